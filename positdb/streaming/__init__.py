"""Row delivery by iterators and callbacks, and snapshots over streams of posits."""
