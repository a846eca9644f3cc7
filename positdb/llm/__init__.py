"""Training-data operators: deduplication, classification, scoring, mixing and packing of a text corpus."""
