"""Delivery of result rows one by one, and queries that run beside the caller and can be cancelled."""

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from positdb.engine import Engine, Result
from positdb.errors import Cancelled


def events(engine: Engine, script: str) -> Iterator[tuple]:
    """What happens as the searches of a script deliver rows, a partition at a time.

    ("start", number of the result, result), ("row", number, row, types of its cells), ("end", number, rows, limited).
    Sending False to a row ends its result.
    """
    for k, result in enumerate(engine.commands(script)):
        yield "start", k, result
        n = 0
        for row, types in result.iterate_typed():
            n += 1
            if (yield "row", k, row, types) is False:
                break
        limit = result.compiled.limit
        yield "end", k, n, limit is not None and n >= limit


def stream(engine: Engine, script: str) -> Iterator[tuple[int, list[str]]]:
    """(number of the result, row) of all searches of a script, in order."""
    for kind, k, *rest in events(engine, script):
        if kind == "row":
            yield k, rest[0]


@dataclass
class Callbacks:
    """What a consumer of several results gets told.  ``row`` may return False to end its result."""

    start: Callable[[int, Result], None] = lambda k, result: None
    row: Callable[[int, list[str], list[str]], bool | None] = lambda k, row, types: None
    end: Callable[[int, int, bool], None] = lambda k, rows, limited: None


def deliver(engine: Engine, script: str, to: Callbacks) -> int:
    """Runs a script and tells ``to``; returns the number of results."""
    happening, said, k = events(engine, script), None, -1
    while True:
        try:
            kind, k, *rest = happening.send(said)
        except StopIteration:
            return k + 1
        said = getattr(to, kind)(k, *rest)


_END = object()


@dataclass
class Running:
    """A script that runs in a thread of its own.  Iterating gives (result, row), ``events`` all that happens; errors are raised there."""

    engine: Engine
    script: str
    timeout: float | None = None
    id: str = field(default_factory=lambda: f"positdb-{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self._rows: queue.Queue = queue.Queue(256)
        self._cancelled = threading.Event()
        self._ends = time.monotonic() + self.timeout if self.timeout is not None else None
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _put(self, item) -> None:
        while not self._cancelled.is_set():
            try:
                return self._rows.put(item, timeout=0.1)
            except queue.Full:
                continue

    def _run(self) -> None:
        spark = self.engine.store.spark
        try:
            spark.addTag(self.id)
            for item in events(self.engine, self.script):
                self._put(item)
                if self._cancelled.is_set():
                    return
            self._put(_END)
        except Exception as e:  # handed to the reader
            self._put(e)
        finally:
            spark.removeTag(self.id)

    def cancel(self) -> None:
        """Stops the jobs of this script; readers get ``Cancelled``."""
        self._cancelled.set()
        self.engine.store.spark.interruptTag(self.id)

    def __iter__(self) -> Iterator[tuple[int, list[str]]]:
        for kind, k, *rest in self.events():
            if kind == "row":
                yield k, rest[0]

    def events(self) -> Iterator[tuple]:
        while True:
            if self._ends is not None and time.monotonic() > self._ends:
                self.cancel()
            if self._cancelled.is_set():
                raise Cancelled("The query was cancelled or took too long")
            try:
                item = self._rows.get(timeout=0.1)
            except queue.Empty:
                continue
            if item is _END:
                return
            if isinstance(item, Exception):
                raise item
            yield item
