"""Keeping a store current from a stream: every micro-batch runs one build tick; background work is a stream of its own.

The file source does not report rewritten, moved or deleted files, so it only wakes the tick; the tick itself compares
the listing with the store. A tick that fails is counted and the stream lives on, as what it left undone is found
again; after some failures in a row the error ends the stream. Background work (embedding, texts of attachments) has
its own query and checkpoint, does a bounded share each time, and finds what is pending by the rows' own state, so a
restart goes on where it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postlake.operators import store as stores

#: Changes after which the index is looked over for merges, and failures in a row that end a stream.
OPTIMIZE, FAILURES = 2000, 5
_FILES = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class Watch:
    """What a watch loop does each tick, and what came of it."""

    store: stores.Store
    root: str
    clock: Callable[[], int] = lambda: int(time.time())
    exclude: tuple[str, ...] = ()
    #: After each build: what must stay level with the store, such as an index.
    level: tuple[Callable[[stores.Store], None], ...] = ()
    #: Each call does a bounded share of pending work.
    background: tuple[Callable[[stores.Store], None], ...] = ()
    optimize: Callable[[stores.Store], None] | None = None
    build: Callable[[], stores.Built] | None = None
    failures: int = FAILURES
    ticks: list[stores.Built] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    in_a_row: dict[str, int] = field(default_factory=dict)
    optimized_at: int = 0

    def _guarded(self, name: str, work: Callable[[], None]) -> None:
        try:
            work()
            self.in_a_row[name] = 0
        except Exception as e:  # one bad tick must not end the loop; the difference finds its work again
            self.errors.append(f"{name}: {type(e).__name__}: {e}")
            self.in_a_row[name] = self.in_a_row.get(name, 0) + 1
            if self.in_a_row[name] >= self.failures:
                raise

    def tick(self, batch: DataFrame | None = None, number: int = 0) -> None:
        """One build, then what must be level with it, then upkeep if it is due."""
        self._guarded("tick", self._tick)

    def _tick(self) -> None:
        self.ticks.append(self.build() if self.build else stores.build(self.store, self.root, self.clock(), list(self.exclude)))
        for work in self.level:
            work(self.store)
        changes = int(self.store.state().get("changes", 0))
        if self.optimize and changes - self.optimized_at >= OPTIMIZE:
            self.optimize(self.store)
            self.optimized_at = changes

    def work(self, batch: DataFrame | None = None, number: int = 0) -> None:
        """A bounded share of each kind of background work."""
        for k, work in enumerate(self.background):
            self._guarded(f"background {k}", lambda: work(self.store))

    def start_background(self, checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
        """A second query beside ``start``, with a checkpoint of its own; without ``every`` it does one share and ends."""
        writer = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(self.work).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()

    def start(self, checkpoint: str, every: str | None = "500 milliseconds", polling: bool = False) -> StreamingQuery:
        """A streaming query that ticks on new files, or every ``every`` when ``polling``; without ``every`` it catches up and ends."""
        spark = self.store.spark
        if polling:
            source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        else:
            source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.emlx").load(self.root).select("path", "length")
        writer = source.writeStream.foreachBatch(self.tick).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
