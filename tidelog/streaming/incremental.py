"""Incremental snapshots that signals ask for, interleaved with a log that is being delivered.

After a micro-batch a chunk of the table is read; that opens its window. The next
micro-batch closes it: rows whose keys the batch touches are evicted, the rest is
delivered behind the batch. When no batch comes, a step on its own closes the window. A
chunk has ``chunk_size`` rows, so it is held on the driver; what is stored is only where the
snapshot stands, and after a crash the open chunk is read again.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.signals import SnapshotState
from ..operators.snapshot import maximum_key, next_chunk
from ..plans.delivery import log_records
from ..sources.tables import read_table, table_entries
from .signal_queue import SignalQueue

#: Signals that are read from the signal folder at once.
MAX_SIGNALS = 10_000


class IncrementalSnapshots:
    """The snapshots of one connector; tables lie under ``snapshot.path`` by name, signals under ``snapshot.signal_path``."""

    def __init__(self, spark: SparkSession, config: Config, queue: SignalQueue | None = None):
        self.spark, self.config, self.queue = spark, config, queue
        self.keys = {t.name: [c.name for c in t.columns if c.key] for t in config.tables}
        self.state = SnapshotState(sorted(self.keys))
        self.handled: set[str] = set()
        self.maximum: tuple | None = None
        self.chunk: tuple[str, DataFrame, int, tuple | None] | None = None
        self.answers: list[tuple[str, str]] = []

    # what is stored

    def store(self) -> dict:
        return {"snapshot": asdict(self.state) | {"completed": list(self.state.completed)}, "handled": sorted(self.handled), "maximum": self.maximum}

    def stored(self) -> None:
        """After the checkpoint: those who wait for a signal's effect go on."""
        if self.queue:
            self.queue.acknowledge()

    def restore(self, stored: dict | None) -> None:
        if stored:
            s = stored["snapshot"]
            self.state = SnapshotState(**s | {"completed": OrderedDict.fromkeys(s["completed"]), "last_key": s["last_key"] and tuple(s["last_key"])})
            self.handled, self.maximum = set(stored["handled"]), stored["maximum"] and tuple(stored["maximum"])

    # signals

    def poll(self) -> None:
        """Handles signals that have come: those of the queue, then those of the folder in the order of their files' names; unreadable lines are dropped."""
        for p in self.queue.take() if self.queue else ():
            self._handle(p.id, p.type, p.data)
        if not self.config.snapshot.signal_path:
            return
        lines = self.spark.read.text(self.config.snapshot.signal_path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.from_json("value", "id string, type string, data string").alias("s"))
        fresh = lines.filter(F.col("s.id").isNotNull() & F.col("s.type").isNotNull()).withColumn("at", F.concat_ws("#", "file", "s.id", "s.type", "s.data")).orderBy("file", "n").limit(MAX_SIGNALS).collect()
        for r in fresh:
            if r["at"] not in self.handled:
                self.handled.add(r["at"])
                self._handle(r["s"]["id"], r["s"]["type"], r["s"]["data"] or "{}")

    def _handle(self, signal_id: str, kind: str, data: str) -> None:
        try:
            self.answers.append((signal_id, self.state.handle(signal_id, kind, data)))
        except ValueError as e:
            self.answers.append((signal_id, f"refused: {e}"))

    # chunks

    def _table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.config.snapshot.path}/{name}")

    def open(self) -> None:
        """Reads the next chunk, if a snapshot is active and none is open."""
        self.poll()
        s, size = self.state, self.config.snapshot.chunk_size
        if s.active is None or s.is_paused or self.chunk is not None:
            return
        if not s.collections:
            s.complete()
            return
        name = s.collections[s.at]
        key, condition, table = self.keys[name], s.condition.get(name), self._table(name)
        if not key:
            raise ValueError(f"{name}: an incremental snapshot needs a key")
        if s.last_key is None:
            found = maximum_key(table, key, condition).first()
            self.maximum = None if found is None or any(v is None for v in found) else tuple(found)
        rows = [] if self.maximum is None else next_chunk(table, key, s.last_key, self.maximum, size, condition).collect()
        self.chunk = (name, self.spark.createDataFrame(rows, table.schema), len(rows), tuple(rows[-1][k] for k in key) if rows else None)

    def close(self, batch: DataFrame | None, anchor: int) -> DataFrame | None:
        """Records of the open chunk that the batch (sink columns) does not touch; the snapshot moves on."""
        if self.chunk is None:
            return None
        (name, rows, n, last), self.chunk = self.chunk, None
        if self.state.active is None or name not in self.state.collections[self.state.at : self.state.at + 1]:
            return None  # stopped meanwhile
        self.state.advance(n, self.config.snapshot.chunk_size, last, self.maximum)
        if not n:
            return None
        schema, _, table = name.rpartition(".")
        entries = table_entries(rows, table, schema, self.keys[name], anchor).withColumn("kind", F.lit("incremental"))
        out = log_records(entries, self.config).filter(F.col("topic").isNotNull()).drop("boundary", "pos", "source_us")
        if batch is not None:
            out = out.join(batch.select("topic", "key").distinct(), ["topic", "key"], "left_anti").select(*out.columns)
        return out


