"""The record pipeline on Structured Streaming: sink, then checkpoint, then acknowledgement.

A micro-batch is one delivery. It is written to the sink, retried as a whole where the
sink says that it may be; then the connector's state is stored under Spark's batch id;
then sources and signals are acknowledged. A batch that is run again after a crash
delivers the same records under the same ids: at least once, with ids to drop repeats by.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import COMMIT, DEFAULTS, SNAPSHOT_COMPLETE

if TYPE_CHECKING:
    from .incremental import IncrementalSnapshots

STORAGE_VERSION = 2


class RetryableSinkError(Exception):
    """The sink may take the same batch later."""


class StateError(Exception):
    """The stored state does not fit; nothing may be delivered."""


class Sink(Protocol):
    def write(self, batch: DataFrame, batch_id: int | str) -> None: ...


class FileSink:
    """Records in the column layout of Spark's Kafka sink: topic, key, value, headers. A batch that comes again overwrites itself."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


class StdoutSink:
    """One payload a line, ``null`` for a tombstone; rows come to the driver one partition at a time."""

    def write(self, batch: DataFrame, batch_id: int) -> None:
        for row in batch.select(F.col("value").cast("string")).toLocalIterator():
            print("null" if row[0] is None else row[0], flush=True)


class KafkaSink:
    """Spark's Kafka sink, where its connector is on the classpath; order is kept per key."""

    RESERVED = ("kafka.bootstrap.servers", "kafka.acks", "kafka.enable.idempotence")

    def __init__(self, servers: str, **options: str):
        bad = [k for k in options if k in self.RESERVED]
        if bad:
            raise ValueError(f"reserved: {bad}")
        self.options = {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.enable.idempotence": "true"} | options

    def write(self, batch: DataFrame, batch_id: int) -> None:
        headers = F.transform(F.map_entries("headers"), lambda h: F.struct(h["key"].alias("key"), h["value"].cast("binary").alias("value")))
        batch.select("topic", "key", "value", headers.alias("headers")).write.format("kafka").options(**self.options).save()


@dataclass
class Checkpoint:
    connector: str
    generation: str
    position: dict | None
    snapshot_completed: bool
    fingerprint: str
    batch_id: int
    updated_at: float
    state: dict | None = None
    storage_version: int = STORAGE_VERSION


class CheckpointStore:
    """One JSON file a connector, replaced atomically and synced; a newer storage version is refused."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, connector: str) -> Path:
        return self.folder / f"{hashlib.sha256(connector.encode()).hexdigest()[:32]}.json"

    def load(self, connector: str) -> Checkpoint | None:
        path = self._path(connector)
        if not path.exists():
            return None
        data = json.loads(path.read_text())
        if data.get("storage_version", 1) > STORAGE_VERSION:
            raise StateError(f"state of storage version {data['storage_version']}")
        return Checkpoint(**data)

    def save(self, checkpoint: Checkpoint) -> None:
        path = self._path(checkpoint.connector)
        part = path.with_suffix(".part")
        with part.open("w") as f:
            json.dump(asdict(checkpoint), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)

    def delete(self, connector: str) -> None:
        self._path(connector).unlink(missing_ok=True)


def fingerprint(config: dict, leave_out: tuple[str, ...] = ("password", "token", "secret", "runtime", "fetch_size", "retry", "poll_interval_ms", "log")) -> str:
    """A hash of what identifies a connector's data: secrets and tuning do not count."""

    def kept(x):
        return {k: kept(v) for k, v in sorted(x.items()) if k not in leave_out} if isinstance(x, dict) else [kept(v) for v in x] if isinstance(x, list) else x

    return hashlib.sha256(json.dumps(kept(config), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def retry_delays(retries: int = DEFAULTS["max_retries"], initial_ms: int = DEFAULTS["retry_initial_ms"], max_ms: int = DEFAULTS["retry_max_ms"]):
    """Delays before each retry; -1 never ends."""
    n, delay = 0, initial_ms
    while retries < 0 or n < retries:
        yield min(delay, max_ms)
        n, delay = n + 1, min(delay * 2, max_ms)


def write_with_retry(sink: Sink, batch: DataFrame, batch_id: int, cancelled: threading.Event, retries: int = DEFAULTS["max_retries"], initial_ms: int = DEFAULTS["retry_initial_ms"], max_ms: int = DEFAULTS["retry_max_ms"]) -> int:
    """Writes a batch, again and again while the sink allows; the number of retries. Cancelling ends a wait at once."""
    delays, n = retry_delays(retries, initial_ms, max_ms), 0
    while True:
        try:
            sink.write(batch, batch_id)
            return n
        except RetryableSinkError:
            delay = next(delays, None)
            if delay is None or cancelled.wait(delay / 1000):
                raise
            n += 1


#: Lifecycle: which state may follow which.
TRANSITIONS = {
    "created": {"starting", "failed"}, "starting": {"snapshotting", "streaming", "stopping", "failed"}, "snapshotting": {"streaming", "stopping", "failed"},
    "streaming": {"snapshotting", "stopping", "failed"}, "stopping": {"stopped", "failed"}, "stopped": {"starting"}, "failed": {"starting"},
}


@dataclass
class Status:
    state: str = "created"
    delivered: int = 0
    failed: int = 0
    retries: int = 0
    last_source_us: int | None = None
    queued: int = 0
    restarts: int = 0
    late_acknowledgements: int = 0

    def to(self, state: str) -> None:
        if state != self.state:
            if state not in TRANSITIONS[self.state]:
                raise ValueError(f"{self.state} cannot become {state}")
            self.state = state

    def lag_ms(self, now: float | None = None) -> int | None:
        return None if self.last_source_us is None else max(0, int((now or time.time()) * 1000) - self.last_source_us // 1000)

    def metrics(self, connector: str) -> str:
        """In the text format of metric scrapers."""
        values = {"delivered_total": self.delivered, "failed_total": self.failed, "retries_total": self.retries, "queue_depth": self.queued, "restarts_total": self.restarts, "source_lag_ms": self.lag_ms(), "up": int(self.state in ("snapshotting", "streaming"))}
        return "".join(f'tidelog_{k}{{connector="{connector}"}} {v}\n' for k, v in values.items() if v is not None)


@dataclass
class Connector:
    """Runs a stream of records into a sink.

    ``records`` has the sink's columns, and ``boundary``, ``pos`` (a sortable struct), ``source_us``.
    ``config`` is what the fingerprint is taken of; ``acknowledge`` is told the position after it is stored.
    """

    name: str
    sink: Sink
    store: CheckpointStore
    config: dict = field(default_factory=dict)
    acknowledge: Callable[[dict | None, int], None] = lambda position, batch_id: None
    acknowledge_mode: str = "connector"  # or manual
    acknowledge_timeout_s: float | None = None
    acknowledge_late: str = "fail"  # or warn, ignore
    retries: int = DEFAULTS["max_retries"]
    retry_initial_ms: int = DEFAULTS["retry_initial_ms"]
    retry_max_ms: int = DEFAULTS["retry_max_ms"]
    heartbeat_topic: str | None = None
    heartbeat_ms: int = 0
    last_heartbeat: float = 0.0
    incremental: IncrementalSnapshots | None = None
    lock: threading.RLock = field(default_factory=threading.RLock)
    steps: int = 0
    query: StreamingQuery | None = None
    status: Status = field(default_factory=Status)
    cancelled: threading.Event = field(default_factory=threading.Event)

    def open(self) -> Checkpoint | None:
        """The stored checkpoint; refused if it was written under another configuration."""
        self.status.to("starting")
        found = self.store.load(self.name)
        if found and found.fingerprint != fingerprint(self.config):
            self.status.to("failed")
            raise StateError("the configuration has changed since the checkpoint was written")
        self.status.to("streaming" if found and found.snapshot_completed else "streaming" if self._mode() == "never" else "snapshotting")
        self.generation = found.generation if found else str(uuid.uuid4())
        if self.incremental and found:
            self.incremental.restore(found.state)
        return found

    def _mode(self) -> str:
        snapshot = self.config.get("snapshot", "initial")
        return snapshot.get("mode", "initial") if isinstance(snapshot, dict) else snapshot

    def with_heartbeat(self, out: DataFrame) -> DataFrame:
        """``out`` and a heartbeat at its end, if one is due."""
        now = time.time()
        if not self.heartbeat_topic or (now - self.last_heartbeat) * 1000 < self.heartbeat_ms:
            return out
        self.last_heartbeat = now
        key, value = json.dumps({"serverName": self.name}, separators=(",", ":")), json.dumps({"ts_ms": int(now * 1000)}, separators=(",", ":"))
        beat = out.sparkSession.range(1).select(F.lit(self.heartbeat_topic).alias("topic"), *[F.lit(v).cast(out.schema[c].dataType).alias(c) for c, v in (("key", key), ("value", value))], F.create_map(F.lit("tidelog.heartbeat"), F.lit("true")).alias("headers"))
        return out.unionByName(beat)

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        """The body of ``foreachBatch``."""
        with self.lock:
            self._deliver(batch, batch_id)

    def step(self) -> bool:
        """Without a batch: delivers the open chunk of an incremental snapshot and opens the next; whether there is more to do."""
        with self.lock:
            last = self.store.load(self.name)
            if self.incremental is None or last is None or last.position is None:
                return False
            self.incremental.open()
            rows = self.incremental.close(None, int(last.position.get("lsn") or 0))
            if rows is not None:
                self.steps += 1
                self.status.retries += write_with_retry(self.sink, rows, f"{last.batch_id}-{self.generation[:8]}-{time.time_ns()}", self.cancelled, self.retries, self.retry_initial_ms, self.retry_max_ms)
            self.store.save(replace(last, state=self.incremental.store(), updated_at=time.time()))
            self.incremental.stored()
            return self.incremental.state.active is not None and not self.incremental.state.is_paused

    def _deliver(self, batch: DataFrame, batch_id: int) -> None:
        last = self.store.load(self.name)
        if last and batch_id <= last.batch_id and last.generation == self.generation:
            return  # delivered and stored before a crash
        seen = F.struct(F.max("pos").alias("pos"), F.count("*").alias("n"), F.max("source_us").alias("us"), F.max(F.col("boundary").isin(SNAPSHOT_COMPLETE)).alias("done"), F.max(F.col("boundary").isin(COMMIT, SNAPSHOT_COMPLETE)).alias("end"))
        batch = batch.persist()
        try:
            facts = batch.agg(seen.alias("f")).first()["f"]
            if not facts["n"]:
                return
            position = facts["pos"].asDict(recursive=True) if facts["pos"] is not None else None
            if last and last.position and position and list(position.values()) < list(last.position.values()):
                raise StateError(f"the position went back: {last.position} to {position}")
            out = batch.filter(F.col("topic").isNotNull()).drop("boundary", "pos", "source_us")
            if self.incremental:
                survivors = self.incremental.close(out, int((position or {}).get("lsn") or 0))
                out = out if survivors is None else out.unionByName(survivors)
            out = self.with_heartbeat(out) if facts["end"] else out  # only behind whole transactions
            try:
                self.status.retries += write_with_retry(self.sink, out, batch_id, self.cancelled, self.retries, self.retry_initial_ms, self.retry_max_ms)
            except Exception:
                self.status.failed += 1
                self.status.to("failed")
                raise
            completed = bool(facts["done"]) or bool(last and last.snapshot_completed)
            plain = None if position is None else {k: int(v) if not isinstance(v, (str, int, type(None))) else v for k, v in position.items()}
            if self.incremental:
                self.incremental.poll()
            self.store.save(Checkpoint(self.name, self.generation, plain, completed, fingerprint(self.config), batch_id, time.time(), self.incremental.store() if self.incremental else None))
            self.status.delivered += facts["n"]
            self.status.last_source_us = facts["us"]
            if facts["done"]:
                self.status.to("streaming")
            self._acknowledge(plain, batch_id)
            if self.incremental:
                self.incremental.stored()
                self.incremental.open()  # its window is the time until the next batch
        finally:
            batch.unpersist()

    def _acknowledge(self, position: dict | None, batch_id: int) -> None:
        """Tells the source what is stored: by itself (``connector``) or not at all (``manual``); a source that does not answer in time is an error, a warning or nothing."""
        if self.acknowledge_mode == "manual":
            return
        done, failed = threading.Event(), []

        def tell() -> None:
            try:
                self.acknowledge(position, batch_id)
            except Exception as e:  # noqa: BLE001
                failed.append(e)
            done.set()

        threading.Thread(target=tell, daemon=True).start()
        in_time = done.wait(self.acknowledge_timeout_s)
        if failed:
            raise failed[0]
        if not in_time:
            self.status.late_acknowledgements += 1
            if self.acknowledge_late == "fail":
                raise TimeoutError("the source did not take the acknowledgement in time")
            if self.acknowledge_late == "warn":
                warnings.warn(f"{self.name}: the source did not take the acknowledgement in time", stacklevel=2)

    def run(self, build: Callable[[], DataFrame], checkpoint_dir: str, available_now: bool = False, transient: Callable[[Exception], bool] = lambda e: False) -> None:
        """Runs until the stream ends or is stopped. A transient failure of the source starts it again from its checkpoint, after growing delays; a batch that was delivered in between begins the count anew."""
        delays, delivered = retry_delays(self.retries, self.retry_initial_ms, self.retry_max_ms), -1
        while True:
            try:
                self.query = self.start(build(), checkpoint_dir, available_now)
                self.query.awaitTermination()
                return
            except Exception as e:
                if self.status.state != "failed":
                    self.status.to("failed")
                if self.status.delivered != delivered:
                    delays, delivered = retry_delays(self.retries, self.retry_initial_ms, self.retry_max_ms), self.status.delivered
                delay = next(delays, None) if transient(e) else None
                if delay is None or self.cancelled.wait(delay / 1000):
                    raise
                self.status.restarts += 1

    def start(self, records: DataFrame, checkpoint_dir: str, available_now: bool = False) -> StreamingQuery:
        self.open()
        writer = records.writeStream.foreachBatch(self.deliver).option("checkpointLocation", checkpoint_dir).queryName(self.name)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{self.config.get('flush_interval_ms', DEFAULTS['flush_interval_ms'])} milliseconds"}
        query = writer.trigger(**trigger).start()
        if self.incremental and not available_now:
            threading.Thread(target=self._idle, daemon=True).start()
        return query

    def _idle(self, interval_s: float = 1.0) -> None:
        while not self.cancelled.wait(interval_s):
            self.step()

    def stop(self, query: StreamingQuery) -> None:
        self.status.to("stopping")
        self.cancelled.set()
        query.stop()
        self.status.to("stopped")
