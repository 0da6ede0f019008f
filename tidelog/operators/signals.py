"""Control signals: which are for us, and what state they lead to."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import DEFAULTS

EXECUTE, STOP, PAUSE, RESUME = "execute-snapshot", "stop-snapshot", "pause-snapshot", "resume-snapshot"
KNOWN = (EXECUTE, STOP, PAUSE, RESUME)
WATERMARKS = ("snapshot-window-open", "snapshot-window-close")


def accepted(signals: DataFrame, connector: str, key: str = "key", value: str = "value") -> DataFrame:
    """Signals from an external channel that are meant for this connector and readable; window marks may not come that way."""
    parsed = F.from_json(value, "id string, type string, data string")
    rows = signals.filter(F.col(key) == connector).withColumn("_s", parsed)
    rows = rows.filter(F.col("_s.id").isNotNull() & F.col("_s.type").isNotNull() & ~F.col("_s.type").isin(*WATERMARKS))
    return rows.select(F.col("_s.id").alias("id"), F.col("_s.type").alias("type"), F.coalesce("_s.data", F.lit("{}")).alias("data"))


def completed_signals(signals: DataFrame, arrival: str = "arrival", keep: int = DEFAULTS["completed_signals"]) -> DataFrame:
    """The last ``keep`` distinct completed ids; one that comes again counts as new."""
    last = signals.groupBy("id").agg(F.max(arrival).alias("last"))
    return last.orderBy(F.col("last").desc(), "id").limit(keep)


def expand_collections(tables: DataFrame, patterns: list[str], name: str = "name") -> DataFrame:
    """Known tables that a signal's patterns cover (full match), each once, in order."""
    some = F.lit(False)
    for p in patterns:
        some = some | F.col(name).rlike(f"^(?:{p})$")
    return tables.filter(some).select(name).distinct().orderBy(name)


def paused(signals: DataFrame, arrival: str = "arrival") -> DataFrame:
    """After each signal, whether snapshots are paused (pausing and resuming twice changes nothing)."""
    last = F.last(F.when(F.col("type") == PAUSE, True).when(F.col("type") == RESUME, False), ignorenulls=True)
    at = W.partitionBy("connector").orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    return signals.withColumn("paused", F.coalesce(last.over(at), F.lit(False)))


@dataclass
class SnapshotState:
    """The incremental snapshot of one connector; control signals are few and come in order, so this is plain Python."""

    known: list[str]
    keep: int = DEFAULTS["completed_signals"]
    active: str | None = None
    collections: list[str] = field(default_factory=list)
    condition: dict[str, str] = field(default_factory=dict)
    at: int = 0
    last_key: tuple | None = None
    is_paused: bool = False
    completed: OrderedDict[str, None] = field(default_factory=OrderedDict)

    def complete(self) -> None:
        if self.active is not None:
            self.completed.pop(self.active, None)
            self.completed[self.active] = None
            while len(self.completed) > self.keep:
                self.completed.popitem(last=False)
        self.active, self.collections, self.condition, self.at, self.last_key = None, [], {}, 0, None

    def handle(self, signal_id: str, kind: str, data: str = "{}") -> str:
        """Applies a signal; says what it did: started, duplicate, busy, stopped, reduced, paused, resumed, ignored."""
        body = json.loads(data or "{}")
        if kind == EXECUTE:
            if signal_id in self.completed or signal_id == self.active:
                return "duplicate"
            if self.active is not None:
                return "busy"
            if str(body.get("type", "incremental")).lower() != "incremental":
                raise ValueError("only incremental snapshots can be asked for")
            patterns = body.get("data-collections") or []
            if not patterns:
                raise ValueError("a snapshot needs a data collection")
            conditions = {c["data-collection"]: c["filter"] for c in body.get("additional-conditions", [])}
            if any(not c.strip() for c in conditions.values()):
                raise ValueError("an additional condition is empty")
            chosen = sorted({t for t in self.known for p in patterns if re.fullmatch(p, t)})
            self.active, self.collections, self.at, self.last_key = signal_id, chosen, 0, None
            self.condition = {t: f for t in chosen for p, f in conditions.items() if re.fullmatch(p, t, re.IGNORECASE)}
            return "started"
        if kind == STOP:
            if self.active is None:
                return "ignored"
            patterns = body.get("data-collections") or []
            gone = {t for t in self.collections for p in patterns if re.fullmatch(p, t)}
            if not patterns or gone >= set(self.collections[self.at :]):
                self.complete()
                return "stopped"
            now = self.collections[self.at]
            before = sum(1 for t in self.collections[: self.at] if t in gone)
            self.collections = [t for t in self.collections if t not in gone]
            self.at -= before
            if now in gone:
                self.last_key = None
            return "reduced"
        if kind in (PAUSE, RESUME):
            self.is_paused = kind == PAUSE
            return "paused" if self.is_paused else "resumed"
        return "ignored"

    def advance(self, rows: int, size: int, last_key: tuple | None, maximum: tuple | None) -> bool:
        """After a chunk; whether its collection is done. The snapshot is complete after the last one."""
        done = rows == 0 or rows < size or last_key == maximum
        self.last_key = None if done else last_key
        self.at += done
        if self.at >= len(self.collections):
            self.complete()
        return done


def retry_delay(attempt: Column, initial_ms: int = DEFAULTS["retry_initial_ms"], max_ms: int = DEFAULTS["retry_max_ms"]) -> Column:
    """Milliseconds before a retry (attempts count from 0): doubling up to the maximum."""
    return F.least(F.lit(max_ms).cast("bigint"), (F.lit(initial_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)))).cast("bigint"))
