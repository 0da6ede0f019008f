"""Snapshots: initial reads, keyset chunks, and chunks interleaved with the log.

A chunk is a range of the primary key below a frozen maximum. While it is open, log
events for its keys evict its rows; what is left is emitted where the window closes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.positions import behind, upto
from .ordering import global_ordinal

MODES = ("initial", "never", "when_needed")


def snapshot_action(mode: Column, completed: Column, history_missing: Column, log_lost: Column) -> Column:
    """snapshot, stream or error, before a source starts."""
    lost = history_missing | log_lost
    return (
        F.when((mode == "initial") & ~completed, "snapshot")
        .when((mode == "when_needed") & (~completed | lost), "snapshot")
        .when(lost, "error")
        .otherwise("stream")
    )


def includes(name: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Full-match selection of ``schema.table``: exclude wins, an empty include list means all."""
    anchored = lambda p: name.rlike(f"^(?:{p})$")
    chosen = reduce(Column.__or__, map(anchored, include), F.lit(False)) if include else F.lit(True)
    return chosen & ~reduce(Column.__or__, map(anchored, exclude), F.lit(False))


def initial_snapshot(tables: Sequence[tuple[str, DataFrame, str]], anchor: int) -> DataFrame:
    """Read events of all tables in name order: table, pk, op, anchor, and a dense ordinal over the whole snapshot.

    ``tables`` are (name, rows, integer primary key). Rows are numbered by ranges of their
    table's key; no task sees a whole table.
    """
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table"), F.col(pk).cast("bigint").alias("pk")) for name, df, pk in sorted(tables, key=lambda t: t[0])])
    numbered = global_ordinal(rows, "pk", ["pk"], name="_in_table", group=["table"])
    sizes = rows.groupBy("table").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("table").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = numbered.join(F.broadcast(sizes.select("table", "_before")), "table")  # a row a table
    return out.select("table", "pk", F.lit("r").alias("op"), F.lit(anchor).cast("bigint").alias("lsn"), (F.col("_before") + F.col("_in_table")).cast("bigint").alias("event_serial"))


def next_chunk(table: DataFrame, key: Sequence[str], after: Sequence | None, maximum: Sequence, size: int, condition: str | None = None) -> DataFrame:
    """The next ``size`` rows by key, behind ``after`` and not beyond ``maximum``."""
    bound = upto(key, maximum) if after is None else behind(key, after) & upto(key, maximum)
    rows = table.filter(bound)
    return (rows.filter(F.expr(condition)) if condition else rows).orderBy(*key).limit(size)


def maximum_key(table: DataFrame, key: Sequence[str], condition: str | None = None) -> DataFrame:
    """One row: the largest key, under a condition."""
    rows = table.filter(F.expr(condition)) if condition else table
    return rows.agg(F.max(F.struct(*key)).alias("m")).select(*[F.col("m")[k].alias(k) for k in key])


def chunk_plan(table: DataFrame, key: str, size: int) -> DataFrame:
    """All chunks of a table at once: chunk, first and last key, rows; every row is in exactly one."""
    numbered = global_ordinal(table.select(F.col(key).cast("bigint").alias(key)), key, [key])
    chunk = F.expr(f"(ordinal - 1) div {size}")
    return numbered.groupBy(chunk.alias("chunk")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("rows"))


def chunk_done(rows: Column, size: Column | int, last: Column, maximum: Column) -> Column:
    """Whether a chunk is the collection's last: it is empty, short, or ends at the maximum."""
    return (rows == 0) | (rows < size) | F.coalesce(last == maximum, F.lit(False))


def evict_touched(chunk: DataFrame, log: DataFrame, key: Sequence[str], low: int, high: int, position: str = "lsn", open_low: bool = True) -> DataFrame:
    """Chunk rows whose key no log event in the window touches; the log's images are looked at before any masking.

    ``open_low``: the window is (low, high]; else [low, high).
    """
    inside = (F.col(position) > low) & (F.col(position) <= high) if open_low else (F.col(position) >= low) & (F.col(position) < high)
    return chunk.join(log.filter(inside).select(*key).distinct(), list(key), "left_anti")


def readonly_window(events: DataFrame, low_xmin: int, low_xmax: int, high_xmin: int, high_xmax: int, xid: str = "xid", is_commit: str = "is_commit") -> DataFrame:
    """Marks log entries against a window given by two transaction snapshots: ``opens``, ``closes``, ``inside``."""
    x, commit = F.col(xid), F.col(is_commit)
    closes = F.when(commit, (x == high_xmax) | (x <= high_xmin)).otherwise(x > max(high_xmax, low_xmax))
    opens = x >= low_xmin
    return events.withColumns({"opens": opens, "closes": closes, "inside": opens & ~closes})


def surrogate_problems(table: DataFrame, column: str) -> DataFrame:
    """One row: nulls and repeated values of a column that is to order a snapshot, and whether it may."""
    repeated = table.filter(F.col(column).isNotNull()).groupBy(column).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, 1).otherwise(0)), F.lit(0)).alias("repeated_keys"))
    nulls = table.agg(F.coalesce(F.sum(F.col(column).isNull().cast("bigint")), F.lit(0)).alias("null_keys"))
    return nulls.crossJoin(repeated).select("null_keys", "repeated_keys", ((F.col("null_keys") == 0) & (F.col("repeated_keys") == 0)).alias("valid"))


def hand_off(snapshot: DataFrame, stream: DataFrame) -> DataFrame:
    """Snapshot rows, then the stream behind the snapshot's anchor; ``phase`` says which."""
    anchor = snapshot.agg(F.max("lsn").alias("_anchor"))
    after = stream.crossJoin(F.broadcast(anchor)).filter(F.col("lsn") > F.coalesce("_anchor", F.lit(-1))).drop("_anchor")  # one row
    return snapshot.withColumn("phase", F.lit("snapshot")).unionByName(after.withColumn("phase", F.lit("stream")), allowMissingColumns=True)
