"""Ordinals, commit boundaries, batches, guards.

The log is ordered per transaction and per key, each in its own partition of the data;
a total order is only produced where a sink asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import COMMIT, DATA, HEARTBEAT, SNAPSHOT_COMPLETE


def event_serial(log: DataFrame, coordinate: Sequence[str], arrival: Sequence[str], name: str = "event_serial") -> DataFrame:
    """1-based ordinal among records with the same log coordinate."""
    return log.withColumn(name, F.row_number().over(W.partitionBy(*coordinate).orderBy(*arrival)).cast("bigint"))


def transaction_order(log: DataFrame, tx: str = "txid", table: str = "tbl", arrival: Sequence[str] = ("lsn",)) -> DataFrame:
    """Adds ``total_order`` (in the transaction) and ``collection_order`` (in the transaction and table).

    The second window's partition key extends the first, so one shuffle by transaction serves both.
    """
    return log.withColumns({
        "total_order": F.row_number().over(W.partitionBy(tx).orderBy(*arrival)).cast("bigint"),
        "collection_order": F.row_number().over(W.partitionBy(tx, table).orderBy(*arrival)).cast("bigint"),
    })


def by_ranges(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """``df`` cut into ranges of ``order`` with about equal numbers of rows: ``_range`` numbers them in order.

    The bounds are quantiles, which Spark samples from the keys, so sparse or skewed keys make no difference;
    rows of one key are in one range. A range is a partition: what is done per range needs no further shuffle of
    the whole, and there are as many ranges as shuffle partitions, whatever the size of the table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id())


#: Rows of a range, about, and the number of ranges at most.
RANGE_ROWS, MAX_RANGES = 65_536, 4_096


def range_bounds(df: DataFrame, key: str, rows: int | None = None) -> list[int]:
    """Upper bounds of all ranges but the last, so that each holds about ``rows`` rows: quantiles of an integer key, in one pass.

    Sparse, clustered or skewed keys make no difference; rows of one key are in one range.
    """
    cuts = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    facts = df.agg(F.count("*").alias("n"), F.percentile_approx(F.col(key).cast("bigint"), F.array(*map(F.lit, cuts)), F.lit(4 * MAX_RANGES)).alias("q")).first()
    n = min(MAX_RANGES, -(-facts["n"] // (rows or RANGE_ROWS)))
    if n < 2 or not facts["q"]:
        return []
    return sorted({facts["q"][i * MAX_RANGES // n - 1] for i in range(1, n)})


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below a key: a binary search in a constant array, 0 for a null key."""
    steps = len(bounds).bit_length()
    if not steps:
        return F.lit(0)
    high = F.array(*map(F.lit, bounds + [2**63 - 1] * ((1 << steps) - len(bounds)))).cast("array<bigint>")
    at = F.lit(0)
    for step in (1 << k for k in reversed(range(steps))):
        # a lambda binds the place found so far, which the next step reads twice
        at = F.transform(F.array(at), lambda i: F.when(F.get(high, i + (step - 1)) < key, i + step).otherwise(i))[0]  # noqa: B023
    return at


def global_ordinal(df: DataFrame, lead: str, order: Sequence[str], name: str = "ordinal", group: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """A dense 1-based ordinal over the whole table (or each ``group``), without gathering it in one task.

    Rows are cut into ranges of the leading integer key by its quantiles; the sizes of the
    ranges are summed up in order (one row a range and group), and rows are numbered within their range.
    """
    placed = df.withColumn("_range", range_of(F.col(lead).cast("bigint"), range_bounds(df, lead, rows)))
    sizes = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_range") if group else W.orderBy("_range")
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = placed.withColumn("_at", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)))
    return numbered.join(offsets, [*group, "_range"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_range", "_before", "_at")


def commit_boundaries(log: DataFrame, tx: str = "commit_lsn", order: Sequence[str] = ("change_lsn",)) -> DataFrame:
    """Marks the last change of each commit (the next row belongs to another one): data or transaction_commit."""
    following = F.lead(tx).over(W.partitionBy(tx).orderBy(*order))
    return log.withColumn("boundary", F.when(following.isNull(), COMMIT).otherwise(DATA))


def complete_commits(page: DataFrame, limit: int, tx: str = "commit_lsn", order: Sequence[str] = ("commit_lsn", "change_lsn")) -> DataFrame:
    """Of a page of ``limit`` + 1 changes, those of commits that are certain to be whole.

    The extra row is looked at only: if there is one, the last commit may go on behind it.
    """
    rows = page.orderBy(*order).limit(limit + 1)
    seen = rows.agg(F.count("*").alias("_n"), F.max(tx).alias("_last"))
    return rows.crossJoin(F.broadcast(seen)).filter((F.col("_n") <= limit) | (F.col(tx) < F.col("_last"))).drop("_n", "_last")


def batch_ids(records: DataFrame, tx: str, order: Sequence[str], max_batch: int, encoded: Column | None = None) -> DataFrame:
    """Adds ``batch_in_tx``: the flush a record belongs to, counted within its transaction.

    A commit always flushes, so no batch spans transactions; within one, records are
    flushed as soon as ``max_batch`` encoded ones wait. ``encoded`` is how many records a change
    is encoded as (a delete with its tombstone: 2), and a flush may overshoot by that.
    With one record a change the rule is a division. Else a batch's end depends on where the one
    before ended: sorted transactions pass through a fold that holds two numbers, so a
    transaction of any length takes linear time and no memory.
    """
    at = W.partitionBy(tx).orderBy(*order)
    if encoded is None:
        return records.withColumn("batch_in_tx", F.floor((F.row_number().over(at) - 1) / max_batch).cast("bigint"))
    schema = T.StructType([*records.schema.fields, T.StructField("batch_in_tx", T.LongType())])
    names = records.columns
    sized = records.withColumn("_n", encoded.cast("bigint")).repartition(tx).sortWithinPartitions(tx, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, held = None, 0, 0
        for rows in batches:
            out = []
            for t, n in zip(rows.column(tx).to_pylist(), rows.column("_n").to_pylist(), strict=True):
                if t != now:
                    now, batch, held = t, 0, 0
                out.append(batch)
                held += n or 0
                if held >= max_batch:
                    batch, held = batch + 1, 0
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(out, pa.int64())], [*names, "batch_in_tx"])

    return sized.mapInArrow(fold, schema)


def flush_trigger(boundary: Column, encoded: Column, max_batch: int) -> Column:
    """Whether a record makes the pipeline flush, given how many encoded records wait."""
    return (
        F.when(boundary.isin(SNAPSHOT_COMPLETE, COMMIT), True)
        .when(boundary == DATA, encoded >= max_batch)
        .when(boundary == HEARTBEAT, encoded == 0)
        .otherwise(False)
    )


def order_violations(records: DataFrame, position: str, arrival: str, partition: Sequence[str], rows: int | None = None) -> DataFrame:
    """Records whose position lies before that of the record that arrived before them.

    Neighbours are compared within ranges of the (integer) arrival, cut by its quantiles; the first of a range
    is compared with the last of the range before, of which there is one row each. So a
    log of few, large partitions is still checked in parallel.
    """
    placed = records.withColumn("_range", range_of(F.col(arrival).cast("bigint"), range_bounds(records, arrival, rows)))
    ends = placed.groupBy(*partition, "_range").agg(F.max_by(position, arrival).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(W.partitionBy(*partition).orderBy("_range"))).drop("_last")
    last = F.lag(position).over(W.partitionBy(*partition, "_range").orderBy(arrival))
    found = placed.withColumn("_lag", last).join(ends, [*partition, "_range"])
    return found.withColumn("previous", F.coalesce("_lag", "_before")).drop("_lag", "_before", "_range").filter(F.col(position) < F.col("previous"))


def skip_replayed(records: DataFrame, position: Column, resume: Column, lead: tuple[str, int] | None = None) -> DataFrame:
    """Records after the resume position.

    ``lead`` names the integer column that leads the position, and its value there: a bound that
    follows from the order and that, unlike the comparison of whole positions, reaches the scan.
    """
    rows = records.filter(F.col(lead[0]) >= lead[1]) if lead else records
    return rows.filter(position > resume)
