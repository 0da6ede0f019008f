"""Which records go on: tables, signals, repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import range_bounds, range_of
from .snapshot import includes


def business_tables(records: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), signal_table: str | None = None, table: str = "tbl") -> DataFrame:
    """Records of selected tables; the signal table is never one of them."""
    chosen = includes(F.col(table), include, exclude)
    return records.filter(chosen & (F.col(table) != signal_table) if signal_table else chosen)


def require_known(records: DataFrame, known: Sequence[str], table: str = "tbl") -> DataFrame:
    """Stops the query at a record of a table whose schema is not known."""
    name = F.col(table)
    return records.withColumn(table, F.when(name.isin(*known), name).otherwise(F.raise_error(F.concat(F.lit("no schema for table "), F.coalesce(name, F.lit("null"))))))


def skip_repeated(records: DataFrame, record_id: str, arrival: str, rows: int | None = None) -> DataFrame:
    """Drops a record whose id is that of the record before it.

    Neighbours are compared within ranges of the integer arrival (cut by its quantiles), and the first of a range with the last of the one before.
    """
    placed = records.withColumn("_range", range_of(F.col(arrival).cast("bigint"), range_bounds(records, arrival, rows)))
    ends = placed.groupBy("_range").agg(F.max_by(record_id, arrival).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(W.orderBy("_range"))).drop("_last")  # a row a range
    at = W.partitionBy("_range").orderBy(arrival)
    found = placed.withColumns({"_n": F.row_number().over(at), "_lag": F.lag(record_id).over(at)}).join(ends, "_range")
    previous = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))
    return found.filter(~F.col(record_id).eqNullSafe(previous)).drop("_n", "_lag", "_before", "_range")


#: Capture rows that may be broadcast.
MAX_CAPTURES = 100_000


def with_capture(log: DataFrame, captures: DataFrame, key: str = "capture") -> DataFrame:
    """Log rows with what is known of their capture instance; rows of others go. The table of captures is counted before it is broadcast."""
    few = captures.limit(MAX_CAPTURES + 1).count() <= MAX_CAPTURES
    return log.join(F.broadcast(captures) if few else captures, key)
