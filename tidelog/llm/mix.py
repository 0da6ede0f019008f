"""Mixing sources to target weights.

Each source gets a word budget; documents stand in hash-random order within their source
and are taken from the front until the budget is met exactly, whole passes (epochs)
first where the budget is larger than the source.

Plan. One pass over the texts leaves a small table of sizes in the shared folder, from
which everything is decided; a second one gives the result. Sources are summed with map-side combine.
The order of a source is cut into ranges of its hash key, as many as its number of
documents asks for. Range sums give a distributed prefix sum; only the one range in
which a source's budget ends is sorted and summed document by document. What comes out
is one row a source (epochs, and the key where the last pass ends), so documents are
decided row by row: texts are never shuffled, and no source, however large, meets in one
task. (Sources themselves are taken to be few: their rows, one each, are put in order in one task.)

Defined cases. A null text has no words. A null source is a source, last in order. Rows
that agree in source, id and size are alike: where the cut falls on them they share the
words that are left equally, rounded down. A source without words has budget 0. An empty
table gives no rows. Columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS_RE, drop_columns, id_order, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Documents in a key range, about.
RANGE_DOCS = 4_096
#: Source rows that may be broadcast.
BROADCAST_SOURCES = 100_000
ADDED = ["size", "source_size", "target", "taken"]


def n_words(text_col: str) -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(text_col), WS_RE, -1), "")).cast("bigint")


def random_key(id_col: str, seed: str = "") -> Column:
    """A hash-random key in hex; ``seed`` gives another order."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).cast("binary"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, n_docs).

    Shares of the total by weight; a source whose share is above its cap (``max_epochs``
    times its size) stops there and the rest goes to the others by weight. In the order
    of cap over weight the capped sources come first, so running sums find the split.
    """
    by_name, by_ratio, every = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("__tl_ratio", F.col("source").asc_nulls_last()), W.partitionBy()
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("__tl_w", weight).withColumn("__tl_cap", F.col("source_size") * max_epochs)
    s = s.withColumn("__tl_ratio", F.col("__tl_cap").cast("double") / F.col("__tl_w"))
    s = s.withColumns({
        "__tl_rank": F.row_number().over(by_ratio),
        "__tl_num": F.sum("source_size").over(every) - F.coalesce(F.sum("__tl_cap").over(before), F.lit(0)),
        "__tl_den": F.sum("__tl_w").over(every) - F.coalesce(F.sum("__tl_w").over(before), F.lit(0)),
    })
    fits = F.col("__tl_num") * F.col("__tl_w") <= F.col("__tl_cap") * F.col("__tl_den")
    s = s.withColumn("__tl_first", F.min(F.when(fits, F.struct("__tl_rank", "__tl_num", "__tl_den"))).over(every))
    target = F.when(F.col("__tl_rank") < F.col("__tl_first.__tl_rank"), F.col("__tl_cap").cast("double")).otherwise((F.col("__tl_first.__tl_num") * F.col("__tl_w")).cast("double") / F.col("__tl_first.__tl_den"))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words taken from the document, repeats counted)."""
    spark = docs.sparkSession
    docs = drop_columns(docs, ADDED)
    sized = materialize(docs.select(F.col(source_col).cast("string").alias("source"), id_order(F.col(id_col)).alias("__tl_id"), random_key(id_col, seed).alias("__tl_key"), n_words(text_col).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    budget = F.floor(F.col("target") + 0.5)
    plan = source_targets(sources, weights, max_epochs).withColumn("__tl_budget", budget)
    full = F.when(F.col("source_size") > 0, F.expr("__tl_budget div source_size")).otherwise(F.lit(0).cast("bigint"))
    plan = plan.withColumn("__tl_epochs", full).withColumn("__tl_rest", F.col("__tl_budget") - F.col("__tl_epochs") * F.col("source_size"))
    plan = plan.withColumn("__tl_ranges", F.ceil(F.col("n_docs") / RANGE_DOCS)).drop("n_docs")
    plan, small = _local(plan)

    # prefix sums over key ranges, then within the range where the budget ends
    hint = F.broadcast if small else (lambda df: df)
    at = F.expr("shiftright(cast(conv(substr(__tl_key, 1, 8), 16, 10) as bigint) * __tl_ranges, 32)")
    placed = sized.join(hint(plan.select(F.col("source").alias("__tl_s"), "__tl_ranges", "__tl_rest")), F.col("source").eqNullSafe(F.col("__tl_s")))
    placed = placed.filter((F.col("__tl_rest") > 0) & (F.col("size") > 0)).select("source", "__tl_id", "__tl_key", "size", "__tl_rest", at.alias("__tl_range"))
    ranges = placed.groupBy("source", "__tl_range", "__tl_rest").agg(F.sum("size").alias("__tl_sum"))
    upto = W.partitionBy("source").orderBy("__tl_range").rowsBetween(W.unboundedPreceding, 0)
    ranges = ranges.withColumn("__tl_upto", F.sum("__tl_sum").over(upto)).filter((F.col("__tl_upto") >= F.col("__tl_rest")) & (F.col("__tl_upto") - F.col("__tl_sum") < F.col("__tl_rest")))
    ranges, few = _local(ranges.select(F.col("source").alias("__tl_s"), F.col("__tl_range").alias("__tl_r"), (F.col("__tl_upto") - F.col("__tl_sum")).alias("__tl_base")))
    inside = placed.join(F.broadcast(ranges) if few else ranges, F.col("source").eqNullSafe(F.col("__tl_s")) & (F.col("__tl_range") == F.col("__tl_r")))
    order = W.partitionBy("source", "__tl_range").orderBy("__tl_key", "__tl_id", "size")
    alike = W.partitionBy("source", "__tl_range", "__tl_key", "__tl_id", "size")
    inside = inside.withColumns({"__tl_upto": F.col("__tl_base") + F.sum("size").over(order), "__tl_alike": F.count("*").over(alike)})
    inside = inside.withColumn("__tl_before", F.col("__tl_upto") - F.col("__tl_alike") * F.col("size"))
    cut = inside.filter((F.col("__tl_upto") >= F.col("__tl_rest")) & (F.col("__tl_before") < F.col("__tl_rest")))
    cut = cut.groupBy("source").agg(F.min(F.struct("__tl_key", "__tl_id", "size")).alias("__tl_cut"), F.min("__tl_before").alias("__tl_before"), F.min("__tl_alike").alias("__tl_alike"))
    cut = cut.select(F.col("source").alias("__tl_s"), "__tl_cut", "__tl_before", "__tl_alike")
    decided, small = _local(plan.join(cut, F.col("source").eqNullSafe(F.col("__tl_s")), "left").drop("__tl_s").withColumnRenamed("source", "__tl_source"))

    mine = F.struct(F.col("__tl_key"), F.col("__tl_id"), F.col("size"))
    part = F.when(F.col("__tl_cut").isNull(), 0).when(mine < F.col("__tl_cut"), F.col("size")).when(mine == F.col("__tl_cut"), F.expr("(__tl_rest - __tl_before) div __tl_alike")).otherwise(0)
    out = docs.withColumns({"__tl_id": id_order(F.col(id_col)), "__tl_key": random_key(id_col, seed), "size": n_words(text_col)})
    out = out.join(F.broadcast(decided) if small else decided, F.col(source_col).cast("string").eqNullSafe(F.col("__tl_source")))
    return out.withColumn("taken", (F.col("__tl_epochs") * F.col("size") + part).cast("bigint")).select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def _local(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table of one row a source as a local relation, if it is small enough to broadcast."""
    rows = df.limit(BROADCAST_SOURCES + 1).collect()
    if len(rows) > BROADCAST_SOURCES:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True
