"""Line dedup: drop lines that other documents hold too.

Explode normalised lines, hash them to 128 bits, find per hash the smallest and the
largest document, and drop a line wherever a smaller document holds it. The texts are
put together again by line position.

Plan. Two scans feed the hash side: one aggregates (map-side combined, so a line that a
third of all documents share costs one row a task), the other joins the few repeated
hashes back to their places. That join is salted, so a line of a third of all documents
is spread, and each side has a shuffle of its own, which AQE may split further.
The places to drop are gathered per document, which one document's lines bound, and meet
the texts in one shuffle on the document.

Defined cases. A null or empty text is one empty line. A null id is one document that
sorts after all others. Rows with one id are one document: they never make each other's
lines repeated, and each row is cleaned on its own. Columns of the input that are named
like an added one are replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, drop_columns, id_order, text_or_empty

SALTS = 4
ADDED = ["n_lines", "n_dropped"]


def _places(docs: DataFrame, id_col: str, text_col: str, min_chars: int, with_place: bool) -> DataFrame:
    """A row for each line whose key is long enough: its document, and its key's hash."""
    text = text_or_empty(text_col)
    place = [F.xxhash64(text).alias("__tl_row"), F.posexplode_outer(F.split(text, "\n", -1)).alias("__tl_pos", "__tl_line")] if with_place else [F.explode_outer(F.split(text, "\n", -1)).alias("__tl_line")]
    lines = docs.select(id_order(F.col(id_col)).alias("__tl_doc"), *place)
    key = ascii_lower(F.btrim("__tl_line", F.lit(WS)))
    return (
        lines.filter(F.char_length(F.btrim("__tl_line", F.lit(WS))) >= min_chars)
        .withColumn("__tl_key", key)
        .select("__tl_doc", *(["__tl_row", "__tl_pos"] if with_place else []), F.xxhash64("__tl_key").alias("__tl_h1"), F.xxhash64(F.lit(7), "__tl_key").alias("__tl_h2"))
    )


def longest_run(ordered: Column) -> Column:
    """How often the commonest value of a sorted array occurs; one pass."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(ordered, start, step, lambda acc: acc["most"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, from_one: bool = False) -> DataFrame:
    """``docs`` with cleaned texts, ``n_lines`` (before) and ``n_dropped``; ``from_one`` adds ``n_from_one``, the most dropped lines that one and the same document holds first.

    Lines whose key (white space stripped at both ends, A-Z lower-cased) has
    ``min_chars`` code points or more and is found in ``min_docs`` documents or more are
    dropped everywhere but in the smallest of these documents.
    """
    held = _places(docs, id_col, text_col, min_chars, False)
    if min_docs > 2:
        held = held.groupBy("__tl_h1", "__tl_h2", "__tl_doc").agg(F.lit(1).alias("__tl_n")).groupBy("__tl_h1", "__tl_h2").agg(F.min("__tl_doc").alias("__tl_first"), F.count("*").alias("__tl_n")).filter(F.col("__tl_n") >= min_docs)
    else:
        held = held.groupBy("__tl_h1", "__tl_h2").agg(F.min("__tl_doc").alias("__tl_first"), F.max("__tl_doc").alias("__tl_last"))
        held = held.filter(F.col("__tl_first") != F.col("__tl_last")) if min_docs == 2 else held
    repeated = held.select("__tl_h1", "__tl_h2", "__tl_first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__tl_salt"))
    drops = (
        _places(docs, id_col, text_col, min_chars, True)
        .withColumn("__tl_salt", F.pmod(F.hash("__tl_doc"), F.lit(SALTS)))
        .join(repeated, ["__tl_h1", "__tl_h2", "__tl_salt"])
        .filter(F.col("__tl_doc") != F.col("__tl_first"))
        .groupBy("__tl_doc", "__tl_row")
        .agg(F.sort_array(F.collect_set(F.struct("__tl_pos", *["__tl_first"] * from_one))).alias("__tl_found"))
        .withColumn("__tl_drop", F.col("__tl_found.__tl_pos"))
    )
    drops = drops.withColumn("__tl_one", longest_run(F.array_sort(F.col("__tl_found.__tl_first")))) if from_one else drops
    drops, added = drops.drop("__tl_found"), [*ADDED, *["n_from_one"] * from_one]
    docs = drop_columns(docs, added)
    text = text_or_empty(text_col)
    joined = docs.withColumns({"__tl_doc": id_order(F.col(id_col)), "__tl_row": F.xxhash64(text)}).join(drops, ["__tl_doc", "__tl_row"], "left")
    lines = F.split(text, "\n", -1)
    # one flag a line, made from the gaps between dropped positions: linear in the number of lines
    gaps = F.expr("zip_with(__tl_drop, concat(array(-1), slice(__tl_drop, 1, size(__tl_drop) - 1)), (d, p) -> concat(array_repeat(false, d - p - 1), array(true)))")
    kept = F.filter(F.zip_with(lines, F.flatten(gaps), lambda line, gone: F.when(F.coalesce(gone, F.lit(False)), None).otherwise(line)), lambda x: x.isNotNull())
    out = {
        "n_lines": F.size(lines).cast("bigint"),
        "n_dropped": F.when(F.col("__tl_drop").isNull(), F.lit(0)).otherwise(F.size("__tl_drop")).cast("bigint"),
        "__tl_kept": F.when(F.col("__tl_drop").isNull(), text).otherwise(F.array_join(kept, "\n")),
    }
    if from_one:
        out["n_from_one"] = F.coalesce("__tl_one", F.lit(0)).cast("bigint")
    cols = [F.col("__tl_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.withColumns(out).select(*cols, *added)
