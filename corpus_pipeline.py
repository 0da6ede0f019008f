"""A corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes the documents that the one before kept, written as Parquet and read
again, and returns documents with the same columns; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import langid
from tidelog.llm.common import materialize, read
from tidelog.llm.decontaminate import decontaminate
from tidelog.llm.jaccard_join import keep_first
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.mix import mix

#: A document whose main language has a smaller share of its letters is rejected, and one with a smaller share of letters in scripts that were learned.
MIN_LANG_SHARE, MIN_KNOWN_SHARE = 0.5, 0.5
#: Lines lost to one and the same document that make a gutted document the remnant of a copy.
COPIED_LINES = 3
#: Near duplicates share this much (%) of their shingles of so many words; op7's contract (4 words, 85 %) binds its query only.
NEAR_SHINGLE, NEAR_PCT = 5, 80


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like an operator's own under other names, and what to call them again."""
    back = {f"__tl_own_{c}": c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, those in which no language prevails, and those in scripts that no learned language uses.

    Null and empty texts have no letter and go; repeated rows are judged alike; a null id is allowed.
    """
    moved, back = aside(docs, langid.ADDED)
    labelled = langid.identify(moved, langid.train(docs))
    kept = labelled.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANG_SHARE) & (F.col("known_share") >= MIN_KNOWN_SHARE)).select(moved.columns)
    return kept.withColumnsRenamed(back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, then documents that have no line left, and remnants of copies.

    A near copy loses the lines that it shares with its original; the few edited lines that
    are left are no document, and no longer like the original. A remnant has lost at least
    half its characters, and at least ``COPIED_LINES`` lines to one and the same document.
    Boilerplate comes from many documents and in few lines, so a document that holds it stays.
    A null or empty text has nothing to lose and stays; rows of one id are one document.
    """
    moved, back = aside(docs, ["n_lines", "n_dropped", "n_from_one"])
    marked = moved.withColumn("__tl_before", F.char_length("text"))
    cleaned = line_dedup(marked, from_one=True).filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    remnant = (F.col("n_from_one") >= COPIED_LINES) & (2 * F.char_length("text") <= F.col("__tl_before"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.filter(~F.coalesce(remnant, F.lit(False))).withColumn("n_chars", n_chars).select(moved.columns).withColumnsRenamed(back)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id stays (a null one is the largest; then a hash of the text decides)."""
    return keep_first(docs, k=NEAR_SHINGLE, pct=NEAR_PCT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 13 consecutive words of a benchmark item, or too many of shorter items; cuts those out of the others.

    op4's share of 5 % is a column of its query; here one verified window is enough. Null texts hold nothing and stay.
    """
    marked = docs.withColumn("__tl_before", F.char_length("text"))
    cleaned = decontaminate(marked, read(spark, sf_dir, "benchmark"), mode="both", any_window=True)
    n_chars = F.char_length("text")
    return cleaned.withColumn("n_chars", F.when(n_chars < F.col("__tl_before"), n_chars.cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with how many; those without words go."""
    return mix(docs).filter("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("jaccard_join", dedup_documents), ("decontaminate", drop_contaminated), ("mix_sources", mix_sources)]
#: The first stage learns a model; SQL has no such thing. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
