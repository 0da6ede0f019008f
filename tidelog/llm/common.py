"""Column helpers shared by the text operators.

Everything here is a plain Spark expression, so plans stay in the JVM.
"""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters x20 x09-x0D.
WS = " \t\n\x0b\f\r"
WS_RE = "[\\x20\\x09-\\x0D]+"
LONG_MAX = 9223372036854775807


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else changed.

    ``lower`` has a byte-wise fast path for ASCII strings and is right for them;
    other strings go through ``translate``.
    """
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ws_words(c: Column) -> Column:
    """Runs of characters outside ``WS``; an empty array when there are none."""
    return F.array_remove(F.split(c, WS_RE, -1), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it.

    Catalyst inlines a column that is named once, also into the body of a
    lambda, where it would run once per element; a lambda variable is not inlined.
    """
    return F.transform(F.array(value), body)[0]


def window_hashes(hashes: Column, n: int) -> Column:
    """Hashes of ``n`` neighbours from hashes of one, by doubling; places without ``n`` neighbours hold leftovers."""
    if n == 1:
        return hashes
    half = n // 2 if n % 2 == 0 else n - 1
    return let(window_hashes(hashes, half), lambda a: F.zip_with(a, F.slice(a if n % 2 == 0 else hashes, half + 1, F.size(hashes)), lambda x, y: F.xxhash64(x, y)))


def id_order(c: Column) -> Column:
    """An integer id that is never null; a null id sorts after all others. (2**63 - 1 stands for null, so it is no id; ids that are no integers are an error.)"""
    return F.coalesce(c.cast("bigint"), F.lit(LONG_MAX))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare case-insensitively, as in Spark)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a new local one where it is unset and there is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set; executors need a folder that they share")
    made = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    spark.sparkContext.setCheckpointDir(made)
    return (spark.sparkContext.getCheckpointDir() or made).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # the result may still be read until then
    return spark.read.schema(df.schema).parquet(path)
