"""Snapshot tables and landed logs: files of any built-in format, or JDBC where a driver is on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_FORMATS = ("parquet", "orc", "json", "csv")

#: A landed log entry, as a capture agent writes it: images and keys are JSON text.
LOG_ENTRY = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("commit_lsn", T.LongType()),
    T.StructField("txid", T.LongType()),
    T.StructField("xmin", T.LongType()),
    T.StructField("serial", T.LongType()),
    T.StructField("total_order", T.LongType()),
    T.StructField("collection_order", T.LongType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("before", T.StringType()),
    T.StructField("after", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("transactional", T.BooleanType()),
    T.StructField("ts_us", T.LongType()),
])


def _entry(line: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in line.split(","))])


#: Landed entries of the other families; images and keys are JSON text. Snapshot rows are of kind ``read`` (operation 0) and have their image in ``after`` (``image``, ``full``).
ENTRIES = {
    "postgresql": LOG_ENTRY,
    "mysql": _entry("kind string, server_id long, file string, pos long, arrival long, gtid string, gtid_set string, query string, database string, table string, key string, before string, after string, ts_us long"),
    "sqlserver": _entry("commit_lsn string, change_lsn string, operation int, database string, schema string, table string, key string, image string, ts_us long"),
    "oracle": _entry("scn long, rs_id string, ssn int, operation_code int, commit_scn long, xid string, database string, schema string, table string, key string, sql_redo string, sql_undo string, after string, ts_us long"),
    "mongodb": _entry("kind string, database string, table string, key string, full string, updated string, before string, token string, seconds long, increment long, session string, ts_us long"),
}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table from files; only ``columns`` are read."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, fetch_size: int = 10_000, partitions: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table from a database, read in key ranges when ``bounds`` are given."""
    given = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)} | options
    if bounds and partitions > 1:
        given |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**given).load()


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 64, family: str = "postgresql") -> DataFrame:
    """A landed log as a stream."""
    return spark.readStream.format(fmt).schema(ENTRIES[family]).option("maxFilesPerTrigger", max_files).load(path)


def table_entries(table: DataFrame, name: str, schema: str, key: list[str], anchor: int) -> DataFrame:
    """A snapshot table as log entries of kind ``read`` at the anchor position; its key may have any columns, or none."""
    as_json = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else F.lit(None)
    given = {"kind": F.lit("read"), "lsn": F.lit(anchor), "schema": F.lit(schema), "table": F.lit(name), "key": as_json(key), "after": as_json(table.columns)}
    return table.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_ENTRY.fields])
