"""The whole run path over a landed log: selection, transactions, masking, formats, tombstones."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Column, Config, Format, Sink, Source, TableColumn, TableSchema
from ..encode import avro
from ..plans import images
from ..plans.delivery import log_records
from ..model import VERSION
from ..plans.changelog import read
from ..sources.tables import LOG_ENTRY, table_entries
from .encode import _R, rendered
from .registry import LOG, query

_READ = """'{{"version":"{v}","connector":"postgresql","name":"shop","ts_ms":null,"snapshot":"true","db":"app","schema":"public","table":"{t}","sequence":"[\\"5\\",\\"5\\"]","txId":null,"lsn":5,"xmin":null}}'"""


def _read_sql(name: str, table: str, key: str, image: str) -> str:
    source = _READ.format(v=VERSION, t=name)
    return f"""SELECT 'shop.app.public.{name}' AS topic, {key} AS "key", '{{"before":null,"after":' || {image} || ',"source":' || {source} || ',"op":"r","ts_ms":null,"transaction":null}}' AS value FROM {table}"""


@query(" UNION ALL ".join([
    _read_sql("customer", "customer", """'{"c_custkey":' || c_custkey || '}'""", """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}'"""),
    _read_sql("lines", "lineitem", """'{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}'""", """'{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}'"""),
    _read_sql("regions", "region", "NULL", """'{"r_name":"' || r_name || '"}'"""),
]))
def q_deliver_snapshot(spark, d):
    """Row images of tables with a single, a composite and no key, as snapshot records."""
    tables = [("customer", "customer", ["c_custkey", "c_name", "c_nationkey"], 1), ("lines", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"], 2), ("regions", "region", ["r_name"], 0)]
    entries = reduce(DataFrame.unionByName, [table_entries(read(spark, d, t).select(*columns), name, "public", columns[:n_key], 5) for name, t, columns, n_key in tables])
    return log_records(entries, config()).select("topic", "key", "value")


_COLUMNS = [TableColumn("k", "bigint", False, True), TableColumn("v", "numeric(18,2)"), TableColumn("event_type", "varchar(20)")]


def config(kind: str = "envelope", columns: list[Column] | None = None) -> Config:
    return Config("shop", Source("postgresql", database="app", include=["public\\..*"]), columns=columns or [], tables=[TableSchema(f"public.{t}", _COLUMNS) for t in ("accounts", "sessions")], format=Format(kind), sink=Sink(prefix="shop"))


def landed(spark: SparkSession, d: str) -> DataFrame:
    """The change log as log entries; every seventh transaction is rolled back behind its last row, the others commit."""
    rows = rendered(spark, d)
    kind = F.when(F.col("op") == "c", "insert").when(F.col("op") == "d", "delete").otherwise("update")
    given = {"kind": kind, "schema": F.lit("public"), "table": F.col("tbl"), "before": F.col("before_json"), "after": F.col("after_json")}
    entry = lambda df, have: df.select(*[have.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_ENTRY.fields])
    ends = rows.groupBy("txid").agg((F.max("lsn") + 4).alias("lsn"), F.max("ts_us").alias("ts_us"))
    return entry(rows, given).unionByName(entry(ends, {"kind": F.when(F.col("txid") % 7 == 3, "stream_abort").otherwise("commit")}))


# the observed time of a landed entry is its own; nothing of a rolled-back transaction is left
_DELIVERED = f"""WITH {LOG}, {_R},
o AS (SELECT *, coalesce(before_json, 'null') AS b, coalesce(after_json, 'null') AS a FROM j WHERE txid % 7 <> 3),
v AS (SELECT *, '{{"before":' || b || ',"after":' || a || ',"source":' || source_json || ',"op":"' || op || '","ts_ms":' || (ts_us // 1000) || ',"transaction":' || tx_json || '}}' AS value FROM o)"""


@query(f"""{_DELIVERED} SELECT topic, "key", value FROM v UNION ALL SELECT topic, "key", NULL FROM v WHERE op = 'd'""")
def q_deliver_aborts(spark, d):
    out = log_records(landed(spark, d), config())
    return out.filter(F.col("topic").isNotNull()).select("topic", "key", "value")


_MASKED = """regexp_replace(CASE tbl WHEN 'accounts' THEN replace({0}, '"event_type":"' || event_type || '"', '"event_type":"***"') ELSE replace({0}, '"event_type":"' || event_type || '"', '"event_type":"' || left(sha256('pepper' || event_type), 20) || '"') END, '"v":"([^"]{{1,2}})[^"]*"', CASE WHEN {0} LIKE '%tidelog_unavailable%' OR tbl = 'sessions' THEN '\\0' ELSE '"v":"\\1"' END)"""


@query(f"""{_DELIVERED.replace("coalesce(before_json, 'null')", "coalesce(" + _MASKED.format("before_json") + ", 'null')").replace("coalesce(after_json, 'null')", "coalesce(" + _MASKED.format("after_json") + ", 'null')")}
SELECT topic, "key", value FROM v UNION ALL SELECT topic, "key", NULL FROM v WHERE op = 'd'""")
def q_deliver_masked(spark, d):
    """Both images under the rules: a fixed mask, a salted hash cut to the column's length, and a truncation (of a column that is declared as text)."""
    rules = [Column(r"public\.accounts\.event_type", "mask", 3), Column(r"public\.sessions\.event_type", "hash_v2", None, "SHA-256", "pepper"), Column(r"public\.accounts\.v", "truncate", 2)]
    c = config(columns=rules)
    c.tables[0] = TableSchema("public.accounts", [_COLUMNS[0], TableColumn("v", "text"), _COLUMNS[2]])
    out = log_records(landed(spark, d), c)
    return out.filter(F.col("topic").isNotNull()).select("topic", "key", "value")


@query(f"""{_DELIVERED} SELECT lsn, "key", '{{"op":"' || op || '","lsn":' || lsn || ',"table":"' || tbl || '","k":' || CASE WHEN op = 'd' THEN 'null' ELSE k::VARCHAR END || ',"v":' || CASE WHEN op = 'd' THEN 'null' WHEN v_unavailable THEN '"__tidelog_unavailable"' ELSE '"' || v || '"' END || ',"total_order":' || total_order || '}}' AS decoded FROM v""")
def q_deliver_avro(spark, d):
    """Envelopes as Avro, read back by the reader."""
    c = config("avro")
    c.format.tombstones = False
    out = log_records(landed(spark, d), c).filter(F.col("topic").isNotNull())
    t = c.tables[0].table()
    schema, key_schema = avro.envelope_schema(t, "postgresql"), avro.row_schema(t, "Key", key=True)

    @F.pandas_udf("string")
    def value(data: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            e = avro.decode(schema, b)
            after = e["after"] or {"k": None, "v": None}
            return json.dumps({"op": e["op"], "lsn": e["source"]["lsn"], "table": e["source"]["table"], "k": after["k"], "v": after["v"], "total_order": e["transaction"]["total_order"]}, separators=(",", ":"))

        return data.map(one)

    @F.pandas_udf("string")
    def key(data: pd.Series) -> pd.Series:
        return data.map(lambda b: json.dumps(avro.decode(key_schema, b), separators=(",", ":")))

    rows = out.select(key("key").alias("key"), value("value").alias("decoded"))
    return rows.select(F.get_json_object("decoded", "$.lsn").cast("bigint").alias("lsn"), "key", "decoded")


@query(f"""WITH {LOG}, {_R} SELECT event_id, '{{"k":' || k || '}}' AS row_key FROM j WHERE op <> 'd'""")
def q_declared_key(spark, d):
    """Keys of declared tables, taken from the images."""
    rows = rendered(spark, d).filter(F.col("op") != "d").select("event_id", "after_json", F.concat(F.lit("public."), F.col("tbl")).alias("name"))
    return rows.select("event_id", images.declared_key(F.col("after_json"), config(), F.col("name")).alias("row_key"))
