"""Filters, identities, documents, schemas: what the other groups leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..encode import json_schema
from ..functions.keys import key_text
from ..functions.types_doc import plain_json
from ..model import UNAVAILABLE
from ..operators.filters import business_tables, require_known, skip_repeated, with_capture
from ..plans.changelog import raw_log, read
from ..sources.logs import transaction_id
from ..operators.schema_history import Field, Table
from .encode import _R, _VALUE, encoded
from .registry import LOG, literal, query, table


@query(f"WITH {LOG}, x AS (SELECT event_id, CASE WHEN event_id % 20 = 7 THEN 'signals' WHEN event_id % 20 = 8 THEN 'other' ELSE tbl END AS tbl FROM raw) SELECT event_id, tbl FROM x WHERE tbl IN ('accounts', 'sessions')")
def q_table_filter(spark, d):
    """The signal table and unselected tables go; a selected table that is not known would stop the query."""
    name = F.when(F.col("event_id") % 20 == 7, "signals").when(F.col("event_id") % 20 == 8, "other").otherwise(F.col("tbl"))
    log = raw_log(read(spark, d, "events")).withColumn("tbl", name)
    kept = business_tables(log, ["accounts", "sessions"], signal_table="signals")
    return require_known(kept, ["accounts", "sessions"]).select("event_id", "tbl")


_CAPTURES = [("dbo_accounts", "dbo", "accounts"), ("dbo_sessions", "dbo", "sessions")]


@query(f"WITH {LOG}, c AS ({literal('capture string, sch string, tbl_name string', _CAPTURES)}) SELECT event_id, sch, tbl_name FROM raw JOIN c ON c.capture = 'dbo_' || raw.tbl")
def q_capture_join(spark, d):
    log = raw_log(read(spark, d, "events")).withColumn("capture", F.concat(F.lit("dbo_"), F.col("tbl")))
    captures = table(spark, "capture string, sch string, tbl_name string", _CAPTURES)
    return with_capture(log, captures).select("event_id", "sch", "tbl_name")


@query(f"""WITH {LOG} SELECT event_id, CASE WHEN txid % 2 = 0 THEN 'src:' || txid ELSE 'log.1:' || (txid * 40) END AS mysql_tx, '0x' || lower(lpad(hex(txid), 20, '0')) AS sqlserver_tx, (txid % 10) || '.' || (txid % 7) || '.' || txid AS oracle_tx,
'session:' || txid AS mongodb_tx FROM raw""")
def q_transaction_identity(spark, d):
    from ..functions.positions import lsn_hex

    t = F.col("txid")
    log = raw_log(read(spark, d, "events"))
    gtid = F.when(t % 2 == 0, F.concat(F.lit("src:"), t.cast("string")))
    return log.select(
        "event_id", transaction_id(gtid, F.lit("log.1"), t * 40).alias("mysql_tx"), lsn_hex("txid").alias("sqlserver_tx"),
        F.concat_ws(".", (t % 10).cast("string"), (t % 7).cast("string"), t.cast("string")).alias("oracle_tx"), F.concat_ws(":", F.lit("session"), t.cast("string")).alias("mongodb_tx"),
    )


@query("WITH x AS (SELECT event_id, 'r' || (event_id // 3) AS record_id FROM events), y AS (SELECT *, lag(record_id) OVER (ORDER BY event_id) AS p FROM x) SELECT event_id, record_id FROM y WHERE record_id IS DISTINCT FROM p")
def q_bridge_repeats(spark, d):
    rows = read(spark, d, "events").select("event_id", F.concat(F.lit("r"), F.expr("event_id div 3").cast("string")).alias("record_id"))
    return skip_repeated(rows, "record_id", "event_id", rows=3000).select("event_id", "record_id")


@query("""SELECT event_id, '{"_id":"' || lpad(hex(event_id), 24, '0') || '","a":[' || (event_id % 100) || ',"00ff",null],"at":"' || strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","d":"' || event_id || '.50","n":' || event_id || ',"t":"' || event_type || '"}' AS doc FROM events""")
def q_extended_json(spark, d):
    n = F.col("event_id")
    doc = F.concat(
        F.lit('{"_id":{"$oid":"'), F.lpad(F.hex(n), 24, "0"), F.lit('"},"n":{"$numberLong":"'), n, F.lit('"},"d":{"$numberDecimal":"'), n, F.lit('.50"},"at":{"$date":{"$numberLong":"'), n * 1000, F.lit('"}},"t":"'), F.col("event_type"),
        F.lit('","a":[{"$numberInt":"'), n % 100, F.lit('"},{"$binary":{"base64":"AP8=","subType":"00"}},{"$undefined":true}]}'),
    )
    return read(spark, d, "events").select("event_id", doc.alias("doc")).select("event_id", plain_json("doc").alias("doc"))


@query("SELECT o_orderkey, o_custkey || ',' || o_orderkey AS key_text, CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE 'f' END AS flag_text FROM orders")
def q_key_text(spark, d):
    rows = read(spark, d, "orders")
    return rows.select("o_orderkey", F.concat_ws(",", key_text(F.col("o_custkey"), "bigint"), key_text(F.col("o_orderkey"), "bigint")).alias("key_text"), key_text(F.col("o_orderkey") % 2 == 0, "boolean").alias("flag_text"))


@query(f"""WITH {LOG}, {_R}, v AS (SELECT event_id, tbl, {_VALUE} AS value FROM j)
SELECT event_id, array_to_string(json_keys(value), ',') AS members, array_to_string(json_keys(value, '$.source'), ',') AS source_members, array_to_string(json_keys(value, '$.transaction'), ',') AS transaction_members, 'shop.app.public.' || tbl || '.Envelope' AS title, true AS conforms FROM v""")
def q_json_schema(spark, d):
    """Every envelope of the log against the schema of its table: members in order, nothing besides, types of what is there."""
    columns = [Field("k", "bigint", False, True), Field("v", "numeric(18,2)"), Field("event_type", "varchar(20)")]
    schema = json_schema.envelope_schema(Table("public.accounts", 1, columns), "t", UNAVAILABLE, "postgresql")
    parts = schema["properties"]
    value, keys = F.col("value"), lambda path: F.json_object_keys(F.get_json_object("value", path))
    image = lambda side: F.coalesce(F.size(F.array_except(keys(f"$.{side}"), F.array(*map(F.lit, parts[side]["anyOf"][1]["properties"])))) == 0, F.lit(True))
    whole = F.get_json_object("value", "$.source.lsn").rlike("^[0-9]+$") & F.get_json_object("value", "$.ts_ms").rlike("^[0-9]+$")
    good = (F.json_object_keys(value) == F.array(*map(F.lit, schema["required"]))) & (keys("$.source") == F.array(*map(F.lit, parts["source"]["required"]))) & F.get_json_object("value", "$.op").isin(parts["op"]["enum"]) & image("before") & image("after") & whole
    title = F.concat(F.col("topic"), F.lit(".Envelope"))
    joined = lambda c: F.array_join(c, ",")
    return encoded(spark, d).select("event_id", joined(F.json_object_keys(value)).alias("members"), joined(keys("$.source")).alias("source_members"), joined(keys("$.transaction")).alias("transaction_members"), title.alias("title"), good.alias("conforms"))
