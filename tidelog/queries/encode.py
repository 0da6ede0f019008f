"""Envelopes, keys, routes, tombstones, framing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encode import avro, frame, kinds, protobuf
from ..encode import json as ej
from ..functions import ids
from ..model import UNAVAILABLE, VERSION
from ..operators.ordering import transaction_order
from ..operators.schema_history import Field, Table
from ..plans.changelog import change_log, read
from .ordering import _ID, _event_id
from .registry import LOG, literal, query, table

OBSERVED = 1705000000000


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """The change log with everything an encoder needs: ids, ordinals, images as JSON objects."""
    log = transaction_order(change_log(spark, d)).withColumn("id", _event_id())
    number, text = ej.json_number, ej.json_string
    value = ej.or_placeholder(text(F.col("v").cast("string")), F.col("v_unavailable"), UNAVAILABLE)
    after = F.when(F.col("op") != "d", ej.json_object([("k", number(F.col("k"))), ("v", value), ("event_type", text(F.col("event_type")))]))
    before = F.when((F.col("op") != "c") & F.col("before_v").isNotNull(), ej.json_object([("k", number(F.col("k"))), ("v", text(F.col("before_v").cast("string")))]))
    none = F.lit(None).cast("bigint")
    source = ej.source_block(
        "postgresql", "postgresql", "shop", F.lit("app"), F.lit("public"), F.col("tbl"), F.floor(F.col("ts_us") / 1000), F.lit(None).cast("string"), commit_lsn=F.col("commit_lsn"), lsn=F.col("lsn"), txid=F.col("txid"), xmin=none
    )
    return log.withColumns({
        "after_json": after,
        "before_json": before,
        "source_json": source,
        "tx_json": ej.transaction_block(F.col("txid").cast("string"), F.col("total_order"), F.col("collection_order")),
        "key": ej.json_object([("k", number(F.col("k")))]),
        "topic": ej.route("shop", F.lit("app"), F.lit("public"), F.col("tbl")),
    })


_R = f"""r AS (SELECT *, {_ID} AS id, row_number() OVER (PARTITION BY txid ORDER BY lsn) AS total_order, row_number() OVER (PARTITION BY txid, tbl ORDER BY lsn) AS collection_order FROM cl),
j AS (SELECT *, CASE WHEN op <> 'd' THEN '{{"k":' || k || ',"v":"' || CASE WHEN v_unavailable THEN '{UNAVAILABLE}' ELSE v::VARCHAR END || '","event_type":"' || event_type || '"}}' END AS after_json,
  CASE WHEN op <> 'c' AND before_v IS NOT NULL THEN '{{"k":' || k || ',"v":"' || before_v || '"}}' END AS before_json,
  '{{"version":"{VERSION}","connector":"postgresql","name":"shop","ts_ms":' || (ts_us // 1000) || ',"snapshot":"false","db":"app","schema":"public","table":"' || tbl || '","sequence":"[\\"' || commit_lsn || '\\",\\"' || lsn || '\\"]","txId":' || txid || ',"lsn":' || lsn || ',"xmin":null}}' AS source_json,
  '{{"id":"' || txid || '","total_order":' || total_order || ',"data_collection_order":' || collection_order || '}}' AS tx_json, '{{"k":' || k || '}}' AS "key", 'shop.app.public.' || tbl AS topic FROM r)"""
_VALUE = f"""'{{"before":' || coalesce(before_json, 'null') || ',"after":' || coalesce(after_json, 'null') || ',"source":' || source_json || ',"op":"' || op || '","ts_ms":{OBSERVED},"transaction":' || tx_json || '}}'"""


def encoded(spark: SparkSession, d: str) -> DataFrame:
    rows = rendered(spark, d)
    value = ej.envelope(F.col("before_json"), F.col("after_json"), F.col("source_json"), F.col("op"), F.lit(OBSERVED), F.col("tx_json"))
    return rows.select("id", "event_id", "lsn", "op", "topic", "key", value.alias("value"))


@query(f"WITH {LOG}, {_R} SELECT event_id, topic, \"key\", {_VALUE} AS value FROM j")
def q_encode_envelope(spark, d):
    return encoded(spark, d).select("event_id", "topic", "key", "value")


@query(f"""WITH {LOG}, {_R} SELECT event_id, '{{"specversion":"1.0","id":"' || id || '","source":' || source_json || ',"position":{{"type":"postgresql","lsn":' || lsn || ',"commit_lsn":' || commit_lsn || ',"transaction_id":' || txid || ',"event_serial":' || (event_id % 5) || ',"snapshot":false}},"transaction":' || tx_json ||
',"op":"' || CASE op WHEN 'c' THEN 'create' WHEN 'u' THEN 'update' ELSE 'delete' END || '","before":' || coalesce(before_json, 'null') || ',"after":' || coalesce(after_json, 'null') || ',"schema":{{"name":"' || tbl || '","version":1}},"source_time":' || (ts_us // 1000) || ',"observed_time":{OBSERVED}}}' AS value FROM j""")
def q_encode_native(spark, d):
    rows = rendered(spark, d)
    position = ids.position_json("postgresql", lsn=F.col("lsn"), commit_lsn=F.col("commit_lsn"), txid=F.col("txid"), serial=F.col("event_id") % 5, snapshot=F.lit(False))
    schema = ej.json_object([("name", ej.json_string(F.col("tbl"))), ("version", F.lit("1"))])
    value = ej.native(F.col("id"), F.col("source_json"), position, F.col("tx_json"), F.col("op"), F.col("before_json"), F.col("after_json"), schema, F.floor(F.col("ts_us") / 1000), F.lit(OBSERVED))
    return rows.select("event_id", value.alias("value"))


_SOURCES = f"""WITH e AS (SELECT event_id FROM events)
SELECT event_id, 'mysql' AS family, '{{"version":"{VERSION}","connector":"mysql","name":"n","ts_ms":null,"snapshot":"true","db":"app","schema":null,"table":"t","server_id":7,"gtid":"a:' || event_id || '","file":"log.1","pos":' || event_id || ',"row":1,"thread":null,"query":null}}' AS source FROM e
UNION ALL SELECT event_id, 'sqlserver', '{{"version":"{VERSION}","connector":"sqlserver","name":"n","ts_ms":null,"snapshot":"true","db":"app","schema":null,"table":"t","change_lsn":"0x01","commit_lsn":"0x02","event_serial_no":2}}' FROM e
UNION ALL SELECT event_id, 'oracle', '{{"version":"{VERSION}","connector":"oracle","name":"n","ts_ms":null,"snapshot":"true","db":"app","schema":null,"table":"t","scn":"' || event_id || '","commit_scn":null,"txId":"1.2.3","rs_id":"r","ssn":4,"event_serial_no":2}}' FROM e
UNION ALL SELECT event_id, 'mongodb', '{{"version":"{VERSION}","connector":"mongodb","name":"n","ts_ms":null,"snapshot":"true","db":"app","schema":null,"table":"t","resume_token":"tok","cluster_time_seconds":' || event_id || ',"cluster_time_increment":1,"event_serial_no":2}}' FROM e
UNION ALL SELECT event_id, 'bridge', '{{"version":"{VERSION}","connector":"bridge","name":"n","ts_ms":null,"snapshot":"true","db":"app","schema":null,"table":"t","source_offset":"{{\\"a\\":1}}","record_id":"kafka:t:0:' || event_id || '","event_serial_no":2}}' FROM e"""


@query(_SOURCES)
def q_source_block(spark, d):
    """The source object of each event in every family but PostgreSQL, which the envelopes have."""
    e = read(spark, d, "events").select("event_id")
    n, lit = F.col("event_id"), F.lit
    fields = {
        "mysql": {"server_id": lit(7), "gtid": F.concat(lit("a:"), n.cast("string")), "file": lit("log.1"), "pos": n, "serial": lit(1)},
        "sqlserver": {"change_lsn": lit("0x01"), "commit_lsn": lit("0x02"), "serial": lit(2)},
        "oracle": {"scn": n, "commit_scn": lit(None), "txid": lit("1.2.3"), "rs_id": lit("r"), "ssn": lit(4), "serial": lit(2)},
        "mongodb": {"token": lit("tok"), "seconds": n, "increment": lit(1), "serial": lit(2)},
        "bridge": {"offset": lit('{"a":1}'), "record_id": F.concat(lit("kafka:t:0:"), n.cast("string")), "serial": lit(2)},
    }
    blocks = [F.struct(lit(f).alias("family"), ej.source_block(f, f, "n", lit("app"), lit(None).cast("string"), lit("t"), lit(None).cast("bigint"), lit("initial"), **c).alias("source")) for f, c in fields.items()]
    return e.select("event_id", F.explode(F.array(*blocks)).alias("b")).select("event_id", "b.family", "b.source")


@query(f"WITH {LOG}, {_R} SELECT event_id, \"key\" FROM j")
def q_encode_key(spark, d):
    return rendered(spark, d).select("event_id", "key")


_ROUTES = [("app", "public", "orders"), ("app", None, "orders"), ("db1", "s", "t")]


@query(f"WITH t AS ({literal('db string, sch string, tbl string', _ROUTES)}) SELECT *, 'p.' || concat_ws('.', db, sch, tbl) AS topic, 'p.message' AS message_topic, 'hb.p' AS heartbeat_topic FROM t")
def q_route(spark, d):
    rows = table(spark, "db string, sch string, tbl string", _ROUTES)
    return rows.withColumns({"topic": ej.route("p", F.col("db"), F.col("sch"), F.col("tbl")), "message_topic": ej.message_route("p"), "heartbeat_topic": F.lit(ej.heartbeat_route("p", "hb", None))})


@query(f"""WITH {LOG}, {_R} SELECT id AS event_uid, topic, "key", {_VALUE} AS value, false AS is_tombstone FROM j
UNION ALL SELECT sha256(encode(id) || '\\x00'::BLOB || encode('tombstone')), topic, "key", NULL, true FROM j WHERE op = 'd'""")
def q_tombstones(spark, d):
    out = ej.with_tombstones(encoded(spark, d).withColumnRenamed("id", "event_uid"), event_id="event_uid")
    return out.select("event_uid", "topic", "key", "value", "is_tombstone")


@query(f"""WITH {LOG} SELECT txid, max(lsn) + 4 AS lsn, 'hb.shop' AS topic, '{{"serverName":"shop"}}' AS "key", '{{"ts_ms":' || (max(ts_us) // 1000) || '}}' AS value, 'heartbeat' AS boundary FROM raw GROUP BY txid""")
def q_heartbeat(spark, d):
    from ..streaming.heartbeat import heartbeats

    commits = change_log(spark, d).groupBy("txid").agg(F.max("commit_lsn").alias("lsn"), F.max("ts_us").alias("observed_us"))
    return heartbeats(commits, "shop", "hb").select("txid", "lsn", "topic", "key", "value", "boundary")


@query("""SELECT event_id, '{"op":"m","ts_ms":' || (epoch_us(ts) // 1000) || ',"source":{},"transaction":null,"message":{"prefix":"app.' || event_type || '","content":"' || to_base64(encode(props)) || '"}}' AS value FROM events""")
def q_message_envelope(spark, d):
    from ..plans.changelog import epoch_micros

    e = read(spark, d, "events")
    value = ej.message_envelope(F.lit("{}"), F.concat(F.lit("app."), F.col("event_type")), F.encode("props", "UTF-8"), F.floor(epoch_micros("ts") / 1000), F.lit("null"))
    return e.select("event_id", value.alias("value"))


@query("SELECT event_id, '00' || lower(lpad(hex(event_id), 8, '0')) || lower(hex(encode(props))) AS framed, '00' || lower(lpad(hex(event_id), 8, '0')) || '00' || lower(hex(encode(props))) AS framed_proto FROM events")
def q_frame(spark, d):
    e, datum = read(spark, d, "events"), F.encode("props", "UTF-8")
    hexed = lambda c: F.lower(F.hex(c))
    return e.select("event_id", hexed(frame.frame(F.col("event_id"), datum)).alias("framed"), hexed(frame.frame(F.col("event_id"), datum, protobuf=True)).alias("framed_proto"))


_NAMES = ["customer-id", "id", "name", "amount", "created_at"]


@query(f"""WITH t AS ({literal('name string', [(n,) for n in _NAMES])}), n AS (SELECT name, ('0x' || left(sha256(name), 8))::BIGINT % 536870911 + 1 AS n FROM t)
SELECT name, CASE WHEN n BETWEEN 19000 AND 19999 THEN n + 1000 ELSE n END AS field_number, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS adjusted FROM n""")
def q_field_numbers(spark, d):
    numbers, names = kinds.field_numbers(_NAMES), kinds.adjusted_all(_NAMES)
    return table(spark, "name string, field_number bigint, adjusted string", [(n, numbers[n], names[n]) for n in _NAMES])


_KINDS = [
    ("bigint", "long"), ("int(11)", "int"), ("tinyint(1)", "boolean"), ("bigint unsigned", "unsigned"), ("varchar(20)", "string"), ("numeric", "decimal"), ("bytea", "bytes"), ("text[]", "array:string"), ("hstore", "map"), ("jsonb", "json"),
    ("double precision", "double"), ("timestamptz", "string"), ("oid", "unsigned"), ("int4range", "string"), ("integer[][]", "array:array:int"),
]


@query(f"""WITH t AS ({literal("source_type string", [(t,) for t, _ in _KINDS])}), b AS (SELECT source_type, regexp_replace(source_type, '(\\[\\])+$', '') AS base, (length(source_type) - length(regexp_replace(source_type, '(\\[\\])+$', ''))) // 2 AS depth FROM t)
SELECT source_type, repeat('array:', depth) || CASE WHEN base LIKE 'tinyint(1)%' OR base LIKE 'bool%' THEN 'boolean' WHEN base LIKE '%unsigned%' OR base = 'oid' THEN 'unsigned' WHEN regexp_matches(base, '^(hstore|map)') THEN 'map' WHEN base IN ('json', 'jsonb') THEN 'json'
  WHEN regexp_matches(base, '^(numeric|decimal|money)') THEN 'decimal' WHEN regexp_matches(base, '^big|^int8$') THEN 'long' WHEN regexp_matches(base, '^(int|integer|smallint|tinyint|serial)( *\\(.*)?$') THEN 'int' WHEN regexp_matches(base, '^(double|real|float)') THEN 'double' WHEN regexp_matches(base, '^(bytea|blob|binary|varbinary)') THEN 'bytes' ELSE 'string' END AS kind FROM b""")
def q_wire_kinds(spark, d):
    return table(spark, "source_type string, kind string", [(t, kinds.kind(t)) for t, _ in _KINDS])


CUSTOMER = Table("app.customer", 1, [Field("c_custkey", "bigint", False, True), Field("c_name", "varchar(25)", False), Field("c_nationkey", "int", True)])


def _customer_json(spark, d):
    rows = read(spark, d, "customer")
    return rows.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("j"))


_ZIGZAG = "CASE WHEN {0} < 64 THEN lpad(hex({0} * 2), 2, '0') WHEN {0} < 8192 THEN lpad(hex(({0} * 2) % 128 + 128), 2, '0') || lpad(hex(({0} * 2) // 128), 2, '0') ELSE lpad(hex(({0} * 2) % 128 + 128), 2, '0') || lpad(hex(({0} * 2) // 128 % 128 + 128), 2, '0') || lpad(hex(({0} * 2) // 16384), 2, '0') END"


@query(f"""SELECT c_custkey, lower('02' || {_ZIGZAG.format('c_custkey')} || '02' || lpad(hex(length(c_name) * 2), 2, '0') || hex(encode(c_name)) || '02' || {_ZIGZAG.format('c_nationkey')}) AS datum FROM customer""")
def q_encode_avro(spark, d):
    schema = avro.row_schema(CUSTOMER, "customer")
    return _customer_json(spark, d).select("c_custkey", F.lower(F.hex(avro.encode_json(F.col("j"), schema))).alias("datum"))


_VARINT = "CASE WHEN {0} < 128 THEN lpad(hex({0}), 2, '0') WHEN {0} < 16384 THEN hex({0} % 128 + 128) || lpad(hex({0} // 128), 2, '0') ELSE hex({0} % 128 + 128) || hex({0} // 128 % 128 + 128) || lpad(hex({0} // 16384), 2, '0') END"
#: A column's message: an integer is field 1 as a varint, a text field 1 with its length.
_COLUMN = {"c_custkey": f"('08' || {_VARINT.format('c_custkey')})", "c_name": "('0A' || lpad(hex(strlen(c_name)), 2, '0') || hex(encode(c_name)))", "c_nationkey": f"('08' || {_VARINT.format('c_nationkey')})"}


def _tag(name: str) -> str:
    """The bytes before a column's message: its number shifted by three, wire type 2."""
    n, out = kinds.field_number(name) << 3 | 2, ""
    while n > 127:
        out, n = out + f"{n & 127 | 128:02X}", n >> 7
    return f"{out}{n:02X}"


@query("SELECT c_custkey, lower(" + " || ".join(f"'{_tag(n)}' || lpad(hex(length({_COLUMN[n]}) // 2), 2, '0') || {_COLUMN[n]}" for n in sorted(_COLUMN, key=kinds.field_number)) + ") AS datum FROM customer")
def q_encode_protobuf(spark, d):
    """Wire bytes; held against the Protobuf runtime in tests, too."""
    return _customer_json(spark, d).select("c_custkey", F.lower(F.hex(protobuf.encode_json(F.col("j"), CUSTOMER, UNAVAILABLE))).alias("datum"))
