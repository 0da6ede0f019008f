"""Log decoding by source family, the bridge, and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_diff, types_doc
from ..plans.changelog import raw_log, read
from ..sources import bridge, logs
from .registry import LOG, literal, query, table

_WAL = """w AS (
  SELECT event_id, txid, CASE op WHEN 'c' THEN 'insert' WHEN 'd' THEN 'delete' ELSE 'update' END AS kind, tbl, lsn, NULL::VARCHAR[] AS tables FROM raw UNION ALL
  SELECT max(event_id), txid, CASE WHEN txid % 7 = 3 THEN 'stream_abort' ELSE 'commit' END, NULL, max(lsn) + 4, NULL FROM raw GROUP BY txid UNION ALL
  SELECT max(event_id), txid, 'relation', NULL, min(lsn), NULL FROM raw GROUP BY txid UNION ALL
  SELECT event_id, txid, 'truncate', NULL, lsn + 1, ['accounts', 'sessions'] FROM raw WHERE event_id % 50 = 0)"""


def wal(spark, d):
    """Raw log entries: data, commits or aborts, relation messages, some truncates."""
    log = raw_log(read(spark, d, "events"))
    kind = F.when(F.col("op") == "c", "insert").when(F.col("op") == "d", "delete").otherwise("update")
    none = F.lit(None).cast("array<string>")
    data = log.select("event_id", "txid", kind.alias("kind"), "tbl", "lsn", none.alias("tables"))
    by_tx = log.groupBy("txid").agg(F.max("event_id").alias("event_id"), F.max("lsn").alias("last"), F.min("lsn").alias("first"))
    ends = by_tx.select("event_id", "txid", F.when(F.col("txid") % 7 == 3, "stream_abort").otherwise("commit").alias("kind"), F.lit(None).cast("string").alias("tbl"), (F.col("last") + 4).alias("lsn"), none.alias("tables"))
    relations = by_tx.select("event_id", "txid", F.lit("relation").alias("kind"), F.lit(None).cast("string").alias("tbl"), F.col("first").alias("lsn"), none.alias("tables"))
    truncates = log.filter("event_id % 50 = 0").select("event_id", "txid", F.lit("truncate").alias("kind"), F.lit(None).cast("string").alias("tbl"), (F.col("lsn") + 1).alias("lsn"), F.array(F.lit("accounts"), F.lit("sessions")).alias("tables"))
    return data.unionByName(ends).unionByName(relations).unionByName(truncates)


@query(f"""WITH {LOG}, {_WAL} SELECT event_id, txid, tbl, lsn, CASE kind WHEN 'insert' THEN 'c' WHEN 'update' THEN 'u' WHEN 'delete' THEN 'd' WHEN 'truncate' THEN 't' END AS op,
CASE WHEN kind = 'commit' THEN 'transaction_commit' ELSE 'data' END AS boundary FROM w WHERE kind <> 'relation' AND txid % 7 <> 3 AND (kind IN ('commit', 'truncate') OR tbl = 'accounts')""")
def q_log_decode(spark, d):
    chosen = (F.col("tbl") == "accounts") | (F.col("kind") == "truncate")
    return logs.decode_wal(wal(spark, d), chosen).select("event_id", "txid", "tbl", "lsn", "op", "boundary")


@query(f"WITH {LOG}, {_WAL} SELECT event_id, lsn, unnest(tables) AS \"table\", 't' AS op FROM w WHERE kind = 'truncate'")
def q_truncate(spark, d):
    return logs.truncates(wal(spark, d)).select("event_id", "lsn", "table", "op")


@query("""WITH m AS (SELECT event_id, 'app.' || event_type AS prefix, event_id % 2 = 0 AS transactional FROM events), c AS (SELECT *, regexp_full_match(prefix, 'app\\.(click|error|view)') AND NOT regexp_full_match(prefix, 'app\\.view') AS chosen FROM m)
SELECT event_id, prefix, CASE WHEN chosen THEN 'm' END AS op, CASE WHEN transactional THEN 'data' ELSE 'transaction_commit' END AS boundary FROM c WHERE chosen OR NOT transactional""")
def q_logical_message(spark, d):
    rows = read(spark, d, "events").select("event_id", F.concat(F.lit("app."), F.col("event_type")).alias("prefix"), (F.col("event_id") % 2 == 0).alias("transactional"), F.lit("message").alias("kind"))
    return logs.logical_messages(rows, ["app\\.(click|error|view)"], ["app\\.view"]).select("event_id", "prefix", "op", "boundary")


_BINLOG = """g AS (
  SELECT event_id * 10 + 5 AS arrival, txid, op, event_id FROM raw), b AS (
  SELECT arrival, CASE op WHEN 'c' THEN 'write' WHEN 'u' THEN 'update' ELSE 'delete' END AS kind, NULL AS q, NULL AS gtid, txid, event_id FROM g UNION ALL
  SELECT min(arrival) - 3, CASE WHEN txid % 3 = 0 THEN 'gtid' ELSE 'query' END, CASE WHEN txid % 3 <> 0 THEN 'BEGIN' END, CASE WHEN txid % 3 = 0 THEN 'SRC-' || (txid % 2) || ':' || txid END, txid, NULL FROM g GROUP BY txid UNION ALL
  SELECT min(arrival) - 2, 'table_map', NULL, NULL, txid, NULL FROM g GROUP BY txid UNION ALL
  SELECT max(arrival) + 1, 'xid', NULL, NULL, txid, NULL FROM g GROUP BY txid)"""
_BINLOG_OUT = f"""{_BINLOG}, t AS (SELECT txid, min(arrival) AS first FROM g GROUP BY txid), r AS (
  SELECT b.arrival, b.event_id, CASE kind WHEN 'write' THEN 'c' WHEN 'update' THEN 'u' WHEN 'delete' THEN 'd' END AS op, CASE WHEN kind = 'xid' THEN 'transaction_commit' ELSE 'data' END AS boundary,
    CASE WHEN txid % 3 = 0 THEN 'SRC-' || (txid % 2) || ':' || txid ELSE 'log.' || (txid // 100) || ':' || (first - 3) END AS tx_id, first - 2 AS anchor,
    CASE WHEN kind <> 'xid' THEN row_number() OVER (PARTITION BY txid ORDER BY b.arrival) END AS event_serial
  FROM b JOIN t USING (txid) WHERE kind IN ('write', 'update', 'delete', 'xid'))"""


def binlog(spark, d):
    """Binlog entries: GTID or BEGIN, a table map, rows, and an XID for each transaction."""
    log = raw_log(read(spark, d, "events")).withColumn("arrival", F.col("event_id") * 10 + 5)
    kind = F.when(F.col("op") == "c", "write").when(F.col("op") == "u", "update").otherwise("delete")
    text = F.lit(None).cast("string")
    rows = log.select("arrival", kind.alias("kind"), text.alias("query"), text.alias("gtid"), "txid", "event_id")
    tx = log.groupBy("txid").agg(F.min("arrival").alias("first"), F.max("arrival").alias("last"))
    has = F.col("txid") % 3 == 0
    gtid = F.concat(F.lit("SRC-"), (F.col("txid") % 2).cast("string"), F.lit(":"), F.col("txid").cast("string"))
    none = F.lit(None).cast("bigint").alias("event_id")
    starts = tx.select((F.col("first") - 3).alias("arrival"), F.when(has, "gtid").otherwise("query").alias("kind"), F.when(~has, "BEGIN").alias("query"), F.when(has, gtid).alias("gtid"), "txid", none)
    maps = tx.select((F.col("first") - 2).alias("arrival"), F.lit("table_map").alias("kind"), text.alias("query"), text.alias("gtid"), "txid", none)
    ends = tx.select((F.col("last") + 1).alias("arrival"), F.lit("xid").alias("kind"), text.alias("query"), text.alias("gtid"), "txid", none)
    out = rows.unionByName(starts).unionByName(maps).unionByName(ends)
    return out.withColumns({"pos": F.col("arrival"), "file": F.concat(F.lit("log."), F.expr("txid div 100").cast("string")), "server_id": F.lit(1)})


@query(f"WITH {LOG}, {_BINLOG_OUT} SELECT * FROM r")
def q_binlog_decode(spark, d):
    # a log file is a partition of its own: transactions do not span files
    out = logs.decode_binlog(binlog(spark, d))
    return out.select("arrival", "event_id", "op", "boundary", "tx_id", "anchor", "event_serial")


@query(f"WITH {LOG}, {_BINLOG_OUT} SELECT arrival, op, boundary, tx_id FROM r WHERE boundary = 'transaction_commit' OR NOT regexp_matches(tx_id, '^src-1:', 'i')")
def q_origin_filter(spark, d):
    records = logs.decode_binlog(binlog(spark, d))
    return logs.filter_origin(records, exclude=["src-1"]).select("arrival", "op", "boundary", "tx_id")


_SETS = [("a1:1-5,B2:7,c3:1-2:9",), ("B2:1",), ("x:1, b2:4",), ("",)]


@query(f"WITH t AS ({literal('gtids string', _SETS)}) SELECT gtids, array_to_string(list_filter(list_transform(string_split(gtids, ','), lambda x: trim(x)), lambda x: regexp_full_match(split_part(x, ':', 1), 'b2|c.*', 'i')), ',') AS chosen FROM t")
def q_gtid_set_filter(spark, d):
    return table(spark, "gtids string", _SETS).withColumn("chosen", logs.filter_gtid_set(F.col("gtids"), ["b2", "c.*"]))


@query(f"""WITH {LOG}, ct AS (
  SELECT txid AS commit_lsn, event_id AS change_lsn, unnest(CASE op WHEN 'd' THEN [1] WHEN 'c' THEN [2] ELSE [3, 4] END) AS operation, tbl, k, v::VARCHAR AS v, op FROM cl)
SELECT commit_lsn, change_lsn, operation, 'dbo_' || tbl AS capture, CASE tbl WHEN 'accounts' THEN '{{"k":' || k || ',"v":"' || v || '"}}' ELSE '{{"k":' || k || '}}' END AS "row"
FROM ct WHERE (commit_lsn > 40 OR (commit_lsn = 40 AND (change_lsn > 202 OR (change_lsn = 202 AND operation > 3)))) AND commit_lsn <= 1500 ORDER BY 1, 2, 3, 4 LIMIT 257""")
def q_cdc_poll_union(spark, d):
    from .ordering import change_log, change_table

    rows = change_table(change_log(spark, d).withColumn("before_v", F.col("v"))).withColumn("v", F.col("v").cast("string"))
    tables = {"dbo_accounts": rows.filter("tbl = 'accounts'"), "dbo_sessions": rows.filter("tbl = 'sessions'").drop("v")}
    return logs.poll_changes(tables, (40, 202, 3), 1500, 256, ["k", "v"])


_say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""WITH e AS (SELECT event_id AS n, event_type AS t, event_id % 6 AS style FROM events) SELECT n AS scn, CASE style WHEN 0 THEN 'c' WHEN 1 THEN 'u' WHEN 2 THEN 'd' WHEN 5 THEN 'm' END AS op, CASE style WHEN 3 THEN 'transaction_commit' ELSE 'data' END AS boundary,
CASE style WHEN 0 THEN '{"ID":"' || n || '","NAME":"O''Brien, AND ' || t || '"}' WHEN 1 THEN '{"ID":"' || n || '","NAME":"' || t || '","NOTE":null}' END AS after,
CASE style WHEN 1 THEN '{"ID":"' || n || '","NAME":"a AND ' || t || '"}' WHEN 2 THEN '{"ID":' || n || ',"N":2.5}' END AS before FROM e WHERE style <> 4 AND (n > 3 OR (n = 3 AND 'r1' > 'r1'))""")
def q_logminer_parse(spark, d):
    """Redo and undo statements of every kind, behind a cursor."""
    n, t = F.col("event_id"), F.col("event_type")
    code = F.element_at(F.array(*map(F.lit, (1, 3, 2, 7, 6, 5))), (n % 6 + 1).cast("int"))
    redo = F.when(code == 1, _say("insert into \"APP\".\"T\"(\"ID\",\"NAME\") values ('", n, "','O''Brien, AND ", t, "')")).when(code == 3, _say("update \"APP\".\"T\" set \"NAME\" = '", t, "' where \"ID\" = '", n, "' and \"NOTE\" IS NULL"))
    undo = F.when(code == 3, _say("update \"APP\".\"T\" set \"NAME\" = 'a AND ", t, "' where \"ID\" = '", n, "'")).when(code == 2, _say('insert into "APP"."T"("ID","N") values (', n, ", 2.5)"))
    rows = read(spark, d, "events").select(n.alias("scn"), F.lit("r1").alias("rs_id"), F.lit(1).alias("ssn"), code.alias("operation_code"), redo.alias("sql_redo"), undo.alias("sql_undo"))
    return logs.decode_logminer(rows, (3, "r1", 1)).select("scn", "op", "boundary", "after", "before")


@query("""WITH e AS (SELECT event_id AS n, event_type AS t, event_id % 7 AS style FROM events) SELECT n AS event_id, CASE WHEN style = 0 THEN 'c' WHEN style < 4 THEN 'u' WHEN style < 6 THEN 'd' ELSE 'm' END AS op,
CASE style WHEN 2 THEN '{"_id":"' || n || '"}' WHEN 4 THEN '{"_id":"' || n || '"}' WHEN 5 THEN '{"_id":"' || n || '","c":"' || t || '"}' END AS before,
CASE style WHEN 0 THEN '{"_id":"' || n || '","a":"' || t || '"}' WHEN 1 THEN '{"_id":"' || n || '","a":"' || t || '"}' WHEN 2 THEN '{"_id":"' || n || '","a":"y","b":"' || t || '"}' WHEN 3 THEN '{"_id":"' || n || '","c":"' || t || '"}' END AS after FROM e""")
def q_doc_change(spark, d):
    """Inserts, updates with and without the full document, replacements, deletes with and without a before image, drops."""
    n, t = F.col("event_id"), F.col("event_type")
    style, key = n % 7, _say('{"_id":"', n, '"}')
    doc = lambda name: _say('{"_id":"', n, f'","{name}":"', t, '"}')
    kind = F.element_at(F.array(*map(F.lit, ("insert", "update", "update", "replace", "delete", "delete", "drop"))), (style + 1).cast("int"))
    full = F.when(style == 0, doc("a")).when(style == 2, _say('{"_id":"', n, '","a":"y","b":"', t, '"}')).when(style == 3, doc("c"))
    updated = F.when(style == 1, _say('{"a":"', t, '"}')).when(style == 2, _say('{"b":"', t, '"}'))
    images = {"kind": kind, "full": full, "updated": updated, "before_doc": F.when(style == 2, key).when(style == 5, doc("c")), "key": F.when(style < 6, key)}
    rows = read(spark, d, "events").select("event_id", *[c.alias(name) for name, c in images.items()])
    op, before, after = logs.decode_document_change(F.col("kind"), F.col("full"), F.col("updated"), F.col("before_doc"), F.col("key"))
    return rows.select("event_id", op.alias("op"), before.alias("before"), after.alias("after"))


def envelopes(spark, d):
    """Upstream envelopes, bare or wrapped in schema and payload or as a cloud event."""
    e = read(spark, d, "events")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    n = F.col("event_id")
    inner = F.concat(
        F.lit('{"before":null,"after":{"id":'), n.cast("string"), F.lit('},"source":{"connector":"mysql","db":"app","table":"t'), (n % 3).cast("string"), F.lit('","ts_ms":'), ms.cast("string"), F.lit(',"snapshot":"'),
        F.when(n == 9, "last").when(n < 9, "true").otherwise("false"), F.lit('"},"op":"'), F.when(n < 10, "r").otherwise("c"), F.lit('","transaction":{"id":"'), F.expr("event_id div 5").cast("string"), F.lit('"}}'),
    )
    doc = F.when(n % 3 == 0, inner).when(n % 3 == 1, F.concat(F.lit('{"schema":{"type":"struct"},"payload":'), inner, F.lit("}"))).otherwise(F.concat(F.lit('{"specversion":"1.0","data":{"schema":{},"payload":'), inner, F.lit("}}")))
    return e.select("event_id", doc.alias("doc"), F.floor(ms).alias("ms"))


@query("""SELECT event_id, 'mysql' AS connector, 'app' AS database, 't' || (event_id % 3) AS "table", CASE WHEN event_id < 10 THEN 'r' ELSE 'c' END AS op, event_id < 10 AS is_snapshot,
CASE WHEN event_id = 9 THEN 'snapshot_complete' ELSE 'data' END AS boundary, '{"id":' || event_id || '}' AS after, (event_id // 5)::VARCHAR AS tx_id, (epoch_us(ts) // 1000) * 1000 AS source_us FROM events""")
def q_bridge_decode(spark, d):
    out = bridge.decode(envelopes(spark, d).withColumnRenamed("event_id", "n"), connector="mysql").filter(F.col("problem").isNull())
    return out.select(F.col("n").alias("event_id"), "connector", "database", "table", "op", "is_snapshot", "boundary", "after", "tx_id", "source_us")


_TIMES = [(1, 1700000000123456789, 5, 6), (2, None, 1700000000123456, 6), (3, None, None, 1700000000123), (4, None, None, 1700000000123456), (5, None, None, None)]


@query(f"""WITH t AS ({literal('n int, ts_ns bigint, ts_us bigint, ts_ms bigint', _TIMES)}) SELECT n, coalesce(ts_ns // 1000, ts_us, CASE WHEN abs(ts_ms) > 100000000000000 THEN ts_ms ELSE ts_ms * 1000 END) AS source_us FROM t""")
def q_bridge_time(spark, d):
    return table(spark, "n int, ts_ns bigint, ts_us bigint, ts_ms bigint", _TIMES).select("n", types_doc.bridge_micros(F.col("ts_ns"), F.col("ts_us"), F.col("ts_ms")).alias("source_us"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a":' || event_id || ',"b":[1,2]}' WHEN 1 THEN '{"b":[1,' || event_id || ',2]}' WHEN 4 THEN '{"a b":{"c":1,"d":"' || event_type || '"}}' END AS doc FROM events""")
def q_json_diff(spark, d):
    """Replace, insert and remove by path; a path that leads nowhere, and a missing base, leave the value unknown."""
    n, t = F.col("event_id"), F.col("event_type")
    pick = lambda *c: F.element_at(F.array(*c), (n % 5 + 1).cast("int"))
    plain = F.lit('{"a":1,"b":[1,2]}')
    base = pick(plain, plain, F.lit('{"a":1}'), F.lit(None).cast("string"), F.lit('{"a b":{"c":1}}'))
    diffs = pick(
        _say('[{"op":"replace","path":"$.a","value":', n, "}]"), _say('[{"op":"insert","path":"$.b[1]","value":', n, '},{"op":"remove","path":"$.a"}]'), _say('[{"op":"replace","path":"$.zz","value":', n, "}]"), F.lit("[]"), _say('[{"op":"insert","path":"$.\\"a b\\".d","value":"', t, '"}]')
    )
    return read(spark, d, "events").select("event_id", base.alias("base"), diffs.alias("diffs")).select("event_id", json_diff.json_after("base", "diffs").alias("doc"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, value::DECIMAL(18,2)::VARCHAR AS value FROM events")
def q_projection(spark, d):
    """The columns that a schema knows, typed by it, out of a row that holds more."""
    row = F.from_json("props", "k bigint")
    return read(spark, d, "events").select("event_id", row["k"].alias("k"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"))
