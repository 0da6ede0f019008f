"""Positions, ordinals, pairing, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, positions
from ..operators import ordering, pairing, signals
from ..plans.changelog import change_log, raw_log, read
from .registry import LOG, literal, query, table


@query(f"WITH {LOG} SELECT event_id, txid, row_number() OVER (PARTITION BY txid ORDER BY lsn) AS total_order FROM cl")
def q_tx_total_order(spark, d):
    return ordering.transaction_order(raw_log(read(spark, d, "events"))).select("event_id", "txid", "total_order")


@query(f"WITH {LOG} SELECT event_id, txid, tbl, row_number() OVER (PARTITION BY txid, tbl ORDER BY lsn) AS collection_order FROM cl")
def q_tx_collection_order(spark, d):
    return ordering.transaction_order(raw_log(read(spark, d, "events"))).select("event_id", "txid", "tbl", "collection_order")


@query(f"WITH {LOG} SELECT event_id, lsn // 64 AS coordinate, row_number() OVER (PARTITION BY lsn // 64 ORDER BY event_id) AS event_serial FROM raw")
def q_event_serial(spark, d):
    log = raw_log(read(spark, d, "events")).withColumn("coordinate", F.expr("lsn div 64"))
    return ordering.event_serial(log, ["coordinate"], ["event_id"]).select("event_id", "coordinate", "event_serial")


_ORDER_SQL = f"""
WITH {LOG}, x AS (SELECT event_id, lsn // 16 AS p, (event_id * 37 % 2000) // 2 AS q, (event_id % 5 <> 0)::INT AS s, (event_id % 3 <> 0)::INT AS t, event_id % 3 AS m, event_id % 2 AS n FROM raw),
y AS (
  SELECT event_id, 'postgresql' AS family, (p, s, m) AS a, (q, t, n) AS b FROM x UNION ALL
  SELECT event_id, 'oracle', (CASE WHEN event_id % 4 = 0 THEN p ELSE p + 3 END, s, m), (q, t, n) FROM x UNION ALL
  SELECT event_id, 'mongodb', (coalesce(CASE WHEN event_id % 11 <> 0 THEN p // 10 END, 0), s, m), (q // 10, t, n) FROM x)
SELECT event_id, family, a > b AS is_after, a <= b AS is_at_or_before FROM y
UNION ALL SELECT event_id, 'mysql', ('log.' || (p // 100), p, s, m) > ('log.' || (q // 100), q, t, n), ('log.' || (p // 100), p, s, m) <= ('log.' || (q // 100), q, t, n) FROM x
UNION ALL SELECT event_id, 'sqlserver', (lower(lpad(hex(p), 20, '0')), lower(lpad(hex(p + 1), 20, '0')), s, m) > (lower(lpad(hex(q), 20, '0')), lower(lpad(hex(p), 20, '0')), t, n),
  (lower(lpad(hex(p), 20, '0')), lower(lpad(hex(p + 1), 20, '0')), s, m) <= (lower(lpad(hex(q), 20, '0')), lower(lpad(hex(p), 20, '0')), t, n) FROM x
UNION ALL SELECT event_id, 'bridge', (s, p) > (t, q), (s, p) <= (t, q) FROM x"""


@query(_ORDER_SQL)
def q_position_order(spark, d):
    """Two positions an event, compared in every family."""
    p, q = F.expr("lsn div 16"), F.expr("(event_id * 37 % 2000) div 2")
    one = {"snapshot": F.col("event_id") % 5 == 0, "serial": F.col("event_id") % 3}
    two = {"snapshot": F.col("event_id") % 3 == 0, "serial": F.col("event_id") % 2}
    hexed, key = positions.lsn_hex, positions.sort_key
    file = lambda c: F.concat(F.lit("log."), F.floor(c / 100).cast("string"))
    pairs = {
        "postgresql": (key("postgresql", lsn=p, **one), key("postgresql", lsn=q, **two)),
        "mysql": (key("mysql", file=file(p), pos=p, **one), key("mysql", file=file(q), pos=q, **two)),
        "sqlserver": (key("sqlserver", database=F.lit("app"), commit_lsn=hexed(p), change_lsn=hexed(p + 1), **one), key("sqlserver", database=F.lit("app"), commit_lsn=hexed(q), change_lsn=hexed(p), **two)),
        "oracle": (key("oracle", scn=p, commit_scn=F.when(F.col("event_id") % 4 != 0, p + 3), **one), key("oracle", scn=q, commit_scn=F.lit(None).cast("bigint"), **two)),
        "mongodb": (key("mongodb", seconds=F.when(F.col("event_id") % 11 != 0, F.floor(p / 10)), increment=F.lit(0), **one), key("mongodb", seconds=F.floor(q / 10), increment=F.lit(0), **two)),
        "bridge": (key("bridge", snapshot=one["snapshot"], serial=p), key("bridge", snapshot=two["snapshot"], serial=q)),
    }
    rows = [F.struct(F.lit(f).alias("family"), positions.is_after(a, b).alias("is_after"), positions.is_at_or_before(a, b).alias("is_at_or_before")) for f, (a, b) in pairs.items()]
    return raw_log(read(spark, d, "events")).select("event_id", F.explode(F.array(*rows)).alias("r")).select("event_id", "r.*")


@query(f"WITH {LOG} SELECT event_id, lsn, op FROM raw WHERE lsn > 4000 OR (lsn = 4000 AND event_id % 5 > 2)")
def q_replay_skip(spark, d):
    log = raw_log(read(spark, d, "events"))
    key = positions.sort_key("postgresql", lsn="lsn", serial=F.col("event_id") % 5, snapshot=F.lit(False))
    resume = positions.sort_key("postgresql", lsn=F.lit(4000), serial=F.lit(2), snapshot=F.lit(False))
    return ordering.skip_replayed(log, key, resume, lead=("lsn", 4000)).select("event_id", "lsn", "op")


@query(f"""WITH {LOG}, x AS (SELECT event_id, tbl, CASE WHEN event_id % 97 = 13 THEN lsn - 5000 ELSE lsn END AS pos FROM raw),
y AS (SELECT *, lag(pos) OVER (PARTITION BY tbl ORDER BY event_id) AS previous FROM x) SELECT event_id, tbl, pos, previous FROM y WHERE pos < previous""")
def q_monotonic_guard(spark, d):
    log = raw_log(read(spark, d, "events")).withColumn("pos", F.when(F.col("event_id") % 97 == 13, F.col("lsn") - 5000).otherwise(F.col("lsn")))
    return ordering.order_violations(log, "pos", "event_id", ["tbl"], rows=4096).select("event_id", "tbl", "pos", "previous")


_STRATEGIES = [(s, c, p, t) for s in ("no_validation", "trust_offset", "trust_slot", "trust_greater_lsn") for c, p in ((100, 100), (200, 100), (100, 200)) for t in (True, False)]
_S = "strategy string, checkpoint bigint, slot bigint, mid_tx boolean"


@query(f"""WITH t AS ({literal(_S, _STRATEGIES)}) SELECT *, CASE WHEN strategy = 'no_validation' OR checkpoint = slot THEN 'use_checkpoint'
WHEN checkpoint > slot THEN CASE strategy WHEN 'trust_slot' THEN 'use_checkpoint' ELSE CASE WHEN mid_tx THEN 'error' ELSE 'advance_slot' END END
ELSE CASE strategy WHEN 'trust_offset' THEN 'error' ELSE 'use_slot' END END AS decision FROM t""")
def q_resume_decision(spark, d):
    return table(spark, _S, _STRATEGIES).withColumn("decision", positions.resume_decision("strategy", "checkpoint", "slot", F.col("mid_tx")))


@query(f"""WITH {LOG}, m AS (SELECT tbl, min(lsn) + 3200 AS available FROM raw GROUP BY tbl),
r AS ({literal("mode string, resume bigint", [("initial", 100), ("initial", 90000), ("when_needed", 100), ("never", 100), ("never", None)])})
SELECT tbl, available, mode, resume, CASE WHEN resume IS NULL OR available <= resume THEN 'ok' WHEN mode = 'when_needed' THEN 'resnapshot' ELSE 'error' END AS decision FROM m, r""")
def q_retention_check(spark, d):
    available = raw_log(read(spark, d, "events")).groupBy("tbl").agg((F.min("lsn") + 3200).alias("available"))
    resume = table(spark, "mode string, resume bigint", [("initial", 100), ("initial", 90000), ("when_needed", 100), ("never", 100), ("never", None)])
    out = available.crossJoin(F.broadcast(resume))  # two tables, five cases
    return out.withColumn("decision", positions.retention_decision("available", "resume", "mode"))


_ID = """sha256(encode('postgresql') || '\\x00'::BLOB || encode('app') || '\\x00'::BLOB ||
  encode('{"type":"postgresql","lsn":' || lsn || ',"commit_lsn":' || commit_lsn || ',"transaction_id":' || txid || ',"event_serial":' || (event_id % 5) || ',"snapshot":false}') || '\\x00'::BLOB ||
  encode('public.' || tbl) || unhex(lpad(hex(event_id), 16, '0')))"""


def _event_id():
    position = ids.position_json("postgresql", lsn=F.col("lsn"), commit_lsn=F.col("commit_lsn"), txid=F.col("txid"), serial=F.col("event_id") % 5, snapshot=F.lit(False))
    return ids.event_id(F.lit("postgresql"), F.lit("app"), position, F.concat(F.lit("public."), F.col("tbl")), F.col("event_id"))


@query(f"WITH {LOG} SELECT event_id, {_ID} AS id FROM cl")
def q_event_id(spark, d):
    return change_log(spark, d).select("event_id", _event_id().alias("id"))


@query(f"WITH {LOG}, i AS (SELECT event_id, op, {_ID} AS id FROM cl WHERE op = 'd') SELECT event_id, id, sha256(encode(id) || '\\x00'::BLOB || encode('tombstone')) AS tombstone_id FROM i")
def q_tombstone_id(spark, d):
    deletes = change_log(spark, d).filter("op = 'd'").select("event_id", _event_id().alias("id"))
    return deletes.withColumn("tombstone_id", ids.derived_id(F.col("id"), "tombstone"))


@query("SELECT event_id, sha256(encode('mysql') || '\\x00'::BLOB || encode('kafka:changes:' || (event_id % 4) || ':' || event_id)) AS id FROM events")
def q_bridge_id(spark, d):
    from ..sources.bridge import kafka_id

    rid = kafka_id(F.lit("changes"), F.col("event_id") % 4, F.col("event_id"))
    return read(spark, d, "events").select("event_id", ids.bridge_id(F.lit("mysql"), rid).alias("id"))


_CT = """ct AS (
  SELECT txid AS commit_lsn, event_id AS change_lsn, 1 AS operation, k, before_v AS v FROM cl WHERE op = 'd' UNION ALL
  SELECT txid, event_id, 2, k, v FROM cl WHERE op = 'c' UNION ALL
  SELECT txid, event_id, 3, k, before_v FROM cl WHERE op = 'u' UNION ALL
  SELECT txid, event_id, 4, k, v FROM cl WHERE op = 'u')"""


def change_table(log):
    """The change log as a change table: deletes and inserts are one row, updates two."""
    codes = F.when(F.col("op") == "d", F.array(F.lit(1))).when(F.col("op") == "c", F.array(F.lit(2))).otherwise(F.array(F.lit(3), F.lit(4)))
    rows = log.withColumn("operation", F.explode(codes))
    return rows.select(F.col("txid").alias("commit_lsn"), F.col("event_id").alias("change_lsn"), "operation", "k", F.when(F.col("operation").isin(1, 3), F.col("before_v")).otherwise(F.col("v")).alias("v"), "tbl")


@query(f"""WITH {LOG}, {_CT} SELECT commit_lsn, change_lsn, CASE max(operation) WHEN 1 THEN 'd' WHEN 2 THEN 'c' ELSE 'u' END AS op, max(operation)::BIGINT AS serial,
max(v) FILTER (WHERE operation IN (1, 3))::VARCHAR AS before_v, max(v) FILTER (WHERE operation IN (2, 4))::VARCHAR AS after_v, count(*) FILTER (WHERE operation = 3) = 0 AND max(operation) = 4 AS orphan
FROM ct GROUP BY commit_lsn, change_lsn""")
def q_update_pairing(spark, d):
    paired = pairing.pair_updates(change_table(change_log(spark, d)), ["commit_lsn", "change_lsn"], ["k", "v"])
    return paired.select("commit_lsn", "change_lsn", "op", "serial", F.col("before.v").cast("string").alias("before_v"), F.col("after.v").cast("string").alias("after_v"), "orphan")


@query(f"WITH {LOG}, {_CT} SELECT commit_lsn, change_lsn, operation, CASE WHEN lead(commit_lsn) OVER (ORDER BY commit_lsn, change_lsn, operation) IS DISTINCT FROM commit_lsn THEN 'transaction_commit' ELSE 'data' END AS boundary FROM ct")
def q_commit_boundary(spark, d):
    out = ordering.commit_boundaries(change_table(change_log(spark, d)), order=["change_lsn", "operation"])
    return out.select("commit_lsn", "change_lsn", "operation", "boundary")


@query(f"""WITH {LOG}, {_CT}, p AS (SELECT * FROM ct WHERE commit_lsn > 20 ORDER BY commit_lsn, change_lsn, operation LIMIT 101)
SELECT commit_lsn, change_lsn, operation FROM p WHERE (SELECT count(*) FROM p) <= 100 OR commit_lsn < (SELECT max(commit_lsn) FROM p)""")
def q_complete_commits(spark, d):
    rows = change_table(change_log(spark, d)).filter("commit_lsn > 20")
    out = ordering.complete_commits(rows, 100, order=["commit_lsn", "change_lsn", "operation"])
    return out.select("commit_lsn", "change_lsn", "operation")


@query(f"""WITH {LOG} SELECT event_id, CASE WHEN v_unavailable THEN before_v ELSE v END::VARCHAR AS v, v_unavailable AND before_v IS NULL AS unavailable FROM cl""")
def q_unavailable_fill(spark, d):
    value, missing = pairing.fill_unavailable(F.col("v"), ~F.col("v_unavailable"), F.col("before_v"), F.col("before_v").isNotNull())
    return change_log(spark, d).select("event_id", value.cast("string").alias("v"), missing.alias("unavailable"))


@query(f"WITH {LOG} SELECT event_id, txid, ((row_number() OVER (PARTITION BY txid // 20 ORDER BY lsn) - 1) // 32)::BIGINT AS batch_in_tx FROM raw")
def q_batch_assignment(spark, d):
    log = raw_log(read(spark, d, "events")).withColumn("big_tx", F.expr("txid div 20"))
    return ordering.batch_ids(log, "big_tx", ["lsn"], 32).select("event_id", "txid", "batch_in_tx")


@query(f"""WITH RECURSIVE {LOG}, n AS (SELECT event_id, txid // 20 AS tx, row_number() OVER (PARTITION BY txid // 20 ORDER BY lsn) AS r, CASE WHEN op = 'd' THEN 2 ELSE 1 END AS n FROM raw),
f AS (SELECT event_id, tx, r, 0::BIGINT AS id, CASE WHEN n >= 32 THEN 0 ELSE n END AS held, n >= 32 AS full_ FROM n WHERE r = 1
  UNION ALL SELECT n.event_id, n.tx, n.r, f.id + f.full_::INT, CASE WHEN f.held + n.n >= 32 THEN 0 ELSE f.held + n.n END, f.held + n.n >= 32 FROM f JOIN n ON n.tx = f.tx AND n.r = f.r + 1)
SELECT event_id, id AS batch_in_tx FROM f""")
def q_batch_assignment_tombstones(spark, d):
    log = raw_log(read(spark, d, "events")).withColumn("big_tx", F.expr("txid div 20"))
    return ordering.batch_ids(log, "big_tx", ["lsn"], 32, encoded=F.when(F.col("op") == "d", 2).otherwise(1)).select("event_id", "batch_in_tx")


@query(f"WITH {LOG}, b AS (SELECT *, (row_number() OVER (PARTITION BY txid // 20 ORDER BY lsn) - 1) // 32 AS b FROM raw) SELECT txid // 20 AS big_tx, b AS batch_in_tx, max(lsn) AS high_lsn, count(*) AS records FROM b GROUP BY 1, 2")
def q_batch_high_watermark(spark, d):
    log = raw_log(read(spark, d, "events")).withColumn("big_tx", F.expr("txid div 20"))
    batches = ordering.batch_ids(log, "big_tx", ["lsn"], 32)
    return batches.groupBy("big_tx", "batch_in_tx").agg(F.max("lsn").alias("high_lsn"), F.count("*").alias("records"))


_TRIGGERS = [(b, n) for b in ("data", "transaction_commit", "snapshot_complete", "heartbeat") for n in (0, 1, 511, 512, 600)]


@query(f"WITH t AS ({literal('boundary string, encoded int', _TRIGGERS)}) SELECT *, CASE boundary WHEN 'data' THEN encoded >= 512 WHEN 'heartbeat' THEN encoded = 0 ELSE true END AS flush FROM t")
def q_flush_trigger(spark, d):
    return table(spark, "boundary string, encoded int", _TRIGGERS).withColumn("flush", ordering.flush_trigger(F.col("boundary"), F.col("encoded"), 512))


@query("SELECT range::BIGINT AS attempt, least(10000, 300 * 2 ** range)::BIGINT AS delay_ms FROM range(20)")
def q_retry_schedule(spark, d):
    return spark.range(20).select(F.col("id").alias("attempt"), signals.retry_delay(F.col("id")).alias("delay_ms"))


@query(f"WITH {LOG} SELECT tbl, op, count(*) AS delivered, count(*) FILTER (WHERE op = 'd') AS deletes, max(lsn) AS high_lsn, max(ts_us) AS last_source_us FROM raw GROUP BY tbl, op")
def q_connector_metrics(spark, d):
    log = raw_log(read(spark, d, "events"))
    return log.groupBy("tbl", "op").agg(F.count("*").alias("delivered"), F.count(F.when(F.col("op") == "d", 1)).alias("deletes"), F.max("lsn").alias("high_lsn"), F.max("ts_us").alias("last_source_us"))


@query(f"WITH {LOG} SELECT event_id, greatest(0, 1705000000000 - ts_us // 1000)::BIGINT AS lag_ms FROM raw")
def q_source_lag(spark, d):
    from ..functions.types_doc import interval_lag

    return raw_log(read(spark, d, "events")).select("event_id", interval_lag(F.lit(1705000000000), F.floor(F.col("ts_us") / 1000)).alias("lag_ms"))
