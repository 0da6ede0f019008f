"""Snapshots, chunks, windows, signals, schema lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schema_history, signals, snapshot
from ..plans.changelog import change_log, raw_log, read
from .registry import LOG, literal, query, table


def _tables(spark, d):
    return [("app.customer", read(spark, d, "customer"), "c_custkey"), ("app.part", read(spark, d, "part"), "p_partkey"), ("app.supplier", read(spark, d, "supplier"), "s_suppkey")]


_TABLES = "s AS (SELECT 'app.customer' AS \"table\", c_custkey AS pk FROM customer UNION ALL SELECT 'app.part', p_partkey FROM part UNION ALL SELECT 'app.supplier', s_suppkey FROM supplier)"


@query(f"WITH {_TABLES} SELECT \"table\", pk, 'r' AS op, 1000::BIGINT AS lsn, row_number() OVER (ORDER BY \"table\", pk) AS event_serial FROM s")
def q_snapshot_read(spark, d):
    return snapshot.initial_snapshot(_tables(spark, d), 1000)


@query(f"WITH {_TABLES} SELECT \"table\", pk FROM s WHERE regexp_full_match(\"table\", 'app\\.(customer|supp.*)')")
def q_snapshot_filter(spark, d):
    rows = snapshot.initial_snapshot(_tables(spark, d), 1000)
    return rows.filter(snapshot.includes(F.col("table"), ["app\\.(customer|supp.*)"])).select("table", "pk")


_NAMES = [(n,) for n in ("public.orders", "public.order_items", "audit.log", "audit.orders", "public.customers", "Public.Orders", "sales.orders")]


@query(f"""WITH t AS ({literal('name string', _NAMES)}) SELECT name, (regexp_full_match(name, 'public\\..*') OR regexp_full_match(name, '.*\\.orders')) AND NOT regexp_full_match(name, 'audit\\..*') AS included, NOT regexp_full_match(name, 'audit\\..*') AS included_by_default FROM t""")
def q_table_selection(spark, d):
    names = table(spark, "name string", _NAMES)
    return names.select("name", snapshot.includes(F.col("name"), ["public\\..*", ".*\\.orders"], ["audit\\..*"]).alias("included"), snapshot.includes(F.col("name"), [], ["audit\\..*"]).alias("included_by_default"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE (o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 100)) AND o_custkey <= 90 ORDER BY o_custkey, o_orderkey LIMIT 64")
def q_keyset_chunk(spark, d):
    rows = snapshot.next_chunk(read(spark, d, "orders"), ["o_custkey", "o_orderkey"], (40, 100), (90, 9223372036854775807), 64)
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 100)) AND o_custkey <= 90 ORDER BY o_custkey, o_orderkey LIMIT 64")
def q_conditional_chunk(spark, d):
    rows = snapshot.next_chunk(read(spark, d, "orders"), ["o_custkey", "o_orderkey"], (40, 100), (90, 9223372036854775807), 64, condition="o_orderstatus = 'F'")
    return rows.select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 DESC, 2 DESC LIMIT 1")
def q_maximum_key(spark, d):
    return snapshot.maximum_key(read(spark, d, "orders"), ["o_custkey", "o_orderkey"], "o_orderstatus = 'F'")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) SELECT ((r - 1) // 1024)::BIGINT AS chunk, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS rows FROM n GROUP BY 1")
def q_chunk_plan(spark, d):
    return snapshot.chunk_plan(read(spark, d, "orders"), "o_orderkey", 1024)


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders), c AS (SELECT (r - 1) // 1024 AS chunk, max(o_orderkey) AS l, count(*) AS n FROM n GROUP BY 1)
SELECT chunk::BIGINT AS chunk, n = 0 OR n < 1024 OR l = (SELECT max(o_orderkey) FROM orders) AS done FROM c""")
def q_chunk_completion(spark, d):
    orders = read(spark, d, "orders")
    top = orders.agg(F.max("o_orderkey").alias("m"))
    plan = snapshot.chunk_plan(orders, "o_orderkey", 1024).crossJoin(F.broadcast(top))  # one row
    return plan.select("chunk", snapshot.chunk_done(F.col("rows"), 1024, F.col("last_key"), F.col("m")).alias("done"))


@query(f"""WITH {LOG}, c AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey >= 10 AND c_custkey <= 120 ORDER BY c_custkey LIMIT 80)
SELECT c.k, c_name, 'r' AS op, 1600::BIGINT AS lsn FROM c WHERE k NOT IN (SELECT k FROM raw WHERE tbl = 'accounts' AND lsn > 800 AND lsn <= 1600)""")
def q_incremental_chunk(spark, d):
    """A chunk of customers, read while events 101 to 200 pass; what the log touched is left to the log."""
    chunk = snapshot.next_chunk(read(spark, d, "customer"), ["c_custkey"], (9,), (120,), 80).select(F.col("c_custkey").alias("k"), "c_name")
    log = raw_log(read(spark, d, "events")).filter("tbl = 'accounts'")
    return snapshot.evict_touched(chunk, log, ["k"], 800, 1600).withColumns({"op": F.lit("r"), "lsn": F.lit(1600).cast("bigint")})


@query(f"WITH {LOG} SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM raw WHERE lsn >= 0 AND lsn < 4000)")
def q_window_dedup(spark, d):
    chunk = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return snapshot.evict_touched(chunk, raw_log(read(spark, d, "events")), ["k"], 0, 4000, open_low=False)


@query("""WITH x AS (SELECT event_id, event_id // 5 AS xid, event_id % 5 = 4 AS is_commit FROM events)
SELECT *, xid >= 20 AS opens, CASE WHEN is_commit THEN xid = 60 OR xid <= 40 ELSE xid > 60 END AS closes, xid >= 20 AND NOT CASE WHEN is_commit THEN xid = 60 OR xid <= 40 ELSE xid > 60 END AS inside FROM x""")
def q_readonly_window(spark, d):
    log = read(spark, d, "events").select("event_id", F.expr("event_id div 5").alias("xid"), (F.col("event_id") % 5 == 4).alias("is_commit"))
    return snapshot.readonly_window(log, 20, 45, 40, 60)


@query("""SELECT 'o_custkey' AS "column", count(*) FILTER (WHERE o_custkey IS NULL) AS null_keys, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS repeated_keys,
  count(*) FILTER (WHERE o_custkey IS NULL) = 0 AND count(DISTINCT o_custkey) = count(*) AS valid FROM orders
UNION ALL SELECT 'o_orderkey', count(*) FILTER (WHERE o_orderkey IS NULL), 0, true FROM orders""")
def q_surrogate_check(spark, d):
    orders = read(spark, d, "orders")
    return snapshot.surrogate_problems(orders, "o_custkey").withColumn("column", F.lit("o_custkey")).unionByName(snapshot.surrogate_problems(orders, "o_orderkey").withColumn("column", F.lit("o_orderkey")))


_CASES = [(m, c, h, x) for m in ("initial", "never", "when_needed") for c in (True, False) for h in (True, False) for x in (True, False)]
_MODE = "mode string, completed boolean, history_missing boolean, log_lost boolean"


@query(f"""WITH t AS ({literal(_MODE, _CASES)}) SELECT *, CASE WHEN mode = 'initial' AND NOT completed THEN 'snapshot' WHEN mode = 'when_needed' AND (NOT completed OR history_missing OR log_lost) THEN 'snapshot'
WHEN history_missing OR log_lost THEN 'error' ELSE 'stream' END AS action FROM t""")
def q_snapshot_mode(spark, d):
    return table(spark, _MODE, _CASES).withColumn("action", snapshot.snapshot_action(F.col("mode"), F.col("completed"), F.col("history_missing"), F.col("log_lost")))


@query(f"""WITH {LOG}, s AS (SELECT c_custkey AS k, 'r' AS op, 2000::BIGINT AS lsn FROM customer) SELECT k, op, lsn, 'snapshot' AS phase FROM s
UNION ALL SELECT k, op, lsn, 'stream' FROM raw WHERE lsn > 2000""")
def q_snapshot_stream_handoff(spark, d):
    initial = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("r").alias("op"), F.lit(2000).cast("bigint").alias("lsn"))
    return snapshot.hand_off(initial, raw_log(read(spark, d, "events")).select("k", "op", "lsn"))


@query(f"WITH t AS ({literal('name string', _NAMES + _NAMES[:3])}) SELECT DISTINCT name FROM t WHERE regexp_full_match(name, 'public\\.o.*') OR regexp_full_match(name, 'audit\\.log')")
def q_collection_expand(spark, d):
    return signals.expand_collections(table(spark, "name string", _NAMES + _NAMES[:3]), ["public\\.o.*", "audit\\.log"])


_SIGNALS = [
    (1, "app", '{"id":"a","type":"execute-snapshot","data":"{}"}'), (2, "other", '{"id":"b","type":"execute-snapshot"}'), (3, "app", "not json"), (4, "app", '{"id":"c","type":"pause-snapshot"}'),
    (5, "app", '{"id":"d","type":"snapshot-window-open"}'), (6, "app", '{"type":"stop-snapshot"}'), (7, "app", '{"id":"e","type":"log"}'), (8, None, '{"id":"f","type":"log"}'),
]


@query(f"""WITH t AS ({literal('n int, key string, value string', _SIGNALS)}), p AS (SELECT n, CASE WHEN json_valid(value) THEN value END AS j FROM t WHERE key = 'app')
SELECT j->>'id' AS id, j->>'type' AS type, coalesce(j->>'data', '{{}}') AS data FROM p WHERE j->>'id' IS NOT NULL AND j->>'type' IS NOT NULL AND j->>'type' NOT LIKE 'snapshot-window%'""")
def q_signal_filter(spark, d):
    return signals.accepted(table(spark, "n int, key string, value string", _SIGNALS), "app")


@query("""WITH s AS (SELECT 'c' || (user_id % 3) AS connector, event_id, CASE WHEN event_type = 'error' THEN 'pause-snapshot' WHEN event_type = 'signup' THEN 'resume-snapshot' ELSE 'log' END AS type FROM events),
r AS (SELECT *, last_value(CASE type WHEN 'pause-snapshot' THEN true WHEN 'resume-snapshot' THEN false END IGNORE NULLS) OVER (PARTITION BY connector ORDER BY event_id) AS p FROM s)
SELECT connector, event_id, type, coalesce(p, false) AS paused FROM r""")
def q_signal_state(spark, d):
    kind = F.when(F.col("event_type") == "error", signals.PAUSE).when(F.col("event_type") == "signup", signals.RESUME).otherwise("log")
    rows = read(spark, d, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("connector"), "event_id", kind.alias("type"))
    return signals.paused(rows, "event_id")


@query("SELECT id, last FROM (SELECT 'sig-' || (event_id % 3000) AS id, max(event_id) AS last FROM events GROUP BY 1) ORDER BY last DESC, id LIMIT 1024")
def q_completed_signals(spark, d):
    rows = read(spark, d, "events").select(F.concat(F.lit("sig-"), (F.col("event_id") % 3000).cast("string")).alias("id"), F.col("event_id").alias("arrival"))
    return signals.completed_signals(rows)


_VERSIONS = [("accounts", 80, 1), ("accounts", 8000, 2), ("accounts", 16000, 3), ("sessions", 400, 1), ("sessions", 24000, 2)]
_V = "tbl string, from_lsn bigint, schema_version int"


@query(f"WITH {LOG}, h AS ({literal(_V, _VERSIONS)}) SELECT event_id, tbl, (SELECT max(schema_version) FROM h WHERE h.tbl = raw.tbl AND h.from_lsn <= raw.lsn) AS schema_version FROM raw")
def q_schema_asof(spark, d):
    log = raw_log(read(spark, d, "events"))
    return schema_history.schema_as_of(log, table(spark, _V, _VERSIONS)).select("event_id", "tbl", "schema_version")


_DDL = [
    "CREATE TABLE orders (id BIGINT NOT NULL, name VARCHAR(50), price DECIMAL(10,2) NOT NULL, PRIMARY KEY (id))",
    "ALTER TABLE orders ADD COLUMN note TEXT AFTER name, MODIFY price DECIMAL(12,2)",
    "CREATE TABLE archive LIKE orders",
    "ALTER TABLE orders RENAME COLUMN note TO remark, DROP COLUMN price",
    "RENAME TABLE archive TO old_orders",
]
_DDL_OUT = [
    ("app.old_orders", 1, 0, "id", "bigint", False, True), ("app.old_orders", 1, 1, "name", "varchar(50)", True, False), ("app.old_orders", 1, 2, "note", "text", True, False), ("app.old_orders", 1, 3, "price", "decimal(12,2)", True, False),
    ("app.orders", 3, 0, "id", "bigint", False, True), ("app.orders", 3, 1, "name", "varchar(50)", True, False), ("app.orders", 3, 2, "remark", "text", True, False),
]
_D = "name string, version int, place int, field string, source_type string, optional boolean, primary_key boolean"


@query(literal(_D, _DDL_OUT))
def q_ddl_history(spark, d):
    history = schema_history.SchemaHistory()
    for statement in _DDL:
        history.apply(statement, "app")
    rows = [(t.name, t.version, i, f.name, f.source_type, f.optional, f.primary_key) for t in history.tables.values() for i, f in enumerate(t.fields)]
    return table(spark, _D, rows)


@query(f"WITH {LOG} SELECT tbl, k, op, v::VARCHAR AS v, lsn FROM cl QUALIFY row_number() OVER (PARTITION BY tbl, k ORDER BY lsn DESC) = 1 AND op <> 'd'")
def q_current_state(spark, d):
    """The table that the log leads to: the last change of each key, unless it is a delete."""
    last = change_log(spark, d).groupBy("tbl", "k").agg(F.max_by(F.struct("op", "v", "lsn"), "lsn").alias("l"))
    return last.filter("l.op <> 'd'").select("tbl", "k", "l.op", F.col("l.v").cast("string").alias("v"), "l.lsn")
