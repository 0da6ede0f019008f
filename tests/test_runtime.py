"""Signals, configuration, checkpoints, and delivery as a stream."""

import json
import os
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import cli, config
from tidelog.operators import signals, snapshot
from tidelog.plans.delivery import bridge_records, records
from tidelog.streaming import runtime

YAML = """
name: shop
source: {family: bridge, path: "${LANDING:-/tmp/none}"}
sink: {kind: files, path: out, prefix: p}
columns: [{selector: "app\\\\.t\\\\.c", kind: mask, length: 3}]
"""


def test_signal_state():
    s = signals.SnapshotState(["app.a", "app.b", "app.c"])
    assert s.handle("1", signals.EXECUTE, '{"data-collections":["app\\\\.[ab]"]}') == "started" and s.collections == ["app.a", "app.b"]
    assert s.handle("1", signals.EXECUTE, '{"data-collections":["app.c"]}') == "duplicate"
    assert s.handle("2", signals.EXECUTE, '{"data-collections":["app.c"]}') == "busy"
    assert s.handle("p", signals.PAUSE) == "paused" and s.handle("p", signals.RESUME) == "resumed"
    assert not s.advance(10, 10, (5,), (9,)) and s.last_key == (5,)
    assert s.handle("3", signals.STOP, '{"data-collections":["app.a"]}') == "reduced" and s.last_key is None and s.collections == ["app.b"]
    assert s.advance(3, 10, (3,), (9,)) and s.active is None and list(s.completed) == ["1"]
    assert s.handle("1", signals.EXECUTE, '{"data-collections":["app.c"]}') == "duplicate"
    with pytest.raises(ValueError):
        s.handle("9", signals.EXECUTE, "{}")


def test_completed_signals_are_bounded():
    s = signals.SnapshotState(["t"], keep=2)
    for i in "abc":
        s.handle(i, signals.EXECUTE, '{"data-collections":["t"]}')
        s.handle("x", signals.STOP)
    assert list(s.completed) == ["b", "c"]


@given(st.lists(st.integers(-50, 50), unique=True, max_size=40), st.integers(1, 7))
@settings(max_examples=8, deadline=None)
def test_chunks_partition_a_table(spark, keys, size):
    table = spark.createDataFrame([(k,) for k in keys], "k bigint")
    plan = sorted(snapshot.chunk_plan(table, "k", size).collect(), key=lambda r: r["chunk"])
    assert [r["rows"] for r in plan] == [min(size, len(keys) - i) for i in range(0, len(keys), size)]
    assert all(a["last_key"] < b["first_key"] for a, b in zip(plan, plan[1:]))


def test_yaml():
    c = config.load(YAML, {"LANDING": "/data"})
    assert c.source.path == "/data" and c.columns[0].rule().length == 3
    assert config.load(YAML, {}).source.path == "/tmp/none"
    with pytest.raises(config.ConfigError, match="unknown field sink.colour"):
        config.load(YAML.replace("prefix: p", "colour: red"), {})
    with pytest.raises(config.ConfigError, match="not set"):
        config.load("name: ${NOPE}", {})
    with pytest.raises(config.ConfigError, match="sink.path"):
        config.load(YAML.replace("path: out, ", ""), {})


def test_properties():
    text = "# c\nname = shop\nconnector.class: io.x.postgresql.Y\ntopic.prefix p\\\n  q\ntable.include.list=a\\\\.b,c{1,2}\ncolumn.mask.with.4.chars=a.b.c\nodd.key=1\nmax.batch.size=7\ndatabase.password=\\u0041\n"
    c, warnings = config.from_properties(text)
    assert (c.name, c.source.family, c.sink.prefix, c.runtime.max_batch_size, c.source.password) == ("shop", "postgresql", "pq", 7, "A")
    assert c.source.include == ["a\\.b", "c{1,2}"] and c.source.interval_mode == "numeric" and warnings == ["odd.key is not used"]


def test_fingerprint_ignores_secrets_and_tuning():
    a, b = config.load(YAML, {}), config.load(YAML, {})
    b.source.password, b.runtime.max_batch_size, b.snapshot.fetch_size = "x", 9, 1
    assert runtime.fingerprint(a.identity()) == runtime.fingerprint(b.identity())
    b.source.include = ["t"]
    assert runtime.fingerprint(a.identity()) != runtime.fingerprint(b.identity())


def test_store(tmp_path):
    store = runtime.CheckpointStore(str(tmp_path))
    assert store.load("a") is None
    store.save(runtime.Checkpoint("a", "g", {"x": 1}, True, "f", 3, 0.0))
    assert store.load("a").batch_id == 3
    path = next(tmp_path.glob("*.json"))
    path.write_text(json.dumps(json.loads(path.read_text()) | {"storage_version": 99}))
    with pytest.raises(runtime.StateError):
        store.load("a")
    store.delete("a")
    assert store.load("a") is None


class Flaky:
    def __init__(self, failures):
        self.failures, self.got = failures, []

    def write(self, batch, batch_id):
        if self.failures:
            self.failures -= 1
            raise runtime.RetryableSinkError
        self.got.append((batch_id, batch.count()))


def test_retry(spark):
    sink = Flaky(2)
    assert runtime.write_with_retry(sink, spark.range(3), 5, threading.Event(), 3, 1, 2) == 2 and sink.got == [(5, 3)]
    with pytest.raises(runtime.RetryableSinkError):
        runtime.write_with_retry(Flaky(9), spark.range(1), 0, threading.Event(), 2, 1, 2)
    cancelled = threading.Event()
    cancelled.set()
    with pytest.raises(runtime.RetryableSinkError):
        runtime.write_with_retry(Flaky(9), spark.range(1), 0, cancelled, -1, 60_000, 60_000)
    assert list(runtime.retry_delays(4, 300, 1000)) == [300, 600, 1000, 1000]


def test_lifecycle():
    s = runtime.Status()
    for x in ("starting", "snapshotting", "streaming", "stopping", "stopped"):
        s.to(x)
    with pytest.raises(ValueError):
        s.to("streaming")
    assert "tidelog_up" in s.metrics("c")


def _documents(folder, numbers):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{numbers[0]}.json", "w") as f:
        for n in numbers:
            body = {"before": {"id": n} if n % 3 == 0 else None, "after": None if n % 3 == 0 else {"id": n}, "op": "d" if n % 3 == 0 else "c", "source": {"connector": "mysql", "db": "app", "table": "t", "ts_ms": 1000 + n}}
            f.write(json.dumps({"schema": {}, "payload": body}) + "\n")


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    landing, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    c = config.load(YAML, {"LANDING": landing})
    _documents(landing, range(1, 8))
    crashed = []

    class Crashing(runtime.FileSink):
        def write(self, batch, batch_id):
            super().write(batch, batch_id)
            if batch_id == 1 and not crashed:
                crashed.append(1)
                raise RuntimeError("lost after the write, before the checkpoint")

    def go():
        connector = runtime.Connector("shop", Crashing(out), runtime.CheckpointStore(state), c.identity())
        query = connector.start(bridge_records(spark, c), str(tmp_path / "cp"), available_now=True)
        query.awaitTermination()
        return connector

    assert go().status.delivered == 9
    _documents(landing, range(10, 14))
    with pytest.raises(Exception, match="lost after the write"):
        go()
    go()
    docs = spark.read.text(landing).select(F.col("value").alias("doc"))
    want = records(docs, c).select("topic", "key", "value", F.col("headers")["tidelog.event.id"].alias("id")).collect()
    got = spark.read.parquet(out).select("topic", "key", "value", F.col("headers")["tidelog.event.id"].alias("id")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({r["id"] for r in got}) == len(got) == 14
    changed = config.load(YAML.replace("prefix: p", "prefix: other"), {"LANDING": landing})
    with pytest.raises(runtime.StateError):
        runtime.Connector("shop", runtime.FileSink(out), runtime.CheckpointStore(state), changed.identity()).open()


def test_command_line(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(YAML + f"runtime: {{state_dir: {tmp_path}/s}}\n")
    assert cli.main(["validate", "--config", str(path)]) == 0
    assert cli.main(["state", "reset", "--config", str(path)]) == 2
    assert cli.main(["state", "reset", "--config", str(path), "--confirm"]) == 0
    path.write_text("name: x")
    assert cli.main(["validate", "--config", str(path)]) == 2


LOG = """
name: shop
source: {family: postgresql, database: app, path: "${LANDING}", include: ["public\\\\..*"], messages: true, message_include: ["app\\\\..*"]}
sink: {kind: files, path: out, prefix: p}
"""


def test_landed_log_as_batch_and_stream(spark, tmp_path, sf_dir):
    from tidelog.plans.delivery import log_records
    from tidelog.sources import tables

    landing = str(tmp_path / "log")
    c = config.load(LOG, {"LANDING": landing})
    customers = tables.read_table(spark, f"{sf_dir}/customer.parquet", columns=["c_custkey", "c_name"]).filter("c_custkey < 3")
    names = [f.name for f in tables.LOG_ENTRY.fields]
    row = lambda **k: tuple(k.get(n) for n in names)
    log = spark.createDataFrame([
        row(kind="begin", lsn=10, txid=1), row(kind="insert", lsn=11, commit_lsn=20, txid=1, total_order=1, collection_order=1, schema="public", table="t", key='{"id":1}', after='{"id":1}', ts_us=5000),
        row(kind="insert", lsn=12, txid=1, schema="audit", table="t", key='{"id":1}', after="{}"), row(kind="delete", lsn=13, txid=1, schema="public", table="t", key='{"id":1}', before='{"id":1}', ts_us=6000), row(kind="commit", lsn=20, txid=1),
        row(kind="message", lsn=30, prefix="app.x", content=b"hi", transactional=False, ts_us=7000), row(kind="message", lsn=31, prefix="other", content=b"no", transactional=False),
    ], tables.LOG_ENTRY)
    entries = tables.table_entries(customers, "customer", "public", ["c_custkey"], 5).unionByName(log)
    entries.coalesce(1).write.parquet(landing)
    batch = log_records(spark.read.parquet(landing), c).collect()
    topics = sorted(str(r["topic"]) for r in batch)
    assert topics == ["None", "None", "p.app.public.customer", "p.app.public.customer", "p.app.public.customer", "p.app.public.t", "p.app.public.t", "p.app.public.t", "p.message"]
    assert len({r["headers"]["tidelog.event.id"] for r in batch if r["topic"]}) == 7
    assert sum(r["value"] is None for r in batch if r["topic"]) == 1 and any(r["value"] and json.loads(r["value"]).get("message") == {"prefix": "app.x", "content": "aGk="} for r in batch)
    path = tmp_path / "c.yaml"
    path.write_text(LOG.replace("${LANDING}", landing).replace("path: out", f"path: {tmp_path}/out") + f"runtime: {{state_dir: {tmp_path}/s}}\n")
    assert cli.main(["run", "--available-now", "--config", str(path)]) == 0
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/out").select("topic", "key", "value").collect())) == sorted(repr(r) for r in log_records(spark.read.parquet(landing), c).filter("topic is not null").select("topic", "key", "value").collect())
    assert runtime.CheckpointStore(f"{tmp_path}/s").load("shop").position["lsn"] == 31


def test_file_sources(spark, tmp_path):
    from tidelog.sources import tables

    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string")
    for fmt in tables.FILE_FORMATS:
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / fmt), fmt, schema=df.schema).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "csv")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "odd")


def test_keyset_bounds_reach_the_scan(spark, sf_dir):
    from tidelog.queries import QUERIES

    plan = QUERIES["q_keyset_chunk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "(o_custkey" in plan and "TakeOrderedAndProject" in plan
    scan = [str(x) for x in QUERIES["q_keyset_chunk"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert any("o_custkey" in x and ">= 40" in x and "Filter" in x for x in scan)
