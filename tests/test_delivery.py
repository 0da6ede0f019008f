"""The run path: masking, formats, transactions as a batch and as a stream, heartbeats, options that do nothing."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import cli, config
from tidelog.encode import avro, json_schema, protobuf
from tidelog.functions.masking import Rule
from tidelog.operators.schema_history import Field, Table
from tidelog.plans import images
from tidelog.plans.delivery import log_records, records
from tidelog.sources import tables
from tidelog.streaming import runtime
from tidelog.streaming.stateful import committed

NAMES = [f.name for f in tables.LOG_ENTRY.fields]


def row(**k):
    return tuple(k.get(n) for n in NAMES)


def change(lsn, txid, kind="insert", key=1, **k):
    image = json.dumps({"id": key, "name": "Åsa \"x\"", "n": 1.50})
    return row(**{"kind": kind, "lsn": lsn, "txid": txid, "schema": "public", "table": "t", "key": f'{{"id":{key}}}', "after": image, "ts_us": 1000, "total_order": 1, "collection_order": 1} | k)


BIG = 2**62 + 1  # no double holds it
FILES = [
    [row(kind="begin", lsn=1, txid=1), change(BIG, 1), change(3, 2), change(4, None, kind="read")],
    [change(5, 3), row(kind="commit", lsn=BIG + 1, txid=1), row(kind="stream_abort", lsn=7, txid=2)],
    [change(8, 3, kind="delete"), row(kind="commit", lsn=9, txid=3), change(10, 4), row(kind="rollback_prepared", lsn=11, txid=4), change(12, 5)],
]


def test_transactions_wait_for_their_end(spark, tmp_path):
    landing = str(tmp_path / "log")
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, tables.LOG_ENTRY).coalesce(1).write.mode("append").parquet(landing)
    batch = committed(spark.read.schema(tables.LOG_ENTRY).parquet(landing))
    assert sorted(r["lsn"] for r in batch.filter(F.col("kind") != "begin").collect()) == [4, 5, 8, 9, BIG, BIG + 1]
    stream = committed(spark.readStream.schema(tables.LOG_ENTRY).option("maxFilesPerTrigger", 1).parquet(landing))
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, spark.read.schema(tables.LOG_ENTRY).parquet(out).collect())) == sorted(map(repr, batch.collect()))


CONFIG = """
name: shop
source: {{family: postgresql, database: app, path: "{landing}"}}
columns: [{{selector: "public\\\\.t\\\\.name", kind: mask, length: 4}}]
tables: [{{name: public.t, columns: [{{name: id, type: bigint, optional: false, key: true}}, {{name: name, type: "varchar(9)"}}, {{name: n, type: double}}]}}]
format: {{kind: {kind}}}
sink: {{kind: files, path: "{out}", prefix: p{registry}}}
runtime: {{state_dir: "{out}-state", heartbeat_interval_ms: 1}}
"""


@pytest.mark.parametrize("kind", ["envelope", "native", "json_schema", "avro", "protobuf"])
def test_no_format_lets_a_masked_value_out(spark, tmp_path, kind):
    landing, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = [r for f in FILES for r in f]
    spark.createDataFrame(rows, tables.LOG_ENTRY).coalesce(1).write.parquet(landing)
    path, ids = tmp_path / "c.yaml", str(tmp_path / "ids.json")
    path.write_text(CONFIG.format(landing=landing, out=out, kind=kind, registry=f', registry: "{ids}"' if kind in ("avro", "protobuf", "json_schema") else ""))
    assert cli.main(["run", "--available-now", "--config", str(path)]) == 0
    got = spark.read.parquet(out).collect()
    beats = [r for r in got if r["topic"] == "heartbeat.p"]
    got = [r for r in got if r["topic"] != "heartbeat.p"]
    assert len(beats) == 1 and {r["topic"] for r in got} == {"p.app.public.t"} and len(got) == (4 if kind == "native" else 5)
    text = b" ".join(bytes(r["value"]) if isinstance(r["value"], (bytes, bytearray)) else r["value"].encode() for r in got if r["value"] is not None)
    assert b"****" in text and "Åsa".encode() not in text and b"u00c5sa" not in text
    if kind == "avro":
        t = config.load_file(str(path)).tables[0].table()
        schema = avro.envelope_schema(t, "postgresql")
        decoded = [avro.decode(schema, bytes(r["value"])[5:]) for r in got if r["value"] is not None]
        assert {d["source"]["lsn"] for d in decoded} == {4, 5, 8, BIG} and all(d["after"] == {"id": 1, "name": "****", "n": 1.5} for d in decoded)
        assert {bytes(r["value"])[:5] for r in got if r["value"] is not None} == {b"\x00\x00\x00\x00\x02"} and {bytes(r["key"])[:5] for r in got} == {b"\x00\x00\x00\x00\x01"}
        assert avro.decode(avro.row_schema(t, "Key", key=True), bytes(got[0]["key"])[5:]) == {"id": 1}
    if kind == "envelope":
        assert any('"n": 1.5' in r["value"] for r in got if r["value"])  # text that no rule names is left as it is


def test_options_that_do_nothing_stop_a_run(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(CONFIG.format(landing=tmp_path, out=tmp_path / "o", kind="avro", registry="").replace("database: app", "database: app, host: db1, hstore_mode: map"))
    assert cli.main(["run", "--config", str(path)]) == 2 and "source.host, source.hstore_mode" in capsys.readouterr().err
    assert cli.main(["validate", "--config", str(path)]) == 0 and "source.host" in capsys.readouterr().err
    path.write_text(CONFIG.format(landing=tmp_path, out=tmp_path / "o", kind="avro", registry="").replace("tables:", "# "))
    assert cli.main(["validate", "--config", str(path)]) == 2


def test_bridge_documents_are_masked_and_keyed(spark):
    c = config.load("""
name: b
source: {family: bridge}
columns: [{selector: "app\\\\.t\\\\.mail", kind: hash_v2, algorithm: MD5, salt: s}, {selector: "app\\\\.t\\\\.note", kind: truncate, length: 2}]
tables: [{name: app.t, columns: [{name: a, type: int, key: true}, {name: b, type: text, key: true}]}]
snapshot: {mode: never}
""", {})  # fmt: skip
    body = lambda **k: json.dumps({"op": "c", "before": None, "after": {"b": "k\"1", "a": 7, "mail": "x@y", "note": "höhö", "gone": None}, "source": {"connector": "mysql", "db": "app", "table": "t", "ts_ms": 1} | k})
    got = records(spark.createDataFrame([(body(),), (body(snapshot="true"),)], "doc string"), c).filter("topic is not null").collect()
    assert len(got) == 1 and json.loads(got[0]["key"]) == {"a": 7, "b": 'k"1'}
    import hashlib

    assert json.loads(got[0]["value"])["after"] == {"b": 'k"1', "a": 7, "mail": hashlib.md5(b"sx@y").hexdigest(), "note": "hö", "gone": None}


@given(st.dictionaries(st.text(max_size=6), st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=2), max_leaves=4), max_size=5), st.booleans(), st.sampled_from([None, 2]))
@settings(deadline=None)
def test_members_of_an_image(image, ascii_only, indent):
    text = json.dumps(image, ensure_ascii=ascii_only, indent=indent)
    assert {n: json.loads(text[a:b]) for n, a, b in images.members(text)} == image
    assert images.mask_image(text, lambda n: (None, None), "<gone>") == text
    hidden = json.loads(images.mask_image(text, lambda n: (Rule(".*", "mask", length=3), "text"), "<gone>"))
    assert hidden == dict.fromkeys(image, "***")


@pytest.mark.parametrize(("raw", "rule", "declared", "expected"), [
    ("null", Rule("x", "mask", length=2), None, '"**"'), ("5", Rule("x", "mask", length=2), None, "5"), ("5", Rule("x", "mask", length=2), "text", '"**"'), ('"a"', Rule("x", "mask", length=2), "int", '"a"'),
    ('"<gone>"', Rule("x", "truncate", length=2), "text", '"<gone>"'), ('"<gone>"', Rule("x", "mask", length=1), "text", '"*"'), ('"AAEC"', Rule("x", "truncate", length=2), "bytea", '"AAE="'), ("null", Rule("x", "hash_v1", algorithm="MD5"), "text", "null"),
    ('"abc"', Rule("x", "hash_v2", algorithm="SHA-256", salt="s"), "varchar(6)", '"9fe07a"'),
])
def test_masked_values(raw, rule, declared, expected):
    import hashlib

    expected = expected.replace("9fe07a", hashlib.sha256(b"sabc").hexdigest()[:6])
    assert images.masked_json(raw, rule, declared, "<gone>") == expected


CUSTOMERS = Table("app.customers", 1, [Field("id", "bigint", False, True), Field("name", "varchar(20)", False), Field("attributes", "hstore", True)])


def test_json_schemas():
    key, value = json_schema.key_schema(CUSTOMERS, "o.app.customers"), json_schema.envelope_schema(CUSTOMERS, "o.app.customers", "<gone>", "mysql")
    assert key == {"$schema": "http://json-schema.org/draft-07/schema#", "title": "o.app.customers.Key", "type": "object", "additionalProperties": False, "properties": {"id": {"type": "integer"}}, "required": ["id"]}
    assert value["required"] == ["before", "after", "source", "op", "ts_ms", "transaction"] and value["title"] == "o.app.customers.Envelope"
    image = value["properties"]["after"]["anyOf"]
    assert image[0] == {"type": "null"} and "required" not in image[1] and list(image[1]["properties"]) == ["id", "name", "attributes"]
    gone = {"const": "<gone>", "type": "string"}
    assert image[1]["properties"]["id"] == {"anyOf": [{"type": "integer"}, gone]}
    assert image[1]["properties"]["attributes"] == {"anyOf": [{"type": "object", "additionalProperties": {"type": ["string", "null"]}}, gone, {"type": "null"}]}
    source = value["properties"]["source"]
    assert source["required"] == list(source["properties"]) and source["properties"]["gtid"] == {"type": ["string", "null"]} and source["properties"]["pos"] == {"type": "integer"}
    tx = value["properties"]["transaction"]["anyOf"][1]
    assert tx["properties"]["total_order"] == {"type": ["integer", "null"]} and tx["required"] == ["id", "total_order", "data_collection_order"]
    assert json_schema.heartbeat_schemas("o")[1]["required"] == ["ts_ms"] and json_schema.message_schema("o")["properties"]["message"]["required"] == ["prefix", "content"]
    assert json_schema.key_schema(Table("t", 1, [Field("x", "int")]), "t") is None


def test_published_avro_schema_defines_a_record_once():
    text = json.dumps(avro.named(avro.envelope_schema(CUSTOMERS, "mysql")))
    assert text.count('"name": "Value"') == 1 and '["null", "Value"]' in text


def test_protobuf_envelope_decodes_with_the_runtime():
    pool_mod = pytest.importorskip("google.protobuf.descriptor_pool")
    from google.protobuf import descriptor_pb2, message_factory

    source = descriptor_pb2.FileDescriptorProto(name="e.proto", package="p", syntax="proto3")
    for name, line in (("Source", f"{json_schema.SOURCE}, {json_schema.SOURCE_OF['postgresql']}"), ("Transaction", json_schema.TRANSACTION)):
        m = source.message_type.add(name=name)
        for i, part in enumerate(line.split(","), 1):
            n, t = part.split()
            m.field.add(name=n, number=i, type=9 if t.startswith("string") else 3, label=1)
    m = source.message_type.add(name="Envelope")
    for n, i in protobuf.ENVELOPE.items():
        if n in ("source", "transaction"):
            m.field.add(name=n, number=i, type=11, type_name=f".p.{n.capitalize()}", label=1)
        else:
            m.field.add(name=n, number=i, type={"op": 9, "ts_ms": 3}.get(n, 12), label=1)
    pool = pool_mod.DescriptorPool()
    pool.Add(source)
    kind = message_factory.GetMessageClass(pool.FindMessageTypeByName("p.Envelope"))
    fields = [("id", "bigint"), ("name", "text")]
    envelope = {"before": None, "after": {"id": 5, "name": "<gone>"}, "source": {"version": "1", "lsn": BIG, "txId": None, "table": "t"}, "op": "c", "ts_ms": 7, "transaction": {"id": "9", "total_order": 2, "data_collection_order": None}}
    got = kind.FromString(protobuf.encode_envelope(fields, envelope, "<gone>", "postgresql"))
    assert (got.op, got.ts_ms, got.source.lsn, got.source.table, got.transaction.id, got.transaction.total_order, got.before) == ("c", 7, BIG, "t", "9", 2, b"")
    assert got.after == protobuf.encode_row(fields, envelope["after"], "<gone>")
    assert "message Envelope { Value before = 1;" in protobuf.envelope_definition(CUSTOMERS, "p", "postgresql")


def test_heartbeats_come_behind_whole_transactions(spark, tmp_path):
    class Kept:
        def __init__(self):
            self.topics = []

        def write(self, batch, batch_id):
            self.topics += [r["topic"] for r in batch.collect()]

    c = config.Config("n", config.Source("postgresql", database="app"), snapshot=config.Snapshot(mode="never"))
    sink = Kept()
    connector = runtime.Connector("n", sink, runtime.CheckpointStore(str(tmp_path)), c.identity(), heartbeat_topic="hb", heartbeat_ms=1)
    connector.open()
    assert connector.status.state == "streaming"
    connector.deliver(log_records(spark.createDataFrame([row(kind="message", lsn=1, prefix="x", transactional=False)], tables.LOG_ENTRY), c), 0)
    assert sink.topics == ["hb"]


def test_incremental_snapshot_by_signal(spark, tmp_path):
    from tidelog.streaming.incremental import IncrementalSnapshots

    c = config.load(f"""
name: shop
source: {{family: postgresql, database: app, path: "{tmp_path}/log"}}
tables: [{{name: public.t, columns: [{{name: a, type: int, key: true}}, {{name: b, type: text, key: true}}, {{name: v, type: int}}]}}, {{name: public.nokey, columns: [{{name: x, type: int}}]}}]
snapshot: {{mode: never, path: "{tmp_path}/tables", signal_path: "{tmp_path}/signals", chunk_size: 3}}
sink: {{kind: files, path: "{tmp_path}/out", prefix: p}}
""", {})  # fmt: skip
    table = [(i // 3, f"k{i % 3}", i) for i in range(10)]
    spark.createDataFrame(table, "a int, b string, v int").write.parquet(f"{tmp_path}/tables/public.t")
    (tmp_path / "signals").mkdir()
    signal = {"id": "s1", "type": "execute-snapshot", "data": json.dumps({"data-collections": ["public\\.t"], "additional-conditions": [{"data-collection": "public\\.t", "filter": "v <> 5"}]})}
    (tmp_path / "signals" / "1.json").write_text(json.dumps(signal) + "\nnot json\n\n")

    def batch(*rows):
        return log_records(spark.createDataFrame([*rows, row(kind="message", lsn=max((r[1] for r in rows), default=0) + 50, prefix="x", transactional=False)], tables.LOG_ENTRY), c)

    def touched(lsn, a, b):
        key = json.dumps({"a": a, "b": b}, separators=(",", ":"))
        return change(lsn, None, kind="update", key=1) [:NAMES.index("key")] + (key,) + change(lsn, None)[NAMES.index("key") + 1 :]

    sink = []

    class Kept:
        def write(self, df, batch_id):
            sink.append([(json.loads(r["key"]) if r["key"] else None, json.loads(r["value"])["op"], json.loads(r["value"])["source"]["snapshot"], json.loads(r["value"])["after"]) for r in df.collect()])

    store = runtime.CheckpointStore(str(tmp_path / "s"))

    def connector():
        out = runtime.Connector("shop", Kept(), store, c.identity(), incremental=IncrementalSnapshots(spark, c))
        out.open()
        return out

    one = connector()
    one.deliver(batch(touched(10, 0, "k0")), 0)  # the signal is seen, and the first chunk read, behind this batch
    assert [x[1] for x in sink[0]] == ["u"] and one.incremental.answers == [("s1", "started")]
    one.deliver(batch(touched(100, 0, "k1"), touched(101, 9, "zz")), 1)  # touches the second row of the chunk
    snapshot = lambda out: sorted(tuple(x[3].values()) for x in out if x[2] == "incremental")
    assert snapshot(sink[1]) == [(0, "k0", 0), (0, "k2", 2)] and all(x[0] == {"a": x[3]["a"], "b": x[3]["b"]} for x in sink[1] if x[1] == "r")
    two = connector()  # a restart: the open chunk was not delivered, and is read again
    assert two.incremental.state.last_key == (0, "k2") and two.incremental.chunk is None
    while two.step():
        pass
    assert [snapshot(x) for x in sink[2:]] == [[(1, "k0", 3), (1, "k1", 4), (2, "k0", 6)], [(2, "k1", 7), (2, "k2", 8), (3, "k0", 9)]]
    assert list(two.incremental.state.completed) == ["s1"] and not two.step()
    (tmp_path / "signals" / "2.json").write_text(json.dumps(signal) + "\n" + json.dumps({"id": "s2", "type": "execute-snapshot", "data": "{}"}))
    assert not two.step() and two.incremental.answers == [("s1", "duplicate"), ("s2", "refused: a snapshot needs a data collection")]
