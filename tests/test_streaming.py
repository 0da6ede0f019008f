"""Stateful streams give what their batch forms give, however the input is cut."""

import json
import os

from pyspark.sql import functions as F

from tidelog.operators import ordering, pairing
from tidelog.plans.changelog import change_log, raw_log, read
from tidelog.queries.ordering import change_table
from tidelog.streaming import stateful
from tidelog.streaming.signal_queue import SignalQueue


def run(spark, tmp_path, rows, build):
    """Runs a stream over ``rows`` cut into three files, each a micro-batch."""
    schema, source = rows.schema, str(tmp_path / "in")
    for i in range(3):
        rows.filter(F.pmod(F.hash(*rows.columns), F.lit(3)) == i).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    out = []
    query = build(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def ordered_run(spark, tmp_path, parts, build):
    source = tmp_path / "in"
    source.mkdir()
    for i, part in enumerate(parts):
        part.coalesce(1).write.json(str(tmp_path / f"p{i}"))
        name = next(f for f in os.listdir(tmp_path / f"p{i}") if f.endswith(".json"))
        os.rename(tmp_path / f"p{i}" / name, source / f"{i}.json")
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = []
    query = build(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_pairing(spark, sf_dir, tmp_path):
    rows = change_table(change_log(spark, sf_dir).filter("event_id < 300"))
    want = pairing.pair_updates(rows, ["commit_lsn", "change_lsn"], ["k", "v"]).select("commit_lsn", "change_lsn", "op", "serial").collect()
    rows = rows.select("commit_lsn", "change_lsn", "operation", F.to_json(F.struct("k", "v")).alias("image"))
    halves = [rows.filter("operation = 3"), rows.filter("operation <> 3")]  # every before row comes a batch early
    got = ordered_run(spark, tmp_path, halves, stateful.pair_updates)
    assert sorted((r["commit_lsn"], r["change_lsn"], r["op"], r["serial"]) for r in got) == sorted(map(tuple, want))
    assert all((r["before"] is None) == (r["op"] == "c") and (r["after"] is None) == (r["op"] == "d") for r in got)


def test_transaction_order(spark, sf_dir, tmp_path):
    log = raw_log(read(spark, sf_dir, "events")).filter("event_id < 300").select("event_id", "txid", "tbl", "lsn", (F.col("event_id") % 5 == 4).alias("is_last"))
    want = ordering.transaction_order(log).select("event_id", "total_order", "collection_order").collect()
    parts = [log.filter("event_id % 5 < 2"), log.filter("event_id % 5 between 2 and 3"), log.filter("event_id % 5 = 4")]
    got = ordered_run(spark, tmp_path, parts, stateful.transaction_order)
    assert sorted((r["event_id"], r["total_order"], r["collection_order"]) for r in got) == sorted(map(tuple, want))


def test_window(spark, tmp_path):
    schema = "collection string, kind string, chunk int, k bigint, row string, lsn bigint"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    parts = [
        rows(*[("t", "chunk", 1, k, f"r{k}", 10) for k in range(4)]),
        rows(("t", "event", None, 2, None, 11), ("u", "event", None, 3, None, 12), ("t", "close", None, None, None, 20)),
        rows(("t", "chunk", 2, 9, "r9", 21), ("t", "event", None, 9, None, 22), ("t", "close", None, None, None, 23)),
    ]
    got = ordered_run(spark, tmp_path, parts, stateful.window_survivors)
    assert sorted(map(tuple, got)) == [("t", 0, "r0", 20), ("t", 1, "r1", 20), ("t", 3, "r3", 20)]


def test_repeats_are_dropped(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("event_id"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"))
    got = run(spark, tmp_path, rows, lambda s: stateful.drop_repeats(s, "ts"))
    assert sorted(r["event_id"] for r in got) == ["e0", "e1", "e2"]


def test_signal_files(spark, tmp_path):
    source = tmp_path / "signals"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(["", json.dumps({"id": "1", "type": "pause-snapshot"}), "{broken", json.dumps({"id": "2", "type": "log", "data": "{}"})]))
    out = []
    stateful.signal_files(spark, str(source)).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, out)) == [("1", "pause-snapshot", "{}"), ("2", "log", "{}")]


def test_signal_queue():
    q = SignalQueue()
    assert not q.send_and_wait("1", "log", timeout=0.01)
    assert [p.id for p in q.take()] == ["1"] and q.take() == []
    p = q.send("2", "log")
    q.take()
    q.acknowledge({}, 0)
    assert p.stored.is_set()
