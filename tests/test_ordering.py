"""Ranges, batches and binlog state where keys are sparse, files many and transactions long."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import filters, ordering
from tidelog.sources.logs import decode_binlog


def test_ranges_of_sparse_keys(spark):
    df = spark.range(3_000).select((F.col("id") * 1_000_003 - 5).alias("k"), (F.col("id") % 7).alias("v"))
    bounds = ordering.range_bounds(df, "k", 1_000)
    assert len(bounds) == 2
    sizes = Counter(r[0] for r in df.select(ordering.range_of(F.col("k"), bounds)).collect())
    assert sorted(sizes) == [0, 1, 2] and max(sizes.values()) < 1_100
    got = ordering.global_ordinal(df, "k", ["k"], rows=100).orderBy("k").select("ordinal").collect()
    assert [r[0] for r in got] == list(range(1, 3_001))
    skewed = df.select(F.when(F.col("v") < 5, 3).otherwise(F.col("k")).alias("k"), F.col("k").alias("tie"), "v")
    got = ordering.global_ordinal(skewed, "k", ["k", "tie"], rows=100, group=["v"]).collect()
    want = {}
    for r in sorted(got, key=lambda r: (r["v"], r["k"], r["tie"])):
        want[r["v"]] = want.get(r["v"], 0) + 1
        assert r["ordinal"] == want[r["v"]]


def test_ranges_without_rows_or_with_null_keys(spark):
    assert ordering.range_bounds(spark.range(0), "id") == []
    df = spark.createDataFrame([(None, 1), (5, 2), (None, 0), (4, 3)], "k bigint, t int")
    assert [(r["k"], r["ordinal"]) for r in ordering.global_ordinal(df, "k", ["k", "t"], rows=1).orderBy("ordinal").collect()] == [(None, 1), (None, 2), (4, 3), (5, 4)]


@given(st.lists(st.integers(-(2**63), 2**63 - 2), max_size=40, unique=True).map(sorted), st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=5))
@settings(max_examples=20, deadline=None)
def test_range_of_is_a_binary_search(spark, bounds, keys):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys + bounds)], "i int, k bigint")
    got = {r[0]: r[1] for r in rows.select("i", ordering.range_of(F.col("k"), bounds)).collect()}
    assert got == {i: 0 if k is None else sum(b < k for b in bounds) for i, k in enumerate(keys + bounds)}


def test_neighbours_over_ranges(spark):
    df = spark.range(500).select((F.col("id") ** 3).cast("bigint").alias("at"), F.expr("id div 3").cast("string").alias("r"), F.when(F.col("id") % 50 == 0, 0).otherwise(F.col("id")).alias("pos"), F.lit(1).alias("p"))
    assert filters.skip_repeated(df, "r", "at", rows=10).count() == 167
    assert sorted(r["at"] for r in ordering.order_violations(df, "pos", "at", ["p"], rows=10).collect()) == [(50 * i) ** 3 for i in range(1, 10)]


def test_batches_of_a_long_transaction(spark):
    sizes = lambda i: 2 if i % 3 == 0 else 1
    df = spark.range(200_000).select(F.lit(1).alias("tx"), F.col("id").alias("n"), F.lit(None).cast("bigint").alias("empty"), F.lit(2**62 + 1).alias("big")).unionByName(spark.createDataFrame([(2, 0, None, 1), (2, 1, 5, 2)], "tx int, n bigint, empty bigint, big bigint"))
    out = ordering.batch_ids(df.repartition(3), "tx", ["n"], 512, F.when(F.col("n") % 3 == 0, 2).otherwise(1))
    assert out.columns == ["tx", "n", "empty", "big", "batch_in_tx"]
    got = out.filter("tx = 1").orderBy("n").select("batch_in_tx", "big").collect()
    batch = held = 0
    for i, r in enumerate(got):
        assert r["batch_in_tx"] == batch and r["big"] == 2**62 + 1
        held += sizes(i)
        if held >= 512:
            batch, held = batch + 1, 0
    assert [r["batch_in_tx"] for r in out.filter("tx = 2").collect()] == [0, 0]


def test_a_transaction_goes_on_over_log_files(spark):
    rows = [
        (7, "f1", 4, 1, "gtid", "a:1", None), (7, "f1", 10, 2, "table_map", None, None), (7, "f1", 11, 3, "write", None, None), (7, "f2", 4, 4, "write", None, None), (7, "f3", 4, 5, "update", None, None), (7, "f3", 9, 6, "xid", None, None),
        (7, "f3", 20, 7, "query", None, "begin"), (7, "f3", 30, 8, "table_map", None, None), (7, "f3", 31, 9, "delete", None, None), (8, "f1", 4, 1, "write", None, None),
    ]
    df = spark.createDataFrame(rows, "server_id int, file string, pos bigint, arrival bigint, kind string, gtid string, query string")
    got = [(r["server_id"], r["arrival"], r["op"], r["boundary"], r["tx_id"], r["anchor"], r["event_serial"]) for r in decode_binlog(df.repartition(3)).orderBy("server_id", "arrival").collect()]
    assert got[:6] == [(7, 3, "c", "data", "a:1", 10, 1), (7, 4, "c", "data", "a:1", 10, 1), (7, 5, "u", "data", "a:1", 10, 1), (7, 6, None, "transaction_commit", "a:1", 10, None), (7, 9, "d", "data", "f3:20", 30, 1), (8, 1, "c", "data", "", None, 1)] or got[5][0] == 8


@pytest.mark.parametrize("lead", [None, ("lsn", 30)])
def test_replay_with_and_without_a_leading_bound(spark, lead):
    df = spark.range(10).select((F.col("id") * 10).alias("lsn"))
    assert ordering.skip_replayed(df, F.struct("lsn"), F.struct(F.lit(30).cast("bigint")), lead).count() == 6
