"""The registered queries against their SQL, and the pipeline's stages against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare, duck
from tidelog.llm.common import materialize
from tidelog.llm.decontaminate import decontaminate
from tidelog.llm.jaccard_join import jaccard_join
from tidelog.llm.queries import QUERIES
from tidelog.llm.sql import ORACLE_SQL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, connection, sf_dir, name):
    compare(spark, connection, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_language_id_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = QUERIES["op6_language_id"](spark, sf_dir).filter("held_out").join(docs, "doc_id")
    assert held.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.98 * held.count()


def test_pipeline(spark, sf_dir, connection):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        kept[name] = out
        if name != "mix_sources":
            assert out.dtypes == documents.dtypes
        docs = out
    assert not kept["jaccard_join"].filter("text is null").count()
    from tests.llm.test_operators import dedup_by_hand, join_by_hand, scan_by_hand

    first = [(r["doc_id"], r["text"]) for r in kept["language_id"].collect()]
    want = {i: t for i, t, _, dropped in dedup_by_hand(first) if not dropped or t.strip(" \t\n\x0b\x0c\r")}
    gone = remnants_by_hand(first)
    assert gone <= {r["doc_id"] for r in documents.collect()}
    want = {i: t for i, t in want.items() if i not in gone}
    assert {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()} == want
    want = {i for i, _, c in join_by_hand(sorted(want.items())) if c == i}
    assert {r["doc_id"] for r in kept["jaccard_join"].collect()} == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert all(len(t.split()) > 13 for _, t in items)
    rows = [(r["doc_id"], r["text"]) for r in kept["jaccard_join"].collect()]
    want = {i for i, _, hit, _, _ in scan_by_hand(rows, items) if not hit}
    assert len(want) < len(rows)
    assert {r["doc_id"]: r["text"] for r in kept["decontaminate"].collect()} == {i: t for i, t in rows if i in want}
    connection.register("stage_in", kept["decontaminate"].toPandas())
    sql = ORACLE_SQL["op3_mix_sources"].replace("FROM documents", "FROM stage_in")
    want = {(i, size, taken) for i, size, _, _, taken in connection.execute(sql).fetchall() if taken}
    assert {(r["doc_id"], r["size"], r["taken"]) for r in kept["mix_sources"].collect()} == want
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, docs.select(run.columns).collect()))


def remnants_by_hand(rows):
    """Documents that lost half their characters, and three lines or more to one document."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    first = {}
    for i, text in sorted(rows):
        for line in (text or "").split("\n"):
            first.setdefault(key(line), i)
    out = set()
    for i, text in rows:
        lines = (text or "").split("\n")
        lost = [line for line in lines if len(key(line)) >= 10 and first[key(line)] != i]
        left = "\n".join(line for line in lines if line not in lost)
        if lost and max(Counter(first[key(line)] for line in lost).values()) >= 3 and 2 * len(left) <= len(text):
            out.add(i)
    return out


def test_pipeline_drops_remnants_of_copies(spark):
    line = lambda i: words(i * 100, i * 100 + 12)
    own = lambda i, n: "\n".join(line(i + k) for k in range(n))
    rows = [(1, own(0, 8)), (2, f"{own(0, 6)}\n{own(50, 2)}"), (3, f"{own(0, 3)}\n{own(60, 9)}"), (4, f"{line(0)}\nshort"), (5, f"{own(70, 1)}\n{own(80, 1)}"), (6, f"{line(0)}\n{line(70)}\n{line(80)}\nx"), (7, None), (7, ""), (None, f"{own(0, 5)}\nmore")]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint").withColumn("n_from_one", F.lit("clash"))
    out = corpus_pipeline.dedup_lines(spark, docs.repartition(3), "").collect()
    assert {r["n_from_one"] for r in out} == {"clash"}
    got = {(r["doc_id"], r["n_chars"]) for r in out}
    assert got == {(1, len(own(0, 8))), (3, len(own(60, 9))), (4, 5), (5, len(rows[4][1])), (6, 1), (7, None), (7, 0)}


def staged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("bigint").alias("n_chars"))
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_documents(spark, docs.repartition(3), "").collect()), key=repr)


def test_pipeline_rejects_scripts_that_were_not_learned(spark):
    en = "the quick dog ran over the hill and went home"
    rows = [(i, f"{en} {i}", "en") for i in range(20)] + [(30, "собака бежала домой через холм", None), (31, f"{en} собака", None), (32, "我能吞下玻璃 the dog", None), (33, "12 !", None), (34, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("known_share", F.lit("own"))
    out = corpus_pipeline.language_id(spark, docs, "").collect()
    assert {r["doc_id"] for r in out} == {*range(20), 31, 32} and {r["known_share"] for r in out} == {"own"}


STAGE_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, tmp_path, stage):
    """An empty table, null columns, null and repeated ids, and columns named like the operators' own."""
    spark.createDataFrame([("i", words(0, 20)), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    empty = spark.createDataFrame([], STAGE_COLUMNS)
    assert f(spark, empty, str(tmp_path)).count() == 0
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "the quick dog ran home", None, None, 22), (1, "the quick dog ran home", "en", "a", 22), (None, "the other dog", "en", None, 13), (3, "x " * 30_000, "en", "b", 60_000)]
    clash = ["score", "n_lines", "n_dropped", "n_from_one", "spans", "items", "component_id", "n_shingles", "n_docs", "h", "node", "cluster"]
    docs = spark.createDataFrame(rows, STAGE_COLUMNS).withColumns({c: F.lit(c) for c in clash})
    out = f(spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(r[c] == c for r in out.collect() for c in clash)
    nothing = spark.createDataFrame([(None,) * 5] * 3, STAGE_COLUMNS)
    assert {r["doc_id"] for r in f(spark, nothing, str(tmp_path)).collect()} <= {None}


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_pipeline_near_duplicates_have_five_words_and_80_percent(spark):
    rows = [(1, words(0, 500)), (2, words(0, 610)), (3, words(1000, 1500)), (4, words(1000, 1640))]
    assert staged(spark, rows) == [rows[i] for i in (0, 2, 3)]  # 496 of 606 shingles; 496 of 636


def test_pipeline_keeps_one_row_of_each_component(spark):
    a, b, c, d, e = (words(i * 1000, i * 1000 + 40) for i in range(5))
    near = d + " more"
    rows = [(1, a), (None, a), (None, b), (2, c), (2, d), (3, near), (4, e), (4, e), (None, words(9000, 9040)), (None, words(9000, 9041)), (None, b), (5, c)]
    got = staged(spark, rows)
    assert sorted(r for r in got if r[0] is not None) == sorted([(1, a), (2, c), (2, d), (4, e)])
    null = [t for i, t in got if i is None]
    assert len(null) == 2 and b in null and set(null) - {b} < {words(9000, 9040), words(9000, 9041)}


def test_jaccard_join_tells_rows_with_one_id_apart(spark):
    rows = [(1, words(0, 40)), (None, words(0, 40)), (None, words(100, 150)), (7, words(200, 230)), (7, words(0, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(docs).collect()), key=repr)
    assert got == sorted([(1, 37, 1), (None, 37, 1), (None, 47, None), (7, 27, 7), (7, 37, 1)], key=repr)


def test_decontaminate_cuts_passages_out_of_long_documents(spark):
    items = spark.createDataFrame([("i", words(0, 60))], "item_id string, text string")
    around = (words(1000, 2000), words(3000, 3440))
    rows = [(1, f"{around[0]}\n{words(0, 60)} {around[1]}"), (2, f"{around[0]} {words(20, 33)} {around[1]}"), (3, f"{words(0, 60)} {words(1000, 1100)}"), (4, around[0]), (5, None), (None, f"{around[1]} {words(5, 18)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("spans", "items", "h", "__tl")})
    got = {r["doc_id"]: r["text"] for r in decontaminate(docs, items, mode="both").collect()}
    assert got == {1: "\n".join(around), 2: " ".join(around), 4: around[0], 5: None, None: f"{around[1]} "}
    assert {r["doc_id"] for r in decontaminate(docs, items, any_window=True).collect()} == {4, 5}


@pytest.mark.parametrize("small", [True, False])
def test_pipeline_drops_every_passage(spark, tmp_path, monkeypatch, small):
    import tidelog.llm.decontaminate as dc

    if not small:  # keys beyond the bound of a broadcast
        monkeypatch.setattr(dc, "MAX_KEYS", 0)
    spark.createDataFrame([("i", words(0, 60)), ("short", "w900 w901")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = words(1000, 2000)
    rows = [(1, f"{long}\n{words(0, 60)} {long}"), (2, f"{long} {words(20, 33)}"), (3, words(0, 60)), (4, long), (5, None), (None, f"{long} {words(5, 18)}"), (6, f"{long} w900, W901! {long}"), (7, "w900 w901 w1"), (8, words(0, 12)), (9, "")]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    want = {4: long, 5: None, 6: f"{long} {long}", 8: words(0, 12), 9: ""}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items()}
