"""Benchmark decontamination by word n-grams.

The test set's normalised n-grams are hashed; the hash set is broadcast and every window
of every text is looked up in it; hits are verified word by word, and documents or
only the hit spans are removed.

Plan. Texts are read once and never shuffled: windows are hashed by doubling (a window's
hash is made of those of its halves), generated and probed inside one code-generated
stage, and only verified hits and one small row a document go on to the aggregate. The
broadcast holds a hash and the words of each n-gram, for the verification; its rows and
bytes are counted first, and a larger test set is cut into blocks that are looked up one
after the other (a scan each), so memory stays bounded and nothing is dropped. Which
items an n-gram stands in, a list without bound, is joined to the few hits afterwards.
Removal broadcasts the keys of hit documents where their counted size allows it; only
beyond that are texts dealt out by document.
(`posexplode_outer` on arrays that are never empty: for `posexplode` Catalyst infers a
filter on the array's size, pushes it to the scan and so computes all arrays twice.)

Defined cases. Null texts and items have no word. An item shorter than ``n`` is one
n-gram of its own length. Rows that agree in id and text give a row each. Null ids are
allowed; items with a null id count as the item ``""``. Other columns, whatever their
names, pass through ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, text_or_empty, window_hashes

N = 13
#: One word in this many, at least, makes a document contaminated.
SHARE = 20
#: N-grams, and bytes of their words, that may be broadcast at once.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 500_000, 64 << 20
#: Hit documents, and spans in them, that may be broadcast to remove them.
MAX_KEYS, MAX_SPANS = 500_000, 2_000_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Marks the end of a document's hashes, so that documents without a hit also give a row.
END = -7046029254386353131


def norm_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _hashes(words: Column, n: int) -> Column:
    """Hashes of all ``n``-word windows."""
    made = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(window_hashes(h, n), 1, F.size(h) - (n - 1)))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<bigint>"))


def benchmark_ngrams(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """The n-grams of the test set, a row for each item that holds one: item, len, h (hash), gram (words joined by a blank)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), norm_words(text_or_empty(text_col)).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    lens = sorted(r["len"] for r in items.select("len").distinct().collect())  # n values at most

    def windows(k: int) -> DataFrame:
        rows = items.filter(F.col("len") == k).select("item", "len", "w", F.posexplode_outer(_hashes(F.col("w"), k)).alias("at", "h"))
        return rows.select("item", "len", "h", F.array_join(F.slice("w", F.col("at") + 1, k), " ").alias("gram"))

    return reduce(DataFrame.unionByName, map(windows, lens or [n])).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, max_broadcast: int = MAX_BROADCAST, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For each document: id, ``__tl_row`` (hash of its text), n_words, n_hit, ``items``, ``spans`` of word positions, contaminated."""
    held = materialize(benchmark_ngrams(benchmark, n=n).withColumn("g", F.xxhash64(F.lit(7), "gram")), "grams")
    grams = held.groupBy("len", "gram", "h", "g").agg(F.lit(1)).select("len", "gram", "h", "g")
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("len")).alias("lens")).first()
    lens = [int(x) for x in size["lens"]]
    blocks = max(1, -(-size["n"] // max_broadcast), -(-size["bytes"] // max_bytes))

    text = text_or_empty(text_col)
    words = docs.select(F.col(id_col).alias("__tl_id"), F.xxhash64(text).alias("__tl_row"), norm_words(text).alias("__tl_w"))
    words = words.withColumns({"__tl_n": F.size("__tl_w"), "__tl_hashes": F.concat(*[_hashes(F.col("__tl_w"), k) for k in lens], F.array(F.lit(END)))})
    windows = words.select("__tl_id", "__tl_row", "__tl_n", "__tl_w", F.size("__tl_hashes").alias("__tl_all"), F.posexplode_outer("__tl_hashes").alias("__tl_p", "__tl_h"))
    end = docs.sparkSession.createDataFrame([(0, "", END, 0)], grams.schema)

    # windows of the first length come first in a document's hashes, then those of the next
    start = reduce(lambda acc, k: acc.when(F.col("len") == k[0], sum((F.greatest(F.col("__tl_n") - j + 1, F.lit(0)) for j in k[1]), F.lit(0))), [(k, lens[:i]) for i, k in enumerate(lens)], F.when(F.lit(False), 0)).otherwise(0)
    hits = []
    for b in range(blocks):
        part = grams.filter(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else grams
        part = part.unionByName(end) if b == 0 else part
        hit = windows.join(F.broadcast(part), F.col("__tl_h") == F.col("h")).withColumn("__tl_at", F.col("__tl_p") - start)
        is_end = (F.col("len") == 0) & (F.col("__tl_p") == F.col("__tl_all") - 1)
        true = (F.col("len") > 0) & (F.col("__tl_at") >= 0) & (F.array_join(F.slice("__tl_w", F.col("__tl_at") + 1, F.col("len")), " ") == F.col("gram"))
        hits.append(hit.filter(is_end | true).select("__tl_id", "__tl_row", "__tl_n", "__tl_at", "len", "h", "g", is_end.alias("__tl_end")))
    hits = reduce(DataFrame.unionByName, hits)
    only_hit = lambda *c: F.when(~F.col("__tl_end"), F.struct(*c))
    span = only_hit(F.col("__tl_at").alias("at"), F.col("len").alias("len"))
    docs_hit = hits.groupBy("__tl_id", "__tl_row").agg(F.max("__tl_n").alias("__tl_n"), F.sum(F.col("__tl_end").cast("int")).alias("__tl_copies"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set(only_hit("h", "g")).alias("__tl_grams"))
    docs_hit = materialize(docs_hit, "hits")

    named = docs_hit.select("__tl_id", "__tl_row", F.explode("__tl_grams").alias("x")).select("__tl_id", "__tl_row", "x.h", "x.g").join(held.select("h", "g", "item"), ["h", "g"])
    named = named.groupBy(F.col("__tl_id").alias("__tl_i"), F.col("__tl_row").alias("__tl_r")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    union = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["end"], s["at"]))).alias("n"), F.greatest(a["end"], s["at"] + s["len"]).alias("end")), lambda a: a["n"])
    out = docs_hit.withColumn("__tl_again", F.explode(F.sequence(F.lit(1), F.col("__tl_copies")))).withColumn("__tl_hit", union)
    out = out.join(named, F.col("__tl_id").eqNullSafe(F.col("__tl_i")) & (F.col("__tl_row") == F.col("__tl_r")), "left")
    items = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return out.select(F.col("__tl_id").alias(id_col), "__tl_row", F.col("__tl_n").cast("bigint").alias("n_words"), F.col("__tl_hit").cast("bigint").alias("n_hit"), items, "spans", ((F.col("__tl_hit") > 0) & (F.col("__tl_hit") * SHARE >= F.col("__tl_n"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, mode: str = "document", max_broadcast: int = MAX_BROADCAST, any_window: bool = False) -> DataFrame:
    """``docs`` without contaminated documents (``mode="document"``), with all hit words cut out of their texts (``"span"``), or both, the latter for documents that stay (``"both"``).

    ``any_window``: a document with a verified window of ``n`` words goes, however small its share; items of fewer words count by their share only.
    """
    if mode not in ("document", "span", "both"):
        raise ValueError(f"mode: {mode}")
    full = F.exists("spans", lambda s: s["len"] == n) if any_window else F.lit(False)
    found = scan(docs, benchmark, id_col, text_col, n, max_broadcast).withColumnRenamed(id_col, "__tl_id").filter("n_hit > 0")
    gone = F.col("contaminated") | full if mode != "span" else F.lit(False)
    # what goes needs no spans
    found = found.withColumn("__tl_gone", gone).select("__tl_id", "__tl_row", "__tl_gone", F.when(~F.col("__tl_gone"), F.col("spans")).alias("__tl_spans")).dropDuplicates(["__tl_id", "__tl_row"])
    found = materialize(found.filter("__tl_gone").drop("__tl_spans") if mode == "document" else found, "found")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__tl_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__tl_row"))
    keys = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if mode == "document" else F.coalesce(F.size("__tl_spans"), F.lit(0))), F.lit(0)).alias("spans")).first()
    small = keys["n"] <= MAX_KEYS and keys["spans"] <= MAX_SPANS
    found = F.broadcast(found) if small else found
    if mode == "document":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    if mode == "both":
        joined = joined.filter(~F.coalesce("__tl_gone", F.lit(False)))
    # pieces of the text: separator, word, separator, word ...; words inside a span go with the separator after them
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    flags = F.expr("flatten(transform(__tl_spans, s -> sequence(s.at, s.at + s.len - 1)))")
    places = F.regexp_extract_all(F.col(text_col), F.lit(f"({word})([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(0))
    head = F.regexp_extract(F.col(text_col), "^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*", 0)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__tl_p") - 1), F.col("__tl_f"))
    hit = F.col("__tl_spans").isNotNull()
    joined = joined.withColumns({"__tl_p": F.when(hit, places), "__tl_f": F.when(hit, flags)})
    cut = F.concat(head, F.array_join(F.transform(stay, lambda i: F.get("__tl_p", i)), ""))
    cols = [F.when(hit, cut).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*cols)
