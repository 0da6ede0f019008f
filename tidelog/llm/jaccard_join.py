"""N-gram Jaccard join: components of documents whose shingle sets are alike.

Two documents link when their sets of ``k``-word shingles have Jaccard similarity of at
least ``pct`` %. The result is exact (64-bit hashes stand for shingles and sets): each
document with the smallest id that links reach.

1. *Shared shingles.* A linked document shares at least ``pct`` % of its shingles with
   other documents, so documents that share less are done. Each task ships its sorted,
   truncated shingles by hash range, one entry a task for those it saw twice itself; the
   owner of a range says which occur elsewhere. (Truncation can only keep a document.)
2. *Copies.* Equal sets are one class from here on, found by a hash of the set.
3. *Candidates.* The hash space is cut into ``SLICES``. Linked sets have a slice where
   the parts reach the same similarity, so it is enough to join the parts of each slice
   by their first shingles in a common order (prefix filter); equal parts are merged
   before they are shipped, and again where they meet. The order puts shingles that many
   chunks hold last, as the owners of step 1 count them. A part that has such a shingle
   among its first ones all the same is made of little else: it is a copy in a large
   family, and is tied to the shingle itself, by a native aggregate, instead of being
   shipped to a task with the family. (More ties make larger clusters, never wrong ones.)
   Ties and the spanning edges that the joins find make clusters.
4. *Prefix-tree join.* The sets of a cluster, in global order (frequent shingles first),
   form a trie. Probing sets walk it level by level, add up the overlap of shared
   stretches once, and leave a subtree when the shingles left on either side can no
   longer reach the overlap needed, or when it holds nothing but documents already in
   the same component. A cluster too large for a task is dealt into blocks.

Nothing is paired within a group: a group of copies is one class, and a group of near
copies costs one probe that connects it, and one more for each member left outside.
Posting lists are kept by component, so a probe passes over all that it is connected with at once.

Defined cases. A null or empty text, or one without words, has no shingle and is its own
component. Repeated rows give a row each. A null id sorts after all others and comes
back as null. Columns of the input that are named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG_MAX, drop_columns, id_order, materialize, text_or_empty
from .hashing import mix, shingle_sets

PCT = 85
SHINGLE = 4
#: Shingles a task gathers before it ships them; bounds its memory.
CHUNK = 2_000_000
#: Shingles an owner of a hash range holds, about.
RANGE = 4_000_000
SLICES = 16
#: Shingles of slices that one task joins, about.
SLICE_GROUP = 4_000_000
#: Shingles of a cluster, or of a block of one, that a task joins.
CLUSTER = 4_000_000
#: A shingle that at least this many chunks hold, and one in ``HEAVY_SHARE`` of all, is heavy; so many heavy ones are ordered by count at most.
HEAVY, HEAVY_SHARE, HEAVY_MOST = 16, 64, 1_000_000
#: Bytes of keys that may be broadcast, at ``KEY_BYTES`` a column.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 16
#: Nodes of a graph with more neighbours than this, and than one in as many of all edges, are joined by broadcast.
HUB = 10_000
ADDED = ["n_shingles", "component_id"]


def signature(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set."""
    if not len(s):
        return 0, 0
    n = np.array([len(s)], np.uint64)
    a = mix(np.bitwise_xor.reduce(mix(s + np.uint64(0x51)), keepdims=True) + n)
    b = mix(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True) * np.uint64(3) + n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


# 1. shared shingles


def few(df: DataFrame) -> bool:
    """Whether a table of keys may be broadcast."""
    most = BROADCAST_BYTES // (KEY_BYTES * (1 + len(df.columns)))
    return df.limit(most + 1).count() <= most


def _pack(docs: DataFrame, k: int, n_ranges: int) -> DataFrame:
    """Rows (key, chunk, tokens, idx): the shingles of a chunk in a hash range; with key -1, the chunk's documents."""
    most = min(max(CHUNK, 16 * n_ranges), 8 * CHUNK)  # pieces for owners should not get too small

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        # the same on every attempt of a task, so that a lost executor's chunks come back under their names
        chunk = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def ship() -> pd.DataFrame:
            nonlocal held, size, chunk
            ids, sets = np.array([h[0] for h in held], np.int64), [h[1] for h in held]
            texts = np.array([h[3] for h in held], np.int64)
            lens = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lens)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
            count = np.diff(np.append(np.flatnonzero(new), len(every)))
            twice = np.repeat(count > 1, count)
            local = np.bincount(owner[twice], minlength=len(sets))
            every, owner = every[new], np.where(count > 1, np.uint16(0xFFFF), owner[new])
            of = ((every >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
            small = ((every * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.uint32) if n_ranges > 1 else (every >> np.uint64(32)).astype(np.uint32)
            cuts = np.searchsorted(of, np.arange(n_ranges + 1, dtype=np.uint64))
            sig = np.array([h[2] for h in held], np.int64).reshape(-1, 2)
            rows = [(-1, chunk, np.concatenate((ids, texts, lens, sig[:, 0], sig[:, 1], local)).tobytes(), b"")]
            rows += [(r, chunk, small[a:b].tobytes(), owner[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            held, size, chunk = [], 0, chunk + 1
            return pd.DataFrame(rows, columns=["key", "chunk", "tokens", "idx"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                for i, row, s in zip(part["__tl_id"], part["__tl_row"], shingle_sets(list(part["__tl_text"]), k), strict=True):
                    held.append((i, s, signature(s), row))
                    size += len(s)
                    if size >= most or len(held) >= 0xFFFF:
                        yield ship()
        if held:
            yield ship()

    return docs.mapInPandas(pack, "key bigint, chunk bigint, tokens binary, idx binary")


def _own(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Which documents of which chunks hold shingles of this range that others hold too: per chunk, packed (idx, count).

    With chunk -1: heavy shingles, and how many chunks hold them; a chunk ships a shingle once.
    """
    if key[0] < 0:
        return rows[["chunk", "tokens", "idx"]]
    tokens = [np.frombuffer(t, np.uint32) for t in rows["tokens"]]
    lens = np.array([len(t) for t in tokens])
    every = np.concatenate(tokens)
    idx = np.concatenate([np.frombuffer(i, np.uint16) for i in rows["idx"]])
    part = np.repeat(np.arange(len(rows)), lens)
    order = np.argsort(every, kind="stable")
    same = every[order]
    new = np.concatenate(([True], same[1:] != same[:-1]))
    count = np.diff(np.append(np.flatnonzero(new), len(same)))
    shared = order[np.repeat(count > 1, count)]
    shared = shared[idx[shared] != 0xFFFF]
    where = part[shared].astype(np.int64) << 16 | idx[shared]
    where, n = np.unique(where, return_counts=True)
    cuts = np.searchsorted(where >> 16, np.arange(len(rows) + 1))
    out = [(c, n[a:b].astype(np.uint32).tobytes(), (where[a:b] & 0xFFFF).astype(np.uint16).tobytes()) for c, a, b in zip(rows["chunk"], cuts[:-1], cuts[1:], strict=True) if a < b]
    heavy = count >= max(HEAVY, len(rows) // HEAVY_SHARE)
    if heavy.any():
        out.append((-1, (np.uint64(key[0]) << np.uint64(32) | same[new][heavy].astype(np.uint64)).tobytes(), count[heavy].astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "tokens", "idx"])


def _settle(pct: int):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        """The documents of a chunk, and whether enough of their shingles are shared."""
        table = rows.loc[rows["idx"].map(len) == 0, "tokens"].iloc[0]
        ids, texts, n, s1, s2, shared = np.frombuffer(table, np.int64).reshape(6, -1)
        shared = shared.copy()
        for t, i in zip(rows["tokens"], rows["idx"], strict=True):
            if len(i):
                shared[np.frombuffer(i, np.uint16)] += np.frombuffer(t, np.uint32)
        return pd.DataFrame({"__tl_id": ids, "__tl_row": texts, "n": n, "s1": s1, "s2": s2, "open": (n > 0) & (100 * shared >= pct * n)})

    return settle


# 3. candidates


def _slice_edges(pct: int):
    def edges(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Spanning edges of the graph of parts with Jaccard similarity of ``pct`` % or more; slice -1 has ties that are known."""
        if key[0] < 0:
            return pd.DataFrame(np.frombuffer(b"".join(rows["tokens"]), np.int64).reshape(-1, 2), columns=["a", "b"])
        first: dict[bytes, int] = {}
        found: list[tuple[int, int]] = []
        for node, tokens in sorted(zip(rows["node"], rows["tokens"], strict=True)):
            at = first.setdefault(tokens, node)
            if at != node:
                found.append((at, node))
        nodes = list(first.values())
        sets = [np.frombuffer(t, np.uint64) for t in first]
        _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        lens = np.array([len(s) for s in sets])
        parts = np.split(ids, np.cumsum(lens)[:-1])
        root = list(range(len(sets)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        posting: dict[int, dict[int, list[int]]] = {}  # by shingle and component
        for i in np.argsort(lens, kind="stable").tolist():
            own, n, seen = set(parts[i].tolist()), int(lens[i]), set()
            order = parts[i][np.argsort(rank[parts[i]])]
            for t in order[: n - -(-pct * n // 100) + 1].tolist():
                if df[t] < 2:
                    continue
                listed = posting.setdefault(t, {})
                for c in [c for c in listed if find(c) != c]:  # the component has grown: one list of the two
                    short, long = sorted((listed.pop(c), listed.get(find(c), [])), key=len)
                    long.extend(short)
                    listed[find(c)] = long
                for c, members in listed.items():
                    if find(c) == find(i):
                        continue
                    for j in members:
                        if j in seen:
                            continue
                        seen.add(j)
                        m = int(lens[j])
                        if 100 * m < pct * n:
                            continue
                        both = sum(map(own.__contains__, parts[j].tolist()))
                        if 100 * both >= pct * (n + m - both):
                            root[find(j)] = find(i)
                            found.append((nodes[i], nodes[j]))
                            break  # connected with all of them
                listed.setdefault(find(i), []).append(i)
        return pd.DataFrame(found, columns=["a", "b"])

    return edges


class Ties:
    """Ties between nodes seen by one task, kept as a forest."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.root.setdefault(x, x)
        while up != x:
            self.root[x] = self.root[up]
            x, up = up, self.root[up]
        return x

    def tie(self, a: int, b: int) -> None:
        self.root[self.find(a)] = self.find(b)

    def rows(self, buckets: int) -> list[tuple]:
        """(-1, bucket, None, packed edges): a tie from each node to the root of its tree."""
        pairs = np.array([(x, self.find(x)) for x in list(self.root)], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        of = np.mod(pairs[:, 0], buckets)
        self.root = {}
        return [(-1, int(b), None, pairs[of == b].tobytes()) for b in np.unique(of)]


class Heavy:
    """Heavy shingles by code (range and truncated hash), and how many chunks hold them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, n_ranges: int):
        order = np.argsort(codes)
        self.codes, self.counts, self.n_ranges = codes[order], counts[order], n_ranges

    def code(self, s: np.ndarray) -> np.ndarray:
        n, low = np.uint64(self.n_ranges), np.uint64(32)
        of = ((s >> low) * n) >> low
        small = ((s * n) >> low) & np.uint64(0xFFFFFFFF) if self.n_ranges > 1 else s >> low
        return of << low | small

    def weights(self, s: np.ndarray) -> np.ndarray:
        """0 for a shingle that is not heavy, else its count."""
        if not len(self.codes):
            return np.zeros(len(s), np.int64)
        codes = self.code(s)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0)


def _heavy(shared: DataFrame, n_ranges: int) -> Heavy:
    """The heavy shingles, ``HEAVY_MOST`` at most: those with the smallest counts are left out, by whole classes of counts.

    They only order the shingles, so that any choice gives the same result.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, i in zip(batch["tokens"], batch["idx"], strict=True):
                yield pd.DataFrame({"code": np.frombuffer(t, np.int64), "n": np.frombuffer(i, np.uint32).astype(np.int64)})

    rows = shared.filter("chunk = -1").mapInPandas(unpack, "code bigint, n bigint").withColumn("c", F.floor(F.log2("n") * 8))
    least, total = None, 0
    for r in rows.groupBy("c").count().orderBy(F.col("c").desc()).collect():  # a few hundred classes
        total += r["count"]
        if total > HEAVY_MOST:
            break
        least = r["c"]
    if least is None:
        return Heavy(np.zeros(0, np.uint64), np.zeros(0, np.int64), n_ranges)
    found = rows.filter(F.col("c") >= least).select("code", "n").toPandas()
    return Heavy(found["code"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64), n_ranges)


def _with_least(pairs: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """``pairs`` and ``m``, the least ``other`` of their ``key``.

    A hub's pairs would meet in one task. Hubs have more than one in ``HUB`` of all pairs, so there are ``HUB`` at
    most, and they are joined by broadcast.
    """
    low = pairs.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("_n"))
    is_hub = F.col("_n") > max(HUB, total // HUB)
    hubs, rest = low.filter(is_hub).drop("_n"), low.filter(~is_hub).drop("_n")
    cold = pairs.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key)
    return cold.unionByName(pairs.join(F.broadcast(hubs), key))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, cluster): the smallest node that each node reaches, by alternating large-star and small-star steps."""
    now = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    while True:
        both, total = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * now.count()
        # every neighbour above a node is linked to the least node next to it
        large = _with_least(both, "a", "b", total).withColumn("m", F.least("a", "m")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # every node and its lower neighbours are linked to the least of these
        small = _with_least(large, "b", "a", total).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        after = materialize(small, "edges")
        done = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0 and after.groupBy("b").count().filter("count > 1").limit(1).count() == 0
        if done:
            return after.select(F.col("b").alias("node"), F.col("a").alias("cluster")).unionByName(after.select(F.col("a").alias("node"), F.col("a").alias("cluster")).distinct())
        now = after


# 4. prefix-tree join


class Trie:
    """A path-compressed prefix tree over distinct sequences that are sorted lexicographically."""

    def __init__(self, seqs: list[np.ndarray]):
        nodes: list[list[int]] = []  # parent, sequence, from, to
        path: list[int] = []
        leaf = []
        for i, s in enumerate(seqs):
            shared = 0
            if i:
                m = min(len(seqs[i - 1]), len(s))
                differ = np.flatnonzero(seqs[i - 1][:m] != s[:m])
                shared = int(differ[0]) if len(differ) else m
            while path and nodes[path[-1]][2] >= shared:
                path.pop()
            if path and nodes[path[-1]][3] > shared:  # the stretch forks here: its head becomes a node
                low = nodes[path.pop()]
                nodes.append([low[0], low[1], low[2], shared])
                low[0], low[2] = len(nodes) - 1, shared
                path.append(len(nodes) - 1)
            nodes.append([path[-1] if path else -1, i, shared, len(s)])
            path.append(len(nodes) - 1)
            leaf.append(len(nodes) - 1)
        table = np.array(nodes, np.int64).reshape(-1, 4)
        self.parent, self.depth, self.leaf = table[:, 0], table[:, 3], np.array(leaf, np.int64)
        kids: dict[int, list[int]] = {}
        for at, up in enumerate(self.parent.tolist()):
            kids.setdefault(up, []).append(at)
        self.levels, todo = [], kids.get(-1, [])
        while todo:
            self.levels.append(np.array(todo, np.int64))
            todo = [k for x in todo for k in kids.get(x, [])]
        stretches = [seqs[s][a:b] for _, s, a, b in nodes]
        self.tokens = np.concatenate(stretches) if nodes else np.zeros(0, np.int64)
        self.size = self.depth - table[:, 2]
        self.begin = np.cumsum(self.size) - self.size
        # how short and how long the sequences are that end in or below a node
        self.short, self.long = np.full(len(nodes), np.iinfo(np.int64).max), np.zeros(len(nodes), np.int64)
        self.short[self.leaf] = self.long[self.leaf] = self.depth[self.leaf]
        for at in reversed(self.levels[1:]):
            np.minimum.at(self.short, self.parent[at], self.short[at])
            np.maximum.at(self.long, self.parent[at], self.long[at])

    def leads_to(self, wanted: np.ndarray) -> np.ndarray:
        """Nodes with a wanted sequence in or below them."""
        out = np.zeros(len(self.parent), bool)
        out[self.leaf[wanted]] = True
        for at in reversed(self.levels[1:]):
            out[self.parent[at[out[at]]]] = True
        return out

    def probe(self, inside: np.ndarray, n: int, wanted: np.ndarray, pct: int) -> np.ndarray:
        """The wanted sequences that reach the similarity with a set of ``n`` tokens, which ``inside`` marks by rank."""
        useful, upto = self.leads_to(wanted), np.concatenate(([0], np.cumsum(inside)))
        walked, overlap = np.zeros(len(self.parent), bool), np.zeros(len(self.parent), np.int64)
        for k, at in enumerate(self.levels):
            at = at[useful[at] & walked[self.parent[at]]] if k else at[useful[at]]
            if not len(at):
                break
            size, begin = self.size[at], self.begin[at]
            ends = np.cumsum(size)
            hit = np.concatenate(([0], np.cumsum(inside[self.tokens[np.arange(ends[-1]) - np.repeat(ends - size - begin, size)]])))
            overlap[at] = hit[ends] - hit[ends - size] + (overlap[self.parent[at]] if k else 0)
            # tokens left in the longest sequence below, and in the probing set after the last rank seen
            left = np.minimum(self.long[at] - self.depth[at], n - upto[self.tokens[begin + size - 1] + 1])
            walked[at[(100 + pct) * (overlap[at] + left) >= pct * (n + self.short[at])]] = True
        at = np.flatnonzero(wanted & walked[self.leaf])
        both, m = overlap[self.leaf[at]], self.depth[self.leaf[at]]
        return at[100 * both >= pct * (n + m - both)]


def components(nodes: list[int], sets: list[np.ndarray], pct: int = PCT, known: list[int] | None = None, probing: list[bool] | None = None) -> list[int]:
    """For each set, the position of the first set of its component (in the order of ``nodes``).

    ``known`` gives components found before; ``probing`` the sets that are to be held against all others.
    """
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    lens = np.array([len(s) for s in sets])
    seqs = [np.sort(rank[p]) for p in np.split(ids, np.cumsum(lens)[:-1])]
    order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
    trie = Trie([seqs[i] for i in order])
    comp = np.arange(len(order)) if known is None else np.unique(np.array([known[i] for i in order]), return_inverse=True)[1]
    asks = np.ones(len(order), bool) if probing is None else np.array([probing[i] for i in order])
    inside = np.zeros(len(df), bool)
    m = lens[order]
    asked = np.zeros(len(order), bool)
    for x in np.flatnonzero(asks).tolist():
        n = int(m[x])
        wanted = (comp != comp[x]) & ~asked & (100 * np.minimum(m, n) >= pct * np.maximum(m, n))
        asked[x] = True  # it has been held against all others
        if not wanted.any():
            continue
        inside[seqs[order[x]]] = True
        for y in trie.probe(inside, n, wanted, pct):
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
        if (comp == comp[x]).all():
            break
        inside[seqs[order[x]]] = False
    of = np.empty(len(order), np.int64)
    of[order] = comp
    least: dict[int, int] = {}
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i]):
        least.setdefault(int(of[i]), i)
    return [least[int(c)] for c in of]


def _large_clusters(members: DataFrame, large: DataFrame, joined) -> DataFrame:
    """(node, rep), rep being a node of its component, for clusters too large for one task.

    A cluster is dealt into blocks, and its first document goes with each of them: for near
    copies of one text that already connects everything. What lies outside the largest
    component then, and only that, is held against every block.
    """
    cuts = large.select("cluster", "blocks", "pivot")
    cuts = F.broadcast(cuts) if few(cuts) else cuts
    placed = members.join(cuts, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = placed.select("__tl_id", "node", "cluster", "n", "block")
    pivots = large.select("pivot.*", "cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    task = lambda *c: F.xxhash64("cluster", *c)
    first = joined(own.unionByName(pivots.select("__tl_id", "node", "cluster", "n", "block")).select("__tl_id", "node", task("block").alias("task")))

    def grouped(edges: DataFrame) -> DataFrame:
        found = connected(edges.select(F.col("node").alias("a"), F.col("rep").alias("b")))
        return materialize(own.join(found.withColumnRenamed("cluster", "g"), "node", "left").withColumn("g", F.coalesce("g", "node")), "groups")

    groups = grouped(first)
    counts = groups.groupBy("cluster", "g").agg(F.sum("n").alias("t"))
    main = counts.groupBy("cluster").agg(F.max_by("g", F.struct("t", "g")).alias("main"), F.count("*").alias("k"))
    loose = main.filter("k > 1")
    if loose.limit(1).count():
        rest = groups.join(loose.select("cluster", "main"), "cluster")
        stray = rest.filter("g <> main")
        parts = stray.groupBy("cluster").agg(F.ceil(F.sum("n") / CLUSTER).alias("parts"), F.max("block").alias("__tl_b")).drop("__tl_b").join(large.select("cluster", "blocks"), "cluster")
        asking = stray.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        asked = rest.join(parts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        tasks = asking.select("__tl_id", "node", task("to", "part").alias("task"), F.col("g").alias("known"), F.lit(True).alias("asks")).unionByName(asked.select("__tl_id", "node", task("block", "part").alias("task"), F.col("g").alias("known"), F.lit(False).alias("asks")))
        second = joined(tasks)
        groups = grouped(first.select("node", "rep").unionByName(second.select("node", "rep")).unionByName(groups.select("node", F.col("g").alias("rep"))))
    return groups.select("node", F.col("g").alias("rep"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, pct: int = PCT) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id``."""
    known = row_membership(docs, id_col, text_col, k, pct)
    docs = drop_columns(docs, [*ADDED, "__tl_id", "__tl_row"])
    # the hash of the text tells rows that share an id apart; rows alike in both are in one component
    one = known.groupBy("__tl_id", "__tl_row").agg(F.min("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = docs.withColumns(row_key(id_col, text_col)).join(one, ["__tl_id", "__tl_row"], "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """What tells rows apart: the id in order, and a hash of the text."""
    return {"__tl_id": id_order(F.col(id_col)), "__tl_row": F.xxhash64(text_or_empty(text_col))}


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, pct: int = PCT) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, of these with the smallest hash of its text.

    Rows alike in id and text (null being an id here) are one document, of which the row with the smallest other columns stays.
    """
    known = row_membership(docs, id_col, text_col, k, pct)
    names, key = docs.columns, ["__tl_id", "__tl_row"]
    stay = (F.col("__tl_id") == F.col("__tl_first.__tl_id")) & (F.col("__tl_row") == F.col("__tl_first.__tl_row"))
    keyed = docs.withColumns(row_key(id_col, text_col))
    kept = keyed.join(known.filter(~stay).select(*key).distinct(), key, "left_anti")
    again = materialize(known.filter(stay).groupBy(*key).count().filter("count > 1").select(*key), "again")
    if again.limit(1).count() == 0:
        return kept.select(*[F.col(f"`{c}`") for c in names])
    one = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__tl_one"))
    return kept.join(again, key, "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(one.select("__tl_one.*"))


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, pct: int = PCT) -> DataFrame:
    """(__tl_id, n_shingles, component_id), a row for each row of ``docs``."""
    return row_membership(docs, id_col, text_col, k, pct).select("__tl_id", "n_shingles", "component_id")


def row_membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, pct: int = PCT) -> DataFrame:
    """(__tl_id, __tl_row, n_shingles, component_id, __tl_first), a row for each row of ``docs``; ``__tl_first`` is the key of the component's first row.

    No text is shuffled but those of cluster members.
    """
    texts = docs.select(*[c.alias(n) for n, c in row_key(id_col, text_col).items()], text_or_empty(text_col).alias("__tl_text"))
    size = texts.agg(F.sum(F.octet_length("__tl_text"))).first()[0] or 0
    n_ranges = max(1, min(CHUNK // 2, round(size / 6 / RANGE)))  # a million at most: beyond 24 TB an owner holds more than RANGE
    shared = _pack(texts, k, n_ranges).withColumn("__tl_spread", F.when(F.col("key") < 0, F.col("chunk")).otherwise(F.col("key")))
    shared = materialize(shared.groupBy("key", "__tl_spread").applyInPandas(lambda key, rows: _own(key, rows), "chunk bigint, tokens binary, idx binary"), "shared")
    known = materialize(shared.filter("chunk >= 0").groupBy("chunk").applyInPandas(_settle(pct), "__tl_id bigint, __tl_row bigint, n bigint, s1 bigint, s2 bigint, open boolean"), "sets")

    classes = known.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("__tl_id", "__tl_row")).alias("key"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max("open").alias("open")).withColumn("first", F.col("key.__tl_id"))
    nodes = materialize(classes.filter("open").select("s1", "first", "n", "key"), "nodes")

    def picked(ids: DataFrame) -> DataFrame:
        """The texts of the documents in ``ids`` (__tl_id, ...), which are broadcast if they are few enough."""
        return texts.drop("__tl_row").join(F.broadcast(ids) if few(ids) else ids, "__tl_id")

    total = known.filter("open").agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // (SLICES * SLICE_GROUP)))
    bits = SLICES.bit_length() - 1

    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(shared, n_ranges))
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ties, first, size = Ties(), {}, 0
        columns = ["slice", "part", "node", "tokens"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at : at + 256], []
                for node, s in zip(part["node"], shingle_sets(list(part["__tl_text"]), k), strict=True):
                    if signature(s)[0] != node:
                        continue
                    cuts = np.searchsorted(s >> np.uint64(64 - bits), np.arange(SLICES + 1, dtype=np.uint64))
                    weights = heavy.value.weights(s)
                    for i in range(SLICES):
                        own, weight = s[cuts[i] : cuts[i + 1]], weights[cuts[i] : cuts[i + 1]]
                        if not len(own):
                            continue
                        tokens = own.tobytes()
                        known_at = first.setdefault((i, tokens), node)
                        if known_at != node:  # an equal part has been shipped
                            ties.tie(node, known_at)
                            continue
                        size += len(tokens)
                        n_first = len(own) - -(-pct * len(own) // 100) + 1
                        if weight.any():
                            mixed = mix(own + np.uint64(i))
                            low = np.lexsort((mixed, weight))[:n_first]
                            for t in mix(own[low][weight[low] > 0] ^ np.uint64(0xC2B2AE3D27D4EB4F + i)).view(np.int64).tolist():
                                ties.tie(node, t)
                            light = mixed[low][weight[low] == 0]
                        else:
                            light = np.sort(mix(own + np.uint64(i)))[:n_first] if groups > 1 else own[:1]
                        out += [(i, int(g), node, tokens) for g in np.unique(light % np.uint64(groups))]
                    if size > 64 << 20 or len(ties.root) > 1_000_000:
                        out += ties.rows(buckets)
                        first, size = {}, 0
                yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(ties.rows(buckets), columns=columns)

    parts = picked(nodes.select(F.col("first").alias("__tl_id"), F.col("s1").alias("node"))).mapInPandas(slices, "slice int, part bigint, node bigint, tokens binary")
    edges = parts.groupBy("slice", "part").applyInPandas(_slice_edges(pct), "a bigint, b bigint")
    clusters = connected(edges)
    members = materialize(clusters.join(nodes.withColumnRenamed("s1", "node"), "node").select(F.col("first").alias("__tl_id"), "node", "cluster", "n", "key"), "clusters")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tasks follow each other, their nodes in order: the component of each node, by its first document."""
        now, held = None, []

        def close() -> pd.DataFrame:
            held.sort(key=lambda h: h[0])
            ids, own = [h[0] for h in held], [h[1] for h in held]
            known = [h[3] for h in held]
            least = components(ids, [h[2] for h in held], pct, None if known[0] is None else known, [h[4] for h in held])
            return pd.DataFrame({"node": own, "rep": [own[i] for i in least], "component_id": [ids[i] for i in least]})

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                for i, node, task, known, asks, s in zip(part["__tl_id"], part["node"], part["task"], part["known"], part["asks"], shingle_sets(list(part["__tl_text"]), k), strict=True):
                    if signature(s)[0] != node:
                        continue
                    if task != now and held:
                        yield close()
                        held = []
                    now = task
                    if held and held[-1][1] == node:
                        held[-1] = (*held[-1][:4], held[-1][4] or asks)
                    else:
                        held.append((i, node, s, None if pd.isna(known) else int(known), bool(asks)))
        if held:
            yield close()

    def joined(tasks: DataFrame) -> DataFrame:
        """``tasks``: __tl_id, node, task, and optionally known, asks."""
        extra = {} if "known" in tasks.columns else {"known": F.lit(None).cast("bigint"), "asks": F.lit(True)}
        rows = picked(tasks.withColumns(extra).select("__tl_id", "node", "task", F.col("known").cast("string").alias("known"), "asks"))
        return materialize(rows.repartition("task").sortWithinPartitions("task", "node").mapInPandas(join, "node bigint, rep bigint, component_id bigint"), "joined")

    sizes = members.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.min(F.struct("__tl_id", "node", "n")).alias("pivot"))
    large = materialize(sizes.filter(F.col("tokens") > CLUSTER).withColumn("blocks", F.ceil(F.col("tokens") / CLUSTER)), "large")
    linked = joined(members.join(large, "cluster", "left_anti").withColumn("task", F.col("cluster"))).select("node", "rep")
    if large.limit(1).count():
        linked = linked.unionByName(_large_clusters(members, large, joined))
    # ids may be null or repeated, so a component's first row is found by its key
    linked = materialize(linked.join(members.select("node", "key"), "node"), "linked")
    least = linked.groupBy("rep").agg(F.min("key").alias("c"))
    linked = linked.join(F.broadcast(least) if few(least) else least, "rep").select(F.col("node").alias("s1"), "c")
    moved = classes.filter("copies > 1 or open").join(linked, "s1", "left").select("s1", "s2", F.coalesce("c", "key").alias("c"))
    # a salt spreads a large group of copies, and gives the small side a shuffle of its own, so that AQE may split what is still large
    salts = 8
    moved = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = known.withColumn("salt", F.pmod(F.hash("__tl_id", "__tl_row"), F.lit(salts))).join(moved, ["s1", "s2", "salt"], "left")
    first = F.coalesce("c", F.struct("__tl_id", "__tl_row"))
    out = out.select("__tl_id", "__tl_row", F.col("n").alias("n_shingles"), first.alias("__tl_first"))
    component = F.col("__tl_first.__tl_id")
    return out.withColumn("component_id", F.when(component == LONG_MAX, None).otherwise(component))
