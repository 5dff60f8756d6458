"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words: weight = count in the
text times idf. idf = 1 + ln(N / max(df, COMMON * N)) / ln(1 / COMMON), from 1 for what
all documents hold to 2 for what at most a share COMMON of them does; damped like this
a group of near copies that is a large part of the corpus still is one, though all
it shares is common. The frequencies are exact, found in two passes: if a shingle is
in a share COMMON of all documents, its counts over blocks where it holds half that
share add up to at least half of it; so blocks report shingles that reach half, sums
below half are discarded, and the few left (at most 2 / COMMON times a mean document's
shingles, whatever the corpus) are broadcast and counted.

Samples come from a table of 2**16 fixed draws (r, c, beta); a shingle picks its
draw by a multiplicative hash for each of BANDS * ROWS samples. Bands of equal
samples make buckets. Texts with equal weighted sets are merged before, so a group
of exact copies is one node. Sets (five bytes a shingle) and bands are written once.

Buckets are range-partitioned by (bucket, node), so a hot one spreads over tasks. A
first round pairs the nodes of a bucket along a tree of fan FAN and with the node
before; linked pairs make components. A second round then closes every bucket that
still holds several components: its nodes, ordered by component, are cut into blocks
of bounded nodes and bytes, and every two blocks that do not belong to one and the
same component meet in a task, which computes all similarities between them as a
product of their weighted sets. So no two nodes of different components that share a
bucket stay uncompared, no pair is made within a component, and no task takes more
than two blocks. Pairs are judged by weighted Jaccard similarity of the whole sets.
Components are found by contraction: each node points to its least neighbour,
pointers are doubled, and edges between the roots go on.

Edge cases: null counts as empty; a text without words, and a row with a null
``doc_id``, is a class of its own. A text of one to four words is one shingle. Rows
that repeat a ``doc_id`` count as one node, of which one row is kept. Other columns
pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from . import spread

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
COMMON = 0.01
FAN = 128  # nodes of a bucket that are paired with the same one
BLOCK_NODES, BLOCK_BYTES = 256, 4 << 20  # what a block of a bucket holds at most; a larger set is a block by itself
SALTS = 8  # parts that the rows of one key are dealt over in a join with few rows for each key
BLOCK = 1 << 21  # shingles that one count in memory takes

_BITS = 40
_MASK = B.U((1 << _BITS) - 1)
_rng = np.random.Generator(np.random.PCG64(99))
_DRAWS = 1 << 16
_R = _rng.gamma(2.0, 1.0, _DRAWS)
_LN_C = np.log(_rng.gamma(2.0, 1.0, _DRAWS))
_BETA = _rng.uniform(0.0, 1.0, _DRAWS)
_PICK = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * B.U(2) + B.U(1)


def sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, their counts, and where each text's begin."""
    tok, at = B.words(data, off)
    sh, begin = B.shingles(tok, at, width)
    n = len(off) - 1
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(begin)) << B.U(_BITS)) | (sh >> B.U(64 - _BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(key)))
    distinct = key[first]
    return distinct & _MASK, tf, np.searchsorted(distinct >> B.U(_BITS), np.arange(n + 1, dtype=np.uint64))


def _frequent(width: int, common: float):
    """Shingles in half of ``common`` of a block's documents, with their counts and the block's size."""

    def report(parts: list[np.ndarray], docs: int) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(parts), return_counts=True)
        hot = n >= common / 2 * docs
        u, n = u[hot].astype(np.int64), n[hot]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64)), pa.array(np.full(len(u), docs, np.int64))], names=["s", "n", "docs"])

    def run(batches):
        # A full block waits for the next one, so that the last few documents are not a block in which all is frequent.
        held, held_docs, parts, docs, size = [], 0, [], 0, 0
        for _, data, off in B.rows_of(batches):
            u, _, _ = sets(data, off, width)
            parts.append(u)
            docs, size = docs + len(off) - 1, size + len(u)
            if size >= BLOCK and (docs >= 10 / common or size >= 4 * BLOCK):
                if held:
                    yield report(held, held_docs)
                held, held_docs, parts, docs, size = parts, docs, [], 0, 0
        if held and docs >= 10 / common:
            yield report(held, held_docs)
            held, held_docs = [], 0
        if held or parts:
            yield report(held + parts, held_docs + docs)

    return run


def _count(wanted, width: int):
    def run(batches):
        known = wanted.value
        total = np.zeros(len(known), np.int64)
        for _, data, off in B.rows_of(batches):
            u, _, _ = sets(data, off, width)
            at = np.minimum(np.searchsorted(known, u), len(known) - 1)
            total += np.bincount(at[known[at] == u], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(total)], names=["s", "n"])

    return run


def document_frequencies(docs: DataFrame, n_docs: int, width: int = WIDTH, common: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that half of ``common`` of the documents hold, or more, and their exact document counts."""
    text = docs.select("text")
    seen = text.mapInArrow(_frequent(width, common), "s long, n long, docs long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # What the blocks that did not report can add is below half of ``common`` of their documents.
    rows = seen.where(F.col("n") + common / 2 * (n_docs - F.col("docs")) >= common * n_docs).select("s").collect()
    known = np.sort(np.array([r.s for r in rows], np.int64)).astype(np.uint64)
    if not len(known):
        return known, np.zeros(0, np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    counted = {r.s: r.n for r in text.mapInArrow(_count(sent, width), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return known, np.array([counted[int(s)] for s in known], np.int64)


class Weights:
    """idf of shingles from the frequencies of the common ones."""

    def __init__(self, known: np.ndarray, df: np.ndarray, n_docs: int, common: float = COMMON):
        self.known = known
        floor = max(1.0, common * n_docs)
        self.idf = 1 + np.log(n_docs / np.maximum(df, floor)) / np.log(1 / common)
        self.rare = float(1 + np.log(n_docs / floor) / np.log(1 / common))

    def idf_of(self, u: np.ndarray) -> np.ndarray:
        w = np.full(len(u), self.rare)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, u), len(self.known) - 1)
            hit = self.known[at] == u
            w[hit] = self.idf[at[hit]]
        return w

    def of(self, u: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.idf_of(u) * tf


def _ordered(x: np.ndarray) -> np.ndarray:
    """Floats as integers of the same order, in the upper half of 64 bits."""
    b = x.astype(np.float32).view(np.uint32)
    return np.where(b >> np.uint32(31), ~b, b | np.uint32(1 << 31)).astype(np.uint64) << B.U(32)


def _ln_a(ln_w: np.ndarray, draw: np.ndarray) -> np.ndarray:
    r, beta = _R[draw], _BETA[draw]
    return _LN_C[draw] - r * (np.floor(ln_w / r + beta) - beta) - r


def samples(u: np.ndarray, w: np.ndarray, starts: np.ndarray, rare: float) -> np.ndarray:
    """BANDS * ROWS samples of each set; ``starts`` are where the sets begin, none of them empty."""
    plain = _ordered(_ln_a(np.full(_DRAWS, np.log(rare)), np.arange(_DRAWS)))
    low = u & B.U(0xFFFFFFFF)
    odd = np.flatnonzero(w != rare)
    ln_odd = np.log(w[odd])
    out = np.empty((len(_PICK), len(starts)), np.uint64)
    for k, a in enumerate(_PICK):
        draw = ((u * a) >> B.U(48)).view(np.int64)
        rank = plain[draw]
        if len(odd):
            rank[odd] = _ordered(_ln_a(ln_odd, draw[odd]))
        out[k] = np.minimum.reduceat(rank | low, starts)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys; the band is part of a key."""
    keys = np.empty((sample.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(sample.shape[1], b + 1, np.uint64)
        for k in range(b * ROWS, b * ROWS + ROWS):
            acc = B.mix(acc * B.U(0xD6E8FEB86659FD93) + sample[k])
        keys[:, b] = acc
    return keys


def pack(u: np.ndarray, tf: np.ndarray) -> bytes:
    """A set: how many shingles, five bytes of each, then place and count of those that repeat."""
    body = np.ascontiguousarray(u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
    more = np.flatnonzero(tf > 1)
    return len(u).to_bytes(4, "little") + body + np.stack([more, tf[more]], axis=1).astype("<u4").tobytes()


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(body, np.uint8, 5 * n, 4).reshape(n, 5)
    tf = np.ones(n, np.int64)
    more = np.frombuffer(body[4 + 5 * n :], "<u4").reshape(-1, 2).astype(np.int64)
    tf[more[:, 0]] = more[:, 1]
    return wide.view("<u8")[:, 0].astype(np.uint64), tf


_SIGNED = "doc_id long, d1 long, d2 long, keys array<long>, body binary"


def _signed(weights, width: int):
    def run(batches):
        model = weights.value
        for batch, data, off in B.rows_of(batches):
            u, tf, begin = sets(data, off, width)
            some = np.flatnonzero(begin[1:] > begin[:-1])
            if not len(some):
                continue
            keys = band_keys(samples(u, model.of(u, tf), begin[some], model.rare)).view(np.int64)
            bodies = [pack(u[begin[i] : begin[i + 1]], tf[begin[i] : begin[i + 1]]) for i in some.tolist()]
            digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in bodies), "<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists, pa.array(bodies, pa.binary())],
                names=["doc_id", "d1", "d2", "keys", "body"],
            )

    return run


def similarity(u1: np.ndarray, w1: np.ndarray, u2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    if not len(u1) or not len(u2):
        return 0.0
    at = np.minimum(np.searchsorted(u2, u1), len(u2) - 1)
    hit = u2[at] == u1
    common = float(np.minimum(w1[hit], w2[at[hit]]).sum(dtype=np.float64))
    return common / (float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - common)


def _verified(weights, threshold: float):
    def run(batches):
        model = weights.value
        for batch in batches:
            sim = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (u1, n1), (u2, n2) = unpack(x), unpack(y)
                sim.append(similarity(u1, model.of(u1, n1), u2, model.of(u2, n2)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array(np.array(sim) >= threshold, pa.bool_()))

    return run


def verified(near: DataFrame, bodies: DataFrame, weights, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those whose weighted Jaccard similarity reaches the threshold; ``bodies`` are node, body."""
    one = near.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    two = one.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(_verified(weights, threshold), "a long, b long, similarity double")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted column: where its runs begin, each row's run, each row's place in it."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    return starts, run, np.arange(len(key)) - starts[run]


def _columns(batches, n: int) -> list[np.ndarray]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate([p[k] for p in parts]) for k in range(n)] if parts else [np.zeros(0, np.int64)] * n


def _tree(fan: int):
    """Of sorted (key, node, bytes): pairs of nodes (kind 0), first nodes of what may go on in another task (1), members of buckets of several (2)."""

    def run(batches):
        key, node, size = _columns(batches, 3)
        if not len(key):
            return
        starts, run_of, i = _runs(key)
        step, up = fan, i // fan * fan
        while len(centre := np.flatnonzero((up == i) & (i > 0))):
            step *= fan
            up[centre] = i[centre] // step * step
        at = np.flatnonzero(i > 0)
        x, y = np.concatenate([node[at], node[at]]), np.concatenate([node[starts[run_of[at]] + up[at]], node[at - 1]])
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
        edge = np.unique([0, len(starts) - 1])
        several = np.bincount(run_of) > 1
        several[edge] = True
        kept = np.flatnonzero(several[run_of])
        for kind, cols in ((0, (pair[:, 0], pair[:, 1], np.zeros(len(pair), np.int64))), (1, (key[starts[edge]], node[starts[edge]], size[starts[edge]])), (2, (key[kept], node[kept], size[kept]))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in cols)], names=["kind", "a", "b", "n"])

    return run


def first_round(member: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows of ``_tree`` over all buckets."""
    order = ["key", "node"]
    return spread.cut(member.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tree(fan), "kind int, a long, b long, n long"))


def tree_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b; the parts of a bucket in several tasks (two a task at most) are paired in a row."""
    own = found.where("kind = 0").select("a", "b")
    before = F.lag("b").over(Window.partitionBy("a").orderBy("b"))
    over = found.where("kind = 1").select(before.alias("x"), F.col("b").alias("y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return own.union(over).distinct()


def _blocks(nodes: int, most: int):
    """Of sorted (key, root, node, bytes): blocks (kind 1: key, block, least and greatest root) and their nodes (kind 0: block, node, root) of buckets with several roots."""

    def run(batches):
        key, root, node, size = _columns(batches, 4)
        if not len(key):
            return
        starts, run_of, _ = _runs(key)
        ends = np.append(starts[1:], len(key)) - 1
        open_ = root[starts] != root[ends]
        # What the tasks beside this one hold of the first and last bucket is not known here.
        open_[[0, -1]] = True
        total = np.concatenate(([0], np.cumsum(size)))
        block, number = [], TaskContext.get().partitionId() << 32
        for a, b in zip(starts[open_].tolist(), (ends[open_] + 1).tolist(), strict=True):
            while a < b:
                c = max(a + 1, min(b, a + nodes, int(np.searchsorted(total, total[a] + most, "right")) - 1))
                block.append((a, c, number))
                number += 1
                a = c
        first, last, name = (np.array(x, np.int64) for x in zip(*block, strict=True))
        rows = np.concatenate([np.arange(a, c) for a, c, _ in block])
        of = np.repeat(name, last - first)
        for kind, cols in ((1, (key[first], name, root[first], root[last - 1])), (0, (of, node[rows], root[rows], np.zeros(len(rows), np.int64)))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c.astype(np.int64)) for c in cols)], names=["kind", "a", "b", "c", "d"])

    return run


def similarities(bodies: list[bytes], model: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of all sets with all: shared weights are a product over the shingles that several hold."""
    sets_ = [unpack(x) for x in bodies]
    row = np.repeat(np.arange(len(sets_)), [len(u) for u, _ in sets_])
    u, tf = np.concatenate([u for u, _ in sets_]), np.concatenate([n for _, n in sets_])
    idf = model.idf_of(u)
    total = np.bincount(row, idf * tf, len(sets_))
    order = np.lexsort((tf, u))
    row, u, tf, idf = row[order], u[order], tf[order], idf[order]
    # min(m, n) counts the levels that both reach; the levels of a shingle are its different counts.
    starts, run, _ = _runs(u)
    level = np.ones(len(u), bool)
    level[1:] = (run[1:] != run[:-1]) | (tf[1:] != tf[:-1])
    name = np.cumsum(level) - 1
    below = np.where(np.isin(np.flatnonzero(level), starts), 0, np.append(0, tf[level][:-1]))
    weight = (tf[level] - below) * idf[level]
    lowest = name[starts][run]
    count = name - lowest + 1
    feature = np.repeat(lowest - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    holder = np.repeat(row, count)
    shared = np.bincount(feature, minlength=len(weight)) > 1
    use = shared[feature]
    feature, holder = (np.cumsum(shared) - 1)[feature[use]], holder[use]
    weight = weight[shared]
    order = np.argsort(feature, kind="stable")
    feature, holder = feature[order], holder[order]
    common = np.zeros((len(sets_), len(sets_)))
    for a in range(0, len(weight), 4096):
        lo, hi = np.searchsorted(feature, [a, a + 4096])
        x = np.zeros((len(sets_), min(4096, len(weight) - a)))
        x[holder[lo:hi], feature[lo:hi] - a] = 1
        common += (x * weight[a : a + 4096]) @ x.T
    return common / np.maximum(total[:, None] + total[None, :] - common, 1e-300)


def _closed(weights, threshold: float):
    """Links between nodes of different roots in a group of two blocks."""

    def run(group: pa.Table) -> pa.Table:
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
        hit = np.triu(similarities(group.column("body").to_pylist(), weights.value) >= threshold, 1) & (root[:, None] != root[None, :])
        i, j = np.nonzero(hit)
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return run


def second_round(several: DataFrame, roots: DataFrame, bodies: DataFrame, weights, threshold: float, nodes: int = BLOCK_NODES, most: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between nodes of different components that share a bucket; ``several`` are key, node, n."""
    known = several.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "node", "n")
    order = ["key", "root", "node"]
    found = spread.cut(known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(nodes, most), "kind int, a long, b long, c long, d long"))
    block = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("block"), F.col("c").alias("lo"), F.col("d").alias("hi"))
    other = block.select("key", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = block.join(other, "key").where("block <= block2 and (lo <> hi or lo2 <> hi2 or lo <> lo2)")
    place = meet.select("block", "block2", F.explode(F.array_distinct(F.array("block", "block2"))).alias("at"))
    row = found.where("kind = 0").select(F.col("a").alias("at"), F.col("b").alias("node"), F.col("c").alias("root"))
    placed = place.join(row, "at").select("block", "block2", "node", "root").join(bodies, "node")
    return placed.groupBy("block", "block2").applyInArrow(_closed(weights, threshold), "a long, b long").distinct()


def salted(large: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with ``few``, whose key is unique; the rows of a hot key are dealt over several tasks.

    Rows meet by one hash of key and salt, and of those the ones of the same key: where ``few`` is broadcast, a table
    by one long takes what its rows need, one by several columns a page (32 MB for a heap of 1.8 GB) in each executor
    until the driver lets go of it.
    """
    dealt = large.withColumn("_here", F.expr(f"xxhash64({key}, int(pmod(xxhash64({', '.join(large.columns)}), {salts})))"))
    rest = [c for c in few.columns if c != key]
    known = few.select(F.col(key).alias("_key"), *rest, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    known = known.select("_key", *rest, F.xxhash64("_key", "_salt").alias("_there"))
    # "=" would make the key a second column to join by.
    return dealt.join(known, F.expr(f"_here = _there and {key} between _key and _key"), how).drop("_here", "_there", "_key")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); the root is the least node of a component.

    What a round makes is gathered into as many partitions as its rows need: a round over few edges is not
    a task and its files for each partition of a shuffle that the documents need.
    """
    edges = spread.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first, nodes = True, 0
    while n := edges.count():
        nodes = nodes or 2 * n  # at most, of all rounds
        edges = spread.gathered(edges, n)
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        up = spread.cut(spread.gathered(up, 2 * n))
        while True:
            # Pointers of those that are no roots; where none of them is pointed to, all point to roots.
            on = up.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("top"))
            if spread.gathered(salted(up, on, "root"), 2 * n).isEmpty():
                break
            up = spread.cut(spread.gathered(salted(up, on, "root", "left").select("node", F.coalesce("top", "root").alias("root")), 2 * n))
        one = salted(edges, up.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").select("x", "b")
        two = salted(one, up.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = spread.cut(spread.gathered(two.where("a <> b").distinct(), n))
        if first:
            labels = up
        else:
            moved = salted(labels, up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            labels = spread.cut(spread.gathered(moved.select("node", F.coalesce("top", "root").alias("root")), nodes))
        first = False
    return labels


def near_dedup(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, common: float = COMMON) -> DataFrame:
    """One row per document: doc_id, class_id (the doc_id of the class's document that stays), kept."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs = src.count()
    known, df = document_frequencies(src, n_docs, width, common)
    weights = docs.sparkSession.sparkContext.broadcast(Weights(known, df, max(1, n_docs), common))
    signed = spread.written(src.where("doc_id is not null").mapInArrow(_signed(weights, width), _SIGNED).withColumn("row", F.monotonically_increasing_id()))
    reps = spread.cut(signed.groupBy("d1", "d2").agg(F.max("doc_id").alias("node"), F.first("keys").alias("keys"), F.first(F.length("body")).alias("n")))
    found = first_round(reps.select(F.explode("keys").alias("key"), "node", F.col("n").cast("long").alias("n")))
    near = spread.cut(tree_pairs(found))
    # All nodes of buckets of several are in pairs, so the second round needs no other sets.
    paired = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bodies = spread.cut(signed.select(F.col("doc_id").alias("node"), "body").join(paired, "node", "left_semi"))
    links = spread.cut(verified(near, bodies, weights, threshold).select("a", "b"))
    roots = components(links)
    several = found.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"), "n")
    more = spread.cut(second_round(several, roots, bodies, weights, threshold))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    classes = reps.select("node", "d1", "d2").join(roots, "node", "left").select(F.struct("d1", "d2").alias("d"), F.coalesce("root", "node").alias("class_id"))
    # Of rows that repeat an id the first one stands for it.
    again = signed.groupBy("doc_id").agg(F.min("row").alias("first"), F.count("*").alias("times")).where("times > 1").select("doc_id", "first")
    classed = salted(signed.select("doc_id", "row", F.struct("d1", "d2").alias("d")), classes, "d").join(again, "doc_id", "left")
    result = classed.select("doc_id", "class_id", F.expr("doc_id = class_id and coalesce(row = first, true)").alias("kept"))
    # Texts without words and rows without an id have no signature.
    rest = src.where("doc_id is null or text is null or not text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return result.unionByName(rest)


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, common: float = COMMON) -> DataFrame:
    """The documents without those that another document of their class stands for; of a repeated id one row stays."""
    done = spread.cut(near_dedup(docs, width, threshold, common).where("doc_id is not null"))
    out, first, second, zero, row = spread.free(docs, "_out", "_one", "_two", "_zero", "_row")
    one, two = spread.apart()
    same = (F.col(first) == F.col(out)) & (F.col(second) == F.col(zero))

    def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
        named = ids.select(F.col("doc_id").alias(out), F.lit(0).cast("long").alias(zero)).hint("shuffle_hash")
        return rows.withColumns({first: one, second: two}).join(named, same, "left_anti").drop(first, second)

    rest = without(docs, done.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept"))
    again = done.groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return rest
    doc = F.col("doc_id").cast("long")
    several = rest.join(again.select(F.col("doc_id").alias(out)), doc == F.col(out), "left_semi")
    single = several.groupBy(doc.alias(out)).agg(F.max_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text")).alias(row))
    return without(rest, again).unionByName(single.select(f"{row}.*"))
