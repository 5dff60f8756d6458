"""Exact, line and near deduplication against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from oxyframe.llm import exact_dedup, line_dedup, near_dedup

from ..helpers import agree

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [(1, None), (2, ""), (3, "Abc"), (4, "aBC"), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (8, "X" * 200_000), (None, "abc"), (10, "\n\n"), (11, "\x00 \x1f")]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_on_tables(spark, small, bits):
    agree(exact_dedup.exact_dedup(small("documents"), bits).drop("n_chunks"), exact_dedup.ORACLE, SMALL)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_odd_rows(docs_of, bits):
    got = exact_dedup.exact_dedup(docs_of(ODD, ", ids long, recipe long"), bits).collect()
    groups = collections.defaultdict(list)
    for d, t in ODD:
        groups[(t or "").translate(LOWER)].append(d)
    want = sorted((d or -1, max(x or -1 for x in g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in got if r.kept) and len(kept) == len(set(kept)) == len(groups)
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 50_000, dtype=np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), body])
    a = set(exact_dedup.cuts(body, np.array([0, len(body)]))[0])
    b = {e - 777 for e in exact_dedup.cuts(shifted, np.array([0, len(shifted)]))[0]}
    assert len(a & b) > 0.8 * len(a)
    sizes = np.diff([0, *exact_dedup.cuts(np.full(300_000, 97, np.uint8), np.array([0, 300_000]))[0]])
    assert sizes.max() <= exact_dedup.MAX_CHUNK


def test_lines_on_tables(spark, small):
    agree(line_dedup.report(small("documents")), line_dedup.ORACLE, SMALL)


def _lines(rows, min_docs=5):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(space).translate(LOWER)
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 40:
                holders[key(line)].add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or gone.get(key(x), d) == d]
        out.append((d or -1, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines_at_every_edge(spark, docs_of):
    """A key that fills several partitions, others that end at an edge."""
    rng = random.Random(4)
    pool = [f"line {k} " + "é" * 20 + "abcdefghij" * 3 for k in range(30)]
    rows = [(i, "\n".join(["Common " + "w" * 40, *rng.choices(pool, k=rng.randint(0, 5)), "short", "Common " + "w" * 40 + " "][: rng.randint(0, 8)])) for i in range(300)]
    rows += [(None, pool[0]), (7, rows[7][1]), (301, None), (302, "")]
    for parts in (1, 2, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) if r.doc_id != 0 else (-1, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(docs_of(rows)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == _lines(rows)
    assert line_dedup.report(docs_of([])).count() == 0


def _words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]


def _classes(rows, threshold=0.8):
    """Components of all pairs whose weighted Jaccard similarity reaches the threshold."""
    sets = {}
    for d, t in rows:
        w = _words(t)
        sets[d] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    df = collections.Counter(s for v in sets.values() for s in v)
    n, common = len(rows), near_dedup.COMMON
    weights = {d: {s: c * (1 + np.log(n / max(df[s], common * n, 1)) / np.log(1 / common)) for s, c in v.items()} for d, v in sets.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a].keys() & sets[b].keys():
            common = sum(min(x, weights[b][s]) for s, x in weights[a].items() if s in weights[b])
            if common / (sum(weights[a].values()) + sum(weights[b].values()) - common) >= threshold:
                root[find(a)] = find(b)
    out = collections.defaultdict(set)
    for d in sets:
        out[find(d)].add(d)
    return {frozenset(v) for v in out.values()}


def _found(df):
    out = collections.defaultdict(set)
    for r in df.collect():
        out[r.class_id].add(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    return {frozenset(v) for v in out.values()}


def test_near_against_all_pairs(docs_of):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        base = rng.choices(vocab, k=rng.randint(30, 300))
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, len(w) // 60, len(w) // 25, len(w) // 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n := n + 1, " ".join(w)))
    rows += [(n + 1, "only three words"), (n + 2, "Only three  words"), (n + 3, "word")]
    want, got = _classes(rows), _found(near_dedup.near_dedup(docs_of(rows, ", keys long, node long")))
    assert not [g for g in got if not any(g <= w for w in want)]
    linked = sum(len(w) - 1 for w in want)
    assert sum(len(w) - 1 for w in want) - sum(len(g) - 1 for g in got) <= 0.02 * linked


def test_near_large_group(docs_of):
    """A chain of edits and many copies are one class, without pairs of all with all."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    group = frozenset(d for d, _ in rows)
    rows += [(2000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(1400)]
    assert [g for g in _found(near_dedup.near_dedup(docs_of(rows))) if len(g) > 1] == [group]


def test_near_pairs_inside_a_template_family(docs_of):
    """Pairs on one template: members of different pairs share buckets but are below the threshold."""
    rows = []
    for i in range(700):
        pair = [f"p{i // 2}x{k}" for k in range(14)]
        rows.append((i, " ".join([f"t{k}" for k in range(280)] + pair + [f"o{i}x{k}" for k in range(6)])))
    got = _found(near_dedup.near_dedup(docs_of(rows)))
    assert sorted(map(len, got)) == [2] * 350


def test_near_odd_rows(docs_of):
    got = near_dedup.near_dedup(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    of = {r.doc_id: r.class_id for r in got}
    assert of[3] == of[4] and of[7] == of[8] and of[1] == 1 and of[2] == 2 and of[10] == 10
    assert near_dedup.near_dedup(docs_of([])).count() == 0
    kept = near_dedup.keep_one(docs_of([(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)])).collect()
    assert sorted(str(r.doc_id) for r in kept if r.doc_id not in (1, 2)) == ["3", "None"] and len(kept) == 3


def test_frequent_shingles_are_exact(spark, docs_of):
    rows = [(i, f"a b c d e f x{i} y{i} z{i} u{i} v{i}" if i % 3 else f"q{i} r{i} s{i} t{i} u{i}") for i in range(600)]
    docs = docs_of(rows)
    known, df = near_dedup.document_frequencies(docs, 600)
    true = collections.Counter()
    for _, t in rows:
        w = t.split()
        true.update({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert sorted(df.tolist())[-2:] == sorted(true.values())[-2:] == [400, 400]


def test_star_rounds(spark):
    rng = random.Random(6)
    edges = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150)) if a != b] + [(300 + i, 301 + i) for i in range(40)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for e in edges for x in e}


def test_components_of_few_links_take_few_tasks(spark):
    """A round over few edges is not a task for each partition of the shuffle."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)] + [(i, i + 2) for i in range(0, 100, 2)], "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = near_dedup.components(edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert len({r.root for r in found.collect()}) == 150 and found.count() == 400


def test_salted_join_has_one_long_key(spark):
    # By several columns a broadcast table takes a page of tens of MB in every executor.
    large = spark.createDataFrame([(k, n) for n, k in enumerate([1, 1, 1, 2, 3, None])], "k long, n long")
    few = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    for how, more in (("inner", []), ("left", [(3, 4, None), (None, 5, None)])):
        done = near_dedup.salted(large, few.hint("broadcast") if how == "inner" else few, "k", how)
        assert sorted(map(tuple, done.select("k", "n", "v").collect()), key=lambda r: r[1]) == [(1, 0, 10), (1, 1, 10), (1, 2, 10), (2, 3, 20), *more]
        by = re.search(r"Join \[([^]]*)\], \[([^]]*)\]", done._jdf.queryExecution().executedPlan().toString())
        assert by and "," not in by[1] + by[2]
    paired = near_dedup.salted(large.selectExpr("struct(k, n) d", "n"), few.selectExpr("struct(k, 3L n) d", "v"), "d", "left")
    assert sorted(map(tuple, paired.select("n", "v").collect())) == [(n, 20 if n == 3 else None) for n in range(6)]
