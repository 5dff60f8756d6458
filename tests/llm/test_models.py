"""The classifier, the language model and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from oxyframe.llm import bytesops as B
from oxyframe.llm import decontaminate, lm_score, near_dedup, pieces, quality, queries, spread

from .test_dedup import _classes as all_pair_classes

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def test_quality_held_out(spark):
    docs, labels = (spread.table(spark, MIDDLE, t) for t in ("documents", "labels"))
    scores = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    held = [(r.quality, scores[r.doc_id]) for r in labels.collect() if scores[r.doc_id].held_out]
    assert all(s.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and s.predicted == (s.score >= 0.5) and 0 <= s.score <= 1 for d, s in scores.items())
    assert np.mean([q == s.predicted for q, s in held]) > 0.95 and len(held) > 80


def _word_hash(word):
    h = sum(int(B.BYTE_CODE[c]) * pow(int(B.BASE), i, 2**64) for i, c in enumerate(word.lower())) + len(word)
    return int(B.mix(np.array([h % 2**64], np.uint64))[0])


def _features(text):
    """Of a text's words, one by one: words, pairs, and runs of one to three shapes."""
    mixed = lambda x: int(B.mix(np.array([x % 2**64], np.uint64))[0]) >> 64 - quality.FEATURE_BITS
    out, before, shapes = set(), None, [0, 0]
    for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()):
        upper, digit = sum(65 <= c < 91 for c in w), sum(48 <= c < 58 for c in w)
        lower = sum(97 <= c < 123 or c > 127 for c in w)
        case = 0 if not upper else 3 if not lower and upper > 1 else 1 if upper == 1 and 65 <= w[0] < 91 else 2
        h = _word_hash(w)
        shape = case + 4 * min(len(w) - upper - lower - digit, 3) + 16 * (digit > 0) + 32 * (upper + lower == 0) + 64 * (h == before) + 1
        one, two = shapes[-1], shapes[-2]
        out |= {mixed(h), mixed(h * 3 + (before or 0) * 0x2545F4914F6CDD1D), mixed(shape + (1 << 40)), mixed(shape + (one << 10) + (2 << 40)), mixed(shape + (one << 10) + (two << 20) + (3 << 40))}
        before = h
        shapes.append(shape)
    return out


def _quality(model, text):
    found = _features(text)
    return 1 / (1 + np.exp(-2 * (sum(float(model[0][f]) for f in found) / np.sqrt(max(1, len(found))) + model[1])))


def test_quality_against_brute_force(spark, small, docs_of):
    """Every score from the words of the text alone."""
    docs, labels = small("documents").select("doc_id", "text"), small("labels")
    both = docs.unionByName(docs_of([(10**6, None), (10**6 + 1, "ÉÄ Straße AB 12 12 a-b-c !!! É"), (10**6 + 2, "\x0b \n")]).select("doc_id", "text"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r._score for r in quality.score(both, model).collect()}
    assert len(got) > 200 and all(abs(got[r.doc_id] - _quality(model, r.text)) < 1e-4 for r in both.collect())


def test_quality_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (6, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (3, "good words here"), (4, "### @@@ !!!"), (None, "x"), (5, "w " * 100_000)]
    got = quality.report(docs_of(rows, ", label long"), labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.report(docs_of(rows), labels.limit(0)).collect()} == {0.5}
    assert quality.report(docs_of([]), labels).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.append(rng.integers(10, 500, 20), 3 if k % 2 else 4)).astype(np.int32) for k in range(200)]
    weight, bias = quality.fit_arrays([quality.packed(x) for x in sets], [k % 2 for k in range(200)])
    many = np.arange(0, 1 << quality.FEATURE_BITS, 3, dtype=np.int32)
    assert all((quality.unpacked(quality.packed(x)) == x).all() for x in (many, sets[0], many[:0])) and len(quality.packed(many)) <= 32769
    assert np.mean([(weight[x].sum() / np.sqrt(len(x)) + bias > 0) == (k % 2 == 1) for k, x in enumerate(sets)]) > 0.97


def _tokens(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w] + ["\0end"]


def _check_base(rows, got):
    learned = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    count = collections.Counter(w for d, t in rows if learned(d) for w in _tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d if d is not None else -1, len(_tokens(t)), sum(w in count for w in _tokens(t)), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in _tokens(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == (not learned(r.doc_id)) and r.score < 0 for r in got)


def test_lm_base_is_exact(spark, small):
    docs = small("documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _check_base(rows, lm_score.score(docs).collect())


def test_lm_beats_the_base_on_learnable_text(spark, docs_of):
    rng = np.random.default_rng(3)
    stem = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]
    rows = []
    for i in range(300):
        a, words = 0, []
        for _ in range(150):
            # A word mostly fixes the next one.
            a = (a * 7 + 3) % 40 if rng.random() < 0.8 else int(rng.integers(0, 40))
            words.append(stem[a])
        rows.append((i, " ".join(words)))
    got = lm_score.score(docs_of(rows)).collect()
    _check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "Abc abc"), (None, "x y"), (3, "Abc abc"), (4, "z" * 70_000), (5, " \n "), (6, "é ☃\x00")]
    _check_base(rows, lm_score.score(docs_of(rows, ", train long, block long")).collect())
    assert lm_score.score(docs_of([])).count() == 0


def test_lm_score_does_not_depend_on_neighbours(spark, small):
    docs = small("documents")
    a = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    b = {r.doc_id: r.score for r in lm_score.score(docs.repartition(5)).collect()}
    assert all(abs(a[d] - b[d]) <= 1e-3 * abs(a[d]) for d in a)


def test_probabilities_sum_to_one():
    """Every code is complete, so the ways of a bit's tree exhaust it."""
    code = lm_score.Code([b"abab the cat " * 50])
    size = code.size.reshape(-1, 256)
    assert np.allclose((0.5**size.astype(float)).sum(axis=1), 1)


def _hash(data):
    h = 0
    for i, c in enumerate(data):
        h = (h + int(lm_score._BYTE[c]) * pow(lm_score._BASE, i, 2**32)) % 2**32
    return h


def _slots(code, text):
    """Of each coded byte of a text, in plain steps: for each bit its places in the tables, gate and value."""
    m32 = lambda x: x % 2**32
    words = [w.encode() for w in _tokens(text)[:-1]]
    coded = b"".join(w + b" " for w in words) + bytes([lm_score.END])
    pads = bytes([lm_score.END] * 4)
    before, word, out = b"", b"", []
    for i, c in enumerate(coded):
        tail = (pads + coded[:i])[-4:]
        two = tail[3] | tail[2] << 8
        which = int(code.which[two])
        own = m32(which * 0x9E3779B1)
        four = m32((two | (tail[1] | tail[0] << 8) << 16) + own)
        prefix, last = m32(_hash(word) + own), _hash(before) ^ own
        mul = [int(x) for x in lm_score._MUL]
        ctx = [m32((four ^ four >> 15) * mul[0]), m32(prefix * mul[1]), m32(m32(prefix + last * 0x2545F491) * mul[2])]
        places = [m32((x ^ x >> 16) * 0x9E3779B1) >> 32 - lm_score.TABLE_BITS for x in ctx]
        way, bits = which * 256 + c, []
        for step in code.step[code.start[way] : code.start[way] + code.size[way]].tolist():
            bits.append(([p ^ step >> 4 for p in places], min(len(word), 3) * 8 + (step >> 1 & 7), step & 1))
        out.append(bits)
        if c in (0x20, lm_score.END):
            before, word = word, b""
        else:
            word += bytes([c])
    return words, out


def _spelled(model, text):
    """Nats of each token, bit by bit."""
    words, coded = _slots(model.code, text)
    own, cells, nats = [0.0] * lm_score.K, model.refined.astype(float).tolist(), []
    for at in range(0, len(coded), lm_score.BLOCK):
        slope, moved, n = [0.0] * lm_score.K, {}, 0
        for bits in coded[at : at + lm_score.BLOCK]:
            cost = 0.0
            for places, gate, bit in bits:
                st = [np.float32(model.tables[k][places[k]]) for k in range(lm_score.K)]
                # Single precision, so that what lies on the edge of two cells falls into the same one.
                x, *more = ((model.weight[k][gate] + np.float32(own[k])) * np.float32(1 / 16) * st[k] for k in range(lm_score.K))
                for part in more:
                    x += part
                p = 1 / (1 + np.exp(-float(x)))
                cell = gate * lm_score.BUCKETS + int(min(max(x * np.float32(4) + np.float32(32), 0), lm_score.BUCKETS - 1))
                q = (p + cells[cell]) / 2
                cost -= np.log(max(1e-9, 1 - abs(bit - q)))
                moved[cell] = cells[cell] + lm_score.MAP_RATE * (bit - cells[cell])
                slope = [g + s * (bit - p) for g, s in zip(slope, st, strict=True)]
                n += 1
            nats.append(cost)
        for cell, value in moved.items():
            cells[cell] = value
        own = [float(np.clip(w + lm_score.RATE / 16 / np.sqrt(n) * g, -lm_score.MOST_OWN, lm_score.MOST_OWN)) for w, g in zip(own, slope, strict=True)]
    ends = np.cumsum([len(w) + 1 for w in words] + [1])
    return [sum(nats[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _log10_probability(nats, tokens, count, n, v):
    total, gains = 0.0, []
    for t, cost in zip(tokens, nats, strict=True):
        g = min(max(1 / (1 + np.exp(-lm_score.TRUST * sum(gains[-lm_score.RECENT :]))), 0.01), 0.99)
        share = (count[t] + 1) / (n + v + 1)
        spell = np.exp(-cost) if cost < 600 else 0.0
        # A word that training lacks can only be spelled.
        total += (np.log(g * share + (1 - g) * spell) if count[t] else np.log(1 - g) - cost) / np.log(10)
        gains.append(min(max(np.log(share) + cost, -8), 8) if count[t] else -8.0)
    return total


def test_lm_score_against_brute_force(spark, docs_of):
    """Counts, mixing, maps and gates step by step, over texts of several blocks."""
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 160)))) for i in range(40)] + [(100, None), (101, " A  b\tA \n"), (None, "x y"), (102, "z" * 700)]
    docs = docs_of(rows).select("doc_id", "text")
    model = lm_score.train(docs, 12)
    learned = [(d, t or "") for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    ones = [collections.Counter() for _ in range(lm_score.K)]
    for _, t in learned:
        for bits in _slots(model.code, t)[1]:
            for places, _, bit in bits:
                for k in range(lm_score.K):
                    ones[k][places[k], bit] += 1
    for k in range(lm_score.K):
        for (p, _), _ in list(ones[k].items())[:3000]:
            assert int(model.tables[k][p]) == int(np.rint(lm_score.log_odds(np.float32(ones[k][p, 0]), np.float32(ones[k][p, 1])) * 16))
    count = collections.Counter(w for _, t in learned for w in _tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d if d is not None else -1, _log10_probability(_spelled(model, t), _tokens(t), count, n, v), len((t or "").encode())) for d, t in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score, r.bits, r.bits_per_byte) for r in lm_score.score(docs, 12).collect())
    for (a, x, size), (b, y, bits, rate) in zip(want, got, strict=True):
        assert a == b and abs(x - y) <= 1e-3 * max(1, abs(x)) and abs(bits + y / np.log10(2)) < 1e-6 and abs(rate - bits / max(1, size)) < 1e-9


def test_windows_change_nothing():
    """A text above a window costs the same whatever the window, with words and spaces over its edges."""
    rng = np.random.default_rng(3)
    code = lm_score.Code([b"the cat sat on the mat " * 40])
    tables = [rng.integers(-60, 60, 1 << lm_score.TABLE_BITS).astype(np.int8) for _ in range(lm_score.K)]
    model = lm_score.Model(code, tables, np.full((lm_score.K, lm_score.GATES), 0.4, np.float32), np.full(lm_score.GATES * lm_score.BUCKETS, 0.5, np.float32))
    for text in (b"the cat  sat\n" * 900, b"x" * 3000 + b" the " + b"y" * 3000, b" " * 2000 + b"a b " * 700 + b" " * 3000, b"word " * 256 * 4):
        low, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        whole = model.token_costs(low, off, 1 << 30)
        assert len(whole) == len(text.split()) + 1
        for window in (lm_score.BLOCK, 4 * lm_score.BLOCK):
            assert np.allclose(model.token_costs(low, off, window), whole, rtol=1e-4)


def test_lm_long_texts_go_side_by_side(monkeypatch):
    """Scoring takes the steps of the longest text, not those of each slice of it and its neighbours; costs are those of each text alone."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats"], n)) for n in rng.integers(18_000, 20_000, 14)] + ["", "a cat"]
    code = lm_score.Code([t.encode() for t in texts])
    tables = [rng.integers(-60, 60, 1 << lm_score.TABLE_BITS).astype(np.int8) for _ in range(lm_score.K)]
    model = lm_score.Model(code, tables, np.full((lm_score.K, lm_score.GATES), 0.4, np.float32), np.full(lm_score.GATES * lm_score.BUCKETS, 0.5, np.float32))
    alone = [model.token_costs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    steps = []
    monkeypatch.setattr(lm_score, "Bits", lambda *of, make=lm_score.Bits: steps.append(of) or make(*of))
    monkeypatch.setattr(lm_score.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = lm_score.pa.RecordBatch.from_arrays([lm_score.pa.array(range(len(texts))), lm_score.pa.array([True] * len(texts)), lm_score.pa.array(texts)], names=["doc_id", "train", "text"])
    got = []
    add = lm_score._Block.add
    monkeypatch.setattr(lm_score._Block, "add", lambda self, *of: got.append(of[3]) or add(self, *of))
    list(lm_score._spelled(type("Sent", (), {"value": model}), 2)(iter([batch])))
    assert len(steps) <= max(len(t) for t in texts) // lm_score.BLOCK + 2
    assert np.array_equal(np.concatenate(got), np.concatenate(alone))


def test_lm_is_fitted_on_every_training_text(docs_of):
    """Cells hold all bits of all training texts, by the other texts' counts, and long texts choose the code too."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats"], rng.integers(0, 12))) for _ in range(20)]
    code = lm_score.Code([t.encode() for t in texts])
    each = [[(places, gate, bit) for bits in _slots(code, t)[1] for places, gate, bit in bits] for t in texts]
    every = [collections.Counter((k, places[k], bit) for places, _, bit in own for k in range(lm_score.K)) for own in each]
    total = sum(every, collections.Counter())
    counts = np.zeros((lm_score.K, 2 << lm_score.TABLE_BITS), np.float32)
    for (k, p, bit), n in total.items():
        counts[k, 2 * p + bit] = n
    want = collections.Counter()
    for own, mine in zip(each, every, strict=True):
        for places, gate, bit in own:
            at = gate
            for k in reversed(range(lm_score.K)):
                n0, n1 = (np.float32(total[k, places[k], b] - mine[k, places[k], b]) for b in (0, 1))
                at = at * lm_score.LEVELS + int(np.rint(lm_score.log_odds(n0, n1) * lm_score.STEPS)) + lm_score.LEVELS // 2
            want[2 * at + bit] += 1
    tables = lm_score.Counts({})
    tables.opened = counts
    sent = type("Sent", (), {"value": (code, tables)})
    batch = lm_score.pa.RecordBatch.from_arrays([lm_score.pa.array(texts)], names=["text"])
    (out,) = lm_score._cells(sent)(iter([batch]))
    got = np.concatenate([np.frombuffer(lm_score.zlib.decompress(b), np.uint32) for b in out.column(1).to_pylist()])
    at = np.concatenate([np.arange(2 * lm_score._PART) + p * 2 * lm_score._PART for p in out.column(0).to_pylist()])
    assert {int(a): int(c) for a, c in zip(at, got, strict=True) if c} == dict(want)
    one, two = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    model = lm_score.train(docs_of([(one, "abab the cat " * 50_000), (two, "abab the cat " * 90_000)]).select("doc_id", "text"))
    assert model.code.size[ord("a")] < 4 and not np.allclose(model.weight, 0.4)


def test_lm_text_above_a_window(docs_of):
    text = "some words of a long text " * 50_000
    one, two, three = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    got = {r.doc_id: r for r in lm_score.score(docs_of([(one, text), (two, "some words"), (three, "of a")])).collect()}
    assert got[one].n_tokens == 300_001 and got[one].score > got[one].base_score and got[one].bits_per_byte < 1


def test_pipeline(spark):
    docs = spread.table(spark, SMALL, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r.doc_id for r in kept.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == ids and all(r.round_trip for r in got.values())
    bench = [r.text for r in spread.table(spark, SMALL, "benchmark").collect()]
    held = {d for d, t in text.items() if any(b in t for b in bench)}
    assert not held & ids
    classes = near_dedup.near_dedup(kept).collect()
    assert all(r.kept for r in classes)
    bad = {r.doc_id for r in spread.table(spark, SMALL, "labels").collect() if r.quality == 0}
    assert len(bad & ids) <= 0.1 * len(bad)


def test_pipeline_against_brute_force(spark, small):
    """Each stage again without hashing, samples or filters: scores word by word, all lines, all pairs, all alignments."""
    docs = small("documents")
    model = quality.fit(docs, small("labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if _quality(model, r.text) >= 0.5]
    lines = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                lines[key(line)].add(d)
    top = {k: max(v) for k, v in lines.items() if len(v) >= 5}
    rows = [(d, "\n".join(x for x in (t or "").split("\n") if top.get(key(x), d) == d)) for d, t in rows]
    classes = all_pair_classes(rows)
    sets = {d: len(_tokens(t)) > 1 for d, t in rows}
    kept = {min(c) if len(c) > 1 else next(iter(c)) for c in classes}
    assert all(sets[d] for c in classes if len(c) > 1 for d in c)
    # Which member stays is the operator's choice: one of each class.
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    items = [decontaminate.item_characters(r.text)[0] for r in small("benchmark").collect()]
    text = dict(rows)

    threes = lambda x: {tuple(x[k : k + 3]) for k in range(len(x) - 2)}
    items = [(i, threes(i.tolist())) for i in items if len(i)]

    def held(d):
        whole = decontaminate.item_characters(text[d])[0]
        own = threes(whole.tolist())
        # An edit spoils three runs of three characters at most; what could still hold the item is aligned whole.
        return any(len(t & own) >= len(t) - 3 * (len(i) // 10) and decontaminate.align(i, whole, len(i) // 10) for i, t in items)

    with open(queries.PIECES, "rb") as f:
        vocab = pieces.Vocabulary(f.read())
    for c in classes:
        stays = [d for d in c if d in got]
        clean = {d: not held(d) for d in c}
        assert len(stays) <= 1 and all(clean[d] for d in stays) and (stays or not all(clean.values())), c
    assert len(got) > 0.5 * len(kept)
    for d, r in got.items():
        ids = vocab.sp.encode(text[d])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.round_trip


def test_pipeline_odd_rows(spark, small, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing columns, an empty table, through every stage."""
    extra = "_one long, _gone long, node long, key long, _maps long, label long, row long"
    long = "a text of many words " * 30_000
    rows = [(None, "Plain words without an id."), (None, None), (1, None), (2, ""), (3, "Some plain words here."), (3, "Some plain words here."), (4, long), (5, " \n")]
    odd = spark.createDataFrame([(d, t, "en", "s", None, *range(7)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            got = out.collect()
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns, name
            assert len(got) <= (docs is odd) * len(rows)
    near = corpus_pipeline.one_of_each(spark, odd, SMALL).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "2", "3", "4", "5", "None", "None"]


def test_every_query_runs(spark):
    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    # The smallest documents hold no secret.
    assert queries.queries()[name](spark, MIDDLE if name.startswith("op6") else SMALL).count() > 0


def test_own_counts_are_taken_out_and_put_back():
    import numpy as np

    from oxyframe.llm import lm_score

    rng = np.random.default_rng(1)
    places = [rng.integers(0, 50, 400) for _ in range(lm_score.K)]
    slots = [2 * p + rng.integers(0, 2, 400) for p in places]
    tables = np.stack([np.bincount(s, minlength=100) + rng.integers(0, 9, 100) for s in slots])
    others, out = lm_score._Others(tables), [np.empty(400, np.uint64) for _ in slots]
    others.without(places, slots, out)
    for t, c, p, s, x in zip(tables, others.counts, places, slots, out, strict=True):
        left = t - np.bincount(s, minlength=100)
        assert np.array_equal(c, t) and np.array_equal(x.view(np.uint32).reshape(-1, 2), left.reshape(-1, 2)[p])


def test_bytes_alike_are_counted_over_many_slices(monkeypatch):
    texts = [b"the same few words, again and again"] * 4000
    code = lm_score.Code(texts[:1])
    batch = lm_score.pa.RecordBatch.from_arrays([lm_score.pa.array([x.decode() for x in texts])], names=["text"])
    counted = []

    class Seen(lm_score.Bits):
        def __init__(self, s, pos, way=None):
            super().__init__(s, pos, way)
            counted.append(len(self.first))

    monkeypatch.setattr(lm_score, "Bits", Seen)

    def parts(slice_bytes):
        monkeypatch.setattr(lm_score, "SLICE", slice_bytes)
        counted.clear()
        out = lm_score._tables(type("Sent", (), {"value": code}))(iter([batch]))
        return [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in out], sum(counted)

    whole, once = parts(1 << 20)
    small, n = parts(1 << 12)
    assert small == whole and n == once <= lm_score.K * (len(texts[0]) + 2)
    monkeypatch.setattr(lm_score, "MERGED", 1, raising=False)
    apart, more = parts(1 << 12)
    assert apart == whole and more > once


def test_levels_stand_while_as_many_go():
    """What ``_steady`` says can go leaves the level, whichever outcome goes, and no fewer are said than need be."""
    rng = np.random.default_rng(4)
    counts = np.concatenate([rng.integers(0, top, (4000, 2)) for top in (2, 6, 40, 3000)] + [[[0, 2**32 - 256], [2**31, 2**31]]]).astype(np.uint32)

    def level(n0, n1):
        return lm_score._level(np.stack([n0, n1], axis=1).astype(np.uint32).ravel().view(np.uint64)) + lm_score.LEVELS // 2

    got = lm_score._steady(counts.ravel())
    assert np.array_equal(got % lm_score.LEVELS, level(counts[:, 0], counts[:, 1]))
    firm = lm_score._FIRM[got // lm_score.LEVELS]
    n0, n1 = counts.T.astype(np.int64)
    for part in (0, 0.3, 1):
        for gone0, gone1 in ((firm, part * firm), (part * firm, firm)):
            assert np.array_equal(level(np.maximum(n0 - gone0, 0), np.maximum(n1 - gone1, 0)), got % lm_score.LEVELS)
    assert (firm[-1:] > 0).all() and (firm > 0).mean() > 0.5


def test_own_counts_are_taken_out_only_where_they_matter(monkeypatch):
    """Over large counts few bits have their own text's taken out; all are counted as if each had."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 700, 90, 2000)] + ["ÿ𝄞" * 300]
    code = lm_score.Code([t.encode() for t in texts])
    assert max(code.again) > 0
    tables = lm_score.Counts({})
    batch = lm_score.pa.RecordBatch.from_arrays([lm_score.pa.array(texts)], names=["text"])
    own = np.zeros((lm_score.K, 2 << lm_score.TABLE_BITS), np.float32)
    for t in texts:
        for bits in _slots(code, t)[1]:
            for places, _, bit in bits:
                for k in range(lm_score.K):
                    own[k, 2 * places[k] + bit] += 1
    # What other texts have: nothing, or much.
    for tables.opened, most in ((own, 1.0), (own + rng.integers(0, 20_000, own.shape).astype(np.float32), 0.2)):
        tables.firm, touched = None, []

        def without(self, places, slots, out, real=lm_score._Others.without, touched=touched):
            touched.append(sum(map(len, slots)))
            real(self, places, slots, out)

        monkeypatch.setattr(lm_score._Others, "without", without)
        (out,) = lm_score._cells(type("Sent", (), {"value": (code, tables)}))(iter([batch]))
        monkeypatch.undo()
        got = np.zeros(2 * lm_score.GATES * lm_score.LEVELS**lm_score.K + 2 * lm_score._PART, np.int64)
        for p, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[p * 2 * lm_score._PART :][: 2 * lm_score._PART] = np.frombuffer(lm_score.zlib.decompress(b), np.uint32)
        want, n_bits = np.zeros_like(got), 0
        others = lm_score._Others(tables.opened)
        for t in texts:
            low = lm_score.LOW[np.frombuffer(t.encode(), np.uint8)]
            s = lm_score.Stream(low, np.array([0, len(low)]), np.ones(1, np.int64), code)
            bits = lm_score.Bits(s, np.flatnonzero(s.coded()))
            places = [bits.slots(c[bits.pos]) for c in s.context]
            slots = [2 * x + bits.bit for x in places]
            others.less(slots)
            np.add.at(want, 2 * (bits.gates() * lm_score.LEVELS**lm_score.K + lm_score._levels(others.seen(places))) + bits.bit, 1)
            others.more(slots)
            n_bits += len(bits.of)
        assert np.array_equal(got, want)
        assert sum(touched) <= most * lm_score.K * n_bits


def test_bytes_lowered_and_words_indexed():
    every = np.arange(256, dtype=np.uint8)
    assert np.array_equal(lm_score.lowered(every), lm_score.LOW[every])
    assert np.array_equal(lm_score._solid(every), lm_score.B.NOT_SPACE[every] > 0)
    x = np.random.default_rng(2).integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for got, want in zip(lm_score._distinct(x), np.unique(x, return_inverse=True), strict=True):
        assert np.array_equal(got, want)
