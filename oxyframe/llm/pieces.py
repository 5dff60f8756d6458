"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The vocabulary is a public byte-pair one. A sequence of pieces is its encoding of a
text exactly if every two neighbours are what the merges make of the two joined
("compatible"); over all segmentations of a text there is one such sequence. In
max-plus terms a forbidden neighbour weighs minus infinity, a piece its score, and
the best path is the only finite one.

A giant text is cut into chunks anywhere. The state at a cut is (last piece begun
before it, how many characters it reaches past it). Each chunk, with a few characters
of its neighbours, gives a transfer matrix from the states at its left cut to those
at its right one, whose entries are the scores of the chunk's best paths. Matrices are
combined by the associative max-plus product as a tree: those of SEGMENT chunks in one
task, the segments of a document in another. From the root down each node of the tree
gives its halves the state between them, and at last each chunk is backtraced by itself.
No piece of the vocabulary goes on over a space, so between two spaces that begin a
word a chunk's matrix is one number, the sum of its words' best scores; the words' paths
are kept. Texts that are not giant are a single chunk and are encoded by the library.

Edge cases: null counts as empty, which has no pieces. A literal U+2581 decodes as a
space, as the format defines. Null and repeated ids give a row each. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import spread

GIANT = 1 << 16
CHUNK = 1 << 14
SEGMENT = 64  # chunks whose matrices one task combines
_KEPT = 256  # characters of a word whose path is kept
SPACE = "▁"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
START = ("", 0)  # nothing before, or a place that every path passes
_SCHEMA = "doc_id long, n_chars int, n_tokens int, ids array<int>, ids_sha256 string, round_trip boolean"


class Vocabulary:
    """A byte-pair SentencePiece model and what its merges allow."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        sp = self.sp
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece goes on over a space; such a vocabulary has no certain cuts")
        self.longest = max(map(len, self.score))
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.whole = lru_cache(1 << 18)(lambda p: self.merge(p) == [p])
        self._word = lru_cache(1 << 17)(self._path)

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand after ``left``; pieces of unknown characters never merge."""
        if left == "" or left not in self.score or right not in self.score:
            return True
        return self.compatible(left, right)

    def _path(self, text: str) -> tuple[tuple[int, ...], float]:
        reached = walk(self, text, 0, "", len(text))
        return tuple(i for p in trace(reached, len(text)) for i in self.ids_of(p)), reached[len(text)][2]

    def words(self, text: str) -> Iterator[tuple[tuple[int, ...], float]]:
        """Pieces and score of the best path of each word, a word being spaces and what follows them."""
        return (self._word(w) if len(w) <= _KEPT else self._path(w) for w in _WORDS.findall(text))

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.score:
            return [self.sp.piece_to_id(piece)]
        return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def at(self, text: str, i: int) -> list[str]:
        """Pieces that may begin at i; an unknown character is one by itself."""
        out = [p for n in range(1, min(self.longest, len(text) - i) + 1) if (p := text[i : i + n]) in self.score and self.whole(p)]
        return out if text[i] in self.score or not text[i : i + 1] else [*out, text[i]]


def certain(text: str, lo: int, hi: int, back: bool = False) -> int:
    """The first (last) place in lo..hi where a space follows something else, or -1."""
    places = range(hi, lo - 1, -1) if back else range(lo, hi + 1)
    return next((i for i in places if 0 < i < len(text) and text[i] == SPACE and text[i - 1] != SPACE), -1)


def walk(v: Vocabulary, text: str, begin: int, last: str, stop: int) -> dict[int, tuple[str, int, float]]:
    """From ``begin`` after piece ``last``: for each place reached, the piece that ends there, its start, the score.

    Pieces begin before ``stop`` and may reach past it. Each place is reached in one way at most.
    """
    reached: dict[int, tuple[str, int, float]] = {begin: (last, -1, 0.0)}
    for i in range(begin, stop):
        if i in reached:
            before, _, total = reached[i]
            for p in v.at(text, i):
                if v.follows(before, p):
                    reached[i + len(p)] = (p, i, total + v.score.get(p, 0.0))
    return reached


def trace(reached: dict[int, tuple[str, int, float]], end: int) -> list[str]:
    out = []
    while reached[end][1] >= 0:
        out.append(reached[end][0])
        end = reached[end][1]
    return out[::-1]


class Chunk:
    """text[left:right] of a normalised document within ``text``, which holds its neighbours' characters too."""

    def __init__(self, v: Vocabulary, text: str, left: int, right: int, is_first: bool, is_last: bool):
        self.v, self.text, self.left, self.right, self.is_first, self.is_last = v, text, left, right, is_first, is_last
        self.head = certain(text, left, right)
        self.tail = certain(text, left, right, back=True)

    def entries(self) -> list[tuple[str, int]]:
        if self.is_first or self.head == self.left:
            return [START]
        out = []
        for start in range(max(0, self.left - self.v.longest), self.left):
            out += [(p, start + len(p) - self.left) for p in self.v.at(self.text, start) if start + len(p) >= self.left]
        return out

    def _exits(self, reached) -> dict[tuple[str, int], float]:
        """States at the right cut: paths that begin a piece before it and end it at or after it."""
        if self.is_last:
            return {START: reached[self.right][2]} if self.right in reached else {}
        return {(p, end - self.right): total for end, (p, start, total) in reached.items() if end >= self.right and start >= 0}

    def _from_left(self, state: tuple[str, int], stop: int):
        return walk(self.v, self.text, self.left + state[1], state[0], stop)

    def transfer(self) -> dict[tuple[str, int], dict[tuple[str, int], float]]:
        """Max-plus matrix, absent entries being minus infinity."""
        out = {}
        if self.head < 0:
            for s in self.entries():
                if self.left + s[1] >= self.right and not self.is_last:
                    # A piece that spans the whole chunk leads on to the state it is.
                    out[s] = {(s[0], self.left + s[1] - self.right): 0.0}
                else:
                    out[s] = self._exits(self._from_left(s, self.right))
            return out
        middle = sum(score for _, score in self.v.words(self.text[self.head : self.tail]))
        last = {START: 0.0} if self.tail == self.right else self._exits(walk(self.v, self.text, self.tail, "", self.right))
        ends = {e: middle + w for e, w in last.items()}
        for s in self.entries():
            if s == START and self.head == self.left:
                out[s] = dict(ends)
            elif self.left + s[1] <= self.head:
                reached = self._from_left(s, self.head)
                if self.head in reached:
                    out[s] = {e: reached[self.head][2] + w for e, w in ends.items()}
        return out

    def ids(self, entry: tuple[str, int], leave: tuple[str, int]) -> list[int]:
        """The pieces that begin in this chunk on the path from ``entry`` to ``leave``."""
        v = self.v
        if self.head < 0:
            if self.left + entry[1] >= self.right and not self.is_last:
                return []
            return [i for p in trace(self._from_left(entry, self.right), self.right + leave[1]) for i in v.ids_of(p)]
        out = []
        if not (entry == START and self.head == self.left):
            out += [i for p in trace(self._from_left(entry, self.head), self.head) for i in v.ids_of(p)]
        for word, _ in v.words(self.text[self.head : self.tail]):
            out += word
        if self.tail < self.right:
            out += [i for p in trace(walk(v, self.text, self.tail, "", self.right), self.right + leave[1]) for i in v.ids_of(p)]
        return out


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    out: dict = {}
    for s, row in a.items():
        best: dict = {}
        for mid, w in row.items():
            for e, x in b.get(mid, {}).items():
                if e not in best or w + x > best[e]:
                    best[e] = w + x
        if best:
            out[s] = best
    return out


def tree(matrices: list[dict]) -> list[list[dict]]:
    """Levels of products of neighbours, from the matrices up to their product."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([product(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    return levels


def resolve(matrices: list[dict], entry: tuple[str, int] = START, leave: tuple[str, int] = START) -> list[tuple[tuple[str, int], tuple[str, int]]]:
    """The states at both cuts of every chunk on the best path from ``entry`` to ``leave``."""
    levels = tree(matrices)
    states = [(entry, leave)]
    for below in reversed(levels[:-1]):
        out = []
        for i, (a, b) in enumerate(states):
            if 2 * i + 1 < len(below):
                left, right = below[2 * i], below[2 * i + 1]
                between = max((s for s in left[a] if b in right.get(s, {})), key=lambda s: left[a][s] + right[s][b])
                out += [(a, between), (between, b)]
            else:
                out.append((a, b))
        states = out
    return states


def split(text: str, longest: int, chunk: int = CHUNK) -> list[tuple[int, str, int, int, bool, bool]]:
    """Chunks of a normalised text: number, characters with their neighbours, left, right, first, last."""
    out = []
    for n, a in enumerate(range(0, max(1, len(text)), chunk)):
        b = min(len(text), a + chunk)
        lo = max(0, a - longest)
        out.append((n, text[lo : min(len(text), b + longest)], a - lo, b - lo, a == 0, b == len(text)))
    return out


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


_models: dict[int, Vocabulary] = {}


def _loaded(sent) -> Vocabulary:
    """One model a worker process."""
    proto = sent.value
    key = hash(proto)
    if key not in _models:
        _models[key] = Vocabulary(proto)
    return _models[key]


def _row(v: Vocabulary, doc, text: str, ids: list[int]) -> tuple:
    body = np.array(ids, "<i4")
    return doc, len(text), len(ids), body, hashlib.sha256(body.tobytes()).hexdigest(), v.sp.decode(ids) == text.replace(SPACE, " ")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    docs, n_chars, n_tokens, ids, sha, ok = zip(*rows, strict=True) if rows else ([],) * 6
    off = np.concatenate(([0], np.cumsum(n_tokens))).astype(np.int32)
    flat = pa.array(np.concatenate(ids) if rows else np.zeros(0, np.int32), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(n_chars, pa.int32()), pa.array(n_tokens, pa.int32()), pa.ListArray.from_arrays(pa.array(off), flat), pa.array(sha, pa.string()), pa.array(ok, pa.bool_())],
        names=["doc_id", "n_chars", "n_tokens", "ids", "ids_sha256", "round_trip"],
    )


def _plain(sent):
    def run(batches):
        v = _loaded(sent)
        for batch in batches:
            lengths = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))))
            for i, j in B.slices(lengths):
                texts = [t or "" for t in batch.column(1)[i:j].to_pylist()]
                yield _batch([_row(v, d, t, ids) for d, t, ids in zip(batch.column(0)[i:j].to_pylist(), texts, v.sp.encode(texts, num_threads=1), strict=True)])
        B.release()

    return run


def _chunks(sent, chunk: int):
    def run(batches):
        longest = _loaded(sent).longest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, body, left, right, first, last in split(normalise(text), longest, chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n], pa.int32()), pa.array([body]), pa.array([left], pa.int32()), pa.array([right], pa.int32()), pa.array([first]), pa.array([last])], names=["key", "n", "body", "left", "right", "first", "last"])

    return run


def _transfers(sent):
    def run(batches):
        v = _loaded(sent)
        for batch in batches:
            out = [pickle.dumps(Chunk(v, *r).transfer()) for r in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "n", "matrix"])

    return run


def _in_order(parts: list[dict]) -> list[dict]:
    return [pickle.loads(m["matrix"]) for m in sorted(parts, key=lambda m: m["n"])]


def _combined(batches):
    """The product of each segment's matrices."""
    for batch in batches:
        out = [pickle.dumps(tree(_in_order(ms))[-1][0]) for ms in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "n", "matrix"])


def _states(batches):
    """Of key, segment's matrices and the segment's own states (null: a whole document) the states of each."""
    for batch in batches:
        keys, ns, states = [], [], []
        for key, ms, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = pickle.loads(own) if own else (START, START)
            for n, s in zip(sorted(m["n"] for m in ms), resolve(_in_order(ms), *ends), strict=True):
                keys.append(key)
                ns.append(n)
                states.append(pickle.dumps(s))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), pa.array(states, pa.binary())], names=["key", "n", "state"])


def _traced(sent):
    def run(batches):
        v = _loaded(sent)
        for batch in batches:
            out = [Chunk(v, *r[:-1]).ids(*pickle.loads(r[-1])) for r in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["key", "n", "part"])

    return run


def _joined(sent):
    def run(batches):
        v = _loaded(sent)
        for batch in batches:
            for doc, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([_row(v, doc, text, [i for p in sorted(parts, key=lambda p: p["n"]) for i in p["part"]])])

    return run


def encode(docs: DataFrame, model_path: str, giant: int = GIANT, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, ids_sha256 (of little-endian int32) and round_trip (decoding gives the text back).

    The model is read on the driver and sent to the executors.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = src.where(F.length("text") <= giant).mapInArrow(_plain(sent), _SCHEMA)
    large = src.where(F.length("text") > giant).withColumn("key", F.unhex(F.sha2("text", 256)))
    one_each = large.select("key", "text").dropDuplicates(["key"])
    parts = one_each.mapInArrow(_chunks(sent, chunk), "key binary, n int, body string, left int, right int, first boolean, last boolean").repartition("key", "n")
    matrices = parts.mapInArrow(_transfers(sent), "key binary, n int, matrix binary")
    matrices = spread.cut(matrices)
    segments = matrices.groupBy("key", F.expr(f"int(n div {segment})").alias("segment")).agg(F.collect_list(F.struct("n", "matrix")).alias("ms"))
    products = segments.mapInArrow(_combined, "key binary, n int, matrix binary")
    tops = products.groupBy("key").agg(F.collect_list(F.struct("n", "matrix")).alias("ms")).withColumn("own", F.lit(None).cast("binary")).mapInArrow(_states, "key binary, n int, state binary")
    within = segments.join(tops.select("key", F.col("n").alias("segment"), F.col("state").alias("own")), ["key", "segment"])
    states = within.select("key", "ms", "own").mapInArrow(_states, "key binary, n int, state binary")
    traced = parts.join(states, ["key", "n"]).mapInArrow(_traced(sent), "key binary, n int, part array<int>")
    whole = traced.groupBy("key").agg(F.collect_list(F.struct("n", "part")).alias("parts"))
    scanned = large.join(whole, "key").select("doc_id", "text", "parts").mapInArrow(_joined(sent), _SCHEMA)
    return plain.unionByName(scanned)


def decode(ids: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of each row's ``ids``; null counts as no pieces."""
    with open(model_path, "rb") as f:
        sent = ids.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        v = _loaded(sent)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.sp.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256, round_trip of each document."""
    return encode(docs, model_path).select("doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip")
