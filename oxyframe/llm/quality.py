"""Quality classifier: linear SVM on n-gram indicators scaled by naive-Bayes ratios.

Features are hashed indicators of a text's words, pairs of words and runs of one to
three word shapes (capitals, digits, symbols, same as the word before). Each is
scaled by the log ratio of the shares of the two classes' documents that hold it (an
indicator has no counts to normalise by); a linear hinge-loss model is then
fitted by dual coordinate descent. Features of the sampled rows are taken on the
executors; the model is one vector of 2**FEATURE_BITS weights, whatever the corpus.

Fitting takes at most ``sample`` labelled rows, those of the smallest hash of
``doc_id``, each as 32 KB of features at most. Scores read the whole text and nothing else.

Edge cases: null counts as empty, which has no features and scores by the bias alone.
Labels other than 0 and 1 and null ids are left out of the sample. With no labelled
row of one class every score is 0.5. Other columns pass through; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B

FEATURE_BITS = 18
SAMPLE = 4000
COST = 0.1
ROUNDS = 12

_CLASS = np.zeros((3, 256), np.uint8)
_CLASS[0, 65:91] = 1  # capitals
_CLASS[1, 97:123] = 1  # small letters, and any byte of a letter beyond ASCII
_CLASS[1, 128:] = 1
_CLASS[2, 48:58] = 1  # digits


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An array (kinds, words) of hashed features and where each text's words begin."""
    s, e = B.spans(data, off)
    at = np.searchsorted(s, off)
    low = B.LOWER[data]
    word = B.span_hash(low, s, e)
    n = len(word)
    size = e - s
    count = []
    for row in _CLASS:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(row[data], out=c[1:], dtype=np.int32)
        count.append(c[e] - c[s])
    upper, lower, digit = count
    symbol = size - upper - lower - digit
    head = _CLASS[0, data[s]] if n else np.zeros(0, np.uint8)
    case = np.select([upper == 0, (lower == 0) & (upper > 1), (upper == 1) & (head == 1)], [0, 3, 1], 2)
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    before = np.roll(word, 1)
    same = (word == before) & ~first
    shape = (case + 4 * np.minimum(symbol, 3) + 16 * (digit > 0) + 32 * (upper + lower == 0) + 64 * same + 1).astype(np.uint64)
    one, two = np.roll(shape, 1), np.roll(shape, 2)
    one[first] = 0
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    two[first | second] = 0
    before[first] = 0
    kinds = (word, word * B.U(3) + before * B.U(0x2545F4914F6CDD1D), shape + B.U(1 << 40), shape + (one << B.U(10)) + B.U(2 << 40), shape + (one << B.U(10)) + (two << B.U(20)) + B.U(3 << 40))
    return np.stack([(B.mix(k.copy()) >> B.U(64 - FEATURE_BITS)).astype(np.int32) for k in kinds]), at


_MAP = (1 << FEATURE_BITS) // 8


def packed(found: np.ndarray) -> bytes:
    """A set of features as a list, or as a bitmap where that is shorter: 32 KB at most, however long the text."""
    if 4 * len(found) <= _MAP:
        return b"l" + found.tobytes()
    bits = np.zeros(1 << FEATURE_BITS, bool)
    bits[found] = True
    return b"m" + np.packbits(bits).tobytes()


def unpacked(body: bytes) -> np.ndarray:
    if body[:1] == b"l":
        return np.frombuffer(body, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8, offset=1))).astype(np.int32)


def _sampled(batches):
    for batch, data, off in B.rows_of(batches):
        f, at = features(data, off)
        sets = [packed(np.unique(f[:, at[i] : at[i + 1]]).astype(np.int32)) for i in range(len(off) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "features"])


def fit_arrays(sets: list[bytes], labels: list[int], cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, from packed sets, of which one at a time is unpacked."""
    weight = np.zeros(1 << FEATURE_BITS)
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if len(set(labels)) < 2:
        return weight.astype(np.float32), 0.0
    total = {}
    for sign in (1.0, -1.0):
        c = np.zeros(1 << FEATURE_BITS)
        for x, label in zip(sets, y, strict=True):
            if label == sign:
                c[unpacked(x)] += 1
        total[sign] = c
    seen = total[1.0] + total[-1.0] > 0
    p, q = 1 + total[1.0], 1 + total[-1.0]
    # Of each class the share of its documents that hold the feature.
    ratio = np.where(seen, np.log((p / (2 + (y > 0).sum())) / (q / (2 + (y < 0).sum()))), 0.0)


    def scaled(body: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = unpacked(body)
        return x, ratio[x] / np.sqrt(max(1, len(x)))

    norm = np.array([v @ v + 1.0 for _, v in map(scaled, sets)])
    # Both classes carry the same cost in all.
    limit = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    alpha, bias = np.zeros(len(y)), 0.0
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = scaled(sets[i])
            slope = y[i] * (weight[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return (weight * ratio).astype(np.float32), float(bias)


def training_rows(col=None):
    """Rows that labels are learned from: crc32 of doc_id as text, modulo 3, is not 1."""
    doc = F.col("doc_id") if col is None else col
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from at most ``sample`` labelled rows that are not held out."""
    picked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & training_rows())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text").mapInArrow(_sampled, "label int, features binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))
    return fit_arrays([bytes(r["features"]) for r in rows], [r["label"] for r in rows])


def _scores(model, names: list[str], text_at: int, keep_from: float | None):
    def run(batches):
        weight, bias = model.value
        seen = np.zeros(1 << FEATURE_BITS, bool)
        for batch, data, off in B.rows_of(batches, col=names[text_at]):
            f, at = features(data, off)
            margin = np.empty(len(off) - 1)
            for i in range(len(margin)):
                seen[f[:, at[i] : at[i + 1]]] = True
                own = np.flatnonzero(seen)
                seen[own] = False
                margin[i] = weight[own].sum() / np.sqrt(max(1, len(own))) + bias
            score = 1 / (1 + np.exp(-np.clip(2 * margin, -60, 60)))
            if keep_from is not None:
                yield batch.filter(pa.array(score >= keep_from))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "_score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The documents with ``_score``, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])
    return docs.mapInArrow(_scores(sent, docs.columns, docs.columns.index("text"), None), schema)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], keep_from: float = 0.5) -> DataFrame:
    """The documents that score ``keep_from`` at least."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scores(sent, docs.columns, docs.columns.index("text"), keep_from), docs.schema)


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    done = score(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return done.select("doc_id", (~training_rows()).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
