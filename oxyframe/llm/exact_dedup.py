"""Exact deduplication by content-defined chunk recipes.

Each text is lower-cased (A-Z only) and cut where a rolling hash of its last bytes
says so. Chunks get 64-bit identifiers, which are verified once: the bodies that
share an identifier meet in one pre-aggregated shuffle, each body once a partition,
and must be the same bytes. Where they are not, the identifier gets a version for
each body. Recipes are written once to the shared folder and read from there. Documents are then compared by their ordered identifier lists alone; a
long text is never shuffled as a whole and a chunk moves at most once a partition.

Edge cases: null counts as the empty text, so null and empty texts are equal. The
empty text has no chunks and an empty recipe. A null ``doc_id`` is a row like any
other, smaller than every number. Of rows that repeat both ``doc_id`` and text one is
kept. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import spread

WINDOW = 32
CUT_BITS = 11
MIN_CHUNK = 256
MAX_CHUNK = 1 << 16


def cuts(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks (offsets into ``data``).

    A cut depends on the last WINDOW bytes only, so equal passages are cut alike
    wherever they stand. Chunks have MIN_CHUNK to MAX_CHUNK bytes but for the last.
    """
    h = B.prefix_hash(data)
    _, inv = B.powers(len(data) + 1)
    n = len(data)
    if n > WINDOW:
        roll = (h[WINDOW:] - h[:-WINDOW]) * inv[: n - WINDOW + 1]
        at = np.flatnonzero((roll * B.U(0x9E6C63D0676A9A99)) >> B.U(64 - CUT_BITS) == 0) + WINDOW
    else:
        at = np.zeros(0, np.int64)
    lo, hi = np.searchsorted(at, off[:-1] + MIN_CHUNK), np.searchsorted(at, off[1:])
    out = []
    for i in range(len(off) - 1):
        start, end, ends = int(off[i]), int(off[i + 1]), []
        for c in at[lo[i] : max(lo[i], hi[i])].tolist():
            while c - start > MAX_CHUNK:
                start += MAX_CHUNK
                ends.append(start)
            if c - start >= MIN_CHUNK and c < end:
                ends.append(c)
                start = c
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if end > start:
            ends.append(end)
        out.append(ends)
    return out


def _ident(body: bytes, bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True) >> (64 - bits)


def _recipes(bits: int):
    def run(batches):
        for batch, data, off in B.rows_of(batches):
            low = B.LOWER[data]
            raw = low.tobytes()
            ids, shas = [], []
            for i, ends in enumerate(cuts(low, off)):
                start, own = int(off[i]), []
                shas.append(hashlib.sha256(raw[start : int(off[i + 1])]).hexdigest())
                for e in ends:
                    own.append(_ident(raw[start:e], bits))
                    start = e
                ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(shas, pa.string()), pa.array(ids, pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "text_sha256", "ids"],
            )

    return run


def _chunks(bits: int):
    """Each distinct chunk once a slice: identifier and body."""

    def run(batches):
        for _, data, off in B.rows_of(batches):
            low = B.LOWER[data]
            raw = low.tobytes()
            found = set()
            for i, ends in enumerate(cuts(low, off)):
                start = int(off[i])
                for e in ends:
                    found.add(raw[start:e])
                    start = e
            bodies = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([_ident(b, bits) for b in bodies], pa.int64()), pa.array(bodies, pa.binary())], names=["id", "body"])

    return run


def _placed(bits: int):
    """Every chunk with its document's row key and its place."""

    def run(batches):
        for batch, data, off in B.rows_of(batches):
            low = B.LOWER[data]
            raw = low.tobytes()
            sha, pos, ids, bodies = [], [], [], []
            for i, ends in enumerate(cuts(low, off)):
                start = int(off[i])
                digest = hashlib.sha256(raw[start : int(off[i + 1])]).hexdigest()
                for k, e in enumerate(ends):
                    sha.append(digest)
                    pos.append(k)
                    ids.append(_ident(raw[start:e], bits))
                    bodies.append(raw[start:e])
                    start = e
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(pos, pa.int32()), pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], names=["text_sha256", "pos", "id", "body"])

    return run


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, text_sha256, ids and versions: the verified recipe of each document.

    ``versions`` is null unless an identifier of the recipe stands for several bodies.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = src.mapInArrow(_recipes(id_bits), "doc_id long, n_bytes long, text_sha256 string, ids array<long>")
    bodies = src.select("text").mapInArrow(_chunks(id_bits), "id long, body binary")
    clashes = bodies.groupBy("id").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("id")
    if clashes.isEmpty():
        return plain.withColumn("versions", F.lit(None).cast("array<int>"))
    # Only identifiers that stand for several bodies come this far: one in 2**32 chunks, or few bits in tests.
    distinct = bodies.join(clashes, "id", "left_semi").distinct()
    first = distinct.alias("a").join(distinct.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.body") >= F.col("b.body")))
    version = first.groupBy(F.col("a.id").alias("id"), F.col("a.body").alias("body")).agg(F.count("*").cast("int").alias("v"))
    placed = src.select("text").mapInArrow(_placed(id_bits), "text_sha256 string, pos int, id long, body binary").distinct()
    per_text = placed.join(version, ["id", "body"]).groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("pv"))
    versions = per_text.select("text_sha256", F.expr("transform(pv, x -> x.v)").alias("versions"))
    return plain.join(versions, "text_sha256", "left").select("doc_id", "n_bytes", "text_sha256", "ids", "versions")


def exact_dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of documents with equal recipes the largest doc_id stays. The groups are summed
    before the shuffle; the join back is one that Spark splits where a group is hot.
    """
    r = recipes(docs, id_bits).withColumn("recipe", F.struct(F.xxhash64("ids").alias("h"), "n_bytes", "ids", F.coalesce("versions", F.array().cast("array<int>")).alias("versions")))
    # Written before they are read twice, so the numbers that tell equal rows apart stay the same.
    r = spread.cut(r.select("doc_id", "text_sha256", "recipe", F.monotonically_increasing_id().alias("row")))
    groups = r.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")).select(F.col("recipe").alias("g"), "top", "group_size")
    # With the hash as a key beside the recipe the groups are dealt anew, and Spark may split a hot one.
    joined = r.join(groups, (F.col("recipe") == F.col("g")) & (F.col("recipe.h") == F.col("g.h")))
    return joined.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256", F.size("recipe.ids").alias("n_chunks"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
