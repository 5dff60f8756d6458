"""Line deduplication by range-partitioned hashes and keep bitmaps.

Every line whose key is long enough becomes a row (key hash, document, positions).
Rows are range-partitioned by (hash, document descending), so a line that a third of
all documents hold spreads over as many partitions as its rows need, and sorted
within a partition. One streaming pass then sees the largest document of a key
first and holds back rows only until enough documents were seen. A key that may
cross a partition's edge is settled afterwards: each partition reports at most two
such keys, whose totals are broadcast (two rows a partition bound them). What comes
back is a compressed keep bitmap for each document that loses lines, not text.

Edge cases: null counts as the empty text, which is one empty line. Rows with a null
``doc_id`` stay as they are and do not count as holders. Rows that repeat a
``doc_id`` count as one document; each loses its own lines. A text that loses every
line becomes empty. Other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spread

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
_FOUND = "h long, h2 long, doc_id long, row_key long, pos array<int>"
_DECIDED = "kind int, h long, h2 long, doc_id long, row_key long, pos array<int>, n long"


def row_key(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _lines(min_chars: int):
    def run(batches):
        for batch in batches:
            h, h2, doc, key, pos = [], [], [], [], []
            for d, body in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()), strict=True):
                body = body.as_py()
                if d is None or not body:
                    continue
                own: dict[bytes, list[int]] = {}
                for k, line in enumerate(body.split(b"\n")):
                    if len(line) >= min_chars and len(line := line.strip(SPACE).lower()) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                        own.setdefault(hashlib.blake2b(line, digest_size=16).digest(), []).append(k)
                rk = row_key(body) if own else 0
                for digest, at in own.items():
                    h.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    doc.append(d)
                    key.append(rk)
                    pos.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, h2, doc, key)] + [pa.array(pos, pa.list_(pa.int32()))], names=["h", "h2", "doc_id", "row_key", "pos"])

    return run


def _stream(min_docs: int):
    """Kinds of rows: 0 lines to drop, 1 lines of a key that may cross an edge, 2 the totals of such a key."""

    def run(batches):
        out: list[tuple] = []
        first, group, held, n_docs, top, last = True, None, [], 0, None, None

        def close(ends_partition: bool):
            """A key's rows have ended; held ones are fewer than enough documents' or the first key's."""
            if group is None:
                return
            if first or ends_partition:
                out.append((2, *group, top, 0, [], n_docs))
                out.extend((1, *group, d, k, p, 0) for d, k, p in held)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for h, h2, d, k, p in zip(*cols, strict=True):
                if (h, h2) != group:
                    close(False)
                    first = group is None
                    group, held, n_docs, top, last = (h, h2), [], 0, d, None
                if d != last:
                    n_docs, last = n_docs + 1, d
                if first:
                    out.append((1, h, h2, d, k, p, 0))
                elif n_docs < min_docs:
                    held.append((d, k, p))
                else:
                    out.extend((0, h, h2, d2, k2, p2, 0) for d2, k2, p2 in held if d2 != top)
                    held = []
                    out.append((0, h, h2, d, k, p, 0))
                if len(out) >= 4096:
                    yield _decided(out)
                    out.clear()
        close(True)
        if out:
            yield _decided(out)

    return run


def _decided(rows: list[tuple]) -> pa.RecordBatch:
    kind, h, h2, doc, key, pos, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (h, h2, doc, key)), pa.array(pos, pa.list_(pa.int32())), pa.array(n, pa.int64())],
        names=["kind", "h", "h2", "doc_id", "row_key", "pos", "n"],
    )


def _bitmaps(batches):
    """Positions to drop of each document to a compressed bitmap of what it keeps."""
    for batch in batches:
        maps = []
        for at in batch.column(2).to_pylist():
            bits = np.ones((max(at) // 8 + 1) * 8, np.uint8)
            bits[at] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "row_key", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row_key, bitmap of each document that loses lines.

    A bit is 1 where the line stays; lines beyond the bitmap stay.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = src.mapInArrow(_lines(min_chars), _FOUND)
    order = [F.col("h"), F.col("h2"), F.col("doc_id").desc()]
    decided = spread.cut(found.repartitionByRange(*order).sortWithinPartitions(*order, "row_key").mapInArrow(_stream(min_docs), _DECIDED))
    edges = decided.where("kind = 2").groupBy("h", "h2").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("top")).where(F.col("n_docs") >= min_docs)
    late = decided.where("kind = 1").select("h", "h2", "doc_id", "row_key", "pos").join(F.broadcast(edges), ["h", "h2"]).where("doc_id < top")
    drops = decided.where("kind = 0").select("doc_id", "row_key", "pos").unionByName(late.select("doc_id", "row_key", "pos"))
    return drops.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("pos")).alias("pos")).mapInArrow(_bitmaps, "doc_id long, row_key long, bitmap binary")


def _apply(text_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, maps in zip(pc.cast(batch.column(text_at), pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                text, maps = text.as_py() or b"", maps.as_py()
                count = text.count(b"\n") + 1
                dropped = 0
                if maps:
                    own = row_key(text)
                    for m in maps:
                        if m["row_key"] == own:
                            keep = np.unpackbits(np.frombuffer(zlib.decompress(m["bitmap"]), np.uint8))[:count]
                            lines = text.split(b"\n")
                            kept = [lines[i] for i in np.flatnonzero(keep)] + lines[len(keep) :]
                            dropped = count - len(kept)
                            text = b"\n".join(kept)
                            break
                texts.append(text)
                n_lines.append(count)
                n_dropped.append(dropped)
            cols = list(batch.columns)[:-1]
            cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

    return run


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """The documents with repeated lines dropped from ``text``, and two columns named by ``counts``: lines before, and dropped."""
    doc, maps, one, two, zero = spread.free(docs, "_doc", "_maps", "_one", "_two", "_zero")
    lists = keep_bitmaps(docs, min_chars, min_docs).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("row_key", "bitmap")).alias(maps))
    first, second = spread.apart()
    keyed = docs.withColumns({one: first, two: second})
    joined = keyed.join(lists.withColumn(zero, F.lit(0).cast("long")).hint("shuffle_hash"), (F.col(one) == F.col(doc)) & (F.col(two) == F.col(zero)), "left").drop(doc, one, two, zero)
    schema = T.StructType([*docs.schema.fields, T.StructField(counts[0], T.LongType()), T.StructField(counts[1], T.LongType())])
    return joined.mapInArrow(_apply(docs.columns.index("text"), schema.fieldNames()), schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    done = line_dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(pos)
), shared AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, coalesce(l.doc_id < s.top, false) AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
