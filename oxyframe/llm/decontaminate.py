"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document holds an item when some passage of it is within the item's edit budget:
floor(EDIT_SHARE * length) insertions, deletions and replacements of characters, after
A-Z are lower-cased and white space runs become one space. An item of m characters
under budget k shares at least m - q + 1 - k * q of its q-grams with such a passage,
on diagonals at most k apart. q is Q, or for short items the largest that leaves a
bound of one at least, down to the whole item where no edit is allowed. Hits of
q-grams are counted by (item, band of diagonals); bands are 2k + 2 wide and begin
every k + 1, so k + 1 neighbouring diagonals always lie in one. Regions that reach
the bound are verified by alignment in a band around their diagonals.

A q-gram that stands in over COMMON places of the items would bring a hit for each of
them. Such q-grams are left out of the count and an item's bound falls by its places
of them; where the bound would end below one, the item is counted apart: by the places
of the text that hold any of its q-grams, in windows of a passage's length, which is
linear in the text whatever repeats. What a window can hold is then aligned.

For the filter a character is one byte (ASCII itself, others a hash), which can only
add hits; alignment compares the characters.

The benchmark is the query set. Equal items are searched once. It is taken in blocks of
at most BLOCK_BYTES; up to LIVE blocks are broadcast at a time and searched in one pass
over the documents; with more the rows found are written before the next are sent.

Edge cases: null texts and items count as empty; an empty item matches nothing. Null
and repeated ids are kept as they are; an item or document that repeats gives a row
each time. Other columns pass through; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from . import spread

Q = 8
EDIT_SHARE = 0.1
BLOCK_BYTES = 8 << 20
LIVE = 8
COMMON = 32  # places of one q-gram in a block's items that a text's q-gram is paired with
PIECE = 1 << 21  # pairs that are counted at a time
STRIDE = 1 << 16  # characters of a text that an item counted apart is aligned with at a time
_FILTER_BITS = 20
_SPREAD = B.U(0x9E3779B97F4A7C15)
_END = 0xFF  # stands after every text; no character folds to it
_SCHEMA = "doc_id long, item_id long, edits int, start int, length int"


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte for each character that begins at ``at``; which are not ASCII, and these as integers."""
    out = data[at]
    wide = np.flatnonzero(out >= 0x80)
    p = at[wide]
    ids = data[p].astype(np.uint32)
    more = np.ones(len(p), bool)
    for k in range(1, 4):
        q = np.minimum(p + k, len(data) - 1)
        more &= (p + k < len(data)) & (data[q] & 0xC0 == 0x80)
        ids |= np.where(more, data[q], 0).astype(np.uint32) << np.uint32(8 * k)
    out[wide] = 0x80 + (B.mix(ids.astype(np.uint64)) % B.U(0x7F)).astype(np.uint8)
    return out, wide, ids


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised folded characters with _END after each text, offsets, each one's place in ``data``; the wide ones and their integers."""
    low = B.LOWER[data]
    space = B.NOT_SPACE[data] == 0
    low[space] = 0x20
    keep = data & 0xC0 != 0x80
    keep[1:] &= ~(space[1:] & space[:-1])
    keep[off[:-1][off[:-1] < off[1:]]] = True
    place = np.flatnonzero(keep)
    new_off = np.searchsorted(place, off)
    n = len(off) - 1
    out = np.full(len(place) + n, _END, np.uint8)
    to = np.arange(len(place)) + np.repeat(np.arange(n), np.diff(new_off))
    out[to], wide, ids = folded(low, place)
    where = np.zeros(len(out), np.int64)
    where[to] = place
    return out, new_off + np.arange(n + 1), where, to[wide], ids


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Every run of ``q`` bytes as an integer; q is eight at most."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    if q < 8:
        out = grams(np.append(data, np.zeros(8 - q, np.uint8)), 8)
        return out & B.U((1 << 8 * q) - 1)
    return np.ndarray((len(data) - q + 1,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))


def item_characters(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A normalised item's characters as integers, and folded."""
    raw = np.frombuffer(b" ".join((text or "").encode().translate(bytes(B.LOWER)).split()), np.uint8)
    byte, wide, ids = folded(raw, np.flatnonzero(raw & 0xC0 != 0x80))
    whole = byte.astype(np.uint32)
    whole[wide] = ids
    return whole, byte


class Index:
    """q-grams of the items of a block that take the same q."""

    def __init__(self, q: int, items: list[tuple[np.ndarray, np.ndarray]], rows: list[int], budget: list[int]):
        self.q, self.rows = q, rows
        self.items = [w for w, _ in items]
        self.size = np.array([len(w) for w in self.items], np.int64)
        self.budget = np.array(budget, np.int64)
        bound = self.size - q + 1 - self.budget * q
        parts = [grams(byte, q) for _, byte in items]
        gram = np.concatenate(parts)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pos = np.concatenate([np.arange(len(p)) for p in parts])
        _, kind, n = np.unique(gram, return_inverse=True, return_counts=True)
        common = n[kind] > COMMON
        left = bound - np.bincount(item[common], minlength=len(parts))
        apart = left < 1
        self.apart = [(i, int(bound[i]), np.unique(parts[i])) for i in np.flatnonzero(apart).tolist()]
        self.bound = left
        use = ~common & ~apart[item]
        order = np.flatnonzero(use)[np.argsort(gram[use], kind="stable")]
        self.item, self.pos = item[order], pos[order]
        self.gram, self.begin = np.unique(gram[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.filter = _bits(self.gram)
        self.far = np.unique(np.concatenate([g for _, _, g in self.apart])) if self.apart else np.zeros(0, np.uint64)
        self.far_filter = _bits(self.far)

    def hits(self, g: np.ndarray, known: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text whose q-gram is known, and which one it is."""
        none = np.zeros(0, np.int64)
        if not len(known) or not len(g):
            return none, none
        maybe = np.flatnonzero(bits[((g * _SPREAD) >> B.U(64 - _FILTER_BITS)).view(np.int64)])
        at = np.minimum(np.searchsorted(known, g[maybe]), len(known) - 1)
        same = known[at] == g[maybe]
        return maybe[same], at[same]

    def regions(self, g: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, begin, end) of what the text must hold an item in, if anywhere; places are q-grams' places."""
        text_at, at = self.hits(g, self.gram, self.filter)
        out, reach = [], int(self.size.max() + 2 * self.budget.max()) + 2
        piece = max(PIECE, 4 * COMMON * reach)
        pairs = np.cumsum(self.begin[at + 1] - self.begin[at])
        i = 0
        while i < len(at):
            # Pieces overlap by what an item can reach, so a band that is cut is whole in the next one.
            j = max(i + 1, int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + piece, "right")))
            out += self._bands(text_at[i:j], at[i:j])
            if j >= len(at):
                break
            i = max(i + 1, int(np.searchsorted(text_at, text_at[j] - reach)))
        far_at, which = self.hits(g, self.far, self.far_filter)
        for i, bound, own in self.apart:
            if len(far_at) < bound:
                continue
            at = far_at[np.isin(self.far[which], own)]
            size, k = int(self.size[i]), int(self.budget[i])
            last = np.searchsorted(at, at + size + k - self.q, "right")
            full = np.flatnonzero(last - np.arange(len(at)) >= bound)
            if len(full):
                begin, end = at[full] - size - k, at[last[full] - 1] + size + k
                new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                for a, b in zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True):
                    out += [(i, c, min(b, c + STRIDE + 2 * (size + k))) for c in range(a, max(a + 1, b - 2 * (size + k)), STRIDE)]
        return out

    def _bands(self, text_at: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        count = self.begin[at + 1] - self.begin[at]
        first = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item = self.item[first]
        place, text_at = self.pos[first], np.repeat(text_at, count)
        top = int(self.size.max())
        band = (text_at - place + top) // (self.budget[item] + 1)
        size = len(item)
        key = np.concatenate([(item << 40) | (band + 1), (item << 40) | band])
        order = np.argsort(key, kind="stable")
        key, hit_of = key[order], order % size
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key))
        least = self.bound[key[first] >> 40]
        out = []
        for r in np.flatnonzero(last - first >= least).tolist():
            own = hit_of[first[r] : last[r]]
            # A q-gram counts once for each of its places in the item, and once for each in the text.
            if min(len(np.unique(x[own])) for x in (place, text_at)) >= least[r]:
                i, n = int(key[first[r]] >> 40), int(key[first[r]] & ((1 << 40) - 1)) - 1
                k = int(self.budget[i])
                d = n * (k + 1) - top
                out.append((i, d - k, d + 3 * k + 2 + int(self.size[i])))
        return out


def _bits(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[((known * _SPREAD) >> B.U(64 - _FILTER_BITS)).view(np.int64)] = True
    return out


class Block:
    """Items of a block, each once with all its ids, and their indexes by q."""

    def __init__(self, ids: list, texts: list[str | None], share: float = EDIT_SHARE):
        held: dict[bytes, list] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[list] = []
        by_q: dict[int, list[tuple[int, int]]] = {}
        for i, text in zip(ids, texts, strict=True):
            whole, byte = item_characters(text)
            key = whole.tobytes()
            if key in held:
                held[key].append(i)
            elif len(whole):
                held[key] = [i]
                self.ids.append(held[key])
                k = int(share * len(whole) + 1e-9)
                by_q.setdefault(max(1, min(Q, len(whole) // (k + 1))), []).append((len(found), k))
                found.append((whole, byte))
        self.indexes = [Index(q, [found[i] for i, _ in rows], [i for i, _ in rows], [k for _, k in rows]) for q, rows in by_q.items()]


def align(item, window, budget: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` against a passage of ``window``, its start and end; None above the budget.

    Both are bytes or arrays of characters.

    Rows go over the item. A row holds the diagonals that a passage of the window can
    reach within the budget, and no others.
    """
    item, text = (np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in (item, window))
    raw, wide = item.tobytes(), item.itemsize
    if text.dtype == item.dtype:
        body = text.tobytes()
        hit = body.find(raw)
        while hit >= 0 and hit % wide:
            hit = body.find(raw, hit + 1)
        if hit >= 0:
            return 0, hit // wide, hit // wide + len(item)
    if budget == 0:
        return None
    n = len(text)
    width = max(1, n - len(item) + 1 + 2 * budget)
    step = np.arange(width + 1)
    # Cell j of row i stands for window[:i + j - budget]; a passage may begin anywhere.
    cost = np.zeros(width + 1, np.int64)
    begin = step - budget
    cost[begin < 0] = len(item) + n
    big = len(item) + n
    for i, c in enumerate(item):
        at = i + step - budget  # the byte that the diagonal step takes
        ok = (at >= 0) & (at < n)
        diagonal = np.where(ok, cost + (text[np.clip(at, 0, max(0, n - 1))] != c), big)
        down = np.append(cost[1:], big) + 1
        from_down = down < diagonal
        new = np.where(from_down, down, diagonal)
        began = np.where(from_down, np.append(begin[1:], 0), begin)
        # Bytes of the window that the item lacks: along the row, one edit each.
        level = new - step
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, step, 0))
        cost, begin = best + step, began[source]
        cost[(i + 1 + step - budget) > n] = big
    j = int(cost.argmin())
    if cost[j] > budget:
        return None
    return int(cost[j]), max(0, int(begin[j])), min(n, len(item) + j - budget)


def matches(block: Block, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, length) of every item that a text holds, start and length in bytes of the text."""
    body, new_off, where, wide, ids = normal(data, off)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    whole = None
    for index in block.indexes:
        for i, a, b in index.regions(grams(body, index.q)):
            if whole is None:
                whole = body.astype(np.uint32)
                whole[wide] = ids
            k = int(index.budget[i])
            # A region may reach over the ends of a text: its part in each text is one of its own.
            a, b = max(0, a), min(b, len(body))
            for row in range(int(np.searchsorted(new_off, a, "right")) - 1, int(np.searchsorted(new_off, b - 1, "right"))):
                lo, hi = max(a, int(new_off[row])), min(b, int(new_off[row + 1]) - 1)
                key = row, index.rows[i]
                if hi - lo < index.size[i] - k or found.get(key, (1,))[0] == 0:
                    continue
                got = align(index.items[i], whole[lo:hi], k)
                if got and (key not in found or got[0] < found[key][0]):
                    begin, end = lo + got[1], lo + got[2]
                    start = int(where[begin])
                    # The passage ends where its last character does.
                    stop = int(where[max(begin, end - 1)]) + 1
                    while stop < off[row + 1] and data[stop] & 0xC0 == 0x80:
                        stop += 1
                    found[key] = (got[0], start - int(off[row]), stop - start)
    return [(row, i, *rest) for (row, i), rest in sorted(found.items())]


def _search(sent: list):
    def run(batches):
        for batch, data, off in B.rows_of(batches):
            for one in sent:
                block = one.value
                got = [(r[0], i, *r[2:]) for r in matches(block, data, off) for i in block.ids[r[1]]]
                rows = pa.array([r[0] for r in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([r[1] for r in got], pa.int64()), *(pa.array([r[k] for r in got], pa.int32()) for k in (2, 3, 4))],
                    names=["doc_id", "item_id", "edits", "start", "length"],
                )

    return run


def _clean(sent: list, text: str):
    def run(batches):
        for batch, data, off in B.rows_of(batches, col=text):
            keep = np.ones(batch.num_rows, bool)
            for one in sent:
                keep[[r[0] for r in matches(one.value, data, off)]] = False
            yield batch.filter(pa.array(keep))

    return run


def blocks(benchmark: DataFrame, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Lists of at most LIVE broadcast blocks of items, each of a bounded size."""
    sc, out, ids, texts, size = benchmark.sparkSession.sparkContext, [], [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len((r.text or "").encode())
        if size >= block_bytes:
            out.append(sc.broadcast(Block(ids, texts, share)))
            ids, texts, size = [], [], 0
            if len(out) == LIVE:
                yield out
                out = []
    if ids:
        out.append(sc.broadcast(Block(ids, texts, share)))
    if out:
        yield out


def _in_turn(parts: Iterator[list], search, start: DataFrame | None, join) -> DataFrame | None:
    """``search`` with each list of blocks; what the earlier ones gave is written, and they are let go."""
    out, before = start, None
    for sent in parts:
        if before is not None:
            out = spread.cut(out)
            for one in before:
                one.unpersist()
        out, before = join(out, search(sent, out)), sent
    return out


def find(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, start, length (bytes of the text) for every document and item it holds."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _in_turn(blocks(benchmark, share, block_bytes), lambda sent, _: src.mapInArrow(_search(sent), _SCHEMA), None, lambda a, b: b if a is None else a.unionByName(b))
    return docs.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item."""
    return _in_turn(blocks(benchmark, share, block_bytes), lambda sent, rest: rest.mapInArrow(_clean(sent, "text"), docs.schema), docs, lambda _, b: b)
