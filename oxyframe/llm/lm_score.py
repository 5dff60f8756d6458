"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is coded as its lower-cased words, each with a space after it, and an end
symbol. Every byte is a path of bits in a prefix code that the two bytes before it
choose. Three predictors look up counts of the bit's two outcomes under a hash of
their context (four bytes, the word so far, the word so far and the word before)
and of the bit's place in the code. Their log odds are mixed by weights that a gate
picks (place in the word and in the code) plus weights that the text itself learns;
an adaptive probability map refines the mixed probability, starting from the map of
the fit. The text's weights and its map move after every BLOCK bytes. So each word
gets a probability of being spelled. It is mixed with the word's share of all training
words (exact counts) by a gate that follows which of the two did better on the last
RECENT words of the text; a word that training lacks can only be spelled. All that is
learned online comes from what stands before it in the same text, so a score does not
depend on the texts beside it.

Bit counts come from every training text: each task sums its own tables and sends them
in parts, which are added up by part. Tables have 2**TABLE_BITS places a predictor
whatever the corpus (hashed contexts share places); the word counts grow with the
corpus. Three passes over the training texts fit a model: one counts the bytes after
each pair of bytes, for the prefix code; one the bits; one takes the three log odds of
every bit, its text's own counts taken out, to the nearest 1 / STEPS, and counts them by
gate. Gated weights (by Newton's method) and the first map are fitted on those counts.

A block of texts sends each range of word hashes its distinct words once, with counts;
sums come back to the blocks. So a word that all texts hold is one entry a block.

Edge cases: null counts as empty: one end token, no words. Texts over WINDOW bytes that are a
slice of their own are scored window by window, and contexts, weights and map go on from one to the next:
the window's size bounds memory and changes nothing. With no training text every count is 0
and base_score is 0. Null and repeated ids give a row each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .spread import cut

TABLE_BITS = 21
ROUNDS = 12  # steps of the weights' fit, which changes them little after half as many
STEPS, LEVELS = 2, 33  # log odds are fitted on in halves, from -8 to 8
CODE_SHARE = 1e-3  # of the training bytes: two bytes as common choose a code of their own
BLOCK = 256  # bytes that a text's own weights and map stay the same for; divides WINDOW
WINDOW = 1 << 20
RATE, MAP_RATE = 0.05, 0.02
MOST_OWN = 0.5  # how far a text's own weights may go
RECENT, TRUST = 16, 0.25  # words that the gate looks back on, and how much it makes of a nat
SLICE = 1 << 18  # bytes of texts whose stream is made at once: they stay in the cache
MERGED = 1 << 21  # bytes whose bits are counted at once: the more, the more of them are alike
SCORED = 1 << 21  # bytes of texts that are scored at once: the more go side by side, the fewer steps
SIDE = 1024  # texts side by side at most, as each has its map
NEAR = 256  # texts whose blocks are scored at once: they stay in the cache
TOKENS_A_BLOCK = 1 << 21
END = 0xFF  # no byte of UTF-8
END_TOKEN = B.U(0x5851F42D4C957F2D)
K = 3
GATES = 32
BUCKETS = 64
NODES = 64  # places a context has in a table, next to each other
LOW = B.LOWER.copy()
LOW[END] = 0xFE  # a stray byte in broken text is not taken for the end
_PAD = 4
U32 = np.uint32
_MUL = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], U32)
_BYTE = (B.BYTE_CODE >> B.U(32)).astype(U32) | U32(1)
_BASE = 0x01000193
_grown: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**32."""
    if not _grown or len(_grown[0]) < n:
        _grown[:] = [np.cumprod(np.r_[U32(1), np.full(max(n, 1 << 16), b, U32)], dtype=U32) for b in (_BASE, pow(_BASE, -1, 2**32))]
    return _grown


def _lengths_and_paths(freq: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """Huffman code of the bytes: for each its way of (node, bit)."""
    heap = [(int(f), i, i) for i, f in enumerate(freq)]
    heapq.heapify(heap)
    child: dict[int, tuple[int, int]] = {}
    nxt = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        child[nxt] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], nxt, nxt))
        nxt += 1
    path: list[tuple[tuple[int, int], ...]] = [()] * 256
    todo: list[tuple[int, tuple[tuple[int, int], ...]]] = [(heap[0][2], ())]
    while todo:
        n, way = todo.pop()
        if n < 256:
            path[n] = way
        else:
            todo += [(child[n][bit], (*way, (n - 256, bit))) for bit in (0, 1)]
    return path


class Code:
    """A prefix code for the bytes after each pair of bytes, fixed before counting.

    Pairs that are common in the texts have their own, others that of their last byte.
    ``counted`` are triples (byte before the last one, last byte, byte) as one number, and how often each came.
    """

    def __init__(self, texts: list[bytes], counted: tuple[np.ndarray, np.ndarray] | None = None):
        if counted is None:
            data = [np.frombuffer(bytes([END] * _PAD) + body, np.uint8).astype(np.int64) for body in texts]
            key = [x[_PAD - 2 : -2] << 16 | x[_PAD - 1 : -1] << 8 | x[_PAD:] for x in data]
            counted = np.unique(np.concatenate(key or [np.zeros(0, np.int64)]), return_counts=True)
        key, n = counted
        byte, last, two = key & 255, key >> 8 & 255, key >> 8 & 255 | key >> 16 << 8
        two_sum = np.bincount(two, n, 1 << 16)
        every = np.bincount(byte, n, 256)
        common = np.flatnonzero(two_sum > max(200, CODE_SHARE * n.sum()))
        self.which = np.zeros(1 << 16, np.int16)  # at most 257 and 1 / CODE_SHARE tables
        tables = [every]
        order = np.argsort(last, kind="stable")
        ends = np.searchsorted(last[order], np.arange(257))
        for b in range(256):
            if ends[b + 1] > ends[b]:
                self.which[np.arange(256) * 256 + b] = len(tables)
                own = order[ends[b] : ends[b + 1]]
                tables.append(np.bincount(byte[own], n[own], 256))
        order = np.argsort(two, kind="stable")
        for pair in common.tolist():
            own = order[slice(*np.searchsorted(two[order], [pair, pair + 1]))]
            self.which[pair] = len(tables)
            tables.append(np.bincount(byte[own], n[own], 256))
        start, size, steps, again = [], [], [], []
        at = 0
        for t in tables:
            # A byte not seen here has a way by its share of all bytes.
            for way in _lengths_and_paths(t * 64 + np.rint(every * 63 / max(1, every.sum())).astype(np.int64) + 1):
                start.append(at)
                size.append(len(way))
                at += len(way)
                # Of each step: its node (the heaviest are 0 and on), its depth, its bit.
                steps += [(254 - n) % NODES << 4 | min(d, 7) << 1 | bit for d, (n, bit) in enumerate(way)]
                again.append(len(way) - len({(254 - n) % NODES for n, _ in way}))
        self.start, self.size, self.step = np.array(start, np.int64), np.array(size, np.int64), np.array(steps, np.uint16)
        #: Steps of a way that share their node with one before.
        self.again = np.array(again, np.int64)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes by ``LOW``."""
    out = (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
    out |= data
    return np.minimum(out, np.uint8(0xFE), out=out)


def _solid(low: np.ndarray) -> np.ndarray:
    """Which bytes are no space, by ``B.NOT_SPACE``."""
    return (low != 0x20) & (low - np.uint8(9) >= 5)


def _span(h: np.ndarray, inv: np.ndarray, a: int, b: int) -> int:
    """Hash of the bytes from a to b."""
    return (int(h[b]) - int(h[a])) * int(inv[a]) % (1 << 32)


class Stream:
    """Coded bytes of some texts, each byte's way in the code and its contexts.

    A window of one text goes on from ``carry``, what the window before it left in ``left``.
    Without a code only the bytes are made.
    """

    def __init__(self, low: np.ndarray, off: np.ndarray, ended: np.ndarray, code: Code | None = None, carry: tuple | None = None):
        n = len(off) - 1
        solid = _solid(low)
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        begins = off[:-1][off[:-1] < off[1:]]
        inside = carry is not None and carry[0][-1] not in (0x20, END)
        keep[begins] = solid[begins] | inside
        place = np.flatnonzero(keep)
        at = np.searchsorted(place, off)
        size = np.diff(at)
        last = np.zeros(n, np.int64)
        some = size > 0
        last[some] = solid[place[at[1:][some] - 1]] & (ended[some] > 0)
        # Pads, bytes, a space after a word that ends the text, the end symbol.
        total = _PAD + size + last + ended
        new = np.concatenate(([0], np.cumsum(total)))
        out = np.full(int(new[-1]), 0x20, np.uint8)
        body = np.where(solid, low, np.uint8(0x20))[keep]
        inner = np.ones(len(out), bool)
        for k in range(_PAD):
            inner[new[:-1] + k] = False
        inner[new[1:][ended > 0] - 1] = False
        inner[new[1:][last > 0] - 2] = False
        out[inner] = body
        for k in range(_PAD):
            out[new[:-1] + k] = END if carry is None else carry[0][k]
        out[new[1:][ended > 0] - 1] = END
        self.bytes, self.begin, self.end = out, new[:-1] + _PAD, new[1:]
        m = len(out)
        if code is None:
            self.left = (out[m - _PAD :], 0, 0, 0)
            return
        index = np.arange(m, dtype=np.int32)
        stop = (out == 0x20) | (out == END)
        start = np.zeros(m, np.int32)
        start[1:] = (index[:-1] + 1) * stop[:-1]
        np.maximum.accumulate(start, out=start)
        begun = start.astype(np.intp)
        p, inv = _powers(m + 1)
        h = np.zeros(m + 1, U32)
        np.cumsum(_BYTE.take(out) * p[:m], out=h[1:], dtype=U32)
        prefix = (h[:-1] - h.take(begun)) * inv.take(begun)
        far = index - start
        first = slice(0, 0)
        if carry is not None:
            # The first word goes on: its bytes before this window count too.
            _, word, length, word_before = carry
            stops = np.flatnonzero(stop[_PAD:])
            first = slice(_PAD, _PAD + int(stops[0]) + 1 if len(stops) else m)
            prefix[first] = U32(word) + U32(pow(_BASE, length, 1 << 32)) * ((h[:-1][first] - h[_PAD]) * inv[_PAD])
            far[first] = index[first] - _PAD + min(length, 3)
        # What stands before a word is the space after the word before it.
        before = prefix.take(np.maximum(begun - 1, 0))
        if carry is not None:
            before[first] = word_before
        # Tokens begin after a stop: at a word, or at the end symbol.
        self.token = np.zeros(m, bool)
        self.token[1:] = stop[:-1]
        if n == 1 and not ended[0]:
            if carry is not None and m == _PAD:
                self.left = carry
            elif stop[m - 1]:
                self.left = (out[m - _PAD :], 0, 0, int(prefix[m - 1]))
            elif m > _PAD and first.stop < m or carry is None:
                a = int(start[m - 1])
                self.left = (out[m - _PAD :], _span(h, inv, a, m), m - a, int(before[m - 1]))
            else:
                more = pow(_BASE, length, 1 << 32) * _span(h, inv, _PAD, m)
                self.left = (out[m - _PAD :], (word + more) % (1 << 32), length + m - _PAD, word_before)
        b = out.astype(U32)
        two = np.full(m, END | (END << 8), U32)
        two[1:] = b[:-1] | U32(END << 8)
        two[2:] = b[1:-1] | (b[:-2] << U32(8))
        four = two.copy()
        four[2:] |= two[:-2] << U32(16)
        # A context counts for one code only.
        which = code.which.take(two)
        self.code, self.way = code, which.astype(np.int32) * 256 + out
        own = which.astype(U32) * U32(0x9E3779B1)
        four, prefix, before = four + own, prefix + own, before ^ own
        mixed = [(four ^ (four >> U32(15))) * _MUL[0], prefix * _MUL[1], (prefix + before * U32(0x2545F491)) * _MUL[2]]
        self.context = [m ^ (m >> U32(16)) for m in mixed]
        self.gate = np.minimum(far, 3) * 8

    def coded(self) -> np.ndarray:
        """Which bytes are coded: all but the pads."""
        out = np.ones(len(self.bytes), bool)
        for k in range(1, _PAD + 1):
            out[self.begin - k] = False
        return out


class Joined(Stream):
    """Streams of whole texts, one behind the other."""

    def __init__(self, parts: list[Stream]):
        self.code = parts[0].code
        for name in ("bytes", "token", "way", "gate"):
            setattr(self, name, np.concatenate([getattr(s, name) for s in parts]))
        self.context = [np.concatenate([s.context[k] for s in parts]) for k in range(K)]
        size = np.array([len(s.bytes) for s in parts])
        shift = np.repeat(np.cumsum(size) - size, [len(s.begin) for s in parts])
        self.begin, self.end = (np.concatenate([getattr(s, name) for s in parts]) + shift for name in ("begin", "end"))


def place(context: np.ndarray) -> np.ndarray:
    x = context * U32(0x9E3779B1)
    x >>= U32(32 - TABLE_BITS)
    return x


class Bits:
    """Bits of the coded bytes at ``pos``, or of the ways given. ``of`` gives each bit its byte's place among them."""

    def __init__(self, s: Stream, pos: np.ndarray | None, way: np.ndarray | None = None):
        self.s, self.pos = s, pos
        way = s.way[pos] if way is None else way
        size = s.code.size.take(way)
        self.first = np.cumsum(size)
        n = int(self.first[-1]) if len(size) else 0
        self.first -= size
        # Every way has a bit at least, so the first bits are apart.
        self.of = np.zeros(n, np.intp)
        self.of[self.first[1:]] = 1
        np.cumsum(self.of, out=self.of)
        at = (s.code.start.take(way) - self.first).take(self.of)
        at += np.arange(n)
        step = s.code.step.take(at)
        self.bit = (step & np.uint16(1)).astype(bool)
        self.depth = (step >> np.uint16(1)) & np.uint16(7)
        step >>= np.uint16(4)
        self.node = step.astype(np.intp)

    def slots(self, context: np.ndarray) -> np.ndarray:
        """Places in a table. The bits of a byte lie within NODES neighbouring ones."""
        return self.near(place(context).astype(np.intp))

    def near(self, places: np.ndarray) -> np.ndarray:
        x = places.take(self.of)
        x ^= self.node
        return x

    def gates(self, base: np.ndarray | None = None) -> np.ndarray:
        """The gate of each bit, on top of ``base`` for its byte."""
        g = self.s.gate[self.pos].astype(np.intp)
        if base is not None:
            g += base
        g = g.take(self.of)
        g += self.depth
        return g


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -7.9, 7.9)


class Model:
    """What scoring needs: the code, log odds of each predictor in sixteenths, weights, probability map."""

    def __init__(self, code: Code, tables: list[np.ndarray], weight: np.ndarray, refined: np.ndarray):
        self.code, self.tables, self.weight, self.refined = code, tables, weight, refined

    def fresh(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Own weights and maps of n texts at their beginning."""
        return np.zeros((K, n), np.float32), np.tile(self.refined, (n, 1))

    def costs(self, s: Stream, state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Nats of each coded byte of the stream.

        Own weights and map of a window's text are in ``state`` and move on. Without it texts are at their
        beginning, and SIDE of them, alike in size, go side by side.
        """
        nats = np.zeros(len(s.bytes), np.float32)
        order = np.argsort(s.end - s.begin, kind="stable")
        for a in range(0, len(order), SIDE):
            group = order[a : a + SIDE]
            self._costs(s, group, self.fresh(len(group)) if state is None else state, nats)
        return nats

    def _costs(self, s: Stream, group: np.ndarray, state: tuple[np.ndarray, np.ndarray], nats: np.ndarray) -> None:
        """Fills in the nats of the texts of ``group``, which is in order of size."""
        own, maps = state
        flat = maps.reshape(-1)
        begin, end = s.begin[group], s.end[group]
        size = end - begin
        rounds = range(int(-(-size[-1] // BLOCK)))
        ended = np.searchsorted(size, np.array(rounds) * BLOCK, "right").tolist()
        for r, at in ((r, at) for r in rounds for at in range(ended[r], len(size), NEAR)):
            live = slice(at, at + NEAR)
            first = begin[live] + r * BLOCK
            count = np.minimum(end[live] - first, BLOCK)
            shift = np.cumsum(count) - count
            pos = np.arange(int(count.sum())) + np.repeat(first - shift, count)
            bits = Bits(s, pos)
            cut = bits.first[shift]
            n_bits = np.diff(np.append(cut, len(bits.node)))
            came = bits.bit.astype(np.float32)
            pick = bits.gates(np.repeat(np.arange(len(count)) * GATES, count))
            odds = []
            for k in range(K):
                st = self.tables[k].take(bits.slots(s.context[k][pos])).astype(np.float32)
                odds.append(st)
                part = ((self.weight[k] + own[k, live][:, None]) * np.float32(1 / 16)).ravel().take(pick)
                part *= st
                if k == 0:
                    x = part
                else:
                    x += part
            p = np.negative(x)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            x *= 4
            x += 32
            cell = np.clip(x, 0, BUCKETS - 1, out=x).astype(np.intp)
            # A text's map lies in its row; ``pick`` is (text among the live, gate).
            pick += at * GATES
            pick *= BUCKETS
            cell += pick
            q = flat.take(cell)
            # Of bits that meet in a cell the last one counts.
            step = came - q
            step *= np.float32(MAP_RATE)
            step += q
            flat[cell] = step
            q += p
            q *= np.float32(0.5)
            # The probability of the bit that came: 1 - |bit - q|.
            got = came - q
            np.abs(got, out=got)
            np.subtract(np.float32(1), got, out=got)
            np.log(np.maximum(got, np.float32(1e-9), out=got), out=got)
            nats[pos] = -np.bincount(bits.of, got)
            wrong = np.subtract(came, p, out=p)
            rate = np.float32(RATE / 16) / np.sqrt(n_bits, dtype=np.float32)
            for k in range(K):
                odds[k] *= wrong
                own[k, live] = np.clip(own[k, live] + rate * np.add.reduceat(odds[k], cut), -MOST_OWN, MOST_OWN)

    def token_costs(self, low: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Nats of each token, word by word and then the end, of the texts of a slice."""
        if len(off) != 2 or len(low) <= window:
            parts = [Stream(low[off[i] : off[j]], off[i : j + 1] - off[i], np.ones(j - i, np.int64), self.code) for i, j in B.slices(off, SLICE)]
            if not parts:
                return np.zeros(0)
            s = Joined(parts)
            coded = s.coded()
            return np.add.reduceat(self.costs(s)[coded], np.flatnonzero(s.token[coded]), dtype=np.float64)
        out, state = [], self.fresh(1)
        for s in windows(low, self.code, window):
            nats = self.costs(s, state)[_PAD:].astype(np.float64)
            at = np.flatnonzero(s.token[_PAD:])
            head = int(at[0]) if len(at) else len(nats)
            if head:
                out[-1][-1] += nats[:head].sum()
            if len(at):
                out.append(np.add.reduceat(nats, at))
        return np.concatenate(out)


def windows(low: np.ndarray, code: Code | None, window: int = WINDOW) -> Iterator[Stream]:
    """Streams of one long text whose coded windows, of whole blocks but for the last, join without a seam."""
    carry = None
    solid = _solid(low)
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    low = low[keep]
    for a in range(0, max(1, len(low)), window):
        b = min(len(low), a + window)
        s = Stream(low[a:b], np.array([0, b - a]), np.array([int(b == len(low))]), code, carry)
        carry = getattr(s, "left", None)
        yield s


def fit(cells: np.ndarray, counts: list[np.ndarray], code: Code, rounds: int = ROUNDS) -> Model:
    """Weights and probability map from the counts of bits by gate and log odds (``_cells``)."""
    of = cells.reshape(-1, 2)
    some = np.flatnonzero(of.any(axis=1))
    n, ones = of[some].sum(axis=1).astype(np.float64), of[some, 1].astype(np.float64)
    gate = some // LEVELS**K
    st = np.stack([(some // LEVELS**k % LEVELS - LEVELS // 2) / STEPS for k in range(K)])
    weight = np.full((K, GATES), 0.4)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(gate, x, GATES)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(weight[:, gate] * st).sum(axis=0)))
        curve = n * p * (1 - p)
        # As if each gate had a little that speaks for 0.4.
        slope = np.stack([summed((ones - n * p) * st[k]) for k in range(K)], axis=1) - (weight.T - 0.4)
        bend = np.stack([np.stack([summed(curve * st[j] * st[k]) for k in range(K)], axis=1) for j in range(K)], axis=1) + np.eye(K)
        weight += np.clip(np.linalg.solve(bend, slope[:, :, None])[:, :, 0].T, -0.5, 0.5)
    weight = weight.astype(np.float32)
    middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) - 31.5) / 4))
    hits = np.tile(np.stack([1 - middle, middle]) * 8, (GATES, 1, 1))
    at = np.clip((weight[:, gate] * st).sum(axis=0) * 4 + 32, 0, BUCKETS - 1).astype(np.intp)
    for bit, came in enumerate((n - ones, ones)):
        hits[:, bit] += np.bincount(gate * BUCKETS + at, came, GATES * BUCKETS).reshape(GATES, BUCKETS)
    refined = np.clip(hits[:, 1] / hits.sum(axis=1), 1e-5, 1 - 1e-5).astype(np.float32).ravel()
    tables = [np.rint(log_odds(c[:, 0], c[:, 1]) * 16).astype(np.int8) for c in counts]
    return Model(code, tables, weight, refined)


def is_training(doc_id=None):
    """Texts that are learned from: crc32 of doc_id as text, modulo 7, is not 2."""
    doc = F.col("doc_id") if doc_id is None else doc_id
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _streams(low: np.ndarray, off: np.ndarray, code: Code | None) -> Iterator[Stream]:
    if len(off) == 2 and len(low) > WINDOW:
        yield from windows(low, code)
    else:
        yield Stream(low, off, np.ones(len(off) - 1, np.int64), code)


_PART = 1 << 15


def _tables(sent):
    """Each task's counts, in parts."""

    def run(batches):
        code = sent.value
        counts = [np.zeros(2 << TABLE_BITS, np.uint32) for _ in range(K)]
        held: list[list[np.ndarray]] = [[] for _ in range(K)]
        size = 0

        def count(s: Stream) -> None:
            """Bytes alike in place and way are merged before their bits are counted, and counted from the table's start to its end."""
            for k in range(K):
                key = np.concatenate(held[k])
                held[k].clear()
                key.sort()
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                times = np.diff(np.append(first, len(key))).astype(U32)
                key = key[first]
                for a in range(0, len(key), _PART):
                    some = key[a : a + _PART]
                    bits = Bits(s, None, (some & B.U(0xFFFFFFFF)).astype(np.intp))
                    slot = bits.near((some >> B.U(32)).astype(np.intp))
                    slot *= 2
                    slot += bits.bit
                    np.add.at(counts[k], slot, times[a : a + _PART].take(bits.of))

        for s in (x for _, data, off in B.rows_of(batches, SLICE) for x in _streams(lowered(data), off, code)):
            coded = np.flatnonzero(s.coded())
            way = s.way[coded].astype(np.uint64)
            for k in range(K):
                held[k].append(place(s.context[k][coded]).astype(np.uint64) << B.U(32) | way)
            size += len(coded)
            if size >= MERGED:
                count(s)
                size = 0
        if size:
            count(s)
        for k in range(K):
            yield _parts(counts[k], k * (len(counts[k]) // (2 * _PART)))

    return run


def _parts(counts: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """The parts of an array of counts that are not all 0, numbered from ``first``."""
    body = np.pad(counts, (0, -len(counts) % (2 * _PART))).reshape(-1, 2 * _PART)
    some = np.flatnonzero(body.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some + first, pa.int32()), pa.array([zlib.compress(body[i].tobytes(), 1) for i in some], pa.binary())], names=["part", "body"])


def _triples(batches):
    """Each task's counts of three bytes on end, in parts."""
    counts = np.zeros(1 << 24, np.uint32)
    for _, data, off in B.rows_of(batches, SLICE):
        for s in _streams(lowered(data), off, None):
            x = s.bytes.astype(np.int64)
            np.add.at(counts, (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[s.coded()[2:]], U32(1))
    yield _parts(counts)


class Counts:
    """Tables of bit counts, sent as compressed parts and opened once in a process."""

    def __init__(self, parts: dict[int, bytes]):
        self.parts, self.opened, self.firm = parts, None, None

    def __getstate__(self):
        return {"parts": self.parts, "opened": None, "firm": None}

    def tables(self) -> np.ndarray:
        if self.opened is None:
            out = np.zeros(K * (2 << TABLE_BITS), np.float32)
            for part, body in self.parts.items():
                out[part * 2 * _PART : (part + 1) * 2 * _PART] = np.frombuffer(zlib.decompress(body), np.int64)
            self.opened = out.reshape(K, -1)
        return self.opened

    def steady(self) -> list[np.ndarray]:
        """Of each place its level of log odds and how firm it is (``_steady``)."""
        if self.firm is None:
            self.firm = [np.concatenate([_steady(_whole(t[a : a + 2 * _PART])) for a in range(0, len(t), 2 * _PART)]) for t in self.tables()]
        return self.firm


def _whole(t: np.ndarray) -> np.ndarray:
    # Whole numbers, so that what is put back leaves no trace; above 32 bits one text's own matter no more.
    return np.minimum(t, 2.0**32 - 256).astype(U32)


class _Others:
    """Counts of all texts' bits, from which one text's own can be taken and put back."""

    def __init__(self, tables: np.ndarray):
        self.counts = [_whole(t) for t in tables]
        self.pairs = [c.view(np.uint64) for c in self.counts]

    def less(self, slots: list[np.ndarray]) -> None:
        for c, slot in zip(self.counts, slots, strict=True):
            np.subtract.at(c, slot, U32(1))

    def more(self, slots: list[np.ndarray]) -> None:
        for c, slot in zip(self.counts, slots, strict=True):
            np.add.at(c, slot, U32(1))

    def seen(self, places: list[np.ndarray]) -> list[np.ndarray]:
        """Counts of both outcomes at places, as they are, each two as one number."""
        return [c.take(x) for c, x in zip(self.pairs, places, strict=True)]

    def without(self, places: list[np.ndarray], slots: list[np.ndarray], out: list[np.ndarray]) -> None:
        """Fills in what is seen at a text's places without the text's own, which is put back."""
        for c, pairs, place, slot, x in zip(self.counts, self.pairs, places, slots, out, strict=True):
            np.subtract.at(c, slot, U32(1))
            pairs.take(place, out=x, mode="clip")
            np.add.at(c, slot, U32(1))


def _level(pairs: np.ndarray) -> np.ndarray:
    """Levels of log odds, 0 in the middle, by counts of both outcomes."""
    n = pairs.view(U32).astype(np.float32)
    x = log_odds(n[::2], n[1::2])
    x *= STEPS
    return np.rint(x, out=x)


def _levels(seen: list[np.ndarray]) -> np.ndarray:
    """Log odds of bits by counts of both outcomes, as one number of their levels."""
    out = np.empty(len(seen[0]), np.int32)
    for a in range(0, len(out), _PART):
        # The numbers are below 2**24, whole in 32 bits.
        total = np.float32(LEVELS**K // 2)
        for k in range(K):
            x = _level(seen[k][a : a + _PART])
            x *= LEVELS**k
            total = np.add(total, x, out=x)
        out[a : a + _PART] = total
    return out


#: A level is as firm as the place here of how many of either outcome can go and leave it. Levels take a byte with that.
_FIRM = np.array([0, 1, 2, 4, 12, 64, 512])


def _steady(counts: np.ndarray) -> np.ndarray:
    """The level that counts of both outcomes have, plus LEVELS times how firm it is, whichever of them go."""
    level = np.arange(LEVELS) - LEVELS // 2
    # A margin for how single precision rounds. Log odds end at the first and the last level.
    up = np.exp(1e-4 - (level + 0.5) / STEPS)
    down = np.exp(1e-4 + (level - 0.5) / STEPS)
    up[-1] = down[0] = 0
    own = (_level(counts.view(np.uint64)) + LEVELS // 2).astype(np.intp)
    n = counts + 0.4
    least0, least1 = n[1::2] * up.take(own), n[::2] * down.take(own)
    # All of an outcome may go if none need stay.
    least0[least0 <= 0.4] = -np.inf
    least1[least1 <= 0.4] = -np.inf
    free = np.minimum(n[::2] - least0, n[1::2] - least1)
    own += LEVELS * (np.searchsorted(_FIRM[1:], free, "right"))
    return own.astype(np.uint8)


_CLASSES = 1 << 18
_STEP = 1 << 13  # bytes whose bits are made at once: they stay in the cache


def _at_most(places: np.ndarray, text: np.ndarray, again: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each byte LEVELS times how firm levels are that its text's counts in its neighbourhood of a table can't change. Texts may share a class."""
    key = places // NODES
    key += text
    key &= _CLASSES - 1
    n = np.zeros(_CLASSES, U32)
    np.add.at(n, key, U32(1))
    np.add.at(n, key.take(more), again)
    np.minimum(n, U32(_FIRM[-1] + 1), out=n)
    return (LEVELS * np.searchsorted(_FIRM, np.arange(_FIRM[-1] + 2))).astype(np.uint8).take(n).take(key)


def _cells(sent):
    """Each task's counts of bits by gate, levels of log odds and the bit, in parts."""

    def run(batches):
        code, counts = sent.value
        others, steady = _Others(counts.tables()), counts.steady()
        cells = np.zeros(2 * GATES * LEVELS**K, np.int64)

        def bits_of(s: Stream) -> tuple[Bits, list[np.ndarray], list[np.ndarray]]:
            bits = Bits(s, np.flatnonzero(s.coded()))
            places = [bits.slots(c[bits.pos]) for c in s.context]
            # Of each bit the place of its own count; that of the other outcome lies beside it.
            slots = [x * 2 for x in places]
            for x in slots:
                x += bits.bit
            return bits, places, slots

        def cell(bits: Bits, levels: np.ndarray) -> np.ndarray:
            at = bits.gates()
            at *= LEVELS**K
            at += levels
            at *= 2
            at += bits.bit
            return at

        def count(s: Stream) -> None:
            """Counts the bits of whole texts. Where a text's own counts can't change a level they stay in."""
            pos = np.flatnonzero(s.coded())
            # Every text has its end symbol at least.
            begin = np.searchsorted(pos, s.begin)
            text = np.repeat(np.arange(len(begin)) * 40503, np.diff(np.append(begin, len(pos))))
            way = s.way.take(pos)
            again = code.again.take(way)
            more = np.flatnonzero(again)
            again = again.take(more).astype(U32)
            places = [place(c.take(pos)).astype(np.intp) for c in s.context]
            most = [_at_most(x, text, again, more) for x in places]
            ends = np.concatenate(([0], np.cumsum(code.size.take(way))))
            at = np.empty(int(ends[-1]), np.intp)
            doubt: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(K)]
            for a in range(0, len(pos), _STEP):
                b = min(a + _STEP, len(pos))
                bits = Bits(s, pos[a:b], way[a:b])
                levels = np.zeros(len(bits.of), np.uint16)  # LEVELS**K is below 2**16
                for k in range(K):
                    near = bits.near(places[k][a:b])
                    x = steady[k].take(near)
                    i = np.flatnonzero(x < most[k][a:b].take(bits.of))
                    x -= x // np.uint8(LEVELS) * np.uint8(LEVELS)
                    near = near.take(i)
                    doubt[k].append((i + ends[a], near, near * 2 + bits.bit.take(i), x.take(i)))
                    levels += x * np.uint16(LEVELS**k)
                at[ends[a] : ends[b]] = cell(bits, levels)
            bit, near, slots, old = ([np.concatenate(x) for x in of] for of in zip(*(zip(*x, strict=True) for x in doubt), strict=True))
            seen = [np.empty(len(x), np.uint64) for x in bit]
            edges = [np.searchsorted(x, ends.take(np.append(begin, len(pos)))).tolist() for x in bit]
            for i in range(len(begin)):
                own = [slice(e[i], e[i + 1]) for e in edges]
                others.without(*([x[o] for x, o in zip(of, own, strict=True)] for of in (near, slots, seen)))
            for k in range(K):
                at[bit[k]] += (_level(seen[k]).astype(np.intp) + LEVELS // 2 - old[k]) * (2 * LEVELS**k)
            np.add.at(cells, at, 1)

        for _, data, off in B.rows_of(batches, SLICE):
            low = lowered(data)
            if len(off) == 2 and len(low) > WINDOW:
                for turn in (
                    lambda _, __, x: others.less(x),
                    lambda bits, x, _: np.add.at(cells, cell(bits, _levels(others.seen(x))), 1),
                    lambda _, __, x: others.more(x),
                ):
                    for s in windows(low, code):
                        turn(*bits_of(s))
            else:
                count(Stream(low, off, np.ones(len(off) - 1, np.int64), code))
        yield _parts(cells.astype(np.uint32))

    return run


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * _PART, np.int64)
    for batch in batches:
        for x in batch.column("body").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "body"])


def _summed_parts(text: DataFrame, run) -> dict[int, bytes]:
    """Parts of the tasks' counts, added up over all tasks."""
    parts = text.mapInArrow(run, "part int, body binary").groupBy("part").applyInArrow(_added, "part int, body binary")
    return {r.part: bytes(r.body) for r in parts.collect()}


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model from all training texts of ``docs`` (doc_id, text)."""
    text = docs.where(is_training()).select(F.coalesce("text", F.lit("")).alias("text"))
    # A task sums its tables over several input splits, so that fewer tables move.
    few = text.coalesce(max(1, -(-text.rdd.getNumPartitions() // 3)))
    context = docs.sparkSession.sparkContext
    key, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, body in sorted(_summed_parts(few, _triples).items()):
        own = np.frombuffer(zlib.decompress(body), np.int64)
        key.append(np.flatnonzero(own) + part * 2 * _PART)
        n.append(own[own > 0])
    code = Code([], (np.concatenate(key), np.concatenate(n)))
    sent = context.broadcast(code)
    counts = Counts(_summed_parts(few, _tables(sent)))
    both = context.broadcast((code, counts))
    cells = np.zeros(2 * GATES * LEVELS**K + -2 * GATES * LEVELS**K % (2 * _PART), np.int64)
    for part, body in _summed_parts(text, _cells(both)).items():
        cells[part * 2 * _PART : (part + 1) * 2 * _PART] = np.frombuffer(zlib.decompress(body), np.int64)
    both.destroy()
    return fit(cells[: 2 * GATES * LEVELS**K], [c.reshape(-1, 2) for c in counts.tables()], code, rounds)


class _Block:
    """Words of a block of texts with their spelled costs, and the texts' rows."""

    def __init__(self):
        self.tok, self.nats, self.count, self.ids, self.train, self.size, self.n = [], [], [], [], [], [], 0

    def add(self, batch, tok, count, nats, size):
        self.tok.append(tok)
        self.nats.append(nats)
        self.count.append(count)
        self.ids.append(batch.column(0))
        self.train.append(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        self.size.append(size)
        self.n += len(tok)

    def rows(self, block: int, ranges: int) -> pa.RecordBatch:
        """The block's own row (dest null), and for each range its distinct words with their count in training texts."""
        count, train = np.concatenate(self.count), np.concatenate(self.train)
        words, index = _distinct(np.concatenate(self.tok))
        learned = np.bincount(index, weights=np.repeat(train, count), minlength=len(words)).astype(np.uint32)
        edge = np.searchsorted(words, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
        edge = np.concatenate(([0], edge, [len(words)]))
        ids = pa.concat_arrays(self.ids)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        own = _packed(ids.fill_null(0).to_numpy(), known, train, count.astype(np.int64), np.concatenate(self.size).astype(np.int64), *_thin(index, np.concatenate(self.nats), len(words)))
        dest, body = [None], [own]
        for r in np.flatnonzero(np.diff(edge)).tolist():
            a, b = int(edge[r]), int(edge[r + 1])
            dest.append(r)
            body.append(_packed(np.array([a], np.int64), words[a:b], _small(learned[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(np.full(len(dest), block), pa.int64()), pa.array(body, pa.binary())], names=["dest", "block", "body"])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like np.unique with the inverse, but only what is distinct is sorted."""
    coded = pa.array(x).dictionary_encode()
    words = coded.dictionary.to_numpy()
    order = np.argsort(words)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return words.take(order), rank.take(coded.indices.to_numpy())


_FINE = 1024  # parts of a nat that a token's cost is kept in


def _thin(index: np.ndarray, nats: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Places below ``most`` in as many bytes as they need, costs in two; costs that need more beside them."""
    wide = 3 if most < 1 << 24 else 4
    places = np.ascontiguousarray(index.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide])
    parts = np.rint(nats * _FINE)
    far = np.flatnonzero(parts >= 0xFFFF)
    parts[far] = 0xFFFF
    return places, parts.astype("<u2"), nats[far].astype(np.float64)


def _thick(places: np.ndarray, parts: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(parts), 4), np.uint8)
    if len(parts):
        wide[:, : len(places) // len(parts)] = places.reshape(len(parts), -1)
    nats = parts.astype(np.float64) / _FINE
    nats[parts == 0xFFFF] = far
    return wide.view("<u4")[:, 0], nats


def _packed(*arrays: np.ndarray) -> bytes:
    bodies = [a.tobytes() for a in arrays]
    return np.array([len(x) for x in bodies], np.int64).tobytes() + b"".join(bodies)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts, most of them small, as compressed bytes."""
    return np.frombuffer(zlib.compress(counts.tobytes(), 1), np.uint8)


def _counts(body: np.ndarray, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(body.tobytes()), kind)


def _unpacked(body: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(body, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


_SENT = "dest int, block long, body binary"


def _spelled(sent, ranges: int):
    def run(batches):
        model = sent.value
        number, block = 0, _Block()
        part = TaskContext.get().partitionId()
        for batch, data, off in B.rows_of(batches, SCORED, "text"):
            low = lowered(data)
            nats = model.token_costs(low, off)
            s, e = B.spans(low, off)
            at = np.searchsorted(s, off)
            # Words of each text, then its end token.
            n = len(off) - 1
            tok = np.full(len(s) + n, END_TOKEN, np.uint64)
            tok[np.arange(len(s)) + np.repeat(np.arange(n), np.diff(at))] = B.span_hash(low, s, e)
            block.add(batch, tok, np.diff(at) + 1, nats, np.diff(off))
            if block.n >= TOKENS_A_BLOCK:
                yield block.rows((part << 24) + number, ranges)
                number, block = number + 1, _Block()
        if block.ids:
            yield block.rows((part << 24) + number, ranges)

    return run


_COUNTED = "block long, body binary, n long, v long"


def _looked_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a range's words over all blocks, for each block; once also their sum and how many there are."""
    blocks, asked = [], []
    for batch in batches:
        blocks += batch.column("block").to_pylist()
        asked += [(at, u, _counts(c, np.uint32)) for at, u, c in (_unpacked(x, np.int64, np.uint64, np.uint8) for x in batch.column("body").to_pylist())]
    words, back = np.unique(np.concatenate([u for _, u, _ in asked]), return_inverse=True)
    count = np.bincount(back, weights=np.concatenate([c for _, _, c in asked]), minlength=len(words)).astype(np.int64)
    out, begin = [], 0
    for at, u, _ in asked:
        out.append(_packed(at, _small(count[back[begin : begin + len(u)]])))
        begin += len(u)
    n, v = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
    n[0], v[0] = count.sum(), (count > 0).sum()
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary()), pa.array(n), pa.array(v)], names=["block", "body", "n", "v"])


def mixed(spell: np.ndarray, share: np.ndarray, known: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log probability of each token from that of its spelling and of its share of all words.

    ``begin`` is where the token's text begins. The gate of a token is the logistic of TRUST times what
    the share gained over the spelling on up to RECENT tokens before it.
    """
    gain = np.where(known, np.clip(share - spell, -8, 8), -8.0)
    so_far = np.concatenate(([0.0], np.cumsum(gain)))
    at = np.arange(len(spell))
    lead = TRUST * (so_far[at] - so_far[np.maximum(begin, at - RECENT)])
    gate = np.clip(1 / (1 + np.exp(-lead)), 0.01, 0.99)
    spelled = np.log1p(-gate) + spell
    return np.where(known, np.logaddexp(np.log(gate) + share, spelled), spelled)


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double, bits_per_byte double"


def _summed(train_tokens: int, distinct: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers = None, []
        for batch in batches:
            for mine, body in zip(batch.column("mine").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if mine:
                    own = _unpacked(body, np.int64, bool, bool, np.int64, np.int64, np.uint8, np.dtype("<u2"), np.float64)
                else:
                    at, c = _unpacked(body, np.int64, np.uint8)
                    answers.append((at, _counts(c, np.int64)))
        ids, known_id, train, n_tokens, size, *thin = own
        index, nats = _thick(*thin)
        count = np.zeros(sum(len(c) for _, c in answers), np.int64)
        for at, c in answers:
            count[at[0] : at[0] + len(c)] = c
        c = count[index]
        total = np.log(train_tokens + distinct + 1)
        share = np.log(c + 1) - total
        begin = np.cumsum(n_tokens) - n_tokens
        # A text has its end token at least, so no sum is over nothing.
        base = np.add.reduceat(share, begin) / np.log(10)
        n_known = np.add.reduceat((c > 0).astype(np.int64), begin)
        score = np.add.reduceat(mixed(-nats, share, c > 0, np.repeat(begin, n_tokens)), begin) / np.log(10)
        bits = -score / np.log10(2)
        columns = [pa.array(ids, pa.int64(), mask=~known_id), pa.array(~train), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(base), pa.array(score), pa.array(bits), pa.array(bits / np.maximum(size, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits", "bits_per_byte"])

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits (of the whole text) and bits_per_byte of each document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_training().alias("train"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(src.select("doc_id", "text"), rounds))
    ranges = max(16, 2 * src.rdd.getNumPartitions())
    sent = cut(src.mapInArrow(_spelled(model, ranges), _SENT))
    back = cut(sent.where("dest is not null").groupBy("dest").applyInArrow(_looked_up, _COUNTED))
    n, v = back.agg(F.sum("n"), F.sum("v")).first()
    both = sent.where("dest is null").select("block", F.lit(True).alias("mine"), "body").unionByName(back.select("block", F.lit(False).alias("mine"), "body"))
    return both.groupBy("block").applyInArrow(_summed(n or 0, v or 0), _RESULT)
