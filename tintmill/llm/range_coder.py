"""An adaptive context-mixing range coder for token ids, in independent blocks.

Three predictions meet for each id. Order 2 and order 1 each name the id that last followed the same
two ids or the same one; order 0 knows how often each id came. How far the first two are trusted is
learned too: the outcomes of each pair of confidences are counted, and these counts are the weights of
the mix. The mixed interval of an id drives a carry-less range coder (64-bit state, 16-bit words).

A block is cut into up to LANES lanes of consecutive ids, which are coded in step over one model: all
lanes code their next id, then the model learns from all of them. So each step is a handful of numpy
calls, and the model is as if it had read the block by columns. Every block starts from an empty model
and carries check sums of its head and of its ids, so it is read without any other.

Block: HEAD (magic, ids, lanes, vocabulary, words, crc32 of the ids, crc32 of the head before it),
words of each lane (u2), words (u2); all little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 16384, 128
#: Ids of a full block.
BLOCK = LANES * STEPS
HEAD = struct.Struct("<4sIIIII")
MAGIC = b"CMR1"
#: An interval is a part of 2^SCALE, of which order 0 keeps a sixteenth at least; its shares are parts
#: of 2^WHOLE. It is brought up to date after each of the first steps, then every REFRESH steps.
SCALE, WHOLE, REFRESH = 24, 20, 16
HASH, SURE_BITS, TRIALS = 20, 3, 1 << 14
MOST_SURE = (1 << SURE_BITS) - 1
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
WORD, HIGH, ODD = np.uint64(16), np.uint64(48), np.uint64(0x9E3779B97F4A7C15)


class _Model:
    """What the lanes of one block have shown so far."""

    def __init__(self, vocabulary: int):
        self.vocabulary = vocabulary
        # The id that followed, times MOST_SURE + 1, plus how often it was right of late.
        self.told = [np.zeros(vocabulary + 1, np.int32), np.zeros(1 << HASH, np.int32)]
        self.outcomes = np.ones(((MOST_SURE + 1) ** 2 * 2, 3), np.int64)
        self.counts, self.late, self.step = np.zeros(vocabulary, np.int64), [], 0
        self.refresh()

    def refresh(self) -> None:
        """Order 0 from all ids so far: where each id's share of 2^WHOLE begins, each share 1 at least."""
        if self.late:
            self.counts += np.bincount(np.concatenate(self.late), minlength=self.vocabulary)
            self.late = []
        self.before = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(self.counts, out=self.before[1:])
        if total := int(self.before[-1]):
            self.before = (self.before * (((1 << WHOLE) - self.vocabulary) / total)).astype(np.int64)
        self.before += np.arange(self.vocabulary + 1)
        self.before[-1] = 1 << WHOLE
        self.owner = None

    def look(self, last: np.ndarray, prior: np.ndarray) -> None:
        """Predictions and weights after the ids prior, last of each lane."""
        pair = (last.astype(np.uint64) << WORD | prior.astype(np.uint64)) * ODD >> np.uint64(64 - HASH)
        self.at = [last, pair.astype(np.int64)]
        told = [self.told[k][self.at[k]] for k in (0, 1)]
        self.said = [x >> SURE_BITS for x in told]
        self.trust = [x & MOST_SURE for x in told]
        self.state = (self.trust[1] << SURE_BITS | self.trust[0]) << 1 | (self.said[0] == self.said[1])
        shares = self.outcomes * ((1 << SCALE) // 16 * 15) // self.outcomes.sum(axis=1, keepdims=True)
        self.two = shares[:, 2][self.state]
        self.known = (shares[:, 1] + shares[:, 2])[self.state]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the interval of each lane's id."""
        self.right = [ids == self.said[0], ids == self.said[1]]
        self.order = np.where(self.right[1], 2, self.right[0])
        new = np.flatnonzero(self.order == 0)
        return self._bounds(new, ids[new], self.known[new])

    def _bounds(self, new: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all lanes; `new` are those that neither order 2 nor order 1 named."""
        second = self.right[1]
        start, size = np.where(second, 0, self.two), np.where(second, self.two, self.known - self.two)
        rest = (1 << SCALE) - known
        low = self.before[ids] * rest >> WHOLE
        start[new] = known + low
        size[new] = (self.before[ids + 1] * rest >> WHOLE) - low
        return start, size

    def found(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id of each lane in whose interval the place lies, and start and size of that interval."""
        if self.owner is None:
            self.owner = np.repeat(np.arange(self.vocabulary, dtype=np.int32), np.diff(self.before))
        second, named = place < self.two, place < self.known
        self.right = [named & ~second | second & (self.said[0] == self.said[1]), second]
        self.order = np.where(second, 2, named)
        ids = np.where(second, self.said[1], self.said[0]).astype(np.int64)
        new = np.flatnonzero(~named)
        known = self.known[new]
        ids[new] = own = self.owner[((place[new] - known + 1 << WHOLE) - 1) // ((1 << SCALE) - known)]
        return ids, *self._bounds(new, own, known)

    def learn(self, ids: np.ndarray) -> None:
        self.outcomes += np.bincount(self.state * 3 + self.order, minlength=self.outcomes.size).reshape(-1, 3)
        while (full := self.outcomes.sum(axis=1) > TRIALS).any():
            self.outcomes[full] = (self.outcomes[full] + 1) // 2
        for k in (0, 1):
            stays = self.said[k] << SURE_BITS
            right = stays | np.minimum(self.trust[k] + 1, MOST_SURE)
            wrong = np.where(self.trust[k] > 1, stays, ids << SURE_BITS) | self.trust[k] >> 1
            # Where lanes share a context the last lane writes.
            self.told[k][self.at[k]] = np.where(self.right[k], right, wrong)
        self.late.append(ids)
        self.step += 1
        if self.step < 8 or self.step % REFRESH == 0:
            self.refresh()


def _due(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose first word is settled; a span that grew too small is cut so that it is."""
    settled = (low ^ (low + span)) < TOP
    small = np.flatnonzero((span < BOTTOM) & ~settled)
    if len(small):
        span[small] = (~low[small] + np.uint64(1)) & (BOTTOM - np.uint64(1))
        settled[small] = True
    return np.flatnonzero(settled)


def _shape(n: int) -> tuple[int, int]:
    """Steps of a lane, and lanes, for n ids; the last lane may be shorter."""
    steps = max(1, -(-n // min(LANES, max(1, -(-n // STEPS)))))
    return steps, -(-n // steps)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """ids (below vocabulary, at most 65,536 kinds) as one block."""
    n = len(ids)
    if vocabulary > 1 << 16 or vocabulary < 1 or (n and (ids.min() < 0 or ids.max() >= vocabulary)):
        raise ValueError("an id is outside the vocabulary, or the vocabulary beyond 16 bits")
    steps, lanes = _shape(n)
    grid = np.zeros(steps * lanes, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    last = prior = np.full(lanes, vocabulary, np.int64)
    whose, words = [], []
    for step in range(steps if n else 0):
        have = lanes if (lanes - 1) * steps + step < n else lanes - 1
        own = grid[step, :have]
        model.look(last[:have], prior[:have])
        start, size = model.interval(own)
        unit = span[:have] >> np.uint64(SCALE)
        low[:have] += unit * start.astype(np.uint64)
        span[:have] = unit * size.astype(np.uint64)
        while len(due := _due(low[:have], span[:have])):
            whose.append(due)
            words.append((low[due] >> HIGH).astype(np.uint16))
            low[due] <<= WORD
            span[due] <<= WORD
        model.learn(own)
        last, prior = own, last[:have]
    if n:  # the two words that begin the first multiple of 2^32 in what is left
        end = (low + (BOTTOM - np.uint64(1))) >> np.uint64(32)
        for shift in (16, 0):
            whose.append(np.arange(lanes))
            words.append((end >> np.uint64(shift)).astype(np.uint16))
    lane, flat = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (whose, words))
    flat = flat[np.argsort(lane.astype(np.uint16), kind="stable")].astype("<u2")
    sizes = np.bincount(lane, minlength=lanes).astype("<u2") if n else np.zeros(0, "<u2")
    head = HEAD.pack(MAGIC, n, vocabulary, lanes if n else 0, len(flat), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + struct.pack("<I", zlib.crc32(head + sizes.tobytes())) + sizes.tobytes() + flat.tobytes()


def decode(read) -> np.ndarray | None:
    """The ids of the next block; read(n) gives up to n bytes. None at the end; ValueError if a check fails."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or head[:4] != MAGIC:
        raise ValueError("no block begins here")
    _, n, vocabulary, lanes, words, crc = HEAD.unpack(head)
    check, sizes = read(4), read(2 * lanes)
    if check != struct.pack("<I", zlib.crc32(head + sizes)):
        raise ValueError("the head of a block is damaged")
    flat = np.frombuffer(read(2 * words), "<u2")
    if len(flat) < words:
        raise ValueError("a block ends early")
    if not n:
        return np.zeros(0, np.int64)
    flat = np.concatenate([flat, np.zeros(1, "<u2")]).astype(np.uint64)  # what lies beyond a lane's words reads as 0
    ends = np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64))
    at = ends - np.frombuffer(sizes, "<u2")

    def more(code: np.ndarray, due: np.ndarray) -> None:
        code[due] = code[due] << WORD | flat[np.where(at[due] < ends[due], at[due], words)]
        at[due] += 1

    steps = _shape(n)[0]
    grid = np.zeros((steps, lanes), np.int64)
    model = _Model(vocabulary)
    low, span, code = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        more(code, np.arange(lanes))
    last = prior = np.full(lanes, vocabulary, np.int64)
    for step in range(steps):
        have = lanes if (lanes - 1) * steps + step < n else lanes - 1
        model.look(last[:have], prior[:have])
        unit = span[:have] >> np.uint64(SCALE)
        place = np.minimum((code[:have] - low[:have]) // unit, np.uint64((1 << SCALE) - 1)).astype(np.int64)
        own, start, size = model.found(place)
        low[:have] += unit * start.astype(np.uint64)
        span[:have] = unit * size.astype(np.uint64)
        while len(due := _due(low[:have], span[:have])):
            more(code, due)
            low[due] <<= WORD
            span[due] <<= WORD
        model.learn(own)
        grid[step, :have] = own
        last, prior = own, last[:have]
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids of a block are damaged")
    return ids
