"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

A block of ids is coded on its own: all models start anew, and a checksum of
its ids is kept with it.  Per id

* order 2 and order 1 each predict an id, the one that last followed the same
  two ids or one id, with a confidence: whether it came true when last tried, or the
  time before;
* one of three symbols tells whether the preferred prediction holds, or else
  whether order 0 knows the id.  The probability of the prediction is mixed from
  three adaptive ones, by the order-2 confidence, by the order-1 confidence, and
  by the recent hits alone, weighted by how well each has done lately;
* an id that isn't predicted is coded by order 0, under the frequencies of the ids
  before it in the block; one that is new there is put in a list beside the code.

Predictions are learned with every id; probabilities are brought up to date every
REFRESH ids at most, and order 0 whenever the block has grown to twice its size or less (TABLES).

The arithmetic is a range coder with 48-bit registers that puts out one 16-bit word
at most per id; carries are added when all words are there.  Blocks are the lanes of
numpy arrays: step t handles id t of every block, so the work per step is a fixed
number of array operations.  What doesn't depend on the step before is done for
some steps at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 4096
LANES = 1536
#: total of the probabilities, as a power of two
SCALE_BITS = 15
SCALE = 1 << SCALE_BITS
MAGIC = b"IDB3"
#: steps between two updates of the probabilities: at most; half of it in the first EARLY steps
REFRESH, EARLY = 128, 512
#: steps at which order 0 takes up the ids so far; the probabilities are updated there, too
TABLES = (64, 128, 256, 512, 896, 1536, 2560)
#: lanes whose ids are sorted together, so that they stay in a cache
_SORTED = 64

#: the range is at least this before a step; the least share of the ids that order 0 knows keeps it so
_LEAST, _LEAST_OLD = 1 << 32, SCALE // 16
_SLOT_BITS = 10
_MIX1, _MIX2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


class Models:
    """The adaptive state of all lanes."""

    def __init__(self, lanes: int):
        both = np.arange(2 * lanes).reshape(2, lanes)
        self.lanes = lanes
        self.known = np.zeros(2 * lanes << _SLOT_BITS, np.int32)  # id * 4 + confidence, by order-1 and order-2 context
        self.first = both << _SLOT_BITS
        self.at = self.first.copy()
        self.mixed = np.zeros((2, lanes), np.uint32)
        self.two = np.zeros(lanes, np.uint32)
        self.entry, self.sure = np.zeros((2, lanes), np.int32), np.zeros((2, lanes), np.int32)
        # probabilities that the prediction holds: by order-2 and by order-1 confidence, alone; that another id is new
        self.by2, self.by1 = np.full((lanes, 4), 0.25), np.full((lanes, 4), 0.25)
        self.alone, self.new = np.full((lanes, 1), 0.25), np.full((lanes, 1), 0.9)
        self.loss = [np.ones((lanes, 1)) for _ in range(3)]
        self.lane16 = np.arange(lanes) * 16
        self._mix()

    def predict(self, context: np.ndarray) -> np.ndarray:
        """Preferred ids; puts the confidences, as order 2 * 4 + order 1, in context."""
        entry, sure = self.entry, self.sure
        self.known.take(self.at, out=entry, mode="clip")
        np.bitwise_and(entry, 3, out=sure)
        np.left_shift(sure[1], 2, out=context)
        context += sure[0]
        guess = np.where(sure[1] > 0, entry[1], entry[0])
        guess >>= 2
        return guess

    def learn(self, ids: np.ndarray) -> None:
        """Take up the right ids (int32)."""
        entry, sure = self.entry, self.sure
        # masks in place of conditions: 3 where the id was known; all bits where another one may stay, a point less sure
        value = ids << 2
        same = entry ^ value
        same -= 4
        same >>= 31
        same &= 3
        np.left_shift(entry, 30, out=sure)
        sure >>= 31
        value |= 1
        entry -= 1
        entry ^= value
        entry &= sure
        entry ^= value
        entry |= same
        self.known[self.at] = entry
        one, mixed = ids.view(np.uint32), self.mixed
        np.multiply(one, _MIX1, out=mixed[0])
        np.add(mixed[0], self.two, out=mixed[1])
        np.multiply(one, _MIX2, out=self.two)
        mixed >>= np.uint32(32 - _SLOT_BITS)
        np.add(self.first, mixed, out=self.at)

    def refresh(self, context: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> None:
        """Learn from some steps: context, whether the prediction held, whether the id was new to order 0."""
        n = 16 * self.lanes
        places = context + self.lane16
        places += hit * n
        seen = np.bincount(places.ravel(), minlength=2 * n).reshape(2, self.lanes, 4, 4)
        total, hits = seen[0] + seen[1], seen[1]
        steps = len(context)
        right = hits.sum(axis=(1, 2))[:, None]
        for k, (p, t, h) in enumerate(((self.by2, total.sum(axis=2), hits.sum(axis=2)), (self.by1, total.sum(axis=1), hits.sum(axis=1)), (self.alone, np.full_like(right, steps), right))):
            lost = h * (1 - p) ** 2 + (t - h) * p**2
            sum_ = lost[:, :1].copy()
            for j in range(1, lost.shape[1]):
                sum_ += lost[:, j : j + 1]
            self.loss[k] = self.loss[k] * 0.5 + sum_ / steps + 0.01
            p += (h - t * p) / (t + 8)
        other = steps - right
        self.new += (fresh.sum(axis=0)[:, None] - other * self.new) / (other + 8)
        self._mix()

    def _mix(self) -> None:
        w2, w1, w0 = (1 / x for x in self.loss)
        holds = (self.by2 * w2)[:, :, None] + (self.by1 * w1 + self.alone * w0)[:, None, :]
        holds /= (w2 + w1 + w0)[:, :, None]
        hit = np.clip(holds * SCALE, 64, SCALE - _LEAST_OLD - 64).astype(np.int64)
        rest = SCALE - hit
        new = np.clip(rest * self.new[:, :, None], 64, rest - _LEAST_OLD).astype(np.int64)
        # where the ids that are predicted end, and the new ones
        self.ends = (hit << 16 | (hit + new)).ravel()


def _steps(size: int) -> Iterator[tuple[int, int]]:
    t = 0
    while t < size:
        end = min(t + (REFRESH // 2 if t < EARLY else REFRESH), size)
        yield t, end
        t = end


class Order0:
    """For coding: how many of the ids so far are below an id, and how many are that id."""

    def __init__(self, ids: np.ndarray):
        """ids: (lane, step)."""
        lanes, size = ids.shape
        # of each id, how many other ids of its lane are smaller
        self.rank = np.empty((size, lanes), np.uint16)
        step, width = np.arange(size, dtype=np.uint32), 0
        for k in range(0, lanes, _SORTED):
            order = np.sort((ids[k : k + _SORTED].astype(np.uint32) << 12) | step, axis=1)
            value = order >> 12
            rank = np.zeros(order.shape, np.uint16)
            np.cumsum(value[:, 1:] != value[:, :-1], axis=1, out=rank[:, 1:])
            width = max(width, int(rank[:, -1].max()) + 1)
            order &= 4095
            order += np.arange(len(order), dtype=np.uint32)[:, None] * np.uint32(size)
            placed = np.empty(order.size, np.uint16)
            placed[order] = rank
            self.rank[:, k : k + _SORTED] = placed.reshape(order.shape).T
        self.first = np.arange(lanes) * width
        # id 0 is known at first; it has rank 0 or isn't there
        self.count = np.zeros((lanes, width), np.int32)
        self.count[:, 0] = (ids == 0).any(axis=1)
        self.below = np.zeros((lanes, width), np.int32)
        self.n, self.taken = 1, 0

    def take_up(self, t: int) -> None:
        """The first t ids are known."""
        if not self.taken:
            self.count[:] = 0
        places = self.rank[self.taken : t] + self.first
        self.count += np.bincount(places.ravel(), minlength=self.count.size).reshape(self.count.shape)
        np.cumsum(self.count[:, :-1], axis=1, out=self.below[:, 1:])
        self.n = self.taken = t

    def spans(self, t: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.rank[t:end] + self.first
        return self.below.ravel().take(at), self.count.ravel().take(at)


def _short(size: np.ndarray) -> np.ndarray:
    """All bits where a word is due."""
    short = size - _LEAST
    short >>= 63
    return short


class Writer:
    def __init__(self, lanes: int, symbols: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
        self.width = symbols + 4
        self.out = np.zeros(lanes * self.width, np.int32)
        self.first = np.arange(lanes) * self.width
        self.next = self.first.copy()

    def put(self, start: np.ndarray, size: np.ndarray, old: np.ndarray, below: np.ndarray, count: np.ndarray, n: int) -> None:
        """Narrow to size from start on, of SCALE; where old to count of n ids from below on, in the rest after start."""
        unit = self.range >> SCALE_BITS
        low = self.low
        start = unit * start
        low += start
        fine = self.range
        fine -= start
        fine //= n
        unit *= size
        low += fine * below
        fine *= count
        size = np.where(old, fine, unit)
        top = low >> 32
        self.out[self.next] = top
        short = _short(size)
        self.next -= short
        top &= short
        top <<= 32
        low -= top
        short &= 16
        low <<= short
        np.left_shift(size, short, out=self.range)

    def finish(self) -> list[bytes]:
        for shift, mask in ((32, -1), (16, 0xFFFF), (0, 0xFFFF)):
            self.out[self.next] = (self.low >> shift) & mask
            self.next += 1
        out = self.out.reshape(-1, self.width)
        while (carry := out >> 16).any():
            out &= 0xFFFF
            out[:, :-1] += carry[:, 1:]
        words = out.astype("<u2")
        return [words[k, :n].tobytes() for k, n in enumerate((self.next - self.first).tolist())]


def _encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    by_lane = np.zeros((lanes, sizes.max()), np.int32)
    for k, b in enumerate(blocks):
        by_lane[k, : len(b)] = b
    # a lane that has ended runs on with ids 0
    ids = np.ascontiguousarray(by_lane.T)
    m, w, order0 = Models(lanes), Writer(lanes, len(ids)), Order0(by_lane)
    fresh = np.zeros(ids.shape, bool)
    contexts, hits = np.empty((REFRESH, lanes), np.int32), np.empty((REFRESH, lanes), bool)
    for t, end in _steps(len(ids)):
        if t in TABLES:
            order0.take_up(t)
        context, hit = contexts[: end - t], hits[: end - t]
        for k, now in enumerate(ids[t:end]):
            np.equal(m.predict(context[k]), now, out=hit[k])
            m.learn(now)
        below, count = order0.spans(t, end)
        new = fresh[t:end]
        np.logical_and(count == 0, ~hit, out=new)
        old = ~(hit | new)
        ends = m.ends.take(context + m.lane16)
        first, second = ends >> 16, ends & 0xFFFF
        start = second * old + first * new
        size = np.where(hit, first, second - first)
        below *= old
        for k in range(end - t):
            w.put(start[k], size[k], old[k], below[k], count[k], order0.n)
        m.refresh(context, hit, new)
    code = w.finish()
    fresh &= np.arange(len(ids))[:, None] < sizes
    lists = [by_lane[k, f].astype("<u2").tobytes() for k, f in enumerate(np.ascontiguousarray(fresh.T))]
    return [len(x).to_bytes(2, "little") + x + c for x, c in zip(lists, code, strict=True)]


def _words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words of all lanes, and where each lane begins; a lane may read beyond its end."""
    sizes = np.array([len(d) // 2 for d in data])
    return np.frombuffer(b"".join([*data, bytes(8)]), "<u2").astype(np.int64), np.cumsum(sizes) - sizes


def _table(ids: np.ndarray) -> np.ndarray:
    """Of the ids of each lane (step, lane), sorted: id, how many are below and how many are equal, in one number."""
    n, lanes = ids.shape
    table = np.empty(lanes * n, np.int64)
    for k in range(0, lanes, _SORTED):
        value = np.sort(ids[:, k : k + _SORTED].T.astype(np.uint16), axis=1)
        begins = np.ones(value.shape, bool)
        np.not_equal(value[:, 1:], value[:, :-1], out=begins[:, 1:])
        at = np.flatnonzero(begins)
        size = np.diff(at, append=value.size)
        found = value.ravel()[at].astype(np.int64) << 32 | (at % n) << 16 | size
        table[k * n : k * n + value.size] = np.repeat(found, size)
    return table


def _decode_lanes(data: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    lanes = len(data)
    cuts = [2 + int.from_bytes(d[:2], "little") for d in data]
    lists, place = _words([d[2:c] for d, c in zip(data, cuts, strict=True)])
    words, at = _words([d[c:] for d, c in zip(data, cuts, strict=True)])
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = (code << 16) | words.take(at, mode="clip")
        at += 1
    size = np.full(lanes, (1 << 48) - 1, np.int64)
    ids = np.zeros((max(lengths), lanes), np.int32)
    m, n = Models(lanes), 1
    table, first = np.ones(lanes, np.int64), np.arange(lanes)
    contexts, hits, news = np.empty((REFRESH, lanes), np.int32), np.empty((REFRESH, lanes), bool), np.empty((REFRESH, lanes), bool)
    for t, end in _steps(len(ids)):
        if t in TABLES:
            n = t
            table, first = _table(ids[:t]), np.arange(lanes) * n
        for k in range(end - t):
            guess = m.predict(contexts[k])
            ends = m.ends.take(contexts[k] + m.lane16)
            unit = size >> SCALE_BITS
            hit_end = ends >> 16
            hit_end *= unit
            ends &= 0xFFFF
            ends *= unit
            hit = np.less(code, hit_end, out=hits[k])
            old = code >= ends
            new = np.logical_or(hit, old, out=news[k])
            np.logical_not(new, out=new)
            # among the ids of order 0; exact: both are below 2**48, and the quotient below 2**12
            size -= ends
            size //= n
            rest = code - ends
            value = (rest / size).astype(np.int64)
            value += first
            found = table.take(value, mode="clip")
            below = found >> 16
            below &= 0xFFFF
            below *= size
            below += ends
            low = np.where(old, below, hit_end * new)
            ends -= hit_end
            size *= found & 0xFFFF
            size = np.where(old, size, np.where(hit, hit_end, ends))
            found >>= 32
            now = ids[k + t]
            now[:] = np.where(old, found, np.where(hit, guess, lists.take(place, mode="clip")))
            place += new
            m.learn(now)
            code -= low
            short = _short(size)
            word = words.take(at, mode="clip")
            word &= short
            at -= short
            short &= 16
            size <<= short
            code <<= short
            code |= word
        m.refresh(contexts[: end - t], hits[: end - t], news[: end - t])
    ids = np.ascontiguousarray(ids.T).astype("<u4")
    return [ids[k, :n] for k, n in enumerate(lengths)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block (1 to BLOCK_IDS ids below 2**16) as bytes with magic, length and checksum."""
    out: list[bytes] = [b""] * len(blocks)
    for some in _lanes(blocks):
        for k, body in zip(some, _encode_lanes([blocks[k] for k in some]), strict=True):
            ids = blocks[k].astype("<u4")
            out[k] = MAGIC + len(ids).to_bytes(4, "little") + zlib.crc32(ids.tobytes()).to_bytes(4, "little") + body
    return out


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a damaged one raises ValueError."""
    lengths = []
    for d in data:
        if d[:4] != MAGIC:
            raise ValueError("not a block of ids")
        lengths.append(int.from_bytes(d[4:8], "little"))
        if not 0 < lengths[-1] <= BLOCK_IDS:
            raise ValueError("length of a block of ids is out of bounds")
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(data)
    for some in _lanes(data):
        for k, ids in zip(some, _decode_lanes([data[k][12:] for k in some], [lengths[k] for k in some]), strict=True):
            if zlib.crc32(ids.tobytes()) != int.from_bytes(data[k][8:12], "little"):
                raise ValueError("checksum of a block of ids doesn't match")
            out[k] = ids
    return out


def _lanes(blocks: list) -> Iterator[range]:
    """At most LANES blocks at a time, about as many each time."""
    times = -(-len(blocks) // LANES)
    for k in range(times):
        yield range(k * len(blocks) // times, (k + 1) * len(blocks) // times)
