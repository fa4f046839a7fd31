"""Adaptive statistics, many blocks at a time.

A lane is a block.  All lanes take the same step at once, so that numpy does the work of a step
for all of them; a lane that has ended stands by.  Encoder and decoder run the same model over
the same bytes, hence no table is stored.  Bytes that repeat earlier ones are copied, not
coded, but the model learns from them too, so that every context is of the bytes that stand there.
"""

from __future__ import annotations

import copy
from bisect import insort
from collections.abc import Callable

import numpy as np

from .coding import LOW, SCALE, SCALE_BITS, Decoder, Encoder
from .transforms import CorruptBlock

# Sizes, thresholds and rates of the models.
ROWS, COUNT_CAP = 4096, 256
LEAST1, LEAST2, LEAST3 = 2, 4, 6
TABLE_BITS, RATE, DECAY = 13, 0.02, 0.995
MASTER_RATE = 0.005  # of the mixer of mixers
_HASH = 0x9E3779B1


def hashed(*parts: np.ndarray | int, bits: int = 12) -> np.ndarray:
    """A hash of small numbers, for each lane."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = (x * np.uint64(0x100000001B3)) ^ np.asarray(p).astype(np.uint64)
        x = (x * np.uint64(_HASH)) & np.uint64(0xFFFFFFFFFFFF)
    return (x >> np.uint64(48 - bits)).astype(np.int64)


#: Sums of what is before each 16th of 256 numbers, and before each of 16, as products of matrices.
_BLOCKS = (np.arange(256)[:, None] // 16 < np.arange(16)).astype(np.float32)
_BEFORE = (np.arange(16)[:, None] < np.arange(16)).astype(np.float32)
_PLACES = np.arange(16, dtype=np.float32)


class Sizes:
    """Sizes that sum to the scale: one for each byte, the rest by counts, what is left to the last byte.

    Products are whole and below 2**20.  A quotient that is not whole is a total's inverse away from
    the next number at least, which is more than single precision rounds by; so it rounds down right.
    """

    def __init__(self, counts: np.ndarray, total: np.ndarray):
        share = counts.astype(np.float32)
        share *= SCALE - 256
        share /= np.maximum(total, 1).astype(np.float32)[:, None]
        self.share = np.floor(share, out=share)
        self.blocks = self.share @ _BLOCKS + 16 * _PLACES
        self.lane = np.arange(len(counts))

    def _ends(self, byte: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = start.astype(np.int64)
        return start, np.where(byte == 255, SCALE - start, self.share[self.lane, byte].astype(np.int64) + 1)

    def of(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of a byte in each lane."""
        block, place = byte >> 4, byte & 15
        inner = self.share.reshape(-1, 16, 16)[self.lane, block]
        inner *= _PLACES < place[:, None]
        return self._ends(byte, self.blocks[self.lane, block] + inner.sum(axis=1) + place)

    def find(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The byte of each lane whose size holds a slot, with its start and size."""
        slot = slot.astype(np.float32)[:, None]
        block = np.count_nonzero(self.blocks <= slot, axis=1) - 1
        starts = self.share.reshape(-1, 16, 16)[self.lane, block] @ _BEFORE + (self.blocks[self.lane, block][:, None] + _PLACES)
        place = np.count_nonzero(starts <= slot, axis=1) - 1
        byte = block * 16 + place
        return byte, *self._ends(byte, starts[self.lane, place])


def concentrated(t1, d1, t2, d2):
    """Order 2, 1 or 0: the highest that has been seen enough and is not more spread than the next."""
    second = (t2 >= LEAST2) & ((t1 < LEAST1) | (t2 * (d1 + 1) >= t1 * (d2 + 1)))
    return np.where(second, 2, np.where(t1 >= LEAST1, 1, 0))


def concentrated_deep(t1, d1, t2, d2, t3, d3):
    third = (t3 >= LEAST3) & ((t2 < LEAST2) | (t3 * (d2 + 1) >= t2 * (d3 + 1))) & ((t1 < LEAST1) | (t3 * (d1 + 1) >= t1 * (d3 + 1)))
    return np.where(third, 3, concentrated(t1, d1, t2, d2))


_PAIRS = np.zeros(1 << 16, np.uint64)  # what hashed() has of two bytes before its shift
for _part in (np.arange(1 << 16, dtype=np.uint64) >> np.uint64(8), np.arange(1 << 16, dtype=np.uint64) & np.uint64(255)):
    _PAIRS = ((_PAIRS * np.uint64(0x100000001B3) ^ _part) * np.uint64(_HASH)) & np.uint64(0xFFFFFFFFFFFF)


class ByteModel:
    """The next byte of each lane from the best of orders 0 to 2, or to 3 if deep.

    Lanes go by falling size, so that those that have not ended stand in front.  A context's
    counts of the byte that follows get a row when it is first seen; a row halves when a count
    passes the cap.
    """

    def __init__(self, sizes: np.ndarray, deep: bool):
        self.rows = [1, 256, ROWS, ROWS][: 4 if deep else 3]
        first = np.cumsum([0, *self.rows])
        self.base = np.arange(len(sizes)) * first[-1] + first[:-1, None]
        self.row = np.zeros(len(sizes) * int(first[-1]), np.int32)  # by lane, order and context; 0 is never counted in
        self.most = 1 + int(sum(np.minimum(sizes, n).sum() for n in self.rows))
        self.count, self.total, self.distinct, self.used = np.zeros((0, 256), np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        self._grow(1)
        self.last = np.zeros((3, len(sizes)), np.int64)

    def _grow(self, need: int) -> None:
        """Room for so many rows at least; it doubles, up to what the blocks can ever need."""
        if need > len(self.count):
            more = min(self.most, max(need, 2 * len(self.count), 1024)) - len(self.count)
            self.count = np.concatenate([self.count, np.zeros((more, 256), np.uint16)])
            self.total, self.distinct = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.total, self.distinct))

    def look(self, live: int) -> None:
        """Takes up the contexts of the first lanes."""
        a, b, c = self.last[:, :live]
        pair = _PAIRS[a << 8 | b]
        self.at = self.base[:, :live].copy()
        self.at[1] += a
        self.at[2] += (pair >> np.uint64(36)).astype(np.int64)
        if len(self.rows) > 3:
            third = (pair * np.uint64(0x100000001B3) ^ c.astype(np.uint64)) * np.uint64(_HASH)
            self.at[3] += ((third & np.uint64(0xFFFFFFFFFFFF)) >> np.uint64(36)).astype(np.int64)
        self.own = self.row[self.at].astype(np.int64)

    def predict(self, lanes: np.ndarray) -> Sizes:
        """Sizes of all bytes in some of the lanes."""
        own = self.own[:, lanes]
        total, distinct = self.total[own], self.distinct[own]
        pick = (concentrated_deep if len(own) > 3 else concentrated)(*(x[k] for k in range(1, len(own)) for x in (total, distinct)))
        chosen = own[pick, np.arange(len(lanes))]
        return Sizes(self.count[chosen], self.total[chosen])

    def update(self, byte: np.ndarray) -> None:
        own, at = self.own.reshape(-1), self.at.reshape(-1)
        fresh = np.flatnonzero(own == 0)
        if len(fresh):
            self._grow(self.used + len(fresh))
            own[fresh] = self.row[at[fresh]] = np.arange(self.used, self.used + len(fresh))
            self.used += len(fresh)
        cell = ((self.own << 8) + byte).reshape(-1)
        count = self.count.reshape(-1)
        now = count[cell] + np.uint16(1)
        count[cell] = now
        self.total[own] += 1
        self.distinct[own] += now == 1
        full = np.flatnonzero(now > COUNT_CAP)
        if len(full):
            rows = own[full]
            half = self.count[rows] >> 1
            self.count[rows], self.total[rows], self.distinct[rows] = half, half.sum(axis=1), np.count_nonzero(half, axis=1)
        n = len(byte)
        self.last[1:, :n] = self.last[:2, :n].copy()
        self.last[0, :n] = byte


#: So many lanes or fewer go on alone, byte by byte: then a step of numpy takes longer than theirs in plain Python.
ALONE = 40
_SECOND, _PAIRS_LIST = (_PAIRS >> np.uint64(36)).tolist(), _PAIRS.tolist()


class Lane:
    """The byte model of one lane in plain Python, taken over from a :class:`ByteModel` at a step, or from the start.

    A row is what followed a context, in order, how often, and the sum of it.
    """

    def __init__(self, deep: bool, model: ByteModel | None = None, lane: int = 0):
        self.rows: list[dict[int, list]] = [{} for _ in range(4 if deep else 3)]
        self.last = [0, 0, 0] if model is None else model.last[:, lane].tolist()
        for k, order in enumerate(self.rows if model else ()):
            own = model.row[model.base[k, lane] : model.base[k, lane] + model.rows[k]]
            contexts = np.flatnonzero(own)
            counts = model.count[own[contexts]]
            which, byte = np.nonzero(counts)
            ends, seen, times = np.cumsum(np.bincount(which, minlength=len(contexts))).tolist(), byte.tolist(), counts[which, byte].tolist()
            at = 0
            for context, total, end in zip(contexts.tolist(), model.total[own[contexts]].tolist(), ends):
                order[context] = [seen[at:end], dict(zip(seen[at:end], times[at:end])), total]
                at = end

    def run(self, data: bytearray, back: list[int], first: int, coded: tuple | None = None) -> tuple[list[int], list[int]] | tuple[int, int]:
        """Goes over the bytes from ``first`` on.

        Returns starts and sizes of the coded ones; or, of ``coded``, a state, words and the place of
        the next, puts the bytes into ``data`` and returns state and place.
        """
        zeros, ones, twos = self.rows[:3]
        threes = self.rows[3] if len(self.rows) > 3 else None
        a, b, c = self.last
        starts, sizes = [], []
        state, words, place = coded or (0, (), 0)
        for i in range(first, len(data)):
            pair = a << 8 | b
            keys = [(zeros, 0), (ones, a), (twos, _SECOND[pair])]
            if threes is not None:
                mixed = ((_PAIRS_LIST[pair] * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF) ^ c) * _HASH
                keys.append((threes, (mixed & 0xFFFFFFFFFFFF) >> 36))
            own = []
            for order, key in keys:
                row = order.get(key)
                if row is None:
                    row = order[key] = [[], {}, 0]
                own.append(row)
            if back[i] == 0:
                r1, r2 = own[1], own[2]
                t1, t2, d1, d2 = r1[2], r2[2], len(r1[0]) + 1, len(r2[0]) + 1
                row = r2 if t2 >= LEAST2 and (t1 < LEAST1 or t2 * d1 >= t1 * d2) else r1 if t1 >= LEAST1 else own[0]
                if threes is not None:
                    t3, d3 = own[3][2], len(own[3][0]) + 1
                    if t3 >= LEAST3 and (t2 < LEAST2 or t3 * d2 >= t2 * d3) and (t1 < LEAST1 or t3 * d1 >= t1 * d3):
                        row = own[3]
                seen, times, total = row
                before, size = 0, 1
                if coded is None:
                    byte = data[i]
                    for x in seen:
                        if x >= byte:
                            if x == byte:
                                size += times[x] * (SCALE - 256) // total
                            break
                        before += times[x] * (SCALE - 256) // total
                    start = before + byte
                else:
                    slot = state & SCALE - 1
                    for x in seen:
                        if slot < before + x:
                            break
                        share = times[x] * (SCALE - 256) // total
                        if slot <= before + x + share or x == 255:
                            byte, size = x, share + 1
                            break
                        before += share
                    else:
                        x = 256
                    if x == 256 or slot < before + x:
                        byte = min(slot - before, 255)
                    start = before + byte
                if byte == 255:
                    size = SCALE - start
                if coded is None:
                    starts.append(start)
                    sizes.append(size)
                else:
                    state = size * (state >> SCALE_BITS) + slot - start
                    if state < LOW:
                        if place >= len(words):
                            raise CorruptBlock("a lane ends early")
                        state, place = state << 16 | words[place], place + 1
                    data[i] = byte
            elif coded is None:
                byte = data[i]
            else:
                byte = data[i] = data[i - back[i]]
            for row in own:
                times = row[1]
                n = times.get(byte)
                row[2] += 1
                if n is None:
                    insort(row[0], byte)
                    times[byte] = 1
                elif n < COUNT_CAP:
                    times[byte] = n + 1
                else:
                    times[byte] = n + 1
                    row[1] = {x: m >> 1 for x, m in times.items() if m > 1}
                    row[0], row[2] = sorted(row[1]), sum(row[1].values())
            a, b, c = byte, a, b
        return (starts, sizes) if coded is None else (state, place)


def _grid(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    grid = np.zeros((int(sizes.max(initial=0)), len(blocks)), np.uint8)
    for k, b in enumerate(blocks):
        grid[: len(b), k] = np.frombuffer(b, np.uint8)
    return grid, sizes


def _sources(sizes: np.ndarray, back: list[np.ndarray] | None) -> np.ndarray:
    """Distances of copied bytes by step and lane; 0 for coded ones, -1 behind the end of a block."""
    grid = np.where(np.arange(int(sizes.max(initial=0)))[:, None] < sizes, np.int32(0), np.int32(-1))
    for k, distance in enumerate(back or ()):
        grid[: len(distance), k] = distance
    return grid


def _live(sizes: np.ndarray) -> list[int]:
    """For each step how many lanes, by falling size, have not ended."""
    return np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0)))).tolist()


def bytes_encode(blocks: list[bytes], deep: bool, back: list[np.ndarray] | None = None) -> list[bytes]:
    """One stream for each block, coded byte by byte where its distances ``back`` are 0."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    grid, sizes = _grid([blocks[k] for k in order])
    source = _sources(sizes, [back[k] for k in order] if back else None)
    model, lanes = None, _live(sizes)
    start, size = np.zeros(grid.shape, np.uint16), np.ones(grid.shape, np.uint16)
    for t, live in enumerate(lanes):
        if live <= ALONE:
            for k in range(live):
                back = source[: sizes[k], k]
                at = t + np.flatnonzero(back[t:] == 0)
                start[at, k], size[at, k] = Lane(deep, model, k).run(bytearray(grid[: sizes[k], k]), back.tolist(), t)
            break
        model = model or ByteModel(sizes, deep)
        byte, coded = grid[t, :live].astype(np.int64), np.flatnonzero(source[t, :live] == 0)
        model.look(live)
        if len(coded):
            start[t, coded], size[t, coded] = model.predict(coded).of(byte[coded])
        model.update(byte)
    del model
    streams = dict(zip(order, _backward(start, size, source == 0, lanes)))
    return [streams[k] for k in range(len(blocks))]


def _backward(start: np.ndarray, size: np.ndarray, live: np.ndarray, lanes: list[int]) -> list[bytes]:
    """Streams of all steps; ``live`` has a row for each eight steps of bits or each step of bytes, of which the first ``lanes`` count."""
    coder, times = Encoder(live.shape[1]), len(start) // max(1, len(live))
    alone = times * next((t for t, n in enumerate(lanes) if n <= ALONE), len(lanes))
    for k in range(lanes[alone // times] if alone < len(start) else 0):
        coder.run(k, *(x[np.repeat(live[alone // times :, k], times)].tolist() for x in (start[alone:, k], size[alone:, k])))
    for t in range(alone - 1, -1, -1):
        n = lanes[t // times]
        now = live[t // times, :n]
        if now.any():
            coder.step(start[t, :n], size[t, :n], now)
    return coder.streams()


def bytes_decode(streams: list[bytes], sizes: list[int], deep: bool, back: list[np.ndarray] | None = None) -> list[bytes]:
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    n = np.array([sizes[k] for k in order], np.int64)
    source = _sources(n, [back[k] for k in order] if back else None)
    model, coder = None, Decoder([streams[k] for k in order])
    out = np.zeros(source.shape, np.uint8)
    for t, live in enumerate(_live(n)):
        if live <= ALONE:
            for k in range(live):
                data, words = bytearray(out[: n[k], k]), coder.words[k, : coder.sizes[k]].tolist()
                coded = int(coder.state[k]), words, int(coder.at[k])
                coder.state[k], coder.at[k] = Lane(deep, model, k).run(data, source[: n[k], k].tolist(), t, coded)
                out[: n[k], k] = np.frombuffer(data, np.uint8)
            break
        model = model or ByteModel(n, deep)
        coded, copied = np.flatnonzero(source[t, :live] == 0), np.flatnonzero(source[t, :live] > 0)
        byte = np.zeros(live, np.int64)
        model.look(live)
        if len(coded):
            first, size = np.zeros(live, np.int64), np.ones(live, np.int64)
            byte[coded], first[coded], size[coded] = model.predict(coded).find(coder.slots(live)[coded])
            coder.step(first, size, source[t, :live] == 0)
        if len(copied):
            byte[copied] = out[t - source[t, copied], copied]
        out[t, :live] = byte
        model.update(byte)
    coder.finish()
    blocks = dict(zip(order, (out[: n[k], k].tobytes() for k in range(len(n)))))
    return [blocks[k] for k in range(len(n))]


# Bits

SPACE, VOWEL, CONSONANT, DIGIT, PUNCT, OTHER = range(6)
CLASS = np.full(256, OTHER)
for _group, _chars in (
    (CONSONANT, "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"), (VOWEL, "aeiouAEIOU"), (DIGIT, "0123456789"),
    (SPACE, " \t\n\r"), (PUNCT, ".,;:!?\"'-()[]{}"),
):
    CLASS[[ord(c) for c in _chars]] = _group

#: A part of a stack: its name, or a function from the model to the numbers, one for each lane,
#: whose hash is a context of the next bit.
Part = str | Callable[["BitModel"], tuple]
Stack = tuple[Part, ...]

#: Models by kind of block.  Each is a context of the next bit, apart from match, ppm and ppmd.
STACKS: dict[str, Stack] = {
    "Text": ("order0", "order1", "order2", "order3", "sparse", "word", "match", "ppm"),
    "Binary": ("order0", "order1", "order2", "sparse", "delta", "match", "ppm"),
    "Exec": ("order0", "order1", "order2", "sparse", "match", "ppm"),
    "baseline": ("order0", "order1", "order2"),
    "ppm3": ("order1", "order2", "order3", "ppm"),
    "ppmd": ("order1", "order2", "order3", "order4", "order6", "order8", "sparse", "ppmd"),
    "indirect": ("order0", "order1", "order2", "indirect"),
}
CONTEXTS: dict[str, Callable[["BitModel"], tuple]] = {
    "order0": lambda m: (0,), "order1": lambda m: (1, m.last[0]), "order2": lambda m: (2, *m.last[:2]), "order3": lambda m: (3, *m.last[:3]),
    "order4": lambda m: (4, *m.last[:4]), "order6": lambda m: (6, *m.last[:6]), "order8": lambda m: (8, *m.last[:8]),
    "sparse": lambda m: (9, m.last[1], m.last[2]), "delta": lambda m: (10, m.last[0], (m.last[0] - m.last[1]) & 255),
    "word": lambda m: (11, m.word, m.last[0]),
    "indirect": lambda m: (12, m.after[m.lane, m.last[0] << 8 | m.last[1]].astype(np.int64), m.last[0]),
}
EXTRAS = ("match", "ppm", "ppmd")


def check_stack(stack: Stack) -> Stack:
    """The stack as a tuple, if every part is known and one at least is a context."""
    for part in stack:
        if not callable(part) and part not in CONTEXTS and part not in EXTRAS:
            raise ValueError(f"no such model: {part}")
    if all(part in EXTRAS for part in stack):
        raise ValueError("a stack without a context")
    return tuple(stack)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def bounded(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.minimum(np.maximum(x, low), high)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-bounded(x, -12, 12)))


class Mixer:
    """Weights by context bank; each bit moves them along the gradient of its coding cost."""

    def __init__(self, lanes: int, inputs: int, banks: int, rate: float = RATE, more: float = 0.15):
        self.weight = np.full((lanes, banks, inputs), 1 / max(1, inputs) + more)
        self.rate, self.lane = rate, np.arange(lanes)

    def part(self, first: int, last: int) -> Mixer:
        """A mixer over some of the banks, with the same weights."""
        out = copy.copy(self)
        out.weight = self.weight[:, first:last]
        return out

    def mix(self, inputs: np.ndarray, bank: np.ndarray) -> np.ndarray:
        self.inputs, self.bank = inputs, bank
        self.p = squash((self.weight[self.lane, bank] * inputs).sum(axis=1))
        return self.p

    def update(self, bit: np.ndarray, live: np.ndarray) -> None:
        error = np.where(live, bit - self.p, 0)
        self.weight[self.lane, self.bank] += self.rate * error[:, None] * self.inputs

    def decay(self, by: float = DECAY) -> None:
        self.weight = 1 / self.weight.shape[2] + (self.weight - 1 / self.weight.shape[2]) * by


class Banks:
    """Mixers that choose their weights by context, each by its own, and a master that mixes them.

    The weights of all mixers are one table, read and written once a step.  Only the first
    lanes take part, as many as there are inputs.
    """

    def __init__(self, lanes: int, inputs: int, sizes: tuple[int, ...]):
        whole, ends = Mixer(lanes, inputs, sum(sizes)), np.cumsum(sizes)
        self.mixers = [whole.part(end - n, end) for n, end in zip(sizes, ends)]
        self.master = Mixer(lanes, len(sizes), 1, MASTER_RATE, 0.0)
        self.rows, self.rate = whole.weight.reshape(-1, inputs), whole.rate
        self.first = (ends - sizes)[:, None] + np.arange(lanes) * ends[-1]

    def mix(self, inputs: np.ndarray, banks: tuple[np.ndarray, ...]) -> np.ndarray:
        n = len(inputs)
        self.inputs, self.at = inputs, self.first[:, :n] + np.stack(banks)
        self.own = self.rows.take(self.at, axis=0)
        self.parts = squash((self.own * inputs).sum(axis=2))
        self.seen, self.above = stretch(bounded(self.parts, 1e-4, 1 - 1e-4)), self.master.weight[:n, 0].T
        self.p = squash((self.above * self.seen).sum(axis=0))
        return self.p

    def update(self, bit: np.ndarray, live: np.ndarray | bool = True) -> None:
        self.own += (self.rate * np.where(live, bit - self.parts, 0))[:, :, None] * self.inputs
        self.rows[self.at] = self.own
        self.above += self.master.rate * np.where(live, bit - self.p, 0) * self.seen


class Refiner:
    """A probability corrected by what came of like ones in a small context, between two bins.

    ``context`` has a number for each lane, or a row of them for each of several corrections.
    """

    BINS = 33

    def __init__(self, lanes: int, contexts: int, rate: float = 0.02):
        grid = squash((np.arange(self.BINS) - 16) / 2)
        self.table = np.tile(grid, lanes * contexts)
        self.rate, self.first = rate, np.arange(lanes) * contexts

    def refine(self, p: np.ndarray, context: np.ndarray) -> np.ndarray:
        x = bounded(stretch(p), -7.99, 7.99) * 2 + 16
        low = x.astype(np.int64)
        part, self.at = x - low, (self.first[: len(p)] + context) * self.BINS + low
        self.low, self.high = self.table.take(self.at), self.table.take(self.at + 1)
        return (1 - part) * self.low + part * self.high

    def update(self, bit: np.ndarray, live: np.ndarray | bool = True) -> None:
        rate = np.where(live, self.rate, 0.0)
        self.table[self.at] = self.low + rate * (bit - self.low)
        self.table[self.at + 1] = self.high + rate * (bit - self.high)


class BitModel:
    """The next bit of each lane: a stack of models, mixed by class, by byte and at large, then refined by three contexts.

    Lanes go by falling size; those that have ended are cut off by :meth:`narrow`.  The counts
    of zeros and ones of a context are one 64-bit cell.
    """

    def __init__(self, lanes: int, stack: Stack):
        self.names = [m for m in check_stack(stack) if m not in EXTRAS]
        self.extra = [m for m in stack if m in EXTRAS]
        size, models = 1 << TABLE_BITS, len(self.names)
        self.counts = np.full(2 * lanes * models * size, 0.4, np.float32).view(np.uint64)
        self.table = np.arange(models)[:, None] * size + np.arange(lanes) * models * size
        self.orders = [k for k, m in enumerate(self.names) if isinstance(m, str) and m.startswith("order")]
        self.lane, self.lanes = np.arange(lanes), lanes
        self.mixer = Banks(lanes, len(stack), (6 * 256, 256, 1))
        self.first, self.second = Refiner(lanes, 256), Refiner(lanes, 2048)
        self.last = np.zeros((8, lanes), np.int64)
        self.word = np.zeros(lanes, np.int64)
        self.after = np.zeros((lanes, 65536), np.uint8)
        self.history = np.zeros((lanes, 1 << 12), np.uint8)
        self.length = 0
        self.place = np.full((lanes, 1 << 12), -1, np.int64)
        self.pointer = np.full(lanes, -1, np.int64)
        self.run = np.zeros(lanes, np.int64)
        self._begin()

    def narrow(self, live: int) -> None:
        """Goes on with the first lanes only."""
        if live < self.lanes:
            self.lanes, self.table, self.last = live, self.table[:, :live], self.last[:, :live]
            self.lane, self.word, self.pointer, self.run = (x[:live] for x in (self.lane, self.word, self.pointer, self.run))
            self._begin()

    def _begin(self) -> None:
        """What stays the same for the bits of a byte: contexts, and the byte that followed the same four bytes."""
        self.node, self.depth = np.ones(self.lanes, np.int64), 0
        made = [CONTEXTS.get(m, m)(self) for m in self.names]
        zero = np.zeros(self.lanes, np.int64)
        self.base = np.stack([hashed(*parts, zero, bits=30) for parts in made])
        self.bank, self.none = CLASS[self.last[0]] * 256, zero
        self.thrice, self.held = self.last[0] * 3, 1024 + (np.minimum(self.run, 3) << 8)
        if "match" in self.extra:
            self.guess = self.history[self.lane, self.pointer & 4095].astype(np.int64) | 256
            self.sure = np.where(self.pointer >= 0, np.minimum(self.run, 15) / 4.0 + 0.5, 0.0)

    def _cells(self) -> np.ndarray:
        x = (self.base + self.node * 0x2F0B4C47) & 0x3FFFFFFF
        x ^= x >> 13
        x &= (1 << TABLE_BITS) - 1
        x += self.table
        return x

    def predict(self) -> np.ndarray:
        self.cells = self._cells()
        self.seen = self.counts.take(self.cells).view(np.float32).reshape(*self.cells.shape, 2)
        total = self.seen[..., 0] + self.seen[..., 1]
        p = self.seen[..., 1] / total
        inputs = np.empty((self.lanes, len(self.names) + len(self.extra)))
        inputs[:, : len(p)] = stretch(p.astype(np.float64)).T
        for k, name in enumerate(self.extra, len(p)):
            inputs[:, k] = self._matched() if name == "match" else self._escaped(p, total, name)
        mixed = bounded(self.mixer.mix(inputs, (self.bank + self.node, self.last[0], self.none)), 1e-4, 1 - 1e-4)
        refined = self.first.refine(mixed, self.node)
        again, last = self.second.refine(bounded(refined, 1e-4, 1 - 1e-4), np.stack([(self.thrice + self.node) & 1023, self.held | self.node]))
        return bounded((2 * mixed + refined + again + last) / 5, 1 / SCALE, 1 - 1 / SCALE)

    def _matched(self) -> np.ndarray:
        """The bit of the byte that followed the same four bytes, the surer the longer that held."""
        fits = self.guess >> (8 - self.depth) == self.node
        return fits * self.sure * (2 * (self.guess >> (7 - self.depth) & 1) - 1)

    def _escaped(self, p: np.ndarray, total: np.ndarray, name: str) -> np.ndarray:
        """Orders blended from the lowest: each gives way to the next by how little it has seen."""
        weight = 0.5 if name == "ppm" else 0.3
        seen = np.maximum(total - 0.8, 0)
        sure = seen / (seen + weight)
        own, rest, out = sure * p, 1 - sure, 0.5
        for k in self.orders:
            out = own[k] + rest[k].astype(np.float64) * out
        return stretch(bounded(out, 1e-4, 1 - 1e-4))

    def update(self, bit: np.ndarray) -> None:
        right = np.stack([bit == 0, bit == 1], axis=1)
        now = np.where(right, np.minimum(self.seen + 1, 250), np.minimum(self.seen, self.seen / 2 + 1))
        self.counts[self.cells] = now.view(np.uint64)[..., 0]
        self.mixer.update(bit)
        self.first.update(bit)
        self.second.update(bit)
        self.node, self.depth = self.node << 1 | bit, self.depth + 1

    def end_byte(self) -> None:
        """Takes the byte that eight bits made into the history of each lane."""
        byte = self.node & 255
        right = (self.pointer >= 0) & (self.history[self.lane, self.pointer & 4095] == byte)
        self.run = np.where(right, self.run + 1, 0)
        self.after[self.lane, self.last[0] << 8 | self.last[1]] = byte
        self.history[: self.lanes, self.length & 4095] = byte
        self.length += 1
        self.last = np.concatenate([byte[None], self.last[:-1]])
        letter = (CLASS[byte] == VOWEL) | (CLASS[byte] == CONSONANT)
        self.word = np.where(letter, hashed(self.word, byte, bits=30), 0)
        key = hashed(*self.last[:4], bits=12)
        at = self.place[self.lane, key]
        keep = right & (self.length - self.pointer - 1 < 4096)
        fresh = np.where((at >= 0) & (self.length - at < 4096), at, -1)
        self.pointer = np.where(keep, self.pointer + 1, fresh)
        self.place[self.lane, key] = self.length
        self._begin()


def bits_encode(blocks: list[bytes], stack: Stack, back: list[np.ndarray] | None = None) -> list[bytes]:
    """One stream for each block, coded bit by bit where its distances ``back`` are 0."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    grid, sizes = _grid([blocks[k] for k in order])
    source = _sources(sizes, [back[k] for k in order] if back else None)
    model = BitModel(len(blocks), stack)
    bits = np.unpackbits(grid[:, None], axis=1).reshape(-1, len(blocks))
    ones = np.ones(bits.shape, np.uint16)
    for t, live in enumerate(_live(sizes)):
        model.narrow(live)
        for b in range(8 * t, 8 * t + 8):
            ones[b, :live] = np.rint(model.predict() * SCALE)
            model.update(bits[b, :live].astype(np.int64))
        model.end_byte()
    del model
    start, size = np.where(bits, np.uint16(0), ones), np.where(bits, ones, np.uint16(SCALE) - ones)
    streams = dict(zip(order, _backward(start, size, source == 0, _live(sizes))))
    return [streams[k] for k in range(len(blocks))]


def bits_decode(streams: list[bytes], sizes: list[int], stack: Stack, back: list[np.ndarray] | None = None) -> list[bytes]:
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    n = np.array([sizes[k] for k in order], np.int64)
    source = _sources(n, [back[k] for k in order] if back else None)
    model, coder, lane = BitModel(len(streams), stack), Decoder([streams[k] for k in order]), np.arange(len(streams))
    out = np.zeros(source.shape, np.uint8)
    for t, live in enumerate(_live(n)):
        model.narrow(live)
        coded = source[t, :live] == 0
        copied = None if coded.all() else out[t - np.maximum(source[t, :live], 0), lane[:live]].astype(np.int64)
        for b in range(8):
            ones = np.rint(model.predict() * SCALE).astype(np.int64)
            one = coder.slots(live) < ones
            if copied is not None:
                one = np.where(coded, one, copied >> (7 - b) & 1 > 0)
            coder.step(np.where(one, 0, ones), np.where(one, ones, SCALE - ones), coded)
            model.update(one.astype(np.int64))
        out[t, :live] = model.node & 255
        model.end_byte()
    coder.finish()
    done = dict(zip(order, (out[: n[k], k].tobytes() for k in range(len(n)))))
    return [done[k] for k in range(len(n))]
