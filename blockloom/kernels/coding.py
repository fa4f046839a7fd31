"""Range asymmetric numeral systems over numpy lanes, and an order-0 coder on top.

A lane is a 32-bit state that takes part in every step; states give up or take in at most one
16-bit word a step, so that encoder and decoder agree on the order of words.
"""

from __future__ import annotations

import struct

import numpy as np

from .framing import get_varint, put_varint
from .transforms import CorruptBlock

SCALE_BITS = 12
SCALE = 1 << SCALE_BITS
LOW = 1 << 16
LANES = 32


def normalise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to the scale, at least 1 for what occurs; the most frequent takes the rest."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, counts * scale // total), 0)
    excess = int(out.sum()) - scale
    while excess > 0:
        top = int(out.argmax())
        step = min(excess, max(1, int(out[top]) // 2))
        out[top] -= step
        excess -= step
    out[int(counts.argmax())] -= excess
    return out


class Encoder:
    """Takes the steps of all lanes and codes them from the last to the first."""

    def __init__(self, lanes: int):
        self.state = np.full(lanes, LOW, np.uint64)
        self.words: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []

    def step(self, start: np.ndarray, size: np.ndarray, live: np.ndarray) -> None:
        """A step of the first lanes, as many as are given."""
        own, s = self.state[: len(live)], size.astype(np.uint64)
        at = np.flatnonzero(live & (own >> np.uint64(32 - SCALE_BITS) >= s))
        if len(at):
            self.words.append((own[at] & np.uint64(0xFFFF)).astype("<u2"))
            self.owner.append(at)
            own[at] >>= np.uint64(16)
        s = np.where(live, s, np.uint64(1))
        whole = own // s
        x = (whole << np.uint64(SCALE_BITS)) + (own - whole * s) + start.astype(np.uint64)
        own[:] = np.where(live, x, own)

    def run(self, lane: int, start: list[int], size: list[int]) -> None:
        """Many steps of one lane, the last first."""
        state, words = int(self.state[lane]), []
        for k in range(len(start) - 1, -1, -1):
            s = size[k]
            if state >> 32 - SCALE_BITS >= s:
                words.append(state & 0xFFFF)
                state >>= 16
            state = (state // s << SCALE_BITS) + state % s + start[k]
        self.state[lane] = state
        self.words.append(np.array(words[::-1], "<u2"))
        self.owner.append(np.full(len(words), lane))

    def streams(self) -> list[bytes]:
        """For each lane its last state and its words, in the order of decoding."""
        words = np.concatenate(self.words[::-1]) if self.words else np.zeros(0, "<u2")
        owner = np.concatenate(self.owner[::-1]) if self.owner else np.zeros(0, np.int64)
        words, ends = words[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=len(self.state)))
        return [struct.pack("<I", int(x)) + w.tobytes() for x, w in zip(self.state, np.split(words, ends[:-1]))]


class Decoder:
    def __init__(self, streams: list[bytes]):
        if any(len(s) < 4 or len(s) % 2 for s in streams):
            raise CorruptBlock("a lane without its state")
        self.state = np.array([struct.unpack_from("<I", s)[0] for s in streams], np.uint64)
        sizes = [len(s) // 2 - 2 for s in streams]
        self.words = np.zeros((len(streams), max(sizes, default=0) + 1), np.uint64)
        for k, s in enumerate(streams):
            self.words[k, : sizes[k]] = np.frombuffer(s, "<u2", offset=4)
        self.at, self.sizes = np.zeros(len(streams), np.int64), np.array(sizes, np.int64)

    def slots(self, lanes: int | None = None) -> np.ndarray:
        return (self.state[:lanes] & np.uint64(SCALE - 1)).astype(np.int64)

    def step(self, start: np.ndarray, size: np.ndarray, live: np.ndarray) -> None:
        """A step of the first lanes, as many as are given."""
        own = self.state[: len(live)]
        slot = own & np.uint64(SCALE - 1)
        x = size.astype(np.uint64) * (own >> np.uint64(SCALE_BITS)) + slot - start.astype(np.uint64)
        own[:] = np.where(live, x, own)
        at = np.flatnonzero(live & (own < LOW))
        if (self.at[at] >= self.sizes[at]).any():
            raise CorruptBlock("a lane ends early")
        self.state[at] = self.state[at] << np.uint64(16) | self.words[at, self.at[at]]
        self.at[at] += 1

    def finish(self) -> None:
        if (self.state != LOW).any() or (self.at != self.sizes).any():
            raise CorruptBlock("a lane does not end as it began")


def order0_encode(data: bytes) -> bytes:
    """Length, frequencies, then lanes: byte p goes to lane p modulo their number."""
    out = bytearray()
    put_varint(out, len(data))
    if not data:
        return bytes(out)
    body = np.frombuffer(data, np.uint8)
    freq = normalise(np.bincount(body, minlength=256))
    out += np.packbits(freq > 0).tobytes()
    for f in freq[freq > 0].tolist():
        put_varint(out, f)
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    rows = -(-len(body) // LANES)
    grid = np.zeros(rows * LANES, np.int64)
    grid[: len(body)] = body
    live = np.arange(rows * LANES) < len(body)
    grid, live, coder = grid.reshape(rows, LANES), live.reshape(rows, LANES), Encoder(LANES)
    for r in range(rows - 1, -1, -1):
        coder.step(start[grid[r]], freq[grid[r]], live[r])
    streams = coder.streams()
    for s in streams:
        put_varint(out, len(s))
    return bytes(out) + b"".join(streams)


def side_sizes(parts: list[bytes], most: int = 1 << 22) -> list[int]:
    """Lengths that :func:`side_encode` gives, of many side by side and without their words.

    Parts of similar length go together, so that ``most`` bytes or one part are held at once.
    """
    out = [1 + len(p) for p in parts]
    order = sorted((k for k in range(len(parts)) if parts[k]), key=lambda k: -len(parts[k]))
    while order:
        some = order[: max(1, min(2048, most // len(parts[order[0]])))]
        order = order[len(some) :]
        for k, n in zip(some, _order0_sizes([parts[k] for k in some])):
            out[k] = min(out[k], 1 + n)
    return out


def _order0_sizes(parts: list[bytes]) -> list[int]:
    """Lengths of :func:`order0_encode`, of parts by falling length: the states of all lanes of all parts."""
    lengths = np.array([len(p) for p in parts])
    rows = -(-lengths // LANES)
    body, part = np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), lengths)
    count = np.bincount(part * 256 + body, minlength=256 * len(parts)).reshape(-1, 256)
    freq = np.where(count > 0, np.maximum(1, count * SCALE // lengths[:, None]), 0)
    excess = freq.sum(axis=1) - SCALE
    freq[np.arange(len(parts)), count.argmax(axis=1)] -= np.minimum(excess, 0)
    for k in np.flatnonzero(excess > 0).tolist():
        freq[k] = normalise(count[k])
    heads = _varint_sizes(lengths) + 32 + (_varint_sizes(freq) * (freq > 0)).sum(axis=1)
    # A cell without a byte has the whole scale, which leaves a state as it is.
    shape = int(rows[0]), len(parts), LANES
    size, start = np.full(shape, SCALE, np.uint16), np.zeros(shape, np.uint16)
    at = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cell = (at // LANES * len(parts) + part) * LANES + at % LANES
    size.reshape(-1)[cell] = freq[part, body]
    start.reshape(-1)[cell] = (np.cumsum(freq, axis=1) - freq)[part, body]
    state, words = np.full((len(parts), LANES), LOW, np.uint32), np.zeros((len(parts), LANES), np.int64)
    live = np.searchsorted(-rows, -np.arange(rows[0])).tolist()
    for r in range(int(rows[0]) - 1, -1, -1):
        s, x = size[r, : live[r]].astype(np.uint32), state[: live[r]]
        full = x >> np.uint32(32 - SCALE_BITS) >= s
        words[: live[r]] += full
        x >>= full.astype(np.uint32) << np.uint32(4)
        whole = x // s
        state[: live[r]] = (whole << np.uint32(SCALE_BITS)) + (x - whole * s) + start[r, : live[r]]
    streams = 4 + 2 * words
    return (heads + (streams + _varint_sizes(streams)).sum(axis=1)).tolist()


def _varint_sizes(values: np.ndarray) -> np.ndarray:
    return 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28, 35))


def order0_decode(coded: bytes) -> bytes:
    n, at = get_varint(coded, 0)
    if not n:
        return b""
    if at + 32 > len(coded):
        raise CorruptBlock("frequencies end early")
    used = np.flatnonzero(np.unpackbits(np.frombuffer(coded[at : at + 32], np.uint8)))
    at += 32
    freq = np.zeros(256, np.int64)
    for s in used.tolist():
        freq[s], at = get_varint(coded, at)
    if freq.sum() != SCALE:
        raise CorruptBlock("frequencies do not fill the scale")
    sizes, streams = [], []
    for _ in range(LANES):
        size, at = get_varint(coded, at)
        sizes.append(size)
    for size in sizes:
        streams.append(coded[at : at + size])
        at += size
    if at != len(coded):
        raise CorruptBlock("bytes after the lanes")
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    symbol = np.repeat(np.arange(256), freq)
    coder, rows = Decoder(streams), -(-n // LANES)
    if rows * LANES > 64 * (len(coded) + 64) * SCALE:
        raise CorruptBlock("more bytes than the lanes can hold")
    out = np.zeros((rows, LANES), np.uint8)
    for r in range(rows):
        live = r * LANES + np.arange(LANES) < n
        s = symbol[coder.slots()]
        coder.step(start[s], freq[s], live)
        out[r] = s
    coder.finish()
    return out.reshape(-1)[:n].tobytes()


def side_encode(data: bytes) -> bytes:
    """A flag and the smaller of the bytes and their order-0 code."""
    coded = order0_encode(data)
    return b"\1" + coded if len(coded) < len(data) else b"\0" + data


def side_decode(coded: bytes) -> bytes:
    if not coded or coded[0] > 1:
        raise CorruptBlock("no flag before a side stream")
    return order0_decode(coded[1:]) if coded[0] else coded[1:]
