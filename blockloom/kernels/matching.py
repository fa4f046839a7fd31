"""Repeats in a block: greedy-lazy matching for the wire engine, and a parse of least cost."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .framing import get_varint, put_varint
from .transforms import CorruptBlock, _copy

# Limits of wire matches, and costs of the parse in bits.
LEAST, MOST, REACH = 4, 65535, 65535
MATCH_BITS, LITERAL_BITS, LEAST_BY_KIND = 33.0, {"Text": 4.0, "Random": 4.0, "Binary": 5.0, "Exec": 5.0}, {"Text": 12}
PARSE_LEAST, PARSE_MOST, CHAIN = 16, 255, 4


@dataclass(frozen=True)
class Run:
    """``length`` bytes at ``at`` are those ``distance`` before, which may lie in the history."""

    at: int
    length: int
    distance: int


def match_length(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and from b on are equal."""
    n, most = 0, min(most, len(data) - b)
    while n + 16 <= most and data[a + n : a + n + 16] == data[b + n : b + n + 16]:
        n += 16
    while n < most and data[a + n] == data[b + n]:
        n += 1
    return n


def wire_encode(data: bytes) -> bytes:
    """Literals and matches: two lengths in a byte with extensions, literals, a two-byte distance.

    A match is looked for at the last two places of the next four bytes, and gives way to a
    longer one that starts a byte later.
    """
    n = len(data)
    before, candidates = previous_places(data)
    last, at_once = before.tolist(), candidates.tolist()
    out, anchor, i, where = bytearray(), 0, 0, 0
    found = (-1, 0, 0)  # the last place asked for, with its answer

    def best(at: int) -> tuple[int, int]:
        nonlocal found
        if found[0] == at:
            return found[1:]
        length = distance = 0
        j, tries = last[at], 2
        while tries and 0 <= j and at - j <= REACH:
            if not length or data[j + length : j + length + 1] == data[at + length : at + length + 1]:
                k = match_length(data, j, at, MOST)
                if k > length:
                    length, distance = k, at - j
            j, tries = last[j], tries - 1
        found = (at, length, distance)
        return length, distance

    while where < len(at_once):
        i = at_once[where]
        where += 1
        length, distance = best(i)
        if i + 1 + LEAST <= n and best(i + 1)[0] > length:
            continue
        _sequence(out, data[anchor:i], length, distance)
        anchor = i + length
        if length > 16:
            where = int(np.searchsorted(candidates, anchor))
        else:
            while where < len(at_once) and at_once[where] < anchor:
                where += 1
    _sequence(out, data[anchor:], 0, 0)
    return bytes(out)


def previous_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the four bytes at each place stood before, or -1, and the places where that is within reach."""
    n = len(data)
    if n < LEAST:
        return np.full(n, -1), np.zeros(0, np.int64)
    first = np.frombuffer(data, np.uint8).astype(np.uint32)
    keys = first[: n - 3] | first[1 : n - 2] << np.uint32(8) | first[2 : n - 1] << np.uint32(16) | first[3:] << np.uint32(24)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    return before, np.flatnonzero((before >= 0) & (np.arange(n) - before <= REACH))


def _sequence(out: bytearray, literals: bytes, length: int, distance: int) -> None:
    more = max(0, length - LEAST)
    out.append(min(15, len(literals)) << 4 | min(15, more))
    for value in (len(literals), more):
        if value >= 15:
            put_varint(out, value - 15)
    out += literals
    if length:
        out += distance.to_bytes(2, "little")


def wire_decode(coded: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while True:
        if i >= len(coded):
            raise CorruptBlock("wire tokens end early")
        count, more = coded[i] >> 4, coded[i] & 15
        i += 1
        if count == 15:
            extra, i = get_varint(coded, i)
            count += extra
        if more == 15:
            extra, i = get_varint(coded, i)
            more += extra
        if i + count > len(coded) or len(out) + count > size:
            raise CorruptBlock("literals beyond the block")
        out += coded[i : i + count]
        i += count
        if i == len(coded):
            break
        if i + 2 > len(coded) or len(out) + more + LEAST > size:
            raise CorruptBlock("match beyond the block")
        _copy(out, int.from_bytes(coded[i : i + 2], "little"), more + LEAST)
        i += 2
    if len(out) != size:
        raise CorruptBlock(f"wire tokens give {len(out)} of {size} bytes")
    return bytes(out)


def parse(data: bytes, kind: str, history: bytes = b"") -> list[Run]:
    """Runs of the cheapest way to write a block: a literal or a match at each byte, from the end."""
    least, bits = LEAST_BY_KIND.get(kind, PARSE_LEAST), LITERAL_BITS[kind]
    whole, base = history + data, len(history)
    before = places_before(whole, least)
    places = np.flatnonzero(before >= 0)
    places = places[places >= base]
    if not len(places):
        return []
    lengths, far = [0] * len(places), [0] * len(places)
    chain, known, after = before.tolist(), {}, -1  # lengths at the place behind, by distance
    for k in range(len(places) - 1, -1, -1):
        at = int(places[k])
        now, j, length, distance = {}, chain[at], 0, 0
        for _ in range(CHAIN):
            if j < 0:
                break
            d = at - j
            m = known.get(d) if after == at + 1 else None
            now[d] = m = match_length(whole, j, at, PARSE_MOST) if m is None else min(PARSE_MOST, m + 1)
            if m > length:
                length, distance = m, d
            j = chain[j]
        lengths[k], far[k] = length, distance
        known, after = now, at
    # What is saved from each place on against literals only; it changes at the places alone.
    then = np.searchsorted(places, places + lengths).tolist()
    saved, take = [0.0] * (len(places) + 1), [False] * len(places)
    for k in range(len(places) - 1, -1, -1):
        saved[k], new = saved[k + 1], saved[then[k]] + bits * lengths[k] - MATCH_BITS
        if new > saved[k]:
            saved[k], take[k] = new, True
    runs, k = [], 0
    while k < len(places):
        if take[k]:
            runs.append(Run(int(places[k]) - base, lengths[k], far[k]))
            k = then[k]
        else:
            k += 1
    return runs


def places_before(data: bytes, least: int) -> np.ndarray:
    """Where the ``least`` bytes at each place, eight or more, stood before, or -1."""
    n = len(data)
    out = np.full(n, -1)
    if n < least:
        return out
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(np.uint64)[:, 0]
    head, tail = words[: n - least + 1], words[least - 8 : n - 7]
    # A hash brings equal ones together; if it brings others too, they are sorted by their bytes.
    key = (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    if (head[a] != head[b]).any() or (tail[a] != tail[b]).any():
        order = np.lexsort((tail, head))
        same = (head[order[1:]] == head[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])
        a, b = order[:-1][same], order[1:][same]
    out[b] = a
    return out


def parse_cost(data: bytes, kind: str, runs: list[Run]) -> float:
    return MATCH_BITS * len(runs) + LITERAL_BITS[kind] * (len(data) - sum(r.length for r in runs))


def distances(runs: list[Run], size: int) -> np.ndarray:
    """For each byte of a block how far before it stands again, or 0 outside runs.

    Runs out of order, beyond the block or from before its start are an error.
    """
    out, end = np.zeros(size, np.int32), 0
    for r in runs:
        if r.at < end or r.length < 1 or r.at + r.length > size:
            raise CorruptBlock("runs out of order or beyond the block")
        if not 0 < r.distance <= r.at:
            raise CorruptBlock("match before the start of the block")
        end = r.at + r.length
        out[r.at : end] = r.distance
    return out


def write_runs(runs: list[Run]) -> bytes:
    out, end = bytearray(), 0
    put_varint(out, len(runs))
    for r in runs:
        for value in (r.at - end, r.length, r.distance):
            put_varint(out, value)
        end = r.at + r.length
    return bytes(out)


def read_runs(data: bytes) -> list[Run]:
    count, at = get_varint(data, 0)
    if count > len(data):
        raise CorruptBlock("more runs than bytes")
    runs, end = [], 0
    for _ in range(count):
        gap, at = get_varint(data, at)
        length, at = get_varint(data, at)
        distance, at = get_varint(data, at)
        runs.append(Run(end + gap, length, distance))
        end += gap + length
    if at != len(data):
        raise CorruptBlock("bytes after the runs")
    return runs
