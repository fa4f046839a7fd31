"""Reversible byte transforms."""

from __future__ import annotations

import re
import struct

import numpy as np


class CorruptBlock(ValueError):
    """Bytes that no encoder of this package writes."""


# Run lengths of zero

_RUNS = re.compile(rb"\x00{1,255}|\xff")
_MARKS = re.compile(rb"\xff([\x00-\xff]?)", re.S)


def rle0(data: bytes) -> bytes:
    """Runs of zero as FF and a count up to 255; FF itself as FF and 0."""
    return _RUNS.sub(lambda m: b"\xff\x00" if m[0] == b"\xff" else bytes((255, len(m[0]))), data)


def rle0_inverse(data: bytes) -> bytes:
    def back(m: re.Match) -> bytes:
        if not m[1]:
            raise CorruptBlock("a run mark without its count")
        return bytes(m[1][0]) if m[1][0] else b"\xff"

    return _MARKS.sub(back, data)


# Recency ranks


def mtf(data: bytes) -> bytes:
    """Each byte as its place in a list from which it then moves to the front."""
    recent, out, front = bytearray(range(256)), bytearray(len(data)), 0
    for i, b in enumerate(data):
        if b != front:
            out[i] = at = recent.find(b)
            recent[1 : at + 1] = recent[:at]
            recent[0] = front = b
    return bytes(out)


def mtf_inverse(ranks: bytes) -> bytes:
    recent, out = bytearray(range(256)), bytearray(len(ranks))
    front = 0
    for i, at in enumerate(ranks):
        if at:
            front = recent[at]
            recent[1 : at + 1] = recent[:at]
            recent[0] = front
        out[i] = front
    return bytes(out)


# Block sorting

SHORT = 512  # bytes up to which plain sorting takes less time than the calls of numpy


def rotation_order(data: bytes) -> np.ndarray:
    """Starts of the rotations in sorted order, equal rotations with the later start first.

    Ranks of prefixes of eight bytes double in length until they differ or cover the block.
    """
    n = len(data)
    first = np.frombuffer(data, np.uint8).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | np.roll(first, -k)
    order, width = np.argsort(packed, kind="stable"), 8
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(packed[order[1:]] != packed[order[:-1]])])
    if rank[order[-1]] == n - 1:
        return order
    while width < n:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1:
            return order
    return np.lexsort((-np.arange(n), rank))


def bwt(data: bytes) -> bytes:
    """Last column of the sorted rotations, then the row of the text as four bytes."""
    if not data:
        return b""
    n = len(data)
    if n <= SHORT:
        twice = data + data
        rows = sorted(range(n - 1, -1, -1), key=lambda k: twice[k : k + n])
        return bytes([data[k - 1] for k in rows]) + struct.pack("<I", rows.index(0))
    order = rotation_order(data)
    last = np.frombuffer(data, np.uint8)[order - 1]
    return last.tobytes() + struct.pack("<I", int(np.flatnonzero(order == 0)[0]))


def bwt_inverse(coded: bytes) -> bytes:
    if not coded:
        return b""
    if len(coded) < 5:
        raise CorruptBlock("a sorted block without its row")
    last, (row,) = np.frombuffer(coded[:-4], np.uint8), struct.unpack("<I", coded[-4:])
    if row >= len(last):
        raise CorruptBlock("row of the text beyond the block")
    follow = jump = np.argsort(last, kind="stable")
    rows = np.array([row])  # of the first bytes; each jump over all of them doubles their number
    while len(rows) < len(last):
        rows = np.concatenate([rows, jump[rows]])
        jump = jump[jump]
    return last[follow[rows[: len(last)]]].tobytes()


# Repeats

LZP_WINDOW, LZP_LEAST, LZP_MOST = 4 << 20, 4, 255


def lzp(data: bytes, probes: int = 32) -> bytes:
    """Length, then tokens: 1, length and a three-byte distance, or 0 and a literal."""
    heads: dict[bytes, list[int]] = {}
    out, i, n = bytearray(struct.pack("<I", len(data))), 0, len(data)
    while i < n:
        length = distance = 0
        for j in reversed(heads.get(data[i : i + 4], ())[-probes:] if i + 4 <= n else ()):
            most = min(LZP_MOST, n - i)
            if i - j > LZP_WINDOW or length == most:
                break
            if length and data[j + length] != data[i + length]:  # no longer than the one found
                continue
            k = 4
            while k + 16 <= most and data[j + k : j + k + 16] == data[i + k : i + k + 16]:
                k += 16
            while k < most and data[j + k] == data[i + k]:
                k += 1
            if k > length:
                length, distance = k, i - j
        step = length if length >= LZP_LEAST else 1
        out += struct.pack("<BB", 1, length) + distance.to_bytes(3, "little") if step > 1 else bytes((0, data[i]))
        for k in range(i, min(i + step, n - 3)):
            heads.setdefault(data[k : k + 4], []).append(k)
        i += step
    return bytes(out)


def lzp_inverse(coded: bytes) -> bytes:
    if len(coded) < 4:
        raise CorruptBlock("repeat tokens without their length")
    (n,), out, i = struct.unpack_from("<I", coded), bytearray(), 4
    while i < len(coded):
        if coded[i] == 0 and i + 2 <= len(coded):
            out.append(coded[i + 1])
            i += 2
        elif coded[i] == 1 and i + 5 <= len(coded):
            distance = int.from_bytes(coded[i + 2 : i + 5], "little")
            _copy(out, distance, coded[i + 1])
            i += 5
        else:
            raise CorruptBlock("broken repeat token")
    if len(out) != n:
        raise CorruptBlock(f"repeat tokens give {len(out)} of {n} bytes")
    return bytes(out)


def _copy(out: bytearray, distance: int, length: int) -> None:
    if not 0 < distance <= len(out):
        raise CorruptBlock("match before the start of the block")
    start = len(out) - distance
    piece = bytes(out[start : start + length])
    while len(piece) < length:
        piece += piece[: length - len(piece)]
    out += piece


# Call targets


def _calls(data: bytes, sign: int) -> bytes:
    out, i = bytearray(data), 0
    while i + 5 <= len(out):
        if out[i] in (0xE8, 0xE9):
            (target,) = struct.unpack_from("<I", out, i + 1)
            struct.pack_into("<I", out, i + 1, (target + sign * (i + 5)) & 0xFFFFFFFF)
            i += 5
        else:
            i += 1
    return bytes(out)


def e8e9(data: bytes) -> bytes:
    """Relative call and jump targets as absolute ones, modulo 2**32."""
    return _calls(data, 1)


def e8e9_inverse(data: bytes) -> bytes:
    return _calls(data, -1)


# Chains


def bwt_mtf_rle(data: bytes) -> bytes:
    coded = bwt(data)
    return coded[-4:] + rle0(mtf(coded[:-4])) if coded else b""


def bwt_mtf_rle_inverse(coded: bytes) -> bytes:
    return bwt_inverse(mtf_inverse(rle0_inverse(coded[4:])) + coded[:4]) if coded else b""


def bwt_mtf(data: bytes) -> bytes:
    coded = bwt(data)
    return coded[-4:] + mtf(coded[:-4]) if coded else b""


def bwt_mtf_inverse(coded: bytes) -> bytes:
    return bwt_inverse(mtf_inverse(coded[4:]) + coded[:4]) if coded else b""


def lzp_bwt_mtf(data: bytes) -> bytes:
    return bwt_mtf(lzp(data))


def lzp_bwt_mtf_inverse(coded: bytes) -> bytes:
    return lzp_inverse(bwt_mtf_inverse(coded))
