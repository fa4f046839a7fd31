"""Kinds of blocks, and members cut into blocks by kind."""

from __future__ import annotations

import re

import numpy as np

from ..functions.blocks import BINARY_BLOCK, PRINTABLE, RANDOM_BITS, RANDOM_BLOCK, TEXT_BLOCK, TINY, WIRE_BLOCK

_CALLS = re.compile(rb"(?=\x55\x89\xe5|\x48\x89\xe5|\xff\xd0)", re.S)
_MAGIC = re.compile(rb"\x7fELF|\xcf\xfa\xed\xfe|MZ\x90\x00", re.S)


def measure(data: bytes) -> tuple[int, float, float, bool]:
    """Length, entropy in bits a byte, printable share, and whether it looks executable."""
    n = len(data)
    if not n:
        return 0, 0.0, 0.0, False
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = count[count > 0] / n
    marks = _MAGIC.search(data) is not None or sum(1 for _, _ in zip(range(2), _CALLS.finditer(data))) == 2
    return n, float(max(0.0, -(p * np.log2(p)).sum())), float(count[0x20:0x7F].sum() / n), marks


def classify(data: bytes) -> str:
    n, entropy, printable, marks = measure(data)
    if n < TINY or entropy > RANDOM_BITS:
        return "Random"
    return "Text" if printable > PRINTABLE else "Exec" if marks else "Binary"


def block_length(kind: str, rest: int, wire: bool = False) -> int:
    if wire:
        return max(1, min(WIRE_BLOCK, rest))
    if kind == "Text":
        return max(RANDOM_BLOCK, min(rest, TEXT_BLOCK))
    return BINARY_BLOCK if kind in ("Binary", "Exec") else RANDOM_BLOCK


def cut(data: bytes, wire: bool = False, window: int | None = None) -> list[tuple[int, int, str]]:
    """``(start, stop, kind)`` of the blocks of a member.

    The kind is that of all that is left of the member, or of the next ``window`` bytes: the
    former reads a member again for each block, the latter reads it once.
    """
    blocks, at = [], 0
    while at < len(data):
        kind = classify(data[at : at + window] if window else data[at:])
        stop = min(len(data), at + block_length(kind, len(data) - at, wire))
        if window:
            stop = min(stop, at + window)
        blocks.append((at, stop, kind))
        at = stop
    return blocks
