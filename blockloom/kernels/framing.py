"""Variable-length numbers and framed lists."""

from __future__ import annotations

from .transforms import CorruptBlock


def put_varint(out: bytearray, value: int) -> None:
    """Seven bits a byte, least first; the high bit says that more follow."""
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place and the place after it."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptBlock("broken number")
        value |= (data[at] & 0x7F) << shift
        at += 1
        if data[at - 1] < 0x80:
            return value, at
        shift += 7


def pack(parts: list[bytes]) -> bytes:
    """Count, lengths, then the parts one after another."""
    out = bytearray()
    put_varint(out, len(parts))
    for p in parts:
        put_varint(out, len(p))
    return bytes(out) + b"".join(parts)


def unpack(data: bytes) -> list[bytes]:
    count, at = get_varint(data, 0)
    if count > len(data):
        raise CorruptBlock("more parts than bytes")
    sizes = []
    for _ in range(count):
        size, at = get_varint(data, at)
        sizes.append(size)
    if at + sum(sizes) != len(data):
        raise CorruptBlock("parts do not fill their frame")
    out = []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out
