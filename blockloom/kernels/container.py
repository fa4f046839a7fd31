"""One-file containers: header, dictionary, members, block entries, payloads.

Little-endian.  Header: magic, version, flags, log2 of the block size, number of blocks.  A
dictionary frame follows if flag 1 is set, a member table from version 2 on, then an entry of
13 bytes for each block (payload length, coded length, method, CRC-32 of the original bytes).
Every count and length is checked against what is there before it is believed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from ..sources.members import UnsafeName, check_name
from . import codecs, lexicon, models
from .classify import cut
from .transforms import CorruptBlock

MAGIC, VERSION, HAS_WORDS = b"BLKL", 2, 1
HEADER, ENTRY = struct.Struct("<4sBBBI"), struct.Struct("<IIBI")


class InvalidContainer(ValueError):
    """Bytes that are not a whole container."""


class CrcMismatch(CorruptBlock):
    def __init__(self, block: int, got: int, want: int):
        super().__init__(f"block {block}: CRC {got:08x}, not {want:08x}")


@dataclass(frozen=True)
class Member:
    name: str
    first_block: int
    num_blocks: int


def write_header(blocks: int, words: bool, version: int = VERSION) -> bytes:
    return HEADER.pack(MAGIC, version, HAS_WORDS if words else 0, 16, blocks)


def read_header(data: bytes) -> tuple[int, int, int]:
    """Version, flags and number of blocks."""
    if len(data) < HEADER.size:
        raise InvalidContainer("no whole header")
    magic, version, flags, _, blocks = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise InvalidContainer("not a container")
    if version not in (1, 2):
        raise InvalidContainer(f"unknown version {version}")
    return version, flags, blocks


def write_members(members: Sequence[Member]) -> bytes:
    out = struct.pack("<I", len(members))
    for m in members:
        name = check_name(m.name).encode()
        out += struct.pack("<H", len(name)) + name + struct.pack("<II", m.first_block, m.num_blocks)
    return out


def read_members(data: bytes, at: int, blocks: int) -> tuple[list[Member], int]:
    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise InvalidContainer("member table ends early")
        at += n
        return data[at - n : at]

    (count,) = struct.unpack("<I", take(4))
    if count * 11 > len(data):
        raise InvalidContainer("more members than bytes")
    members = []
    for _ in range(count):
        raw = take(struct.unpack("<H", take(2))[0])
        first, number = struct.unpack("<II", take(8))
        try:
            name = check_name(raw.decode())
        except (UnicodeDecodeError, UnsafeName) as e:
            raise InvalidContainer(str(e)) from e
        if first + number > blocks:
            raise InvalidContainer("member beyond the blocks")
        members.append(Member(name, first, number))
    return members, at


def compress_archive(members: Sequence[tuple[str, bytes]], mode: str = "hybrid", stack: models.Stack | None = None, **floors: int) -> bytes:
    """A container of named members; at least one is needed.  A ``stack`` of models of one's own is not stored in it."""
    if not members:
        raise ValueError("nothing to archive")
    words = [] if stack or mode in ("wire", "general") else lexicon.build(b"".join(d for _, d in members))
    blocks, table = [], []
    for name, data in members:
        cuts = cut(data, mode == "wire" and not stack)
        table.append(Member(name, len(blocks), len(cuts)))
        blocks += [(kind, _structure(data[a:b]) if kind == "Text" else None, data[a:b]) for a, b, kind in cuts]
    coded = codecs.encode_blocks(blocks, mode, words, stack=stack, **floors)
    out = write_header(len(coded), bool(words))
    if words:
        body = lexicon.write(words)
        out += struct.pack("<I", len(body)) + body
    out += write_members(table)
    out += b"".join(ENTRY.pack(len(c.payload), c.coded_len, c.method, zlib.crc32(d)) for c, (_, _, d) in zip(coded, blocks))
    return out + b"".join(c.payload for c in coded)


def decompress_archive(data: bytes, stack: models.Stack | None = None) -> list[tuple[str, bytes]]:
    version, flags, count = read_header(data)
    at, words = HEADER.size, []
    if flags & HAS_WORDS:
        if at + 4 > len(data) or at + 4 + (size := struct.unpack_from("<I", data, at)[0]) > len(data):
            raise InvalidContainer("dictionary ends early")
        words = lexicon.read(data[at + 4 : at + 4 + size])
        at += 4 + size
    members = [Member("", 0, count)]
    if version > 1:
        members, at = read_members(data, at, count)
    if at + count * ENTRY.size > len(data):
        raise InvalidContainer("entries end early")
    entries = [ENTRY.unpack_from(data, at + k * ENTRY.size) for k in range(count)]
    at += count * ENTRY.size
    if at + sum(e[0] for e in entries) != len(data):
        raise InvalidContainer("payloads do not fill the container")
    coded = []
    for size, coded_len, method, _ in entries:
        coded.append(codecs.Coded(method, coded_len, data[at : at + size]))
        at += size
    try:
        raw = codecs.decode_blocks(coded, words, stack)
    except CorruptBlock:
        raise
    except (ValueError, IndexError, KeyError, OverflowError, struct.error) as e:
        raise CorruptBlock(str(e)) from e
    for k, (block, entry) in enumerate(zip(raw, entries)):
        if zlib.crc32(block) != entry[3]:
            raise CrcMismatch(k, zlib.crc32(block), entry[3])
    return [(m.name, b"".join(raw[m.first_block : m.first_block + m.num_blocks])) for m in members]


def compress(data: bytes, mode: str = "hybrid", stack: models.Stack | None = None, **floors: int) -> bytes:
    return compress_archive([("data", data)], mode, stack, **floors)


def decompress(container: bytes, stack: models.Stack | None = None) -> bytes:
    """The one member of a container; several are an error."""
    members = decompress_archive(container, stack)
    if len(members) > 1:
        raise InvalidContainer(f"{len(members)} members; read them as an archive")
    return members[0][1] if members else b""


def _structure(data: bytes) -> str | None:
    """json, csv or xml, by the rules of the detectors."""
    from . import shred

    body, sample = data.lstrip(b" \t\n\r\f\x0b"), data[:8192]
    if len(data) >= 32 and body[:1] in (b"{", b"[") and sample.count(b":") >= 2 and sample.count(b'"') >= 2 * sample.count(b":"):
        return "json"
    by = shred.delimiter_of(data)
    lines = [x for x in (x.removesuffix(b"\r") for x in sample.split(b"\n")) if x][:16]
    if len(data) >= 32 and body[:1] not in (b"{", b"[", b"<") and sample.isascii() and sample.count(by) >= 4 and len(lines) >= 2:
        widths = [len(shred.csv_row(x, by)) for x in lines]
        if widths[0] >= 2 and 2 * widths.count(widths[0]) >= len(widths):
            return "csv"
    opened, closed = sample.count(b"<"), sample.count(b">")
    if len(data) >= 16 and body[:1] == b"<":
        tagged = opened >= 2 and closed >= 2 and abs(opened - closed) <= opened // 2 + 1
        if body[:5] in (b"<?xml", b"<?XML") or tagged and 100 * sum(c < 128 for c in sample) // len(sample) >= 70:
            return "xml"
    return None
