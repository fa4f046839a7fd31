"""A dictionary of frequent words, and texts with words replaced by short tokens."""

from __future__ import annotations

import re
import struct
from collections import Counter

from .framing import pack, unpack
from .transforms import CorruptBlock

# Size and lengths of the dictionary, and its tokens.
MOST, SHORTEST, LONGEST, ONE_BYTE, LONG_FROM = 1024, 2, 255, 127, 4
TOKEN, ESCAPE = 0x80, 0xFF
BREAKS = b" \t\n\r\0!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = re.compile(b"[^" + re.escape(BREAKS) + b"]+")


def words_of(data: bytes) -> list[bytes]:
    return [w for w in WORD.findall(data) if SHORTEST <= len(w) <= LONGEST]


def choose(counts: list[tuple[bytes, int]]) -> list[bytes]:
    """Words for the ids 0, 1 and so on, from (word, count) in order of first sight.

    The first ids go to the most frequent words; ids that need an escape only to words that
    are longer than their token.
    """
    ranked = [w for w, _ in sorted(counts, key=lambda x: -x[1])]
    return ranked[:ONE_BYTE] + [w for w in ranked[ONE_BYTE:] if len(w) >= LONG_FROM][: MOST - ONE_BYTE]


def build(data: bytes) -> list[bytes]:
    return choose(list(Counter(words_of(data)).items()))


def _token(i: int) -> bytes:
    return bytes((TOKEN + i,)) if i < ONE_BYTE else struct.pack("<BH", ESCAPE, i)


def replace(data: bytes, words: list[bytes]) -> bytes:
    """Tokens for the first word of the list that starts at each place; ASCII only."""
    if not data.isascii():
        raise ValueError("words are replaced in ASCII texts only")
    if not words:
        return data
    ids = {w: _token(i) for i, w in reversed(list(enumerate(words)))}
    return re.compile(b"|".join(map(re.escape, words))).sub(lambda m: ids[m[0]], data)


def restore(data: bytes, words: list[bytes]) -> bytes:
    def back(m: re.Match) -> bytes:
        i = struct.unpack("<H", m[1])[0] if m[1] is not None else m[0][0] - TOKEN
        if m[0] == b"\xff" or i >= len(words):
            raise CorruptBlock("a token without its word")
        return words[i]

    return re.sub(rb"\xff([\x00-\xff]{2})|[\x80-\xff]", back, data, flags=re.S)


def write(words: list[bytes]) -> bytes:
    return pack(words)


def read(data: bytes) -> list[bytes]:
    words = unpack(data)
    if len(words) > MOST:
        raise CorruptBlock("too many words")
    return words
