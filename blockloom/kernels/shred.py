"""Semi-structured blocks as homogeneous streams, and back without loss.

Each split returns lists of byte strings; a layout stream says in which order to take them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .framing import pack, unpack
from .transforms import CorruptBlock

_JSON = re.compile(rb'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?', re.S)
_KEY = re.compile(rb"[ \t\r\n]*:")
_XML = re.compile(rb"(<[/?!]?[^ \t\r\n>/<]*)([^>]*?)([/?]?>|$)|([^<]+)", re.S)
#: Marks in a JSON layout; a byte of the block that equals one is doubled after ESCAPE.
KEY, STRING, NUMBER, ESCAPE = b"\x01", b"\x02", b"\x03", b"\x04"
_LAYOUT = re.compile(rb"\x04([\x01-\x04])|([\x01-\x03])", re.S)
_MARK = re.compile(rb"[\x01-\x04]")


@dataclass
class Json:
    structural: bytes
    keys: list[bytes]
    strings: list[bytes]
    numbers: list[bytes]

    def streams(self) -> list[bytes]:
        return [self.structural, pack(self.keys), pack(self.strings), pack(self.numbers)]


def json_split(data: bytes) -> Json:
    """Strings that a colon follows are keys; quotes stay out of the streams, escapes stay raw."""
    layout, keys, strings, numbers, at = [], [], [], [], 0
    for m in _JSON.finditer(data):
        layout.append(_MARK.sub(lambda x: ESCAPE + x[0], data[at : m.start()]))
        token, at = m[0], m.end()
        if token[:1] != b'"':
            numbers.append(token)
            layout.append(NUMBER)
        elif _KEY.match(data, at):
            keys.append(token[1:-1])
            layout.append(KEY)
        else:
            strings.append(token[1:-1])
            layout.append(STRING)
    layout.append(_MARK.sub(lambda x: ESCAPE + x[0], data[at:]))
    return Json(b"".join(layout), keys, strings, numbers)


def json_join(parts: Json) -> bytes:
    iters = {KEY: iter(parts.keys), STRING: iter(parts.strings), NUMBER: iter(parts.numbers)}

    def back(m: re.Match) -> bytes:
        if m[1]:
            return m[1]
        token = next(iters[m[2]], None)
        if token is None:
            raise CorruptBlock("fewer values than marks")
        return token if m[2] == NUMBER else b'"' + token + b'"'

    out = _LAYOUT.sub(back, parts.structural)
    if any(next(i, None) is not None for i in iters.values()):
        raise CorruptBlock("more values than marks")
    return out


@dataclass
class Csv:
    delimiter: bytes
    columns: list[list[bytes]]
    fields: list[int]

    def streams(self) -> list[bytes]:
        return [self.delimiter + pack([str(n).encode() for n in self.fields]), *(pack(c) for c in self.columns)]


def delimiter_of(data: bytes, sample: int = 8192) -> bytes:
    return b"\t" if data[:sample].count(b"\t") > data[:sample].count(b",") else b","


def csv_row(line: bytes, delimiter: bytes) -> list[bytes]:
    """Fields of a line, quotes kept; a delimiter inside double quotes belongs to its field."""
    if b'"' not in line:
        return line.split(delimiter)
    fields, start, quoted = [], 0, False
    for i in range(len(line)):
        c = line[i : i + 1]
        if c == b'"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            fields.append(line[start:i])
            start = i + 1
    return [*fields, line[start:]]


def csv_split(data: bytes) -> Csv:
    """Cells by column; each row's number of fields is kept, and carriage returns in its last cell."""
    by = delimiter_of(data)
    rows = [csv_row(line, by) for line in data.split(b"\n")]
    width = max(map(len, rows))
    return Csv(by, [[r[k] for r in rows if k < len(r)] for k in range(width)], [len(r) for r in rows])


def csv_join(parts: Csv) -> bytes:
    cells = [iter(c) for c in parts.columns]
    try:
        rows = [parts.delimiter.join([next(cells[k]) for k in range(n)]) for n in parts.fields]
    except (StopIteration, IndexError, RuntimeError) as e:
        raise CorruptBlock("fewer cells than fields") from e
    if any(next(c, None) is not None for c in cells):
        raise CorruptBlock("more cells than fields")
    return b"\n".join(rows)


@dataclass
class Xml:
    layout: bytes
    tags: list[bytes]
    attrs: list[bytes]
    text: list[bytes]

    def streams(self) -> list[bytes]:
        return [self.layout, pack(self.tags), pack(self.attrs), pack(self.text)]


def xml_split(data: bytes) -> Xml:
    """Tag names with their ends, attribute regions and text; layout t for text, g and a for tags
    without and with attributes."""
    layout, tags, attrs, text = bytearray(), [], [], []
    for m in _XML.finditer(data):
        if m[4] is not None:
            layout += b"t"
            text.append(m[4])
        else:
            layout += b"a" if m[2] else b"g"
            tags += [m[1], m[3]]
            if m[2]:
                attrs.append(m[2])
    return Xml(bytes(layout), tags, attrs, text)


def xml_join(parts: Xml) -> bytes:
    tags, attrs, text, out = iter(parts.tags), iter(parts.attrs), iter(parts.text), []
    try:
        for kind in parts.layout:
            if kind == ord("t"):
                out.append(next(text))
            else:
                out += [next(tags), next(attrs) if kind == ord("a") else b"", next(tags)]
    except StopIteration as e:
        raise CorruptBlock("fewer pieces than the layout names") from e
    if any(next(i, None) is not None for i in (tags, attrs, text)):
        raise CorruptBlock("more pieces than the layout names")
    return b"".join(out)


def unpack_json(streams: list[bytes]) -> Json:
    return Json(streams[0], *(unpack(x) for x in streams[1:4]))


def unpack_csv(streams: list[bytes]) -> Csv:
    return Csv(streams[0][:1], [unpack(x) for x in streams[1:]], [int(x) for x in unpack(streams[0][1:])])


def unpack_xml(streams: list[bytes]) -> Xml:
    return Xml(streams[0], *(unpack(x) for x in streams[1:4]))
