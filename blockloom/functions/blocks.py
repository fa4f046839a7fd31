"""Predicates and measures of byte blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the classifier and detectors, and sizes of blocks.
TINY, RANDOM_BITS, PRINTABLE = 32, 7.9, 0.85
SAMPLE = 8192
WIRE_BLOCK, TEXT_BLOCK, BINARY_BLOCK, RANDOM_BLOCK = 4 << 20, 4 << 20, 1 << 20, 64 << 10
MIN_MATCH = {"Text": 12, "Binary": 16, "Exec": 16, "Random": 16}
LITERAL_BITS = {"Text": 4.0, "Random": 4.0, "Binary": 5.0, "Exec": 5.0}


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_list(data: Column | str) -> Column:
    """The bytes of a binary column as an array of two-digit hex strings."""
    return F.regexp_extract_all(F.hex(as_column(data)), F.lit("(..)"), F.lit(1))


def byte_count(data: Column, byte: str) -> Column:
    """How often one byte, given in hex, occurs, on byte boundaries."""
    return F.size(F.filter(byte_list(data), lambda x: x == byte))


def entropy_of(counts: Column) -> Column:
    """Bits per symbol of an array of counts; 0 if it is empty or sums to 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(F.lit(0.0)))
    return F.when(total > 0, bits).otherwise(F.lit(0.0))


def kind_of(n: Column, entropy: Column, printable: Column, exec_marks: Column) -> Column:
    """Random, Text, Exec or Binary, in the order in which the rules hold."""
    return (
        F.when(n < TINY, "Random").when(entropy > RANDOM_BITS, "Random").when(printable > PRINTABLE, "Text")
        .when(exec_marks, "Exec").otherwise("Binary")
    )


def has_exec_marks(data: Column | str) -> Column:
    """Two call or prologue patterns, or one executable magic, on byte boundaries."""
    h = F.hex(as_column(data))
    calls = F.size(F.regexp_extract_all(h, F.lit("(?s)\\G(?:(?!5589E5|4889E5|FFD0)..)*?(5589E5|4889E5|FFD0)"), F.lit(1)))
    magic = h.rlike("^(?:..)*?(?:7F454C46|CFFAEDFE|4D5A9000)")
    return (calls >= 2) | magic


def is_compressible(kind: Column | str) -> Column:
    return as_column(kind) != "Random"


def block_size(kind: Column, rest: Column, wire: bool = False) -> Column:
    """Bytes of the next block of a kind with ``rest`` bytes to come."""
    if wire:
        return F.greatest(F.least(F.lit(WIRE_BLOCK), rest), F.lit(1))
    text = F.greatest(F.least(rest, F.lit(TEXT_BLOCK)), F.lit(RANDOM_BLOCK))
    return F.when(kind == "Text", text).when(kind.isin("Binary", "Exec"), F.lit(BINARY_BLOCK)).otherwise(F.lit(RANDOM_BLOCK))


def engine_route(kind: Column, mode: str) -> Column:
    """slow or fast for a block of a kind under a mode."""
    if mode == "slow":
        return F.lit("slow")
    if mode == "hybrid":
        return F.when(kind.isin("Binary", "Exec"), "slow").otherwise("fast")
    return F.lit("fast")


def min_match(kind: Column) -> Column:
    return F.when(kind == "Text", 12).otherwise(16)


def head(text: Column) -> Column:
    """The sample that detectors look at."""
    return F.substring(text, 1, SAMPLE)


def first_solid(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "^[ \\t\\n\\r\\f\\x0B]+", ""), 1, 1)


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.translate(text, char, ""))


def looks_like_json(text: Column) -> Column:
    """Starts with a brace or bracket, two colons at least and two quotes to each."""
    sample = head(text)
    colons = occurrences(sample, ":")
    return (
        (F.octet_length(text) >= 32) & first_solid(text).isin("{", "[") & (colons >= 2)
        & (occurrences(sample, '"') >= 2 * colons)
    )


def delimiter(text: Column) -> Column:
    sample = head(text)
    return F.when(occurrences(sample, "\t") > occurrences(sample, ","), "\t").otherwise(",")


def field_count(line: Column, by: Column) -> Column:
    """Fields of a line; a delimiter inside double quotes is part of its field."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*(?:"|$)', "")
    return F.length(bare) - F.length(F.replace(bare, by, F.lit(""))) + 1


def looks_like_csv(text: Column) -> Column:
    """ASCII, enough delimiters, and half of the first lines as wide as the first."""
    sample = head(text)
    by = delimiter(text)
    lines = F.slice(F.filter(F.transform(F.split(sample, "\n"), lambda x: F.regexp_replace(x, "\\r$", "")), lambda x: x != ""), 1, 16)
    even = lambda n: (
        (F.size(n) >= 2) & F.coalesce(F.get(n, F.lit(0)) >= 2, F.lit(False)) & (2 * F.size(F.filter(n, lambda x: x == F.get(n, F.lit(0)))) >= F.size(n))
    )
    likely = (
        (F.octet_length(text) >= 32) & ~first_solid(text).isin("{", "[", "<") & (F.octet_length(sample) == F.length(sample))
        & (F.greatest(occurrences(sample, ","), occurrences(sample, "\t")) >= 4)
    )
    return F.when(likely, let(by, lambda d: let(F.transform(lines, lambda x: field_count(x, d)), even))).otherwise(F.lit(False))


def looks_like_xml(text: Column) -> Column:
    """Starts with a tag and has about as many ends as starts of tags."""
    sample = head(text)
    opened, closed = occurrences(sample, "<"), occurrences(sample, ">")
    solid = F.regexp_replace(text, "^[ \\t\\n\\r\\f\\x0B]+", "")
    ascii_share = F.length(F.regexp_replace(sample, "[^\\x00-\\x7F]", "")) * 100 / F.greatest(F.octet_length(sample), F.lit(1))
    balanced = (opened >= 2) & (closed >= 2) & (F.abs(opened - closed) <= F.floor(opened / 2) + 1)
    return (F.octet_length(text) >= 16) & (first_solid(text) == "<") & (
        solid.startswith("<?xml") | solid.startswith("<?XML") | ((F.floor(ascii_share) >= 70) & balanced)
    )


def byte_class(byte: Column) -> Column:
    """Space, vowel, consonant, digit, punct or other, of a byte value."""
    chars = lambda s: [ord(c) for c in s]
    return (
        F.when(byte.isin(chars(" \t\n\r")), "space").when(byte.isin(chars("aeiouAEIOU")), "vowel").when(byte.between(48, 57), "digit")
        .when(byte.isin(chars(".,;:!?\"'-()[]{}")), "punct").when(byte.between(65, 90) | byte.between(97, 122), "consonant").otherwise("other")
    )


def safe_member_name(name: Column, longest: int = 4096) -> Column:
    """A relative path of plain parts."""
    parts = F.split(name, "/")
    return F.coalesce(
        (name != "") & (F.octet_length(name) <= longest) & ~name.startswith("/") & ~F.contains(name, F.lit("\\")) & ~F.contains(name, F.lit("\0"))
        & ~F.exists(parts, lambda p: p.isin("", ".", "..")),
        F.lit(False),
    )


def little_endian(value: Column, width: int) -> Column:
    """Hex digits of an unsigned number, least byte first."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))))


def pick_order(t1: Column, d1: Column, t2: Column, d2: Column) -> Column:
    """The context order whose row is most concentrated, from totals and distinct counts."""
    second = (t2 >= 4) & ((t1 < 2) | (t2 * (d1 + 1) >= t1 * (d2 + 1)))
    return F.when(second, 2).when(t1 >= 2, 1).otherwise(0)


def pick_order_deep(t1: Column, d1: Column, t2: Column, d2: Column, t3: Column, d3: Column) -> Column:
    third = (t3 >= 6) & ((t2 < 4) | (t3 * (d2 + 1) >= t2 * (d3 + 1))) & ((t1 < 2) | (t3 * (d1 + 1) >= t1 * (d3 + 1)))
    return F.when(third, 3).otherwise(pick_order(t1, d1, t2, d2))
