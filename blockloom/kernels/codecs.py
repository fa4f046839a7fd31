"""Engines: blocks to payloads under a mode, and back.

A payload is what is left of a block after its transform: runs of repeats, and the other bytes
through a statistical model that learns from all of them.  Blocks are coded in groups of similar
length, a lane each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from ..plans.levels import method_pipeline, pipeline_method
from . import lexicon, models, shred, transforms
from .coding import side_decode, side_encode, side_sizes
from .framing import pack, unpack
from .matching import distances, parse, read_runs, wire_decode, wire_encode, write_runs
from .transforms import CorruptBlock

BYTE_LANES, BIT_LANES = 256, 384  # a lane of bits takes 1.2 MB
#: Of a group of byte lanes: contexts of the highest order, half a KB each once seen, and steps times lanes.
BYTE_CONTEXTS, BYTE_CELLS = 1 << 20, 1 << 26
#: Sizes below which trials are not worth their time, and their cap on entropy.
STRUCTURED_FLOOR, PLAIN_FLOOR, TRIAL_BITS = 256 << 10, 1 << 20, 7.2


@dataclass(frozen=True)
class Coded:
    method: int
    coded_len: int
    payload: bytes


# Pipelines

_STREAM = (
    (lambda b: b, lambda b: b),
    (transforms.bwt_mtf_rle, transforms.bwt_mtf_rle_inverse),
    (transforms.lzp_bwt_mtf, transforms.lzp_bwt_mtf_inverse),
)


def pick_streams(streams: Sequence[bytes]) -> list[bytes]:
    """A selector and the smallest form of each stream; block sorting wins ties over none."""
    made = [f(data) for data in streams for f, _ in _STREAM]
    sizes, out = side_sizes(made), []
    for at in range(0, len(made), len(_STREAM)):
        best = min((sizes[at + k], k != 1, k) for k in range(len(_STREAM)))[2]
        out.append(bytes((best,)) + made[at + best])
    return out


def pick_stream(data: bytes) -> bytes:
    return pick_streams([data])[0]


def unpick_stream(data: bytes) -> bytes:
    if not data or data[0] >= len(_STREAM):
        raise CorruptBlock("unknown stream selector")
    return _STREAM[data[0]][1](data[1:])


def _split(split: Callable, join: Callable, read: Callable) -> tuple[Callable, Callable]:
    return (
        lambda data, words: pack(pick_streams(split(data).streams())),
        lambda data, words: join(read([unpick_stream(s) for s in unpack(data)])),
    )


PIPELINES: dict[str, tuple[Callable[[bytes, list[bytes]], bytes], Callable[[bytes, list[bytes]], bytes]]] = {
    "raw": (lambda d, w: d, lambda d, w: d),
    "bwt_mtf_rle": (lambda d, w: transforms.bwt_mtf_rle(d), lambda d, w: transforms.bwt_mtf_rle_inverse(d)),
    "lzp_bwt_mtf": (lambda d, w: transforms.lzp_bwt_mtf(d), lambda d, w: transforms.lzp_bwt_mtf_inverse(d)),
    "json_split": _split(shred.json_split, shred.json_join, shred.unpack_json),
    "csv_split": _split(shred.csv_split, shred.csv_join, shred.unpack_csv),
    "xml_split": _split(shred.xml_split, shred.xml_join, shred.unpack_xml),
    "xwrt_bwt_mtf_rle": (
        lambda d, w: transforms.bwt_mtf_rle(lexicon.replace(d, w)), lambda d, w: lexicon.restore(transforms.bwt_mtf_rle_inverse(d), w),
    ),
    "e8e9": (lambda d, w: transforms.e8e9(d), lambda d, w: transforms.e8e9_inverse(d)),
}


def candidates(
    data: bytes, structure: str | None, words: list[bytes], entropy: float, floor: int = STRUCTURED_FLOOR, plain_floor: int = PLAIN_FLOOR, most_bits: float = TRIAL_BITS,
) -> list[str]:
    """Pipelines worth a trial: none for short or near-random blocks; all with floors of 0 and 8 bits."""
    if len(data) < (floor if structure else plain_floor) or entropy > most_bits:
        return ["raw"]
    names = ["raw", "bwt_mtf_rle", "lzp_bwt_mtf"]
    if structure:
        names.append(f"{structure}_split")
    if words and data.isascii():
        names.append("xwrt_bwt_mtf_rle")
    return names


def trial(data: bytes, names: Sequence[str], words: list[bytes]) -> tuple[str, bytes]:
    """The pipeline of least size, the first on ties, with what it made.

    Sizes are of order-0 codes, which the coders after it approach or beat.
    """
    made = {name: PIPELINES[name][0](data, words) for name in names}
    best = names[int(np.argmin(side_sizes([made[n] for n in names])))] if len(names) > 1 else names[0]
    return best, made[best]


def shannon(data: bytes) -> float:
    if not data:
        return 0.0
    p = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    return float(-(p[p > 0] * np.log2(p[p > 0])).sum())


# Blocks

_TEXT_METHODS = {2, 5, 6, 7, 13, 15, 16}


def _coder(method: int, stack: models.Stack | None) -> tuple[str | models.Stack, str]:
    """Model and kind of parse for a method."""
    if method == 1 and stack:
        return stack, "Text"
    if method in _TEXT_METHODS or method == 1:
        return "Text", "Text"
    if method in (3, 4):
        return ("Binary", "Exec")[method - 3], ("Binary", "Exec")[method - 3]
    return ("deep", "Binary") if method in (8, 14) else ("shallow", "Text")


def encode_blocks(
    blocks: Sequence[tuple[str, str | None, bytes]], mode: str, words: list[bytes], floor: int = STRUCTURED_FLOOR, plain_floor: int = PLAIN_FLOOR,
    stack: models.Stack | None = None,
) -> list[Coded]:
    """Payloads of ``(kind, structure, bytes)`` blocks, in their order.

    A ``stack`` of models of one's own codes all blocks but random ones, whatever the mode; the
    same stack is needed to decode them.
    """
    stack = models.check_stack(stack) if stack else None
    out: dict[int, Coded] = {}
    jobs: dict[str | models.Stack, list[tuple[int, int, bytes]]] = defaultdict(list)
    for i, (kind, structure, data) in enumerate(blocks):
        slow = mode == "slow" or mode == "hybrid" and kind in ("Binary", "Exec")
        if mode == "wire" and not stack:
            out[i] = _least(Coded(19, len(data), side_encode(wire_encode(data))), data)
            continue
        if kind == "Random":
            out[i] = Coded(0, len(data), data)
            continue
        if stack:
            method, coded = 1, data
        elif kind == "Exec":
            method, coded = (4 if slow else 14), transforms.e8e9(data)
        elif kind == "Binary":
            method, coded = (3 if slow else 8), data
        elif mode == "general":
            method, coded = 20, data
        else:
            entropy = shannon(data) if len(data) >= min(floor, plain_floor) else 0.0
            name, coded = trial(data, candidates(data, structure, words, entropy, floor, plain_floor), words)
            method = 20 if name == "raw" and not slow else pipeline_method(name, "slow" if slow else "fast")
        jobs[_coder(method, stack)[0]].append((i, method, coded))
    for coder, todo in jobs.items():
        ready = sorted(((i, m, c, parse(c, _coder(m, stack)[1])) for i, m, c in todo), key=lambda x: len(x[2]))
        for group in _groups(ready, coder, [len(x[2]) for x in ready]):
            streams = _encode([g[2] for g in group], coder, [distances(g[3], len(g[2])) for g in group])
            for (i, method, coded, runs), stream in zip(group, streams):
                out[i] = _least(Coded(method, len(coded), pack([side_encode(write_runs(runs)), stream])), blocks[i][2])
    return [out[i] for i in range(len(blocks))]


def _least(coded: Coded, data: bytes) -> Coded:
    return coded if len(coded.payload) < len(data) else Coded(0, len(data), data)


def _groups(ready: list, coder: str | models.Stack, sizes: Sequence[int] = ()) -> Iterator[list]:
    """Groups of bits of equal number, of bytes as large as memory allows, since a step costs few lanes nearly as much as many.

    ``sizes`` are those of the blocks, by rising size.
    """
    if coder in ("deep", "shallow"):
        most, end = BYTE_CONTEXTS >> (coder == "deep"), len(ready)
        while end:
            at, contexts = end, 0
            while at and end - at < BYTE_LANES and (at == end or contexts + min(sizes[at - 1], models.ROWS) <= most and sizes[end - 1] * (end - at + 1) <= BYTE_CELLS):
                at -= 1
                contexts += min(sizes[at], models.ROWS)
            yield ready[at:end]
            end = at
        return
    groups = -(-len(ready) // BIT_LANES)
    for k in range(groups):
        yield ready[k * len(ready) // groups : (k + 1) * len(ready) // groups]


def _encode(blocks: list[bytes], coder: str | models.Stack, back: list[np.ndarray]) -> list[bytes]:
    if coder in ("deep", "shallow"):
        return models.bytes_encode(blocks, coder == "deep", back)
    return models.bits_encode(blocks, models.STACKS.get(coder, coder), back)


def _decode(streams: list[bytes], sizes: list[int], coder: str | models.Stack, back: list[np.ndarray]) -> list[bytes]:
    if coder in ("deep", "shallow"):
        return models.bytes_decode(streams, sizes, coder == "deep", back)
    return models.bits_decode(streams, sizes, models.STACKS.get(coder, coder), back)


def decode_blocks(blocks: Sequence[Coded], words: list[bytes], stack: models.Stack | None = None) -> list[bytes]:
    """The bytes of blocks, in their order; broken payloads and unknown methods raise."""
    stack = models.check_stack(stack) if stack else None
    out: dict[int, bytes] = {}
    jobs: dict[str | models.Stack, list] = defaultdict(list)
    for i, b in enumerate(blocks):
        pipeline = method_pipeline(b.method)
        if b.method == 0:
            out[i] = b.payload
        elif b.method == 19:
            out[i] = wire_decode(side_decode(b.payload), b.coded_len)
        else:
            parts = unpack(b.payload)
            if len(parts) != 2:
                raise CorruptBlock("a payload without its parts")
            jobs[_coder(b.method, stack)[0]].append((b.coded_len, i, pipeline, distances(read_runs(side_decode(parts[0])), b.coded_len), parts[1]))
    for coder, todo in jobs.items():
        todo.sort(key=lambda x: x[0])
        for group in _groups(todo, coder, [x[0] for x in todo]):
            for (_, i, pipeline, _, _), data in zip(group, _decode([g[4] for g in group], [g[0] for g in group], coder, [g[3] for g in group])):
                out[i] = PIPELINES[pipeline][1](data, words)
    return [out[i] for i in range(len(blocks))]
