"""Round trips, malformed input and known values of the byte kernels."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.kernels import classify, codecs, coding, container, lexicon, matching, models, shred, transforms
from blockloom.kernels.framing import get_varint, pack, put_varint, unpack
from blockloom.kernels.transforms import CorruptBlock

BLOCKS = [b"", b"a", b"ab" * 40, b"a" * 300, bytes(range(256)), b"\0" * 600, b"\xff\0\xff", b"banana", b"the quick brown fox, the lazy dog. " * 20]
SMALL = st.one_of(st.binary(max_size=300), st.lists(st.sampled_from(list(b'ab,"\n<>{}:1\0\xff\x01\x04 ')), max_size=200).map(bytes))
PAIRS = [
    (transforms.rle0, transforms.rle0_inverse), (transforms.mtf, transforms.mtf_inverse), (transforms.bwt, transforms.bwt_inverse),
    (transforms.lzp, transforms.lzp_inverse), (transforms.e8e9, transforms.e8e9_inverse), (transforms.bwt_mtf, transforms.bwt_mtf_inverse),
    (transforms.bwt_mtf_rle, transforms.bwt_mtf_rle_inverse), (transforms.lzp_bwt_mtf, transforms.lzp_bwt_mtf_inverse),
    (coding.order0_encode, coding.order0_decode), (coding.side_encode, coding.side_decode), (codecs.pick_stream, codecs.unpick_stream),
]


@pytest.mark.parametrize("there,back", PAIRS, ids=lambda f: f.__name__)
def test_transforms_come_back(there, back):
    for block in BLOCKS:
        assert back(there(block)) == block


@settings(max_examples=60, deadline=None)
@given(SMALL)
def test_any_bytes_come_back(block):
    for there, back in PAIRS:
        assert back(there(block)) == block
    assert matching.wire_decode(matching.wire_encode(block), len(block)) == block
    for name in ("json", "csv", "xml"):
        streams = getattr(shred, f"{name}_split")(block).streams()
        assert getattr(shred, f"{name}_join")(getattr(shred, f"unpack_{name}")(streams)) == block


def test_known_values():
    assert transforms.rle0(b"\0\0\0a\xff") == b"\xff\x03a\xff\x00"
    assert transforms.mtf(b"bbac") == bytes((98, 0, 98, 99))
    assert transforms.bwt(b"banana")[:-4] == b"nnbaaa"
    assert transforms.e8e9(b"\xe8\x00\x00\x00\x00\x90")[:5] == b"\xe8\x05\x00\x00\x00"
    assert len(transforms.e8e9(BLOCKS[4])) == 256


def test_sorting_equals_a_plain_sort_of_rotations():
    rng = random.Random(5)
    for _ in range(40):
        block = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        rows = sorted(range(len(block)), key=lambda i: (block[i:] + block[:i], -i))
        assert transforms.rotation_order(block).tolist() == rows


def test_broken_transforms_raise():
    for call in (
        lambda: transforms.rle0_inverse(b"a\xff"), lambda: transforms.bwt_inverse(b"ab\x09\0\0\0"), lambda: transforms.bwt_inverse(b"abc"),
        lambda: transforms.lzp_inverse(b"\x05\0\0\0\x00a"), lambda: transforms.lzp_inverse(b"\x04\0\0\0\x01\x04\x09\0\0"),
        lambda: matching.wire_decode(b"\xf0", 20), lambda: matching.wire_decode(b"", 0), lambda: coding.side_decode(b""), lambda: coding.order0_decode(b"\x05ab"),
        lambda: codecs.unpick_stream(b"\x09"), lambda: unpack(b"\x02\x01"), lambda: get_varint(b"\x80", 0),
    ):
        with pytest.raises(CorruptBlock):
            call()


def test_frames():
    parts = [b"", b"x" * 200, b"\0"]
    assert unpack(pack(parts)) == parts
    for value in (0, 127, 128, 300, 1 << 40):
        out = bytearray()
        put_varint(out, value)
        assert get_varint(bytes(out), 0) == (value, len(out))


def test_json_streams_hold_keys_strings_and_numbers():
    parts = shred.json_split(b'{"a": 1, "b\\"": ["x", -2.5e3]}')
    assert (parts.keys, parts.strings, parts.numbers) == ([b"a", b'b\\"'], [b"x"], [b"1", b"-2.5e3"])


def test_csv_keeps_returns_blank_lines_and_ragged_rows():
    for data in (b'a,b,"c,d"\r\n\r\n1,2\n', b'x,"un,closed\ny,z', b"a,b\n\n\nc,d,e\n\n", b"1\t2,3\t4\t5\n6\t7\n"):
        parts = shred.csv_split(data)
        assert shred.csv_join(parts) == data
    assert shred.csv_split(b'a,"b,c"\n').fields == [2, 1]


def test_joins_refuse_missing_and_spare_pieces():
    a, c, x = shred.json_split(b'{"a": 1}'), shred.csv_split(b"a,b\nc,d"), shred.xml_split(b'<a b="c">t</a>')
    a.numbers.append(b"2")
    c.columns[0].pop()
    x.text.clear()
    for join, parts in ((shred.json_join, a), (shred.csv_join, c), (shred.xml_join, x)):
        with pytest.raises(CorruptBlock):
            join(parts)


def test_xml_streams():
    parts = shred.xml_split(b'<?xml version="1.0"?><a><b c="d"/>text</a>')
    assert parts.attrs == [b' version="1.0"', b' c="d"'] and parts.text == [b"text"]
    assert parts.tags == [b"<?xml", b"?>", b"<a", b">", b"<b", b"/>", b"</a", b">"]


def test_dictionary_ranks_tiers_and_replacement():
    counts = [(f"w{i:03d}".encode(), 1000 - i) for i in range(130)] + [(b"zzz", 5), (b"long", 4)]
    words = lexicon.choose(counts)
    assert words[:127] == [w for w, _ in counts[:127]] and b"zzz" not in words and words[-1] == b"long"
    text = b"the theme, the themes; " * 50
    found = lexicon.build(text)
    coded = lexicon.replace(text, found)
    assert len(coded) < len(text) and lexicon.restore(coded, found) == text and lexicon.read(lexicon.write(found)) == found
    assert lexicon.replace(b"abab", [b"ab", b"aba"]) == b"\x80\x80"
    with pytest.raises(CorruptBlock):
        lexicon.restore(b"\x85", [b"one"])
    with pytest.raises(ValueError):
        lexicon.replace("é".encode(), found)


def test_parse_is_the_cheapest():
    def least(data, kind, found):
        n = len(data)
        cost = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            cost[i] = cost[i + 1] + matching.LITERAL_BITS[kind]
            for length in found.get(i, ()):
                cost[i] = min(cost[i], matching.MATCH_BITS + cost[i + length])
        return cost[0]

    data = b"abcdefghijklmnop-abcdefghijklmnop+abcdefghijklmnop"
    runs = matching.parse(data, "Text")
    assert matching.distances(runs, len(data)).tolist() == [0] * 17 + [17] * 16 + [0] + [runs[1].distance] * 16
    assert matching.parse_cost(data, "Text", runs) == least(data, "Text", {17: [16], 34: [16]})
    assert matching.read_runs(matching.write_runs(runs)) == runs
    for broken in ([(0, 4, 9)], [(4, 3, 0)], [(4, 9, 1)], [(5, 3, 1), (6, 2, 1)], [(5, 0, 1)]):
        with pytest.raises(CorruptBlock):
            matching.distances([matching.Run(*r) for r in broken], 12)
    history = b"0123456789abcdefghij"
    assert [(r.at, r.distance) for r in matching.parse(history, "Binary", history)] == [(0, 20)]


def test_frequencies_fill_the_scale():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 3, 256) * rng.integers(1, 10_000, 256)
        freq = coding.normalise(counts)
        assert freq.sum() == (coding.SCALE if counts.sum() else 0) and ((freq > 0) == (counts > 0)).all()


@pytest.mark.parametrize("deep", [False, True])
def test_byte_models(deep):
    sizes = [len(b) for b in BLOCKS]
    streams = models.bytes_encode(BLOCKS, deep)
    assert models.bytes_decode(streams, sizes, deep) == BLOCKS
    assert sum(map(len, streams)) < sum(sizes)
    with pytest.raises(CorruptBlock):
        models.bytes_decode([s[:-2] for s in streams], sizes, deep)


@pytest.mark.parametrize("stack", list(models.STACKS))
def test_bit_models(stack):
    streams = models.bits_encode(BLOCKS, models.STACKS[stack])
    assert models.bits_decode(streams, [len(b) for b in BLOCKS], models.STACKS[stack]) == BLOCKS
    assert len(streams[3]) < 30


def test_models_learn_from_copied_bytes():
    """Copies cost nothing, come back, and make what follows cheaper than if only the rest were seen."""
    rng = random.Random(7)
    piece = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    data = piece * 3 + piece[:200] + b"!" + piece[200:]
    runs = [matching.Run(400, 255, 400), matching.Run(655, 255, 400), matching.Run(910, 255, 400)]
    back = [matching.distances(runs, len(data)), np.zeros(5, np.int32)]
    for there, again, model in ((models.bytes_encode, models.bytes_decode, True), (models.bits_encode, models.bits_decode, models.STACKS["ppm3"])):
        streams = there([data, b"other"], model, back)
        assert again(streams, [len(data), 5], model, back) == [data, b"other"]
        rest = b"".join(data[i : i + 1] for i in range(len(data)) if not back[0][i])
        assert len(streams[0]) < len(there([rest], model)[0])


def low_nibbles(model):
    return 20, model.last[0] & 15, model.last[1] & 15


@pytest.mark.parametrize("stack", [("order1", "order2"), ("order0", low_nibbles, "match", "ppm")])
def test_stacks_of_ones_own(stack):
    packed = container.compress_archive(mixed(), "wire", stack)
    assert container.decompress_archive(packed, stack) == mixed()
    assert len(packed) < sum(len(d) for _, d in mixed())
    with pytest.raises((CorruptBlock, ValueError)):
        container.decompress_archive(packed, ("order0",))


def test_stacks_are_checked():
    for stack in (("order9",), ("match", "ppm")):
        with pytest.raises(ValueError):
            container.compress(b"some text " * 20, stack=stack)


def test_models_move_towards_what_they_see():
    mixer, inputs, bank = models.Mixer(1, 2, 1), np.array([[1.0, -0.5]]), np.zeros(1, int)
    before = mixer.mix(inputs, bank)[0]
    mixer.update(np.array([1]), np.array([True]))
    assert mixer.mix(inputs, bank)[0] > before
    heavy = mixer.weight.copy()
    mixer.decay()
    assert (np.abs(mixer.weight - 0.5) < np.abs(heavy - 0.5) + 1e-12).all()
    banks = models.Banks(1, 2, (4, 1))
    before = banks.mix(inputs, (np.array([3]), bank))[0]
    banks.update(np.array([1]), np.array([True]))
    assert banks.mix(inputs, (np.array([3]), bank))[0] > before
    assert (banks.mixers[0].weight[0, :3] == banks.mixers[0].weight[0, 0]).all() and banks.mixers[0].weight[0, 3, 0] > banks.mixers[0].weight[0, 0, 0]
    refiner = models.Refiner(1, 1)
    before = refiner.refine(np.array([0.3]), bank)[0]
    refiner.update(np.array([1]), np.array([True]))
    assert refiner.refine(np.array([0.3]), bank)[0] > before


def test_selectors():
    assert models.concentrated(5, 1, 5, 1) == 2 and models.concentrated(5, 1, 3, 1) == 1 and models.concentrated(1, 1, 3, 1) == 0
    assert models.concentrated_deep(5, 2, 5, 2, 9, 1) == 3 and models.concentrated_deep(50, 1, 50, 1, 6, 5) == 2


def test_classes():
    text, noise = b"plain text " * 20, random.Random(1).randbytes(4000)
    assert classify.classify(text) == "Text" and classify.classify(noise) == "Random" and classify.classify(text[:31]) == "Random"
    assert classify.classify(b"\x7fELF" + b"\x01\x02" * 40) == "Exec" and classify.classify(b"\x55\x89\xe5\x01\x02" * 20) == "Exec"
    assert classify.classify(b"\x01\x02\x03" * 40) == "Binary"
    assert classify.measure(b"") == (0, 0.0, 0.0, False) and classify.measure(b"aabb")[1] == 1.0
    assert classify.cut(b"") == [] and classify.cut(noise * 20)[0][:2] == (0, 64 << 10)
    assert sum(b - a for a, b, _ in classify.cut(noise * 40, window=1000)) == len(noise) * 40
    assert len(classify.cut(bytes(9 << 20), wire=True)) == 3


def mixed():
    rows = json.dumps([{"id": i, "name": f"user{i}"} for i in range(60)]).encode()
    table = "\n".join(f'{i},n{i % 7},"a,b{i}"' for i in range(60)).encode()
    page = b'<?xml version="1.0"?><r>' + b"".join(b'<it id="%d">x%d</it>' % (i, i) for i in range(40)) + b"</r>"
    code = b"\x7fELF" + b"".join(b"\x55\x89\xe5\xe8" + (i * 7).to_bytes(4, "little") for i in range(40))
    return [("text", b"Once upon a time, " * 30), ("rows.json", rows), ("t/table.csv", table), ("page.xml", page), ("code", code), ("noise", random.Random(3).randbytes(600)), ("none", b"")]


@pytest.mark.parametrize("mode", ["wire", "general", "fast", "hybrid", "slow"])
def test_containers_come_back(mode):
    packed = container.compress_archive(mixed(), mode, floor=64, plain_floor=64)
    assert container.decompress_archive(packed) == mixed()
    assert len(packed) < sum(len(d) for _, d in mixed())


def test_broken_containers_raise():
    packed = container.compress_archive(mixed(), "fast")
    for broken in (b"", b"XXXX" + packed[4:], packed[:4] + b"\x09" + packed[5:], packed[:-1], packed + b"x", packed[:40]):
        with pytest.raises((container.InvalidContainer, CorruptBlock)):
            container.decompress_archive(broken)
    flipped = bytearray(packed)
    flipped[-1] ^= 1
    with pytest.raises(CorruptBlock):
        container.decompress_archive(bytes(flipped))
    with pytest.raises(ValueError):
        container.compress_archive([], "fast")
    with pytest.raises(ValueError):
        container.compress_archive([("../x", b"")], "fast")
    with pytest.raises(container.InvalidContainer):
        container.decompress(packed)
    assert container.decompress(container.compress(b"alone")) == b"alone"


def test_crc_is_of_the_original_bytes():
    data = b"stored as it is"
    packed = container.compress(data, "wire")
    assert zlib.crc32(data).to_bytes(4, "little") in packed


def test_unknown_methods_raise():
    with pytest.raises(ValueError):
        codecs.decode_blocks([codecs.Coded(99, 1, b"a")], [])


def test_trials():
    long = b"a,b,c\n" * 60_000
    assert codecs.candidates(b"x" * 1000, "json", [], 4.0) == ["raw"]
    assert codecs.candidates(long, "csv", [], 4.0) == ["raw", "bwt_mtf_rle", "lzp_bwt_mtf", "csv_split"]
    assert codecs.candidates(long, None, [], 4.0) == ["raw"] and codecs.candidates(long, "csv", [], 7.3) == ["raw"]
    assert codecs.candidates(long, "csv", [b"a"], 4.0)[-1] == "xwrt_bwt_mtf_rle"
    name, made = codecs.trial(b"abc " * 400, ["raw", "bwt_mtf_rle"], [])
    assert name == "bwt_mtf_rle" and codecs.PIPELINES[name][1](made, []) == b"abc " * 400


def test_short_blocks_are_sorted_as_long_ones():
    rng = random.Random(12)
    for n in (1, 2, 3, 30, transforms.SHORT - 1, transforms.SHORT, transforms.SHORT + 1):
        for data in (bytes(rng.choice(b"ab") for _ in range(n)), b"ab" * (n // 2) + b"a" * (n % 2), bytes(n)):
            order = transforms.rotation_order(data)
            last = bytes(data[k - 1] for k in order.tolist())
            assert transforms.bwt(data) == last + int(np.flatnonzero(order == 0)[0]).to_bytes(4, "little") and transforms.bwt_inverse(transforms.bwt(data)) == data
    streams = [b"", b"a", b"ab" * 40, bytes(600), b"1,2,3"]
    assert codecs.pick_streams(streams) == [codecs.pick_stream(s) for s in streams] and codecs.pick_streams([]) == []


def test_byte_models_keep_rows_for_seen_contexts_only():
    rng = np.random.default_rng(6)
    blocks = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (0, 1, 900, 40, 2500, 900)]
    sizes = np.array(sorted(map(len, blocks), reverse=True))
    assert len(models.ByteModel(sizes, True).count) <= 1 + 4 * sizes.sum() < 256 * sum(1 for b in blocks) * 12
    for deep in (False, True):
        streams = models.bytes_encode(blocks, deep)
        assert streams == [models.bytes_encode([b], deep)[0] for b in blocks]  # lanes do not depend on each other
        assert models.bytes_decode(streams, [len(b) for b in blocks], deep) == blocks


def chained(data, kind):
    """The parse of least cost, place by place."""
    least, bits = matching.LEAST_BY_KIND.get(kind, matching.PARSE_LEAST), matching.LITERAL_BITS[kind]
    heads, found, n = {}, [], len(data)
    for at in range(n):
        key, length, distance = data[at : at + least], 0, 0
        if len(key) == least:
            for j in reversed(heads.setdefault(key, [])[-matching.CHAIN :]):
                if (k := matching.match_length(data, j, at, matching.PARSE_MOST)) > length:
                    length, distance = k, at - j
            heads[key].append(at)
        found.append((length, distance))
    cost, take = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        cost[i], length = cost[i + 1] + bits, found[i][0]
        if length and cost[i + length] + matching.MATCH_BITS < cost[i]:
            cost[i], take[i] = cost[i + length] + matching.MATCH_BITS, length
    runs, i = [], 0
    while i < n:
        if take[i]:
            runs.append(matching.Run(i, take[i], found[i][1]))
        i += take[i] or 1
    return runs


def test_parses_are_those_place_by_place():
    rng = random.Random(21)
    piece = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    blocks = [b"", b"a" * 11, b"a" * 900, b"abc" * 300, piece * 4 + b"!" + piece[5:60] * 3, bytes(rng.choice(b"ab") for _ in range(1500))]
    for data in blocks:
        for kind in ("Text", "Binary"):
            assert matching.parse(data, kind) == chained(data, kind)
    calls = []
    measured, matching.match_length = matching.match_length, lambda *x: calls.append(x) or measured(*x)
    try:
        matching.parse(piece * 4, "Text")
    finally:
        matching.match_length = measured
    assert len(calls) < 30  # a run is measured at its end only, not at each of its places


def test_lanes_alone_write_what_many_do(monkeypatch):
    rng = np.random.default_rng(15)
    blocks = [bytes(rng.choice([97, 98, 99, 120, 255], n, p=[0.6, 0.2, 0.1, 0.05, 0.05]).astype(np.uint8)) for n in (0, 1, 900, 40, 2500, 900)]
    blocks += [rng.integers(0, 256, 1500).astype(np.uint8).tobytes(), bytes(1200)]
    back = [matching.distances(matching.parse(b, "Text"), len(b)) for b in blocks]
    for deep in (False, True):
        made = []
        for alone in (0, 2, 5, 40):
            monkeypatch.setattr(models, "ALONE", alone)
            made.append(models.bytes_encode(blocks, deep, back))
            assert models.bytes_decode(made[-1], [len(b) for b in blocks], deep, back) == blocks
        assert all(m == made[0] for m in made)
        with pytest.raises(CorruptBlock):
            models.bytes_decode([s[:-2] for s in made[0]], [len(b) for b in blocks], deep, back)
    groups = list(codecs._groups(list(range(3000)), "shallow", [100] * 2000 + [5000] * 1000))
    assert sorted(k for g in groups for k in g) == list(range(3000)) and len(groups) < 14 and max(map(len, groups)) <= codecs.BYTE_LANES
    assert list(codecs._groups([7], "deep", [1 << 30])) == [[7]] and list(codecs._groups([], "deep", [])) == []


def test_sizes_round_down_right():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 257, (300, 256)).astype(np.uint16) * (rng.random((300, 256)) < rng.random((300, 1)))
    counts[0] = 0
    total = counts.sum(axis=1).astype(np.int64)
    want = 1 + counts.astype(np.int64) * (coding.SCALE - 256) // np.maximum(total, 1)[:, None]
    want[:, 255] += coding.SCALE - want.sum(axis=1)
    starts, lanes = np.cumsum(want, axis=1) - want, np.arange(300)
    sizes = models.Sizes(counts, total)
    for byte in (0, 1, 15, 16, 100, 254, 255):
        start, size = sizes.of(np.full(300, byte))
        assert (start == starts[:, byte]).all() and (size == want[:, byte]).all()
        for slot in (start, start + size - 1):
            found = sizes.find(slot)
            assert (found[0] == byte).all() and (found[1] == start).all() and (found[2] == size).all()


def test_sizes_of_side_streams():
    rng = random.Random(8)
    parts = [b"", b"a", b"ab" * 40, bytes(5000), bytes(rng.randrange(256) for _ in range(700))]
    parts += [bytes(min(255, int(rng.expovariate(0.1))) for _ in range(n)) for n in (31, 32, 33, 64, 1000, 4097)]
    assert coding.side_sizes(parts, most=3000) == coding.side_sizes(parts) == [len(coding.side_encode(p)) for p in parts]
    assert coding.side_sizes([]) == []


def test_bit_models_take_many_lanes_and_drop_those_that_ended():
    groups = [len(g) for g in codecs._groups(list(range(codecs.BIT_LANES + 2)), "Text")]
    assert groups == [codecs.BIT_LANES // 2 + 1] * 2 and codecs.BIT_LANES >= 256 and list(codecs._groups([], "Text")) == []
    model = models.BitModel(4, models.STACKS["Text"])
    model.narrow(2)
    assert len(model.predict()) == 2
    rng = np.random.default_rng(9)
    blocks = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (0, 70, 3, 200, 200)]
    for stack in models.STACKS.values():
        streams = models.bits_encode(blocks, stack)
        assert streams == [models.bits_encode([b], stack)[0] for b in blocks]  # lanes do not depend on each other
        assert models.bits_decode(streams, [len(b) for b in blocks], stack) == blocks


#: MD5 of the streams that the models of version 2 wrote, by stack.
STREAMS = {
    "Text": "0a75f0367c4b45aae1304aa70d89f8b1", "Binary": "b1eb71beb79b29edb80c636ccd3cd618",
    "Exec": "d07025074ddc1c79a6d6a480a5dc7ea8", "baseline": "2d0aa0a83f10eb570cbe097879254579",
    "ppm3": "f04b606b61e24c81bd66f578e060c492", "ppmd": "cc607fcc15e772a08c6d637e894691fa",
    "indirect": "aa29f130435652643c0d69156d9446f9",
}


def test_bit_streams_are_those_of_earlier_archives():
    blocks = [*BLOCKS, bytes(k * k % 251 for k in range(700)), b'{"a": 1, "b": [2, 3]}\n' * 30]
    made = {name: hashlib.md5(b"".join(models.bits_encode(blocks, stack))).hexdigest() for name, stack in models.STACKS.items()}
    assert made == STREAMS
