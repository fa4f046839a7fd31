"""Decontamination against an exhaustive search, and its recall on paraphrases by kind of edit."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import decontaminate


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


def sentences(rng, n=3):
    return " ".join(prose(rng, rng.randint(9, 16)).capitalize() + "." for _ in range(n))


def changed(rng, text, kind):
    words = text.split()
    if kind == "replaced":
        return " ".join(prose(rng, 1) if rng.random() < 0.2 else w for w in words)
    if kind == "dropped":
        return " ".join(w for w in words if rng.random() >= 0.2)
    if kind == "swapped":
        for k in range(0, len(words) - 1, 4):
            words[k], words[k + 1] = words[k + 1], words[k]
        return " ".join(words)
    if kind == "reversed":
        return " ".join(reversed(re.split(r"(?<=[.])\s+", text)))
    return text


KINDS = ("whole", "replaced", "dropped", "swapped", "reversed")


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(13)
    items = [(k, sentences(rng)) for k in range(40)]
    rows, truth = [], {}
    for kind in KINDS:
        for k, t in items:
            body = prose(rng, 150).split()
            at = rng.randrange(150)
            body[at:at] = [changed(rng, t, kind)]
            truth[len(rows)] = (kind, k)
            rows.append((len(rows), " ".join(body)))
    rows += [(len(rows) + k, sentences(rng, 12)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark, docs, bench).collect()}
    return items, rows, truth, found


def test_recall_by_kind_of_edit(planted):
    _, _, truth, found = planted
    for kind in KINDS:
        own = [(d, k) for d, (name, k) in truth.items() if name == kind]
        assert len(found & set(own)) >= 0.9 * len(own), kind
    assert found <= {(d, k) for d, (_, k) in truth.items()}


def test_the_search_finds_what_all_windows_give(planted):
    """Every window of every document against every item, without cosine or literal runs."""
    items, rows, _, found = planted
    size = 16
    read = decontaminate.read_items([k for k, _ in items], [t for _, t in items], size)
    table = pa.array([t for _, t in rows])
    words, terms = decontaminate._words(table)
    names = np.unique(np.concatenate(read.terms))
    place = np.zeros(1 << decontaminate.TERM_BITS, np.int32)
    place[names] = np.arange(1, len(names) + 1)
    blocks, first, _ = decontaminate._blocks(words, size)
    count, used = np.zeros(len(names) + 1), place[terms]
    for b in range(first[-1]):
        count[np.unique(used[(blocks == b) & (used > 0)])] += 1
    total = first[-1] + len(read.owner)
    weight = np.log((1 + total) / (1 + count))
    weight[0] = 0
    search = decontaminate.Search(place, np.zeros((1, 1)), np.zeros((1, 1)), read, weight, size, 0.0, 0.8, 0.55, 0.5, 0.4, 1)
    want = set()
    for row in range(len(rows)):
        span = words.span(row)
        for i, own in enumerate(read.words):
            n = len(own)
            for start in range(span.start, span.stop, size):
                region = words.hashes[max(span.start, start - n) : min(span.stop, start + 2 * size + n)].tolist()
                if decontaminate.verdict(search, i, region) > 0:
                    want.add((rows[row][0], i))
    assert found <= want and len(found) >= 0.98 * len(want) and len(want) > 180


def test_items_are_taken_in_bounded_blocks():
    rng = random.Random(2)
    texts = [prose(rng, 30) for _ in range(50)] + [""]
    items = decontaminate.read_items(list(range(51)), texts, 16)
    blocks = list(decontaminate.bounded_items(items, 100))
    assert [i for b in blocks for i in b.ids] == list(range(51)) and len(blocks) > 5
    for b in blocks:
        assert len(np.unique(np.concatenate([x for x in b.named]))) <= 100 or len(b.ids) == 1
        assert all(b.owner[k] < len(b.ids) for k in range(len(b.owner))) and len(b.terms) == len(b.owner)


def test_candidates_are_those_whose_surroundings_may_hold_the_item():
    """At any cosine: nothing that the verdict takes is left out, and little else comes."""
    rng = random.Random(5)
    size, texts = 16, [sentences(rng) for _ in range(30)] + [sentences(rng, 40)]
    rows = [prose(rng, 90) + " " + changed(rng, t, KINDS[k % 5]) + " " + prose(rng, 40) for k, t in enumerate(texts)] + ["", prose(rng, 900)]
    items = decontaminate.read_items(list(range(len(texts))), texts, size)
    names = np.unique(np.concatenate(items.terms))
    place = np.zeros(1 << decontaminate.TERM_BITS, np.int32)
    place[names] = np.arange(1, len(names) + 1)
    latent = np.random.default_rng(3).standard_normal((len(names) + 1, 8)).astype(np.float32)
    vectors = np.ones((len(items.owner), 8), np.float32)
    search = decontaminate.Search(place, latent, vectors, items, np.ones(len(names) + 1, np.float32), size, -100.0, 0.8, 0.55, 0.5, 0.4, 1)
    words, terms = decontaminate._words(pa.array(rows))
    got, want, windows = set(decontaminate.candidates(search, words, terms)), set(), 0
    for row in range(len(rows)):
        span = words.span(row)
        for start in range(span.start, span.stop, size):
            if (place[terms[start : min(start + size, span.stop)]] > 0).any():
                windows += 1
                for i, own in enumerate(items.words):
                    region = words.hashes[max(span.start, start - len(own)) : min(span.stop, start + 2 * size + len(own))].tolist()
                    if decontaminate.verdict(search, i, region) > 0:
                        want.add((row, start, i))
    assert want <= got and len(want) > 100
    assert len(got) < 0.2 * windows * len(texts)


def test_sums_of_latent_rows_are_those_of_each_run():
    rng = np.random.default_rng(4)
    latent, count = rng.integers(-9, 9, (50, 6)).astype(np.float32), rng.integers(1, 17, 700)
    term, at = rng.integers(0, 50, int(count.sum())), np.cumsum(count) - count
    want = [latent[term[a : a + n]].sum(axis=0) for a, n in zip(at, count)]
    assert np.array_equal(decontaminate.latent_sums(latent, term, at, count), want)
