"""Benchmark items in documents, paraphrases included, by latent semantic search.

1. Passages are runs of words, folded to lower case and split at ASCII punctuation too.  Spark
   counts in how many passages of the corpus's different texts each benchmark term occurs.
   In the same pass it counts how often each two of them stand in one passage, for all passages.
2. The TF-IDF passages of the benchmark and of the whole corpus get a latent space by a randomised
   SVD: products of the counted pairs with a random, then an orthogonal, narrow matrix are made
   by Spark, a row of terms each, so that only matrices of fixed width come to the driver, and
   of bounded height, since items are taken in blocks of at most MAX_TERMS terms.
3. Each passage of each document is projected, two neighbouring blocks of words at a time, and
   compared by cosine with all items, in blocks of items.  Beside it, every run of words is
   looked up among the items' own, so that a literal passage needs no weight to be found.
4. A candidate is a leak if the longest common subsequence covers most of the item.  A paraphrase
   covers less, in other order: there the common subsequences of the item's sentences, each by
   itself, must cover enough words, the words found must carry enough of the item's weight, and
   the answer, the last sentence, must be there too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import Words, chunks, split_words, trim, window_hashes

TERM_BITS = 20
RUN_WORDS = 8
RUN_BITS = 24
#: Terms of a run of words are marked in so many bits.
MARK_BITS = 4096
#: The latent space of a block of items has at most so many rows.
MAX_TERMS = 1 << 15
#: Pairs of terms that a task holds at once.
MOST_PAIRS = 1 << 22
#: A matrix of pairs that a task holds whole.
MOST_CELLS = 1 << 24
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
BREAKS = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def _words(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = split_words(pc.utf8_lower(column), breaks=BREAKS)
    return words, (words.hashes & np.uint64((1 << TERM_BITS) - 1)).astype(np.int64)


def _blocks(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its block of ``size`` words, counted over all rows; for each row its first block."""
    per_row = -(-np.diff(words.first) // size)
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(per_row)), np.diff(words.first))
    return first[row] + (np.arange(len(row)) - words.first[row]) // size, first, row


def _counted(rows: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """``(row, at, n)``: counts by row, whose numbers must ascend, as bytes."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(rows))
    parts = [(int(rows[a]), values[a:b].astype("<i4").tobytes(), counts[a:b].astype("<i8").tobytes()) for a, b in zip(first.tolist(), ends.tolist())]
    columns = list(zip(*parts)) if parts else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["row", "at", "n"])


class _Pairs:
    """How often each two terms stand in one passage: the upper half of A'A for A's counts.

    A matrix of MOST_CELLS at most is held whole; of a larger one pairs are counted MOST_PAIRS at a time.
    """

    def __init__(self, terms: int):
        self.terms = terms
        self.whole = np.zeros(terms * terms, np.uint32) if terms * terms <= MOST_CELLS else None
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, passage: np.ndarray, term: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Terms in the order of their passages' numbers."""
        step = 0
        while step < len(term):
            same = np.flatnonzero(passage[step:] == passage[: len(passage) - step])
            if not len(same):
                break
            one, other = term[same].astype(np.int64), term[same + step]
            at = np.minimum(one, other) * self.terms + np.maximum(one, other)
            for at in (at, at[one == other])[: 1 + (step > 0)]:  # both orders of a term with itself
                if self.whole is not None:
                    np.add.at(self.whole, at, np.uint32(1))
                else:
                    self.held.append(at)
                self.size += len(at)
            step += 1
            if self.size > (MOST_PAIRS if self.whole is None else 1 << 31):
                yield from self.rows()

    def rows(self, step: int = 256) -> Iterator[pa.RecordBatch]:
        """What was counted since the last call, of both orders the one by number."""
        if self.whole is not None:
            for first in range(0, self.terms, step):
                part = self.whole[first * self.terms : (first + step) * self.terms]
                at = np.flatnonzero(part)
                yield _counted(first + at // self.terms, at % self.terms, part[at])
                part[at] = 0
        else:
            at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
            self.held = []
            yield _counted(at // self.terms, at % self.terms, n)
        self.size = 0


def corpus_counts(batches: Iterator[pa.RecordBatch], place: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    """``(row, at, n)``: pairs of benchmark terms in passages of two blocks, by the first's row, and in row -1 in how many
    blocks each term occurs; term 0 counts all blocks, and in row 0 all passages."""
    trim()
    at = place.value
    count, pairs, passages = np.zeros(int(at.max()) + 1, np.int64), _Pairs(int(at.max()) + 1), 0
    for batch in batches:
        for part in chunks(batch, "text"):
            words, terms = _words(part.column("text"))
            block, first, _ = _blocks(words, size)
            term = at[terms]
            used = term > 0
            both = np.unique(block[used] * len(count) + term[used])
            count += np.bincount(both % len(count), minlength=len(count))
            count[0] += first[-1]
            passage, first, _ = _blocks(words, 2 * size)
            passages += int(first[-1])
            yield from pairs.add(passage[used], term[used])
    yield from pairs.rows()
    del pairs
    yield _counted(np.zeros(1, int), np.zeros(1, int), np.array([passages]))
    used = np.flatnonzero(count)
    yield _counted(np.full(len(used), -1), used, count[used])
    trim()


def _passage_pairs(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """The same pairs of passages ``(terms array<long>)``."""
    pairs = _Pairs(terms)
    for batch in batches:
        lists = batch.column("terms").to_pylist()
        yield from pairs.add(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([t for x in lists for t in x], np.int64))
    yield from pairs.rows()
    del pairs
    trim()


def _summed(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """One row for each number, from rows in the order of their numbers."""
    last, total = None, np.zeros(terms, np.int64)

    def made() -> pa.RecordBatch:
        used = np.flatnonzero(total)
        return _counted(np.full(len(used), last), used, total[used])

    for batch in batches:
        for row, at, n in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "n"))):
            if row != last and last is not None:
                yield made()
                total[:] = 0
            last = row
            total[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
    if last is not None:
        yield made()


COUNTS = "row int, at binary, n binary"


def summed(counts: DataFrame, terms: int) -> DataFrame:
    return counts.repartition("row").sortWithinPartitions("row").mapInArrow(lambda it: _summed(it, terms), COUNTS)


def _weighed(batches: Iterator[pa.RecordBatch], matrix: Broadcast, weight: Broadcast) -> Iterator[pa.RecordBatch]:
    """Sums over this task's rows of the weighted pairs' product with a matrix, both orders of a pair."""
    o, w = matrix.value, weight.value
    total = np.zeros(o.shape)
    for batch in batches:
        for row, at, n, share in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "n", "share"))):
            at = np.frombuffer(at, "<i4")
            value = share * w[row] * w[at] * np.frombuffer(n, "<i8")
            total[row] += value @ o[at]
            later = at > row
            total[at[later]] += value[later, None] * o[row]
    used = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i].tobytes() for i in used], pa.binary())], ["row", "part"])
    del total
    trim()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each number, from rows in the order of their numbers."""
    last, total = None, 0
    for batch in batches:
        for row, part in zip(batch.column("row").to_pylist(), batch.column("part").to_pylist()):
            if row != last and last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["row", "part"])
                total = 0
            last, total = row, total + np.frombuffer(part)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["row", "part"])


@dataclass
class Items:
    """Benchmark items: their words by hash, where sentences and the answer start, and the terms of
    words and of passages."""

    ids: list
    words: list[list[int]]
    sentences: list[list[int]]
    question: list[int]
    named: list[np.ndarray]
    owner: np.ndarray
    terms: list[np.ndarray]

    def some(self, keep: list[int]) -> Items:
        """The items at some places."""
        new = {old: i for i, old in enumerate(keep)}
        at = [k for k, o in enumerate(self.owner.tolist()) if o in new]
        pick = lambda x: [x[i] for i in keep]
        return Items(
            pick(self.ids), pick(self.words), pick(self.sentences), pick(self.question), pick(self.named),
            np.array([new[int(self.owner[k])] for k in at], np.int64), [self.terms[k] for k in at],
        )


def _sentence_end(text: str) -> int:
    """Where the last sentence of a text starts, if it isn't the only one."""
    body = text.rstrip(" \t\r\n.!?")
    return max(body.rfind(x) + 1 for x in (". ", "! ", "? ", "\n", ".\n"))


def read_items(ids: list, texts: list[str], size: int) -> Items:
    words, sentences, question, named, owner, terms = [], [], [], [], [], []
    for i, text in enumerate(texts):
        table, term = _words(pa.array([text or ""], pa.string()))
        lengths: list[int] = []
        for k in np.diff(_words(pa.array(SENTENCE.split(text or ""), pa.string()))[0].first).tolist():
            if lengths and (k < 4 or lengths[-1] < 4):  # short ones have no order of their own
                lengths[-1] += k
            elif k:
                lengths.append(k)
        sentences.append(np.cumsum([0, *lengths]).tolist())
        named.append(term)
        cut, _ = _words(pa.array([(text or "")[: _sentence_end(text or "")]], pa.string()))
        n = len(table.hashes)
        asked = len(cut.hashes) if 0 < len(cut.hashes) <= n - 3 else n - max(3, n // 4)
        words.append(table.hashes.tolist())
        question.append(max(0, asked))
        last = max(0, n - 2 * size)
        for start in sorted({*range(0, last, size), last}) if n else ():
            owner.append(i)
            terms.append(term[start : start + 2 * size])
    return Items(ids, words, sentences, question, named, np.array(owner, np.int64), terms)


def bounded_items(items: Items, most: int = MAX_TERMS) -> Iterator[Items]:
    """Items in blocks of at most ``most`` different terms, or of one item."""
    block: list[int] = []
    seen: set[int] = set()
    for i, named in enumerate(items.named):
        both = seen.union(named.tolist())
        if block and len(both) > most:
            yield items.some(block)
            block, both = [], set(named.tolist())
        block.append(i)
        seen = both
    if block:
        yield items.some(block)


def latent_space(spark: SparkSession, pairs: DataFrame, weight: np.ndarray, rank: int, extra: int = 8, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Right singular vectors, one column each, of the weighted passages A whose pairs A'A are
    ``(row, at, n, share)``, a row being the sum of its own, each times its share.

    Each round multiplies by A'A in Spark and makes the result orthogonal here; the last step
    rotates it by the eigenvectors of the small matrix Q'(A'A)Q.
    """
    width = min(rank + extra, len(weight))
    q = np.random.default_rng(seed).standard_normal((len(weight), width))
    shared = spark.sparkContext.broadcast(weight)

    def product(matrix: np.ndarray) -> np.ndarray:
        given = spark.sparkContext.broadcast(matrix)
        kind = "row int, part binary"
        parts = pairs.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(lambda it: _weighed(it, given, shared), kind)
        rows = parts.repartition("row").sortWithinPartitions("row").mapInArrow(_joined, kind).toArrow()
        out = np.zeros((len(weight), width))
        for row, part in zip(rows.column("row").to_pylist(), rows.column("part").to_pylist()):
            out[row] = np.frombuffer(part)
        return out

    for _ in range(rounds):
        q, _ = np.linalg.qr(product(q))
    values, vectors = np.linalg.eigh(q.T @ product(q))
    order = np.argsort(-values)[:rank]
    return q @ vectors[:, order[values[order] > 1e-9 * max(values.max(), 1e-300)]]


def randomised_svd(spark: SparkSession, passages: DataFrame, weight: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors, one column each, of the weighted passages ``(terms array<long>)``."""
    return latent_space(spark, passage_pairs(spark, passages, len(weight)).withColumn("share", F.lit(1.0)), weight, rank)


def passage_pairs(spark: SparkSession, passages: DataFrame, terms: int) -> DataFrame:
    return Scratch(spark).save(summed(passages.mapInArrow(lambda it: _passage_pairs(it, terms), COUNTS), terms))


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        if x in places:
            both = row & places[x]
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


@dataclass
class Search:
    """What a task needs: places and latent rows of terms, item vectors and words, and the limits."""

    place: np.ndarray
    latent: np.ndarray
    vectors: np.ndarray
    items: Items
    weight: np.ndarray
    size: int
    cosine: float
    whole: float
    asked: float
    weighed: float
    answered: float
    least: int

    def __post_init__(self) -> None:
        self.heavy = np.abs(self.latent).max(axis=1, initial=0) > 0
        self.counts = [Counter(w) for w in self.items.words]
        self.weights = [dict(zip(w, self.weight[self.place[t]].tolist())) for w, t in zip(self.items.words, self.items.named)]
        self.runs = []
        for width in sorted({min(len(w), RUN_WORDS) for w in self.items.words if w}):
            own = [i for i, w in enumerate(self.items.words) if min(len(w), RUN_WORDS) == width]
            hashes = [window_hashes(np.array(self.items.words[i], np.uint64), width) for i in own]
            owner, run = np.repeat(own, [len(h) for h in hashes]), np.concatenate(hashes)
            order = np.lexsort((owner, run))
            may = np.zeros(1 << RUN_BITS, bool)
            may[run & np.uint64((1 << RUN_BITS) - 1)] = True
            self.runs.append((width, run[order], owner[order], may))
        self.lengths = np.array([len(w) for w in self.items.words], np.int64)
        owner = np.repeat(np.arange(len(self.lengths)), [len(t) for t in self.items.named])
        self.marks = term_marks(owner, self.place[np.concatenate([np.zeros(0, np.int64), *self.items.named])], len(self.lengths))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("heavy", "counts", "runs", "weights", "lengths", "marks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()


def term_marks(run: np.ndarray, term: np.ndarray, runs: int) -> np.ndarray:
    """A row of bits for each run, with the bit of each of its terms set; term 0 has none."""
    out = np.zeros(runs * (MARK_BITS >> 6), np.uint64)
    used = term > 0
    bit = term[used].astype(np.int64) % MARK_BITS
    np.bitwise_or.at(out, run[used] * (MARK_BITS >> 6) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(runs, MARK_BITS >> 6)


def may_hold(search: Search, tables: list[np.ndarray], low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether blocks from low up to high can hold as much of an item as :func:`verdict` asks for first.

    Each bit that an item has and the blocks lack is a word at least that they lack.  ``tables``
    has the marks of each block, then of each two blocks in a row, each four and so on.
    """
    level = np.frexp((high - low).astype(float))[1] - 1
    while len(tables) <= level.max(initial=0):
        last, width = tables[-1], 1 << len(tables) - 1
        tables.append(last.copy())
        tables[-1][:-width] |= last[width:]
    lacks = np.zeros(len(low), np.int64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        held = tables[k][low[at]] | tables[k][high[at] - (1 << k)]
        lacks[at] = np.bitwise_count(search.marks[item[at]] & ~held).sum(axis=1)
    n = search.lengths[item]
    return n - lacks >= min(search.asked, search.whole) * n


def latent_sums(latent: np.ndarray, term: np.ndarray, at: np.ndarray, count: np.ndarray, step: int = 256) -> np.ndarray:
    """Sums of the latent rows of runs of terms that start at ``at``, as many as ``count``.

    Runs go by falling length, a few at a time: those that have a k-th term stand in front.
    """
    out = np.empty((len(at), latent.shape[1]), latent.dtype)
    order = np.argsort(-count, kind="stable")
    for low in range(0, len(at), step):
        some = order[low : low + step]
        start, size = at[some], count[some]
        total = latent[term[start]]
        for k in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -k))
            total[:n] += latent[term[start[:n] + k]]
        out[some] = total
    return out


def candidates(search: Search, words: Words, terms: np.ndarray, step: int = 8192) -> Iterator[tuple[int, int, int]]:
    """``(row, first word, item)`` of document passages near a passage of an item, without those
    whose surroundings lack too many of its words."""
    block, first, row = _blocks(words, search.size)
    term = search.place[terms]
    used = np.flatnonzero(term > 0)
    used = used[search.heavy[term[used]]]
    if not len(used):
        return
    at = np.flatnonzero(np.concatenate([[True], np.diff(block[used]) > 0]))
    ids, rows, count = block[used[at]], row[used[at]], np.diff(np.append(at, len(used)))
    joined = np.zeros(len(at), bool)
    joined[:-1] = (ids[1:] == ids[:-1] + 1) & (rows[1:] == rows[:-1])
    both = count + np.where(joined, np.append(count[1:], 0), 0)
    enough = np.flatnonzero(both >= search.least)
    if not len(enough):
        return
    sums = latent_sums(search.latent, term[used], at, count)
    pairs = sums[enough]
    second = np.flatnonzero(joined[enough])
    pairs[second] += sums[enough[second] + 1]
    ids, rows = ids[enough], rows[enough]
    norm = np.linalg.norm(pairs, axis=1)
    pairs /= np.maximum(norm, 1e-12)[:, None]
    tables = [term_marks(block, term, int(first[-1]))]
    reach, items = -(-search.lengths // search.size), len(search.lengths)
    for start in range(0, len(pairs), step):
        near = np.flatnonzero((pairs[start : start + step] @ search.vectors.T).reshape(-1) >= search.cosine)
        near = np.unique(near // len(search.vectors) * items + search.items.owner[near % len(search.vectors)])
        for part in range(0, len(near), step):
            p, item = near[part : part + step] // items + start, near[part : part + step] % items
            r = rows[p]
            low, high = np.maximum(first[r], ids[p] - reach[item]), np.minimum(first[r + 1], ids[p] + 2 + reach[item])
            may = may_hold(search, tables, low, high, item)
            p, r, item = p[may], r[may], item[may]
            yield from zip(r.tolist(), (words.first[r] + (ids[p] - first[r]) * search.size).tolist(), item.tolist())


def literal_candidates(search: Search, words: Words) -> Iterator[tuple[int, int, int]]:
    """``(row, first word, item)`` where a run of words is one of an item's, as :func:`candidates`."""
    for width, runs, owner, may in search.runs:
        hashes = window_hashes(words.hashes, width)
        at = np.flatnonzero(may[hashes & np.uint64((1 << RUN_BITS) - 1)])
        row = np.searchsorted(words.first, at, side="right") - 1
        inside = at + width <= words.first[row + 1]
        at, row = at[inside], row[inside]
        low, high = np.searchsorted(runs, hashes[at]), np.searchsorted(runs, hashes[at], side="right")
        size = high - low
        item = owner[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        first = words.first[row]
        start = first + (at - first) // search.size * search.size
        yield from sorted(set(zip(np.repeat(row, size).tolist(), np.repeat(start, size).tolist(), item.tolist())))


def verdict(search: Search, item: int, region: list[int]) -> float:
    """Covered share of an item if the region holds it, else 0."""
    words, asked, count, weight = search.items.words[item], search.items.question[item], search.counts[item], search.weights[item]
    held = count.keys() & set(region)
    if sum(map(count.__getitem__, held)) < min(search.asked, search.whole) * len(words):
        return 0.0
    share = common_length(words, region) / len(words)
    if share >= search.whole:
        return share
    total = sum(weight[w] * n for w, n in count.items())
    if not asked or sum(weight[w] * count[w] for w in held) < search.weighed * total:
        return 0.0
    ends = search.items.sentences[item]
    pieces = [words[a:b] for a, b in zip(ends, ends[1:])]
    found = max(share, sum(common_length(p, region) for p in pieces) / len(words))
    answer = words[asked:]
    there = sum(weight[w] for w in answer if w in held) >= search.answered * sum(weight[w] for w in answer)
    return found if found >= search.asked and there else 0.0


def _find(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    trim()
    search: Search = shared.value
    for batch in batches:
        for part in chunks(batch, "text"):
            words, terms = _words(part.column("text"))
            best: dict[tuple[int, int], float] = {}
            tried = set()
            for row, start, item in chain(literal_candidates(search, words), candidates(search, words, terms)):
                n = len(search.items.words[item])
                if (row, item, start) in tried:
                    continue
                tried.add((row, item, start))
                low, high = max(int(words.first[row]), start - n), min(int(words.first[row + 1]), start + 2 * search.size + n)
                share = verdict(search, item, words.hashes[low:high].tolist())
                if share > best.get((row, item), 0.0):
                    best[row, item] = share
            ids = part.column("doc_id").to_pylist()
            found = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r, _ in found], pa.int64()), pa.array([search.items.ids[i] for _, i in found], pa.int64()), pa.array([best[x] for x in found], pa.float64())],
                ["doc_id", "item_id", "share"],
            )
    trim()


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rank: int = 256, size: int = 16, cosine: float = 0.5,
    whole: float = 0.8, asked: float = 0.55, weighed: float = 0.5, answered: float = 0.4, item_block: int = 20_000, corpus_weight: int = 4096,
) -> DataFrame:
    """``(doc_id, item_id, share)``: items that documents contain, with the share of words found.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored.  Null,
    empty and wordless texts match nothing.  Rows with a null id are left out.  Rows that
    repeat an id give one result with the largest share.  Frequent terms weigh less, by their
    share of the passages of different texts, and every term has some weight, so that no item
    with words is without one.  A document passage is a candidate if it holds a third of the
    terms of the item passage that has fewest, one at least, and its latent cosine is
    ``cosine`` or more, or if it shares eight words in a row with the item, or all of a
    shorter item, whatever they weigh.  The latent space is fitted on the benchmark and on
    all passages of the corpus's different texts, which count together as ``corpus_weight``
    passages if they are more, so that the benchmark's own do not vanish among them.
    Items are searched for ``item_block`` at a time, and so that they have MAX_TERMS terms at
    most, which bounds what a task holds.  A share of just ``whole``, or of ``asked``,
    ``weighed`` and ``answered``, is a leak.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bench = bench.distinct()
    blocks = -(-bench.count() // item_block)
    found = None
    for number in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).orderBy("item_id", "text").toArrow()
        for items in bounded_items(read_items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), size)):
            if not len(items.owner):
                continue
            one = _search_block(spark, docs, items, rank, size, corpus_weight, cosine=cosine, whole=whole, asked=asked, weighed=weighed, answered=answered)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, share double")
    return scratch.save(found).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _search_block(spark: SparkSession, docs: DataFrame, items: Items, rank: int, size: int, corpus_weight: int, **limits: float) -> DataFrame:
    names = np.unique(np.concatenate(items.terms))
    place = np.zeros(1 << TERM_BITS, np.int32)
    place[names] = np.arange(1, len(names) + 1)
    shared = spark.sparkContext.broadcast(place)
    height = len(names) + 1
    counts = Scratch(spark).save(summed(docs.select("text").distinct().mapInArrow(lambda it: corpus_counts(it, shared, size), COUNTS), height))
    count, passages_held = np.zeros(height), 0
    for row in counts.where("row = -1").collect():
        count[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["n"], "<i8")
    for row in counts.where("row = 0").collect():  # no term has this number
        passages_held += int(np.frombuffer(row["n"], "<i8").sum())
    total = count[0] + len(items.owner)
    weight = np.log((1 + total) / (1 + count))
    weight[0] = 0
    terms = [place[t].astype(np.int64) for t in items.terms]
    own = passage_pairs(spark, spark.createDataFrame([(t.tolist(),) for t in terms], "terms array<long>"), height)
    share = min(1.0, corpus_weight / max(1, passages_held))
    pairs = counts.where("row > 0").withColumn("share", F.lit(share)).unionByName(own.withColumn("share", F.lit(1.0)))
    v = latent_space(spark, pairs, weight, rank)
    latent = (weight[:, None] * v).astype(np.float32)
    vectors = np.stack([latent[t].sum(axis=0) for t in terms])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(norm > 0, vectors / np.maximum(norm, 1e-12), 0).astype(np.float32)
    # The window that fits an item best holds half of its terms or more.
    least = max(1, (min(len(t) for t in terms) + 1) // 3)
    search = spark.sparkContext.broadcast(Search(place, latent, vectors, items, weight.astype(np.float32), size, least=least, **limits))
    return docs.mapInArrow(lambda it: _find(it, search), "doc_id long, item_id long, share double")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents by :func:`find_leaks`, whose docstring defines nulls, empties, ties and repeats."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(spark, docs, benchmark)
