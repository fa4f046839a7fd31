"""Byte-level BPE: encoding by ranked merges in Spark higher-order functions, and decoding.

Texts split into words by the vocabulary's pattern, once.  A word that is a piece has its rank.
All others are merged by a fold in Spark over an array of byte strings, whose ranks come from
one literal array of small maps, by hash, so that a look-up does not depend on the size of the
vocabulary.  Each different word is folded once: chunks of documents keep their words by number,
send them, in blobs dealt by hash, to where equal words meet, and get the ids back.  Decoding
joins the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import list_array, trim

BUCKETS = 1 << 14
#: The fold has twelve bits for a position in a word's hex string.
POSITIONS = 1 << 12
MOST_BYTES = POSITIONS // 2 - 1
#: A chunk has the words of about so many bytes of text.
CHUNK_BYTES = 12 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece from a vocabulary file of base-64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of ranked neighbours: what the fold gives, in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop and end[i] == j):
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in the plainest form, for comparison: the least of a list of neighbours' ranks, again and again."""
    if word in ranks:
        return [ranks[word]]
    none = 1 << 60
    parts = [word[i : i + 1] for i in range(len(word))]
    near = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while near and (least := min(near)) < none:
        i = near.index(least)
        parts[i : i + 2] = [both := parts[i] + parts[i + 1]]
        del near[i]
        if i:
            near[i - 1] = ranks.get(parts[i - 1] + both, none)
        if i < len(near):
            near[i] = ranks.get(both + parts[i + 1], none)
    return [ranks[x] for x in parts]


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of maps from hex to rank, placed by hash."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        maps[xxhash.xxh64_intdigest(key, seed=42) % BUCKETS][key] = rank  # Spark's xxhash64, whose low bits need no sign
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(word: Column, table: Column) -> Column:
    """Ids of a word given in hex, of MOST_BYTES at most, by a fold of its bytes: in each step the
    leftmost of the neighbouring pairs of least rank becomes one piece."""
    return _let(table, lambda t: _folded(word, t))


def _folded(word: Column, table: Column) -> Column:
    # A pair is one number: its rank, then where its first piece starts, and both its pieces end, in the hex string.
    wide, none = F.lit(POSITIONS - 1).cast("long"), 1 << 26
    rank = lambda piece: F.try_element_at(F.get(table, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), piece)
    start = lambda pair: F.shiftright(pair, 24).bitwiseAND(wide).cast("int")
    middle = lambda pair: F.shiftright(pair, 12).bitwiseAND(wide).cast("int")
    stop = lambda pair: pair.bitwiseAND(wide).cast("int")
    n = (F.length(word) / 2).cast("int")

    def pair(a: Column, b: Column, c: Column) -> Column:
        ranked = F.shiftleft(F.coalesce(rank(F.substring(word, a + 1, c - a)), F.lit(none)).cast("long"), 36)
        return ranked + F.shiftleft(a.cast("long"), 24) + F.shiftleft(b.cast("long"), 12) + c.cast("long")

    def step(acc: Column, _: Column) -> Column:
        end, nothing = F.size(acc), F.array().cast("array<long>")

        def join(p: Column, a: Column, c: Column) -> Column:
            left = F.when(p > 1, F.array(pair(start(F.get(acc, p - 2)), a, c))).otherwise(nothing)
            right = F.when(p < end, F.array(pair(a, c, stop(F.get(acc, p))))).otherwise(nothing)
            return F.concat(F.slice(acc, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(acc, p + 2, end))

        return _let(F.array_min(acc), lambda least: F.when(
            least < none << 36, _let(F.array_position(acc, least).cast("int"), lambda p: join(p, start(least), stop(least)))
        ).otherwise(acc))

    def pieces(acc: Column) -> Column:
        last = middle(F.get(acc, F.size(acc) - 1))
        firsts = F.transform(acc, lambda x: rank(F.substring(word, start(x) + 1, middle(x) - start(x))))
        return F.when(F.size(acc) == 0, F.array(rank(word))).otherwise(F.concat(firsts, F.array(rank(F.substring(word, last + 1, F.length(word))))))

    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(2 * i, 2 * i + 2, 2 * i + 4))
    folded = F.aggregate(F.sequence(F.lit(1), n - 1), pairs, step, pieces)
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(rank(word))).otherwise(
        F.coalesce(F.when(rank(word).isNotNull(), F.array(rank(word))), folded)
    )


#: Plans are described without the whole literal, which would fill the driver.
SHORT_PLANS = ("spark.sql.maxPlanStringLength", "10000")
#: Nor is the plan described again after each stage; the number of its partitions is given.
FIXED_PLANS = ("spark.sql.adaptive.enabled", "false")
#: Shuffle files go as soon as their table is written.
SHORT_SHUFFLES = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextlib.contextmanager
def _having(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _pack(**columns: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _planes(values: np.ndarray) -> pa.Array:
    """Their width in bytes, then the lowest bytes of all numbers, and so on, which compress better than whole ones."""
    width = 3 if values.max(initial=0) < 1 << 24 else 4
    return pa.array(np.append(np.uint8(width), values.astype("<i4").view(np.uint8).reshape(-1, 4).T[:width].reshape(-1)))


def _from_planes(planes: pa.Array) -> np.ndarray:
    body = planes.to_numpy()
    rows = body[1:].reshape(int(body[0]), -1)
    out = np.zeros((rows.shape[1], 4), np.uint8)
    out[:, : len(rows)] = rows.T
    return out.reshape(-1).view("<i4")


def _often(count: np.ndarray) -> np.ndarray:
    """Numbers by falling count: the most frequent gets the least code."""
    return np.argsort(-count, kind="stable")


def _pack_runs(lengths: np.ndarray, values: np.ndarray) -> bytes:
    """Runs of numbers, all lengths first."""
    return len(lengths).to_bytes(4, "little") + _pack(planes=_planes(np.concatenate([lengths, values])))


def _unpack_runs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both, n = _from_planes(_unpack(body[4:]).column("planes")), int.from_bytes(body[:4], "little")
    return both[:n], both[n:]


def _unpack(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _blobs(rows: list[tuple[int, int, int, str, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "chunk", "bucket", "kind", "body"])


class _Codes(dict):
    """Codes of words: the rank of those that are a piece, and others numbered from ``base`` as they come."""

    def __init__(self, ranks: dict[bytes, int], base: int):
        super().__init__()
        for piece, rank in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self[piece.decode()] = rank
        self.base, self.new = base, []

    def __missing__(self, word: str) -> int:
        self[word] = code = self.base + len(self.new)
        self.new.append(word)
        return code

    def forget(self) -> None:
        for word in self.new:
            del self[word]
        self.new = []


def _split(batches: Iterator[pa.RecordBatch], pattern: str, shared: Broadcast, longest: int, buckets: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Chunks of documents as blobs: ``docs``, ``texts`` with their words as codes and ``counts``
    of ranks and words, which tell what codes stand for; ``words`` with the words that are no
    piece, by bucket, and ``ids`` of the words above ``longest`` bytes."""
    trim()
    part, find, ranks = TaskContext.get().partitionId(), regex.compile(pattern).findall, shared.value
    codes = _Codes(ranks, max(ranks.values()) + 1)
    held: list[tuple[int | None, bytes, np.ndarray]] = []
    chunk = size = 0

    def flush() -> pa.RecordBatch:
        new = codes.new
        bucket = np.fromiter((zlib.crc32(b) % buckets if len(b := w.encode()) <= longest else buckets for w in new), np.int32, len(new))
        order = pc.sort_indices(pa.array(new, pa.string())).to_numpy().astype(np.int64)  # like words are close, which compresses better
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.arange(codes.base + len(new), dtype=np.int32)  # words are numbered by bucket
        place[codes.base + order] = np.arange(codes.base, len(place))
        lengths = np.array([len(c) for _, _, c in held])
        flat = np.concatenate([c for _, _, c in held])
        count = np.zeros(len(place), np.int64)
        for at in range(0, len(flat), 1 << 18):
            count += np.bincount(flat[at : at + (1 << 18)], minlength=len(place))
        count[place] = count.copy()
        code = np.empty(len(place), np.int32)
        code[_often(count)] = np.arange(len(place))
        np.take(code[place], flat, out=flat, mode="clip")
        docs = _pack(doc_id=pa.array([d for d, _, _ in held], pa.int64()), sha=pa.array([s for _, s, _ in held], pa.binary(32)))
        rows = [(part, chunk, -3, "docs", docs), (part, chunk, -2, "counts", _pack(planes=_planes(count)))]
        rows.append((part, chunk, -1, "texts", _pack_runs(lengths, flat)))
        del flat
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if new else ():
            words, k = [new[i] for i in at.tolist()], int(bucket[at[0]])
            if k < buckets:
                rows.append((part, chunk, k, "words", _pack(word=pa.array(words, pa.string()))))
            else:
                ids = [np.array(merge_word(w.encode(), ranks)) for w in words]
                rows.append((part, chunk, k, "ids", _pack_runs(np.array([len(x) for x in ids]), np.concatenate(ids))))
        codes.forget()
        return _blobs(rows)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = find(text)
            held.append((doc, hashlib.sha256(body := text.encode()).digest(), np.fromiter(map(codes.__getitem__, words), np.int32, len(words))))
            size += len(body)
            if size >= most:
                yield flush()
                held, chunk, size = [], chunk + 1, 0
    if held:
        yield flush()
        held.clear()
    trim()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of a bucket in hex, a row each, then a row for each chunk with the places of its own."""
    place: dict[str, int] = {}
    chunk_rows = []
    for batch in batches:
        for part, chunk, bucket, body in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "bucket", "body"))):
            own = [place.setdefault(w, len(place)) for w in _unpack(body).column("word").to_pylist()]
            chunk_rows.append((part, chunk, bucket, "places", _pack(planes=_planes(np.array(own)))))
    words = list(place)
    for at in range(0, len(words), 2000):
        some = pa.array([w.encode().hex().upper() for w in words[at : at + 2000]], pa.string())
        rest = _blobs([(None, None, None, None, None)] * len(some))
        yield pa.RecordBatch.from_arrays([some, *rest.columns], ["word", *rest.schema.names])
    if chunk_rows:
        rest = _blobs(chunk_rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(chunk_rows), pa.string()), *rest.columns], ["word", *rest.schema.names])
    del place, words, chunk_rows
    trim()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each chunk's words of a bucket, from rows of words in their order, then of chunks."""
    lengths, values, table = [], [], None
    for batch in batches:
        here = batch.column("kind").is_null()
        if (words := batch.filter(here).column("ids")) and len(words):
            lengths.append(words.value_lengths().to_numpy())
            values.append(words.flatten().to_numpy())
        rows = []
        chunk_rows = batch.filter(pc.invert(here))
        if chunk_rows.num_rows and table is None:
            table = _Table(np.concatenate(lengths), np.concatenate(values))
        for part, chunk, bucket, body in zip(*(chunk_rows.column(c).to_pylist() for c in ("part", "chunk", "bucket", "body"))):
            ids, size = table.take(_from_planes(_unpack(body).column("planes")))
            rows.append((part, chunk, bucket, "ids", _pack_runs(size, ids)))
        yield _blobs(rows)


class _Table:
    """Runs of values, taken by number."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray):
        self.lengths, self.values = lengths.astype(np.int64), values
        self.starts = np.cumsum(self.lengths) - self.lengths

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some runs in a row, and the length of each run."""
        size = self.lengths[at]
        shift = self.starts[at] - (np.cumsum(size) - size)
        return self.values[np.repeat(shift, size) + np.arange(int(size.sum()))], size


def _decoder(ranks: dict[bytes, int]) -> _Table:
    """The bytes of pieces by rank."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return _Table(np.array([len(p) for p in pieces]), np.frombuffer(b"".join(pieces), np.uint8))


def _documents(held: dict[str, bytes], runs: list[tuple[np.ndarray, np.ndarray]], pieces: _Table, digest: bool, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk from its blobs, and the ids of its words by their number."""
    base = len(pieces.lengths)
    table = _Table(np.concatenate([np.ones(base, np.int64), *(n for n, _ in runs)]), np.concatenate([np.arange(base, dtype="<i4"), *(x for _, x in runs)]))
    docs, often = _unpack(held["docs"]), _often(_from_planes(_unpack(held["counts"]).column("planes")))
    sizes, codes = _unpack_runs(held["texts"])
    codes, bounds, shas = often[codes], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), docs.column("sha").to_pylist()
    first = 0
    while first < docs.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        ids, size = table.take(codes[bounds[first] : bounds[last]])
        body, lengths = pieces.take(ids)
        ends = np.concatenate([[0], np.cumsum(size)])[bounds[first : last + 1] - bounds[first]]
        stops = np.concatenate([[0], np.cumsum(lengths)])[ends]
        own = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        back = [body[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
        sums = [hashlib.sha256(b) for b in back]
        intact = [s.digest() == sha for s, sha in zip(sums, shas[first:last])]
        if digest:
            columns = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own], pa.string()), pa.array([s.hexdigest() for s in sums], pa.string())
        else:
            columns = list_array(own, pa.int32()), pa.array(back, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [docs.column("doc_id").slice(first, last - first), pa.array(np.diff(ends), pa.int64()), *columns, pa.array(intact, pa.bool_())],
            ["doc_id", "n_tokens", "ids", "decoded", "intact"],
        )
        first = last


def _encode(batches: Iterator[pa.RecordBatch], shared: Broadcast, digest: bool) -> Iterator[pa.RecordBatch]:
    """Documents from rows of each chunk: its own blobs, then the ids of its words by bucket."""
    trim()
    pieces, held, runs = _decoder(shared.value), {}, []
    for batch in batches:
        for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
            if kind == "docs" and held:
                yield from _documents(held, runs, pieces, digest)
                held, runs = {}, []
            if kind == "ids":
                runs.append(_unpack_runs(body))
            else:
                held[kind] = body
    if held:
        yield from _documents(held, runs, pieces, digest)
    del held, runs
    trim()


BLOBS = "part int, chunk int, bucket int, kind string, body binary"


def encode(
    spark: SparkSession, docs: DataFrame, path: str, pattern: str, digest: bool = False, sample_docs: int | None = None, longest: int = 256
) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded, intact)`` of every row of docs.

    docs needs doc_id and text; other columns are ignored.  ``ids`` is an array of int and
    ``decoded`` the bytes they stand for, or the SHA-256 of either if ``digest``, of ids as
    little-endian 32-bit integers; ``intact`` tells whether they are the text, by SHA-256.  A
    null text counts as empty and has no ids; doc_ids pass as they are, repeated or null.
    Every different word of all documents that is no piece itself is merged once by the fold; a
    word above ``longest`` bytes, for which the fold's time would grow with the square of its
    length, by a heap, with the same ids.  ``sample_docs`` has no effect: nothing is taken from
    a sample.  An empty table gives an empty result.
    """
    ranks, longest = read_ranks(path), min(longest, MOST_BYTES)
    table = rank_table(ranks)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(ranks)
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    saved = scratch.save(docs.mapInArrow(lambda it: _split(it, pattern, shared, longest, buckets), BLOBS), "kind")
    rows = saved.select("part", "chunk", "bucket", "kind", "body")
    words = rows.where("kind = 'words'").repartitionById(buckets, F.col("bucket")).mapInArrow(_distinct, "word string, " + BLOBS)
    words = words.select(F.when(F.col("word").isNotNull(), merged(F.col("word"), table)).alias("ids"), "part", "chunk", "bucket", "kind", "body")
    with _having(spark, *SHORT_PLANS), _having(spark, *FIXED_PLANS), _having(spark, *SHORT_SHUFFLES):
        ids = scratch.save(words.mapInArrow(_dealt, BLOBS))  # so that only one plan has the literal
    scratch.drop(saved, part="kind=words")
    parts = (rows.where("kind = 'docs'").agg(F.max("part")).first()[0] or 0) + 1
    both = rows.where("kind <> 'words'").unionByName(ids).repartitionById(parts, F.col("part")).sortWithinPartitions("chunk", "bucket")
    kinds = "ids string, decoded string" if digest else "ids array<int>, decoded binary"
    return both.mapInArrow(lambda it: _encode(it, shared, digest), f"doc_id long, n_tokens long, {kinds}, intact boolean")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of all documents by :func:`encode`, whose docstring defines nulls, empties and repeats."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
