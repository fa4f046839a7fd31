"""Operators, sources, archives, streams and scores on small tables."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom import __main__ as cli
from blockloom.functions import blocks as B
from blockloom.functions.register import register
from blockloom.kernels import classify, codecs, coding, container, lexicon, transforms as T
from blockloom.operators import blocks as block_ops
from blockloom.operators import contexts, streams, transforms, words
from blockloom.plans import archive, levels, scoring
from blockloom.plans.queries import QUERIES
from blockloom.sources import members as M
from blockloom.streaming import append

CELLS = [b"", b"ab" * 60, bytes(range(256)) * 4, b"\x7fELF" + b"\x01\x02" * 40, b"\x55\x89\xe5\x01" * 30, "é".encode() * 40, b"banana"]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id long, raw binary").cache()


def test_profiles_equal_the_kernel(cells):
    rows = block_ops.profile(cells).orderBy("id").collect()
    assert [r["kind"] for r in rows] == [classify.classify(c) for c in CELLS]
    marks = cells.select("id", B.has_exec_marks("raw").alias("m")).orderBy("id").collect()
    assert [r["m"] for r in marks] == [classify.measure(c)[3] for c in CELLS]


def test_histograms_agree(cells):
    a = sorted(map(tuple, block_ops.histogram(cells, keys=("id",)).collect()))
    b = sorted(map(tuple, block_ops.histogram_native(cells, keys=("id",)).collect()))
    assert a == b and sum(r[2] for r in a) == sum(map(len, CELLS))


def test_cuts_cover_members(spark, cells):
    fixed = block_ops.cut_fixed(cells, 100, "raw")
    back = fixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("b")).collect()
    assert {r["id"]: b"".join(bytes(x["raw"]) for x in r["b"]) for r in back} == {i: c for i, c in enumerate(CELLS) if c}
    cut = block_ops.cut(cells.select(F.col("id").alias("member_id"), F.col("raw").alias("content"))).collect()
    assert {(r["member_id"], r["kind"]) for r in cut} == {(i, classify.classify(c)) for i, c in enumerate(CELLS) if c}


def test_detectors_agree_with_the_container(spark):
    long = '{"a": 1, "b": "x", "c": [1, 2, 3]}'
    texts = [
        "", " \n" + long, "[" + "1," * 30 + "]", "a,b,c\n1,2,3\n4,5,6\n7,8,9,10\n", 'a,"b,c",d\n1,2,3\n4,5,6\n7,8,9\n1,2,3', "a\tb\tc\n" * 8, "<a><b>text</b></a>",
        "<?xml version='1.0'?>", "<" * 40, "just some words, and a few more, without any structure, at all", "é,b,c\n" * 9, long[:20], "x,y\n" * 8 + "z\n" * 20, "<a>é" + "é" * 200,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [r["s"] for r in df.select("id", block_ops.structure_of(F.col("t")).alias("s")).orderBy("id").collect()]
    assert got == [container._structure(t.encode()) for t in texts]


def test_relations_equal_kernels(cells):
    some = cells.where("id in (1, 6)")
    for key, data in ((1, CELLS[1]), (6, CELLS[6])):
        ranks = {r["pos"]: r["rank"] for r in transforms.mtf_ranks(some, "id", "raw").where(F.col("id") == key).collect()}
        seen = T.mtf(data)
        assert all(r is None or r == seen[p] for p, r in ranks.items()) and len(ranks) == len(data)
        last = transforms.bwt_rows(some, "id", "raw").where(F.col("id") == key).first()["last"]
        assert bytes.fromhex(last) == T.bwt(data)[:-4]
    runs = transforms.runs(cells, "id", "raw").where("id = 2").count()
    assert runs == 1024
    far = transforms.previous_grams(cells, "id", "raw").where("id = 2 and distance is not null").agg(F.min("distance"), F.max("distance")).first()
    assert tuple(far) == (256, 256)


def test_transform_columns_come_back(cells):
    for name in transforms.KERNELS:
        back = cells.withColumn("b", transforms.inverse(transforms.transform("raw", name), name))
        assert back.where("b <> raw or b is null").isEmpty(), name
    wired = cells.withColumn("w", transforms.wire_encode("raw")).withColumn("b", transforms.wire_decode("w", F.octet_length("raw")))
    assert wired.where("b <> raw").isEmpty()


def test_streams_come_back(spark):
    df = spark.createDataFrame([(1, b'{"k": [1, "v"]}', b"a,b\r\n\n1", b"<a b='c'>t</a>"), (2, None, None, None)], "id int, json binary, csv binary, xml binary")
    for name in streams.SPLITS:
        back = df.withColumn("b", streams.join_streams(streams.split_streams(name, name), name))
        assert back.where(F.col("b").eqNullSafe(F.col(name))).count() == 2
        assert streams.stream_totals(df, name, name).count() >= 3


def test_dictionary_equals_the_kernel(spark):
    text = "the cat and the hat; a cat, the end. " * 3 + "once upon"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    table = words.dictionary(words.word_counts(docs))
    found = words.collect_words(table)
    assert found == lexicon.build(text.encode())
    coded = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("w", words.replace_words("raw", found)).withColumn("b", words.restore_words("w", found))
    assert coded.where("doc_id = 1 and b = raw and octet_length(w) < octet_length(raw)").count() == 1
    assert words.savings(table).where("word = 'the'").first()["saved"] == 9 * (3 - 1) - 4


def test_contexts(cells):
    counts = [contexts.context_counts(cells, k) for k in range(4)]
    assert counts[0].agg(F.sum("n")).first()[0] == sum(map(len, CELLS))
    assert counts[2].agg(F.sum("n")).first()[0] == sum(max(0, len(c) - 2) for c in CELLS)
    row = counts[1].where(f"context = {ord('a')} and byte = {ord('n')}").first()
    assert row["n"] >= 2
    assert contexts.conditional_entropy(counts[0]).first()["contexts"] == 1
    assert contexts.chosen_orders(*counts[1:]).agg(F.sum("n")).first()[0] == counts[3].agg(F.sum("n")).first()[0]
    assert contexts.frequencies(block_ops.histogram(cells)).agg(F.sum("freq")).first()[0] == 4096


@pytest.mark.parametrize("mode", levels.MODES)
def test_archives_come_back(spark, tmp_path, mode):
    rows = json.dumps([{"id": i} for i in range(80)])
    data = [(1, "a.json", rows.encode()), (2, "d/noise", random.Random(1).randbytes(900)), (3, "empty", b""), (4, "d/code", CELLS[3]), (5, "text", b"so it goes, so it goes; " * 40)]
    members = spark.createDataFrame([(i, n, c, len(c)) for i, n, c in data], "member_id long, name string, content binary, raw_len long")
    path = str(tmp_path / mode)
    archive.write(members, path, mode=mode, floor=64, plain_floor=64)
    assert sorted((r["member_id"], r["name"], bytes(r["content"])) for r in archive.read(spark, path).collect()) == data
    assert archive.verify(spark, path).isEmpty()
    coded, table, found = archive.open_archive(spark, path)
    assert scoring.round_trips(archive.decompress(coded, table, found), members).where("not intact").isEmpty()
    assert archive.diagnostics(coded).agg(F.sum("size_in")).first()[0] == sum(len(c) for _, _, c in data)
    with pytest.raises(Exception, match="already exists"):
        archive.write(members, path, mode=mode)
    broken = coded.withColumn("crc32", F.col("crc32") + 1)
    errors = archive.decode(broken, found, permissive=True)
    assert errors.where("error like 'CrcMismatch%'").count() == coded.count()
    with pytest.raises(Exception, match="CrcMismatch"):
        archive.decode(broken, found).collect()
    odd = coded.withColumn("method", F.lit(77))
    assert archive.decode(odd, found, permissive=True).where("error like 'CorruptBlock%'").count() == coded.count()
    with pytest.raises(ValueError):
        archive.write(members.limit(0), path, mode=mode)


def test_trials_choose_the_smallest(spark):
    rows = json.dumps([{"id": i, "name": "n" * (i % 5)} for i in range(300)]).encode()
    blocks = spark.createDataFrame([(1, 0, "Text", rows), (2, 0, "Text", b"short"), (3, 0, "Binary", rows)], "member_id long, block_id int, kind string, raw binary")
    table = archive.trials(blocks, [], 256, 256)
    best = {r["member_id"]: r for r in archive.winners(table).collect()}
    sizes = [r["size"] for r in table.where("member_id = 1").collect()]
    assert set(best) == {1, 2} and best[2]["pipeline"] == "raw" and best[1]["size"] == min(sizes) and len(sizes) == 4


def test_the_best_pipeline_is_sought_for_blocks_of_every_size(spark, tmp_path):
    texts = ["ab " * 20, "a", "so it goes, " * 30, "x,y\n1,2\n" * 200, None, "the quick brown fox jumps over a lazy dog"]
    page, line, event = "<ul>" + "<li>one</li>" * 12 + "</ul>", (1, 1, 2, 3, "A", "F"), (1, 1, '{"k": 1}')
    for name, rows, shape in (
        ("documents", list(enumerate(texts)), "doc_id long, text string"), ("pages", [(1, page)], "page_id long, html string"),
        ("events", [event], "event_id long, user_id long, props string"),
        ("lineitem", [line], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"),
    ):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    want: dict[str, list[int]] = {}
    for text in [*texts, page, '[{"k": 1}]', "1,2,3,A,F"]:
        data = (text or "").encode()
        for a, b, kind in classify.cut(data, window=1 << 20):
            if kind == "Text":
                cell = spark.createDataFrame([(data[a:b].decode(),)], "t string")
                shape = cell.select(block_ops.structure_of(F.col("t"))).first()[0]
                names = ["raw", "bwt_mtf_rle", "lzp_bwt_mtf", *([f"{shape}_split"] if shape else [])]
                best, made = codecs.trial(data[a:b], names, [])
                want.setdefault(best, []).append(len(coding.side_encode(made)))
    got = {r["pipeline"]: (r["blocks"], r["size"]) for r in QUERIES["trial_winner"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), sum(v)) for k, v in want.items()} and len(got) > 1
    # near-random text, too
    noise = bytes(random.Random(4).choices(range(32, 256), k=4000))
    blocks = spark.createDataFrame([(1, 0, "Text", noise)], "member_id long, block_id int, kind string, raw binary")
    assert codecs.shannon(noise) > codecs.TRIAL_BITS and archive.trials(blocks, [], 0, 0, most_bits=8.0).count() == 3


def test_trials_are_dealt_to_all_cores_and_small_members_go_on_together(spark):
    rows = spark.range(0, 500, 1, 1).select(F.col("id").alias("member_id"), F.encode(F.repeat(F.lit("word "), 10), "UTF-8").alias("content"))
    blocks = block_ops.cut(rows)
    sizes = blocks.mapInArrow(lambda it: (b.select(["member_id"]).slice(0, 1) for b in it), "member_id long").count()
    assert blocks.count() == 500 and sizes < 5
    table = archive.trials(blocks, [], 256, 256)
    parts = {r["p"]: r["n"] for r in table.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert len(parts) > 1 and sum(parts.values()) == 500


def test_batches_are_coded_together():
    batches = [pa.RecordBatch.from_pydict({"k": [10 * i, 10 * i + 1], "raw": [b"x" * 30, None if i == 2 else b"y" * 30]}) for i in range(5)]
    got = list(archive.together(iter(batches), "raw", 100))
    assert [k for b in got for k in b.column("k").to_pylist()] == [k for b in batches for k in b.column("k").to_pylist()]
    assert [b.num_rows for b in got] == [4, 5, 1] and list(archive.together(iter([]), "raw")) == []
    sizes = [pa.RecordBatch.from_pydict({"n": [70, 70, 5]})]
    assert [b.num_rows for b in archive.together(iter(sizes), "n", 100)] == [2, 1]


def test_levels_and_methods(spark):
    assert [levels.parse_level(x) for x in (1, -3, 9, -19)] == [1, 3, 9, 19]
    assert levels.resolve_mode() == "hybrid" and levels.resolve_mode(-1) == "wire" and levels.resolve_mode(None, "fast") == "fast" and levels.resolve_mode(19, "slow") == "slow"
    for bad in (lambda: levels.parse_level(2), lambda: levels.resolve_mode(1, "slow"), lambda: levels.resolve_mode(None, "x"), lambda: levels.method_pipeline(21)):
        with pytest.raises(ValueError):
            bad()
    assert levels.method_pipeline(17) == "csv_split" and levels.pipeline_method("csv_split", "slow") == 15
    df = spark.range(22).select(levels.method_label(F.col("id")).alias("l"))
    assert df.where("l = '?'").count() == 1
    with pytest.raises(Exception, match="unknown method"):
        spark.range(21, 22).select(levels.method_kind(F.col("id"))).collect()


def test_names(spark):
    names = ["a/b.txt", "", "/a", "a//b", "../a", "a/./b", "a\\b", "x" * 4097, "é/ü", "a\0b"]
    good = [r["g"] for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(B.safe_member_name(F.col("n")).alias("g")).collect()]
    assert good == [True, *[False] * 7, True, False]
    for name, ok in zip(names, good):
        if ok:
            assert M.check_name(name) == name
        else:
            with pytest.raises(M.UnsafeName):
                M.check_name(name)


def test_files_come_back(spark, tmp_path, capsys):
    root = tmp_path / "in put"
    (root / "deep").mkdir(parents=True)
    files = {"a+b.txt": b"hello " * 50, "deep/é 1%.bin": bytes(range(256)), "none": b""}
    for name, data in files.items():
        (root / name).write_bytes(data)
    (root / "link").symlink_to(root / "none")
    found = M.scan_tree(spark, str(root))
    assert [(r["name"], bytes(r["content"])) for r in found.orderBy("member_id").collect()] == sorted((f"in put/{n}", d) for n, d in files.items())
    assert cli.main(["compress", str(root), str(tmp_path / "out.blk"), "--level", "3", "--verbose"]) == 0
    assert cli.main(["verify", str(tmp_path / "out.blk")]) == 0
    assert cli.main(["decompress", str(tmp_path / "out.blk"), str(tmp_path / "back")]) == 0
    for name, data in files.items():
        assert (tmp_path / "back" / "in put" / name).read_bytes() == data
    with pytest.raises(Exception, match="FileExists"):
        M.restore(found, str(tmp_path / "back"))
    M.restore(found, str(tmp_path / "back"), force=True)
    one = M.scan_file(spark, str(root / "a+b.txt")).first()
    assert one["name"] == "a+b.txt" and one["raw_len"] == 300
    with pytest.raises(ValueError):
        M.scan_file(spark, str(root / "link"))
    assert {r["name"] for r in M.scan_corpus(spark, str(root)).collect()} == {"a+b.txt"}
    assert cli.main(["bench", str(root), "--mode", "wire"]) == 0
    assert '"intact": true' in capsys.readouterr().out
    assert M.restored_name("x.blk", None, None) == "x" and M.restored_name("x.blk", "n", None) == "n" and M.restored_name("x.blk", "n", "o") == "o"
    with pytest.raises(ValueError):
        M.restored_name("x", None, None)


def test_block_ranges(spark):
    members = spark.createDataFrame([(1, 0, 2), (2, 2, 0), (3, 2, 1)], "member_id long, first_block int, num_blocks int")
    out = block_ops.block_member(spark.range(3).select(F.col("id").cast("int").alias("block_no")), members)
    assert sorted((r["block_no"], r["member_id"]) for r in out.collect()) == [(0, 1), (1, 1), (2, 3)]


def test_sql_functions(spark):
    names = register(spark)
    assert {"block_kind", "block_compress", "block_bwt_inverse"} <= set(names)
    row = spark.sql("SELECT block_kind(encode(repeat('text ', 20), 'UTF-8')) k, block_decompress(block_compress(encode('abc', 'UTF-8'))) d, block_kind(null) n").first()
    assert row["k"] == "Text" and bytes(row["d"]) == b"abc" and row["n"] is None


def test_streams_of_members(spark, tmp_path):
    source = tmp_path / "source"
    rows = [(1, "a", b"text " * 30, "2026-01-01 00:01:00"), (2, "b", bytes(range(256)), "2026-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "member_id long, name string, content binary, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(source))
    live = spark.readStream.schema(df.schema).parquet(str(source))
    append.append(live.drop("at"), str(tmp_path / "coded"), str(tmp_path / "marks"), level=3).trigger(availableNow=True).start().awaitTermination()
    coded = spark.read.schema(archive.CODED).parquet(str(tmp_path / "coded"))
    assert scoring.round_trips(archive.decompress(coded, df, []), df).where("intact").count() == 2
    q = append.kind_counts(live, "at").writeStream.format("memory").queryName("kinds").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["kind"] for r in spark.table("kinds").collect()} == {"Text", "Random"}


def test_streams_with_a_dictionary(spark, tmp_path):
    text = b"alpha omega; " * 60
    df = spark.createDataFrame([(1, "a", text)], "member_id long, name string, content binary")
    df.write.parquet(str(tmp_path / "source"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "source"))
    words = [b"alpha", b"omega"]
    run = append.append(live, str(tmp_path / "coded"), str(tmp_path / "marks"), mode="slow", words=words, floor=64, plain_floor=64)
    run.trigger(availableNow=True).start().awaitTermination()
    coded = spark.read.schema(archive.CODED).parquet(str(tmp_path / "coded"))
    assert scoring.round_trips(archive.decompress(coded, df, words), df).where("intact").count() == 1


def test_archives_of_a_stack(spark):
    rows = [(1, "a", b"so it goes, " * 30), (2, "noise", random.Random(2).randbytes(300)), (3, "none", b"")]
    df = spark.createDataFrame(rows, "member_id long, name string, content binary")
    stack = ("order1", "order2", "match")
    coded, words = archive.compress(df, mode="wire", stack=stack)
    assert words == [] and {r["method"] for r in coded.select("method").collect()} == {0, 1}
    assert scoring.round_trips(archive.decompress(coded, df, words, stack), df).where("intact").count() == 3
    with pytest.raises(ValueError, match="no such model"):
        archive.compress(df, mode="wire", stack=("order9",))


def test_scores(spark):
    own = spark.createDataFrame([("f", "e", 40.0, 5.0), ("g", "e", 0.1, 1.0)], "file string, engine string, ratio double, speed double")
    peer = spark.createDataFrame([("f", "p", 50.0, 9.0), ("g", "p", 0.4, 0.5)], "file string, engine string, ratio double, speed double")
    rows = {r["file"]: (r["ratio"], r["speed"], r["both"]) for r in scoring.verdicts(own, peer).collect()}
    assert rows == {"f": ("win", "lose", "split"), "g": ("tie", "win", "win")}
    both = scoring.tally(scoring.verdicts(own, peer)).where("axis = 'both'").first()
    assert (both["wins"], both["losses"], both["ties"]) == (1, 0, 0)
    metrics = spark.createDataFrame([(200, 50, 2.0)], "original long, compressed long, seconds double")
    assert metrics.select(scoring.ratio(F.col("original"), F.col("compressed")), scoring.throughput(F.col("original"), F.col("seconds"))).first()[:] == (25.0, 0.0001)
    missing = scoring.round_trips(spark.createDataFrame([], "member_id long, content binary"), spark.createDataFrame([(1, b"x")], "member_id long, content binary"))
    assert not missing.first()["intact"]
