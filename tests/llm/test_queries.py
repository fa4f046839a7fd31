"""Registered queries against their SQL, and the pipeline against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from string import ascii_letters, digits

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm.byte_bpe import read_ranks
from blockloom.llm.html_text import main_text
from blockloom.llm.line_dedup import within_one
from blockloom.llm.registry import QUERIES, SQL


def prose(rng, n):
    return " ".join(f"w{int(900 * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    base = ["\n".join(prose(rng, rng.randint(8, 25)) for _ in range(rng.randint(3, 6))) for _ in range(50)]
    shared = prose(rng, 30)
    items = [(k, prose(rng, 24) + ". " + prose(rng, 12) + ".") for k in range(12)]
    rows = []
    for i in range(150):
        lines = rng.choice(base).split("\n") if i % 3 else [prose(rng, rng.randint(20, 40)) for _ in range(3)]
        if i % 3 == 1:
            words = lines[-1].split(" ")
            words[rng.randrange(len(words))] = f"z{i}"
            lines[-1] = " ".join(words)
        if i % 5 == 0:
            lines.append(shared)
        if i % 10 == 9:
            lines.append(items[i % 12][1])
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
    rows += [(210 + k, f"{shared}\nkey {''.join(rng.choices(ascii_letters + digits, k=32))} AKIA{'Z7' * 8 * (k % 2)} secret: hunter{k}xy {'0a' * (10 + k)}\n{prose(rng, 60)}", "en", "src1", 0) for k in range(6)]
    rows += [(200, "too short", "en", "src0", 0), (201, "a b " * 60, "en", "src1", 0), (202, None, None, None, None), (203, "", "en", "src0", 0)]
    hosts = ["a.com", "b.net", "c.org", "d.org", "www.example.com", "example.com", "e.net"]
    pages = []
    for k in range(80):
        links = f"<nav><a href='/'>Home</a></nav><article><h1>Title {k}</h1><p>{prose(rng, 30)} &amp; more</p></article>" + "".join(f'<a class="x" href="{rng.choice(("http:", "https:", ""))}//{rng.choice(hosts)}/p{j}">t</a><a href="/in">i</a>' for j in range(rng.randint(0, 3)))
        pages.append((k, f"http://{rng.choice(hosts)}/{rng.choice(('es/', 'fr/', 'en/', 'de/', ''))}{k}?q#x" if k % 20 else None, links if k % 7 else None))
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(bool(t) and i % 3 > 0), 0) for i, t, *_ in rows if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, tables[0]).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_leaks_of_the_query(spark, tables):
    folder, rows, items = tables
    got = QUERIES["op1_decontaminate"](spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, k) for i, t, *_ in rows for k, x in items if t and x in t} and len(got) > 10


def test_tokens_of_the_query(spark, tables):
    import public_tokenizers
    import tiktoken

    folder, rows, _ = tables
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, QUERIES["op5_byte_bpe"](spark, folder).collect())) == sorted(want)


def test_texts_of_the_query(spark, tables):
    folder = tables[0]
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = sorted((r["page_id"], r["url"] or "", main_text(r["html"])) for r in pages)
    got = QUERIES["op6_html_text"](spark, folder).collect()
    assert sorted((r["page_id"], r["url"] or "", r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum("Title" in t and "Home" not in t for *_, t in want) > 60


def _statistics(text):
    words, solid = re.findall(r"[^ \t-\r]+", text), len(re.sub(r"[ \t-\r]", "", text))
    n, count = len(words), lambda chars: sum(text.count(c) for c in chars)
    share = lambda a, b: a / b if b > 0 else 0.0
    per_word = lambda k: math.log1p(100 * share(k, n))
    return [
        math.log1p(n), math.log1p(share(solid, n)), per_word(count("#*$%&<>")), per_word(count("!?")), per_word(count("|")), per_word(count("0123456789")),
        math.log1p(100 * share(sum(c.isupper() for c in text), solid)), share(len(set(words)), n) ** 0.5, per_word(sum(a == b for a, b in zip(words, words[1:]))),
        math.log1p(share(n, text.count("\n") + 1)), per_word(count(".,")),
    ]


def test_scores_equal_a_numpy_discriminant(spark, tables):
    folder, rows, _ = tables
    x = {i: np.array(_statistics(t or "")) for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in x}
    label = {i: int(bool(t) and i % 3 > 0) for i, t, *_ in rows if i % 7}
    learnt = [np.array([x[i] for i in x if i in label and not held[i] and label[i] == k]) for k in (0, 1)]
    n, mean, spread = [len(a) for a in learnt], [a.mean(0) for a in learnt], [np.cov(a.T, bias=True) for a in learnt]
    common = (n[0] * spread[0] + n[1] * spread[1]) / sum(n)
    scale = np.diag(common) + (mean[0] - mean[1]) ** 2 * n[0] * n[1] / sum(n) ** 2 + 1e-6
    density = []
    for k in (0, 1):
        s = 0.9 * spread[k] + 0.1 * common
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.05 * np.diag(scale)
        density.append({i: math.log(n[k] / sum(n)) - 0.5 * (np.linalg.slogdet(s)[1] + (v - mean[k]) @ np.linalg.solve(s, v - mean[k])) for i, v in x.items()})
    got = QUERIES["op7_quality_classifier"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(max(-500, min(500, density[0][i] - density[1][i])))), abs=1e-9)
        assert r["held_out"] == held[i] and r["predicted"] == int(r["score"] >= 0.5)


def _rules(docs):
    words = {i: re.findall(r"[^ \t-\r]+", t or "") for i, t in docs.items()}

    def bad(w):
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(twice) > 50 * len(w)

    return {i: t for i, t in docs.items() if not bad(words[i])}


def _lines(docs):
    flat = [(i, k, tuple(x.lower().split())) for i, t in sorted(docs.items()) for k, x in enumerate(t.split("\n"))]
    first = {}
    for i, k, w in flat:
        first.setdefault(w, (i, k))
    near = {w for w in first if len(w) >= 8 and any(x != w and len(x) >= 8 and first[x] < first[w] and within_one(list(x), list(w)) for x in first)}
    gone = {(i, k) for i, k, w in flat if w and (first[w] < (i, k) or w in near)}
    out = {}
    for i, t in docs.items():
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if kept.split() or not any(j == i for j, _ in gone):
            out[i] = kept
    return out


def _near(docs):
    sets = {}
    for i, t in docs.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    out, group = {}, {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i: t for i, t in docs.items() if group[i] == i} or out


def test_pipeline_equals_brute_force(spark, tables):
    import public_tokenizers
    import tiktoken

    folder, rows, items = tables
    docs = _near(_lines(_rules({i: t for i, t, *_ in rows})))
    docs = {i: t for i, t in docs.items() if not any(x in t for _, x in items)}
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["ids"], r["intact"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (reference.encode_ordinary(t), True) for i, t in docs.items()} and 20 < len(got) < 120


CLASHES = ("lines", "words", "body", "n_words", "__bit", "__removed", "bit", "gone", "furniture", "depleted", "rules_n_words", "key", "component_id", "removed", "base_failed", "kept", "share", "node")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, tables, name, stage):
    """Clashing names, nulls in every column, empty and very long texts, repeated rows, and empty tables."""
    folder, rows, items = tables
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    long = " ".join(f"long{k % 50_000}" for k in range(60_000))
    leak = "a b c d e f g h. " + items[3][1] + " " + " ".join(f"own{k}" for k in range(60))
    fresh = " ".join(f"only{k}" for k in range(70))
    odd = [(None, fresh, None, None, None), (None, fresh, None, None, None), (None, leak, "en", "x", 1), (900, long, None, None, None), (901, fresh + " end", "en", "x", 3), (901, fresh + " end", "en", "x", 3), (902, " \n\t", "en", "x", 3)]
    docs = plain.unionByName(spark.createDataFrame(odd, plain.schema))
    want = stage(spark, docs, folder)
    wide = docs.select("*", *(F.lit("z").alias(c) for c in CLASHES))
    got = stage(spark, wide, folder)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert stage(spark, wide.limit(0), folder).count() == 0
    if name == "tokenise":
        assert want.columns == ["doc_id", "n_tokens", "ids", "intact"] and want.count() == docs.count()
        return
    assert want.columns == docs.columns and got.columns == wide.columns
    kept = [(r["doc_id"], r["text"]) for r in want.collect()]
    assert kept.count((None, fresh)) == 2 and (900, long) in kept
    assert kept.count((901, fresh + " end")) == 2
    assert ((None, leak) in kept) == (name != "decontaminate")
    assert ((902, " \n\t") in kept) == (name != "quality_rules") == ((202, None) in kept)


def test_there_are_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontaminate", "tokenise"]
