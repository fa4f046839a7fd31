"""Registered queries of the library over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..operators import blocks as block_ops
from ..operators import contexts, streams, transforms, words
from ..sources.members import from_table
from . import archive, levels, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; of documents and pages, which one row group may hold, dealt to all cores if they are few splits."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and rows.rdd.getNumPartitions() < 4 * cores:
        return rows.repartition(cores)
    return rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, raw)``: texts as blocks of bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))


HIST = """
bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents),
counts AS (SELECT doc_id, h, count(*) AS c FROM bytes GROUP BY ALL),
size AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS x FROM documents),
measured AS (
  SELECT size.doc_id, any_value(n)::BIGINT AS n, coalesce(-sum(c / n * log2(c / n)), 0) AS entropy,
    coalesce(sum(CASE WHEN h >= '20' AND h < '7F' THEN c END), 0) / greatest(any_value(n), 1) AS printable, any_value(x) AS x
  FROM size LEFT JOIN counts USING (doc_id) GROUP BY size.doc_id),
profiled AS (
  SELECT doc_id, n, entropy, printable,
    CASE WHEN n < 32 OR entropy > 7.9 THEN 'Random' WHEN printable > 0.85 THEN 'Text'
      WHEN regexp_matches(x, '^(..)*?(7F454C46|CFFAEDFE|4D5A9000)') OR regexp_matches(x, '^(..)*?(5589E5|4889E5|FFD0)(..)*?(5589E5|4889E5|FFD0)') THEN 'Exec'
      ELSE 'Binary' END AS kind
  FROM measured)
"""


@query(f"WITH {HIST} SELECT kind, count(*) AS blocks, sum(n)::BIGINT AS bytes, round(avg(entropy), 3) AS mean_entropy FROM profiled GROUP BY kind")
def kind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ops.kind_summary(block_ops.profile(documents(spark, sf_dir)))


@query(f"WITH {HIST} SELECT doc_id, n, round(entropy, 4) AS entropy, round(printable, 4) AS printable, kind FROM profiled")
def block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = block_ops.profile(documents(spark, sf_dir))
    return out.select("doc_id", "n", F.round("entropy", 4).alias("entropy"), F.round("printable", 4).alias("printable"), "kind")


@query(f"WITH {HIST} SELECT ('0x' || h)::INT AS byte, sum(c)::BIGINT AS n FROM counts GROUP BY h")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ops.histogram(documents(spark, sf_dir))


@query(f"WITH {HIST} SELECT ('0x' || h)::INT AS byte, sum(c)::BIGINT AS n FROM counts GROUP BY h")
def byte_histogram_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ops.histogram_native(documents(spark, sf_dir))


@query(
    f"""WITH {HIST}, t AS (SELECT h, sum(c) AS n FROM counts GROUP BY h)
SELECT round(-sum(n / s * log2(n / s)), 4) AS entropy, sum(n)::BIGINT AS bytes FROM t, (SELECT sum(n) AS s FROM t)"""
)
def corpus_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = block_ops.histogram(documents(spark, sf_dir))
    counts = F.collect_list(F.col("n").cast("double"))
    return h.agg(F.round(B.entropy_of(counts), 4).alias("entropy"), F.sum("n").alias("bytes"))


@query(
    """WITH t AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, (i // 4096)::INT AS block_id, i::BIGINT AS start, least(i + 4096, n)::BIGINT AS stop, md5(unhex(substr(x, 2 * i + 1, 8192))) AS digest
FROM t, LATERAL (SELECT unnest(range(0, n, 4096)) AS i)"""
)
def block_cut_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = block_ops.cut_fixed(documents(spark, sf_dir), 4096, "raw")
    return cut.select("doc_id", "block_id", "start", "stop", F.md5("raw").alias("digest"))


@query(
    f"""WITH {HIST} SELECT kind, mode, CASE WHEN mode = 'slow' OR mode = 'hybrid' AND kind IN ('Binary', 'Exec') THEN 'slow' ELSE 'fast' END AS route,
  CASE WHEN kind = 'Text' THEN 12 ELSE 16 END AS least_match, kind <> 'Random' AS compressible, count(*) AS blocks,
  max(CASE WHEN kind = 'Text' THEN greatest(least(n, 4194304), 65536) WHEN kind = 'Random' THEN 65536 ELSE 1048576 END)::BIGINT AS size
FROM profiled, (SELECT unnest(['wire', 'general', 'fast', 'hybrid', 'slow']) AS mode) GROUP BY kind, mode"""
)
def engine_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    out = block_ops.profile(documents(spark, sf_dir)).select("n", "kind", F.explode(F.array(*(
        F.struct(F.lit(m).alias("mode"), B.engine_route(kind, m).alias("route")) for m in levels.MODES
    ))).alias("r"))
    return out.groupBy("kind", "r.mode", "r.route", B.min_match(kind).alias("least_match"), B.is_compressible(kind).alias("compressible")).agg(
        F.count("*").alias("blocks"), F.max(B.block_size(kind, F.col("n"))).alias("size")
    )


STRUCTURED = """
cells AS (
  SELECT 'page/' || page_id AS id, html AS t FROM pages UNION ALL SELECT 'doc/' || doc_id, text FROM documents
  UNION ALL SELECT 'user/' || user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' FROM events GROUP BY user_id
  UNION ALL SELECT 'order/' || l_orderkey, string_agg(concat_ws(',', l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) FROM lineitem GROUP BY l_orderkey),
s AS (SELECT id, t, substr(t, 1, 8192) AS s, regexp_replace(t, '^[ \\t\\n\\r\\f\\v]+', '') AS b FROM cells),
k AS (SELECT *, substr(b, 1, 1) AS f, length(s) - length(replace(s, ':', '')) AS colons, length(s) - length(replace(s, '"', '')) AS quotes,
  length(s) - length(replace(s, ',', '')) AS commas, length(s) - length(replace(s, chr(9), '')) AS tabs,
  length(s) - length(replace(s, '<', '')) AS lt, length(s) - length(replace(s, '>', '')) AS gt FROM s),
w AS (SELECT *, list_filter(string_split(s, chr(10)), lambda x: x <> '')[1:16] AS lines, CASE WHEN tabs > commas THEN chr(9) ELSE ',' END AS d FROM k),
v AS (SELECT *, list_transform(lines, lambda x: length(regexp_replace(x, '"([^"]|"")*("|$)', '', 'g')) - length(replace(regexp_replace(x, '"([^"]|"")*("|$)', '', 'g'), d, '')) + 1) AS n FROM w),
kinds AS (SELECT id,
  octet_length(encode(t)) >= 32 AND f IN ('{', '[') AND colons >= 2 AND quotes >= 2 * colons AS is_json,
  octet_length(encode(t)) >= 32 AND f NOT IN ('{', '[', '<') AND octet_length(encode(s)) = length(s) AND greatest(commas, tabs) >= 4 AND len(lines) >= 2
    AND coalesce(n[1] >= 2, false) AND 2 * len(list_filter(n, lambda x: x = n[1])) >= len(n) AS is_csv,
  octet_length(encode(t)) >= 16 AND f = '<' AND (b LIKE '<?xml%' OR b LIKE '<?XML%' OR
    (length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) * 100 // greatest(octet_length(encode(s)), 1) >= 70 AND lt >= 2 AND gt >= 2 AND abs(lt - gt) <= lt // 2 + 1)) AS is_xml
  FROM v)
"""


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, t)``: documents, pages, arrays of JSON and CSV made of other tables."""
    listed = lambda order, x, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, x.alias("x")))), lambda e: e["x"]), by)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("id"), F.col("text").alias("t"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("id"), F.col("html").alias("t"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("["), listed(["event_id"], F.col("props"), ","), F.lit("]")).alias("t"))
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed(["l_linenumber", "l_partkey", "l_suppkey"], line, "\n").alias("t"))
    return docs.unionByName(pages).unionByName(users.select(F.concat(F.lit("user/"), "user_id").alias("id"), "t")).unionByName(
        orders.select(F.concat(F.lit("order/"), "l_orderkey").alias("id"), "t")
    )


@query(f"WITH {STRUCTURED} SELECT id, is_json FROM kinds")
def detect_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(spark, sf_dir).select("id", B.looks_like_json(F.col("t")).alias("is_json"))


@query(f"WITH {STRUCTURED} SELECT id, is_csv FROM kinds")
def detect_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(spark, sf_dir).select("id", B.looks_like_csv(F.col("t")).alias("is_csv"))


@query(f"WITH {STRUCTURED} SELECT id, is_xml FROM kinds")
def detect_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(spark, sf_dir).select("id", B.looks_like_xml(F.col("t")).alias("is_xml"))


@query(f"WITH {STRUCTURED} SELECT CASE WHEN is_json THEN 'json' WHEN is_csv THEN 'csv' WHEN is_xml THEN 'xml' END AS structure, count(*) AS blocks FROM kinds GROUP BY 1")
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured(spark, sf_dir).groupBy(block_ops.structure_of(F.col("t")).alias("structure")).agg(F.count("*").alias("blocks"))


WORDS = """
w AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\x00!-/:-@\\[-`{-~]+') AS l FROM documents)),
counted AS (SELECT word, count(*) AS freq, min((doc_id, place)) AS seen FROM w WHERE octet_length(encode(word)) BETWEEN 2 AND 255 GROUP BY word),
short AS (SELECT word, freq, seen, 0 AS tier FROM counted ORDER BY freq DESC, seen LIMIT 127),
long AS (SELECT word, freq, seen, 1 AS tier FROM counted WHERE octet_length(encode(word)) >= 4 AND word NOT IN (SELECT word FROM short) ORDER BY freq DESC, seen LIMIT 897),
dict AS (SELECT (row_number() OVER (ORDER BY tier, freq DESC, seen) - 1)::INT AS word_id, word, freq FROM (SELECT * FROM short UNION ALL SELECT * FROM long))
"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {WORDS} SELECT word, freq, seen[1] AS doc, seen[2]::INT AS place FROM counted".replace("seen[1]", "struct_extract(seen, 1)").replace("seen[2]", "struct_extract(seen, 2)"))
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("word", "freq", "first_seen.doc", "first_seen.place")


@query(f"WITH {WORDS} SELECT word_id, word, freq FROM dict")
def dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.dictionary(_counts(spark, sf_dir))


@query(f"WITH {WORDS} SELECT word_id, word, (freq * (octet_length(encode(word)) - CASE WHEN word_id < 127 THEN 1 ELSE 3 END) - (octet_length(encode(word)) + 1))::BIGINT AS saved FROM dict")
def dictionary_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.savings(words.dictionary(_counts(spark, sf_dir)))


@query(
    """WITH l AS (SELECT regexp_extract_all(text, '[^ \\t\\n\\r\\x00!-/:-@\\[-`{-~]+') AS l FROM documents),
p AS (SELECT unnest(l[:-2]) AS previous, unnest(l[2:]) AS word FROM l WHERE len(l) >= 2) SELECT previous, word, count(*) AS n FROM p GROUP BY ALL"""
)
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_pairs(table(spark, sf_dir, "documents"))


@query(
    """WITH u AS (SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS t FROM events GROUP BY user_id),
b AS (SELECT *, regexp_replace(t, '"([^"\\\\]|\\\\.)*"', '', 'g') AS bare, len(regexp_extract_all(t, '("([^"\\\\]|\\\\.)*")[ \\t\\r\\n]*:')) AS k FROM u)
SELECT user_id, k AS n_keys, len(regexp_extract_all(t, '"([^"\\\\]|\\\\.)*"')) - k AS n_strings, len(regexp_extract_all(bare, '-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?')) AS n_numbers,
  length(regexp_replace(bare, '-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?', '', 'g')) AS structural FROM b"""
)
def json_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda e: e["props"]), ",")
    users = events.groupBy("user_id").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("t"))
    return users.select("user_id", streams.json_totals("t").alias("s")).select("user_id", "s.*")


@query(
    """WITH c AS (SELECT string_split(concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate), ',') AS l FROM lineitem),
x AS (SELECT unnest(range(len(l))) AS i, unnest(l) AS cell FROM c)
SELECT i::INT AS "column", count(*) AS cells, sum(octet_length(encode(cell)))::BIGINT AS bytes FROM x GROUP BY i"""
)
def csv_column_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in names))
    return streams.csv_columns(table(spark, sf_dir, "lineitem").select(line.alias("line")), "line", ",")


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<[^>]*>')) AS n_tags, len(regexp_extract_all(html, '<[^\\s>/]+\\s[^>]*>')) AS n_attrs,
  length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars FROM pages"""
)
def xml_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", streams.xml_totals("html").alias("s")).select("page_id", "s.*")


def _shred(structure: str, name: str, key: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every cell split to streams and joined again."""
        cells = table(spark, sf_dir, name).select(key, F.encode(column, "UTF-8").alias("raw"))
        back = cells.withColumn("back", streams.join_streams(streams.split_streams("raw", structure), structure))
        return back.select(key, F.octet_length("back").cast("long").alias("n"), F.md5("back").alias("digest"))

    run.__name__ = f"shred_{structure}"
    query(f"SELECT {key}, octet_length(encode({column}))::BIGINT AS n, md5({column}) AS digest FROM {name}")(run)


_shred("json", "events", "event_id", "props")
_shred("csv", "documents", "doc_id", "text")
_shred("xml", "pages", "page_id", "html")


def _round_trip(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every document through a transform and its inverse."""
        back = documents(spark, sf_dir).withColumn("back", transforms.inverse(transforms.transform("raw", name), name))
        return back.select("doc_id", F.octet_length("back").cast("long").alias("n"), F.md5("back").alias("digest"))

    run.__name__ = f"transform_{name}"
    query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n, md5(text) AS digest FROM documents")(run)


for _name in transforms.KERNELS:
    _round_trip(_name)


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n, md5(text) AS digest FROM documents")
def dictionary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.collect_words(words.dictionary(_counts(spark, sf_dir)))
    docs = documents(spark, sf_dir)
    back = docs.withColumn("back", F.coalesce(words.restore_words(words.replace_words("raw", found), found), "raw"))
    return back.select("doc_id", F.octet_length("back").cast("long").alias("n"), F.md5("back").alias("digest"))


@query(
    """SELECT doc_id, CASE WHEN n > 0 THEN n + 4 ELSE 0 END::BIGINT AS coded, md5(array_to_string(list_sort(regexp_extract_all(x, '..')), '')) AS bytes, upper(coalesce(list_min(regexp_extract_all(x, '..')), '')) AS least
FROM (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS x FROM documents)"""
)
def bwt_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every sorted text: the length with its row number, and its bytes in order, which are the text's."""
    coded = documents(spark, sf_dir).withColumn("coded", transforms.transform("raw", "bwt"))
    body = F.hex(F.expr("substring(coded, 1, octet_length(coded) - 4)"))
    pairs = F.sort_array(F.regexp_extract_all(body, F.lit(".."), F.lit(0)))
    return coded.select("doc_id", F.octet_length("coded").cast("long").alias("coded"), F.md5(F.array_join(pairs, "")).alias("bytes"), F.coalesce(F.get(pairs, F.lit(0)), F.lit("")).alias("least"))


@query(
    """WITH x AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)
SELECT doc_id, len(b)::BIGINT AS coded, coalesce(upper(b[1]), '') AS first, len(list_filter(range(2, len(b) + 1), lambda i: b[i] = b[i - 1]))::BIGINT AS fronts,
  len(list_filter(range(3, len(b) + 1), lambda i: b[i] = b[i - 2] AND b[i] <> b[i - 1]))::BIGINT AS seconds FROM x"""
)
def mtf_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text's ranks: their number, the first, which is the byte itself, and how often the first and second place."""
    pairs = F.regexp_extract_all(F.hex("coded"), F.lit(".."), F.lit(0))
    coded = documents(spark, sf_dir).withColumn("coded", transforms.transform("raw", "mtf")).withColumn("r", pairs)
    later = F.slice("r", F.lit(2), F.size("r"))
    again = lambda rank: F.size(F.filter(later, lambda x: x == rank)).cast("long")
    return coded.select("doc_id", F.octet_length("coded").cast("long").alias("coded"), F.coalesce(F.get("r", F.lit(0)), F.lit("")).alias("first"), again("00").alias("fronts"), _seconds().alias("seconds"))


def _seconds() -> Column:
    """Ranks of 1 from the third on: a byte last seen two places before, with another between.

    Ranks of 1 with a run between (a, b, b, a) are left out by asking that the rank before is not 0.
    """
    return F.size(F.filter(F.slice("r", F.lit(3), F.size("r")), lambda x, i: (x == "01") & (F.get("r", i + 1) != "00"))).cast("long")


@query(
    """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, h, run, count(*) AS length FROM g GROUP BY ALL)
SELECT length::INT AS length, count(*) AS runs, count(DISTINCT h) AS bytes FROM r GROUP BY length"""
)
def rle0_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.runs(documents(spark, sf_dir), "doc_id", "raw").groupBy("length").agg(F.count("*").alias("runs"), F.count_distinct("byte").alias("bytes"))


@query(
    """WITH x AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 8) AS gram FROM x, LATERAL (SELECT unnest(range(0, n - 3)) AS i)),
d AS (SELECT i - lag(i) OVER (PARTITION BY doc_id, gram ORDER BY i) AS distance FROM g)
SELECT CASE WHEN distance IS NULL THEN -1 ELSE floor(log2(distance))::INT END AS reach, count(*) AS n FROM d GROUP BY 1"""
)
def prev_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = transforms.previous_grams(documents(spark, sf_dir), "doc_id", "raw")
    reach = F.when(F.col("distance").isNull(), -1).otherwise(F.floor(F.log2("distance")).cast("int"))
    return grams.groupBy(reach.alias("reach")).agg(F.count("*").alias("n"))


BIGRAMS = """
x AS (SELECT hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
o1 AS (SELECT substr(h, 2 * i + 1, 2) AS c1, substr(h, 2 * i + 3, 2) AS b, count(*) AS n FROM x, LATERAL (SELECT unnest(range(0, n - 1)) AS i) GROUP BY ALL),
o2 AS (SELECT substr(h, 2 * i + 1, 4) AS c2, substr(h, 2 * i + 5, 2) AS b, count(*) AS n FROM x, LATERAL (SELECT unnest(range(0, n - 2)) AS i) GROUP BY ALL),
o3 AS (SELECT substr(h, 2 * i + 1, 6) AS c3, substr(h, 2 * i + 7, 2) AS b, count(*) AS n FROM x, LATERAL (SELECT unnest(range(0, n - 3)) AS i) GROUP BY ALL),
t1 AS (SELECT c1, sum(n)::BIGINT AS t1, count(*) AS d1 FROM o1 GROUP BY c1), t2 AS (SELECT c2, sum(n)::BIGINT AS t2, count(*) AS d2 FROM o2 GROUP BY c2),
t3 AS (SELECT c3, sum(n)::BIGINT AS t3, count(*) AS d3 FROM o3 GROUP BY c3)
"""


@query(f"WITH {BIGRAMS} SELECT ('0x' || c1)::BIGINT AS context, ('0x' || b)::INT AS byte, n FROM o1")
def order_k_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.context_counts(documents(spark, sf_dir), 1)


@query(f"WITH {BIGRAMS} SELECT count(DISTINCT c2) AS contexts, sum(n)::BIGINT AS n, round(sum(-n * log2(n / t2)) / sum(n), 4) AS bits FROM o2 JOIN t2 USING (c2)")
def order_k_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.conditional_entropy(contexts.context_counts(documents(spark, sf_dir), 2))


SECOND = "t2 >= 4 AND (t1 < 2 OR t2 * (d1 + 1) >= t1 * (d2 + 1))"
THIRD = "t3 >= 6 AND (t2 < 4 OR t3 * (d2 + 1) >= t2 * (d3 + 1)) AND (t1 < 2 OR t3 * (d1 + 1) >= t1 * (d3 + 1))"


@query(f'WITH {BIGRAMS} SELECT CASE WHEN {SECOND} THEN 2 WHEN t1 >= 2 THEN 1 ELSE 0 END AS "order", count(*) AS contexts, sum(t2)::BIGINT AS n FROM t2 JOIN t1 ON substr(c2, 3, 2) = c1 GROUP BY 1')
def order_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return contexts.chosen_orders(contexts.context_counts(docs, 1), contexts.context_counts(docs, 2))


@query(
    f"""WITH {BIGRAMS} SELECT CASE WHEN {THIRD} THEN 3 WHEN {SECOND} THEN 2 WHEN t1 >= 2 THEN 1 ELSE 0 END AS "order", count(*) AS contexts, sum(t3)::BIGINT AS n
FROM t3 JOIN t2 ON substr(c3, 3, 4) = c2 JOIN t1 ON substr(c2, 3, 2) = c1 GROUP BY 1"""
)
def order_selector_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return contexts.chosen_orders(*(contexts.context_counts(docs, k) for k in (1, 2, 3)))


@query(f"WITH {BIGRAMS} SELECT ('0x' || c1)::INT AS first, ('0x' || b)::INT AS second, n FROM o1 WHERE n >= 4")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.frequent_pairs(contexts.context_counts(documents(spark, sf_dir), 1))


@query(f"WITH {BIGRAMS} SELECT ((('0x' || b)::INT - ('0x' || c1)::INT + 256) % 256)::INT AS delta, sum(n)::BIGINT AS n FROM o1 GROUP BY 1")
def exec_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.deltas(contexts.context_counts(documents(spark, sf_dir), 1))


@query(
    f"""WITH {HIST}, t AS (SELECT ('0x' || h)::INT AS b, sum(c)::BIGINT AS n FROM counts GROUP BY h)
SELECT CASE WHEN b IN (32, 9, 10, 13) THEN 'space' WHEN chr(b) IN ('a','e','i','o','u','A','E','I','O','U') AND b < 128 THEN 'vowel' WHEN b BETWEEN 48 AND 57 THEN 'digit'
  WHEN b IN (46,44,59,58,33,63,34,39,45,40,41,91,93,123,125) THEN 'punct' WHEN b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 THEN 'consonant' ELSE 'other' END AS class, sum(n)::BIGINT AS n
FROM t GROUP BY 1"""
)
def byte_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.class_profile(block_ops.histogram(documents(spark, sf_dir)))


@query(
    f"""WITH {HIST}, t AS (SELECT ('0x' || h)::INT AS byte, sum(c)::BIGINT AS n FROM counts GROUP BY h),
f AS (SELECT byte, n, greatest(1, (n * 4096) // (SELECT sum(n) FROM t))::BIGINT AS q, row_number() OVER (ORDER BY n DESC, byte) AS r FROM t),
g AS (SELECT byte, CASE WHEN r = 1 THEN 4096 - (SELECT sum(q) FROM f) + q ELSE q END::BIGINT AS freq FROM f)
SELECT byte, freq, coalesce(sum(freq) OVER (ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g"""
)
def symbol_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.frequencies(block_ops.histogram(documents(spark, sf_dir)))


@query(
    """WITH n AS (SELECT page_id, url AS name FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^[a-z]+://', '') FROM pages
  UNION ALL SELECT page_id, '../' || page_id FROM pages UNION ALL SELECT page_id, '' FROM pages UNION ALL SELECT page_id, 'a/' || page_id || '/b.txt' FROM pages)
SELECT page_id, name, coalesce(name <> '' AND octet_length(encode(name)) <= 4096 AND NOT starts_with(name, '/') AND NOT contains(name, '\\')
  AND len(list_filter(string_split(name, '/'), lambda p: p IN ('', '.', '..'))) = 0, false) AS safe FROM n"""
)
def safe_member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    forms = (F.col("url"), F.regexp_replace("url", "^[a-z]+://", ""), F.concat(F.lit("../"), key), F.lit(""), F.concat(F.lit("a/"), key, F.lit("/b.txt")))
    names = p.select("page_id", F.explode(F.array(*forms)).alias("name"))
    return names.withColumn("safe", B.safe_member_name(F.col("name")))


@query(
    "WITH m(method, label, kind) AS (VALUES "
    + ", ".join(f"({k}, '{v}', '{'Random' if k == 0 else 'Binary' if k in (3, 19) else 'Exec' if k in (4, 14) else 'Text'}')" for k, v in levels.METHODS.items())
    + ") SELECT (l_orderkey + l_linenumber) % 21 AS method, label, kind, count(*) AS n FROM lineitem JOIN m ON (l_orderkey + l_linenumber) % 21 = method GROUP BY ALL"
)
def method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") + F.col("l_linenumber")) % 21).alias("method"))
    return m.groupBy("method").agg(F.count("*").alias("n")).select("method", levels.method_label(F.col("method")).alias("label"), levels.method_kind(F.col("method")).alias("kind"), "n")


@query(
    """SELECT doc_id, '424C4B4C' || '02' || '01' || '10' || concat_ws('', substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS header
FROM (SELECT doc_id, lpad(to_hex((octet_length(encode(text)) + 4095) // 4096), 8, '0') AS h FROM documents)"""
)
def container_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.floor((F.octet_length("raw") + 4095) / 4096)
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("424C4B4C020110"), B.little_endian(blocks, 4)).alias("header"))


@query(
    """WITH n AS (SELECT source, doc_id, (octet_length(encode(text)) + 4095) // 4096 AS num FROM documents),
b AS (SELECT doc_id, unnest(range(0, octet_length(encode(text)), 4096)) AS i, octet_length(encode(text)) AS size FROM documents)
SELECT doc_id, (i // 4096)::INT AS block_id, least(4096, size - i)::BIGINT AS comp_len, i::BIGINT AS "offset" FROM b"""
)
def archive_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = block_ops.cut_fixed(documents(spark, sf_dir).withColumnRenamed("doc_id", "member_id"), 4096, "raw")
    out = archive.offsets(cut.select("member_id", "block_id", (F.col("stop") - F.col("start")).alias("comp_len")))
    return out.withColumnRenamed("member_id", "doc_id")


METRICS = """
m AS (SELECT source AS file, sum(octet_length(encode(text)))::BIGINT AS original, count(*) AS k FROM documents GROUP BY source),
e AS (SELECT file, 'level-' || l AS engine, (k * 7 + l * 13) % 41 / 2.0 AS ratio, original / 1000 % 17 + l AS speed, original FROM m, (SELECT unnest([1, 3, 9, 19]) AS l)),
p AS (SELECT file, 'peer-' || l AS engine, (k * 5 + l * 11) % 41 / 2.0 AS ratio, original / 1000 % 13 + l AS speed FROM m, (SELECT unnest([1, 2, 3]) AS l)),
v AS (SELECT e.file, e.engine, p.engine AS peer, CASE WHEN e.ratio = p.ratio OR e.ratio < 0.5 AND p.ratio < 0.5 THEN 'tie' WHEN e.ratio < p.ratio THEN 'win' ELSE 'lose' END AS ratio,
  CASE WHEN e.speed = p.speed THEN 'tie' WHEN e.speed > p.speed THEN 'win' ELSE 'lose' END AS speed FROM e JOIN p USING (file)),
b AS (SELECT *, CASE WHEN ratio <> 'lose' AND speed = 'win' THEN 'win' WHEN ratio = 'lose' AND speed = 'lose' THEN 'lose' ELSE 'split' END AS both FROM v)
"""


def _metrics(spark: SparkSession, sf_dir: str, name: str, ids: list[int], a: int, b: int, modulus: int) -> DataFrame:
    """Sizes and speeds made from byte counts, so that they are the same on every machine."""
    m = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.sum(F.octet_length("text")).alias("original"), F.count("*").alias("k"))
    l = F.explode(F.array(*map(F.lit, ids)))
    return m.select("file", "original", "k", l.alias("l")).select(
        "file", F.concat(F.lit(name), "l").alias("engine"), ((F.col("k") * a + F.col("l") * b) % 41 / F.lit(2.0)).alias("ratio"),
        (F.col("original") / 1000 % modulus + F.col("l")).alias("speed"), "original",
    )


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.verdicts(_metrics(spark, sf_dir, "level-", [1, 3, 9, 19], 7, 13, 17), _metrics(spark, sf_dir, "peer-", [1, 2, 3], 5, 11, 13))


@query(f"WITH {METRICS} SELECT file, engine, peer, ratio, speed, both FROM b".replace("both FROM b", '"both" FROM b').replace("AS both FROM v", 'AS "both" FROM v'))
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(
    f"""WITH {METRICS}, x AS (SELECT 'ratio' AS axis, engine, peer, ratio AS t FROM b UNION ALL SELECT 'speed', engine, peer, speed FROM b UNION ALL SELECT 'both', engine, peer, "both" FROM b)
SELECT axis, engine, peer, count(*) FILTER (t = 'win') AS wins, count(*) FILTER (t = 'lose') AS losses, count(*) FILTER (t = 'tie') AS ties FROM x GROUP BY ALL""".replace("AS both FROM v", 'AS "both" FROM v')
)
def win_loss_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tally(_verdicts(spark, sf_dir))


@query(
    f"""WITH {METRICS} SELECT e.file, e.engine, e.ratio, e.ratio - b0.ratio AS delta,
  CASE WHEN e.ratio - b0.ratio < -0.05 THEN 'better' WHEN e.ratio - b0.ratio > 0.05 THEN 'worse' ELSE 'same' END AS mark
FROM e JOIN (SELECT file, ratio FROM e WHERE engine = 'level-9') b0 USING (file) WHERE e.engine <> 'level-9'""".replace("AS both FROM v", 'AS "both" FROM v')
)
def config_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.against_baseline(_metrics(spark, sf_dir, "level-", [1, 3, 9, 19], 7, 13, 17), "level-9")


@query(
    f"""WITH {METRICS} SELECT engine, count(*) AS files, sum(original)::BIGINT AS original, sum(original * (ratio::DOUBLE) / 100)::BIGINT AS compressed FROM e GROUP BY engine""".replace("AS both FROM v", 'AS "both" FROM v')
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir, "level-", [1, 3, 9, 19], 7, 13, 17).withColumn("compressed", F.col("original") * F.col("ratio") / 100)
    return scoring.totals(m).select("engine", "files", "original", F.round("compressed").cast("long").alias("compressed"))


def _archive(name: str, mode: str, **options: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every document coded under a mode and decoded again."""
        members = from_table(table(spark, sf_dir, "documents"), "doc_id", "text")
        coded, found = archive.compress(members, mode=mode, **options)
        back = archive.decompress(coded, members, found)
        return back.select(F.col("member_id").alias("doc_id"), F.octet_length("content").cast("long").alias("n"), F.md5("content").alias("digest"))

    run.__name__ = f"roundtrip_{name}"
    query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n, md5(text) AS digest FROM documents")(run)


for _mode in ("wire", "general", "fast"):
    _archive(_mode, _mode)
#: Bit mixing in blocks of 4 KiB, many at once.
for _mode in ("slow", "hybrid"):
    _archive(f"{_mode}_4k", _mode, window=4096)
#: With trials for blocks of 256 bytes and up, so that every pipeline for text is tried and most are taken.
_archive("fast_trials", "fast", floor=256, plain_floor=256)


@query()
def trial_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pipeline of every page and document; every block is tried, short and near-random ones too."""
    cells = structured(spark, sf_dir).withColumn("member_id", F.xxhash64("id")).select("member_id", F.encode("t", "UTF-8").alias("content"))
    blocks = block_ops.cut(cells, window=1 << 20)
    return archive.winners(archive.trials(blocks, [], 0, 0, most_bits=8.0)).groupBy("pipeline").agg(F.count("*").alias("blocks"), F.sum("size").alias("size"))


@query()
def parse_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest parse of every document: runs, bytes they cover, and its cost in bits."""
    docs = block_ops.profile(documents(spark, sf_dir)).withColumn("runs", transforms.parse_runs("raw", "kind"))
    covered = F.aggregate("runs", F.lit(0), lambda a, r: a + r["length"])
    literal = F.when(F.col("kind").isin("Text", "Random"), 4.0).otherwise(5.0)
    return docs.select("doc_id", "kind", F.size("runs").alias("runs"), covered.alias("covered"), (33.0 * F.size("runs") + literal * (F.col("n") - covered)).alias("bits"))
