"""Check queries of this folder's operators over the given tables, and their SQL twins."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.llm import (
    alignment, byte_bpe, chat, collocations, decontaminate, licenses, line_dedup, piece_counts, quality, shingle_join,
    substring_dedup, syncmers, toxicity,
)
from repeatloom.suite.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def check(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file(name: str = RANKS) -> bytes:
    """Read on the driver; the tasks get the bytes."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def id_digests(ids: str, decoded: bytes) -> tuple[str, str]:
    return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@check("op1_line_dedup", rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{line_dedup.HOST}', 1)), '') AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup.SKIPPED}', '', 'g'),
      '{line_dedup.BREAKS}', chr(10), 'g'), '{line_dedup.TAGS}', '', 'g'), chr(10)) AS ls FROM pages),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT DISTINCT page_id, host, line FROM (SELECT page_id, host, trim(unnest(ls)) AS line FROM p) WHERE line <> ''),
b AS (SELECT host, list(line) AS bad FROM (SELECT host, line, count(*) AS c FROM l GROUP BY ALL) JOIN n USING (host)
  WHERE c >= 2 AND c > 0.1 * pages GROUP BY host)
SELECT page_id, p.host, len(list_filter(ls, lambda x: trim(x) <> '')) AS n_lines,
  len(list_filter(ls, lambda x: coalesce(list_contains(bad, trim(x)), false))) AS n_dropped,
  array_to_string(list_filter(ls, lambda x: NOT coalesce(list_contains(bad, trim(x)), false)), chr(10)) AS text
FROM p LEFT JOIN b ON p.host = b.host""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text"))
    return line_dedup.drop_boilerplate(pages, "page_id", "host", "text", counts=("n_lines", "n_dropped"))


@check("op2_syncmers")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


@check("op4_chat_format", """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(role || chr(31) || text, chr(30)) OVER w AS pre
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n AND pre NOT IN
    (SELECT pre FROM p WHERE pos < n) GROUP BY pre)
SELECT conv_id, count(*) AS n_turns, any_value(copies) AS copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM p JOIN e USING (conv_id) GROUP BY conv_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@check("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(
        table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN, describe=id_digests,
        fields=[T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


@check("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@check("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


SQL_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""


@check("op7_decontaminate", rf"""
WITH iw AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS size,
    array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM dw, (SELECT DISTINCT size FROM windows)),
hits AS (SELECT doc_id, item_id, i, i + s.size - 1 AS e FROM starts s
  JOIN windows v ON v.size = s.size AND v.win = array_to_string(list_slice(w, i, i + s.size - 1), ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, e + 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@check("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@check("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), rank_file())


@check("op10_shingle_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@check("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@check("op12_collocations", r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')))
    AS phrase FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, (2000000 * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, a, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase FROM
  (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c))),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_parts i
  WHERE i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.a >= 80 * low.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@check("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
