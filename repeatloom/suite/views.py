"""Sequences, features, points and text lines derived from the given tables.

The tables hold no genomes, so every check query works on rows that Spark derives
from them: whole document texts become sequences, line items become features,
orders become points.  ``CTES`` states the same views for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.functions import scans
from repeatloom.functions.motifs import MECHANISM_FAMILIES, RESCREEN_FAMILIES, SURVEY_FAMILIES
from repeatloom.operators.durable import once, stored

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ACGTACGTACGTACGTACGTACNNNN"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seq_col() -> Column:
    return F.col("seq")


def dna_of(text: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), ALPHABET, LETTERS)


def n_docs(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "documents").agg(F.count("*")).scalar()


def dna(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").repartition("doc_id")
    letters, images = ALPHABET + ALPHABET.lower(), LETTERS + LETTERS
    return once(d, dna=scans.kept_letters(F.col("text"), letters, images)).select("doc_id", F.col("source").alias("genome"), "lang", "dna")


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts with a forward and a reverse array set into them."""
    i, d = F.col("doc_id"), F.col("dna")
    n = F.length(d)
    unit = F.when(i % 4 < 2, F.lit("TTAGGG"))
    for j, u in enumerate(SURVEY_FAMILIES):
        unit = unit.when(i % 6 == j, F.lit(u))
    step = F.when(i % 10 == 0, F.floor(n / 6)).otherwise(F.floor(n / 200)) + 1
    g = F.expr("repeat(unit, cast((doc_id % 9) * step as int))")
    c = F.expr("repeat(reverse(translate(unit, 'ACGT', 'TGCA')), cast((doc_id % 5) * step as int))")
    mid = F.substring(d, F.lit(21), ((i % 7) * 8).cast("int"))
    rest = F.substring(d, (F.lit(21) + (i % 7) * 8).cast("int"), n)
    head = F.when(i % 3 == 0, "GT").when(i % 3 == 1, "CT").otherwise("")
    tail = F.when(i % 3 == 0, "AG").when(i % 3 == 1, "AC").otherwise("")
    arrays = dna(spark, sf).withColumn("unit", unit).withColumn("step", step).withColumn("g", g).withColumn("c", c)
    text = F.concat(
        head, F.substring(d, 1, 20),
        F.when(i % 2 == 0, F.concat("g", mid, "c")).otherwise(F.concat("c", mid, "g")), rest, tail)
    return once(arrays, seq=text).select("doc_id", "genome", "lang", "unit", "seq")


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return seqs(spark, sf).select(F.col("doc_id").alias("contig"), "genome", "seq")


def stored_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """Contigs with ``contig_len``, made once and written to the shared folder, for queries that read them several times."""
    return stored(contigs(spark, sf).withColumn("contig_len", F.length("seq").cast("long")), "contigs")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as features of an order's transcript on a document's contig."""
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % n_docs(spark, sf)).alias("contig"), F.col("l_orderkey").alias("parent"),
        F.when(F.col("l_returnflag") == "R", "CDS").otherwise("exon").alias("ftype"),
        F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % n_docs(spark, sf)).alias("contig"),
        pos.alias("pos"))


def flanks(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text cut in the middle: two flanks."""
    half = F.floor(F.length("dna") / 2).cast("int")
    fam = F.lit(MECHANISM_FAMILIES[0])
    for j, u in enumerate(MECHANISM_FAMILIES):
        fam = F.when(F.col("doc_id") % 5 == j, u).otherwise(fam)
    return dna(spark, sf).select(
        "doc_id", F.substring("dna", F.lit(1), half).alias("left"),
        F.substring("dna", half + 1, F.length("dna")).alias("right"), fam.alias("family"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as short sequences."""
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "role",
        dna_of(F.col("text")).alias("seq"))


# --- the same views in SQL --------------------------------------------------

def _family_rows(families: tuple[str, ...]) -> str:
    return ", ".join(f"('{u}', {i})" for i, u in enumerate(families))


def _dna_sql(col: str) -> str:
    return f"translate(upper(regexp_replace({col}, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{LETTERS}')"


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _motifs(name: str, families: tuple[str, ...]) -> str:
    return f"""{name} AS (
  SELECT DISTINCT family, rnk, strand, CAST(length(u) AS BIGINT) AS k, substring(u || u, CAST(i AS INT) + 1, length(u)) AS kmer
  FROM (SELECT family, rnk, 'fwd' AS strand, family AS u FROM (VALUES {_family_rows(families)}) f(family, rnk)
        UNION ALL
        SELECT family, rnk, 'rev', {RC.format('family')} FROM (VALUES {_family_rows(families)}) f(family, rnk)) s,
       unnest(range(length(u))) r(i))"""


def _hits(name: str, motifs: str, sizes: tuple[int, ...], words: str = "words") -> str:
    parts = " UNION ALL ".join(
        f"SELECT w.doc_id, w.pos, m.family, m.rnk, m.strand, m.k FROM {words} w JOIN {motifs} m "
        f"ON substring(w.word, 1, {k}) = m.kmer AND m.k = {k}" for k in sizes)
    return f"{name} AS ({parts})"


def _runs(name: str, hits: str, keys: str, least: int) -> str:
    """Gaps and islands over hit starts: a new island after the previous hit's end."""
    return f"""{name} AS (
  SELECT {keys}, min(pos) AS s, max(pos) + any_value(k) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY pos) AS island FROM (
      SELECT {keys}, pos, k, CASE WHEN pos > lag(pos) OVER (PARTITION BY {keys} ORDER BY pos) + k THEN 1 ELSE 0 END AS fresh
      FROM (SELECT DISTINCT {keys}, pos, k FROM {hits})))
  GROUP BY {keys}, island HAVING max(pos) + any_value(k) - min(pos) >= {least})"""


_CASE_UNIT = "CASE WHEN doc_id % 4 < 2 THEN 'TTAGGG' " + " ".join(
    f"WHEN doc_id % 6 = {j} THEN '{u}'" for j, u in enumerate(SURVEY_FAMILIES)) + " END"
_CASE_FAMILY = "CASE " + " ".join(
    f"WHEN doc_id % 5 = {j} THEN '{u}'" for j, u in enumerate(MECHANISM_FAMILIES)) + " END"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "dna": ((), f"dna AS (SELECT doc_id, source AS genome, lang, {_dna_sql('text')} AS dna FROM documents)"),
    "seqs": (("dna",), f"""seqs AS (
  SELECT doc_id, genome, lang, unit, p5 || substring(dna, 1, 20)
    || CASE WHEN doc_id % 2 = 0 THEN g || mid || c ELSE c || mid || g END
    || substring(dna, CAST(21 + (doc_id % 7) * 8 AS BIGINT)) || p3 AS seq
  FROM (SELECT *, repeat(unit, CAST((doc_id % 9) * step AS BIGINT)) AS g,
          repeat({RC.format('unit')}, CAST((doc_id % 5) * step AS BIGINT)) AS c,
          substring(dna, 21, CAST((doc_id % 7) * 8 AS BIGINT)) AS mid,
          CASE doc_id % 3 WHEN 0 THEN 'GT' WHEN 1 THEN 'CT' ELSE '' END AS p5,
          CASE doc_id % 3 WHEN 0 THEN 'AG' WHEN 1 THEN 'AC' ELSE '' END AS p3
        FROM (SELECT *, {_CASE_UNIT} AS unit,
                CASE WHEN doc_id % 10 = 0 THEN length(dna) // 6 ELSE length(dna) // 200 END + 1 AS step FROM dna)))"""),
    "lens": (("seqs",), "lens AS (SELECT doc_id, CAST(length(seq) AS BIGINT) AS n FROM seqs)"),
    "words": (("seqs",), """words AS (
  SELECT doc_id, base + i AS pos, substring(t, CAST(i AS BIGINT) + 1, 8) AS word, n FROM (
    SELECT doc_id, n, base, substring(seq, CAST(base AS BIGINT) + 1, 1007) AS t FROM (
      SELECT doc_id, seq, length(seq) AS n, unnest(range(0, length(seq), 1000)) AS base FROM seqs)),
    unnest(range(1000)) r(i) WHERE base + i < n)"""),
    "survey": ((), _motifs("survey", SURVEY_FAMILIES)),
    "mechanism": ((), _motifs("mechanism", MECHANISM_FAMILIES)),
    "rescreen": ((), _motifs("rescreen", RESCREEN_FAMILIES)),
    "tta": ((), _motifs("tta", ("TTAGGG",))),
    "survey_hits": (("words", "survey"), _hits("survey_hits", "survey", (5, 6, 7, 8))),
    "mechanism_hits": (("words", "mechanism"), _hits("mechanism_hits", "mechanism", (5, 6, 7))),
    "rescreen_hits": (("words", "rescreen"), _hits("rescreen_hits", "rescreen", (5, 6, 7, 8))),
    "tta_hits": (("words", "tta"), _hits("tta_hits", "tta", (6,))),
    "survey_runs": (("survey_hits",), _runs("survey_runs", "survey_hits", "doc_id, family, rnk", 1)),
    "rescreen_runs": (("rescreen_hits",), _runs("rescreen_runs", "rescreen_hits", "doc_id, family, rnk", 1)),
    "mechanism_runs": (("mechanism_hits",),
                       _runs("mechanism_runs", "mechanism_hits", "doc_id, family, rnk, strand", 10)),
    "tta_runs": (("tta_hits",), _runs("tta_runs", "tta_hits", "doc_id", 1)),
    "tta_strand_runs": (("tta_hits",), _runs("tta_strand_runs", "tta_hits", "doc_id, strand", 10)),
    "survey_cov": (("lens", "survey_runs"), f"""survey_cov AS (
  SELECT l.doc_id, f.family, f.rnk, CASE WHEN n > 0 THEN coalesce(b, 0) / n ELSE 0.0 END AS cov
  FROM lens l CROSS JOIN (VALUES {_family_rows(SURVEY_FAMILIES)}) f(family, rnk)
  LEFT JOIN (SELECT doc_id, family, CAST(sum(e - s) AS DOUBLE) AS b FROM survey_runs GROUP BY ALL) r
    ON r.doc_id = l.doc_id AND r.family = f.family)"""),
    "best": (("survey_cov",), """best AS (
  SELECT doc_id, cov AS telo_coverage, CASE WHEN cov > 0 THEN family END AS repeat_type FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cov DESC, rnk) AS r FROM survey_cov) WHERE r = 1)"""),
    "tta_cov": (("lens", "tta_runs"), """tta_cov AS (
  SELECT l.doc_id, CASE WHEN n > 0 THEN coalesce(b, 0) / n ELSE 0.0 END AS cov
  FROM lens l LEFT JOIN (SELECT doc_id, CAST(sum(e - s) AS DOUBLE) AS b FROM tta_runs GROUP BY ALL) r
    ON r.doc_id = l.doc_id)"""),
    "norm": (("seqs",), f"""norm AS (
  SELECT doc_id, genome, seq, left(seq, 2) AS donor, right(seq, 2) AS acceptor,
    CASE WHEN left(seq, 2) = 'CT' AND right(seq, 2) = 'AC' THEN {RC.format('seq')} ELSE seq END AS norm_seq FROM seqs)"""),
    "features": ((), """features AS (
  SELECT l_orderkey % (SELECT count(*) FROM documents) AS contig, l_orderkey AS parent,
    CASE WHEN l_returnflag = 'R' THEN 'CDS' ELSE 'exon' END AS ftype,
    CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS s,
    date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"""),
    "points": ((), """points AS (
  SELECT o_orderkey AS id, o_orderkey % (SELECT count(*) FROM documents) AS contig,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS pos FROM orders)"""),
    "introns": (("features",), """introns AS (
  SELECT contig, parent, mx AS s, s AS e, s - mx AS length FROM (
    SELECT contig, parent, s, max(e) OVER (PARTITION BY contig, parent ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx
    FROM features) WHERE mx < s)"""),
    "flanks": (("dna",), f"""flanks AS (
  SELECT doc_id, substring(dna, 1, length(dna) // 2) AS lf, substring(dna, length(dna) // 2 + 1) AS rf,
    {_CASE_FAMILY} AS family FROM dna)"""),
    "turns": ((), f"turns AS (SELECT conv_id * 1000 + turn AS id, conv_id, role, {_dna_sql('text')} AS seq FROM conversations)"),
    "strand_counts": (("seqs", "tta"), """strand_counts AS (
  SELECT doc_id, sum(CASE WHEN strand = 'fwd' THEN c ELSE 0 END) AS f, sum(CASE WHEN strand = 'rev' THEN c ELSE 0 END) AS r FROM (
    SELECT doc_id, strand, (length(seq) - length(replace(seq, kmer, ''))) // k AS c FROM seqs CROSS JOIN tta) GROUP BY doc_id)"""),
    "strand_class": (("strand_counts",), """strand_class AS (
  SELECT doc_id, f, r, CASE WHEN f + r = 0 THEN 0.5 ELSE f / (f + r) END AS fwd_frac,
    CASE WHEN f + r = 0 THEN 'unknown' WHEN f / (f + r) > 0.7 THEN 'coding-strand'
         WHEN f / (f + r) < 0.3 THEN 'template-strand' ELSE 'converging' END AS orientation FROM strand_counts)"""),
}


def with_ctes(*names: str, extra: str = "", body: str) -> str:
    """``WITH`` clause of the named views and what they need, then ``body``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, sql = CTES[name]
            for n in needs:
                add(n)
            done[name] = sql

    for n in names:
        add(n)
    parts = list(done.values()) + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + body

