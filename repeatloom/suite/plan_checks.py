"""Check queries for the plans."""

from __future__ import annotations

from pyspark.sql import functions as F


from repeatloom.functions import scalars as S
from repeatloom.operators import arrays as A
from repeatloom.operators import intervals as I
from repeatloom.operators import sequences as Q

from repeatloom.operators.durable import stored
from repeatloom.plans import compartments as D
from repeatloom.plans import linkers as L
from repeatloom.plans import mechanism as B
from repeatloom.plans import surveys as P
from repeatloom.plans import validation as C
from repeatloom.sources import readers as R
from repeatloom.suite import views as V
from repeatloom.suite.interval_checks import _MERGED, _lengths
from repeatloom.suite.motif_checks import _FAMILY, _classified, _NEAR
from repeatloom.suite.registry import check
from repeatloom.suite.scalar_checks import FINDER, _VCF, _vcf_lines, finder_lines
from repeatloom.suite.summary_checks import _SIDES
from repeatloom.suite.views import RC, seq_col, with_ctes


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_INTRONS = f"""picked AS (SELECT contig, s, e, min(parent) AS parent FROM introns WHERE length BETWEEN 20 AND 500000 GROUP BY contig, s, e),
itext AS (SELECT (contig * 100000 + s) * 100000 + e AS doc_id, contig, genome, parent, substring(seq, s + 1, e - s) AS seq FROM picked JOIN seqs ON doc_id = contig WHERE s < length(seq)),
ik AS (SELECT t.doc_id, i AS pos, substring(seq, CAST(i AS BIGINT) + 1, 6) AS w FROM itext t, unnest(range(length(seq) - 5)) r(i)),
ihits AS (SELECT DISTINCT doc_id, pos, 6 AS k FROM ik JOIN tta ON w = kmer), """ + V._runs("iruns", "ihits", "doc_id", 1) + f""",
icov AS (SELECT t.*, coalesce(b, 0) / length(seq) AS cov FROM itext t LEFT JOIN (SELECT doc_id, CAST(sum(e - s) AS DOUBLE) AS b FROM iruns GROUP BY doc_id) r USING (doc_id)),
inorm AS (SELECT *, CASE WHEN left(seq, 2) = 'CT' AND right(seq, 2) = 'AC' THEN {RC.format('seq')} ELSE seq END AS nseq FROM icov WHERE cov >= 0.85),
imot AS (SELECT *, CASE WHEN left(nseq, 2) = 'GT' AND right(nseq, 2) = 'AG' AND length(nseq) >= 8 THEN substring(nseq, length(nseq) - 5, 4) END AS a4,
   CASE WHEN left(nseq, 2) = 'GT' AND right(nseq, 2) = 'AG' AND length(nseq) >= 8 THEN substring(nseq, 3, 4) END AS d4 FROM inorm)"""


def _introns(spark, sf, max_len=I.INTRON_MAX_HUMAN):
    chunks = Q.chunk(V.contigs(spark, sf), ["contig", "genome"], size=1024)
    return P.intron_texts(V.features(spark, sf), chunks, max_len, 1024)


@check("q03_human_survey", with_ctes("introns", "seqs", "tta", extra=_INTRONS, body="""
SELECT g.*, n_total, n_gt_ag FROM (
  SELECT genome, count(*) AS n_introns, count(*) FILTER (cov >= 0.1) AS ge_10, count(*) FILTER (cov >= 0.3) AS ge_30, count(*) FILTER (cov >= 0.5) AS ge_50,
    count(*) FILTER (cov >= 0.7) AS ge_70, count(*) FILTER (cov >= 0.85) AS ge_85, count(*) FILTER (cov >= 0.95) AS ge_95 FROM icov GROUP BY genome) g
LEFT JOIN (SELECT genome, count(*) AS n_total, count(*) FILTER (left(nseq, 2) = 'GT' AND right(nseq, 2) = 'AG') AS n_gt_ag FROM imot GROUP BY genome) b ON b.genome = g.genome"""))
def q03(spark, sf):
    s = P.human_survey(_introns(spark, sf))
    return s.select("genome", "n_introns", *[f"ge_{t}" for t in (10, 30, 50, 70, 85, 95)], "n_total", "n_gt_ag")


@check("q01_screened_introns", with_ctes("best", "norm", "strand_class", body="""
SELECT b.doc_id, round(telo_coverage, 6) AS telo_coverage, repeat_type, round(fwd_frac, 6) AS fwd_frac, orientation, left(norm_seq, 8) AS donor_8, right(norm_seq, 8) AS acceptor_8, md5(norm_seq) AS norm
FROM best b JOIN norm n ON n.doc_id = b.doc_id JOIN strand_class c ON c.doc_id = b.doc_id WHERE telo_coverage >= 0.85"""))
def q01(spark, sf):
    return P.screen(V.seqs(spark, sf)).select(
        "doc_id", F.round("telo_coverage", 6).alias("telo_coverage"), "repeat_type", F.round("fwd_frac", 6).alias("fwd_frac"),
        "orientation", "donor_8", "acceptor_8", F.md5("norm_seq").alias("norm"))


_BOUND = """b AS (SELECT genome, orientation, norm_seq, CASE WHEN left(norm_seq, 2) = 'GT' AND right(norm_seq, 2) = 'AG' AND length(norm_seq) >= 8 THEN substring(norm_seq, 3, 4) END AS d4,
  CASE WHEN left(norm_seq, 2) = 'GT' AND right(norm_seq, 2) = 'AG' AND length(norm_seq) >= 8 THEN substring(norm_seq, length(norm_seq) - 5, 4) END AS a4
  FROM best JOIN norm USING (doc_id) JOIN strand_class USING (doc_id) WHERE telo_coverage >= 0.85),
ds AS (SELECT genome, d4, row_number() OVER (PARTITION BY genome ORDER BY count(*) DESC, d4) AS r FROM b WHERE d4 IS NOT NULL GROUP BY genome, d4),
acs AS (SELECT genome, a4, row_number() OVER (PARTITION BY genome ORDER BY count(*) DESC, a4) AS r FROM b WHERE a4 IS NOT NULL GROUP BY genome, a4)"""


@check("q01_genome_survey", with_ctes("best", "norm", "strand_class", extra=_BOUND, body="""
SELECT t.genome, n_total, n_gt_ag, d4 AS top_donor, a4 AS top_acceptor FROM (
  SELECT genome, count(*) AS n_total, count(*) FILTER (left(norm_seq, 2) = 'GT' AND right(norm_seq, 2) = 'AG') AS n_gt_ag FROM b GROUP BY genome) t
LEFT JOIN ds ON ds.genome = t.genome AND ds.r = 1 LEFT JOIN acs ON acs.genome = t.genome AND acs.r = 1"""))
def q01g(spark, sf):
    return P.genome_survey(P.screen(V.seqs(spark, sf))).select("genome", "n_total", "n_gt_ag", "top_donor", "top_acceptor")


_RESCREEN = """rcov AS (SELECT l.doc_id, f.family, f.rnk, CASE WHEN n >= 4 THEN coalesce(b, 0) / n ELSE 0.0 END AS cov
  FROM lens l CROSS JOIN (SELECT DISTINCT family, rnk FROM rescreen) f
  LEFT JOIN (SELECT doc_id, family, CAST(sum(e - s) AS DOUBLE) AS b FROM rescreen_runs GROUP BY ALL) r ON r.doc_id = l.doc_id AND r.family = f.family),
rbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cov DESC, rnk) AS r FROM rcov) WHERE r = 1 AND cov >= 0.85),
rfrac AS (SELECT doc_id, any_value(cov) AS cov, any_value(family) AS family, CAST(sum(CASE WHEN strand = 'fwd' THEN c ELSE 0 END) AS BIGINT) AS f, CAST(sum(c) AS BIGINT) AS t FROM (
  SELECT b.doc_id, b.cov, b.family, m.strand, (length(seq) - length(replace(seq, m.kmer, ''))) // m.k AS c FROM rbest b JOIN seqs q ON q.doc_id = b.doc_id JOIN rescreen m ON m.family = b.family) GROUP BY doc_id)"""


@check("q05_rescreen", with_ctes("seqs", "lens", "rescreen", "rescreen_runs", extra=_RESCREEN, body="""
SELECT doc_id, family AS repeat_type, round(cov, 6) AS telo_coverage, round(CASE WHEN t = 0 THEN 0.5 ELSE f / t END, 6) AS fwd_frac,
  CASE WHEN t = 0 THEN 'unknown' WHEN f / t > 0.7 THEN 'coding-strand' WHEN f / t < 0.3 THEN 'template-strand' ELSE 'converging' END AS orientation FROM rfrac"""))
def q05(spark, sf):
    return P.rescreen(V.seqs(spark, sf)).select(
        "doc_id", "repeat_type", F.round("telo_coverage", 6).alias("telo_coverage"), F.round("fwd_frac", 6).alias("fwd_frac"), "orientation")


_VCOV = _VCF + """,
ins AS (SELECT id AS doc_id, s AS seq FROM (SELECT id, CASE kind WHEN 0 THEN CASE WHEN seq <> '' THEN seq END WHEN 1 THEN CASE WHEN length(alt) > 31 THEN substring(alt, 2) END
  WHEN 2 THEN CASE WHEN length(alt) > 31 THEN substring(alt, 2) END END AS s FROM vcf) WHERE length(s) >= 30),
vk AS (SELECT doc_id, i AS pos, substring(seq, CAST(i AS BIGINT) + 1, 6) AS w FROM ins, unnest(range(length(seq) - 5)) r(i)),
vhits AS (SELECT DISTINCT doc_id, pos, 6 AS k FROM vk JOIN tta ON w = kmer), """ + V._runs("vruns", "vhits", "doc_id", 1) + """,
vcov AS (SELECT t.*, coalesce(b, 0) / length(seq) AS cov FROM ins t LEFT JOIN (SELECT doc_id, CAST(sum(e - s) AS DOUBLE) AS b FROM vruns GROUP BY doc_id) r USING (doc_id)),
vbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) AS r FROM vruns) WHERE r = 1)"""


def _insertions(spark, sf):
    return R.parse_vcf(_vcf_lines(spark, sf)).where(F.col("ins_seq").isNotNull())


@check("q04_p24_insertion_scan", with_ctes("turns", "tta", extra=_VCOV, body="""
SELECT c.doc_id AS pos, length(seq) AS ins_length, round(cov, 4) AS telo_coverage, e - s AS longest_run, s AS run_start, e AS run_end, left(seq, 100) AS seq_preview,
  CASE WHEN cov >= 0.5 THEN left(seq, 4) END AS first_4bp FROM vcov c LEFT JOIN vbest b ON b.doc_id = c.doc_id WHERE cov >= 0.1"""))
def q04(spark, sf):
    return P.scan_insertions(_insertions(spark, sf)).select(
        "pos", "ins_length", F.round("telo_coverage", 4).alias("telo_coverage"), "longest_run", "run_start", "run_end",
        "seq_preview", "first_4bp")


@check("q04_insertion_thresholds", with_ctes("turns", "tta", extra=_VCOV, body="""
SELECT count(*) AS n_total, count(*) FILTER (cov >= 0.1) AS ge_10, count(*) FILTER (cov >= 0.3) AS ge_30, count(*) FILTER (cov >= 0.5) AS ge_50,
  count(*) FILTER (cov >= 0.7) AS ge_70, count(*) FILTER (cov >= 0.85) AS ge_85, count(*) FILTER (cov >= 0.95) AS ge_95 FROM vcov"""))
def q04t(spark, sf):
    return P.insertion_thresholds(_insertions(spark, sf))


@check("q04_s06_contig_scan", with_ctes("seqs", "tta_cov", "tta_runs", "strand_class", body="""
SELECT doc_id, length(seq) AS ins_length, round(cov, 4) AS telo_coverage, e - s AS longest_run, orientation FROM seqs JOIN tta_cov USING (doc_id) JOIN strand_class USING (doc_id)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) AS r FROM tta_runs) t USING (doc_id) WHERE (t.r = 1 OR t.r IS NULL) AND length(seq) >= 30 AND cov >= 0.10"""))
def q04c(spark, sf):
    return P.scan_contigs(V.seqs(spark, sf)).select(
        "doc_id", "ins_length", F.round("telo_coverage", 4).alias("telo_coverage"), "longest_run", "orientation")


_KINDS = f"""fam AS (SELECT u AS family, i AS rnk, strand, substring(b || b, CAST(j AS BIGINT) + 1, k) AS kmer, k FROM (
  SELECT u, i, k, 'fwd' AS strand, u AS b FROM units UNION ALL SELECT u, i, k, 'rev', {RC.format('u')} FROM units), unnest(range(k)) r(j)),
kinds AS (SELECT consensus, period, family || CASE WHEN h = 0 THEN '' ELSE '~1mm' END AS family, strand, h = 0 AS exact FROM (
  SELECT d.consensus, d.k AS period, family, strand, hamming(d.consensus, kmer) AS h, row_number() OVER (PARTITION BY d.consensus, d.k ORDER BY hamming(d.consensus, kmer), rnk, strand) AS r
  FROM (SELECT DISTINCT consensus, k FROM finder) d JOIN fam ON fam.k = d.k AND length(d.consensus) = fam.k WHERE hamming(d.consensus, kmer) <= 1) WHERE r = 1)"""


@check("m26_consensus_family", f"WITH {FINDER}, {_KINDS} SELECT * FROM kinds")
def m26(spark, sf):
    hits = R.parse_repeat_finder(finder_lines(spark, sf)).select("consensus", "period").distinct()
    return P.with_consensus_family(hits).where(F.col("kind").isNotNull()).select("consensus", "period", "kind.*")


@check("q02_g08_j10_repeat_finder_survey", f"WITH {FINDER}, {_KINDS}, " + """
told AS (SELECT f.*, x.family, x.strand FROM finder f LEFT JOIN kinds x ON x.consensus = f.consensus AND x.period = f.k),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY b - a DESC, a, k, consensus DESC) AS r FROM told) WHERE r = 1 AND family IS NOT NULL),
agg AS (SELECT seq_id, count(DISTINCT strand) AS n_strands, count(*) AS n_hits FROM told GROUP BY seq_id)
SELECT CAST(t.seq_id AS VARCHAR) AS seq_id, family AS repeat_type, k AS period, n_hits, CASE WHEN n_strands >= 2 THEN 'converging' WHEN strand = 'fwd' THEN 'coding-strand' ELSE 'template-strand' END AS orientation,
  round((b - a) / 200, 4) AS tr_coverage FROM top t JOIN agg USING (seq_id) JOIN orders ON o_orderkey = seq_id""")
def q02(spark, sf):
    introns = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("seq_id"), F.lit(200).alias("length"))
    return P.repeat_finder_survey(introns, R.parse_repeat_finder(finder_lines(spark, sf))).select(
        "seq_id", "repeat_type", "period", "n_hits", "orientation", "tr_coverage")


@check("q02_finder_survey", with_ctes("introns", extra=f"{FINDER}, {_KINDS}" + """,
picked AS (SELECT contig, s, e, min(parent) AS parent FROM introns WHERE length BETWEEN 20 AND 100000 GROUP BY contig, s, e),
near AS (SELECT contig, s, e, f.* FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY s, e, contig) AS r FROM picked) JOIN finder f ON f.seq_id = parent WHERE r = 1),
told AS (SELECT n.*, x.family, x.strand FROM near n LEFT JOIN kinds x ON x.consensus = n.consensus AND x.period = n.k),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig, s, e ORDER BY b - a DESC, a, k, consensus DESC) AS r FROM told) WHERE r = 1 AND family IS NOT NULL),
agg AS (SELECT contig, s, e, count(DISTINCT strand) AS n_strands, count(*) AS n_hits FROM told GROUP BY contig, s, e)""", body="""
SELECT t.contig, t.s AS start, t.e AS "end", t.e - t.s AS length, seq_id AS mrna, family AS repeat_type, k AS period, n_hits,
  CASE WHEN n_strands >= 2 THEN 'converging' WHEN strand = 'fwd' THEN 'coding-strand' ELSE 'template-strand' END AS orientation, round((b - a) / (t.e - t.s), 4) AS tr_coverage
FROM top t JOIN agg ON agg.contig = t.contig AND agg.s = t.s AND agg.e = t.e"""))
def q02f(spark, sf):
    f = V.features(spark, sf)
    # Hits are named by an order; the order's first intron, of those that appear under its name, gets them.
    gaps = I.introns(f).where(F.col("length").between(I.INTRON_MIN, I.INTRON_MAX))
    single = I.first_per_interval(gaps, ["contig", "start", "end"], ["parent"])
    first = single.groupBy(F.col("parent").cast("string").alias("seq_id")).agg(
        F.min(F.struct("start", "end", "contig")).alias("i"))
    hits = R.parse_repeat_finder(finder_lines(spark, sf)).join(first, "seq_id").withColumn(
        "seq_id", F.concat_ws("|", *[F.col(f"i.{c}").cast("string") for c in ("contig", "start", "end")])).drop("i")
    return P.finder_survey(f, hits).select(
        "contig", "start", "end", "length", "mrna", "repeat_type", "period", "n_hits", "orientation", "tr_coverage")


_VALID = """v AS (SELECT n.doc_id, genome AS species, seq, donor, acceptor, norm_seq, b.telo_coverage, orientation, f, r,
    coalesce(len, 0) / greatest(length(seq), 1) AS run_share, count(*) OVER (PARTITION BY genome, seq) AS copies
  FROM norm n JOIN best b ON b.doc_id = n.doc_id JOIN strand_class c ON c.doc_id = n.doc_id
  LEFT JOIN (SELECT doc_id, max(e - s) AS len FROM tta_runs GROUP BY doc_id) t ON t.doc_id = n.doc_id WHERE length(seq) > 0),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN telo_coverage < 0.85 THEN 'LOW_PURITY' END,
    CASE WHEN NOT ((donor = 'GT' AND acceptor = 'AG') OR (donor = 'CT' AND acceptor = 'AC')) THEN 'NON_CANONICAL_SPLICE' END,
    CASE WHEN length(seq) < 30 THEN 'TOO_SHORT' END, CASE WHEN run_share < 0.5 THEN 'SCATTERED_HEXAMERS' END], lambda x: x IS NOT NULL), ',') AS reasons FROM v)"""


def _validated(spark, sf):
    rows = A.with_strand_class(A.with_best_family(V.seqs(spark, sf))).select(
        "doc_id", F.col("genome").alias("species"), "seq", "telo_coverage", "orientation",
        F.length("seq").alias("length"), S.first(seq_col(), 2).alias("donor"), S.last(seq_col(), 2).alias("acceptor"),
        (F.col("doc_id") % 7).alias("contig"), (F.col("doc_id") * 100).alias("start"),
        (F.col("doc_id") * 100 + F.length("seq")).alias("end"))
    return C.validate(rows, ids=["doc_id"])


@check("q06_validation", with_ctes("norm", "best", "strand_class", "tta_runs", extra=_VALID, body="""
SELECT doc_id, reasons, copies, reasons = '' AS validated, CASE WHEN f + r = 0 THEN 'unknown' WHEN f > r THEN 'TTAGGG' ELSE 'CCCTAA' END AS repeat_unit, left(seq, 80) AS seq_preview,
  copies > 1 AS duplicate, doc_id * 100 + length(seq) < 5000 AND doc_id * 100 < 1000 AS near_start FROM w"""))
def q06(spark, sf):
    flag = lambda text: F.exists("artifact_flags", lambda f: f.startswith(text))
    return _validated(spark, sf).select(
        "doc_id", F.array_join("reject_reasons", ",").alias("reasons"), "copies", "validated", "repeat_unit", "seq_preview",
        flag("DUPLICATE").alias("duplicate"), flag("NEAR").alias("near_start"))


@check("q06_g04_species_summary", with_ctes("norm", "best", "strand_class", "tta_runs", extra=_VALID, body="""
SELECT * FROM (SELECT species, count(*) FILTER (reasons = '') AS n_validated, count(*) FILTER (reasons <> '') AS n_rejected, count(*) AS n_total,
  count(*) FILTER (reasons = '' AND orientation = 'template-strand') AS n_template, count(*) FILTER (reasons = '' AND orientation = 'coding-strand') AS n_coding,
  count(DISTINCT doc_id % 7) FILTER (reasons = '') AS n_contigs, round(avg(length(seq)) FILTER (reasons = ''), 1) AS mean_length,
  round(avg(telo_coverage) FILTER (reasons = ''), 4) AS mean_purity, count(DISTINCT doc_id % 7) FILTER (reasons = '') < count(*) FILTER (reasons = '') / 3 AS clustered FROM w GROUP BY species)
WHERE n_validated > 0"""))
def q06s(spark, sf):
    return C.species_summary(_validated(spark, sf)).select(
        "species", "n_validated", "n_rejected", "n_total", "n_template", "n_coding", "n_contigs", "mean_length", "mean_purity", "clustered")


_MIS = """cand AS (SELECT DISTINCT contig, s, e FROM introns WHERE length >= 20),
ranked AS (SELECT contig, parent, ps, pe, s, e, n_exons - 1 AS n_introns FROM (
  SELECT contig, parent, s, e, count(*) OVER (PARTITION BY contig, parent) AS n_exons, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM (SELECT DISTINCT contig, parent, s, e FROM features)
  WINDOW w AS (PARTITION BY contig, parent ORDER BY s, e)) WHERE pe IS NOT NULL),
gs AS MATERIALIZED (SELECT * FROM (SELECT c.contig, c.s AS cs, c.e AS ce, parent, ps, pe, r.s AS ns, r.e AS ne, n_introns, row_number() OVER (PARTITION BY c.contig, c.s, c.e ORDER BY parent DESC, pe DESC, r.s DESC) AS k
  FROM (SELECT *, unnest(range(s - 2, s + 3)) AS near FROM cand) c JOIN ranked r ON r.contig = c.contig AND r.pe = near AND abs(r.s - c.e) <= 2) WHERE k = 1),
f AS MATERIALIZED (SELECT c.contig, c.s, c.e, parent, n_introns, pe - ps AS pl, ne - ns AS nl, l.n, left(wd.word, 2) AS d, left(wa.word, 2) AS a, c.s >= 2 AND c.e + 2 <= l.n AS inside
  FROM cand c JOIN lens l ON l.doc_id = c.contig LEFT JOIN words wd ON wd.doc_id = c.contig AND wd.pos = c.s LEFT JOIN words wa ON wa.doc_id = c.contig AND wa.pos = c.e - 2 LEFT JOIN gs ON gs.contig = c.contig AND gs.cs = c.s AND gs.ce = c.e),
sides AS (SELECT contig, cs, ce, 'prev' AS side, ps AS xs, pe AS xe FROM gs UNION ALL SELECT contig, cs, ce, 'next', ns, ne FROM gs),
hp AS MATERIALIZED (SELECT DISTINCT doc_id, pos FROM tta_hits),
places AS MATERIALIZED (SELECT contig, cs, ce, side, xs, xe, unnest(range(xs, xe - 5)) AS at FROM sides),
inexon AS MATERIALIZED (SELECT contig, cs, ce, side, xs, xe, pos FROM places JOIN hp ON hp.doc_id = places.contig AND hp.pos = places.at),
side_cov AS MATERIALIZED (SELECT contig, cs, ce, side, count(DISTINCT pos + d) / any_value(least(xe, n) - xs) AS cov FROM (SELECT *, unnest(range(6)) AS d FROM inexon) JOIN lens ON doc_id = contig GROUP BY contig, cs, ce, side),
telo AS MATERIALIZED (SELECT contig, cs, ce, max(CASE WHEN side = 'prev' THEN cov END) AS p, max(CASE WHEN side = 'next' THEN cov END) AS x FROM side_cov GROUP BY contig, cs, ce)"""


@check("q07_misannotation_filter", with_ctes("introns", "features", "lens", "tta_hits", extra=_MIS, body="""
SELECT f.contig, s AS start, e AS "end", parent, array_to_string(list_filter([CASE WHEN NOT inside THEN 'NEAR_CONTIG_BOUNDARY' END,
  CASE WHEN inside AND NOT ((d = 'GT' AND a = 'AG') OR (d = 'CT' AND a = 'AC')) THEN 'BAD_GENOMIC_SPLICE' END, CASE WHEN pl < 20 THEN 'TINY_PREV_EXON(' || pl || 'bp)' END, CASE WHEN nl < 20 THEN 'TINY_NEXT_EXON(' || nl || 'bp)' END,
  CASE WHEN n_introns = 1 AND pl < 50 AND nl < 50 THEN 'SINGLE_INTRON_TINY_EXONS' END, CASE WHEN t.p > 0.30 THEN 'TELO_IN_PREV_EXON' END,
  CASE WHEN t.x > 0.30 THEN 'TELO_IN_NEXT_EXON' END, CASE WHEN n_introns IS NULL THEN 'NO_GENE_STRUCTURE_FOUND' END], lambda x: x IS NOT NULL), ',') AS flags, round(coalesce(t.p, 0), 3) AS prev_exon_telo, round(coalesce(t.x, 0), 3) AS next_exon_telo
FROM f LEFT JOIN telo t ON t.contig = f.contig AND t.cs = f.s AND t.ce = f.e"""))
def q07(spark, sf):
    f = V.features(spark, sf)
    i = I.introns(f).where(F.col("length") >= 20).select("contig", "start", "end").distinct()
    transcripts = f.select(F.col("parent").alias("transcript_id"), F.col("parent").alias("gene_id")).distinct()
    genes = transcripts.select("gene_id", F.lit("g").alias("gene_name"), F.lit("protein_coding").alias("gene_biotype")).distinct()
    contigs = V.stored_contigs(spark, sf)
    out = C.misannotation_filter(
        i, f.select("contig", "parent", "start", "end"), transcripts, genes, Q.chunk(contigs, size=1024),
        contigs.select("contig", "contig_len"), 1024)
    share = lambda side: F.coalesce(f"{side}_exon_telo", F.lit(0.0)).alias(f"{side}_exon_telo")
    return out.select(
        "contig", "start", "end", "parent", F.array_join("flags", ",").alias("flags"), share("prev"), share("next"))


_SITES = """tsd AS (SELECT doc_id, coalesce(list_max(list_filter(range(3, 26), lambda l: l <= length(lf) AND l <= length(rf) AND right(lf, l) = left(rf, l))), 0) AS tsd_len FROM flanks)"""


@check("q08_mechanism_battery", with_ctes("seqs", "flanks", "lens", "words", "tta", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.05) + ", " + _NEAR + ", " + _SITES, body="""
SELECT o.doc_id, o.family, classification, o.fwd_bp, o.rev_bp, linker_len, tsd_len,
  CASE WHEN o.family = 'TTAGGG' THEN round(c / greatest(n - 5, 1), 6) END AS canonical_frac, CASE WHEN o.family = 'TTAGGG' THEN round(v / greatest(n - 5, 1), 6) END AS variant_frac
FROM oriented o JOIN tsd ON tsd.doc_id = o.doc_id LEFT JOIN (SELECT doc_id, sum(canon) AS c, sum(variant) AS v FROM windows GROUP BY doc_id) x ON x.doc_id = o.doc_id WHERE o.family IS NOT NULL"""))
def q08(spark, sf):
    return _rounded(_battery(spark, sf).select(
        "doc_id", "family", "classification", "fwd_bp", "rev_bp", "linker_len", "tsd_len", "canonical_frac", "variant_frac"))


def _battery(spark, sf):
    records = V.seqs(spark, sf).drop("unit").join(V.flanks(spark, sf).drop("family"), "doc_id")
    return B.battery(records)


@check("q08_class_statistics", with_ctes("flanks", "lens", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.05) + ", " + _SITES, body="""
SELECT classification, count(*) AS n, min(linker_len) AS linker_min, max(linker_len) AS linker_max, list_sort(list(linker_len))[count(*) // 2 + 1] AS linker_median,
  count(*) FILTER (linker_len BETWEEN 5 AND 30) AS linker_5_30, count(*) FILTER (linker_len > 30 AND linker_len <= 120) AS linker_30_120, count(*) FILTER (linker_len > 120) AS linker_120_up,
  count(*) FILTER (tsd_len >= 3) AS n_tsd, round(avg(tsd_len) FILTER (tsd_len >= 3), 6) AS tsd_mean
FROM oriented JOIN tsd USING (doc_id) WHERE family IS NOT NULL GROUP BY classification"""))
def q08s(spark, sf):
    return _rounded(B.class_statistics(_battery(spark, sf)).select(
        "classification", "n", "linker_min", "linker_max", "linker_median", "linker_5_30", "linker_30_120", "linker_120_up", "n_tsd", "tsd_mean"))


_LINEAGE = """k AS (SELECT o.*, lang, CASE WHEN two AND gap > 0 THEN substring(seq, CAST(gs AS BIGINT) + 1, CAST(gap AS BIGINT)) ELSE '' END AS linker FROM oriented o JOIN seqs q ON q.doc_id = o.doc_id WHERE family IS NOT NULL),
z AS (SELECT *, classification LIKE '%WITHLINKER' AS linked, (SELECT CAST(sum((length(linker) - length(replace(linker, kmer, ''))) // 6) AS BIGINT) FROM tta) AS c, length(linker) // 2 AS h FROM k)"""


@check("q12_lineage_comparison", with_ctes("seqs", "tta", "lens", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.0) + ", " + _LINEAGE, body=f"""
SELECT lang AS dataset, count(*) AS n, count(*) FILTER (classification LIKE 'CONV%') AS n_converging, count(*) FILTER (classification LIKE 'DIV%') AS n_diverging,
  round(count(*) FILTER (classification LIKE 'CONV%') / nullif(count(*) FILTER (classification LIKE 'DIV%'), 0), 6) AS ratio, count(*) FILTER (linked) AS n_linked, count(*) FILTER (linked AND c = 0) AS n_pure,
  count(*) FILTER (linked AND linker_len >= 5 AND linker_len < 30) AS short, count(*) FILTER (linked AND linker_len >= 30 AND linker_len < 120) AS medium, count(*) FILTER (linked AND linker_len >= 120) AS long,
  round(avg(length(regexp_replace(linker, '[^GC]', '', 'g')) / length(linker)) FILTER (linked), 6) AS linker_gc,
  count(*) FILTER (linked AND linker_len >= 30 AND CASE WHEN h > 0 THEN (h - hamming(left(linker, h), {RC.format('right(linker, h)')})) / h END >= 0.7) AS n_palindromic FROM z GROUP BY lang"""))
def q12(spark, sf):
    return _rounded(B.lineage_comparison(V.seqs(spark, sf).drop("unit").withColumnRenamed("lang", "dataset")))


_ORIGINS = """h AS (SELECT l_orderkey % 5 AS acc, l_partkey % 50 AS sc, l_suppkey % 50 AS hc, l_partkey * 10 AS ss, l_partkey * 10 + 100 AS se,
  l_suppkey * 60 AS hs, l_suppkey * 60 + CAST(l_quantity AS BIGINT) AS he FROM lineitem WHERE (CAST(l_quantity AS BIGINT) + 10) / 60 >= 0.8),
good AS (SELECT DISTINCT * FROM h WHERE NOT (sc = hc AND hs <= se + 200 AND he >= ss - 200)),
known AS (SELECT DISTINCT o_orderkey % 5 AS acc, o_custkey % 50 AS contig, o_custkey * 10 AS s, o_custkey * 10 + 300 AS e FROM orders),
src AS (SELECT acc, sc, ss, se, s AS a_s, e AS a_e FROM (SELECT g.acc, sc, ss, se, s, e, row_number() OVER (PARTITION BY g.acc, sc, ss, se ORDER BY s, e) AS r
  FROM (SELECT DISTINCT acc, sc, ss, se FROM good) g JOIN known k ON k.acc = g.acc AND k.contig = sc AND s <= ss AND e >= se) WHERE r = 1),
dst AS (SELECT acc, hc, hs, he, s AS b_s, e AS b_e FROM (SELECT g.acc, hc, hs, he, s, e, row_number() OVER (PARTITION BY g.acc, hc, hs, he ORDER BY s, e) AS r
  FROM (SELECT DISTINCT acc, hc, hs, he FROM good) g JOIN known k ON k.acc = g.acc AND k.contig = hc AND hs >= s - 50 AND he <= e + 50) WHERE r = 1),
j AS (SELECT g.*, [g.acc, g.sc, a_s, a_e] AS a, CASE WHEN b_s IS NOT NULL THEN [g.acc, g.hc, b_s, b_e] END AS b FROM good g JOIN src ON src.acc = g.acc AND src.sc = g.sc AND src.ss = g.ss AND src.se = g.se
  LEFT JOIN dst ON dst.acc = g.acc AND dst.hc = g.hc AND dst.hs = g.hs AND dst.he = g.he),
m AS (SELECT 'shared' AS type, least(a, b) AS ka, greatest(a, b) AS kb, a AS member FROM j WHERE b IS NOT NULL UNION SELECT 'shared', least(a, b), greatest(a, b), b FROM j WHERE b IS NOT NULL
  UNION SELECT 'locus', [acc, hc, hs // 1000 * 1000, he // 1000 * 1000 + 1000], NULL, a FROM j WHERE b IS NULL)"""


@check("q10_g13_linker_groups", f"WITH {_ORIGINS} " + """
SELECT type, array_to_string(ka, '|') AS key_a, array_to_string(kb, '|') AS key_b, count(*) AS n_members FROM m GROUP BY ALL""")
def q10(spark, sf):
    hits = V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("acc"), (F.col("l_partkey") % 50).alias("src_contig"),
        (F.col("l_suppkey") % 50).alias("hit_contig"), (F.col("l_partkey") * 10).alias("src_start"),
        (F.col("l_partkey") * 10 + 100).alias("src_end"), (F.col("l_suppkey") * 60).alias("hit_start"),
        (F.col("l_suppkey") * 60 + F.col("l_quantity").cast("long")).alias("hit_end"),
        ((F.col("l_quantity").cast("long") + 10) / 60).alias("qcov"), F.lit(90.0).alias("pident"))
    known = V.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 5).alias("acc"), (F.col("o_custkey") % 50).alias("contig"),
        (F.col("o_custkey") * 10).alias("o_start"), (F.col("o_custkey") * 10 + 300).alias("o_end")).distinct()
    g = L.origin_group_sizes(L.linker_origins(hits, known))
    text = lambda k: F.when(F.col(k).isNotNull(), F.concat_ws("|", *[F.col(f"{k}.{c}").cast("string") for c in ("acc", "contig", "start", "end")]))
    return g.select("type", text("key_a").alias("key_a"), text("key_b").alias("key_b"), "n_members")


_COMP = _MERGED.replace("merged AS", "cds AS").replace("FROM features))", "FROM features WHERE ftype = 'CDS'))") + """,
px AS (SELECT DISTINCT contig, parent, s, e FROM (SELECT *, max(CASE WHEN ftype = 'exon' THEN 1 ELSE 0 END) OVER (PARTITION BY contig, parent) AS has FROM features) WHERE ftype = 'exon' OR has = 0),
xi AS (SELECT contig, pe AS s, s AS e FROM (SELECT contig, s, lag(e) OVER (PARTITION BY contig, parent ORDER BY s, e) AS pe FROM px) WHERE pe < s),
gene AS (SELECT contig, min(s) AS s, max(e) AS e FROM features GROUP BY contig, parent),
occ AS (SELECT * FROM gene UNION ALL SELECT * FROM xi), """ + _MERGED.replace("merged AS", "mi AS").replace("FROM features))", "FROM xi))") + ", " + _MERGED.replace("merged AS", "mo AS").replace("FROM features))", "FROM occ))") + """,
clens AS (SELECT doc_id AS contig, CAST(length(seq) AS BIGINT) AS n FROM seqs),
free AS (SELECT m.contig, coalesce(lag(e) OVER (PARTITION BY m.contig ORDER BY s), 0) AS s, s AS e FROM mo m UNION ALL SELECT contig, max(e), any_value(n) FROM mo JOIN clens USING (contig) GROUP BY contig),
comp AS (SELECT 'cds' AS compartment, contig, s, e FROM cds UNION ALL SELECT 'intron', contig, s, e FROM mi UNION ALL SELECT 'intergenic', contig, s, e FROM free),
piece AS (SELECT row_number() OVER () AS doc_id, compartment, genome, substring(seq, s + 1, least(e, length(seq)) - s) AS seq FROM comp JOIN seqs ON seqs.doc_id = comp.contig WHERE s < least(e, length(seq))),
pk AS (SELECT doc_id, base + j AS pos, substring(t, CAST(j AS BIGINT) + 1, 6) AS w FROM (SELECT doc_id, n, base, substring(seq, CAST(base AS BIGINT) + 1, 1005) AS t FROM (SELECT *, length(seq) AS n, unnest(range(0, length(seq), 1000)) AS base FROM piece)), unnest(range(1000)) r(j) WHERE base + j < n),
ps AS (SELECT doc_id, pos, hit, sum(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS inside FROM (SELECT doc_id, pos, CASE WHEN kmer IS NULL THEN 0 ELSE 1 END AS hit FROM pk LEFT JOIN tta ON w = kmer)),
pd AS (SELECT p.doc_id, compartment, genome, length(seq) AS bp, sum(hit) AS h, count(*) FILTER (inside >= 2 AND pos + 200 <= length(seq)) AS d FROM piece p JOIN ps USING (doc_id) GROUP BY ALL)"""


@check("q11_compartment_density", with_ctes("features", "seqs", "tta", extra=_COMP, body="""
SELECT genome, compartment, CAST(sum(bp) AS BIGINT) AS bp, CAST(sum(CASE WHEN bp >= 200 THEN h ELSE 0 END) AS BIGINT) AS telo_kmers, CAST(sum(CASE WHEN bp >= 200 THEN d ELSE 0 END) AS BIGINT) AS telo_windows,
  CAST(sum(greatest(bp - 199, 0)) AS BIGINT) AS total_windows FROM pd GROUP BY ALL"""))
def q11(spark, sf):
    return _density(spark, sf)


def _density(spark, sf):
    f = V.features(spark, sf)
    genes = f.groupBy("contig", "parent").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    contigs = V.stored_contigs(spark, sf)
    parts = D.compartments(f, genes, contigs.select("contig", "contig_len"))
    named = parts.join(contigs.select("contig", "genome"), "contig")
    return D.compartment_density(named, Q.chunk(contigs, size=1024), ["genome"])


@check("q11_g14_density_ratios", with_ctes("features", "seqs", "tta", extra=_COMP + """,
den AS (SELECT genome, compartment, sum(CASE WHEN bp >= 200 THEN h ELSE 0 END) * 1e6 / sum(bp) AS d FROM pd GROUP BY ALL)""", body="""
SELECT genome, round(max(d) FILTER (compartment = 'cds'), 3) AS cds, round(max(d) FILTER (compartment = 'intron'), 3) AS intron, round(max(d) FILTER (compartment = 'intergenic'), 3) AS intergenic,
  round(max(d) FILTER (compartment = 'intron') / nullif(max(d) FILTER (compartment = 'intergenic'), 0), 6) AS intron_to_intergenic FROM den GROUP BY genome"""))
def q11r(spark, sf):
    r = D.density_ratios(_density(spark, sf), ["genome"])
    return r.select("genome", *[F.round(c, 3).alias(c) for c in ("cds", "intron", "intergenic")],
                    F.round("intron_to_intergenic", 6).alias("intron_to_intergenic"))


@check("q09_purity_by_class", with_ctes("seqs", "tta", "lens", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.05) + ", " + _LINEAGE, body="""
SELECT classification, CASE WHEN h2 >= 15 AND h2 < 30 THEN 'short' WHEN h2 >= 30 AND h2 < 120 THEN 'medium' WHEN h2 >= 120 THEN 'long' END AS bucket, count(*) AS n_linkers,
  count(*) FILTER (c = 0) AS n_pure, count(*) FILTER (c > 0) AS n_contaminated FROM (SELECT *, length(linker) AS h2 FROM z) WHERE linked AND h2 >= 15 GROUP BY ALL"""))
def q09(spark, sf):
    told = A.with_orientation(A.with_strand_runs(V.seqs(spark, sf).drop("unit"))).where(
        F.col("classification").endswith("_WITHLINKER"))
    linkers = told.select("doc_id", "classification", F.col("linker").alias("seq")).where(F.length("seq") >= 15)
    return L.purity_mix(linkers, ["classification"]).select("classification", "bucket", "n_linkers", "n_pure", "n_contaminated")


@check("q14_origin_context", with_ctes("turns", "introns", "features", "seqs", extra=f"""pr AS (
  SELECT id, seq AS t, conv_id % (SELECT count(*) FROM documents) AS contig, (id * 7) % 1500 AS os, p_partkey, q FROM turns JOIN (SELECT p_partkey, {V._dna_sql('p_name')} AS q FROM part) ON p_partkey = conv_id),
tr AS (SELECT pr.*, o, 0 AS st, length(q) - hamming(q, substring(t, CAST(o AS BIGINT) + 1, length(q))) AS m FROM pr, unnest(range(length(t) - length(q) + 1)) r(o) WHERE length(q) > 0
  UNION ALL SELECT pr.*, o, 1, length(q) - hamming({RC.format('q')}, substring(t, CAST(o AS BIGINT) + 1, length(q))) FROM pr, unnest(range(length(t) - length(q) + 1)) r(o) WHERE length(q) > 0),
bp AS (SELECT *, os + o AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id, p_partkey ORDER BY m DESC, st, o) AS r FROM tr) WHERE r = 1)""", body="""
SELECT id, p_partkey, pos, CASE WHEN EXISTS (SELECT 1 FROM introns i WHERE i.contig = b.contig AND i.s <= pos AND pos < i.e) THEN 'in_intron'
  WHEN EXISTS (SELECT 1 FROM features f WHERE f.contig = b.contig AND f.s <= pos AND pos < f.e) THEN 'in_exon' ELSE 'intergenic' END AS place, least(pos, length(seq) - (pos + length(q))) AS end_distance
FROM bp b JOIN seqs s ON s.doc_id = b.contig"""))
def q14(spark, sf):
    parts = V.table(spark, sf, "part").select("p_partkey", V.dna_of(F.col("p_name")).alias("query"))
    members = V.turns(spark, sf).join(parts, F.col("conv_id") == F.col("p_partkey")).select(
        "id", "p_partkey", "query", F.col("seq").alias("target"), (F.col("conv_id") % V.n_docs(spark, sf)).alias("contig"),
        ((F.col("id") * 7) % 1500).alias("origin_start"))
    f = I.on_keys_of(V.features(spark, sf), members)
    i = stored(I.introns(f), "introns")
    none = i.where(F.col("length") < 0).withColumn("name", F.col("start"))
    out = L.origin_context(
        members, none, i.withColumn("gene", F.col("parent")), f.withColumn("gene", F.col("parent")), _lengths(spark, sf))
    return out.select("id", "p_partkey", "pos", "place", "end_distance")


@check("q13_terminal_table", with_ctes("seqs", extra=_SIDES, body="""
SELECT doc_id, side, length(t) AS text_len, length(regexp_extract_all(t, 'CT[ACG][CT]')) AS n_branch, length(regexp_extract_all(t, '[CT]{4,}')) AS n_tracts,
  round(CASE WHEN length(t) > 0 THEN (length(t) - length(replace(t, 'A', ''))) / length(t) ELSE 0.0 END, 6) AS share_a FROM sides"""))
def q13(spark, sf):
    from repeatloom.plans.terminals import terminal_table
    return terminal_table(V.seqs(spark, sf), ["doc_id"]).select(
        "doc_id", "side", "text_len", "n_branch", "n_tracts", F.round("share_a", 6).alias("share_a"))


