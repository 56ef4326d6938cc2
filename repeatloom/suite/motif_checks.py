"""Check queries for the motif operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.operators import arrays as A
from repeatloom.operators import sequences as Q
from repeatloom.operators import summaries as G
from repeatloom.operators.durable import once
from repeatloom.suite import views as V
from repeatloom.suite.registry import check
from repeatloom.suite.views import seq_col, with_ctes

TTA_F, TTA_R, TTA = M.forward("TTAGGG"), M.backward("TTAGGG"), M.both_strands("TTAGGG")


@check("m01_motif_hits", with_ctes("tta_hits", body="""
SELECT doc_id, strand, count(*) AS n_hits, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(pos) AS BIGINT) AS pos_sum
FROM tta_hits GROUP BY doc_id, strand"""))
def m01(spark, sf):
    s = V.seqs(spark, sf).withColumn("s", F.explode(F.array(
        F.struct(F.lit("fwd").alias("strand"), M.hit_positions(seq_col(), TTA_F).alias("h")),
        F.struct(F.lit("rev").alias("strand"), M.hit_positions(seq_col(), TTA_R).alias("h")))))
    return (
        s.select("doc_id", "s.strand", F.explode("s.h").alias("pos")).groupBy("doc_id", "strand")
        .agg(F.count("*").alias("n_hits"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
             F.sum("pos").alias("pos_sum")))


@check("m01_contig_hits", with_ctes("tta_hits", body="""
SELECT doc_id AS contig, count(*) AS n_hits, CAST(sum(pos) AS BIGINT) AS pos_sum FROM tta_hits
WHERE strand = 'fwd' GROUP BY doc_id"""))
def m01_contig(spark, sf):
    return Q.contig_hits(V.contigs(spark, sf), TTA_F, size=1024).groupBy("contig").agg(
        F.count("*").alias("n_hits"), F.sum("pos").alias("pos_sum"))


@check("m02_family_coverage", with_ctes("survey_cov", body="""
SELECT doc_id, family, round(cov, 6) AS cov FROM survey_cov"""))
def m02(spark, sf):
    return V.seqs(spark, sf).select(
        "doc_id", F.explode(A.family_coverages(seq_col(), M.SURVEY_FAMILIES)).alias("c")
    ).select("doc_id", "c.family", F.round("c.cov", 6).alias("cov"))


@check("m03_threshold_counts", with_ctes("tta_cov", body="""
SELECT genome, count(*) AS n_total, count(*) FILTER (cov >= 0.1) AS ge_10, count(*) FILTER (cov >= 0.3) AS ge_30,
  count(*) FILTER (cov >= 0.5) AS ge_50, count(*) FILTER (cov >= 0.7) AS ge_70, count(*) FILTER (cov >= 0.85) AS ge_85,
  count(*) FILTER (cov >= 0.95) AS ge_95
FROM tta_cov JOIN seqs USING (doc_id) GROUP BY genome"""))
def m03(spark, sf):
    s = V.seqs(spark, sf).select("genome", M.coverage(seq_col(), TTA).alias("telo_coverage"))
    return G.threshold_counts(s, ["genome"])


@check("m04_covered_runs", with_ctes("tta_strand_runs", body="""
SELECT doc_id, strand, CAST(s AS BIGINT) AS run_start, CAST(e AS BIGINT) AS run_end FROM tta_strand_runs"""))
def m04(spark, sf):
    s = V.seqs(spark, sf).withColumn("s", F.explode(F.array(
        F.struct(F.lit("fwd").alias("strand"), M.covered_runs(seq_col(), TTA_F).alias("r")),
        F.struct(F.lit("rev").alias("strand"), M.covered_runs(seq_col(), TTA_R).alias("r")))))
    return s.select("doc_id", "s.strand", F.explode("s.r").alias("r")).select(
        "doc_id", "strand", F.col("r.start").cast("long").alias("run_start"),
        F.col("r.end").cast("long").alias("run_end"))


@check("m04_contig_runs", with_ctes("tta_runs", body="""
SELECT doc_id AS contig, CAST(s AS BIGINT) AS run_start, CAST(e AS BIGINT) AS run_end FROM tta_runs WHERE e - s >= 10"""))
def m04_contig(spark, sf):
    return Q.contig_runs(V.contigs(spark, sf), TTA, 10, size=512).select(
        "contig", F.col("start").alias("run_start"), F.col("end").alias("run_end"))


@check("m05_tandem_structure", with_ctes("lens", "tta_runs", body="""
SELECT l.doc_id, coalesce(len, 0) AS longest_run, coalesce(s, 0) AS run_start, coalesce(e, 0) AS run_end,
  round(CASE WHEN n > 0 THEN coalesce(len, 0) / n ELSE 0.0 END, 6) AS run_share, coalesce(gaps, 0) AS n_gaps
FROM lens l LEFT JOIN (
  SELECT doc_id, s, e, e - s AS len, count(*) OVER (PARTITION BY doc_id) - 1 AS gaps,
    row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) AS r FROM tta_runs) t ON t.doc_id = l.doc_id AND r = 1"""))
def m05(spark, sf):
    return A.with_tandem_structure(V.seqs(spark, sf)).select(
        "doc_id", "longest_run", "run_start", "run_end", F.round("run_share", 6).alias("run_share"), "n_gaps")


@check("m06_strand_ratio", with_ctes("strand_class", body="""
SELECT doc_id, CAST(f AS BIGINT) AS n_fwd, CAST(r AS BIGINT) AS n_rev, round(fwd_frac, 6) AS fwd_frac, orientation FROM strand_class"""))
def m06(spark, sf):
    return A.with_strand_class(V.seqs(spark, sf)).select(
        "doc_id", M.separate_count(seq_col(), TTA_F).alias("n_fwd"), M.separate_count(seq_col(), TTA_R).alias("n_rev"),
        F.round("fwd_frac", 6).alias("fwd_frac"), "orientation")


@check("m07_best_family", with_ctes("best", body="""
SELECT doc_id, round(telo_coverage, 6) AS telo_coverage, repeat_type, telo_coverage >= 0.85 AS kept FROM best"""))
def m07(spark, sf):
    return A.with_best_family(V.seqs(spark, sf)).select(
        "doc_id", F.round("telo_coverage", 6).alias("telo_coverage"), "repeat_type",
        (F.col("telo_coverage") >= 0.85).alias("kept"))


_FAMILY = """family_bp AS (
  SELECT doc_id, family, rnk, CAST(sum(e - s) AS BIGINT) AS bp,
    CAST(sum(CASE WHEN strand = 'fwd' THEN e - s ELSE 0 END) AS BIGINT) AS fwd_bp,
    CAST(sum(CASE WHEN strand = 'rev' THEN e - s ELSE 0 END) AS BIGINT) AS rev_bp FROM mechanism_runs GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bp DESC, rnk) AS r FROM family_bp) WHERE r = 1),
longest AS (SELECT doc_id, strand, s, e FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.doc_id, strand ORDER BY e - s DESC, s) AS r
  FROM mechanism_runs m JOIN chosen c ON c.doc_id = m.doc_id AND c.family = m.family) WHERE r = 1),
placed AS (
  SELECT l.doc_id, n, c.family, coalesce(fwd_bp, 0) AS fwd_bp, coalesce(rev_bp, 0) AS rev_bp,
    f.s AS fs, f.e AS fe, r.s AS rs, r.e AS re, f.s < r.s AS fwd_first,
    CASE WHEN f.s < r.s THEN f.e ELSE r.e END AS gs, CASE WHEN f.s < r.s THEN r.s ELSE f.s END AS ge
  FROM lens l LEFT JOIN chosen c ON c.doc_id = l.doc_id
  LEFT JOIN longest f ON f.doc_id = l.doc_id AND f.strand = 'fwd'
  LEFT JOIN longest r ON r.doc_id = l.doc_id AND r.strand = 'rev')"""


def _classified(share: float) -> str:
    return f"""classified AS (SELECT *, has_f AND has_r AS two, greatest(0, ge - gs) AS gap FROM (
  SELECT *, fwd_bp >= 10 AND fwd_bp / greatest(n, 1) >= {share} AS has_f, rev_bp >= 10 AND rev_bp / greatest(n, 1) >= {share} AS has_r FROM placed)),
oriented AS (SELECT *, CASE WHEN two THEN CASE WHEN fwd_first THEN 'CONVERGING' ELSE 'DIVERGING' END
    || CASE WHEN gap <= 4 THEN '_NOLINKER' ELSE '_WITHLINKER' END
  WHEN has_f THEN 'SINGLE_G' WHEN has_r THEN 'SINGLE_C' ELSE 'NONE' END AS classification,
  CASE WHEN two THEN gap ELSE 0 END AS linker_len FROM classified)"""


@check("m08_family_by_runs", with_ctes("lens", "mechanism_runs", extra=_FAMILY, body="""
SELECT doc_id, family, fwd_bp, rev_bp, coalesce(fe - fs, 0) AS fwd_run_max, coalesce(re - rs, 0) AS rev_run_max FROM placed"""))
def m08(spark, sf):
    return A.with_orientation(A.with_strand_runs(V.seqs(spark, sf))).select(
        "doc_id", "family", "fwd_bp", "rev_bp", "fwd_run_max", "rev_run_max")


@check("m09_orientation_class", with_ctes("lens", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.05), body="""
SELECT doc_id, classification, CASE WHEN two THEN gs END AS linker_start, CASE WHEN two THEN ge END AS linker_end, linker_len FROM oriented"""))
def m09(spark, sf):
    return A.with_orientation(A.with_strand_runs(V.seqs(spark, sf))).select(
        "doc_id", "classification", "linker_start", "linker_end", "linker_len")


@check("m10_orientation_any_share", with_ctes("lens", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.0), body="""
SELECT doc_id, classification, linker_len FROM oriented"""))
def m10(spark, sf):
    return A.with_orientation(A.with_strand_runs(V.seqs(spark, sf)), min_share=0.0).select(
        "doc_id", "classification", "linker_len")


@check("m11_linker_text", with_ctes("seqs", "lens", "mechanism_runs", extra=_FAMILY + ", " + _classified(0.05), body="""
SELECT doc_id, linker, linker_len, round(CASE WHEN linker_len > 0 THEN
  length(regexp_replace(linker, '[^GC]', '', 'g')) / linker_len ELSE 0.0 END, 6) AS linker_gc FROM (
  SELECT o.doc_id, linker_len, CASE WHEN two AND gap > 0 THEN substring(seq, CAST(gs AS BIGINT) + 1, CAST(gap AS BIGINT)) ELSE '' END AS linker
  FROM oriented o JOIN seqs q ON q.doc_id = o.doc_id)"""))
def m11(spark, sf):
    return A.with_orientation(A.with_strand_runs(V.seqs(spark, sf))).select(
        "doc_id", "linker", "linker_len", F.round(S.gc_share(F.col("linker")), 6).alias("linker_gc"))


_NEAR = """near AS (
  SELECT w.word6 AS word, max(CASE WHEN h = 0 THEN 1 ELSE 0 END) AS canon, max(CASE WHEN h = 1 THEN 1 ELSE 0 END) AS one FROM (
    SELECT u.word6, hamming(u.word6, m.kmer) AS h FROM (SELECT DISTINCT substring(word, 1, 6) AS word6 FROM words WHERE pos + 6 <= n) u CROSS JOIN tta m) w
  GROUP BY w.word6),
receptor AS (SELECT v FROM (VALUES ('TCAGGG'), ('TGAGGG'), ('GTAGGG'), ('TTGGGG'), ('TTCGGG'), ('CTAGGG')) r(v)
  UNION SELECT reverse(translate(v, 'ACGT', 'TGCA')) FROM (VALUES ('TCAGGG'), ('TGAGGG'), ('GTAGGG'), ('TTGGGG'), ('TTCGGG'), ('CTAGGG')) r(v)),
windows AS (SELECT doc_id, pos, canon, CASE WHEN canon = 0 THEN one ELSE 0 END AS variant,
    CASE WHEN canon = 0 AND one = 1 AND r.v IS NOT NULL THEN 1 ELSE 0 END AS tti
  FROM words w JOIN near x ON x.word = substring(w.word, 1, 6) LEFT JOIN receptor r ON r.v = x.word WHERE pos + 6 <= n)"""


@check("m12_variant_signal", with_ctes("words", "tta", "lens", extra=_NEAR, body="""
SELECT l.doc_id, greatest(n - 5, 0) AS n_windows, CAST(coalesce(c, 0) AS BIGINT) AS n_canonical,
  CAST(coalesce(v, 0) AS BIGINT) AS n_variant, CAST(coalesce(t, 0) AS BIGINT) AS n_receptor
FROM lens l LEFT JOIN (SELECT doc_id, sum(canon) AS c, sum(variant) AS v, sum(tti) AS t FROM windows GROUP BY doc_id) w ON w.doc_id = l.doc_id"""))
def m12(spark, sf):
    return A.with_variant_signal(V.seqs(spark, sf)).select(
        "doc_id", "n_windows", "n_canonical", "n_variant", "n_receptor")


_NEAR_RUNS = _NEAR + """,
near_hits AS (SELECT doc_id, pos, 6 AS k FROM windows WHERE canon + variant > 0), """ + V._runs("near_runs", "near_hits", "doc_id", 1)


@check("m13_coverage_one_mismatch", with_ctes("words", "tta", "lens", extra=_NEAR_RUNS, body="""
SELECT l.doc_id, round(CASE WHEN n > 0 THEN coalesce(b, 0) / n ELSE 0.0 END, 6) AS cov
FROM lens l LEFT JOIN (SELECT doc_id, CAST(sum(e - s) AS DOUBLE) AS b FROM near_runs GROUP BY doc_id) r ON r.doc_id = l.doc_id"""))
def m13(spark, sf):
    return V.seqs(spark, sf).select("doc_id", F.round(M.coverage_one_mismatch(seq_col(), "TTAGGG"), 6).alias("cov"))


_STRICT = """longest AS (SELECT doc_id, strand, s, e FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, strand ORDER BY e - s DESC, s) AS r FROM tta_strand_runs) WHERE r = 1),
gaps AS (SELECT f.doc_id, CASE WHEN f.s < r.s THEN f.e ELSE r.e END AS gs, CASE WHEN f.s < r.s THEN r.s ELSE f.s END AS ge
  FROM longest f JOIN longest r ON r.doc_id = f.doc_id AND f.strand = 'fwd' AND r.strand = 'rev'),
links AS (SELECT g.doc_id, gs, ge, substring(seq, CAST(gs AS BIGINT) + 1, CAST(ge - gs AS BIGINT)) AS link
  FROM gaps g JOIN seqs q ON q.doc_id = g.doc_id
  WHERE ge - gs >= 25 AND length(replace(seq, 'N', '')) >= 0.95 * length(seq)),
link_words AS (SELECT doc_id, i AS pos, substring(link, CAST(i AS BIGINT) + 1, 6) AS word FROM links, unnest(range(length(link) - 5)) r(i)),
link_near AS (SELECT DISTINCT doc_id, pos, 6 AS k FROM link_words JOIN tta ON hamming(word, kmer) <= 1),
""" + V._runs("link_runs", "link_near", "doc_id", 1) + """,
pure AS (SELECT l.*, (SELECT coalesce(sum(e - s), 0) FROM link_runs r WHERE r.doc_id = l.doc_id) AS near_bp,
  (SELECT sum((length(link) - length(replace(link, kmer, ''))) // 6) FROM tta) AS n_exact FROM links l)"""


@check("m14_m15_strict_linkers", with_ctes("seqs", "tta_strand_runs", "tta", extra=_STRICT, body="""
SELECT doc_id, gs AS linker_start, ge AS linker_end, link AS linker FROM pure
WHERE n_exact <= 1 AND near_bp / length(link) < 0.10 AND length(replace(link, 'N', '')) >= 0.95 * length(link)"""))
def m15(spark, sf):
    return A.strict_linkers(V.seqs(spark, sf).drop("unit"), "TTAGGG").select(
        "doc_id", "linker_start", "linker_end", "linker")


_MIXED = """mixed AS (SELECT DISTINCT kmer, k FROM survey WHERE family IN ('TTAGGG', 'TTTAGGG')),
mixed_hits AS (SELECT doc_id, pos, pos + 6 AS e FROM words JOIN mixed ON k = 6 AND substring(word, 1, 6) = kmer
  UNION SELECT doc_id, pos, pos + 7 FROM words JOIN mixed ON k = 7 AND substring(word, 1, 7) = kmer),
starts AS (SELECT doc_id, pos, max(e) AS e FROM mixed_hits GROUP BY ALL),
walls AS (SELECT doc_id, pos AS ge, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gs FROM starts
  UNION ALL SELECT l.doc_id, n, coalesce(max(e), 0) FROM lens l LEFT JOIN starts s ON s.doc_id = l.doc_id GROUP BY l.doc_id, n),
widest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ge - gs DESC, gs) AS r FROM walls WHERE ge > gs) WHERE r = 1)"""


@check("m16_canonical_gap", with_ctes("words", "survey", "lens", extra=_MIXED, body="""
SELECT l.doc_id, CASE WHEN ge - gs >= 25 THEN gs END AS gap_start, CASE WHEN ge - gs >= 25 THEN ge END AS gap_end
FROM lens l LEFT JOIN widest w ON w.doc_id = l.doc_id"""))
def m16(spark, sf):
    kmers = TTA + M.both_strands("TTTAGGG")
    return A.with_canonical_linker(V.seqs(spark, sf), kmers).select("doc_id", "gap_start", "gap_end")


_ARRAYS = """found AS (
  SELECT doc_id, seq, regexp_extract_all(seq, '((?:TTAGGG|TAGGGT|AGGGTT|GGGTTA|GGTTAG|GTTAGG|CCCTAA|CCTAAC|CTAACC|TAACCC|AACCCT|ACCCTA)+)', 1) AS f,
    regexp_split_to_array(seq, '(?:TTAGGG|TAGGGT|AGGGTT|GGGTTA|GGTTAG|GTTAGG|CCCTAA|CCTAAC|CTAACC|TAACCC|AACCCT|ACCCTA)+') AS b FROM seqs),
arrays AS (
  SELECT doc_id, i, len, CAST(sum(gap + coalesce(lag_len, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS s FROM (
    SELECT *, lag(len) OVER (PARTITION BY doc_id ORDER BY i) AS lag_len FROM (
      SELECT doc_id, i, length(f[i]) AS len, length(b[i]) AS gap FROM found, unnest(range(1, length(f) + 1)) r(i))))"""


@check("m17_register_arrays", with_ctes("seqs", extra=_ARRAYS, body="""
SELECT doc_id, s AS array_start, s + len AS array_end, len // 6 AS copies, round((len // 6) / (len // 6 + 1), 6) AS purity FROM arrays"""))
def m17(spark, sf):
    return V.seqs(spark, sf).select("doc_id", F.explode(A.register_arrays(seq_col())).alias("a")).select(
        "doc_id", F.col("a.start").alias("array_start"), F.col("a.end").alias("array_end"), "a.copies",
        F.round(F.col("a.copies") / (F.col("a.copies") + 1), 6).alias("purity"))


_TERMINALS = _ARRAYS + """,
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s) AS r FROM arrays) WHERE r = 1),
terminals AS (SELECT q.doc_id, genome, seq, s, s + len AS e, len // 6 AS copies, substring(seq, 1, s) AS leader,
    substring(seq, s + len + 1) AS trailer, substring(seq, s + 1, len) AS body
  FROM seqs q LEFT JOIN main m ON m.doc_id = q.doc_id AND length(seq) >= 12)"""


@check("m18_terminals", with_ctes("seqs", extra=_TERMINALS, body="""
SELECT doc_id, s AS array_start, e AS array_end, copies, md5(leader) AS leader, md5(trailer) AS trailer,
  right(leader, 2) AS donor_site, left(trailer, 2) AS acceptor_site FROM terminals"""))
def m18(spark, sf):
    return A.with_terminals(V.seqs(spark, sf)).select(
        "doc_id", "array_start", "array_end", "copies", F.md5("leader").alias("leader"),
        F.md5("trailer").alias("trailer"), "donor_site", "acceptor_site")


@check("m19_estimated_terminals", """
SELECT l_orderkey AS id, l_linenumber AS line, l_quantity * 5 - 6 * l_linenumber AS rest,
  (l_quantity * 5 - 6 * l_linenumber) / 2 AS terminal_len FROM lineitem WHERE l_quantity * 5 - 6 * l_linenumber > 0""")
def m19(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") * 5).alias("length"), F.col("l_linenumber").alias("copies"))
    return A.with_estimated_terminals(rows, "length", "copies").select(
        "id", "line", (F.col("length") - F.col("copies") * 6).alias("rest"), "terminal_len")


@check("m20_boundary_windows", with_ctes("seqs", extra=_TERMINALS, body="""
SELECT doc_id, right(leader, 20) || left(body, 20) AS left_boundary, right(body, 20) || left(trailer, 20) AS right_boundary FROM terminals"""))
def m20(spark, sf):
    return A.with_boundary_windows(A.with_terminals(V.seqs(spark, sf))).select(
        "doc_id", "left_boundary", "right_boundary")


_CLASSES = """near2 AS (
  SELECT u.word6 AS word, min(CASE WHEN m.strand = 'fwd' AND hamming(word6, kmer) = 0 THEN 1 WHEN m.strand = 'rev' AND hamming(word6, kmer) = 0 THEN 2
     WHEN m.strand = 'fwd' AND hamming(word6, kmer) = 1 THEN 3 WHEN m.strand = 'rev' AND hamming(word6, kmer) = 1 THEN 4 ELSE 5 END) AS c
  FROM (SELECT DISTINCT substring(word, 1, 6) AS word6 FROM words WHERE pos + 6 <= n) u CROSS JOIN tta m GROUP BY u.word6),
marks AS (SELECT doc_id, pos, c FROM words w JOIN near2 x ON x.word = substring(w.word, 1, 6) WHERE pos + 6 <= n AND c < 5),
bases AS (SELECT doc_id, pos + o AS p, min(c) AS c FROM marks, unnest(range(6)) r(o) GROUP BY doc_id, pos + o)"""


@check("m22_base_classes", with_ctes("words", "tta", "lens", extra=_CLASSES, body="""
SELECT l.doc_id, count(*) FILTER (c = 1) AS fwd_canonical, count(*) FILTER (c = 2) AS rev_canonical,
  count(*) FILTER (c = 3) AS fwd_variant, count(*) FILTER (c = 4) AS rev_variant, n - count(c) AS non_telo
FROM lens l LEFT JOIN bases b ON b.doc_id = l.doc_id GROUP BY l.doc_id, n"""))
def m22(spark, sf):
    return A.base_classes(V.seqs(spark, sf), "TTAGGG", ["doc_id"])


_DENSE = """flags AS (SELECT doc_id, pos, CASE WHEN t.kmer IS NOT NULL THEN 1 ELSE 0 END AS hit, n
  FROM words LEFT JOIN tta t ON substring(word, 1, 6) = t.kmer),
sliding AS (SELECT doc_id, pos, n, hit, sum(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) AS inside FROM flags)"""


@check("m23_dense_windows", with_ctes("words", "tta", "lens", extra=_DENSE, body="""
SELECT l.doc_id, CASE WHEN l.n >= 200 THEN coalesce(h, 0) ELSE 0 END AS n_hits, greatest(l.n - 199, 0) AS n_windows, coalesce(d, 0) AS n_dense
FROM lens l LEFT JOIN (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS h, count(*) FILTER (inside >= 2 AND pos + 200 <= n) AS d FROM sliding GROUP BY doc_id) s
  ON s.doc_id = l.doc_id"""))
def m23(spark, sf):
    return once(V.seqs(spark, sf), d=A.dense_windows(seq_col(), TTA)).select("doc_id", "d.*")


@check("m24_half_site_pairs", with_ctes("flanks", extra="""joined AS (SELECT doc_id, lf || rf AS t FROM flanks),
sites AS (SELECT doc_id, i AS pos, substring(t, CAST(i AS BIGINT) + 1, 6) AS w FROM (
  SELECT doc_id, base + j AS i, t FROM (SELECT doc_id, t, unnest(range(0, length(t), 1000)) AS base FROM joined), unnest(range(1000)) r(j))
  WHERE i + 6 <= length(t) AND substring(t, CAST(i AS BIGINT) + 1, 6) IN ('GGGTCA', 'TGACCC'))""", body="""
SELECT j.doc_id, (SELECT count(*) FROM sites a WHERE a.doc_id = j.doc_id AND w = 'GGGTCA') AS n_fwd,
  (SELECT count(*) FROM sites a WHERE a.doc_id = j.doc_id AND w = 'TGACCC') AS n_rev,
  coalesce(direct, 0) AS direct, coalesce(inverted, 0) AS inverted
FROM joined j LEFT JOIN (
  SELECT a.doc_id, count(*) FILTER (b.w = 'GGGTCA' AND b.pos - a.pos BETWEEN 6 AND 16) AS direct,
    count(*) FILTER (b.w = 'TGACCC' AND abs(b.pos - a.pos) BETWEEN 6 AND 16) AS inverted
  FROM sites a JOIN sites b ON a.doc_id = b.doc_id AND a.w = 'GGGTCA' GROUP BY a.doc_id) p ON p.doc_id = j.doc_id"""))
def m24(spark, sf):
    return V.flanks(spark, sf).withColumn(
        "p", A.half_site_pairs(F.concat("left", "right"))).select("doc_id", "p.*")


@check("m25_dominant_unit", with_ctes("strand_counts", body="""
SELECT doc_id, CASE WHEN f + r = 0 THEN 'unknown' WHEN f > r THEN 'TTAGGG' ELSE 'CCCTAA' END AS repeat_unit FROM strand_counts"""))
def m25(spark, sf):
    return V.seqs(spark, sf).select("doc_id", M.dominant_unit(
        M.separate_count(seq_col(), TTA_F), M.separate_count(seq_col(), TTA_R)).alias("repeat_unit"))


@check("m27_linker_purity_class", with_ctes("turns", "tta", body="""
SELECT id, CASE WHEN f + r = 0 THEN 'none' WHEN r = 0 THEN 'fwd-only' WHEN f = 0 THEN 'rev-only' ELSE 'both' END AS purity,
  f + r BETWEEN 1 AND 2 AS low FROM (
  SELECT id, CAST(sum(CASE WHEN strand = 'fwd' THEN c ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN strand = 'rev' THEN c ELSE 0 END) AS BIGINT) AS r FROM (
    SELECT id, strand, (length(seq) - length(replace(seq, kmer, ''))) // 6 AS c FROM turns CROSS JOIN tta) GROUP BY id)"""))
def m27(spark, sf):
    t = V.turns(spark, sf)
    return A.with_purity_class(t).select("id", "purity", "low")


@check("m28_quadruplex_density", with_ctes("seqs", body="""
SELECT doc_id, length(regexp_extract_all(seq, 'G{3,}(?:[ACGT]{1,7}G{3,}){3}')) + length(regexp_extract_all(seq, 'C{3,}(?:[ACGT]{1,7}C{3,}){3}')) AS n_g4,
  round((length(regexp_extract_all(seq, 'G{3,}(?:[ACGT]{1,7}G{3,}){3}')) + length(regexp_extract_all(seq, 'C{3,}(?:[ACGT]{1,7}C{3,}){3}'))) * 1000.0 / greatest(length(seq), 1), 6) AS per_kb FROM seqs"""))
def m28(spark, sf):
    n = S.quadruplex_count(seq_col())
    return V.seqs(spark, sf).select(
        "doc_id", n.alias("n_g4"), F.round(n * 1000 / F.greatest(F.length("seq"), F.lit(1)), 6).alias("per_kb"))


@check("m29_near_motif_share", with_ctes("words", "tta", extra=_NEAR, body="""
SELECT genome, CAST(sum(canon + variant) AS BIGINT) AS n_near, count(*) AS n_windows, round(sum(canon + variant) / count(*), 6) AS near_share
FROM windows JOIN seqs USING (doc_id) GROUP BY genome"""))
def m29(spark, sf):
    near, wins = F.sum(F.col("n_canonical") + F.col("n_variant")), F.sum("n_windows")
    return A.with_variant_signal(V.seqs(spark, sf)).groupBy("genome").agg(
        near.alias("n_near"), wins.cast("long").alias("n_windows"), F.round(near / wins, 6).alias("near_share"))


@check("m30_array_phase", with_ctes("seqs", extra=_TERMINALS, body="""
SELECT total, p0 AS phase_0, p1 AS phase_1, p2 AS phase_2, p3 AS phase_3, p4 AS phase_4, p5 AS phase_5,
  round(((p0 - x) ** 2 + (p1 - x) ** 2 + (p2 - x) ** 2 + (p3 - x) ** 2 + (p4 - x) ** 2 + (p5 - x) ** 2) / x, 6) AS chi_square FROM (
  SELECT count(s) AS total, count(s) / 6 AS x, count(*) FILTER (s % 6 = 0) AS p0, count(*) FILTER (s % 6 = 1) AS p1, count(*) FILTER (s % 6 = 2) AS p2,
    count(*) FILTER (s % 6 = 3) AS p3, count(*) FILTER (s % 6 = 4) AS p4, count(*) FILTER (s % 6 = 5) AS p5 FROM terminals)"""))
def m30(spark, sf):
    starts = A.with_terminals(V.seqs(spark, sf)).where(F.col("array_start").isNotNull()).select(
        (F.col("array_start") % 6).alias("phase"))
    return G.uniformity(starts, "phase").withColumn("chi_square", F.round("chi_square", 6))


@check("m31_density_profile", with_ctes("tta_hits", "lens", body="""
SELECT strand, least(19, CAST(floor(pos * 20.0 / n) AS BIGINT)) AS bin, count(*) AS n_hits FROM tta_hits JOIN lens USING (doc_id) GROUP BY ALL"""))
def m31(spark, sf):
    return A.density_profile(V.seqs(spark, sf), "TTAGGG", 20)


@check("m31_boundary_density", with_ctes("flanks", "tta", extra="""parts AS (
  SELECT doc_id, right(lf, 50) AS l, substring(rf, 1, length(rf) - 60) AS s, left(substring(rf, greatest(1, length(rf) - 59)), 50) AS r FROM flanks),
w AS (SELECT doc_id, l || s || r AS t, length(l) AS nl, length(s) AS n FROM parts),
hits AS (SELECT DISTINCT doc_id, strand, i AS pos FROM (
    SELECT doc_id, t, base + j AS i FROM (SELECT doc_id, t, unnest(range(0, length(t), 1000)) AS base FROM w), unnest(range(1000)) r(j)) x
  JOIN tta ON substring(t, CAST(i AS BIGINT) + 1, 6) = kmer),
under AS (SELECT DISTINCT doc_id, strand, pos + d AS p FROM hits, unnest(range(6)) q(d)),
letters AS (SELECT doc_id, nl, n, base + j AS p FROM (
    SELECT doc_id, nl, n, length(t) AS m, unnest(range(0, length(t), 1000)) AS base FROM w), unnest(range(1000)) r(j) WHERE base + j < m),
placed AS (SELECT doc_id, p, CASE WHEN p < nl THEN 'left' WHEN p < nl + n THEN 'inside' ELSE 'right' END AS zone,
  CASE WHEN p < nl THEN nl - 1 - p WHEN p < nl + n THEN (p - nl) * 20 // n ELSE p - nl - n END AS bin FROM letters)""", body="""
SELECT zone, CAST(bin AS BIGINT) AS bin, st.strand, count(*) AS bases, count(u.p) AS covered, round(count(u.p) / count(*), 6) AS density
FROM placed CROSS JOIN (VALUES ('fwd'), ('rev')) st(strand)
LEFT JOIN under u ON u.doc_id = placed.doc_id AND u.p = placed.p AND u.strand = st.strand GROUP BY ALL"""))
def m31_boundary(spark, sf):
    cut = F.greatest(F.lit(0), F.length("right") - 60)
    rows = V.flanks(spark, sf).select(
        "left", F.substring("right", F.lit(1), cut).alias("seq"),
        F.substring("right", cut + 1, F.lit(50)).alias("right"))
    return A.boundary_density(rows, "TTAGGG").select(
        "zone", F.col("bin").cast("long").alias("bin"), "strand", F.col("bases").cast("long").alias("bases"),
        F.col("covered").cast("long").alias("covered"), F.round("density", 6).alias("density"))
