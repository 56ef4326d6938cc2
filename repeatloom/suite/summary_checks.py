"""Check queries for grouped summaries, shared k-mers and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.operators import arrays as A
from repeatloom.operators import kmers as K
from repeatloom.operators import summaries as G
from repeatloom.operators.durable import once
from repeatloom.plans import linkers as L
from repeatloom.plans import surveys as P
from repeatloom.plans import terminals as T
from repeatloom.plans import validation as C
from repeatloom.suite import views as V
from repeatloom.suite.motif_checks import _TERMINALS
from repeatloom.suite.registry import check
from repeatloom.suite.views import RC, seq_col, with_ctes



def shaped(spark, sf):
    """Whole texts with strand class and splice form."""
    return A.with_splice_form(A.with_strand_class(V.seqs(spark, sf)))


_BOUNDARY = """bound AS (SELECT n.doc_id, genome, orientation, substring(norm_seq, 3, 4) AS d4, substring(norm_seq, length(norm_seq) - 5, 4) AS a4,
  left(norm_seq, 2) = 'GT' AND right(norm_seq, 2) = 'AG' AS gtag, left(norm_seq, 2) = 'GT' AND right(norm_seq, 2) = 'AG' AND length(norm_seq) >= 8 AS inner_ok
  FROM norm n JOIN strand_class c ON c.doc_id = n.doc_id)"""


@check("g01_boundary_counts", with_ctes("norm", "strand_class", extra=_BOUNDARY, body="""
SELECT genome, orientation, 'donor' AS side, d4 AS motif, count(*) AS n FROM bound WHERE inner_ok GROUP BY ALL
UNION ALL SELECT genome, orientation, 'acceptor', a4, count(*) FROM bound WHERE inner_ok GROUP BY ALL"""))
def g01(spark, sf):
    return G.boundary_counts(shaped(spark, sf))


_KINDS = (("template-strand", "template"), ("coding-strand", "coding"), ("converging", "converging"))


@check("g01_boundary_totals", with_ctes("norm", "strand_class", extra=_BOUNDARY, body="""
SELECT genome, count(*) AS n_total, count(*) FILTER (gtag) AS n_gt_ag,
  round(100.0 * count(*) FILTER (inner_ok AND a4 = 'AACC') / nullif(count(*) FILTER (inner_ok), 0), 1) AS fingerprint_pct, """ + ", ".join(
    f"round(100.0 * count(*) FILTER (inner_ok AND a4 = 'AACC' AND orientation = '{k}') / nullif(count(*) FILTER (inner_ok AND orientation = '{k}'), 0), 1) AS fingerprint_pct_{s}, "
    f"count(*) FILTER (inner_ok AND orientation = '{k}') AS n_{s}" for k, s in _KINDS) + " FROM bound GROUP BY genome"))
def g01t(spark, sf):
    return G.boundary_totals(shaped(spark, sf))


@check("g02_most_common_motifs", with_ctes("norm", "strand_class", extra=_BOUNDARY, body="""
SELECT orientation, motif, n, rank FROM (SELECT orientation, a4 AS motif, count(*) AS n, row_number() OVER (PARTITION BY orientation ORDER BY count(*) DESC, a4) AS rank
  FROM bound WHERE inner_ok GROUP BY orientation, a4) WHERE rank <= 5"""))
def g02(spark, sf):
    s = shaped(spark, sf).select("orientation", S.inner_motif(F.col("norm_seq"), "acceptor").alias("motif"))
    return G.most_common(s, ["orientation"], "motif", 5)


@check("g03_duplicate_texts", with_ctes("dna", body="""
SELECT doc_id, count(*) OVER (PARTITION BY lang, dna) AS copies FROM dna"""))
def g03(spark, sf):
    return G.duplicate_counts(V.dna(spark, sf), ["lang"], "dna", ["doc_id"]).select("doc_id", "copies")


@check("g05_species_rollup", """
SELECT c_nationkey AS species, count(*) AS n, round(avg(o_totalprice), 3) AS mean_length, count(DISTINCT o_custkey) AS n_genes,
  count(*) FILTER (o_orderstatus = 'F') AS template, count(*) FILTER (o_orderstatus = 'O') AS coding, count(*) FILTER (o_orderstatus = 'P') AS converging
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
def g05(spark, sf):
    rows = V.table(spark, sf, "orders").join(
        V.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
            F.col("c_nationkey").alias("species"), F.col("o_totalprice").alias("length"),
            F.col("o_custkey").alias("gene"), F.col("o_orderstatus").alias("orientation"))
    return G.species_rollup(rows, {"template": "F", "coding": "O", "converging": "P"}).withColumn(
        "mean_length", F.round("mean_length", 3))


_FLAGGED = """flagged AS (SELECT o_orderkey, o_custkey % 40 AS species, list_filter([CASE WHEN o_totalprice < 50000 THEN 'LOW' END, CASE WHEN o_orderstatus = 'P' THEN 'BAD' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'EDGE' END], lambda x: x IS NOT NULL) AS flags FROM orders)"""


@check("g06_p23_flags_verdicts", f"WITH {_FLAGGED}, counts AS (SELECT species, flag, count(*) AS n FROM (SELECT species, unnest(flags) AS flag FROM flagged) GROUP BY ALL)" + """
SELECT f.species, n_pass, n_fail, flag AS top_reason, n AS top_reason_n FROM (
  SELECT species, count(*) FILTER (length(flags) = 0) AS n_pass, count(*) FILTER (length(flags) > 0) AS n_fail FROM flagged GROUP BY species) f
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n DESC, flag) AS r FROM counts) c ON c.species = f.species AND r = 1""")
def g06(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("species", F.col("o_custkey") % 40).withColumn("flags", S.flag_list(
        F.when(F.col("o_totalprice") < 50000, "LOW"), F.when(F.col("o_orderstatus") == "P", "BAD"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "EDGE")))
    return C.verdict_summary(o.withColumn("verdict", S.verdict(F.col("flags"))), ["species"])


@check("g07_type_summary", with_ctes("best", "strand_class", "seqs", body="""
SELECT genome, repeat_type, count(*) AS n, round(avg(telo_coverage), 6) AS mean_coverage, count(*) FILTER (orientation = 'template-strand') AS n_template,
  count(*) FILTER (orientation = 'coding-strand') AS n_coding, count(*) FILTER (orientation = 'converging') AS n_converging, count(*) FILTER (orientation = 'unknown') AS n_unknown
FROM best JOIN strand_class USING (doc_id) JOIN seqs USING (doc_id) GROUP BY ALL"""))
def g07(spark, sf):
    return P.type_summary(A.with_strand_class(A.with_best_family(V.seqs(spark, sf)))).withColumn(
        "mean_coverage", F.round("mean_coverage", 6))


@check("g09_class_pivot", """
SELECT o_orderpriority AS dataset, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def g09(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), "o_orderstatus")
    return G.class_pivot(o, "dataset", "o_orderstatus", ["F", "O", "P"])


@check("g10_upper_median", """
SELECT l_returnflag, list_sort(list(q))[count(*) // 2 + 1] AS median, min(q) AS lo, max(q) AS hi FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_returnflag""")
def g10(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q")).groupBy(
        "l_returnflag").agg(G.upper_median("q").alias("median"), F.min("q").alias("lo"), F.max("q").alias("hi"))


@check("g11_document_frequency", with_ctes("dna", body="""
SELECT kmer, count(DISTINCT doc_id) AS n_seqs, count(*) AS n_total FROM (
  SELECT doc_id, substring(t, CAST(j AS BIGINT) + 1, 8) AS kmer FROM (
    SELECT doc_id, n, base, substring(dna, CAST(base AS BIGINT) + 1, 1007) AS t FROM (
      SELECT doc_id, dna, length(dna) AS n, unnest(range(0, length(dna), 1000)) AS base FROM dna)), unnest(range(1000)) r(j) WHERE base + j + 8 <= n)
GROUP BY kmer"""))
def g11(spark, sf):
    return K.document_frequency(V.dna(spark, sf), 8, "dna")


@check("g11_top_shared_kmers", with_ctes("turns", body="""
SELECT kmer, n_seqs, n_total, rank FROM (SELECT *, row_number() OVER (ORDER BY n_seqs DESC, kmer) AS rank FROM (
  SELECT kmer, count(DISTINCT id) AS n_seqs, count(*) AS n_total FROM (
    SELECT id, substring(seq, CAST(i AS BIGINT) + 1, 10) AS kmer FROM turns, unnest(range(length(seq) - 9)) r(i)) GROUP BY kmer)) WHERE rank <= 15"""))
def g11top(spark, sf):
    top = K.document_frequency(V.turns(spark, sf), 10).orderBy(F.desc("n_seqs"), "kmer").limit(15)
    return G.top_k(top, [], [F.desc("n_seqs"), F.asc("kmer")], 15)


_SETS = f"""strands AS (SELECT doc_id AS id, dna AS seq, length(dna) AS n FROM dna WHERE length(dna) >= 32 UNION ALL SELECT doc_id, {RC.format('dna')}, length(dna) FROM dna WHERE length(dna) >= 32),
km AS (SELECT DISTINCT id, substring(t, CAST(j AS BIGINT) + 1, 16) AS w FROM (
    SELECT id, n, base, substring(seq, CAST(base AS BIGINT) + 1, 1015) AS t FROM (SELECT *, unnest(range(0, n, 1000)) AS base FROM strands)), unnest(range(1000)) r(j)
  WHERE base + j + 16 <= n),
sizes AS (SELECT id, count(*) AS n FROM km GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM km a JOIN km b ON a.w = b.w AND a.id <> b.id GROUP BY ALL)"""


def _texts(spark, sf):
    """Whole documents; 16-mers, because invented prose repeats its syllables."""
    return V.dna(spark, sf).select(F.col("doc_id").alias("id"), F.col("dna").alias("seq"))


@check("j13_central_linkers", with_ctes("dna", extra=_SETS, body="""
SELECT s.id, count(b) AS degree FROM sizes s LEFT JOIN (
  SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c / least(x.n, y.n) >= 0.20) p ON p.a = s.id GROUP BY s.id"""))
def j13(spark, sf):
    t = _texts(spark, sf)
    sets = K.distinct_sets(t, 16, 32)
    degree = K.degrees(sets, K.similar_sets(sets, 0.20)).join(sets.select("rep", "set_key"), "rep")
    return K.members(t, 16, 32).join(degree, "set_key").select("id", "degree")


@check("g12_linker_groups", with_ctes("dna", extra=_SETS + """,
edges AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c / least(x.n, y.n) >= 0.50)""", body="""
SELECT count(*) AS n_groups, count(*) FILTER (size = 1) AS n_singletons, count(*) FILTER (size >= 3) AS n_ge3, count(*) FILTER (size >= 10) AS n_ge10, max(size) AS largest FROM (
  SELECT label, count(*) AS size FROM (
    WITH RECURSIVE reach(id, other) AS (SELECT id, id FROM sizes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other)
    SELECT id, min(other) AS label FROM reach GROUP BY id) GROUP BY label)"""))
def g12(spark, sf):
    return K.size_statistics(L.linker_groups(_texts(spark, sf), 16, threshold=0.50))


@check("g15_pair_distance", """
WITH p AS (SELECT o_custkey, o_orderkey AS id, o_custkey % 3 AS x, o_orderkey % 7 AS contig, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(floor(o_totalprice) AS BIGINT) + 100 AS e FROM orders)
SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.contig = b.contig THEN abs((a.s + a.e) / 2 - (b.s + b.e) / 2) END AS distance,
  CASE WHEN a.x = 0 THEN 'shared-linker' WHEN a.contig = b.contig THEN 'same-contig-intergenic' ELSE 'cross-contig' END AS pair_class
FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.id < b.id""")
def g15(spark, sf):
    o = V.table(spark, sf, "orders")
    s = F.floor("o_totalprice").cast("long")
    side = lambda x: o.select(
        "o_custkey", F.col("o_orderkey").alias(f"id_{x}"), (F.col("o_orderkey") % 7).alias(f"contig_{x}"),
        s.alias(f"start_{x}"), (s + 100).alias(f"end_{x}"))
    pairs = side("a").join(side("b"), "o_custkey").where(F.col("id_a") < F.col("id_b")).withColumn(
        "shared", F.col("o_custkey") % 3 == 0)
    return G.pair_distance(pairs).select("id_a", "id_b", "distance", "pair_class")


@check("g17_purity_mix", with_ctes("turns", "tta", extra="""marked AS (
  SELECT id, role, length(seq) AS n, length(regexp_replace(seq, '[^GC]', '', 'g')) / greatest(length(seq), 1) AS gc,
    (SELECT CAST(sum((length(seq) - length(replace(seq, kmer, ''))) // 6) AS BIGINT) FROM tta) AS c FROM turns)""", body="""
SELECT role, CASE WHEN n >= 15 AND n < 30 THEN 'short' WHEN n >= 30 AND n < 120 THEN 'medium' WHEN n >= 120 THEN 'long' END AS bucket, count(*) AS n_linkers,
  count(*) FILTER (c = 0) AS n_pure, count(*) FILTER (c > 0) AS n_contaminated, count(*) FILTER (c BETWEEN 1 AND 2) AS n_low,
  min(n) FILTER (c = 0) AS shortest, max(n) FILTER (c = 0) AS longest,
  list_sort(list(n) FILTER (c = 0))[count(*) FILTER (c = 0) // 2 + 1] AS median, round(avg(gc) FILTER (c = 0), 6) AS mean_gc FROM marked GROUP BY ALL"""))
def g17(spark, sf):
    return L.purity_mix(V.turns(spark, sf), ["role"]).withColumn("mean_gc", F.round("mean_gc", 6))


_SIDES = _TERMINALS + """, sides AS (SELECT doc_id, 'leader' AS side, leader AS t, copies FROM terminals WHERE s IS NOT NULL UNION ALL SELECT doc_id, 'trailer', trailer, copies FROM terminals WHERE s IS NOT NULL)"""


@check("g18_terminal_statistics", with_ctes("seqs", extra=_SIDES, body="""
SELECT side, count(*) AS n, round(avg(length(t)), 6) AS mean, median(length(t)) AS median, round(stddev_samp(length(t)), 6) AS sd_sample, round(stddev_pop(length(t)), 6) AS sd_population,
  min(length(t)) AS min, max(length(t)) AS max, round(avg(length(regexp_extract_all(t, 'CT[ACG][CT]'))), 6) AS mean_n_branch, round(avg(length(regexp_extract_all(t, '[CT]{4,}'))), 6) AS mean_n_tracts, """ + ", ".join(
    f"round(avg((length(t) - length(replace(t, '{b}', ''))) / length(t)), 6) AS mean_share_{b.lower()}" for b in "ACGT") + """
FROM sides WHERE length(t) > 0 GROUP BY side"""))
def g18(spark, sf):
    stats = T.terminal_statistics(T.terminal_table(V.seqs(spark, sf), ["doc_id"]))
    return stats.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes])


@check("g19_terminal_correlations", with_ctes("seqs", extra=_TERMINALS, body="""
SELECT round(corr(length(leader), length(trailer)), 6) AS leader_trailer, round(corr(length(leader), copies / (copies + 1)), 6) AS leader_purity,
  round(corr(length(trailer), copies / (copies + 1)), 6) AS trailer_purity FROM terminals WHERE s IS NOT NULL"""))
def g19(spark, sf):
    c = T.terminal_correlations(V.seqs(spark, sf))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@check("g20_position_frequencies", with_ctes("seqs", extra=_TERMINALS + """, w AS (SELECT right(leader, 20) || left(body, 20) AS t FROM terminals WHERE s IS NOT NULL)""", body="""
SELECT pos, base, n, round(n / sum(n) OVER (PARTITION BY pos), 6) AS share FROM (
  SELECT i AS pos, substring(t, CAST(i AS BIGINT) + 1, 1) AS base, count(*) AS n FROM w, unnest(range(40)) r(i) WHERE length(t) >= 20 AND i < length(t) GROUP BY ALL)"""))
def g20(spark, sf):
    rows = A.with_boundary_windows(A.with_terminals(V.seqs(spark, sf))).where(F.length("left_boundary") >= 20)
    return G.position_frequencies(rows, "left_boundary").withColumn("share", F.round("share", 6))


@check("g21_ledger_totals", """
SELECT count(*) FILTER (o_orderstatus = 'O') AS n_ok, count(*) FILTER (o_orderstatus <> 'O') AS n_failed, CAST(sum(o_custkey) AS BIGINT) AS n_introns, CAST(sum(o_orderkey % 3) AS BIGINT) AS n_kept FROM orders""")
def g21(spark, sf):
    return P.ledger_totals(V.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "ok").otherwise("failed").alias("status"),
        F.col("o_custkey").alias("n_introns"), (F.col("o_orderkey") % 3).alias("n_kept")))


@check("g22_near_misses", with_ctes("best", "seqs", body="""
SELECT lang, doc_id, round(telo_coverage, 6) AS telo_coverage, rank FROM (SELECT lang, doc_id, telo_coverage, row_number() OVER (PARTITION BY lang ORDER BY telo_coverage DESC, doc_id) AS rank
  FROM best JOIN seqs USING (doc_id) WHERE telo_coverage >= 0.70 AND telo_coverage < 0.85) WHERE rank <= 10"""))
def g22(spark, sf):
    return P.near_misses(A.with_best_family(V.seqs(spark, sf)), ["lang"], ["doc_id"]).select(
        "lang", "doc_id", F.round("telo_coverage", 6).alias("telo_coverage"), "rank")


@check("g22_every_nth", """
SELECT id, grp FROM (SELECT o_orderkey AS id, o_custkey AS grp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE (r - 1) % 4 = 0""")
def g22n(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), "o_totalprice")
    return G.every_nth(o, ["grp"], [F.desc("o_totalprice"), F.asc("id")], 4).select("id", "grp")


@check("g23_multi_family_table", with_ctes("tta_hits", "tta_cov", "strand_class", "seqs", body="""
SELECT genome, count(*) AS n_introns, count(h) AS n_any, count(*) FILTER (h >= 5) AS n_5_hits, count(*) FILTER (cov >= 0.3) AS n_30, count(*) FILTER (cov >= 0.5) AS n_50, count(*) FILTER (cov >= 0.7) AS n_70,
  round(100.0 * count(*) FILTER (orientation = 'template-strand') / count(*), 1) AS template_pct
FROM seqs JOIN tta_cov USING (doc_id) JOIN strand_class USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS h FROM tta_hits GROUP BY doc_id) t USING (doc_id) GROUP BY genome"""))
def g23(spark, sf):
    both = M.both_strands("TTAGGG")
    s = once(V.seqs(spark, sf), hits=M.hit_count(seq_col(), both), cov=M.coverage(seq_col(), both), fwd_frac=M.strand_fraction(seq_col()))
    o = M.strand_class(seq_col(), F.col("fwd_frac"))
    return s.groupBy("genome").agg(
        F.count("*").alias("n_introns"), F.count_if(F.col("hits") > 0).alias("n_any"),
        F.count_if(F.col("hits") >= 5).alias("n_5_hits"),
        *[F.count_if(F.col("cov") >= t / 100).alias(f"n_{t}") for t in (30, 50, 70)],
        F.round(100 * F.count_if(o == "template-strand") / F.count("*"), 1).alias("template_pct"))


@check("g24_burden_rollup", """
WITH c AS (SELECT r_name AS supergroup, n_name AS phylum, c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS telo
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT supergroup, phylum, count(*) AS n_genomes, CAST(sum(telo) AS BIGINT) AS telo, CAST(sum(total) AS BIGINT) AS total, round(avg(telo / total), 6) AS mean_burden, round(median(telo / total), 6) AS median_burden,
  round(quantile_cont(telo / total, 0.75) - quantile_cont(telo / total, 0.25), 6) AS iqr, round(count(*) FILTER (telo > 0) / count(*), 6) AS prevalence
FROM c GROUP BY ROLLUP (supergroup, phylum)""")
def g24(spark, sf):
    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("telo"))
    taxa = V.table(spark, sf, "nation").join(
        V.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("supergroup"), F.col("n_name").alias("phylum"))
    rows = V.table(spark, sf, "customer").join(o, "c_custkey").join(taxa, "c_nationkey")
    b = G.burden(rows, ["supergroup", "phylum"])
    return b.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes])


@check("g25_rank_correlation", """
WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS y FROM orders)
SELECT o_orderpriority, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY o_orderpriority""")
def g25(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_custkey").cast("double").alias("k"))
    return G.spearman(o, "o_totalprice", "k", ["o_orderpriority"]).withColumn("rho", F.round("rho", 6))


@check("g26_degenerate_splice", with_ctes("norm", body="""
SELECT genome, count(*) FILTER (s) AS n_degenerate, count(*) FILTER (NOT s) AS n_regular FROM (
  SELECT genome, donor IN ('TT', 'TA', 'AT', 'AA', 'GG', 'GA') OR acceptor IN ('TT', 'TA', 'AT', 'AA', 'GG', 'GA') OR CASE WHEN (donor = 'GT' AND acceptor = 'AG') OR (donor = 'CT' AND acceptor = 'AC') THEN 'canonical' ELSE 'other' END <> 'canonical' AS s
  FROM norm) GROUP BY genome"""))
def g26(spark, sf):
    rows = once(V.seqs(spark, sf), donor=S.first(seq_col(), 2), acceptor=S.last(seq_col(), 2))
    d, a = F.col("donor"), F.col("acceptor")
    kind = F.when(S.canonical_sites(d, a), "canonical").otherwise("other")
    flag = S.degenerate_splice(d, a, kind)
    return rows.groupBy("genome").agg(F.count_if(flag).alias("n_degenerate"), F.count_if(~flag).alias("n_regular"))


@check("g27_motif_enrichment", with_ctes("norm", "strand_class", extra=_BOUNDARY, body="""
SELECT genome, motif, n, round(n / sum(n) OVER (PARTITION BY genome), 6) AS share, round(n / sum(n) OVER (PARTITION BY genome) * 256, 6) AS enrichment FROM (
  SELECT genome, a4 AS motif, count(*) AS n FROM bound WHERE inner_ok GROUP BY ALL)"""))
def g27(spark, sf):
    counts = shaped(spark, sf).select("genome", S.inner_motif(F.col("norm_seq"), "acceptor").alias("motif")).where(
        F.col("motif").isNotNull()).groupBy("genome", "motif").agg(F.count("*").alias("n"))
    e = G.enrichment(counts, ["genome"])
    return e.withColumns({"share": F.round("share", 6), "enrichment": F.round("enrichment", 6)})


@check("g28_adjusted_p_values", """
WITH t AS (SELECT l_orderkey AS id, l_linenumber AS line, (l_quantity + l_discount * 100) / 1000 AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (ORDER BY p, id, line) AS k, count(*) OVER () AS m FROM t)
SELECT id, line, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM (
  SELECT id, line, p, m, max(k) OVER (PARTITION BY p) AS k FROM r)""")
def g28(spark, sf):
    t = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        ((F.col("l_quantity") + F.col("l_discount") * 100) / 1000).alias("p"))
    return G.adjusted_p_values(t).select("id", "line", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@check("g28_strand_by_splice", with_ctes("norm", "strand_class", extra=_BOUNDARY, body="""
SELECT orientation, count(*) FILTER (gtag) AS gt_ag, count(*) FILTER (NOT gtag) AS other FROM bound GROUP BY orientation"""))
def g28b(spark, sf):
    gtag = S.starts_ends(F.col("norm_seq"), "GT", "AG")
    return shaped(spark, sf).groupBy("orientation").agg(F.count_if(gtag).alias("gt_ag"), F.count_if(~gtag).alias("other"))


@check("g29_first_component", """
WITH RECURSIVE t AS (SELECT count(*) AS a, sum(o_totalprice) AS b, max(o_totalprice) AS c FROM orders GROUP BY o_custkey),
r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM t),
p(i, x, y, z) AS (SELECT 0, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, u / sqrt(u * u + v * v + w * w), v / sqrt(u * u + v * v + w * w), w / sqrt(u * u + v * v + w * w)
  FROM (SELECT i, x + ab * y + ac * z AS u, ab * x + y + bc * z AS v, ac * x + bc * y + z AS w FROM p, r) WHERE i < 200),
e AS (SELECT x, y, z, x + ab * y + ac * z AS u, ab * x + y + bc * z AS v, ac * x + bc * y + z AS w FROM p, r WHERE i = 200)
SELECT round(abs(u) / sqrt(x * u + y * v + z * w), 6) AS pc_a, round(abs(v) / sqrt(x * u + y * v + z * w), 6) AS pc_b,
  round(abs(w) / sqrt(x * u + y * v + z * w), 6) AS pc_c FROM e""")
def g29(spark, sf):
    rows = V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("a"), F.sum("o_totalprice").alias("b"), F.max("o_totalprice").alias("c"))
    return G.first_component(rows, ["a", "b", "c"]).agg(
        F.round(F.abs(F.corr("pc1", "a")), 6).alias("pc_a"), F.round(F.abs(F.corr("pc1", "b")), 6).alias("pc_b"),
        F.round(F.abs(F.corr("pc1", "c")), 6).alias("pc_c"))


_HITS = """h AS (SELECT l_orderkey AS q, l_partkey % 50 AS sc, l_suppkey % 50 AS hc, l_partkey * 10 AS ss, l_partkey * 10 + 300 AS se,
  l_suppkey * 60 AS hs, l_suppkey * 60 + CAST(l_quantity AS BIGINT) AS he, (CAST(l_quantity AS BIGINT) + 10) / 60 AS qcov FROM lineitem),
good AS (SELECT * FROM h WHERE NOT (sc = hc AND hs <= se + 200 AND he >= ss - 200) AND qcov >= 0.8)"""


@check("g30_hits_per_linker", f"WITH {_HITS}, " + """
n AS (SELECT o_orderkey, (SELECT count(*) FROM good WHERE q = o_orderkey) AS c FROM orders)
SELECT count(*) AS n_linkers, median(c) AS median, round(avg(c), 6) AS mean, max(c) AS max, count(*) FILTER (c = 0) AS n_0, count(*) FILTER (c BETWEEN 1 AND 2) AS n_1_2,
  count(*) FILTER (c BETWEEN 3 AND 9) AS n_3_9, count(*) FILTER (c BETWEEN 10 AND 99) AS n_10_99, count(*) FILTER (c >= 100) AS n_100_up, count(*) FILTER (c >= 3) AS n_multi, count(*) FILTER (c = 1) AS n_single_copy FROM n""")
def g30(spark, sf):
    linkers = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("qseqid"))
    return L.hit_distribution(L.hits_per_linker(linkers, hit_rows(spark, sf))).withColumn("mean", F.round("mean", 6))


def hit_rows(spark, sf):
    q = F.col("l_quantity").cast("long")
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("qseqid"), (F.col("l_partkey") % 50).alias("src_contig"),
        (F.col("l_suppkey") % 50).alias("hit_contig"), (F.col("l_partkey") * 10).alias("src_start"),
        (F.col("l_partkey") * 10 + 300).alias("src_end"), (F.col("l_suppkey") * 60).alias("hit_start"),
        (F.col("l_suppkey") * 60 + q).alias("hit_end"), ((q + 10) / 60).alias("qcov"), F.lit(90.0).alias("pident"))


@check("g31_subtelomeric_share", with_ctes("features", "seqs", body="""
SELECT ftype, count(*) AS n, count(*) FILTER (near) AS n_near, round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 6) AS near_share FROM (
  SELECT ftype, least(s, n - e) < 500 AS near FROM features JOIN (SELECT doc_id, CAST(length(seq) AS BIGINT) AS n FROM seqs) ON doc_id = contig) GROUP BY ftype"""))
def g31(spark, sf):
    lengths = V.contigs(spark, sf).select("contig", F.length("seq").cast("long").alias("contig_len"))
    return L.subtelomeric_share(V.features(spark, sf), lengths, ["ftype"], 500).withColumn(
        "near_share", F.round("near_share", 6))


