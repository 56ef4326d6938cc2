"""Check queries for introns, interval algebra and joins by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.operators import intervals as I
from repeatloom.operators import placement as P
from repeatloom.operators import sequences as Q
from repeatloom.plans.linkers import distant_hits
from repeatloom.plans.surveys import catalog_report
from repeatloom.suite import views as V
from repeatloom.suite.registry import check
from repeatloom.suite.views import with_ctes

KEYS = ["contig", "parent"]


def _lengths(spark, sf):
    return V.contigs(spark, sf).select("contig", F.length("seq").cast("long").alias("contig_len"))


def _chunks(spark, sf, size=1024):
    return Q.chunk(V.contigs(spark, sf), size=size)


@check("w01_introns", with_ctes("introns", body="SELECT contig, parent, s AS start, e AS \"end\", length FROM introns"))
def w01(spark, sf):
    return I.introns(V.features(spark, sf))


@check("w01_introns_row_order", with_ctes("features", body="""
SELECT contig, parent, pe AS start, s AS "end", s - pe AS length FROM (
  SELECT contig, parent, s, lag(e) OVER (PARTITION BY contig, parent ORDER BY s, e) AS pe FROM features) WHERE pe < s"""))
def w01_rows(spark, sf):
    return I.introns(V.features(spark, sf), running=False)


@check("w02_prefer_exons", with_ctes("features", body="""
SELECT DISTINCT contig, parent, s AS start, e AS "end" FROM (
  SELECT *, max(CASE WHEN ftype = 'exon' THEN 1 ELSE 0 END) OVER (PARTITION BY contig, parent) AS has FROM features)
WHERE ftype = 'exon' OR has = 0"""))
def w02(spark, sf):
    return I.prefer_exons(V.features(spark, sf))


@check("w03_first_per_interval", with_ctes("features", body="""
SELECT contig, start, "end", parent, ftype FROM (SELECT contig, s AS start, e AS "end", parent, ftype,
  row_number() OVER (PARTITION BY contig, s, e ORDER BY parent, ftype) AS r FROM features) WHERE r = 1"""))
def w03(spark, sf):
    return I.first_per_interval(
        V.features(spark, sf).drop("strand"), ["contig", "start", "end"], ["parent", "ftype"])


_MERGED = """merged AS (
  SELECT contig, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY s, e) AS island FROM (
      SELECT contig, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM features))
  GROUP BY contig, island)"""


@check("w04_merged", with_ctes("features", extra=_MERGED, body='SELECT contig, s AS start, e AS "end" FROM merged'))
def w04(spark, sf):
    return I.merge(V.features(spark, sf))


@check("w05_complement", with_ctes("features", "seqs", extra=_MERGED + """,
clens AS (SELECT doc_id AS contig, CAST(length(seq) AS BIGINT) AS n FROM seqs),
walls AS (SELECT m.contig, coalesce(lag(e) OVER (PARTITION BY m.contig ORDER BY s), 0) AS a, s AS b FROM merged m JOIN clens USING (contig) WHERE s < n
  UNION ALL SELECT contig, max(e), any_value(n) FROM merged JOIN clens USING (contig) WHERE s < n GROUP BY contig
  UNION ALL SELECT contig, 0, any_value(n) FROM merged JOIN clens USING (contig) GROUP BY contig HAVING min(s) >= any_value(n))""", body="""
SELECT contig, a AS start, b AS "end" FROM walls WHERE b > a"""))
def w05(spark, sf):
    return I.complement(I.merge(V.features(spark, sf)), _lengths(spark, sf))


@check("w06_exon_ranks", with_ctes("features", extra="""ranked AS (
  SELECT contig, parent, s, e, row_number() OVER w AS rn, count(*) OVER (PARTITION BY contig, parent) AS n_exons,
    lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM (SELECT DISTINCT contig, parent, s, e FROM features)
  WINDOW w AS (PARTITION BY contig, parent ORDER BY s, e))""", body="""
SELECT contig, parent, pe AS start, s AS "end", rn - 2 AS exon_index, n_exons, n_exons - 1 AS n_introns, pe - ps AS prev_exon_len,
  e - s AS next_exon_len, ps AS prev_exon_start, e AS next_exon_end FROM ranked WHERE pe IS NOT NULL"""))
def w06(spark, sf):
    return I.exon_ranks(V.features(spark, sf)).withColumn("next_exon_len", F.col("next_exon_end") - F.col("end"))


@check("w06_exon_sizes", with_ctes("features", body="""
SELECT contig, parent, row_number() OVER (PARTITION BY contig, parent ORDER BY s, e) - 1 AS exon_index, e - s AS exon_len
FROM (SELECT DISTINCT contig, parent, s, e FROM features)"""))
def w06_sizes(spark, sf):
    return I.exon_sizes(V.features(spark, sf))


@check("w07_neighbour_gaps", with_ctes("features", body="""
SELECT contig, CASE WHEN gap < 100 THEN 'below-100' WHEN gap < 1000 THEN '100-1k' WHEN gap < 10000 THEN '1k-10k' ELSE 'above' END AS bucket,
  count(*) AS n, CAST(sum(gap) AS BIGINT) AS total FROM (
  SELECT contig, s - lag(e) OVER (PARTITION BY contig ORDER BY s, e) AS gap FROM (SELECT DISTINCT contig, s, e FROM features))
WHERE gap IS NOT NULL GROUP BY ALL"""))
def w07(spark, sf):
    g = I.neighbour_gaps(V.features(spark, sf)).where(F.col("gap").isNotNull())
    bucket = S.length_bucket(F.col("gap"), (-10**9, 100, 1000, 10000), ("below-100", "100-1k", "1k-10k", "above"))
    return g.groupBy("contig", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("gap").alias("total"))


@check("w08_tandem_clusters", with_ctes("features", body="""
SELECT parent AS contig, count(*) AS n_members, CAST(sum(gap) AS BIGINT) AS total_gap FROM (
  SELECT parent, s - lag(e) OVER (PARTITION BY parent ORDER BY s, e) AS gap FROM (SELECT DISTINCT parent, s, e FROM features))
GROUP BY parent HAVING count(*) BETWEEN 3 AND 5 AND coalesce(bool_and(gap BETWEEN 0 AND 1000), true)"""))
def w08(spark, sf):
    f = V.features(spark, sf).drop("contig").withColumnRenamed("parent", "contig")
    return I.tandem_clusters(f)


@check("w10_sliding_windows", with_ctes("features", "seqs", "words", "tta", extra=_MERGED.replace("FROM features))", "FROM features WHERE ftype = 'CDS'))") + """,
clens AS (SELECT doc_id AS contig, CAST(length(seq) AS BIGINT) AS n FROM seqs),
grid AS (SELECT contig, w AS ws, least(w + 500, n) AS we FROM clens, unnest(range(0, greatest(n, 1), 250)) r(w)),
introns2 AS (SELECT contig, mx AS s, s AS e FROM (SELECT contig, parent, s, max(e) OVER (PARTITION BY contig, parent ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM features) WHERE mx < s),
thits AS (SELECT doc_id AS contig, pos FROM words JOIN tta ON substring(word, 1, 6) = kmer)""", body="""
SELECT contig, ws AS w_start, we AS w_end, CAST(coalesce(c, 0) AS BIGINT) AS cds_bp, coalesce(i, 0) AS n_introns, coalesce(h, 0) AS n_hits,
  round(least(coalesce(c, 0), we - ws) / (we - ws), 6) AS cds_share, round(coalesce(h, 0) * 1000 / (we - ws), 6) AS hits_per_kb
FROM grid g
LEFT JOIN (SELECT g.contig, ws, sum(least(e, ws + 500) - greatest(s, ws)) AS c FROM grid g JOIN merged m ON m.contig = g.contig AND s < ws + 500 AND e > ws GROUP BY ALL) USING (contig, ws)
LEFT JOIN (SELECT g.contig, ws, count(*) AS i FROM grid g JOIN introns2 m ON m.contig = g.contig AND s < ws + 500 AND e > ws GROUP BY ALL) USING (contig, ws)
LEFT JOIN (SELECT g.contig, ws, count(*) AS h FROM grid g JOIN thits m ON m.contig = g.contig AND pos >= ws AND pos < ws + 500 GROUP BY ALL) USING (contig, ws)
WHERE we > ws"""))
def w10(spark, sf):
    f = V.features(spark, sf)
    hits = Q.contig_stretches(V.contigs(spark, sf), M.both_strands("TTAGGG"))
    land = I.window_landscape(
        _lengths(spark, sf), I.merge(f.where(F.col("ftype") == "CDS")), I.introns(f), hits, size=500, step=250)
    return land.where(F.col("w_end") > F.col("w_start")).withColumns({
        "cds_share": F.round("cds_share", 6), "hits_per_kb": F.round("hits_per_kb", 6)})


# --- joins ------------------------------------------------------------------

@check("j01_s03_intron_text", with_ctes("introns", "seqs", body="""
SELECT contig, s AS start, e AS "end", substring(seq, s + 1, e - s) AS seq FROM (SELECT DISTINCT contig, s, e FROM introns WHERE length BETWEEN 20 AND 100000) i
JOIN seqs q ON q.doc_id = i.contig WHERE s < length(seq)"""))
def j01(spark, sf):
    wanted = I.introns(V.features(spark, sf)).where(F.col("length").between(I.INTRON_MIN, I.INTRON_MAX))
    return Q.slices(wanted, _chunks(spark, sf), size=1024)


@check("j02_contigs_with_genes", with_ctes("seqs", "features", body="""
SELECT genome, count(*) AS n_contigs, CAST(sum(length(seq)) AS BIGINT) AS bases FROM seqs WHERE doc_id IN (SELECT contig FROM features WHERE ftype = 'CDS') GROUP BY genome"""))
def j02(spark, sf):
    genic = V.features(spark, sf).where(F.col("ftype") == "CDS").select("contig").distinct()
    return V.contigs(spark, sf).join(genic, "contig", "left_semi").groupBy("genome").agg(
        F.count("*").alias("n_contigs"), F.sum(F.length("seq")).alias("bases"))


@check("j03_unprocessed", """
SELECT c_custkey AS acc, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def j03(spark, sf):
    done = V.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("acc"))
    todo = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("acc"), F.col("c_name").alias("name"))
    return todo.join(done, "acc", "left_anti")


@check("j04_parent_chain", """
SELECT l_orderkey AS parent, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS size, o_custkey AS gene_id,
  coalesce(c_name, '?') AS gene_name, coalesce(c_mktsegment, '?') AS gene_biotype
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def j04(spark, sf):
    exons = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("long").alias("size"))
    transcripts = V.table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("transcript_id"), F.col("o_custkey").alias("gene_id"))
    genes = V.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("gene_id"), F.col("c_name").alias("gene_name"),
        F.col("c_mktsegment").alias("gene_biotype"))
    return I.parent_chain(exons, transcripts, genes)


@check("j05_within_tolerance", with_ctes("introns", "features", extra="""
targets AS (SELECT DISTINCT contig, s + 1 AS ts, e - 1 AS te FROM introns)""", body="""
SELECT contig, ts AS t_start, te AS t_end, max(parent) AS parent, count(*) AS n_matches FROM introns JOIN targets USING (contig)
WHERE abs(s - ts) <= 2 AND abs(e - te) <= 2 GROUP BY ALL"""))
def j05(spark, sf):
    i = I.introns(V.features(spark, sf))
    targets = i.select(
        "contig", (F.col("start") + 1).alias("t_start"), (F.col("end") - 1).alias("t_end")).distinct()
    return I.within_tolerance(i, targets).groupBy("contig", "t_start", "t_end").agg(
        F.max("parent").alias("parent"), F.count("*").alias("n_matches"))


def _containers(spark, sf, slack):
    f = V.features(spark, sf)
    hits = f.where(F.col("ftype") == "CDS").select("contig", "parent", "start", "end")
    known = I.introns(f).select("contig", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    return I.first_container(hits, known, slack=slack).groupBy("contig", "start", "end", "o_start", "o_end").agg(
        F.count("*").alias("n"))


def _container_sql(slack):
    return with_ctes("features", "introns", body=f"""
SELECT h.contig, h.s AS start, h.e AS "end", o.s AS o_start, o.e AS o_end, n FROM (
  SELECT contig, s, e, count(*) AS n FROM features WHERE ftype = 'CDS' GROUP BY ALL) h
LEFT JOIN (SELECT hc, hs, he, s, e FROM (
  SELECT h.contig AS hc, h.s AS hs, h.e AS he, k.s, k.e, row_number() OVER (PARTITION BY h.contig, h.s, h.e ORDER BY k.s, k.e) AS r
  FROM (SELECT DISTINCT contig, s, e FROM features WHERE ftype = 'CDS') h
  JOIN introns k ON k.contig = h.contig AND h.s >= k.s - {slack} AND h.e <= k.e + {slack}) WHERE r = 1) o
ON hc = h.contig AND hs = h.s AND he = h.e""")


@check("j06_container_with_slack", _container_sql(50))
def j06(spark, sf):
    return _containers(spark, sf, I.KNOWN_SLACK)


@check("j07_container", _container_sql(0))
def j07(spark, sf):
    return _containers(spark, sf, 0)


@check("j08_catalog_with_ledger", """
SELECT c_custkey AS acc, coalesce(status, 'missing') AS status, coalesce(n_introns, 0) AS n_introns FROM customer LEFT JOIN (
  SELECT o_custkey, min(o_orderstatus) AS status, count(*) AS n_introns FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def j08(spark, sf):
    ledger = V.table(spark, sf, "orders").where(F.col("o_orderstatus") != "O").groupBy(
        F.col("o_custkey").alias("acc")).agg(F.min("o_orderstatus").alias("status"), F.count("*").alias("n_introns"))
    catalog = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("acc"))
    return catalog_report(catalog, ledger).select("acc", "status", "n_introns")


@check("j09_point_annotation", with_ctes("points", "introns", "features", extra="""
named AS (SELECT contig, s, e, parent FROM introns),
ti AS (SELECT contig, s, e FROM introns WHERE length >= 500)""", body="""
SELECT id, p.contig, pos, CASE WHEN t IS NOT NULL THEN 'in_target' WHEN gi IS NOT NULL THEN 'in_intron' WHEN ge IS NOT NULL THEN 'in_exon' ELSE 'intergenic' END AS place,
  CASE WHEN t IS NOT NULL THEN NULL WHEN gi IS NOT NULL THEN gi ELSE ge END AS gene
FROM (SELECT id, contig, pos,
  (SELECT min(s) FROM ti WHERE ti.contig = q.contig AND ti.s <= pos AND pos < ti.e) AS t,
  (SELECT min(parent) FROM named n WHERE n.contig = q.contig AND n.s <= pos AND pos < n.e) AS gi,
  (SELECT min(parent) FROM features f WHERE f.contig = q.contig AND f.s <= pos AND pos < f.e) AS ge FROM points q) p"""))
def j09(spark, sf):
    f = V.features(spark, sf)
    i = I.introns(f).withColumn("gene", F.col("parent"))
    targets = i.where(F.col("length") >= 500).withColumn("name", F.col("start"))
    return I.annotate_points(
        V.points(spark, sf), targets, i, f.withColumn("gene", F.col("parent"))
    ).select("id", "contig", "pos", "place", "gene")


@check("j11_flanks", with_ctes("introns", "seqs", body="""
SELECT contig, s AS start, e AS "end", substring(seq, greatest(s - 100, 0) + 1, least(s, length(seq)) - greatest(s - 100, 0)) AS left_flank,
  CASE WHEN e < length(seq) THEN substring(seq, e + 1, 100) ELSE '' END AS right_flank FROM (SELECT DISTINCT contig, s, e FROM introns) i
JOIN seqs q ON q.doc_id = i.contig WHERE e <= length(seq)"""))
def j11(spark, sf):
    contigs = V.stored_contigs(spark, sf)
    lengths = contigs.select("contig", "contig_len")
    rows = I.introns(V.features(spark, sf)).join(lengths, "contig").where(F.col("end") <= F.col("contig_len")).drop("contig_len")
    return Q.flanks(rows, Q.chunk(contigs, size=1024), lengths, size=1024)


_PLACED = """pairs AS (SELECT id, p_partkey, q, t FROM (SELECT id, seq AS t, conv_id FROM turns) x JOIN (
  SELECT p_partkey, %s AS q FROM part) y ON y.p_partkey = x.conv_id),
tries AS (SELECT id, p_partkey, q, o, 0 AS st, length(q) - hamming(q, substring(t, CAST(o AS BIGINT) + 1, length(q))) AS m FROM pairs, unnest(range(length(t) - length(q) + 1)) r(o) WHERE length(q) > 0
  UNION ALL SELECT id, p_partkey, q, o, 1, length(q) - hamming(reverse(translate(q, 'ACGT', 'TGCA')), substring(t, CAST(o AS BIGINT) + 1, length(q))) FROM pairs, unnest(range(length(t) - length(q) + 1)) r(o) WHERE length(q) > 0)""" % V._dna_sql("p_name")


@check("j12_best_placement", with_ctes("turns", extra=_PLACED, body="""
SELECT p.id, p.p_partkey, m AS matches, round(m / length(p.q), 6) AS identity, o AS "offset", CASE st WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand
FROM pairs p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id, p_partkey ORDER BY m DESC, st, o) AS r FROM tries) t
  ON t.id = p.id AND t.p_partkey = p.p_partkey AND r = 1"""))
def j12(spark, sf):
    parts = V.table(spark, sf, "part").select("p_partkey", V.dna_of(F.col("p_name")).alias("query"))
    pairs = V.turns(spark, sf).withColumnRenamed("seq", "target").join(
        parts, F.col("conv_id") == F.col("p_partkey"))
    return P.best_placement(pairs).select(
        "id", "p_partkey", "matches", F.round("identity", 6).alias("identity"), "offset", "strand")


@check("j14_alignment_filter", """
WITH h AS (SELECT l_orderkey AS q, l_linenumber AS line, l_partkey % 50 AS sc, l_suppkey % 50 AS hc, l_partkey * 10 AS ss, l_partkey * 10 + 300 AS se,
  l_suppkey * 60 AS hs, l_suppkey * 60 + CAST(l_quantity AS BIGINT) AS he, (CAST(l_quantity AS BIGINT) + 10) / 50 AS qcov, 80 + l_discount * 200 AS pident FROM lineitem)
SELECT q, line, sc AS src_contig, hc AS hit_contig, hs AS hit_start, he AS hit_end, round(qcov, 6) AS qcov FROM h
WHERE NOT (sc = hc AND hs <= se + 200 AND he >= ss - 200) AND qcov >= 0.80 AND pident >= 85""")
def j14(spark, sf):
    q = F.col("l_quantity").cast("long")
    h = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 50).alias("src_contig"), (F.col("l_suppkey") % 50).alias("hit_contig"),
        (F.col("l_partkey") * 10).alias("src_start"), (F.col("l_partkey") * 10 + 300).alias("src_end"),
        (F.col("l_suppkey") * 60).alias("hit_start"), (F.col("l_suppkey") * 60 + q).alias("hit_end"),
        ((q + 10) / 50).alias("qcov"), (80 + F.col("l_discount") * 200).alias("pident"))
    return distant_hits(h).select(
        "q", "line", "src_contig", "hit_contig", "hit_start", "hit_end", F.round("qcov", 6).alias("qcov"))


@check("j15_positional_lookup", with_ctes("features", "introns", body="""
SELECT f.contig, f.s AS start, f.e AS "end", f.parent, l.o_totalprice AS value FROM features f
JOIN (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM documents) AS contig, o_totalprice, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS p FROM orders) l
  ON l.contig = f.contig AND l.p = f.s AND l.o_orderkey = f.parent"""))
def j15(spark, sf):
    o = V.points(spark, sf).join(
        V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), "id")
    keyed = o.select("contig", F.col("pos").alias("start"), F.col("id").alias("parent"), "value")
    return V.features(spark, sf).join(keyed, ["contig", "start", "parent"]).select(
        "contig", "start", "end", "parent", "value")


@check("j16_ortholog_presence", """
SELECT l_partkey AS ortholog, count(*) AS n_present, count(DISTINCT l_suppkey) AS n_genomes,
  count(*) FILTER (free.ps_part IS NOT NULL) AS n_with_free_locus FROM lineitem
LEFT JOIN (SELECT DISTINCT l_partkey AS ps_part FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 5) free ON ps_part = l_partkey
WHERE l_returnflag = 'R' GROUP BY l_partkey""")
def j16(spark, sf):
    l = V.table(spark, sf, "lineitem")
    rows = l.where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("ortholog"), F.col("l_suppkey").alias("genome"))
    free = l.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 5)).select(
        F.col("l_partkey").alias("ortholog"))
    return I.ortholog_presence(rows, free)


@check("j17_insertions_in_introns", with_ctes("points", "introns", body="""
SELECT contig, count(*) AS n_points, count(*) FILTER (EXISTS (SELECT 1 FROM introns i WHERE i.contig = p.contig AND i.s <= pos AND pos < i.e)) AS n_in_introns
FROM points p GROUP BY contig"""))
def j17(spark, sf):
    i = I.introns(V.features(spark, sf))
    placed = I.covering_label(V.points(spark, sf), i, "parent", "gene")
    return placed.groupBy("contig").agg(
        F.count("*").alias("n_points"), F.count("gene").alias("n_in_introns"))


@check("g14_compartments", with_ctes("features", "seqs", extra=_MERGED.replace("FROM features))", "FROM features WHERE ftype = 'CDS'))") + """,
cds AS (SELECT contig, s, least(e, n) AS e FROM merged JOIN (SELECT doc_id AS contig, length(seq) AS n FROM seqs) USING (contig) WHERE s < n),
texts AS (SELECT contig, s, substring(seq, s + 1, e - s) AS t FROM cds JOIN seqs ON doc_id = contig)""", body="""
SELECT genome, count(*) AS n_intervals, CAST(sum(length(t)) AS BIGINT) AS bp FROM texts JOIN seqs ON doc_id = contig GROUP BY genome"""))
def g14(spark, sf):
    cds = I.merge(V.features(spark, sf).where(F.col("ftype") == "CDS"))
    text = Q.slices(cds, _chunks(spark, sf), size=1024).select("contig", "seq")
    return text.join(V.dna(spark, sf).select(F.col("doc_id").alias("contig"), "genome"), "contig").groupBy("genome").agg(
        F.count("*").alias("n_intervals"), F.sum(F.length("seq")).alias("bp"))


@check("g16_contig_lengths", with_ctes("seqs", body="SELECT doc_id AS contig, CAST(length(seq) AS BIGINT) AS contig_len FROM seqs WHERE length(seq) > 0"))
def g16(spark, sf):
    return Q.contig_lengths(_chunks(spark, sf)).where(F.col("contig_len") > 0)

