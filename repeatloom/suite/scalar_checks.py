"""Check queries for scalar expressions, readers, sorting and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.operators.durable import once, scratch_path

from repeatloom.operators import summaries as G
from repeatloom.plans import surveys as P
from repeatloom.sinks import writers as K
from repeatloom.sources import readers as R
from repeatloom.suite import views as V
from repeatloom.suite.registry import check
from repeatloom.suite.views import RC, seq_col, with_ctes



@check("p01_rotations", f"""
WITH units AS (SELECT DISTINCT {V._dna_sql('p_name')} AS unit FROM part),
strands AS (SELECT unit, 'fwd' AS strand, unit AS base FROM units UNION ALL SELECT unit, 'rev', {RC.format('unit')} FROM units)
SELECT DISTINCT unit, strand, substring(base || base, CAST(i AS BIGINT) + 1, length(base)) AS kmer FROM strands, unnest(range(length(base))) r(i)""")
def p01(spark, sf):
    return M.rotation_table(V.table(spark, sf, "part").select(V.dna_of(F.col("p_name")).alias("unit")).distinct())


@check("p02_reverse_complement", with_ctes("dna", body=f"""
SELECT doc_id, md5({RC.format('dna')}) AS rc, md5({RC.format("regexp_replace(replace(dna, 'T', 'U'), '[^ACGTN]', 'N', 'g')")}) AS masked FROM dna"""))
def p02(spark, sf):
    d = F.col("dna")
    return V.dna(spark, sf).select(
        "doc_id", F.md5(S.revcomp(d)).alias("rc"), F.md5(S.revcomp_masked(F.replace(d, F.lit("T"), F.lit("U")))).alias("masked"))


@check("p03_p06_splice_form", with_ctes("norm", body="""
SELECT doc_id, md5(norm_seq) AS norm, donor, acceptor, left(norm_seq, 8) AS donor_8, right(norm_seq, 8) AS acceptor_8,
  CASE WHEN g THEN substring(norm_seq, 3, 4) END AS donor_4, CASE WHEN g THEN substring(norm_seq, length(norm_seq) - 5, 4) END AS acceptor_4,
  (donor = 'GT' AND acceptor = 'AG') OR (donor = 'CT' AND acceptor = 'AC') AS canonical
FROM (SELECT *, left(norm_seq, 2) = 'GT' AND right(norm_seq, 2) = 'AG' AND length(norm_seq) >= 8 AS g FROM norm)"""))
def p03(spark, sf):
    n = F.col("norm_seq")
    rows = once(V.seqs(spark, sf), norm_seq=S.sense_strand(seq_col()), donor=S.first(seq_col(), 2), acceptor=S.last(seq_col(), 2))
    return rows.select(
        "doc_id", F.md5("norm_seq").alias("norm"), "donor", "acceptor", S.first(n, 8).alias("donor_8"),
        S.last(n, 8).alias("acceptor_8"), S.inner_motif(n, "donor").alias("donor_4"),
        S.inner_motif(n, "acceptor").alias("acceptor_4"),
        S.canonical_sites(F.col("donor"), F.col("acceptor")).alias("canonical"))


@check("p07_splice_in_repeat", with_ctes("turns", "tta", extra=f"""edges AS (
  SELECT id, 'G' || 'TTAGG' || seq || 'AACC' || 'AG' AS a, 'GT' || seq || 'TTAGGG' || 'TTAG' AS b FROM turns)""", body="""
SELECT id, left(a, 2) = 'GT' AND left(a, 6) IN (SELECT kmer FROM tta) AS gt_a, right(a, 2) = 'AG' AND right(a, 6) IN (SELECT kmer FROM tta) AS ag_a,
  left(b, 2) = 'GT' AND left(b, 6) IN (SELECT kmer FROM tta) AS gt_b, right(b, 2) = 'AG' AND right(b, 6) IN (SELECT kmer FROM tta) AS ag_b FROM edges"""))
def p07(spark, sf):
    a = F.concat(F.lit("GTTAGG"), seq_col(), F.lit("AACCAG"))
    b = F.concat(F.lit("GT"), seq_col(), F.lit("TTAGGGTTAG"))
    return V.turns(spark, sf).select(
        "id", S.edge_in_repeat(a, "donor").alias("gt_a"), S.edge_in_repeat(a, "acceptor").alias("ag_a"),
        S.edge_in_repeat(b, "donor").alias("gt_b"), S.edge_in_repeat(b, "acceptor").alias("ag_b"))


@check("p08_p09_composition", with_ctes("dna", body="""
SELECT doc_id, """ + ", ".join(
    f"round(CASE WHEN n > 0 THEN (n - length(replace(dna, '{b}', ''))) / n ELSE 0.0 END, 6) AS share_{b.lower()}" for b in "ACGTN") + """,
  round(CASE WHEN n > 0 THEN length(regexp_replace(dna, '[^GC]', '', 'g')) / n ELSE 0.0 END, 6) AS gc,
  round((n - length(replace(dna, 'CG', ''))) / 2 / greatest(1, n - 1), 6) AS cpg, round((n - length(replace(dna, 'TA', ''))) / 2 / greatest(1, n - 1), 6) AS tpa
FROM (SELECT *, length(dna) AS n FROM dna)"""))
def p08(spark, sf):
    d = F.col("dna")
    return V.dna(spark, sf).select(
        "doc_id", *[F.round(S.letter_share(d, b), 6).alias(f"share_{b.lower()}") for b in "ACGTN"],
        F.round(S.gc_share(d), 6).alias("gc"), F.round(S.dinucleotide_share(d, "CG"), 6).alias("cpg"),
        F.round(S.dinucleotide_share(d, "TA"), 6).alias("tpa"))


@check("p10_n_filter", with_ctes("dna", body="""
SELECT lang, count(*) AS n_rows, count(*) FILTER (length(dna) > 0 AND length(replace(dna, 'N', '')) < 0.95 * length(dna)) AS n_dropped FROM dna GROUP BY lang"""))
def p10(spark, sf):
    return V.dna(spark, sf).groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.count_if(S.letter_share(F.col("dna"), "N") > 0.05).alias("n_dropped"))


@check("p11_p12_branch_points_tracts", with_ctes("dna", body="""
SELECT doc_id, length(regexp_extract_all(dna, 'CT[ACG][CT]')) AS n_branch, length(t) AS n_tracts,
  CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS tract_bases, coalesce(list_max(list_transform(t, lambda x: length(x))), 0) AS longest
FROM (SELECT *, regexp_extract_all(dna, '[CT]{4,}') AS t FROM dna)"""))
def p11(spark, sf):
    d = F.col("dna")
    rows = once(V.dna(spark, sf), t=S.pyrimidine_tract_lengths(d))
    return rows.select(
        "doc_id", S.branch_points(d).alias("n_branch"), S.pyrimidine_tracts(d).alias("n_tracts"),
        F.aggregate("t", F.lit(0), lambda a, x: a + x).alias("tract_bases"),
        F.coalesce(F.array_max("t"), F.lit(0)).alias("longest"))


@check("p13_sites_in_unit", f"""
WITH units AS (SELECT DISTINCT {V._dna_sql('p_name')} AS unit FROM part)
SELECT unit, coalesce(array_to_string(list_filter(range(length(unit)), lambda i: substring(unit || left(unit, 1), CAST(i AS BIGINT) + 1, 2) = 'GT'), ','), '') AS gt,
  coalesce(array_to_string(list_filter(range(length(unit)), lambda i: substring(unit || left(unit, 1), CAST(i AS BIGINT) + 1, 2) = 'AG'), ','), '') AS ag
FROM units WHERE length(unit) > 0""")
def p13(spark, sf):
    u = V.table(spark, sf, "part").select(V.dna_of(F.col("p_name")).alias("unit")).distinct().where(F.length("unit") > 0)
    text = lambda pair: F.array_join(M.splice_sites_in_unit(F.col("unit"), pair).cast("array<string>"), ",")
    return u.select("unit", text("GT").alias("gt"), text("AG").alias("ag"))


@check("p14_p15_periodic_near_start", f"""
SELECT p_partkey, n >= 12 AND length(list_filter(range(0, n - 5, 6), lambda i: substring(t, CAST(i AS BIGINT) + 1, 6) = left(t, 6))) / greatest(1, n // 6) > 0.95 AS periodic,
  p_retailprice * 3 < 5000 AND p_retailprice < 1000 AS near_start FROM (
  SELECT *, length(t) AS n FROM (SELECT p_partkey, p_retailprice, repeat('TTAGGG', p_size) || {V._dna_sql('p_name')} AS t FROM part))""")
def p14(spark, sf):
    t = F.concat(F.expr("repeat('TTAGGG', p_size)"), V.dna_of(F.col("p_name")))
    price = F.col("p_retailprice")
    return V.table(spark, sf, "part").select(
        "p_partkey", S.perfectly_periodic(t).alias("periodic"),
        S.near_contig_start(price, price * 3).alias("near_start"))


@check("p16_palindromes", with_ctes("turns", body=f"""
SELECT id, round(CASE WHEN h > 0 THEN (h - hamming(left(seq, h), {RC.format('right(seq, h)')})) / h ELSE 0.0 END, 6) AS identity
FROM (SELECT id, seq, length(seq) // 2 AS h FROM turns)"""))
def p16(spark, sf):
    return V.turns(spark, sf).select("id", F.round(S.palindrome_identity(seq_col()), 6).alias("identity"))


@check("p17_site_duplication", with_ctes("flanks", body="""
SELECT doc_id, coalesce(list_max(list_filter(range(3, 26), lambda l: l <= length(lf) AND l <= length(rf) AND right(lf, l) = left(rf, l))), 0) AS tsd_len FROM flanks"""))
def p17(spark, sf):
    return V.flanks(spark, sf).select(
        "doc_id", S.target_site_duplication(F.col("left"), F.col("right")).cast("long").alias("tsd_len"))


@check("p18_p19_microhomology", with_ctes("flanks", "mechanism", extra="""
ends AS (SELECT DISTINCT family, 'p' AS kind, left(kmer, CAST(l AS BIGINT)) AS w, l FROM mechanism, unnest(range(2, 9)) r(l) WHERE l <= k
  UNION SELECT DISTINCT family, 's', right(kmer, CAST(l AS BIGINT)), l FROM mechanism, unnest(range(2, 9)) r(l) WHERE l <= k)""", body="""
SELECT doc_id, coalesce((SELECT max(l) FROM ends e WHERE e.family = f.family AND kind = 'p' AND l <= length(lf) AND right(lf, l) = w), 0) AS mh_5p,
  coalesce((SELECT max(l) FROM ends e WHERE e.family = f.family AND kind = 's' AND l <= length(rf) AND left(rf, l) = w), 0) AS mh_3p FROM flanks f"""))
def p18(spark, sf):
    from repeatloom.functions.motifs import MECHANISM_FAMILIES
    f = F.col("family")
    return V.flanks(spark, sf).select(
        "doc_id", S.microhomology_by_family(F.col("left"), f, MECHANISM_FAMILIES, "5p").alias("mh_5p"),
        S.microhomology_by_family(F.col("right"), f, MECHANISM_FAMILIES, "3p").alias("mh_3p"))


@check("p20_junction_microhomology", with_ctes("flanks", "tta", body="""
SELECT doc_id, coalesce(list_max(list_filter(range(2, 9), lambda l: l <= length(lf) AND l <= length(rf) AND right(lf, l) = left(rf, l)
   AND contains(right(lf, l) || right(lf, l), 'TT')
   AND (length(list_filter(ks, lambda k: contains(k, right(lf, l)))) > 0 OR (l >= 4 AND length(list_filter(ks, lambda k: left(k, 4) = left(right(lf, l), 4))) > 0)))), 0) AS mh
FROM flanks, (SELECT list(kmer) AS ks FROM tta)"""))
def p20(spark, sf):
    return V.flanks(spark, sf).select(
        "doc_id", S.junction_microhomology(F.col("left"), F.col("right"), "TTAGGG").alias("mh"))


@check("p22_length_buckets", with_ctes("turns", body="""
SELECT CASE WHEN n BETWEEN 5 AND 30 THEN '5-30' WHEN n > 30 AND n <= 120 THEN '31-120' WHEN n > 120 THEN '121-' END AS closed_bucket,
  CASE WHEN n >= 5 AND n < 30 THEN '5-29' WHEN n >= 30 AND n < 120 THEN '30-119' WHEN n >= 120 THEN '120-' END AS open_bucket, count(*) AS n
FROM (SELECT length(seq) AS n FROM turns) GROUP BY ALL"""))
def p22(spark, sf):
    n = F.length("seq")
    return V.turns(spark, sf).groupBy(
        S.length_bucket(n, (5, 30, 120), ("5-30", "31-120", "121-"), "right").alias("closed_bucket"),
        S.length_bucket(n, (5, 30, 120), ("5-29", "30-119", "120-")).alias("open_bucket"),
    ).agg(F.count("*").alias("n"))


# --- readers ----------------------------------------------------------------

@check("s04_gff_lines", with_ctes("features", body="""
SELECT contig, 'line' AS source, ftype, s AS start, e AS "end", strand, 'id' || parent AS parent, count(*) AS n FROM features GROUP BY ALL"""))
def s04(spark, sf):
    f = V.features(spark, sf)
    lines = f.select(F.concat_ws(
        "\t", F.col("contig").cast("string"), F.lit("line"), "ftype", (F.col("start") + 1).cast("string"),
        F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"),
        F.concat(F.lit("ID=x;Parent=id"), F.col("parent").cast("string"))).alias("value"))
    return R.parse_gff(lines).groupBy(
        F.col("contig").cast("long").alias("contig"), "source", "ftype", "start", "end", "strand",
        F.col("attrs")["Parent"].alias("parent")).agg(F.count("*").alias("n"))


_VCF = """vcf AS (SELECT id, seq, kind, CASE kind WHEN 0 THEN '<INS>' WHEN 1 THEN 'A' || seq WHEN 2 THEN 'AC,A' || seq WHEN 3 THEN 'AC,<DEL>' ELSE 'C' END AS alt
  FROM (SELECT id, id % 5 AS kind, repeat('TTAGGG', CAST(id % 90 AS BIGINT)) || seq AS seq FROM turns))"""


def _vcf_lines(spark, sf):
    kind = F.col("id") % 5
    rows = V.turns(spark, sf).select(
        "id", F.concat(F.expr("repeat('TTAGGG', cast(id % 90 as int))"), seq_col()).alias("seq"))
    alt = (
        F.when(kind == 0, "<INS>").when(kind == 1, F.concat(F.lit("A"), seq_col()))
        .when(kind == 2, F.concat(F.lit("AC,A"), seq_col())).when(kind == 3, "AC,<DEL>").otherwise("C"))
    info = F.when(kind == 0, F.concat(F.lit("SVTYPE=INS;SEQ="), F.lower("seq"))).otherwise("SVTYPE=DEL")
    return rows.select(F.concat_ws(
        "\t", F.lit("chr1"), F.col("id").cast("string"), F.concat(F.lit("sv"), F.col("id").cast("string")), F.lit("A"),
        alt, F.lit("."), F.lit("PASS"), info).alias("value"))


@check("s05_p21_vcf_insertions", with_ctes("turns", extra=_VCF, body="""
SELECT id AS pos, CASE kind WHEN 0 THEN nullif(regexp_extract('SEQ=' || seq, 'SEQ=([ACGTN]+)', 1), '')
  WHEN 1 THEN CASE WHEN length(alt) > 31 THEN substring(alt, 2) END
  WHEN 2 THEN CASE WHEN length(alt) > 31 THEN substring(alt, 2) WHEN length(seq) + 1 > 31 THEN seq END END AS ins_seq FROM vcf"""))
def s05(spark, sf):
    return R.parse_vcf(_vcf_lines(spark, sf)).select("pos", "ins_seq")


@check("s08_catalog_lines", """
SELECT 'GC' || s_suppkey AS acc, replace(replace('a b/c ' || s_name, ' ', '_'), '/', '_') AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE CAST(s_suppkey * 1000 AS BIGINT) END AS genome_bp FROM supplier WHERE s_suppkey % 7 NOT IN (1, 2)""")
def s08(spark, sf):
    k = F.col("s_suppkey")
    head = F.lit("Accession\tname\tx\ty\tbp")
    good = V.table(spark, sf, "supplier").select(k, F.concat_ws(
        "\t", F.when(k % 7 == 1, "").otherwise(F.concat(F.lit("GC"), k.cast("string"))), F.concat(F.lit("a b/c "), F.col("s_name")), F.lit("x"), F.lit("y"),
        F.when(k % 3 == 0, "n/a").otherwise((k * 1000).cast("string"))).alias("value"))
    lines = good.select(F.when(k % 7 == 2, F.substring_index("value", "\t", 4)).otherwise(F.col("value")).alias("value"))
    return R.parse_catalog(lines.unionByName(V.table(spark, sf, "region").select(head.alias("value"))))


def finder_lines(spark, sf):
    """Repeat-finder lines from line items; some are noise or have bad numbers."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    unit = F.element_at(F.array(*[F.lit(u) for u in M.REPEAT_FINDER_FAMILIES]), (F.col("l_partkey") % 13 + 1).cast("int"))
    turned = F.when(F.col("l_suppkey") % 3 == 0, S.revcomp(unit)).otherwise(unit)
    by = (F.col("l_partkey") % F.length(unit)).cast("int")
    rotated = F.concat(F.substring(turned, by + 1, F.length(unit)), F.substring(turned, F.lit(1), by))
    noisy = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("C"), F.substring(rotated, F.lit(2), F.length(rotated)))).otherwise(rotated)
    rows = V.table(spark, sf, "lineitem").select(F.concat_ws(
        "\t", F.col("l_orderkey").cast("string"), (k * 10).cast("string"), (k * 10 + q).cast("string"),
        F.length(unit).cast("string"), F.when(F.col("l_tax") == 0, "n/a").otherwise(q.cast("string")), noisy,
        (q / F.length(unit)).cast("string"), F.lit("0"), F.lit("1"), F.lit("2")).alias("value"))
    return rows


FINDER = """units AS (SELECT u, i, length(u) AS k FROM (VALUES """ + ", ".join(
    f"('{u}', {i})" for i, u in enumerate(M.REPEAT_FINDER_FAMILIES)) + f""") f(u, i)),
raw AS (SELECT l_orderkey AS seq_id, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b, k, l_suppkey, l_partkey % k AS shift, l_tax, l_quantity,
    CASE WHEN l_suppkey % 3 = 0 THEN {RC.format('u')} ELSE u END AS t FROM lineitem JOIN units ON l_partkey % 13 = i),
finder AS (SELECT seq_id, CAST(a AS BIGINT) AS a, b, k, CAST(l_quantity AS BIGINT) AS score, CASE WHEN l_suppkey % 5 = 0 THEN 'C' || substring(r, 2) ELSE r END AS consensus FROM (
  SELECT *, substring(t, shift + 1) || substring(t, 1, shift) AS r FROM raw) WHERE l_tax <> 0 AND b - a >= 10)"""


@check("s09_repeat_finder_lines", f"WITH {FINDER} " + """
SELECT seq_id, a AS tr_start, b AS tr_end, k AS period, consensus, count(*) AS n, CAST(sum(score) AS DOUBLE) AS score FROM finder GROUP BY ALL""")
def s09(spark, sf):
    return R.parse_repeat_finder(finder_lines(spark, sf)).groupBy(
        F.col("seq_id").cast("long").alias("seq_id"), "tr_start", "tr_end", "period", "consensus").agg(
            F.count("*").alias("n"), F.sum("score").alias("score"))


@check("s10_alignment_lines", """
SELECT 'NW_' || (l_suppkey % 50) || '.1' AS hit_contig, 'c' || l_partkey % 50 AS src_contig, l_partkey * 10 AS src_start, l_partkey * 10 + 300 AS src_end,
  l_suppkey * 60 AS hit_start, l_suppkey * 60 + CAST(l_quantity AS BIGINT) AS hit_end, round((CAST(l_quantity AS BIGINT) + 10) / 60, 6) AS qcov, count(*) AS n FROM lineitem GROUP BY ALL""")
def s10(spark, sf):
    return R.parse_alignment_hits(alignment_lines(spark, sf)).groupBy(
        "hit_contig", "src_contig", "src_start", "src_end", "hit_start", "hit_end", F.round("qcov", 6).alias("qcov")).agg(
            F.count("*").alias("n"))


def alignment_lines(spark, sf):
    """Alignment lines from line items; odd order numbers run backwards."""
    q = F.col("l_quantity").cast("long")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    text = lambda c: c.cast("string")
    low, high = s * 60, s * 60 + q
    back = F.col("l_orderkey") % 2 == 1
    return V.table(spark, sf, "lineitem").select(F.concat_ws(
        "\t", F.concat(F.lit("acc|x|c"), text(p % 50), F.lit("|"), text(p * 10), F.lit("-"), text(p * 10 + 300), F.lit("|t")),
        F.concat(F.lit("ref|NW_"), text(s % 50), F.lit(".1|")), F.lit("90.5"), text(q), F.lit("0"), F.lit("0"), F.lit("1"),
        text(q + 10), text(F.when(back, high).otherwise(low)), text(F.when(back, low).otherwise(high)), F.lit("1e-5"), F.lit("50"),
        F.lit("60"), F.lit("x")).alias("value"))


@check("s11_json_properties", """
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def s11(spark, sf):
    path = scratch_path(spark, "events")
    K.write_json(V.table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p")), path)
    back = R.read_json(spark, path, "event_type string, p struct<k bigint>", one_per_line=True)
    return back.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@check("s01_k03_fasta_round_trip", with_ctes("seqs", body="""
SELECT 'doc' || doc_id AS contig, length(seq) AS n, md5(seq) AS digest FROM seqs WHERE length(seq) >= 15"""))
def s01(spark, sf):
    path = scratch_path(spark, "fasta")
    K.write_fasta(V.seqs(spark, sf).withColumn("id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), path, min_len=15)
    return R.read_fasta_records(spark, path).select("contig", F.length("seq").alias("n"), F.md5("seq").alias("digest"))


@check("s01_s02_fasta_chunks", with_ctes("seqs", "features", body="""
SELECT 'doc' || doc_id AS contig, CAST(length(seq) AS BIGINT) AS n, md5(seq) AS digest FROM seqs WHERE length(seq) > 0 AND doc_id IN (SELECT contig FROM features WHERE ftype = 'CDS')"""))
def s02(spark, sf):
    path = scratch_path(spark, "genome")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" len="), F.length("seq").cast("string"))
    wrapped = F.rtrim(F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n"))
    K.write_fasta(V.seqs(spark, sf).select(name.alias("id"), wrapped.alias("seq")), path)
    genic = V.features(spark, sf).where(F.col("ftype") == "CDS").select(
        F.concat(F.lit("doc"), F.col("contig").cast("string")).alias("contig")).distinct()
    chunks = R.read_fasta_chunks(spark, path, 1024, genic)
    return chunks.groupBy("contig").agg(
        F.sum(F.length("seq")).alias("n"),
        F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("chunk_no", "seq")))["seq"], "")).alias("digest"))


@check("s07_s12_k01_k02_table_round_trip", """
SELECT 'GCF_' || o_custkey || '.1' AS acc, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders GROUP BY o_custkey""")
def s07(spark, sf):
    path = scratch_path(spark, "table")
    o = V.table(spark, sf, "orders").select(
        F.concat(F.lit("GCF_"), F.col("o_custkey").cast("string"), F.lit(".1")).alias("acc"),
        F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", "F").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("part"))
    K.write_table(o, path, ["acc", "price", "status", "missing", "part"], by=["part"])
    back = R.read_table(spark, path, "acc string, price double, status string, missing string, part string")
    return back.groupBy("acc").agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"),
        F.count_if(F.col("status") == "F").alias("n_f"))


@check("k04_nested_json", """
SELECT c_nationkey AS genome, c_mktsegment AS motif, count(*) AS n FROM customer GROUP BY ALL""")
def k04(spark, sf):
    path = scratch_path(spark, "json")
    counts = V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("genome"), F.col("c_mktsegment").alias("motif")).agg(F.count("*").alias("n"))
    K.write_json(counts.groupBy("genome").agg(F.collect_list(F.struct("motif", "n")).alias("motifs")), path)
    back = spark.read.json(path, schema="genome int, motifs array<struct<motif string, n bigint>>")
    return back.select("genome", F.inline("motifs"))


@check("k05_hits_report", """
SELECT acc, name, n FROM (SELECT c_custkey AS acc, c_name AS name, coalesce(n, 0) AS n FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey) WHERE n > 0 ORDER BY n DESC, acc""")
def k05(spark, sf):
    ledger = V.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("acc")).agg(
        F.count("*").alias("n"), F.lit("ok").alias("status"))
    catalog = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("acc"), F.col("c_name").alias("name"))
    report = P.catalog_report(catalog, ledger)
    return report.where(F.col("n") > 0).orderBy(F.desc("n"), "acc").select("acc", "name", "n")


# --- sorting and sets -------------------------------------------------------

@check("o01_o02_top_rows", with_ctes("tta_cov", body="""
SELECT doc_id, round(cov, 6) AS cov FROM tta_cov ORDER BY cov DESC, doc_id LIMIT 50"""))
def o01(spark, sf):
    s = V.seqs(spark, sf).select("doc_id", M.coverage(seq_col(), M.both_strands("TTAGGG")).alias("cov"))
    return K.capped(s, [F.desc("cov"), "doc_id"], 50).select("doc_id", F.round("cov", 6).alias("cov"))


@check("o02_o03_top_per_group", """
SELECT grp, id, cls, rnk AS rank FROM (SELECT o_custkey % 20 AS grp, o_orderkey AS id, o_orderstatus AS cls,
  row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rnk FROM orders) WHERE rnk <= 15""")
def o02(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("cls"), "o_totalprice")
    order = F.when(F.col("cls") == "P", 0).when(F.col("cls") == "F", 1).otherwise(2)
    return G.top_k(rows, ["grp"], [order, F.desc("o_totalprice"), F.asc("id")], 15).select("grp", "id", "cls", "rank")


@check("o04_tagged_union", """
SELECT 'seg' AS dataset, c_mktsegment AS name, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY ALL""")
def o04(spark, sf):
    from repeatloom.plans.mechanism import tagged
    both = tagged(seg=V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")),
                  type=V.table(spark, sf, "part").select(F.col("p_type").alias("name")))
    return both.groupBy("dataset", "name").agg(F.count("*").alias("n"))


@check("o05_kmer_sets", with_ctes("turns", extra="""
km AS (SELECT DISTINCT role, substring(seq, CAST(i AS BIGINT) + 1, 6) AS w FROM turns, unnest(range(length(seq) - 5)) r(i)),
a AS (SELECT w FROM km WHERE role = 'user'), b AS (SELECT w FROM km WHERE role = 'assistant')""", body="""
SELECT (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)) AS n_union, (SELECT count(*) FROM (SELECT w FROM a INTERSECT SELECT w FROM b)) AS n_both,
  (SELECT count(*) FROM (SELECT w FROM a EXCEPT SELECT w FROM b)) AS n_only_user"""))
def o05(spark, sf):
    from repeatloom.operators.kmers import kmer_list
    words = V.turns(spark, sf).select("role", F.explode(kmer_list(seq_col(), 6)).alias("w"))
    sides = words.groupBy("w").agg(F.max((F.col("role") == "user").cast("int")).alias("u"),
                                   F.max((F.col("role") == "assistant").cast("int")).alias("a"))
    u, a = F.col("u") == 1, F.col("a") == 1
    return sides.agg(F.count_if(u | a).alias("n_union"), F.count_if(u & a).alias("n_both"), F.count_if(u & ~a).alias("n_only_user"))


@check("o06_repeatable_examples", """
SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h, doc_id LIMIT 20""")
def o06(spark, sf):
    return K.capped(V.table(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h")), ["h", "doc_id"], 20)



