"""Grouped summaries.  All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions import scalars as S
from repeatloom.functions.motifs import COVERAGE_THRESHOLDS
from repeatloom.operators.ordered import attach_to_groups, running, value_bin


def upper_median(col: str) -> Column:
    """``sorted[n // 2]`` of whole numbers, not interpolated."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col} DESC)").cast("long")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group.

    Spark prunes each partition to k rows per group before it shuffles them.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def most_common(df: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """k most frequent values per group; the smaller value wins a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return top_k(counts, group, [F.desc("n"), F.asc(value)], k)


def threshold_counts(df: DataFrame, group: Sequence[str], cov: str = "telo_coverage") -> DataFrame:
    """Rows at or above each coverage threshold."""
    return df.groupBy(*group).agg(
        F.count("*").alias("n_total"),
        *[F.count_if(F.col(cov) >= t).alias(f"ge_{int(t * 100)}") for t in COVERAGE_THRESHOLDS])


def boundary_counts(df: DataFrame, genome: str = "genome") -> DataFrame:
    """Rows, GT…AG rows and inner-motif counts, long form.

    ``norm_seq`` and ``orientation`` come from the screen.  One row per genome,
    orientation, side and motif.
    """
    norm = F.col("norm_seq")
    sides = F.array(
        F.struct(F.lit("donor").alias("side"), S.inner_motif(norm, "donor").alias("motif")),
        F.struct(F.lit("acceptor").alias("side"), S.inner_motif(norm, "acceptor").alias("motif")))
    return (
        df.select(genome, "orientation", F.explode(sides).alias("_s"))
        .where(F.col("_s.motif").isNotNull())
        .groupBy(genome, "orientation", F.col("_s.side").alias("side"), F.col("_s.motif").alias("motif"))
        .agg(F.count("*").alias("n"))
    )


def boundary_totals(df: DataFrame, genome: str = "genome", fingerprint: str = "AACC") -> DataFrame:
    """Totals per genome and the share of one acceptor motif, by orientation too."""
    norm = F.col("norm_seq")
    acceptor = S.inner_motif(norm, "acceptor")
    orient = F.col("orientation")

    def share(extra: Column) -> Column:
        return F.round(
            F.try_divide(F.lit(100) * F.count_if((acceptor == fingerprint) & extra),
                         F.count_if(acceptor.isNotNull() & extra)), 1)

    kinds = ("template-strand", "coding-strand", "converging")
    return df.groupBy(genome).agg(
        F.count("*").alias("n_total"),
        F.count_if(S.starts_ends(norm, "GT", "AG")).alias("n_gt_ag"),
        share(F.lit(True)).alias("fingerprint_pct"),
        *[share(orient == k).alias("fingerprint_pct_" + k.split("-")[0]) for k in kinds],
        *[F.count_if(acceptor.isNotNull() & (orient == k)).alias("n_" + k.split("-")[0]) for k in kinds],
    )


def boundary_summary(df: DataFrame, genome: str = "genome", fingerprint: str = "AACC") -> DataFrame:
    """``boundary_totals`` with ``top_donor`` and ``top_acceptor``, the most common inner motifs (the smaller of equals).

    Rows are read once: they are counted per side and motif, and as a whole (side ``row``), and all else comes from
    these counts.  Rows without a genome have no top motifs.
    """
    norm, orient = F.col("norm_seq"), F.col("orientation")
    kinds = ("template-strand", "coding-strand", "converging")
    sides = F.array(
        F.struct(F.lit("row").alias("side"), F.lit(None).cast("string").alias("motif")),
        *[F.struct(F.lit(s).alias("side"), S.inner_motif(norm, s).alias("motif")) for s in ("donor", "acceptor")])
    rows = df.select(
        genome, "orientation", S.starts_ends(norm, "GT", "AG").alias("_gt_ag"), F.explode(sides).alias("_s"))
    side, motif = F.col("_s.side"), F.col("_s.motif")
    names = [k.split("-")[0] for k in kinds]
    counts = (
        rows.where((side == "row") | motif.isNotNull())
        .groupBy(genome, side.alias("side"), motif.alias("motif"))
        .agg(F.count("*").alias("n"), F.count_if("_gt_ag").alias("_gt_ag"),
             *[F.count_if(orient == k).alias(f"_{m}") for k, m in zip(kinds, names)]))
    ranked = counts.withColumn("_rank", F.row_number().over(
        Window.partitionBy(genome, "side").orderBy(F.desc("n"), F.asc("motif"))))

    def total(of: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0))

    inside = F.col("side") == "acceptor"

    def share(of: str) -> Column:
        return F.round(F.try_divide(
            F.lit(100) * total(of, inside & (F.col("motif") == fingerprint)), total(of, inside)), 1)

    def top(s: str) -> Column:
        first = (F.col("side") == s) & (F.col("_rank") == 1) & F.col(genome).isNotNull()
        return F.max(F.when(first, F.col("motif")))

    return ranked.groupBy(genome).agg(
        total("n", F.col("side") == "row").alias("n_total"), total("_gt_ag", F.col("side") == "row").alias("n_gt_ag"),
        share("n").alias("fingerprint_pct"),
        *[share(f"_{m}").alias(f"fingerprint_pct_{m}") for m in names],
        *[total(f"_{m}", inside).alias(f"n_{m}") for m in names],
        top("donor").alias("top_donor"), top("acceptor").alias("top_acceptor"))


def duplicate_counts(df: DataFrame, group: Sequence[str], seq: str, ids: Sequence[str]) -> DataFrame:
    """Adds how often the row's text occurs in its group.

    Counts are made per digest with map-side sums; only texts that occur more
    than once are joined back, over salts.
    """
    keyed = df.withColumn("_digest", F.sha2(F.upper(F.col(seq)), 256))
    many = (
        keyed.groupBy(*group, "_digest").agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1))
    return attach_to_groups(keyed, many, [*group, "_digest"], ids).withColumn(
        "copies", F.coalesce("copies", F.lit(1))).drop("_digest")


def class_pivot(df: DataFrame, rows: str, classes: str, values: Sequence[str]) -> DataFrame:
    """Counts with one column per class; the classes are named up front."""
    return df.groupBy(rows).agg(*[
        F.count_if(F.col(classes) == v).alias(v.lower().replace("-", "_")) for v in values])


def position_frequencies(df: DataFrame, seq: str, width: int = 40) -> DataFrame:
    """Share of each letter at each position over the rows that reach it."""
    letters = df.select(F.posexplode(F.split(F.col(seq), "")).alias("pos", "base")).where(
        (F.col("pos") < width) & (F.col("base") != ""))
    counts = letters.groupBy("pos", "base").agg(F.count("*").alias("n"))
    return counts.withColumn(
        "share", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def describe_lengths(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """Count, mean, interpolated median, both deviations and the extremes."""
    c = F.col(col)
    return df.groupBy(*group).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"),
        F.stddev_samp(c).alias("sd_sample"), F.stddev_pop(c).alias("sd_population"),
        F.min(c).alias("min"), F.max(c).alias("max"))


def average_rank(df: DataFrame, value: str, out: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank by value with ties at their mean rank, over the whole table or within groups.

    Ranks are running sums of counts per distinct value, in value bins.  There can
    be as many values as rows, so the join back is not salted: adaptive execution
    splits the partition of a frequent value.
    """
    keys = [*group, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = running(counts, group, value, "_n", "_upto", "sum", upto_self=True, bin_by=value_bin(df, value))
    ranks = placed.select(*keys, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, keys, "left")


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank correlation: the correlation of the mean ranks within each group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "_rx", group), y, "_ry", group)
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def adjusted_p_values(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini–Hochberg over the whole table.

    Per distinct p the rank is the number of tests up to it; the adjusted value is
    the smallest ``p * m / rank`` from there upwards, at most 1.
    """
    bins = value_bin(tests, p)
    counts = tests.groupBy(p).agg(F.count("*").alias("_n"))
    ranked = running(counts, [], p, "_n", "_rank", "sum", upto_self=True, bin_by=bins)
    total = counts.agg(F.sum("_n").alias("_m"))
    scaled = ranked.withColumn("_q", F.col(p) * total.scalar() / F.col("_rank"))
    stepped = running(scaled, [], p, "_q", "_min", "min", upto_self=True, from_top=True, bin_by=bins)
    adjusted = stepped.select(p, F.least(F.col("_min"), F.lit(1.0)).alias("adjusted"))
    return tests.join(adjusted, p, "left")


def first_component(df: DataFrame, columns: Sequence[str], out: str = "pc1") -> DataFrame:
    """Score of each row on the first principal component of the standardised columns."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_z").fit(vectors)
    scaled = scaler.transform(vectors)
    model = PCA(k=1, inputCol="_z", outputCol="_s").fit(scaled)
    return model.transform(scaled).withColumn(out, vector_to_array("_s")[0]).drop("_v", "_z", "_s")


def uniformity(df: DataFrame, phase: str, phases: int = 6) -> DataFrame:
    """Counts per phase, and chi-square against equal shares on one row."""
    per = df.groupBy(phase).agg(F.count("*").alias("n"))
    listed = per.agg(
        F.sum("n").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col(phase) == i, F.col("n"))), F.lit(0)).alias(f"phase_{i}")
          for i in range(phases)])
    expected = F.col("total") / phases
    terms = [F.pow(F.col(f"phase_{i}") - expected, 2) / expected for i in range(phases)]
    return listed.withColumn("chi_square", sum(terms[1:], terms[0]))


def enrichment(counts: DataFrame, group: Sequence[str], n: str = "n", states: int = 256) -> DataFrame:
    """Share of each motif and its ratio to the uniform share."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("_total"))
    return counts.join(total, list(group)).withColumn("share", F.col(n) / F.col("_total")).withColumn(
        "enrichment", F.col("share") * states).drop("_total")


def pair_distance(pairs: DataFrame) -> DataFrame:
    """Middle-to-middle distance and class of two placed intervals."""
    same = F.col("contig_a") == F.col("contig_b")
    middle = lambda side: (F.col(f"start_{side}") + F.col(f"end_{side}")) / 2
    return pairs.withColumns({
        "distance": F.when(same, F.abs(middle("a") - middle("b"))),
        "pair_class": F.when(F.col("shared"), "shared-linker").when(same, "same-contig-intergenic").otherwise(
            "cross-contig"),
    })


def end_distance(start: Column, end: Column, contig_len: Column) -> Column:
    """Distance of an interval to the nearer end of its contig."""
    return F.least(start, contig_len - end)


def every_nth(df: DataFrame, group: Sequence[str], order: Sequence[Column], step: int) -> DataFrame:
    """Every ``step``-th row of each group's order, from the first on."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where((F.col("_r") - 1) % step == 0).drop("_r")


def species_rollup(rows: DataFrame, classes: dict[str, str], species: str = "species") -> DataFrame:
    """Rows, mean length, distinct genes and orientation counts per species."""
    return rows.groupBy(species).agg(
        F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.count_distinct("gene").alias("n_genes"),
        *[F.count_if(F.col("orientation") == value).alias(name) for name, value in classes.items()])


def burden(genomes: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """Share of rows of interest per genome, rolled up over the taxonomy.

    A genome without rows has no share: it counts in ``n_genomes`` and ``prevalence`` only.
    """
    share = F.try_divide("telo", "total")
    return genomes.rollup(*taxa).agg(
        F.count("*").alias("n_genomes"), F.sum("telo").alias("telo"), F.sum("total").alias("total"),
        F.avg(share).alias("mean_burden"), F.percentile(share, F.lit(0.5)).alias("median_burden"),
        (F.percentile(share, F.lit(0.75)) - F.percentile(share, F.lit(0.25))).alias("iqr"),
        (F.count_if(F.col("telo") > 0) / F.count("*")).alias("prevalence"))
