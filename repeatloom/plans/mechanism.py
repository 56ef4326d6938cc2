"""Mechanism battery: arrays, linkers, junctions and half sites per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.operators import arrays as A
from repeatloom.operators import summaries as G
from repeatloom.operators.durable import once


def tagged(**datasets: DataFrame) -> DataFrame:
    """Union of datasets with their name in ``dataset``."""
    parts = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def battery(records: DataFrame) -> DataFrame:
    """All measures of records ``seq, left, right``; rows without a family go."""
    runs = A.with_strand_runs(records.where(F.length("seq") > 0)).where(F.col("family").isNotNull())
    told = A.with_variant_signal(A.with_orientation(runs))
    variants = F.col("family") == "TTAGGG"
    share = lambda c: F.when(variants & (F.col("n_windows") > 0), F.col(c) / F.col("n_windows")).when(
        variants, F.lit(0.0))
    fam = F.col("family")
    return once(
        told,
        tsd_len=S.target_site_duplication(F.col("left"), F.col("right")),
        mh_5p=S.microhomology_by_family(F.col("left"), fam, M.MECHANISM_FAMILIES, "5p"),
        mh_3p=S.microhomology_by_family(F.col("right"), fam, M.MECHANISM_FAMILIES, "3p"),
        sites=A.half_site_pairs(F.concat("left", "right")),
        linker_gc=S.gc_share(F.col("linker")),
        canonical_frac=share("n_canonical"), variant_frac=share("n_variant"), tti_frac=share("n_receptor"),
    ).withColumns({
        "tsd_seq": F.right(F.col("left"), F.col("tsd_len")),
        "halfsites": F.col("sites.n_fwd") + F.col("sites.n_rev"),
        "direct_repeats": F.col("sites.direct"), "inverted_repeats": F.col("sites.inverted"),
    }).drop("fwd_runs", "rev_runs", "sites", "n_windows")


def class_statistics(measured: DataFrame, group: Sequence[str] = ("classification",)) -> DataFrame:
    """Per-class means and rates; the linker median is the upper one."""
    tsd = F.col("tsd_len") >= 3
    return measured.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.min("linker_len").alias("linker_min"), F.max("linker_len").alias("linker_max"),
        G.upper_median("linker_len").alias("linker_median"),
        F.count_if(F.col("linker_len").between(5, 30)).alias("linker_5_30"),
        F.count_if((F.col("linker_len") > 30) & (F.col("linker_len") <= 120)).alias("linker_30_120"),
        F.count_if(F.col("linker_len") > 120).alias("linker_120_up"),
        F.count_if(tsd).alias("n_tsd"), F.avg(F.when(tsd, F.col("tsd_len"))).alias("tsd_mean"),
        F.avg("halfsites").alias("halfsite_mean"), F.count_if(F.col("halfsites") > 0).alias("n_halfsite"),
        F.avg("variant_frac").alias("variant_mean"), F.avg("tti_frac").alias("tti_mean"),
        F.avg("mh_5p").alias("mh_5p_mean"), F.avg("mh_3p").alias("mh_3p_mean"))


def lineage_comparison(records: DataFrame, group: str = "dataset") -> DataFrame:
    """Orientation counts, linker purity and palindromes per dataset.

    A strand counts as soon as it has a run.
    """
    told = A.with_orientation(A.with_strand_runs(records.where(F.length("seq") > 0)), min_share=0.0).where(
        F.col("family").isNotNull())
    marked = A.with_purity_class(told, seq="linker")
    checked = once(marked, palindrome=S.palindrome_identity(F.col("linker")), gc=S.gc_share(F.col("linker")))
    c, n = F.col("classification"), F.col("linker_len")
    linked = c.endswith("_WITHLINKER")
    return checked.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if(c.startswith("CONVERGING")).alias("n_converging"),
        F.count_if(c.startswith("DIVERGING")).alias("n_diverging"),
        F.try_divide(F.count_if(c.startswith("CONVERGING")), F.count_if(c.startswith("DIVERGING"))).alias("ratio"),
        F.count_if(linked).alias("n_linked"),
        F.count_if(linked & (F.col("purity") == "none")).alias("n_pure"),
        F.count_if(linked & (n >= 5) & (n < 30)).alias("short"),
        F.count_if(linked & (n >= 30) & (n < 120)).alias("medium"),
        F.count_if(linked & (n >= 120)).alias("long"),
        F.avg(F.when(linked, F.col("gc"))).alias("linker_gc"),
        F.count_if(linked & (n >= 30) & (F.col("palindrome") >= 0.7)).alias("n_palindromic"))
