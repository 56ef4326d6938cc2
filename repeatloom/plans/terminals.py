"""Leaders and trailers of repeat arrays: composition, statistics, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import scalars as S
from repeatloom.operators import arrays as A
from repeatloom.operators import summaries as G
from repeatloom.operators.durable import once


def terminal_table(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per sequence and side with length, composition and motif counts."""
    told = A.with_terminals(rows).where(F.col("array_start").isNotNull())
    sides = F.array(
        F.struct(F.lit("leader").alias("side"), F.col("leader").alias("text")),
        F.struct(F.lit("trailer").alias("side"), F.col("trailer").alias("text")))
    long = told.select(*ids, "purity", "copies", F.explode(sides).alias("_s")).select(*ids, "purity", "copies", "_s.*")
    text = F.col("text")
    return once(
        long, text_len=F.length(text), n_branch=S.branch_points(text), n_tracts=S.pyrimidine_tracts(text),
        **{f"share_{b.lower()}": S.letter_share(text, b) for b in "ACGT"})


def terminal_statistics(table: DataFrame, group: Sequence[str] = ("side",)) -> DataFrame:
    """Length statistics with both deviations, and means of the rest; empty texts go."""
    kept = table.where(F.col("text_len") > 0)
    means = [F.avg(c).alias("mean_" + c) for c in
             ("n_branch", "n_tracts", "share_a", "share_c", "share_g", "share_t")]
    stats = G.describe_lengths(kept, group, "text_len")
    return stats.join(kept.groupBy(*group).agg(*means), list(group))


def terminal_correlations(rows: DataFrame) -> DataFrame:
    """Pearson correlations of leader length, trailer length and purity."""
    told = A.with_terminals(rows).where(F.col("array_start").isNotNull()).select(
        F.length("leader").alias("l"), F.length("trailer").alias("t"), "purity")
    return told.agg(
        F.corr("l", "t").alias("leader_trailer"), F.corr("l", "purity").alias("leader_purity"),
        F.corr("t", "purity").alias("trailer_purity"))
