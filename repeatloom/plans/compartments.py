"""Repeat density of coding, intron and intergenic sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.operators import intervals as I
from repeatloom.operators import sequences as Q
from repeatloom.operators.durable import stored
from repeatloom.operators.ordered import position_bin, previous_value, running


def compartments(
    features: DataFrame, genes: DataFrame, lengths: DataFrame, keys: Sequence[str] = ("contig",),
) -> DataFrame:
    """Merged intervals of each compartment, long form, inside their contig.

    Introns come from exons, or from CDS rows of transcripts without exons.
    """
    exons = I.prefer_exons(features, [*keys, "parent"])
    introns = stored(I.introns(exons, [*keys, "parent"], running=False).select(*keys, "start", "end").distinct(), "introns")
    cds = I.merge(features.where(F.col("ftype") == "CDS").select(*keys, "start", "end"), keys)
    introns_merged = I.merge(introns, keys)
    occupied = I.merge(genes.select(*keys, "start", "end").unionByName(introns), keys)
    free = I.complement(occupied, lengths, keys)
    rows = (
        cds.withColumn("compartment", F.lit("cds"))
        .unionByName(introns_merged.withColumn("compartment", F.lit("intron")))
        .unionByName(free.withColumn("compartment", F.lit("intergenic"))))
    return stored(rows.join(lengths, list(keys)).withColumns({
        "start": F.greatest(F.col("start"), F.lit(0)), "end": F.least(F.col("end"), F.col("contig_len")),
    }).where(F.col("end") > F.col("start")).drop("contig_len"), "compartments")


def compartment_density(
    intervals: DataFrame, chunks: DataFrame, group: Sequence[str], keys: Sequence[str] = ("contig",),
    window: int = 200, strict: bool = True, unit: str = "TTAGGG",
) -> DataFrame:
    """Bases, hits and dense windows per compartment, from a chunk table without overlap.

    ``strict`` takes hits only from intervals at least one window long, while the
    bases of all intervals count; otherwise all hits count.  A window is dense with two hits.  Neither hits nor windows are
    rows: stretches of neighbouring hits, and of neighbouring starts of dense windows, are numbered along the contig, and an
    interval's share is the difference between its ends.  The last windows of an interval don't see a hit that reaches
    over its end; they are counted from the last two hits inside.
    """
    kmers = M.both_strands(unit)
    k = len(unit)
    marks = stored(_marks(stored(Q.chunk_stretches(chunks, kmers, keys), "stretches"), window, keys), "marks")
    s, e = F.col("start"), F.col("end")
    last = e - window
    full = F.greatest(s, last - k + 2)
    ask = lambda kind, x, sign: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("pos"), F.lit(sign).alias("sign"))
    asked = F.when(last >= s, F.array(
        ask("hit", s, -1), ask("hit", e - k + 1, 1), ask("dense", s, -1), ask("dense", full, 1)))
    if not strict:
        asked = asked.when(e - s >= k, F.array(ask("hit", s, -1), ask("hit", e - k + 1, 1)))
    place = F.lit(None).cast(marks.schema["_in"].dataType)
    probes = intervals.select(*keys, *group, "compartment", "start", F.explode(asked).alias("_a")).select(
        *keys, *group, "compartment", "start", "_a.*", place.alias("_in"))
    # At one place a question comes first: it asks for what begins before.
    both = probes.unionByName(marks, allowMissingColumns=True).withColumn(
        "_at", F.struct("pos", F.col("sign").isNull().alias("mark"))).drop("pos")
    told = running(both, [*keys, "kind"], "_at", "_in", "_held", "max", bin_by=position_bin("_at.pos")).where(
        F.col("sign").isNotNull() & F.col("_held").isNotNull()).withColumn("pos", F.col("_at.pos"))
    held, hit = F.col("_held"), F.col("kind") == "hit"
    top = F.least(held["last"], F.col("pos") - 1)
    before = held["earlier"] + top - held["first"] + 1
    second = F.when(top > held["first"], top - 1).otherwise(held["prev"])
    # The last question about hits stands k - 1 before the interval's end, which need not be sent.
    last = F.col("pos") + k - 1 - window
    full = F.greatest(s, last - k + 2)
    cut_off = F.when(hit & (F.col("sign") == 1) & (last >= s) & second.isNotNull(), F.greatest(
        F.lit(0), F.least(second, last) - full + 1)).otherwise(0)
    shares = told.select(
        *group, "compartment", F.when(hit, F.col("sign") * before).otherwise(0).alias("_h"),
        (F.when(hit, 0).otherwise(F.col("sign") * before) + cut_off).alias("_d"))
    bp = e - s
    zero = F.lit(0).cast("long")
    return intervals.select(
        *group, "compartment", bp.alias("_bp"), F.greatest(bp - window + 1, F.lit(0)).alias("_w"),
        zero.alias("_h"), zero.alias("_d"),
    ).unionByName(shares.withColumns({"_bp": zero, "_w": zero})).groupBy(*group, "compartment").agg(
        F.sum("_bp").alias("bp"), F.sum("_h").alias("telo_kmers"), F.sum("_d").alias("telo_windows"),
        F.sum("_w").alias("total_windows"))


def _marks(stretches: DataFrame, window: int, keys: Sequence[str]) -> DataFrame:
    """Stretches ``pos, last`` of hits, and of starts of windows with two hits, with the number of places before each.

    The windows whose first hit is the stretch's first one begin behind the stretch before and reach its second hit; the
    others of a stretch are dense as they stand, its last one if the next stretch is in reach.
    """
    near = running(previous_value(stretches, keys, "pos", "last", "_prev"), keys, "pos", "pos", "_next", "min", from_top=True)
    pos, last = F.col("pos"), F.col("last")
    reaches = F.coalesce(F.col("_next") <= last + window - 1, F.lit(False))
    second = F.when(last > pos, pos + 1).otherwise(F.col("_next"))
    low = F.greatest(F.col("_prev") + 1, second - window + 1)
    high = F.when(reaches, last).otherwise(last - 1)
    sized = near.withColumns({"_low": low, "_high": high}).withColumn("_n", last - pos + 1).withColumn(
        "_m", F.when(second.isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("_high") - F.col("_low") + 1)).otherwise(0))
    hits = running(sized, keys, "pos", "_n", "_n_before", "sum")
    both = running(hits, keys, "pos", "_m", "_m_before", "sum")
    mark = lambda kind, first, end, earlier, prev: F.struct(
        F.lit(kind).alias("kind"), F.col(first).alias("pos"), F.struct(
            F.col(first).alias("first"), F.col(end).alias("last"), F.col(earlier).cast("long").alias("earlier"),
            prev.cast("long").alias("prev")).alias("_in"))
    return both.select(*keys, F.explode(F.array_compact(F.array(
        mark("hit", "pos", "last", "_n_before", F.col("_prev")),
        F.when(F.col("_m") > 0, mark("dense", "_low", "_high", "_m_before", F.lit(None)))))).alias("_k")).select(*keys, "_k.*")


def density_ratios(density: DataFrame, group: Sequence[str]) -> DataFrame:
    """Density per megabase of each compartment and their ratios.

    Infinite where the divisor is 0; null where a compartment has no bases.
    """
    per = density.withColumn("d", F.try_divide(F.col("telo_kmers") * 1e6, F.col("bp")))
    wide = per.groupBy(*group).agg(*[
        F.max(F.when(F.col("compartment") == c, F.col("d"))).alias(c) for c in ("cds", "intron", "intergenic")])

    def ratio(a: str, b: str):
        return F.when(F.col(b) == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col(a), F.col(b)))

    return wide.withColumns({
        "intron_to_cds": ratio("intron", "cds"), "intergenic_to_cds": ratio("intergenic", "cds"),
        "intron_to_intergenic": ratio("intron", "intergenic")})
