"""Interval operators: introns, merges, complements, joins by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.operators.durable import cut, stored
from repeatloom.operators.ordered import position_bin, previous_max, previous_value, running

# --- fixed values -----------------------------------------------------------
INTRON_MIN, INTRON_MAX, INTRON_MAX_HUMAN = 20, 100_000, 500_000
KNOWN_SLACK, SELF_SLACK, TOLERANCE = 50, 200, 2
SUBTELOMERE = 5000
# ---------------------------------------------------------------------------


def introns(
    features: DataFrame, keys: Sequence[str] = ("contig", "parent"), running: bool = True,
) -> DataFrame:
    """Gaps between consecutive features of one parent.

    ``running=True`` starts a gap at the furthest end seen so far.  With
    ``False`` it starts at the end of the row before in (start, end) order, so a
    feature nested in a longer one yields a gap at its own end.  Features with
    the same start cannot have a gap between them, hence the first aggregation:
    it is exact, combines on the map side and bounds what a bin can hold.
    """
    starts = features.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    step = previous_max if running else previous_value
    return (
        step(starts, keys, "start", "end", "gap_start")
        .where(F.col("gap_start") < F.col("start"))
        .select(*keys, F.col("gap_start").alias("start"), F.col("start").alias("end"))
        .withColumn("length", F.col("end") - F.col("start"))
    )


def prefer_exons(features: DataFrame, keys: Sequence[str] = ("contig", "parent")) -> DataFrame:
    """Exon rows, and CDS rows of parents that have no exon; distinct intervals."""
    typed = features.where(F.col("ftype").isin("exon", "CDS"))
    per_parent = typed.groupBy(*keys, "start", "end").agg(
        F.max((F.col("ftype") == "exon").cast("int")).alias("is_exon"))
    has_exon = (
        typed.where(F.col("ftype") == "exon").select(*keys).distinct().withColumn("has", F.lit(1)))
    return (
        per_parent.join(has_exon, list(keys), "left")
        .where((F.col("is_exon") == 1) | F.col("has").isNull())
        .select(*keys, "start", "end")
    )


def first_per_interval(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in the given order.

    An aggregate, not a window: copies of one interval combine before the
    shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")


def merge(intervals: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Union of overlapping or touching intervals per key.

    The first pass is written to the shared folder, by column: the second one reads it twice, and without that the plan
    would double with each pass.
    """
    starts = (
        intervals.where(F.col("end") > F.col("start"))
        .groupBy(*keys, "start").agg(F.max("end").alias("end")))
    seen = previous_max(starts, keys, "start", "end", "_seen")
    opened = stored(seen.withColumn(
        "_open", F.when(F.col("_seen").isNull() | (F.col("start") > F.col("_seen")), F.col("start"))).drop("_seen"), "opened")
    carried = previous_max(opened, keys, "start", "_open", "_before")
    return (
        carried.withColumn("_island", F.coalesce("_open", "_before"))
        .groupBy(*keys, F.col("_island").alias("start")).agg(F.max("end").alias("end"))
    )


def complement(
    merged: DataFrame, lengths: DataFrame, keys: Sequence[str] = ("contig",), only_listed: bool = True,
) -> DataFrame:
    """What merged intervals leave free of ``[0, contig_len)``.

    ``lengths`` holds one ``contig_len`` per key.  With ``only_listed`` keys
    without any interval give nothing; otherwise they are free as a whole.
    """
    placed = stored(merged.join(lengths, list(keys)), "placed")
    inner = placed.where(F.col("start") < F.col("contig_len"))
    walls = previous_value(inner, keys, "start", "end", "_end")
    between = walls.select(
        *keys, F.coalesce("_end", F.lit(0)).alias("free_start"), F.col("start").alias("free_end"))
    tails = inner.groupBy(*keys).agg(
        F.max("end").alias("free_start"), F.max("contig_len").alias("free_end"))
    free = between.unionByName(tails)
    if only_listed:
        untouched = placed.groupBy(*keys).agg(
            F.max("contig_len").alias("contig_len"), F.min("start").alias("_first")).where(
                F.col("_first") >= F.col("contig_len"))
    else:
        untouched = lengths.join(inner.select(*keys).distinct(), list(keys), "left_anti")
    whole = untouched.select(
        *keys, F.lit(0).alias("free_start"), F.col("contig_len").alias("free_end"))
    return (
        free.unionByName(whole)
        .where(F.col("free_end") > F.col("free_start"))
        .select(*keys, F.col("free_start").alias("start"), F.col("free_end").alias("end"))
    )


# --- joins by position ------------------------------------------------------

def _bins(start: Column, end: Column, width: int) -> Column:
    last = F.greatest(start, end - 1)
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(last / width).cast("long")))


def within_tolerance(
    introns_df: DataFrame, targets: DataFrame, keys: Sequence[str] = ("contig",), tol: int = TOLERANCE,
) -> DataFrame:
    """Introns whose both ends lie within ``tol`` of a target's.

    ``targets`` has ``t_start, t_end``.  Both tables meet in cells of both ends, by an equi-join: an intron lies in one,
    a target reaches one or two along each end, so few rows are made more of.
    """
    width = max(64, 8 * tol)
    cell = lambda x: F.floor(x / width).cast("long")
    reach = lambda x: F.explode(F.sequence(cell(F.col(x) - tol), cell(F.col(x) + tol)))
    wanted = targets.withColumn("_s", reach("t_start")).withColumn("_e", reach("t_end"))
    near = lambda x: F.abs(F.col(x) - F.col(f"t_{x}")) <= tol
    return introns_df.withColumns({"_s": cell(F.col("start")), "_e": cell(F.col("end"))}).join(
        wanted, [*keys, "_s", "_e"]).where(near("start") & near("end")).drop("_s", "_e")


def _next_at(points: DataFrame, keys: Sequence[str], probes: DataFrame, value: str, out: str) -> DataFrame:
    """For each distinct ``x`` of ``probes``, the ``value`` of the first point at or behind it.

    ``points`` has one row per ``x`` and key.  Both sides are put in one order and
    walked from the top, so the cost is linear in both.
    """
    kind = dict(points.dtypes)[value]
    both = points.select(*keys, "x", F.lit(1).alias("_tag"), value).unionByName(
        probes.select(*keys, "x").distinct().select(
            *keys, "x", F.lit(0).alias("_tag"), F.lit(None).cast(kind).alias(value)))
    walked = running(
        both.withColumn("_at", F.struct("x", "_tag")), keys, "_at", value, out, "min", from_top=True,
        bin_by=position_bin("x"))
    return walked.where("_tag = 0").select(*keys, "x", out)


def first_container(
    inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("contig",), slack: int = 0,
) -> DataFrame:
    """First outer interval, by (start, end), that contains each inner one, with slack at the ends.

    ``inner`` has ``start, end``; ``outer`` has ``o_start, o_end``.  The container of
    smallest start ends further than all that start earlier (else one of those
    would come first), and among such intervals both ends grow: the one sought is
    the first that ends far enough.  A second walk over the intervals of that start
    finds the smallest end.  No pairs are made, however many intervals nest.  Both
    sides and the first walk's result are written to the shared folder, since the walks read them several times.
    """
    probes = cut(inner.select(*keys, "start", "end").distinct().withColumn("x", F.col("end") - slack))
    walls = cut(outer.select(*keys, "o_start", "o_end").distinct())
    starts = walls.groupBy(*keys, "o_start").agg(F.max("o_end").alias("x"))
    records = previous_max(starts, keys, "o_start", "x", "_seen").where(
        F.col("_seen").isNull() | (F.col("x") > F.col("_seen")))
    by_end = _next_at(records.withColumn("_s", F.struct("x", "o_start")), keys, probes, "_s", "_first")
    begun = cut(
        probes.join(by_end, [*keys, "x"]).where(F.col("_first.o_start") <= F.col("start") + slack)
        .select(*keys, "start", "end", "x", F.col("_first.o_start").alias("o_start")))
    ends = walls.select(*keys, "o_start", F.col("o_end").alias("x"), "o_end")
    by_start = _next_at(ends, [*keys, "o_start"], begun, "o_end", "_end")
    found = begun.join(by_start, [*keys, "o_start", "x"]).select(
        *keys, "start", "end", "o_start", F.col("_end").alias("o_end"))
    return inner.join(found, [*keys, "start", "end"], "left")


_LEAF, _RADIX, _LEVELS = 64, 4, 13


def covering_label(
    points: DataFrame, intervals: DataFrame, label: str, out: str, keys: Sequence[str] = ("contig",),
    closed: bool = False,
) -> DataFrame:
    """Smallest ``label`` among the intervals that cover each point; null if none.

    Positions fall into leaves of 64.  The whole leaves of an interval are tiled
    with blocks of 64, 256, 1024 … positions, and each block keeps one label, the
    smallest.  The ragged ends lie in at most two leaves, and equal ends in a leaf
    become one row.  A point looks up the one block per size it lies in and the
    ends in its leaf.  Whatever the depth of coverage, a leaf holds no more than
    64 places and 2,080 ends, so the cost stays linear in both tables.

    All joins are merge joins by hint: the planner's estimate does not see that points are multiplied, and would send
    them through the driver.  Points look no higher than the largest block size there is.  The distinct intervals are
    written to the shared folder, since blocks, ends and that size are three readers.
    """
    places = points.select(*keys, F.col("pos").cast("long").alias("pos")).distinct()
    return points.hint("merge").join(_covering(places, intervals, label, out, keys, closed), [*keys, "pos"], "left")


def _covering(
    places: DataFrame, intervals: DataFrame, label: str, out: str, keys: Sequence[str], closed: bool = False,
) -> DataFrame:
    """Smallest label per covered place; ``places`` are distinct."""
    spans = stored(
        intervals.select(
            *keys, F.col("start").cast("long").alias("start"),
            (F.col("end") + (1 if closed else 0)).cast("long").alias("end"), F.col(label).alias("_label"))
        .where(F.col("end") > F.col("start"))
        .groupBy(*keys, "start", "end").agg(F.min("_label").alias("_label")), "spans")
    start, end = F.col("start"), F.col("end")
    low = (F.ceil(start / _LEAF) * _LEAF).cast("long")
    high = (F.floor(end / _LEAF) * _LEAF).cast("long")

    def piece(a: Column, b: Column, there: Column) -> Column:
        return F.when(there, F.struct(
            F.floor(a / _LEAF).cast("long").alias("leaf"), a.alias("start"), b.alias("end")))

    ragged = F.array_compact(F.array(
        piece(start, F.least(low, end), start < low), piece(high, end, (high < end) & (high >= low))))
    ends = (
        spans.select(*keys, "_label", F.explode(ragged).alias("_e"))
        .groupBy(*keys, F.col("_e.leaf").alias("_leaf"), F.col("_e.start").alias("_s"), F.col("_e.end").alias("_t"))
        .agg(F.min("_label").alias("_label")))
    blocks = (
        spans.where(low < high).select(*keys, "_label", F.explode(_tiles(low, high)).alias("_b"))
        .groupBy(*keys, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
        .agg(F.min("_label").alias("_label")))
    pos = F.col("pos")
    longest = spans.agg(F.max(end - start)).scalar()
    probes = places.withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(j).alias("level"), F.lit(_LEAF * _RADIX ** j).cast("long").alias("size"))
        for j in range(_LEVELS)]))).where(F.col("_p.size") <= longest).select(
            *keys, "pos", F.col("_p.level").alias("_level"), F.floor(pos / F.col("_p.size")).cast("long").alias("_block"))
    inner = probes.hint("merge").join(blocks, [*keys, "_level", "_block"]).select(*keys, "pos", "_label")
    outer = (
        places.withColumn("_leaf", F.floor(pos / _LEAF).cast("long"))
        .hint("merge").join(ends, [*keys, "_leaf"]).where((F.col("_s") <= pos) & (pos < F.col("_t")))
        .select(*keys, "pos", "_label"))
    return inner.unionByName(outer).groupBy(*keys, "pos").agg(F.min("_label").alias(out))


def _tiles(low: Column, high: Column) -> Column:
    """Blocks of growing size that tile ``[low, high)`` of whole leaves exactly.

    On each level the aligned part reaches from the first multiple of the size to
    the last one.  A level emits what lies outside the aligned part of the next
    level, or all of its own if the next one has none.
    """
    up = lambda s: (F.ceil(low / s) * s).cast("long")
    down = lambda s: (F.floor(high / s) * s).cast("long")
    none = F.array().cast("array<bigint>")

    def blocks(a: Column, b: Column, size: Column) -> Column:
        return F.when(b > a, F.sequence((a / size).cast("long"), (b / size).cast("long") - 1)).otherwise(none)

    def level(size: Column, j: Column) -> Column:
        bigger = size * _RADIX
        nested = up(bigger) < down(bigger)
        mine = F.when(nested, F.concat(
            blocks(up(size), up(bigger), size), blocks(down(bigger), down(size), size))
        ).otherwise(blocks(up(size), down(size), size))
        return F.transform(mine, lambda x: F.struct(j.alias("level"), x.alias("block")))

    sizes = F.filter(
        F.array(*[F.lit(_LEAF * _RADIX ** j).cast("long") for j in range(_LEVELS)]), lambda s: s <= high - low)
    return F.flatten(F.transform(sizes, level))


def on_keys_of(rows: DataFrame, others: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Rows whose keys occur in ``others``; for intervals that only points of a few contigs will ask for.

    The distinct keys are written to the shared folder, so the planner knows their size when it picks the join.
    """
    return rows.join(stored(others.select(*keys).distinct(), "keys"), list(keys), "left_semi")


def annotate_points(
    points: DataFrame, targets: DataFrame, intron_rows: DataFrame, exon_rows: DataFrame,
    keys: Sequence[str] = ("contig",),
) -> DataFrame:
    """Where each point lies: in a target, an intron, an exon, or between genes.

    The distinct places are written to the shared folder; all three labels are looked up from there, so the points
    themselves are read twice however they are made.
    """
    places = stored(points.select(*keys, F.col("pos").cast("long").alias("pos")).distinct(), "places")
    told = points
    for rows, label, out in (
            (targets, "name", "in_target"), (intron_rows, "gene", "in_intron_of"), (exon_rows, "gene", "in_exon_of")):
        told = told.hint("merge").join(_covering(places, rows, label, out, keys), [*keys, "pos"], "left")
    return told.withColumn(
        "place",
        F.when(F.col("in_target").isNotNull(), "in_target")
        .when(F.col("in_intron_of").isNotNull(), "in_intron")
        .when(F.col("in_exon_of").isNotNull(), "in_exon")
        .otherwise("intergenic"),
    ).withColumn(
        "gene",
        F.when(F.col("place") == "in_intron", F.col("in_intron_of"))
        .when(F.col("place") == "in_exon", F.col("in_exon_of")),
    )


def parent_chain(exons: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """exon → transcript → gene.  Exons of unlisted transcripts are dropped.

    A gene that is not listed shows as '?'.
    """
    names = genes.select("gene_id", "gene_name", "gene_biotype")
    return (
        exons.join(transcripts.select(F.col("transcript_id").alias("parent"), "gene_id"), "parent")
        .join(names, "gene_id", "left")
        .fillna("?", ["gene_name", "gene_biotype"])
    )


# --- ranks within a transcript and along a contig ---------------------------

def _in_order(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct intervals with their unique sort position, the pair (start, end)."""
    return intervals.select(*keys, "start", "end").distinct().withColumn("_at", F.struct("start", "end"))


def exon_ranks(exons: DataFrame, keys: Sequence[str] = ("contig", "parent")) -> DataFrame:
    """Introns with their index, exon counts and neighbour exon sizes.

    Exons are made distinct first; index and neighbours follow (start, end).
    Both, and the number of exons, come from one exchange by key and position
    bin: the last row of a bin tells what the following bins need.
    """
    bins = F.coalesce(position_bin("start"), F.lit(-1 << 62))
    d = exons.select(*keys, "start", "end").distinct().withColumn("_bin", bins).repartition(*keys, "_bin")
    inside = Window.partitionBy(*keys, "_bin").orderBy("start", "end")
    me = F.struct("start", "end")
    local = d.withColumns({
        "_rank": F.row_number().over(inside), "_prev": F.lag(me).over(inside),
        "_last": F.lead(F.lit(1)).over(inside).isNull()})
    every = Window.partitionBy(*keys)
    across = every.orderBy("_bin")
    carry = local.where("_last").select(*keys, "_bin", F.col("_rank").alias("_n"), me.alias("_tail")).select(
        *keys, "_bin", F.lag("_tail").over(across).alias("_before"), F.sum("_n").over(every).alias("n_exons"),
        F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_upto"))
    before = local.join(carry, [*keys, "_bin"]).withColumns({
        "rank": F.col("_rank") + F.coalesce("_upto", F.lit(0)), "prev": F.coalesce("_prev", "_before")})
    return (
        before.where(F.col("prev").isNotNull())
        .select(
            *keys,
            F.col("prev.end").alias("start"), F.col("start").alias("end"),
            (F.col("rank") - 2).alias("exon_index"), "n_exons",
            (F.col("n_exons") - 1).alias("n_introns"),
            (F.col("prev.end") - F.col("prev.start")).alias("prev_exon_len"),
            (F.col("end") - F.col("start")).alias("next_exon_len"),
            F.col("prev.start").alias("prev_exon_start"), F.col("end").alias("next_exon_end"),
        )
    )


def exon_sizes(exons: DataFrame, keys: Sequence[str] = ("contig", "parent")) -> DataFrame:
    """All exon sizes of a transcript in (start, end) order: one row per distinct exon, numbered from 0.

    Rows instead of one list per transcript, which nothing bounds.
    """
    ranked = running(
        _in_order(exons, keys).withColumn("one", F.lit(1)), keys, "_at", "one", "_rank", "sum", upto_self=True,
        bin_by=position_bin("start"))
    return ranked.select(*keys, (F.col("_rank") - 1).alias("exon_index"), (F.col("end") - F.col("start")).alias("exon_len"))


def neighbour_gaps(intervals: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Distance from each distinct interval to the one before on its contig."""
    d = _in_order(intervals, keys)
    return (
        previous_value(d, keys, "_at", "end", "prev_end", position_bin("start")).drop("_at")
        .withColumn("gap", F.col("start") - F.col("prev_end"))
    )


def tandem_clusters(
    intervals: DataFrame, keys: Sequence[str] = ("contig",), sizes: tuple[int, int] = (3, 5),
    max_gap: int = 1000,
) -> DataFrame:
    """Contigs with a few members that all follow each other closely."""
    gap = F.col("gap")
    return (
        neighbour_gaps(intervals, keys).groupBy(*keys)
        .agg(
            F.count("*").alias("n_members"),
            F.sum(gap).alias("total_gap"),
            F.min(F.coalesce(gap.between(0, max_gap), F.lit(True))).alias("_close"),
        )
        .where(F.col("_close") & F.col("n_members").between(*sizes))
        .drop("_close")
    )


def sliding_windows(
    lengths: DataFrame, keys: Sequence[str] = ("contig",), size: int = 5000, step: int = 2500,
) -> DataFrame:
    """Window grid ``[start, start+size)`` clipped to the contig."""
    return lengths.withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("contig_len") - 1), F.lit(step)))
    ).select(
        *keys, F.col("start").alias("w_start"),
        F.least(F.col("start") + size, F.col("contig_len")).alias("w_end"))


def _touched_windows(start: Column, end: Column, size: int, step: int) -> Column:
    """Grid starts of all windows an interval overlaps."""
    lowest = F.greatest(F.lit(0), F.floor((start - size) / step).cast("long") + 1)
    highest = F.floor((end - 1) / step).cast("long")
    return F.explode(F.transform(F.sequence(lowest, highest), lambda x: x * step))


def window_landscape(
    lengths: DataFrame, merged_cds: DataFrame, intron_rows: DataFrame, hits: DataFrame,
    keys: Sequence[str] = ("contig",), size: int = 5000, step: int = 2500,
) -> DataFrame:
    """CDS share, intron count and motif density per sliding window.

    Features are sent to the few grid windows they touch and summed there, so
    the join with the grid is an equi-join on (key, window start).  ``hits`` has
    stretches of neighbouring hit starts, ``pos`` to ``last``.
    """
    grid = sliding_windows(lengths, keys, size, step)
    by = [*keys, "w_start"]
    s, e, w = F.col("start"), F.col("end"), F.col("w_start")
    cds = (
        merged_cds.withColumn("w_start", _touched_windows(s, e, size, step))
        .groupBy(*by).agg(F.sum(F.least(e, w + size) - F.greatest(s, w)).alias("cds_bp")))
    intr = (
        intron_rows.withColumn("w_start", _touched_windows(s, e, size, step))
        .groupBy(*by).agg(F.count("*").alias("n_introns")))
    pos, behind = F.col("pos"), F.col("last") + 1
    mot = (
        hits.withColumn("w_start", _touched_windows(pos, behind, size, step))
        .groupBy(*by).agg(F.sum(F.least(behind, w + size) - F.greatest(pos, w)).alias("n_hits")))
    width = F.col("w_end") - F.col("w_start")
    return (
        grid.join(cds, by, "left").join(intr, by, "left").join(mot, by, "left")
        .fillna(0, ["cds_bp", "n_introns", "n_hits"])
        .withColumn("cds_share", F.least(F.col("cds_bp"), width) / width)
        .withColumn("hits_per_kb", F.col("n_hits") * 1000 / width)
    )


def ortholog_presence(rows: DataFrame, free: DataFrame) -> DataFrame:
    """Per ortholog: rows, genomes, and rows with an intron-free locus elsewhere."""
    loci = free.select("ortholog").distinct().withColumn("_free", F.lit(1))
    counted = rows.groupBy("ortholog").agg(
        F.count("*").alias("n_present"), F.count_distinct("genome").alias("n_genomes"))
    return counted.join(loci, "ortholog", "left").select(
        "ortholog", "n_present", "n_genomes",
        F.when(F.col("_free") == 1, F.col("n_present")).otherwise(0).alias("n_with_free_locus"))
