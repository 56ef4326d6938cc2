"""Repeat families and the column expressions that scan sequences for them.

Two ways of scanning are used, both linear in the sequence length:

* ``regexp_*`` with a prefix-factored alternation of the motifs, for counts and
  for motif sets that ``scans`` does not take;
* ``scans``: a table lookup per letter on Arrow batches, for covered bases, hit
  positions and runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import scans

# --- fixed values -----------------------------------------------------------
# Repeat units and their list order.  The order decides ties between families.
SURVEY_FAMILIES = ("TTAGGG", "TTTAGGG", "TTGGGG", "TTTGGG", "TTAGG", "TTTTAGGG")
RESCREEN_FAMILIES = (
    "TTAGGG", "TTTAGGG", "TTTGGG", "TTGGGG", "TTAGG", "TTTTAGGG", "TTAGGC",
)
MECHANISM_FAMILIES = ("TTAGGG", "TTTAGGG", "TTAGG", "TTTGGG", "TTGGGG")
REPEAT_FINDER_FAMILIES = (
    "TTAGGG", "TTTAGGG", "TTTTAGGG", "TTTGGG", "TTGGGG", "TTTGGGG", "TTTTGGGG",
    "TTAGG", "TTAGGC", "TAGGG", "TTCAGG", "TTGGG", "TTTTTTAGGG",
)
# Hexamer variants that mark receptor-bound telomeres, forward strand.
RECEPTOR_VARIANTS = ("TCAGGG", "TGAGGG", "GTAGGG", "TTGGGG", "TTCGGG", "CTAGGG")
# Nuclear-receptor half site.
HALF_SITE = "GGGTCA"
COVERAGE_THRESHOLDS = (0.10, 0.30, 0.50, 0.70, 0.85, 0.95)
MIN_RUN_BP = 10
# ---------------------------------------------------------------------------

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc_text(unit: str) -> str:
    """Reverse complement of a literal motif."""
    return unit.translate(_COMPLEMENT)[::-1]


def rotations(unit: str) -> list[str]:
    """Distinct rotations of a literal motif, in rotation order."""
    doubled = unit + unit
    return list(dict.fromkeys(doubled[i:i + len(unit)] for i in range(len(unit))))


def forward(unit: str) -> list[str]:
    return rotations(unit)


def backward(unit: str) -> list[str]:
    return rotations(rc_text(unit))


def both_strands(unit: str) -> list[str]:
    return list(dict.fromkeys(forward(unit) + backward(unit)))


def one_mismatch(kmers: Iterable[str]) -> list[str]:
    """Patterns for "at most one substitution": one position is left open."""
    return sorted({m[:i] + "." + m[i + 1:] for m in kmers for i in range(len(m))})


def alternation(kmers: Iterable[str]) -> str:
    """Regular expression for a motif set, with common prefixes factored out."""
    words = sorted(set(kmers))
    if words == [""]:
        return ""
    branches = [
        head + alternation(w[1:] for w in words if w[0] == head)
        for head in sorted({w[0] for w in words})
    ]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def run_pattern(kmers: Sequence[str]) -> str:
    """Regular expression of one maximal covered run of equally long motifs.

    A run starts at a hit, continues for up to ``k`` letters until the next hit
    starts, and ends ``k`` letters after its last hit.  Overlapping and touching
    hits fall into one run.  The quantifiers are possessive, so arrays of any
    length are matched without backtracking or recursion.
    """
    hit = alternation(kmers)
    k = len(kmers[0])
    return f"(?:(?={hit}).(?:(?!{hit}).){{0,{k - 1}}}+)++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


# --- counts and coverage ----------------------------------------------------

def hit_count(seq: Column, kmers: Sequence[str]) -> Column:
    """Number of positions at which a motif starts (overlaps count)."""
    if scans.can_scan(kmers):
        return scans.counts(seq, [kmers])[0]
    return F.regexp_count(seq, F.lit(f"(?={alternation(kmers)})")).cast("long")


def separate_count(seq: Column, kmers: Sequence[str]) -> Column:
    """Non-overlapping count of each motif, summed over the motifs."""
    counts = [F.regexp_count(seq, F.lit(m)) for m in kmers]
    return sum(counts[1:], counts[0]).cast("long")


def covered_bases(seq: Column, kmers: Sequence[str]) -> Column:
    """Bases that lie under at least one hit."""
    if scans.can_scan(kmers):
        return scans.covered(seq, [kmers])[0]
    left_over = F.regexp_replace(seq, F.lit(run_pattern(kmers)), F.lit(""))
    return (F.length(seq) - F.length(left_over)).cast("long")


def coverage(seq: Column, kmers: Sequence[str], min_len: int = 1) -> Column:
    """Covered share of the sequence; 0 below ``min_len`` letters."""
    n = F.length(seq)
    return F.when(n >= max(1, min_len), covered_bases(seq, kmers) / n).otherwise(F.lit(0.0))


def coverage_one_mismatch(seq: Column, unit: str) -> Column:
    """Covered share when hits may differ from the motif in one letter."""
    return coverage(seq, one_mismatch(both_strands(unit)))


def strand_fraction(seq: Column, unit: str = "TTAGGG") -> Column:
    """Forward share of all separate motif counts; 0.5 without any."""
    fwd, rev = separate_count(seq, forward(unit)), separate_count(seq, backward(unit))
    return let(
        F.struct(fwd.alias("f"), rev.alias("r")),
        lambda c: F.when(c["f"] + c["r"] == 0, F.lit(0.5))
        .otherwise(c["f"] / F.greatest(c["f"] + c["r"], F.lit(1))),
    )


def strand_class(seq: Column, frac: Column, unit: str = "TTAGGG") -> Column:
    """coding-strand above 0.7, template-strand below 0.3, else converging."""
    none = ~seq.rlike(alternation(both_strands(unit)))
    return F.when(none, "unknown").otherwise(strand_side(frac))


def strand_side(frac: Column) -> Column:
    """Class of a forward share, where there are motifs at all."""
    return (
        F.when(frac > 0.7, "coding-strand").when(frac < 0.3, "template-strand").otherwise("converging"))


def dominant_unit(fwd: Column, rev: Column) -> Column:
    """Repeat unit of the stronger strand; an even count goes to the reverse one."""
    return (
        F.when(fwd + rev == 0, "unknown").when(fwd > rev, "TTAGGG").otherwise("CCCTAA")
    )


# --- positions and runs -----------------------------------------------------

def hit_positions(seq: Column, kmers: Sequence[str]) -> Column:
    """Sorted 0-based starts of all hits of equally long motifs."""
    n = F.length(seq)
    return F.when(n >= len(kmers[0]), scans.positions(seq, kmers)).otherwise(F.array().cast("array<int>"))


def runs_of_hits(hits: Column, k: int, min_run: int = 1) -> Column:
    """Covered runs ``array<struct<start,end>>`` of sorted hit starts.

    A hit opens a run when it starts after the previous hit's end; it closes one
    when the next hit starts after its own end.
    """
    def build(h: Column) -> Column:
        starts = F.filter(
            h, lambda x, i: (i == 0) | (x > F.get(h, i - 1) + k))
        ends = F.filter(
            h, lambda x, i: (i == F.size(h) - 1) | (F.get(h, i + 1) > x + k))
        paired = F.zip_with(
            starts, ends, lambda s, e: F.struct(s.alias("start"), (e + k).alias("end")))
        return F.filter(paired, lambda r: r["end"] - r["start"] >= min_run)

    return let(hits, build)


def covered_runs(seq: Column, kmers: Sequence[str], min_run: int = MIN_RUN_BP) -> Column:
    """Covered runs of at least ``min_run`` bases."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.length(seq) >= len(kmers[0]), scans.runs(seq, [kmers], min_run)[0]).otherwise(nothing)


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p + by)


def mixed_runs(seq: Column, kmers: Sequence[str], min_run: int = 1) -> Column:
    """Covered runs of motifs of different lengths.

    A motif longer than the shortest one covers the same bases as shorter hits
    at its first positions, so all hits are brought to the shortest length.
    """
    short = min(map(len, kmers))
    parts = []
    for k in sorted({len(m) for m in kmers}):
        found = hit_positions(seq, [m for m in kmers if len(m) == k])
        parts += [_shifted(found, by) for by in range(k - short + 1)]
    return runs_of_hits(F.array_sort(F.array_distinct(F.concat(*parts))), short, min_run)


def longest_run(runs: Column) -> Column:
    """Longest run; the first one wins among equals.  Null without runs."""
    nothing = F.lit(None).cast("struct<start:int,end:int>")
    return F.aggregate(
        runs,
        nothing,
        lambda best, r: F.when(
            best.isNull() | (r["end"] - r["start"] > best["end"] - best["start"]), r
        ).otherwise(best),
    )


def total_bases(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda acc, r: acc + r["end"] - r["start"])


def longest_gap(runs: Column, n: Column) -> Column:
    """Longest uncovered stretch between, before or after the runs; first wins."""
    def gaps(rs: Column) -> Column:
        before = F.transform(
            rs, lambda r, i: F.struct(
                F.when(i == 0, 0).otherwise(F.get(rs, i - 1)["end"]).alias("start"),
                r["start"].alias("end")))
        tail_start = F.when(F.size(rs) == 0, 0).otherwise(F.get(rs, F.size(rs) - 1)["end"])
        tail = F.array(F.struct(tail_start.alias("start"), n.alias("end")))
        return F.filter(F.concat(before, tail), lambda g: g["end"] > g["start"])

    return longest_run(let(runs, gaps))


def near_starts(seq: Column) -> tuple[Column, Column]:
    """Starts of the half site on either strand."""
    return hit_positions(seq, [HALF_SITE]), hit_positions(seq, [rc_text(HALF_SITE)])


# --- motif tables -----------------------------------------------------------

def rotation_table(units: DataFrame, unit: str = "unit") -> DataFrame:
    """All rotations of each unit on both strands, one row per distinct motif."""
    u = F.col(unit)
    k = F.length(u)
    strands = F.array(
        F.struct(F.lit("fwd").alias("strand"), u.alias("base")),
        F.struct(F.lit("rev").alias("strand"),
                 F.reverse(F.translate(u, "ACGT", "TGCA")).alias("base")),
    )
    return (
        units.where(k > 0)
        .withColumn("_s", F.explode(strands))
        .withColumn("_i", F.explode(F.sequence(F.lit(1), k)))
        .withColumn(
            "kmer",
            F.substring(F.concat(F.col("_s.base"), F.col("_s.base")), F.col("_i"), k))
        .select(*[c for c in units.columns], F.col("_s.strand").alias("strand"), "kmer")
        .distinct()
    )


def splice_sites_in_unit(kmer: Column, dinucleotide: str) -> Column:
    """0-based offsets of a dinucleotide in one period, across its boundary too."""
    ring = F.concat(kmer, F.substring(kmer, 1, 1))
    offsets = F.filter(
        F.sequence(F.lit(1), F.length(kmer)),
        lambda i: F.substring(ring, i, 2) == dinucleotide)
    return F.transform(offsets, lambda i: i - 1)
