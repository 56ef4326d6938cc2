"""Scalar column expressions on sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from repeatloom.functions.motifs import both_strands

# --- fixed values -----------------------------------------------------------
BRANCH_POINT = "CT[ACG][CT]"
PYRIMIDINE_TRACT = "[CT]{4,}"
G_QUADRUPLEX = "G{3,}(?:[ACGT]{1,7}G{3,}){3}"
C_QUADRUPLEX = "C{3,}(?:[ACGT]{1,7}C{3,}){3}"
DEGENERATE_SITES = ("TT", "TA", "AT", "AA", "GG", "GA")
# ---------------------------------------------------------------------------


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters outside ACGT stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def revcomp_masked(seq: Column) -> Column:
    """Reverse complement; letters outside ACGT become N."""
    return revcomp(F.regexp_replace(seq, "[^ACGTN]", "N"))


def first(seq: Column, n: int) -> Column:
    return F.substring(seq, 1, n)


def last(seq: Column, n: int) -> Column:
    return F.right(seq, F.lit(n))


def starts_ends(seq: Column, head: str, tail: str) -> Column:
    return (first(seq, 2) == head) & (last(seq, 2) == tail)


def sense_strand(seq: Column) -> Column:
    """Sequences that read CT…AC are turned over, others stay."""
    return F.when(starts_ends(seq, "CT", "AC"), revcomp(seq)).otherwise(seq)


def canonical_sites(donor: Column, acceptor: Column) -> Column:
    return ((donor == "GT") & (acceptor == "AG")) | ((donor == "CT") & (acceptor == "AC"))


def inner_motif(norm: Column, side: str) -> Column:
    """Four letters inside the splice site of a GT…AG sequence, else null."""
    inside = F.substring(norm, 3, 4) if side == "donor" else F.substring(norm, F.length(norm) - 5, 4)
    return F.when(starts_ends(norm, "GT", "AG") & (F.length(norm) >= 8), inside)


def edge_in_repeat(norm: Column, side: str, unit: str = "TTAGGG") -> Column:
    """Is the splice signal part of a repeat unit at the sequence's edge?"""
    site, edge = (
        (first(norm, 2) == "GT", first(norm, 6)) if side == "donor"
        else (last(norm, 2) == "AG", last(norm, 6))
    )
    return site & edge.isin(both_strands(unit))


def letter_count(seq: Column, letters: str) -> Column:
    kept = F.translate(seq, letters, "")
    return F.length(seq) - F.length(kept)


def letter_share(seq: Column, letters: str) -> Column:
    """Share of the given letters; 0 for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, letter_count(seq, letters) / n).otherwise(F.lit(0.0))


def gc_share(seq: Column) -> Column:
    return letter_share(seq, "GC")


def dinucleotide_share(seq: Column, pair: str) -> Column:
    """Count of two different letters over the n-1 windows (at least one)."""
    return F.regexp_count(seq, F.lit(pair)) / F.greatest(F.lit(1), F.length(seq) - 1)


def branch_points(seq: Column) -> Column:
    return F.regexp_count(F.upper(seq), F.lit(BRANCH_POINT))


def pyrimidine_tracts(seq: Column) -> Column:
    return F.regexp_count(F.upper(seq), F.lit(PYRIMIDINE_TRACT))


def pyrimidine_tract_lengths(seq: Column) -> Column:
    tracts = F.regexp_extract_all(F.upper(seq), F.lit(f"({PYRIMIDINE_TRACT})"), F.lit(1))
    return F.transform(tracts, F.length)


def perfectly_periodic(seq: Column) -> Column:
    """More than 95 % of the 6-letter steps repeat the first six letters."""
    n = F.length(seq)
    steps = F.filter(
        F.regexp_extract_all(F.upper(seq), F.lit("(.{6})"), F.lit(1)),
        lambda w: w == F.upper(first(seq, 6)))
    return (n >= 12) & (F.size(steps) / F.greatest(F.lit(1), F.floor(n / 6)) > 0.95)


def near_contig_start(start: Column, end: Column) -> Column:
    return (end < 5000) & (start < 1000)


def palindrome_identity(seq: Column) -> Column:
    """Share of letters of the first half equal to the turned-over last half."""
    half = F.floor(F.length(seq) / 2).cast("int")
    a = F.split(F.substring(seq, F.lit(1), half), "")
    b = F.split(revcomp(F.right(seq, half)), "")
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(half > 0, same / F.greatest(half, F.lit(1))).otherwise(F.lit(0.0))


def target_site_duplication(left: Column, right: Column, shortest: int = 3, longest: int = 25) -> Column:
    """Longest L whose last L letters on the left open the right flank; 0 if none."""
    sizes = F.filter(
        F.sequence(F.lit(shortest), F.lit(longest)),
        lambda n: (n <= F.length(left)) & (n <= F.length(right))
        & (F.right(left, n) == F.left(right, n)))
    return F.coalesce(F.array_max(sizes), F.lit(0))


def _affixes(unit: str, longest: int, prefix: bool) -> list[str]:
    sizes = range(2, min(longest, len(unit)) + 1)
    return sorted({m[:n] if prefix else m[-n:] for m in both_strands(unit) for n in sizes})


def microhomology(flank: Column, unit: str, side: str, longest: int = 8) -> Column:
    """Longest flank end that opens (5p) or closes (3p) a rotation of the unit."""
    words = _affixes(unit, longest, side == "5p")
    cut = F.right if side == "5p" else F.left
    sizes = F.filter(
        F.sequence(F.lit(2), F.lit(longest)),
        lambda n: (n <= F.length(flank)) & cut(flank, n).isin(words))
    return F.coalesce(F.array_max(sizes), F.lit(0))


def microhomology_by_family(flank: Column, family: Column, families: Sequence[str], side: str) -> Column:
    """Microhomology against the row's own family."""
    out = F.lit(0)
    for unit in families:
        out = F.when(family == unit, microhomology(flank, unit, side)).otherwise(out)
    return out


def junction_microhomology(flank: Column, seq: Column, unit: str, longest: int = 8) -> Column:
    """First-generation rule: the flank's end is repeated by the sequence's start.

    The doubled end must contain TT, and the end must lie within a motif or, from
    four letters on, open like one.
    """
    motifs = both_strands(unit)
    openings = sorted({m[:4] for m in motifs})

    def ok(n: Column) -> Column:
        tail = F.right(flank, n)
        return (
            (n <= F.length(flank)) & (n <= F.length(seq)) & (tail == F.left(seq, n))
            & F.concat(tail, tail).contains("TT")
            & (F.lit("|".join(motifs)).contains(tail) | F.left(tail, F.least(n, F.lit(4))).isin(openings))
        )

    sizes = F.filter(F.sequence(F.lit(2), F.lit(longest)), ok)
    return F.coalesce(F.array_max(sizes), F.lit(0))


def inserted_sequence(ref: Column, alt: Column, info: Column, min_len: int = 30) -> Column:
    """Inserted bases of a variant line, null when it is no usable insertion.

    The length test comes before the comma test: a long multi-allelic ALT is cut
    as one text.
    """
    symbolic = alt.startswith("<")
    seq_tag = F.regexp_extract(info, "SEQ=([ACGTNacgtn]+)", 1)
    from_info = F.when(info.contains("SVTYPE=INS") & (seq_tag != ""), seq_tag)
    allele = F.get(
        F.filter(F.split(alt, ","), lambda a: (F.length(a) > F.length(ref) + min_len)
                 & ~a.startswith("<")), F.lit(0))
    tail = lambda a: F.substring(a, F.length(ref) + 1, F.length(a))
    raw = (
        F.when(symbolic, from_info)
        .when(F.length(alt) > F.length(ref) + min_len, tail(alt))
        .when(alt.contains(","), tail(allele))
    )
    return F.upper(raw)


def length_bucket(length: Column, edges: Sequence[int], labels: Sequence[str], closed: str = "left") -> Column:
    """Name of the length bucket.

    ``edges`` are the lower bounds.  With ``closed='left'`` a bucket is
    [edge, next); with ``'right'`` the upper bound belongs to it and the next
    one starts above.  Null below the first edge.
    """
    out = F.lit(None).cast("string")
    for i in range(len(edges)):
        inside = length >= edges[i] if (closed == "left" or i == 0) else length > edges[i]
        if i + 1 < len(edges):
            inside = inside & (length < edges[i + 1] if closed == "left" else length <= edges[i + 1])
        out = F.when(inside, labels[i]).otherwise(out)
    return out


def flag_list(*flags: Column) -> Column:
    """The flags that are set, as an array."""
    return F.array_compact(F.array(*flags))


def verdict(flags: Column) -> Column:
    return F.when(F.size(flags) == 0, "PASS").otherwise("FAIL")


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two equally long texts."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")),
        F.lit(0), lambda s, v: s + v)


def quadruplex_count(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit(G_QUADRUPLEX)) + F.regexp_count(seq, F.lit(C_QUADRUPLEX))


def degenerate_splice(donor: Column, acceptor: Column, splice_type: Column) -> Column:
    return (
        donor.isin(*DEGENERATE_SITES) | acceptor.isin(*DEGENERATE_SITES)
        | (splice_type != "canonical")
    )
