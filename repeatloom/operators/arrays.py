"""Repeat arrays inside one sequence: families, orientation, linkers, terminals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.functions import scans
from repeatloom.operators.durable import once

# --- fixed values -----------------------------------------------------------
MIN_ARRAY_SHARE = 0.05
NO_LINKER_MAX = 4
PURE_MIN_LEN, PURE_MAX_N, PURE_MAX_EXACT, PURE_MAX_COVERAGE = 25, 0.05, 1, 0.10
# ---------------------------------------------------------------------------


def family_coverages(seq: Column, families: Sequence[str], min_len: int = 1) -> Column:
    """``array<struct<cov, rank, family>>`` in family order."""
    n = F.length(seq)
    under = scans.covered(seq, [M.both_strands(u) for u in families])
    return F.array(*[
        F.struct(F.when(n >= max(1, min_len), under[i] / n).otherwise(F.lit(0.0)).alias("cov"),
                 F.lit(-i).alias("rank"), F.lit(u).alias("family"))
        for i, u in enumerate(families)])


def with_best_family(
    df: DataFrame, families: Sequence[str] = M.SURVEY_FAMILIES, seq: str = "seq", min_len: int = 1,
) -> DataFrame:
    """Family with the highest coverage; list order decides ties; null at 0."""
    best = F.array_max(family_coverages(F.col(seq), families, min_len))
    return (
        once(df, _best=best)
        .withColumn("telo_coverage", F.col("_best.cov"))
        .withColumn("repeat_type", F.when(F.col("_best.cov") > 0, F.col("_best.family")))
        .drop("_best")
    )


def with_strand_class(df: DataFrame, seq: str = "seq", family: str | None = None,
                      families: Sequence[str] = ()) -> DataFrame:
    """Strand ratio and class, by TTAGGG or by each row's own family.

    Both strands of the family are counted by one lookup per letter.  Rows of no listed family have neither.
    """
    strands = lambda unit: (M.forward(unit), M.backward(unit))
    if family is None:
        found, known = scans.separate_counts(F.col(seq), strands("TTAGGG")), F.lit(True)
    else:
        found = scans.own_separate_counts(F.col(seq), F.col(family), {u: strands(u) for u in families})
        known = F.col(family).isin(*families)
    counted, counts = df.withColumn("_counts", found), F.col("_counts")
    fwd, both = counts[0], counts[0] + counts[1]
    frac = F.when(both == 0, F.lit(0.5)).otherwise(fwd / F.greatest(both, F.lit(1)))
    kind = F.when(both == 0, "unknown").otherwise(M.strand_side(F.col("fwd_frac")))
    return counted.withColumn("fwd_frac", F.when(known, frac)).withColumn("orientation", F.when(known, kind)).drop("_counts")


def with_splice_form(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Sense-strand text and the eight letters at either end of it."""
    return df.withColumn("norm_seq", S.sense_strand(F.col(seq))).withColumns({
        "donor_8": S.first(F.col("norm_seq"), 8),
        "acceptor_8": S.last(F.col("norm_seq"), 8),
    })


def with_tandem_structure(df: DataFrame, seq: str = "seq", unit: str = "TTAGGG") -> DataFrame:
    """Longest covered run, its place and share, and the number of gaps."""
    runs = M.covered_runs(F.col(seq), M.both_strands(unit), 1)
    best = F.col("_best")
    size = F.coalesce(best["end"] - best["start"], F.lit(0))
    return (
        once(df, _found=M.let(runs, lambda r: F.struct(M.longest_run(r).alias("best"), F.size(r).alias("n"))))
        .withColumn("_best", F.col("_found.best"))
        .withColumns({
            "run_start": F.coalesce(best["start"], F.lit(0)),
            "run_end": F.coalesce(best["end"], F.lit(0)),
            "longest_run": size,
            "run_share": F.when(F.length(seq) > 0, size / F.length(seq)).otherwise(F.lit(0.0)),
            "n_gaps": F.greatest(F.col("_found.n") - 1, F.lit(0)),
        })
        .drop("_found", "_best")
    )


def with_strand_runs(
    df: DataFrame, families: Sequence[str] = M.MECHANISM_FAMILIES, seq: str = "seq",
    min_run: int = M.MIN_RUN_BP, family: str | None = None,
) -> DataFrame:
    """``family``, ``fwd_runs`` and ``rev_runs`` of the family with most run bases.

    The first of equal families wins; rows without any run get a null family.
    With ``family`` given, that family is used for every row.
    """
    units = (family,) if family else families
    strands = [kmers for u in units for kmers in (M.forward(u), M.backward(u))]
    # Null texts have no runs.
    nothing = F.array_repeat(F.array().cast("array<struct<start:int,end:int>>"), len(strands))
    found = once(df, _runs=F.coalesce(scans.runs(F.col(seq), strands, min_run), nothing))

    def entry(i: int, unit: str) -> Column:
        fwd, rev = F.col("_runs")[2 * i], F.col("_runs")[2 * i + 1]
        return F.struct(
            (M.total_bases(fwd) + M.total_bases(rev)).alias("bp"), F.lit(-i).alias("rank"), F.lit(unit).alias("family"),
            fwd.alias("fwd_runs"), rev.alias("rev_runs"))

    best = F.array_max(F.array(*[entry(i, u) for i, u in enumerate(units)]))
    return once(found, _best=best).select(
        *df.columns,
        F.when((F.col("_best.bp") > 0) | F.lit(family is not None), F.col("_best.family")).alias("family"),
        F.col("_best.fwd_runs").alias("fwd_runs"),
        F.col("_best.rev_runs").alias("rev_runs"),
    )


def with_orientation(df: DataFrame, seq: str = "seq", min_share: float = MIN_ARRAY_SHARE) -> DataFrame:
    """Orientation class and linker from the strand runs.

    A strand counts with at least ten run bases that are ``min_share`` of the
    sequence.  The order of the two longest runs tells converging from diverging
    arrays; up to four letters between them is no linker.
    """
    n = F.length(seq)
    out = once(
        df,
        fwd_bp=M.total_bases(F.col("fwd_runs")),
        rev_bp=M.total_bases(F.col("rev_runs")),
        _f=M.longest_run(F.col("fwd_runs")),
        _r=M.longest_run(F.col("rev_runs")),
        n_fwd_runs=F.size("fwd_runs"),
        n_rev_runs=F.size("rev_runs"),
    )

    def has(bp: str) -> Column:
        return (F.col(bp) >= M.MIN_RUN_BP) & (F.col(bp) / F.greatest(n, F.lit(1)) >= min_share)

    fwd_first = F.col("_f.start") < F.col("_r.start")
    both = has("fwd_bp") & has("rev_bp")
    gap_from = F.when(fwd_first, F.col("_f.end")).otherwise(F.col("_r.end"))
    gap_to = F.when(fwd_first, F.col("_r.start")).otherwise(F.col("_f.start"))
    size = F.greatest(F.lit(0), gap_to - gap_from)
    suffix = F.when(size <= NO_LINKER_MAX, "_NOLINKER").otherwise("_WITHLINKER")
    return out.withColumns({
        "classification": F.when(
            both, F.concat(F.when(fwd_first, "CONVERGING").otherwise("DIVERGING"), suffix))
        .when(has("fwd_bp"), "SINGLE_G").when(has("rev_bp"), "SINGLE_C").otherwise("NONE"),
        "linker_start": F.when(both, gap_from),
        "linker_end": F.when(both, gap_to),
        "linker_len": F.when(both, size).otherwise(F.lit(0)),
        "linker": F.when(
            both & (size > 0),
            F.substring(F.col(seq).cast("binary"), gap_from + 1, size).cast("string")
        ).otherwise(F.lit("")),
        "fwd_run_max": F.coalesce(F.col("_f.end") - F.col("_f.start"), F.lit(0)),
        "rev_run_max": F.coalesce(F.col("_r.end") - F.col("_r.start"), F.lit(0)),
    }).drop("_f", "_r")


def with_variant_signal(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Canonical, one-mismatch and receptor-variant windows of TTAGGG rows."""
    text = F.col(seq)
    motifs = M.both_strands("TTAGGG")
    receptor = sorted(set(M.RECEPTOR_VARIANTS) | {M.rc_text(v) for v in M.RECEPTOR_VARIANTS})
    return df.withColumns({
        "n_windows": F.greatest(F.length(text) - 5, F.lit(0)),
        "n_canonical": M.hit_count(text, motifs),
        "_near": M.hit_count(text, M.one_mismatch(motifs)),
        "n_receptor": M.hit_count(text, receptor),
    }).withColumn("n_variant", F.col("_near") - F.col("n_canonical")).drop("_near")


def pure_nonrepeat(text: Column, unit: str) -> Column:
    """Long enough, few N, at most one exact motif, low one-mismatch coverage."""
    return (
        (F.length(text) >= PURE_MIN_LEN)
        & (S.letter_share(text, "N") <= PURE_MAX_N)
        & (M.separate_count(text, M.both_strands(unit)) <= PURE_MAX_EXACT)
        & (M.coverage_one_mismatch(text, unit) < PURE_MAX_COVERAGE)
    )


def strict_linkers(df: DataFrame, unit: str, seq: str = "seq") -> DataFrame:
    """Rows whose gap between the longest runs of either strand is pure non-repeat."""
    runs = with_strand_runs(df.where(S.letter_share(F.col(seq), "N") <= PURE_MAX_N), seq=seq, family=unit)
    placed = with_orientation(runs, seq, 0.0).where(
        (F.col("n_fwd_runs") > 0) & (F.col("n_rev_runs") > 0)
        & (F.col("linker_end") - F.col("linker_start") >= PURE_MIN_LEN))
    return once(placed, _pure=pure_nonrepeat(F.col("linker"), unit)).where("_pure").drop("_pure")


def with_canonical_linker(df: DataFrame, kmers: Sequence[str], min_len: int = 25, seq: str = "seq") -> DataFrame:
    """Longest uncovered stretch of at least ``min_len`` letters, else null."""
    gap = M.longest_gap(M.mixed_runs(F.col(seq), kmers), F.length(seq))
    return once(df, _gap=gap).withColumns({
        "gap_start": F.when(F.col("_gap.end") - F.col("_gap.start") >= min_len, F.col("_gap.start")),
        "gap_end": F.when(F.col("_gap.end") - F.col("_gap.start") >= min_len, F.col("_gap.end")),
    }).drop("_gap")


# --- in-register arrays and terminals ---------------------------------------

def register_arrays(seq: Column, unit: str = "TTAGGG") -> Column:
    """Arrays of back-to-back units: ``array<struct<start, end, copies>>``.

    The units found by one pattern and the text between them alternate, so the
    offsets are sums of the lengths seen so far.
    """
    k = len(unit)
    pattern = f"((?:{M.alternation(M.both_strands(unit))})++)"
    found = F.transform(F.regexp_extract_all(seq, F.lit(pattern), F.lit(1)), F.length)
    between = F.transform(F.split(seq, pattern, -1), F.length)

    def offsets(pair: Column) -> Column:
        start0 = F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,end:int,copies:int>>").alias("out"))
        steps = F.zip_with(pair["gap"], pair["len"], lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        walked = F.aggregate(
            F.filter(steps, lambda s: s["n"].isNotNull()), start0,
            lambda acc, s: F.struct(
                (acc["at"] + s["g"] + s["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["g"]).alias("start"),
                    (acc["at"] + s["g"] + s["n"]).alias("end"),
                    (s["n"] / k).cast("int").alias("copies")))).alias("out")))
        return walked["out"]

    return M.let(F.struct(between.alias("gap"), found.alias("len")), offsets)


def largest_array(seq: Column, unit: str = "TTAGGG") -> Column:
    """The array with most copies; the first one wins.

    Folded in one pass, without keeping the other arrays.
    """
    k = len(unit)
    pattern = f"((?:{M.alternation(M.both_strands(unit))})++)"
    found = F.transform(F.regexp_extract_all(seq, F.lit(pattern), F.lit(1)), F.length)
    between = F.transform(F.split(seq, pattern, -1), F.length)

    def fold(pair: Column) -> Column:
        steps = F.zip_with(pair["gap"], pair["len"], lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("size"))
        done = F.aggregate(steps, zero, lambda acc, s: M.let(
            F.coalesce(s["n"], F.lit(0)),
            lambda n: F.struct(
                (acc["at"] + s["g"] + n).alias("at"),
                F.when(n > acc["size"], acc["at"] + s["g"]).otherwise(acc["start"]).alias("start"),
                F.greatest(n, acc["size"]).alias("size"))))
        return F.when(done["size"] > 0, F.struct(
            done["start"].alias("start"), (done["start"] + done["size"]).alias("end"),
            (done["size"] / k).cast("int").alias("copies")))

    return M.let(F.struct(between.alias("gap"), found.alias("len")), fold)


def with_terminals(df: DataFrame, seq: str = "seq", null_leader_at_zero: bool = False) -> DataFrame:
    """Leader before and trailer after the largest in-register array.

    Sequences under twelve letters and those without an array get nulls.  An
    array at the very start leaves an empty leader, or a null one on request.
    """
    text = F.col(seq).cast("binary")
    n = F.length(seq)
    arr = F.col("_a")
    cut = lambda a, size: F.substring(text, a + 1, size).cast("string")
    empty_leader = F.lit(None).cast("string") if null_leader_at_zero else F.lit("")
    return (
        once(df, _a=F.when(n >= 12, largest_array(F.col(seq))))
        .withColumns({
            "array_start": arr["start"], "array_end": arr["end"], "copies": arr["copies"],
            "purity": arr["copies"] / (arr["copies"] + 1),
            "leader": F.when(arr["start"] > 0, cut(F.lit(0), arr["start"])).when(
                arr["start"] == 0, empty_leader),
            "trailer": F.when(arr["end"] < n, cut(arr["end"], n - arr["end"])).when(
                arr["end"] == n, F.lit("")),
        })
        .withColumns({
            "donor_site": S.last(F.col("leader"), 2),
            "acceptor_site": S.first(F.col("trailer"), 2),
        })
        .drop("_a")
    )


def with_boundary_windows(df: DataFrame, seq: str = "seq", width: int = 20) -> DataFrame:
    """Letters around both borders of the main array."""
    text = F.col(seq).cast("binary")
    body = F.substring(
        text, F.col("array_start") + 1, F.col("array_end") - F.col("array_start")).cast("string")
    return df.withColumns({
        "left_boundary": F.concat(S.last(F.col("leader"), width), S.first(body, width)),
        "right_boundary": F.concat(S.last(body, width), S.first(F.col("trailer"), width)),
    })


def with_estimated_terminals(df: DataFrame, length: str, copies: str, k: int = 6) -> DataFrame:
    """Leader and trailer length guessed from counts: half the rest on either side."""
    rest = F.col(length) - F.col(copies) * k
    return df.withColumn("terminal_len", rest / 2).where(rest > 0)


def base_classes(df: DataFrame, unit: str, ids: Sequence[str], seq: str = "seq") -> DataFrame:
    """Bases per class: canonical or one-mismatch hit on either strand, or neither.

    A base takes the strongest class that covers it.  Runs of each class come
    from covered bases of growing motif sets, so no per-base rows are made.
    """
    text = F.col(seq)
    f, r = M.forward(unit), M.backward(unit)
    near_f, near_r = M.one_mismatch(f), M.one_mismatch(r)
    sets = [f, f + r, f + r + near_f, f + r + near_f + near_r]
    found = once(df, _under=scans.covered(text, sets))
    return found.select(*ids, *[F.col("_under")[i].alias(f"_u{i}") for i in range(len(sets))], F.length(text).alias("n")).select(
        *ids,
        F.col("_u0").alias("fwd_canonical"),
        (F.col("_u1") - F.col("_u0")).alias("rev_canonical"),
        (F.col("_u2") - F.col("_u1")).alias("fwd_variant"),
        (F.col("_u3") - F.col("_u2")).alias("rev_variant"),
        (F.col("n") - F.col("_u3")).alias("non_telo"),
    )


def dense_windows(seq: Column, kmers: Sequence[str], window: int = 200) -> Column:
    """Struct of hits, windows and windows with at least two hit starts inside.

    Two consecutive hits closer than the window make every window dense that
    starts after the second one minus the window and not after the first one;
    the union of those start ranges is counted without sliding.  Sequences
    shorter than the window give zeros.
    """
    def count(v: Column) -> Column:
        h, last_start = v["h"], v["last"]
        more = F.greatest(F.size(h) - 1, F.lit(0))
        zero = F.struct(F.lit(-1).alias("done"), F.lit(0).alias("total"))
        pairs = F.zip_with(
            F.slice(h, F.lit(1), more), F.slice(h, F.lit(2), more),
            lambda a, b: F.struct(
                F.greatest(b - window + 1, F.lit(0)).alias("lo"), F.least(a, last_start).alias("hi")))
        folded = F.aggregate(pairs, zero, lambda acc, p: F.struct(
            F.greatest(acc["done"], p["hi"]).alias("done"),
            (acc["total"] + F.greatest(
                F.lit(0), p["hi"] - F.greatest(p["lo"], acc["done"] + 1) + 1)).alias("total")))
        return F.struct(
            F.size(h).alias("n_hits"), (last_start + 1).alias("n_windows"),
            folded["total"].alias("n_dense"))

    none = F.struct(F.lit(0).alias("n_hits"), F.lit(0).alias("n_windows"), F.lit(0).alias("n_dense"))
    bound = F.struct(hit_positions_of(seq, kmers).alias("h"), (F.length(seq) - window).alias("last"))
    return F.when(F.length(seq) >= window, M.let(bound, count)).otherwise(none)


def hit_positions_of(seq: Column, kmers: Sequence[str]) -> Column:
    """Distinct hit starts of motifs of any lengths."""
    sizes = sorted({len(m) for m in kmers})
    parts = [M.hit_positions(seq, [m for m in kmers if len(m) == k]) for k in sizes]
    return parts[0] if len(parts) == 1 else F.array_sort(F.array_distinct(F.concat(*parts)))


def half_site_pairs(seq: Column, max_spacing: int = 10) -> Column:
    """Half sites and their direct and inverted pairs, ``struct`` of counts.

    Direct pairs keep 0 to ``max_spacing`` letters between two forward sites;
    inverted ones between a forward and a reverse site.  One walk over all sites
    in order of place, which keeps the sites within reach: two per letter at most.
    """
    k = len(M.HALF_SITE)
    fwd, rev = M.near_starts(seq)

    def count(p: Column) -> Column:
        tagged = lambda sites, strand: F.transform(
            sites, lambda s: F.struct(s.alias("at"), F.lit(strand).alias("strand")))
        sites = F.array_sort(F.concat(tagged(p["f"], 0), tagged(p["r"], 1)))
        none = F.array().cast("array<struct<at:int,strand:int>>")
        start = F.struct(none.alias("near"), F.lit(0).alias("direct"), F.lit(0).alias("inverted"))

        def step(acc: Column, s: Column) -> Column:
            near = F.filter(acc["near"], lambda o: s["at"] - o["at"] <= k + max_spacing)
            clear = lambda kind: F.size(F.filter(
                acc["near"], lambda o: (s["at"] - o["at"]).between(k, k + max_spacing) & kind(o)))
            return F.struct(
                F.concat(near, F.array(s)).alias("near"),
                (acc["direct"] + clear(lambda o: (o["strand"] == 0) & (s["strand"] == 0))).alias("direct"),
                (acc["inverted"] + clear(lambda o: o["strand"] != s["strand"])).alias("inverted"))

        return F.aggregate(sites, start, step, lambda acc: F.struct(
            F.size(p["f"]).alias("n_fwd"), F.size(p["r"]).alias("n_rev"), acc["direct"].alias("direct"),
            acc["inverted"].alias("inverted")))

    return M.let(F.struct(fwd.alias("f"), rev.alias("r")), count)


def with_purity_class(df: DataFrame, unit: str = "TTAGGG", seq: str = "seq") -> DataFrame:
    """Which strands' motifs a linker holds, and whether it holds only a few."""
    out = df.withColumns({
        "_f": M.separate_count(F.col(seq), M.forward(unit)),
        "_r": M.separate_count(F.col(seq), M.backward(unit)),
    })
    f, r = F.col("_f"), F.col("_r")
    return out.withColumns({
        "purity": F.when(f + r == 0, "none").when(r == 0, "fwd-only").when(f == 0, "rev-only").otherwise("both"),
        "low": (f + r).between(1, 2),
    }).drop("_f", "_r")


def density_profile(df: DataFrame, unit: str, bins: int, seq: str = "seq") -> DataFrame:
    """Hits per strand and per equal part of the sequence, over all rows."""
    text = F.col(seq)
    strands = F.array(
        F.struct(F.lit("fwd").alias("strand"), M.hit_positions(text, M.forward(unit)).alias("h")),
        F.struct(F.lit("rev").alias("strand"), M.hit_positions(text, M.backward(unit)).alias("h")))
    return (
        df.select(F.length(text).alias("n"), F.explode(strands).alias("_s"))
        .select("n", "_s.strand", F.explode("_s.h").alias("pos"))
        .select("strand", F.least(F.lit(bins - 1), F.floor(F.col("pos") * bins / F.col("n"))).alias("bin"))
        .groupBy("strand", "bin").agg(F.count("*").alias("n_hits"))
    )


def boundary_density(
    df: DataFrame, unit: str, bins: int = 20, flank: int = 50, left: str = "left", seq: str = "seq", right: str = "right",
) -> DataFrame:
    """``zone, bin, strand, bases, covered, density`` along sequences and their flanks, over all rows.

    The sequence is cut into ``bins`` equal parts (a letter at ``p`` of ``n`` is in part ``floor(p * bins / n)``); the
    flanks are told letter by letter, ``bin`` letters from the border, up to ``flank`` letters (the zones ``left`` and
    ``right``).  A letter is covered if it lies under a hit of the strand; hits may cross the borders.  Each part sums
    its overlap with the runs of covered letters, so what is shuffled are sums per part.  Null and empty texts have no
    letters, and parts without letters no rows.
    """
    k = len(unit)
    before = F.substring(F.coalesce(F.col(left), F.lit("")), F.greatest(F.lit(1), F.length(left) - flank + 1), F.lit(flank))
    behind = F.substring(F.coalesce(F.col(right), F.lit("")), F.lit(1), F.lit(flank))
    texts = df.select(
        F.coalesce(before, F.lit("")).alias("_l"), F.coalesce(F.col(seq), F.lit("")).alias("_s"), behind.alias("_r"))
    whole = F.concat("_l", "_s", "_r")
    rows = once(texts, nl=F.length("_l"), n=F.length("_s"), nr=F.length("_r"),
                fwd=M.runs_of_hits(M.hit_positions(whole, M.forward(unit)), k),
                rev=M.runs_of_hits(M.hit_positions(whole, M.backward(unit)), k)).drop("_l", "_s", "_r")
    # First letter of part b of a sequence: the smallest p with floor(p * bins / n) >= b.
    edge = lambda b: F.ceil(b * F.col("n") / F.lit(bins))
    parts = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(
            F.lit("inside").alias("zone"), b.cast("int").alias("bin"), (F.col("nl") + edge(b)).cast("int").alias("begin"),
            (F.col("nl") + edge(b + 1)).cast("int").alias("end"))),
        F.transform(F.sequence(F.lit(0), F.lit(flank - 1)), lambda b: F.struct(
            F.lit("left").alias("zone"), b.cast("int").alias("bin"), (F.col("nl") - 1 - b).cast("int").alias("begin"),
            (F.col("nl") - b).cast("int").alias("end"))),
        F.transform(F.sequence(F.lit(0), F.lit(flank - 1)), lambda b: F.struct(
            F.lit("right").alias("zone"), b.cast("int").alias("bin"), (F.col("nl") + F.col("n") + b).cast("int").alias("begin"),
            (F.col("nl") + F.col("n") + b + 1).cast("int").alias("end"))))
    size = F.col("nl") + F.col("n") + F.col("nr")
    under = lambda runs: F.aggregate(
        runs, F.lit(0), lambda acc, r: acc + F.greatest(
            F.lit(0), F.least(r["end"], F.col("_p.end")) - F.greatest(r["start"], F.col("_p.begin"))))
    return (
        rows.withColumn("_size", size).withColumn("_p", F.explode(parts))
        .where((F.col("_p.begin") >= 0) & (F.col("_p.end") <= F.col("_size")) & (F.col("_p.begin") < F.col("_p.end")))
        .select("_p.zone", "_p.bin", (F.col("_p.end") - F.col("_p.begin")).alias("bases"), F.explode(F.array(
            F.struct(F.lit("fwd").alias("strand"), under(F.col("fwd")).alias("covered")),
            F.struct(F.lit("rev").alias("strand"), under(F.col("rev")).alias("covered")))).alias("_c"))
        .groupBy("zone", "bin", "_c.strand").agg(F.sum("bases").alias("bases"), F.sum("_c.covered").alias("covered"))
        .withColumn("density", F.col("covered") / F.col("bases")))
