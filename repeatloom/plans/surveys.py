"""Surveys: introns, repeat-finder hits, insertions, and a second screen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.functions import scalars as S
from repeatloom.operators import arrays as A
from repeatloom.operators import intervals as I
from repeatloom.operators import sequences as Q
from repeatloom.operators import summaries as G
from repeatloom.operators.durable import cut, once, stored

# --- fixed values -----------------------------------------------------------
KEEP_COVERAGE = 0.85
REPORT_COVERAGE = 0.10
SHOW_COVERAGE = 0.50
MIN_INSERTION = 30
SCREEN_COLUMNS = (
    "genome_acc", "genome_name", "contig", "start", "end", "length", "strand", "mrna", "donor", "acceptor",
    "telo_coverage", "repeat_type", "fwd_frac", "orientation", "donor_8", "acceptor_8", "intron_seq",
)
# ---------------------------------------------------------------------------


def todo(
    catalog: DataFrame, ledger: DataFrame, only: str | None = None, force: bool = False, max_bp: int | None = None,
) -> DataFrame:
    """Catalog rows still to do; ``only`` is a case-insensitive part of acc or name.

    Genomes above ``max_bp`` are left out here and get a ledger row from ``too_large``.
    """
    rows = catalog if max_bp is None else catalog.where(F.coalesce(F.col("genome_bp") <= max_bp, F.lit(True)))
    if only:
        text = only.lower()
        rows = rows.where(F.lower("acc").contains(text) | F.lower("name").contains(text))
    return rows if force else rows.join(ledger.select("acc").distinct(), "acc", "left_anti")


def too_large(catalog: DataFrame, max_bp: int) -> DataFrame:
    """Ledger rows of the genomes that ``todo`` leaves out for their size."""
    return catalog.where(F.col("genome_bp") > max_bp).select("acc", F.lit("skipped_too_large").alias("status"))


def catalog_report(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every catalog row with its result; 'missing' and 0 where there is none."""
    numbers = [c for c, t in ledger.dtypes if t in ("bigint", "int", "double") and c not in catalog.columns]
    return catalog.join(ledger, "acc", "left").fillna("missing", ["status"]).fillna(0, numbers)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") != "ok").alias("n_failed"),
        F.sum("n_introns").alias("n_introns"), F.sum("n_kept").alias("n_kept"))


def intron_texts(
    features: DataFrame, chunks: DataFrame, max_len: int = I.INTRON_MAX, size: int = Q.CHUNK,
    keys: Sequence[str] = ("contig",), running: bool = True, per_transcript: bool = False,
) -> DataFrame:
    """Introns with text.

    By default each interval appears once, with the smallest transcript that has
    it.  ``per_transcript`` keeps an intron once per transcript.  The introns are written to the shared folder before
    they meet the chunks; other columns of the chunks come along.
    """
    gaps = I.introns(features, [*keys, "parent"], running).where(
        F.col("length").between(I.INTRON_MIN, max_len))
    strands = features.groupBy(*keys, "parent").agg(F.min("strand").alias("strand"))
    if not per_transcript:
        gaps = I.first_per_interval(gaps, [*keys, "start", "end"], ["parent"])
    rows = stored(gaps.join(strands, [*keys, "parent"]), "introns")
    return (
        Q.with_slices(rows, chunks, keys, size)
        .withColumnRenamed("parent", "mrna")
        .withColumns({"donor": S.first(F.col("seq"), 2), "acceptor": S.last(F.col("seq"), 2)})
    )


def screen(
    introns: DataFrame, families: Sequence[str] = M.SURVEY_FAMILIES, least: float = KEEP_COVERAGE,
) -> DataFrame:
    """Introns whose best family covers enough of them, with strand and splice form.

    Strand and splice columns are only made for rows that pass.
    """
    kept = A.with_best_family(introns, families).where(F.col("telo_coverage") >= least)
    return A.with_splice_form(A.with_strand_class(kept))


def motif_screen(introns: DataFrame, unit: str = "TTAGGG", least: float = REPORT_COVERAGE) -> DataFrame:
    """One-family screen that keeps everything from ``least`` on."""
    covered = once(introns, telo_coverage=M.coverage(F.col("seq"), M.both_strands(unit)))
    kept = covered.where(F.col("telo_coverage") >= least)
    return A.with_splice_form(A.with_strand_class(kept))


def genome_survey(screened: DataFrame, genome: str = "genome") -> DataFrame:
    """Per-genome totals with the most common boundary motifs."""
    return G.boundary_summary(screened, genome)


def human_survey(introns: DataFrame, genome: str = "genome") -> DataFrame:
    """Threshold counts of all introns and boundary motifs of the pure ones.

    Introns are extracted and scanned once; only coverages and pure texts are kept.
    """
    covered = once(introns, telo_coverage=M.coverage(F.col("seq"), M.both_strands("TTAGGG")))
    pure_text = F.when(F.col("telo_coverage") >= KEEP_COVERAGE, F.col("seq"))
    scanned = cut(covered.select(genome, "telo_coverage", pure_text.alias("seq")))
    counts = G.threshold_counts(scanned, [genome])
    pure = A.with_splice_form(A.with_strand_class(scanned.where(F.col("seq").isNotNull())))
    return counts.withColumnRenamed("n_total", "n_introns").join(genome_survey(pure, genome), genome, "left")


def near_misses(screened: DataFrame, group: Sequence[str], ids: Sequence[str], k: int = 10) -> DataFrame:
    """The best rows just below the threshold, per group."""
    rows = screened.where((F.col("telo_coverage") >= 0.70) & (F.col("telo_coverage") < KEEP_COVERAGE))
    return G.top_k(rows, group, [F.desc("telo_coverage"), *[F.asc(i) for i in ids]], k)


def rescreen(introns: DataFrame, least: float = KEEP_COVERAGE) -> DataFrame:
    """Second screen with seven families; the strand ratio uses the row's own family."""
    kept = A.with_best_family(introns, M.RESCREEN_FAMILIES, min_len=4).where(F.col("telo_coverage") >= least)
    return A.with_splice_form(
        A.with_strand_class(kept, family="repeat_type", families=M.RESCREEN_FAMILIES))


def type_summary(screened: DataFrame, genome: str = "genome") -> DataFrame:
    """Rows, mean coverage and orientation counts per genome and repeat type."""
    o = F.col("orientation")
    return screened.groupBy(genome, "repeat_type").agg(
        F.count("*").alias("n"), F.avg("telo_coverage").alias("mean_coverage"),
        F.count_if(o == "template-strand").alias("n_template"),
        F.count_if(o == "coding-strand").alias("n_coding"),
        F.count_if(o == "converging").alias("n_converging"),
        F.count_if(o == "unknown").alias("n_unknown"))


# --- insertions -------------------------------------------------------------

def scan_insertions(insertions: DataFrame) -> DataFrame:
    """Insertions with repeat content: runs, strand, previews.

    The full text is kept from half coverage on, the first and last four letters
    then too.
    """
    seq = F.col("ins_seq")
    long_enough = insertions.where(F.length("ins_seq") >= MIN_INSERTION)
    covered = once(long_enough, telo_coverage=M.coverage(seq, M.both_strands("TTAGGG"), 6)).where(
        F.col("telo_coverage") >= REPORT_COVERAGE)
    shaped = A.with_strand_class(A.with_tandem_structure(covered, "ins_seq"), "ins_seq")
    shown = F.col("telo_coverage") >= SHOW_COVERAGE
    return shaped.withColumns({
        "ins_length": F.length("ins_seq"),
        "seq_preview": S.first(seq, 100),
        "full_seq": F.when(shown, seq),
        "first_4bp": F.when(shown & (F.length("ins_seq") >= 4), S.first(seq, 4)),
        "last_4bp": F.when(shown & (F.length("ins_seq") >= 4), S.last(seq, 4)),
    })


def scan_contigs(contigs: DataFrame, min_len: int = MIN_INSERTION) -> DataFrame:
    """Assembled insertion contigs, scanned like variant insertions."""
    return scan_insertions(contigs.where(F.length("seq") >= min_len).withColumnRenamed("seq", "ins_seq"))


def insertion_thresholds(insertions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    seq = F.col("ins_seq")
    rows = once(insertions.where(F.length("ins_seq") >= MIN_INSERTION),
                telo_coverage=M.coverage(seq, M.both_strands("TTAGGG"), 6))
    return G.threshold_counts(rows, group)


# --- repeat-finder hits -----------------------------------------------------

def consensus_words(spark: SparkSession) -> DataFrame:
    """``word, family, strand, exact`` for each word that a family's consensus can be.

    A rotation of a family's unit fits exactly; failing all families, one with a single mismatch fits loosely.  Family
    order decides, forward before reverse.  The families fix the number of words (a few thousand), so the table can be
    sent to every task whatever the hits are.  ``N`` stands for every letter but A, C, G and T.
    """
    words: dict[str, tuple[str, str, bool]] = {}
    for exact in (True, False):
        for unit in M.REPEAT_FINDER_FAMILIES:
            for strand, kmers in (("fwd", M.forward(unit)), ("rev", M.backward(unit))):
                near = kmers if exact else [
                    w.replace(".", letter) for w in M.one_mismatch(kmers) for letter in "ACGTN"]
                for word in near:
                    words.setdefault(word, (unit if exact else unit + "~1mm", strand, exact))
    return spark.createDataFrame(
        [(word, *kind) for word, kind in words.items()], "word string, family string, strand string, exact boolean")


def with_consensus_family(hits: DataFrame) -> DataFrame:
    """Adds ``kind``, ``struct<family, strand, exact>`` of each hit's consensus; null where none fits or the period
    isn't the consensus' length."""
    words = consensus_words(hits.sparkSession).select("word", F.struct("family", "strand", "exact").alias("kind"))
    word = F.when(
        F.col("period") == F.length("consensus"), F.regexp_replace(F.upper("consensus"), "[^ACGT]", "N"))
    return hits.withColumn("_word", word).join(F.broadcast(words), F.col("_word") == F.col("word"), "left").drop(
        "_word", "word")


def repeat_finder_survey(introns: DataFrame, hits: DataFrame, by: str = "seq_id") -> DataFrame:
    """Introns whose longest hit (the first of equals) has a known family.

    An intron whose classified hits show both strands is converging.  Coverage is
    the best hit's length over the intron's, rounded to four digits.
    """
    span = F.col("tr_end") - F.col("tr_start")
    kept = ("tr_start", "tr_end", "period", "consensus", "copies", "score", "substitutions", "insertions",
            "deletions")
    named = with_consensus_family(hits)
    strand = F.col("kind.strand")
    first_longest = F.struct(
        span.alias("n"), (-F.col("tr_start")).alias("at"), (-F.col("period")).alias("p"), F.col("consensus").alias("c"))
    best = named.groupBy(by).agg(
        F.max_by(F.struct(*kept, "kind"), first_longest).alias("b"),
        F.bool_or(strand == "fwd").alias("fwd"), F.bool_or(strand == "rev").alias("rev"), F.count("*").alias("n_hits"))
    orient = (
        F.when(F.col("fwd") & F.col("rev"), "converging")
        .when(F.col("b.kind.strand") == "fwd", "coding-strand").otherwise("template-strand"))
    return introns.join(best.where(F.col("b.kind").isNotNull()), by).select(
        *introns.columns, F.col("b.kind.family").alias("repeat_type"),
        *[F.col(f"b.{c}").alias(c) for c in kept], "n_hits", orient.alias("orientation"),
        F.round((F.col("b.tr_end") - F.col("b.tr_start")) / F.col("length"), 4).alias("tr_coverage"))


def finder_survey(
    features: DataFrame, hits: DataFrame, keys: Sequence[str] = ("contig",), max_len: int = I.INTRON_MAX,
) -> DataFrame:
    """Second survey from features: introns, one per interval, meet the repeat finder's hits by name.

    An intron's name, and its hits' ``seq_id``, is its keys, start and end joined by ``|``.  Introns without hits, or
    whose longest hit has no known family, give no row.
    """
    gaps = I.introns(features, [*keys, "parent"]).where(F.col("length").between(I.INTRON_MIN, max_len))
    single = I.first_per_interval(gaps, [*keys, "start", "end"], ["parent"]).withColumnRenamed("parent", "mrna")
    named = single.withColumn("seq_id", F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "start", "end")]))
    return repeat_finder_survey(named, hits)
