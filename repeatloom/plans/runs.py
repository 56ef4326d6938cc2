"""The survey from files to files: catalog, annotation and sequence in; tables, boundary JSON and a ledger out.

A run writes its rows first, under its own run number, and then one ledger row per accession.  The ledger row is the
commit: ``survey_rows`` and ``boundary_rows`` show an accession's rows of the run that its ledger row names, and no
others.  A run that is killed before its ledger rows are written leaves nothing that shows, and the next run takes up
the same accessions again.  A forced run replaces the ledger rows of its accessions (dynamic partition overwrite), so
their earlier rows go and the new ones come in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.functions import motifs as M
from repeatloom.operators import arrays as A
from repeatloom.operators import intervals as I
from repeatloom.operators import sequences as Q
from repeatloom.operators import summaries as G
from repeatloom.operators.durable import cut
from repeatloom.plans import surveys as P
from repeatloom.sinks import writers as W
from repeatloom.sources import readers as R

# --- fixed values -----------------------------------------------------------
TOP_MOTIFS, TOP_BY_ORIENTATION = 5, 3
# ---------------------------------------------------------------------------

LEDGER = (
    "name string, genome_bp bigint, status string, error string, n_introns bigint, n_kept bigint, n_gt_ag bigint, "
    "top_donor string, top_acceptor string, fingerprint_pct double, run string, acc string")
PLACED_COLUMNS = (*P.SCREEN_COLUMNS, "acc", "run")
BOUNDARY = (
    "n_kept bigint, n_gt_ag bigint, top_donor_4 array<struct<motif: string, n: bigint>>, "
    "top_acceptor_4 array<struct<motif: string, n: bigint>>, orientations array<struct<orientation: string, n: bigint, "
    "top_acceptor: array<struct<motif: string, n: bigint>>>>, acc string, run string")


def accession_in(path: Column, pattern: str = R.ACCESSION) -> Column:
    """The last accession in a path: in the file's name or the name of a folder that it lies in."""
    return F.element_at(F.regexp_extract_all(path, F.lit(pattern), F.lit(1)), -1)


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """One row per accession done so far; empty before the first run."""
    return _or_empty(spark, LEDGER, lambda: spark.read.schema(LEDGER).json(f"{out}/ledger"))


def _committed(spark: SparkSession, rows: DataFrame, out: str) -> DataFrame:
    return rows.join(read_ledger(spark, out).select("acc", "run"), ["acc", "run"], "left_semi")


def survey_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows kept, as text, with ``acc`` and ``run``."""
    schema = ", ".join(f"`{c}` string" for c in PLACED_COLUMNS)
    table = _or_empty(spark, schema, lambda: spark.read.csv(f"{out}/kept", sep="\t", header=True, schema=schema))
    return _committed(spark, table, out)


def boundary_rows(spark: SparkSession, out: str) -> DataFrame:
    """Boundary motifs per accession that has rows."""
    return _committed(
        spark, _or_empty(spark, BOUNDARY, lambda: spark.read.schema(BOUNDARY).json(f"{out}/boundary")), out)


def boundary_details(kept: DataFrame, genome: str = "acc") -> DataFrame:
    """Totals and the most common boundary motifs per genome, and per orientation, nested."""
    counts = G.boundary_counts(kept, genome)
    order = [F.desc("n"), F.asc("motif")]

    def listed(rows: DataFrame, group: Sequence[str], k: int) -> DataFrame:
        best = G.top_k(rows, group, order, k)
        in_order = F.sort_array(F.collect_list(F.struct("rank", "motif", "n")))
        return best.groupBy(*group).agg(
            F.transform(in_order, lambda x: F.struct(x["motif"].alias("motif"), x["n"].alias("n"))).alias("top"))

    sides = listed(counts.groupBy(genome, "side", "motif").agg(F.sum("n").alias("n")), [genome, "side"], TOP_MOTIFS)
    tops = sides.groupBy(genome).agg(*[
        F.first(F.when(F.col("side") == s, F.col("top")), ignorenulls=True).alias(f"top_{s}_4")
        for s in ("donor", "acceptor")])
    by_class = listed(
        counts.where(F.col("side") == "acceptor"), [genome, "orientation"], TOP_BY_ORIENTATION)
    classes = (
        kept.groupBy(genome, "orientation").agg(F.count("*").alias("n"))
        .join(by_class, [genome, "orientation"], "left").groupBy(genome)
        .agg(F.sort_array(F.collect_list(F.struct("orientation", "n", F.col("top").alias("top_acceptor")))).alias(
            "orientations")))
    totals = G.boundary_totals(kept, genome).select(genome, F.col("n_total").alias("n_kept"), "n_gt_ag")
    return totals.join(tops, genome, "left").join(classes, genome, "left")


def _present(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Accessions that have a file; only the listing is read, no content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        accession_in(F.col("path")).alias("acc")).where(F.col("acc").isNotNull()).distinct()


def _texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", accession_in(F.col("_metadata.file_path")).alias("acc"))


def survey(
    spark: SparkSession, catalog: str, annotation: str | Sequence[str], sequence: str | Sequence[str], out: str,
    only: str | None = None, force: bool = False, max_bp: int | None = None,
    families: Sequence[str] = M.SURVEY_FAMILIES, least: float = P.KEEP_COVERAGE, size: int = Q.CHUNK,
    running: bool = True, per_transcript: bool = False,
) -> DataFrame:
    """Surveys the catalog's accessions that have no ledger row yet and returns the report of all.

    ``annotation`` (GFF3) and ``sequence`` (FASTA) are folders or files with the accession in a file's or folder's
    name.  ``only`` and ``force`` are those of ``todo``; genomes above ``max_bp`` get a ledger row of their own, and so
    do accessions without a file of either kind (``failed``, ``input_missing``).  An accession listed twice counts
    once, with the smaller name; one without introns, or with none that is kept, is ``ok`` with zeros.  An intron
    outside its contig, or on a contig without sequence, has no text and isn't counted.

    Texts are scanned once: coverages, and the texts of what is kept, are written to the shared folder, and all outputs
    are made from them.
    """
    run = uuid.uuid4().hex
    listed = R.parse_catalog(spark.read.text(catalog))
    listed = listed.groupBy("acc").agg(F.min(F.struct("name", "genome_bp")).alias("c")).select("acc", "c.*")
    ledger = read_ledger(spark, out)
    wanted = cut(P.todo(listed, ledger, only, force))
    fits = wanted if max_bp is None else P.todo(wanted, ledger, force=True, max_bp=max_bp)
    has_both = _present(spark, annotation).join(_present(spark, sequence), "acc")
    work = fits.join(has_both, "acc", "left_semi").select("acc", "name")

    features = R.gene_tables(R.parse_gff(_texts(spark, annotation).join(work, "acc", "left_semi")), ["acc"])[2]
    chunks = R.read_fasta_chunks(spark, sequence, size, features).withColumn("acc", accession_in(F.col("file")))
    introns = P.intron_texts(features, chunks.drop("file"), I.INTRON_MAX, size, ("acc", "contig"), running, per_transcript)
    covered = A.with_best_family(introns, families)
    passes = F.col("telo_coverage") >= least
    scanned = cut(covered.select(
        "acc", "contig", "start", "end", "length", "strand", "mrna", "donor", "acceptor", "telo_coverage", "repeat_type",
        F.when(passes, F.col("seq")).alias("seq")))
    kept = A.with_splice_form(A.with_strand_class(scanned.where(F.col("seq").isNotNull())))
    named = kept.join(work, "acc").withColumns({
        "genome_acc": F.col("acc"), "genome_name": F.col("name"), "intron_seq": F.col("seq"), "run": F.lit(run)})
    W.write_table(named.hint("rebalance", "acc"), f"{out}/kept", PLACED_COLUMNS, ["acc", "run"], "append")
    boundary_details(kept).withColumn("run", F.lit(run)).write.mode("append").partitionBy("acc", "run").json(
        f"{out}/boundary")

    counts = scanned.groupBy("acc").agg(F.count("*").alias("n_introns"), F.count("seq").alias("n_kept"))
    tops = P.genome_survey(kept, "acc").select("acc", "n_gt_ag", "top_donor", "top_acceptor", "fingerprint_pct")
    big = F.lit(False) if max_bp is None else F.coalesce(F.col("genome_bp") > max_bp, F.lit(False))
    here = F.col("_here").isNotNull()
    rows = (
        wanted.join(has_both.withColumn("_here", F.lit(1)), "acc", "left").join(counts, "acc", "left")
        .join(tops, "acc", "left")
        .withColumns({
            "status": F.when(big, "skipped_too_large").when(here, "ok").otherwise("failed"),
            "error": F.when(~big & ~here, "input_missing"), "run": F.lit(run)})
        .fillna(0, ["n_introns", "n_kept", "n_gt_ag"]))
    _commit(rows.select(*[c.split()[0] for c in LEDGER.split(", ")]), out)
    return P.catalog_report(listed, read_ledger(spark, out).drop("name", "genome_bp"))


def _commit(rows: DataFrame, out: str) -> None:
    """One ledger row per accession of this run, in place of earlier ones; other accessions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("acc").json(f"{out}/ledger")
