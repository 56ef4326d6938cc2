"""Readers: annotation, sequence, variant, alignment and table files.

Each ``parse_*`` function works on a DataFrame of text lines (column ``value``);
each ``read_*`` function adds the file scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatloom.functions import scalars as S
from repeatloom.operators.durable import once

# --- fixed values -----------------------------------------------------------
ACCESSION = r"(GC[AF]_\d+\.\d+)"
HIT_CONTIG = r"(NW_\d+\.\d+)"
FINDER_COLUMNS = (
    "SeqID", "Start", "End", "Period", "Score", "Consensus", "#copies", "#substitutions",
    "#insertions", "#deletions",
)
GENE_TYPES = ("gene",)
TRANSCRIPT_TYPES = ("mRNA", "transcript", "lnc_RNA", "rRNA", "tRNA")
EXON_TYPES = ("exon", "CDS")
HEADS = ("accession", "assembly accession", "assembly_accession", "#assembly_accession", "acc")
# ---------------------------------------------------------------------------


def _fields(lines: DataFrame, least: int) -> DataFrame:
    return once(
        lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), f=F.split("value", "\t")
    ).where(F.size("f") >= least)


def _number(text: Column, kind: str = "bigint") -> Column:
    """The number that a cell holds, null if it holds none."""
    return text.try_cast(kind)


def rejected(lines: DataFrame, least: int, numbers: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Lines that a reader leaves out: too few columns, or no whole number in one of ``numbers``; per ``by``."""
    cells = once(lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), f=F.split("value", "\t"))
    bad = F.size("f") < least
    for i in numbers:
        bad = bad | _number(F.get(F.col("f"), F.lit(i))).isNull()
    return cells.groupBy(*by).agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_rejected"))


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF3 features, 0-based half-open, attributes as a map.

    Lines with fewer than nine columns or without whole numbers as places are
    skipped (``rejected`` counts them).  Columns besides ``value``
    (a genome name, a line number) are kept.
    """
    rest = [c for c in lines.columns if c != "value"]
    f = F.col("f")
    pairs = F.transform(
        F.regexp_extract_all(f[8], F.lit(r"(\w+=[^;]+)"), F.lit(1)), lambda kv: F.split(kv, "=", 2))
    names = F.transform(pairs, lambda p: p[0])
    unique = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p[0]))
    placed = _fields(lines, 9).where(_number(f[3]).isNotNull() & _number(f[4]).isNotNull())
    return placed.select(
        *rest, f[0].alias("contig"), f[1].alias("source"), f[2].alias("ftype"),
        (_number(f[3]) - 1).alias("start"), _number(f[4]).alias("end"), f[6].alias("strand"),
        F.map_from_entries(F.transform(unique, lambda p: F.struct(p[0], p[1]))).alias("attrs"),
    )


def read_gff(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_gff(with_file_name(spark.read.text(path)))


def gene_tables(features: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genes, transcripts and exon rows of a feature table."""
    a = F.col("attrs")
    genes = features.where(F.col("ftype").isin(*GENE_TYPES)).select(
        *keep, F.coalesce(a["ID"], F.lit("")).alias("gene_id"),
        F.coalesce(a["Name"], a["gene"], a["ID"], F.lit("")).alias("gene_name"),
        F.coalesce(a["gene_biotype"], F.lit("?")).alias("gene_biotype"),
        "source", "contig", "start", "end", "strand")
    transcripts = features.where(F.col("ftype").isin(*TRANSCRIPT_TYPES)).select(
        *keep, F.coalesce(a["ID"], F.lit("")).alias("transcript_id"),
        F.coalesce(a["Parent"], F.lit("")).alias("gene_id"), "contig", "strand", "source")
    exons = features.where(F.col("ftype").isin(*EXON_TYPES)).select(
        *keep, F.coalesce(a["Parent"], F.lit("")).alias("parent"), "contig", "ftype", "start", "end", "strand")
    return genes, transcripts, exons


def parse_vcf(lines: DataFrame, min_len: int = 30) -> DataFrame:
    """Insertions with sequence: ``chrom, pos, sv_id, ins_seq``; lines without a position are skipped."""
    rest = [c for c in lines.columns if c != "value"]
    f = F.col("f")
    return _fields(lines, 5).where(_number(f[1]).isNotNull()).select(
        *rest, f[0].alias("chrom"), _number(f[1]).alias("pos"), f[2].alias("sv_id"),
        S.inserted_sequence(f[3], f[4], F.coalesce(F.get(f, F.lit(7)), F.lit("")), min_len).alias("ins_seq"))


def read_vcf(spark: SparkSession, path: str | Sequence[str], min_len: int = 30) -> DataFrame:
    return parse_vcf(spark.read.text(path), min_len)


def parse_alignment_hits(lines: DataFrame, contig_pattern: str | None = HIT_CONTIG) -> DataFrame:
    """Tabular alignment hits with query length and the query's own place.

    The query name has five parts joined by ``|``; the third is its contig and
    the fourth ``start-end``.  Subject ends are put in order.  Lines with a cell that
    is no number are skipped; without a query length the covered share is null.
    """
    rest = [c for c in lines.columns if c != "value"]
    f = F.col("f")
    q = F.split(f[0], r"\|")
    place = F.split(F.get(q, F.lit(3)), "-")
    contig = f[1]
    if contig_pattern:
        found = F.regexp_extract(f[1], contig_pattern, 1)
        contig = F.when(found != "", found).otherwise(f[1])
    num = lambda i: _number(f[i])
    return (
        _fields(lines, 14)
        .where((F.size(q) >= 5) & (F.size(place) == 2) & num(8).isNotNull() & num(9).isNotNull())
        .select(
            *rest, f[0].alias("qseqid"), F.get(q, F.lit(2)).alias("src_contig"),
            F.expr("try_cast(split(split(f[0], '[|]')[3], '-')[0] as bigint)").alias("src_start"),
            F.expr("try_cast(split(split(f[0], '[|]')[3], '-')[1] as bigint)").alias("src_end"),
            contig.alias("hit_contig"), _number(f[2], "double").alias("pident"),
            F.least(num(8), num(9)).alias("hit_start"), F.greatest(num(8), num(9)).alias("hit_end"),
            F.try_divide(num(7) - num(6) + 1, num(12)).alias("qcov"))
        .dropna(subset=["src_start", "src_end", "pident"])
    )


def read_alignment_hits(spark: SparkSession, path: str | Sequence[str], **kw: str) -> DataFrame:
    return parse_alignment_hits(with_file_name(spark.read.text(path)), **kw)


def parse_repeat_finder(lines: DataFrame, min_span: int = 10) -> DataFrame:
    """Repeat-finder table: noise and header lines go, bad casts and short hits too."""
    kinds = ("string", "bigint", "bigint", "bigint", "double", "string", "double", "bigint", "bigint", "bigint")
    names = ("seq_id", "tr_start", "tr_end", "period", "score", "consensus", "copies", "substitutions",
             "insertions", "deletions")
    rest = [c for c in lines.columns if c != "value"]
    cells = once(lines.where(~F.col("value").startswith("SeqID")), f=F.split("value", "\t")).where(
        F.size("f") >= len(FINDER_COLUMNS))
    cast = once(cells, **{
        name: F.expr(f"try_cast(f[{i}] as {kind})") for i, (name, kind) in enumerate(zip(names, kinds))})
    return cast.select(*rest, *names).dropna(subset=list(names)).where(
        F.col("tr_end") - F.col("tr_start") >= min_span)


def read_repeat_finder(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_repeat_finder(with_file_name(spark.read.text(path)))


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str, accession: bool = False) -> DataFrame:
    """Header TSV with a declared schema; the accession can come from the file name."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return with_file_name(df) if accession else df


def parse_catalog(lines: DataFrame) -> DataFrame:
    """Accession catalog of at least five columns: short rows, rows without accession and the header go.

    Names are cleaned, bases default to 0.
    """
    f = F.col("f")
    return (
        once(lines, f=F.split("value", "\t")).where((F.size("f") >= 5) & (F.trim(f[0]) != "") & ~F.lower(f[0]).isin(*HEADS))
        .select(
            f[0].alias("acc"), F.regexp_replace(f[1], "[ /]", "_").alias("name"),
            F.coalesce(F.expr("try_cast(get(f, 4) as bigint)"), F.lit(0)).alias("genome_bp")))


def read_json(
    spark: SparkSession, path: str | Sequence[str], schema: str, one_per_line: bool = False,
) -> DataFrame:
    """Ledgers, groups and pairs kept as JSON: one document per file, or one per line, which Spark can split."""
    return spark.read.json(path, schema=schema, multiLine=not one_per_line)


def with_file_name(df: DataFrame, pattern: str = ACCESSION) -> DataFrame:
    """Many files as one table: ``file`` and the accession in its name."""
    name = F.col("_metadata.file_name")
    return df.select(*[c for c in df.columns], name.alias("file"), F.regexp_extract(name, pattern, 1).alias("acc"))


# --- FASTA ------------------------------------------------------------------

def read_fasta_records(
    spark: SparkSession, path: str | Sequence[str], upper: bool = True, whole_header: bool = False,
    min_len: int = 0,
) -> DataFrame:
    """One row per record; for records that fit in a row (introns, linkers, contigs)."""
    raw = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    header = F.trim(F.split(body, "\n", 2)[0])
    seq = F.regexp_replace(F.coalesce(F.get(F.split(body, "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    return raw.select(
        (header if whole_header else F.regexp_extract(header, r"^(\S*)", 1)).alias("contig"),
        (F.upper(seq) if upper else seq).alias("seq")).where(F.length("seq") >= min_len)


def read_fasta_chunks(
    spark: SparkSession, path: str | Sequence[str], size: int = 16_384, contigs: DataFrame | None = None,
) -> DataFrame:
    """Chromosome-sized FASTA as ``(file, contig, chunk_no, chunk_start, seq)``.

    No record is ever one row: lines stay rows.  A line's place follows from the
    block of the file it was read from and its row number in that block; letters
    before it are summed within blocks and carried from block to block.  With
    ``contigs`` only the listed ones are kept.
    """
    m = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        m["file_path"].alias("file"), m["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("row"), F.upper(F.trim("value")).alias("text"),
        F.trim("value").alias("raw"))
    head = F.col("raw").startswith(">")
    lines = lines.withColumns({
        "name": F.when(head, F.regexp_extract("raw", r"^>(\S*)", 1)),
        "n": F.when(head, 0).otherwise(F.length("text")),
    }).drop("raw")
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumns({
        "own": F.last("name", ignorenulls=True).over(inside),
        "upto": F.sum("n").over(inside),
    })
    head_at = F.when(F.col("name").isNotNull(), F.col("upto"))
    local = local.withColumn("own_at", F.last(head_at, ignorenulls=True).over(inside))
    across = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(
        F.sum("n").alias("len"),
        F.max_by(F.when(F.col("name").isNotNull(), F.col("name")), F.when(F.col("name").isNotNull(), F.col("row"))).alias("last_name"),
        F.max(F.when(F.col("name").isNotNull(), F.col("row"))).alias("last_row"))
    tails = local.join(blocks.select("file", "block", "last_row"), ["file", "block"]).where(
        F.col("row") == F.col("last_row")).select("file", "block", F.col("upto").alias("last_at"))
    blocks = blocks.join(tails, ["file", "block"], "left").withColumn(
        "base", F.coalesce(F.sum("len").over(across), F.lit(0)))
    blocks = blocks.withColumns({
        "in_name": F.last("last_name", ignorenulls=True).over(across),
        "in_at": F.last(F.col("base") + F.col("last_at"), ignorenulls=True).over(across),
    }).select("file", "block", "base", "in_name", "in_at")
    placed = (
        local.join(blocks, ["file", "block"])
        .where(F.col("name").isNull() & (F.col("n") > 0))
        .withColumn("contig", F.coalesce("own", "in_name"))
        .withColumn("at", F.col("base") + F.col("upto") - F.col("n") - F.coalesce(
            F.when(F.col("own").isNotNull(), F.col("base") + F.col("own_at")), F.col("in_at")))
    )
    if contigs is not None:
        placed = placed.join(contigs.select("contig").distinct(), "contig", "left_semi")
    return _lines_to_chunks(placed, size)


def _lines_to_chunks(lines: DataFrame, size: int) -> DataFrame:
    """Lines with ``contig, at, text`` cut at chunk borders and joined per chunk."""
    at, n = F.col("at"), F.col("n")
    parts = F.transform(
        F.sequence(F.floor(at / size).cast("int"), F.floor((at + n - 1) / size).cast("int")),
        lambda c: F.struct(
            c.alias("chunk_no"),
            F.greatest(at, c.cast("long") * size).alias("from"),
            F.least(at + n, (c.cast("long") + 1) * size).alias("to")))
    cut = lines.select("file", "contig", "at", "text", F.explode(parts).alias("_c"))
    piece = F.substring(
        F.col("text").cast("binary"), (F.col("_c.from") - at + 1).cast("int"),
        (F.col("_c.to") - F.col("_c.from")).cast("int")).cast("string")
    return (
        cut.select("file", "contig", F.col("_c.chunk_no").alias("chunk_no"),
                   F.struct(F.col("_c.from").alias("from"), piece.alias("piece")).alias("p"))
        .groupBy("file", "contig", "chunk_no")
        .agg(F.array_join(F.sort_array(F.collect_list("p"))["piece"], "").alias("seq"))
        .withColumn("chunk_start", F.col("chunk_no").cast("long") * size)
        .select("file", "contig", "chunk_no", "chunk_start", "seq")
    )
