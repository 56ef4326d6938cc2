"""Writers: tables, per-genome folders, FASTA text and nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed column order as text, missing columns and values as ''."""
    have = set(df.columns)
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
        for c in columns])


def write_table(df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Fixed-column TSV with a header, one folder per value of ``by``."""
    out = table_form(df, columns).write.mode(mode)
    if by:
        out = out.partitionBy(*by)
    out.csv(path, sep="\t", header=True, emptyValue="", quoteAll=False)


def fasta_lines(df: DataFrame, name: str = "id", seq: str = "seq") -> DataFrame:
    """One text row ``>id\\nseq`` per record."""
    return df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(
    df: DataFrame, path: str, name: str = "id", seq: str = "seq", min_len: int = 0,
    classes: Sequence[str] = (), class_col: str = "classification", mode: str = "overwrite",
) -> None:
    """FASTA text of the records that are long enough and of a listed class."""
    kept = df.where(F.length(seq) >= min_len)
    if classes:
        kept = kept.where(F.col(class_col).isin(*classes))
    fasta_lines(kept, name, seq).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested summary rows as JSON lines."""
    df.write.mode(mode).json(path)


def capped(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """First rows of a sorted report list."""
    return df.orderBy(*order).limit(limit)


def write_chunks(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("contig",)) -> None:
    """Sequence chunks bucketed by contig and chunk.

    Joins of ranges with this table shuffle only the ranges.
    """
    (df.write.mode("overwrite").bucketBy(buckets, *keys, "chunk_no").sortBy(*keys, "chunk_no").saveAsTable(table))
