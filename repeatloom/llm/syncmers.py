"""Document fingerprints from closed syncmers of words.

A run of ``K`` words is chosen if the smallest hash of its inner runs of ``S`` words is that of its first or its last
one.  The choice looks at nothing but the run itself, so texts that share a passage choose the same runs in it,
wherever it stands.  The fingerprint is the chosen runs' codes in text order; likeness is the share of common codes.
All of it is array expressions on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.llm.rows import free_name, quoted
from repeatloom.operators.ordered import value_bin

K, S = 5, 2


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of anchor codes (long) of the string column ``text`` in text order.

    A text of fewer than ``K`` words, or one of which no run is chosen, has one code of all its words; a text without words, and null, have
    none.
    """
    words, singles, pairs, at = (free_name(df, f"{out}_{n}") for n in ("words", "singles", "pairs", "at"))
    blank = F.array().cast("array<bigint>")
    inner = range(K - S + 1)
    p = lambda i, j: F.get(F.col(pairs), i + j)
    chosen = lambda i: F.least(*[p(i, j) for j in inner]) == F.least(p(i, 0), p(i, K - S))
    return (
        df.withColumn(words, F.filter(F.split(F.coalesce(quoted(text), F.lit("")), "[ \\t-\\r]+"), lambda w: w != ""))
        .withColumn(singles, F.transform(F.col(words), lambda w: F.xxhash64(w)))
        .withColumn(pairs, F.transform(
            _places(F.size(singles) - S + 1), lambda i: F.xxhash64(F.get(F.col(singles), i), F.get(F.col(singles), i + 1))))
        .withColumn(at, F.filter(_places(F.size(singles) - K + 1), chosen))
        .withColumn(out, F.when(F.size(singles) == 0, blank)
                    .when(F.size(at) == 0, F.array(F.xxhash64(F.array_join(words, " "))))
                    .otherwise(F.transform(F.col(at), lambda i: F.xxhash64(p(i, 0), p(i, 2), p(i, 3)))))
        .drop(words, singles, pairs, at))


def _places(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def as_text(codes: Column) -> Column:
    """The fingerprint: 16 hexadecimal digits for each anchor, in text order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Common share (0 to 1) of two arrays of distinct codes; two texts without words are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))).cast("double")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, codes, fingerprint`` per row; equal texts have equal fingerprints, repeated rows one each."""
    named = df.select(quoted(id_col).alias(id_col), quoted(text_col).alias("_text_"))
    return with_codes(named, "_text_", "codes").select(
        id_col, "codes", as_text(F.col("codes")).alias("fingerprint"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, codes, next_text, next_codes``: each row beside the next one in descending order of id.

    Behind the last row comes the first again.  Rows are dealt out once, in bins between quantiles of the id (as many
    as there are shuffle partitions, at least 4), and the first row of the following bin is added to each bin, so that no
    task holds more than a bin.  Null texts are empty; null ids come last; rows with one id are in descending order of
    text.  The rows that the bins' heads are found by are at most as many as there are bins.
    """
    session = df.sparkSession
    parts = max(4, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("bin", F.coalesce(value_bin(rows, "id", parts), F.lit(-1)))
    heads = rows.groupBy("bin").agg(F.max("id").alias("head"))
    down = Window.orderBy(F.desc("bin"))
    after = heads.select(
        "bin", F.coalesce(F.lag("bin").over(down), F.min("bin").over(Window.partitionBy())).alias("goes_to"), "head")
    carried = (
        rows.alias("r").join(F.broadcast(after).alias("h"), (F.col("r.bin") == F.col("h.bin"))
                             & F.col("r.id").eqNullSafe(F.col("h.head")))
        .groupBy("goes_to", "id").agg(F.max("text").alias("text"))
        .select("id", "text", F.col("goes_to").alias("bin"), F.lit(True).alias("carried")))
    dealt = rows.withColumn("carried", F.lit(False)).unionByName(carried).repartition(parts, "bin")
    coded = with_codes(dealt, "text", "codes").withColumn("codes_set", F.array_distinct("codes"))
    order = Window.partitionBy("bin").orderBy("carried", F.desc_nulls_last("id"), F.desc("text"))
    return (
        coded.withColumn("next_text", F.lead("text").over(order)).withColumn("next_set", F.lead("codes_set").over(order))
        .where(~F.col("carried")).select("id", "text", "codes", "codes_set", "next_text", "next_set"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its second half replaced by the beginning of the next one.

    ``id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``; see ``with_next`` for the
    order and for nulls and ties.
    """
    paired = with_next(df, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    both = with_codes(edited, "edited", "new_codes")
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited", as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("new_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes_set"), F.array_distinct("new_codes")).alias("near_edited"),
        likeness(F.col("codes_set"), F.col("next_set")).alias("near_next"))
