"""Neighbours in position order that never gather one key in one task.

A window over ``partitionBy(key)`` would hand a contig with a third of all rows
to a single task.  The helpers here split each key into position bins, solve the
bins with ordinary windows, and carry one summary row per bin across the bins.
The carry table has one row per non-empty bin, so its window stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 20


def position_bin(pos: str, width: int = BIN) -> Column:
    return F.floor(F.col(pos) / width).cast("long")


def value_bin(df: DataFrame, value: str, parts: int | None = None) -> Column:
    """Bin number by value, for orders over a whole table.

    The borders are at most ``parts`` approximate quantiles, by default four times
    the session's shuffle partitions, so bins follow the size a cluster is set up for.  They are fixed
    before the job, so a task that runs again puts a row in the same bin.
    """
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = df.stat.approxQuantile(value, [i / parts for i in range(1, parts)], 0.5 / parts)
    marks = F.array(*[F.lit(b) for b in sorted(set(borders))]) if borders else F.array(F.lit(0.0))
    return F.aggregate(
        marks, F.lit(0), lambda n, m: n + (m < F.col(value)).cast("int")).cast("long")


def _dealt(df: DataFrame, keys: Sequence[str], pos: str, value: str, bin_by: Column | None) -> tuple[DataFrame, bool]:
    """``df`` with its bin, and whether it is dealt by key and bin here.

    Where there are no other columns, the rows and the carry ask for the same ones, so one exchange serves both; with
    others the carry is cheaper from its own, which combines on the map side.  Filters on one side, such as a join's on
    null keys, would make it two exchanges; they don't pass a column that isn't called deterministic.
    """
    binned = df.withColumn("_bin", position_bin(pos) if bin_by is None else bin_by)
    if not set(df.columns) <= {*keys, pos, value}:
        return binned, False
    return binned.repartition(*keys, "_bin").withColumn(value, F.when(F.spark_partition_id() >= 0, F.col(value))), True


def _with_carry(local: DataFrame, tails: DataFrame, keys: Sequence[str], carry: Column) -> DataFrame:
    """Joins the bins' carries to their rows; bins that nothing comes to are not sent."""
    told = tails.withColumn("_carry", carry).where(F.col("_carry").isNotNull()).select(*keys, "_bin", "_carry")
    return local.join(told, [*keys, "_bin"], "left")


def running(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, fold: str,
    upto_self: bool = False, from_top: bool = False, bin_by: Column | None = None,
) -> DataFrame:
    """``fold`` (sum, max or min) of ``value`` over the rows before, by ``pos``.

    ``upto_self`` includes the row itself, ``from_top`` walks downwards.  ``pos``
    is unique within a key.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[fold]
    both = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[fold]
    turn = F.desc if from_top else F.asc
    binned, together = _dealt(df, keys, pos, value, bin_by)
    inside = Window.partitionBy(*keys, "_bin").orderBy(turn(pos))
    across = Window.partitionBy(*keys).orderBy(turn("_bin"))
    local = binned.withColumn("_local", agg(value).over(
        inside.rowsBetween(Window.unboundedPreceding, 0 if upto_self else -1)))
    if together:
        local = local.withColumn("_end", F.lead(F.lit(1)).over(inside).isNull())
        tail = F.col("_local") if upto_self else both(F.col("_local"), F.col(value))
        tails = local.where("_end").select(*keys, "_bin", tail.alias("_tail"))
        local = local.drop("_end")
    else:
        tails = binned.groupBy(*keys, "_bin").agg(agg(value).alias("_tail"))
    before = agg("_tail").over(across.rowsBetween(Window.unboundedPreceding, -1))
    return _with_carry(local, tails, keys, before).withColumn(
        out, both(F.col("_local"), F.col("_carry"))).drop("_local", "_carry", "_bin")


def previous_max(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """Largest ``value`` of all rows before, by ``pos``; null for the first."""
    return running(df, keys, pos, value, out, "max")


def previous_value(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, bin_by: Column | None = None,
) -> DataFrame:
    """``value`` of the row before, by ``pos`` (unique within a key)."""
    binned, together = _dealt(df, keys, pos, value, bin_by)
    inside = Window.partitionBy(*keys, "_bin").orderBy(pos)
    across = Window.partitionBy(*keys).orderBy("_bin")
    local = binned.withColumn("_local", F.lag(value).over(inside))
    if together:
        local = local.withColumn("_end", F.lead(F.lit(1)).over(inside).isNull())
        tails = local.where("_end").select(*keys, "_bin", F.col(value).alias("_tail"))
        local = local.drop("_end")
    else:
        tails = binned.groupBy(*keys, "_bin").agg(F.max_by(value, pos).alias("_tail"))
    return _with_carry(local, tails, keys, F.lag("_tail").over(across)).withColumn(
        out, F.coalesce("_local", "_carry")).drop("_local", "_carry", "_bin")


def attach_to_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    how: str = "left", salts: int | None = None,
) -> DataFrame:
    """Join a per-key table back to rows whose keys may be very uneven.

    ``groups`` has one row per key.  It is repeated once per salt and the rows
    are spread over the salts, so a key with a third of the rows is shared by
    ``salts`` tasks (by default the session's shuffle partitions).  ``spread_by`` names columns that tell the rows of one key
    apart; a salt made from them stays the same when a task is run again.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")
