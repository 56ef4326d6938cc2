"""Blocks of a table that Spark joins by key, and Arrow columns as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from repeatloom.llm.rows import release
from repeatloom.operators.durable import scratch_path

#: Blocks in a row group of a Parquet file: Spark's reader decodes a row group at once, and a writer holds one back.
TOGETHER = 8


def block_numbers() -> Iterator[int]:
    """Numbers that no other task of the same stage gives; what carries them is written before it is read twice."""
    first = TaskContext.get().partitionId() << 32
    return (first + i for i in range(1 << 32))


def written(df: DataFrame, name: str, together: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; where rows are blocks, row groups hold ``together`` of them."""
    path = scratch_path(df.sparkSession, name)
    _grouped(df, together).parquet(path)
    return df.sparkSession.read.parquet(path)


def _grouped(df: DataFrame, together: int | None) -> DataFrameWriter:
    return df.write.option("parquet.block.row.count.limit", together) if together else df.write


def bucketed(df: DataFrame, name: str, by: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table in buckets of ``by``, which joins on ``by`` read in place, and what forgets the table's name.

    There are as many buckets as the session has shuffle partitions, so that the other side of a join is dealt alike.
    The files lie in the shared folder, with ``TOGETHER`` rows in a row group.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _grouped(df, TOGETHER).option("path", path).bucketBy(parts, by).saveAsTable(table)
    return spark.table(table), lambda: spark.sql(f"DROP TABLE IF EXISTS {table}")


def numbers(column: pa.ChunkedArray | pa.Array, row: int) -> np.ndarray:
    """The array of integers in one row."""
    return column[row].values.to_numpy(zero_copy_only=False)


def table_of(schema: pa.Schema, columns: list) -> pa.Table:
    release()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
