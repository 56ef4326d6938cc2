"""Resumable runs: new introns are screened as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from repeatloom.plans.surveys import screen


def screen_new_files(
    spark: SparkSession, source: str, schema: str, out: str, progress: str, files_per_batch: int = 64,
) -> StreamingQuery:
    """Screens the Parquet intron files not seen by an earlier run, then stops.

    The checkpoint at ``progress`` is the ledger of files; it and ``out`` belong in
    a shared folder.  Screening is narrow, so a batch needs no state, and a batch
    that fails is run again as a whole.
    """
    rows: DataFrame = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    return (
        screen(rows).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", progress)
        .trigger(availableNow=True).start())
