"""Streaming resume, an extension: new ledger files are folded into the set of finished chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.plans.complete import LEDGER


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ledger entries from the Parquet files of a folder."""
    return spark.readStream.schema(LEDGER).parquet(path)


def finished(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append every successful entry that was not seen before to `out`, once, and stop when the folder is read."""
    new = entries(spark, path).where("error IS NULL").dropDuplicates(["chunk_id", "seq"])
    return new.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
