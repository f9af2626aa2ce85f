"""Continuous forms: weekly appends with key replacement, and price levels by time window."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quoteloom.operators.tables import upsert


def windowed_levels(quotes: DataFrame, *, time: str = "ingested_at", window: str = "7 days", late: str = "14 days") -> DataFrame:
    """Per brand and window (weeks begin on Mondays): quotes, and sum and count of log prices; later rows than ``late`` are left out.

    ``quotes`` may be a stream or a table. Sums and counts merge over windows, where means and medians would not.
    """
    priced = quotes.where("quoted and premium > 0 and not isnan(premium)").withColumn("t_", F.col(time).cast("timestamp"))
    if quotes.isStreaming:
        priced = priced.withWatermark("t_", late)
    # windows are counted from 1 January 1970, a Thursday; four days on is a Monday
    grouped = priced.groupBy(F.window("t_", window, startTime="4 days"), "brand").agg(F.count("*").alias("n"), F.sum(F.ln("premium")).alias("log_sum"))
    return grouped.select(F.col("window.start").cast("date").alias("window_start"), "brand", "n", "log_sum")


def upsert_stream(stream: DataFrame, table_path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys in the Parquet table at ``table_path``.

    A batch writes a new version beside the old and moves the pointer file last, so a batch that is run again
    after a failure starts from the version before it and leaves the same table.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        before = current_version(table_path, below=epoch)
        old = batch.sparkSession.read.parquet(f"{table_path}/v{before}") if before is not None else None
        (batch if old is None else upsert(old, batch, keys)).write.mode("overwrite").parquet(f"{table_path}/v{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(table_path: str, below: int | None = None) -> int | None:
    """The latest complete version of a table that ``upsert_stream`` keeps."""
    if not os.path.isdir(table_path):
        return None
    done = [int(v[1:]) for v in os.listdir(table_path) if v.startswith("v") and v[1:].isdigit() and os.path.exists(f"{table_path}/{v}/_SUCCESS")]
    done = [v for v in done if below is None or v < below]
    return max(done) if done else None


def read_upserted(spark: SparkSession, table_path: str) -> DataFrame:
    v = current_version(table_path)
    if v is None:
        raise FileNotFoundError(table_path)
    return spark.read.parquet(f"{table_path}/v{v}")
