"""Event-time windows, deduplication and link ingestion as Structured Streaming.

Each transformation works on a stream and on a table alike; `collect_stream` runs one over a directory until its input
is used up and gives the result as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.operators import store


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum by type in windows of `width`; on a stream, rows later than `late` are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicate(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key; on a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def collect_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes a stream's rows to a table until its present input is used up; restarts go on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(links: DataFrame, table: str, checkpoint: str, key: Callable = store.sha_key, **allocate: object) -> None:
    """Gives keys to links as they come: each batch is allocated against the table so far and appended.

    A batch is told apart by its number, which names its folder: a batch that is run again replaces itself.
    """
    spark = links.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        held = [f"{table}/batch={n}" for n in range(number)]
        known = spark.read.parquet(*held) if held else spark.createDataFrame([], "seq long, url string, key string")
        store.allocate(rows, known.select("key", "url").distinct(), key, **allocate).write.mode("overwrite").parquet(f"{table}/batch={number}")

    links.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
