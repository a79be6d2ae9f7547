"""Change streams: folding by quiet time, last state by generation, idempotent batch upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def fold(changes: DataFrame, gap: str) -> DataFrame:
    """path, first, last, n: changes of a path that follow each other within the gap, for batch and stream alike."""
    s = F.session_window("ts", gap)
    return changes.groupBy("path", s.alias("session")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("session")


def late(changes: DataFrame, delay_s: int) -> DataFrame:
    """Changes older than the newest one before them, in arrival order (event_id), by more than the delay: those a watermark would drop."""
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("newest", F.max("ts").over(before)).where(F.col("newest").cast("long") - F.col("ts").cast("long") > delay_s)


def latest(changes: DataFrame) -> DataFrame:
    """path, ts, size, generation: the last change of each path and how many there were."""
    return changes.groupBy("path").agg(F.max("ts").alias("ts"), F.max_by("size", F.struct("ts", "event_id")).alias("size"), F.count(F.lit(1)).alias("generation"))


def read_changes(spark: SparkSession, folder: str, delay: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of change files (event_id, path, ts, size) with a watermark."""
    schema = "event_id long, path string, ts timestamp, size double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withWatermark("ts", delay)


def maintain(stream: DataFrame, state_path: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Keeps the last state of each path under state_path, one folder a batch; a batch that is run again writes
    the same folder again, so nothing is applied twice."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{state_path}/gen={batch_id - 1}"
        rows = batch.select("path", "ts", "size", "event_id")
        if batch_id:
            rows = rows.unionByName(spark.read.parquet(before))
        kept = rows.groupBy("path").agg(F.max_by(F.struct("ts", "size", "event_id"), F.struct("ts", "event_id")).alias("r")).select("path", "r.*")
        kept.write.mode("overwrite").parquet(f"{state_path}/gen={batch_id}")
        if publish:
            publish(spark.read.parquet(f"{state_path}/gen={batch_id}"), batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def polled(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (added, changed, removed) between two listings (path, size, mtime_ms)."""
    b = before.select("path", F.col("size").alias("bs"), F.col("mtime_ms").alias("bm"))
    x = b.join(now.select("path", F.col("size").alias("ns"), F.col("mtime_ms").alias("nm")), "path", "full_outer")
    change = F.when(F.col("bs").isNull(), "added").when(F.col("ns").isNull(), "removed").when((F.col("bs") != F.col("ns")) | (F.col("bm") != F.col("nm")), "changed")
    return x.select("path", change.alias("change")).where("change is not null")


def watch(
    listing: Callable[[], DataFrame], before: DataFrame, apply: Callable[[DataFrame], DataFrame], rounds: int, keep: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(last listing, deferred) after some rounds of polling: each round's changes and what was deferred are applied once, and
    what apply() gives back as not done (a busy store) is tried again, so nothing is lost. keep() cuts a listing's lineage."""
    deferred = None
    for _ in range(rounds):
        now = keep(listing())
        found = polled(before, now).select("path")
        todo = found if deferred is None else found.unionByName(deferred).distinct()
        deferred = keep(apply(keep(todo)).select("path"))
        before = now
    return before, deferred
