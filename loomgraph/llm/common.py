"""Things that several operators share: tables, scratch space, components, running offsets."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = got.get() if got.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(place)
    return place


#: The folder of the run that the current thread is in, or None.
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("loomgraph_run", default=None)


@contextlib.contextmanager
def folder_of(path: str) -> Iterator[str]:
    """What scratch() names inside stands under path, so that one run's files can be deleted and no other's."""
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{_RUN.get() or shared_dir(spark) + '/loomgraph'}/{tag}-{uuid.uuid4().hex}"


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column of taken has it (case does not count)."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        n = "__" + n
        while n.lower() in low:
            n = "_" + n
        out.append(n)
    return out


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def work(spark: SparkSession) -> Iterator[None]:
    """A folder for what is stored inside; it is deleted at the end, so results must be stored at a path named before."""
    with folder_of(scratch(spark, "work")) as path:
        try:
            yield
        finally:
            sweep(spark, [path])


#: Rows of numbers and lines take up to so many times the bytes of their compressed files in memory.
FILE_TO_MEMORY = 16


def weighed(spark: SparkSession) -> None:
    """The planner is to take files for what their rows are in memory: by the size of the files it broadcasts tables with a
    row a document or a line, which grow with the input, and the driver holds each of them several times over."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) < FILE_TO_MEMORY:
        spark.conf.set(key, str(FILE_TO_MEMORY))


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder (or the path) and read it back: cuts the lineage and survives lost executors."""
    weighed(df.sparkSession)
    path = path or scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote."""
    sweep(df.sparkSession, [df._loomgraph_path])


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver runs from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    old = env.get("PYTHONPATH", "")
    if root not in old.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, old) if x)


def rest() -> None:
    """In a Python worker at the end of a task: give back to the system what the task no longer holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_start(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """For each (out, value) of sums adds as out the sum of value over all rows before a row in the given total order,
    and as range the number of the row's range in that order; a range is one sorted partition.

    Ranges are dealt out by the order columns, so no task sees more than its range; only one row
    for each range (as many as there are shuffle partitions) is summed in one place.
    """
    n = partitions(df.sparkSession)
    ranged = stored(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    up_to_here = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range").agg(*[F.sum(v).alias(f"__sum_{o}") for o, v in sums.items()])
    before = before.select("range", *[F.coalesce(F.sum(f"__sum_{o}").over(up_to_here), F.lit(0)).alias(f"__before_{o}") for o in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(o) for o, v in sums.items()])
    out = out.join(F.broadcast(before), "range", "left")  # a row for each shuffle partition at most
    return out.withColumns({o: F.col(o) + F.col(f"__before_{o}") for o in sums}).drop(*[f"__before_{o}" for o in sums])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node that can be reached.

    Smallest labels spread along links and along label chains until nothing changes, so rounds
    grow with the logarithm of the longest path. Both sides of each join come from written files:
    a node with very many links is then a skewed partition that adaptive execution splits.
    """
    both = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .where("node <> other")
        .distinct(),
        "links",
    )
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "root")
        spread = stored(seen.unionByName(labels).groupBy("node").agg(F.min("root").alias("root")), "labels")
        up = spread.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        short = stored(
            spread.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "labels"
        )
        changed = short.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was")
        more = not changed.isEmpty()
        discard(labels)
        discard(spread)
        labels = short
        if not more:
            discard(both)
            return labels
