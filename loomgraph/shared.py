"""The folder that driver and executors share, and derived tables that are written there once."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all run on one machine."""
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


#: Larger estimates are dropped.
MOST_BYTES = 2**62


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return _bounded(df.checkpoint())


def _bounded(df: DataFrame) -> DataFrame:
    """The checkpoint, without its estimated size where that is past MOST_BYTES.

    A checkpoint keeps the estimate of its plan, and joins multiply the estimates of their sides: in a loop it would get
    some times the digits each round, until numbers of millions of digits fill the driver's memory and time.
    """
    plan, jvm, session = df._jdf.queryExecution().analyzed(), df.sparkSession._jvm, df.sparkSession._jsparkSession
    if plan.stats().sizeInBytes() < MOST_BYTES:
        return df
    none = jvm.scala.Option.empty()  # no estimate counts as the largest long
    same = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, same), df.sparkSession)


#: Rows take so many times the bytes of their compressed files in memory: of millions of numbered names a file holds a byte each.
FILE_TO_MEMORY = 64


def sized(spark: SparkSession) -> None:
    """The planner is to take files for what their rows are in memory. It broadcasts what looks small, by default by the size
    of the files, and a column of millions of names looks small there; measured sizes while a query runs count as before.

    Shuffle files go when the query, checkpoint or stored table that needed them is done, not at some later collection."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) < FILE_TO_MEMORY:
        spark.conf.set(key, str(FILE_TO_MEMORY))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextlib.contextmanager
def hashed(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """What is run within joins by hash tables, without sorting, where each part of a side was measured to have `most` compressed
    bytes or less; larger parts are sorted and merged as ever."""
    keys = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    were = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:  # it holds only for parts that are not put together to larger ones
            spark.conf.set(k, most)
        yield
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """df from compressed files in the shared folder: for many rows, of which a checkpoint holds each one whole."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph-written/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a written() that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_KEPT: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, key: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """What make() gives, written once in an application under the key and read from there; by: a partitioning column.

    Like the tables and the text index of a graph store, which are made when files are taken in and read by all queries.
    """
    sized(spark)
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _KEPT:
        path = f"{shared_dir(spark)}/loomgraph-kept/{slot[0]}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"
        out = make().write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        _KEPT[slot] = path
    return spark.read.parquet(_KEPT[slot])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the row's number from 0 in a total order, without ordering all rows in one task: ranges are counted, and only a
    row a range is summed in one place."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    up_to_here = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("k")).select("__range", F.coalesce(F.sum("k").over(up_to_here), F.lit(0)).alias("__before"))
    out = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    out = out.join(F.broadcast(before), "__range")  # a row for each shuffle partition at most
    return out.withColumn(name, F.col("__before") + F.col("__place") - 1).drop("__range", "__before", "__place")


def carried(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = 4096) -> DataFrame:
    """Adds, for each name of values, the last value that is not null at or before a row of its group.

    order is a whole number. Rows are dealt into bins of it, each bin is one small sort, and what the bins before hold is one
    row a bin, so a group of any size (one huge log) is spread over all tasks.
    """
    x = df.withColumn("__bin", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "__bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"__own_{n}": v for n, v in values.items()})
    last = x.groupBy(*keys, "__bin").agg(*[F.max_by(f"__own_{n}", F.when(F.col(f"__own_{n}").isNotNull(), F.col(order))).alias(f"__last_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    past = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), *[F.last(f"__last_{n}", True).over(before).alias(f"__past_{n}") for n in values])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__bin") == F.col("__b")]
    y = x.withColumns({f"__here_{n}": F.last(f"__own_{n}", True).over(inside) for n in values}).join(past, same)
    return y.select(*df.columns, *[F.coalesce(f"__here_{n}", f"__past_{n}").alias(n) for n in values])
