"""Exact deduplication against a persistent digest index.

Method: the index is a folder of runs; each is a Parquet table bucketed by SHA-256 digest with one sorted
file a bucket, one row a text. New data is reduced to one row a digest and sorted once; what the index has
is removed by sort-merge anti-joins against the runs, which are neither shuffled nor sorted, and the rest
is appended as a new run. When there are MOST runs they are merged bucket by bucket into one. A run counts
once its marker stands, so a batch that is lost midway can be added again, and any session that knows the
folder can go on with the index. Since the row with the largest doc_id stays, groups() brings its rows in
blocks of falling doc_id: whatever is in the index already is larger.

A text that very many rows share is one row after map-side aggregation; where rows are brought back to
their groups, both sides of the join come from files, so adaptive execution splits such a text's rows.

Cases: a null text counts as empty; only A-Z are lower-cased; a null doc_id is smaller than any other;
of wholly equal rows exactly one is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions, scratch, stored, sweep, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = 2
MOST = 8  # runs
COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT"


def digests(docs: DataFrame) -> DataFrame:
    """row (unique once written), doc_id, digest of the normalised text."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """Rows (digest, keep_id, keep_row) under a folder that driver and executors share.

    Spark reads buckets through a catalogue table, so a session registers each run it opens; files are
    the index's own, and dropping the table leaves them. The number of buckets is the first run's.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        runs = self.runs()
        self.buckets = runs[0][1] if runs else buckets or partitions(spark)
        # one sorted file a bucket: its order counts
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def runs(self) -> list[tuple[int, int, int]]:
        """(number, buckets, the oldest number it holds) of each run that counts, oldest first."""
        folder = self._at(f"{self.path}/published")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        found = sorted((tuple(map(int, n.split("-"))) for n in names), reverse=True)
        out, least = [], None
        for run in found:  # newest first; what a merged run holds does not count any more
            if least is None or run[0] < least:
                out.append(run)
                least = run[2]
        return out[::-1]

    def _name(self, number: int) -> str:
        return f"loomgraph_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{number}"

    def _read(self, number: int) -> DataFrame:
        name = self._name(number)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/run-{number}'"
        )
        return self.spark.table(name)

    def _write(self, rows: DataFrame, holds: int | None = None) -> None:
        """rows, which are in the index's buckets, as the next run."""
        number = max([r[0] for r in self.runs()], default=0) + 1
        place = f"{self.path}/run-{number}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(number)}")
        sweep(self.spark, [place])  # what a batch has left that was lost midway
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", place).saveAsTable(self._name(number))
        self._fs.create(self._at(f"{self.path}/published/{number}-{self.buckets}-{holds or number}"), False).close()

    def exists(self) -> bool:
        return bool(self.runs())

    def read(self) -> DataFrame:
        out = self.spark.createDataFrame([], COLUMNS)
        parts = [self._read(number) for number, _, _ in self.runs()]
        for k, part in enumerate(parts):
            out = out.unionByName(part) if k else part
        return out

    def fresh(self, batch: DataFrame) -> DataFrame:
        """One row for each digest of batch (see digests()) that the index lacks, with the row that stays."""
        first = batch.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"))
        first = first.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")).repartition(self.buckets, "digest")
        for number, _, _ in self.runs():
            first = first.join(self._read(number).select("digest").hint("merge"), "digest", "left_anti")
        return first

    def add(self, batch: DataFrame) -> None:
        """Append what is new; a batch that is lost midway can be added again."""
        self._write(self.fresh(batch))
        runs = self.runs()
        if len(runs) >= MOST:
            self._write(self.read().repartition(self.buckets, "digest"), holds=runs[0][2])

    def drop(self) -> None:
        for number, _, _ in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(number)}")
        sweep(self.spark, [self.path])


def groups(docs: DataFrame, index: DigestIndex, blocks: int = BLOCKS) -> DataFrame:
    """row, doc_id, digest, keep_id, keep_row, group_size of every row of docs, through the index."""
    spark = docs.sparkSession
    paths = [scratch(spark, x) for x in ("digests", "groups")]
    rows = stored(digests(docs), "digests", paths[0])
    cuts = rows.select(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)])).first()[0] or []
    above = None
    for cut in [*sorted(set(cuts), reverse=True), None]:  # falling doc_id, nulls last
        block = rows if above is None else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") <= above))
        index.add(block if cut is None else block.where(F.col("doc_id") > cut))
        above = cut
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    found = stored(index.read().join(sizes, "digest"), "groups", paths[1])
    return rows.join(found, "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, scratch(spark, "digest-index"))
    try:
        found = groups(table(spark, sf_dir, "documents"), index)
    finally:
        index.drop()  # what groups() returns is stored apart
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""
