"""Versioned tables: a new folder a generation, published by a pointer, with compare-and-swap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published since the caller read."""


class VersionedTable:
    """A table under root; readers see the generation the pointer names, writers publish the next."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """0 before anything is published. A generation counts once its marker file exists."""
        folder = self._path(f"{self.root}/published")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max(map(int, names), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/gen={self.generation()}")

    def publish(self, df: DataFrame, expected: int) -> int:
        """Write df as generation expected + 1; raises Conflict if another one has been published. The marker is
        created without overwriting, so of two writers one fails, and its folder is never read."""
        if self.generation() != expected:
            raise Conflict(f"generation is {self.generation()}, expected {expected}")
        df.write.mode("overwrite").parquet(f"{self.root}/gen={expected + 1}")
        try:
            self._fs.create(self._path(f"{self.root}/published/{expected + 1}"), False).close()
        except Exception as e:
            raise Conflict(str(e)) from e
        return expected + 1


def replace_files(old: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """old without the rows of the paths in new (and gone), and with new: one file's rows are replaced as a whole."""
    paths = new.select("path").distinct()
    if gone is not None:
        paths = paths.union(gone.select("path")).distinct()
    return old.join(paths, "path", "left_anti").unionByName(new)


def requeue(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of other files into the deleted paths, as unresolved references to the bare name of their target."""
    lost = nodes.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("dst"), "symbol", "kind")
    kept = edges.join(gone.select("path"), "path", "left_anti").join(lost, "dst")
    bare = F.when(F.col("kind") == "file", F.regexp_replace(F.element_at(F.split("symbol", "/"), -1), r"\.[^.]+$", "")).otherwise(F.element_at(F.split("symbol", r"\."), -1))
    return kept.select("path", "src", bare.alias("dst_symbol"), "relation", "line", F.lit("UNRESOLVED").alias("resolution_state"))


def rehome(df: DataFrame, moves: DataFrame, id_columns: list[str]) -> DataFrame:
    """Rewrites path and the 12 hex digits of ids for moved files; moves: old_path, new_path.

    Moves are few (one commit's), so the map is small; Spark broadcasts it if it is."""
    ns = lambda c: F.substring(F.sha2(F.col(c), 256), 1, 12)
    m = moves.select("old_path", "new_path", ns("old_path").alias("old_ns"), ns("new_path").alias("new_ns"))
    by_path = m.select(F.col("old_path").alias("path"), F.col("new_path").alias("__new_path"))
    out = df.join(by_path, "path", "left").withColumn("path", F.coalesce("__new_path", "path")).drop("__new_path") if "path" in df.columns else df
    for c in id_columns:
        of = m.select(F.col("old_ns").alias("__ns"), F.col("new_ns").alias("__new"))
        out = out.withColumn("__ns", F.regexp_extract(c, "^(?:file|sym):([0-9a-f]{12})", 1)).join(of, "__ns", "left")
        out = out.withColumn(c, F.when(F.col("__new").isNotNull(), F.expr(f"replace(`{c}`, __ns, __new)")).otherwise(F.col(c))).drop("__ns", "__new")
    return out.select(*df.columns)
