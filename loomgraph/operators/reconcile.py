"""Keeping the graph in step with the files: what to parse, what to commit, what to delete, what to clean.

A state is five tables (journal, nodes, edges, pending, and vectors where there are any); every step takes and
gives whole tables, so the caller publishes one consistent generation (see Snapshot).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.operators.store import Conflict
from loomgraph.shared import cut, hashed, written

BATCH = 64


@dataclass(frozen=True)
class State:
    """journal: path, digest, size, mtime_ms, generation, parser_outcome; nodes: id, path, kind, symbol, fqn, …; edges: path,
    src, dst, relation, line; pending: path, src, dst_symbol, relation, line, import_source, receiver, resolution_state."""

    journal: DataFrame
    nodes: DataFrame
    edges: DataFrame
    pending: DataFrame


def is_note(kind: Column, id_: Column) -> Column:
    return (kind == "note") | F.startswith(id_, F.lit("note:"))


def jobs(disk: DataFrame, journal: DataFrame, force: bool = False) -> DataFrame:
    """path, size, mtime_ms, base_generation of files to parse: a file is left alone only if size, time and bytes are the
    journal's."""
    j = journal.select("path", F.col("digest").alias("jd"), F.col("size").alias("js"), F.col("mtime_ms").alias("jm"), "generation")
    x = disk.join(j, "path", "left")
    same = F.coalesce((F.col("size") == F.col("js")) & (F.col("mtime_ms") == F.col("jm")) & (F.col("digest") == F.col("jd")), F.lit(False))
    return x.where(F.lit(force) | ~same).select("path", "size", "mtime_ms", F.coalesce("generation", F.lit(0)).alias("base_generation"))


def deletion_scope(known: DataFrame, asked: list[str] | None) -> DataFrame:
    """Journaled paths that a scan of the asked paths may find gone: those paths and what lies under them; without any, all."""
    if not asked:
        return known.select("path")
    hit = F.lit(False)
    for a in asked:
        hit = hit | (F.col("path") == a) | F.startswith("path", F.lit(a.rstrip("/") + "/"))
    return known.where(hit).select("path")


def dead_paths(known: DataFrame, disk: DataFrame, asked: list[str] | None = None) -> DataFrame:
    return deletion_scope(known, asked).join(disk.select("path"), "path", "left_anti")


def drift(journal: DataFrame, disk: DataFrame, deep: bool = False) -> DataFrame:
    """path, why: journaled files that are missing, unreadable or differ (deep: in bytes, else in size or time)."""
    d = disk.select("path", F.col("digest").alias("dd"), F.col("size").alias("ds"), F.col("mtime_ms").alias("dm"), F.lit(True).alias("there"))
    x = journal.join(d, "path", "left")
    other = F.col("dd") != F.col("digest") if deep else (F.col("ds") != F.col("size")) | (F.col("dm") != F.col("mtime_ms"))
    unreadable = F.col("dd").isNull() if deep else F.col("ds").isNull()
    why = F.when(F.col("there").isNull(), "missing").when(unreadable, "unreadable").when(other, "hash_mismatch" if deep else "mtime_size_mismatch")
    return x.select("path", why.alias("why")).where("why is not null")


def bounded_drift(journal: DataFrame, disk: DataFrame, deep: bool = False, limit: int = 100) -> DataFrame:
    """The first rows of drift() by path, with how many there are."""
    found = drift(journal, disk, deep)
    return found.orderBy("path").limit(limit).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row


def stale_files(asked: DataFrame, journal: DataFrame, disk: DataFrame) -> DataFrame:
    """Asked paths whose bytes are not the journal's or that are gone; paths the journal does not know are not stale."""
    x = asked.select("path").distinct().join(journal.select("path", "digest", "size"), "path").join(disk.select("path", F.col("digest").alias("dd"), F.col("size").alias("ds")), "path", "left")
    return x.where(~F.coalesce((F.col("dd") == F.col("digest")) & (F.col("ds") == F.col("size")), F.lit(False))).select("path")


def conflicts(records: DataFrame, journal: DataFrame) -> DataFrame:
    """Paths whose generation in the journal is not the one their parse began with. records: path, base_generation."""
    j = journal.select("path", F.col("generation").alias("now"))
    return records.select("path", "base_generation").distinct().join(j, "path", "left").where(F.coalesce("now", F.lit(0)) != F.coalesce("base_generation", F.lit(0))).select("path")


def commit(state: State, records: DataFrame, nodes: DataFrame, edges: DataFrame, pending: DataFrame) -> tuple[State, DataFrame]:
    """(state, conflicts): each parsed file's rows replaced as a whole, its generation one higher; a file that lost the race
    keeps what is there and is named.

    records: path, digest, size, mtime_ms, base_generation, parser_outcome. Of equal edges of a file the last line stays.
    """
    lost = written(conflicts(records, state.journal))
    won = written(records.join(lost, "path", "left_anti"))
    paths = won.select("path")
    swap = lambda old, new: old.join(paths, "path", "left_anti").unionByName(new.join(paths, "path", "left_semi").select(*old.columns))
    n = swap(state.nodes, nodes).groupBy("id").agg(F.max_by(F.struct(*[c for c in state.nodes.columns if c != "id"]), F.struct("path")).alias("r")).select("id", "r.*").select(*state.nodes.columns)
    e = swap(state.edges, edges).groupBy("path", "src", "dst", "relation").agg(F.max("line").alias("line")).select(*state.edges.columns)
    p = swap(state.pending, pending)
    j = won.join(state.journal.select("path", F.col("generation").alias("g")), "path", "left").withColumn("generation", F.coalesce("g", F.lit(0)) + 1)
    journal = state.journal.join(paths, "path", "left_anti").unionByName(j.select(*state.journal.columns))
    return State(journal, n, e, p), lost


def requeued(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """References of other files into vanished ones, by bare name; a file's module stays as the import to look for."""
    lost = nodes.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("dst"), "symbol", "fqn", "kind")
    ids = lost.select(F.col("dst").alias("src"))
    kept = edges.join(gone.select("path"), "path", "left_anti").join(ids, "src", "left_anti").join(lost, "dst")
    file = F.col("kind") == "file"
    tail = F.element_at(F.split(F.coalesce("fqn", F.lit("")), r"\."), -1)
    name = F.when(file & (tail != ""), tail).otherwise(F.coalesce("symbol", F.lit("")))
    return kept.select("path", "src", name.alias("dst_symbol"), "relation", "line", F.when(file, F.col("fqn")).alias("import_source"), F.lit(None).cast("string").alias("receiver"), F.lit("UNRESOLVED").alias("resolution_state"))


def delete_paths(state: State, gone: DataFrame) -> State:
    """Without the files and all rows that hang on their nodes; references into them wait for their targets again."""
    gone = gone.select("path").distinct()
    ids = cut(state.nodes.join(gone, "path", "left_semi").select("id"))
    again = requeued(state.edges, state.nodes, gone)
    free = lambda df: df.join(gone, "path", "left_anti")
    no_end = lambda df, end: df.join(ids.withColumnRenamed("id", end), end, "left_anti")
    edges = no_end(no_end(free(state.edges), "src"), "dst").select(*state.edges.columns)
    old = no_end(free(state.pending), "src").select(*state.pending.columns)
    keys = ["path", "src", "dst_symbol", "relation"]
    new = again.groupBy(*keys).agg(F.max("line").alias("line"), F.max("import_source").alias("import_source"))
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    hit = F.col("n.import_source").isNotNull() | F.col("n.line").isNotNull()
    pick = {
        "line": F.coalesce("o.line", "n.line"), "import_source": F.when(hit, F.col("n.import_source")).otherwise(F.col("o.import_source")),
        "resolution_state": F.when(hit, "UNRESOLVED").otherwise(F.col("o.resolution_state")),
    }
    pending = both.select(*[pick[c].alias(c) if c in pick else F.col(c) if c in keys else F.col(f"o.{c}") for c in state.pending.columns])
    return State(free(state.journal), free(state.nodes), edges, pending)


def delete_node(state: State, ids: DataFrame) -> State:
    """Without some nodes and the edges and references at them."""
    no = lambda df, end: df.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return replace(state, nodes=no(state.nodes, "id").select(*state.nodes.columns), edges=no(no(state.edges, "src"), "dst").select(*state.edges.columns), pending=no(state.pending, "src").select(*state.pending.columns))


def cleaned(state: State) -> State:
    """Without edges that lack an end and references that lack a source or a file."""
    ids = state.nodes.select("id")
    has = lambda df, end: df.join(ids.withColumnRenamed("id", end), end, "left_semi")
    edges = has(has(state.edges, "src"), "dst").select(*state.edges.columns)
    pending = has(state.pending, "src").join(state.journal.select("path"), "path", "left_semi").select(*state.pending.columns)
    return replace(state, edges=edges, pending=pending)


def clean_plan(state: State, disk: DataFrame, reset: bool = False, include_notes: bool = False) -> DataFrame:
    """One row: how many paths, nodes, edges, references and notes a cleaning takes away; nothing is changed."""
    if include_notes and not reset:
        raise ValueError("notes go only with a reset")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    note = is_note(F.col("kind"), F.col("id"))
    if reset:
        counts = [one(state.journal, "paths"), one(state.nodes.where(~note), "nodes"), one(state.edges, "edges"), one(state.pending, "pending"), one(state.nodes.where(note & F.lit(include_notes)), "notes")]
    else:
        stale = cut(state.journal.select("path").join(disk.select("path"), "path", "left_anti"))
        after = cleaned(state)
        gone = lambda all_, kept: all_.agg(F.count(F.lit(1)).alias("a")).crossJoin(kept.join(stale, "path", "left_anti").agg(F.count(F.lit(1)).alias("b")))  # noqa: E731  single rows
        counts = [
            one(stale, "paths"), one(state.nodes.where(~note).join(stale, "path", "left_semi"), "nodes"), gone(state.edges, after.edges).select((F.col("a") - F.col("b")).alias("edges")),
            gone(state.pending, after.pending).select((F.col("a") - F.col("b")).alias("pending")), one(state.nodes.limit(0), "notes"),
        ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # single rows
    return out


def apply_clean(state: State, disk: DataFrame, reset: bool = False, include_notes: bool = False) -> State:
    """The state after a cleaning; notes stay unless a reset asks for them too."""
    note = is_note(F.col("kind"), F.col("id"))
    if reset:
        none = lambda df: df.where("1 = 0")
        return State(none(state.journal), none(state.nodes) if include_notes else state.nodes.where(note), none(state.edges), none(state.pending))
    stale = cut(state.journal.select("path").join(disk.select("path"), "path", "left_anti"))
    free = lambda df: df.join(stale, "path", "left_anti")
    nodes = free(state.nodes.where(~note)).unionByName(state.nodes.where(note)).select(*state.nodes.columns)
    return cleaned(State(free(state.journal), nodes, free(state.edges).select(*state.edges.columns), free(state.pending).select(*state.pending.columns)))


def with_note(nodes: DataFrame, title: str, body: str, now: int) -> DataFrame:
    """nodes with a note; the same title and body is the same note."""
    spark = nodes.sparkSession
    new = spark.createDataFrame([(title, body)], "label string, body string").select(
        F.concat(F.lit("note:"), F.substring(F.sha2(F.concat("label", F.lit("\n"), "body"), 256), 1, 12)).alias("id"), F.lit("").alias("path"), F.lit("note").alias("kind"), F.col("label").alias("symbol"), F.col("label").alias("fqn"),
        "label", "body", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(now).alias("updated_at"),
    )
    return nodes.join(new.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(new.select(*nodes.columns))


def rehome_candidates(missing: DataFrame, disk: DataFrame) -> DataFrame:
    """path, new_path of vanished files whose name stands exactly once on disk; an ambiguous name is never guessed."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    unique = disk.groupBy(name("path").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("new_path")).where("n = 1").drop("n")
    return missing.select("path", name("path").alias("name")).join(unique, "name").select("path", "new_path")


def reconcile(
    state: State, disk: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame, DataFrame]], asked: list[str] | None = None, force: bool = False
) -> tuple[State, DataFrame]:
    """(state, one row of counts): what changed is parsed and committed, what vanished deleted, references resolved, orphans
    taken away.

    parse takes jobs and gives (records, nodes, edges, pending); a file without a record has failed.
    """
    with hashed(disk.sparkSession):
        return _reconcile(state, disk, parse, asked, force)


def _reconcile(state: State, disk: DataFrame, parse: Callable, asked: list[str] | None, force: bool) -> tuple[State, DataFrame]:
    scope = disk if not asked else disk.join(deletion_scope(disk, asked), "path", "left_semi")
    todo = written(jobs(scope, state.journal, force))
    records, nodes, edges, pending = parse(todo)
    records = written(records)
    gone = written(dead_paths(state.journal, disk, asked))
    new, lost = commit(state, records, nodes, edges, pending)
    new = delete_paths(new, gone)
    new = State(*[written(x) for x in (new.journal, new.nodes, new.edges, new.pending)])  # read several times below
    named = written(resolve.resolve_pending(new.pending, new.nodes, new.edges, new.journal.select("path")))  # edges and references come from it
    found, left = resolve.promoted(named.drop("resolution_state"))
    added = new.edges.unionByName(found.select(*new.edges.columns)).groupBy("path", "src", "dst", "relation").agg(F.max("line").alias("line")).select(*new.edges.columns)
    new = cleaned(replace(new, edges=added, pending=left.select(*new.pending.columns)))
    new = State(*[written(x) for x in (new.journal, new.nodes, new.edges, new.pending)])
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(scope, "scanned").crossJoin(one(todo, "jobs")).crossJoin(one(records, "parsed")).crossJoin(one(lost, "conflicts")).crossJoin(one(gone, "deleted"))  # single rows
    return new, counts.select(
        "scanned", (F.col("scanned") - F.col("jobs")).alias("unchanged"), (F.col("parsed") - F.col("conflicts")).alias("updated"), "deleted", (F.col("jobs") - F.col("parsed")).alias("failed"), "conflicts"
    )


class Snapshot:
    """A state under a folder: a folder a generation, named by a marker that is made without overwriting; of two writers one
    fails, and what it wrote is never read."""

    TABLES = ("journal", "nodes", "edges", "pending")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        folder = self._path(f"{self.root}/published")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max(map(int, names), default=0)

    def read(self) -> State:
        g = self.generation()
        return State(*[self.spark.read.parquet(f"{self.root}/gen={g}/{t}") for t in self.TABLES])

    def publish(self, state: State, expected: int) -> int:
        if self.generation() != expected:
            raise Conflict(f"generation is {self.generation()}, expected {expected}")
        for t in self.TABLES:
            getattr(state, t).write.mode("overwrite").parquet(f"{self.root}/gen={expected + 1}/{t}")
        try:
            self._fs.create(self._path(f"{self.root}/published/{expected + 1}"), False).close()
        except Exception as e:
            raise Conflict(str(e)) from e
        return expected + 1

    def sizes(self) -> tuple[int, int]:
        """(bytes, files) of the generation that is read."""
        s = self._fs.getContentSummary(self._path(f"{self.root}/gen={self.generation()}"))
        return s.getLength(), s.getFileCount()

    def compact(self, files: int = 1, dry_run: bool = False) -> dict[str, int]:
        """Rewrites the generation into few files a table, drops older ones, and says what that saved."""
        g, (size, n) = self.generation(), self.sizes()
        if dry_run or not g:
            return {"bytes_before": size, "bytes_after": size, "files_before": n, "files_after": n}
        state = self.read()
        self.publish(State(*[getattr(state, t).coalesce(files) for t in self.TABLES]), g)
        for k in range(1, g + 1):
            self._fs.delete(self._path(f"{self.root}/gen={k}"), True)
        after, m = self.sizes()
        return {"bytes_before": size, "bytes_after": after, "files_before": n, "files_after": m}
