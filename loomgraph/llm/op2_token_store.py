"""Content-addressed store of token ids.

File format, one folder with three Parquet tables:
  chunks    digest (SHA-256 of data), n, data: ids as little-endian unsigned 16-bit numbers; one row a
            digest, whatever the number of documents that hold it
  recipes   in ascending doc_id order, a folder range=k for each range of doc_id: row, doc_id, place (documents
            before it), start (ids before it), n_tokens, and the digests and ends of its chunks in order
  manifest  a Merkle tree over the recipes: node k of level v hashes the 1,024 nodes from 1,024 k of the
            level below; level 0 are the recipes themselves; the one node of the last level is the root

Chunks end where a rolling hash of the last 32 ids has ten zero bits, so that equal passages cut alike
wherever they stand. Reading checks every chunk against its digest and the recipes against the tree,
and raises on any difference. A document's CRC is put together from its chunks' CRCs, each shifted by
the ids after it, so that reading moves no ids.

Cases: a null or empty text is stored as the end id alone; texts of any length are stored whole;
repeated rows are stored as often as they occur (as recipes; their chunks once); a null doc_id stays
null and comes first; extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, running_start, scratch, ship_package, stored, table
from loomgraph.llm.vocab import ByteEncoder, encoder

WINDOW_BITS = 5  # 32 ids
ZERO_BITS = 10  # a boundary every 1,024 ids on average
SHORTEST, LONGEST = 256, 8192
FANOUT = 1024  # of the Merkle tree
DOCS_AT_ONCE = 3000
SALTS = 16
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


def candidates(ids: np.ndarray) -> np.ndarray:
    """Ends of windows whose rolling hash has the zero bits. ids may hold many documents one after the
    other: what the hash sees of the one before ends within SHORTEST, where no boundary counts."""
    h = ids.astype(np.uint32)
    h *= np.uint32(2654435761)
    h += np.uint32(374761393)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    for k in range(WINDOW_BITS):
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h < np.uint32(1 << (32 - ZERO_BITS))) + 1


def boundaries(ends: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, from the candidates, within the least and greatest sizes."""
    out, at = [], 0
    for c in [*ends, n]:
        while c - at > LONGEST:
            at += LONGEST
            out.append(at)
        if c - at >= SHORTEST or (c == n and c > at):
            out.append(c)
            at = c
    return out


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """row, doc_id, n_tokens and the digests, ends (in ids) and data of the chunks of each document."""
    ship_package(docs.sparkSession)
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
        ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("data", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, ByteEncoder)
        end = np.array([end_id], "<u2").tobytes()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(lo, DOCS_AT_ONCE)
                coded = words.encode(pc.fill_null(b.column("text"), ""))
                rows, at = [], 0
                whole = end.join([*coded, b""])
                hits = candidates(np.frombuffer(whole, "<u2"))
                for doc, n in zip(b.column("doc_id").to_pylist(), [len(x) // 2 + 1 for x in coded], strict=True):
                    first, last = np.searchsorted(hits, (at, at + n), "right")
                    ends = boundaries((hits[first:last] - at).tolist(), n)
                    data = [whole[2 * (at + i) : 2 * (at + j)] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                    rows.append((row, doc, n, [hashlib.sha256(x).digest() for x in data], ends, data))
                    row += 1
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "row long, doc_id long, n_tokens long, digests array<binary>, ends array<bigint>, data array<binary>"
    )


def tree(recipes: DataFrame) -> DataFrame:
    """level, node, hash of the Merkle tree over the recipes; a group holds FANOUT nodes at most."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "start", "n_tokens")]
    leaf = F.sha2(F.concat_ws(" ", *fields, F.concat_ws(" ", F.transform("digests", lambda x: F.hex(x))), F.concat_ws(" ", F.col("ends").cast("array<string>"))), 256)
    nodes = recipes.select(F.col("place").alias("node"), leaf.alias("hash"))
    total, level, levels = recipes.count(), 0, []
    while total > 1 or not levels:
        level += 1
        total = -(-total // FANOUT)
        inside = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
        nodes = nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("__up")).agg(F.sha2(F.concat_ws("", inside), 256).alias("hash"))
        nodes = stored(nodes.select(F.col("__up").cast("long").alias("node"), "hash"), "tree")
        levels.append(nodes.select(F.lit(level).alias("level"), "node", "hash"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Encode docs and write the three tables under path."""
    cut = stored(cut_documents(docs, vocabulary, end_id), "cut")
    copies = stored(repeated_chunks(cut), "copies")
    chunks = cut.select("row", F.posexplode(F.arrays_zip("digests", "data")).alias("k", "x"))
    # copies is read from files: Spark sends it to all tasks where its size allows, and sorts and merges otherwise
    chunks = chunks.join(copies, ["row", "k"], "left_anti").select(F.col("x.digests").alias("digest"), (F.octet_length("x.data") / 2).cast("int").alias("n"), F.col("x.data").alias("data"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = running_start(
        cut.select("row", "doc_id", "n_tokens", "digests", "ends", F.lit(1).alias("one")), ["doc_id", "row"], {"start": "n_tokens", "place": "one"}
    ).drop("one")
    recipes.write.option("compression", "zstd").partitionBy("range").parquet(f"{path}/recipes")
    tree(recipes_of(docs.sparkSession, path)).write.parquet(f"{path}/manifest")
    discard(cut)
    discard(copies)


def repeated_chunks(cut: DataFrame) -> DataFrame:
    """row, k of every chunk whose digest stands earlier; data is not read. A chunk that very many documents hold is
    dealt to SALTS tasks: the few repeated digests go to each of them."""
    held = cut.select("row", F.posexplode("digests").alias("k", "digest"))
    first = held.groupBy("digest").agg(F.min(F.struct("row", "k")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    salted = held.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    return salted.join(first, ["digest", "salt"]).where(F.struct("row", "k") != F.col("first")).select("row", "k")


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    schema = "row long, doc_id long, n_tokens long, digests array<binary>, ends array<bigint>, start long, place long, range int"
    return spark.read.schema(schema).parquet(f"{path}/recipes").drop("range")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of CRC polynomials."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(POLYNOMIAL), b >> np.uint32(1))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRC's share in that of a longer string, with n_bytes more after it."""
    n = n_bytes.astype(np.int64) * 8
    power = np.full(1, 1 << 30, np.uint32)  # x
    while n.any():
        at = np.flatnonzero(n & 1)
        if len(at):
            crc[at] = times(np.broadcast_to(power, len(at)).copy(), crc[at])
        power = times(power, power)
        n >>= 1
    return crc


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n and the CRC of the ids as 32-bit numbers; raises where data and digest differ."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for digest, n, data in zip(*[b.column(c).to_pylist() for c in ("digest", "n", "data")], strict=True):
                if hashlib.sha256(data).digest() != digest or len(data) != 2 * n:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(data, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n").cast(pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").mapInArrow(run, "digest binary, n int, crc long")


def verify_manifest(spark: SparkSession, path: str) -> str | None:
    """The root; raises if the recipes are not those that the tree was built over."""
    there, now = spark.read.parquet(f"{path}/manifest"), tree(recipes_of(spark, path))
    both = there.withColumnRenamed("hash", "was").join(now, ["level", "node"], "full_outer")
    if not both.where("not (was <=> hash)").isEmpty():
        raise ValueError("recipes and Merkle tree differ")
    top = there.orderBy(F.desc("level")).select("hash").first()
    return top and top[0]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from checked files."""
    verify_manifest(spark, path)
    part = lambda e, i: F.struct(F.get("digests", i).alias("digest"), (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("int").alias("size"), (F.col("n_tokens") - e).alias("after"))
    held = recipes_of(spark, path).select("row", "doc_id", "start", "n_tokens", F.explode(F.transform("ends", part)).alias("x")).select("row", "doc_id", "start", "n_tokens", "x.*")
    found = held.join(read_chunks(spark, path), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if b.column("crc").null_count or pc.any(pc.not_equal(b.column("n"), b.column("size"))).as_py():
                raise ValueError("a recipe names a chunk that is not in the store")
            crc = shifted(b.column("crc").to_numpy().astype(np.uint32), b.column("after").to_numpy() * 4)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("row", "doc_id", "start", "n_tokens", "n")], pa.array(crc.astype(np.int64))], ["row", "doc_id", "start", "n_tokens", "n", "crc"]
            )

    parts = found.select("row", "doc_id", "start", "n_tokens", "n", "size", "after", "crc").mapInArrow(
        run, "row long, doc_id long, start long, n_tokens long, n int, crc long"
    )
    whole = parts.groupBy("row", "doc_id", "start", "n_tokens").agg(F.sum("n").alias("ids"), F.bit_xor("crc").alias("ids_crc32"))
    return whole.select("doc_id", "start", F.expr("if(ids = n_tokens, n_tokens, raise_error('a recipe is incomplete'))").alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array) of every stored document, put together from its chunks."""
    verify_manifest(spark, path)
    held = recipes_of(spark, path).select("row", "doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    parts = held.join(spark.read.parquet(f"{path}/chunks"), "digest")
    whole = parts.groupBy("row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(y["data"] for y in x), "<u2").tolist() for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_index(spark, path)
