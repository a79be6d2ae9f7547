"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits of XXH64 over word shingles, majority by bit. Two link at RADIUS or fewer
differing bits. Method: every bit gets a random non-zero vector of RADIUS + 1 bits; each of the
2^(RADIUS + 1) - 1 non-zero vectors v gives a mask of the bits whose vector has odd product with v.
RADIUS vectors never span the space, so for any RADIUS differing bits some v is orthogonal to all of
them: every linked pair is equal under some mask, without exception.

Equal fingerprints are one class before anything else, and the fingerprint is its number. Buckets of more than LEAF classes are not
compared: their members go on to a further, independent family, within their bucket, which fixes about
half the free bits again, until buckets are small (at the latest when all bits are fixed). Within a
bucket only a star to the smallest member of each linked part is emitted, never its pairs. Components
are found by spreading smallest ids (see components()).

Cases: a null or empty text has fingerprint zero and links like any other; texts of any length are
hashed whole; repeated rows share a class; a row without doc_id links like any other, and a component
in which no row has a doc_id has a null component_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import components, rest, scratch, ship_package, stored, table, work

WORDS = 4
SEED = 42
RADIUS = 4
LEAF = 512


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64 bits; 0 for a text without words."""
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    k = min(words, len(w))
    begins, ends = start[: len(w) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(begins, ends, strict=True)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65_535):
        ones += np.add.reduce(np.unpackbits(h[lo : lo + 65_535], axis=1), axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, key: str | None = None) -> DataFrame:
    """key (or null), doc_id and fp (the fingerprint as a signed long) of each row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(fp.view(np.int64))], ["key", "doc_id", "fp"])
        rest()

    number = (F.col(key) if key else F.lit(None)).cast("long").alias("key")
    return docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, doc_id long, fp long")


def covering_masks(radius: int, level: int) -> list[int]:
    """The masks of one family, as signed longs; each level has its own vectors, evenly dealt."""
    rng = random.Random(f"covering {radius} {level}")
    top = 1 << (radius + 1)
    vectors = [1 + k % (top - 1) for k in range(64)]
    rng.shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_parts(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the members of a bucket: links (member, smallest member of its linked part) that connect each part."""
    fp = np.sort(fp)
    bits = fp.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    part = np.arange(len(fp))
    while True:
        least = np.where(near, part[None, :], len(fp)).min(1)
        least = np.minimum(least, least[least])
        if (least == part).all():
            break
        part = least
    far = part != np.arange(len(fp))
    return fp[far], fp[part[far]]


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) links from rows of members (fingerprints), LEAF of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            at = members.offsets.to_numpy()
            fp = members.values.to_numpy()
            size = np.diff(at)
            i = at[:-1][size == 2]
            i = i[np.bitwise_count((fp[i] ^ fp[i + 1]).view(np.uint64)) <= radius]
            found = [(np.maximum(fp[i], fp[i + 1]), np.minimum(fp[i], fp[i + 1]))]
            found += [linked_parts(fp[x:y], radius) for x, y in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def links(classes: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Links that connect the classes (distinct fp) as all pairs within the radius would."""
    ship_package(classes.sparkSession)
    level, rows, out = 0, classes.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    while True:
        masks = F.array(*[F.lit(m) for m in covering_masks(radius, level)])
        wide = rows.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseOR(F.col("mask")))).alias("mask"))
        if level:
            wide = wide.distinct()  # several ways may fix the same bits
        wide = wide.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = wide.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # without the hint the planner may broadcast the wide rows: it takes them for as few bytes as the classes' files have
        shared = stored(wide.hint("merge").join(sizes, ["mask", "key"]), "buckets")
        small = shared.where(F.col("n") <= leaf).groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        out.append(stored(bucket_links(small, radius).distinct(), "links"))
        rows = shared.where(F.col("n") > leaf).select("mask", "fp")
        if rows.isEmpty():
            break
        level += 1
    edges = out[0]
    for x in out[1:]:
        edges = edges.unionByName(x)
    return edges


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, key: str | None = None) -> DataFrame:
    """key (or null), doc_id, fp, group (a number of the component) and component_id (the smallest doc_id in it) of each row."""
    spark = docs.sparkSession
    paths = [scratch(spark, x) for x in ("fingerprints", "components")]
    rows = stored(fingerprints(docs, words, key), "fingerprints", paths[0])
    with work(spark):
        classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
        roots = components(links(classes, radius)).withColumnRenamed("node", "fp")
        of = stored(classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("group")), "groups")
        least = of.groupBy("group").agg(F.min("low").alias("component_id"))
        of = stored(of.join(least, "group").select("fp", "group", "component_id"), "components", paths[1])
    return rows.join(of, "fp", "left").select("key", "doc_id", "fp", "group", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
