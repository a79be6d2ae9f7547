"""Quality scores by logistic regression over hashed word n-grams.

Features: words and word pairs (lower case, punctuation at the end apart), the punctuation itself, and
marks for a word in capitals and for a word that repeats the one before; all hashed into one space.
A document's value for a feature is its count over the number of words, times SCALE. Method: weights
follow the regularised leader (FTRL-proximal, per-coordinate rates, L1 and L2); a score is the
logistic function of a sparse dot product.

Training takes at most TRAIN_ROWS labelled rows, those with the smallest seeded hash of doc_id, and
only rows whose crc32(doc_id as text) mod 5 is not 0; it runs in one task, and what it sends back is
one array of weights whose size is a parameter. Every document is scored, whole, without a shuffle.

Cases: a null or empty text gets the score of the bias; a row without label or without doc_id is
scored but not learnt from; a document with several labels counts as 1 if any is; without any usable
label all scores are 0.5; repeated rows give repeated results; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import vocab
from loomgraph.llm.common import rest, ship_package, table

TRAIN_ROWS = 8000
BITS = 18
SCALE = 8.0
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
THRESHOLD = 0.3
DOCS_AT_ONCE = 512
ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct word the hash of its letters, and of what else marks it (0: nothing)."""
    core, mark = np.zeros(len(words), np.uint32), np.zeros(len(words), np.uint32)
    for i, w in enumerate(words):
        stem = w.rstrip(ENDS) or w
        core[i] = zlib.crc32(stem.lower().encode())
        more = w[len(stem) :] + "^" * (len(stem) > 1 and stem.isupper())
        if more:
            mark[i] = zlib.crc32(more.encode(), 1) or 1
    return core, mark


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and pairs (row of the text, hashed feature) in three groups."""
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    at = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    core, mark = _word_hashes(coded.dictionary.to_pylist())
    which = coded.indices.to_numpy()
    size = np.diff(at)
    empty = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)
    size = np.where(empty, 0, size)  # splitting an empty text gives one empty word
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    c, m = core[which], mark[which]
    same = np.zeros(len(which), bool)
    follows = np.flatnonzero(row[1:] == row[:-1]) + 1
    same[follows] = which[follows] == which[follows - 1]
    shift = np.uint32(32 - bits)
    spread = lambda h: ((h ^ (h >> np.uint32(16))) * np.uint32(0x9E3779B1)) >> shift
    words = np.where(same, np.uint32(0x5A3E), c)
    pair = words[follows - 1] * np.uint32(0x85EBCA6B) + (words[follows] ^ np.uint32(0xC2B2AE35))
    marked = np.flatnonzero(m)
    kept = ~empty[row]
    return size, [(row[kept], spread(words[kept])), (row[marked], spread(m[marked])), (row[follows], spread(pair))]


def train(docs: Iterator[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) from (label, distinct features, values)."""
    n_weights = (1 << bits) + 1
    z, n = np.zeros(n_weights), np.zeros(n_weights)
    rows = list(docs)
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        over = np.abs(z[at]) > L1
        return np.where(over, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, at, x = rows[k]
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            grown = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(slice(None)).astype(np.float32)


def _rows(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(batch.column("text"), "")
    size, groups = features(texts, bits)
    row = np.concatenate([r for r, _ in groups])
    hashed = np.concatenate([h for _, h in groups]).astype(np.int64)
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(len(texts) + 1))
    for i, label in enumerate(batch.column("label").to_pylist()):
        at, count = np.unique(hashed[order[ends[i] : ends[i + 1]]], return_counts=True)
        yield label, np.append(at, 1 << bits).astype(np.int32), np.append(count * (SCALE / max(1, size[i])), 1.0).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learnt from at most `rows` labelled documents that are not held out."""
    ship_package(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    one = usable.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taken = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"])  # `rows` ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (x for b in batches for lo in range(0, b.num_rows, DOCS_AT_ONCE) for x in _rows(b.slice(lo, DOCS_AT_ONCE), bits))
        vocab.forget()
        yield pa.RecordBatch.from_arrays([pa.array([train(seen, bits).tobytes()])], ["weights"])
        rest()

    ordered = taken.select("label", "text", F.xxhash64("doc_id").alias("h"), "doc_id").repartition(1).sortWithinPartitions("h", "doc_id", "text")
    got = ordered.mapInArrow(run, "weights binary").collect()  # one row
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, out: str = "quality_score") -> DataFrame:
    """All columns of docs with out (0 to 1) added; docs must not have a column of that name."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2^bits + 1 numbers
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        vocab.forget()
        rest()
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(lo, DOCS_AT_ONCE)
                texts = b.column(names.index("text")).cast(pa.string())
                size, groups = features(pc.fill_null(texts, ""), bits)
                total = sum(np.bincount(row, w[hashed], b.num_rows) for row, hashed in groups)
                value = 1 / (1 + np.exp(-np.clip(total * SCALE / np.maximum(size, 1) + w[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(value)], [*names, out])
        rest()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted")
    )
