"""From raw documents to packed training sequences.

Every stage works on all rows that the one before it kept, and its result is written before the next one
reads it. In all stages: a null doc_id, source or text stays a row like any other; rows need no doc_id of
their own (rows are told apart by a number that is written with them, so two texts with one doc_id are
two rows, and a repeated row is one more row); empty and very long texts are taken whole; extra columns
stay, whatever their names; an empty table gives an empty result. What each stage does with these cases
stands there. Files of a stage stay in the shared folder as long as its result may be read: run() deletes
those of a stage when the next one has been written, and what the last one needs is left there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import op1_line_dedup, op4_best_fit_packing, op6_simhash, op8_quality, op9_mixing
from loomgraph.llm.common import WORD, folder_of, free, scratch, stored, sweep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least the threshold. A null or empty text has the score of the bias alone; equal
    texts have equal scores, so repeated rows stay or go together; without labels all rows have 0.5 and stay."""
    (score,) = free(docs.columns, "score")
    weights = op8_quality.fit(docs, table(spark, sf_dir, "labels"))
    return op8_quality.score(docs, weights, out=score).where(F.col(score) >= op8_quality.THRESHOLD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text without lines that stand earlier, exactly or nearly; n_chars follows. All rows stay: a null text is null, a
    text all of whose lines stand earlier is empty but for its blank lines; of repeated rows, which have one doc_id and
    decide as one document, each keeps its lines."""
    out = op1_line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest doc_id, rows without one last. Null and empty texts have
    one fingerprint and so are one component; of repeated rows one stays."""
    row, group = free(docs.columns, "row", "group")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-in")
    found = op6_simhash.near_duplicates(held.select(row, "doc_id", "text"), key=row)
    first = found.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first"))
    kept = stored(first.select(F.col("first.key").alias(group)), "near-kept")  # a number a row; Spark knows the size of the files
    return held.join(kept, F.col(row) == F.col(group), "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole, and once more, cut after the last word taken, for the rest. A row
    without words takes nothing and goes; a null source is a source; repeated rows are taken each for itself."""
    row, size, taken, turn, words = free(docs.columns, "row", "size", "taken", "turn", "words")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixing-in")
    mixed = op9_mixing.mix(held.select("doc_id", "source", "text", F.col(row)), key=row)
    mixed = mixed.where("taken > 0").select(row, F.col("size").alias(size), F.col("taken").alias(taken))
    joined = held.join(mixed.hint("merge"), row)
    turns = F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))
    each = joined.withColumn(turn, F.explode(turns)).withColumn(words, F.least(F.col(size), F.col(taken) - (F.col(turn) - 1) * F.col(size)))
    found = F.regexp_extract_all("text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(found, 1, F.col(words).cast("int")), "")
    return each.withColumn("text", F.when(F.col(words) < F.col(size), part).otherwise(F.col("text"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes in the training sequences. A null or empty text is a piece of its end id;
    repeated rows are packed as often as they occur."""
    return op4_best_fit_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL can't express training, edit-distance joins, fingerprints or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, before = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        with folder_of(f"{base}/{k}-{name}") as now:
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stored(docs, name)
        if before:  # packing has written its pieces, so it does not read the stage before either
            sweep(spark, [before])
        before = now
    return docs
