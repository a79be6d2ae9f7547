"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources sorted by code point (null last) have the weights 5, 2, 1, repeating, and share TOTAL
times all words; a target stops at MOST times its source's words and the excess is shared again by
weight, which is the water level at which min(cap, level x weight) adds up. Method: the words to take
are cut into equal blocks; sources get blocks by the highest quotients target / (2 k - 1), and within a
source its shards get the blocks of the last, partial pass by the highest quotients of their sizes.
Nothing is ranked seat by seat: all seats whose quotient is surely high enough are given at once, and
only the few last ones, as many as there are parties at most, are ranked. In a shard, documents stand
in seeded order and the quota's words are taken from its start, the last document perhaps in part.

A source has as many shards as the square root of its documents, so that neither the shards of one
source nor the documents of one shard grow with the whole; a source with a third of all rows is spread
like the others. Only DataFrame functions are used.

Cases: a null or empty text has size 0 and takes nothing; a null source is one source, the last; rows
without doc_id and repeated rows count as rows of their own; an empty table, or one without words,
gives no words; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, stored, table

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BLOCK = 64  # words
SEED = 17


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """row (unique once written, or the key column), doc_id, source, size, draw."""
    return docs.select(
        (F.col(key) if key else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))).alias("draw"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target: one row a source."""
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())  # a row a source
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    out = each.withColumn("w", F.element_at(weights, (F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    out = out.withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    lower = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").cast("binary").asc_nulls_last())
    out = out.withColumn("total", TOTAL * F.sum("source_size").over(every))
    # with all sources before this one at their caps, the level that shares the rest by weight
    before, rest = lower.rowsBetween(Window.unboundedPreceding, -1), lower.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "sharing": F.sum("w").over(rest), "turn": F.row_number().over(lower)})
    out = out.withColumn("level", (F.col("total") - F.col("capped")) / F.col("sharing"))
    out = out.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("turn"))).over(every))
    return out.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds quota: how many of the group's seats each party gets by the highest quotients votes / (2 k - 1).

    Equal quotients go by the order columns. With m parties and K seats no party's quota lies below
    round(share (K - m / 2)) or above share (K + m / 2) + 1/2, so only seats between are ranked.
    """
    per = Window.partitionBy(*group)
    share = F.when(F.col("__votes") > 0, F.col(votes) / F.col("__votes")).otherwise(0.0)
    known = parties.withColumns({"__votes": F.sum(votes).over(per), "__m": F.count(F.lit(1)).over(per)})
    sure = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("__m") / 2) + 0.5 - 1e-6))
    most = F.floor(share * (F.col(seats) + F.col("__m") / 2) + 0.5) + 1
    known = known.withColumns({"__sure": sure.cast("long"), "__most": F.when(share > 0, most).otherwise(0).cast("long")})
    known = known.withColumn("__open", F.col(seats) - F.sum("__sure").over(per))
    asks = known.where("__most > __sure").select(*group, *order, votes, "__open", F.explode(F.expr("sequence(__sure + 1, __most)")).alias("__k"))
    best = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("__k") - 1)).desc(), *order, "__k")
    won = asks.withColumn("__place", F.row_number().over(best)).where("__place <= __open").groupBy(*group, *order).agg(F.count(F.lit(1)).alias("__won"))
    keys = list(dict.fromkeys([*group, *order]))
    won = won.select(*[F.col(c).alias(f"__key_{c}") for c in keys], "__won")
    same = [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys]
    out = known.join(won, same, "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def mix(docs: DataFrame, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """key (or a row number), doc_id, size, source_size, target, taken of each row of docs."""
    rows = stored(sized(docs, key), "sizes")
    want = targets(rows).withColumns({
        "one": F.lit(1),
        "blocks": F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"),
        "place": F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())),
    })
    given = sainte_lague(want, ["one"], ["place"], "target", "blocks")
    words = F.least(F.col("quota") * block, MOST * F.col("source_size"))
    given = given.withColumn("words", words)
    given = given.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    given = given.withColumns({
        "shards": F.greatest(F.lit(1), F.ceil(F.sqrt("n_docs"))).cast("long"),
        "part_blocks": F.round((F.col("words") - F.col("passes") * F.col("source_size")) / block).cast("long"),
    })
    given = stored(given.select("place", "source", "source_size", "target", "passes", "shards", "part_blocks"), "quotas")
    dealt = rows.join(given.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards"))).drop("of")
    parts = dealt.groupBy("place", "shard", "part_blocks").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(parts, ["place"], ["shard"], "shard_size", "part_blocks").select(
        F.col("place").alias("at_place"), F.col("shard").alias("at_shard"), (F.col("quota") * block).alias("shard_words")
    )
    dealt = dealt.join(quotas, (F.col("place") == F.col("at_place")) & (F.col("shard") == F.col("at_shard")))
    seeded = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("shard_words") - F.coalesce(F.sum("size").over(seeded), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    taken = F.least(MOST * F.col("size"), F.col("passes") * F.col("size") + part).cast("long")
    return dealt.withColumn("taken", taken).select(F.col("row").alias(key or "row"), "doc_id", "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row")
