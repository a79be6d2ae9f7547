"""Packing of token pieces into as few fixed-size sequences as possible.

Method: the histogram of piece lengths (at most one row a length, so its size is bounded by the
capacity, not by the data) defines the configuration linear program: cover every length's count with
fillings of one sequence. Multiplicative weights price the lengths, a knapsack dynamic program finds
the most valuable filling, as many copies of it as the counts allow are taken, and the prices of what
is covered fall. What the fractional part leaves is rounded by best fit on groups of equal sequences,
so the driver's work does not grow with the number of pieces. Each piece then gets a rank among those
of its length, and its rank gives its sequence and place; ranks are made in hashed blocks of each
length, so a length that very many pieces share is spread over all tasks.

Cases: a null or empty text is one piece with the end id alone; a text of any length is cut whole;
repeated rows are packed as often as they occur; a null doc_id stays null; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions, rest, ship_package, stored, table
from loomgraph.llm.vocab import WordEncoder, encoder

CAPACITY = 4096
ROUNDS = 400  # of pricing
FALL = 3.0  # how fast the price of a covered length falls
DOCS_AT_ONCE = 2048


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as 16-bit numbers) of every piece of every row."""
    ship_package(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, WordEncoder)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(lo, DOCS_AT_ONCE)
                rows = []
                for doc, coded in zip(b.column("doc_id").to_pylist(), words.encode(pc.fill_null(b.column("text"), "")), strict=True):
                    ids = np.frombuffer(coded + end, "<u2")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        x = ids[at : at + capacity]
                        rows.append((doc, k, at, len(x), crc32_of(x), *[x.tobytes()] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rest()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )


def best_filling(value: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack dynamic program: the filling of one sequence with the greatest value (value[L]: of length L)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    down = value[capacity:0:-1].copy()  # long lengths first, so that they win ties
    for c in range(1, capacity + 1):
        with_last = down[capacity - c :] + best[:c]
        k = int(with_last.argmax())
        if with_last[k] > best[c - 1]:
            best[c], took[c] = with_last[k], c - k
        else:
            best[c] = best[c - 1]
    filling: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            filling[int(took[c])] = filling.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return filling


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(filling, number of sequences with it) that hold exactly counts[L] pieces of each length L."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    need = float((left * lengths).sum())
    groups: list[tuple[dict[int, int], int]] = []
    most = max(1, int(need / capacity / rounds))
    shade = 1 + 0.2 * lengths / capacity  # long pieces are harder to place
    scarce = np.zeros(capacity + 1, bool)  # too few left for a filling that wants them: best fit places them
    for _ in range(rounds):
        if not (left * ~scarce).any():
            break
        covered = 1 - left / np.maximum(counts, 1)
        value = np.where((left > 0) & ~scarce, lengths / capacity * shade * np.exp(-FALL * covered), -np.inf)
        filling = best_filling(value, capacity)
        if short := [k for k, n in filling.items() if left[k] < n]:
            scarce[short] = True
            continue
        copies = min(most, *(int(left[k]) // n for k, n in filling.items()))
        groups.append((filling, copies))
        for k, n in filling.items():
            left[k] -= n * copies
    return best_fit(groups, left, capacity)


def best_fit(groups: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Places what is left, longest first, where least room remains; equal sequences are handled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    room_bits = 0

    def put(filling: dict[int, int], n: int) -> None:
        nonlocal room_bits
        room = capacity - sum(k * m for k, m in filling.items())
        open_.setdefault(room, []).append((filling, n))
        room_bits |= 1 << room

    for filling, n in groups:
        put(filling, n)
    for k in range(capacity, 0, -1):
        todo = int(left[k])
        while todo:
            fit = room_bits >> k
            if fit:
                room = k + (fit & -fit).bit_length() - 1
                filling, n = open_[room].pop()
                if not open_[room]:
                    room_bits &= ~(1 << room)
            else:
                room, filling, n = capacity, {}, todo
            each = min(room // k, todo)
            used = min(n, todo // each)
            put({**filling, k: filling.get(k, 0) + each}, used)
            if filling and used < n:
                put(filling, n - used)
            todo -= used * each
    return [x for xs in open_.values() for x in xs]


def layout(groups: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where ranks go: sorted key (length and first rank), first sequence, pieces a sequence, first offset."""
    rows, rank, sequence = [], [0] * (capacity + 1), 0
    for filling, n in groups:
        offset = 0
        for k in sorted(filling, reverse=True):
            m = filling[k]
            rows.append((k << 48 | rank[k], sequence, m, offset))
            rank[k] += n * m
            offset += k * m
        sequence += n
    rows.sort()
    key, first, each, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": key, "first": first, "each": each, "offset": offset, "sequences": np.array([sequence])}


def ranked(parts: DataFrame) -> DataFrame:
    """Adds rank, from 0 among the rows of equal length, without bringing a length's rows together."""
    blocks = partitions(parts.sparkSession)
    dealt = parts.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    sums = dealt.groupBy("length", "__block").count()
    before = sums.select(
        F.col("length").alias("__length"),
        F.col("__block").alias("__at"),
        F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        dealt.join(before, (F.col("length") == F.col("__length")) & (F.col("__block") == F.col("__at")))
        .withColumn("rank", F.row_number().over(inside) - 1 + F.col("__before"))
        .drop("__block", "__length", "__at", "__before")
    )


def pack(parts: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length (1 to capacity), ids_crc32.

    parts must come from files (see stored()), since it is read twice.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # a row a length: at most capacity rows
        counts[length] = n
    places = layout(solve(counts, capacity, rounds), capacity)
    sent = parts.sparkSession.sparkContext.broadcast(places)  # grows with the capacity, not with the data
    columns = [c for c in parts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(at["key"], length << 48 | rank, "right") - 1
            inside = rank - (at["key"][slot] & ((1 << 48) - 1))
            sequence = at["first"][slot] + inside // at["each"][slot]
            offset = at["offset"][slot] + inside % at["each"][slot] * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked(parts).select(*columns, F.col("rank").cast("long")).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """pieces() of docs, packed."""
    return pack(stored(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
