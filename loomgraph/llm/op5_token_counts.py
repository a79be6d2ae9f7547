"""Token counts by byte-pair merging, without ids.

Method: a text becomes single characters in a linked list, all adjacent pairs that form a piece enter
a heap by rank, and the lowest-ranked pair is merged again and again (leftmost first among equals).
The count is the initial symbols minus the merges; what is left over and not in the vocabulary counts
its UTF-8 bytes where the model falls back to bytes. No pair of neighbours that occurs in no piece can
ever be merged, so a text is cut at such pairs, each distinct segment is merged once, and its count is
kept in a bounded cache.

Cases: a null or empty text has 0 tokens and 0 bytes; a text of any length is counted whole; repeated
rows give repeated results; a null doc_id stays null; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import ship_package, table

CACHE_WORDS = 1_000_000
LONG_WORD = 64
BLANK = "▁"  # stands for a space in the pieces


class PieceCounter:
    """Counts tokens as a byte-pair model of whole-text pieces does; see the module for the method."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.rank = {
            model.id_to_piece(i): (-model.get_score(i))
            for i in ids
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        self.bytes_each = any(model.is_byte(i) for i in ids)
        self.pairs = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("pieces run over blanks; words can't be counted one by one")
        self.words: dict[str, int] = {}
        self.segments: dict[str, int] = {}

    def leaf(self, char: str) -> int:
        return 1 if char in self.rank or not self.bytes_each else len(char.encode())

    def merged(self, segment: str) -> int:
        """Initial symbols minus merges, with bytes for what the vocabulary lacks."""
        rank = self.rank
        n = len(segment)
        part = list(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, x) for i in range(n - 1) if (r := rank.get(x := segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, piece = heapq.heappop(heap)
            left = part[i]
            j = after[i]
            if not left or j >= n or left + part[j] != piece:
                continue  # a neighbour has been merged meanwhile
            part[i], part[j] = piece, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(x := piece + part[k])) is not None:
                    heapq.heappush(heap, (r, i, x))
            h = before[i]
            if h >= 0 and (r := rank.get(x := part[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, x))
        return n - merges + sum(self.leaf(c) - 1 for c in part if len(c) == 1)

    def word(self, word: str) -> int:
        """Tokens of a word, its leading blank included."""
        total, start, pairs = 0, 0, self.pairs
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in pairs:
                segment = word[start:k]
                start = k
                if len(segment) == 1:
                    total += self.leaf(segment)
                    continue
                n = self.segments.get(segment)
                if n is None:
                    n = self.merged(segment)
                    if len(segment) <= LONG_WORD:
                        if len(self.segments) >= CACHE_WORDS:
                            self.segments.clear()
                        self.segments[segment] = n
                total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            words = [x[1:] for x in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK))]
        else:
            words = text.split(" ")
        known = self.words
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(BLANK + w)
                if len(w) <= LONG_WORD:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for b in batches:
            text = pc.fill_null(b.column("text"), "")
            n = pa.array([count(x.as_py()) for x in text], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
