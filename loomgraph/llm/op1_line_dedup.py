"""Deduplication of lines, exact and within a small edit distance.

A line goes if the same line stands earlier, or if an earlier line's text is within TAU edits of its
own (both of MIN_CHARS characters or more); earlier means smaller doc_id, then line number, of the first
place of a text. A carriage return at the end belongs to the line end, not to the text. Lines of nothing
but ASCII white space are structure: they never go and are never compared. Below MIN_CHARS, TAU edits are
a large part of a line ("page 7", "page 12"), so only equal ones go.

Method (segment partition): equal lines are one text. Every text is cut into TAU + 1 segments, one of
which an edit distance of TAU must leave whole. An index holds each text's segments under (length,
number, content); each text probes the indexes of its own and of TAU shorter lengths with the substrings
whose place the edits to the left and right still allow. Texts that meet under a key are compared in
blocks inside arrays, so no rows of pairs are made: what equal beginnings and ends leave over is verified
by banded bit-parallel edit distance (2 TAU + 1 diagonals in one word), first on a few characters.

A segment that very many texts share is not compared block by block. What its texts have besides it is
within TAU edits as well, and so it is, with common beginning and end taken off, what the same segments,
index and probes are made of once more, under that key; and so on, until groups are small or nothing but
TAU characters is left, where all are links. Work thus grows with the texts and their true links.

Only DataFrame functions are used. Cases: a null or empty text has no lines; long texts and lines are
taken whole; a null doc_id is the smallest; rows of equal doc_id decide as one document; extra columns
stay, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import free, partitions, scratch, stored, table, work

TAU = 2
MIN_CHARS = 24
BLOCK = 64  # texts of each side that are compared at once
HEAD = 16  # characters that the automaton sees first
BLANKS = " \t\n\x0b\x0c\r"  # ASCII white space, fixed
NO_ID = -(1 << 63)


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def lines_of(docs: DataFrame) -> DataFrame:
    """id, line_no, line, h, h2 of every line that is not blank."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line")
    ).where(~is_blank(F.col("line")))
    rows = rows.withColumn("line", F.rtrim("line", F.lit("\r")))
    return rows.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def texts_of(lines: DataFrame) -> DataFrame:
    """One row a text: h, h2, n, first (id, line_no), line."""
    return lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "line_no")).alias("first"), F.first("line").alias("line"))


def _keys(texts: DataFrame, tau: int, least: int, probes: list[tuple[int, int, int]], *more: str) -> DataFrame:
    """h, more and a key for each (how much shorter the indexed text is, segment number, move) of probes, and at and
    size: where the segment stands in line. Texts of one parent meet only each other.

    The list is exploded first and one expression then makes the key: one expression a probe would be a
    method so large that compiling it takes an executor more than a gigabyte.
    """
    k = tau + 1
    plan = F.array(*[F.struct(F.lit(d).alias("shorter"), F.lit(i).alias("i"), F.lit(v).alias("move")) for d, i, v in probes])
    parent = [F.col("parent")] if "parent" in texts.columns else []
    rows = texts.select("h", *more, *parent, "line", F.length("line").alias("chars"), F.explode(plan).alias("p"))
    rows = rows.select("h", *more, *parent, "line", (F.col("chars") - F.col("p.shorter")).alias("n"), F.col("p.i").alias("i"), F.col("p.move").alias("move"))
    each, longer = F.floor(F.col("n") / k), F.col("n") % k  # the last `longer` of the k segments are one longer
    at = F.col("i") * each + F.greatest(F.lit(0), F.col("i") - k + longer) + F.col("move")
    size = each + F.when(F.col("i") >= k - longer, 1).otherwise(0)
    rows = rows.where(F.col("n") >= least).withColumns({"at": at.cast("int"), "size": size.cast("int")})
    return rows.select("h", *more, F.xxhash64(*parent, "n", "i", F.substr("line", F.col("at") + 1, F.col("size"))).alias("key"), "at", "size", "line")


def _segments(tau: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(tau + 1)]


def _probes(tau: int) -> list[tuple[int, int, int]]:
    """Segment i of a text d shorter can have moved by what i edits to its left and tau - i to its right allow.

    Equally long texts that agree in an unmoved segment meet in the index itself and need no probe.
    """
    moves = lambda d, i: range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1)
    return [(d, i, v) for d in range(tau + 1) for i in range(tau + 1) for v in moves(d, i) if d or v]


def index_keys(texts: DataFrame, tau: int, least: int) -> DataFrame:
    return _keys(texts, tau, least, _segments(tau)).select("h", "key")


def probe_keys(texts: DataFrame, tau: int, least: int) -> DataFrame:
    return _keys(texts, tau, least, _probes(tau)).select("h", "key")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _common(a: Column, b: Column, cut: str) -> Column:
    """Length of the common beginning (cut 'left') or end ('right'), by halving."""
    take = F.left if cut == "left" else F.right

    def halved(most: Column) -> Column:
        # powers of two from high to low, so that their sum reaches any length
        steps = F.transform(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
        more = lambda p, s: F.when((p + s <= most) & (take(a, p + s) == take(b, p + s)), p + s).otherwise(p)
        return F.aggregate(steps, F.lit(0), more)

    return _let(F.least(F.length(a), F.length(b)), halved)


def _alive(x: Column, y: Column, n: Column, m: Column, tau: int) -> Column:
    """The last word of the automaton after the m characters of y (arrays of characters; n: length of x).

    A word for each number of errors e holds the 2 tau + 1 diagonals of the band; its bit d + tau is set
    if the first j + d characters of a and the first j of b are within e edits. A character of b moves
    all diagonals at once: along a match for free, else at the cost of one error from the word below.
    """
    width = 2 * tau + 1
    full = F.lit((1 << width) - 1)
    ones = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.greatest(k, F.lit(0)), F.lit(width)).cast("int")) - 1

    def move(s: Column, j: Column) -> Column:
        match = F.lit(0).cast("long")
        for i in range(width):
            match = match.bitwiseOR(F.when(F.get(x, j + (i - tau)) == F.get(y, j), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))

        def levels(c: Column) -> Column:
            now, then = ones(n - j + tau), ones(n - j - 1 + tau)  # diagonals with a character of a left, before and after
            new = []
            for e in range(tau + 1):
                r = s[f"r{e}"].bitwiseAND(c)
                if e:
                    below = s[f"r{e - 1}"]
                    r = r.bitwiseOR(below.bitwiseAND(now)).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(new[e - 1].bitwiseAND(then), 1))
                new.append(r.bitwiseAND(full))
            return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(new)])

        return F.when(s[f"r{tau}"] == 0, s).otherwise(_let(match, levels))

    first = [F.shiftleft(ones(F.least(n, F.lit(e)) + 1), tau).bitwiseAND(full) for e in range(tau + 1)]
    return F.aggregate(
        F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(*[r.cast("long").alias(f"r{e}") for e, r in enumerate(first)]),
        move,
        lambda s: s[f"r{tau}"],
    )


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings is tau or less. Most pairs that differ do so within HEAD characters, after
    which no diagonal is left; only the others are seen whole."""

    def run(t: Column) -> Column:
        last = _alive(t["x"], t["y"], t["n"], t["m"], tau)
        return F.lit(1).cast("long").bitwiseAND(F.call_function("shiftright", last, (t["n"] - t["m"] + tau).cast("int"))) == 1

    def parts(x: Column, y: Column) -> Column:
        return F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"), F.length(x).alias("n"), F.length(y).alias("m"))

    head = _let(parts(F.left(a, F.lit(HEAD + tau)), F.left(b, F.lit(HEAD))), lambda t: _alive(t["x"], t["y"], t["n"], t["m"], tau) != 0)
    long_ones = F.length(b) > HEAD
    return F.when(F.abs(F.length(a) - F.length(b)) > tau, False).when(long_ones & ~head, False).otherwise(_let(parts(a, b), run))


def near(a: Column, b: Column, tau: int) -> Column:
    """within(), after the equal beginning and end of the two are cut off."""
    tails = lambda p: F.struct(F.substr(a, p + 1).alias("x"), F.substr(b, p + 1).alias("y"))
    cores = lambda t, q: F.struct(F.left(t["x"], F.length(t["x"]) - q).alias("x"), F.left(t["y"], F.length(t["y"]) - q).alias("y"))
    short = lambda t: _let(_common(t["x"], t["y"], "right"), lambda q: _let(cores(t, q), lambda c: within(c["x"], c["y"], tau)))
    return _let(_common(a, b, "left"), lambda p: _let(tails(p), short))


def _compared(members: DataFrame, tau: int, block: int) -> DataFrame:
    """h, h2, other_h, other_h2 of the links between the two sides of each key; members: key, side, h, h2, line, n0, n1."""
    spread = partitions(members.sparkSession)
    blocks = lambda k: F.greatest(F.lit(1), F.ceil(F.col(f"n{k}") / block)).cast("int")
    own = lambda k: F.pmod(F.xxhash64("h", "h2"), blocks(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), blocks(k) - 1)
    at = F.when(F.col("side") == 0, F.transform(every(1), lambda k: F.struct(own(0).alias("i"), k.alias("j")))).otherwise(F.transform(every(0), lambda k: F.struct(k.alias("i"), own(1).alias("j"))))
    dealt = members.select("key", "side", "h", "h2", "line", F.explode(at).alias("at")).repartition(spread, "key", "at")  # by number, so that it is dealt by work and not by bytes
    one = F.struct("h", "h2", "line")
    pairs = dealt.groupBy("key", "at").agg(*[F.collect_list(F.when(F.col("side") == k, one)).alias(n) for k, n in ((0, "xs"), (1, "ys"))])

    def linked(x: Column) -> Column:
        differs = lambda y: ~((x["h"] == y["h"]) & (x["h2"] == y["h2"]))
        longer = lambda y: F.length(y["line"]) - F.length(x["line"])
        after = lambda y: (x["h"] < y["h"]) | ((x["h"] == y["h"]) & (x["h2"] < y["h2"]))  # noqa: E731  one direction is enough for equal lengths
        asks = lambda y: differs(y) & (longer(y).between(1, tau) | ((longer(y) == 0) & after(y)))
        found = F.filter("ys", lambda y: F.when(asks(y), near(x["line"], y["line"], tau)).otherwise(False))
        return F.transform(found, lambda y: F.struct(x["h"].alias("h"), x["h2"].alias("h2"), y["h"].alias("other_h"), y["h2"].alias("other_h2")))

    return pairs.select(F.explode(F.flatten(F.transform("xs", linked))).alias("l")).select("l.*").distinct()


def _stripped(rows: DataFrame) -> DataFrame:
    """key, side, h, h2 and line without what all texts of the key begin and end with."""
    ends = rows.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.min(F.reverse("line")).alias("c"), F.max(F.reverse("line")).alias("d"), F.min(F.length("line")).alias("least"))
    ends = ends.select("key", _common(F.col("a"), F.col("b"), "left").alias("p"), _common(F.col("c"), F.col("d"), "left").alias("q"), "least")
    ends = ends.select("key", "p", F.least("q", F.col("least") - F.col("p")).alias("q"))
    cut = F.substr("line", F.col("p") + 1, F.length("line") - F.col("p") - F.col("q"))
    return rows.join(ends, "key").select("key", "side", "h", "h2", cut.alias("line"))


def line_links(texts: DataFrame, tau: int = TAU, least: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """h, h2, other_h, other_h2 for all pairs of different texts within tau edits, in both directions. texts (h, h2,
    line) has a row a text and comes from files; call it in work()."""
    long_ones = texts.where(F.length("line") >= least).select("h", "h2", "line")
    index = index_keys(long_ones, tau, least)
    held = index.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    # held has a row a key, so its parts are even: they are hashed, and the many probes need no sort
    met = probe_keys(long_ones, tau, least).join(held.hint("shuffle_hash"), "key").where("low <> h or high <> h").select("key", "h").distinct()
    shared = held.where("low <> high").select("key", F.lit(None).cast("long").alias("h"))
    met = stored(met.unionByName(shared), "met")
    keys = met.groupBy("key").agg(F.bool_or(F.col("h").isNull()).alias("shared"))
    indexed = index.join(keys, "key").withColumn("side", F.explode(F.when(F.col("shared"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    sides = indexed.select("key", "h", "side").unionByName(met.where("h is not null").select("key", "h", F.lit(1).alias("side"))).distinct()
    sides = stored(sides, "sides")
    wanted = stored(long_ones.join(sides.select("h").distinct().hint("merge"), "h", "left_semi"), "texts")
    sizes = sides.groupBy("key").agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1)])
    members = stored(sides.join(sizes, "key").join(wanted, "h"), "members")
    big = F.col("n0") * F.col("n1") > block * block
    found = [stored(_compared(members.where(~big), tau, block), "links")]
    rows = members.where(big)
    if not rows.isEmpty():
        # what each text has besides the segment under which it met the others
        made = _keys(wanted, tau, least, _segments(tau), "h2").withColumn("side", F.lit(0)).unionByName(_keys(wanted, tau, least, _segments(tau) + _probes(tau), "h2").withColumn("side", F.lit(1)))
        held = made.join(rows.select("key", "h", "h2", "side"), ["key", "h", "h2", "side"], "left_semi")
    while not rows.isEmpty():
        rest = F.concat(F.left("line", F.col("at")), F.substr("line", F.col("at") + F.col("size") + 1))
        group = stored(held.select("key", "side", "h", "h2", rest.alias("line")).distinct(), "rests")
        group = stored(_stripped(group).withColumnRenamed("key", "parent"), "stripped")
        low, high = group.where("side = 0"), group.where("side = 1")
        made = _keys(low, tau, 0, _segments(tau), "h2", "side").unionByName(_keys(high, tau, 0, _segments(tau) + _probes(tau), "h2", "side"))
        sizes = made.select("key", "side", "h", "h2", "line").distinct().groupBy("key").agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1)], F.min(F.length("line")).alias("shortest")).where("n0 > 0 and n1 > 0")
        rows = stored(made.join(sizes, "key"), "deeper")
        # of TAU characters or fewer all pairs are links, however many there are
        big = (F.col("n0") * F.col("n1") > block * block) & (F.col("shortest") > tau)
        small = rows.where(~big).select("key", "side", "h", "h2", "n0", "n1").distinct().join(wanted, ["h", "h2"])
        found.append(stored(_compared(small, tau, block), "links"))
        held = rows = rows.where(big)
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    back = links.select(F.col("other_h").alias("h"), F.col("other_h2").alias("h2"), F.col("h").alias("other_h"), F.col("h2").alias("other_h2"))
    return links.unionByName(back).distinct()


def decisions(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS) -> DataFrame:
    """id, kept (its line numbers that stay), n_links, linked_ids: one row for each document that holds a text's first place."""
    spark = docs.sparkSession
    path = scratch(spark, "decisions")
    with work(spark):
        texts = stored(texts_of(lines_of(docs)), "line-texts")
        links = stored(line_links(texts, tau, least), "line-links")
        first = texts.select(F.col("h").alias("other_h"), F.col("h2").alias("other_h2"), F.col("first").alias("other_first"))
        near_by = links.join(first.hint("merge"), ["other_h", "other_h2"]).groupBy("h", "h2").agg(
            F.min("other_first").alias("earliest"), F.count(F.lit(1)).alias("links"), F.collect_set("other_first.id").alias("ids")
        )
        all_texts = texts.drop("line").join(stored(near_by, "near").hint("merge"), ["h", "h2"], "left")
        stays = F.when(F.col("earliest").isNull() | (F.col("earliest") > F.col("first")), F.col("first.line_no"))
        out = all_texts.groupBy(F.col("first.id").alias("id")).agg(
            F.sort_array(F.collect_list(stays)).alias("kept"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("linked_ids"),
        )
        return stored(out, "decisions", path)


def without_repeats(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS) -> DataFrame:
    """docs with only the lines that stay (and blank lines) in text; other columns and rows as they are."""
    id_, kept = free(docs.columns, "id", "kept")
    found = decisions(docs, tau, least).select(F.col("id").alias(id_), F.col("kept").alias(kept))
    joined = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(found.hint("merge"), id_, "left")
    parts = F.split("text", "\n")
    none = F.array().cast("array<int>")
    blank = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: is_blank(F.get(p, i)))
    stay = lambda p: F.transform(F.sort_array(F.array_union(blank(p), F.coalesce(F.col(kept), none))), lambda i: F.get(p, i))
    text = F.when(F.col("text").isNotNull(), _let(parts, lambda p: F.array_join(stay(p), "\n")))
    return joined.withColumn("text", text).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~is_blank(x)))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), n_lines.alias("n_lines"))
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    return rows.join(decisions(docs).hint("merge"), "id", "left").select(
        "doc_id", "n_lines", F.size(kept).alias("n_kept"), kept.alias("kept_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("linked_ids", F.array().cast("array<bigint>")).alias("linked_ids"),
    )
