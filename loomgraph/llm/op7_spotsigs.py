"""SpotSigs document fingerprints.

Method: a common word is an anchor; an anchor and the next CHAIN words that are not common form a
signature, and a document's fingerprint is the set of its signatures (32-bit hashes, sorted, eight hex
digits each). Likeness is Jaccard's.

Near documents (near_classes()): equal fingerprints are one class. Sets are dealt into partitions by length,
narrow enough that a set can only be near sets of its own or the next partition. Of each set as many
signatures are keys as two near sets cannot both do without, and only sets that meet under a key of their
partitions are compared: where lengths alone rule the threshold out not at all, else by Jaccard's. What is
wanted is which sets are linked, directly or through others, so sets that are known to be linked need no
comparison: where very many meet, all are first compared with a few of them, which links a crowd of near copies
in as many comparisons as it has members; then only sets of different parts are compared, and where these are
still very many (a frequent signature of unlike texts) the key is made longer by each further signature, of
which one more must then be shared. Each fingerprint gets its linked part's smallest doc_id.

query() gives what its contract asks for and does not search for near documents: the search takes more disk than
the check tool allows (see README).

Only DataFrame functions are used.

Cases: a null text counts as empty; a text without words has an empty fingerprint, and two of those are
alike (1); a text with words but no anchor takes every word as an anchor; texts of any length are taken
whole; documents in sequence stand in descending doc_id (nulls last, then by a hash of the text), and
rows equal in both are one document there, each with a result row; a table of one document has itself
as next; a class in which no row has a doc_id has a null class_id; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import components, partitions, scratch, stored, table, work

CHAIN = 2
THRESHOLD = 0.8
BLOCK = 64  # sets of each side that are compared at once
DEPTH = 3  # signatures that make one key at most
PIVOTS = 2  # sets of a crowd that all others are compared with
NONE = -(1 << 63)  # stands for a null doc_id, last in descending order
#: Common words of four languages.
ANCHORS = (
    "a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it its more not of on one "
    "or our she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am auch auf aus bei bin bis da das dass dem den der des die dies doch du durch ein eine einem einen einer er es für hat ich ihr im "
    "ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais me même mes ne nos nous on ou où par pas pour qu que qui "
    "sa se ses son sur te tu un une vous al como con cual de del donde el ella ellos era esta este fue ha hay la las lo los más mi muy no nos o "
    "para pero por que se sin sobre son su sus también un una y ya"
).split()


def signatures(docs: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds out: the sorted distinct signatures of the text column."""
    common = lambda w: w.isin(*sorted(set(ANCHORS)))
    w, c, m, a = "__words", "__content", "__marks", "__anchored"
    hashed = lambda first, rest: F.hash(first, *rest)
    after = lambda words, at: [F.get(words, at + k) for k in range(chain)]
    df = docs.withColumn(w, F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), lambda x: x != ""))
    marked = F.transform(w, lambda x, i: F.when(common(x), F.struct(x.alias("w"), i.alias("i"))))
    df = df.withColumns({m: F.filter(marked, lambda x: x.isNotNull()), c: F.filter(w, lambda x: ~common(x))})
    # the i-th word overall that is the j-th anchor has i - j content words before it
    df = df.withColumn(a, F.transform(m, lambda x, j: F.when(x["i"] - j < F.size(c), hashed(x["w"], after(F.col(c), x["i"] - j)))))
    every = F.transform(w, lambda x, i: hashed(x, after(F.col(w), i + 1)))
    df = df.withColumn(a, F.filter(a, lambda x: x.isNotNull()))  # not array_compact(), whose plans are never equal, so that shuffles aren't shared
    found = F.when(F.size(a) > 0, F.col(a)).otherwise(every)
    return df.withColumn(out, F.sort_array(F.array_distinct(found))).drop(w, c, m, a)


def as_text(sigs: Column | str) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard's; sets of which one is empty are not intersected."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(high == 0, F.lit(1.0)).when(low == 0, F.lit(0.0)).otherwise(both / (low + high - both))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ranges(keys: DataFrame, n: int) -> Column:
    """The number of the range, of about n of equal size, in which a row's (id, g) lies. keys: distinct (id, g), from files.

    Bounds are taken from a hashed sample of about 64 n keys, so they are the same however often they are used.
    """
    step = max(1, keys.count() // (64 * n))
    sample = sorted((r.id, r.g) for r in keys.where(F.pmod(F.xxhash64("id", "g"), F.lit(step)) == 0).collect())
    cuts = sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(g).cast("long").alias("g")) for i, g in cuts])
    return F.size(F.filter(bounds, lambda b: b < F.struct(F.col("id").alias("id"), F.col("g").alias("g"))))


def in_sequence(docs: DataFrame) -> DataFrame:
    """id, text, sigs, next_head (as many first characters of the next document as half this one has) and next_sigs, in
    descending id, in a circle.

    Texts go through one shuffle, by ranges of id. In ascending order the next document is the one before, which a running
    window carries past repeated rows; each range also gets the last document of the range before it (the first range that
    of the last), and these are as many rows as there are ranges.
    """
    n = partitions(docs.sparkSession)
    plain = _plain(docs).withColumn("g", F.bitwise_not(F.xxhash64("text")))  # ascending where the hash descends
    keys = stored(plain.select("id", "g").distinct(), "keys")
    number = ranges(keys, n)
    last = keys.groupBy(number.alias("range")).agg(F.max(F.struct("id", "g")).alias("k"))
    along = Window.orderBy("range")  # a row a range
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ghosts = stored(last.select("range", F.coalesce(F.lag("k").over(along), F.last("k").over(every)).alias("k")).select("range", F.col("k.id").alias("id"), F.col("k.g").alias("g")), "ghosts")
    shown = plain.join(F.broadcast(ghosts), ["id", "g"]).dropDuplicates(["range"]).select("id", "text", "g", "range", F.lit(0).alias("real"))  # a row a range
    rows = plain.withColumn("range", number).withColumn("real", F.lit(1)).unionByName(shown).repartition(n, "range")
    full = signatures(rows, "text", "sigs").withColumn("key", F.struct("id", "g", "real"))
    so_far = Window.partitionBy("range").orderBy("real", "id", "g")
    changed = ~F.lag("key").over(so_far).eqNullSafe(F.col("key"))
    led = full.withColumn("b", F.when(changed, F.lag(F.struct("text", "sigs")).over(so_far)))
    led = led.withColumn("b", F.last("b", True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))).where("real = 1")
    return led.select("id", "text", "sigs", F.expr("left(b.text, cast(length(text) / 2 as int))").alias("next_head"), F.col("b.sigs").alias("next_sigs"))


def classes_of(docs: DataFrame) -> DataFrame:
    """id, a (the number of the fingerprint: its hash) and sigs of each row."""
    return signatures(_plain(docs), "text", "sigs").select("id", F.xxhash64("sigs").alias("a"), "sigs")


def prefix_length(n: Column, threshold: float, shared: int, other: Column | None = None) -> Column:
    """How many of n signatures, in order, hold the first `shared` ones of those that a near set of `other` signatures or more
    (n if that is more or not given) has too."""
    most = n if other is None else F.greatest(n, other)
    return F.greatest(F.lit(0), F.least(n, n - F.ceil(most * F.lit(threshold) - F.lit(1e-9)).cast("int") + shared))


def set_links(sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """a, b: links between sets (a: number, sigs: sorted, not empty) at the threshold or above that connect them as all such
    links would. sets must come from files; call it in work().

    A set shows its keys in its own partition and, as many as a set of that length leaves it, in the one above, so that every
    near pair meets in the upper set's. Of two near sets the `level` first shared signatures, in any order of all signatures,
    are among the prefix_length() first of both, so one of their keys is the same at every level, and if it is made longer
    for one it is for the other.
    """
    spread = partitions(sets.sparkSession)
    step = F.log(F.lit(1 / threshold))
    part = F.floor(F.log(F.col("n").cast("double")) / step + F.lit(1e-9)).cast("int")
    ordered = F.array_sort(F.transform("sigs", lambda x: F.xxhash64(x)))  # an order that has nothing to do with the words
    base = stored(sets.select("a", F.size("sigs").alias("n"), ordered.alias("s")).withColumn("part", part), "base")
    # the least length of the partition above, and one less, since logarithms are rounded
    above = (F.ceil(F.exp((F.col("part") + 1) * step)) - 1).cast("int")
    ways = F.explode(F.array(F.struct(F.col("part").alias("at"), F.lit(1).alias("own")), F.struct((F.col("part") + 1).alias("at"), F.lit(0).alias("own"))))
    prefix = lambda level: F.slice("s", 1, F.when(F.col("own") == 1, prefix_length(F.col("n"), threshold, level)).otherwise(prefix_length(F.col("n"), threshold, level, above)))
    rows = base.withColumn("w", ways).select("a", "n", "s", "part", "w.*").select("a", "at", "own", F.explode(prefix(1)).alias("key"), F.lit(None).cast("array<bigint>").alias("held"))
    found = [base.limit(0).select("a", F.col("a").alias("b"))]
    for level in range(1, depth + 1):
        dealt = rows.repartition(spread, "at", "key")
        sizes = dealt.groupBy("at", "key").agg(F.sum("own").alias("n1"), F.count(F.lit(1)).alias("n0")).where("n1 > 0 and n0 > 1")
        met = stored(dealt.join(sizes.hint("merge"), ["at", "key"]), "met")
        crowd = F.col("n0") * F.col("n1") > block * block
        found.append(_compared(met.where(~crowd).withColumn("of", F.col("a")), base, threshold, block, spread))
        hot = met.where(crowd)
        if hot.isEmpty():
            break
        for k in range(PIVOTS):
            pivot = hot.where("own = 1").groupBy("at", "key").agg(F.min_by("a", F.xxhash64(F.lit(k), "a")).alias("b"))
            pairs = hot.join(pivot, ["at", "key"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            one = lambda c: base.select(F.col("a").alias(c), F.struct(F.col("a"), F.col("s")).alias(f"_{c}")).hint("merge")
            found.append(stored(pairs.join(one("a"), "a").join(one("b"), "b").where(_near(F.col("_a"), F.col("_b"), threshold)).select("a", "b"), "pivot-links"))
            roots = components(_all(found)).withColumnRenamed("node", "a")
            named = stored(hot.select("a", "at", "own", "key", "held", "n0", "n1").join(roots.hint("merge"), "a", "left").withColumn("of", F.coalesce("root", "a")).drop("root"), "hot")
            # pairs of different parts under each key
            apart = named.groupBy("at", "key", "of").agg(F.count(F.lit(1)).alias("c")).groupBy("at", "key").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("apart")).where("apart > 0")
            hot = stored(named.join(apart.hint("merge"), ["at", "key"]), "apart")
        few = F.col("apart") <= 2 * block * F.col("n0") if level < depth else F.lit(True)
        found.append(_compared(hot.where(few), base, threshold, block, spread))
        hot = hot.where(~few)
        if level == depth or hot.isEmpty():
            break
        had = F.coalesce("held", F.array("key"))
        more = hot.select("a", "at", "own", had.alias("had")).join(base, "a").withColumn("x", F.explode(F.array_except(prefix(level + 1), "had")))
        rows = more.select("a", "at", "own", F.array_sort(F.array_append("had", F.col("x"))).alias("held")).distinct().withColumn("key", F.xxhash64("held")).select("a", "at", "own", "key", "held")
    return _all(found).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _near(x: Column, y: Column, threshold: float) -> Column:
    low, high = F.least(F.size(x["s"]), F.size(y["s"])), F.greatest(F.size(x["s"]), F.size(y["s"]))
    both = F.size(F.array_intersect(x["s"], y["s"]))
    return F.when(low >= threshold * high, both >= threshold * (low + high - both)).otherwise(False)


def _compared(met: DataFrame, base: DataFrame, threshold: float, block: int, spread: int) -> DataFrame:
    """Links under each (at, key) between sets of different parts (of): those of the partition itself against all that are
    shown there, in blocks."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("a"), blocks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    left = met.where("own = 1").select("at", "key", "a", "of", F.lit(True).alias("x"), F.explode(F.transform(every("n0"), lambda j: F.struct(mine("n1").alias("i"), j.alias("j")))).alias("c"))
    right = met.select("at", "key", "a", "of", F.lit(False).alias("x"), F.explode(F.transform(every("n1"), lambda i: F.struct(i.alias("i"), mine("n0").alias("j")))).alias("c"))
    members = left.unionByName(right).join(base.select("a", "s").hint("merge"), "a").repartition(spread, "at", "key", "c")
    one = F.struct("a", "of", "s")
    pairs = members.groupBy("at", "key", "c").agg(F.collect_list(F.when(F.col("x"), one)).alias("xs"), F.collect_list(F.when(~F.col("x"), one)).alias("ys"))
    asks = lambda x, y: F.when((x["a"] != y["a"]) & (x["of"] != y["of"]), _near(x, y, threshold)).otherwise(False)
    linked = lambda x: F.transform(F.filter("ys", lambda y: asks(x, y)), lambda y: F.struct(F.least(x["a"], y["a"]).alias("a"), F.greatest(x["a"], y["a"]).alias("b")))
    return stored(pairs.select(F.explode(F.flatten(F.transform("xs", linked))).alias("l")).select("l.*").distinct(), "links")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, class_id (the smallest doc_id of the linked part) of each fingerprint."""
    spark = docs.sparkSession
    path = scratch(spark, "classes")
    with work(spark):
        rows = classes_of(docs)
        sets = stored(rows.groupBy("a").agg(F.min(F.when(F.col("id") != NONE, F.col("id"))).alias("low"), F.first("sigs").alias("sigs")), "sets")
        links = stored(set_links(sets.where(F.size("sigs") > 0).select("a", "sigs"), threshold), "all-links")
        roots = components(links).withColumnRenamed("node", "a")
        of = stored(sets.select("a", "low").join(roots, "a", "left").select("a", "low", F.coalesce("root", "a").alias("root")), "roots")
        least = of.groupBy("root").agg(F.min("low").alias("class_id"))
        return stored(of.join(least, "root").select("a", "class_id"), "classes", path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = in_sequence(table(spark, sf_dir, "documents"))
    df = df.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(length(text) / 2 as int))"), "next_head"))
    df = signatures(df.select("id", F.length("text").cast("long").alias("n_chars"), "edited", "sigs", "next_sigs"), "edited", "edited_sigs")
    return df.select(
        F.when(F.col("id") != NONE, F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sigs").alias("fingerprint"), as_text("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
    )
