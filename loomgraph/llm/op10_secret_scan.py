"""Secret scan: candidates by shape, false positives removed by a random forest.

A run of characters without white space is split into its assigned and quoted parts; names with "=" or
":" before a value, quotes and brackets around it, are taken off. A value of VALUE_LEAST or more
characters is a candidate if it begins like a known key, if its name or one of the three words before
names a secret, or if the run has LEAST or more characters and run and value hold a digit or a
lower-case letter before an upper-case one; the forest rejects the rest. Features: length; shares of digits, capitals and hexadecimal digits; how often neighbouring
characters change class, and how often they make a common letter pair; entropy; the share covered by
dictionary words; dots, "@", "/" and "-"; what the path says (tests, examples); whether a neighbouring
word names a secret, a hash or an example; whether it is assigned. The forest is trained from labelled
findings: a table with before, value, after, path, label that the caller gives, or else the ones of
labelled_findings(), which makes them from public formats by a seeded generator.

Cases: a null or empty text has no findings; texts of any length are scanned whole; a null doc_id stays
null; repeated rows give repeated findings; a null path says nothing; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ship_package, stored, table

LEAST = 16
VALUE_LEAST = 8
TREES, DEPTH, SEED = 40, 8, 11
EXAMPLES = 6000  # made by labelled_findings()
THRESHOLD = 0.5

#: Words of names and of prose, for coverage; fixed values.
DICTIONARY = (
    "account address admin alpha author backup batch beta bucket build cache change client cloud column commit common config connect content copy "
    "count create data date default delete demo design device digest document domain driver dummy email engine error event example export field file "
    "filter folder format group handler hash header hello helper house image import index input item kernel label language layer length letter level "
    "library light line list local logger login machine main manager map master matrix memory message method mock model module month name network "
    "number object office option order output package page paper password path people phone place platform player plugin point policy print process "
    "product profile project public query queue random reader record release report request result return river room root sample schema school screen "
    "script search second secret select sender server service session shop signal simple size small source space spark start state station status "
    "stream string style summer super support switch system table target team template test text thread time title token total train tree type "
    "update upload user value version video view water window winter word work worker world writer year"
).split()
#: Common pairs of letters in prose; fixed values.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
).split()
#: What neighbouring words and paths say; fixed values.
SECRETIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "credential", "auth", "private", "bearer")
HARMLESS = ("commit", "sha", "md5", "checksum", "digest", "uuid", "version", "etag", "revision", "mail", "href", "phone", "card", "hash", "id")
EXAMPLE = ("example", "sample", "dummy", "placeholder", "test", "mock", "fixture", "demo", "doc")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "AIza", "glpat-", "eyJ")

_WORDS = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
_SHAPE = re.compile(r"\d|[a-z][A-Z]")
_QUOTED = re.compile(r"""(["'`])(.*?)\1|[^"'`]+""", re.S)
_APART = re.compile(r"[?&,;|(\[{<](?=[A-Za-z_][\w.\-]*[=:]|" + "|".join(PREFIXES) + ")")
_NAMED = re.compile(r"([A-Za-z_][\w.\-]*)[=:]+(?=[^=:])")
_NAME_LAST = re.compile(r"([A-Za-z_][\w.\-]*)[=:]+\Z")
_VALUE = re.compile(r"[(\[{<]*(.*?)[^A-Za-z0-9+/=_\-]*\Z", re.S)
NAMES = (
    "length digits capitals hexadecimal changes pairs entropy covered dots at slashes dashes path_example near_secret near_harmless near_example assigned prefix repeats"
).split()


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(value: str, before: list[str], after: list[str], name: str, path: str) -> list[float]:
    """The features of one candidate, in the order of NAMES."""
    n = len(value)
    low = value.lower()
    near = " ".join([*before, name]).lower()
    around = near + " " + " ".join(after).lower()
    kinds = [_kind(c) for c in value]
    share = {c: value.count(c) / n for c in set(value)}
    says = lambda words, text: float(any(w in text for w in words))
    return [
        float(min(n, 200)), kinds.count(2) / n, kinds.count(1) / n, sum(c in "0123456789abcdef" for c in low) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, sum(low[i : i + 2] in PAIRS for i in range(n - 1)) / n,
        -sum(p * math.log2(p) for p in share.values()), sum(map(len, _WORDS.findall(low))) / n,
        float(value.count(".")), float("@" in value), float(value.count("/")), float(value.count("-")),
        says(EXAMPLE, path.lower()), says(SECRETIVE, near), says(HARMLESS, near), says(EXAMPLE, around + " " + low), float(bool(name) or near.rstrip().endswith(("=", ":"))),
        float(value.startswith(PREFIXES)), max(share.values()),
    ]


def _secretive(text: str) -> bool:
    return any(w in text for w in SECRETIVE)


def _plain_parts(piece: str, at: int) -> Iterator[tuple[str, int, str]]:
    """parts() of a piece without quotes of its own that begins at the given place."""
    cuts = [0, *[m.end() for m in _APART.finditer(piece)]]
    for start, end in zip(cuts, [*[c - 1 for c in cuts[1:]], len(piece)], strict=True):
        name, start = "", start + len(piece[start:end]) - len(piece[start:end].lstrip("([{<"))
        while (m := _NAMED.match(piece, start, end)) and (not name or _secretive(m[1].lower())):
            name, start = m[1], m.end()
        m = _VALUE.match(piece, start, end)
        yield name, at + m.start(1), m[1]


def parts(run: str) -> Iterator[tuple[str, int, str]]:
    """(name or "", start, value) of the assigned and quoted parts of a run, and of the rest between them."""
    name = ""
    for m in _QUOTED.finditer(run):
        if not m[1]:
            last = _NAME_LAST.search(m[0]) if m.end() < len(run) else None  # a quote follows
            if m[0].strip("=:"):
                name = last[1] if last else ""
            yield from _plain_parts(m[0][: last.start()] if last else m[0], m.start())
        elif name:
            yield name, m.start(2), m[2]
            name = ""
        elif run[m.end() : m.end() + 1] in (":", "="):
            name = m[2]
        else:
            yield from _plain_parts(m[2], m.start(2))


def candidates_in(text: str, path: str) -> Iterator[tuple[int, str, list[float]]]:
    """(start, value, features) of each candidate of a text."""
    runs = list(re.finditer(r"\S+", text))
    words = [m[0] for m in runs]
    named = _secretive(text.lower())
    for i, w in enumerate(words):
        if len(w) < VALUE_LEAST:
            continue
        formed = len(w) >= LEAST and _SHAPE.search(w)
        if not (named or formed or any(p in w for p in PREFIXES)):
            continue
        before = words[max(0, i - 3) : i]
        near = named and _secretive(" ".join(before).lower())
        for name, start, value in parts(w):
            if len(value) >= VALUE_LEAST and (value.startswith(PREFIXES) or near or _secretive(name.lower()) or (formed and _SHAPE.search(value))):
                yield runs[i].start() + start, value, describe(value, before, words[i + 1 : i + 3], name, path)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, start (code points), length, value_sha256, features of every candidate."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("value_sha256", pa.string()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, place in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("path").to_pylist(), strict=True):
                for start, value, features in candidates_in(text.as_py() or "", place or ""):
                    rows.append((doc, start, len(value), hashlib.sha256(value.encode()).hexdigest(), features))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    from_path = F.col(path) if path in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), from_path.cast("string").alias("path")).mapInArrow(
        run, "doc_id long, start long, length int, value_sha256 string, features array<double>"
    )


def labelled_findings(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(before, value with its name or quotes, after, path, label) made from public formats; label 1: a secret."""
    r = random.Random(seed)
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    sounds = [a + b for a in ("th", "er", "st", "on", "ch", "le", "an", "mi", "ro") for b in ("e", "in", "or", "a", "us")]
    prose = lambda: "".join(r.choice(sounds) for _ in range(r.randint(1, 4)))
    name = lambda k: [r.choice(DICTIONARY) for _ in range(k)]
    secret_name = lambda: r.choice(("password", "token", "secret", "api_key", "auth_token", "access_key", "pwd"))
    joined = lambda v: r.choice((f"{secret_name()}={v}", f'{secret_name()}="{v}"', f"{secret_name()}:{v}"))
    spaced = lambda v: (f"{secret_name()} {r.choice('=:')}", r.choice((f'"{v}"', f"'{v}'", v)))
    rich = low + up + dig
    out = []
    for i in range(n):
        before, after, path, label = prose() + " " + prose(), prose() + " " + prose(), r.choice(("src", "app", "conf", "web", "lib")) + str(r.randrange(20)), i % 2
        if label:
            value = r.choice((
                lambda: r.choice(("AKIA", "ASIA")) + draw(up + "234567", 16), lambda: "ghp_" + draw(rich, 36), lambda: draw(hexa, r.choice((16, 18, 20, 24, 32, 40, 64))),
                lambda: draw(rich + "+/", r.choice((24, 32, 40, 44))), lambda: "xoxb-" + draw(dig, 12) + "-" + draw(rich, 24), lambda: draw(rich + "!#$%&*", r.randint(16, 24)),
                lambda: draw(rich, 4) + draw("!#$%&*", 1) + draw(rich, r.randint(3, 9)), lambda: draw(low + dig, r.randint(8, 15)), lambda: draw(low, r.randint(10, 24)), lambda: draw(up, r.randint(10, 24)),
                lambda: r.choice(DICTIONARY).title() + draw("!#$%&*", 1) + draw(rich, r.randint(4, 8)),
            ))()
            if value[:4] in ("AKIA", "ASIA", "ghp_", "xoxb") and r.random() < 0.6:
                pass  # known by their form, wherever they stand
            elif r.random() < 0.5:
                value = joined(value)
            else:
                before, value = spaced(value)
        else:
            shape = r.randrange(15)
            value = (
                lambda: f"{prose()}.{r.randrange(99)}@mail{r.randrange(9)}.{r.choice(('example', 'test', 'org'))}.com",
                lambda: draw("45", 1) + draw(dig, 15), lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(name(4)) + f"/{r.randrange(999)}.txt",
                lambda: name(1)[0] + "".join(w.title() for w in name(3)), lambda: f"https://{prose()}.com/{'-'.join(name(2))}/{r.randrange(9999)}", lambda: draw(hexa, r.choice((32, 40, 64))),
                lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randrange(10)}T0{r.randrange(10)}:00:00Z", lambda: f"{'_'.join(name(3))}_v{r.randrange(9)}", lambda: prose() * 4 + str(r.randrange(99)),
                lambda: joined(r.choice(("xxxxxxxxxxxxxxx1", "changeme12345678", "EXAMPLEKEY000000", "your-token-here-1", "1234567890123456"))), lambda: f"+{draw(dig, 2)}-{draw(dig, 4)}-{draw(dig, 8)}",
                lambda: "".join(r.choice(sounds) for _ in range(r.randint(4, 6))), lambda: r.choice([w for w in DICTIONARY if len(w) >= 7]) + r.choice(("s", "ing", "ed")),
                lambda: joined(r.choice(("changeme", "undefined", "required", "placeholder", "your_password", "xxxxxxxx", "********a", "os.environ"))),
            )[shape]()
            if shape in (2, 6):
                before = r.choice(("commit", "sha256", "md5 checksum", "uuid", "revision", "etag", "digest"))
            if shape in (12, 13):
                before = f"{prose()} {secret_name()} {r.choice(('', prose(), 'is', 'and'))}".rstrip()
            if shape == 6 and r.random() < 0.3:
                before, path = f"example {secret_name()} =", "tests/fixture"
        out.append((before, value, after, path, label))
    return out


def example_rows(findings: list[tuple[str, str, str, str, int]]) -> list[tuple[list[float], float]]:
    """(features, label) of the candidates in labelled findings."""
    out = []
    for before, value, after, path, label in findings:
        out += [(f, float(label)) for start, _, f in candidates_in(f"{before} {value} {after}", path) if len(before) <= start <= len(before) + len(value)]
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> RandomForestClassificationModel:
    rows = example_rows(labelled_findings() if findings is None else findings)
    data = spark.createDataFrame(rows, "features array<double>, label double").coalesce(1).select(array_to_vector("features").alias("x"), "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source") -> DataFrame:
    """doc_id, start, length, value_sha256, score, is_secret of every candidate of docs."""
    found = stored(candidates(docs, path), "candidates")
    scored = model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "length", "value_sha256", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(spark))
