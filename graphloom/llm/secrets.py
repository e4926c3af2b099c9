"""Secret scan: three base patterns and sliding-window entropy over candidate strings (native expressions only).

Positions are code points, end exclusive. Base kinds are matched leftmost and non-overlapping per kind; a match that
fails its length test is dropped with the text it consumed. The entropy kind slides a window over every candidate run of
a character class: the counts of the window's characters are kept in the fold's state, and each step changes two of them
and two terms of the sum, so a window costs the same at any width. Windows over the class's threshold merge into one
span, from the first such window to the last. A span is suppressed if no window over the threshold is left between the parts
of its run that allow-list patterns match, or if it lies inside a base span; base spans always stay.

Nulls and edge cases: a null text counts as empty (no spans, the hash of the empty string); repeated rows are scanned
row by row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the class is maximal, so asking for the length inside the pattern drops exactly the runs that are too short.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharClass:
    """Candidate runs of a class and the entropy in bits that a window must reach."""

    name: str
    pattern: str
    bits: float


WINDOW = 20
CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_-])", 3.0),
    CharClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])(?![0-9A-Fa-f]++(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}", 3.7),
)
#: Strings known to be harmless: ordered alphabets and digits, placeholders, UUIDs.
ALLOW = (
    r"(?i)0123456789|abcdefghij|example|sample|placeholder|xxxxxxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)


#: Elements whose sums run in one fold: a fold copies what it has found at each step, so long arrays go by blocks.
BLOCK = 128


def sums_before(values: Column) -> Column:
    """For each of the numbers the sum of all before it. Sums run within blocks, then over the blocks' totals: nearly linear."""
    def run(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda t, x: t + x)

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(blocks) - 1) / BLOCK).cast("int")), lambda i: F.slice(blocks, i * BLOCK + 1, F.lit(BLOCK)))
    # Groups of blocks: their totals are few enough for one fold up to some millions of numbers.
    tops = run(F.transform(groups, lambda g: F.aggregate(F.transform(g, total), F.lit(0), lambda t, x: t + x)))
    inner = F.flatten(F.zip_with(groups, tops, lambda g, at: F.transform(run(F.transform(g, total)), lambda x: x + at)))
    long = F.flatten(F.zip_with(blocks, inner, lambda b, at: F.transform(run(b), lambda x: x + at)))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= BLOCK, run(values)).otherwise(long)


@dataclass(frozen=True)
class Wanted:
    """A pattern whose matches become spans of a kind; ``keep`` drops matches, with the text that they consumed."""

    pattern: str
    kind: str
    rank: int
    keep: Callable[[Column], Column] | None = None


def with_spans(df: DataFrame, text: str, wanted: list[Wanted]) -> DataFrame:
    """``df`` with an array of spans for each pattern, named ``s0``, ``s1`` ..; positions follow from the lengths of matches and of the pieces between.

    Each step is a projection of its own, so that no pattern is matched twice.
    """
    own, n = df.columns, range(len(wanted))
    found = [F.regexp_extract_all(text, F.lit(w.pattern), F.lit(0)).alias(f"f{i}") for i, w in enumerate(wanted)]
    df = df.select(*own, *found, *[F.transform(F.split(text, w.pattern, -1), lambda x: F.length(x)).alias(f"g{i}") for i, w in enumerate(wanted)])
    sizes = [F.zip_with(F.slice(f"g{i}", F.lit(1), F.size(f"f{i}")), f"f{i}", lambda g, m: g + F.length(m)).alias(f"v{i}") for i in n]
    df = df.select(*own, *[c for i in n for c in (f"f{i}", f"g{i}")], *sizes)
    df = df.select(*own, *[c for i in n for c in (f"f{i}", f"g{i}")], *[sums_before(F.col(f"v{i}")).alias(f"b{i}") for i in n])

    def spans(i: int, w: Wanted) -> Column:
        zipped = F.filter(F.arrays_zip(F.col(f"b{i}").alias("b"), F.col(f"g{i}").alias("g"), F.col(f"f{i}").alias("m")), lambda z: z["m"].isNotNull() & (w.keep(z["m"]) if w.keep else F.lit(True)))
        one = lambda z: F.struct((z["b"] + z["g"]).alias("start"), F.lit(w.rank).alias("rank"), (z["b"] + z["g"] + F.length(z["m"])).alias("end"), F.lit(w.kind).alias("kind"))
        return F.when(F.size(f"f{i}") == 0, F.array().cast(SPAN)).otherwise(F.transform(zipped, one))

    return df.select(*own, *[spans(i, w).alias(f"s{i}") for i, w in enumerate(wanted)])


def _f(c: Column) -> Column:
    """c * log2(c) for a small count, looked up."""
    return F.get(F.array(*[F.lit(i * math.log2(i) if i else 0.0) for i in range(WINDOW + 2)]), c)


def entropy_reach(s: Column, bits: float) -> Column:
    """struct(lo, hi): offsets of the first window's start and the last window's end with that entropy; lo = -1: none."""
    chars = F.split(s, "")
    n = F.length(s)
    letters = F.array_distinct(chars)
    limit = F.lit(WINDOW * (math.log2(WINDOW) - bits) + 1e-9)  # the sum of c*log2(c) stays at or below this
    first = F.slice(chars, 1, WINDOW)
    counts = F.transform(letters, lambda a: F.size(F.filter(first, lambda x: x == a)))
    total = F.aggregate(counts, F.lit(0.0), lambda t, c: t + _f(c))
    zero = F.struct(
        counts.alias("c"), total.alias("t"),
        F.when(total <= limit, 0).otherwise(-1).alias("lo"), F.when(total <= limit, WINDOW).otherwise(-1).alias("hi"),
    )

    def step(acc: Column, i: Column) -> Column:
        gone, come = F.array_position(letters, F.get(chars, i - 1)) - 1, F.array_position(letters, F.get(chars, i + WINDOW - 1)) - 1
        cg, cc = F.get(acc["c"], gone.cast("int")), F.get(acc["c"], come.cast("int"))
        same = gone == come
        t = F.when(same, acc["t"]).otherwise(acc["t"] - _f(cg) + _f(cg - 1) - _f(cc) + _f(cc + 1))
        c = F.when(same, acc["c"]).otherwise(
            F.transform(acc["c"], lambda x, k: x - F.when(k == gone, 1).otherwise(0) + F.when(k == come, 1).otherwise(0))
        )
        hit = t <= limit
        return F.struct(
            c.alias("c"), t.alias("t"),
            F.when(hit & (acc["lo"] < 0), i).otherwise(acc["lo"]).alias("lo"), F.when(hit, i + WINDOW).otherwise(acc["hi"]).alias("hi"),
        )

    steps = F.when(n > WINDOW, F.sequence(F.lit(1), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, zero, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def entropy_spans(candidates: Column, text: Column, rank: int, cls: CharClass, allow=ALLOW) -> Column:
    """Spans over the threshold inside candidate spans (as with_spans gives them), unless only allow-listed strings reach it."""
    def look(z: Column) -> Column:
        s = F.substring(text, z["start"] + 1, z["end"] - z["start"])
        reach = entropy_reach(s, cls.bits)
        start = z["start"] + reach["lo"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (z["start"] + reach["hi"]).alias("end"), F.lit(cls.name).alias("kind"), (reach["lo"] >= 0).alias("hit"), s.alias("s"))

    looked = F.filter(F.transform(candidates, look), lambda z: z["hit"])
    listed = "|".join(f"(?:{a})" for a in allow)
    beside = lambda s: F.exists(F.split(s, listed, -1), lambda x: (F.length(x) >= WINDOW) & (entropy_reach(x, cls.bits)["lo"] >= 0))
    looked = F.filter(looked, lambda z: F.when(z["s"].rlike(listed), beside(z["s"])).otherwise(True))
    return F.transform(looked, lambda z: F.struct(z["start"].alias("start"), z["rank"].alias("rank"), z["end"].alias("end"), z["kind"].alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", z["kind"], z["start"].cast("string"), z["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """The rows of ``docs`` with ``base`` (array of base spans) and ``spans`` (all spans), each in order of start and kind.

    All columns are kept, whatever their names; the two new ones must not be among them.
    """
    if {base.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {base} or {spans} already")
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("x"))
    group2 = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    kinds = [Wanted(ASSIGN, "assign", 0, group2), Wanted(ACCESS, "access", 1), Wanted(HEX, "hex", 2)]
    kinds += [Wanted(cls.pattern, cls.name, len(kinds) + i) for i, cls in enumerate(CLASSES)]
    df = with_spans(df, "x", kinds).withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    for i, cls in enumerate(CLASSES):
        entropy = entropy_spans(F.col(f"s{3 + i}"), F.col("x"), 3 + i, cls)
        outside = F.filter(entropy, lambda z: ~F.exists(F.col("base"), lambda b: (b["start"] <= z["start"]) & (z["end"] <= b["end"])))
        df = df.withColumn(f"e{i}", F.when(F.size(f"s{3 + i}") == 0, F.array().cast(SPAN)).otherwise(outside))
    df = df.withColumn("spans", F.array_sort(F.concat("base", *[f"e{i}" for i in range(len(CLASSES))])))
    return df.select("row.*", F.col("base").alias(base), F.col("spans").alias(spans))


def secret_report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda z: z["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
