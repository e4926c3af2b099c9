"""Merkle fingerprints of documents over sections, paragraphs and word runs (native expressions only).

A text is split without loss: sections at ``\\n\\n``, paragraphs at ``\\n``, and each paragraph into leaves of up to
eight words with their white space. A leaf is hashed with SHA-256, a paragraph hashes its leaves, a section its
paragraphs and the root its sections. Equal roots mean equal texts; where roots differ, section and leaf hashes show
where. A fingerprint is ``root|section;section...`` with a section as ``hash16:para/para...`` and a paragraph as the
comma-joined first eight hex digits of its leaves.

Nulls and edge cases: a null text counts as the empty text; the empty text has one section, one paragraph and no leaf;
repeated ids are ordered by text; a null id orders after all others; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, maybe_broadcast

LEAF_WORDS = 8
LEAF = f"[{WS}]*+(?:[^{WS}]++[{WS}]*+){{1,{LEAF_WORDS}}}+|[{WS}]++"

#: Neighbour search: quantile segments (bounded), and rows aimed at in a bucket of a segment.
SEGMENTS = 256
BUCKET_ROWS = 400


def leaves(text: Column) -> Column:
    """array of sections, each an array of paragraphs, each an array of leaf hashes (64 hex digits)."""
    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda w: F.sha2(w, 256))

    return F.transform(
        F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph)
    )


def section_hashes(tree: Column) -> Column:
    def node(tag: str, parts: Column) -> Column:
        return F.sha2(F.concat(F.lit(tag), F.array_join(parts, "")), 256)

    return F.transform(tree, lambda s: node("s", F.transform(s, lambda p: node("p", p))))


def fingerprint_of(tree: Column, sections: Column) -> Column:
    """The fingerprint text from a tree of leaf hashes and its section hashes."""
    body = F.transform(
        F.arrays_zip(sections.alias("h"), tree.alias("t")),
        lambda z: F.concat(
            F.substring(z["h"], 1, 16),
            F.lit(":"),
            F.array_join(
                F.transform(z["t"], lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), ",")), "/"
            ),
        ),
    )
    root = F.sha2(F.concat(F.lit("r"), F.array_join(sections, "")), 256)
    return F.concat(root, F.lit("|"), F.array_join(body, ";"))


def add_fingerprint(df: DataFrame, text: str, out: str, leaf_set: str | None = None) -> DataFrame:
    """Add column ``out`` with the fingerprint of ``text`` and, if asked for, its set of leaf tokens."""
    tree, secs = f"__tree_{out}", f"__secs_{out}"
    df = df.withColumn(tree, leaves(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(secs, section_hashes(F.col(tree)))
    df = df.withColumn(out, fingerprint_of(F.col(tree), F.col(secs)))
    if leaf_set:
        df = df.withColumn(leaf_set, F.array_distinct(F.transform(F.flatten(F.flatten(F.col(tree))), lambda x: F.substring(x, 1, 8))))
    return df.drop(tree, secs)


def leaf_tokens(fingerprint: Column) -> Column:
    """The set of leaf tokens that a fingerprint text carries."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(fingerprint, "[^|;]*[|:]|[0-9a-f]{16}:", ""), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(fp_a: Column, set_a: Column, fp_b: Column, set_b: Column) -> Column:
    """1 for equal fingerprints, otherwise the Dice coefficient of the leaf sets (0 when both are empty)."""
    total = F.size(set_a) + F.size(set_b)
    dice = F.lit(2.0) * F.size(F.array_intersect(set_a, set_b)) / total
    return F.when(fp_a == fp_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(dice)


def differing_sections(fp_a: Column, fp_b: Column) -> Column:
    """0-based indexes of sections whose subtree hash differs or that only one side has."""
    a = F.split(F.regexp_replace(fp_a, "^[^|]*[|]", ""), ";", -1)
    b = F.split(F.regexp_replace(fp_b, "^[^|]*[|]", ""), ";", -1)
    n = F.greatest(F.size(a), F.size(b))
    return F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: ~F.substring(F.get(a, i), 1, 16).eqNullSafe(F.substring(F.get(b, i), 1, 16)),
    )


def with_next(docs: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """Add ``out``: the text of the row that follows in descending ``key`` order; after the last comes the first.

    Rows are dealt into buckets of neighbouring keys (quantile segments, each cut into equal key ranges), so the text
    is shuffled once and no task sorts the whole table; only the first row of each bucket crosses into another one.
    """
    base = docs.select(F.col(key).cast("long").alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"), *[F.col(c) for c in docs.columns if c not in (key, text)])
    ids = base.select("__k")
    points = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    stats = ids.agg(F.percentile_approx("__k", points, 2000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    bounds = sorted(set(stats["q"] or [0]))
    subs = max(1, -(-stats["n"] // (len(bounds) * BUCKET_ROWS)))
    widths = [max(1, -(-(b - a) // subs)) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1])]
    low, width = F.array(*map(F.lit, bounds)), F.array(*[F.lit(w).cast("long") for w in widths])
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    seg = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(low, at + s - 1) <= F.col("__k")), at + s).otherwise(at),
    )

    def bucketed(df: DataFrame) -> DataFrame:
        df = df.withColumn("__s", F.when(F.col("__k").isNull(), F.lit(-1)).otherwise(F.greatest(seg, F.lit(1))))
        at = F.col("__s") - 1
        sub = F.floor((F.col("__k") - F.get(low, at)) / F.get(width, at))
        sub = F.least(F.greatest(sub, F.lit(0)), F.lit((1 << 31) - 1))
        return df.withColumn("__b", F.coalesce(F.col("__s").cast("long") * (1 << 31) + sub, F.lit(-1).cast("long")))

    tops = bucketed(ids).groupBy("__s", "__b").agg(F.max("__k").alias("__top"))
    # At most SEGMENTS + 1 rows: the largest key of each segment.
    seg_tops = {r["__s"]: r["m"] for r in tops.groupBy("__s").agg(F.max("__top").alias("m")).collect()}
    order = sorted(seg_tops, reverse=True)
    after = {s: seg_tops[order[(i + 1) % len(order)]] for i, s in enumerate(order)} if order else {}
    cross = F.lit(None).cast("long")
    for s, v in after.items():
        cross = F.when(F.col("__s") == s, F.lit(v).cast("long")).otherwise(cross) if len(after) <= 8 else cross
    if len(after) > 8:
        arr = F.array(*[F.lit(after.get(s)).cast("long") for s in range(-1, max(after) + 1)])
        cross = F.get(arr, F.col("__s") + 1)
    in_seg = Window.partitionBy("__s").orderBy(F.desc("__b"))
    links = tops.select(
        "__b", F.when(F.lead("__b").over(in_seg).isNull(), cross).otherwise(F.lead("__top").over(in_seg)).alias("__to")
    )
    n_links = max(1, stats["n"] // BUCKET_ROWS + SEGMENTS)
    first = (
        base.select("__k", "__t")
        .join(maybe_broadcast(links, n_links, 32), F.col("__k").eqNullSafe(F.col("__to")))
        .groupBy("__b")
        .agg(F.min("__t").alias("__first"))
    )
    w = Window.partitionBy("__b").orderBy(F.col("__k").desc_nulls_last(), F.col("__t"))
    out_df = bucketed(base).withColumn("__n", F.lead("__t").over(w)).join(first, "__b", "left")
    out_df = out_df.withColumn(out, F.coalesce("__n", "__first"))
    return out_df.select(F.col("__k").alias(key), F.col("__t").alias(text), out, *[c for c in docs.columns if c not in (key, text)])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's."""
    df = with_next(docs.select("doc_id", "text"), "doc_id", "text", "__next")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn(
        "__edited",
        F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("__next").substr(F.lit(1), half)),
    )
    df = df.withColumn("edited_sha256", F.sha2("__edited", 256))
    df = add_fingerprint(df, "text", "fingerprint", "__sa")
    df = add_fingerprint(df, "__edited", "edited_fingerprint", "__se")
    df = add_fingerprint(df, "__next", "__fn", "__sn")
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("__sa"), F.col("edited_fingerprint"), F.col("__se")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__sa"), F.col("__fn"), F.col("__sn")).alias("near_next"),
    )
