"""Mixing sources to target weights by hash-threshold histograms (native expressions only).

Sizes are summed by (source, hash bucket). Walking the buckets upward, the budget of a source falls into one boundary
bucket; only that bucket is summed again, with the next bits of the hash, until a bucket is a single hash value. What
lies below the threshold is taken by a filter: nothing is sorted. Thresholds are nested, since the hash of a document
never changes: a larger budget takes all that a smaller one takes.

A source whose target exceeds its size is repeated whole, and the threshold settles the rest. The boundary documents
(equal hashes share one fate) give just the words still missing, so that a source meets its target within a word for each of
them; where whole documents are wanted, they are taken if that brings the source nearer to its target.

Nulls and edge cases: a null text has size 0; a null source is a source of its own, last in order; rows with the same
id share one hash and one fate; an empty table gives an empty result; documents of size 0 take 0 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, materialize, maybe_broadcast

#: Bits of the hash settled by each histogram; 5 rounds settle all 60 bits.
ROUND_BITS, ROUNDS = 12, 5
HASH_BITS = ROUND_BITS * ROUNDS


def word_count(text: Column) -> Column:
    """Number of words in one regex pass: each word with its white space becomes one character."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]*+[^{WS}]++[{WS}]*+", "x")
    return F.length(F.translate(marks, WS_CHARS, "")).cast("long")


def mix_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text: any engine can compute it."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, source_size, target. Works on one row per source, never on documents.

    The level L solves sum(min(max_repeat * size, L * weight)) = total; it is found along the order of
    max_repeat * size / weight, where a prefix of sources is capped.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.lit(max_repeat).cast("long") * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        F.sum("source_size").over(every).alias("total"),
        F.sum("w").over(every).alias("w_total"),
    )
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("w_total") - F.col("w_before")).cast("double")
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    # The first source in order that isn't capped sets the level of all that follow.
    per = per.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def hash_thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the hash below which documents are taken (exclusive), and what the budget leaves for that hash.

    source, all_in (the budget covers every document), base (the boundary hash), left (budget for it), edge (its sizes).

    ``sizes`` has source, size, h; ``budgets`` has source, budget. Each round is one partial aggregation over the
    rows of the boundary buckets only.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("base"), F.lit(False).alias("all_in"))
    for r in range(ROUNDS):
        shift = HASH_BITS - ROUND_BITS * (r + 1)
        rows = sizes
        if r:
            rows = sizes.join(state.select("source", "base", "all_in"), sizes["source"].eqNullSafe(state["source"])).where(
                ~F.col("all_in") & (F.shiftright("h", shift + ROUND_BITS) == F.shiftright("base", shift + ROUND_BITS))
            ).select(sizes["source"], "size", "h")
        hist = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("cum", F.sum("tokens").over(upto)).alias("a").join(
            state.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))
        )
        over = F.col("cum").cast("double") > F.col("left")
        found = hist.groupBy(F.col("s.source").alias("source")).agg(
            F.min(F.when(over, F.struct("bucket", "tokens", "cum"))).alias("hit"),
            F.max("cum").alias("whole"),
        )
        state = state.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left").select(
            F.col("s.source").alias("source"),
            F.when(F.col("hit").isNull(), F.col("left")).otherwise(F.col("left") - (F.col("hit.cum") - F.col("hit.tokens"))).alias("left"),
            F.when(F.col("hit").isNull(), F.col("base")).otherwise(F.shiftleft(F.col("hit.bucket"), shift)).alias("base"),
            (F.col("all_in") | F.col("hit").isNull()).alias("all_in"),
            F.when(F.col("hit").isNull(), F.lit(0)).otherwise(F.col("hit.tokens")).alias("edge"),
        )
        state = materialize(state.select("source", "left", "base", "all_in", "edge"), f"mix-round{r}")
    return state


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, source, size, h of every document) and (plan: a row for each source)."""
    sizes = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("h")), "mix-sizes"
    )
    per = source_targets(sizes, weights, max_repeat)
    per = per.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = materialize(per.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    state = hash_thresholds(sizes.where("size > 0"), per.select("source", "budget"))
    plan = per.alias("p").join(state.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left").select(
        F.col("p.source").alias("plan_source"), "source_size", "target", "passes", "budget", "all_in", "base", "left", "edge"
    )
    return sizes, materialize(plan.withColumn("room", (F.col("passes") < max_repeat) & (F.col("budget") > 0)), "mix-plan")


def _below() -> Column:
    return F.col("room") & (F.col("all_in") | (F.col("h") < F.col("base")))


def _at_edge() -> Column:
    return F.col("room") & ~F.col("all_in") & (F.col("h") == F.col("base"))


def _nearer() -> Column:
    return F.col("edge") - F.col("left") < F.col("left")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words in the mix; boundary documents give what is missing)."""
    sizes, plan = plan_mix(docs, weights, max_repeat)
    out = sizes.join(maybe_broadcast(plan, plan.count(), 128), sizes["source"].eqNullSafe(plan["plan_source"]))
    copies = F.col("passes") + F.when(_below(), 1).otherwise(0)
    part = F.when(_at_edge(), F.floor(F.col("left") * F.col("size") / F.col("edge"))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size") + part).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The first words of a text with the white space between them."""
    pieces = F.regexp_extract_all(text, F.lit(f"([{WS}]*+[^{WS}]++)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, whole: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    ``whole``: boundary documents come whole where that is nearer to the target. Otherwise they come cut to the words that
    are missing, so that the words of a document's rows are what ``mix`` reports as taken. All columns are kept as they
    are, whatever their names; only a cut text differs.
    """
    _, plan = plan_mix(docs, weights, max_repeat)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), mix_hash(docs["doc_id"]).alias("h"), docs["source"].alias("row_source"))
    out = rows.join(maybe_broadcast(plan, plan.count(), 128), rows["row_source"].eqNullSafe(plan["plan_source"]))
    copies = F.coalesce(F.col("passes") + F.when(_below() | (_at_edge() & _nearer() if whole else F.lit(False)), 1).otherwise(0), F.lit(0)).cast("int")
    if whole:
        return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
    part = F.when(_at_edge(), F.floor(F.col("left") * word_count(F.col("row.text")) / F.col("edge"))).otherwise(0)
    cut = F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("words", F.explode(F.concat(F.array_repeat(F.lit(None).cast("bigint"), copies), cut)))
    text = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("words")))
    return out.withColumn("row", F.col("row").withField("text", text)).select("row.*")
