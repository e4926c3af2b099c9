"""Toxicity score from a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lowers case, maps compatibility forms and look-alike letters of other scripts to Latin ones, and digits and symbols to the
letters they stand for; i, l, 1, ! and | fold to one letter. Everything else becomes a blank, so that a term can be
anchored at the start of a word (all terms) and at its end (whole words). Where several terms start at one place the
heaviest counts. Exception phrases are matched by the same automaton, and terms inside one don't count.

The lexicon is learned: whole words and word beginnings of four to eight letters whose document frequency among toxic
labels is many times that among the others, with a log-odds weight; the strongest MAX_TERMS by the G statistic count.
Exceptions are given, or learned: a word that meets a term, with the word before or after it, where that phrase occurs in
several documents that are not toxic and in no toxic one. The score is a logistic function of the weight found
and of the text's length, fitted on the same rows. Labels are read for at most FIT_ROWS documents, chosen by a hash of
the id (a documented bound of the fit); scoring reads every text whole.

Nulls and edge cases: a null text scores as the empty one; labels that are null or whose document is missing, and all
labels of a document that contradict each other, are left out; of different texts that share a labelled doc_id the
one of the smallest hash is learned from; with no labels, or labels of one class, every score is the base rate's (0.02 without any); repeated rows are
scored one by one; an empty table gives an empty result; only doc_id and text are read, and doc_id is no input of the
score; scored rows keep all columns, whatever their names, and the score's name can be chosen.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, materialize, maybe_broadcast, release_memory

FIT_ROWS = 20_000
MAX_TERMS = 5_000
PREFIXES = (4, 5, 6, 7, 8)
#: Least support among toxic documents, ratio of the two frequencies and G statistic of a term.
MIN_DOCS, MIN_RATIO, MIN_G = 3, 20.0, 18.0
#: Documents that are not toxic in which an exception phrase occurs at least, and how many phrases are learned at most.
MIN_CLEAN, MAX_EXCEPTIONS = 3, 2_000

#: Look-alikes, each with the Latin letters they fold to.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "i", "һ": "h", "ц": "u", "ѵ": "v", "ɡ": "g",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "i", "þ": "p", "ð": "d", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fi",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "i", "l": "i"}
#: Characters that are written inside a word to hide it and vanish: soft hyphen, joiners, zero-width space, marks.
VANISH = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")


class _Fold(dict):
    """A translation table filled on demand, one entry for each character met."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        c = chr(code)
        if c in VANISH or unicodedata.combining(c):
            out = ""
        else:
            parts = []
            for x in unicodedata.normalize("NFKC", HOMOGLYPHS.get(c, c)).lower():
                x = DIGITS.get(x, x)
                x = HOMOGLYPHS.get(x, x)
                if not unicodedata.combining(x):
                    parts.append(x if x.isalnum() else " ")
            out = "".join(parts)
        self[code] = out
        return out


_TABLE = _Fold()


def fold(text: str) -> str:
    """The folded text between blanks."""
    return f" {text.lower().translate(_TABLE)} "


@dataclass(frozen=True)
class Model:
    """terms: anchored folded patterns with weights; b0 + b1 * log1p(weight) + b2 * log1p(words) is the score's logit."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    b0: float = -4.0
    b1: float = 0.0
    b2: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for e in self.exceptions:
            t = fold(e)[:-1]
            a.add_word(t, (len(t), -1.0))
        if not len(a):
            return None
        a.make_automaton()
        return a


def weigh(folded: str, automaton: ahocorasick.Automaton | None) -> float:
    """Sum over start positions of the heaviest term there, without terms that an exception phrase covers."""
    if automaton is None:
        return 0.0
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w < 0:
            covered.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    if covered:
        starts, ends = _joined(covered)
        best = {s: w for s, w in best.items() if not (i := bisect_right(starts, s)) or ends[i - 1] < s}
    return sum(best.values())


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans, overlapping ones joined, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if starts and a <= ends[-1] + 1:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def features(folded: str) -> set[str]:
    """Anchored patterns of a text: whole words and word beginnings."""
    out: set[str] = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 24:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos: Counter[str] = Counter()
    neg: Counter[str] = Counter()
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic")):
            (pos if toxic.as_py() else neg).update(features(fold(text.as_py() or "")))
        if len(pos) + len(neg) > 300_000:
            yield _counted(pos, neg)
            pos, neg = Counter(), Counter()
            release_memory()
    yield _counted(pos, neg)
    del pos, neg
    release_memory()


def _counted(pos: Counter, neg: Counter) -> pa.RecordBatch:
    terms = list(pos.keys() | neg.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], names=["term", "pos", "neg"]
    )


def _logistic(x: np.ndarray, y: np.ndarray, k: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression of rows that occur k times, by Newton steps; the intercept is free."""
    x = np.column_stack([np.ones(len(x)), x])
    b, r = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    r[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + r, x.T @ (k * (y - p)) - r @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def sample_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fifth, in the order of a hash of the id; contradictions are left out."""
    known = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    one = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    return one.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def phrases(folded: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Each word that meets a term, with the word before it and with the one after it, where a single blank parts them."""
    out: set[str] = set()
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 2  # a term begins with the blank before its word
        stop = folded.find(" ", start)
        before, after = folded.rfind(" ", 0, start - 1) + 1, folded.find(" ", stop + 1)
        if w > 0 and before < start - 1:
            out.add(folded[before:stop])
        if w > 0 and stop + 1 < after:
            out.add(folded[start:after])
    return out


def _phrase_counts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        pos: Counter[str] = Counter()
        neg: Counter[str] = Counter()
        for b in batches:
            release_memory()
            for text, toxic in zip(b.column("text"), b.column("toxic")):
                (pos if toxic.as_py() else neg).update(phrases(fold(text.as_py() or ""), automaton) if automaton else ())
        yield _counted(pos, neg)

    return run


COUNTS = "term string, pos long, neg long"


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), rows: int = FIT_ROWS) -> Model:
    """Learn lexicon, exceptions and calibration from at most ``rows`` labelled documents; given exceptions are kept."""
    bound_batches(docs.sparkSession)
    chosen = maybe_broadcast(sample_labels(labels, rows), rows, 24)
    labelled = docs.select("doc_id").join(chosen, "doc_id").groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("k"))
    sums = labelled.agg(F.sum("toxic"), F.count(F.lit(1)), F.max("k")).first()
    train = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    if (sums[2] or 0) > 1:  # several rows of one id: the hash says which text counts, so that the bound holds
        hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
        one = hashed.select("doc_id", "th").join(chosen, "doc_id").groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("th").alias("th"))
        train = hashed.join(maybe_broadcast(materialize(one, "toxicity-train"), rows, 32), ["doc_id", "th"]).select("text", "toxic")
    total_p = int(sums[0] or 0)
    total_n = int(sums[1]) - total_p
    if not total_p or not total_n:
        rate = (total_p + 0.5) / (total_p + total_n + 1) if total_p + total_n else 0.02
        return Model({}, exceptions, math.log(rate / (1 - rate)))
    summed = lambda run: train.mapInArrow(run, COUNTS).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.lit(float(total_n) / total_p) * (F.col("pos") + 0.5) / (F.col("neg") + 0.5)
    share = total_p / (total_p + total_n)
    both = F.col("pos") + F.col("neg")
    part = lambda k, s: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * s))).otherwise(0.0)
    g = 2 * (part("pos", share) + part("neg", 1 - share))
    best = summed(_count).where((F.col("pos") >= MIN_DOCS) & (ratio >= MIN_RATIO)).withColumn("g", g).where(F.col("g") >= MIN_G).orderBy(F.desc("g"), "term").limit(MAX_TERMS)
    terms = {r.term: math.log((r.pos + 0.5) / (total_p + 1)) - math.log((r.neg + 0.5) / (total_n + 1)) for r in best.collect()}
    clean = summed(_phrase_counts(Model(terms))).where((F.col("pos") == 0) & (F.col("neg") >= MIN_CLEAN)).orderBy(F.desc("neg"), "term").limit(MAX_EXCEPTIONS)
    exceptions = (*exceptions, *sorted(r.term for r in clean.collect()))
    model = Model(terms, exceptions)
    got = train.mapInArrow(_weights(model), "w double, n long, toxic int").groupBy("w", "n", "toxic").agg(F.count(F.lit(1)).alias("k")).orderBy("w", "n", "toxic").toPandas()  # at most ``rows`` rows
    x = np.column_stack([np.log1p(got["w"]), np.log1p(got["n"])])
    b = _logistic(x, got["toxic"].to_numpy(dtype=float), got["k"].to_numpy(dtype=float))
    return Model(terms, exceptions, *map(float, b))


def _weights(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            release_memory()
            w, n = np.empty(b.num_rows), np.empty(b.num_rows, dtype=np.int64)
            for i, t in enumerate(b.column("text")):
                folded = fold(t.as_py() or "")
                w[i], n[i] = weigh(folded, automaton), folded.count(" ")
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n), b.column("toxic")], names=["w", "n", "toxic"])

    return run


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` between 0 and 1, which ``docs`` must not have; needs a column ``text``."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out} already")
    bound_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            release_memory()
            got = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text")):
                folded = fold(t.as_py() or "")
                z = model.b0 + model.b1 * math.log1p(weigh(folded, automaton)) + model.b2 * math.log1p(folded.count(" "))
                got[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, f"{fields}, `{out}` double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns kept."""
    name = free_name(docs, "__toxicity")
    return score(docs, model, name).where(F.col(name) < limit).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
