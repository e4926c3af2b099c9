"""Benchmark decontamination: exact seeds by the pigeonhole principle, edit verification.

Texts and items are sequences of words, lower-cased and without punctuation at their ends. An item is cut into one
segment more than the edits that EDIT_SHARE allows, so that in any stretch within that bound at least one segment (two to
four words) stands unchanged. Every place of a document is looked up among the segments, hence the recall at EDIT_SHARE is
1 but for the hashes. Around each seed the words of the item are counted, and where enough are there the item is
verified: its edit distance to the best stretch of words must be at most EDIT_SHARE of its words.

The items are a stated query set, matched in blocks of at most BLOCK_ITEMS against all rows; documents are not shuffled.

Nulls and edge cases: null or empty texts have no hits; items of fewer than MIN_WORDS words (also null ones) are not
matched; repeated items each report; repeated documents each report; empty tables give an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release_memory
from .editdist import best_infix
from .ngram_join import mix
from .tokenstore import slices

MIN_WORDS = 4
EDIT_SHARE = 0.25
BLOCK_ITEMS = 20_000
_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'`()[]{}<>|*_~#-–—«»„“”‚‘’…¿¡/\\"


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the normalised words of all texts, and the texts' offsets."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    words = [w.strip(_EDGE) for w in coded.dictionary.to_pylist()]
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in words), dtype=np.uint64, count=len(words))
    h = table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
    real = h != 0
    return h[real], np.concatenate([[0], np.cumsum(real)])[bounds]


def grams(words: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all runs of two, three and four words, by the word that they begin at."""
    out = {1: words}
    for k in range(2, 5):
        m = max(0, len(words) - k + 1)
        out[k] = mix(out[k - 1][:m] ^ mix(words[k - 1 :] + np.uint64(0x9E3779B9 * k))) if m else np.empty(0, np.uint64)
    return {k: g for k, g in out.items() if k > 1}


@dataclass
class Probes:
    """The segments of one length of all items, sorted by hash, with the item and offset of each."""

    length: int
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray


_LOW = np.uint64((1 << 22) - 1)


def edits_of(words: int) -> int:
    return int(EDIT_SHARE * words)


def build_probes(items: list[np.ndarray]) -> list[Probes]:
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, w in enumerate(items):
        if len(w) >= MIN_WORDS:
            parts = edits_of(len(w)) + 1
            cuts = [len(w) * k // parts for k in range(parts + 1)]
            by = grams(w)
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(b - a, []).append((int(by[b - a][a]), i, a))
    out = []
    for length, rows in sorted(found.items()):
        k = np.array([x[0] for x in rows], dtype=np.uint64)
        it, of = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        order = np.argsort(k, kind="stable")
        bitmap = np.zeros(1 << 22, dtype=bool)
        bitmap[(k & _LOW).astype(np.int64)] = True
        out.append(Probes(length, k[order], it[order], of[order], bitmap))
    return out


def find_hits(words: np.ndarray, bounds: np.ndarray, items: list[np.ndarray], probes: list[Probes]) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, first word) of every verified pair of a text and an item, the best stretch of each."""
    tries: set[tuple[int, int, int]] = set()
    grid = [max(1, edits_of(len(w))) for w in items]  # stretches that begin in one cell are verified as one
    held: dict[int, set[int]] = {}
    by = grams(words)
    for p in probes:
        g = by[p.length]
        at = np.flatnonzero(p.bitmap.take((g & _LOW).view(np.int64)))
        lo, hi = np.searchsorted(p.keys, g[at], "left"), np.searchsorted(p.keys, g[at], "right")
        doc = np.searchsorted(bounds, at, side="right") - 1
        real = (hi > lo) & (at + p.length <= bounds[doc + 1])
        for s, d, a, b in zip(at[real].tolist(), doc[real].tolist(), lo[real].tolist(), hi[real].tolist()):
            tries.update((d, it, (s - of) // grid[it]) for it, of in zip(p.item[a:b].tolist(), p.offset[a:b].tolist()))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for d, it, at in sorted(tries):
        item = items[it]
        most = edits_of(len(item))
        if best.get((d, it), (most + 1, 0))[0] == 0:
            continue
        lo, hi = max(int(bounds[d]), at * grid[it] - most), min(int(bounds[d + 1]), (at + 1) * grid[it] + len(item) + most)
        near = words[lo:hi].tolist()
        if it not in held:
            held[it] = set(item.tolist())
        if sum(map(held[it].__contains__, near)) < len(item) - most:
            continue
        edits, end = best_infix(item.tolist(), near)
        if edits <= most and edits < best.get((d, it), (most + 1, 0))[0]:
            best[(d, it)] = (edits, lo + max(0, end - len(item)) - int(bounds[d]))
    return [(d, it, e, s) for (d, it), (e, s) in best.items()]


HITS = "doc_id long, item_id long, item_words int, edits int, first_word int"


def _matcher(ids: list[int], texts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bounds = normal_words(pa.array(texts, pa.string()))
        items = [words[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        probes = build_probes(items)
        for batch in batches:
            release_memory()
            docs = pc.fill_null(batch.column("text"), "")
            keys = batch.column("doc_id")
            for i, j in slices(docs):
                found = find_hits(*normal_words(docs.slice(i, j - i)), items, probes)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(i, j - i).take(pa.array([d for d, *_ in found], pa.int64())),
                        pa.array([ids[it] for _, it, *_ in found], pa.int64()),
                        pa.array([len(items[it]) for _, it, *_ in found], pa.int32()),
                        pa.array([e for *_, e, _ in found], pa.int32()),
                        pa.array([s for *_, s in found], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "item_words", "edits", "first_word"],
                )

    return run


def item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The stated items, at most about BLOCK_ITEMS at a time."""
    bound_batches(items.sparkSession)
    items = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, edits, first_word: one row for every document and item that it holds."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for ids, texts in item_blocks(items):
        found = docs.mapInArrow(_matcher(ids, texts), HITS)
        out = found if out is None else out.union(found)
    return out


def _sieve(texts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bounds = normal_words(pa.array(texts, pa.string()))
        items = [words[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        probes = build_probes(items)
        for batch in batches:
            release_memory()
            docs = pc.fill_null(batch.column("text"), "")
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, j in slices(docs):
                for d, *_ in find_hits(*normal_words(docs.slice(i, j - i)), items, probes):
                    keep[i + d] = False
            yield batch.filter(pa.array(keep))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns kept."""
    for _, texts in item_blocks(items):
        docs = docs.mapInArrow(_sieve(texts), docs.schema)
    return docs
