"""Exact Jaccard self-join of word-shingle sets by signatures over size bands and partitions of the feature domain.

Sets fall into size bands such that similar sets lie in the same band or in neighbouring ones; a tag stands for two
neighbouring bands. Within a tag the feature domain is cut into partitions by a hash, and a set's projection on a
partition is one signature, as in PartEnum. Two sets with Jaccard similarity of 0.75 or more differ in at most
k = (n1 + n2) / 7 elements, so at most k signatures of one are missing from the other: of the k + 1 first signatures in
any order that all sets share, at least one is common. Those are kept, signatures of more elements first; signatures made
only of very frequent shingles come last. PartEnum's second step, subsets of second-level partitions, is left out: at this
similarity a subset holds two to five elements, so it is empty for some of the sets in every partition, and all of those
would share a signature (see the README for figures). Which shingles count as frequent is a hint found from the counts
of each task; it changes the work, never the result.

Of equal sets one represents all. In the groups of sets that share a signature, small groups compare all pairs and large
ones compare every set with one pivot; verified links give components; then large groups that still hold several
components compare the pairs across them. Every candidate is verified on whole sets, so no link is lost.

A signature that a good part of all sets share is found in a sample; its group is split, each part has a pivot, and the
pivots meet through the smallest. A shingle is 64 bits of hash; equal sets are known by 128 bits over their shingles and
number. Before whole sets meet, a
sketch of one bit for each element bounds their intersection from above, which drops most false candidates exactly.

Nulls and edge cases: a null text or one without words has an empty set and links with nothing; a text of fewer than
five words is one shingle; rows with the same id are separate members of their classes; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, maybe_broadcast, release_memory
from .components import components
from .tokenstore import slices

SHINGLE = 5
#: Largest group that compares all of its pairs at once; larger ones go by pivot first.
SMALL_GROUP = 8
#: Frequency hint: shingles seen so often in one task, at most so many from a task and in all.
HINT_LOCAL, HINT_TASK, HINT_ALL = 4, 8192, 1 << 17
#: Sets whose signatures are counted to find those that many sets share, and the share that makes one hot.
HOT_SAMPLE, HOT_SHARE = 4_000, 0.004
#: Text bytes handled at once: signatures take some hundred bytes for each word.
NGRAM_SLICE = 2 << 20
#: Elements and sets of a block, and distinct elements that a matrix product takes at once.
BLOCK_ELEMENTS, BLOCK_MEMBERS, BLOCK_COLUMNS = 100_000, 1024, 1024
#: Tags up to this size use one partition for each shingle; up to the next, two partitions for each.
TINY, SLIM = 64, 256

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lowered) and the offsets of the texts in them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    coded = lists.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.empty(0, np.uint64)
    real = h != 0
    if not real.all():  # empty strings before the first and after the last word
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        h = h[real]
    return h, bounds.astype(np.int64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, sorted, and their offsets."""
    w, bounds = word_hashes(texts)
    n_words = np.diff(bounds)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(offs[-1]), dtype=np.uint64)
    full = np.zeros(max(0, len(w) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        if len(full):
            full += mix(w[k : k + len(full)] ^ _POLY[k]) * _POLY[k]
    full = mix(full)
    long = n_words >= SHINGLE
    at = np.repeat(bounds[:-1][long] - offs[:-1][long], counts[long])
    slots = np.ones(len(out), dtype=bool)
    short = np.flatnonzero((n_words > 0) & ~long)
    slots[offs[short]] = False
    where = np.flatnonzero(slots)
    out[where] = full[where + at]
    for d in short.tolist():
        out[offs[d]] = xxhash.xxh3_64_intdigest(w[bounds[d] : bounds[d + 1]].tobytes(), seed=1)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    first = np.ones(len(out), dtype=bool)
    first[1:] = out[1:] != out[:-1]
    first[offs[:-1][counts > 0]] = True
    new = np.concatenate([[0], np.cumsum(first)])[offs]
    return out[first], new


def set_digests(sets: np.ndarray, offs: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits over each set and its size; 0 for the empty set. Two seeds make the 128 bits that equal sets share."""
    n = np.diff(offs)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _POLY[2 * seed]), dtype=np.uint64)])
    d = mix((sums[offs[1:]] - sums[offs[:-1]]) + n.astype(np.uint64) * _POLY[2 * seed + 1])
    return np.where(n > 0, np.where(d == 0, np.uint64(1), d), np.uint64(0))


def _bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 4 // 3 + 1)
    return np.array(edges, dtype=np.int64)


#: Band i holds the sizes from BANDS[i] to BANDS[i + 1] - 1; a set's partners lie in its own band or a neighbour.
BANDS = _bands()


def signatures(sets: np.ndarray, offs: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the index of the set of each."""
    n = np.diff(offs)
    band = np.searchsorted(BANDS, n, side="right") - 1
    common = np.zeros(len(sets), dtype=bool)
    if frequent is not None and len(frequent) and len(sets):
        bits = np.zeros(1 << 22, dtype=bool)
        low = np.uint64((1 << 22) - 1)
        bits[(frequent & low).astype(np.int64)] = True
        may = np.flatnonzero(bits[(sets & low).astype(np.int64)])
        at = np.searchsorted(frequent, sets[may])
        common[may] = frequent[np.minimum(at, len(frequent) - 1)] == sets[may]
    out, of = [], []
    docs = np.flatnonzero(n > 0)
    for up in (0, 1):
        tag = band[docs] + up
        top = BANDS[tag + 1] - 1
        most = np.minimum(4 * n[docs] // 3, top)
        use = docs if not up else docs[most >= BANDS[tag]]
        if len(use) < len(docs):
            keep = most >= BANDS[tag]
            tag, top, most = tag[keep], top[keep], most[keep]
        k = (n[use] + most) // 7
        width = np.where(top < TINY, 0, np.where(top < SLIM, 2 * top, top))
        seed = mix((tag.astype(np.uint64) + np.uint64(1)) * _POLY[2])
        sizes = n[use]
        src = np.repeat(offs[:-1][use] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        el, hot = sets[src], common[src]
        who = np.repeat(np.arange(len(use)), sizes)
        mixed = mix(el ^ seed[who])
        room = np.where(width > 0, width, sizes)
        base = np.cumsum(room) - room
        inner = np.arange(len(el)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        w = np.maximum(width, 1).astype(np.uint64)
        part = np.where(width[who] > 0, (mixed % w[who]).astype(np.int64), inner)
        slot = base[who] + part
        total = int(room.sum())
        sig = np.zeros(total, dtype=np.uint64)
        np.add.at(sig, slot, mix(mixed ^ _POLY[3]))
        cnt = np.bincount(slot, minlength=total)
        cold = np.bincount(slot[~hot], minlength=total)
        full = np.flatnonzero(cnt)
        owner = np.searchsorted(base, full, side="right") - 1
        sig = mix(sig[full] ^ seed[owner])
        rank = ((cold[full] == 0).astype(np.uint64) << np.uint64(63)) | ((np.uint64(255) - np.minimum(cnt[full], 255).astype(np.uint64)) << np.uint64(55)) | (sig >> np.uint64(9))
        ends = np.searchsorted(owner, np.arange(len(use) + 1))
        picks = []
        for a, b, kk in zip(ends[:-1].tolist(), ends[1:].tolist(), k.tolist()):
            picks.append(a + np.argpartition(rank[a:b], kk)[: kk + 1] if b - a > kk + 1 else np.arange(a, b))
        pick = np.concatenate(picks) if picks else np.empty(0, np.int64)
        out.append(sig[pick])
        of.append(use[owner[pick]])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    release_memory()
    return pc.fill_null(batch.column("text"), "")


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document, and at the task's end rows (null id, negative n) with its frequent shingles."""
    held: list[np.ndarray] = []
    texts = sets = offs = None
    for batch in batches:
        texts = _texts(batch)
        for i, j in slices(texts, NGRAM_SLICE):
            sets, offs = shingle_sets(texts.slice(i, j - i))
            held.append(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), _i64(np.diff(offs)), _i64(set_digests(sets, offs)), _i64(set_digests(sets, offs, 1))], names=["id", "n", "d", "e"])
            if sum(map(len, held)) > 2_000_000:
                top = _frequent(held)
                yield _hint(top)
                held = []
    top, held, texts, sets, offs = _frequent(held), [], None, None, None
    yield _hint(top)
    del top
    release_memory()


def _frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate(held) if held else np.empty(0, np.uint64)
    values.sort()
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(values)))
    often = counts >= HINT_LOCAL
    v, c = values[starts[often]], counts[often]
    best = np.argsort(-c, kind="stable")[:HINT_TASK]
    return v[best], c[best]


def _hint(top: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    v, c = top
    return pa.RecordBatch.from_arrays([pa.nulls(len(v), pa.int64()), _i64(-c - 1), _i64(v), pa.nulls(len(v), pa.int64())], names=["id", "n", "d", "e"])


def _signed(frequent: np.ndarray, hot: np.ndarray, salts: int):
    """sig, salt, id; the rows of a hot signature are dealt over salts from 1, all others have salt 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = _texts(batch), batch.column("id").to_numpy()
            for i, j in slices(texts, NGRAM_SLICE):
                sig, of = signatures(*shingle_sets(texts.slice(i, j - i)), frequent)
                sig, own = (sig >> np.uint64(16)).astype(np.int64), ids[i:j][of].astype(np.int64)
                salt = np.zeros(len(sig), dtype=np.int32)
                if len(hot) and len(sig):
                    split = hot[np.minimum(np.searchsorted(hot, sig), len(hot) - 1)] == sig
                    salt[split] = 1 + (mix(own[split].astype(np.uint64)) % np.uint64(salts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_i64(sig), pa.array(salt), _i64(own)], names=["sig", "salt", "id"])
        batch = texts = ids = sig = of = own = salt = split = None
        release_memory()

    return run


def hot_signatures(reps: DataFrame, rows: int, frequent: np.ndarray) -> np.ndarray:
    """Signatures that at least HOT_SHARE of a sample of the sets share, sorted: their groups are split, whatever their true size.

    The sample only decides where work is split, never which sets meet; it holds about HOT_SAMPLE sets at any size of the
    input, so the list is bounded.
    """
    every = max(1, rows // HOT_SAMPLE)
    some = reps.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    found = some.mapInArrow(_signed(frequent, np.empty(0, np.int64), 1), SIGNED).groupBy("sig").agg(F.count(F.lit(1)).alias("k"))
    got = found.where(F.col("k") >= max(SMALL_GROUP + 1, int(HOT_SAMPLE * HOT_SHARE))).select("sig").toArrow()
    return np.sort(got.column("sig").to_numpy().astype(np.int64))


SIGNED = "sig long, salt int, id long"


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch)
        for i, j in slices(texts, NGRAM_SLICE):
            sets, offs = shingle_sets(texts.slice(i, j - i))
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), _i64(sets))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), lists], names=["id", "s"])
    batch = texts = sets = offs = lists = None
    release_memory()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= 75 * union."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= 75 * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


#: Sketch of a set: bit i is set if an element hashes to i; widths are powers of two of about 4 bits an element.
SKETCH_BITS = 4


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch)
        for i, j in slices(texts, NGRAM_SLICE):
            sets, offs = shingle_sets(texts.slice(i, j - i))
            out = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                width = 1 << max(6, int(SKETCH_BITS * (b - a) - 1).bit_length())
                bits = np.zeros(width, dtype=bool)
                bits[(sets[a:b] & np.uint64(width - 1)).astype(np.int64)] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), _i64(np.diff(offs)), pa.array(out, pa.binary())], names=["id", "n", "k"])
    batch = texts = sets = offs = out = None
    release_memory()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs that can't reach the similarity: each bit of only one sketch is an element that the other set lacks."""
    for t in batches:
        keep = np.zeros(t.num_rows, dtype=bool)
        rows = zip(t.column("na").to_pylist(), t.column("nb").to_pylist(), t.column("ka").to_pylist(), t.column("kb").to_pylist())
        for r, (na, nb, ka, kb) in enumerate(rows):
            x, y = np.frombuffer(ka, np.uint8), np.frombuffer(kb, np.uint8)
            while len(x) > len(y):
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] | y[len(y) // 2 :]
            most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
            keep[r] = 100 * most >= 75 * (na + nb - most)
        yield t.select(["a", "b"]).filter(pa.array(keep))


def _texts_of(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    return docs.join(maybe_broadcast(ids, rows, 16), "id", "left_semi")


def with_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``id``: the doc_id where that is unique and never null, else a stored row number."""
    docs = docs.drop("id")
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("id", F.col("doc_id").cast("long"))
    return materialize(docs.withColumn("id", F.monotonically_increasing_id()), "ngram-rows")


def link_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (id, text): (rows: id, n, rep) and (links: a, b between representatives of different sets).

    ``rep`` is the smallest id of the equal sets; the links are enough for the components.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("id", "text")
    profile = materialize(docs.mapInArrow(_profile, "id long, n long, d long, e long"), "ngram-profile")
    hints = profile.where("n < 0").groupBy("d").agg(F.sum(-F.col("n") - 1).alias("c")).orderBy(F.desc("c"), "d").limit(HINT_ALL)
    frequent = np.sort(np.array([r[0] for r in hints.select("d").collect()], dtype=np.int64).view(np.uint64))  # at most HINT_ALL
    rows = profile.where("n >= 0")
    copies = materialize(rows.where("n > 0").groupBy("d", "e").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1"), "ngram-copies")
    named = rows.join(maybe_broadcast(copies.select("d", "e", "rep"), copies.count(), 32), ["d", "e"], "left")
    rows = materialize(named.select("id", "n", F.coalesce("rep", "id").alias("rep")), "ngram-classes")
    extra = rows.where("id <> rep").select("id")
    n_rows, n_extra = rows.count(), extra.count()
    reps = docs.join(maybe_broadcast(extra, n_extra, 16), "id", "left_anti")
    hot = hot_signatures(reps, n_rows - n_extra, frequent)
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = Window.partitionBy("sig", "salt")
    signed = reps.mapInArrow(_signed(frequent, hot, salts), SIGNED)
    shared = signed.select("sig", "salt", "id", F.min("id").over(by).alias("lo"), F.count(F.lit(1)).over(by).alias("k")).where("k > 1 or salt > 0")
    shared = materialize(shared, "ngram-shared")
    small, large = shared.where((F.col("k") <= SMALL_GROUP) & (F.col("salt") == 0)), shared.where((F.col("k") > SMALL_GROUP) | (F.col("salt") > 0))
    pairs = small.alias("x").join(small.alias("y"), "sig").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    star = large.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    # The pivots of a split group meet through the smallest of them: one row for each part of it.
    heads = large.where("salt > 0").select("sig", "lo").distinct()
    tops = heads.groupBy("sig").agg(F.min("lo").alias("a"))
    heads = heads.join(maybe_broadcast(tops, len(hot), 24), "sig").where("a <> lo").select("a", F.col("lo").alias("b"))
    star = star.union(heads)
    pairs = materialize(pairs.union(star).distinct(), "ngram-pairs")
    open_ids = large.select("id").distinct()
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(open_ids).distinct(), "ngram-wanted")
    texts = _texts_of(docs, wanted, wanted.count())
    sketches = materialize(texts.mapInArrow(_sketches, "id long, n long, k binary"), "ngram-sketches")
    names = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"))
    sized = sketches.select("id", "n")
    fits = pairs.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b")
    likely = fits.join(names("b"), "b").join(names("a"), "a").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_possible, "a long, b long")
    likely = materialize(likely, "ngram-likely")
    wanted = materialize(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "ngram-likely-ids")
    sets = materialize(_texts_of(docs, wanted, wanted.count()).mapInArrow(_whole_sets, "id long, s array<long>"), "ngram-sets")
    links = materialize(_verified(likely, sets), "ngram-links")
    comp = components(links, "ngram-comp1")
    # Large groups that still hold several components: the pairs across them.
    open_ = large.select("sig", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = open_.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("id").alias("lo")).where("c0 <> c1").select("sig", "lo")
    mixed = materialize(mixed, "ngram-mixed")
    open_ = materialize(open_.join(maybe_broadcast(mixed, mixed.count(), 24), "sig").join(sized, "id"), "ngram-open")
    return rows, materialize(links.union(_across(open_, docs)), "ngram-all-links")


def _across(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that share a signature (sig, id, n, comp, lo).

    Sets tied by shared signatures form a family. A family's sets are dealt into blocks of bounded size, each pair of
    blocks is one group, and intersections are counted there by matrix products: no pair is emitted but the links.
    """
    family = components(open_.select(F.col("lo").alias("a"), F.col("id").alias("b")).where("a <> b").distinct(), "ngram-family")
    members = open_.select("id", "n", "comp").distinct().join(family.select("id", F.col("comp").alias("f")), "id")
    members = materialize(members, "ngram-members")
    sizes = members.groupBy("f").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_ELEMENTS), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    dealt = members.join(sizes.select("f", "blocks"), "f").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = _texts_of(docs, members.select("id"), members.count()).mapInArrow(_whole_sets, "id long, s array<long>")
    dealt = dealt.select("id", "comp", "f", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(sets, "id")
    return dealt.groupBy("f", "i", "j").applyInArrow(_block_links, "a long, b long")


def _block_links(table: pa.Table) -> pa.Table:
    release_memory()
    d, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
    lists = table.column("s").combine_chunks()
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    values, el = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    who = np.repeat(np.arange(len(d)), n)
    names, label, often = np.unique(comp, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(label != np.argmax(often))  # any pair across components has a member outside the largest
    inter = np.zeros((len(rest), len(d)), dtype=np.float32)
    held = np.bincount(el, minlength=len(values)) > 1
    order = np.argsort(el, kind="stable")
    order = order[held[el[order]]]
    el, who = el[order], who[order]
    new = np.cumsum(np.concatenate([[0], el[1:] != el[:-1]])) if len(el) else el
    for lo in range(0, int(new[-1]) + 1 if len(new) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(new, [lo, lo + BLOCK_COLUMNS])
        m = np.zeros((len(d), BLOCK_COLUMNS), dtype=np.float32)
        m[who[a:b], new[a:b] - lo] = 1
        inter += m[rest] @ m.T
    found, out = [], []
    for lo in range(0, len(rest), 256):
        some = rest[lo : lo + 256]
        both = inter[lo : lo + 256].astype(np.int64)
        x, y = np.nonzero((100 * both >= 75 * (n[some][:, None] + n[None, :] - both)) & (label[some][:, None] != label[None, :]))
        found.append((some[x], y))
    x, y = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    while len(x):  # one link joins two components; pairs inside a joined one add nothing
        a, b = x[0], y[0]
        out.append((a, b))
        label[label == label[b]] = label[a]
        left = label[x] != label[y]
        x, y = x[left], y[left]
    u, v = d[[a for a, _ in out]], d[[b for _, b in out]]
    return pa.table({"a": pa.array(np.minimum(u, v), pa.int64()), "b": pa.array(np.maximum(u, v), pa.int64())})


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    own = with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _joined(own).select("doc_id", "n_shingles", "component_id")


def _joined(docs: DataFrame) -> DataFrame:
    """id, doc_id, n_shingles, component_id, first (whether the row stands for its component)."""
    rows, links = link_sets(docs)
    rows = rows.join(docs.select("id", "doc_id"), "id")
    comp = components(links, "ngram-comp2").select(F.col("id").alias("rep"), "comp")
    comp = materialize(comp, "ngram-of-rep")
    rows = materialize(rows.join(maybe_broadcast(comp, comp.count(), 24), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "ngram-grouped")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("m")
    first = materialize(rows.groupBy("comp").agg(least).select("comp", F.col("m.doc_id").alias("component_id"), F.col("m.id").alias("first_id")), "ngram-first")
    out = rows.join(first, "comp")
    return out.select("id", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("first_id")).alias("first"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id (nulls last). Documents without words all stay; all columns are kept, whatever their names."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    own = with_ids(rows)
    kept = materialize(_joined(own.select("id", "doc_id", "text")).where("first").select("id"), "ngram-kept")
    return own.join(maybe_broadcast(kept, kept.count(), 16), "id", "left_semi").select("row.*")
