"""Content-addressed store of token ids.

Encoding cuts every document's id stream into chunks with a rolling (gear) hash over 32 ids, so equal passages give
equal chunks wherever they stand. A chunk is named by the BLAKE2b-128 of its bytes and stored once; a document is a
recipe: its chunk names and lengths in order, with a Merkle root over the names. The store is a folder:

``chunks/``   chunk (16 bytes), n (ids), data (ids, little-endian unsigned, 2 bytes each if the vocabulary allows)
``recipes/``  files in ascending doc_id order: doc_id, row, part, local_start, n_tokens, chunks, lens, root

Reading checks every chunk against its name and every recipe against its root. The CRC-32 of a document follows from the
CRC-32 of its chunks as read: CRC is linear, so each chunk's value is shifted by the bytes after it and all are XORed.

Nulls and edge cases: a null text is encoded as the empty text, which still gets the end id; rows with the same doc_id
stay separate documents, side by side; a null doc_id comes first; an empty table gives an empty store; extra columns are
ignored. A text longer than a slice is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop_path, materialize, maybe_broadcast, release_memory, shared_path

GEAR = 32
MIN_CHUNK, MAX_CHUNK, MASK = 64, 2048, 255
#: Text bytes that a Python worker handles at once, and words that it remembers at most (some 40 bytes each).
SLICE_BYTES, CACHE_WORDS = 4 << 20, 1_500_000
CRC_BITS = 44  # shifts of up to 2**44 bytes

STAGED = "row long, doc_id long, n_tokens long, chunks array<binary>, lens array<int>, root binary, chunk binary, n int, data binary"


@dataclass(frozen=True)
class Codec:
    """A tokenizer file of the tokenizers library and the id that ends a document."""

    tokenizer: str = "word_bpe_49k.json"
    end_id: int = 2

    def path(self) -> str:
        if "/" in self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path(self.tokenizer)


_ENCODERS: dict[Codec, Encoder] = {}


class WordCache:
    """Ids of words seen, in flat arrays: a sorted main part and a recent part that is merged into it now and then.

    Words are known by 128 bits of hash. A full cache is emptied; that costs time, not correctness.
    """

    RECENT = 150_000

    def __init__(self, first: np.ndarray):
        self.first = first  # stays at the start of ``flat``
        self.clear()

    def clear(self) -> None:
        none = np.empty(0, np.uint64)
        self.parts = [(none, none, np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(2)]
        self.flat = self.first

    def find(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``flat`` (-1: unknown) and length of each word."""
        start, length = np.full(len(lo), -1, dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
        for keys, high, at, n in self.parts:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, lo), len(keys) - 1)
                ok = (keys[i] == lo) & (high[i] == hi)
                start[ok], length[ok] = at[i[ok]], n[i[ok]]
        return start, length

    def add(self, lo: np.ndarray, hi: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, flat])
        new = tuple(np.concatenate(x) for x in zip(self.parts[1], (lo, hi, at, n)))
        order = np.argsort(new[0], kind="stable")
        self.parts[1] = tuple(x[order] for x in new)
        if len(order) > self.RECENT:
            whole = tuple(np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(whole[0], kind="stable")
            none = np.empty(0, np.uint64)
            self.parts = [tuple(x[order] for x in whole), (none, none, np.empty(0, np.int64), np.empty(0, np.int64))]

    def __len__(self) -> int:
        return len(self.parts[0][0]) + len(self.parts[1][0])


class Encoder:
    """Encodes slices of texts. Where no token can span white space, each distinct word is encoded once and remembered."""

    def __init__(self, codec: Codec):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(codec.path())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = self._words_are_apart(json.loads(self.tokenizer.to_str()))
        self.end = np.array([codec.end_id], dtype=self.dtype)
        self.cache = WordCache(self.end)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")

    @staticmethod
    def _words_are_apart(spec: dict) -> bool:
        """True if the pre-tokenizer keeps only matches of a pattern without white space and drops the rest."""
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        first = steps[0] if steps else {}
        split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        pattern = (first.get("pattern") or {}).get("Regex", " ")
        known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        plain = all(not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
        return bool(split and known and plain)

    def _words(self, table: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the cache holds each word's ids; words not seen yet are encoded."""
        keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in table]), dtype=np.uint64).reshape(-1, 2)
        lo, hi = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        if len(self.cache) + len(table) > CACHE_WORDS:
            self.cache.clear()
        starts, lens = self.cache.find(lo, hi)
        new = np.flatnonzero(starts < 0)
        if len(new):
            order, flat, n = self._encode_words([table[i] for i in new.tolist()])
            self.cache.add(lo[new[order]], hi[new[order]], flat, n)
            starts[new], lens[new] = self.cache.find(lo[new], hi[new])
        return starts, lens

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which the words were encoded, their ids end to end, and the number of ids of each.

        Plain words are encoded a thousand at a time: each has as many closing tokens as pieces.
        """
        pieces = np.fromiter(map(_plain_pieces, words), dtype=np.int64, count=len(words))
        plain = np.flatnonzero(pieces)
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        order, flat, lens, rest = [], [], [], [np.flatnonzero(pieces == 0)]
        for g, ids in self._encode_groups(words, groups):
            ends = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum(pieces[g]) - 1
            if len(ends) == last[-1] + 1:
                order.append(g)
                flat.append(ids)
                lens.append(np.diff(ends[last], prepend=0))
            else:
                rest.append(g)
        left = np.concatenate(rest)
        found = self._ids([words[i] for i in left.tolist()])
        lens.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        return np.concatenate([*order, left]), np.concatenate([self.end[:0], *flat, *found]), np.concatenate(lens)

    def _encode_groups(self, words: list[str], groups: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(groups), 16):  # the library's results are many times the ids' size
            some = groups[at : at + 16]
            coded = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g.tolist()]) for g in some], add_special_tokens=False)
            for g, e in zip(some, coded):
                yield g, np.array(e.ids, dtype=self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice with end ids, and the offsets of its documents (one more than documents)."""
        if self.by_word:
            words = pc.ascii_split_whitespace(texts)
            bounds = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            starts, lens = self._words(coded.dictionary.to_pylist())
            flat = self.cache.flat
            index = coded.indices.to_numpy(zero_copy_only=False)
            bounds = bounds - bounds[0]
        else:
            pieces = self._ids(texts.to_pylist())
            index, bounds = np.arange(len(pieces)), np.arange(len(pieces) + 1)
            lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            flat = np.concatenate([self.end, *pieces])
            starts = np.cumsum(lens) - lens + 1
        # The end id is one more word, at the end of every document.
        starts, lens = np.append(starts, 0), np.append(lens, 1)
        index = np.insert(index.astype(np.int64), bounds[1:], len(lens) - 1)
        each = lens[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat((starts[index] - ends[:-1]).astype(np.int32), each)
        at += np.arange(int(ends[-1]), dtype=np.int32)
        return flat.take(at), ends[bounds + np.arange(len(bounds))]


def _plain_pieces(word: str) -> int:
    """Pieces that the known pre-tokenizer makes of a word of letters with at most one mark behind; 0: can't tell."""
    if "İ" in word:  # its lower case has a mark that is no letter
        return 0
    if word.isalpha():
        return 1
    return 2 if word[-1:] in {".", ",", ";", ":", "!", "?"} and word[:-1].isalpha() else 0


def encoder(codec: Codec) -> Encoder:
    if codec not in _ENCODERS:
        _ENCODERS[codec] = Encoder(codec)
    return _ENCODERS[codec]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def gear_hash(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 32 ids at every position, by doubling the window five times."""
    h = _mix(ids)
    k = 1
    while k < GEAR:
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h, k = g, 2 * k
    return h


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of all chunks and the number of chunks of each document; no chunk crosses a document's end."""
    h = gear_hash(ids)
    marks = (np.flatnonzero((h >> np.uint32(24)) & np.uint32(MASK) == 0) + 1).tolist()
    cuts: list[int] = []
    counts: list[int] = []
    i, n = 0, len(marks)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        before, p = len(cuts), start
        while i < n and marks[i] <= start:
            i += 1
        while i < n and marks[i] < end:
            x = marks[i]
            i += 1
            while x - p > MAX_CHUNK:
                p += MAX_CHUNK
                cuts.append(p)
            if x - p >= MIN_CHUNK:
                p = x
                cuts.append(p)
        while end - p > MAX_CHUNK:
            p += MAX_CHUNK
            cuts.append(p)
        if end > p:
            cuts.append(end)
        counts.append(len(cuts) - before)
    return cuts, counts


def chunk_name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(names: list[bytes]) -> bytes:
    """Root of the binary tree over chunk names; a lone node moves up unchanged."""
    level = names or [b""]
    while len(level) > 1:
        level = [chunk_name(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return chunk_name(b"root" + level[0])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def stage(docs: DataFrame, codec: Codec) -> DataFrame:
    """Recipe rows and chunk rows in one pass; a task leaves out chunks that it has already emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(codec)
        seen: set[bytes] = set()
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            release_memory()
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                ids, offsets = enc.encode(part)
                cuts, counts = cut_points(ids, offsets)
                raw, width = memoryview(ids.tobytes()), enc.dtype.itemsize
                names, lens, fresh, datas, sizes = [], [], [], [], []
                p = 0
                for c in cuts:
                    data = bytes(raw[p * width : c * width])
                    name = chunk_name(data)
                    names.append(name)
                    lens.append(c - p)
                    if name not in seen:
                        seen.add(name)
                        fresh.append(name)
                        datas.append(data)
                        sizes.append(c - p)
                    p = c
                if len(seen) > 2_000_000:  # later repeats are settled when the store is compacted
                    seen.clear()
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                roots = [merkle_root(names[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                d, f = j - i, len(fresh)
                null = lambda n, t: pa.nulls(n, t)
                ids_col = batch.column("doc_id").slice(i, d)
                yield pa.RecordBatch.from_arrays(
                    [
                        null(d, pa.int64()), ids_col, pa.array(np.diff(offsets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.binary())), pa.ListArray.from_arrays(pa.array(ends), pa.array(lens, pa.int32())),
                        pa.array(roots, pa.binary()), null(d, pa.binary()), null(d, pa.int32()), null(d, pa.binary()),
                    ],
                    names=COLUMNS,
                )
                if f:
                    yield pa.RecordBatch.from_arrays(
                        [
                            null(f, pa.int64()), null(f, pa.int64()), null(f, pa.int64()), null(f, pa.list_(pa.binary())), null(f, pa.list_(pa.int32())),
                            null(f, pa.binary()), pa.array(fresh, pa.binary()), pa.array(sizes, pa.int32()), pa.array(datas, pa.binary()),
                        ],
                        names=COLUMNS,
                    )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STAGED)
    return rows.withColumn("row", F.monotonically_increasing_id())


COLUMNS = [c.split()[0] for c in STAGED.split(", ")]


def _local_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        ends = at + np.cumsum(n)
        out = pa.array(ends - n, pa.int64())
        at = int(ends[-1]) if len(n) else at
        yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "local_start"])


def write_store(docs: DataFrame, path: str, codec: Codec = Codec()) -> None:
    """Encode ``docs`` (doc_id, text) and write the store to the folder ``path``."""
    spark = docs.sparkSession
    bound_batches(spark)
    tmp = shared_path(spark, "token-stage")
    staged = materialize(stage(docs, codec), "token-stage", tmp)
    recipes = staged.where("chunk is null").select("row", "doc_id", "n_tokens", "chunks", "lens", "root")
    recipes = recipes.repartitionByRange(F.col("doc_id"), F.col("row")).sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    schema = "row long, doc_id long, n_tokens long, chunks array<binary>, lens array<int>, root binary, part int, local_start long"
    recipes.mapInArrow(_local_starts, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    chunks = staged.where("chunk is not null").select("row", "chunk", "n", "data")
    # The first row of a name owns it; only names that several tasks emitted have rows to drop.
    owner = chunks.groupBy("chunk").agg(F.min("row").alias("owner"), F.count(F.lit(1)).alias("k")).where("k > 1")
    extra = chunks.select("row", "chunk").join(owner, "chunk").where("row <> owner").select("row")
    extra = materialize(extra, "token-extra")
    kept = chunks.join(maybe_broadcast(extra, extra.count(), 16), "row", "left_anti").select("chunk", "n", "data")
    kept.write.option("compression", "zstd").parquet(f"{path}/chunks")
    drop_path(spark, tmp)


def _crc_tables() -> np.ndarray:
    """tables[k, b, v]: CRC register after 2**k zero bytes, for byte b of the register with value v."""
    byte = np.arange(256, dtype=np.uint32)
    t = byte.copy()
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    one = lambda x: (x >> np.uint32(8)) ^ t[x & np.uint32(255)]
    out = np.empty((CRC_BITS, 4, 256), dtype=np.uint32)
    for b in range(4):
        out[0, b] = one(byte << np.uint32(8 * b))
    for k in range(1, CRC_BITS):
        for b in range(4):
            out[k, b] = _apply(out[k - 1], out[k - 1, b])
    return out


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    m = np.uint32(255)
    return table[0, x & m] ^ table[1, (x >> np.uint32(8)) & m] ^ table[2, (x >> np.uint32(16)) & m] ^ table[3, x >> np.uint32(24)]


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The CRC-32 of each value's bytes as they count when ``n_bytes`` more follow."""
    out, left, k = crc.astype(np.uint32), n_bytes.astype(np.int64).copy(), 0
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _apply(tables[k], out[odd])
        left >>= 1
        k += 1
    return out


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for name, n, data in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist()):
            if chunk_name(data) != name:
                raise ValueError(f"chunk {name.hex()} does not hold what its name says")
            ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("n"), pa.array(crcs, pa.int64())], names=["chunk", "n", "crc"])


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        chunks, lens = b.column("chunks"), b.column("lens")
        for names, root in zip(chunks.to_pylist(), b.column("root").to_pylist()):
            if merkle_root(names) != root:
                raise ValueError(f"a recipe does not match its root {root.hex()}")
        counts = pc.list_value_length(chunks).to_numpy()
        n = lens.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        last = np.cumsum(counts)
        doc_end = np.repeat(ends[last - 1], counts)
        row = pa.array(np.repeat(b.column("row").to_numpy(), counts), pa.int64())
        yield pa.RecordBatch.from_arrays([row, chunks.flatten(), pa.array(4 * (doc_end - ends), pa.int64())], names=["row", "chunk", "after"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _crc_tables()
    for b in batches:
        if b.column("crc").null_count:
            raise ValueError("a recipe names a chunk that the store lacks")
        crc = crc_shift(b.column("crc").to_numpy(), b.column("after").to_numpy(), tables)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(crc, pa.int64())], names=["row", "n", "crc"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the store; raises where they disagree."""
    recipes = spark.read.parquet(f"{path}/recipes")
    per_part = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    at, offsets = 0, []
    for r in sorted(per_part.collect()):  # one row for each file
        offsets.append((r["part"], at))
        at += r["n"]
    base = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))
    crcs = spark.read.parquet(f"{path}/chunks").mapInArrow(_read_chunks, "chunk binary, n int, crc long")
    refs = recipes.select("row", "chunks", "lens", "root").mapInArrow(_refs, "row long, chunk binary, after long")
    parts = refs.join(crcs, "chunk", "left").select("row", "after", F.col("n").cast("long").alias("n"), "crc").mapInArrow(_shifted, "row long, n long, crc long")
    found = parts.groupBy("row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"))
    out = recipes.select("row", "doc_id", "part", "local_start", "n_tokens").join(base, "part").join(found, "row")
    wrong = F.raise_error(F.lit("a document's chunks have another length than its recipe"))
    return out.select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"),
        F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(wrong.cast("long")).alias("n_tokens"), "ids_crc32",
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: the id streams rebuilt in full, with the end id."""
    recipes = spark.read.parquet(f"{path}/recipes").select("row", "doc_id", F.posexplode("chunks").alias("pos", "chunk"))
    chunks = spark.read.parquet(f"{path}/chunks")
    both = recipes.join(chunks, "chunk").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "data"))).alias("parts"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [
                np.concatenate([np.frombuffer(p["data"], dtype="<u2" if len(p["data"]) == 2 * p["n"] else "<u4").astype(np.int32) for p in parts])
                for parts in b.column("parts").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return both.mapInArrow(rebuild, "doc_id long, ids array<int>")


def token_output(docs: DataFrame, codec: Codec = Codec(), path: str | None = None) -> DataFrame:
    """Write the store and report on every document from its files."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-store")
    write_store(docs.select("doc_id", "text"), path, codec)
    return read_manifest(spark, path)
