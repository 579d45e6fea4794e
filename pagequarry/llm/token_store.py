"""Token ids as binary shards with a minimal perfect hash index for keyed access.

A shard holds the ids of consecutive documents (by doc_id) as raw little-endian
unsigned 32-bit integers, and an index.  The index is a minimal perfect hash of the
shard's distinct keys: levels of bit arrays, a key's level is the first in which no
other key left falls on its bit, and the number of bits set before is its slot.  A
slot stores a fingerprint of the key, and where its ids begin and how many they are,
so a lookup reads a constant number of places, and a strange key is told from its
fingerprint.  Equal keys (repeated rows) are stored one after the other; the slot
gives the first and how many they are.  Readers take places and sizes from the index.

Files are Parquet files with one shard in a row (columns: part, seq, first_key,
last_key, n_docs, n_ids, start_in_part, shard), so any store that Spark writes to
holds them.  Texts are dealt out by ranges of doc_id and of their place in the input,
so rows of one doc_id are split as well; each task writes its shards in order and
forgets them: memory is one shard, whatever the input.

Defined results: a null or empty text has the end id alone; a very long text is one
document of its shard, which then is as large.  Rows with a null doc_id come first, are
in scans and can't be looked up.  Equal doc_ids are in the order in which they are
read.  Extra columns are ignored, whatever their names.  An empty table makes no shards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _spec, shared_vocabulary
from .common import documents, fresh_path, text_slices, trim
from .wordbpe import coder

MAGIC = b"PQTOKEN1"
END_ID = 1
#: Ids in a shard before it is closed: 2 million, 8 MB.
SHARD_IDS = 2_000_000
SCHEMA = "part long, seq long, first_key long, last_key long, n_docs long, n_ids long, start_in_part long, shard binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; -1 marks keys that are surely strange."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        counts = [int(b.sum()) for b in levels]
        self.base = np.cumsum([0, *counts])
        self.ranks = [np.cumsum(b) - b for b in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys.astype(np.uint64))
        while len(left):
            width = max(64, 2 * len(left))
            at = (_mixed(left, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        for k, bits in enumerate(self.levels):
            at = (_mixed(keys, k) % np.uint64(len(bits))).astype(np.int64)
            now = (out < 0) & bits[at]
            out[now] = self.base[k] + self.ranks[k][at[now]]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 977) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of documents in order: keys, which of them aren't null, numbers of ids, and all ids."""
    starts = np.cumsum(counts, dtype=np.uint64) - counts.astype(np.uint64)
    distinct, first, copies = np.unique(keys[known], return_index=True, return_counts=True)
    first = np.flatnonzero(known)[first]
    as_hashed = distinct.astype(np.int64).view(np.uint64)
    table = PerfectHash.of(as_hashed)
    slot = table.slots(as_hashed)
    prints, begins, rows, times = (np.zeros(len(distinct), kind) for kind in ("<u4", "<u8", "<u4", "<u4"))
    prints[slot], begins[slot], rows[slot], times[slot] = fingerprints(as_hashed), starts[first], first, copies
    levels = [np.packbits(b, bitorder="little").tobytes() for b in table.levels]
    head = struct.pack("<8sIIQI", MAGIC, len(keys), len(distinct), len(ids), len(levels))
    widths = struct.pack(f"<{len(levels)}I", *[len(b) for b in table.levels])
    columns = [prints, begins, rows, times, known.astype("u1"), keys.astype("<i8"), counts.astype("<u4"), ids.astype("<u4", copy=False)]
    return b"".join([head, widths, *levels, *[c.tobytes() for c in columns]])


class Shard:
    """Reader of a shard."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_keys, self.n_ids, n_levels = struct.unpack_from("<8sIIQI", data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<8sIIQI")
        widths = struct.unpack_from(f"<{n_levels}I", data, at)
        at += 4 * n_levels
        levels = []
        for w in widths:
            size = -(-w // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[:w].astype(bool))
            at += size
        self.hash = PerfectHash(levels)

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.prints, self.begins = column("<u4", self.n_keys), column("<u8", self.n_keys)
        self.rows, self.copies = column("<u4", self.n_keys), column("<u4", self.n_keys)
        self.known, self.keys, self.counts = column("u1", self.n_docs), column("<i8", self.n_docs), column("<u4", self.n_docs)
        self.ids = column("<u4", self.n_ids)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key: where its ids begin in the shard (-1: not here), its first row, and how many rows it has."""
        if not self.n_keys or not len(keys):
            return np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        hashed = np.ascontiguousarray(keys, dtype=np.int64).view(np.uint64)
        slot = self.hash.slots(hashed)
        good = (slot >= 0) & (self.prints[slot] == fingerprints(hashed))
        return np.where(good, self.begins[slot].astype(np.int64), -1), np.where(good, self.rows[slot].astype(np.int64), 0), np.where(good, self.copies[slot].astype(np.int64), 0)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of this key, in order; none if it isn't here."""
        (begin,), (row,), (copies,) = self.places(np.array([key]))
        if begin < 0:
            return []
        cut = begin + np.cumsum(self.counts[row : row + copies], dtype=np.int64)
        return np.split(self.ids[begin : cut[-1]], cut[:-1] - begin)

    def documents(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of all documents: key, where its ids begin, and how many they are; each known key's place is the index's."""
        known = self.known == 1
        keys = np.unique(self.keys[known])
        begin, row, copies = self.places(keys)
        if (begin < 0).any():
            raise ValueError("a shard's index doesn't hold its keys")
        order = np.argsort(begin, kind="stable")
        keys, begin, row, copies = keys[order], begin[order], row[order], copies[order]
        nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        size = self.counts[np.repeat(row, copies) + nth].astype(np.int64)
        before = np.cumsum(size) - size
        first = np.repeat(before[np.cumsum(copies) - copies] if len(copies) else before, copies)
        at = np.repeat(begin, copies) + before - first
        # Rows without a key are in no index: they stand before all others.
        lost = self.counts[~known].astype(np.int64)
        at, size = np.concatenate([np.cumsum(lost) - lost, at]), np.concatenate([lost, size])
        column = pa.array(np.concatenate([np.zeros(len(lost), dtype=np.int64), np.repeat(keys, copies)]), pa.int64(), mask=np.arange(len(size)) < len(lost))
        return column, at, size


def _packer(shared, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code = coder(_spec(shared.value), by_library=True)
        held: list[tuple[np.ndarray, ...]] = []  # keys, known, counts, ids
        n_ids = seq = done = 0

        def closed() -> pa.RecordBatch:
            keys, known, counts, ids = map(np.concatenate, zip(*held, strict=True))
            own = keys[known]
            row = [part, seq, int(own[0]) if len(own) else None, int(own[-1]) if len(own) else None, len(keys), len(ids), done, pack_shard(keys, known, counts, ids)]
            kinds = [*[pa.int64()] * 7, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1), 4 << 20):  # larger slices share more words
                found = code.encode_column(texts)
                key = batch.column(0).slice(at, len(texts))
                at += len(texts)
                ends = found.offsets.to_numpy()[1:]
                ids = np.insert(found.values.to_numpy().view(np.uint32), ends, end_id)
                cut = ends.astype(np.int64) + np.arange(1, len(ends) + 1)  # ends with the end ids
                counts = np.diff(cut, prepend=0)
                keys, known = key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False)
                a = 0
                while a < len(keys):
                    base = cut[a - 1] if a else 0
                    b = min(len(keys), int(np.searchsorted(cut, base + shard_ids - n_ids)) + 1)
                    held.append((keys[a:b], known[a:b], counts[a:b], ids[base : cut[b - 1]]))
                    n_ids += int(cut[b - 1] - base)
                    if n_ids >= shard_ids:
                        yield closed()
                        seq, done = seq + 1, done + n_ids
                        held, n_ids = [], 0
                    a = b
        if held:
            yield closed()
        trim()

    return run


def write_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode the texts and write their ids as shards in ascending doc_id order."""
    shared = shared_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    dealt.mapInArrow(_packer(shared, end_id, shard_ids), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with the number of ids before each (`start`): totals of parts, one number for each write task, are added up on the driver."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for r in totals:
        bases.append((r.part, base))
        base += r.n
    known = spark.createDataFrame(bases, "part long, part_start long")
    return shards.join(F.broadcast(known), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (binary) of every document, each found through its shard's index; repeated keys are read in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                keys, begin, size = shard.documents()
                ids = [shard.ids[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(begin + start), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
        trim()

    return read_shards(spark, path).select("start", "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys: doc_id.  -> doc_id, ids (binary) of the documents stored under these keys, one row each.

    Keys meet the shard whose range holds them; the shards' ranges, 16 bytes for each
    8 MB of ids, are joined, and the index gives the place at once.
    """
    spans = spark.read.schema(SCHEMA).parquet(path).filter("first_key is not null")
    wanted = keys.select("doc_id").filter("doc_id is not null").distinct()
    routed = wanted.join(spans.select("part", "seq", "first_key", "last_key"), (F.col("doc_id") >= F.col("first_key")) & (F.col("doc_id") <= F.col("last_key")))
    asked = routed.groupBy("part", "seq").agg(F.collect_list("doc_id").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [], []
            for asked, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                for key in asked:
                    for x in shard.get(key):
                        found.append(key)
                        ids.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return spans.join(asked, ["part", "seq"]).select("asked", "shard").mapInArrow(run, "doc_id long, ids binary")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every whole text of documents, from the files written."""
    path = fresh_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    rows = read_tokens(spark, path)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
