"""Similarity join on word shingles: all links of Jaccard similarity 0.75 or more, as components.

Method.  Each text is a set of distinct 5-word shingles (64-bit hashes, sorted).
Equal sets are one node.  Shingles have one order for all sets: rare ones first by
hash, very common ones last by count.  Two sets that link share a shingle within
the first quarter of each (prefix filter), so nodes meet in the tile of a shared
prefix shingle.  Within a tile, nodes are sorted by size, and only sizes within a
factor of 4/3 are compared (size bands).  A pair must meet in as many tiles as the
prefixes of linked sets do.  Pairs then pass the bitmap signatures: bit
h mod B is the parity of the set's hashes there; the bits in which two bitmaps differ
can't outnumber the elements in which the sets differ, which bounds the overlap from
above.  B grows with the size band; a wider bitmap folds onto a narrower one.  What
passes is decided by exact intersection of the sorted arrays.

Hot tiles.  Lines and passages that very many documents share come last in the order
and so leave the prefixes of other texts.  What remains are groups of near copies.
A tile of more than TILE nodes compares its nodes with a few of its own size band
only; links found so far are joined to components.  Of the tiles that still hold
several components, a second round compares each node with its likest partners of
other components, by the bitmaps, and a third all pairs of different components that
the bitmaps allow.  Both work on blocks of BLOCK nodes: a tile is cut by size band, a
band by hash, and each block meets each other one of its band and the next in a task
of its own.  The tile of a shingle that more than SPLIT entries hold is dealt over
several tasks from the start.  Pairs within a component needn't be compared, so no
component is lost and no group costs its square.

Rows carry node keys, never texts; candidate pairs move with signatures of some
hundred bytes.  Sets take about twice the room of their texts, so they aren't kept: they
are made again from the texts where they are counted and where tiles are filled, and
those of nodes in candidate pairs and hot tiles alone are written and shuffled.  Texts
are read four times; a table that may differ between readings must be written before.
Tables that no later step reads are deleted.

Defined results: a null or empty text, or one without words, has no shingles and is
its own component.  A very long text is one set, read whole.  An empty table gives none.  Rows with a null doc_id get no component of others: they are kept
and count as component null unless they equal a document with an id.  Repeated rows
fall in one component.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import deleted, documents, small_batches, trim, written
from .components import components
from .decontam import SHINGLES_SQL
from .shingles import shingle_sets

PERCENT = 75
#: Nodes in a tile that are compared with each other at once.
TILE = 64
#: A pair chosen in a hot tile counts as met so often: it passes to the bitmaps.
CERTAIN = 1 << 20
#: Partners of other components that a node of a hot tile is compared with before all of them are.
LIKEST = 6
#: A shingle counted this often comes last in the order; at most MOST_HOT of them do (8 MB broadcast).
HOT_COUNT, MOST_HOT = 20, 500_000
#: Shingles counted together in a task (64 MB), and how often one must occur there to be told.
COUNT_CHUNK, COUNT_LEAST = 8_000_000, 3
#: Prefix entries in a bucket of tiles.
BUCKET_ENTRIES = 400_000
#: Pairs of a bucket that are held at once, and rows told together.
PASS_PAIRS, TOLD_ROWS = 1_500_000, 50_000
#: Entries of one shingle beyond which its tile is dealt over several buckets.
SPLIT = 200_000
#: Nodes of a hot tile that are compared in one task with as many others.
BLOCK = 2_048
#: Needed nodes up to this number are broadcast (8 bytes each), more are joined by shuffle.
BROADCAST_NODES = 500_000

#: Cells of the filter of needed nodes: so many a node, and at most so many in all (16 MB broadcast), in parts of at most PART_CELLS.
CELLS_EACH, MOST_CELLS, PART_CELLS = 64, 1 << 27, 1 << 20

_NODE_SCHEMA = "doc_id long, node long, n_shingles long, bits binary"


def _need(a, b):
    """Least overlap of linked sets of sizes a and b: 100 * o >= PERCENT * (a + b - o)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the hashes in as many cells as the size band has: the power of two from the size up, 64 at least."""
    width = 64
    while width < len(hashes):
        width *= 2
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """The overlap that two sets can't exceed, by the bits in which their bitmaps differ."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    width = min(len(x), len(y))
    return (na + nb - int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())) // 2


def _nodes_of(texts: pa.Array, seen: set[int]) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """For each text its node, its set, and whether the node is the first of its kind in a task, by the nodes seen there."""
    for found in shingle_sets(texts):
        if not len(found):
            yield None, found, False
            continue
        import xxhash

        node = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)
        first = node not in seen
        if first:
            seen.add(node)
            if len(seen) > 2_000_000:
                seen.clear()
        yield node, found, first


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their node; the first of a node in a task carries its bitmap."""
    seen: set[int] = set()
    for batch in batches:
        nodes, sizes, bits = [], [], []
        for node, found, first in _nodes_of(batch.column(1), seen):
            nodes.append(node)
            sizes.append(len(found))
            bits.append(parity_bitmap(found) if first else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())],
            ["doc_id", "node", "n_shingles", "bits"],
        )
        trim()


def _cells(needed: DataFrame) -> np.ndarray:
    """A bitmap in which the cell of each needed node is marked: its low bits."""
    count, width = needed.count(), 1 << 12
    while width < min(CELLS_EACH * count, MOST_CELLS):
        width *= 2
    size = min(width, PART_CELLS)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            part = cells // size
            for k in np.unique(part).tolist():
                inside = cells[part == k] % size
                np.bitwise_or.at(held.setdefault(k, np.zeros(size // 8, dtype=np.uint8)), inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for k, bitmap in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bitmap.tobytes()], pa.binary())], ["part", "bitmap"])

    cell = F.col("node").bitwiseAND(F.lit(width - 1).cast("long")).alias("cell")
    parts = needed.select(cell).repartition(F.floor(F.col("cell") / size)).mapInArrow(marked, "part long, bitmap binary")
    out = np.zeros(width // 8, dtype=np.uint8)
    for k, bitmap in parts.collect():  # a row for each part: MOST_CELLS / 8 bytes at most
        out[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(bitmap, dtype=np.uint8)
    return out


def _sets_of(cells):
    """Maker of the sets of nodes whose cell is marked, the first of each node in a task; some others pass as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = cells.value, set()
        low = 8 * len(marks) - 1
        for batch in batches:
            nodes, sets = [], []
            for node, found, first in _nodes_of(batch.column(0), seen):
                if first and marks[(node & low) >> 3] >> (node & 7) & 1:
                    nodes.append(node)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])
            trim()

    return run


#: Where the hashes are cut to be counted by parts, for the memory of sorting.
_CUTS = np.arange(1, 8, dtype=np.uint64) << np.uint64(61)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that occur COUNT_LEAST times or more among some millions, with their counts."""
    held: list[list[np.ndarray]] = [[] for _ in range(8)]
    seen: set[int] = set()
    n = 0

    def told() -> Iterator[pa.RecordBatch]:
        for part in held:
            values, counts = np.unique(np.concatenate(part), return_counts=True)
            part.clear()
            keep = counts >= COUNT_LEAST
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["shingle", "n"])

    for batch in batches:
        sets = [found for _, found, first in _nodes_of(batch.column(0), seen) if first]
        if not sets:
            continue
        cuts = [[0, *np.searchsorted(x, _CUTS).tolist(), len(x)] for x in sets]
        for k, part in enumerate(held):
            part.append(np.concatenate([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)]))
        n += sum(map(len, sets))
        if n >= COUNT_CHUNK:
            yield from told()
            n = 0
    if n:
        yield from told()
    trim()


def _planes(values: np.ndarray) -> bytes:
    """An array by planes of bytes, so that compression finds the empty ones."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(blob: bytes, kind: str, count: int, offset: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, count * size, offset).reshape(size, count).T).view(kind).ravel()


def _prefixes(hot, buckets: int, percent: int, split: int):
    """Maker of the tile entries: for each bucket of hashes a blob of (32 bits of the shingle, node, size) columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = hot.value  # in ascending order of count
        by_hash = np.argsort(common, kind="stable")
        ordered = common[by_hash]
        parts_of = np.maximum(-(-counts // split), 1)[by_hash]
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for node, found, first in _nodes_of(batch.column(0), seen):
                if not first:
                    continue
                size = len(found)
                take = size - (-(-percent * size // 100)) + 1
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
                    is_hot = ordered[at] == found
                    prefix = found[~is_hot][:take]
                    if len(prefix) < take:
                        rank = np.sort(by_hash[at[is_hot]])[: take - len(prefix)]
                        prefix = np.concatenate([prefix, common[rank]])
                else:
                    prefix = found[:take]
                keys.append(prefix)
                nodes.append(np.full(len(prefix), node, dtype=np.int64))
                sizes.append(np.full(len(prefix), size, dtype=np.uint32))
            if not keys:
                continue
            k, v, n = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
            bucket = (k >> np.uint64(32)).astype(np.int64)
            if len(ordered) and parts_of.max() > 1:
                at = np.minimum(np.searchsorted(ordered, k), len(ordered) - 1)
                parts = np.where(ordered[at] == k, parts_of[at], 1)
                bucket += v.view(np.uint64).astype(np.int64) % parts
            bucket %= buckets
            low = (k & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((v, bucket))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out_bucket, out = [], []
            for b in range(buckets):
                o = order[cut[b] : cut[b + 1]]
                if len(o):
                    out_bucket.append(b)
                    out.append(low[o].tobytes() + v[o].tobytes() + _planes(n[o]))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out, pa.binary())], ["bucket", "blob"])
        trim()

    return run


def _entries(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, v, n = [], [], []
    for blob in blobs:
        c = len(blob) // 16
        k.append(np.frombuffer(blob, dtype=np.uint32, count=c))
        v.append(np.frombuffer(blob, dtype=np.int64, count=c, offset=4 * c))
        n.append(_unplaned(blob, "<u4", c, 12 * c))
    return np.concatenate(k), np.concatenate(v), np.concatenate(n).astype(np.int64)


def _told(a, b, na, nb, shared, tile) -> Iterator[pa.RecordBatch]:
    """Rows of tiles in batches of TOLD_ROWS; a column is an array or None for nulls."""
    n = len(a)
    for at in range(0, n, TOLD_ROWS):
        end = min(at + TOLD_ROWS, n)
        columns = [pa.nulls(end - at, pa.int64()) if x is None else pa.array(x[at:end].astype(np.int64)) for x in (a, b, na, nb, shared, tile)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "na", "nb", "shared", "tile"])


def _tile_pairs(blobs: list[bytes], percent: int, dealt: np.ndarray, tile: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a bucket's tiles (a < b, their sizes, how often they met), and the entries of hot tiles for the second round (b null).  dealt: shingles whose tiles are in several buckets.

    Pairs are held as one number each, and made in as many passes over the first
    node as keep them under PASS_PAIRS.
    """
    k, v, n = _entries(blobs)
    nodes, v = np.unique(v, return_inverse=True)
    v = v.astype(np.int32)
    sizes = np.zeros(len(nodes), dtype=np.int64)
    sizes[v] = n
    order = np.lexsort((v, n, k))
    k, v, n = k[order], v[order], n[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, v, n = k[new], v[new], n[new]
    marks, first, inverse, count = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
    hot_mark = (count > tile) | np.isin(marks, dealt)
    hot = hot_mark[inverse]
    keep = np.flatnonzero(~hot & (count[inverse] > 1))
    kk, vv, nn = k[keep], v[keep], n[keep]
    small = count[~hot_mark].astype(np.int64)
    passes = int((small * (small - 1) // 2).sum() // PASS_PAIRS) + 1

    def code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x, y).astype(np.int64) << 32 | np.maximum(x, y)

    def told(codes: list[np.ndarray], weight: int) -> Iterator[pa.RecordBatch]:
        pairs, times = np.unique(np.concatenate(codes), return_counts=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        yield from _told(nodes[a], nodes[b], sizes[a], sizes[b], times * weight, None)

    for turn in range(passes):
        met = [np.zeros(0, dtype=np.int64)]
        for step in range(1, min(tile, len(kk))):
            same = kk[step:] == kk[:-step]
            if not same.any():
                break
            at = np.flatnonzero(same & (percent * nn[step:] <= 100 * nn[:-step]))
            made = code(vv[at], vv[at + step])
            met.append(made if passes == 1 else made[(made >> 32) % passes == turn])
        yield from told(met, 1)
    stars = [np.zeros(0, dtype=np.int64)]
    for g in np.flatnonzero(hot_mark):
        own_v, own_n = v[first[g] : first[g] + count[g]], n[first[g] : first[g] + count[g]]
        # Size bands of a factor 1.15; each node meets one of its own band and one of the band below.
        band = np.floor(np.log(own_n) / np.log(1.15)).astype(np.int64)
        bands, starts, counts = np.unique(band, return_index=True, return_counts=True)
        chosen = starts + int(marks[g] & 3) * counts // 4
        own = np.searchsorted(bands, band)
        for below in (0, 1):
            b = own - below
            rep = chosen[np.maximum(b, 0)]
            low, high = np.minimum(own_n, own_n[rep]), np.maximum(own_n, own_n[rep])
            at = np.flatnonzero((b >= 0) & (percent * high <= 100 * low) & (rep != np.arange(len(own_n))))
            stars.append(code(own_v[at], own_v[rep[at]]))
    yield from told(stars, CERTAIN)
    yield from _told(nodes[v[hot]], None, n[hot], None, None, k[hot])


def _tiles(hot, percent: int, split: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        common, counts = hot.value
        dealt = (common[counts > split] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield from _tile_pairs(held, percent, dealt, tile)
                    held = []
                    trim()
                now = bucket
                held.append(blob.as_py())
        if held:
            yield from _tile_pairs(held, percent, dealt, tile)
        trim()

    return run


def _hot_pairs(percent: int, most: int | None):
    """Pairs of different labels whose bitmaps allow a link, in each block of a hot tile's band: the `most` likest of each node, or all.

    Input: tile, band, i, j, node, n, label, bits, own, block, tiles, sorted by the
    first four.  Rows of the band below meet those of the own band only, and,
    where i and j differ, one block the other.  A pair that shares several tiles is
    told in the first of them.
    """

    def of(rows: list[tuple], tile: int, apart: bool) -> tuple[list, list]:
        rows.sort(key=lambda r: (r[1], r[0]))
        node, n, label, block = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1, 2, 5))
        own = np.array([r[4] for r in rows], dtype=bool)
        width = np.array([len(r[3]) for r in rows])
        stacks = {w: np.frombuffer(b"".join(r[3] for r in rows if len(r[3]) == w), dtype=np.uint64).reshape(-1, w // 8) for w in np.unique(width)}
        row = np.zeros(len(rows), dtype=np.int64)  # place within the stack of its width
        for w in stacks:
            row[width == w] = np.arange(int((width == w).sum()))
        lefts, rights = [], []
        for x in range(len(rows)):
            # All partners of nodes with a limit; each pair once without.
            start = int(np.searchsorted(100 * n, percent * n[x], side="left")) if most else x + 1
            end = int(np.searchsorted(percent * n, 100 * n[x], side="right"))
            near = slice(start, end)
            meet = (label[near] != label[x]) & (own[near] | own[x])
            if apart:
                meet &= block[near] != block[x]
            at = np.flatnonzero(meet) + start
            if not len(at):
                continue
            good, unlike = [], []
            for w, stack in stacks.items():
                same = at[width[at] == w]
                mine = stacks[width[x]][row[x]]
                cells = min(len(mine), stack.shape[1])
                differ = np.bitwise_count(_fold(stack[row[same]], cells) ^ _fold(mine, cells)).sum(axis=1).astype(np.int64)
                ok = (n[x] + n[same] - differ) // 2 >= _need(n[x], n[same])
                good.append(same[ok])
                unlike.append(differ[ok])
            good, unlike = np.concatenate(good), np.concatenate(unlike)
            if most:
                good = good[np.lexsort((node[good], unlike))[:most]]
            else:
                mine = set(rows[x][6])
                good = np.array([y for y in good if min(mine.intersection(rows[y][6])) == tile], dtype=np.int64)
            lefts += np.minimum(node[x], node[good]).tolist()
            rights += np.maximum(node[x], node[good]).tolist()
        return lefts, rights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def made():
            a, b = of(held, now[0] - (1 << 31), now[2] != now[3])  # tiles are listed as 32-bit integers
            pairs = sorted(set(zip(a, b, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for tile, band, i, j, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tile, band, i, j) != now and held:
                    yield made()
                    held = []
                now = (tile, band, i, j)
                held.append(tuple(row))
        if held:
            yield made()
        trim()

    return run


def _blocks(entries: DataFrame, percent: int, across: bool, block: int) -> DataFrame:
    """Entries of hot tiles (tile, node, n_shingles, ...) dealt to blocks: band, i, j, own, block.

    Linked sizes are in one band or in neighbouring ones, so a node goes to its own
    band and the one above.  Of a band's blocks each meets itself, and with `across`
    each other one.
    """
    band = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent)) + F.lit(1e-9))
    sides = entries.withColumn("low", band).withColumn("band", F.explode(F.array(F.col("low"), F.col("low") + 1))).withColumn("own", F.col("low") == F.col("band")).drop("low")
    counts = sides.groupBy("tile", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"), F.max("own").alias("any")).filter("any").drop("any")
    if counts.filter("parts > 1").limit(1).count() == 0:  # no band is over one block
        return sides.join(counts.select("tile", "band"), ["tile", "band"], "left_semi").withColumns({"block": F.lit(0).cast("long"), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    dealt = sides.join(counts, ["tile", "band"]).withColumn("block", F.expr("pmod(xxhash64(node), parts)"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) if across else F.col("block")
    dealt = dealt.withColumn("__other", other)
    return dealt.withColumn("i", F.least("block", "__other")).withColumn("j", F.greatest("block", "__other")).drop("__other", "parts")


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, slack: pairs whose bitmaps allow a link, and by how much."""

    @F.arrow_udf(T.LongType())
    def spare(xa: pa.Array, xb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        rows = zip(xa, xb, na.to_pylist(), nb.to_pylist(), strict=True)
        return pa.array([overlap_bound(p.as_py(), q.as_py(), m, n) - _need(m, n) for p, q, m, n in rows], pa.int64())

    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("xa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", spare.asNondeterministic()("xa", "xb", "na", "nb").alias("slack")).filter("slack >= 0")  # so that the filter doesn't work it out again


def _among(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows of needed nodes; few enough of these are broadcast."""
    needed = needed.select("node").distinct()
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    return rows.join(needed, "node", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets link, by exact intersection of the sorted arrays.  Only the sets of pairs' nodes are shuffled."""

    @F.arrow_udf(T.BooleanType())
    def linked(xa: pa.Array, xb: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(xa, xb, strict=True):
            x, y = np.frombuffer(p.as_py(), dtype=np.uint64), np.frombuffer(q.as_py(), dtype=np.uint64)
            if len(x) > len(y):
                x, y = y, x
            overlap = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out.append(overlap >= _need(len(x), len(y)))
        return pa.array(out, pa.bool_())

    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = _among(sets, needed).dropDuplicates(["node"])
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("xb"))
    return pairs.join(a, "a").join(b, "b").filter(linked("xa", "xb")).select("a", "b")


def _met_enough(met: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """a, b of pairs that met in as many tiles as linked sets must.

    Of the set whose prefix ends first, all prefix shingles that the other set holds
    are in the other's prefix; a linked set lacks n less the needed overlap at most.  Hot
    tiles, where not all pairs meet, count as met.
    """
    hot = crowded.groupBy("node").agg(F.count(F.lit(1)).alias("hot"))
    if hot.count() <= BROADCAST_NODES:
        hot = F.broadcast(hot)
    pairs = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pairs = pairs.join(hot.select(F.col("node").alias("a"), F.col("hot").alias("ha")), "a", "left").join(hot.select(F.col("node").alias("b"), F.col("hot").alias("hb")), "b", "left")
    need = f"ceil({percent} * (na + nb) / {100 + percent})"
    prefix = lambda n: f"({n} - ceil({percent} * {n} / 100) + 1)"
    least = f"least({prefix('na')} - na, {prefix('nb')} - nb) + {need}"
    return pairs.filter(F.expr(f"shared + least(coalesce(ha, 0), coalesce(hb, 0)) >= {least}")).select("a", "b")


def _parted(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes in different components."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _mixed_tiles(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """tile, node, n_shingles, label of the hot tiles that hold more than one component."""
    named = crowded.join(labels, "node", "left").select("tile", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
    named = written(named, "hot")
    mixed = named.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("tile")
    out = written(named.join(mixed, "tile", "left_semi"), "mixed")
    deleted(named)
    return out


def _joined(labels: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels after the links among more pairs."""
    links = written(_links(pairs, sets), "links")
    if links.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
    deleted(links)
    return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, tile: int = TILE, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """-> doc_id, n_shingles, component_id for each row: the least doc_id reachable by links of percent or more."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(text).cast("string").alias("text"))
    rows = written(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_node_rows, _NODE_SCHEMA), "nodes")
    nodes = rows.filter(F.col("bits").isNotNull()).select("node", "n_shingles", "bits")
    total, counted = (x or 0 for x in nodes.agg(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1), F.sum("n_shingles")).first())

    # Counted in pieces as large as memory allows, as a shingle that is spread over many small ones would be missed.
    pieces = max(int(counted // COUNT_CHUNK) + 1, spark.sparkContext.defaultParallelism)
    common = texts.coalesce(pieces).mapInArrow(_common, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    hot = common.filter(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "shingle").limit(MOST_HOT).toPandas()[::-1]  # at most MOST_HOT rows
    hot = spark.sparkContext.broadcast((hot["shingle"].to_numpy(dtype=np.int64).view(np.uint64), hot["n"].to_numpy(dtype=np.int64)))

    buckets = int(total // BUCKET_ENTRIES) + 16
    blobs = texts.mapInArrow(_prefixes(hot, buckets, percent, split), "bucket long, blob binary")
    tiled = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_tiles(hot, percent, split, tile), "a long, b long, na long, nb long, shared long, tile long")
    tiled = written(tiled, "tiles")
    signed = written(nodes.dropDuplicates(["node"]), "signed")
    crowded = written(tiled.filter(F.col("tile").isNotNull()).select("tile", F.col("a").alias("node"), F.col("na").alias("n_shingles")).distinct(), "crowded")
    pairs = written(_allowed(_met_enough(tiled.filter(F.col("b").isNotNull()), crowded, percent), signed), "pairs")
    deleted(tiled)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    cells = spark.sparkContext.broadcast(_cells(needed))
    sets = written(texts.mapInArrow(_sets_of(cells), "node long, hashes binary"), "sets")
    # Of a group of alike texts first the pairs with each node's least and likest partners, then those that still part components.
    few = pairs.groupBy("a").agg(F.min("b").alias("b")).union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    few = written(few.union(pairs.groupBy("a").agg(F.max_by("b", F.struct("slack", "b")).alias("b"))).distinct(), "few")
    links = written(_links(few, sets), "links")
    labels = components(links)
    deleted(links)
    parted = written(_parted(pairs, labels).join(few, ["a", "b"], "left_anti").select("a", "b"), "parted")
    if parted.limit(1).count():
        labels = _joined(labels, parted, sets)
    deleted(parted, few)

    tested = pairs.select("a", "b")
    for most in (LIKEST, None):
        mixed = _mixed_tiles(crowded, labels)
        if not mixed.limit(1).count():
            break
        if most:  # each node in one of its tiles
            mixed_here = mixed.groupBy("node").agg(F.min_by(F.struct("tile", "n_shingles", "label"), "tile").alias("x")).select("node", "x.*")
        else:
            mixed_here = mixed
        signs = _among(signed.select("node", "bits"), mixed)
        if most is None:  # a node's own hot prefix shingles
            signs = signs.join(mixed.groupBy("node").agg(F.sort_array(F.collect_list((F.col("tile") - (1 << 31)).cast("int"))).alias("tiles")), "node")
        else:
            signs = signs.withColumn("tiles", F.lit(None).cast("array<int>"))
        entries = _blocks(mixed_here, percent, across=most is None, block=block).join(signs, "node")
        entries = entries.select("tile", "band", "i", "j", "node", "n_shingles", "label", "bits", "own", "block", "tiles")
        groups = entries.repartition("tile", "band", "i", "j").sortWithinPartitions("tile", "band", "i", "j")
        more = groups.mapInArrow(_hot_pairs(percent, most), "a long, b long").distinct()
        more = written(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(more)
        labels = _joined(labels, more, sets)
        deleted(mixed)
    deleted(crowded, signed, pairs, sets)

    slim = written(rows.select("doc_id", "n_shingles", "node"), "slim")
    deleted(rows)  # the bitmaps aren't read any more
    least_of = slim.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = least_of.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = grouped.join(least, "label").select("node", "component_id")
    return slim.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every whole text of documents."""
    return near_duplicates(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH RECURSIVE s AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(nx.n) + any_value(ny.n) - count(*))
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
