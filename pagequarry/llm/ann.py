"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

Codes.  Vectors are scaled by the largest norm and given one more coordinate that
makes all norms 1, so the largest inner product is the least angle.  Rotations are
learned on a bounded sample by iterative quantization (turn the sample so that it
lies near the corners of a cube), as many as fill BITS bits; a bit is the sign of a
turned coordinate.

Search.  A code is cut into parts of PART bits, each indexed by its value.  Codes
within radius r of a query's agree with it in at least one part up to r / parts bits
(pigeonhole), so probing the values that near in every part retrieves every code
within r.  The parts are probed with growing distance t, after which all codes within
parts * (t + 1) - 1 are known; what is found is reranked by the inner product of the
original vectors in double precision.  A query is done when that radius holds what may
still be nearer than its k-th best: the distance of codes at that angle, learned on the
sample, with a margin that holds `recall` of them.  Where the next probes would read
more entries than a part of the block's rows, the codes left are read in a row, the
nearest first, under the same rule.  A query with fewer than k found is searched again
without a radius.

Layout.  Every row is indexed in the task that reads it, in blocks; queries are
broadcast in rounds of QUERY_BLOCK, one after the other, so memory doesn't grow with
their number.  Each block gives k rows a query, which are ranked by a window on the
query.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do rows with a null id.  Rows that
share the query's id aren't its candidates; of queries with one id the least vector
stands.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import small_batches, trim, written

BITS, PART, K = 256, 16, 20
#: Share of a block's rows that the probes of one distance may read.
PROBED = 0.5
SAMPLE_ROWS = 20_000
QUERY_BLOCK = 8_192
BLOCK_ROWS = 65_536
RECALL = 0.985


class BinaryCodes:
    """Learned rotations; maps vectors to packed codes."""

    def __init__(self, sample: np.ndarray, top: float, bits: int = BITS, rounds: int = 25):
        self.top = top
        x = self.lifted(sample)
        width = x.shape[1]
        rng = np.random.default_rng(20)
        turns = []
        for _ in range(-(-bits // width)):
            r = np.linalg.qr(rng.standard_normal((width, width)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
                r = (u @ vt).T
            turns.append(r)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        last = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))
        return np.concatenate([x, last[:, None]], axis=1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(self.lifted(x) @ self.turn > 0, axis=1, bitorder="little")

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.sqrt((q * q).sum(axis=1))[:, None]
        return np.packbits(np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ self.turn > 0, axis=1, bitorder="little")


#: The values of a part by their number of bits.
_NEAR = [np.flatnonzero(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)) == t) for t in range(PART + 1)]


class MultiIndex:
    """The codes of a block with one index for each part of the code.  `read` counts the entries and codes that searches read."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.parts = np.ascontiguousarray(codes).view(np.uint16)
        self.order = [np.argsort(self.parts[:, j], kind="stable") for j in range(self.parts.shape[1])]
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, j], minlength=1 << PART))]) for j in range(self.parts.shape[1])]
        self.read = 0

    def distances(self, rows: np.ndarray | slice, code: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[rows] ^ np.ascontiguousarray(code).view(np.uint64)).sum(axis=1).astype(np.int64)

    def ring(self, code: np.ndarray, t: int) -> np.ndarray | None:
        """Rows of which a part differs in exactly t bits; None if reading the codes in a row costs less."""
        own = np.ascontiguousarray(code).view(np.uint16)
        if len(own) * len(_NEAR[t]) > PROBED * len(self.words) + len(own):
            return None
        starts, counts = [], []
        for j, first in enumerate(self.first):
            values = _NEAR[t] ^ int(own[j])
            starts.append(first[values])
            counts.append(first[values + 1] - first[values])
        if sum(int(c.sum()) for c in counts) > PROBED * len(self.words) + len(own):
            return None
        rows = []
        for order, start, count in zip(self.order, starts, counts, strict=True):
            ends = np.cumsum(count)
            rows.append(order[np.repeat(start - ends + count, count) + np.arange(ends[-1])])
        found = np.concatenate(rows)
        self.read += len(found)
        return np.unique(found)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from `code` in radius bits at most."""
        found = np.zeros(len(self.words), dtype=bool)
        for t in range(radius // self.parts.shape[1] + 1):
            if (rows := self.ring(code, t)) is None:
                self.read += len(self.words)
                return np.flatnonzero(self.distances(slice(None), code) <= radius)
            found[rows] = True
        rows = np.flatnonzero(found)
        return rows[self.distances(rows, code) <= radius]

    def search(self, code: np.ndarray, score, k: int, floor: float, radius) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the likely k best.  score(rows) -> scores, -inf for rows that are no candidates; floor: a score that k rows are known to reach; radius(score) -> the distance that holds codes of that score."""
        seen = np.zeros(len(self.words), dtype=bool)
        held, scores = np.zeros(0, dtype=np.int64), np.zeros(0)

        def needed() -> int:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            return radius(max(floor, kth))

        def add(rows: np.ndarray) -> None:
            nonlocal held, scores
            held, scores = np.concatenate([held, rows]), np.concatenate([scores, score(rows)])
            if len(held) > 4 * k:
                keep = np.argpartition(scores, len(scores) - k)[len(scores) - k :]
                keep = np.flatnonzero(scores >= scores[keep].min())  # with all ties
                held, scores = held[keep], scores[keep]

        n_parts = self.parts.shape[1]
        for t in range(PART + 1):
            if n_parts * t - 1 >= needed():
                return held, scores
            if (rows := self.ring(code, t)) is None:
                break
            rows = rows[~seen[rows]]
            seen[rows] = True
            add(rows[self.distances(rows, code) <= needed()])
        self.read += len(self.words)
        far = self.distances(slice(None), code)
        left = np.flatnonzero(~seen & (far <= needed()))
        left = left[np.argsort(far[left], kind="stable")]
        for at in range(0, len(left), 1_024):
            if far[left[at]] > needed():
                break
            add(left[at : at + 1_024])
        return held, scores


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    keep = np.arange(len(ids))
    if len(ids) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def learned_radius(codes: BinaryCodes, sample: np.ndarray, recall: float):
    """A function of cosines: the distance within which `recall` of the codes at that angle lie.  Fitted on the nearer pairs of some hundred rows of the sample with the others."""
    asked = sample[:: max(1, len(sample) // 300)]
    rows, queries = codes.of_rows(sample).view(np.uint64), codes.of_queries(asked).view(np.uint64)
    norms = np.sqrt((asked * asked).sum(axis=1))
    angles, far = [], []
    for q, x, norm in zip(queries, asked, norms, strict=True):
        cosine = np.clip(sample @ x / (norm * codes.top), -1, 1)
        near = np.argsort(-cosine, kind="stable")[: max(50, len(sample) // 20)]
        angles.append(np.arccos(cosine[near]))
        far.append(np.bitwise_count(rows[near] ^ q).sum(axis=1))
    angle, distance = np.concatenate(angles), np.concatenate(far).astype(np.float64)
    slope, base = np.polyfit(angle, distance, 1) if np.ptp(angle) > 0.05 else (BITS / np.pi, 0.0)
    spread = float(np.quantile(distance - slope * angle - base, recall))
    return float(slope), float(base), max(spread, 1.0)


def radius_of(fit: tuple[float, float, float], cosine: float) -> int:
    if cosine < -1:  # nothing is known yet
        return BITS
    slope, base, spread = fit
    return min(BITS, int(np.ceil(slope * np.arccos(min(cosine, 1.0)) + base + spread)))


def valid(vector: str, width: Column | None = None) -> Column:
    """Whether a vector takes part."""
    fine = F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists({vector}, x -> x <> 0)")
    return fine if width is None else fine & (F.size(vector) == width)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, queries, query_codes, floors, fit = pickle.loads(shared.value)
        held_ids, held, n = [], [], 0

        def found() -> pa.RecordBatch:
            row_ids, rows = np.concatenate(held_ids), np.concatenate(held)
            index = MultiIndex(codes.of_rows(rows))
            out_q, out_v, out_s = [], [], []
            for qid, q, code, floor in zip(ids, queries, query_codes, floors, strict=True):
                scale = float(np.sqrt(q @ q)) * codes.top
                score = lambda at: np.where(row_ids[at] == qid, -np.inf, (rows[at] * q).sum(axis=1))  # noqa: B023, E731
                reach = lambda x: radius_of(fit, x / scale) if fit else BITS  # noqa: B023, E731
                at, scores = index.search(code, score, k, floor, reach)
                fine = np.flatnonzero(scores > -np.inf)
                top = fine[best(row_ids[at[fine]], scores[fine], k)]
                out_q.append(np.full(len(top), qid, dtype=np.int64))
                out_v.append(row_ids[at[top]])
                out_s.append(scores[top])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held_ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                held.append(_matrix(batch.column(1)))
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield found()
                held_ids, held, n = [], [], 0
        if n:
            yield found()
        trim()

    return run


def _floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows of the sample, other than its own, reach; -inf where the sample is too small."""
    out = np.full(len(ids), -np.inf)
    for at in range(0, len(ids), 512):
        scores = queries[at : at + 512] @ sample.T
        scores[ids[at : at + 512, None] == sample_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            out[at : at + 512] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return out - 1e-9 * np.abs(np.where(np.isfinite(out), out, 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = K, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """df, queries: vec_id long, embedding array.  -> query_id, rank, vec_id, score."""
    spark = df.sparkSession
    small_batches(spark)
    fields = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = df.select(*fields).filter(F.col("vec_id").isNotNull() & valid("embedding"))
    asked = queries.select(*fields).filter(F.col("vec_id").isNotNull() & valid("embedding"))
    kinds = rows.groupBy(F.size("embedding").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.expr("sqrt(aggregate(embedding, 0D, (a, x) -> a + x * x))")).alias("top")
    )
    kind = kinds.orderBy(F.desc("n"), "width").first()
    result = "query_id long, rank int, vec_id long, score double"
    if kind is None:
        return spark.createDataFrame([], result)
    rows, asked = (x.filter(F.size("embedding") == kind.width) for x in (rows, asked))
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample_rows).toArrow()
    sample_ids, sample = taken["vec_id"].to_numpy(), _matrix(taken["embedding"].combine_chunks())
    codes = BinaryCodes(sample, float(kind.top))
    fit = learned_radius(codes, sample, recall)

    asked = written(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    count = asked.count()

    def searched(part: DataFrame, fit: tuple | None) -> DataFrame:
        """One round for each block of queries, dealt by a hash of their ids; a round's result is written and its broadcast dropped before the next."""
        rounds = int(count * 1.25 // QUERY_BLOCK) + 1
        out = None
        for r in range(rounds):
            block = part.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).orderBy("vec_id").toArrow()
            if not block.num_rows:
                continue
            ids, q = block["vec_id"].to_numpy(), _matrix(block["embedding"].combine_chunks())
            floors = _floors(ids, q, sample_ids, sample, k) if fit else np.full(len(ids), -np.inf)
            value = pickle.dumps((codes, ids, q, codes.of_queries(q), floors, fit))
            if len(value) > 256 << 20:
                raise ValueError("a block of queries is larger than may be broadcast")
            shared = spark.sparkContext.broadcast(value)
            got = written(ranked(rows.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score double")), "neighbours")
            shared.unpersist()
            out = got if out is None else out.union(got)
        return out if out is not None else spark.createDataFrame([], result)

    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(x: DataFrame) -> DataFrame:
        return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = searched(asked, fit)
    full = min(k, kind.n - 1)
    counts = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(counts, "vec_id", "left").filter(F.coalesce("n", F.lit(0)) < full).select("vec_id", "embedding")
    if short.limit(1).count():
        short = written(short, "queries")
        again = searched(short, None)
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(again)
    return first


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every row of embeddings whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
