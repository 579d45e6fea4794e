"""Token counts under a unigram model, by dynamic programming over a trie.

Pre-tokens are the pieces between white space, each with the vocabulary's word mark
before it.  The vocabulary is a public SentencePiece file; a piece's probability
falls with its place in the file (Zipf's law over the file's order), so nothing is
trained.  A pre-token is cut into the pieces with the largest product of
probabilities; of equal products the one with fewer pieces.  A character that is no
piece is written as its bytes, one token each.

Distinct pre-tokens are put in a trie and walked depth first.  A node keeps the best
score and count of its prefix, computed once however many pre-tokens share it; the
terminal node's count is the pre-token's.  Counts are kept between batches, bounded in
bytes in each Python worker.  No shuffle.

Defined results: a null or empty text, or one of white space alone, counts 0.
A very long text is read whole.  An empty table stays empty.
Repeated rows are counted each.  A result column replaces one of the same name.
"""

from __future__ import annotations

import functools
import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import shared_vocabulary, vocabulary_path
from .common import Recent, documents, text_slices

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"


class UnigramCounter:
    def __init__(self, model: bytes, cache_bytes: int = 64 << 20):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = file.get_piece_size()
        norm = math.log(sum(1 / (r + 1) for r in range(n)))
        score = lambda i: -math.log(i + 1) - norm
        kinds = {i: "byte" if file.is_byte(i) else "other" if file.is_control(i) or file.is_unknown(i) or file.is_unused(i) else "piece" for i in range(n)}
        self.scores = {file.id_to_piece(i): score(i) for i, k in kinds.items() if k == "piece"}
        self.byte_score = [score(i) for i, k in kinds.items() if k == "byte"] or [score(n)] * 256
        tails: dict[str, set[int]] = {}
        for p in self.scores:
            if len(p) > 1:
                tails.setdefault(p[-2:], {1}).add(len(p))
        #: Of the last two characters: the lengths of the pieces that end so.
        self.reach = {t: tuple(sorted(s)) for t, s in tails.items()}
        self.cache = Recent(cache_bytes)

    def single(self, char: str) -> tuple[float, int]:
        """Score and tokens of one character: a piece, or its bytes."""
        if (s := self.scores.get(char)) is not None:
            return s, 1
        data = char.encode("utf-8", "surrogatepass")
        return sum(self.byte_score[b] for b in data), len(data)

    def counts(self, pieces) -> dict[str, int]:
        """Tokens of each distinct pre-token; in order they are the depth-first walk of their trie."""
        scores, reach, one = self.scores.get, self.reach.get, (1,)
        path = [(0.0, 0)]  # of each prefix: best score, tokens
        before, out = "", {}
        for piece in sorted(set(pieces)):
            word = MARK + piece
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, n + 1):
                last, tokens = path[end - 1]
                more, count = self.single(word[end - 1])
                best, least = last + more, tokens + count
                for size in reach(word[end - 2 : end], one) if end > 1 else one:
                    if 1 < size <= end and (s := scores(word[end - size : end])) is not None:
                        last, tokens = path[end - size]
                        total = last + s
                        if total > best or total == best and tokens + 1 < least:
                            best, least = total, tokens + 1
                path.append((best, least))
            out[piece] = path[n][1]
            before = word
        return out

    def count_texts(self, texts: list[str | None]) -> list[int]:
        chunks = [t.split() if t else [] for t in texts]
        distinct = list(set(itertools.chain.from_iterable(chunks)))
        known = dict(zip(distinct, self.cache.many(distinct), strict=True))
        fresh = self.counts([c for c in distinct if known[c] is None])
        for c, n in fresh.items():
            self.cache.put(c, n, 8)
        known |= fresh
        return [sum(map(known.__getitem__, c)) for c in chunks]


@functools.lru_cache(maxsize=2)
def counter(model: bytes) -> UnigramCounter:
    return UnigramCounter(model)


def count_tokens(df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    shared = shared_vocabulary(df.sparkSession, vocabulary or vocabulary_path(DEFAULT_VOCABULARY))

    @F.arrow_udf(T.LongType())
    def run(column: pa.Array) -> pa.Array:
        c = counter(shared.value)
        return pa.array([n for part in text_slices(column) for n in c.count_texts(part.to_pylist())], pa.int64())

    return df.withColumn(n_tokens, run(F.col(text).cast("string")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every whole text of documents."""
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_tokens")
