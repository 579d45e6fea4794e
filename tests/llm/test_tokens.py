"""BPE, token store and token counts against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from pagequarry.llm import bpe, token_counts, token_store
from pagequarry.llm.wordbpe import WordBpe

ODD = ["", None, " \n", "Hello, World! don't we've I'LL", "ΣΑΣ İstanbul ſtraße ﬁ", "\x1c\x85\xa0x", "日本語 é 𝔘", "'''s 'S", "a<|endoftext|>b <|startoftext|>", "12½²٣", "é ́e", "x" * 3_000, "<| |>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def made_up(n: int) -> list[str | None]:
    rnd = random.Random(7)
    letters = list("aàbcdeéz ,.!?'s09\n\tSTßΣ日é<|>")
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pairs_agree_with_plain_merging():
    code = WordBpe(open(bpe.vocabulary_path()).read())
    rnd = random.Random(2)
    ids = list(code.vocab.values())
    inner = [i for i in ids if not code.names[i].endswith(code.suffix)]
    for _ in range(3_000):
        a, b = rnd.choice(inner), rnd.choice(ids)
        if code._stands(a) and code._stands(b):
            both = code._symbols(code.names[a]) + code._symbols(code.names[b])
            assert code._follows(a, b) == (code._merge(both) == [code.names[a], code.names[b]])


def test_encoding_and_decoding_are_the_librarys(spark, library):
    texts = made_up(300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    rows = {r.doc_id: r for r in bpe.encode_and_decode(df).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].token_ids == want and rows[i].decoded == library.decode(want, skip_special_tokens=False), t
    again = bpe.decode(bpe.encode(df)).select("doc_id", "decoded").collect()
    assert all(r.decoded == rows[r.doc_id].decoded for r in again)


def test_token_store(spark, library, tmp_path):
    texts = made_up(120)
    rows = [(int(i) * 3 - 40, t) for i, t in enumerate(texts)] + [(5, "b"), (5, "a"), (None, "no key")]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, shard_ids=300)
    found = token_store.read_tokens(spark, path).orderBy("start").collect()
    at = 0
    packed = lambda t: struct.pack(f"<{n}I", *ids) if (n := len(ids := [*library.encode(t or "", add_special_tokens=False).ids, 1])) else b""
    want = sorted([(key is not None, key or 0, packed(t)) for key, t in rows])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in found) == want
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    for r in found:
        assert r.start == at
        at += len(r.ids) // 4
    asked = token_store.lookup(spark, path, spark.createDataFrame([(5,), (-40,), (7_777,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id, r.ids) for r in asked) == sorted((r.doc_id, r.ids) for r in found if r.doc_id in (5, -40))


def test_shard_reads_through_its_index():
    keys = np.array([0, 3, 5, 5, 9])
    known = np.array([False, True, True, True, True])
    shard = token_store.Shard(token_store.pack_shard(keys, known, np.array([2, 1, 3, 1, 2]), np.arange(9)))
    column, at, size = shard.documents()
    assert (column.to_pylist(), at.tolist(), size.tolist()) == ([None, 3, 5, 5, 9], [0, 2, 3, 6, 7], [2, 1, 3, 1, 2])
    assert [x.tolist() for x in shard.get(5)] == [[3, 4, 5], [6]] and shard.get(4) == []
    shard.begins = shard.begins + np.uint64(1)  # a wrong index gives a wrong result
    assert shard.documents()[1].tolist() != at.tolist()
    shard.prints = shard.prints ^ np.uint32(1)
    with pytest.raises(ValueError):
        shard.documents()


def test_op8_query(spark, library, tmp_path):
    for texts in (made_up(40), []):
        spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string").write.parquet(str(tmp_path / f"{len(texts)}/documents.parquet"))
        rows = token_store.op8_token_store(spark, str(tmp_path / f"{len(texts)}")).orderBy("doc_id").collect()
        at = 0
        for r, t in zip(rows, texts, strict=True):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += len(ids)


def test_op4_query(spark, library, tmp_path):
    texts = made_up(40)
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in bpe.op4_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5_000).astype(np.uint64)
    slots = token_store.PerfectHash.of(keys).slots(np.unique(keys))
    assert sorted(slots) == list(range(len(np.unique(keys))))
    shard = token_store.Shard(token_store.pack_shard(np.array([1, 2, 9]), np.ones(3, dtype=bool), np.array([1, 0, 2]), np.array([1, 2, 3])))
    assert [[x.tolist() for x in shard.get(k)] for k in (9, 2, 4)] == [[[2, 3]], [[]], []]


def test_counts_are_those_of_plain_dynamic_programming(spark):
    counter = token_counts.UnigramCounter(open(bpe.vocabulary_path(token_counts.DEFAULT_VOCABULARY), "rb").read())

    def plain(word: str) -> int:
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            s, n = counter.single(word[end - 1])
            options = [(best[end - 1][0] + s, -(best[end - 1][1] + n))]
            options += [(best[a][0] + counter.scores[word[a:end]], -(best[a][1] + 1)) for a in range(end - 1) if word[a:end] in counter.scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    texts = made_up(150)
    rows = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert r.n_tokens == sum(plain(token_counts.MARK + w) for w in (texts[r.doc_id] or "").split()), texts[r.doc_id]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, token_ids string")
    assert bpe.encode_and_decode(df).count() == 0 and token_counts.count_tokens(df).count() == 0
    assert hashlib.sha256(b"").hexdigest()
