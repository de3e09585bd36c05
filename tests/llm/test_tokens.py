import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from placeloom.llm import tokens as K  # noqa: E402

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=K.merger(K.vocabulary()).ranks, special_tokens={})


def test_random_texts(encoding):
    rng = random.Random(1)
    parts = ["'s", "'re", "'ll", "'ve", "'", "''", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "²", "!", "中文", "🚂", "​", "l", "r", "e", "\r\n", " ", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20000)]
    for t, (ids, _, _) in zip(texts, K.encode_texts(texts, K.vocabulary())):
        assert ids == encoding.encode_ordinary(t), t


def test_offsets_and_round_trip():
    texts = ["Two'll  go\n to 中文!", None, "", " " * 5 + "x"]
    for t, (ids, starts, counts) in zip(texts, K.encode_texts(texts, K.vocabulary(), offsets=True)):
        assert K.decode(ids, K.vocabulary()) == (t or "") and sum(counts) == len(ids)
        at = 0
        for i, (s, n) in enumerate(zip(starts, counts)):
            end = starts[i + 1] if i + 1 < len(starts) else len(t)
            assert K.decode(ids[at : at + n], K.vocabulary()) == t[s:end]
            at += n


def test_long_pieces(encoding):
    for t in ("a" * 40_000, "ab" * 9_000, "中" * 5_000, " " * 30_000 + "x"):
        assert next(iter(K.encode_texts([t], K.vocabulary())))[0] == encoding.encode_ordinary(t)


def test_spark(spark, encoding):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "Hello world", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in K.encode_corpus(df).collect()}
    assert got == {1: encoding.encode_ordinary("Hello world"), 2: [], 3: [], 4: got[1]}
    full = {r["doc_id"]: r for r in K.encode_corpus(df, offsets=True).collect()}
    assert full[1]["starts"] == [0, 5] and full[2]["counts"] == []
    assert {tuple(r) for r in K.token_counts(df, ["doc_id"]).collect()} == {(1, 2), (2, 0), (3, 0), (4, 2)}
    assert K.encode_corpus(df.limit(0)).count() == 0
