import base64
import random

import public_tokenizers
import pytest
import tiktoken

from marketclime.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return memoryview(packed).cast("i").tolist()


def test_encoder_equals_library_on_odd_texts(library):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, generation=500)
    random.seed(1)
    letters = "abcdeéß  \n\t'sdllvre1290.,!? \x1c\x1f\x85漢字😀 "
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "ab" * 5000 + "x" * 700, "<|endoftext|>", "a  b", "a \n b"]
    assert [ids(encoder.encode(t)) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_round_trip_with_nulls_and_clashing_columns(spark, library):
    rows = [(1, "Hé 漢 <|endoftext|>", 5, 6), (1, "Hé 漢 <|endoftext|>", 5, 6), (None, None, 7, 8), (3, "", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded int")
    coded = bpe.encode_bpe(df, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_bpe(coded, RANKS).collect()
    assert sorted((bytes(r.decoded).decode() for r in back)) == sorted((r[1] or "") for r in rows)
    assert all(r.ids == library.encode_ordinary(r.text or "") for r in back)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, RANKS, public_tokenizers.PATTERN).count() == 0


def test_both_ways_in_one_pass(spark, library):
    rows = [(1, "Hé 漢 <|endoftext|>", 5, 6), (None, None, 7, 8), (3, "", None, 9), (4, "x" * 100_000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded int")
    out = bpe.code_bpe(df, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")


def test_digests(spark, library):
    import hashlib

    texts = ["", None, "a b", "été  ok\n\n", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
