"""Token alignment beside whole-text encoding and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from marketclime.llm import alignment
from marketclime.llm.perfecthash import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "The cat sat on the mat, it's 1234 cats!"), (2, "the cat  sat\n\non\tthe mat. "), (3, None), (4, ""), (5, " "),
    (6, "x▁y z"), (7, "<|endoftext|> </s> 😀é中文字 中文"), (8, "ab" * 3000 + " " + "😀" * 500), (9, "  lead trail  "),
    (20, "a\x85b \u2028c \u3000d\u180ee \xa0f \x1f g\u200b h 's 'll I'll we're"), (10, "nul\x00 a\x1cb c\x1c d e f  g"), (None, "the cat"), (1, "The cat sat on the mat, it's 1234 cats!"), (11, "a" * 200_000),
    (12, "long " * 20_000 + "tail"),
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()

    def a_bytes(i):
        token = ta.id_to_token(i)
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def b_bytes(i):
        return bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()

    aligned, counts = [], Counter()
    for doc_id, text in rows:
        a = [(i, a_bytes(i)) for i in ta.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_bytes(i)) for i in tb.encode(text)] if text else []
        want = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
            group, at_a, at_b, i, j = ([], []), 0, 0, 0, 0
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    group[0].append(a[i][0])
                    at_a, i = at_a + len(a[i][1]), i + 1
                else:
                    group[1].append(b[j][0])
                    at_b, j = at_b + len(b[j][1]), j + 1
                if at_a == at_b:
                    groups.append(group)
                    group = ([], [])
        links = Counter()
        for x, y in groups:
            for (p, n), (q, m) in ((u, v) for u in Counter(x).items() for v in Counter(y).items()):
                links[p, q] += n * m
        counts.update(links.keys())
        aligned.append((doc_id, groups, links))
    most = Counter()
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = Counter()
    for doc_id, groups, links in aligned:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for (p, q), n in links.items() if counts[p, q] == most[p]), sum(n * counts[k] for k, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ] += 1
    return out, counts


@pytest.fixture(scope="module")
def want():
    return plain(TEXTS)


@pytest.fixture
def docs(spark):
    rows = [(d, t, 7, "x") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a long, groups string").repartition(5)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(docs):
    got = alignment.digests(docs, A, B)
    assert got.columns == COLUMNS
    return Counter(tuple(r) for r in got.collect())


def test_alignment_is_the_plain_one(docs, want):
    assert found(docs) == want[0]


def test_pair_counts_over_the_corpus(docs, want):
    rows = alignment.PairCounts(docs, alignment.Files(docs, A, B)).rows().collect()
    assert {(r.a, r.b): r.n for r in rows} == want[1] and len(rows) == len(want[1])


def test_many_shards_passes_and_levels(docs, want, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 16)
    monkeypatch.setattr(alignment, "PASS", 60)
    monkeypatch.setattr(alignment, "FAN", 2)
    assert found(docs) == want[0]


def test_few_kept_segments(want):
    files = [open(p, "rb").read() for p in (A, B)]
    known = alignment.Known(alignment.Tokenizers(*files), True)
    alignment.KEPT, kept = 8, alignment.KEPT
    try:
        for _ in range(3):
            for doc_id, text in TEXTS:
                found = alignment.Slice(known, [text])
                row = (doc_id, *(int(found.total(x)[0]) for x in (found.aligned.n_a, found.aligned.n_b, found.aligned.n_groups, found.aligned.n_links)))
                groups = found.groups()[0]
                digest = hashlib.sha256(groups).hexdigest() if groups else ""
                assert (*row, digest) in {(*w[:5], w[7]) for w in want[0]}
                assert known.uses.size == len(known.rows) <= 8
    finally:
        alignment.KEPT = kept


def test_ranks_are_used_only_where_they_are_the_ids():
    import json

    spec = json.load(open(A))
    tokens = alignment.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    assert tokens.ranked is not None
    spec["model"]["merges"][0], spec["model"]["merges"][1] = spec["model"]["merges"][1], spec["model"]["merges"][0]
    assert alignment._ranked(spec, tokens.a_bytes) is None
    assert alignment._ranked({**spec, "normalizer": {"type": "NFC"}}, tokens.a_bytes) is None


def test_links_of_a_large_group_in_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    a, b = np.array([5, 6, 5, 9, 9]), np.array([1, 2, 1, 3])
    first, keys, times = alignment._pairs(a, b, np.array([3, 2]), np.array([3, 1]), np.array([0, 1]), 2)
    got = {(k >> 16, k & 0xFFFF): t for k, t in zip(keys.tolist(), times.tolist())}
    assert got == {(5, 1): 4, (5, 2): 2, (6, 1): 2, (6, 2): 1, (9, 3): 2} and first.tolist() == [0, 4, 5]


def test_empty_table(docs):
    assert alignment.digests(docs.limit(0), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.digests(docs.filter("text is null"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 32, 50_000, replace=False)
    hashed = PerfectHash(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(keys.size))
    strange = np.setdiff1d(np.arange(1000), keys)
    assert hashed.index(strange).max() < keys.size
    assert PerfectHash(np.zeros(0, np.int64)).index(np.array([3])).tolist() == [-1]
