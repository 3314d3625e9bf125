"""Lexical search beside a plain restatement of the score."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketclime.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        want = Counter(terms(text))
        scored = []
        for d, b, size in bags:
            m = 75 + (25 * size * n) // total
            score = 0
            for t, r in want.items():
                if t in b:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += r * w * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "中文", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(random.choices(words, weights, k=random.randint(1, 80)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3, W1-w2") for i in range(30)]  # ties
    docs += [(5, docs[5][1]), (None, "w50 w51"), (None, None), (2000, ""), (2001, " .,! "), (2002, "w40 " * 30_000)]
    items = [(i, " ".join(random.choices(words, k=12))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w1 w1 w1 w2"), (3, items[3][1]), (104, "中文 éA"), (None, "w50 x1")]
    return docs, items


@pytest.fixture
def frames(spark, corpus):
    docs, items = corpus
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, terms string").repartition(5)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")


def test_ranking_is_the_plain_one(frames, corpus):
    got = search.rank_documents(*frames)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain(*corpus)


def test_small_blocks_and_several_rounds(frames, corpus, monkeypatch):
    monkeypatch.setattr(search, "ITEM_TERMS", 40)
    got = search.rank_documents(*frames, k=3)
    assert Counter(tuple(r) for r in got.collect()) == plain(*corpus, k=3)


def test_empty_tables(spark, frames):
    docs, items = frames
    assert search.rank_documents(docs.limit(0), items).count() == 0
    assert search.rank_documents(docs, items.limit(0)).count() == 0


def block(pairs, postings, size):
    """A block with given posting lists: number -> [(place, impact)]."""
    starts = np.concatenate([[0], np.cumsum([len(p) for p in postings.values()])])
    flat = [x for p in postings.values() for x in p]
    lists = [sorted({p for p, _ in postings[a]} & {p for p, _ in postings[b]}) for a, b in pairs]
    most = [max((dict(postings[a])[p] + dict(postings[b])[p] for p in both), default=0) for (a, b), both in zip(pairs, lists)]
    row = {
        "size": size, "ids": np.arange(size), "nulls": np.zeros(size, bool), "terms": np.array(list(postings), np.int32),
        "starts": starts.astype(np.int32), "places": np.array([p for p, _ in flat], np.int32), "impacts": np.array([v for _, v in flat]),
        "pairs": np.arange(len(pairs), dtype=np.int32), "pair_starts": np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32),
        "pair_places": np.array([p for x in lists for p in x], np.int32), "pair_most": np.array(most, np.int64),
    }
    return search.Block({k: v if k == "size" else v.tobytes() for k, v in row.items()})


def test_pair_bound_is_below_the_sum_of_maxima_and_skips():
    # the two heavy impacts lie in different documents, so the pair gives at most 10, not 20
    own = block([(0, 1)], {0: [(0, 10), (1, 1)], 1: [(1, 1), (2, 10)], 2: [(3, 11)]}, 4)
    units = own.units([(0, 1, 1, 1), (2, 1, -1, 0)], [0, -1])
    assert [u[0] for u in units] == [10, 11]
    best = search.Best(1, 11)
    own.search([(0, 1, 1, 1), (2, 1, -1, 0)], [0, -1], best)
    assert best.ids.tolist() == [3] and best.scores.tolist() == [11]
    assert own.scores.tolist() == [0, 0, 0, 11]  # the pair's lists were not walked
