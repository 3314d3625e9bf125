"""Stages of the corpus pipeline on small fixtures."""

import corpus_pipeline
from marketclime.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_pair(name, shared, own):
    """Two texts of ``shared`` common and ``own`` further shingles each."""
    words = [f"{name}{i}" for i in range(shared + 4)]
    return [" ".join(words + [f"{name}{side}{i}" for i in range(own)]) for side in "ab"]


def test_near_copies_from_four_fifths_on_go(spark):
    pairs = [near_pair("low", 77, 11), near_pair("mid", 90, 10), near_pair("edge", 80, 10), near_pair("high", 90, 4)]
    rows = [(10 * i + j, text, "en", "s", 1) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == [0, 1, 10, 20, 30]  # 77 of 99 shingles is less, 90 of 110, 80 of 100 and 90 of 98 are enough
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == [0, 1, 10, 11, 20, 21, 30]


def test_bands_follow_the_similarity():
    assert minhash.bands_for(85) == 24 and minhash.bands_for(100) == 1
    for percent in (50, 80, 85, 95):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent) <= 1e-6


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    same, none, mixed = near_pair("same", 90, 4), near_pair("none", 90, 4), near_pair("mixed", 90, 4)
    rows = [(5, same[0]), (5, same[1]), (5, same[1]), (None, none[0]), (None, none[1]), (None, mixed[0]), (8, mixed[1]), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i, text in rows], DOCS)
    out = minhash.keep_one(docs).collect()
    groups = sorted((r.text or "").rstrip("0123456789 ")[:4] for r in out)
    assert groups == ["", "", "mixe", "none", "same"]
    assert {r.doc_id for r in out} == {5, 8, 9, None}
    # the contract's column still marks every row of the smallest id
    assert minhash.near_duplicates(docs).filter("kept").count() == 8
