"""Columns of any name pass through the stages that filter or change rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketclime.llm import contamination, minhash, quality
from marketclime.llm.columns import shielded

HELPERS = (
    "kept", "marks", "upper", "repeats", "distance", "base_failed", "_group", "_mean", "_quality_n_words", "_word", "_bit", "_mask",
    "_maybe", "_id", "_key", "_leak_id", "_leak_hash", "_secrets", "secrets", "text_key", "component_id", "_in0", "item_id", "class",
)


@pytest.fixture
def docs(spark):
    words = " ".join(f"Word{i % 89} some more{i}." for i in range(80))
    rows = [(i, f"{words} {i} end{i % 3}", "en", "s", 5) for i in range(9)]
    rows += [(20, "short", "en", "s", 1), (21, None, None, None, None), (22, "key password = 'q7Zx9Lm2Vt5Rk8Pw3Yb6Nc1' " + words[::-1], "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(0))).alias(c) for c in HELPERS])


def same_rows(out, docs):
    """Each row that came out is a row that went in, all columns included."""
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and set(rows) <= set(docs.collect())
    return rows


def test_quality(docs):
    assert {r.doc_id for r in same_rows(quality.keep_good(docs), docs)} >= set(range(9))


def test_near_duplicates(docs):
    assert sorted(r.doc_id for r in same_rows(minhash.keep_one(docs, 80), docs)) == [0, 20, 21, 22]


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, "Word0 some more0. Word1 some more1. Word2 some more2.", "x")], "item_id long, text string, _leak_id string")
    assert sorted(r.doc_id for r in same_rows(contamination.drop_leaks(docs, items), docs)) == [20, 21, 22]


def test_secrets(spark, docs):
    out = corpus_pipeline.secret_scan(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    for r in docs.collect():
        if r.doc_id == 22:
            assert "q7Zx9Lm2" not in rows[22].text and rows[22].n_chars == len(rows[22].text)
            assert rows[22][5:] == r[5:]
        else:
            assert rows[r.doc_id] == r


def test_a_needed_column_must_be_there_once(docs):
    with pytest.raises(ValueError):
        shielded(docs, ("no_such",), lambda rows: rows)
