"""Outlier distances of groups of every size beside plain numpy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from marketclime.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
D = len(quality.FEATURES)


def prose(seed, junk=False):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(r.randint(60, 90))]
    if junk:
        words = [w.upper() + "#$%&|<>{}" for w in words]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, len(words), 12))


def rows():
    groups = [("en", "hot", 130), ("de", "a", 60), ("de", "b", 60), ("fr", "a", 120), ("fr", "b", 5), ("xx", "a", 3), (None, None, 2), ("yy", "a", 1)]
    out = []
    for lang, source, n in groups:
        out += [(len(out) + i, prose(len(out) + i), lang, source, 1) for i in range(n)]
    out += [(1000 + i, prose(1000 + i, junk=True), lang, source, 1) for i, (lang, source, _) in enumerate(groups)]
    return [*out, (2000, "few words", "zz", "a", 1), (2001, None, None, "a", 1)]


def features(text):
    data = (text or "").encode()
    s = {k: int(v[0]) for k, v in quality.text_stats(np.frombuffer(data, np.uint8), np.array([0, len(data)])).items()}

    def share(top, bottom, scale):
        return math.asinh(s[top] * scale / s[bottom]) if s[bottom] else 0.0

    length = math.log(max(s["word_chars"] / s["n_words"], 1)) if s["n_words"] else 0.0
    more = [("n_symbols", "word_chars", 50), ("n_dup_lines", "n_lines", 2), ("n_repeat_words", "n_words", 3), ("n_upper", "word_chars", 5), ("n_marks", "word_chars", 20)]
    return [2 * length, *(share(*x) for x in more)], s["n_words"] < 50 or 2 * s["n_repeat_words"] > s["n_words"]


def model(x):
    x = np.array(x)
    n = len(x)
    quarter = [np.sort(x, axis=0)[math.ceil(q * n) - 1] for q in (0.25, 0.5, 0.75)]
    mean, precision = quarter[1], np.diag(1 / np.maximum((quarter[2] - quarter[0]) / 1.349, quality.FLOOR) ** 2)
    for _ in range(quality.STEPS):
        gap = x - mean
        bins = np.floor(np.log2(np.maximum(np.einsum("ni,ij,nj->n", gap, precision, gap), 0) + 2.0**-20) * quality.BINS_PER_OCTAVE)
        near = x[[np.sum(bins < b) < quality.KEEP_SHARE * n for b in bins]]
        mean = near.mean(axis=0)
        cov = (near.T @ near / len(near) - np.outer(mean, mean)) * quality.consistency()
        precision = np.linalg.inv(cov + quality.FLOOR**2 * np.eye(D))
    return mean, precision


def distances(docs):
    """doc_id to base_failed and squared distance."""
    told = {r[0]: (*features(r[1]), r[2], r[3]) for r in docs}
    passing = [(f, lang, source) for f, failed, lang, source in told.values() if not failed]
    source_rows, lang_rows = defaultdict(list), defaultdict(list)
    for f, lang, source in passing:
        source_rows[lang, source].append(f)
        lang_rows[lang].append(f)
    out = {}
    for doc_id, (f, failed, lang, source) in told.items():
        rest = [x for (g, s), own in source_rows.items() if g == lang and len(own) < 100 for x in own]
        fitting = (source_rows[lang, source], rest, lang_rows[lang], [x for x, _, _ in passing])
        mean, precision = model(next((x for x in fitting[:3] if len(x) >= quality.MIN_GROUP), fitting[3]))
        out[doc_id] = failed, max(float((f - mean) @ precision @ (f - mean)), 0.0)
    return out


def test_every_group_is_judged(spark):
    docs = rows()
    got = {r.doc_id: r for r in quality.document_quality(spark.createDataFrame(docs, DOCS)).collect()}
    want = distances(docs)
    assert got.keys() == want.keys()
    for doc_id, (failed, distance) in want.items():
        assert got[doc_id].base_failed == failed
        assert got[doc_id].distance == pytest.approx(distance, rel=1e-6, abs=1e-6)
        assert got[doc_id].kept == (not failed and distance <= quality.CUTOFF)
    assert sorted(d for d, r in got.items() if not r.kept) == [*range(1000, 1008), 2000, 2001]
    assert quality.keep_good(spark.createDataFrame(docs, DOCS)).count() == len(docs) - 10


def test_small_tables_are_judged(spark):
    docs = [(i, prose(i, junk=i == 7), "en", f"s{i}", 1) for i in range(20)]
    got = quality.document_quality(spark.createDataFrame(docs, DOCS)).collect()
    assert [r.doc_id for r in got if not r.kept] == [7]
    nothing = quality.document_quality(spark.createDataFrame([(1, "few words", "en", "s", 1)], DOCS)).collect()
    assert [(r.base_failed, r.distance, r.kept) for r in nothing] == [(True, None, False)]
