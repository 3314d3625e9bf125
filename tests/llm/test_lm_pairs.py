import dataclasses
import math
import random
import re

import numpy as np

from marketclime.llm import lm
from marketclime.llm.textbytes import word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, data.size]))
    return word_hashes(data, starts, ends)[0]


def corpus(spark, n=260):
    rng = random.Random(5)
    follow = {w: rng.sample(range(40), 4) for w in range(40)}
    rows = []
    for i in range(n):
        w, words = rng.randrange(40), []
        for _ in range(rng.randrange(5, 60)):
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.randrange(40)
            words.append(f"w{w}" if rng.random() < 0.97 else f"odd{rng.randrange(10**6)}")
        rows.append((i, " ".join(words)))
    return spark.createDataFrame([*rows, (n, None), (n, ""), (None, "w1 w2")], "doc_id long, text string")


def test_scores_are_sums_of_log_probabilities_that_add_up_to_one(spark):
    docs = corpus(spark)
    counts, model = lm.fit(docs)
    assert model.pairs.size > 50 and np.abs(model.pair_weights).max() > 0.3
    known = {r.key & (2**64 - 1): r.n for r in counts.filter(f"kind = {lm.WORD_KIND}").collect()}
    pairs = dict(zip(model.pairs.tolist(), model.pair_weights.tolist()))
    of_class = {}
    for token, n in known.items():
        of_class.setdefault(token >> 58, []).append((token, n))

    def inner(last, token):
        """The probability of a token within its class: all words of the class are gone through."""
        k = token >> 58

        def weight(t, n):
            return (n + lm.SMOOTH) * math.exp(pairs.get((last >> 32) << 32 | t >> 32, 0.0))

        total = sum(weight(t, n) for t, n in of_class.get(k, [])) + lm.SMOOTH
        return (weight(token, known[token]) if token in known else lm.SMOOTH) / total

    def wanted(text):
        out, ids = 0.0, [int(hashed(w.lower())) for w in WORD.findall(text or "")] + [int(lm.END)]
        for i, token in enumerate(ids):
            last = ids[i - 1] if i else int(lm.START)
            tokens, begins = np.array(ids, np.uint64), np.array([0, len(ids)])
            outer = np.exp(lm.log_softmax(model.weights, lm.contexts_of(tokens, begins[:-1])[i : i + 1]))[0]
            assert abs(outer.sum() - 1) < 1e-9
            out += math.log10(outer[token >> 58] * inner(last, token))
        return out

    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = sorted(round(r.score, 6) for r in lm.score(docs, counts, model).collect())
    assert np.allclose(got, sorted(wanted(t) for _, t in texts), atol=1e-5)


def test_held_out_texts_score_above_the_base(spark):
    rows = lm.score_documents(corpus(spark)).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.9


def test_given_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lm.score_documents(docs).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert (sum(r.score for r in rows) - sum(r.base_score for r in rows)) / tokens > 0.02


def test_no_text_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(docs).collect() == []


def test_rare_pairs_count_as_frequent_ones_do(spark, monkeypatch):
    docs = corpus(spark).repartition(3)
    sent = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs).collect())
    for heavy in (1, 40, 400):  # hardly any, some and most words and pairs are frequent
        monkeypatch.setattr(lm, "HEAVY", heavy)
        counts, model = lm.fit(docs)
        learned = counts.filter(f"kind = {lm.PAIR_KIND}")
        assert model.pairs.size < learned.count() == learned.filter("weight is not null and log_z is not null and n > 1").count()
        rows = lm.score(docs, counts, model).collect()
        assert np.allclose(sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows), sent, atol=1e-5)


def test_answers_do_not_multiply_with_partitions(spark, monkeypatch):
    """Sums travel packed: what the texts' questions bring back is no row per text and partition."""
    docs = corpus(spark).repartition(3)
    monkeypatch.setattr(lm, "HEAVY", 1)
    counts, model = lm.fit(docs)
    plain, made = type(docs).mapInArrow, {}

    def counted(self, func, schema, *args, **more):
        rows = made[func.__name__] = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in func(batches):
                rows.add(batch.num_rows)
                yield batch

        return plain(self, run, schema, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    found = {}
    for parts in (4, 48):
        rows = lm.score(docs, counts, dataclasses.replace(model, parts=parts)).collect()
        found[parts] = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
        blocks = -(-len(rows) // 16) + 3  # texts lie together by 16; 3: the last of each input partition
        assert len(rows) < made["answer"].value <= len(rows) + 2 * parts * blocks
    assert np.allclose(found[4], found[48], atol=1e-5)


def test_packed_keys_come_back_whole():
    rng = np.random.default_rng(3)
    for kind in (lm.WORD_KIND, lm.CELL_KIND, lm.PAIR_KIND, lm.ASK_WORD, lm.ASK_PAIR, lm.ASK_WEIGHT):
        keys = np.arange(5000, dtype=np.uint64) if kind == lm.CELL_KIND else rng.integers(0, 2**64, 5000, dtype=np.uint64)
        rows, order = np.sort(rng.integers(0, 2**40, 5000)), np.arange(5000, dtype=np.int32)
        for buckets in (lm.buckets_for(1), lm.buckets_for(700)):
            batch = lm.packed(kind, lm.bucket_of(kind, keys, buckets), buckets, keys, order, rows=rows)
            assert key_bytes(batch) == 7 * keys.size
            got, of_row, at = lm.unpacked_questions([batch], kind)
            assert (got == keys[at]).all() and (of_row == rows[at]).all() and sorted(at) == order.tolist()
    pairs = rng.integers(0, 2**38, 50, dtype=np.uint64).repeat(20) << np.uint64(26) | rng.integers(0, 2**26, 1000, dtype=np.uint64)
    assert len(set(zip(lm.groups_of(pairs), lm.bucket_of(lm.PAIR_KIND, pairs, 1024)))) == 50  # contexts stay whole


def key_bytes(batch):
    return sum(len(x) for x in batch.column("keys").to_pylist())
