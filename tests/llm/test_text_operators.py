"""Small fixtures beside plain Python for the operators on whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from marketclime.llm import chat, contamination, lm, minhash, quality, repeats, secrets, slots, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 97}x{i}" for i in range(400))
    rows = [(i, long[: 900 + 7 * i] + f" tail{i}", "en", "s", 1) for i in range(6)]
    rows += [(10, long, "en", "s", 1), (11, long, "de", None, 1), (10, long, "en", "s", 1)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (None, "few words only", "en", "s", 3), (22, "Few WORDS only", "en", "s", 3)]
    rows += [(30, "x é😀 password = 'abc123456' AKIA" + "A1" * 9 + " " + "0f" * 14 + " token=abc", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def test_secrets_base(docs, texts):
    patterns = [(re.compile(secrets.ASSIGN), "assign"), (re.compile("AKIA[A-Z0-9]+"), "access"), (re.compile("[0-9a-f]+"), "hex")]

    def spans(t):
        out = []
        for rank, (p, kind) in enumerate(patterns):
            for m in p.finditer(t):
                size = len(m[2]) if kind == "assign" else len(m[0])
                if size >= (6, 20, 24)[rank]:
                    out.append((m.start(), rank, m.end(), kind))
        return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))

    got = Counter((r.doc_id, r.base_sha256) for r in secrets.digests(docs).collect())
    assert got == Counter((d, sha(spans(t))) for d, t in texts)


def test_entropy_spans_against_plain_windows(spark):
    strings = ["q7Zx9Lm2Vt5Rk8Pw3Yb6Nc1", "aaaaaaaaaaaaaaaaaaaaaaaa1", "EXAMPLEq7Zx9Lm2Vt5Rk8Pw3Yb6", "0f3a9c1b7e5d2846af03b19c7e"]
    df = spark.createDataFrame([(i, f"é {s} z") for i, s in enumerate(strings)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets if s.rank > 2] for r in secrets.find_secrets(df).collect()}

    def hull(s, bits):
        w = secrets.WINDOW
        good = []
        for i in range(len(s) - w + 1):
            c = Counter(s[i : i + w])
            if -sum(n / w * math.log2(n / w) for n in c.values()) >= bits - 1e-9:
                good.append(i)
        return (good[0] + 2, good[-1] + w + 2) if good else None

    assert found[0] == [(*hull(strings[0], 3.6), "entropy_base64")]
    assert found[1] == [] and found[2] == []
    assert found[3] == [(*hull(strings[3], 3.0), "entropy_hex")]


def test_redaction_masks_overlapping_spans_once(spark):
    df = spark.createDataFrame([(1, "a password=" + "0f" * 14 + " b"), (2, None), (3, "plain")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(df)).collect()}
    assert out == {1: "a [SECRET] b", 2: None, 3: "plain"}


def test_repeats(docs, texts):
    seen = Counter(b[i : i + 200] for _, t in texts for b in [t.encode()] for i in range(len(b) - 199))

    def cut(t):
        b = t.encode()
        gone = set()
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone |= set(range(i, i + 200))
        spans = sum(1 for i in gone if i - 1 not in gone)
        return len(b), len(gone), spans, sha(bytes(c for i, c in enumerate(b) if i not in gone))

    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(docs).collect())
    assert got == Counter((d, *cut(t)) for d, t in texts)


def test_crowded_grams_are_counted_by_digest(docs, monkeypatch):
    whole = sorted(map(repr, repeats.digests(docs).collect()))
    monkeypatch.setattr(repeats, "CROWDED", 1)
    assert sorted(map(repr, repeats.digests(docs).collect())) == whole


@pytest.mark.parametrize("length", [3, 20])
def test_repeated_windows(length):
    parts = [b"abcabcabcabd" * 4, b"xabcabcabcabdy" * 3, b"", b"ab", bytes(range(60))]
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    want = [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]
    assert [f.tolist() for f in repeats.repeated_windows(parts, length)] == want


def test_near_duplicates(docs, texts):
    def shingles(t):
        w = [x.lower() for x in WORD.findall(t)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]

    def least(i):
        return min((d for (d, _), x in zip(texts, label) if x == label[i] and d is not None), default=None)

    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter((d, len(s), least(i)) for i, ((d, _), s) in enumerate(zip(texts, sets)))


def test_leaks(spark, docs):
    items = spark.createDataFrame(
        [(1, " ".join(f"WORD{i % 97}x{i}" for i in range(50, 80))), (2, "too short"), (3, None), (4, "a b c d e f g h")],
        "item_id long, text string",
    )
    found = {(r.doc_id, r.item_id, r.containment) for r in contamination.find_leaks(docs, items).collect()}
    assert found == {(d, 1, 1.0) for d in (0, 1, 2, 3, 4, 5, 10, 11)}
    assert contamination.drop_leaks(docs, items).count() == 5


def test_base_scores(docs, texts):
    def tokens(t):
        return t.encode().lower().split() + [None]

    def out(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0

    c = Counter(w for d, t in texts if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_documents(docs).collect())
    want = [
        (d or -1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))
        for d, t in texts
        for w in [tokens(t)]
    ]
    assert got == sorted(want)


def test_quality_base(docs, texts):
    def stats(t):
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    rows = quality.document_quality(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((d, *stats(t)) for d, t in texts)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in rows)


def test_shards_are_even_and_numbered(docs, tmp_path):
    rows = slots.shard_documents(docs, str(tmp_path / "map"), shards=3).collect()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    weights = {r.virtual_slot: r.size for r in rows}
    old = slots.balance(weights, 3)
    new = slots.rebalance(old, weights, 4)
    assert {new[i] for i in range(slots.SLOTS) if old[i] != new[i]} <= {0, 1, 2, 3}
    assert slots.rebalance(old, weights, 3) == slots.rebalance(slots.rebalance(old, weights, 3), weights, 3)


def test_chats(spark):
    rows = [(1, 1, "assistant", "</s>[INST] \\ ok"), (1, 0, "user", None), (1, None, "odd[AS]", "[TURN]"), (None, 0, None, "x"), (1, 1, "assistant", "</s>[INST] \\ ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    turns = [("odd[AS]", "[TURN]"), ("user", ""), *[("assistant", "</s>[INST] \\ ok")] * 2]
    assert got[1].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
    assert got[1].loss_sha256 == sha("</s>[INST] \\ ok" * 2) and got[None].loss_chars == 0


def test_templates_that_rewrite_history_are_told():
    def forgetful(turns):
        last = len(turns) - 1
        return "".join(f"<{r}>{t if r == 'user' or i == last else '...'}</{r}>" for i, (r, t) in enumerate(turns))

    out, spans, rewrites = chat.locate_turns(forgetful, [("user", "a"), ("bot", "bb"), ("user", "c"), ("bot", "dd")])
    assert rewrites and [out[s.text_start : s.text_end] if s.text_start >= 0 else None for s in spans] == ["a", None, "c", "dd"]
    assert not chat.locate_turns(chat.render_marked, [("user", "a"), ("assistant", "b")])[2]


def test_urls(spark):
    pages = [(1, "HTTP://www.Example.com/en/x"), (2, "http://example.com/en/"), (3, "http://badexample.com"), (4, None), (5, "x"), (5, "a://b.net/es/?q")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rules = urls.rule_table(spark, [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")])
    got = sorted((r.page_id, r.host, r.rule or "", r.verdict) for r in urls.judge_urls(df, rules).collect())
    assert got == [
        (1, "www.example.com", "www.example.com/en/", "allow"),
        (2, "example.com", "example.com/en/", "block"),
        (3, "badexample.com", "", "allow"),
        (4, "", "", "allow"),
        (5, "", "", "allow"),
        (5, "b.net", "net/es/", "block"),
    ]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for run in (secrets.digests, repeats.digests, minhash.near_duplicates, lm.score_documents, quality.document_quality):
        assert run(none).count() == 0
