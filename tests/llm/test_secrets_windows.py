"""Entropy stretches beside plain windows, and very long candidates."""

import math
import random
import time
from collections import Counter

from marketclime.llm import secrets


def stretches(string, bits, window=secrets.WINDOW):
    out = []
    for i in range(len(string) - window + 1):
        counts = Counter(string[i : i + window])
        if -sum(n / window * math.log2(n / window) for n in counts.values()) >= bits - 1e-9:
            if out and i <= out[-1][1]:
                out[-1][1] = i + window
            else:
                out.append([i, i + window])
    return [tuple(x) for x in out]


def found(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "doc_id long, text string")
    return {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets if s.rank > 2] for r in secrets.find_secrets(df).collect()}


def test_several_stretches_in_a_candidate(spark):
    random.seed(3)
    alphabets = {"entropy_hex": "0123456789abcdef", "entropy_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "entropy_base64": secrets.CLASSES[2].alphabet}
    strings, want = [], {}
    for kind, bits in (("entropy_hex", 3.0), ("entropy_upper", 3.4), ("entropy_base64", 3.6)):
        for _ in range(12):
            s = "7q7Q"[: 1 if kind != "entropy_base64" else 4].replace("q", "f" if kind == "entropy_hex" else "Q" if kind == "entropy_upper" else "q")
            for _ in range(random.randint(1, 5)):
                s += "".join(random.choices(alphabets[kind], k=random.randint(15, 60)))
                s += random.choice("0" if kind != "entropy_base64" else "0aZ") * random.randint(0, 70)
            s += {"entropy_hex": "a1", "entropy_upper": "GZ9", "entropy_base64": "gZ+9"}[kind]
            want[len(strings)] = [(a, b, kind) for a, b in stretches(s, bits)]
            strings.append(s)
    assert found(spark, strings) == want
    assert any(len(x) > 1 for x in want.values())


def test_more_spans_than_a_short_list_holds(spark):
    random.seed(4)
    blocks = ["".join(random.sample("0123456789abcdefghijklmnopqrstuvwxyzABCDEF", 22)) + "0" * 40 for _ in range(700)]
    one = "".join(blocks)
    many = " ".join(f"q7Zx9Lm2Vt5Rk8Pw3Yb{i:05d}" for i in range(1200))
    got = found(spark, [one, many])
    assert got[0] == [(a, b, "entropy_base64") for a, b in stretches(one, 3.6)] and len(got[0]) > 600
    assert len(got[1]) == 1200 and all(many[a:b].startswith("q7Z") for a, b, _ in got[1])


def test_a_million_characters(spark):
    """Neither separators nor random runs overflow a stack or take the square of their length."""
    random.seed(6)
    letters = secrets.CLASSES[2].alphabet.replace("x", "").replace("X", "")  # "xxxx" is on the allow list
    blob = "".join(random.choices(letters, k=1_000_000))
    texts = ["ab-" * 333_334, "ab-" * 333_334 + "12345678", "ab_cd/" * 170_000 + "!", blob, "token = " + "a" * 1_000_000]
    began = time.time()
    got = found(spark, texts)
    assert time.time() - began < 120
    assert got[0] == [] and got[1] == [] and got[2] == [] and got[4] == []
    assert got[3] == [(a, b, "entropy_base64") for a, b in stretches(blob, 3.6)]


def test_the_allow_list_takes_what_it_took(spark):
    import re

    allow = re.compile(r"^[A-Za-z]+([_/-][A-Za-z]+)*([_/-]?[0-9]{1,8})?$")
    random.seed(8)
    strings = ["".join(random.choices("ab-_/19", weights=[8, 8, 2, 1, 1, 1, 1], k=random.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = df.filter(df.s.rlike(secrets.ALLOW[3])).collect()
    assert Counter(r.s for r in got) == Counter(s for s in strings if allow.search(s))
