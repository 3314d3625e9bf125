import zlib
from collections import Counter, defaultdict

import pytest

from marketclime.llm import slots

SCHEMA = "doc_id long, text string, shard string, _key string, _heavy string"


def laid_out(spark, tmp_path, rows, shards=24):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    return slots.shard_documents(docs, str(tmp_path / "map"), shards).collect()


def test_sizes_sums_and_places_against_plain_python(spark, tmp_path):
    texts = [None, "", "a", "ä" * 70, "long " * 4000, *(f"text {i} " * (i % 40) for i in range(1500))]
    rows = [(None if i % 50 == 3 else i, t) for i, t in enumerate(texts)]
    got = laid_out(spark, tmp_path, rows)
    wanted = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == wanted
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(24))


def test_a_third_of_equal_rows_tips_no_shard(spark, tmp_path):
    rows = [(1, "the same text " * 2)] * 4000 + [(i, f"text {i} " * 4) for i in range(8000)]
    got = laid_out(spark, tmp_path, rows)
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert len(got) == 12000 and max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())


def test_the_edited_map_moves_few_rows_and_only_to_even_out(spark, tmp_path):
    got = laid_out(spark, tmp_path, [(i, f"text {i} " * 4) for i in range(6000)])
    loads = Counter()
    for r in got:
        loads[r.next_shard] += r["size"]
    moved = sum(r.shard != r.next_shard for r in got)
    assert set(loads) == set(range(25)) and max(loads.values()) < 1.05 * min(loads.values())
    assert 0.03 < moved / len(got) < 0.08
    with_slot = {(r.virtual_slot, r.shard, r.next_shard) for r in got}
    assert len(with_slot) == len({s for s, _, _ in with_slot})


def test_an_empty_table_and_a_version_that_exists(spark, tmp_path):
    assert laid_out(spark, tmp_path, []) == []
    with pytest.raises(Exception, match="(?i)exists"):
        slots.write_map(spark, str(tmp_path / "map"), 2, [0])
