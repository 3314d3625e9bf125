"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

One pass gives every document its number of distinct word shingles, a digest of
the set and band keys over its minima. Documents with equal sets are one class
from there on, so groups of copies collapse at once. Classes that meet another
in a band bucket get a signature: the low bits of further minima, packed into
longs. Candidates are classes in one bucket, taken in the first band they share;
their similarity is estimated from bit counts, corrected for chance agreement of
the low bits, and those that come near are confirmed on full sets.

A bucket's pairs are never all formed at once. In each round the next few of
its members, in the order of their digests, are centres and meet the members
behind them. Links found so far are summed up into components, and what lies in
one component already is not compared again, so a bucket of thousands of copies
needs its size in comparisons, not the square. Shingles that only one member
has bound its similarity to all others; members they rule out leave. Rounds go
on until every other pair is either compared or known to be connected, so no
link that matters is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketclime.llm.components import components
from marketclime.llm.columns import shielded
from marketclime.llm.sieve import bitmap, with_maybe
from marketclime.llm.textbytes import (
    SECOND_BASE,
    column_bytes,
    lower_ascii,
    mix,
    slices,
    window_hashes,
    word_hashes,
    word_spans,
)
from marketclime.session import cut_lineage

WORDS = 5
ROWS = 5  # minima a band
MISSES = 1e-6  # share of the pairs just similar enough that no band may find
BITS, LANES = 2, 256  # of the signature; its minima are others than the bands'
PLANE = LANES // 64  # longs that hold one bit of every lane
DEVIATIONS = 5  # of the estimate, by which it may fall short
CENTRES, GROWTH = 1, 16  # centres per bucket in the first round, and their growth


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    factor = random.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return factor, random.integers(0, 1 << 63, count, np.uint64)


def bands_for(percent: int) -> int:
    """The fewest bands that miss a pair of similarity ``percent`` at most once in a million: 24 at 85, 35 at 80."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    missed = 1 - (percent / 100) ** ROWS  # by one band
    return math.ceil(math.log(MISSES) / math.log(missed)) if missed else 1


def band_functions(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash functions of all bands' minima."""
    return _functions(bands_for(percent) * ROWS, 20)


LANE_FUNCTIONS = _functions(LANES, 21)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles; fewer words are one shingle, none an empty set."""
    data = lower_ascii(data)
    starts, ends, places = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, n)
    for first, last in zip(places[:-1], places[1:], strict=True):
        if last - first >= n:
            yield np.unique(windows[first : last - n + 1])
        elif last > first:
            yield window_hashes(words[first:last], int(last - first)) + np.uint64(last - first)
        else:
            yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    factor, offset = functions
    out = np.full(factor.size, (1 << 32) - 1, np.uint64)
    for first in range(0, shingles.size, 1024):
        part = shingles[first : first + 1024]
        hashed = part[None, :] * factor[:, None]
        hashed += offset[:, None]
        hashed >>= np.uint64(32)
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key per band; equal minima in a band give equal keys, different bands different ones."""
    low = low.reshape(-1, ROWS)
    out = np.arange(1, low.shape[0] + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(SECOND_BASE) + low[:, k])
    return out.view(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of the lanes' minima, packed into longs: all lanes' lowest bits, then all their next."""
    low = minima(shingles, LANE_FUNCTIONS)
    planes = [(low >> np.uint64(p)) & np.uint64(1) for p in range(BITS)]
    return np.packbits(np.concatenate(planes).astype(np.uint8)).view(">i8").astype(np.int64)


def _differing(a: Column, b: Column) -> Column:
    """How many lanes differ in their low bits: planes are XORed, ORed together, and counted."""
    total = F.lit(0)
    for word in range(PLANE):
        differ = [F.get(a, i).bitwiseXOR(F.get(b, i)) for i in range(word, BITS * PLANE, PLANE)]
        total = total + F.bit_count(reduce(Column.bitwiseOR, differ))
    return total


def estimated_similarity(a: Column, b: Column) -> Column:
    """Similarity of two signatures, corrected for lanes that agree by chance."""
    chance = 2.0**-BITS
    agree = 1 - _differing(a, b) / LANES
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate that a pair of similarity ``percent`` falls below by chance only ``DEVIATIONS`` deviations off."""
    chance = 2.0**-BITS
    agree = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - DEVIATIONS * math.sqrt(agree * (1 - agree) / LANES) / (1 - chance) - 1e-9


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("class", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sign_documents(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class and bands per row; the last two are null for empty sets."""
    functions = band_functions(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, classes, bands = [], [], []
                for s in shingle_sets(*column_bytes(part.column("text"))):
                    sizes.append(s.size)
                    classes.append(_class_of(s) if s.size else None)
                    bands.append(band_keys(minima(s, functions)) if s.size else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    SIGNED.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SIGNED)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, packed shingle set and signature of every text whose key is in ``wanted``, which has no blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(*column_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_class_of(s) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([signature(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["class", "shingles", "signature"],
                )

    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text")
    texts = with_maybe(keyed, F.col("text_key"), bitmap(wanted, "text_key")).filter("_maybe").drop("_maybe")
    texts = texts.join(wanted, "text_key", "left_semi")
    sets = texts.mapInArrow(run, "class binary, shingles binary, signature array<long>")
    return sets.groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("signature").alias("signature"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``100 * common >= percent * union``."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * common >= percent * (x.size + y.size - common))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _short(key: Column) -> Column:
    """The high half of a band key."""
    return F.shiftright(key, 32).cast("int")


def _candidates(live: DataFrame, centres: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the first ``centres`` members of every bucket with the members behind them, where a link is possible.

    ``live``: bucket, class, component, n (set size), common (at most so many
    shingles in any other set), signature, bands. Members go by the number of
    shingles nobody else has, so the first is nearest to what the bucket shares.
    Pairs that cannot reach ``percent``, that are connected, or that meet in an
    earlier band's bucket too do not leave the join. The earlier bucket stays
    open until the pair is compared there or connected.
    """
    live = live.withColumn("place", F.struct((F.col("n") - F.col("common")).alias("alone"), "class"))
    first = live.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("place")))
    first = first.filter(F.col("rank") <= centres)
    named = ("class", "component", "place", "n", "common", "signature", "bands")
    one = first.select("bucket", *[F.col(c).alias(f"{c}_a") for c in named])
    two = live.select("bucket", *[F.col(c).alias(f"{c}_b") for c in named])
    # no more in common than the smaller set, and than either has in common with anyone
    most = F.least("n_a", "n_b", "common_a", "common_b")
    possible = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    near = estimated_similarity(F.col("signature_a"), F.col("signature_b")) >= least_estimate(percent)
    apart = (F.col("component_a") != F.col("component_b")) & (F.col("place_b") > F.col("place_a"))
    here = F.get(F.array_intersect("bands_a", "bands_b"), F.lit(0)) == _short(one["bucket"])
    met = one.join(two, (one["bucket"] == two["bucket"]) & apart & possible & near & here)
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _alone(sets: DataFrame, live: DataFrame) -> DataFrame:
    """class and alone: how many of its shingles no other class in ``live`` has; classes with none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column("class"), batch.column("shingles"), strict=True):
                shingles = np.frombuffer(packed.as_buffer(), np.int64)
                names = pa.array([name.as_py()], pa.binary()).take(pa.array(np.zeros(shingles.size, np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array(shingles)], ["class", "shingle"])

    own = sets.join(live.select("class").distinct(), "class", "left_semi").select("class", "shingles")
    rows = own.mapInArrow(run, "class binary, shingle long")
    once = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("class").alias("class")).filter("sets = 1")
    return once.groupBy("class").agg(F.count(F.lit(1)).alias("alone"))


def _still_open(live: DataFrame, centres: int) -> DataFrame:
    """The buckets with members in different components that not all have been centres."""
    state = live.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("left")
    )
    state = state.filter((F.col("low") != F.col("high")) & (F.col("left") > centres + 1)).select("bucket")
    return live.join(cut_lineage(state, "open"), "bucket", "left_semi")


def _order() -> Column:
    """What the rows of a component go by: ids before nulls, then the key of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept and stays per row of ``docs`` (doc_id, text).

    Words are maximal runs without space or 0x09-0x0D, A-Z lower-cased. Two
    documents are linked where their sets of 5-word shingles (fewer words: the
    whole sequence) have a Jaccard similarity of ``percent`` or more.
    component_id is the smallest doc_id reachable, and ``kept`` marks its rows.
    Null and blank texts are linked with nothing and kept. Null ids have the
    component's smallest id; a component without any id keeps its rows.
    ``stays`` marks the one document of each component that has the smallest id
    and text key, ids before nulls, with all its copies; and blank texts.
    """
    signed = cut_lineage(sign_documents(docs, percent), "signatures")
    classes = signed.filter(F.col("class").isNotNull()).groupBy("class")
    classes = classes.agg(
        F.min(_order()).alias("first_row"),
        F.min("text_key").alias("text_key"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    classes = cut_lineage(classes, "classes")
    banded = classes.select("class", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    shared = cut_lineage(shared, "shared")  # so that the join is of plain exchanges, which Spark can split
    members = cut_lineage(banded.join(shared, "bucket").select("bucket", "class"), "buckets")
    met = cut_lineage(members.select("class").distinct(), "met")
    sets = classes.join(met, "class").select("text_key").distinct()
    sets = cut_lineage(_full_sets(docs, cut_lineage(sets, "candidates")), "sets")
    # halves of the band keys tell the first band that two classes share
    short = F.transform("bands", _short).alias("bands")
    lanes = classes.join(met, "class").select("class", F.col("n_shingles").alias("n"), short)
    lanes = lanes.join(sets.select("class", "signature"), "class")
    members = members.join(cut_lineage(lanes, "lanes"), "class")
    members = members.select("bucket", "class", "n", "signature", "bands")

    labels, centres = None, CENTRES
    live = members.select("*", F.col("class").alias("component"), F.col("n").alias("common"))
    while True:
        pairs = cut_lineage(_candidates(live, centres, percent), "pairs")
        found = cut_lineage(_confirmed(pairs, sets, percent), "found")
        if labels is None or not found.isEmpty():
            if labels is not None:  # links found before count through their component
                found = found.union(labels.filter(F.col("class") != F.col("component")).select("class", "component"))
            labels = cut_lineage(components(found).select(F.col("node").alias("class"), "component"), "labels")
            live = live.drop("component").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
        live = cut_lineage(_still_open(live, centres), "live")
        if live.isEmpty():
            break
        # a set with many shingles of its own cannot be near any other: such members leave
        live = live.drop("common").join(_alone(sets, live), "class", "left")
        live = live.withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
        smallest = live.groupBy("bucket").agg(F.min("n").alias("smallest"))
        live = live.join(smallest, "bucket")
        hopeful = 100 * F.col("common") >= percent * (
            F.col("n") + F.greatest("smallest", "common") - F.col("common")
        )
        live = cut_lineage(live.filter(hopeful).drop("smallest"), "hopeful")
        centres *= GROWTH

    placed = classes.select("class", "first_row").join(labels, "class", "left")
    placed = placed.select("class", "first_row", F.coalesce("component", "class").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first_row").alias("least"))
    ids = cut_lineage(placed.join(smallest, "component").select("class", "least"), "component-ids")
    out = signed.select("doc_id", "text_key", "n_shingles", "class").join(ids, "class", "left")
    component_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component_id.alias("component_id"),
        F.col("doc_id").eqNullSafe(component_id).alias("kept"),
        (F.col("class").isNull() | (_order() == F.col("least"))).alias("stays"),
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``: the smallest doc_id's; blank texts all stay.

    Rows that go are told by id and text. Of rows equal in both one stays, and
    of texts that share the smallest id, or have none, that of the smallest key.
    """
    found = near_duplicates(docs.select("doc_id", "text"), percent)
    named = F.struct(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    gone = found.filter(~F.col("stays")).select(named.alias("_gone")).distinct()
    again = found.filter(F.col("stays") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_key").count().filter("count > 1")
    gone = cut_lineage(gone.select("_gone._id", "_gone._key"), "gone")
    again = cut_lineage(again.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "again")
    key = F.xxhash64("text")

    def chosen(rows: DataFrame) -> DataFrame:
        # only rows that may have to go are shuffled to meet the list
        sieved = with_maybe(rows, key, bitmap(gone, "_key"))
        doubtful = sieved.filter("_maybe").drop("_maybe")
        meets = [doubtful["doc_id"].eqNullSafe(gone["_id"]), key == gone["_key"]]
        once = sieved.filter("not _maybe").drop("_maybe").union(doubtful.join(gone, meets, "left_anti"))
        if again.isEmpty():
            return once
        repeats = [once["doc_id"].eqNullSafe(again["_id"]), key == again["_key"]]
        single = once.join(again, repeats, "left_semi").dropDuplicates(["doc_id", "text"])
        return once.join(again, repeats, "left_anti").union(single)

    return shielded(docs, ("doc_id", "text"), chosen)
