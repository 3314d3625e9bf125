"""Ranked lexical search: an index in blocks of documents, searched by MaxScore with pair bounds.

A document's score for an item sums, over the item's terms with repeats, the
term's impact in the document: ``w * ((10**9 * tf) div (1000 * tf + 12 * m))``
in whole numbers. Each block of the index holds the documents of one task's
share and, for the items' terms, posting lists with impacts. For each pair of
terms that an item puts together it also holds the intersection list with the
largest joint impact in the block.

An item's distinct terms are paired in order of weight. The bound of a pair is
what any document of the block can get from both terms: the largest joint
impact, or the largest impact of either alone, instead of the sum of the two
maxima. Pairs are ordered by bound; as long as the bounds of the first ones add
up to less than the threshold (the item's k-th best score so far), a document
that has no other term cannot enter, so their lists are not walked. Documents of
the other lists are scored, and dropped as soon as their score and the bounds
that are left fall short. Bounds are exact maxima and ties are kept, so the
ranking is the exact one.

Thresholds start from the index: where a block's intersection list (or posting
list) has k documents, its k-th joint impact is a score that k documents reach.

Nothing meets by document or term in a shuffle: texts are read once, blocks are
written to the shared folder, and each task hands on k rows per item at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketclime.llm.tally import Tally
from marketclime.llm.textbytes import column_bytes, lower_ascii, slices, word_hashes, word_spans
from marketclime.session import cut_lineage

TOP = 20
BLOCK_ROWS = 1 << 15
BLOCK_POSTINGS = 1 << 21
ITEM_TERMS = 1 << 20  # terms of the items that are searched at once; more go in further rounds
LAST = np.iinfo(np.int64).max

FORWARD = "doc_id long, n long, terms array<int>, tfs array<long>"
# sizes and places are packed 32-bit, impacts 64-bit numbers
BLOCK = (
    "size long, ids binary, nulls binary, terms binary, starts binary, places binary, impacts binary, "
    "pairs binary, pair_starts binary, pair_places binary, pair_most binary, pair_kth binary, term_kth binary"
)


def spaced_terms(data: np.ndarray) -> np.ndarray:
    """Digits, ASCII letters in lower case and bytes from 0x80 on; all else becomes a space."""
    out = lower_ascii(data)
    out[~(((out >= 97) & (out <= 122)) | ((out >= 48) & (out <= 57)) | (out >= 128))] = 32
    return out


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of the texts, and the len + 1 places where a text's terms begin."""
    data, offsets = column_bytes(column)
    data = spaced_terms(data)
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first


@dataclass
class Queries:
    """The items of a round: their distinct terms, and each item's pairs (a second term of -1: none) with repeats."""

    dictionary: np.ndarray  # sorted hashes; a term's number is its place
    items: list[tuple[int, list[tuple[int, int, int, int]]]]  # item number and (term, repeats, term, repeats)
    pairs: np.ndarray  # distinct (smaller term << 32 | larger term), sorted

    @staticmethod
    def pair_key(a: int, b: int) -> int:
        return min(a, b) << 32 | max(a, b)


def _term_rows(items: DataFrame) -> DataFrame:
    """item, term (hash) and repeats, for each item number and distinct term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                terms, first = text_terms(part.column("text"))
                item = np.repeat(part.column("item").to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(terms.view(np.int64))], ["item", "term"])

    every = items.mapInArrow(run, "item long, term long")
    return every.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


def _forward(docs: DataFrame, dictionary: Broadcast) -> DataFrame:
    """Per document: doc_id, number of terms, and numbers and frequencies of the dictionary's terms in it. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for batch in batches:
            for part in slices(batch, "text"):
                terms, first = text_terms(part.column("text"))
                place = np.minimum(np.searchsorted(known, terms), known.size - 1)
                there = np.flatnonzero(known[place] == terms)
                row = np.searchsorted(first, there, "right") - 1
                met, tfs = np.unique(row << 32 | place[there], return_counts=True)
                edges = pa.array(np.searchsorted(met >> 32, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(edges, pa.array((met & 0xFFFFFFFF).astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(tfs.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return cut_lineage(docs.mapInArrow(run, FORWARD), "forward")


def _frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the dictionary stands; at most a number for each term leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            terms, n = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
            tally.add(terms.astype(np.int64), n)
        terms, n = tally.take()
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(n.astype(np.int64))], ["term", "n"])

    table = forward.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of each posting, in 64-bit whole numbers; ``total`` is at least 1 wherever there is a posting."""
    m = 75 + (25 * n * documents) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, values.size - k)[values.size - k]) if values.size >= k else 0


def _index(forward: DataFrame, queries: Broadcast, weight: Broadcast, documents: int, total: int, k: int) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` documents. Written."""

    def block(ids, n, sizes, terms, tfs) -> pa.RecordBatch:
        nulls = np.array([x is None for x in ids], bool)
        ids = np.array([LAST if x is None else x for x in ids], np.int64)
        row = np.repeat(np.arange(ids.size), sizes)
        value = impacts(weight.value[terms], tfs, n[row], documents, max(total, 1))
        order = np.lexsort((row, terms))
        terms, row, value = terms[order], row[order].astype(np.int32), value[order]
        there, starts = np.unique(terms, return_index=True)
        starts = np.append(starts, terms.size)
        at = {int(t): i for i, t in enumerate(there)}
        term_kth = np.array([_kth(value[a:b], k) for a, b in zip(starts[:-1], starts[1:])], np.int64)
        pairs, lists, most, kth = [], [], [], []
        for number, key in enumerate(queries.value.pairs.tolist()):
            i, j = at.get(key >> 32), at.get(key & 0xFFFFFFFF)
            if i is None or j is None:
                continue
            a, b = slice(starts[i], starts[i + 1]), slice(starts[j], starts[j + 1])
            both, x, y = np.intersect1d(row[a], row[b], assume_unique=True, return_indices=True)
            joint = value[a][x] + value[b][y]
            pairs.append(number)
            lists.append(both)
            most.append(int(joint.max()) if joint.size else 0)
            kth.append(_kth(joint, k))
        pair_starts = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([x.size for x in lists], out=pair_starts[1:])
        columns = (
            ids, nulls, there.astype(np.int32), starts.astype(np.int32), row, value,
            np.array(pairs, np.int32), pair_starts.astype(np.int32), np.concatenate(lists) if lists else row[:0],
            np.array(most, np.int64), np.array(kth, np.int64), term_kth,
        )
        packed = [pa.array([c.tobytes()], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([ids.size], pa.int64()), *packed], [f.split()[0] for f in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0

        def ready() -> pa.RecordBatch:
            ids = [i for x in held for i in x.column("doc_id").to_pylist()]
            n = np.concatenate([x.column("n").to_numpy() for x in held])
            sizes = np.concatenate([x.column("terms").value_lengths().to_numpy() for x in held])
            flat = [np.concatenate([x.column(c).flatten().to_numpy() for x in held]) for c in ("terms", "tfs")]
            return block(ids, n, sizes, *flat)

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                held.append(part)
                rows += part.num_rows
                postings += len(part.column("terms").flatten())
                if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
                    yield ready()
                    held, rows, postings = [], 0, 0
        if held:
            yield ready()

    return cut_lineage(forward.filter("n > 0").mapInArrow(run, BLOCK), "index")


class Best:
    """The best documents of an item: score, null id, id."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.scores, self.nulls, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to be looked at."""
        return max(self.floor, int(self.scores[-1]) if self.scores.size == self.k else 1)

    def add(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        if not scores.size:
            return
        if scores.size > 4 * self.k:
            keep = scores >= _kth(scores, self.k)
            scores, nulls, ids = scores[keep], nulls[keep], ids[keep]
        scores, nulls, ids = np.concatenate([self.scores, scores]), np.concatenate([self.nulls, nulls]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.nulls, self.ids = scores[order], nulls[order], ids[order]


class Block:
    """A block of the index in memory."""

    def __init__(self, row: dict):
        def read(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        self.size = row["size"]
        self.ids, self.nulls = read("ids", np.int64), read("nulls", bool)
        self.starts, self.places, self.values = read("starts", np.int32), read("places", np.int32), read("impacts", np.int64)
        self.at = {t: i for i, t in enumerate(read("terms", np.int32).tolist())}
        self.most = np.maximum.reduceat(self.values, self.starts[:-1]) if self.values.size else self.values
        self.pair_at = {p: i for i, p in enumerate(read("pairs", np.int32).tolist())}
        self.pair_starts, self.pair_places = read("pair_starts", np.int32), read("pair_places", np.int32)
        self.pair_most = read("pair_most", np.int64)
        self.scores = np.zeros(self.size, np.int64)

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.places[a:b], self.values[a:b]

    def units(self, pairs: list[tuple[int, int, int, int]], numbers: list[int]) -> list[tuple[int, list[tuple[int, int]], int]]:
        """(bound, [(list, repeats)], pair) of an item's pairs that stand in this block, by bound."""
        out = []
        for (a, x, b, y), number in zip(pairs, numbers):
            i, j = self.at.get(a), self.at.get(b)
            lists = [(t, r) for t, r in ((i, x), (j, y)) if t is not None]
            if len(lists) == 2:
                p = self.pair_at[number]
                one, two = x * int(self.most[i]), y * int(self.most[j])
                joint = 0
                if self.pair_starts[p + 1] > self.pair_starts[p]:
                    joint = min(one + two, int(self.pair_most[p]) + (x - 1) * int(self.most[i]) + (y - 1) * int(self.most[j]))
                out.append((max(one, two, joint), lists, p))
            elif lists:
                out.append((lists[0][1] * int(self.most[lists[0][0]]), lists, -1))
        return sorted(out, key=lambda u: u[0])

    def whole(self, units: list, docs: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        """Scores of ``docs`` (ascending places) from the lists of ``units``, added to ``scores``."""
        scores = np.zeros(docs.size, np.int64) if scores is None else scores
        for _, lists, _ in units:
            for i, repeats in lists:
                places, values = self.postings(i)
                at = np.minimum(np.searchsorted(places, docs), places.size - 1)
                scores += np.where(places[at] == docs, values[at] * repeats, 0)
        return scores

    def search(self, pairs: list, numbers: list[int], best: Best) -> None:
        units = self.units(pairs, numbers)
        bounds = np.cumsum([u[0] for u in units])
        if not units or bounds[-1] < best.least:
            return
        top = max(units, key=lambda u: u[0])
        if top[2] >= 0 and best.scores.size < best.k:  # the strongest pair's documents raise the threshold first
            seed = self.pair_places[self.pair_starts[top[2]] : self.pair_starts[top[2] + 1]][:1024]
            if seed.size >= best.k:
                best.floor = max(best.floor, _kth(self.whole(units, seed), best.k))
        skipped = int(np.searchsorted(bounds, best.least, "left"))  # their bounds add up to less than the threshold
        rest = int(bounds[skipped - 1]) if skipped else 0
        scores = self.scores
        scores[:] = 0
        for _, lists, _ in units[skipped:]:
            for i, repeats in lists:
                places, values = self.postings(i)
                scores[places] += values * repeats
        docs = np.flatnonzero(scores >= max(1, best.least - rest))
        found = scores[docs]
        for n in range(skipped - 1, -1, -1):
            found = self.whole(units[n : n + 1], docs, found)
            enough = found >= best.least - (int(bounds[n - 1]) if n else 0)
            docs, found = docs[enough], found[enough]
            if not docs.size:
                return
        enough = found >= best.least
        docs, found = docs[enough], found[enough]
        best.add(found, self.nulls[docs], self.ids[docs])


def _floors(index: DataFrame, queries: Queries, k: int) -> list[int]:
    """For each item, a score that k documents reach: the largest k-th impact of one of its terms or pairs in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, key, value in (("term", "terms", "term_kth"), ("pair", "pairs", "pair_kth")):
            most: dict[int, int] = {}
            if kind == "term":
                batches = list(batches)
            for batch in batches:
                for keys, values in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
                    for t, v in zip(np.frombuffer(keys, np.int32).tolist(), np.frombuffer(values, np.int64).tolist()):
                        if v > most.get(t, 0):
                            most[t] = v
            columns = [pa.array([kind] * len(most), pa.string()), pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "value"])

    small = index.select("terms", "term_kth", "pairs", "pair_kth")
    best = small.mapInArrow(run, "kind string, key int, value long").groupBy("kind", "key").agg(F.max("value").alias("value"))
    known = {(r.kind, r.key): r.value for r in best.collect()}  # a number for each term and pair of the items at most
    out = []
    for _, pairs in queries.items:
        of = [known.get(("term", t), 0) for a, _, b, _ in pairs for t in (a, b)]
        of += [known.get(("pair", _pair_number(queries, a, b)), 0) for a, _, b, _ in pairs if b >= 0]
        out.append(max(of, default=0))
    return out


def _pair_number(queries: Queries, a: int, b: int) -> int:
    return int(np.searchsorted(queries.pairs, Queries.pair_key(a, b))) if b >= 0 else -1


def _search(index: DataFrame, queries: Broadcast, floors: Broadcast, k: int) -> DataFrame:
    """item, doc_id and score of the best k documents per item and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = queries.value.items
        best = [Best(k, f) for f in floors.value]
        numbers = [[_pair_number(queries.value, a, b) for a, _, b, _ in pairs] for _, pairs in items]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for (_, pairs), number, own in zip(items, numbers, best):
                    block.search(pairs, number, own)
        for (item, _), own in zip(items, best):
            ids = pa.array(own.ids, pa.int64(), mask=own.nulls)
            yield pa.RecordBatch.from_arrays([pa.array([item] * own.ids.size, pa.int64()), ids, pa.array(own.scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _queries(rows: list, weight: dict[int, int] | None, dictionary: np.ndarray) -> Queries:
    """Items with their terms paired by weight, heaviest first (equal weights by term number)."""
    of: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        of.setdefault(r.item, []).append((int(np.searchsorted(dictionary, np.uint64(r.term & (1 << 64) - 1))), r.repeats))
    items, keys = [], set()
    for item in sorted(of):
        terms = sorted(of[item], key=lambda t: (-weight[t[0]], t[0]))
        pairs = [(*terms[i], *terms[i + 1]) if i + 1 < len(terms) else (*terms[i], -1, 0) for i in range(0, len(terms), 2)]
        keys |= {Queries.pair_key(a, b) for a, _, b, _ in pairs if b >= 0}
        items.append((item, pairs))
    return Queries(dictionary, items, np.array(sorted(keys), np.int64))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents (score above 0) of every row of ``items`` (item_id, text).

    ``docs`` needs doc_id and text; other columns are not read. Terms are maximal
    runs of digits, letters A-Z (lower-cased) and characters from U+0080 on;
    terms are told by 64-bit hashes. Null and empty texts have none and are
    counted nowhere. Equal scores go by ascending doc_id, a null id last;
    repeated rows of ``docs`` are ranked each, repeated rows of ``items`` are
    answered each. An item without a term, or whose terms stand in no document,
    gives no row; so does every item over an empty table. Texts are read whole.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = cut_lineage(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    terms = cut_lineage(_term_rows(numbered.select("item", "text")), "item-terms")
    rounds = -(-terms.count() // ITEM_TERMS)
    found = []
    for i in range(rounds):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i).collect()  # some ITEM_TERMS rows
        dictionary = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64))
        forward = _forward(own, spark.sparkContext.broadcast(dictionary))
        n, total = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).head()
        weight = weights(_frequencies(forward, dictionary.size), n)
        queries = _queries(rows, dict(enumerate(weight.tolist())), dictionary)
        shared = spark.sparkContext.broadcast(queries)
        index = _index(forward, shared, spark.sparkContext.broadcast(weight), n, total or 0, k)
        found.append(_search(index, shared, spark.sparkContext.broadcast(_floors(index, queries, k)), k))
    if not found:
        found = [spark.createDataFrame([], "item long, doc_id long, score long")]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # k rows of each item and task: thinned out by parts of the tasks first, then as a whole
    dealt = every.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    thin = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
