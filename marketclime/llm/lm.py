"""Language-model scores: unigram base and a hashed maximum-entropy model.

The model factors a token into its class and the token within its class.
Classes are hash classes, so every word, seen or not, has one and no table of
classes is needed. The class is predicted by a softmax over hashed features of
the two tokens before it: the last (n-gram), the one before (skip), both
together, and a bias.

Within a class a second softmax has a bias per token, its smoothed relative
frequency, and a weight per hashed pair of the last token and the token. Every
pair seen ``FEATURE_LEAST`` times is a feature. As all other weights are zero,
the normaliser of a context is one plus a sum over that context's pairs, so no
pass over the class's words is needed. Both softmaxes have a Gaussian prior, so
that contexts seen rarely stay near the bias.

Training reads all training texts once: counts of words, of token pairs and of
(context buckets, class) are summed up in numpy per task and then by Spark. The
gradient of the class model depends on the texts only through the latter, so
every update is a distributed pass over that table, whose size is fixed by the
number of buckets. Pair weights of one context and class depend on no others, so
each task updates its own contexts. Words are told by 64-bit hashes, words in
pairs by 32 bits. Frequent words and pairs (at least one in ``HEAVY``, so no more
than that many) are sent to the scoring tasks; for all others the tasks ask, and
questions meet counts and weights by a shuffle, in which no word or pair is
frequent. Counts and questions travel packed, a row per bucket of hashes with
many keys in it; buckets hold whole contexts, and their number follows the texts.
What a task finds for a text is added up there, and these sums travel packed as
well, a row per bucket of texts: their number never passes that of the questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.llm.tally import Tally, added
from marketclime.llm.textbytes import column_bytes, lower_ascii, mix, slices, word_hashes, word_spans
from marketclime.session import cut_lineage

CLASSES, LAST, SKIP, PAIRS = 64, 256, 32, 2048  # buckets; powers of two
CONTEXTS = LAST * SKIP
HEAVY = 1 << 20
SMOOTH = 0.1  # fixed value of the base score
EPOCHS, RATE = 16, 0.25  # four features are active at once, so a quarter of a full step each
PRIOR = 4.0  # of class weights: as many tokens as speak for a weight of zero
FEATURE_LEAST, PAIR_PRIOR, PAIR_EPOCHS = 2, 2.0, 24
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # stand for hashes
WORD_KIND, CELL_KIND, PAIR_KIND = 0, 1, 2
DOC, ASK_WORD, ASK_PAIR, ASK_WEIGHT = 3, 4, 5, 6  # kinds of rows while scoring; a weight alone: the normaliser is known
SUM_WORDS, SUM_PAIRS = 7, 8  # what a task's words and pairs add to the texts that asked
PAIR_KINDS, SUM_KINDS = (PAIR_KIND, ASK_PAIR, ASK_WEIGHT), (SUM_WORDS, SUM_PAIRS)
TABLE = 1 << 20  # distinct words a task holds before it hands them on
PART_BYTES, PARTS_LEAST = 8 << 20, 8  # text per partition, fewest partitions
BUCKETS, BUCKETS_PER_PART = 1024, 2  # a fixed number as long as it gives so many per partition
HELD = 1 << 19  # questions a task holds before it packs them
DOC_BITS = 4  # so many texts in a row share a bucket: the steps between them stay short
PACKED = "bucket int, kind int, first_row long, keys binary, a binary, b binary, c binary"
PACKED_NAMES = ["bucket", "kind", "first_row", "keys", "a", "b", "c"]


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is divisible by 10; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(10)) == 0


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts laid end to end, every text with its end token, and the len + 1 places where texts begin."""
    data = lower_ascii(data)
    starts, ends, places = word_spans(data, offsets)
    n = offsets.size - 1
    out = np.full(starts.size + n, END, np.uint64)
    of_word = np.repeat(np.arange(n), np.diff(places))
    out[np.arange(starts.size) + of_word] = word_hashes(data, starts, ends)
    return out, places + np.arange(n + 1)


def class_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(58)).astype(np.int64)


def pairs_of(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The token before and the token, 32 bits of each; the first 38 bits name the context and the class."""
    last = np.empty_like(tokens)
    last[1:] = tokens[:-1]
    last[begins] = START
    return ((last >> np.uint64(32)) << np.uint64(32)) | (tokens >> np.uint64(32))


def groups_of(pairs: np.ndarray) -> np.ndarray:
    """The context and class of each pair."""
    return pairs >> np.uint64(26)


def contexts_of(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The context number of each token from the buckets of the two before it in its text."""
    last, skip = np.empty_like(tokens), np.empty_like(tokens)
    last[1:], skip[2:] = tokens[:-1], tokens[:-2]
    last[begins] = START
    skip[begins] = START
    second = begins[1:] - begins[:-1] > 1 if begins.size > 1 else np.zeros(0, bool)
    # the second token of a text has one token before it
    firsts = begins[np.append(second, tokens.size - begins[-1] > 1)] if begins.size else begins
    skip[firsts + 1] = START
    a = (last >> np.uint64(40)) & np.uint64(LAST - 1)
    b = (skip >> np.uint64(30)) & np.uint64(SKIP - 1)
    return (a * np.uint64(SKIP) + b).astype(np.int64)


def features_of(contexts: np.ndarray) -> np.ndarray:
    """The numbers of the four features of each context: bias, last, skip, both."""
    a, b = contexts // SKIP, contexts % SKIP
    both = ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) % PAIRS
    return np.stack([np.zeros_like(a), 1 + a, 1 + LAST + b, 1 + LAST + SKIP + both], axis=1)


N_FEATURES = 1 + LAST + SKIP + PAIRS


def log_softmax(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log of the class probabilities, a row per context."""
    logits = weights[features_of(contexts)].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def partitions_for(docs: DataFrame) -> int:
    """As many partitions as keep the packed keys of one at a fixed size."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(PARTS_LEAST, -(-size // PART_BYTES))


def buckets_for(parts: int) -> int:
    """A multiple of 256: a bucket tells one byte of its keys."""
    return max(BUCKETS, -(-BUCKETS_PER_PART * parts // 256) * 256)


def _blend(kind: int, keys: np.ndarray) -> np.ndarray:
    """A byte from the lower seven bytes of each key; of a pair, from its context and class alone."""
    low = keys & np.uint64((1 << 56) - 1)
    return mix(low >> np.uint64(26) if kind in PAIR_KINDS else low) & np.uint64(255)


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; pairs of one context and class lie together. Its low byte is the key's highest, blended."""
    group = groups_of(keys) if kind in PAIR_KINDS else keys
    more = (mix(group) >> np.uint64(8)) % np.uint64(buckets // 256)
    return (more * np.uint64(256) + (keys >> np.uint64(56) ^ _blend(kind, keys))).astype(np.int32)


def packed(kind: int, bucket: np.ndarray, buckets: int, keys: np.ndarray, *values: np.ndarray, rows: np.ndarray | None = None) -> pa.RecordBatch:
    """A row per bucket with the bytes of its keys and values.

    The highest byte of a key is told by its bucket, so seven go along (all
    eight of sums). Ascending ``rows`` go along as steps, in a column for their low byte and
    one for the rest, nearly all zero; the first step of a bucket counts from ``first_row``.
    """
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    found, firsts = np.unique(bucket[order], return_index=True)
    edges = np.append(firsts, keys.size)

    def column(array: np.ndarray) -> pa.Array:
        offsets = (edges * array[:1].nbytes if array.size else edges).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), found.size, [None, pa.py_buffer(offsets), pa.py_buffer(array)])

    base = int(rows[0]) if rows is not None and rows.size else 0
    stored = keys if kind in SUM_KINDS else keys.view(np.uint8).reshape(-1, 8)[:, :7]
    columns = [column(np.ascontiguousarray(v[order])) for v in (stored, *values)]
    if rows is not None:
        steps = np.diff(rows[order], prepend=base)
        steps[firsts] = rows[order][firsts] - base
        columns += [column((steps & 0xFF).astype(np.uint8)), column((steps >> 8).astype(np.int64))]
    columns += [pa.nulls(found.size, pa.binary())] * (4 - len(columns))
    kinds, bases = pa.array(np.full(found.size, kind, np.int32)), pa.array(np.full(found.size, base, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(found), kinds, bases, *columns], PACKED_NAMES)


def _of_kind(batches: list[pa.RecordBatch], kind: int) -> list[pa.RecordBatch]:
    return [b.filter(pc.equal(b.column("kind"), kind)) for b in batches]


def _values(own: list[pa.RecordBatch], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column_bytes(b.column(column))[0].tobytes() for b in own), kind)


def _keys(own: list[pa.RecordBatch], kind: int) -> np.ndarray:
    """The keys of packed rows, whole again."""
    if kind in SUM_KINDS or not own:
        return _values(own, "keys", np.uint64)
    stored = _values(own, "keys", np.uint8).reshape(-1, 7)
    out = np.zeros((len(stored), 8), np.uint8)
    out[:, :7] = stored
    low = out.view(np.uint64).ravel()
    sizes = np.concatenate([pc.binary_length(b.column("keys")).to_numpy(zero_copy_only=False) for b in own]).astype(np.int64) // 7
    bucket = np.concatenate([b.column("bucket").to_numpy() for b in own]).astype(np.uint64)
    top = np.repeat(bucket & np.uint64(255), sizes) ^ _blend(kind, low)
    return top << np.uint64(56) | low


def unpacked(batches: list[pa.RecordBatch], kind: int, *types: type) -> list[np.ndarray]:
    """Keys and values of all packed rows of a kind."""
    own = _of_kind(batches, kind)
    return [_keys(own, kind), *(_values(own, c, t) for c, t in zip(("a", "b"), types))]


def unpacked_questions(batches: list[pa.RecordBatch], kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows and times of all questions of a kind."""
    own = _of_kind(batches, kind)
    ends = np.cumsum(_values(own, "c", np.int64) * 256 + _values(own, "b", np.uint8)) if own else np.zeros(0, np.int64)
    sizes = np.concatenate([pc.binary_length(b.column("b")).to_numpy(zero_copy_only=False) for b in own] or [np.zeros(0)]).astype(np.int64)
    base = np.concatenate([b.column("first_row").to_numpy(zero_copy_only=False) for b in own] or [np.zeros(0, np.int64)])
    before = np.append(0, ends)[np.cumsum(sizes) - sizes]
    return _keys(own, kind), ends + np.repeat(base - before, sizes), _values(own, "a", np.int32)


def corpus_counts(docs: DataFrame, parts: int) -> DataFrame:
    """kind, key, n, total: counts of token hashes, context cells and token pairs over the training texts, written out.

    Pairs are those seen ``FEATURE_LEAST`` times; their ``total`` counts the
    tokens of their context and class, other pairs included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CONTEXTS * CLASSES, np.int64)
        words, pairs = Tally(TABLE), Tally(TABLE)

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            buckets = buckets_for(parts)
            return packed(kind, bucket_of(kind, key, buckets), buckets, key, n)

        for batch in batches:
            for part in slices(batch, "text"):
                tokens, begins = tokens_of(*column_bytes(part.column("text")))
                cell = contexts_of(tokens, begins[:-1]) * CLASSES + class_of(tokens)
                cells += np.bincount(cell, minlength=cells.size)
                for kind, tally, found in ((WORD_KIND, words, tokens), (PAIR_KIND, pairs, pairs_of(tokens, begins[:-1]))):
                    tally.add(*np.unique(found, return_counts=True))
                    if tally.full:
                        yield rows(kind, *tally.take())
        yield rows(WORD_KIND, *words.take())
        yield rows(PAIR_KIND, *pairs.take())
        seen = np.flatnonzero(cells)
        yield rows(CELL_KIND, seen.astype(np.uint64), cells[seen])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        for kind in (WORD_KIND, CELL_KIND, PAIR_KIND):
            key, n = added(*unpacked(got, kind, np.int64))
            total = np.zeros_like(n)
            if kind == PAIR_KIND:
                _, group = np.unique(groups_of(key), return_inverse=True)
                total = np.bincount(group, n).astype(np.int64)[group] if key.size else total
                often = n >= FEATURE_LEAST
                key, n, total = key[often], n[often], total[often]
            for i in range(0, key.size, 1 << 16):
                j = slice(i, i + (1 << 16))
                part = key[j].view(np.int64)
                kinds = pa.array(np.full(part.size, kind, np.int32))
                yield pa.RecordBatch.from_arrays([kinds, pa.array(part), pa.array(n[j]), pa.array(total[j])], ["kind", "key", "n", "total"])

    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    dealt = training.mapInArrow(run, PACKED).repartition(parts, "bucket")
    return cut_lineage(dealt.mapInArrow(merge, "kind int, key long, n long, total long"), "counts")


def train_classes(
    counts: DataFrame, class_tokens: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, parts: int = 8
) -> np.ndarray:
    """Weights of the class softmax, by full-batch gradient updates over the table of context cells.

    Each update divides the gradient by the expected count of its weight, so
    rare features move as fast as frequent ones. All weights but the bias, which
    starts at the classes' frequencies, are drawn to zero by ``PRIOR``. Tasks return sums of fixed size (features times classes), which
    the driver adds up.
    """
    cells = counts.filter(F.col("kind") == CELL_KIND)
    context = F.floor(F.col("key") / CLASSES).cast("long")
    entry = F.struct((F.col("key") % CLASSES).cast("int").alias("k"), "n")
    table = cells.groupBy(context.alias("context")).agg(F.collect_list(entry).alias("cells"))
    table = cut_lineage(table.repartition(parts, "context"), "contexts")
    context_of = table.sparkSession.sparkContext
    weights = np.zeros((N_FEATURES, CLASSES))
    weights[0] = np.log(class_tokens + 1.0)
    prior = np.full((N_FEATURES, 1), PRIOR)
    prior[0] = 0.0
    for _ in range(epochs):
        sent = context_of.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, expected = np.zeros((N_FEATURES, CLASSES)), np.zeros((N_FEATURES, CLASSES))
            for batch in batches:
                contexts = batch.column("context").to_numpy()
                seen = np.zeros((contexts.size, CLASSES))
                lists = batch.column("cells")
                flat = lists.flatten()
                of_row = np.repeat(np.arange(contexts.size), lists.value_lengths().to_numpy())
                seen[of_row, flat.field("k").to_numpy()] = flat.field("n").to_numpy()
                likely = np.exp(log_softmax(sent.value, contexts)) * seen.sum(axis=1, keepdims=True)
                features = features_of(contexts)
                for j in range(features.shape[1]):
                    np.add.at(gradient, features[:, j], seen - likely)
                    np.add.at(expected, features[:, j], likely)
            used = np.flatnonzero(expected.any(axis=1))
            if used.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), *(pa.array([x[u].tobytes() for u in used], pa.binary()) for x in (gradient, expected))],
                    ["feature", "gradient", "expected"],
                )

        gradient, expected = np.zeros_like(weights), np.zeros_like(weights)
        for row in table.mapInArrow(run, "feature long, gradient binary, expected binary").collect():
            gradient[row["feature"]] += np.frombuffer(row["gradient"])
            expected[row["feature"]] += np.frombuffer(row["expected"])
        weights = weights + np.clip(rate * (gradient - prior * weights) / (expected + prior + 1.0), -1.0, 1.0)
        sent.unpersist()
    return weights


def pair_features(counts: DataFrame, tokens: int) -> DataFrame:
    """pair, n, total, mass: all counted pairs; ``mass``: the smoothed count of the words that have the token's 32 bits."""
    pairs = counts.filter(F.col("kind") == PAIR_KIND).select(
        F.col("key").alias("pair"), "n", "total", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("short")
    )
    words = counts.filter(F.col("kind") == WORD_KIND).groupBy(F.shiftrightunsigned("key", 32).alias("short"))
    masses = cut_lineage(words.agg(F.sum(F.col("n") + F.lit(SMOOTH)).alias("mass")), "masses")
    # frequent words, whose pairs are many, are sent; no more than about HEAVY can be
    heavy = F.col("mass") * F.lit(HEAVY) >= F.lit(tokens)
    sent = F.broadcast(masses.filter(heavy))
    met = pairs.join(sent, "short").unionByName(pairs.join(sent, "short", "left_anti").join(masses.filter(~heavy), "short"))
    return met.drop("short")


def train_pairs(features: DataFrame, class_tokens: np.ndarray, class_words: np.ndarray, parts: int = 8) -> DataFrame:
    """pair, n, weight, log_z: weights and the natural log of their contexts' normalisers, by gradient updates, written out.

    A context's pairs meet in one task.
    """
    class_mass = class_tokens + SMOOTH * (class_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        key, n, total, mass = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("pair", "n", "total", "mass"))
        pairs = key.view(np.uint64)
        plain = mass / class_mass[class_of(pairs << np.uint64(32))]
        _, group = np.unique(groups_of(pairs), return_inverse=True)
        weights = np.zeros(pairs.size)

        def normaliser() -> np.ndarray:
            return 1.0 + np.bincount(group, plain * np.expm1(weights))

        for _ in range(PAIR_EPOCHS):
            expected = total * plain * np.exp(weights) / normaliser()[group]
            weights += np.clip((n - expected - PAIR_PRIOR * weights) / (expected + PAIR_PRIOR), -1.0, 1.0)
        logs = np.log(normaliser())[group]
        for i in range(0, pairs.size, 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (key, n, weights.astype(np.float32), logs.astype(np.float32))], ["pair", "n", "weight", "log_z"])

    grouped = features.repartition(parts, F.shiftrightunsigned("pair", 26)).select("pair", "n", "total", "mass")
    return cut_lineage(grouped.mapInArrow(run, "pair long, n long, weight float, log_z float"), "pair-weights")


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted keys (at least one), and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class Model:
    """Everything scoring needs besides the rarer words and pairs; its size is fixed by the constants above."""

    weights: np.ndarray
    class_tokens: np.ndarray  # training tokens per class
    class_words: np.ndarray  # distinct training words per class
    heavy_keys: np.ndarray  # sorted hashes of frequent words
    heavy_counts: np.ndarray
    pairs: np.ndarray  # sorted frequent pairs
    pair_weights: np.ndarray
    groups: np.ndarray  # sorted contexts and classes of the pairs
    group_logs: np.ndarray  # natural logs of their normalisers
    parts: int  # partitions in which questions meet the rarer words and pairs

    def pair_scores(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log of what the context adds to each token within its class, as far as the frequent pairs tell;
        whether the pair is one of them, and whether its context's normaliser is known."""
        out, found, placed = np.zeros(pairs.size), np.zeros(pairs.size, bool), np.zeros(pairs.size, bool)
        if self.pairs.size:
            at, found = looked_up(self.pairs, pairs)
            out = np.where(found, self.pair_weights[at], 0.0)
            at, placed = looked_up(self.groups, groups_of(pairs))
            out -= np.where(placed, self.group_logs[at], 0.0)
        return out, found, placed

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def words(self) -> int:
        return int(self.class_words.sum())


def fit(docs: DataFrame) -> tuple[DataFrame, Model]:
    """The model, learned from the documents that are not held out, and what is joined to texts: kind, key, n,
    and for pairs weight and log_z."""
    parts = partitions_for(docs)
    counts = corpus_counts(docs, parts)
    words = counts.filter(F.col("kind") == WORD_KIND)
    per_class = words.groupBy(F.shiftrightunsigned("key", 58).alias("class")).agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")
    )
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in per_class.collect():
        tokens[row["class"]], distinct[row["class"]] = row["tokens"], row["words"]
    # at most HEAVY words can have so many tokens, nor can more pairs
    frequent = F.col("n") * F.lit(HEAVY) >= F.lit(int(tokens.sum()))
    heavy = words.filter(frequent).select("key", "n").toPandas()
    keys = heavy["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, heavy_counts = keys[order], heavy["n"].to_numpy(np.int64)[order]
    trained = train_pairs(pair_features(counts, int(tokens.sum())), tokens, distinct, parts)
    found = trained.filter(frequent).select("pair", "weight", "log_z").toPandas()
    pairs = found["pair"].to_numpy(np.int64).view(np.uint64)
    by_pair = np.argsort(pairs)
    pairs, weights, logs = pairs[by_pair], found["weight"].to_numpy(float)[by_pair], found["log_z"].to_numpy(float)[by_pair]
    groups, first = np.unique(groups_of(pairs), return_index=True)
    model = Model(
        train_classes(counts, tokens), tokens, distinct, keys, heavy_counts, pairs, weights, groups, logs[first], parts
    )
    plain = counts.filter(F.col("kind") != PAIR_KIND).select("kind", "key", "n")
    learned = trained.select(F.lit(PAIR_KIND).alias("kind"), F.col("pair").alias("key"), "n", "weight", "log_z")
    return plain.unionByName(learned, allowMissingColumns=True), model


ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
ROW_NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty and has its end token; with nothing to learn from
    every probability is one. Repeated rows and ids stay rows of their own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    buckets = buckets_for(model.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        base_log = np.log10(m.tokens + SMOOTH * (m.words + 1))
        class_log = np.log10(m.class_tokens + SMOOTH * (m.class_words + 1))
        heavy_log = np.log10(m.heavy_counts + SMOOTH)
        asks, held = {ASK_WORD: [], ASK_PAIR: [], ASK_WEIGHT: []}, 0  # keys, rows, times

        def packs() -> Iterator[pa.RecordBatch]:
            for kind, parts in asks.items():
                if parts:
                    key, row, times = (np.concatenate(x) for x in zip(*parts))
                    parts.clear()
                    yield _wide(packed(kind, bucket_of(kind, key, buckets), buckets, key, times, rows=row))

        for batch in batches:
            for part in slices(batch, "text"):
                tokens, begins = tokens_of(*column_bytes(part.column("text")))
                n = part.num_rows
                of_doc = np.repeat(np.arange(n), np.diff(begins))
                contexts, row_of = np.unique(contexts_of(tokens, begins[:-1]), return_inverse=True)
                classes = class_of(tokens)
                class_score = log_softmax(m.weights, contexts)[row_of, classes] / np.log(10) - class_log[classes]
                own, place = np.unique(tokens, return_inverse=True)
                at = np.searchsorted(m.heavy_keys, own)
                at[at == m.heavy_keys.size] = 0
                known = m.heavy_keys[at] == own if m.heavy_keys.size else np.zeros(own.size, bool)
                logs = np.where(known, heavy_log[at], 0.0) if m.heavy_keys.size else np.zeros(own.size)
                count_score = logs[place]
                n_tokens = np.diff(begins)
                known_here = np.bincount(of_doc[known[place]], minlength=n)
                shared = np.bincount(of_doc, count_score, n)
                base = shared - n_tokens * base_log
                near, near_of = np.unique(pairs_of(tokens, begins[:-1]), return_inverse=True)
                near_score, near_known, near_placed = m.pair_scores(near)
                scores = shared + np.bincount(of_doc, class_score + near_score[near_of] / np.log(10), n)
                rows = part.column("row").to_numpy()
                yield _wide(
                    _packed_docs(rows, buckets),
                    [
                        pa.array(rows), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens.astype(np.int64)),
                        pa.array(known_here.astype(np.int64)), pa.array(base), pa.array(scores),
                    ],
                )
                kinds = ((ASK_WORD, own, place, ~known), (ASK_PAIR, near, near_of, ~near_known & ~near_placed), (ASK_WEIGHT, near, near_of, ~near_known & near_placed))
                for kind, keys, key_of, asked in kinds:
                    mine = asked[key_of]
                    found, times = np.unique(of_doc[mine].astype(np.int64) * keys.size + key_of[mine], return_counts=True)
                    if found.size:
                        asks[kind].append((keys[found % keys.size], rows[found // keys.size], times.astype(np.int32)))
                        held += found.size
                if held > HELD:
                    yield from packs()
                    held = 0
        yield from packs()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in (WORD_KIND, PAIR_KIND):
                own = batch.filter(pc.equal(batch.column("kind"), kind))
                key = own.column("key").to_numpy().view(np.uint64)
                values = [own.column(c).to_numpy() for c in (("n",) if kind == WORD_KIND else ("weight", "log_z"))]
                if key.size:
                    yield _wide(packed(kind, bucket_of(kind, key, buckets), buckets, key, *values))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            of_docs = batch.filter(pc.equal(batch.column("kind"), DOC))
            yield of_docs
            got.append(batch.select(PACKED_NAMES).filter(pc.not_equal(batch.column("kind"), DOC)))
        keys, n = _ordered(*unpacked(got, WORD_KIND, np.int64))
        wanted, rows, times = unpacked_questions(got, ASK_WORD)
        at, there = looked_up(keys, wanted) if keys.size else (np.zeros(wanted.size, int), np.zeros(wanted.size, bool))
        c = np.where(there, n[at], 0) if keys.size else np.zeros(wanted.size)
        yield _packed_sums(SUM_WORDS, rows, times * np.log10(c + SMOOTH), there * times, buckets)
        keys, weights, logs = _ordered(*unpacked(got, PAIR_KIND, np.float32, np.float32))
        groups, first = np.unique(groups_of(keys), return_index=True)
        asked = []  # rows, what the pairs add
        for kind in (ASK_PAIR, ASK_WEIGHT):
            wanted, rows, times = unpacked_questions(got, kind)
            if not keys.size:
                continue
            at, there = looked_up(keys, wanted)
            more = np.where(there, weights[at], 0.0)
            if kind == ASK_PAIR:
                at, there = looked_up(groups, groups_of(wanted))
                more = more - np.where(there, logs[first][at], 0.0)
            on = more != 0
            asked.append((rows[on], (times * more)[on]))
        if asked:
            rows, more = (np.concatenate(x) for x in zip(*asked))
            yield _packed_sums(SUM_PAIRS, rows, more, np.zeros(rows.size, int), buckets)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        docs = [b.select(ROW_NAMES) for b in _of_kind(got, DOC)]
        if not sum(b.num_rows for b in docs):
            return
        of_docs = pa.Table.from_batches(docs).sort_by("row")
        row, known, base, scores = (of_docs.column(c).to_numpy() for c in ("row", "n_known", "base", "score"))
        amounts, rows, times = unpacked_questions(got, SUM_WORDS)
        place = np.searchsorted(row, rows)
        words = np.bincount(place, amounts.view(np.float64), row.size)
        known = known + np.bincount(place, times, row.size).astype(np.int64)
        amounts, rows, _ = unpacked_questions(got, SUM_PAIRS)
        pairs = np.bincount(np.searchsorted(row, rows), amounts.view(np.float64), row.size) / np.log(10)
        whole = of_docs.select(ROW_NAMES[:4])
        for name, values in (("n_known", known), ("base", base + words), ("score", scores + words + pairs)):
            whole = whole.append_column(name, pa.array(values))
        yield from whole.combine_chunks().to_batches(max_chunksize=1 << 16)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    wide = f"{PACKED}, {ROWS}"
    # frequent words and pairs are in the model
    rarer = F.col("kind").isin(WORD_KIND, PAIR_KIND) & (F.col("n") * F.lit(HEAVY) < F.lit(model.tokens))
    learned = counts.filter(rarer).select("kind", "key", "n", "weight", "log_z").mapInArrow(pack, wide)
    met = rows.mapInArrow(run, wide).union(learned).repartition(model.parts, "bucket").mapInArrow(answer, wide)
    summed = met.repartition(model.parts, "bucket").mapInArrow(total, ROWS)
    train = F.lit(model.tokens).cast("long").alias("train_tokens")
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", train, F.col("base").alias("base_score"), "score")


def doc_bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each text, by its number."""
    return (mix((rows >> DOC_BITS).astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _packed_sums(kind: int, rows: np.ndarray, amounts: np.ndarray, known: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The sums of each text that asked, packed as questions are: the amount's bits for keys, known words for times."""
    rows, place = np.unique(rows, return_inverse=True)
    sums, known = np.bincount(place, amounts, rows.size), np.bincount(place, known, rows.size)
    return _wide(packed(kind, doc_bucket(rows, buckets), buckets, sums.view(np.uint64), known.astype(np.int32), rows=rows))


def _packed_docs(rows: np.ndarray, buckets: int) -> list[pa.Array]:
    """A row per document, dealt out by its number."""
    bucket = doc_bucket(rows, buckets)
    kinds = pa.array(np.full(rows.size, DOC, np.int32))
    return [pa.array(bucket), kinds, pa.nulls(rows.size, pa.int64()), *[pa.nulls(rows.size, pa.binary())] * 4]


def _wide(first: pa.RecordBatch | list[pa.Array], docs: list[pa.Array] | None = None) -> pa.RecordBatch:
    """Packed rows and rows of documents in one form."""
    first = first.columns if isinstance(first, pa.RecordBatch) else first
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([*first, *(docs or [pa.nulls(len(first[0]), k) for k in kinds])], PACKED_NAMES + ROW_NAMES)


def _ordered(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys)
    return [x[order] for x in (keys, *values)]


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and score all of them."""
    counts, model = fit(docs)
    return score(docs, counts, model)
