"""Language ID by language-bitmask n-gram filters.

Each learned language has a Bloom filter of the byte n-grams that are common in
it, and the filters are bit-sliced: one array holds, for every Bloom position,
a mask with a bit per language. The bitwise AND of the masks at an n-gram's
positions is the set of all languages that contain it. A text's n-grams give a
popcount per language; the count expected from false positives alone is taken
off, and the language whose corrected share is largest against the share that
its own learning texts have decides.

An n-gram is in a language's filter if its share of all the language's n-grams
of that length is at least ``LEAST_SHARE`` and at least ``1 / RATIO`` of its
share in any other language. So a filter holds at most ``1 / LEAST_SHARE``
n-grams of each length, whatever the size of the corpus, and the broadcast
array has a proven bound: 2**22 positions for each 64 languages.

Words are runs of letters A-Z (in lower case) and bytes from 0x80 on; n-grams
lie inside a word and its two boundary spaces. They are packed, not hashed, so
counts are exact. Each distinct word of a slice is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.llm.tally import Tally, added
from marketclime.llm.textbytes import column_bytes, lower_ascii, mix, slices, word_hashes, word_spans
from marketclime.session import cut_lineage

ORDERS = (2, 3, 4)
LEAST_SHARE = 2.0**-16
RATIO = 4.0
HASHES = 4
BITS_PER_KEY = 10
MAX_LANGUAGES = 512  # 256 MB of masks at most; more distinct values are no language codes
UNKNOWN = "und"

GRAMS = "lang string, gram long, n long"


def spaced(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case and bytes from 0x80 on; all else becomes a space."""
    out = lower_ascii(data)
    out[~(((out >= 97) & (out <= 122)) | (out >= 128))] = 32
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, each between two spaces in one array, their len + 1 offsets there, and the number of every word."""
    _, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends[first] - starts[first]
    offsets = np.zeros(first.size + 1, np.int64)
    np.cumsum(sizes + 2, out=offsets[1:])
    out = np.full(int(offsets[-1]), 32, np.uint8)
    inside = np.arange(int(sizes.sum()), dtype=np.int64)
    word = np.repeat(np.arange(first.size), sizes)
    inside -= np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[offsets[:-1][word] + 1 + inside] = data[starts[first][word] + inside]
    return out, offsets, inverse


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of spaced words as packed numbers (length in the top byte), and the word each lies in; by word within a length."""
    grams, words = [], []
    word = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    wide = data.astype(np.uint64)
    for n in ORDERS:
        if data.size < n:
            continue
        packed = np.full(data.size - n + 1, n, np.uint64)
        for k in range(n):
            packed = packed << np.uint64(8) | wide[k : data.size - n + 1 + k]
        inside = word[: packed.size] == word[n - 1 :]
        grams.append(packed[inside])
        words.append(word[: packed.size][inside])
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(words)


def gram_counts(learn: DataFrame) -> DataFrame:
    """lang, gram and n over all rows of ``learn`` (lang, text)."""

    def rows(tallies: dict[str, Tally]) -> Iterator[pa.RecordBatch]:
        for lang, tally in tallies.items():
            keys, counts = tally.take()
            if keys.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * keys.size, pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                codes = part.column("lang").dictionary_encode()
                names, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
                data, offsets = column_bytes(part.column("text"))
                data = spaced(data)
                starts, ends, first = word_spans(data, offsets)
                if not starts.size:
                    continue
                words, edges, number = distinct_words(data, starts, ends)
                grams, word = word_grams(words, edges)
                spoken = np.repeat(lang, np.diff(first))
                for code, name in enumerate(names):
                    often = np.bincount(number[spoken == code], minlength=edges.size - 1)
                    there = often[word] > 0
                    tallies.setdefault(name, Tally()).add(*added(grams[there], often[word[there]]))
            if sum(t.size for t in tallies.values()) > 1 << 20:
                yield from rows(tallies)
        yield from rows(tallies)

    counted = learn.select("lang", "text").mapInArrow(run, GRAMS)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _places(grams: np.ndarray, positions: int) -> Iterator[np.ndarray]:
    """The Bloom positions of n-grams, one array for each hash; ``positions`` is a power of two."""
    h = mix(grams)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield (h + np.uint64(k) * step) & np.uint64(positions - 1)


class Filters:
    """Bit-sliced Bloom filters: ``masks[w][p]`` has a bit for each of the 64 languages from 64 * w on."""

    def __init__(self, languages: list[str], masks: np.ndarray, coverage: np.ndarray, common: int):
        self.languages, self.coverage, self.common = languages, coverage, common
        fill = []
        for i in range(len(languages)):
            fill.append(np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / masks.shape[1])
        self.false = np.minimum(np.asarray(fill) ** HASHES, 0.999)  # chance that a strange n-gram is found
        width = len(languages)
        small = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
        self.masks = masks.astype(small)

    def found(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each 64 languages, the mask of those that contain each n-gram."""
        places = list(_places(grams, self.masks.shape[1]))
        out = []
        for row in self.masks:
            mask = row[places[0]]
            for p in places[1:]:
                mask &= row[p]
            out.append(mask)
        return out

    def decide(self, hits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score for rows of hits per language among ``sizes`` n-grams."""
        n = sizes[:, None].astype(float)
        corrected = np.maximum(hits - n * self.false, 0) / (1 - self.false)
        share = corrected / np.maximum(n, 1) / self.coverage
        best = np.argmax(share, axis=1)
        total = share.sum(axis=1)
        score = np.where(total > 0, share[np.arange(best.size), best] / np.where(total > 0, total, 1), 0.0)
        return np.where(total > 0, best, self.common), np.clip(score, 0, 1)


def learn_filters(learn: DataFrame) -> Filters | None:
    """Filters from all rows of ``learn`` (lang, text; neither null); None where there is nothing to learn from.

    Languages with a blank text only have no n-grams and are not learned.
    Memory on the driver: the masks and at most three shares per language.
    """
    counts = cut_lineage(gram_counts(learn), "grams")
    order = F.shiftrightunsigned("gram", 8 * 4)
    for n in reversed(ORDERS[:-1]):
        order = F.when(F.col("gram") < (n + 1) << 8 * n, n).otherwise(order)
    counts = counts.withColumn("order", order.cast("int"))
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    languages = [r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages")
    if not languages:
        return None
    languages.sort()
    shares = counts.join(totals, ["lang", "order"]).withColumn("share", F.col("n") / F.col("total"))
    # at most one entry for each language
    met = shares.groupBy("gram", "order").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("of"))
    kept = F.filter("of", lambda x: (x["share"] >= LEAST_SHARE) & (x["share"] * RATIO >= F.col("most")))
    chosen = cut_lineage(met.select("gram", "order", F.explode(kept).alias("of")).select("gram", "order", "of.*"), "kept-grams")
    sums = {r.lang: (r.keys, r.share) for r in chosen.groupBy("lang").agg(F.count("*").alias("keys"), F.sum("share").alias("share")).collect()}
    common = max(totals.groupBy("lang").agg(F.sum("total").alias("n")).collect(), key=lambda r: (r.n, r.lang)).lang
    keys = max(k for k, _ in sums.values())
    positions = 1 << max(10, (keys * BITS_PER_KEY - 1).bit_length())

    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            own = np.array([number[x] for x in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy(zero_copy_only=False)]
            mask = np.uint64(1) << (own % 64).astype(np.uint64)
            for places in _places(batch.column("gram").to_numpy().view(np.uint64), positions):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own // 64), pa.array(places.view(np.int64)), pa.array(mask.view(np.int64))], ["word", "place", "mask"]
                )

    bits = chosen.select("lang", "gram").mapInArrow(run, "word long, place long, mask long")
    table = bits.groupBy("word", "place").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(((len(languages) + 63) // 64, positions), np.uint64)
    word, place, mask = (table.column(c).to_numpy() for c in ("word", "place", "mask"))
    masks[word, place] = mask.view(np.uint64)
    # mean over the lengths; a language without an n-gram that is common enough keeps a coverage of 1
    coverage = np.array([max(sums[x][1] / len(ORDERS), 1e-6) if x in sums else 1.0 for x in languages])
    return Filters(languages, masks, coverage, number[common])


def predict(docs: DataFrame, filters: Filters | None, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``into`` (a learned language or ``und``) and ``score`` (0 to 1) to every row; other columns stay.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Equal shares go to the language that sorts first; a text none of
    whose n-grams is known gets the language with most learned n-grams, score 0.
    Very long texts are read whole. Columns already named so are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kept = [c for c in docs.columns if c not in (into, score)]
    place = kept.index(text)
    rows = docs.select(*[docs[f"`{c}`"] for c in kept])
    out = rows.withColumn(into, F.lit("")).withColumn(score, F.lit(0.0)).schema
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(place)):
                texts = part.column(place)
                data, offsets = column_bytes(texts)
                lettered = np.array([bool(t) and letter.search(t) is not None for t in texts.to_pylist()], bool)
                names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if model is not None and lettered.any():
                    best, sure = model.decide(*_hits(model, spaced(data), offsets))
                    names[lettered] = np.array(model.languages, object)[best[lettered]]
                    scores[lettered] = sure[lettered]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], out.names)

    return rows.mapInArrow(run, out)


def _hits(model: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits per text and language, and n-grams per text."""
    texts = offsets.size - 1
    starts, ends, first = word_spans(data, offsets)
    words, edges, number = distinct_words(data, starts, ends)
    grams, word = word_grams(words, edges)
    masks, distinct = model.found(grams), edges.size - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    hits = np.zeros((texts, len(model.languages)), np.int64)
    for i in range(len(model.languages)):
        mask = masks[i // 64]
        own = np.bincount(word[(mask >> mask.dtype.type(i % 64) & mask.dtype.type(1)).astype(bool)], minlength=distinct)
        hits[:, i] = np.bincount(text, own[number], texts)
    return hits, np.bincount(text, np.bincount(word, minlength=distinct)[number], texts).astype(np.int64)


def held_out(doc_id: Column, every: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``every``; a null id counts as an empty text (and so is held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % every == 0


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from the rows that are not held out and have a text and a language;
    lang and doc_id take no part in a prediction. Repeated rows count as often
    as they stand; an empty table gives an empty result.
    """
    own = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    learn = own.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    filters = learn_filters(learn.select("lang", "text"))
    return predict(own.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
