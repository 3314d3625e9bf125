"""Removal of byte strings that occur more than once in a corpus, by suffix arrays over meeting places.

Every window of ``length`` bytes has a representative: the gram with the
smallest hash in it (the leftmost of equals). Equal windows have equal
representatives, so they can meet by its hash. Windows that follow each other
with the same representative form a segment. Grams that occur once drop out
after a count; equal segments are counted as one, so groups of copies collapse
before any bytes move.

What is left are different segments with a common gram. Their bytes are laid
end to end, and repeats among them are found on the Burrows-Wheeler transform:
breadth-first backward extension of intervals derives the longest common
prefixes by increasing value and stops at ``length``; neighbours in suffix
order without a value share a whole window. A gram with very many different
segments is not laid into one array: its windows are counted by digest instead,
with map-side sums.

Keys and hashes only decide what meets; 64-bit hashes of segments and grams
(together 128 bits) stand for their bytes where copies collapse.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.llm.textbytes import SECOND_BASE, column_bytes, mix, prefix_sums, slices, span_hashes
from marketclime.session import cut_lineage

LENGTH = 200
GRAM = 64
BLOCK = 1 << 20
CHUNK = 2 << 20  # bytes laid end to end for one suffix array, and a last group
CROWDED = 4096  # different segments of a gram beyond which windows are counted by digest


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: out.size - rest], out[rest:]) if rest else out


def segments(
    data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (text, start, windows, gram hash, segment hash): text number, first window within it, and how many."""
    for first in range(0, max(0, data.size - length + 1), BLOCK):
        part = data[first : first + BLOCK + length - 1]
        count = part.size - length + 1
        sums, others = prefix_sums(part), prefix_sums(part, SECOND_BASE)
        places = np.arange(part.size - gram + 1)
        hashes = mix(span_hashes(sums, places, places + gram))
        order = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
        least = (_sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(first, first + count), "right") - 1
        valid = np.arange(first, first + count) + length <= offsets[np.minimum(text + 1, offsets.size - 1)]
        breaks = np.ones(count + 1, bool)
        breaks[1:-1] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        edges = np.flatnonzero(breaks)
        starts, ends = edges[:-1], edges[1:]
        kept = valid[starts]
        starts, ends = starts[kept], ends[kept]
        stops = ends - 1 + length
        own = mix(span_hashes(sums, starts, stops) + mix(span_hashes(others, starts, stops, SECOND_BASE) + stops.astype(np.uint64) - starts.astype(np.uint64)))
        yield text[starts], starts + first - offsets[text[starts]], ends - starts, hashes[least[starts]], own


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes that start there, compared by their first ``depth`` symbols or more."""
    n = symbols.size
    padded = np.append(symbols.astype(np.int64), np.zeros(7, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    reach = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank_of = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if reach >= depth or rank_of[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = rank_of + 1
        after = np.zeros(n, np.int64)
        after[:-reach] = rank[reach:] if reach < n else 0
        key = rank * (n + 1) + after
        reach *= 2


def _widths(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How far it is from each of ``begins`` to the next place with a value, or to the end."""
    n = values.size
    widths = np.ones(begins.size, np.int64)
    open_ones = np.arange(begins.size)
    for _ in range(16 if begins.size < n // 64 else 0):  # few intervals, as a rule short ones
        at = begins[open_ones] + widths[open_ones]
        open_ones = open_ones[(at < n) & (values[np.minimum(at, n - 1)] < 0)]
        if not open_ones.size:
            return widths
        widths[open_ones] += 1
    known = np.append(np.flatnonzero(values >= 0), n)
    return known[np.searchsorted(known, begins, "right")] - begins


def common_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order the common prefix with the one before it, -1 where it is ``length`` or more.

    An interval of the transform holds the suffixes that begin with one string.
    Extending every interval found on one level by each symbol before it gives
    the intervals of strings one longer; an interval that begins where no value
    is set yet begins after a common prefix of just that many symbols.
    """
    n = symbols.size
    before = symbols[order - 1]  # the transform; the first suffix is preceded by the last symbol
    by_symbol = np.argsort(before, kind="stable")
    moved = np.empty(n, np.int64)
    moved[by_symbol] = np.arange(n)
    last = np.full(n, -1, np.int64)  # the place before with the same symbol
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last[by_symbol[1:][same]] = by_symbol[:-1][same]
    out = np.full(n, -1, np.int32)
    firsts = symbols[order]
    fresh = np.append(0, np.flatnonzero(firsts[1:] != firsts[:-1]) + 1)
    out[fresh] = 0
    for level in range(length - 1):
        widths = _widths(out, fresh)
        begins = np.repeat(fresh, widths)
        inside = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths) + begins
        targets = moved[inside[last[inside] < begins]]
        fresh = np.unique(targets[out[targets] < 0])
        if not fresh.size:
            break
        out[fresh] = level + 1
    return out


def repeated_windows(parts: Sequence[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, whether the window at each of its places also starts at another place of any of them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    symbols = np.zeros(int(sizes.sum()) + len(parts) + 1, np.int16)  # 0 ends every string
    begins = np.cumsum(sizes + 1) - sizes - 1
    for p, b in zip(parts, begins, strict=True):
        symbols[b : b + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    order = suffix_order(symbols, length)
    shared = common_prefixes(symbols, order, length) < 0
    again = shared.copy()
    again[:-1] |= shared[1:]
    found = np.zeros(symbols.size, bool)
    found[order] = again
    return [found[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _keyed(docs: DataFrame) -> DataFrame:
    """The text under two hashes that tell it from others (87 bits)."""
    text = F.coalesce("text", F.lit(""))
    check = F.crc32(text).bitwiseAND(0x7FFFFF).cast("long")
    return docs.withColumns({"text": text, "key": F.xxhash64(text), "check": check})


SEGMENT = "gram long, segment long, key long, place long"
# place: 23 bits of check, 8 bits of windows less one, 32 bits of start
FOUND = "key long, check long, start long, stop long"


def _segment_rows(texts: DataFrame, only_grams: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                key, check = part.column("key").to_numpy(), part.column("check").to_numpy()
                for text, start, windows, gram, own in segments(*column_bytes(part.column("text"))):
                    if only_grams:
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])
                        continue
                    place = check[text] << 40 | (windows - 1) << 32 | start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (gram.view(np.int64), own.view(np.int64), key[text], place)],
                        ["gram", "segment", "key", "place"],
                    )

    return texts.select("key", "check", "text").mapInArrow(run, "gram long" if only_grams else SEGMENT)


def _bytes_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the bytes of each row of ``wanted`` (gram, segment, key, place, copies), one text per key."""
    asked = F.struct("gram", "segment", "place", "copies")
    lists = wanted.withColumn("check", F.shiftrightunsigned("place", 40))
    lists = cut_lineage(lists.groupBy("key", "check").agg(F.collect_list(asked).alias("asked")), "asked")
    here = texts.select("key", "check", "text").join(lists.select("key", "check"), ["key", "check"], "left_semi")
    here = here.dropDuplicates(["key", "check"]).join(lists, ["key", "check"])
    names = ["gram", "segment", "key", "place", "copies", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, keys = batch.column("text").cast(pa.binary()), batch.column("asked"), batch.column("key")
            for text, asked, key in zip(texts, lists, keys, strict=True):
                raw, rows = text.as_py(), asked.as_py()
                at = [(r["place"] & 0xFFFFFFFF, (r["place"] >> 32 & 0xFF) + LENGTH) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([r[c] for r in rows], pa.int64()) for c in ("gram", "segment")),
                        pa.array([key.as_py()] * len(rows), pa.int64()),
                        *(pa.array([r[c] for r in rows], pa.int64()) for c in ("place", "copies")),
                        pa.array([raw[s : s + n] for s, n in at], pa.binary()),
                    ],
                    names,
                )

    return here.mapInArrow(run, "gram long, segment long, key long, place long, copies long, bytes binary")


def _by_transform(rows: DataFrame) -> DataFrame:
    """Repeated stretches (key, check, start, stop) of the segments that occur once; all segments of a gram in one array."""

    def judged(held: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([h[2] for h in held])
        out = []
        for (key, place, _, copies), found in zip(held, flags, strict=True):
            if copies == 1 and found.any():
                start, check = place & 0xFFFFFFFF, place >> 40
                out += [(key, check, start + a, start + b - 1 + LENGTH) for a, b in zip(*map(np.ndarray.tolist, _runs(found)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["key", "check", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for gram, key, place, raw, copies in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "place", "bytes", "copies")), strict=True):
                if gram != last and size >= CHUNK:
                    yield judged(held)
                    held, size = [], 0
                held.append((key, place, raw, copies))
                size += len(raw)
                last = gram
        if held:
            yield judged(held)

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, FOUND)


def _by_digest(rows: DataFrame) -> DataFrame:
    """The same for crowded grams: every window by two 64-bit hashes, counted with map-side sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, raw, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "bytes", "copies")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(data.size - LENGTH + 1)
                one = mix(span_hashes(prefix_sums(data), at, at + LENGTH))
                two = mix(span_hashes(prefix_sums(data, SECOND_BASE), at, at + LENGTH, SECOND_BASE))
                n = at.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, key)), pa.array((place & 0xFFFFFFFF) + at), pa.array(np.full(n, place >> 40)), pa.array(np.full(n, copies))],
                    ["one", "two", "key", "start", "check", "copies"],
                )

    windows = rows.mapInArrow(run, "one long, two long, key long, start long, check long, copies long")
    again = windows.groupBy("one", "two").agg(F.sum("copies").alias("times")).filter("times > 1").select("one", "two")
    single = windows.filter("copies = 1").join(again, ["one", "two"], "left_semi")
    return single.select("key", "check", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """key, check and stretches (start, stop in bytes, may overlap) of every text with repeated windows."""
    texts = _keyed(docs.select("text")).filter(F.octet_length("text") >= LENGTH)
    grams = _segment_rows(texts, True).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    grams = cut_lineage(grams, "grams")  # a join of two plain exchanges, whose hot grams Spark can split
    met = cut_lineage(_segment_rows(texts, False).join(grams, "gram", "left_semi"), "segments")
    different = met.groupBy("gram", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "place")).alias("at"))
    different = cut_lineage(different.select("gram", "segment", "copies", "at.key", "at.place"), "different")
    per_gram = different.groupBy("gram").agg(F.count(F.lit(1)).alias("others"), F.min("copies").alias("fewest"))
    unsure = per_gram.filter("others > 1 and fewest = 1").select("gram", "others")
    asked = cut_lineage(different.join(unsure, "gram"), "unsure")
    crowded = asked.filter(F.col("others") > CROWDED).select("gram").distinct()
    rows = _bytes_of(texts, asked.drop("others"))
    if not crowded.isEmpty():
        rows = cut_lineage(rows, "segment-bytes")
        crowded = cut_lineage(crowded, "crowded")
        found = _by_transform(rows.join(crowded, "gram", "left_anti")).union(_by_digest(rows.join(crowded, "gram", "left_semi")))
    else:
        found = _by_transform(rows)
    copied = met.join(different.filter("copies > 1").select("gram", "segment"), ["gram", "segment"], "left_semi")
    start = F.col("place").bitwiseAND(0xFFFFFFFF)
    stop = start + F.shiftrightunsigned("place", 32).bitwiseAND(0xFF) + LENGTH
    copied = copied.select("key", F.shiftrightunsigned("place", 40).alias("check"), start.alias("start"), stop.alias("stop"))
    # copies of one text give equal stretches, so they are summed up first
    stretches = copied.union(found).distinct()
    grouped = stretches.groupBy("key", "check").agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))
    return cut_lineage(grouped, "stretches")


CUT = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, removed (maximal byte runs), kept (the bytes that stay).

    A byte goes where it lies in a string of 200 bytes that also starts at
    another place of the corpus: in another row, or elsewhere in the same text;
    overlapping occurrences count. Null text counts as empty; texts below 200
    bytes stay whole; repeated rows repeat each other.
    """
    found = repeated_stretches(docs)
    rows = _keyed(docs.select(F.col("doc_id").cast("long"), "text")).join(found, ["key", "check"], "left")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                sizes, removed, kept = [], [], []
                for raw, stretches in zip(texts, part.column("stretches"), strict=True):
                    sizes.append(len(raw))
                    gone = []
                    if stretches.is_valid:
                        flat = stretches.values
                        edges = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edges, flat.field("start").to_numpy(), 1)
                        np.add.at(edges, flat.field("stop").to_numpy(), -1)
                        gone = list(zip(*map(np.ndarray.tolist, _runs(np.cumsum(edges[:-1]) > 0)), strict=True))
                    removed.append([{"start": a, "stop": b} for a, b in gone])
                    ends = [0, *(b for _, b in gone)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "removed", "kept"],
                )

    return rows.select("doc_id", "text", "stretches").mapInArrow(run, CUT)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    cut = remove_repeats(docs)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
