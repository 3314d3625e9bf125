"""Alignment of two tokenizers, with corpus-wide counts of linked token pairs.

Tokenizer A is byte-level BPE (the tokenizers library), B is sentencepiece BPE
with byte fallback. Their tokens are cut into groups at the byte offsets where
both end; every A token of a group is linked to every B token of it.

Counts of pairs, that is in how many documents a pair is linked, are kept in
dense vectors indexed by minimal perfect hashes of the distinct pairs:

1. every task aligns its documents and hands on its distinct pairs with counts;
2. distinct pairs are dealt into shards of some ``SHARD`` pairs by hash, and a
   perfect hash is built for each shard, in a task of its own;
3. every task turns its partial counts into one vector per shard, and vectors
   are summed as a tree (``FAN`` at a time);
4. documents are aligned a second time and look their pairs up: index by hash,
   stored key compared, count read.

The tables travel to the tasks in passes of at most ``PASS`` pairs (some 13
bytes each), so a broadcast is bounded whatever the corpus; further passes add
to the sums of the ones before.

Between two words that stand apart by one space both tokenizers start anew, so
a text is cut there and each distinct segment of a slice is encoded once, by the
libraries themselves. A segment is never cut elsewhere, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketclime.llm.perfecthash import PerfectHash
from marketclime.llm.tally import Tally, added
from marketclime.llm.textbytes import held, mix, slices
from marketclime.session import cut_lineage

SHARD = 1 << 17
PASS = 1 << 23
FAN = 32
# Fixed value: the pattern that byte-level pre-tokenizers split by.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = regex.compile(r"(?<=\S) (?=\S)")
BLOCK = 1 << 22  # pairs listed at once
SLICE = 2 << 20  # bytes of text aligned at once
KEPT = 1 << 18
ENCODED = 1 << 12  # segments handed to a library as one text

PARTIAL = "pair long, n long"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
SUMS = ("n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(spec: dict, tokens: list[bytes]):
    """A tiktoken encoding that gives the ids of a byte-level BPE vocabulary, or None where its ids are no ranks."""
    import tiktoken

    model, splits = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and splits.get("type") == "ByteLevel" and splits.get("use_regex", True)
    plain = plain and not splits.get("add_prefix_space") and model.get("type") == "BPE"
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    ranks = {tokens[i]: i for i in range(256 + len(merges))}
    if len(ranks) != 256 + len(merges) or any(len(tokens[i]) != 1 for i in range(256)):
        return None
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Both libraries, and the bytes of every id.

    Where a byte-level vocabulary numbers its merges in order, splits by the
    usual pattern and does nothing else, its ids are ranks, and the tiktoken
    library gives the same ids in a quarter of the time; it is then used for A.
    """

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("vocabularies of at most 65,536 entries")
        self.ranked = _ranked(json.loads(a), self.a_bytes)
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.labels = [np.array([b"%d%s" % (i, end) for i in ids], "S6") for end in (b",", b"|", b";")]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, segments: list[str], regular: int) -> tuple[np.ndarray, ...]:
        """The ids of A and of B of all segments, how many each segment has of both, and whether they join to its bytes.

        The first ``regular`` segments have no white space at their edges, so
        many of them are one text to the libraries; each one's ids are told by
        the bytes they cover. Where that fails, and for the other segments, each
        is encoded by itself.
        """
        parts = []
        first = 0
        while first < len(segments):
            last = min(first + ENCODED, regular) if first < regular else len(segments)
            part = segments[first:last]
            parts.append((self._together(part) if first < regular else None) or self._apart(part))
            first = last
        a, b, sizes_a, sizes_b, whole = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 5))
        return a, b, sizes_a, sizes_b, whole.astype(bool)

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + t for t in texts]
        if self.ranked:
            a = [self.ranked.encode_ordinary(t) for t in spaced]
        else:
            a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def _together(self, segments: list[str]) -> tuple[np.ndarray, ...] | None:
        text = " ".join(segments)
        want = b" " + text.encode()
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        ids, counts = [], []
        for own, vocabulary, sizes in zip(self._ids([text]), (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes)):
            if b"".join(map(vocabulary.__getitem__, own[0])) != want:
                return None
            flat = np.array(own[0], np.int64)
            covered = np.cumsum(sizes[flat])
            at = np.searchsorted(covered, ends)
            if (covered[at] != ends).any():
                return None
            ids.append(flat)
            counts.append(np.diff(at, prepend=-1))
        return *ids, *counts, np.ones(len(segments), bool)

    def _apart(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        a, b = self._ids(segments)
        whole = np.ones(len(segments), bool)
        for i, s in enumerate(segments):
            want = b" " + s.encode()
            if b"".join([self.a_bytes[t] for t in a[i]]) != want or b"".join([self.b_bytes[t] for t in b[i]]) != want:
                whole[i], a[i], b[i] = False, [], []
        (flat_a, n_a), (flat_b, n_b) = _flat(a), _flat(b)
        return flat_a, flat_b, n_a, n_b, whole


@dataclass
class Aligned:
    """The alignment of segments: counts per segment, its groups as text, its distinct pairs with how often each is linked."""

    whole: np.ndarray  # whether the tokens' bytes are the segment's
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    first: np.ndarray  # segments + 1 offsets of the pairs below
    pairs: np.ndarray  # A id << 16 | B id
    times: np.ndarray

    def take(self, rows: np.ndarray) -> Aligned:
        sizes = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.first[rows] - first[:-1], sizes) + np.arange(int(first[-1]))
        groups = [self.groups[i] for i in rows.tolist()] if self.groups else []
        numbers = [x[rows] for x in (self.whole, self.n_a, self.n_b, self.n_groups, self.n_links)]
        return Aligned(*numbers, groups, first, self.pairs[at], self.times[at])

    def joined(self, other: Aligned) -> Aligned:
        def both(name: str) -> np.ndarray:
            return np.concatenate([getattr(self, name), getattr(other, name)])

        first = np.concatenate([self.first, self.first[-1] + other.first[1:]])
        numbers = [both(c) for c in ("whole", "n_a", "n_b", "n_groups", "n_links")]
        return Aligned(*numbers, self.groups + other.groups, first, both("pairs"), both("times"))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if values.size else values


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``, of the given sizes."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def align(tokens: Tokenizers, segments: list[str], regular: int, texts: bool) -> Aligned:
    """Encode and align segments, each with a space before it; ``groups`` is left empty where ``texts`` is not set."""
    a, b, n_a, n_b, whole = tokens.encode(segments, regular)
    # both sides cover the same bytes, so one running offset places all segments
    a_end, b_end = np.cumsum(tokens.a_sizes[a]), np.cumsum(tokens.b_sizes[b])
    marks = np.zeros(int(a_end[-1]) + 1 if a.size else 1, np.uint8)
    marks[a_end] = 1
    marks[b_end] += 1
    before = np.cumsum(marks == 2) - (marks == 2)  # ends of both before each byte offset
    a_group, b_group = before[a_end], before[b_end]
    groups = int(np.count_nonzero(marks == 2))
    of_a, of_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    segment = np.repeat(np.arange(len(segments)), n_a)
    group_segment = segment[np.cumsum(of_a) - 1] if groups else np.zeros(0, np.int64)
    n_groups = np.bincount(group_segment, minlength=len(segments))
    links = _sums(of_a * of_b, n_groups)
    return Aligned(
        whole, n_a, n_b, n_groups, links, _texts(tokens, a, b, a_group, b_group, _sums(of_a + of_b, n_groups)) if texts else [],
        *_pairs(a, b, of_a, of_b, group_segment, len(segments)),
    )


def _texts(tokens: Tokenizers, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;...`` of each segment; ``sizes``: its tokens of both kinds."""
    last_a, last_b = np.ones(a.size, bool), np.ones(b.size, bool)
    last_a[:-1] = a_group[1:] != a_group[:-1]
    last_b[:-1] = b_group[1:] != b_group[:-1]
    groups = int(a_group[-1]) + 1 if a.size else 0
    before_b = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=groups))])
    upto_a = np.cumsum(np.bincount(a_group, minlength=groups))
    inner, end_a, end_b = tokens.labels
    out = np.empty(a.size + b.size, inner.dtype)
    out[np.arange(a.size) + before_b[a_group]] = np.where(last_a, end_a[a], inner[a])
    out[np.arange(b.size) + upto_a[b_group]] = np.where(last_b, end_b[b], inner[b])
    written = _sums(np.char.str_len(out), sizes)
    whole = out.tobytes().translate(None, b"\0")
    ends = np.cumsum(written)
    return [whole[i:j][:-1] for i, j in zip((ends - written).tolist(), ends.tolist())]


def _pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, segment: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each segment and how often they are linked; at most ``BLOCK`` links are listed at once."""
    from_a, from_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    product = of_a * of_b
    found = []
    first = 0
    while first < product.size:
        upto = np.cumsum(product[first : first + BLOCK])
        last = first + max(1, int(np.searchsorted(upto, BLOCK, "right")))
        if product[first] > BLOCK:  # a group of its own: its distinct ids, some of A's at a time
            ids, times = np.unique(a[from_a[first] : from_a[first] + of_a[first]], return_counts=True)
            others, often = np.unique(b[from_b[first] : from_b[first] + of_b[first]], return_counts=True)
            step = max(1, BLOCK // others.size)
            for k in range(0, ids.size, step):
                keys = (ids[k : k + step, None] << 16 | others[None, :]).ravel()
                found.append((np.full(keys.size, segment[first]), keys, (times[k : k + step, None] * often[None, :]).ravel()))
            last = first + 1
        else:
            sizes = product[first:last]
            group = np.repeat(np.arange(first, last), sizes)
            within = np.arange(group.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = a[from_a[group] + within // of_b[group]] << 16 | b[from_b[group] + within % of_b[group]]
            found.append((segment[group], keys, np.ones(keys.size, np.int64)))
        first = last
    if not found:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, keys, times = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((keys, owner))
    owner, keys, times = owner[order], keys[order], times[order]
    new = np.ones(keys.size, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(owner[at], np.arange(n + 1)), keys[at], np.add.reduceat(times, at)


class Known:
    """The alignments of segments that a worker has met, most used ones kept; ``KEPT`` of them at most, none of a long segment."""

    def __init__(self, tokens: Tokenizers, groups: bool):
        self.tokens, self.groups = tokens, groups
        self.rows: dict[str, int] = {}
        self.store = align(tokens, [], 0, groups)
        self.uses = np.zeros(0, np.int64)

    def find(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each segment, -1 where it is new, and whether it is empty or has white space at an edge (then it is new)."""
        get = self.rows.get
        rows = np.fromiter((get(s, -1) for s in segments), np.int64, len(segments))
        ragged = np.zeros(rows.size, bool)
        new = np.flatnonzero(rows < 0)
        ragged[new] = [not s or s[0].isspace() or s[-1].isspace() for s in map(segments.__getitem__, new.tolist())]
        return rows, ragged

    def align(self, segments: list[str], rows: np.ndarray, ragged: np.ndarray) -> Aligned:
        """The alignment of ``segments``; ``rows`` and ``ragged`` as found."""
        new = np.flatnonzero(rows < 0)
        new = new[np.argsort(ragged[new], kind="stable")]
        fresh = align(self.tokens, [segments[i] for i in new.tolist()], int(np.count_nonzero(~ragged[new])), self.groups)
        at = rows.copy()
        at[new] = self.uses.size + np.arange(new.size)
        out = self.store.joined(fresh).take(at)
        self.uses[rows[rows >= 0]] += 1
        keep = [k for k, i in enumerate(new.tolist()) if not ragged[i] and len(segments[i]) <= 64 and fresh.whole[k]]
        for k, row in zip(keep, range(self.uses.size, self.uses.size + len(keep))):
            self.rows[segments[new[k]]] = row
        self.store = self.store.joined(fresh.take(np.array(keep, np.int64)))
        self.uses = np.concatenate([self.uses, np.ones(len(keep), np.int64)])
        if self.uses.size > KEPT:
            self._thin()
        return out

    def _thin(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT // 2])
        stay = stay[self.uses[stay] > 1]
        place = np.full(self.uses.size, -1)
        place[stay] = np.arange(stay.size)
        self.rows = {s: r for s, i in self.rows.items() if (r := int(place[i])) >= 0}
        self.store, self.uses = self.store.take(stay), (self.uses[stay] + 1) // 2


class Slice:
    """The texts of a slice as numbers of distinct segments, and their alignment.

    A segment ends at every single space between two other characters that are
    no white space. Most texts can be split at every space; whether one can is
    seen from its distinct parts, none of which may be blank at an edge.
    """

    def __init__(self, known: Known, texts: list[str | None]):
        parts = [t.split(" ") if t else [] for t in texts]
        sizes, numbers, distinct = self._numbered(parts)
        rows, ragged = known.find(distinct)
        odd = _sums(ragged[numbers], sizes) > 0
        if odd.any():
            parts = [CUT.split(t) if o else p for t, p, o in zip(texts, parts, odd)]
            sizes, numbers, distinct = self._numbered(parts)
            rows, ragged = known.find(distinct)
        self.aligned = known.align(distinct, rows, ragged)
        self.good = (_sums(~self.aligned.whole[numbers], sizes) == 0) & (sizes > 0)
        fine = np.repeat(self.good, sizes)
        self.segments, self.sizes = numbers[fine], np.where(self.good, sizes, 0)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)

    @staticmethod
    def _numbered(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        numbers, distinct = pd.factorize(np.array(list(chain.from_iterable(parts)), object))
        return np.fromiter(map(len, parts), np.int64, len(parts)), numbers, distinct.tolist()

    def total(self, per_segment: np.ndarray) -> np.ndarray:
        """Sums of a segment's numbers over each text, in whole numbers."""
        return _sums(per_segment[self.segments], self.sizes)

    def groups(self) -> list[bytes]:
        """The groups of each text."""
        of, numbers = self.aligned.groups, self.segments.tolist()
        ends = np.cumsum(self.sizes)
        return [b";".join([of[n] for n in numbers[i:j]]) for i, j in zip((ends - self.sizes).tolist(), ends.tolist())]

    def documents_with(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and the number of texts each is linked in."""
        x, many = self.aligned, max(1, self.aligned.n_a.size)
        met = _distinct(self.text * many + self.segments)
        text, segment = met // many, met % many
        keys, counts = [], []
        sizes = np.diff(x.first)[segment]
        upto = np.cumsum(sizes)
        first = 0
        while first < met.size:  # whole texts, some millions of pairs at a time
            base = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
            last = int(np.searchsorted(text, text[last - 1], "right"))
            many_of = sizes[first:last]
            at = np.repeat(x.first[segment[first:last]] - np.cumsum(many_of) + many_of, many_of) + np.arange(int(many_of.sum()))
            both = _distinct(np.repeat(text[first:last], many_of) << 32 | x.pairs[at])
            pair, n = added(both & 0xFFFFFFFF, np.ones(both.size, np.int64))
            keys.append(pair)
            counts.append(n)
            first = last
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return added(np.concatenate(keys), np.concatenate(counts))


MAX_FILE = 64 << 20


class Files:
    """Both vocabulary files, read by the driver (at most ``MAX_FILE`` bytes each) and broadcast."""

    def __init__(self, df: DataFrame, a: str, b: str):
        data = []
        for path in (a, b):
            with open(path, "rb") as f:
                data.append(f.read(MAX_FILE + 1))
            if len(data[-1]) > MAX_FILE:
                raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
        self.name = hashlib.sha256(data[0] + b"|" + data[1]).hexdigest()
        self.shared = df.sparkSession.sparkContext.broadcast(tuple(data))

    def load(self, groups: bool) -> tuple[tuple, Known]:
        """What this worker has met, with or without groups; new where another operator or file was at work here."""
        key = (self.name, groups)
        if held.get("align", (None,))[0] != key:
            held["align"] = (key, Known(Tokenizers(*self.shared.value), groups))
        return held["align"]


def _slices(batch: pa.RecordBatch, files: Files, groups: bool) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """``held`` is emptied when slices are cut; ours is put back for the next batch."""
    own = files.load(groups)
    for part in slices(batch, "text", SLICE):
        held["align"] = own
        yield part, Slice(own[1], part.column("text").to_pylist())


def partial_counts(docs: DataFrame, files: Files) -> DataFrame:
    """pair and n: in how many of a task's documents the pair is linked. Written to the shared folder."""

    def rows(tally: Tally) -> pa.RecordBatch:
        keys, counts = tally.take()
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, part in _slices(batch, files, False):
                tally.add(*part.documents_with())
                if tally.full:
                    yield rows(tally)
        yield rows(tally)

    return cut_lineage(docs.select("text").mapInArrow(run, PARTIAL), "partial-pairs")


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)


TABLE = "shard int, size long, hash binary, keys binary"


def _hash_shards(partial: DataFrame) -> DataFrame:
    """A perfect hash for each shard of the distinct pairs, and the keys by index. Written to the shared folder."""
    distinct = cut_lineage(partial.select("pair").distinct(), "pairs")
    shards = max(1, -(-distinct.count() // SHARD))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(keys, shards).astype(np.int32)), batch.column("pair")], ["shard", "pair"])

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        keys = frame["pair"].to_numpy()
        hashed = PerfectHash(keys)
        own = np.zeros(keys.size, np.uint32)
        own[hashed.index(keys)] = keys
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "size": [keys.size], "hash": [pickle.dumps(hashed)], "keys": [own.tobytes()]})

    return cut_lineage(distinct.mapInArrow(dealt, "shard int, pair long").groupBy("shard").applyInPandas(build, TABLE), "perfect-hash")


class Table:
    """Perfect hashes, keys and counts of some shards."""

    def __init__(self, rows: list, shards: int):
        import pickle

        self.shards = shards
        self.own = {r["shard"]: (pickle.loads(r["hash"]), np.frombuffer(r["keys"], np.uint32)) for r in rows}
        self.counts = {r["shard"]: np.frombuffer(r["counts"], np.int64) for r in rows if "counts" in r}

    def places(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard here: its number, which of the keys it holds, and their indices."""
        shard = _shard_of(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (hashed, own) in self.own.items():
            mine = order[edges[s] : edges[s + 1]]
            index = hashed.index(keys[mine])
            there = index >= 0
            there[there] = own[index[there]] == keys[mine][there]  # the stored key decides
            yield s, mine[there], index[there]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, 0 for those in no shard here."""
        out = np.zeros(keys.size, np.int64)
        for s, which, index in self.places(keys):
            out[which] = self.counts[s][index]
        return out


def _passes(table: DataFrame) -> tuple[int, list[list[int]]]:
    """The number of shards, and the shards that travel together."""
    sizes = sorted((r.shard, r.size) for r in table.select("shard", "size").collect())  # a row for each 131,072 pairs
    out, total = [], PASS
    for shard, size in sizes:
        if total + size > PASS:
            out.append([])
            total = 0
        out[-1].append(shard)
        total += size
    return max((s for s, _ in sizes), default=0) + 1, out


def _summed(partial: DataFrame, table: DataFrame, shards: int, passes: list[list[int]]) -> DataFrame:
    """shard and counts (64-bit numbers by index): vectors of each task, summed ``FAN`` at a time."""
    spark = partial.sparkSession

    def vectors(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Table(shared.value, shards)
            total = {s: np.zeros(keys.size, np.int64) for s, (_, keys) in own.own.items()}
            seen = False
            for batch in batches:
                seen = True
                keys, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
                for s, which, index in own.places(keys):
                    total[s] += np.bincount(index, n[which], total[s].size).astype(np.int64)
            for s, vector in total.items():
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([vector.tobytes()], pa.binary())], ["shard", "counts"]
                    )

        return run

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(frame["counts"].iloc[0]) // 8, np.int64)
        for x in frame["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "counts": [total.tobytes()], "branch": [frame["branch"].iloc[0]]})

    kind = "shard int, counts binary"
    parts = []
    for chosen in passes:
        rows = [r.asDict() for r in table.filter(F.col("shard").isin(chosen)).collect()]
        level = partial.mapInArrow(vectors(spark.sparkContext.broadcast(rows)), kind).withColumn("branch", F.spark_partition_id())
        while True:
            level = level.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int"))
            level = cut_lineage(level.groupBy("shard", "branch").applyInPandas(summed, f"{kind}, branch int"), "vectors")
            if not level.agg(F.max("branch")).head()[0]:  # one vector of each shard is left
                break
        parts.append(level.drop("branch"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class PairCounts:
    """Distinct pairs, their counts and the largest count of each A id; tables in the shared folder."""

    def __init__(self, docs: DataFrame, files: Files):
        self.files = files
        partial = partial_counts(docs, files)
        table = _hash_shards(partial)
        self.shards, self.passes = _passes(table)
        if not self.passes:
            self.table, self.most = None, np.zeros(1 << 16, np.int64)
            return
        self.table = cut_lineage(table.join(_summed(partial, table, self.shards, self.passes), "shard"), "pair-counts")

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.zeros(1 << 16, np.int64)
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                    np.maximum.at(most, np.frombuffer(keys, np.uint32) >> 16, np.frombuffer(counts, np.int64))
            ids = np.flatnonzero(most)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most[ids])], ["a", "n"])

        self.most = np.zeros(1 << 16, np.int64)
        top = self.table.select("keys", "counts").mapInArrow(largest, "a long, n long").groupBy("a").agg(F.max("n").alias("n"))
        for row in top.collect():  # at most 65,536 ids
            self.most[row.a] = row.n

    def rows(self) -> DataFrame | None:
        """a, b and n of every pair of the corpus; None where there is none."""
        if self.table is None:
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                    keys = np.frombuffer(keys, np.uint32).astype(np.int64)
                    columns = [pa.array(keys >> 16), pa.array(keys & 0xFFFF), pa.array(np.frombuffer(counts, np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

        return self.table.select("keys", "counts").mapInArrow(run, "a long, b long, n long")


def align_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``a`` is the path of a byte-level BPE vocabulary (the tokenizers library's
    JSON), ``b`` of a sentencepiece model with byte fallback. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``. ``n_best`` counts the links whose pair is in as many
    documents as any pair of their A id, ties included; ``count_sum`` adds up the
    counts of all links.

    A text that is null or empty, or whose joined tokens are not a space and the
    text on either side, has no tokens: zeros and empty groups. Repeated rows
    are documents of their own. Long texts and long segments are aligned whole;
    links of one large group are listed in blocks. An empty table gives an empty
    result. The table has as many extra columns as it likes; they are not read.
    """
    files = Files(docs, a, b)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = PairCounts(rows, files)
    most = spark.sparkContext.broadcast(counts.most)
    rows = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in SUMS])
    passes = counts.passes or [[]]
    for i, chosen in enumerate(passes):
        table = [r.asDict() for r in counts.table.filter(F.col("shard").isin(chosen)).collect()] if chosen else []
        last = i == len(passes) - 1
        rows = _looked_up(rows, files, spark.sparkContext.broadcast(table), counts.shards, most, last)
        if not last:
            rows = cut_lineage(rows, "looked-up")
    return rows


def _looked_up(rows: DataFrame, files: Files, shared: Broadcast, shards: int, most: Broadcast, last: bool) -> DataFrame:
    """Align again and add what the shared table holds to n_best and count_sum; the last pass gives the other columns for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value, shards)
        for batch in batches:
            for part, texts in _slices(batch, files, last):
                x = texts.aligned
                counts = table.look_up(x.pairs)
                segment = np.repeat(np.arange(x.n_a.size), np.diff(x.first))
                best = (counts > 0) & (counts == most.value[x.pairs >> 16])
                n_best, summed = np.zeros(x.n_a.size, np.int64), np.zeros(x.n_a.size, np.int64)
                np.add.at(n_best, segment[best], x.times[best])
                np.add.at(summed, segment, x.times * counts)
                sums = [texts.total(v) + part.column(c).to_numpy() for c, v in zip(SUMS, (n_best, summed))]
                if last:
                    numbers = [texts.total(v) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                    groups = pa.array(texts.groups(), pa.binary()).cast(pa.string())
                    columns = [part.column("doc_id"), *map(pa.array, [*numbers, *sums]), groups]
                else:
                    columns = [part.column("doc_id"), part.column("text"), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = ALIGNED if last else rows.schema
    names = [c.split()[0] for c in ALIGNED.split(", ")] if last else rows.columns
    return rows.mapInArrow(run, kind)


def digests(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``align_documents`` with the SHA-256 of the groups in place of them; without tokens it is empty, not a hash."""
    found = align_documents(docs, a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return found.withColumn("groups_sha256", digest).drop("groups")
