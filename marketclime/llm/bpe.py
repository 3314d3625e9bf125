"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged by itself. A segment tree over its
byte positions stores the leftmost smallest rank of a pair of live neighbours;
a merge is two or three point updates, so a match of n bytes takes
O(n log n) whatever its length. Words repeat, so what a match or a word between
single spaces encodes to is remembered in two bounded generations per worker.

Both operators are row-wise (no shuffle); the rank file is read once by the
driver, checked for size and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketclime.llm.textbytes import held

MAX_RANK_FILE = 64 << 20  # bytes; a rank file is a few hundred kilobytes
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1
NONE = 1 << 62  # a pair that does not merge
GENERATION = 250_000  # remembered words (of under 64 characters) and matches per generation and worker: some 50 MB each


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, checked against ``MAX_RANK_FILE``."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the leftmost pair of smallest rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    # a leaf holds rank and place of the pair that starts at its byte, so the smallest is also the leftmost
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << PLACE_BITS | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 2))  # start of the next live token; n: none
    before = list(range(-1, n))
    while (best := tree[1]) != NONE:
        i = best & PLACES
        j = after[i]  # joins the token at i
        end = after[i] = after[j]
        before[end] = i
        if end < n:
            rank = get(piece[i : after[end]])
            value = NONE if rank is None else rank << PLACE_BITS | i
            k = size + j
            if tree[k] != NONE:
                tree[k] = NONE
                k >>= 1
                while k:  # the dead leaf's parents, up to one that does not change
                    x, y = tree[k + k], tree[k + k + 1]
                    if y < x:
                        x = y
                    if tree[k] == x:
                        break
                    tree[k] = x
                    k >>= 1
        else:
            value = NONE
        k = size + i
        while tree[k] != value:
            tree[k] = value
            if k == 1:
                break
            x = tree[k ^ 1]
            if x < value:
                value = x
            k >>= 1
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            value = NONE if rank is None else rank << PLACE_BITS | left
            k = size + left
            while tree[k] != value:
                tree[k] = value
                if k == 1:
                    break
                x = tree[k ^ 1]
                if x < value:
                    value = x
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Irregular(Exception):
    """A single space beside other white space: the text must be split by the pattern as a whole."""


class Encoder:
    """Splits and merges texts; remembers words. Ids are packed 32-bit integers."""

    def __init__(self, data: bytes, pattern: str, generation: int = GENERATION):
        import regex

        self.ranks = parse_ranks(data)
        self.find = regex.compile(pattern).findall
        self.pieces: tuple[dict, dict] = ({}, {})
        self.words: tuple[dict, dict] = ({}, {})
        self.generation = generation

    def piece(self, piece: str) -> bytes:
        new, old = self.pieces
        ids = new.get(piece)
        if ids is None:
            ids = old.get(piece)
            if ids is None:
                ids = array("i", merge_piece(piece.encode(), self.ranks)).tobytes()
            if len(piece) < 64:
                if len(new) >= self.generation:
                    self.pieces = ({}, new)
                self.pieces[0][piece] = ids
        return ids

    def split(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.find(text)))

    def word(self, word: str) -> bytes:
        """Ids of a space and ``word``, which stands between two single spaces."""
        new, old = self.words
        ids = new.get(word) or old.get(word)
        if ids is None:
            # a space with no white space on either side always starts a match
            if not word or word[0].isspace() or word[-1].isspace():
                raise _Irregular
            ids = self.split(" " + word)
        if len(word) < 64:
            if len(new) >= self.generation:
                self.words = ({}, new)
            self.words[0][word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if not words or not first or first[-1].isspace() or words[-1] == "":
            return self.split(text)
        known, other = self.words[0].get, self.word
        try:
            return self.split(first) + b"".join([known(w) or other(w) for w in words])
        except _Irregular:
            return self.split(text)


def _once(kind: str, key, make):
    """The last encoder or vocabulary of this worker, or a new one."""
    if kind not in held or held[kind][0] != key:
        held[kind] = (key, make())
    return held[kind][1]


def _shared_ranks(df: DataFrame, path: str) -> tuple[Broadcast, str]:
    """The rank file for the tasks, and a name for its contents."""
    data = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def _place(df: DataFrame, name: str) -> int:
    places = [i for i, c in enumerate(df.columns) if c == name]
    if len(places) != 1:
        raise ValueError(f"need exactly one column {name}, found {len(places)}")
    return places[0]


def _list_array(rows: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


PART = 512  # rows encoded at once; ids go out in parts as small


class Coder:
    """Ids of texts and bytes of ids, by one rank file; what one process of a worker keeps for both."""

    def __init__(self, data: bytes, pattern: str | None):
        self.encoder = Encoder(data, pattern) if pattern else None
        ranks = self.encoder.ranks if self.encoder else parse_ranks(data)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, texts: pa.Array) -> pa.ListArray:
        return _list_array([self.encoder.encode(t) if t else b"" for t in texts.to_pylist()])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        lists, token = ids.fill_null([]), self.tokens.__getitem__
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        return pa.array([b"".join(map(token, flat[a:b].tolist())) for a, b in zip([0, *ends], ends)], pa.binary())


def _coded(df: DataFrame, ranks: str, pattern: str | None, source: str, out: dict[str, T.DataType], run_part) -> DataFrame:
    """Replace or add the columns ``out``, computed from ``source`` by ``run_part(coder, column)``, a few rows at a time."""
    data, name = _shared_ranks(df, ranks)
    place, schema = _place(df, source), df.schema
    for column, kind in out.items():
        schema = T.StructType([*(f for f in schema.fields if f.name != column), T.StructField(column, kind)])
    keep = [i for i, c in enumerate(df.columns) if c not in out]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _once("bpe", (name, pattern), lambda: Coder(data.value, pattern))
        for batch in batches:
            for first in range(0, batch.num_rows, PART):
                part = batch.slice(first, PART)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *run_part(coder, part.column(place))], names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType())


def encode_bpe(df: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``: the ids of ``text`` as the tiktoken library's ``encode_ordinary`` gives them.

    ``ranks`` is the path of a rank file, ``pattern`` the split pattern. Null
    or empty text gives an empty list. A column already named ``into`` is
    replaced; all other columns and rows stay, repeated rows included.
    """
    return _coded(df, ranks, pattern, text, {into: IDS}, lambda coder, texts: [coder.encode(texts)])


def decode_bpe(df: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the bytes of ``ids`` (binary, since ids need not end on whole characters).

    Null or empty ids give empty bytes; an id outside the rank file is an
    error. A column already named ``into`` is replaced.
    """
    return _coded(df, ranks, None, ids, {into: T.BinaryType()}, lambda coder, lists: [coder.decode(lists)])


def code_bpe(df: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids", back: str = "decoded") -> DataFrame:
    """``encode_bpe`` and ``decode_bpe`` of its ids, in one pass and one process for each task."""

    def both(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        ids = coder.encode(texts)
        return [ids, coder.decode(ids)]

    return _coded(df, ranks, pattern, text, {into: IDS, back: T.BinaryType()}, both)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of the bytes decoded from them."""
    coded = code_bpe(docs.select("doc_id", "text"), ranks, pattern).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
