"""Numpy views of the texts of an Arrow batch: words, word hashes, rolling hashes.

Texts are UTF-8 bytes. A word is a maximal run of bytes other than space and
0x09-0x0D. Hashes are polynomials over the byte values modulo 2**64 with an odd
base, taken as differences of prefix sums, and mixed afterwards; equal bytes
always have equal hashes. Work goes in blocks, so a very long text costs a few
bytes of memory per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15  # odd, so powers of it have inverses modulo 2**64
SECOND_BASE = 0xD1B54A32D192ED03
BLOCK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of ``base`` and their inverses; kept between calls up to a few blocks."""
    held = _powers.get(base)
    if held is None or held[0].size < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        held = (up, down)
        if size <= 4 * BLOCK:
            _powers[base] = held
    return held[0][:n], held[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """``sums[i]``: the sum of (byte + 1) * base**j over j < i."""
    up, _ = powers(base, data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """The hash of the bytes of each span, whatever its place; ``sums`` of ``prefix_sums``."""
    _, down = powers(base, sums.size)
    return (sums[ends] - sums[starts]) * down[starts]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and the len + 1 offsets of its texts; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


held: dict[str, tuple] = {}  # what one operator keeps in a worker between tasks; dropped when another one starts there


def slices(batch: pa.RecordBatch, text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``size`` bytes of text, or one longer text."""
    held.clear()
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(batch.num_rows + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the place of its first word among them (len + 1 places)."""
    inside = np.ones(data.size + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    finishes = inside[:-1] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < data.size)]  # a word never runs into the next text
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(starts.size, np.uint64)
    first = 0
    while first < starts.size:
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = data[low : int(ends[last - 1])]
        sums = prefix_sums(part)
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix(span_hashes(sums, s, e) + (e - s).astype(np.uint64))
        first = last
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each ``n`` consecutive word hashes (``len(words) - n + 1`` of them)."""
    count = max(0, words.size - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(SECOND_BASE) + words[k : k + count])
    return out
