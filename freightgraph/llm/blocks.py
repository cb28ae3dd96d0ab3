"""Array views of a text column, in blocks of bounded size, for use inside Arrow tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Block:
    """Some rows of a batch: ``data`` holds their texts' UTF-8 bytes, ``offsets`` where each begins."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The row that each byte position belongs to."""
        return np.searchsorted(self.offsets, positions, "right") - 1


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``limit`` bytes of text (a longer text is a block of its own); null counts as empty.

    When a task's rows are through, its Python worker, which Spark keeps for the next task, gives free memory back.
    """
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, at, raw = texts.buffers()
        offsets = np.frombuffer(at, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield Block(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
        batch = texts = at = raw = offsets = data = None
    trim()


def trim() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """_BASE or its inverse to the powers 0 … n−1, modulo 2^64; kept up to the usual block size."""
    if len(_powers[kind]) >= n:
        return _powers[kind]
    factors = np.full(max(n, BLOCK_BYTES + 1), _BASE if kind == "up" else _BASE_INVERSE)
    factors[0] = 1
    made = np.multiply.accumulate(factors)
    if n <= BLOCK_BYTES + 1:
        _powers[kind] = made
    return made


def byte_table(separators: str = "", *, ranges: Iterable[tuple[int, int]] = (), lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is the byte part of a word, the byte after lower-casing A–Z)."""
    part = np.ones(256, bool)
    for a, b in [(ord(c), ord(c)) for c in separators] + list(ranges):
        part[a : b + 1] = False
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[65:91] += 32
    return part, folded


def word_spans(block: Block, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the place of its first word (n + 1 values)."""
    n = len(block.data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(block.n + 1, np.int64)
    inside = part[block.data]
    edge = np.zeros(n + 1, bool)  # a new text begins here
    edge[block.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, block.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *more: np.ndarray) -> np.ndarray | list[np.ndarray]:
    """A 64-bit hash of the bytes in each span, by differences of one running polynomial sum.

    Each of ``more`` gives other ends for the same starts; the result is then a list.
    """
    up = _power("up", len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    before, down = sums[starts], _power("down", len(data))[starts]
    out = [mix((sums[e] - before) * down) for e in (ends, *more)]
    return out if more else out[0]


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word grams that lie in one row.

    Returns the hashes, the word each gram starts at, and for each row the place of its first gram.
    With ``short``, a row of 1 to k−1 words has one gram, of all its words.
    """
    count = np.diff(first)
    grams = np.where(count >= k, count - k + 1, (count > 0) & short).astype(np.int64)
    place = np.zeros(len(first), np.int64)
    np.cumsum(grams, out=place[1:])
    start = np.arange(place[-1]) + np.repeat(first[:-1] - place[:-1], grams)
    stop = np.repeat(first[1:], grams)
    total = np.zeros(place[-1], U64)
    for j in range(k):
        at = start + j
        have = at < stop
        total = total * _BASE + np.where(have, words[np.minimum(at, len(words) - 1)] if len(words) else U64(0), U64(j + 1))
    return mix(total), start, place
