"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.llm.blocks import BLOCK_BYTES, U64, mix, span_hashes

#: Bins of each level and what an agreeing bin counts: phrases of about 3, 9 and 30 characters. Longer ones say more, short
#: texts have few of them; every text is described by all levels, and each level is compared with itself.
LEVELS = ((32, 1.0), (64, 3.0), (64, 9.0))
BINS = sum(b for b, _ in LEVELS)
_WEIGHTS = np.repeat([w for _, w in LEVELS], [b for b, _ in LEVELS])
_TOSSES = 3  # rounds after the first: labels below 128, 14, 8, 6


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: where a label first differs from its left neighbour's, and its bit there."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = ~labels[first]
    unlike = labels ^ before
    one = labels.dtype.type(1)
    place = np.bitwise_count((unlike & (~unlike + one)) - one)
    bit = (labels >> place.astype(labels.dtype)).astype(np.uint8) & np.uint8(1)
    return (place << np.uint8(1)) | bit


def parse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of each sequence. ``offsets`` has n + 1 values.

    Runs of one symbol become one symbol first, so neighbours differ; coin tossing then gives labels
    below six that depend on a few symbols to the left only, and phrases begin at their local maxima.
    A phrase's name is a hash of its symbols, so equal stretches get equal names wherever they stand,
    but for a few phrases at their ends.
    """
    n = len(symbols)
    if not n:
        return symbols, np.zeros_like(offsets)
    new = np.ones(n + 1, bool)
    new[1:n] = symbols[1:] != symbols[:-1]
    new[offsets] = True
    heads = np.flatnonzero(new[:n])
    runs = np.diff(np.append(heads, n)).astype(U64)
    value = np.where(runs == 1, symbols[heads], mix(symbols[heads] + runs * U64(0xD6E8FEB86659FD93)))
    offsets = np.searchsorted(heads, offsets)
    first = offsets[:-1][np.diff(offsets) > 0]
    labels = _toss(value, first)
    for _ in range(_TOSSES):
        labels = _toss(labels, first)
    peak = np.zeros(len(value) + 1, bool)
    peak[1 : len(value) - 1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[np.maximum(offsets[1:] - 1, 0)] = False  # the neighbour on its right is another text's
    peak[offsets] = True
    starts = np.flatnonzero(peak[: len(value)])
    ends = np.append(starts[1:], len(value))
    return span_hashes(value, starts, ends), np.searchsorted(starts, offsets)


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS 16-bit values for each text, level by level, 0 for an empty bin: the least phrase name in each bin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    rows = []
    for level, (bins, _) in enumerate(LEVELS, 1):
        symbols, offsets = parse(symbols, offsets)
        names = mix(symbols + U64(level))
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        least = np.full(len(texts) * bins, np.iinfo(U64).max, U64)
        np.minimum.at(least, doc * bins + (names % U64(bins)).astype(np.int64), names // U64(bins))
        value = np.where(least == np.iinfo(U64).max, U64(0), mix(least) % U64(65535) + U64(1))
        rows.append(value.astype(">u2").reshape(len(texts), bins))
    return np.concatenate(rows, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted share of bins that agree, of those that either text fills; 1 for two empty texts."""
    filled = ((a != 0) | (b != 0)) @ _WEIGHTS
    return np.where(filled == 0, 1.0, ((a == b) & (a != 0)) @ _WEIGHTS / np.maximum(filled, 1))


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """Ids in the table that cut it into about ``parts`` equal ranges; the first is the least."""
    shares = [i / parts for i in range(parts)]
    found = docs.agg(F.min("id"), F.percentile_approx("id", shares, 100 * parts)).first()
    return [] if found[0] is None else sorted({found[0], *found[1]})


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprint each text, and the text with its last quarter replaced from the start of the next document.

    Returns (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    The next document is that with the next larger key; after the last comes the first. The table is
    cut into key ranges at keys that it holds; the rows of each cut's key are also sent to the range
    before it, so every text is shuffled once and each range is a stream that looks one row ahead.

    Null and empty texts count as empty: no bin is filled, the likeness of two of them is 1, of one and
    another text 0. A null key counts as the smallest; rows with one key follow in the order of a hash
    of their texts. A table of one row is its own next. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    parts = parts or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    cuts = np.asarray(_cuts(rows, parts), np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add each row's range; the rows at a cut also go to the range before, as its last."""
        for batch in batches:
            ids = batch.column(1).to_numpy()
            part = np.searchsorted(cuts, ids, "right") - 1
            again = np.flatnonzero(cuts[part] == ids)
            take = pa.array(np.concatenate([np.arange(len(ids)), again]))
            where = np.concatenate([part, (part[again] - 1) % len(cuts)])
            ahead = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(3)), pa.array(where.astype(np.int32)), pa.array(ahead)], ["key", "id", "text", "part", "ahead"])

    def judged(keys: list, texts: list[str], ahead: str) -> pa.RecordBatch:
        following = [*texts[1:], ahead]
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]
        prints, changed = sketches([*texts, ahead]), sketches(edited)
        show = lambda rows: [r.tobytes().hex() for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, keys_type), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array(show(prints[:-1]), pa.string()), pa.array(show(changed), pa.string()),
                pa.array(likeness(prints[:-1], changed)), pa.array(likeness(prints[:-1], prints[1:])),
            ], names,
        )

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    keys_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.int64())

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range, a range's rows from the next one last; the last row seen waits for its next."""
        keys: list = []
        texts: list[str] = []
        size, at, closed = 0, None, False
        for batch in batches:
            for key_, text_, part, ahead in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if part != at:
                    at, closed = part, False
                if closed:
                    continue  # further rows with the cut's key
                if ahead or size > BLOCK_BYTES:
                    if keys:
                        yield judged(keys, texts, text_)
                    keys, texts, size, closed = [], [], 0, ahead
                    if ahead:
                        continue
                keys.append(key_)
                texts.append(text_)
                size += len(text_)

    dealt = rows.mapInArrow(deal, f"key {kind}, id long, text string, part int, ahead boolean")
    placed = dealt.repartition("part").sortWithinPartitions("part", "ahead", "id", F.xxhash64("text"))
    return placed.mapInArrow(stream, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)
