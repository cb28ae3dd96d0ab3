"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import Block, blocks

MAX_LENGTH = 2048
END_ID = 1
CACHE_WORDS = 80_000
MAX_BASES = 1_000_000


class WordIds(dict):
    """Ids of words as bytes, made on demand and kept up to a bound."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = array("I", self.encode(word)).tobytes()
        return ids


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_ODD = np.zeros(256, bool)
_ODD[[*range(10), *range(11, 32), 127, *range(0xCA, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    In a plain text (Latin letters, no white space but single spaces and line ends) a space always
    begins a new piece of the tokenizer's pattern, a line end is a piece of its own, and so is a full
    stop or comma between a letter and a blank; so the text's ids are those of its words one after
    another, and each distinct word's are kept. Their ids come from the same vocabulary's ranks. Any
    other text is encoded as a whole by the tokenizer itself, and so is one that holds the string of a
    special token, unless those are to be ordinary text.
    """

    def __init__(self, path: str, ranks: str, special: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.words = WordIds(words.encode_ordinary)

    @staticmethod
    def plain(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each row: whether its words can be encoded apart, and whether its stops can too."""
        data, n = block.data, len(block.data)
        if not n:
            return np.zeros(block.n, bool), np.zeros(block.n, bool)
        edge = np.zeros(n + 1, bool)
        edge[block.offsets] = True
        blank = _BLANK[data]
        after = np.append(data[1:], 32)
        before = np.append(32, data[:-1])
        odd = _ODD[data] | ((data == 0xC2) & ((after == 0xA0) | (after == 0x85)))
        odd |= blank & (edge[:n] | edge[1:] | np.append(blank[1:], True))
        accent = (np.append([0, 0], data[:-2])[:n] == 0xC3) & (before != 0x97) & (before != 0xB7)
        close = edge[1:] | _BLANK[after]
        loose = _STOP[data] & ~((_LETTER[before] | accent) & ~edge[:n] & close)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets])
        return sums(odd) == 0, sums(loose) == 0

    def holding_special(self, block: Block) -> np.ndarray:
        """The rows that hold the string of a special token."""
        raw = block.data.tobytes()
        found = [m.start() for s in self.special for m in re.finditer(re.escape(s), raw)]
        return block.doc_of(np.asarray(found, np.int64))

    def encode(self, block: Block, texts: list[str]) -> list[bytes]:
        plain, stops = self.plain(block)
        plain[self.holding_special(block)] = False
        whole = self.tokenizer.encode_batch_fast([t for t, ok in zip(texts, plain, strict=True) if not ok], add_special_tokens=False)
        rest = iter(np.asarray(e.ids, "<u4").tobytes() for e in whole)
        look = self.words.__getitem__
        out = []
        for t, ok, cut in zip(texts, plain, stops, strict=True):
            if not ok:
                out.append(next(rest))
                continue
            if cut:
                t = t.replace(".", "\0.").replace(",", "\0,")
            out.append(b"".join(map(look, t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))))
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, ranks: str, special: bool) -> Encoder:
    """One encoder, with its words, for all tasks of a Python worker."""
    return Encoder(path, ranks, special)


def lengths(tokens: int, longest: int) -> list[int]:
    """The power-of-two lengths, longest first, that sum to ``tokens``."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str, key: str = "doc_id", text: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID,
    special: bool = True,
) -> DataFrame:
    """Cut every document's tokens into power-of-two pieces; each piece is one sequence of its bucket.

    Returns (key, start, length, ids_crc32, doc_tokens, bucket, slot, sequence_id, offset): the pieces
    of one length form a bucket, ``slot`` runs gapless within it, ``sequence_id`` runs gapless over all
    buckets, shortest bucket first, and ``offset`` is 0, as every sequence is one whole piece of a
    power-of-two length and needs no padding. Which of a bucket's slots a piece has follows the order
    in which the table is read; it is fixed by one write.

    ``tokenizer`` is the path of a tokenizer file, ``ranks`` that of the same vocabulary as ranks;
    ``longest`` is a power of two. With ``special``, the string of a special token in a text becomes that
    token, as the tokenizer does by default; without, it is ordinary text. The texts are read once and never shuffled. A null or empty text
    has the one token ``end_id``; a very long text yields as many longest pieces as it fills; repeated
    rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer, ranks, special), TaskContext.get().partitionId()
        used = dict.fromkeys((1 << b for b in range(longest.bit_length())), 0)  # pieces of each length so far in this task
        end = np.asarray([end_id], "<u4").tobytes()
        for block in blocks(batches, "text"):
            keys = block.batch.column(0)
            out: list[tuple[int, int, int, int, int, int]] = []
            for i, ids in enumerate(encoder.encode(block, [t or "" for t in block.batch.column(1).to_pylist()])):
                ids += end
                tokens, start = len(ids) // 4, 0
                for n in lengths(tokens, longest):
                    out.append((i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, used[n]))
                    used[n] += 1
                    start += n
            if out:
                row, *columns = (np.asarray(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)), *map(pa.array, columns), pa.array(np.full(len(row), task, np.int64))],
                    ["key", "start", "length", "ids_crc32", "doc_tokens", "local", "task"],
                )

    pieces = written(
        docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
        .mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, local long, task long"),
        "pieces",
    )
    counts = pieces.groupBy("length", "task").agg((F.max("local") + 1).alias("n"))  # tasks × lengths, a few rows each
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("in_bucket", F.coalesce(F.sum("n").over(before("length").orderBy("task")), F.lit(0)))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n"))  # one row for each power of two
    buckets = sizes.select("length", F.coalesce(F.sum("n").over(before().orderBy("length")), F.lit(0)).alias("before"))
    # a row for each task that read texts and length: they grow with the table, so they are broadcast up to a bound only
    bases = written(bases.drop("n"), "bases")
    bases = F.broadcast(bases) if bases.count() <= MAX_BASES else bases
    return (
        pieces.join(bases, ["length", "task"]).join(F.broadcast(buckets), "length")
        .withColumn("slot", F.col("in_bucket") + F.col("local"))
        .select(
            F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", F.col("length").alias("bucket"), "slot",
            (F.col("before") + F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
