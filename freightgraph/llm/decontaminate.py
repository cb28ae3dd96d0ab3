"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import U64, blocks, byte_table, gram_hashes, span_hashes, word_spans

K = 5
CONTAINMENT = 0.6
FILTER_BITS = 1 << 24  # 2 MB, whatever the number of items
#: Items of up to this many shingles → how many of their least hashes are searched for. A class's sketch
#: finds an item at the containment c with probability 1 − (1 − c)^size; the last class has no upper bound.
SKETCHES = ((16, 16), (64, 24), (256, 32), (None, 48))

#: Words are runs of 0–9, a–z and everything beyond ASCII, after A–Z are lower-cased.
_PART, _FOLD = byte_table(ranges=[(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def shingle_hashes(rows: DataFrame, key: str, text: str, k: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, n_shingles, shingles array<long>): each row's distinct k-word shingle hashes.

    ``wanted`` is a bit table; only hashes whose bit is set leave the task then, and rows without any
    are dropped. A text of fewer than k words has one shingle.
    """
    kind = dict(rows.dtypes)[key]
    shared = rows.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            starts, ends, first = word_spans(block, _PART)
            hashes, _, place = gram_hashes(span_hashes(_FOLD[block.data], starts, ends), first, k)
            doc = np.repeat(np.arange(block.n), np.diff(place))
            if shared is not None:
                slot = (hashes % U64(FILTER_BITS)).astype(np.int64)
                keep = (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                hashes, doc = hashes[keep], doc[keep]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            hashes, doc = hashes[new], doc[new]
            bounds = np.searchsorted(doc, np.arange(block.n + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            out = pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(np.diff(bounds)), lists], ["key", "n_shingles", "shingles"])
            yield out if shared is None else out.filter(pa.array(np.diff(bounds) > 0))

    return rows.select(rows[key].alias("key"), rows[text].cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_shingles long, shingles array<long>")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of FILTER_BITS bits with one set for each hash. What reaches the driver is at most that table."""
    # hashes are signed longs here; 2^64 is a multiple of FILTER_BITS, so the remainder is that of the unsigned value
    bits = hashes.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("bit"))
    rows = bits.groupBy(F.expr("shiftright(bit, 3)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 as int)))").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return table


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    k: int = K, containment: float = CONTAINMENT,
) -> DataFrame:
    """Pairs of a document and a test item that it contains: (key, item_key, hits, n_shingles, containment).

    Containment is the share of the item's distinct k-word shingles that stand anywhere in the document.
    First the search: items are partitioned by their number of shingles; each class has its MinHash
    size, and only these least hashes are looked for. A pair is a candidate if the document holds one of
    them, wherever: a document of any length is one set, so a short item inside it is not diluted by
    the rest. Then the check: candidate documents are read again, and all shingles of a candidate pair
    are counted.

    No text is shuffled: a bit table of fixed size, of the hashes looked for, lets only hits (and few
    chance ones) leave the task; the joins are over those. Documents without a candidate are not read
    a second time past the join on their key.

    Null or empty texts and items have no shingles and no pairs; a text of fewer than k words has one
    shingle, of all its words. Rows with a null key are left out. Repeated rows of one key are counted
    as one, and so are repeated items; items with one key and different texts are one set. Empty tables
    give an empty result; other columns are ignored.
    """
    own = written(
        shingle_hashes(items, item_key, item_text, k).where("key is not null").select(F.col("key").alias("item"), F.explode("shingles").alias("hash")).distinct(),
        "item_shingles",
    )
    sizes = own.groupBy("item").agg(F.count("*").alias("n_shingles"))
    sketch_size = F.coalesce(*[F.when(F.col("n_shingles") <= F.lit(top), F.lit(s)) if top else F.lit(s) for top, s in SKETCHES])
    by_hash = Window.partitionBy("item").orderBy("hash")
    sketches = written(own.join(sizes, "item").withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= sketch_size).select("item", "hash"), "item_sketches")
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("key is not null")
    seen = shingle_hashes(rows, "key", "text", k, bit_table(sketches)).select("key", F.explode("shingles").alias("hash"))
    pairs = written(seen.join(sketches, "hash").select("key", "item").distinct(), "candidates")
    again = rows.join(pairs.select("key").distinct(), "key", "left_semi")
    held = shingle_hashes(again, "key", "text", k, bit_table(own)).select("key", F.explode("shingles").alias("hash"))
    return (
        held.join(own, "hash").join(pairs, ["key", "item"], "left_semi")
        .groupBy("key", "item").agg(F.count_distinct("hash").alias("hits")).join(sizes, "item")
        .withColumn("containment", F.round(F.col("hits") / F.col("n_shingles"), 6))
        .where(F.col("hits") >= F.col("n_shingles") * containment)
        .select(F.col("key").alias(key), F.col("item").alias(item_key), "hits", "n_shingles", "containment")
    )
