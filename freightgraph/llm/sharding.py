"""Sharding by a Feistel permutation of the global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.numbering import free_name, number_rows
from freightgraph.llm.blocks import U64, mix

ROUNDS = 6
ADDED = ("row_no", "shuffled", "shard", "slot")


def feistel(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 … n−1, applied to ``numbers``.

    A balanced network permutes the least even power of two that is not below ``n``; values outside
    0 … n−1 walk on along their cycle until they come back in, which keeps it a permutation.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = U64((1 << half) - 1), U64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed & 0xFFFFFFFFFFFFFFFF))
    out = np.asarray(numbers).astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, order: list[str], shards: int, seed: int = 42) -> DataFrame:
    """Add ``row_no``, ``shuffled`` (its place after the shuffle), ``shard`` and ``slot``.

    Rows are numbered in the order of the columns ``order`` (nulls first), so the same table, seed
    and shard count give the same result however it is stored; anyone can compute a row's shard and
    slot from its number alone. Shard sizes differ by one row at most and slots have no gaps, since
    row r goes to shard ``shuffled % shards`` at ``shuffled // shards``. Rows that agree on all of
    ``order`` are interchangeable; a null comes before any value. Pass narrow rows: they are
    range-partitioned and written once. An empty table gives an empty result; repeated rows get a place
    each; columns of ``docs`` with an added name, in any case of letters, are left out, all others stay.
    """
    free = [c for c in docs.columns if c.lower() not in ADDED]
    keys = [free_name(free, f"_order_{i}") for i in range(len(order))]
    numbered = number_rows(docs.select(*[docs[c] for c in free], *[docs[c].alias(k) for c, k in zip(order, keys, strict=True)]), keys).drop(*keys)
    n = numbered.count()

    @F.pandas_udf("long")
    def shuffled(row: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(), n, seed))

    return (
        numbered.withColumn("shuffled", shuffled("row_no"))
        .withColumn("shard", (F.col("shuffled") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("shuffled") / shards).cast("long"))
    )
