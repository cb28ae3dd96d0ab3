"""Turns of conversations in their order, as blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from freightgraph.functions.scratch import written

BLOCK_ROWS, BLOCK_BYTES = 64, 1 << 20


def block_starts(ids: pa.Array, sizes: np.ndarray | None, most_rows: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin in a run of rows, and where a conversation begins."""
    n = len(ids)
    value, missing = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
    first = np.ones(n, bool)
    first[1:] = (value[1:] != value[:-1]) | (missing[1:] != missing[:-1])
    begins = np.flatnonzero(first)
    place = np.arange(n) - begins[np.cumsum(first) - 1]
    cut = place % most_rows == 0
    if sizes is not None:
        full = np.cumsum(sizes) // most_bytes
        cut[1:] |= full[1:] != full[:-1]
    return np.flatnonzero(cut), first


def ordered_blocks(rows: DataFrame, order: list[str], payload: list[str], sized: str | None = None, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, part, idx, whole, *payload as arrays): neighbouring rows of a conversation in the order of conv_id and ``order``.

    The rows are range-partitioned and sorted, so a conversation of any length lies in as many tasks as
    it needs; (part, idx) are unique and follow the order. A block holds at most ``most_rows`` rows and
    about ``most_bytes`` bytes of the column ``sized`` (a longer text is a block of its own), and is
    ``whole`` if it surely is all of its conversation. The result is written once, which fixes the places.
    """
    kinds = dict(rows.dtypes)
    laid = rows.select("conv_id", *order, *[c for c in payload if c not in order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, idx = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            sizes = pc.fill_null(pc.binary_length(column(sized)), 0).to_numpy(zero_copy_only=False).astype(np.int64) if sized else None
            starts, first = block_starts(batch.column(0), sizes, most_rows, most_bytes)
            ends = np.append(starts[1:], batch.num_rows)
            after = np.append(first, False)
            whole = first[starts] & after[ends] & (starts > 0)
            bounds = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.concat_arrays([column(c)])) for c in payload]
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(starts)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(idx, idx + n)), pa.array(whole), *lists],
                ["conv_id", "part", "idx", "whole", *payload],
            )
            idx += n

    schema = f"conv_id {kinds['conv_id']}, part int, idx long, whole boolean, " + ", ".join(f"{c} array<{kinds[c]}>" for c in payload)
    placed = laid.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    return written(placed.mapInArrow(run, schema), "turn_blocks")
