"""Prefix trie of conversations by vertical bitmaps, shard by shard."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.conversations import ordered_blocks

GROUP, PREFIX = 100, 6  # a conversation begins with fewer than PREFIX turns of the first one of its hundred
SHARD = 512  # conversations whose bitmaps are held together
HOT_PARTS = 1000
ROOT = bytes(16)
_PLACE = (1 << 33) - 1
NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order as an array of (digest, code points); null role and text are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.char_length(text).alias("n"))
    blocks = ordered_blocks(turns, ["turn", "d"], ["d", "n"], most_rows=1024)
    one = F.struct("part", "idx", F.arrays_zip("d", "n").alias("s"))
    return blocks.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda b: b["s"])).alias("seq"))


def rebuilt(own: DataFrame, group: int = GROUP, prefix: int = PREFIX) -> DataFrame:
    """(conv_id, seq): the first h turns of the first conversation of the hundred, then the own ones after h; h from the CRC of the id."""
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, prefix - 1).alias("base_seq"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % prefix).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left").withColumn("h", h)
    head = F.expr("slice(coalesce(base_seq, slice(seq, 1, 0)), 1, h)")
    return joined.select("conv_id", F.concat(head, F.expr("slice(seq, h + 1, greatest(size(seq) - h, 0))")).alias("seq"))


def common(a: str, b: str) -> Column:
    """Length of the common beginning of two sequences; −1 if one is null."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), -1).otherwise(F.when(at == 0, F.size(a)).otherwise(at - 1)).cast("int")


def shard_edges(placed: DataFrame) -> DataFrame:
    """(part, shard, before, after): how many turns a shard's first and last sequence share with the neighbouring shard's nearest one.

    Within a part by a window; only one row for each part meets in a single window.
    """
    ends = written(placed.groupBy("part", "shard").agg(F.min_by("seq", "place").alias("head"), F.max_by("seq", "place").alias("tail")), "shard_ends")
    inner = Window.partitionBy("part").orderBy("shard")
    rows = ends.select("*", F.lag("tail").over(inner).alias("prior"), F.lead("head").over(inner).alias("next"))
    parts = ends.groupBy("part").agg(F.min_by("head", "shard").alias("head"), F.max_by("tail", "shard").alias("tail"), F.max("shard").alias("last"))
    across = Window.orderBy("part")
    outer = parts.select("part", "last", "head", "tail", F.lag("tail").over(across).alias("prior"), F.lead("head").over(across).alias("next")).select(
        "part", "last", common("prior", "head").alias("part_before"), common("tail", "next").alias("part_after"))
    both = rows.select("part", "shard", common("prior", "head").alias("before"), common("tail", "next").alias("after")).join(outer, "part")
    return both.select(
        "part", "shard", F.when(F.col("shard") == 0, F.col("part_before")).otherwise(F.col("before")).alias("before"),
        F.when(F.col("shard") == F.col("last"), F.col("part_after")).otherwise(F.col("after")).alias("after"))


def trie_nodes(convs: list[tuple[int, list[bytes], list[int]]], before: int, after: int) -> list[list]:
    """Rows (key, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, ends) of one shard's nodes.

    convs: (id, digests, code points), sorted by sequence. ``before`` and ``after`` say to what depth the
    first and the last one's nodes are shared with the shards beside it: a shared node's own code points and
    its being a child count in the first shard that has it, its being a leaf in the last. So the rows of one
    node add up over shards. Postings of (position, turn) are bitmaps over the shard's conversations,
    the lowest bit the smallest id; a node's children are the postings met with its own bitmap.
    """
    by_id = sorted(range(len(convs)), key=lambda i: convs[i][0])
    bit = {i: b for b, i in enumerate(by_id)}
    first, last = 1 << bit[0], 1 << bit[len(convs) - 1]
    ids = [convs[i][0] for i in by_id]
    digests, sizes = [convs[i][1] for i in by_id], [convs[i][2] for i in by_id]
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    ended: dict[int, int] = defaultdict(int)
    for b, seq in enumerate(digests):
        for at, d in enumerate(seq):
            postings[at, d] |= 1 << b
        ended[len(seq)] |= 1 << b
    out: list[list] = []
    todo = [((1 << len(ids)) - 1, 0, ROOT, None, -1)]  # members, depth, key, parent's key, parent's row
    above: list[int] = []
    while todo:
        members, depth, key, parent, over = todo.pop()
        low = (members & -members).bit_length() - 1
        shared_before, shared_after = depth <= before and bool(members & first), depth <= after and bool(members & last)
        done = members & ended[depth]
        going, n = members & ~done, members.bit_count()
        size = sizes[low][depth - 1] if depth else 0
        row = [key, parent, depth, ids[low], n, 0, 0, (n - (not shared_before)) * size, _ids(done, ids)]
        if not going and not shared_after:
            row[6] = 1
        if over >= 0 and not shared_before:
            out[over][5] += 1
        here = len(out)
        out.append(row)
        above.append(over)
        while going:
            b = (going & -going).bit_length() - 1
            d = digests[b][depth]
            child = going & postings[depth, d]
            todo.append((child, depth + 1, xxhash.xxh3_128_digest(key + d), key, here))
            going &= ~child
    for i in range(len(out) - 1, 0, -1):  # what lies deeper comes later in the list
        out[above[i]][6] += out[i][6]
        out[above[i]][7] += out[i][7]
    return out


def _ids(members: int, ids: list[int]) -> str | None:
    found = []
    while members:
        b = (members & -members).bit_length() - 1
        found.append(str(ids[b]))
        members &= members - 1
    return ",".join(found) if found else None


NAMES = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 6]
ROWS = 4096


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sharded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard; the rows of a shard come together, in order."""
    names, kinds = [*NAMES, "ends", "part", "shard"], [*KINDS, pa.string(), pa.int32(), pa.int64()]
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        found = trie_nodes(held, now[2], now[3])
        for i in range(0, len(found), ROWS):
            yield _batch([(*r, now[0], now[1]) for r in found[i : i + ROWS]], names, kinds)

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "shard", "before", "after", "conv_id", "seq")]
        for *at, conv, seq in zip(*cols, strict=True):
            if now is not None and at[:2] != now[:2]:
                yield from flush()
                held = []
            now = at
            held.append((conv, [t["d"] for t in seq], [t["n"] for t in seq]))
    if held:
        yield from flush()


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node: the shards' rows of a node come together, in order."""
    names, kinds = [*NAMES, "ends_sha256"], [*KINDS, pa.string()]
    row, sha, any_end, out = None, None, False, []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NAMES, "ends")]
        for *new, ends in zip(*cols, strict=True):
            if row is None or new[0] != row[0]:
                if row is not None:
                    out.append((*row, sha.hexdigest()))
                row, sha, any_end = new, hashlib.sha256(), False
                if len(out) >= ROWS:
                    yield _batch(out, names, kinds)
                    out = []
            else:
                row[3] = min(row[3], new[3])
                row[4:] = [a + b for a, b in zip(row[4:], new[4:], strict=True)]
            if ends is not None:
                sha.update(f"{',' if any_end else ''}{ends}".encode())
                any_end = True
    if row is not None:
        out.append((*row, sha.hexdigest()))
    if out:
        yield _batch(out, names, kinds)


def prefix_trie(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of ``convs`` (conv_id, seq).

    The conversations are sorted by sequence and dealt into shards of neighbours; each shard's bitmaps
    give its nodes, and a node that lies in several shards is the sum of its rows (``trie_nodes``). Its
    end list is hashed shard by shard, in ascending order of ids, never held whole. A parent's id comes by a
    join; parents of more than one node in HOT_PARTS, of which there can be no more than HOT_PARTS, as a
    broadcast. Equal conversations, however many, are spread over shards; one conversation is one row.

    Repeated ids are members each. An empty table has no nodes, not even a root.
    """
    placed = written(
        convs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
        .select("conv_id", "seq", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(_PLACE).alias("place"))
        .withColumn("shard", F.floor(F.col("place") / shard)),
        "placed",
    )
    laid = placed.join(shard_edges(placed), ["part", "shard"]).repartition("part", "shard").sortWithinPartitions("part", "shard", "place")
    partial = laid.mapInArrow(_sharded, f"{NODE}, ends string, part int, shard long")
    nodes = written(partial.repartition("key").sortWithinPartitions("key", "part", "shard").mapInArrow(_merged, f"{NODE}, ends_sha256 string"), "nodes")
    share = nodes.count() / HOT_PARTS
    name = lambda where, key, conv: nodes.where(where).select(F.col("key").alias(key), F.col("conv_id").alias(conv))
    hot, cold = name(F.col("n_children") > share, "hot_key", "hot_conv"), name((F.col("n_children") > 0) & (F.col("n_children") <= share), "cold_key", "cold_conv")
    # children of hot parents go on under their own keys, spread over all tasks
    met = nodes.join(F.broadcast(hot), F.col("parent") == F.col("hot_key"), "left").withColumn("cold_key", F.when(F.col("hot_conv").isNull(), F.col("parent")).otherwise(F.col("key")))
    met = met.join(cold.withColumnRenamed("cold_key", "k"), (F.col("cold_key") == F.col("k")) & F.col("hot_conv").isNull(), "left")
    return met.select("conv_id", "depth", F.coalesce("hot_conv", "cold_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The prefix trie of rebuilt conversations. rows: conv_id, turn, role, text.

    Turns go in the order of turn (nulls first), ties by a digest of role and text; null role and text
    are empty, rows with a null conv_id are left out, repeated rows are turns of their own. Texts count
    whole, an empty table gives an empty result, and further columns of any name are ignored.
    """
    return prefix_trie(written(rebuilt(written(sequences(rows), "sequences")), "rebuilt"), shard)
