"""SimHash near-duplicates: tiled exact comparison of fingerprints, then components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import U64, blocks, mix
from freightgraph.operators.components import connected_components

SEED = 42
TILE_ROWS = 16_384
_SUB, _COLS = 128, 2048  # rows and columns that are compared at once, small enough for a core's cache


def shingles(text: bytes, k: int) -> list[bytes]:
    """All k-word shingles, repeats included; all words if there are fewer; none without words."""
    words = text.lower().split()  # bytes: only A–Z change, only the six ASCII spaces split
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *stops[: -k].tolist()]
    return [joined[a:b] for a, b in zip(starts, (stops[k - 1 :] - 1).tolist(), strict=True)]


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    grams = shingles(text, k)
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), U64, len(grams))


def fingerprint(hashes: np.ndarray, parts: int) -> list[int]:
    """``parts`` words of 64 bits; a bit is set if it is set in over half the shingles' hashes."""
    if not len(hashes):
        return [0] * parts
    out = []
    for _ in range(parts):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 4096):
            bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.uint32)
        out.append(int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(U64)[0]))
        hashes = mix(hashes + U64(0x9E3779B97F4A7C15))
    return out


def fingerprints(docs: DataFrame, key: str, text: str, k: int, parts: int) -> DataFrame:
    """(key, f0, … as signed longs) for every row; reads two columns, no shuffle."""
    kind = dict(docs.dtypes)[key]
    names = [f"f{i}" for i in range(parts)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            raw = block.data.tobytes()
            found = [fingerprint(shingle_hashes(raw[a:b], k), parts) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            words = np.asarray(found, U64).reshape(-1, parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.batch.column(0), *(pa.array(words[:, i]) for i in range(parts))], ["key", *names])

    schema = f"key {kind}, " + ", ".join(f"{n} long" for n in names)
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def joining(tree: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trees after the links x–y, and which of these links were needed to join them."""
    needed = np.zeros(len(x), bool)
    at = np.arange(len(x))
    while True:
        tx, ty = tree[x[at]], tree[y[at]]
        apart = tx != ty
        at, tx, ty = at[apart], tx[apart], ty[apart]
        if not len(at):
            return tree, needed
        # one link per tree at a time, so no two chosen links can close a cycle
        low, high = np.minimum(tx, ty), np.maximum(tx, ty)
        _, one = np.unique(high, return_index=True)
        needed[at[one]] = True
        parent = np.arange(len(tree))
        parent[high[one]] = low[one]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        tree = parent[tree]


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between rows of ``left`` and ``right`` (n × parts words).

    Every pair is compared, except where the first words' population counts in each 16-bit quarter
    already differ by more than ``radius`` together, which no pair within it can. Only links that join
    two trees are returned, so a group of m rows yields m − 1 of them, not m²; links of few differing
    bits come first.
    """
    quarter = lambda x: np.bitwise_count(np.ascontiguousarray(x[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int8)
    ql, qr = quarter(left), quarter(right)
    rank = np.lexsort(ql.T)
    kinds, place = np.unique(qr, axis=0, return_inverse=True)
    members = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[members], np.arange(len(kinds) + 1))
    shift = 0 if same else len(left)
    tree = np.arange(len(left) + (0 if same else len(right)))
    # so many words of all pairs are compared (three at most, a byte holds their count), the others where these are
    # close: by chance they differ in 32 bits a word with a deviation of 4, three deviations must stay beyond the radius
    wide = next((w for w in range(1, 3) if 32 * w - 12 * w**0.5 > radius), 3)
    wide = min(wide, left.shape[1])
    order = np.random.default_rng(SEED)
    a: list[int] = []
    b: list[int] = []
    prune = radius < 16
    step = _SUB // 2 if prune else _SUB
    for i in range(0, len(rank), step):
        rows = rank[i : i + step]
        if prune:
            low, high = ql[rows].min(axis=0), ql[rows].max(axis=0)
            far = np.maximum(np.maximum(low - kinds, kinds - high), 0).sum(axis=1)
            near = np.flatnonzero(far <= radius)
            columns = np.concatenate([members[bounds[q] : bounds[q + 1]] for q in near]) if len(near) else np.empty(0, np.int64)
        else:
            columns = np.arange(len(right))
        for j in range(0, len(columns), _COLS):
            cols = columns[j : j + _COLS]
            apart = np.bitwise_count(left[rows, 0][:, None] ^ right[cols, 0][None, :])
            for p in range(1, wide):
                apart = apart + np.bitwise_count(left[rows, p][:, None] ^ right[cols, p][None, :])
            close = apart <= radius
            if not close.any():
                continue
            ii, jj = np.nonzero(close)
            total = apart[ii, jj].astype(np.int16)
            for p in range(wide, left.shape[1]):
                total += np.bitwise_count(left[rows[ii], p] ^ right[cols[jj], p])
            keep = total <= radius
            x, y, total = rows[ii[keep]], cols[jj[keep]], total[keep]
            keep = tree[x] != tree[y + shift]
            if same:
                keep &= x < y
            x, y, total = x[keep], y[keep], total[keep]
            nearest = np.lexsort((order.random(len(x)), total))  # ties at random, so no row gets most of the links
            x, y = x[nearest], y[nearest]
            tree, needed = joining(tree, x, y + shift)
            a += x[needed].tolist()
            b += y[needed].tolist()
    return np.asarray(a, np.int64), np.asarray(b, np.int64)


def link_fingerprints(prints: DataFrame, parts: int, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b: ids of distinct fingerprints) whose components are those of all pairs within ``radius``.

    ``prints`` has ``id`` and the words f0, …. Rows are dealt into tiles of one population count (of
    f0) each; tiles whose counts differ by more than ``radius`` never meet. Each remaining pair of
    tiles is one group of at most about 2 · ``tile_rows`` rows.
    """
    words = [f"f{i}" for i in range(parts)]
    ones = F.bit_count("f0").cast("int")
    sizes = {r["p"]: r["n"] for r in prints.groupBy(ones.alias("p")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    split = {p: -(-n // tile_rows) for p, n in sizes.items()}
    spark = prints.sparkSession
    base, tiles = {}, 0
    for p in sorted(split):
        base[p], tiles = tiles, tiles + split[p]
    if not tiles:
        return spark.createDataFrame([], "a long, b long")
    plan = spark.createDataFrame(
        [(p, base[p], split[p], [base[q] + s for q in sorted(split) if 0 <= q - p <= radius for s in range(split[q])],
          [base[q] + s for q in sorted(split) if 0 <= p - q <= radius for s in range(split[q])]) for p in sorted(split)],
        "p int, base int, split int, above array<int>, below array<int>",
    )
    tiled = (
        prints.withColumn("p", ones).join(F.broadcast(plan), "p")
        .withColumn("tile", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("split"))).cast("int"))
    )
    left = tiled.select(F.explode("above").alias("with"), "tile", "id", *words).where("with >= tile").select(
        F.col("tile").alias("i"), F.col("with").alias("j"), F.lit(True).alias("is_left"), "id", *words)
    right = tiled.select(F.explode("below").alias("with"), "tile", "id", *words).where("with < tile").select(
        F.col("with").alias("i"), F.col("tile").alias("j"), F.lit(False).alias("is_left"), "id", *words)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        side = group["is_left"].to_numpy()
        ids, bits = group["id"].to_numpy(), np.ascontiguousarray(group[words].to_numpy()).view(U64)
        same = bool(side.all())
        other = slice(None) if same else ~side
        if group["i"].iloc[0] != group["j"].iloc[0] and (same or not side.any()):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        a, b = forest(bits[side], bits[other], radius, same)
        return pd.DataFrame({"a": ids[side][a], "b": ids[other][b]})

    return left.unionByName(right).groupBy("i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, parts: int = 1, radius: int = 4, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(key, f0, …, component_id) for every row of ``docs``; the key is a long.

    ``component_id`` is the smallest key that can be reached over links, where two rows link if their
    64 · ``parts`` fingerprint bits differ in ``radius`` places or fewer. Equal fingerprints meet in a
    partly aggregated group first, so copies never form pairs. The comparison of distinct fingerprints
    is exact and costs their number squared over the share of skipped tiles. A null, empty or blank text
    has fingerprint zero and links like any other; repeated rows share their component; rows that share
    a key but not a text each link, and the key's component then joins what either reaches; an empty
    table gives an empty result; other columns are ignored. A null key never stands for a component.
    """
    words = [f"f{i}" for i in range(parts)]
    prints = written(fingerprints(docs, key, text, k, parts), "fingerprints")
    distinct = written(prints.groupBy(*words).agg(F.min("key").alias("id")), "distinct")
    links = link_fingerprints(distinct.where("id is not null"), parts, radius, tile_rows)
    found = connected_components(links, "a", "b")
    # the smallest key in a component of representatives is the smallest key of all its rows
    return (
        prints.join(distinct.join(found, F.col("id") == F.col("node"), "left").select(*words, F.coalesce("component", "id").alias("component_id")), words)
        .withColumnRenamed("key", key).select(key, *words, "component_id")
    )
