"""Near-duplicates by the similarity of shingle sets: SimHash tiles within candidate groups, links checked exactly.

All pairs of a corpus are too many to compare. Texts that share a band of least shingle hashes are linked
to one of them, a star for each band; the components of these stars are the candidate groups. Within a
group every pair is compared by the bits of a wide SimHash, in tiles, and what is near is counted exactly.
Only the links of spanning forests leave a task, so rows grow with the texts, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import U64, Block, blocks, byte_table, gram_hashes, mix, span_hashes, word_spans
from freightgraph.llm.simhash import SEED, fingerprint, joining
from freightgraph.operators.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of least hashes. A pair of similarity s shares none of them with probability (1 − s^LEAST)^BANDS: 3 in 100,000 at 0.8,
#: and sharing a group by way of other texts is enough to be compared.
BANDS, LEAST = 20, 4
#: Bits compared within a group: sets of similarity 0.8 differ in 78 of 512 on average with a deviation of 8, at the
#: worst (four shingles of five) in 96; the radius lies four deviations beyond.
PARTS, RADIUS = 8, 128
TILE_GRAMS, TILE_ROWS = 1 << 20, 16_384  # shingles and rows of one tile (a longer text is a tile of its own)
_ROWS, _COLS = 128, 2048  # compared at once
_ROW_GRAMS = 1 << 16

#: Words lie between the six ASCII blanks; A–Z are lower-cased.
_PART, _FOLD = byte_table(" \t\n\x0b\x0c\r")
_FACTORS = mix(np.arange(1, BANDS * LEAST + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in order, one row after another, and where each row's begin (n + 1)."""
    starts, ends, first = word_spans(block, _PART)
    hashes, _, place = gram_hashes(span_hashes(_FOLD[block.data], starts, ends), first, k)
    row = np.repeat(np.arange(block.n), np.diff(place))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(block.n + 1))


def bands(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows × BANDS: each band's least hashes as one word; equal sets have equal bands, the empty set the zero hash throughout."""
    filled = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, BANDS), U64)
    for band in range(BANDS):
        word = np.full(len(filled), band + 1, U64)
        for f in _FACTORS[band * LEAST : (band + 1) * LEAST]:
            if len(filled):
                word = mix(word ^ np.minimum.reduceat(grams * f, at[filled]))
        out[filled, band] = word
    return out


def described(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(row, key, digest, bands): a hash of key and text, one word that stands for the set of shingles, the set's bands."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            grams, at = shingle_sets(block, k)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams + U64(SEED)), dtype=U64)])
            digest = pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (block.n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands(grams, at).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(1), digest, lists], ["row", "key", "digest", "bands"])

    rows = docs.select(row_hash(docs, key, text).alias("row"), docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, key {kind}, digest long, bands array<long>")


def row_hash(docs: DataFrame, key: str, text: str):
    return F.xxhash64(docs[key], docs[text])


def candidate_groups(known: DataFrame) -> DataFrame:
    """(digest, component): sets that reach each other over shared bands; ``known`` has (digest, bands), each set once.

    A band's sets are all linked to the least of them, so a band of m sets gives m − 1 links.
    """
    each = known.select("digest", F.explode("bands").alias("band"))
    firsts = each.groupBy("band").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first < last").select("band", "first")
    stars = each.join(firsts, "band").where("digest != first").select("digest", "first").distinct()
    return connected_components(stars, "digest", "first").withColumnRenamed("node", "digest")


def group_sets(docs: DataFrame, text: str, k: int, wanted: DataFrame, condition) -> DataFrame:
    """(component, digest, n, prints, grams) of the rows of ``docs`` that meet ``wanted`` (component, digest)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            grams, at = shingle_sets(block, k)
            prints = np.asarray([fingerprint(grams[a:b], PARTS) for a, b in zip(at[:-1], at[1:], strict=True)], U64).reshape(-1)
            every = pa.array(np.arange(0, (block.n + 1) * PARTS, PARTS, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(every, pa.array(prints.view(np.int64))), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(1), pa.array(np.diff(at)), *lists], ["component", "digest", "n", "prints", "grams"])

    rows = docs.join(wanted, condition).select("component", "digest", docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "component long, digest long, n long, prints array<long>, grams array<long>")


def dealt(sets: DataFrame) -> DataFrame:
    """``sets`` once for each task that needs them: (bucket, c, i, d, j, is_left, …).

    Groups that fit into a tile share buckets. A larger group is dealt by size class: sets of similarity
    s differ in size by a factor of s at least, so those of classes that are not neighbours never meet;
    each class is split into tiles, and each pair of tiles (c, i)–(d, j) is one task.
    """
    size = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1 / SIMILARITY))).cast("int")
    sized = sets.withColumn("c", size)
    totals = sets.groupBy("component").agg(F.sum("n").alias("grams_all"), F.count("*").alias("rows_all"))
    large = totals.where(f"grams_all > {TILE_GRAMS} or rows_all > {TILE_ROWS}").select("component")
    small = totals.where(f"grams_all <= {TILE_GRAMS} and rows_all <= {TILE_ROWS}").select("component", "grams_all")
    whole = small.agg(F.sum("grams_all")).first()[0] or 0
    buckets = max(8, 2 * whole // TILE_GRAMS)
    columns = ["component", "digest", "n", "prints", "grams"]
    none = F.lit(0)
    apart = sized.join(small, "component").select(
        F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"), F.lit(-1).alias("c"), none.alias("i"), F.lit(-1).alias("d"), none.alias("j"), F.lit(True).alias("is_left"), *columns)
    tiles = sized.join(large, "component").groupBy("component", "c").agg(
        F.greatest(F.ceil(F.sum("n") / TILE_GRAMS), F.ceil(F.count("*") / TILE_ROWS)).cast("int").alias("tiles"))
    upper = tiles.select("component", (F.col("c") - 1).alias("c"), F.col("tiles").alias("above"))
    lower = tiles.select("component", (F.col("c") + 1).alias("c"), F.col("tiles").alias("below"))
    plan = tiles.join(upper, ["component", "c"], "left").join(lower, ["component", "c"], "left")
    placed = sized.join(plan, ["component", "c"]).withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int"))
    each = lambda n, where=None: F.when(F.coalesce(n, none) > 0, F.sequence(none, F.coalesce(n, none) - 1)).otherwise(F.array().cast("array<int>"))
    to = lambda c, i, d, j, is_left: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), F.lit(is_left).alias("is_left"))
    c, tile = F.col("c"), F.col("tile")
    meets = F.concat(
        F.transform(F.filter(each(F.col("tiles")), lambda j: j >= tile), lambda j: to(c, tile, c, j, True)),
        F.transform(F.filter(each(F.col("tiles")), lambda j: j < tile), lambda j: to(c, j, c, tile, False)),
        F.transform(each(F.col("above")), lambda j: to(c, tile, c + 1, j, True)),
        F.transform(each(F.col("below")), lambda j: to(c - 1, j, c, tile, False)),
    )
    split = placed.withColumn("m", F.explode(meets)).select(F.col("component").alias("bucket"), "m.*", *columns)
    return apart.unionByName(split)


@dataclass
class Sets:
    """Rows of a task: bits (rows × PARTS), and grams of row r from at[r] to at[r + 1]."""

    prints: np.ndarray
    grams: np.ndarray
    at: np.ndarray

    def bit_rows(self, rows: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
        """Rows × words: which grams of the sorted ``vocabulary`` each row has."""
        out = np.zeros((len(rows), -(-len(vocabulary) // 64)), U64)
        if not len(vocabulary):
            return out
        n = self.at[rows + 1] - self.at[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        spot = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[rows], n)
        value = self.grams[spot]
        place = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
        held = vocabulary[place] == value
        np.bitwise_or.at(out, (owner[held], place[held] >> 6), U64(1) << (place[held] & 63).astype(U64))
        return out

    def vocabulary(self, rows: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.grams[self.at[r] : self.at[r + 1]] for r in rows.tolist()]))


def alike(sets: Sets, rows: np.ndarray, cols: np.ndarray, similarity: float):
    """A function of places (i in ``rows``, j in ``cols``) that says which pairs of sets are that similar, exactly."""
    words = sets.vocabulary(rows)
    a, b = sets.bit_rows(rows, words), sets.bit_rows(cols, words)
    na, nb = sets.at[rows + 1] - sets.at[rows], sets.at[cols + 1] - sets.at[cols]
    step = max(1, (1 << 20) // max(1, a.shape[1]))

    def judge(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(i), np.int64)
        for s in range(0, len(i), step):
            shared[s : s + step] = np.bitwise_count(a[i[s : s + step]] & b[j[s : s + step]]).sum(axis=1)
        return shared >= similarity * (na[i] + nb[j] - shared) - 1e-9

    return judge


def row_blocks(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of at most _ROWS rows and (but for a longer text) _ROW_GRAMS grams."""
    i = 0
    ends = np.cumsum(sizes[rows])
    while i < len(rows):
        done = ends[i - 1] if i else 0
        j = min(i + _ROWS, max(i + 1, int(np.searchsorted(ends, done + _ROW_GRAMS, "right"))))
        yield rows[i:j]
        i = j


def exact_forest(sets: Sets, left: np.ndarray, right: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between rows ``left`` and ``right`` (the same array: all pairs within).

    A pair is tried if its bits differ in ``radius`` places or fewer and its sizes allow the similarity;
    a link is a pair that passes the exact count. Of each block's pairs the nearest that would join two
    trees are tried first, then what is left; pairs of one tree are not tried at all.
    """
    sizes = np.diff(sets.at)
    tree = np.arange(len(sizes))
    same = left is right
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for rows in row_blocks(left, sizes):
        for s in range(0, len(right), _COLS):
            cols = right[s : s + _COLS]
            close = tree[rows][:, None] != tree[cols][None, :]
            low, high = np.minimum(sizes[rows][:, None], sizes[cols][None, :]), np.maximum(sizes[rows][:, None], sizes[cols][None, :])
            close &= low >= similarity * high - 1e-9
            if same:
                close &= rows[:, None] < cols[None, :]
            if not close.any():
                continue
            apart = np.zeros(close.shape, np.int16)
            for p in range(sets.prints.shape[1]):
                apart += np.bitwise_count(sets.prints[rows, p][:, None] ^ sets.prints[cols, p][None, :])
            i, j = np.nonzero(close & (apart <= radius))
            nearest = np.argsort(apart[i, j], kind="stable")
            i, j = i[nearest], j[nearest]
            if not len(i):
                continue
            judge = alike(sets, rows, cols, similarity)
            for turn in range(3):
                x, y = rows[i], cols[j]
                trial = joining(tree, x, y)[1] if turn < 2 else tree[x] != tree[y]
                if not trial.any():
                    break
                ok = trial.copy()
                ok[trial] = judge(i[trial], j[trial])
                tree, needed = joining(tree, x[ok], y[ok])
                found.append((x[ok][needed], y[ok][needed]))
                rest = ~trial & (tree[x] != tree[y])
                i, j = i[rest], j[rest]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def compare(table: pa.Table, similarity: float, radius: int) -> pa.Table:
    """Links (a, b: digests) of one bucket of small groups, or of one pair of tiles."""
    table = table.combine_chunks()
    column = lambda n: table.column(n).combine_chunks() if isinstance(table.column(n), pa.ChunkedArray) else table.column(n)
    digest, component, left = (column(n).to_numpy(zero_copy_only=False) for n in ("digest", "component", "is_left"))
    flat = lambda n: (column(n).flatten().to_numpy().view(U64), np.concatenate([[0], np.cumsum(column(n).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64))
    prints, (grams, at) = flat("prints")[0].reshape(-1, PARTS), flat("grams")
    sets = Sets(prints, grams, at)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if column("c")[0].as_py() < 0:
        order = np.argsort(component, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            out.append(exact_forest(*part(sets, members), similarity, radius))
            out[-1] = (members[out[-1][0]], members[out[-1][1]])
    else:
        one = column("i")[0].as_py() == column("j")[0].as_py() and column("c")[0].as_py() == column("d")[0].as_py()
        a = np.flatnonzero(left)
        out.append(exact_forest(sets, a, a if one else np.flatnonzero(~left), similarity, radius))
    x, y = (np.concatenate(side) if side else np.empty(0, np.int64) for side in zip(*out, strict=True))
    return pa.table({"a": digest[x], "b": digest[y]})


def part(sets: Sets, members: np.ndarray) -> tuple[Sets, np.ndarray, np.ndarray]:
    """The sets of some rows, and all their numbers twice."""
    n = sets.at[members + 1] - sets.at[members]
    at = np.concatenate([[0], np.cumsum(n)])
    spot = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(sets.at[members], n)
    every = np.arange(len(members))
    return Sets(sets.prints[members], sets.grams[spot], at), every, every


def one_of_each(docs: DataFrame, key: str, text: str, twins: DataFrame) -> DataFrame:
    """``docs`` with one row of those that agree in key and text; ``twins`` (row) are the hashes of such rows."""
    same = row_hash(docs, key, text) == twins["row"]
    return docs.join(twins, same, "left_anti").unionByName(docs.join(twins, same, "left_semi").dropDuplicates([key, text]))


def grouped(docs: DataFrame, key: str, text: str, k: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(row, key, component) of every row, and (row) of those that occur more than once."""
    prints = written(described(docs, key, text, k), "described")
    twins = written(prints.groupBy("row").agg(F.count("*").alias("m")).where("m > 1").select("row"), "twins")
    known = written(prints.select("digest", "bands").distinct(), "sets")
    groups = candidate_groups(known)
    wanted = written(prints.join(groups, "digest").groupBy("component", "digest").agg(F.min("row").alias("row")), "wanted")
    once = one_of_each(docs.select(key, text), key, text, twins)
    sets = written(group_sets(once, text, k, wanted, row_hash(once, key, text) == wanted["row"]), "group_sets")
    links = dealt(sets).groupBy("bucket", "c", "i", "d", "j").applyInArrow(lambda t: compare(t, similarity, radius), "a long, b long")
    found = connected_components(links, "a", "b")
    rows = prints.select("row", "key", "digest").join(found, F.col("digest") == F.col("node"), "left")
    return written(rows.select("row", "key", F.coalesce("component", "digest").alias("component")), "grouped"), twins


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, component_id) for every row: the smallest key that can be reached over links.

    Two rows link if their sets of k-word shingles (64-bit hashes; a text of fewer words has one, a
    text without words none) have at least ``similarity`` in common, intersection over union; equal
    sets always link. Null, empty and blank texts have the empty set and are one group; repeated rows
    share theirs; rows of one key with different texts are judged each; null keys come last, and a group
    of null keys only has a null id. Texts of any length are compared whole. An empty table gives an
    empty result; other columns are ignored.
    """
    rows, _ = grouped(docs, key, text, k, similarity, radius)
    least = rows.groupBy("component").agg(F.min("key").alias("component_id"))
    return rows.join(least, "component").select(F.col("key").alias(key), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of each group of ``near_duplicate_groups``: that of the smallest key (of several texts under it, any one, always the same).

    Rows are told apart by key and text, so of rows that repeat both one stays, and a row is not lost
    for what another text under its key is like. A null key counts as the largest. All columns are kept;
    their names do not matter.
    """
    rows, twins = grouped(docs, key, text, k, similarity, radius)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("best"), F.count("*").alias("m")).where("m > 1")
    others = written(rows.join(best, "component").where(F.col("row") != F.col("best.row")).select("row").distinct(), "others")
    return one_of_each(docs.join(others, row_hash(docs, key, text) == others["row"], "left_anti"), key, text, twins)
