"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import U64, Block, blocks, mix

LEAST, MOST = 16, 112  # bytes
MIN_WORDS = 16
HOT_PARTS = 1000
REACH = 192  # bytes looked at beyond a run
_MASK = U64(31)  # a cut at one byte in 32, before the least size
_WINDOW = 16  # the bits that the mask looks at depend on this many bytes
#: The gear table: one 64-bit value for each byte, from the mixing function.
GEAR = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[byte i−j] << j over the last 16 bytes, by doubling the window."""
    h = GEAR[data]
    reach = 1
    while reach < _WINDOW:
        longer = h.copy()
        longer[reach:] += h[:-reach] << U64(reach)
        h, reach = longer, 2 * reach
    return h


def cut_points(block: Block, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """For each row, the ends of its chunks (byte positions in the block).

    A chunk ends before the first word that follows a gear hit, at least ``least`` and (but for a long
    word) about ``most`` bytes after it began, so cuts depend on nearby content only and come back into
    step after an insertion. Without a hit the chunk is cut at ``most``, at a character's first byte.
    """
    data, offsets = block.data, block.offsets
    if not len(data):
        return [[] for _ in range(block.n)]
    hits = np.flatnonzero((gear_hashes(data) >> U64(20)) & _MASK == 0)
    hits = hits[hits - offsets[block.doc_of(hits)] >= _WINDOW - 1]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    after = np.searchsorted(begins, hits, "right")
    marks = np.unique(begins[after[after < len(begins)]])
    bounds = np.searchsorted(marks, offsets)
    out = []
    for i in range(block.n):
        last, end = int(offsets[i]), int(offsets[i + 1])
        cuts: list[int] = []
        for c in [*marks[bounds[i] : bounds[i + 1]].tolist(), end]:
            while c - last > most:
                at = last + most
                while data[at] & 0xC0 == 0x80 and at > last + 1:
                    at -= 1
                cuts.append(at)
                last = at
            if c - last >= least or (c == end and c > last):
                cuts.append(c)
                last = c
        out.append(cuts)
    return out


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, start, length, words, d1, d2, again): every chunk with its 128-bit digest, and whether its text has it before. Bytes of UTF-8."""
    kind = dict(docs.dtypes)[key]
    names = ["key", "seq", "start", "length", "words", "d1", "d2", "again"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            cuts = cut_points(block)
            count = np.fromiter(map(len, cuts), np.int64, len(cuts))
            ends = np.fromiter((c for row in cuts for c in row), np.int64, int(count.sum()))
            if not len(ends):
                continue
            row = np.repeat(np.arange(block.n), count)
            head = np.cumsum(count) - count
            seq = np.arange(len(ends)) - head[row]
            starts = np.where(seq == 0, block.offsets[row], np.concatenate([[0], ends[:-1]]))
            raw = block.data.tobytes()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64).reshape(-1, 2)
            blank = (block.data == 32) | ((block.data >= 9) & (block.data <= 13))
            edge = blank.copy()
            edge[1:] = ~blank[1:] & blank[:-1]
            edge[0] = not blank[0]
            edge[block.offsets[:-1][block.offsets[:-1] < len(raw)]] = True
            words = np.concatenate([[0], np.cumsum(edge)])
            again = np.ones(len(ends), bool)
            again[np.unique(mix(digests[:, 0].view(U64) + mix(row.astype(U64))), return_index=True)[1]] = False
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0).take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(starts - block.offsets[row]), pa.array((ends - starts).astype(np.int32)),
                 pa.array((words[ends] - words[starts]).astype(np.int32)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(again)], names)

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(run, f"key {kind}, seq int, start long, length int, words int, d1 long, d2 long, again boolean")


BLANKS = b" \t\n\x0b\x0c\r"


def agreement(a: bytes, b: bytes, reach: int = REACH) -> tuple[int, int, bool]:
    """(bytes to the last word boundary, bytes that agree, whether it may go on) of two texts' beginnings, looked at for ``reach`` bytes.

    A boundary is where both texts end, or a blank stands before or after. The same holds for ends of
    texts read backwards.
    """
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        n = least
    else:
        n = int(np.argmax(np.frombuffer(a, np.uint8, least) != np.frombuffer(b, np.uint8, least)))
    whole = n == reach
    stops = lambda x: (n == len(x) and n < reach) or (n < len(x) and x[n] in BLANKS)
    if n and (a[n - 1] in BLANKS or (stops(a) and stops(b))):
        return n, n, whole
    return 1 + max(a.rfind(c, 0, n) for c in BLANKS_EACH) if n else 0, n, whole


BLANKS_EACH = [bytes([c]) for c in BLANKS]


def _windows(docs: DataFrame, asked: DataFrame, kind: str, reach: int) -> DataFrame:
    """(doc, pos, back, w): ``reach`` bytes of a text from pos on, or back from it, reversed. asked: doc, pos, back. Rows of one id with different texts give the least."""
    names = ["doc", "pos", "back", "w"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bool, bytes]] = []
            for i, (text, at) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                raw = text.as_py().encode()
                for p in at.as_py():
                    pos, back = p["pos"], p["back"]
                    out.append((i, pos, back, raw[max(0, pos - reach) : pos][::-1] if back else raw[pos : pos + reach]))
            if out:
                row, pos, back, w = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos), pa.array(back), pa.array(w, pa.binary())], names)

    lists = asked.groupBy("doc").agg(F.collect_set(F.struct("pos", "back")).alias("at"))  # no more than a text has chunks
    found = docs.join(lists, "doc").select("doc", "text", "at").mapInArrow(run, f"doc {kind}, pos long, back boolean, w binary")
    return found.groupBy("doc", "pos", "back").agg(F.min("w").alias("w"))


def _extended(batches: Iterable[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Edges a window further: ``taken`` bytes and ``words`` are sure, ``loose`` bytes agree but have met no boundary yet."""
    names = ["key", "start", "back", "pos", "doc2", "pos2", "taken", "words", "loose", "open"]
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        taken, words, loose = column("taken"), column("words"), column("loose")
        moved, going = [], []
        for i, (a, b) in enumerate(zip(column("w"), column("w2"), strict=True)):
            sure, n, whole = agreement(a, b, reach)
            at_blank = not a or a[0] in BLANKS
            if sure or (not n and loose[i] and at_blank and (not b or b[0] in BLANKS)):
                taken[i] += loose[i] + sure
                words[i] += len(a[:sure].split()) + (loose[i] > 0 and at_blank)
                loose[i] = 0
                moved.append(sure)
            else:
                moved.append(n if whole else 0)
                loose[i] = loose[i] + n if whole else 0
            going.append(whole)
        step = np.asarray(moved, np.int64) * np.where(np.asarray(column("back"), bool), -1, 1)
        own, other = (np.asarray(column(c), np.int64) + step for c in ("pos", "pos2"))
        keep = {c: batch.column(batch.schema.get_field_index(c)) for c in ("key", "start", "back", "doc2")}
        yield pa.RecordBatch.from_arrays(
            [keep["key"], keep["start"], keep["back"], pa.array(own), keep["doc2"], pa.array(other), pa.array(taken, pa.int64()), pa.array(words, pa.int64()), pa.array(loose, pa.int64()), pa.array(going, pa.bool_())], names)


def _extensions(texts: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    """(key, start, left, right, more): how many bytes each run goes on to either side as its holder does, to whole words, and their words.

    Windows of REACH bytes are compared, and of four times as many for as long as one agrees whole; equal text of that length mostly has a whole
    chunk in common with its holder's, so there is seldom a second look.
    """
    sides = F.explode(F.array(
        F.struct(F.lit(True).alias("back"), F.col("start").alias("pos"), F.col("left.doc").alias("doc2"), F.col("left.pos").alias("pos2")),
        F.struct(F.lit(False).alias("back"), (F.col("start") + F.col("length")).alias("pos"), F.col("right.doc").alias("doc2"), F.col("right.pos").alias("pos2")))).alias("s")
    zero = F.lit(0).cast("long")
    edges = runs.select("key", "start", sides).select("key", "start", "s.*").where(~F.col("back") | ((F.col("pos") > 0) & (F.col("pos2") > 0))).select("*", zero.alias("taken"), zero.alias("words"), zero.alias("loose"))
    schema = f"key {kind}, start long, back boolean, pos long, doc2 {kind}, pos2 long, taken long, words long, loose long, open boolean"
    done, reach = None, REACH
    while True:
        asked = edges.select(F.col("key").alias("doc"), "pos", "back").unionByName(edges.select(F.col("doc2").alias("doc"), F.col("pos2").alias("pos"), "back")).distinct()
        seen = written(_windows(texts, asked, kind, reach), "windows")
        own, other = seen.withColumnRenamed("doc", "key"), seen.select(F.col("doc").alias("doc2"), F.col("pos").alias("pos2"), "back", F.col("w").alias("w2"))
        met = written(edges.join(own, ["key", "pos", "back"]).join(other, ["doc2", "pos2", "back"]).mapInArrow(functools.partial(_extended, reach=reach), schema), "edges")
        found = met.where("not open")
        done = found if done is None else done.unionByName(found)
        edges = met.where("open").drop("open")
        if edges.isEmpty():
            break
        reach *= 4
    side = lambda back: F.coalesce(F.max(F.when(F.col("back") == back, F.col("taken"))), zero)
    return done.groupBy("key", "start").agg(side(True).alias("left"), side(False).alias("right"), F.sum("words").alias("more"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Stretches of each text that stand in a document with a smaller key: (key, start, length, n_chunks, n_words, first_key, holders).

    Texts are cut into content-defined chunks; a chunk's first holder is the smallest key whose text has
    it. Neighbouring chunks that all have earlier holders form one run, and a run goes on to both
    sides, to whole words, as far as its first and last chunk's holders read the same there. Runs that
    then meet or overlap are one span; spans of fewer than ``min_words`` words (standard lines, chance) are
    left alone. ``start`` and ``length`` are UTF-8 bytes; ``n_words`` are the words of the chunks and
    of the ends, those between two runs that overlap counted with both. ``first_<key>`` is the first holder of
    most of the run of most chunks (the smallest on a tie by chunk count), ``holders`` all first holders in it.

    The first holders come from a group partly aggregated before the shuffle, and only digests with two
    holders join back. A digest of more than one in HOT_PARTS chunks, of which there can be no more than
    HOT_PARTS, joins as a broadcast, so no task gets more than that share of one digest. The ends are compared as
    windows of REACH bytes, cut from the texts that have runs or hold them. Null and
    empty texts have no chunks; rows with a null key are left out; repeated rows of one key count as one
    holder, so they are not repeats of each other; repeats within one document are none either. An
    empty table gives an empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    cut = chunks(docs, key, text).where("key is not null")
    # of numbers alone, so that they are added up without sorting; the first holder has a chunk once that is not said again
    ends_of = cut.groupBy("d1", "d2").agg(F.min("key").alias("key"), F.min_by("start", F.when(~F.col("again"), F.col("key"))).alias("start"), F.max("key").alias("last"), F.count("*").alias("n"))
    held = written(ends_of.where("key < last").select("d1", "d2", F.struct("key", "start").alias("first"), "n"), "holders")
    share = (held.agg(F.sum("n")).first()[0] or 0) / HOT_PARTS
    hot = held.where(F.col("n") > share).select("d1", "d2", F.col("first").alias("hot_first"))
    shared = held.where(F.col("n") <= share).select(F.col("d1").alias("j1"), F.col("d2").alias("j2"), F.col("first").alias("cold_first"))
    # chunks of hot digests go on under keys of their own, spread over all tasks
    away = F.xxhash64("key", "seq")
    met = cut.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("j1", F.when(F.col("hot_first").isNull(), F.col("d1")).otherwise(away)).withColumn("j2", F.col("d2"))
    late = (
        met.join(shared, ["j1", "j2"], "left").withColumn("h", F.coalesce("hot_first", "cold_first"))
        .where("key > h.key").select("key", "seq", "start", "length", "words", F.col("h.key").alias("first"), F.col("h.start").alias("at")).distinct()
    )
    by_seq = Window.partitionBy("key").orderBy("seq")
    runs = written(
        late.withColumn("run", F.col("seq") - F.row_number().over(by_seq))
        .groupBy("key", "run")
        .agg(
            F.min("start").alias("start"), F.sum("length").cast("long").alias("length"), F.count("*").alias("n_chunks"),
            F.sum("words").cast("long").alias("n_words"), F.mode("first", deterministic=True).alias("first"), F.sort_array(F.collect_set("first")).alias("holders"),
            F.min_by(F.struct(F.col("first").alias("doc"), F.col("at").alias("pos")), "seq").alias("left"),
            F.max_by(F.struct(F.col("first").alias("doc"), (F.col("at") + F.col("length")).alias("pos")), "seq").alias("right"),
        ).drop("run"),
        "runs",
    )
    texts = docs.select(docs[key].alias("doc"), docs[text].cast("string").alias("text")).where("doc is not null and length(text) > 0")
    ends = _extensions(texts, runs, kind)
    zero = F.lit(0)
    whole = runs.drop("left", "right").join(ends, ["key", "start"], "left").select(
        "key", (F.col("start") - F.coalesce("left", zero)).alias("start"), (F.col("start") + F.col("length") + F.coalesce("right", zero)).alias("end"),
        "n_chunks", (F.col("n_words") + F.coalesce("more", zero)).alias("n_words"), "first", "holders")
    in_order = Window.partitionBy("key").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    joined = whole.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = joined.groupBy("key", "span").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_words").alias("n_words"),
        F.min(F.struct((-F.col("n_chunks")).alias("n"), "first")).alias("most"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("holders"))
    kept = spans.where(F.col("n_words") >= min_words)
    return kept.select(F.col("key").alias(key), "start", "length", "n_chunks", "n_words", F.col("most.first").alias(f"first_{key}"), "holders")


def drop_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans (start, length); where two words would meet, a blank at an end of what goes stays."""
    kept, at = [], 0
    for start, length in sorted(spans):
        kept.append(text[at:start])
        end = max(at, start + length)
        gone, before, after = text[max(at, start) : end], text[:start][-1:], text[end : end + 1]
        if gone and before and after and before not in BLANKS and after not in BLANKS:
            kept.append(gone[:1] if gone[:1] in BLANKS else gone[-1:] if gone[-1:] in BLANKS else b"")
        at = end
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every repeated span cut out of ``text``; same columns, same rows.

    The first holder keeps its passage. A text that is one whole repeat becomes empty; rows without
    repeats keep their text to the byte, null included, and so do rows with a null key. Repeated rows
    are cut alike. Columns of any name are kept; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, key, text, min_words).groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("start", "length")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        pairs = zip(texts, found, strict=True)
        return pd.Series([t if f is None else drop_spans(t.encode(), [(s["start"], s["length"]) for s in f]) for t, f in pairs], dtype=object)

    found = docs.join(spans, docs[key] == spans["_key"], "left")
    return found.select(*[cut(docs[text], spans["_spans"]).alias(text) if c == text else docs[c] for c in docs.columns])
