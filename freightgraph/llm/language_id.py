"""Language ID: each document is a mixture of languages, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.llm.blocks import U64, Block, blocks, mix

BUCKETS = 1 << 16
PASSAGE = 64  # bytes
ROUNDS = 12
PENALTY = 0.5  # of one passage, for each language in the set
TEMPER = 1 / 3  # neighbouring trigrams share two bytes
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, byte position) of every byte trigram with a letter in its middle; letters are folded, all else in ASCII is blank, and so is what stands before and after a text."""
    size = np.diff(block.offsets)
    row = np.repeat(np.arange(block.n), size)
    b = np.full(len(block.data) + 2 * block.n + 2, 32, U64)
    middle = np.arange(len(block.data)) + 2 * row + 1
    b[middle] = _FOLD[block.data]
    own = np.flatnonzero(b[middle] != 32)
    row, middle = row[own], middle[own]
    value = b[middle - 1] | b[middle] << U64(8) | b[middle + 1] << U64(16)
    return (mix(value) % U64(BUCKETS)).astype(np.int64), row, np.maximum(own - 1, block.offsets[row])


def has_letters(block: Block) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_letter = _FOLD[block.data] != 32
    ascii_letter &= block.data < 128
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = sums[block.offsets[1:]] > sums[block.offsets[:-1]]
    for i in np.flatnonzero(~found):
        raw = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return found


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over every row of ``docs``; each task adds up its own before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for block in blocks(batches, "text"):
            bucket, row, _ = trigrams(block)
            names = np.asarray(block.batch.column(1).to_pylist(), object)
            for name in set(names):
                seen = np.bincount(bucket[(names == name)[row]], minlength=BUCKETS)
                totals[name] = totals.get(name, 0) + seen
        for name, seen in totals.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(seen[at])], ["lang", "bucket", "n"])

    rows = docs.select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages, the log probability of each trigram bucket in each (BUCKETS × languages), which buckets were seen at all, and each language's share of rows."""

    def __init__(self, languages: list[str], logs: np.ndarray, seen: np.ndarray, prior: np.ndarray):
        self.languages, self.logs, self.seen, self.prior = languages, logs, seen, prior

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
        """From all labelled rows of ``docs``. The driver gets one count for each language and bucket, 256 kB of model a language."""
        rows = docs.select(docs[lang].cast("string").alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
        known = {r["lang"]: r["n"] for r in rows.collect()}
        languages = sorted(known)
        counts = np.full((BUCKETS, len(languages)), 0.5)
        table = trigram_counts(docs, text, lang).toPandas()
        number = {name: i for i, name in enumerate(languages)}
        counts[table["bucket"].to_numpy(np.int64), table["lang"].map(number).to_numpy(np.int64)] += table["n"].to_numpy(float)
        prior = np.array([known[name] for name in languages], float)
        logs = np.log(counts / counts.sum(axis=0)).astype(np.float32) if languages else counts
        return cls(languages, logs, (counts > 0.5).any(axis=1), prior / max(prior.sum(), 1))

    def shares(self, block: Block) -> np.ndarray:
        """Rows × languages: each text's proportions, 0 for languages outside its set.

        A text is cut into passages of PASSAGE bytes, each written in one language. The maximisation
        step takes PENALTY passages from every language before it divides, so a language whose
        passages do not pay for it leaves the set: a penalised likelihood chooses the set on the way.
        A text of trigrams that no language has gets the language of the most rows, with its share of them.
        """
        n, m = block.n, len(self.languages)
        out = np.zeros((n, m))
        bucket, row, at = trigrams(block)
        if not len(bucket) or not m:
            return out
        passage = (at - block.offsets[row]) // PASSAGE
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (passage[1:] != passage[:-1])
        heads = np.flatnonzero(new)
        fit = np.add.reduceat(self.logs[bucket], heads, axis=0).astype(float) * TEMPER
        weight = np.diff(np.append(heads, len(row))) / PASSAGE
        likely = np.exp(fit - fit.max(axis=1, keepdims=True))
        doc = row[heads]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        which = doc[first]
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
        mixture = np.full((len(first), m), 1 / m)
        for _ in range(ROUNDS):
            part = likely * mixture[place]
            part *= (weight / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            held = np.add.reduceat(part, first, axis=0)
            left = np.maximum(held - PENALTY, 0)
            # a text too short to pay for any language keeps its likeliest one
            none = left.sum(axis=1) == 0
            left[none] = np.where(held[none] == held[none].max(axis=1, keepdims=True), held[none] + 1e-12, 0)
            mixture = left / left.sum(axis=1, keepdims=True)
        out[which] = mixture
        strange = which[np.add.reduceat(self.seen[bucket], heads[first]) == 0]
        likeliest = self.prior.argmax()
        out[strange] = np.where(np.arange(m) == likeliest, self.prior[likeliest], 0)
        return out


def identify_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score, languages, *keep) for every row; one pass, no shuffle.

    ``lang_pred`` is the language with the largest share (the first by name on a tie), ``score`` its
    share, ``languages`` the chosen set, comma-joined by name. A null text, or one without a letter, is
    ``und`` with score 0; so is any under a model that has seen no language. Whole texts count, of any length; repeated rows are judged each; an empty table gives an
    empty result; columns not named in ``keep`` are ignored. Texts go to Python only one way: what is
    kept stays with Spark.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.seen, model.prior))  # BUCKETS values a language, however many rows there are

    @F.arrow_udf("lang_pred string, score double, languages string")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = LanguageModel(*shared.value)
        names = np.asarray([*known.languages, UNKNOWN], object)
        for texts in batches:
            predicted, scores, sets = [], [], []
            for block in blocks([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
                shares = known.shares(block)
                found = has_letters(block) & (shares.sum(axis=1) > 0)
                best = np.where(found, shares.argmax(axis=1) if shares.shape[1] else 0, len(names) - 1)
                predicted += names[best].tolist()
                scores.append(np.where(found, shares.max(axis=1, initial=0), 0.0))
                sets += [",".join(names[:-1][s > 0]) for s in shares]
            yield pa.StructArray.from_arrays([pa.array(predicted, pa.string()), pa.array(np.concatenate([*scores, np.empty(0)])), pa.array(sets, pa.string())], ["lang_pred", "score", "languages"])

    judged = docs.select(key, *keep, judge(docs[text].cast("string")).alias("_judged"))
    return judged.select(key, "_judged.lang_pred", "_judged.score", F.when(F.col("_judged.lang_pred") == UNKNOWN, "").otherwise(F.col("_judged.languages")).alias("languages"), *keep)
