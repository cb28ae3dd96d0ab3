"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import U64, Block, blocks, byte_table, span_hashes, word_spans

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8, 9)  # bytes
WIDTH = 1 + len(PREFIXES)  # a word and its prefixes; as many columns again say that one occurs twice
SPAN = 2 * WIDTH * BUCKETS  # features
LEXICON_SUPPORT = 5
BROADCAST_LABELS = 2_000_000  # two numbers each
MAX_PATTERNS = 1_000_000  # of votes, broadcast to the rows; more are joined
#: The classifier uses features whose share of the labelled rows differs between the classes by so many deviations.
DEVIATIONS = 4.0
ROUNDS, SHRINK = 40, 1e-3  # of the classifier's fit, and its ridge penalty

#: Lexicon voters by language.
SEEDS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile retard freak filthy vermin bastard",
    "de": "idiot dumm dummkopf abschaum trottel arschloch widerlich versager drecksack hurensohn missgeburt schwachkopf",
    "fr": "idiot imbécile connard salope abruti ordure pourriture débile minable crétin enculé raclure",
    "es": "idiota imbécil estúpido basura escoria inútil asqueroso payaso cabrón pendejo gilipollas patético",
}
#: Pattern voters, as words of which one must stand directly before a word of the second list.
SECOND_PERSON = "you youre du ihr tu eres vous sie ustedes"
VERBS = "are is bist seid es êtes sind son suck disgust stink"
THREATS = "kill murder hang shoot burn töten umbringen tuer matar"
TARGETS = "you him her them yourself dich euch toi vous te los"

_PART, _FOLD = byte_table(ranges=[(0x00, 0x60), (0x7B, 0x7F)])
_PART[65:91] = True

PATTERNS = ("second_person", "threat", "shouting")
_COLUMNS = ("words", *(f"prefix_{p}" for p in PREFIXES))
VOTERS = (*(f"lexicon_{x}" for x in SEEDS), *PATTERNS, *(f"mined_{c}" for c in _COLUMNS), *(f"mined_{c}_twice" for c in _COLUMNS))


@functools.cache
def _word_hashes(words: str) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array([words])], ["text"])
    block = next(blocks([batch], "text"))
    starts, ends, _ = word_spans(block, _PART)
    return np.unique(span_hashes(_FOLD[block.data], starts, ends))


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, buckets: words × WIDTH) of every word: its bucket and its prefixes', −1 where the word is shorter."""
    starts, ends, first = word_spans(block, _PART)
    row = np.repeat(np.arange(block.n), np.diff(first))
    if not len(starts):
        return row, np.empty(0, U64), np.empty((0, WIDTH), np.int32)
    columns = span_hashes(_FOLD[block.data], starts, ends, *(np.minimum(ends, starts + p) for p in PREFIXES))
    buckets = np.stack([(c >> U64(46)).astype(np.int32) for c in columns], axis=1)
    for i, p in enumerate(PREFIXES):
        buckets[ends - starts < p, i + 1] = -1
    return row, columns[0], buckets


def distinct_features(row: np.ndarray, buckets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) once each, sorted; feature = column · BUCKETS + bucket. The second WIDTH columns hold what occurs twice or more.

    ``wanted`` (2 · WIDTH · BUCKETS) says which features are asked for.
    """
    span = SPAN
    pairs = []
    for i in range(WIDTH):
        b = buckets[:, i].astype(np.int64)
        keep = b >= 0
        if wanted is not None:
            once, twice = wanted[i * BUCKETS : (i + 1) * BUCKETS], wanted[(WIDTH + i) * BUCKETS : (WIDTH + i + 1) * BUCKETS]
            keep &= (once | twice)[b]
        at, n = np.unique(row[keep] * span + i * BUCKETS + b[keep], return_counts=True)
        pairs += [at, at[n > 1] + WIDTH * BUCKETS]
    pair = np.sort(np.concatenate(pairs))
    doc, found = pair // span, pair % span
    if wanted is not None:
        doc, found = doc[wanted[found]], found[wanted[found]]
    return doc, found


def fixed_votes(block: Block, row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bits of the lexicon and pattern voters for each row of the block."""
    bits = np.zeros(block.n, np.int64)

    def mark(rows: np.ndarray, voter: str) -> None:
        bits[np.unique(rows)] |= 1 << VOTERS.index(voter)

    isin = lambda text: np.isin(words, _word_hashes(text))
    for lang, text in SEEDS.items():
        mark(row[isin(text)], f"lexicon_{lang}")
    for voter, left, right in (("second_person", SECOND_PERSON, VERBS), ("threat", THREATS, TARGETS)):
        a, b = isin(left), isin(right)
        mark(row[1:][a[:-1] & b[1:] & (row[:-1] == row[1:])] if len(row) else row, voter)
    upper = (block.data >= 65) & (block.data <= 90)
    letters = _PART[block.data]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets])
    mark(np.flatnonzero((sums(upper) > 0.5 * np.maximum(sums(letters), 1)) & (sums(letters) >= 40)), "shouting")
    return bits


def mined_votes(n: int, doc: np.ndarray, found: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Bits of the mined voters: a row has a feature that the lexicon (a flag for each feature) has in the voter's column."""
    bits = np.zeros(n, np.int64)
    hit = lexicon[found]
    np.bitwise_or.at(bits, doc[hit], 1 << (len(SEEDS) + len(PATTERNS) + found[hit] // BUCKETS))
    return bits


@dataclass
class ToxicityModel:
    """The linear classifier's weights by feature and its intercept; what the voters are worth."""

    weights: np.ndarray
    intercept: float
    accuracies: dict[str, tuple[float, float]]
    correlations: np.ndarray

    def scores(self, block: Block) -> np.ndarray:
        row, _, buckets = features(block)
        doc, found = distinct_features(row, buckets, self.weights != 0)
        total = self.intercept + np.bincount(doc, self.weights[found], minlength=block.n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def classes_of(labels: DataFrame, key: str, toxic: str) -> DataFrame:
    """(key, y): one label for each key, 1 if it has both."""
    return labels.select(labels[key].alias("key"), labels[toxic].cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, held: DataFrame, key: str, text: str) -> DataFrame:
    """(text, y) of every row with a label. Up to BROADCAST_LABELS labels go to the texts; more meet the texts of their own keys in a shuffle."""
    few = held.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.join(F.broadcast(held) if few else held, "key").select("text", "y")


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, one, zero): rows (text, y) of each class that have a feature; feature SPAN counts the rows. Each task adds up its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SPAN + 1), np.int32)
        for block in blocks(batches, "text"):
            row, _, buckets = features(block)
            doc, found = distinct_features(row, buckets)
            y = block.batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                np.add.at(totals[c], found[y[doc] == c], 1)
                totals[c, SPAN] += (y == c).sum()
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[1, at].astype(np.int64)), pa.array(totals[0, at].astype(np.int64))], ["feature", "one", "zero"])

    return rows.mapInArrow(run, "feature int, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))


def mine(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From ``feature_counts``: (a flag for each feature of the mined lexicons, the features that the classifier uses).

    A lexicon has what enough rows of class 1 have and is at least 20 times likelier there; the
    classifier uses what is significantly likelier in either class. The driver gets these features'
    counts alone, of SPAN at most.
    """
    total = counts.where(F.col("feature") == SPAN).first()
    flags = np.zeros(SPAN, bool)
    if total is None or not total["one"] or not total["zero"]:
        return flags, np.empty(0, np.int64)
    n1, n0 = total["one"], total["zero"]
    one, zero = F.col("one"), F.col("zero")
    mean = (one + zero + 1.0) / (n1 + n0 + 2.0)
    deviation = F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    telling = F.abs(one / n1 - zero / n0) >= DEVIATIONS * deviation
    found = counts.where(F.col("feature") < SPAN).where((one >= LEXICON_SUPPORT) | telling).select("feature", "one", "zero", telling.alias("telling")).toArrow()
    feature, one, zero, telling = (c.to_numpy() for c in found.columns)
    odds = np.log((one + 0.1) / (n1 + 1)) - np.log((zero + 0.1) / (n0 + 1))
    flags[feature[(one >= LEXICON_SUPPORT) & (odds >= np.log(20))]] = True
    return flags, np.sort(feature[telling].astype(np.int64))


class LabelModel:
    """Binary voters given a hidden class: each one's rates of firing, with dependent voters sharing their weight.

    Expectation-maximisation over the counts of vote patterns; rows whose class is known (``known``:
    patterns, classes, weights) keep it. Correlation of two voters within a class (their excess of
    agreement over independence) is measured in each round; a voter's log likelihood ratio is divided
    by one plus its correlations with the others, so a clique of voters that repeat one signal counts
    about once. A voter that does not fire abstains: lexicons of other languages say nothing. That none
    fires at all is itself a vote, for class 0.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, rounds: int = 25):
        self.m = len(VOTERS)
        sure, classes, weights = known or (np.empty(0, np.int64), np.empty(0), np.empty(0))
        votes = self.unpack(np.concatenate([patterns, sure]))
        silent = np.concatenate([patterns, sure]) == 0
        posterior = np.where(patterns != 0, 0.5, 0.02)
        self.prior = float(np.clip(prior, 1e-3, 0.5))
        for _ in range(rounds):
            self.rates, self.silence = [], []
            corr = np.zeros((self.m, self.m))
            for c in (0, 1):
                w = np.concatenate([(posterior if c else 1 - posterior) * counts, (classes == c) * weights])
                total = w.sum() + 2.0
                mean = (votes.T @ w + 0.02) / total
                self.silence.append((w @ silent + 0.02) / total)
                self.rates.append(np.clip(mean, 1e-4, 1 - 1e-4))
                both = (votes.T * w) @ votes / total - np.outer(mean, mean)
                spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-6))
                corr += 0.5 * np.clip(both / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(corr, 0)
            self.correlations, self.share = corr, 1 / (1 + corr.sum(axis=1))
            posterior = self.posterior(patterns)

    def unpack(self, patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None] >> np.arange(self.m) & 1).astype(float)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        zero, one = self.rates
        # a voter that fires no likelier in class 1 is no evidence for it
        fired = self.share * np.maximum(np.log(one / zero), 0)
        quiet = min(0.0, float(np.log(self.silence[1] / self.silence[0])))
        odds = np.log(self.prior / (1 - self.prior)) + self.unpack(patterns) @ fired + (patterns == 0) * quiet
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def described(docs: DataFrame, key: str, text: str, lexicon: np.ndarray, used: np.ndarray) -> DataFrame:
    """(key, votes, features) of every row: all voters' votes, and the row's features as places in ``used``."""
    kind = dict(docs.dtypes)[key]
    entries, size = np.flatnonzero(lexicon), len(lexicon)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, wanted, place = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.int32)
        flags[entries] = True
        wanted[used] = True
        place[used] = np.arange(len(used))
        both = flags | wanted
        for block in blocks(batches, "text"):
            row, words, buckets = features(block)
            doc, found = distinct_features(row, buckets, both)
            votes = fixed_votes(block, row, words) | mined_votes(block.n, doc, found, flags)
            doc, found = doc[wanted[found]], found[wanted[found]]
            bounds = np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(votes), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[found]))], ["key", "votes", "features"])

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, votes long, features array<int>")


def fit_linear(table: DataFrame, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on (target, features), by Spark's distributed optimiser; each row counts as class 1 by its target and as class 0 by the rest.

    Rows without any feature only move the intercept.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    tokens = table.select("target", F.col("features").cast("array<string>").alias("tokens"))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(used))], inputCol="tokens", outputCol="features").setBinary(True).transform(tokens)
    sides = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), w.alias("weight")) for y, w in ((1.0, F.col("target")), (0.0, 1 - F.col("target")))]))
    each = vectors.select("features", sides.alias("side")).select("features", "side.*").where("weight > 0.001")
    fitted = LogisticRegression(maxIter=ROUNDS, regParam=SHRINK, weightCol="weight", standardization=False).fit(each)
    out = np.zeros(SPAN)
    out[used] = fitted.coefficients.toArray()
    return out, float(fitted.intercept)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Voters over all of ``docs``, a label model over all their votes, a linear classifier on its posteriors.

    ``docs`` are the rows whose labels may be used. Every step covers every row: the mined lexicons and
    the classifier's features are counted over all labelled rows, the label model has all votes and all
    labels, which anchor it, and the classifier is fitted on the posteriors of all rows, labelled or not. Texts
    are read twice; labels join the rows' votes alone by key, so neither the text of a row without
    a label nor any row's features are shuffled. The driver holds counts by feature (SPAN at most), vote patterns and
    weights, no rows. Null and empty texts are rows without features;
    repeated rows count each; a key with two labels counts as toxic; labels of unknown keys are left
    out. Without labels of both classes no feature is told apart and every text gets the same low score.
    """
    held = written(classes_of(labels, key, toxic), "classes")
    lexicon, used = mine(written(feature_counts(labelled(docs, held, key, text)), "feature_counts"))
    rows = written(described(docs, key, text, lexicon, used), "votes")
    sure = rows.select("key", "votes").join(held, "key", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    table = sure.groupBy("votes", "y").agg(F.count("*").alias("n")).toPandas()
    rate = labels.agg(F.avg(labels[toxic].cast("double"))).first()[0] or 0.05
    # labelled rows weigh as much as they stand for
    share = lambda y, n: np.where(y == 1, rate / max(1, n[y == 1].sum()), (1 - rate) / max(1, n[y == 0].sum()))
    every = table.groupby("votes")["n"].sum()
    known = table[table["y"] >= 0]
    classes, n = known["y"].to_numpy(), known["n"].to_numpy(float)
    counts = every.to_numpy(float)
    model = LabelModel(every.index.to_numpy(np.int64), counts, rate, (known["votes"].to_numpy(np.int64), classes, share(classes, n) * n * counts.sum()))
    accuracies = {v: (float(a), float(b)) for v, a, b in zip(VOTERS, *model.rates, strict=True)}
    if not len(used):
        return ToxicityModel(np.zeros(SPAN), -3.0, accuracies, model.correlations)
    patterns = every.index.to_numpy(np.int64)
    judged = docs.sparkSession.createDataFrame(list(zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True)), "votes long, posterior double")
    judged = F.broadcast(judged) if len(patterns) <= MAX_PATTERNS else judged
    weights, bias = fit_linear(written(rows.join(judged, "votes").select(F.col("posterior").alias("target"), "features"), "instances"), used)
    return ToxicityModel(weights, bias, accuracies, model.correlations)


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row, by the linear classifier over the whole text; one pass, no shuffle.

    A null, empty or letterless text has no features and gets the intercept's score. Long texts are
    scored whole; repeated rows each; an empty table gives an empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], len(model.weights), model.intercept))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, size, intercept = shared.value
        weights = np.zeros(size)
        weights[at] = value
        fitted = ToxicityModel(weights, intercept, {}, np.empty(0))
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(fitted.scores(block))], ["key", "score"])

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
