"""Toxic passages: maximum-scoring segments of words scored by log-odds.

Tokens are words and their beginnings of ``PREFIXES`` bytes, so that the forms of a
stem count together. Learning, from labelled rows: how many toxic and other documents
hold each token gives its log-odds under a Dirichlet prior spread like the whole
vocabulary. A word takes the log-odds, less two standard errors, of its most
significant token; tokens count that reach ``MIN_Z`` by likelihood ratio and
``MIN_ODDS`` in score, other words have 0; every word loses ``DRIFT``, so that a random text
drifts downwards. Scanning a text, the linear-time algorithm of Ruzzo and Tompa finds
all its maximal-scoring segments at once.

Calibration: the best segment of a clean text of n words follows an extreme-value law,
P(S > x) = 1 - exp(-K n exp(-lambda x)); lambda comes from the word scores of clean
labelled texts, K from their best segments. Each segment's evidence is lambda S - ln(K n); segments with
positive evidence (fewer than one expected by chance) are the toxic passages, their
evidence is added up, and a logistic curve fitted to the labelled rows maps it to 0..1.

At most ``MAX_LABELLED`` labelled rows are learned from (those with the smallest hash
of their id), and at most ``MAX_TOKENS`` tokens kept (the most significant); both bound
what is broadcast. All documents are scored, in one pass and without a shuffle.

Defined cases: labels of one id that differ count as toxic; null labels and ids teach
nothing; with no toxic or no clean labels every score is 0.0; texts without words have
no segments and get the score of zero evidence; repeated documents each get their row;
other columns are carried along, unless a result column has the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trailmark.llm.tasks import map_batches
from trailmark.llm.words import (
    LOWERED,
    LOWERED_VALUES,
    Block,
    Sums,
    Words,
    blocks,
    find_words,
    mix,
    without_columns,
)
from trailmark.storage import materialize

MAX_LABELLED = 50_000
MAX_TOKENS = 200_000
PREFIXES = (4, 5, 6, 7, 8)
PRIOR = 1.0  # weight of the prior, as a share of what toxic documents hold
MIN_Z = 5.5  # a few in 100 million by chance
MIN_ODDS = 1.5
DRIFT = 0.25
LARGEST_EVIDENCE = 60.0
MERGE_AT = 2_000_000
RESULTS = ["n_words", "segments", "best", "evidence"]

SEGMENT = T.StructType(
    [
        T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def held_out(doc_id: Column) -> Column:
    """The third of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Log-odds of significant tokens (by hash, sorted) and the calibration of segments."""

    tokens: np.ndarray
    odds: np.ndarray
    z: np.ndarray
    rate: float = 1.0  # lambda
    space: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 0.0

    def evidence(self, score: np.ndarray, n_words: int) -> np.ndarray:
        return self.rate * score - np.log(self.space * max(n_words, 1))

    def score_words(self, block: Block, words: Words) -> np.ndarray:
        score = np.zeros(len(words.start))
        strength = np.zeros(len(words.start))
        if len(self.tokens):
            for which, tokens in tokens_of(block, words):
                at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
                better = (self.tokens[at] == tokens) & (self.z[at] > strength[which])
                where, at = which[better], at[better]
                score[where], strength[where] = self.odds[at], self.z[at]
        return score - DRIFT


def tokens_of(block: Block, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their tokens, one kind of token after the other."""
    sums = Sums(LOWERED_VALUES[block.data])
    length = words.end - words.start
    yield np.arange(len(length)), sums.hash(words.start, words.end)
    for prefix in PREFIXES:
        which = np.flatnonzero(length > prefix)
        start = words.start[which]
        yield which, mix(sums.hash(start, start + prefix) + np.uint64(prefix))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model | None]:
    """The labelled sample (text, toxic) and the token scores, not yet calibrated."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    known = materialize(known, "labelled")
    counted = map_batches(
        # copies of one text would pass for independent evidence
        labelled(docs, known).select("text", "toxic").dropDuplicates(),
        count_tokens,
        "token bigint, toxic_docs bigint, clean_docs bigint",
    )
    counts = materialize(
        counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs")]),
        "token-counts",
    )
    totals = counts.agg(F.sum("toxic_docs"), F.sum("clean_docs")).first()
    if not totals[0] or not totals[1]:
        return known, None
    toxic, clean = float(totals[0]), float(totals[1])
    prior = PRIOR * toxic
    share = (F.col("toxic_docs") + F.col("clean_docs")) / F.lit(toxic + clean)
    in_toxic = F.col("toxic_docs") + F.lit(prior) * share
    in_clean = F.col("clean_docs") + F.lit(prior) * share
    odds = F.log(in_toxic / (F.lit(toxic + prior) - in_toxic)) - F.log(
        in_clean / (F.lit(clean + prior) - in_clean)
    )
    lower = odds - 2 * F.sqrt(1 / in_toxic + 1 / in_clean)
    # likelihood ratio against the label share of all tokens; its root is like a z value
    rate = toxic / (toxic + clean)
    n = F.col("toxic_docs") + F.col("clean_docs")

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(F.lit(0.0))

    ratio = part(F.col("toxic_docs"), n * rate) + part(F.col("clean_docs"), n * (1 - rate))
    z = F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))
    rows = (
        counts.select("token", lower.alias("odds"), z.alias("z"))
        .where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS))
        .orderBy(F.col("z").desc(), "token")
        .limit(MAX_TOKENS)
        .toPandas()
    )
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return known, Model(
        tokens[order], rows["odds"].to_numpy(float)[order], rows["z"].to_numpy(float)[order]
    )


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Texts and labels of the sample; ``known`` has at most MAX_LABELLED rows of two numbers."""
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each token, by label; merged per task while that stays small."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        every = np.concatenate([c for _, c in held], axis=1)
        return keys, np.stack([np.bincount(at, c, len(keys)).astype(np.int64) for c in every])

    def batch_of(keys, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), *map(pa.array, counts)],
            names=["token", "toxic_docs", "clean_docs"],
        )

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) != 0
        for block in blocks(batch.column("text")):
            words = find_words(block, LOWERED)
            row = words.row
            for which, tokens in tokens_of(block, words):
                # one for each document that has the token: pairs of token and document
                pair = mix(tokens ^ mix(row[which].astype(np.uint64) + np.uint64(1)))
                _, first = np.unique(pair, return_index=True)
                label = toxic[block.first_row + row[which[first]]]
                held.append((tokens[first], np.stack([label, ~label]).astype(np.int64)))
        if sum(len(k) for k, _ in held) > MERGE_AT:
            held = [merged()]
            if len(held[0][0]) > MERGE_AT // 2:
                yield batch_of(*held.pop())
    if held:
        yield batch_of(*merged())


def fit_decay(docs: DataFrame, known: DataFrame, model: Model) -> float:
    """lambda: the positive solution of E[exp(lambda score)] = 1 over the words of clean texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                score = shared.value.score_words(block, find_words(block, LOWERED))
                bins, n = np.unique(np.rint(score * 100).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    clean = labelled(docs, known.where("toxic = 0")).select("text")
    # log-odds of counts lie within a few dozen, so there are a few thousand bins at most
    rows = map_batches(clean, histogram, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    score = rows["bin"].to_numpy(float) / 100
    share = rows["n"].to_numpy(float)
    if not len(share) or not (score > 0).any():
        return 1.0
    share /= share.sum()

    def excess(rate: float) -> float:
        return (share * np.exp(np.minimum(rate * score, 700))).sum() - 1

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def maximal_segments(position: np.ndarray, score: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) from the positive words of a text.

    ``position`` and ``score`` list the positive words; ``before`` is the sum of all
    scores ahead of each. A candidate looks back for the nearest one that begins lower;
    if that one also ends lower, the two and all between them become one candidate.
    """
    found: list[list] = []  # [first, end, sum before, sum behind, nearest candidate that begins lower]
    for first, value, left in zip(position.tolist(), score.tolist(), before.tolist()):
        end, right = first + 1, left + value
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([first, end, left, right, j])
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(first, end, right - left) for first, end, left, right, _ in found]


def score_batch(model: Model, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    n = batch.num_rows
    n_words, best, evidence = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    segments: list[list[dict]] = [[] for _ in range(n)]
    for block in blocks(batch.column("text")):
        words = find_words(block, LOWERED)
        n_words[block.first_row : block.first_row + block.n_rows] = np.diff(words.first)
        score = model.score_words(block, words)
        sums = np.concatenate([[0.0], np.cumsum(score)])
        positive = np.flatnonzero(score > 0)
        split = np.searchsorted(positive, words.first)
        for r in np.flatnonzero(np.diff(split)):
            mine = positive[split[r] : split[r + 1]]
            base, row = words.first[r], block.first_row + r
            found = maximal_segments(mine - base, score[mine], sums[mine] - sums[base])
            value = np.array([s for _, _, s in found])
            weight = model.evidence(value, int(n_words[row]))
            best[row] = value.max()
            evidence[row] = min(weight[weight > 0].sum(), LARGEST_EVIDENCE)
            segments[row] = [
                {"first_word": first, "end_word": end, "score": s}
                for (first, end, s), w in zip(found, weight)
                if w > 0
            ]
    kind = pa.list_(
        pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())])
    )
    return pa.RecordBatch.from_arrays(
        [batch.column(name) for name in names]
        + [pa.array(n_words), pa.array(segments, kind), pa.array(best), pa.array(evidence)],
        names=names + RESULTS,
    )


def find_segments(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``n_words``, toxic ``segments``, ``best`` score and ``evidence``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = without_columns(docs.columns, RESULTS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield score_batch(shared.value, batch, names)

    schema = T.StructType(
        docs.select(*names).schema.fields
        + [T.StructField("n_words", T.LongType()), T.StructField("segments", T.ArrayType(SEGMENT))]
        + [T.StructField("best", T.DoubleType()), T.StructField("evidence", T.DoubleType())]
    )
    return map_batches(docs, scan, schema)


def fit_space(docs: DataFrame, known: DataFrame, model: Model) -> float:
    """K: maximum likelihood over the best segments of clean labelled texts."""
    scored = find_segments(labelled(docs, known.where("toxic = 0")), model).where("n_words > 0")
    n, mass = scored.agg(
        F.count(F.lit(1)), F.sum(F.col("n_words") * F.exp(-F.lit(model.rate) * F.col("best")))
    ).first()
    return n / mass if n else 1.0


def fit_curve(scored: DataFrame, known: DataFrame) -> tuple[float, float]:
    """Intercept and slope of the logistic curve, by Newton's method on a histogram."""
    bins = (
        scored.join(F.broadcast(known), "doc_id")
        .groupBy(F.rint(F.col("evidence") * 10).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
        .toPandas()
    )  # at most 10 * LARGEST_EVIDENCE + 1 rows
    x = np.stack([np.ones(len(bins)), bins["bin"].to_numpy(float) / 10])
    n, y = bins["n"].to_numpy(float), bins["toxic"].to_numpy(float)
    weights = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-weights @ x))
        gradient = x @ (y - n * p) - 1e-3 * weights
        hessian = (x * (n * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (without text) with ``n_words``, toxic ``segments`` and ``score``."""
    known, model = learn(docs, labels)
    kept = without_columns([name for name in docs.columns if name != "text"], [*RESULTS, "score"])
    if model is None:
        empty = F.array().cast(T.ArrayType(SEGMENT))
        return docs.select(*kept, empty.alias("segments"), F.lit(0.0).alias("score"))
    # the columns of a document are in one struct, so that none of them meets a name used here
    docs = docs.select("doc_id", "text", F.struct(*kept).alias("row"))
    model.rate = fit_decay(docs, known, model)
    model.space = fit_space(docs, known, model)
    scored = materialize(find_segments(docs, model).drop("text"), "toxic-segments")
    model.intercept, model.slope = fit_curve(scored, known)
    logit = F.lit(model.intercept) + F.lit(model.slope) * F.col("evidence")
    score = 1 / (1 + F.exp(-logit))
    return scored.select(*[F.col("row")[name].alias(name) for name in kept], *RESULTS, score.alias("score"))
