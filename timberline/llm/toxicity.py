"""Toxicity by maximum-scoring segments.

Each word has a log-odds score of toxic against other texts, under a Dirichlet
prior drawn from both together; words whose score is not clearly positive count
as a small loss.  One linear scan finds all maximal scoring segments of a text
(none of them can be joined or trimmed to gain).  Extreme-value statistics say
how often chance gives a text of n words a segment of score S: the expected
number is E = K n exp(-lambda S), with lambda from the word scores of ordinary
text and K fitted to the best segments of ordinary texts.  The evidence of a text, that of its best segment
and that of all significant ones, is turned into a probability by a
logistic fit.

The model is learned from at most ``most`` labelled rows of each class, a
parameter; it holds every word of theirs whose score is clearly positive.  Scoring reads
every text whole, in one pass without a shuffle.

Defined cases: a null text is empty; an empty text has no segment and gets the
probability of no evidence; labels that are null or not 0 or 1 are no labels;
without training rows of both classes every score is the share of toxic training
rows (0 without any); repeated rows are scored one by one; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, slices, small_batches, texts, type_of
from .decontaminate import words
from .learn import Logistic, labelled_sample, sigmoid

EULER = 0.5772156649015329


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time, in order."""
    left: list[float] = []  # of each candidate, the sum before it
    right: list[float] = []  # and the sum at its end
    first: list[int] = []
    last: list[int] = []
    smaller: list[int] = []  # the nearest candidate before it with a smaller left sum, or -1
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        begin, before, after = i, total, total + s
        total = after
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= before:
                j = smaller[j]
            if j < 0 or right[j] >= after:
                left.append(before), right.append(after), first.append(begin), last.append(i), smaller.append(j)
                break
            begin, before = first[j], left[j]
            del left[j:], right[j:], first[j:], last[j:], smaller[j:]
    return [(a, b + 1, r - le) for a, b, le, r in zip(first, last, left, right, strict=True)]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    loss: float = -1.0
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    fit: Logistic | None = None
    share: float = 0.0
    level: float = 0.01

    def segments(self, own: list[bytes]) -> list[tuple[int, int, float]]:
        """Maximal scoring segments, as places of words."""
        get = self.weights.get
        w = np.array([get(x, 0.0) for x in own])
        w[w == 0.0] = self.loss
        up = np.flatnonzero(w > 0)
        if not len(up):
            return []
        sums = np.concatenate([[0.0], np.cumsum(w)])
        gaps = sums[up[1:]] - sums[up[:-1] + 1]
        mixed = np.empty(2 * len(up) - 1)
        mixed[0::2], mixed[1::2] = w[up], gaps
        return [(int(up[a // 2]), int(up[(b - 1) // 2]) + 1, s) for a, b, s in segments(mixed.tolist())]

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        """Of the best segment (30 at most), and of all significant ones (as a log): minus the log of the expected number by chance; and how many are significant (as a log)."""
        own = [self.rate * s - math.log(n) - self.log_k for *_, s in found]
        strong = [e for e in own if e > -math.log(self.level)]
        return min(30.0, max([0.0, *own])), math.log1p(sum(strong)), math.log1p(len(strong))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.full(len(features), self.share) if self.fit is None else sigmoid(self.fit.logit(features))


def with_shape(rows: DataFrame) -> DataFrame:
    """Adds shape, the least hash of five neighbouring words: nearly always the same for close copies."""

    def make():
        import xxhash

        def shape(own: list[bytes]) -> bytes:
            return min((xxhash.xxh3_128_digest(b" ".join(own[i : i + 5])) for i in range(max(1, len(own) - 4))), default=b"")

        return lambda batch: {"text": batch.column(0), "label": batch.column(1), "shape": pa.array([shape(words(t)) for t in texts(batch)], pa.binary())}

    return arrow_map(rows, make, "text string, label int, shape binary")


def class_counts(rows: DataFrame) -> DataFrame:
    """word, c0, c1: in how many ordinary and toxic texts a word occurs."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()
        for piece in slices(batches):
            for label, text in zip(piece.column(1).to_pylist(), texts(piece), strict=True):
                held[label].update(set(words(text)))
            if len(held[0]) + len(held[1]) > 300_000:
                yield out(held)
                held[0].clear(), held[1].clear()
        yield out(held)

    def out(held):
        keys = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.binary()).cast(pa.string()), "c0": pa.array([held[0][k] for k in keys], pa.int64()), "c1": pa.array([held[1][k] for k in keys], pa.int64())})

    small_batches(rows.sparkSession)
    return rows.select("text", "label").mapInArrow(run, "word string, c0 bigint, c1 bigint").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def log_odds(counts: DataFrame, n0: int, n1: int, strength: float) -> DataFrame:
    """Adds score, the log-odds of toxic under a Dirichlet prior of both classes together, and z, its standard score.

    ``strength``: the prior's weight, as a part of the smaller class.
    """
    strength = strength * min(n0, n1)
    prior = strength * (F.col("c0") + F.col("c1")) / F.lit(float(n0 + n1))
    a, b = F.col("c1") + prior, F.col("c0") + prior
    score = F.log(a / (n1 + strength - a)) - F.log(b / (n0 + strength - b))
    return counts.withColumn("score", score).withColumn("z", score / F.sqrt(1 / a + 1 / b))


def train(documents: DataFrame, labels: DataFrame, condition, label: str = "toxic", most: int = 20_000, strength: float = 0.5, least_z: float = 3.0, loss: float = -0.5) -> Model:
    """``documents``: doc_id, text."""
    spark = documents.sparkSession
    sample, stands = labelled_sample(labels, label, condition, most)
    # one of each group of copies, exact or close: they would pass for evidence that a word is toxic
    own = documents.join(F.broadcast(sample), "doc_id").select("text", "label")
    # the least text stays, so that a model does not hang on how the rows are dealt
    rows = checkpointed(with_shape(own).groupBy("shape", "label").agg(F.min("text").alias("text")).select("text", "label"))
    counts = class_counts(rows)
    n0, n1 = counts.agg(F.coalesce(F.sum("c0"), F.lit(0)), F.coalesce(F.sum("c1"), F.lit(0))).head()
    positive, negative = (stands[c] * sample.where(F.col("label") == c).count() for c in (1, 0))
    model = Model(share=positive / max(1.0, positive + negative), loss=loss)
    if not n0 or not n1:
        return model
    scored = log_odds(counts, n0, n1, strength).where((F.col("z") >= least_z) & (F.col("score") > 0))
    kept = scored.orderBy(F.desc("z"), "word").collect()  # words that set the classes of the bounded sample apart
    if not kept:
        return model
    model.weights = {r.word.encode(): r.score for r in kept}
    s, p = np.array([r.score for r in kept] + [loss]), np.array([max(r.c0, 0.5) / n0 for r in kept] + [0.0])
    p[-1] = max(1 - p.sum(), 0.01)
    low, high = 1e-6, 1.0
    while p @ np.exp(np.minimum(high * s, 500)) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * s, 500)) < 1 else (low, mid)
    model.rate = max(low, 0.01)

    def measured(measure) -> list:
        """Of each text of the sample, by the model as it stands: its label and a few numbers."""
        shared = spark.sparkContext.broadcast(model)

        def make():
            def work(batch: pa.RecordBatch) -> dict:
                own = [words(t) for t in texts(batch)]
                found = [measure(shared.value, len(w), shared.value.segments(w)) for w in own]
                return {"label": batch.column(1), "x": pa.array(found, pa.list_(pa.float64()))}

            return work

        found = arrow_map(rows.select("text", "label"), make, "label int, x array<double>").collect()  # two numbers for each labelled text
        return sorted(found, key=lambda r: (r.label, r.x))  # sums come out alike

    top = measured(lambda m, n, found: [m.rate * max(s for *_, s in found) - math.log(n)] if found else [])
    chance = [r.x[0] for r in top if r.label == 0 and r.x]
    model.log_k = float(np.median(chance)) + math.log(math.log(2)) if chance else 0.0  # the median of the extreme-value law; texts that hide toxic parts do not move it
    fitted = measured(lambda m, n, found: list(m.evidence(max(1, n), found)))
    features = np.array([r.x for r in fitted])
    y = np.array([r.label for r in fitted], float)
    model.fit = Logistic(features, y, np.array([stands[r.label] for r in fitted]))
    return model


def classified(documents: DataFrame, labels: DataFrame, held_out, doc: str = "doc_id", text: str = "text", label: str = "toxic", **training) -> DataFrame:
    """A row for each document: held_out, score (0 to 1), predicted, and the significant segments as word places and scores.

    ``held_out``: a condition on doc_id; labels of such documents are never learned from.
    """
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    out_id = F.coalesce(held_out, F.lit(False))
    model = train(rows, labels, ~out_id, label, **training)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            model: Model = shared.value
            own = [words(t) for t in texts(batch)]
            found = [model.segments(w) for w in own]
            score = model.scores(np.array([model.evidence(max(1, len(w)), f) for w, f in zip(own, found, strict=True)]).reshape(-1, 3))
            strong = [[f"{a}:{b}:{s:.3f}" for a, b, s in f if model.rate * s - math.log(len(w)) - model.log_k > -math.log(model.level)] for w, f in zip(own, found, strict=True)]
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": pa.array((score >= 0.5).astype(np.int32)), "segments": pa.array(strong, pa.list_(pa.string()))}

        return work

    return arrow_map(rows.withColumn("held_out", out_id), make, f"doc_id {type_of(rows, 'doc_id')}, held_out boolean, score double, predicted int, segments array<string>")
