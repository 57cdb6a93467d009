"""Quality classification by co-training.

Two views of a document: its text (shares of character and word kinds) and its
page metadata (language, source, stated length).  A classifier of each view
starts from the labelled sample.  In each round both score all unlabelled
documents, and each gives the other those it is sure of as pseudo-labels of lower
weight, in the proportion of the classes.  At the end each view is calibrated on
the labelled sample, and a small fit combines the two calibrated views to score
every document.

The labelled sample is bounded (``most`` rows of each class, the first by a hash
of the id); the exchange covers every other document.  The views of all documents
are written once (a few hundred bytes each); a round is a pass over them that
adds up gradients and curvatures by place, so neither a task nor the driver holds
more than one set of sums.  Texts are read whole, without a shuffle.

Defined cases: a null text is empty; null metadata is a value of its own; labels
that are null or not 0 or 1 are no labels; without labels of both classes every
score is the share of good training rows (1 without any), so nothing good is
thrown away; repeated rows are scored one by one; an empty table gives no rows;
further columns are ignored by ``classified``.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, fresh, slices, small_batches, texts, type_of
from .learn import Logistic, labelled_sample, sigmoid

#: Bytes of each kind become one of these letters: upper, lower, digit, space, line end, sentence mark, other ASCII sign, non-ASCII.
_KIND = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else ord("n") if c == 10 else ord(" ") if c in (9, 11, 12, 13, 32) else ord("u") if c >= 128 else ord(".") if c in b".,;:'\"()-" else ord("#")
    for c in range(256)
)
BUCKETS = 32


def content(text: bytes) -> list[float]:
    """Shares of kinds of characters and words; all within a fixed range, whatever the length."""
    kinds = text.translate(_KIND)
    n = max(1, len(text))
    own = text.split()
    m = max(1, len(own))
    sample = kinds.split()
    # a word's kind, with runs of letters shortened: "Aa" a capital first, "a#" a sign at the end
    ends = sum(k.endswith(b"#") for k in sample)
    alone = sum(not k.strip(b"#.") for k in sample)
    upper = sum(k.strip(b"#.").isupper() and len(k) > 1 for k in sample)
    share = [kinds.count(k) / n for k in (b"A", b"a", b"0", b"n", b".", b"#", b"u")]
    lines = text.split(b"\n")
    return [
        *share,
        ends / m,
        alone / m,
        upper / m,
        len(set(own)) / m,
        len(set(lines)) / len(lines),
        min(30.0, n / m) / 30,
        math.log1p(len(own)) / 12,
        kinds.count(b".n") / max(1, len(lines)),
    ]


def metadata(lang, source, n_chars) -> list[float]:
    """One place for each bucket of language and source, and the stated length."""
    out = [0.0] * (2 * BUCKETS)
    out[zlib.crc32(repr(lang).encode()) % BUCKETS] = 1.0
    out[BUCKETS + zlib.crc32(repr(source).encode()) % BUCKETS] = 1.0
    return [*out, math.log1p(max(0, n_chars or 0)) / 12, float(n_chars is None)]


@dataclass
class Model:
    text: Logistic | None = None
    page: Logistic | None = None
    text_scale: Logistic | None = None
    page_scale: Logistic | None = None
    both: Logistic | None = None
    share: float = 1.0

    def views(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of both views."""
        return self.text_scale.logit(self.text.logit(x)[:, None]), self.page_scale.logit(self.page.logit(z)[:, None])

    def scores(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: by the text, by the metadata, by both."""
        if self.both is None:
            return (np.full(len(x), self.share),) * 3
        a, b = self.views(x, z)
        return sigmoid(a), sigmoid(b), sigmoid(self.both.logit(np.column_stack([a, b])))


@dataclass
class Lent:
    """What pseudo-labelled rows of one class give to a learner: how many they are, their gradient and their curvature."""

    n: float
    gradient: np.ndarray
    curve: np.ndarray

    @staticmethod
    def of(learner: Logistic, rows: np.ndarray, target: float) -> Lent:
        z = learner.standard(rows)
        p = sigmoid(z @ learner.beta)
        return Lent(float(len(rows)), z.T @ (target - p), (z * (p * (1 - p))[:, None]).T @ z)


def lend(text: Logistic, page: Logistic, x: np.ndarray, z: np.ndarray, sure: float) -> dict[tuple[str, int], Lent]:
    """By learner and class: the rows of which the other view is sure."""
    out = {}
    for learner, own, rows, p in (("page", page, z, sigmoid(text.logit(x))), ("text", text, x, sigmoid(page.logit(z)))):
        for label, certainty in ((1, p), (0, 1 - p)):
            out[learner, label] = Lent.of(own, rows[certainty >= sure], float(label))
    return out


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, weight: np.ndarray, exchange, rounds: int = 6, lent: float = 0.3) -> Model:
    """``x``, ``z``: the views of labelled rows; ``y``: 1 for good.

    ``exchange(text, page)`` gives what ``lend`` does for all unlabelled rows.  In
    each round each view takes a Newton step on the labelled rows and on the rows
    that the other is sure of.  Those of a class weigh ``lent`` times the labelled
    rows of that class in all, and no row more than ``lent``.
    """
    model = Model(share=float(np.average(y, weights=weight)))
    views = {"text": Logistic(x, y, weight), "page": Logistic(z, y, weight)}
    own = {"text": x, "page": z}
    for _ in range(rounds):
        found = exchange(views["text"], views["page"])
        for name, learner in views.items():
            gradient, curve = learner.sums(own[name], y, weight)
            for label in (0, 1):
                part = found[name, label]
                each = min(lent, lent * weight[y == label].sum() / max(1.0, part.n))
                gradient, curve = gradient + each * part.gradient, curve + each * part.curve
            learner.step(gradient, curve)
    model.text, model.page = views["text"], views["page"]
    model.text_scale = Logistic(model.text.logit(x)[:, None], y, weight)
    model.page_scale = Logistic(model.page.logit(z)[:, None], y, weight)
    a, b = model.views(x, z)
    model.both = Logistic(np.column_stack([a, b]), y, weight)
    return model


def features(rows: DataFrame) -> DataFrame:
    """doc_id, held_out, label and both views of each row of doc_id, text, lang, source, n_chars, held_out, label."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            lang, source, n_chars = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
            kind = pa.list_(pa.float32())
            return {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "label": batch.column("label"),
                "x": pa.array([content(t) for t in texts(batch)], kind),
                "z": pa.array([metadata(*m) for m in zip(lang, source, n_chars, strict=True)], kind),
            }

        return work

    columns = ("doc_id", "text", "lang", "source", "n_chars", "held_out", "label")
    return arrow_map(rows.select(*columns), make, f"doc_id {type_of(rows, 'doc_id')}, held_out boolean, label int, x array<float>, z array<float>")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1) for c in ("x", "z"))


def lent_by_all(unlabelled: DataFrame, text: Logistic, page: Logistic, sure: float) -> dict[tuple[str, int], Lent]:
    """``lend`` over a table of views: sums of each task, added up by place, so that the driver gets one set of them."""
    keys = [(learner, label) for learner in ("page", "text") for label in (1, 0)]
    sizes = {"text": len(text.beta), "page": len(page.beta)}

    def run(batches):
        import pyarrow.compute  # noqa: F401

        total = None
        for batch in batches:
            if batch.num_rows:
                found = lend(text, page, *_views(batch), sure)
                flat = np.concatenate([np.concatenate([[found[k].n], found[k].gradient, found[k].curve.ravel()]) for k in keys])
                total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "v": pa.array(total[at], pa.float64())})

    small_batches(unlabelled.sparkSession)
    sums = unlabelled.select("x", "z").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as the views have pairs of features
    flat = np.zeros(2 * sum(1 + d + d * d for d in sizes.values()))
    for r in sums:
        flat[r.i] = r.v
    out, at = {}, 0
    for learner, label in keys:
        d = sizes[learner]
        out[learner, label] = Lent(flat[at], flat[at + 1 : at + 1 + d], flat[at + 1 + d : at + 1 + d + d * d].reshape(d, d))
        at += 1 + d + d * d
    return out


def train(documents: DataFrame, labels: DataFrame, condition, label: str = "quality", most: int = 10_000, sure: float = 0.95, **rounds) -> tuple[Model, DataFrame]:
    """``documents``: doc_id, text, lang, source, n_chars, and what else.  Gives the model, and all documents' views without their texts."""
    sample, stands = labelled_sample(labels, label, condition, most)
    marked = documents.join(F.broadcast(sample), "doc_id", "left")
    every = checkpointed(features(marked))
    # a document id may be repeated; its first rows by a hash are enough to learn from
    known = every.where("label IS NOT NULL").orderBy(F.xxhash64("doc_id", "x", "z"), "doc_id").limit(4 * most).toArrow()
    y = known["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(share=float(y.mean()) if len(y) else 1.0), every
    x, z = (np.array(known[c].to_pylist(), float).reshape(known.num_rows, -1) for c in ("x", "z"))
    weight = np.where(y > 0, stands[1], stands[0])
    unlabelled = every.where("label IS NULL")
    return co_train(x, z, y, weight / weight.mean(), lambda text, page: lent_by_all(unlabelled, text, page, sure), **rounds), every


def classified(documents: DataFrame, labels: DataFrame, held_out, threshold: float = 0.5, doc: str = "doc_id", **training) -> DataFrame:
    """A row for each document: held_out, content_score, metadata_score, score and keep (score >= threshold).

    ``held_out``: a condition on doc_id; labels of such documents are never learned from.
    """
    rows = documents.select(F.col(doc).alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model, every = train(rows, labels, ~F.coalesce(held_out, F.lit(False)), **training)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            a, b, score = shared.value.scores(*_views(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "content_score": a, "metadata_score": b, "score": score, "keep": score >= threshold})

    return every.mapInArrow(run, f"doc_id {type_of(rows, 'doc_id')}, held_out boolean, content_score double, metadata_score double, score double, keep boolean")


def kept(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, doc: str = "doc_id", **training) -> DataFrame:
    """The documents that are not rejected, with all their columns; learns from all labels."""
    spark, schema = documents.sparkSession, documents.schema
    rows = documents.select(F.col(doc).alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.lit(False).alias("held_out"))
    model, _ = train(rows, labels, F.lit(True), **training)
    shared = spark.sparkContext.broadcast(model)
    n = fresh(documents, "n")

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in slices(batches):
            x = np.array([content(t) for t in texts(batch)]).reshape(batch.num_rows, -1)
            lang, source, n_chars = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", n))
            z = np.array([metadata(*m) for m in zip(lang, source, n_chars, strict=True)]).reshape(batch.num_rows, -1)
            yield batch.filter(pa.array(shared.value.scores(x, z)[2] >= threshold)).select(range(batch.num_columns - 1))

    small_batches(spark)
    return documents.withColumn(n, F.col("n_chars").cast("bigint")).mapInArrow(run, schema)
