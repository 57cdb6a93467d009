"""Language identification by words first, and by ever shorter character n-grams where a word is not known.

A text is its runs of letters in lower case.  A word that the training sample
holds, in whatever language, is scored by its log frequency in each language.  Any
other word is scored by its character n-grams (the word stands between spaces),
of the longest size of which the sample holds at least one of its n-grams: the
mean of the log frequencies, among n-grams of that size, of those it holds.  A
word without any known character says nothing.  A language without the word or
n-gram counts as a tenth of an occurrence in the largest language.  A text's
score of a language is the sum over its words and the log share of the language
among training rows; the result is the language's probability under these.

The sample is bounded by ``most_bytes`` of text in all, dealt evenly to the
languages: of each language the rows whose hashed id starts with so many zero
bits that its part suffices, whole texts, and at least one row.  Shares of
languages are counted over all training rows.  Counting runs in tasks; the model
(words and n-grams of the sample) goes to every task, so its size is bounded by
``most_bytes`` whatever the corpus.  Languages are expected to be some hundreds
at most.  Scoring is one pass over whole texts without a shuffle; a task remembers
at most ``REMEMBERED`` unknown words between texts.

Defined cases: a null or empty text, or one without a letter, is ``und`` with
score 0, as is every text if nothing could be learned; a null language teaches
nothing; a null id is neither held out nor left out of training; repeated rows
teach and are scored one by one; ties go to the language whose name sorts first;
a very long text is taken whole, in memory; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, texts, type_of

_RUN = re.compile(r"[^\W\d_]+")
LONGEST = 5
REMEMBERED = 200_000


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _RUN.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for run in _letters(w)]


def _letters(word: str) -> list[list[str]]:
    """Runs of letters of a word in which other signs (numerals that are no digits) may stand."""
    runs: list[list[str]] = [[]]
    for c in word:
        if c.isalpha():
            runs[-1].append(c)
        elif runs[-1]:
            runs.append([])
    return [r for r in runs if r]


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


@dataclass
class Model:
    """Log frequencies by language (columns, in the order of ``langs``) of words, and of n-grams of every size."""

    langs: list[str]
    prior: np.ndarray
    words: list[str] = field(default_factory=list)
    word_logs: np.ndarray | None = None
    grams: list[str] = field(default_factory=list)
    gram_logs: np.ndarray | None = None


def logs(counts: np.ndarray) -> np.ndarray:
    """Natural log frequencies of a table of counts by row and language."""
    totals = counts.sum(axis=0)
    floor = 0.1 / max(1.0, float(totals.max(initial=0)))
    return np.log(np.where(counts > 0, counts / np.maximum(totals, 1), floor))


class Scorer:
    """What a task keeps of a model: where known words stand, and the rows of unknown words met."""

    def __init__(self, model: Model, longest: int = LONGEST) -> None:
        self.model, self.longest = model, longest
        self.known = {w: i for i, w in enumerate(model.words)}
        self.grams = {g: i for i, g in enumerate(model.grams)}
        self.table = np.concatenate([model.word_logs, np.zeros((1024, len(model.langs)))])
        self.more: dict[str, int] = {}

    def backed_off(self, word: str) -> np.ndarray:
        for size in range(self.longest, 0, -1):
            found = [i for g in grams(word, size) if g.strip() and (i := self.grams.get(g)) is not None]
            if found:
                return self.model.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.model.langs))

    def place(self, word: str) -> int:
        """The row of an unknown word."""
        at = self.more.get(word)
        if at is None:
            at = self.more[word] = len(self.known) + len(self.more)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.more), self.table.shape[1]))])
            self.table[at] = self.backed_off(word)
        return at

    def score(self, text: str) -> tuple[str, float]:
        own = words(text)
        if not own or not self.model.langs:
            return "und", 0.0
        if len(self.more) > REMEMBERED:
            self.more, self.table = {}, self.table[: len(self.known) + 1024].copy()
        at = [self.place(w) if i is None else i for w, i in zip(own, map(self.known.get, own), strict=True)]
        total = self.model.prior + self.table[at].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def counted(sample: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, size, key, n: occurrences of words (size 0) and of n-grams in rows of lang and text."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            held: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                held.update((lang, w) for w in words(text.decode()))
            out: Counter = Counter()
            for (lang, w), n in held.items():
                out[lang, 0, w] += n
                for size in range(1, longest + 1):
                    for g in grams(w, size):
                        if g.strip():
                            out[lang, size, g] += n
            lang, size, key = zip(*out, strict=True) if out else ([], [], [])
            return {"lang": pa.array(lang, pa.string()), "size": pa.array(size, pa.int32()), "key": pa.array(key, pa.string()), "n": pa.array(out.values(), pa.int64())}

        return work

    return arrow_map(sample, make, "lang string, size int, key string, n bigint").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def sampled(training: DataFrame, most_bytes: int) -> tuple[DataFrame, dict[str, int]]:
    """Whole rows of each language whose texts have at most its part of ``most_bytes``, or one row; and how many rows there are of each."""
    rows = training.withColumn("zeros", (64 - F.length(F.bin(F.xxhash64("doc_id")))).cast("int"))
    sizes = rows.groupBy("lang", "zeros").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("size")).collect()  # at most 64 a language
    langs = sorted({r.lang for r in sizes})
    least = []
    for lang in langs:
        levels = {r.zeros: r.size for r in sizes if r.lang == lang}
        held, start = 0, max(levels)
        for zeros in sorted(levels, reverse=True):
            held += levels[zeros]
            if held > most_bytes / len(langs):
                break
            start = zeros
        least.append((lang, start))
    chosen = F.broadcast(training.sparkSession.createDataFrame(least, "lang string, least int"))
    return rows.join(chosen, "lang").where(F.col("zeros") >= F.col("least")).select("lang", "text"), {lang: sum(r.n for r in sizes if r.lang == lang) for lang in langs}


def train(training: DataFrame, most_bytes: int, longest: int = LONGEST) -> Model:
    """``training``: doc_id, text, lang."""
    sample, rows = sampled(training.where("lang IS NOT NULL"), most_bytes)
    if not rows:
        return Model([], np.zeros(0))
    found = checkpointed(counted(sample, longest)).orderBy("size", "key").toArrow()  # of a bounded sample
    langs = sorted(set(found["lang"].to_pylist()))
    if not langs:
        return Model([], np.zeros(0))
    share = np.array([rows[lang] for lang in langs], float)
    place = {lang: i for i, lang in enumerate(langs)}
    size, n = found["size"].to_numpy(), found["n"].to_numpy()
    lang = np.array([place[v] for v in found["lang"].to_pylist()])
    model, by_size = Model(langs, np.log(share / share.sum())), []
    for s in range(longest + 1):
        rows_of = np.flatnonzero(size == s)
        keys = found["key"].take(pa.array(rows_of)).combine_chunks().dictionary_encode()
        counts = np.zeros((len(keys.dictionary), len(langs)))
        counts[keys.indices.to_numpy(), lang[rows_of]] = n[rows_of]
        by_size.append((keys.dictionary.to_pylist(), logs(counts)))
    model.words, model.word_logs = by_size[0]
    model.grams, model.gram_logs = [g for keys, _ in by_size[1:] for g in keys], np.concatenate([v for _, v in by_size[1:]])
    return model


def identified(documents: DataFrame, held_out, most_bytes: int = 8 << 20, longest: int = LONGEST, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document.  ``held_out``: a condition on doc_id; such documents teach nothing."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"), most_bytes, longest)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value, longest) if shared.value.langs else None

        def work(batch: pa.RecordBatch) -> dict:
            found = [scorer.score(t.decode()) if scorer else ("und", 0.0) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([p for p, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())}

        return work

    return arrow_map(rows.select("doc_id", "text", "held_out"), make, f"doc_id {type_of(rows, 'doc_id')}, held_out boolean, lang_pred string, score double")
