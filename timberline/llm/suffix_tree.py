"""Language-model scoring by a probabilistic suffix tree.

Symbols are words (ASCII white space apart, A-Z lower-cased) and one end per
text.  The root of the tree is the add-one unigram distribution over all
training words.  A context of up to ``depth`` words is a candidate state if it
occurs twice or more; it becomes a state if the divergence test holds: the
log-likelihood ratio of its next symbols against those of its longest retained
suffix is at least ``test`` nats.  A state's distribution keeps the counts of the
next symbols that follow it twice or more and gives all other mass, and ``prior``
pseudo-counts, to the distribution of its longest retained suffix:

    P(w | s) = c(s, w) / (c(s) + prior) + (c(s) - sum of kept c(s, .) + prior) / (c(s) + prior) * P(w | parent of s)

which sums to one.  A text's tokens are scored by the longest suffix state of
what stands before them.  ``least`` asks in addition that a word or sequence
makes up that share of all training tokens; it is 0 if not given, so that the
model grows with the corpus and thresholds are the same at every size.

Scale: a model that cannot hold more than ``WHOLE`` sequences of one length is
a few sorted arrays, broadcast to the workers (``broadcast_scores``).  Any other
stays in the cluster (``table_scores``).  A sequence, its context, and the suffixes
of both, all hold the word before the last; so every token is dealt to a bucket by
the word before it, once, with the words before that and its document, as packed
columns of a few bytes a token.  The bucket counts its sequences, settles its states,
and answers with the sums of each document.  Only the most frequent words are known
to all tasks (``KNOWN``); other words' counts are found in buckets of their own,
and so are the pairs after a hot word, whose followers are spread over buckets by the
word before it.  No sequence is dropped before it is counted.  Sequences are known
by 64-bit hashes there; sums are added as multiples of 2 ** -36.

Defined cases: a null text is empty (one token, the end); a null id belongs to
the training part; no training text at all gives every token the probability of
an unknown word; repeated rows are scored one by one; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, checkpointed, slices, small_batches, texts, type_of
from .jaccard_join import _M3, _mixed

END = b"\n"
BITS = 20
#: Distinct words or sequences that a task counts before it hands them on.
HELD = 300_000
#: Sequences of one length up to which the model is broadcast whole.
WHOLE = 500_000
#: Words that every task knows: at most so many, the most frequent, of at least that share of all tokens.
KNOWN, CACHED = 1_000_000, 2.5e-7
#: Tokens that a task turns into rows at a time, and tokens that a bucket is meant to have; what follows a word that has more than half of it is spread.
HELD_TOKENS, BUCKET = 1_500_000, 1_000_000


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


@dataclass
class Level:
    """Frequent sequences of one length: codes (prefix index << BITS | last word id) in order, counts, and those kept as states."""

    codes: np.ndarray
    counts: np.ndarray
    suffix: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)


class Model:
    """Frequent words by id (the order of ``words``), and a level for each sequence length from 1 on."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.ids = {w: i for i, w in enumerate(words)}
        n = len(words)
        self.levels = [Level(np.arange(n), np.array(counts, np.int64), np.full(n, -1))]
        self.root = np.zeros(0)

    def word_ids(self, docs: list[list[bytes]]) -> np.ndarray:
        """Ids of all words (-1: not frequent), with one -1 behind each text, as nothing reaches over its end."""
        get, none = self.ids.get, (b"",)
        return np.array([get(w, -1) for w in chain.from_iterable(chain(d, none) for d in docs)], np.int64)

    def places(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each level, the index of the frequent sequence that ends at each token, or -1."""
        out = [ids]
        for level in self.levels[1:]:
            at, codes = self.codes_after(out[-1], ids)
            found = np.full(len(ids), -1)
            found[at] = level.find(codes)
            out.append(found)
        return out

    @staticmethod
    def codes_after(below: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a sequence one longer than those of ``below`` may be frequent, and its code there."""
        at = np.flatnonzero((below[1:] >= 0) & (below[:-1] >= 0)) + 1
        return at, (below[at - 1] << BITS) | ids[at]

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        level, below = Level(codes[order], counts[order]), self.levels[-1]
        prefix, last = level.codes >> BITS, level.codes & ((1 << BITS) - 1)
        level.suffix = last if len(self.levels) == 1 else below.find((below.suffix[prefix] << BITS) | last)
        self.levels.append(level)

    def grow(self, total: int, distinct: int, test: float, prior: float) -> None:
        """Settle which contexts are states.  ``total``, ``distinct``: N and V of the training tokens."""
        self.prior = prior
        self.root = (self.levels[0].counts + 1) / (total + distinct + 1)
        # p[k]: probability of each frequent sequence's last word after the words before it, by the states settled so far
        below = self.root
        for level, after in zip(self.levels, self.levels[1:], strict=False):
            prefix, last = after.codes >> BITS, after.codes & ((1 << BITS) - 1)
            parent = self.root[last] if level is self.levels[0] else below[after.suffix]
            n = level.counts[prefix]
            gain = after.counts * np.log(np.maximum(after.counts / n, 1e-300) / parent)
            rest = 1.0 - np.bincount(prefix, after.counts / n, len(level.codes))
            rest_parent = np.maximum(1.0 - np.bincount(prefix, parent, len(level.codes)), 1e-12)
            total_gain = np.bincount(prefix, gain, len(level.codes)) + level.counts * np.where(rest > 1e-9, rest * np.log(np.maximum(rest, 1e-12) / rest_parent), 0.0)
            level.state = total_gain >= test
            level.kept = np.bincount(prefix, after.counts, len(level.codes))
            share = after.counts / (n + prior) + (n - level.kept[prefix] + prior) / (n + prior) * parent
            below = np.where(level.state[prefix], share, parent)

    def score(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the root's and of the tree's probability of each token; of a word that is not frequent, of the factor to the root's."""
        places = self.places(ids)
        known = ids >= 0
        root = np.where(known, self.root[ids] if len(self.root) else 1.0, 1.0)
        p = root.copy()
        for level, after, here, there in zip(self.levels, self.levels[1:], places, places[1:], strict=False):
            at = np.flatnonzero(here[:-1] >= 0)
            at = at[level.state[here[at]]] + 1
            s, g = here[at - 1], there[at]
            n = level.counts[s] + self.prior
            seen = np.where(g >= 0, after.counts[g] if len(after.counts) else 0, 0)
            p[at] = seen / n + (level.counts[s] - level.kept[s] + self.prior) / n * p[at]
        return np.log10(root), np.log10(p)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, c: how often each word and the end occur; added up within a task before they are shuffled."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()).cast(pa.string()), "c": pa.array(held.values(), pa.int64())})

        for piece in slices(batches):
            own = texts(piece)
            for text in own:
                held.update(text.lower().split())
            held[END] += len(own)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    small_batches(documents.sparkSession)
    return documents.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def sequence_counts(documents: DataFrame, model) -> DataFrame:
    """code, c: how often the sequences one longer than the model's occur, of those that may be frequent."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        tree, codes, counts = model.value, np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            every = np.concatenate([codes, *(c for c, _ in waiting)])
            unique, at = np.unique(every, return_inverse=True)
            return unique, np.bincount(at, np.concatenate([counts, *(n for _, n in waiting)]), len(unique)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_pydict({"code": codes, "c": counts})

        for piece in slices(batches):
            ids = tree.word_ids([tokens(t) for t in texts(piece)])
            waiting.append(np.unique(tree.codes_after(tree.places(ids)[-1], ids)[1], return_counts=True))
            if sum(len(c) for c, _ in waiting) > 4 * HELD:
                codes, counts = merged()
                waiting = []
                if len(codes) > 4 * HELD:
                    yield out()
                    codes, counts = codes[:0], counts[:0]
        codes, counts = merged()
        if len(codes):
            yield out()

    small_batches(documents.sparkSession)
    return documents.select("text").mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c"))


def hashed(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and the token's place in its text."""
    import xxhash

    lengths = np.array([len(d) for d in docs])
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(docs)), np.uint64, int(lengths.sum()))
    return words.view(np.int64), np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def chained(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence that has one more word."""
    return _mixed(key.view(np.uint64) + word.view(np.uint64) + _M3).view(np.int64)


def dealt(key: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(key.view(np.uint64) + _M3) % np.uint64(n)).astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, or of any 64-bit numbers, byte by byte of their places, compressed."""
    head, parts = [len(columns)], []
    for x in columns:
        x = np.ascontiguousarray(x, np.int64)
        wide = 8 if len(x) and x.min() < 0 else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        head += [len(x), wide]
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * count].view(np.int64).reshape(count, 2), 8 + 16 * count, []
    for n, wide in head.tolist():
        x = np.zeros((n, 8), np.uint8)
        x[:, :wide] = raw[at : at + n * wide].reshape(wide, n).T
        out.append(x.reshape(-1).view(np.int64))
        at += n * wide
    return out


def ordered(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the first column, then the next."""
    first, *rest = columns
    bits = [int(c.max(initial=0)).bit_length() for c in rest]
    if sum(bits) > 63 or first.max(initial=0) >= 1 << 16:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(first), np.int64)
    for c, b in zip(rest, bits, strict=True):
        key = (key << b) | c
    order = np.argsort(key)
    return order[np.argsort(first[order].astype(np.uint16), kind="stable")]


def runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and how long they are."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if n else False
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, n))


def found_at(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Words:
    """The most frequent words by rank, as every task knows them: code 1 is the most frequent; 0 is no word; codes above all ranks are a piece's own."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int, buckets: int, group: int) -> None:
        self.hashes, self.counts, self.buckets = hashes, counts, buckets
        self.by_hash = np.argsort(hashes)
        self.sorted = hashes[self.by_hash]
        #: Whether every word that occurs twice is known: no sequence that counts holds another then.
        self.all_twice = least <= 2
        self.hot = int((counts > group).sum())
        self.splits = -(-counts[: self.hot] // group)

    def codes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each word, and the words that codes above all ranks stand for."""
        at = found_at(self.sorted, words)
        out = np.where(at >= 0, self.by_hash[at] + 1 if len(self.sorted) else 0, 0)
        other = np.flatnonzero(at < 0)
        own, which = np.unique(words[other], return_inverse=True)
        out[other] = len(self.hashes) + 1 + which
        return out, own

    def words(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), self.hashes, own])[codes]

    def bucket(self, code: np.ndarray, word: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Where what follows a word is dealt to; after a hot word it is spread by another word."""
        out = dealt(word, self.buckets)
        hot = np.flatnonzero((code > 0) & (code <= self.hot))
        share = (dealt(by[hot], 1 << 30) % self.splits[code[hot] - 1]).astype(np.int64)
        out[hot] = dealt(chained(word[hot], share), self.buckets)
        return out

    def buckets_of(self, rank: int) -> np.ndarray:
        return np.unique(dealt(chained(np.repeat(self.hashes[rank : rank + 1], self.splits[rank]), np.arange(self.splits[rank])), self.buckets))

    def picked(self, codes: list[np.ndarray], own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Codes of a part of a piece, and the words of its own that occur there."""
        top = len(self.hashes)
        used = np.unique(np.concatenate([c[c > top] for c in codes]))
        return [np.where(c > top, top + 1 + np.searchsorted(used, c), c) for c in codes], own[used - top - 1]


def blocks(batches):
    """Words, places, document indexes, training marks and ids of about ``HELD_TOKENS`` tokens at a time."""
    held, n, docs = [], 0, 0

    def out():
        words, place, doc, train = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
        return words, place, doc, train, pa.concat_arrays([x[4] for x in held])

    for piece in slices(batches):
        own = [tokens(t) for t in texts(piece)]
        words, place = hashed(own)
        held.append((words, place, docs + np.repeat(np.arange(len(own)), [len(d) for d in own]), np.array(piece.column(2).to_pylist(), bool), piece.column(0)))
        n, docs = n + len(words), docs + len(own)
        if n > HELD_TOKENS:
            yield out()
            held, n, docs = [], 0, 0
    if held:
        yield out()


def common_pairs(rows: DataFrame, shared, often: int) -> DataFrame:
    """bucket, data: the pairs of words that count, if the second is not known to all tasks or the first is hot, with their counts and the second's."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        known: Words = shared.value
        top = len(known.hashes)
        for words, place, doc, train, _ in blocks(batches):
            codes, own = known.codes(words)
            before = np.where(place > 0, np.roll(codes, 1), 0)
            at = np.flatnonzero(train[doc] & ((codes > top) | ((before > 0) & (before <= known.hot))))
            bucket = dealt(words[at], known.buckets)
            columns = [bucket, codes[at], before[at]]
            order = ordered(columns)
            columns = [c[order] for c in columns]
            begin, count = runs(columns)
            bucket, word, before = (c[begin] for c in columns)
            for a, n in zip(*runs([bucket]), strict=True):
                (w, b), mine = known.picked([word[a : a + n], before[a : a + n]], own)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket[a]], pa.int64()), "data": pa.array([packed(w, b, count[a : a + n], mine)], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        known: Words = shared.value
        top, parts = len(known.hashes), []
        for data in group["data"].to_pylist():
            w, b, n, own = unpacked(data)
            parts.append((known.words(w, own), known.words(b, own), np.where(w > top, -1, w), np.where(b > top, -1, b), n))
        word, before, code, code_b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((before, word))
        word, before, code, code_b, n = (x[order] for x in (word, before, code, code_b, n))
        begin, size = runs([word])
        root = np.repeat(np.add.reduceat(n, begin), size)
        root = np.where(code > 0, np.concatenate([[0], known.counts])[np.maximum(code, 0)], root)
        begin, _ = runs([word, before])
        c = np.add.reduceat(n, begin)
        keep = (c >= often) & (code_b[begin] != 0)
        word, before, code_b, root, c = word[begin][keep], before[begin][keep], code_b[begin][keep], root[begin][keep], c[keep]
        hot = (code_b > 0) & (code_b <= known.hot)
        of = [(np.flatnonzero(~hot), dealt(before[~hot], known.buckets))]
        for rank in np.unique(code_b[hot]) - 1:
            mine, where = np.flatnonzero(code_b == rank + 1), known.buckets_of(rank)
            of.append((np.tile(mine, len(where)), np.repeat(where, len(mine))))
        at, bucket = (np.concatenate(x) for x in zip(*of, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, at = bucket[order], at[order]
        begin, size = runs([bucket])
        data = [packed(*(x[at[a : a + n]] for x in (before, word, c, root))) for a, n in zip(begin, size, strict=True)]
        return pa.table({"bucket": bucket[begin], "data": pa.array(data, pa.binary())})

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "bucket bigint, data binary").groupBy("bucket").applyInArrow(add, "bucket bigint, data binary")


class Part:
    """The contexts that end in the words of one bucket, and their next words."""

    def __init__(self, known: Words, data: list[bytes], given: list[bytes], depth: int, often: int, total: int, distinct: int, test: float, prior: float) -> None:
        self.known, self.depth, self.data = known, depth, data
        self.size = float(total + distinct + 1)
        before, word, c, root = (np.concatenate(x) for x in zip(*map(unpacked, given), strict=True)) if given else (np.zeros(0, np.int64),) * 4
        hot = np.sort(known.hashes[: known.hot])
        pair = chained(chained(before, np.zeros(len(before), np.int64)), word)
        order = np.argsort(pair)
        given_pair, given_root = pair[order], root[order]
        ready = order[found_at(hot, before[order]) >= 0]
        self.contexts: list[np.ndarray] = []
        self.left: list[np.ndarray] = []  # by context: what is left to its longest suffix
        self.grams: list[np.ndarray] = []
        self.ratio: list[np.ndarray] = []  # by sequence: probability against the root's
        held: list[list[tuple]] = [[] for _ in range(depth)]
        for one in data:
            for n, (context, gram, origin, count, first) in enumerate(self.sequences(one)):
                keep = count > 0
                if n == 0:  # of hot words the whole counts are given
                    keep &= ~((first > 0) & (first <= known.hot))
                held[n].append(tuple(x[keep] for x in (gram, context, origin, count)))
            if sum(len(x[0]) for x in held[0][1:]) > HELD_TOKENS // 2:
                held = [[self.summed(h)] for h in held]
        below_gram, below_p = np.zeros(0, np.int64), np.zeros(0)
        for n in range(depth):
            gram, context, origin, count = self.summed(held[n]) if held[n] else (np.zeros(0, np.int64),) * 4  # origin: the next word's code or the sequence without its first word
            held[n] = []
            many = count >= often
            if n == 0:
                at = found_at(given_pair, gram[many])
                top = np.concatenate([[0], known.counts])
                in_top = origin[many] <= len(known.counts)
                times = np.where(in_top, top[np.where(in_top, origin[many], 0)], given_root[at] if len(given_root) else 0)
                roots = np.concatenate([times, root[ready]])
                mine = [np.concatenate(x) for x in ((gram[many], pair[ready]), (context[many], chained(before[ready], np.zeros(len(ready), np.int64))), (count[many], c[ready]))]
                first = parent = (roots + 1) / self.size
            else:
                mine = [gram[many], context[many], count[many]]
                at = found_at(below_gram, origin[many])
                parent, first = below_p[0][at], below_p[1][at]
            g, of, times = mine
            contexts, which = np.unique(of, return_inverse=True)
            at = found_at(contexts, context)
            whole = np.bincount(at[at >= 0], count[at >= 0], len(contexts))
            if n == 0 and len(hot):
                at = found_at(contexts, chained(known.hashes[: known.hot], np.zeros(known.hot, np.int64)))
                whole[at[at >= 0]] = known.counts[: known.hot][at >= 0]
            kept, share = np.bincount(which, times, len(contexts)), np.bincount(which, parent, len(contexts))
            gain = np.bincount(which, times * np.log(times / parent), len(contexts)) - kept * np.log(whole)
            rest = 1 - kept / whole
            gain += np.where(rest > 1e-9, whole * rest * np.log(np.maximum(rest, 1e-12) / np.maximum(1 - share, 1e-12)), 0.0)
            state = gain >= test
            left = np.where(state, (whole - kept + prior) / (whole + prior), 1.0)
            p = np.where(state[which], times / (whole[which] + prior), 0.0) + left[which] * parent
            order = np.argsort(g)
            below_gram, below_p = g[order], (p[order], first[order])
            ratio = below_p[0] / below_p[1]
            self.contexts.append(contexts[state])
            self.left.append(left[state])
            met = state[which][order]
            self.grams.append(below_gram[met])
            self.ratio.append(ratio[met])

    @staticmethod
    def summed(parts: list[tuple]) -> tuple:
        gram, *rest, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram)
        begin, _ = runs([gram[order]])
        first = order[begin]
        return (gram[first], *(x[first] for x in rest), np.add.reduceat(count[order], begin) if len(begin) else count)

    def read(self, one: bytes):
        *codes, length, marked, own = unpacked(one)
        return codes, length, marked >> 1, (marked & 1).astype(np.int64), own

    def keys(self, codes: list[np.ndarray], own: np.ndarray):
        """For each length of context: whether there is one, its key, and that of it with its next word.  ``codes``: the word before, the one before that, and so on, then the next."""
        *before, last = (self.known.words(c, own) for c in codes)
        there, context = np.ones(len(last), bool), np.zeros(len(last), np.int64)
        for c, w in zip(codes, before, strict=False):
            there = there & (c > 0)
            context = chained(w, context)
            yield there, context, chained(context, last)

    def sequences(self, one: bytes):
        codes, length, _, train, own = self.read(one)
        begin = np.cumsum(length) - length
        count = np.add.reduceat(train, begin) if len(begin) else length
        origin = codes[-1]
        for there, context, gram in self.keys(codes, own):
            yield tuple(x[there] for x in (context, gram, origin, count, codes[0]))
            origin = gram

    def sums(self, one: bytes) -> bytes | None:
        """Documents and their sums of log10 of the tree's probabilities against the root's."""
        codes, length, doc, _, own = self.read(one)
        r = np.ones(len(length))
        for n, (there, context, gram) in enumerate(self.keys(codes, own)):
            begin, size = runs([context])
            at = np.repeat(found_at(self.contexts[n], context[begin]), size)
            hit = np.flatnonzero(there & (at >= 0))
            at, seen = at[hit], found_at(self.grams[n], gram[hit])
            r[hit] = np.where(seen >= 0, self.ratio[n][seen] if len(self.ratio[n]) else 1.0, r[hit] * self.left[n][at])
        value = np.bincount(doc, np.repeat(np.log10(r), length))
        at = np.flatnonzero(value)
        return packed(np.diff(at, prepend=0), fixed(value[at])) if len(at) else None


def fixed(x: np.ndarray) -> np.ndarray:
    """Multiples of 2 ** -36, whose sums do not hang on their order; zigzag, so that small numbers are short."""
    n = np.rint(x * 2.0**36).astype(np.int64)
    return (n << 1) ^ (n >> 63)


def unfixed(n: np.ndarray) -> np.ndarray:
    return (n >> 1) ^ -(n & 1)


def table_scores(rows: DataFrame, counts: DataFrame, id_type: str, depth: int, floor: int, total: int, distinct: int, test: float, prior: float) -> DataFrame:
    """The scores by a model of any size, which never leaves the cluster."""
    spark, id_kind = rows.sparkSession, to_arrow_schema(rows.select("doc_id").schema).field(0).type
    often, size = max(2, floor), float(total + distinct + 1)
    least = max(1, math.ceil(CACHED * total), known_from(counts))
    top = counts.where(F.col("c") >= least).mapInArrow(hashes, "g bigint, c bigint").toArrow()  # at most KNOWN
    order = np.lexsort((top["g"].to_numpy(), -top["c"].to_numpy()))
    buckets = max(1, math.ceil(total / BUCKET))
    shared = spark.sparkContext.broadcast(Words(top["g"].to_numpy()[order], top["c"].to_numpy()[order], least, buckets, max(1, BUCKET // 2)))
    given = common_pairs(rows, shared, often)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        known: Words = shared.value
        n, part, top = len(known.hashes), TaskContext.get().partitionId() << 32, len(known.hashes)
        roots = np.log10((np.concatenate([[0], known.counts]) + 1) / size)
        kind = pa.list_(id_kind)

        def row(bucket, block, what, data, ids=None):
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "block": pa.array([block], pa.int64()), "kind": pa.array([what], pa.int32()), "data": pa.array([data], pa.binary()), "ids": pa.array([None], kind) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(kind.value_type))})

        for block, (words, place, doc, train, ids) in enumerate(blocks(batches), part):
            codes, own = known.codes(words)
            length = np.bincount(doc, minlength=len(ids))
            begin = np.cumsum(length) - length
            in_top = codes <= n
            base = np.add.reduceat(np.where(in_top, roots[np.where(in_top, codes, 0)], 0.0), begin)
            yield row(2 * buckets + block % buckets, block, 2, packed(train, length, np.add.reduceat(in_top.astype(np.int64), begin), fixed(base)), ids)
            marked = 2 * doc + train[doc]
            for what in (0, 1):
                if what:  # words that not every task knows
                    at = np.flatnonzero(~in_top)
                    columns = [buckets + dealt(words[at], buckets), codes[at]]
                else:
                    before, there = [], np.ones(len(codes), bool)
                    for j in range(1, depth + 1):
                        there = there & (place >= j)
                        there[:j] = False
                        c = np.where(there, np.roll(codes, j), 0)
                        if known.all_twice:
                            there = there & (c <= top)
                            c = np.where(there, c, 0)
                        before.append(c)
                    at = np.flatnonzero(before[0] > 0)
                    by = np.roll(words, 2)[at] * (before[1][at] > 0) if depth > 1 else words[at]
                    bucket = known.bucket(before[0][at], np.roll(words, 1)[at], by)
                    columns = [bucket, *(c[at] for c in before), codes[at]]
                order = ordered(columns)
                columns, mark = [c[order] for c in columns], marked[at][order]
                first, count = runs(columns)
                columns = [c[first] for c in columns]
                ends = np.append(first, len(mark))
                for a, m in zip(*runs(columns[:1]), strict=True):
                    mine, rest = known.picked([c[a : a + m] for c in columns[1:]], own)
                    yield row(columns[0][a], block, what, packed(*mine, count[a : a + m], mark[ends[a] : ends[a + m]], rest))

    shape = f"bucket bigint, block bigint, kind int, data binary, ids array<{id_type}>"
    answer = f"block bigint, kind int, data binary, ids array<{id_type}>"

    def answered(group: pa.Table, given: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        known: Words = shared.value
        columns = ["block", "kind", "data", "ids"]
        what, data = group["kind"][0].as_py() if len(group) else 2, group["data"].to_pylist()
        if what == 2:
            return group.select(columns)
        if what == 1:
            out = tail(known, data, size)
        else:
            part = Part(known, data, given["data"].to_pylist(), depth, often, total, distinct, test, prior)
            out = [part.sums(x) for x in data]
        made = group.select(columns).set_column(2, "data", pa.array(out, pa.binary()))
        return made.filter(pa.compute.is_valid(made["data"]))

    def final(group: pa.Table) -> pa.Table:
        own, ids = next((unpacked(d.as_py()), i.values) for k, d, i in zip(group["kind"].to_pylist(), group["data"], group["ids"], strict=True) if k == 2)
        train, length, seen, base = own
        base, tree = unfixed(base), np.zeros(len(length), np.int64)
        seen = seen.copy()
        for what, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            if what != 2:
                at, value, *known = unpacked(data)
                at = np.cumsum(at)
                (base if what else tree)[at] += unfixed(value)
                if what:
                    seen[at] += known[0]
        return pa.table({"doc_id": ids, "held_out": train == 0, "n_tokens": length, "n_known": seen, "train_tokens": np.full(len(length), total), "base_score": base / 2.0**36, "score": (base + tree) / 2.0**36})

    small_batches(spark)
    spread = rows.select("doc_id", "text", "train").mapInArrow(run, shape)
    met = spread.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(answered, answer)
    return met.groupBy("block").applyInArrow(final, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def tail(known: Words, data: list[bytes], size: float) -> list[bytes]:
    """Documents and their sums of log10 of the root's probabilities, and how many words are known, of words that not every task knows."""
    parts = []
    for one in data:
        word, length, marked, own = unpacked(one)
        parts.append((known.words(word, own), length, marked))
    counts = [np.add.reduceat(m & 1, np.cumsum(n) - n) for _, n, m in parts]
    unique, at = np.unique(np.concatenate([w for w, _, _ in parts]), return_inverse=True)
    c = np.bincount(at, np.concatenate(counts), len(unique))
    out = []
    for word, length, marked in parts:
        times = c[np.searchsorted(unique, word)]
        doc = marked >> 1
        value, seen = np.bincount(doc, np.repeat(np.log10((times + 1) / size), length)), np.bincount(doc, np.repeat(times > 0, length)).astype(np.int64)
        met = np.flatnonzero(np.bincount(doc))
        out.append(packed(np.diff(met, prepend=0), fixed(value[met]), seen[met]))
    return out


def hashes(batches):
    """g, c: the hash and the count of each word."""
    import xxhash

    for batch in batches:
        g = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column(0).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"g": g.view(np.int64), "c": batch.column(1)})


def known_from(counts: DataFrame) -> int:
    """The least count from which at most ``KNOWN`` words are broadcast."""
    least, n = 1 << 62, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        n += r["count"]
        if n > KNOWN:
            break
        least = r.c
    return least


def scored(documents: DataFrame, train, depth: int = 2, least: float = 0.0, test: float = 12.0, prior: float = 8.0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: n_tokens, n_known, train_tokens, base_score and score (log10), held_out.

    ``train``: a condition on the table's columns; texts for which it is false are held out.
    """
    id_type = type_of(documents, doc)
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    counts = checkpointed(word_counts(rows.where("train")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    floor = max(1, math.ceil(least * total))
    if total / floor > WHOLE:
        return table_scores(rows, counts, id_type, depth, floor, total, distinct, test, prior)
    return broadcast_scores(rows, counts, id_type, depth, floor, total, distinct, test, prior)


def broadcast_scores(rows: DataFrame, counts: DataFrame, id_type: str, depth: int, floor: int, total: int, distinct: int, test: float, prior: float) -> DataFrame:
    """The scores by a model of at most ``WHOLE`` sequences of each length."""
    spark, learn = rows.sparkSession, rows.where("train")
    frequent = counts.where(F.col("c") >= floor).orderBy(F.desc("c"), "word").collect()  # at most WHOLE
    model = Model([w.word.encode() for w in frequent], [w.c for w in frequent])
    for _ in range(depth):
        shared = spark.sparkContext.broadcast(model)
        found = sequence_counts(learn, shared).where(F.col("c") >= max(2, floor)).toArrow()  # at most WHOLE
        shared.unpersist()
        model.add(found["code"].to_numpy(), found["c"].to_numpy())
    model.grow(total, distinct, test, prior)
    shared = spark.sparkContext.broadcast(model)

    def make():
        part, place = TaskContext.get().partitionId() << 33, 0

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal place
            tree: Model = shared.value
            docs = [tokens(t) for t in texts(batch)]
            ids = tree.word_ids(docs)
            root, p = tree.score(ids)
            lengths = np.array([len(d) + 1 for d in docs])
            starts = np.cumsum(lengths) - lengths
            inside = np.ones(len(ids), bool)
            inside[starts + lengths - 1] = False
            sums = [np.add.reduceat(np.where(inside, x, 0), starts) for x in (root, p, (ids >= 0) & inside)]
            row = np.arange(part + place, part + place + len(docs))
            place += len(docs)
            rare = [Counter(w for w in d if w not in tree.ids) for d in docs]
            n = [len(r) for r in rare]
            m = sum(n)

            def column(values, kind, rest=None):
                return pa.concat_arrays([pa.array(values, kind), rest if rest is not None else pa.nulls(m, kind)])

            return {
                "row": pa.array(np.concatenate([row, np.repeat(row, n)])),
                "doc_id": pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]),
                "held_out": pa.concat_arrays([pa.compute.invert(batch.column(2)), pa.nulls(m, pa.bool_())]),
                "n_tokens": column(lengths - 1, pa.int64()),
                "n_known": column(sums[2], pa.int64()),
                "base": column(sums[0], pa.float64()),
                "tree": column(sums[1], pa.float64()),
                # no word holds white space: a document's own row meets none, and has a place of its own in the shuffle
                "word": pa.concat_arrays([pa.array([f" {r}" for r in row.tolist()], pa.string()), pa.array(chain.from_iterable(rare), pa.binary()).cast(pa.string())]),
                "times": column(repeat(0, len(docs)), pa.int64(), pa.array(list(chain.from_iterable(r.values() for r in rare)), pa.int64())),
            }

        return work

    flat = arrow_map(rows, make, f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, tree double, word string, times bigint")
    other = counts.where(F.col("c") < floor)
    seen = F.coalesce("c", F.lit(0))
    own = F.when(F.col("times") > 0, F.col("times") * F.log10((seen + 1) / F.lit(float(total + distinct + 1)))).otherwise(0.0)
    return (
        flat.join(other, "word", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.bool_or("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + F.sum(F.when(seen > 0, F.col("times")).otherwise(0))).alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"),
            (F.sum("base") + F.sum(own)).alias("base_score"),
            (F.sum("tree") + F.sum(own)).alias("score"),
        )
        .drop("row")
    )
