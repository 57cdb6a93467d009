"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

1. Each text becomes its set of shingle hashes.  Equal sets are one node, however
   many documents share it.
2. A node that can be linked to another shares most of its tokens with others.
   The tokens that a single node holds are counted for each node; where they are
   more than a link may miss, no group can hold enough of the node's tokens, and
   it is settled alone.  Few nodes stay open.
3. Open nodes are partitioned into groups of similar sets: those with the same
   least hash among the more frequent half of their tokens, in parts of bounded size.
4. The matrix holds each group's token union, a row for each (token, group).  Two
   sets within the threshold share at least k of their first n - ceil(t n) + k
   tokens in any common order; the order is by frequency, rarest first, and only
   those tokens are kept.  The overlap of a node's first tokens with a group's
   union bounds what it can share with a member; with sizes it rules groups out.
5. Only the groups left are opened: their sets and the sets that ask for them meet
   in blocks of bounded size, where overlaps are counted by token lists.
6. Components of the links give the classes.

No link between different sets is lost: each bound is a necessary condition.
Pairs within a class are never listed: a block gives a spanning forest.

Scale: two passes over the texts, and one over the texts of open nodes.  Tokens
travel as packed arrays; a token that more than ``FEW`` sets of a task hold costs
one place a task.  Groups are cut by rows and bytes, so that a block
fits into a task whatever its size.  Needed keys are broadcast only up to
``BROADCAST`` bytes, else joined.  Sets are told apart by 128 bits, shingles and
the holders of a token by 64.

Defined cases: a null, empty or blank text has an empty set, is linked with
nothing and is its own component; a text of fewer words than a shingle has one;
repeated rows are linked to each other; null ids count as no id (a component of
nothing else has a null id); an empty table gives no rows; further columns are
ignored, or kept by ``representatives``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, parallel, slices, small_batches, texts, type_of
from .components import components

#: Bytes up to which a table is broadcast.
BROADCAST = 16 << 20
#: Sets and bytes of hashes of one part of a group, and of the sets that ask for it in one block.
ROWS, BYTES = 4096, 8 << 20
#: Sets up to this size show all their tokens to the count of holders, larger ones a share of them.
WHOLE = 128
#: Tokens that a task gathers before it hands them on, and tokens of a bucket.
HELD = 1 << 20
#: Holders of a token that a task hands on; more are counted where they are, so that no bucket grows with a hot token.
FEW = 16
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(docs: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of ``size`` words of each text."""
    import xxhash

    own = [d.lower().split() for d in docs]
    lengths = [len(w) for w in own]
    hashes = np.fromiter((h for w in own for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, sum(lengths))
    del own
    rolled = np.zeros(len(hashes), np.uint64)
    for j in range(size):  # the order of the words counts
        rolled[: len(hashes) - j] = _mixed(rolled[: len(hashes) - j] + hashes[j:] + _M3)
    out, at = [], 0
    for n in lengths:
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1].view(np.int64)))
        elif n:
            whole = np.zeros(1, np.uint64)
            for h in hashes[at : at + n]:
                whole = _mixed(whole + h + _M3)
            out.append((_mixed(whole + np.uint64(n))).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


class Shown:
    """Which tokens of a set count for its being open.

    Sets of at most ``WHOLE`` tokens show all, larger ones those whose hash is
    divisible by ``share``.  A set whose partners may be larger is judged by the
    divisible ones alone, as its partners may show no others; bit 0 of its key
    says so.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.whole = num, den, WHOLE
        self.share = max(1, int(den / (2.5 * max(1, den - num))))

    def sampled(self, n: int) -> bool:
        return self.share > 1 and n * self.den > self.num * self.whole

    def key(self, fp: bytes, n: int) -> int:
        """63 bits of the fingerprint and the flag; never 0."""
        return (int.from_bytes(fp[:8], "little", signed=True) & ~1 | self.sampled(n)) or 2

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        return hashes if len(hashes) <= self.whole or self.share == 1 else hashes[hashes % self.share == 0]

    def judged(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return ((keys & 1) == 0) | (hashes % self.share == 0)

    def count(self, hashes: np.ndarray) -> int:
        """How many tokens the set is judged by."""
        return int((hashes % self.share == 0).sum()) if self.sampled(len(hashes)) else len(hashes)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


class Join:
    """Linked if den * intersection >= num * union."""

    def __init__(self, documents: DataFrame, size: int, num: int, den: int, doc: str, text: str) -> None:
        self.size, self.num, self.den = size, num, den
        self.shown = Shown(num, den)
        self.id_type = type_of(documents, doc)
        self.rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))

    # --- numbers that follow from a set's size n, as Columns ---

    def least_overlap(self, n):
        return F.floor((self.num * n + self.den - 1) / self.den)

    def at_least(self, n):
        """k: shared tokens asked for."""
        return F.when(n * self.num >= 30 * self.den, 3).otherwise(1)

    def sure(self, n):
        """The k that a set and any set linked to it both meet."""
        return self.at_least(n * F.lit(self.num) / F.lit(self.den))

    # --- sets ---

    def sets(self) -> DataFrame:
        """doc_id, th, n, fp, key, judged: of each document its set's size, fingerprint, key, and how many tokens it is judged by."""
        size, shown = self.size, self.shown

        def make():
            def work(batch: pa.RecordBatch) -> dict:
                sets = shingle_sets(texts(batch), size)
                fps = [fingerprint(s) for s in sets]
                return {
                    "doc_id": batch.column(0),
                    "th": batch.column(2),
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "fp": pa.array(fps, pa.binary()),
                    "key": pa.array([shown.key(f, len(s)) for f, s in zip(fps, sets, strict=True)], pa.int64()),
                    "judged": pa.array([shown.count(s) for s in sets], pa.int32()),
                }

            return work

        return arrow_map(self.rows, make, f"doc_id {self.id_type}, th bigint, n int, fp binary, key bigint, judged int")

    def shared(self, tokens: int) -> DataFrame:
        """key, shared: how many of the tokens a set is judged by other sets hold as well; ``tokens``: how many there are in all, about."""
        size, shown = self.size, self.shown
        buckets = max(parallel(self.rows.sparkSession), -(-tokens // shown.share // HELD))
        names = ["bucket", "tokens", "keys"]

        def gather(batches):
            import pyarrow.compute  # noqa: F401

            own = buckets + TaskContext.get().partitionId()
            held: list[np.ndarray] = []
            keys: list[int] = []
            met: set[int] = set()

            def out():
                """Each token with its holders; with 0 where there are more than ``FEW``, which are counted here."""
                token = np.concatenate(held).view(np.uint64)
                key = np.repeat(np.array(keys, np.int64), [len(h) for h in held])
                order = np.argsort(token, kind="stable")
                token, key = token[order], key[order]
                starts, sizes = _runs(token)
                hot = np.repeat(sizes > FEW, sizes)
                known, count = np.unique(key[hot][shown.judged(token[hot].view(np.int64), key[hot])], return_counts=True)
                first = np.zeros(len(token), bool)
                first[starts] = True
                key = np.where(hot, 0, key)[~hot | first]
                token = token[~hot | first]
                cut = np.searchsorted(((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
                rows = [(b, token[cut[b] : cut[b + 1]].tobytes(), key[cut[b] : cut[b + 1]].tobytes()) for b in some] + [(own, known.tobytes(), count.astype(np.int64).tobytes())]
                for at in range(0, len(rows), 4096):
                    b, t, k = zip(*rows[at : at + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(t, pa.binary()), pa.array(k, pa.binary())], names)
                held.clear(), keys.clear()
                if len(met) > HELD:
                    met.clear()

            many = 0
            for piece in slices(batches):
                for s in shingle_sets(texts(piece), size):
                    if len(s) and (key := shown.key(fingerprint(s), len(s))) not in met:
                        met.add(key)
                        held.append(shown.tokens(s))
                        keys.append(key)
                        many += len(held[-1])
                if many > HELD:
                    yield from out()
                    many = 0
            if many:
                yield from out()

        def both(group: pa.Table, *columns: str) -> list[np.ndarray]:
            return [np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in columns]

        def count(group: pa.Table) -> pa.Table:
            """How many shared tokens each key has in a bucket, packed by slots of keys."""
            token, key = both(group, "tokens", "keys")
            if group["bucket"][0].as_py() < buckets:
                order = np.argsort(token, kind="stable")
                token, key = token[order], key[order]
                starts, sizes = _runs(token)
                several = np.repeat(np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts), sizes) & (key != 0)
                token, key = token[several], key[several]
                mine = shown.judged(token, key)
                token, key = token[mine], key[mine]
                order = np.lexsort((token, key))  # tasks with copies of a set show it each
                token, key = token[order], key[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (token[1:] != token[:-1])])[: len(key)]
                token, key = np.unique(key[new], return_counts=True)
            order = np.argsort(token.view(np.uint64) % np.uint64(buckets), kind="stable")
            known, times = token[order], key[order]
            starts, sizes = _runs(known.view(np.uint64) % np.uint64(buckets))
            slot = (known[starts].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            pack = lambda x: pa.array([x[a : a + n].astype(np.int64).tobytes() for a, n in zip(starts, sizes, strict=True)], pa.binary())
            return pa.table({"slot": slot, "keys": pack(known), "counts": pack(times)})

        def total(group: pa.Table) -> pa.Table:
            known, times = both(group, "keys", "counts")
            unique, at = np.unique(known, return_inverse=True)
            return pa.table({"key": unique, "shared": np.bincount(at, times, len(unique)).astype(np.int64)})

        small_batches(self.rows.sparkSession)
        packed = self.rows.select("text").mapInArrow(gather, "bucket bigint, tokens binary, keys binary")
        counted = packed.groupBy("bucket").applyInArrow(count, "slot bigint, keys binary, counts binary")
        return counted.groupBy("slot").applyInArrow(total, "key bigint, shared bigint")

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """node, set: all hashes (8 bytes each) of the nodes of ``wanted`` (node, first, copies), read from the first text of each."""
        size = self.size

        def make():
            def work(batch: pa.RecordBatch) -> dict:
                return {"node": batch.column(0), "set": pa.array([s.tobytes() for s in shingle_sets(texts(batch), size)], pa.binary())}

            return work

        few = small(wanted.select("node", F.col("first.doc_id").alias("d"), F.col("first.th").alias("t"), (F.col("copies") > 1).alias("several")))
        found = self.rows.join(few, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("node", "text", "several")
        # a row may be repeated whole: one set a node
        made = arrow_map(found.where("NOT several").select("node", "text"), make, "node bigint, set binary")
        return made.unionByName(arrow_map(found.where("several").select("node", "text"), make, "node bigint, set binary").dropDuplicates(["node"]))

    # --- the matrix ---

    def placed(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """node, n, g, part, p: of each open node its group and its first shared tokens, rarest first."""
        n = F.col("n")
        tokens = sets.mapInArrow(_exploded, "node bigint, token bigint")
        held = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        lists = tokens.join(held, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))
        # the tokens of this node alone come first in the order
        length = n - self.least_overlap(n) + self.at_least(n) - (n - F.size("t"))
        known = lists.join(nodes.select("node", "n"), "node").withColumn("length", length.cast("int")).where(F.least("length", F.size("t")) >= self.sure(n))
        token = lambda part: F.transform(part, lambda x: x.token)
        half = (F.size("t") / 2).cast("int")
        group = F.array_min(token(F.slice("t", half + 1, F.size("t"))))
        known = checkpointed(known.select("node", "n", group.alias("g"), token(F.slice("t", F.lit(1), F.col("length"))).alias("p")))
        parts = F.greatest(F.ceil(F.sum(8 * n + 64) / BYTES), F.ceil(F.count("*") / ROWS))
        sizes = small(known.groupBy("g").agg(parts.cast("int").alias("parts")))
        return checkpointed(known.join(sizes, "g").select("node", "n", "g", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "p"))

    def opened(self, placed: DataFrame) -> DataFrame:
        """g, part, node: the groups before their own that nodes have to meet."""
        prefix = placed.select("node", "n", F.struct("g", "part").alias("own"), F.explode("p").alias("token"))
        matrix = prefix.groupBy("token", F.col("own").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
        fits = (self.den * F.col("high") >= self.num * F.col("n")) & (self.num * F.col("low") <= self.den * F.col("n"))
        met = prefix.join(matrix, "token").where((F.col("other") < F.col("own")) & fits)
        met = met.groupBy("node", "other").agg(F.count("*").alias("k"), F.first("n").alias("n"))
        return met.where(F.col("k") >= self.sure(F.col("n"))).select("other.g", "other.part", "node")

    def links(self, placed: DataFrame, sets: DataFrame) -> DataFrame:
        """u, v: links that join what is linked; a spanning forest of each block."""
        num, den = self.num, self.den
        ask = checkpointed(self.opened(placed).join(placed.select("node", "n"), "node"))
        # as many blocks of a group as the sets that ask for it need
        blocks = ask.groupBy("g", "part").agg(F.greatest(F.ceil(F.sum(8 * F.col("n") + 64) / BYTES), F.ceil(F.count("*") / ROWS)).cast("int").alias("blocks"))
        inside = placed.groupBy("g", "part").agg(F.count("*").alias("members"))
        groups = checkpointed(inside.join(blocks, ["g", "part"], "left").where("members > 1 OR blocks > 0").select("g", "part", F.coalesce("blocks", F.lit(1)).alias("blocks")))
        body = placed.join(groups, ["g", "part"]).select("g", "part", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        asked = ask.join(groups, ["g", "part"]).select("g", "part", "node", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int").alias("block"))
        rows = body.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
        met = rows.join(sets, "node").groupBy("g", "part", "block").agg(F.collect_list(F.struct("node", "asks", "set")).alias("rows"))

        def compare(batches):
            for batch in batches:
                for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = rows.as_py()
                    found = spanning_links([r["node"] for r in own], [r["asks"] for r in own], [np.frombuffer(r["set"], np.int64) for r in own], num, den, block == 0)
                    yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

        small_batches(self.rows.sparkSession)
        return met.select("block", "rows").mapInArrow(compare, "u bigint, v bigint")

    # --- classes ---

    def classes(self) -> DataFrame:
        every = checkpointed(self.sets())
        some = every.where("n > 0")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
        nodes = checkpointed(some.groupBy("fp").agg(first, F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "key", "judged"))))
        tokens = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
        alone = F.col("judged") - F.coalesce("shared", F.lit(0))
        may_miss = F.col("n") - self.least_overlap(F.col("n"))
        still = nodes.join(self.shared(tokens), "key", "left").where(alone <= may_miss)
        open_nodes = checkpointed(still.select(F.monotonically_increasing_id().alias("node"), "fp", "first", "copies", "n"))
        sets = checkpointed(self.whole_sets(open_nodes))
        final = components(self.links(self.placed(open_nodes, sets), sets))

        joined = open_nodes.join(final, F.col("node") == F.col("id")).select("fp", "first", "component")
        least = joined.groupBy("component").agg(F.min("first").alias("least"))
        moved = joined.join(least, "component").select("fp", "least")
        of_fp = nodes.select("fp", "first").join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))
        out = every.select("doc_id", "th", "n", "fp").join(of_fp, "fp", "left")
        empty = F.col("n") == 0
        return out.select(
            "doc_id",
            "th",
            F.col("n").cast("bigint").alias("n_shingles"),
            F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
            (empty | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("th").eqNullSafe(F.col("first.th")))).alias("stays"),
        )


def spanning_links(nodes: list[int], asks: list[bool], sets: list[np.ndarray], num: int, den: int, within: bool) -> list[tuple[int, int]]:
    """Links between the sets that ask and the others, and among the others if ``within``; a spanning forest of them."""
    sizes = np.array([len(s) for s in sets])
    token, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    body = np.flatnonzero(~np.array(asks))
    # the members that hold each token
    entry = np.concatenate([local[starts[i] : starts[i] + sizes[i]] for i in body]) if len(body) else np.zeros(0, np.int64)
    order = np.argsort(entry, kind="stable")
    holder = np.repeat(np.arange(len(body)), sizes[body])[order]
    first = np.searchsorted(entry[order], np.arange(len(token) + 1))
    held = np.diff(first)
    label, out = np.arange(len(nodes)), []
    # sets whose tokens are common in the block first: they link most, and those after them find one label
    weight = np.array([held[local[a : a + n]].sum() / max(1, n) for a, n in zip(starts, sizes, strict=True)])
    for i in np.argsort(-weight, kind="stable").tolist():
        if not (asks[i] or within) or (label[body] == label[i]).all():
            continue
        own = local[starts[i] : starts[i] + sizes[i]]
        many = held[own]
        at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(holder[at], minlength=len(body))
        linked = (both > 0) & (den * both >= num * (sizes[i] + sizes[body] - both))
        for other in np.unique(label[body[linked]]).tolist():
            if other != label[i]:
                out.append((nodes[i], nodes[other]))
                label[label == other] = label[i]
    return out


def small(df: DataFrame) -> DataFrame:
    """The table, written, to be broadcast if it is within ``BROADCAST`` bytes at 32 bytes a row."""
    out = checkpointed(df)
    return F.broadcast(out) if 32 * out.count() <= BROADCAST else out


def _exploded(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        if sets:
            yield pa.RecordBatch.from_pydict({"node": np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets]), "token": np.concatenate(sets)})


def joined(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) for each document."""
    return Join(documents, size, num, den, doc, text).classes().select("doc_id", "n_shingles", "component_id")


def representatives(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are linked to another one which stays: of each class the row with the least id."""
    classes = checkpointed(Join(documents, size, num, den, doc, text).classes().select("doc_id", "th", "n_shingles", "stays"))
    gone = small(classes.where("NOT stays").select("doc_id", "th").distinct())
    # of rows that are repeated whole, one stays
    repeated = small(classes.where("stays AND n_shingles > 0").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"))
    keyed = documents.select(F.col(doc).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.struct(*documents.columns).alias("row"))
    same = F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))
    kept = keyed.join(gone, same, "left_anti")
    once = kept.join(repeated, same, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("k", "t").orderBy(F.lit(0)))).where("place = 1")
    return kept.join(repeated, same, "left_anti").select("row.*").unionByName(once.select("row.*"))
