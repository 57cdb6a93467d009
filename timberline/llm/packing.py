"""Order-preserving packing into sequences by dynamic programming.

Documents are laid end to end in table order, as token ids with one end id after
each.  A cut may fall behind a document, behind a sentence (a token that ends
one, at most one candidate in ``grid`` tokens) or, where neither occurs for long,
on the grid.  The cost of a packing is its padding plus a penalty for each cut
inside a document: small behind a sentence, large elsewhere.  With positions p
and best costs f,

    f[j] = penalty[j] + min over i with p[j] - p[i] <= size of f[i] + padding(p[j] - p[i])

Padding is ``size - length``, so the minimum of ``f[i] + p[i]`` over a sliding
window decides, kept in a monotone queue: linear time.  A length that is a power
of two is not padded; those few predecessors are looked up on their own.

Each input partition is packed by itself and streams: when ``flush`` tokens are
waiting they are packed, all but the last sequences are emitted, and the rest
waits for more.  No task holds more than that and one document, nothing is
shuffled, and a lost task is redone from its own input with the same result.

Defined cases: a null text is empty; an empty document is its end id alone; a
document longer than a sequence is cut; repeated documents are packed as often
as they occur; an empty table gives no rows; further columns are ignored by
``packed`` and need no particular names.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts, type_of

SIZE = 4096
END_ID = 2
#: Distinct white-space-separated chunks whose ids a worker remembers before it starts anew.
CACHE = 100_000
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Chunks of printable Latin-1: lower-casing and composing them is the same by any Unicode version.
_PLAIN = re.compile("[!-~\u00a1-\u00ff]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are their own, the others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class Encoder(dict):
    """Ids of a chunk without ASCII white space, as little-endian 32-bit words.

    The tokenizer splits its input at white space before anything else and drops
    the white space, so the ids of a text are those of its chunks in turn.  A
    plain chunk is cut into the tokenizer's pieces here and only the pieces go
    through its BPE model; any other chunk goes through the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.pieces = self.tokenizer.model, byte_letters(), {}
        self.ends = self.sentence_ends()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        self.pieces[piece] = out = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return out

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        get = self.pieces.get
        if chunk.isalpha():  # letters of ASCII alone are one piece
            out = get(piece := chunk.lower().decode()) or self.piece(piece)
        elif chunk[:-1].isalpha() and chunk[-1:] in b".,":
            out = (get(piece := chunk[:-1].lower().decode()) or self.piece(piece)) + (get(end := chunk[-1:].decode()) or self.piece(end))
        elif "<|" not in (text := chunk.decode()) and _PLAIN.fullmatch(text):
            out = b"".join([get(p) or self.piece(p) for p in _PIECE.findall(text.lower())])
        else:
            out = array("I", self.ids(text)).tobytes()
        self[chunk] = out
        return out

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))

    def sentence_ends(self) -> np.ndarray:
        """Of every id of the vocabulary, and of the end id, whether it ends a sentence."""
        out = np.zeros(max(self.tokenizer.get_vocab_size(), END_ID + 1), bool)
        out[[i for mark in (".", "!", "?", "。", "！", "？") for i in self.ids(mark)[-1:]]] = True
        return out

    def forget(self) -> None:
        """Drop what is remembered, as a worker process outlives its task."""
        self.clear()
        self.pieces.clear()


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process; reading the vocabulary takes long."""
    return Encoder(path)


def cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, grid: int, sentence: float, hard: float, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate positions in documents laid end to end (each behind a token) and their penalties; ``ends`` is true for ids that end a sentence."""
    at = np.flatnonzero(ends[ids]) + 1
    doc = np.searchsorted(doc_ends, at, "left")
    inside = at != doc_ends[doc]
    at, doc = at[inside], doc[inside]
    if len(at):
        cell = (at - np.concatenate([[0], doc_ends])[doc]) // grid
        at = at[np.append((cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1]), True)]
    position = np.concatenate([at, doc_ends])
    penalty = np.concatenate([np.full(len(at), sentence), np.zeros(len(doc_ends))])
    order = np.argsort(position, kind="stable")
    position, penalty = position[order], penalty[order]
    before = np.concatenate([[0], position[:-1]])
    if len(wide := np.flatnonzero(position - before > widest)):
        extra = np.concatenate([np.arange(before[k] + grid, position[k], grid) for k in wide])
        position, penalty = np.concatenate([position, extra]), np.concatenate([penalty, np.full(len(extra), hard)])
        order = np.argsort(position, kind="stable")
        position, penalty = position[order], penalty[order]
    return position, penalty


def best_cuts(position: list[int], penalty: list[float], size: int) -> list[int]:
    """Indexes into ``position`` (which begins with 0 and has no step over ``size``) of the cheapest cuts, first and last among them."""
    powers = [1 << k for k in range(size.bit_length() - 1, -1, -1) if 1 << k <= size and 1 << k >= size // 64] or [1]
    cost, back = [0.0] * len(position), [0] * len(position)
    index, queue, put = {0: 0}, deque([0]), {0: 0.0}
    for j in range(1, len(position)):
        p = position[j]
        while position[queue[0]] < p - size:
            put.pop(queue.popleft())
        i = queue[0]
        least = put[i] + size - p
        for power in powers:
            k = index.get(p - power)
            if k is not None and cost[k] < least:
                least, i = cost[k], k
        cost[j], back[j] = least + penalty[j], i
        index[p] = j
        value = cost[j] + p
        while queue and put[queue[-1]] >= value:
            put.pop(queue.pop())
        queue.append(j)
        put[j] = value
    out = [len(position) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Packer:
    """Takes documents in order and gives rows (key, start, length, ids_crc32, doc_tokens, sequence, offset).

    Positions count tokens since the last one emitted.
    """

    def __init__(self, ends: np.ndarray, size: int = SIZE, grid: int = 32, sentence: float = 8.0, hard: float = 64.0, flush: int = 1 << 20) -> None:
        self.ends = ends
        self.size, self.grid, self.sentence, self.hard, self.flush = size, min(grid, max(1, size // 4)), sentence, hard, flush
        self.docs: deque[list] = deque()  # key, all its ids, tokens of them emitted
        self.position, self.penalty = np.zeros(0, np.int64), np.zeros(0)
        self.waiting = self.sequence = 0

    def add(self, keys: list, encoded: list[bytes]) -> Iterator[tuple]:
        if not keys:
            return
        doc_ends = np.cumsum([len(x) // 4 for x in encoded])
        position, penalty = cuts(np.frombuffer(b"".join(encoded), "<u4"), doc_ends, self.ends, self.grid, self.sentence, self.hard, self.size // 4)
        self.docs.extend([k, x, 0] for k, x in zip(keys, encoded, strict=True))
        self.position, self.penalty = np.concatenate([self.position, position + self.waiting]), np.concatenate([self.penalty, penalty])
        self.waiting += int(doc_ends[-1])
        if self.waiting >= self.flush:
            yield from self.pack(last=False)

    def pack(self, last: bool = True) -> Iterator[tuple]:
        if not self.waiting:
            return
        position = [0, *self.position.tolist()]
        chosen = [position[i] for i in best_cuts(position, [0.0, *self.penalty.tolist()], self.size)]
        if not last:  # what the end of the waiting tokens has shaped is decided when more are there
            chosen = [p for p in chosen if p <= self.waiting - 8 * self.size]
        yield from self.emit(chosen)
        done = chosen[-1] if chosen else 0
        keep = self.position > done
        self.position, self.penalty = self.position[keep] - done, self.penalty[keep]
        self.waiting -= done

    def emit(self, chosen: list[int]) -> Iterator[tuple]:
        at = 0
        for end in chosen[1:]:
            offset = 0
            while at < end:
                key, ids, first = doc = self.docs[0]
                total = len(ids) // 4
                n = min(total - first, end - at)
                yield key, first, n, zlib.crc32(memoryview(ids)[4 * first : 4 * (first + n)]), total, self.sequence, offset
                at, offset, doc[2] = at + n, offset + n, first + n
                if first + n == total:
                    self.docs.popleft()
            self.sequence += 1


def packed(documents: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, **weights) -> DataFrame:
    """A row for each piece of a document in a sequence.

    ``tokenizer`` is the path of a tokenizers file that is the same on all machines.
    sequence_id holds the input partition in its upper and a running number in its lower 32 bits.
    """
    id_type = type_of(documents, doc)

    def run(batches: Iterable[pa.RecordBatch]):
        import pyarrow.compute  # noqa: F401

        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        packer, part = Packer(encoder.ends, size, **weights), TaskContext.get().partitionId() << 32
        names = ["doc_id", *(f.split()[0] for f in PIECES.split(", "))]
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            key, *columns = zip(*rows, strict=True)
            columns[4] = [s + part for s in columns[4]]
            return pa.RecordBatch.from_arrays([pa.array(key, kind), *(pa.array(c, pa.int64()) for c in columns)], names)

        for piece in slices(batches):
            kind = piece.column(0).type
            rows = list(packer.add(piece.column(0).to_pylist(), [encoder.encode(t) + end for t in texts(piece)]))
            if rows:
                yield batch(rows)
        if rows := list(packer.pack()):
            yield batch(rows)
        encoder.forget()

    small_batches(documents.sparkSession)
    return documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, {PIECES}")
