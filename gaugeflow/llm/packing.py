"""Packing into training sequences by vector bin packing.

A piece is a vector (tokens, segments, loss-bearing tokens).  Every task packs the rows of
its own partition: it keeps a window of waiting pieces and fills one sequence at a time
with the piece that fits and has the largest dot product with what is left of the three
limits.  Nothing is shuffled, memory is bounded by the window, and a repeated task gives
the same sequences again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, held, text_or_empty

# Bounds of a worker's caches.
CACHED, CACHED_CHARS = 300_000, 48
# White space to Python, other characters to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
# Fixed values of the tokenizer's pre-tokens, spelt out for characters up to U+0233; words
# with any other character are left to the tokenizer.
_UNUSUAL = re.compile("[^\x00-\u0233]")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02c1\u02c6-\u02d1\u02e0-\u02e4\u02ec\u02ee"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

# Byte-level vocabularies write each byte as a printable character: itself where it is one,
# else the next free one from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how packing goes about it."""

    tokens: int = 4096
    segments: int = 24
    loss_tokens: int = 4088
    # Pieces that wait at a time in a task.
    window: int = 512
    # A gap of fewer tokens is padded instead of filled with a fragment.
    least_cut: int = 16


class Remembered(dict):
    """A dict that computes what it lacks; of two generations, the older one goes when the newer is full."""

    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room, self.older = compute, room, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of a text as little-endian 32-bit integers.

    This tokenizer drops white space and no token spans it, so words are looked up; an
    unknown word is looked up by its lower-case pre-tokens, and only those are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Remembered(self.word, CACHED)
        self.parts = Remembered(self.part, CACHED)

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        """A pre-token, straight to the merges of the tokenizer's model."""
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return np.array([t.id for t in self.model.tokenize(part)], dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        if "<|" in word or _UNUSUAL.search(word):
            return self.encode(word)
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))

    def text(self, text: str) -> bytes:
        if any(c in text for c in _SEPARATORS):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    """The ids of this process; a reused Python worker keeps its caches between tasks."""
    return held(("ids", path), lambda: WordIds(path))


class Packer:
    """Fills sequences from a bounded window of pieces (key, start, tokens, loss tokens, payload).

    ``cut`` splits a payload: cut(piece, n) gives the first n tokens and the rest.  Without
    it pieces stay whole.  ``place`` yields (sequence, offset, piece) for finished sequences.
    """

    def __init__(self, limits: Limits, cut=None):
        self.limits, self.cut = limits, cut
        self.waiting: list = []
        self.size = np.zeros((limits.window + 1, 3))
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.sequence = 0

    def add(self, piece) -> Iterator[tuple]:
        if piece[2] > self.limits.tokens or piece[3] > self.limits.loss_tokens:
            raise ValueError("a piece exceeds the limits of a sequence")
        self._keep(piece)
        if len(self.waiting) > self.limits.window - 1:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._fill()

    def _keep(self, piece) -> None:
        self.size[len(self.waiting)] = piece[2], 1, piece[3]
        self.waiting.append(piece)

    def _take(self, i: int):
        piece, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.size[i] = self.size[len(self.waiting)]
        return piece

    def _fill(self) -> Iterator[tuple]:
        """One sequence; the last one of a task is closed at powers of two where pieces may be cut."""
        room, placed = self.full.copy(), []
        while self.waiting:
            size = self.size[: len(self.waiting)]
            fits = (size <= room).all(axis=1)
            if fits.any():
                worth = size @ (room / self.full**2)
                piece = self._take(int(np.argmax(np.where(fits, worth, -1.0))))
            else:
                # A cut piece bears loss on all its tokens but the first.
                part, i = int(min(room[0], room[2] + 1)), int(np.argmax(size[:, 0]))
                if not self.cut or part < self.limits.least_cut or room[1] < 1 or size[i, 0] <= part:
                    break
                piece, rest = self.cut(self._take(i), part)
                self._keep(rest)
            placed.append(piece)
            room -= (piece[2], 1, piece[3])
        used = int(self.full[0] - room[0])
        if self.cut and not self.waiting and used < self.limits.tokens:
            yield from self._powers(placed, used)
            return
        yield from self._emit(placed)

    def _powers(self, placed: list, used: int) -> Iterator[tuple]:
        placed = placed[::-1]
        for bit in reversed(range(used.bit_length())):
            room, part = used & (1 << bit), []
            while room:
                piece = placed.pop()
                if piece[2] > room:
                    piece, rest = self.cut(piece, room)
                    placed.append(rest)
                part.append(piece)
                room -= piece[2]
            yield from self._emit(part)

    def _emit(self, placed: list) -> Iterator[tuple]:
        offset = 0
        for piece in placed:
            yield self.sequence, offset, piece
            offset += piece[2]
        self.sequence += bool(placed)


def _cut_ids(piece: tuple, n: int) -> tuple[tuple, tuple]:
    key, start, tokens, _, ids, total = piece
    return (
        (key, start, n, n - 1, ids[: 4 * n], total),
        (key, start + n, tokens - n, tokens - n - 1, ids[4 * n :], total),
    )


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, loss_tokens long"
)


PLACES = "example_id long, tokens long, loss_tokens long, sequence_id long, offset long"


def as_columns(rows: list[tuple], ddl: str) -> Columns:
    names = [c.split()[0] for c in ddl.split(",")]
    return {name: [row[i] for row in rows] for i, name in enumerate(names)}


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, close it with ``end_id`` and pack the pieces: one row per piece.

    A document longer than a sequence is cut into full sequences and a rest.  A piece's
    first id has nothing before it, so it bears no loss.  Every input row is a document of
    its own, repeated rows and NULL ids included; a NULL or empty text is its end id.
    Other columns are ignored.  An empty table gives no piece.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    most = min(limits.tokens, limits.loss_tokens + 1)

    def pack(batches: Iterator[Columns]) -> Iterator[Columns]:
        ids_of, base = word_ids(path), TaskContext.get().partitionId() << 33
        packer, rows = Packer(limits, _cut_ids), []

        def take(found) -> None:
            for sequence, offset, (key, start, n, loss, ids, total) in found:
                rows.append((key, start, n, zlib.crc32(ids), total, base + sequence, offset, loss))

        def out() -> Columns:
            made = as_columns(rows, PIECES)
            rows.clear()
            return made

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"]):
                ids = ids_of.text(text) + end
                total = len(ids) // 4
                for start in range(0, total, most):
                    n = min(most, total - start)
                    part = ids[4 * start : 4 * (start + n)]
                    take(packer.add((key, start, n, n - 1, part, total)))
                if len(rows) > 20_000:
                    yield out()
        take(packer.finish())
        yield out()

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).transform(batchwise(pack, PIECES, keeps=True))


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Place instruction examples (example_id, tokens, loss_tokens) whole: adds sequence_id, offset.

    Rows with a NULL count as having none; an example beyond a limit fails the job, since
    it can be placed nowhere.
    """

    def pack(batches: Iterator[Columns]) -> Iterator[Columns]:
        base, packer = TaskContext.get().partitionId() << 33, Packer(limits)

        def frame(found) -> Columns:
            return as_columns([(p[0], p[2], p[3], base + s, o) for s, o, p in found], PLACES)

        for batch in batches:
            done = []
            for key, tokens, loss in zip(batch["example_id"], batch["tokens"], batch["loss_tokens"]):
                done.extend(packer.add((key, 0, tokens, loss, None, 0)))
            yield frame(done)
        yield frame(packer.finish())

    return examples.select(
        F.col("example_id").cast("long"),
        F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"),
        F.coalesce(F.col("loss_tokens").cast("long"), F.lit(0)).alias("loss_tokens"),
    ).transform(batchwise(pack, PLACES))
