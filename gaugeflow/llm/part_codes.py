"""Compression of vectors to one code a part, with equal-average search for the nearest entry.

Components become whole numbers, a vector is cut into equal parts, and each part position has a
codebook.  A codebook is refined in rounds: every part goes to its nearest entry, then every
entry becomes the floor of its parts' mean.

Equal-average search: the entries of a codebook are sorted by the sum of their components.
Squared distance is at least the squared gap of the sums over the dimension, so the search
starts at the part's own sum, goes outward on both sides, and ends on a side once that bound
strictly exceeds the best distance.  An equal bound goes on, as a tie belongs to the lower index.

All arithmetic is on 64-bit integers, so results do not depend on how rows are spread.  The
codebooks (parts x entries x part size) are all that is held outside of tasks; a round reads
the vectors once, and each task sends one sum for each component of a codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import let_go, materialized

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

# codebooks[part][entry][component]
Codebooks = np.ndarray


def _usable(size: int | None, parts: int, scale: int) -> Column:
    """Rows that take part: as many components as the others, each finite and not too great.

    The bound keeps squared sums of a part below 2^62; for parts of 8 it is 32768.
    """
    length = F.size("embedding")
    if size is None:
        return F.col("embedding").isNotNull() & (length > 0) & (length % parts == 0) & F.forall(
            "embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)
        )
    most = float((1 << 30) // (size // parts) // scale)
    return (length == size) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(most))
    )


def _whole_numbers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, size)


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties: the lowest) and its squared distance."""
    n, size = parts.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ordered, sums = book[order], sums[order]
    own = parts.sum(axis=1)
    middle = np.searchsorted(sums, own)
    best = np.full(n, (1 << 62) // size, np.int64)
    index = np.full(n, len(book), np.int64)
    # Rows whose search still goes on, upward and downward.
    going = [np.arange(n), np.arange(n)]
    for step in range(len(book)):
        for side, place in ((0, middle + step), (1, middle - 1 - step)):
            rows = going[side]
            at = place[rows]
            inside = (at >= 0) & (at < len(book))
            rows, at = rows[inside], at[inside]
            gap = own[rows] - sums[at]
            near = gap * gap <= best[rows] * size
            rows, at = rows[near], at[near]
            going[side] = rows
            if not len(rows):
                continue
            apart = parts[rows] - ordered[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            entry = order[at]
            closer = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
            rows = rows[closer]
            best[rows], index[rows] = distance[closer], entry[closer]
        if not len(going[0]) and not len(going[1]):
            break
    return index, best


def _sums(vectors: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """Sums of the parts that go to each entry: part, entry, place, total, n."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        totals = np.zeros(books.shape, np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            numbers = _whole_numbers(batch.column("embedding"), parts * width, scale)
            for p in range(parts):
                mine = numbers[:, p * width : (p + 1) * width]
                index, _ = nearest_entries(mine, books[p])
                np.add.at(totals[p], index, mine)
                counts[p] += np.bincount(index, minlength=entries)
        part, entry, place = np.nonzero(np.broadcast_to((counts > 0)[:, :, None], books.shape))
        yield pa.RecordBatch.from_pydict(
            {
                "part": part.astype(np.int32),
                "entry": entry.astype(np.int32),
                "place": place.astype(np.int32),
                "total": totals[part, entry, place],
                "n": counts[part, entry],
            }
        )

    ddl = "part int, entry int, place int, total long, n long"
    return (
        vectors.select("embedding")
        .mapInArrow(work, ddl)
        .groupBy("part", "entry", "place")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )


def train_codebooks(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """The rows that take part, and the codebooks (None without rows).

    Entries start as the parts of the vectors with the smallest ids (a missing id comes last,
    rows of one id by their components).  Fewer rows give fewer entries.
    """
    columns = vectors.select("vec_id", "embedding", "label")
    fit = columns.where(_usable(None, parts, scale))
    first = F.col("vec_id").asc_nulls_last(), F.col("embedding")
    head = fit.orderBy(*first).limit(1).collect()
    if not head:
        return fit, None
    size = len(head[0].embedding)
    kept = columns.where(_usable(size, parts, scale))
    starts = [row.embedding for row in kept.orderBy(*first).limit(entries).collect()]
    if not starts:
        return kept, None
    numbers = np.floor(np.array(starts, np.float64) * scale).astype(np.int64)
    books = numbers.reshape(len(starts), parts, size // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        # At most one row for each component of the codebooks.
        for part, entry, place, total, n in _sums(kept, books, scale).collect():
            books[part, entry, place] = total // n
    return kept, books


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Columns vec_id, label, code (two hex digits a part) and error (squared, over all parts)."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            numbers = _whole_numbers(batch.column("embedding"), parts * width, scale)
            index = np.empty((len(numbers), parts), np.uint8)
            error = np.zeros(len(numbers), np.int64)
            for p in range(parts):
                index[:, p], best = nearest_entries(
                    numbers[:, p * width : (p + 1) * width], books[p]
                )
                error += best
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([row.tobytes().hex() for row in index], pa.string()),
                    pa.array(error),
                ],
                ["vec_id", "label", "code", "error"],
            )

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    )


def compressed_vectors(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Columns vec_id, code, error, label_error and codebooks_sha256, one row a vector.

    ``label_error`` adds up the errors of equal labels, missing ones together.  Rows are left
    out whose vector is NULL, empty, or holds NULL, infinite or NaN components, components of
    2^30 / part size / scale and more (32768 for parts of 8), or another number of components
    than the vector with the smallest id that has a multiple of ``parts``.  Rows of one id
    stay rows of their own; other columns are ignored.  ``entries`` is at most 256.
    """
    kept, books = train_codebooks(vectors, parts, entries, rounds, scale)
    if books is None:
        return kept.select(
            "vec_id",
            F.lit("").alias("code"),
            F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"),
            F.lit("").alias("codebooks_sha256"),
        ).where(F.lit(False))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # Codes are a sixth of the vectors or less; both readers below use the stored ones.
    codes = materialized(encode(kept, books, scale))
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
