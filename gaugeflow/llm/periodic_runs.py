"""Periodic stretches of words, found by minimizers at several scales.

A run is a stretch of words with smallest period q (words q apart are identical), at least
``SHORTEST`` and 2q words long, that no neighbouring word extends keeping that period.

* Periods below ``SCANNED`` are found by comparing the words with themselves shifted by
  each such lag.
* Periods in [2^s, 2^(s+1)) have a scale of their own, with blocks of K = 2^(s-1) words.  Of
  every K blocks in a row the least by hash is a minimizer.  Two windows a period apart in
  a run hold the same blocks, so the run has two equal minimizers at just that distance; such
  pairs are seeds, extended by comparing words to both sides.
* Blocks that have a period of at most K/2 themselves (known from smaller scales) are no
  minimizers.  Equal blocks without one lie more than K/2 apart, so every minimizer has at
  most seven partners within its scale and the work of a scale grows with the words only.
* A run whose whole first period consists of such blocks is a place where two runs of a smaller
  period r meet in different phase; its periods follow from the phases by arithmetic.

Blocks are compared by 64-bit hashes to find seeds; what a seed gives is compared by words.
A task takes the texts of a slice of a batch as one sequence, parted by marks that equal
nothing.  Memory is about 200 bytes a word of the slice; a long text is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, slices, whole

# The least number of words of a run.
SHORTEST = 12
# Periods below this are found by comparing at each lag; a power of two.
SCANNED = 16
# Characters of texts that a task works on at a time.
SLICE = 1 << 21
# Equal blocks of K words without a period of K/2 are more than K/2 apart, and partners less than 4K.
PARTNERS = 7

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def _doubled(blocks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of twice the size."""
    return _mixed(blocks[:-size] * _ODD[0] + blocks[size:] * _ODD[1])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``width`` values in a row; ``width`` is a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _matched_after(words: np.ndarray, i: int, lag: int) -> int:
    """The first place from ``i`` on that differs from the word ``lag`` later."""
    last, step = len(words) - lag, 16
    while i < last:
        stop = min(i + step, last)
        unequal = words[i:stop] != words[i + lag : stop + lag]
        if unequal.any():
            return i + int(unequal.argmax())
        i, step = stop, min(step * 4, 1 << 16)
    return last


def _matched_before(words: np.ndarray, i: int, lag: int) -> int:
    """The first place of the stretch before ``i`` whose words all equal those ``lag`` later."""
    step = 16
    while i > 0:
        start = max(i - step, 0)
        unequal = words[start:i] != words[start + lag : i + lag]
        if unequal.any():
            return i - int(unequal[::-1].argmax())
        i, step = start, min(step * 4, 1 << 16)
    return 0


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def _is_smallest(words: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether a stretch of at least two periods has no smaller period (one would divide it)."""
    return all(
        _matched_after(words[:stop], start, period // p) < stop - period // p
        for p in _prime_factors(period)
    )


def _scanned(words: np.ndarray) -> list[Run]:
    """Runs of the periods below SCANNED, of half a block of the first scale and more."""
    runs = []
    for period in range(1, min(SCANNED, len(words))):
        same = np.flatnonzero(words[:-period] == words[period:])
        if not len(same):
            continue
        ends = np.flatnonzero(np.diff(same) != 1)
        starts = same[np.concatenate(([0], ends + 1))]
        stops = same[np.concatenate((ends, [len(same) - 1]))] + 1 + period
        wide = stops - starts >= max(SCANNED // 2, 2 * period)
        for start, stop in zip(starts[wide].tolist(), stops[wide].tolist()):
            if _is_smallest(words, start, stop, period):
                runs.append((start, stop, period))
    return runs


def _seeds(blocks: np.ndarray, size: int, runs: np.ndarray) -> Iterator[tuple[int, int]]:
    """(lag, place) of equal minimizers 2 to 4 sizes apart, in that order."""
    inside = runs[(runs[:, 2] <= size // 2) & (runs[:, 1] - runs[:, 0] >= size)]
    change = np.zeros(len(blocks) + 1, np.int32)
    np.add.at(change, inside[:, 0], 1)
    np.add.at(change, np.minimum(inside[:, 1] - size + 1, len(blocks)), -1)
    periodic = np.cumsum(change[:-1]) > 0
    values = np.where(periodic, _MOST, blocks)
    if len(values) < size:
        return
    least = _sliding(values, size, np.minimum)
    edge = np.zeros(size - 1, np.uint64)
    # A block is a minimizer if it is the least of some window it is in; the least never exceeds it.
    best = _sliding(np.concatenate((edge, least, edge)), size, np.maximum)
    places = np.flatnonzero((best == values) & ~periodic)
    order = np.argsort(values[places], kind="stable")
    places = places[order]
    chosen = values[places]
    found = []
    for ahead in range(1, min(PARTNERS, len(places) - 1) + 1):
        equal = chosen[:-ahead] == chosen[ahead:]
        if not equal.any():
            break
        lag = places[ahead:] - places[:-ahead]
        near = np.flatnonzero(equal & (lag >= 2 * size) & (lag < 4 * size))
        found.append(np.stack((lag[near], places[near])))
    if found:
        pairs = np.concatenate(found, axis=1)
        yield from pairs[:, np.lexsort((pairs[1], pairs[0]))].T.tolist()


def _extended(words: np.ndarray, seeds: Iterator[tuple[int, int]]) -> list[Run]:
    runs: list[Run] = []
    lag_before = reached = -1
    for lag, place in seeds:
        if lag == lag_before and place < reached:
            continue
        start = _matched_before(words, place, lag)
        reached, lag_before = _matched_after(words, place, lag), lag
        stop = reached + lag
        if stop - start >= 2 * lag and _is_smallest(words, start, stop, lag):
            runs.append((start, stop, lag))
    return runs


def _phase(words: np.ndarray, one: int, other: int, period: int) -> int | None:
    """The turn of the period at ``one`` that gives that at ``other``."""
    twice = np.concatenate((words[one : one + period], words[one : one + period])).tobytes()
    wanted = words[other : other + period].tobytes()
    at = twice.find(wanted)
    while at >= 0 and at % words.itemsize:
        at = twice.find(wanted, at + 1)
    return None if at < 0 else at // words.itemsize


def _meeting(words: np.ndarray, runs: list[Run]) -> list[Run]:
    """Runs of four and more times the period around places where two runs of one period meet."""
    found = []
    ordered = sorted(runs, key=lambda run: (run[2], run[0]))
    for (a, a_stop, period), (b, b_stop, other) in zip(ordered, ordered[1:]):
        if other != period or b > a_stop:
            continue
        most = min(a_stop - a, b_stop - b, (b_stop - a) // 2)
        least = max(SCANNED, 4 * period)
        if most < least:
            continue
        turn = _phase(words, a, b, period)
        if turn is None:
            continue
        first = least + (b - a - turn - least) % period
        for lag in range(first, most + 1, period):
            start, stop = max(a, b - lag), min(a_stop, b_stop - lag)
            if a == b - lag:
                start = _matched_before(words, start, lag)
            if a_stop == b_stop - lag:
                stop = _matched_after(words, stop, lag)
            found.append((start, stop + lag, lag))
    return found


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """Runs (start, length, period) of each text, ordered by start, then period.

    A text is an array of non-negative integers, equal where words are.
    """
    if not texts:
        return []
    sizes = np.array([len(t) + 1 for t in texts])
    words = np.empty(int(sizes.sum()), np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for k, (text, start) in enumerate(zip(texts, starts.tolist())):
        words[start : start + len(text)] = text
        words[start + len(text)] = -1 - k
    short = _scanned(words)
    runs = {*short, *_meeting(words, short)}
    # What a scale works on: the texts long enough for it, their places and block hashes.
    kept, size, period = np.arange(len(words)), 1, SCANNED
    blocks = _mixed(words.view(np.uint64) * _ODD[0] + _ODD[1])
    while 2 * period < sizes.max():
        long = np.repeat(sizes > 2 * period, sizes)[kept]
        if not long.all():
            blocks, kept = blocks[long[: len(blocks)]], kept[long]
        while 2 * size < period:
            blocks = _doubled(blocks, size)
            size *= 2
        here = words[kept]
        known = np.array(sorted(runs), np.int64).reshape(-1, 3)
        at = np.searchsorted(kept, known[:, 0])
        present = at < len(kept)
        present[present] = kept[at[present]] == known[present, 0]
        moved = known[present] - (known[present, 0] - at[present])[:, None] * [1, 1, 0]
        grown = [
            (int(kept[start]), int(kept[start]) + stop - start, lag)
            for start, stop, lag in _extended(here, _seeds(blocks, size, moved))
        ]
        runs.update(grown)
        runs.update(_meeting(words, [r for r in runs if period <= r[2] < 2 * period]))
        period *= 2
    found: list[list[Run]] = [[] for _ in texts]
    for start, stop, lag in sorted(runs, key=lambda run: (run[0], run[2])):
        if stop - start >= max(SHORTEST, 2 * lag):
            k = int(np.searchsorted(starts, start, "right")) - 1
            found[k].append((start - int(starts[k]), stop - start, lag))
    return found


def _kept(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def runs_in_batches(rewrite: Rewrite | None) -> Callable[[Iterator[Columns]], Iterator[Columns]]:
    def work(batches: Iterator[Columns]) -> Iterator[Columns]:
        for columns in batches:
            ids, texts = columns["doc_id"], whole(columns["text"])
            for start, stop in slices(texts, SLICE):
                numbers: dict[bytes, int] = {}
                split, coded = [], []
                for doc_id, text in zip(ids[start:stop], texts[start:stop]):
                    # White space of bytes is just space and the five controls from tab on.
                    words = text.encode().split()
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    split.append(words)
                    coded.append(
                        np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                    )
                runs = find_runs(coded)
                yield {
                    "doc_id": ids[start:stop],
                    "runs": [
                        [{"start": s, "length": n, "period": q} for s, n, q in found]
                        for found in runs
                    ],
                    "collapsed": [
                        b" ".join(_kept(w, found)).decode() for w, found in zip(split, runs)
                    ],
                }

    return work


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Columns doc_id, runs (by start, then period) and collapsed, one row per document.

    Words are what lies between spaces, tabs and line ends; runs are told in word numbers
    from 0.  ``collapsed`` is the text, words joined by one space, without what runs contain
    after their first period.  ``rewrite`` may change a document's words first.  A NULL or empty
    text has no runs and an empty collapsed text.  Rows with the same id, or none, stay rows of
    their own; other columns are ignored.
    """
    ddl = (
        "doc_id long, runs array<struct<start: long, length: long, period: long>>, "
        "collapsed string"
    )
    return docs.select("doc_id", "text").transform(batchwise(runs_in_batches(rewrite), ddl))


def periods_by_id(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Repeats a stretch of the words to the end in every tenth document, told by its id.

    A missing id counts as empty text.
    """
    chosen = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, rest = len(words), chosen // 10
    if chosen % 10 or not n:
        return words
    first = rest % n
    period = 1 + (n - first) // (3 + rest % 8)
    return words[:first] + [words[first + i % period] for i in range(n - first)]


def run_digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: the first, then the shorter period) and digests of all runs and texts."""
    longest = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"),
                (-r["start"]).alias("before"),
                (-r["period"]).alias("brief"),
            ),
        )
    )
    lines = F.transform(
        "runs",
        lambda r: F.concat(
            F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]),
            F.lit("\n"),
        ),
    )
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.before")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.brief")).alias("period"),
        F.expr("longest.length * 1000 div -longest.brief").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
