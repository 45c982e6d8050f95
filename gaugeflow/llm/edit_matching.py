"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: a passage within k
edits of it holds one piece unchanged.  One Aho-Corasick pass over a text finds the pieces,
and Myers' bit-parallel search measures the distance around each hit.  Items are handled in
blocks of bounded size, whatever the size of the benchmark; texts are scanned where they
lie and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import materialized, text_or_empty, whole

# Pieces that one scan looks for.
BLOCK_PIECES = 100_000
# Items of fewer normalized characters are looked for as they are, between word edges.
LEAST_CHARS = 24


def normalized(text: str) -> str:
    """Lower case, one blank between words."""
    return " ".join(text.lower().split())


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int

    @staticmethod
    def of(item_id: int, text: str, rate: float) -> Item:
        plain = normalized(text)
        return Item(item_id, plain, int(rate * len(plain)) if len(plain) >= LEAST_CHARS else 0)

    def pieces(self) -> list[tuple[int, str]]:
        """(place in the item, piece), budget + 1 of them with nearly equal lengths."""
        n = self.budget + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def character_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str) -> int:
    """Least edit distance between the pattern and any stretch of the text."""
    every, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = every, 0, size
    best = size
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & every
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = up << 1 & every, down << 1 & every
        plus = down | ~(vertical | up) & every
        minus = up & vertical
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for place, piece in item.pieces():
                places.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in places.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if items:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, distance) of each item that the normalized text holds within its budget."""
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, owners) in self.automaton.iter(text) if self.items and text else ():
            for i, place in owners:
                start = end - size + 1 - place
                if best.get(i) == 0 or (i, start) in tried:
                    continue
                tried.add((i, start))
                distance = self.distance(i, text, start)
                if distance <= self.items[i].budget:
                    best[i] = min(distance, best.get(i, distance))
        return sorted((self.items[i].item_id, d) for i, d in best.items())

    def distance(self, i: int, text: str, start: int) -> int:
        item = self.items[i]
        size, k = len(item.text), item.budget
        if start >= 0 and text.startswith(item.text, start):
            if size >= LEAST_CHARS:
                return 0
            edges = text[max(0, start - 1) : start], text[start + size : start + size + 1]
            return int(any(c.isalnum() for c in edges))
        if not k:
            return 1
        if i not in self.masks:
            self.masks[i] = character_masks(item.text)
        return myers(self.masks[i], size, text[max(0, start - k) : max(0, start + size + k)])


def item_blocks(
    benchmark: DataFrame, rate: float, id_col: str, text_col: str
) -> Iterator[list[Item]]:
    """The benchmark in blocks of at most ``BLOCK_PIECES`` pieces, streamed through the driver."""
    block: list[Item] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("long"), text_or_empty(text_col)).toLocalIterator()
    for item_id, text in rows:
        item = Item.of(item_id, text, rate)
        if item_id is None or not item.text:
            continue
        if block and size + item.budget + 1 > BLOCK_PIECES:
            yield block
            block, size = [], 0
        block.append(item)
        size += item.budget + 1
    if block:
        yield block


def _search(items, kind: str):
    """Column function that looks for one broadcast block; its matcher is built once a task."""
    matchers: list[Matcher] = []

    @F.pandas_udf(kind)
    def search(texts: pd.Series) -> pd.Series:
        if not matchers:
            matchers.append(Matcher(items.value))
        find = matchers[0].find
        return pd.Series(
            [[{"item_id": i, "distance": d} for i, d in find(normalized(t))] for t in whole(texts)],
            dtype=object,
        )

    return search


def _found(
    docs: DataFrame, benchmark: DataFrame, text: Column, rate: float, id_col: str, text_col: str
) -> DataFrame:
    """The rows as ``row``, with ``found``: array<struct<item_id, distance>> of the items a text holds.

    Each block of items is a pass over the texts.  The first one's result is not stored if it is
    the only one; otherwise a pass is written before the next block is broadcast, and the
    block let go.
    """
    context = docs.sparkSession.sparkContext
    kind = "array<struct<item_id:bigint,distance:int>>"
    result = docs.select(
        F.struct("*").alias("row"), text.alias("text"), F.array().cast(kind).alias("found")
    )
    before = None
    for block in item_blocks(benchmark, rate, id_col, text_col):
        if before is not None:
            result = materialized(result)
            before.unpersist()
        before = context.broadcast(block)
        result = result.withColumn("found", F.concat("found", _search(before, kind)("text")))
    return result.select("row", "found")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.06,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Benchmark items in every whole text: doc_id, n_items, distance, items, contaminated.

    A text holds an item where some stretch of it is within ``rate`` edits per character of
    the item, both normalized.  ``distance`` is the least one, NULL where there is none;
    ``items`` are the ids in order.  One row per input row; NULL texts hold nothing.  Items of
    fewer than ``LEAST_CHARS`` characters are found as they are, between word edges.  Items
    that are NULL or blank or have no id are left out; an item that is listed twice counts
    twice.  Other columns are ignored.
    """
    found = _found(
        docs, benchmark, text_or_empty(text_col), rate, item_id_col, item_text_col
    ).select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), "found")
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_items"),
        F.array_min(F.transform("found", lambda x: x["distance"])).alias("distance"),
        F.array_sort(F.transform("found", lambda x: x["item_id"])).alias("items"),
        (F.size("found") > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """Documents that hold no benchmark item, with their own columns and rows as they are.

    NULL and empty texts hold nothing and stay, as do all rows if the benchmark is empty.
    """
    found = _found(docs, benchmark, text_or_empty("text"), rate, "item_id", "text")
    return found.where(F.size("found") == 0).select("row.*")
