"""Token counts by a two-tier lookup on the map side.

A text falls into pieces that the tokenizer never merges across: a run of non-space
characters with the one blank before it.  Their token counts come from a broadcast table
of frequent pieces, and for all others from a cache that each Python worker fills by
asking the tokenizer.  The frequent ones are counted over all texts first, combined in each
task; the counts of texts are one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, held, materialized, text_or_empty

# Frequent pieces that are broadcast, and different ones that a task counts before it hands them on.
FREQUENT, COUNTED = 16_384, 200_000
# Bounds of a worker's cache.
CACHED, CACHED_CHARS = 300_000, 48

# Fixed values of byte-level pre-tokenization: how white space and other runs are told apart.
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# White space to Python, other characters to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Lengths(dict):
    """Piece -> token count, with ``prefix`` before the piece; a miss is encoded and kept."""

    def __init__(self, tokenizer, prefix: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.prefix, self.frequent = tokenizer, prefix, frequent

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class Counts:
    """Counts the tokens of whole texts exactly as a byte-level tokenizer file gives them."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = Lengths(self.tokenizer, " ", frequent or {})
        self.bare = Lengths(self.tokenizer, "", {})

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or _SEPARATORS.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words, breaks = text.split(), text.count("\n")
        gaps = text.count(" ") + breaks
        spaced, bare = self.spaced, self.bare
        if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(text):
            return sum(
                spaced[run[1:]] if run[0] == " " and not run.isspace() else bare[run]
                for run in _RUNS.findall(text)
            )
        # Every gap is one blank or one line break.
        n = sum(map(spaced.__getitem__, words))
        for line in text.split("\n"):
            first = line[: line.find(" ")] if " " in line else line
            n += bare[first] - spaced[first]
        return n + breaks * bare["\n"]


def counter(path: str, frequent: dict[str, int] | None = None) -> Counts:
    """The counter of this process; a reused Python worker keeps its cache between tasks."""
    return held(("counts", path), lambda: Counts(path, frequent))


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pieces of all whole texts; ties go by the piece."""

    def count(batches: Iterator[Columns]) -> Iterator[Columns]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(text.split())
                if len(seen) > COUNTED:
                    yield {"piece": list(seen), "n": list(seen.values())}
                    seen.clear()
        yield {"piece": list(seen), "n": list(seen.values())}

    most = (
        docs.select(text_or_empty(text_col).alias("text"))
        .transform(batchwise(count, "piece string, n long"))
        .where(F.length("piece") <= CACHED_CHARS)
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(FREQUENT)
    )
    # Stored first, so that partitions' own most frequent pieces meet in a task, not in the driver.
    most = materialized(most).collect()
    lengths = Lengths(Counts(path).tokenizer, " ", {})
    return {row.piece: lengths[row.piece] for row in most}


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    One row per input row, repeated rows and NULL ids included; a NULL text counts as
    empty and has no token.  Other columns are ignored, whatever their names.  An empty
    table gives an empty result.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col))

    def count(batches: Iterator[Columns]) -> Iterator[Columns]:
        tokens = counter(path, frequent.value)
        for batch in batches:
            yield {
                "doc_id": batch["doc_id"],
                "n_bytes": batch["n_bytes"],
                "n_tokens": [tokens(t) for t in batch["text"]],
            }

    text = text_or_empty(text_col)
    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            text.alias("text"),
        )
        .transform(batchwise(count, "doc_id long, n_bytes long, n_tokens long", keeps=True))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
