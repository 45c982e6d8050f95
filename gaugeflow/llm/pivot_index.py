"""Near-duplicate vectors through a pivot-permutation index.

Reference points are drawn from the vectors, no two of them close together, so that a large
group of near copies holds few.  Each vector is described by the ordered list of those
nearest to it, and goes into the inverted list of each.  Vectors that meet in a
list and share enough pivots are compared exactly.  A list is compared in blocks of
bounded size, each a task of its own; a block gives counts and a spanning forest of its
links, never the pairs.  Exact copies are one vector with a weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, in_blocks, materialized
from gaugeflow.llm.components import components


@dataclass(frozen=True)
class Index:
    """Parameters of the index."""

    # Pivots grow with the square root of the vectors, between these bounds.
    least_pivots: int = 64
    most_pivots: int = 2048
    # Candidates for each pivot, and the cosine that two pivots stay below.
    drawn: int = 2
    apart: float = 0.8
    # Pivots that describe a vector, and how many a candidate pair shares.
    described_by: int = 8
    shared: int = 2
    # Vectors of one side of a block.
    block: int = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; scaled first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _usable(vector: Column) -> Column:
    return (
        (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def spread(vectors: np.ndarray, apart: float, most: int) -> np.ndarray:
    """The first unit vectors, at most ``most``, whose cosine to every one before is below ``apart``."""
    kept, many = np.empty((min(most, len(vectors)), vectors.shape[1])), 0
    for vector in vectors:
        if many == len(kept):
            break
        if (kept[:many] @ vector).max(initial=-1) < apart:
            kept[many] = vector
            many += 1
    return kept[:many]


def choose_pivots(vectors: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: a bounded sample of distinct vectors in the order of their hashes, spread out."""
    wanted = min(index.most_pivots, max(index.least_pivots, 2 * math.isqrt(vectors.count())))
    rows = (
        vectors.select("embedding", "h1", "h2")
        .orderBy("h1", "h2")
        .limit(index.drawn * wanted)
        .collect()
    )
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    return {
        size: spread(unit(np.array(found, float)), index.apart, -(-wanted * len(found) // len(rows)))
        for size, found in by_size.items()
    }


def describe(vectors: np.ndarray, pivots: np.ndarray, many: int) -> np.ndarray:
    """Ordered nearest pivots of each unit vector."""
    near = vectors @ pivots.T
    many = min(many, len(pivots))
    return np.argsort(-near, axis=1, kind="stable")[:, :many]


def _postings(reps: DataFrame, index: Index) -> DataFrame:
    pivots = reps.sparkSession.sparkContext.broadcast(choose_pivots(reps, index))

    def described(batches):
        for batch in batches:
            lists = []
            for vector in batch["embedding"]:
                known = pivots.value.get(len(vector))
                if known is None:
                    # No pivot has this dimension: its vectors share one list, in which all are compared.
                    lists.append([-1] * index.shared)
                else:
                    found = describe(unit(np.array([vector], float)), known, index.described_by)[0]
                    lists.append(found.tolist())
            yield {**batch, "pivots": lists}

    kinds = "rep long, label int, size int, copies long, embedding array<double>, pivots array<int>"
    return reps.select(
        "rep", "label", "size", "copies", F.col("embedding").cast("array<double>").alias("embedding")
    ).transform(batchwise(described, kinds))


def least_labels(linked: np.ndarray) -> np.ndarray:
    """Connected components of a small symmetric matrix: the least index reachable from each."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        now = np.minimum(label, near)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _compare(pivot: int, left: bool, rows: Columns, threshold: float, shared: int) -> np.ndarray:
    """Which rows of a block are linked; pairs of one side only where the block is on the diagonal."""
    vectors = unit(rows["embedding"])
    kinds, places = np.unique(rows["pivots"], return_inverse=True)
    member = np.zeros((len(vectors), len(kinds)), np.float32)
    np.put_along_axis(member, places.reshape(rows["pivots"].shape), 1, axis=1)
    earlier = member[:, kinds < pivot]
    linked = vectors @ vectors.T >= threshold
    if pivot >= 0:
        # Pairs that share several lists are compared in the first of them; few pivots may be all there are.
        shared = min(shared, rows["pivots"].shape[1])
        linked &= (member @ member.T >= shared) & (earlier @ earlier.T == 0)
    if not left:
        side = rows["side"]
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return linked


def linked_pairs(reps: DataFrame, threshold: float, index: Index) -> DataFrame:
    """Per block and vector: weight of its links in the block, and a vector of its component there."""
    posted = materialized(
        _postings(reps, index).withColumn("pivot", F.explode(F.array_distinct("pivots")))
    )
    key = ["label", "size", "pivot"]
    met = in_blocks(posted, key, "rep", index.block).select(
        *key, "rep", "copies", "embedding", "pivots", "side", "low", "high"
    )
    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(block: pa.Table) -> pa.Table:
        many = block.num_rows
        rep, copies = block["rep"].to_numpy(), block["copies"].to_numpy()
        rows = {
            "embedding": block["embedding"].combine_chunks().flatten().to_numpy().reshape(many, -1),
            "pivots": block["pivots"].combine_chunks().flatten().to_numpy().reshape(many, -1),
            "side": block["side"].to_numpy(),
        }
        diagonal = block["low"][0].as_py() == block["high"][0].as_py()
        linked = _compare(block["pivot"][0].as_py(), diagonal, rows, threshold, index.shared)
        some = linked.any(axis=1)
        links = (linked[some] * copies).sum(axis=1)
        roots = rep[least_labels(linked)[some]]
        return pa.table([rep[some], links, roots], schema=out)

    return met.groupBy(*key, "low", "high").applyInArrow(compare, "rep long, links long, root long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, index: Index = Index()) -> DataFrame:
    """Links between vectors of equal label: vec_id, n_links, component_id, kept.

    One row per input row of (vec_id, embedding, label).  Vectors that are NULL, empty or
    zero, hold NULL, NaN or infinity, or have no label link with nothing, and so do vectors
    of different dimension.  Exact copies always link; other links are those that the index
    finds, each verified in double precision.  component_id is the smallest vec_id
    reachable; kept says that it is the row's own.  Rows that repeat a vec_id count as
    vectors of their own.  Other columns are ignored.
    """
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        "embedding",
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit("second"), "embedding").alias("h2"),
    )
    key = ["label", "h1", "h2"]
    reps = materialized(
        rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .where(_usable(F.col("embedding")))
        .groupBy(*key, "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .select(
            F.monotonically_increasing_id().alias("rep"), *key, "embedding",
            F.size("embedding").alias("size"), "copies", "first_id",
        )
    )
    found = materialized(linked_pairs(reps, threshold, index))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    members = groups.withColumnRenamed("node", "rep").join(reps.select("rep", "first_id"), "rep")
    least = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = members.join(least, "component").select("rep", "component_id")
    known = (
        reps.join(links, "rep", "left")
        .join(named, "rep", "left")
        .select(
            *key,
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "first_id").alias("component_id"),
        )
    )
    return (
        rows.drop("embedding")
        .join(known, key, "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
