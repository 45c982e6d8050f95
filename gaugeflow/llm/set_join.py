"""Near-duplicate texts: exact Jaccard self-join of word shingle sets.

Universe partitioning with pigeonholes.  Sets are put into bands of similar size; a band
cuts the universe of hashed shingles into segments, so many that two sets within the
Jaccard bound must agree on a whole segment or, where a segment is allotted one deletion,
differ there in one shingle.  Segments and one-deletion neighbourhoods are hashed to keys;
how many segments of either sort a band has is chosen by a cost model.  Of whole segments a
set indexes no more than it needs, those of most shingles.  The few sets whose shingles
crowd into too few segments also index a prefix of their hashes, which finds the pairs
among them.  Sets that meet under a key are candidates, and all links between sets
of different components are verified on the whole sets.

Copies of a text are one node from the start.  Candidates are first verified along the
most frequent meetings; after that only pairs between different components are left, so
a large group of near copies costs links in proportion to its size.  Lists with the same
smallest member, which mostly hold the same sets, are compared as one.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import (
    BROADCAST_ROWS, batchwise, compacted, materialized, paired_blocks, slices, text_or_empty,
)
from gaugeflow.llm.components import components, joined

# Words of a shingle, and the bound as a fraction: linked where 100 * both >= 75 * either.
SHINGLE, PER_CENT = 5, 75
# Bits of the smallest parity bitmap.
LEAST_BITS = 512
# Keys that one reducing task handles, and documents that a mapping task gathers at a time.
BUCKET_KEYS, GATHERED_KEYS = 2_200_000, 1_000_000
# Sizes travel as logarithms in a byte; all above the greatest count as equal.
SCALE, MOST_SCALE = 12, 127
# Sets of one side where a list's members are compared, and sets of the corpus for each such task.
BLOCK, COMPARED = 1024, 4096
# Lists with one smallest member are one list, unless it has more than so many times their pairs.
MERGED = 4
# Pairs of two components that a task gives to be verified at first.
FIRST_PAIRS = 64

# -- hashing ------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b)))) for b in (_BASE, _INVERSE))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array: a polynomial of its bytes, by running sums."""
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(20, len(data).bit_length()))
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    return start, mixed((total[end] - total[start]) * down[start])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: five words, or all words of a shorter one.

    A-Z count as a-z; blanks, tabs and line breaks of ASCII part words.
    """
    out = []
    for first, last in slices(texts):
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts[first:last]]
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        start, word = word_hashes(data)
        at = np.searchsorted(start, begin)
        many = max(0, len(word) - SHINGLE + 1)
        gram = np.zeros(many, np.uint64)
        for k in range(SHINGLE if many else 0):
            gram += word[k : k + many] * _PLACE[k]
        gram = mixed(gram)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(gram[a : b - SHINGLE + 1]))
            elif b > a:
                whole = (word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
                out.append(mixed(np.array([whole + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray, seed: int) -> int:
    return int(mixed(shingles + np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64))


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of the parity of hashed shingles: sets that differ in d shingles differ in at most d bits.

    It has one and a half to three bits a shingle, a power of two, and folds to any smaller one.
    With fewer, pairs that are similar but not linked would pass; more would cost room.
    """
    size = max(LEAST_BITS, 1 << (3 * len(shingles) // 2).bit_length())
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """Bitmaps (one a row) as they are for ``longs`` 64-bit integers."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, longs), axis=1)


def bits_apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many bits bitmaps differ, row by row, at the size of the smaller ones."""
    longs = min(one.shape[1], other.shape[1])
    both = folded(one, longs) ^ folded(other, longs)
    return np.bitwise_count(both.view(np.uint64)).sum(axis=1, dtype=np.int64)


class Bitmaps:
    """Bitmaps of several sizes, one after the other in one array."""

    def __init__(self, column: pa.Array):
        self.flat = column.flatten().to_numpy()
        size = np.diff(column.offsets.to_numpy())
        self.start, self.size = np.concatenate(([0], np.cumsum(size)[:-1])), size

    def apart(self, i: np.ndarray, j: np.ndarray, other: Bitmaps | None = None) -> np.ndarray:
        other = other or self
        out = np.zeros(len(i), np.int64)
        kinds = self.size[i].astype(np.int64) << 32 | other.size[j]
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            rows = [
                side.flat[side.start[k[at]][:, None] + np.arange(side.size[k[at[0]]])]
                for side, k in ((self, i), (other, j))
            ]
            out[at] = bits_apart(*rows)
        return out


def most_apart(one, other):
    """Most shingles in which linked sets of these sizes differ."""
    return (100 - PER_CENT) * (one + other) // (100 + PER_CENT)


# -- segments -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Band:
    """Sizes low to high, cut into ``segments``, of which the first ``deleting`` index one-deletions."""

    number: int
    low: int
    high: int
    segments: int
    deleting: int


def _allot(high: int) -> tuple[int, int]:
    """Numbers of segments and of one-deletion segments at the least expected cost.

    A segment of m holds x = size / m shingles on average, so its chance to be empty or
    single is Poisson.  Empty segments cover no difference, others one, and those with a
    deletion two.  What covers more than is needed is not indexed, single shingles first.
    The cost counts keys, and candidates by keys of few shingles.
    """
    need = most_apart(high, high) + 1
    # For the smallest sets no number is sure enough; they rely on the prefix of crowded sets.
    best = (math.inf, need, need)
    for share in (0.0, 0.1, 0.25, 0.5, 1.0):
        m = math.ceil(need / (1 + share))
        while True:
            x = high / m
            filled, several = 1 - math.exp(-x), 1 - math.exp(-x) * (1 + x)
            deleting = round(share * m)
            covered = m * filled + deleting * several
            spread = math.sqrt(m * filled * (1 - filled) + deleting * several * (1 - several))
            if covered >= need + 1.5 * spread or m > 2 * high:
                break
            m += max(1, m // 50)
        if m > 2 * high:
            continue
        spare = covered - need
        single = max(0, (m - deleting) * x * math.exp(-x) - spare) + deleting * x * x * math.exp(-x)
        cost = m * filled + deleting * x - spare + 8 * single
        if cost < best[0]:
            best = (cost, m, deleting)
    return best[1:]


@lru_cache(maxsize=None)
def _edges(most: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return tuple(edges)


@lru_cache(maxsize=None)
def band(number: int) -> Band:
    size = 1
    for _ in range(number + 1):
        low, size = size, max(size + 1, size * 3 // 2)
    return Band(number, low, size - 1, *_allot(size - 1))


def bands_of(size: int) -> list[Band]:
    """A set's own band, and the next ones while they hold sets it may link to."""
    own = bisect_right(_edges(1 << max(4, size.bit_length())), size) - 1
    found = [band(own)]
    while band(found[-1].number + 1).low * PER_CENT <= 100 * size:
        found.append(band(found[-1].number + 1))
    return found


def keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a set in all its bands.  Linked sets have one in common.

    Where a set has ``spare`` segments more than differences can touch, linked sets that agree
    in no segment with a deletion agree in more than ``spare`` others.  So each set may leave
    out its last ``spare`` ones in an order by content: the first in which both agree stays.
    """
    out = []
    size = len(shingles)
    value = mixed(shingles ^ _PLACE[0])
    total = np.concatenate(([np.uint64(0)], np.cumsum(value)))
    for b in bands_of(size):
        # Hashes are sorted, so a segment of their range is a stretch of the set.
        place = ((shingles >> np.uint64(32)) * np.uint64(b.segments) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(place, np.arange(b.segments + 1))
        count = np.diff(cut)
        salt = mixed(np.arange(b.segments, dtype=np.uint64) + np.uint64(b.number << 32))
        content = total[cut[1:]] - total[cut[:-1]]
        whole = mixed(content + salt)
        deleting = np.flatnonzero((place < b.deleting) & (count[place] > 1))
        out.append(mixed(content[place[deleting]] - value[deleting] + salt[place[deleting]]))
        covered = np.count_nonzero(count) + np.count_nonzero(count[: b.deleting] > 1)
        spare = covered - most_apart(size, min(b.high, 100 * size // PER_CENT)) - 1
        rest = b.deleting + np.flatnonzero(count[b.deleting :])
        if spare > 0:
            # Keys of few shingles go first, since they meet by chance.
            rest = rest[np.lexsort((whole[rest], -count[rest]))][: max(0, len(rest) - spare)]
        out.append(whole[: b.deleting][count[: b.deleting] > 0])
        out.append(whole[rest])
        if spare < 0:
            # Too crowded.  Its partner has enough segments, or indexes a prefix like this one.
            prefix = size - -(-PER_CENT * size // 100) + 1
            out.append(mixed(shingles[:prefix] + np.uint64((b.number << 32) + 0xFFFFFFFF)))
    return np.unique(np.concatenate(out))


# -- stages -------------------------------------------------------------------------------

_SETS = "doc_id long, n int, node long, check long, bits array<long>"
_KEYS = "bucket int, nodes array<long>, scales array<tinyint>, keys array<int>"


def document_sets(docs: DataFrame, seed: int) -> DataFrame:
    """Per document the size of its set, two fingerprints and the bitmap."""

    def measure(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"])
            yield {
                "doc_id": batch["doc_id"],
                "n": [len(s) for s in sets],
                "node": [fingerprint(s, seed) for s in sets],
                "check": [fingerprint(s, seed + 0x51ED27) for s in sets],
                "bits": [parity(s) for s in sets],
            }

    return docs.transform(batchwise(measure, _SETS))


def posted_keys(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Keys of all sets by bucket, as arrays.

    The bucket comes from the upper bits of a key and 32 of the others travel: keys of a bucket
    that agree in them by chance make a few candidates more.  A key takes 13 bytes whatever
    the number of buckets.
    """

    def post(batches):
        seen: set[int] = set()
        nodes, scales, found, gathered = [], [], [], 0

        def flushed():
            every = np.concatenate(found)
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            bucket = ((every >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, owner, bucket = every[order], owner[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            node, scale = np.array(nodes, np.int64)[owner], np.array(scales, np.int8)[owner]
            short = every.astype(np.uint32).view(np.int32)
            filled = [i for i in range(buckets) if cut[i + 1] > cut[i]]
            parts = [slice(cut[i], cut[i + 1]) for i in filled]
            return {
                "bucket": filled,
                "nodes": [node[p] for p in parts],
                "scales": [scale[p] for p in parts],
                "keys": [short[p] for p in parts],
            }

        for batch in batches:
            for first, last in slices(batch["text"]):
                for shingles in shingle_sets(batch["text"][first:last]):
                    node = fingerprint(shingles, seed)
                    if not len(shingles) or node in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    scales.append(min(round(SCALE * math.log(len(shingles))), MOST_SCALE))
                    found.append(keys(shingles))
                    gathered += len(found[-1])
                if gathered > GATHERED_KEYS:
                    yield flushed()
                    nodes, scales, found, gathered = [], [], [], 0
        if found:
            yield flushed()

    return docs.select("text").transform(batchwise(post, _KEYS))


_MET = "a long, b long, times long, two boolean, least long, list long, members array<long>"


def gathered(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Lists that share their smallest member as one, unless that makes many more pairs."""
    every = np.unique(np.concatenate(lists))
    return [every] if len(every) ** 2 <= MERGED * sum(len(x) ** 2 for x in lists) else lists


def meetings(posted: DataFrame) -> DataFrame:
    """What meets under the keys of a bucket: neighbours by size with how often, and longer lists as they are.

    Neighbours link a list of two.  Lists of three and more are kept too, once if equal, and
    gathered by their smallest member.
    """
    schema = pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64()), ("two", pa.bool_()),
         ("least", pa.int64()), ("list", pa.int64()), ("members", pa.list_(pa.int64()))]
    )

    def meet(bucket: pa.Table) -> pa.Table:
        flat = {
            c: bucket[c].combine_chunks().flatten().to_numpy()
            for c in ("nodes", "scales", "keys")
        }
        owner = np.argsort(flat["keys"], kind="stable")
        key = flat["keys"][owner]
        same = key[1:] == key[:-1]
        live = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, owner = key[live], owner[live]
        node, scale = flat["nodes"][owner], flat["scales"][owner]
        order = np.lexsort((node, scale, key))
        key, node, scale = key[order], node[order], scale[order]
        # Other tasks may have posted the same set.
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, scale = key[fresh], node[fresh], scale[fresh]
        beside = np.flatnonzero(key[1:] == key[:-1]) if len(key) else np.zeros(0, np.int64)
        beside = beside[scale[beside + 1] - scale[beside] <= SCALE * math.log(100 / PER_CENT) + 1]
        rows = {name: [] for name in schema.names}
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        if len(beside):
            pairs = np.stack([node[beside], node[beside + 1]], axis=1)
            kind, of, times = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
            two = np.zeros(len(kind), bool)
            two[of.reshape(-1)[np.repeat(size == 2, size)[beside]]] = True
            rows["a"], rows["b"] = kind[:, 0].tolist(), kind[:, 1].tolist()
            rows["times"], rows["two"] = times.tolist(), two.tolist()
        blank = len(rows["a"])
        by_least: dict[int, dict[int, np.ndarray]] = {}
        for i, j in zip(start[size > 2], (start + size)[size > 2]):
            by_least.setdefault(int(node[i:j].min()), {})[_content(node[i:j])] = node[i:j]
        for least, lists in by_least.items():
            for members in gathered(list(lists.values())):
                rows["least"].append(least)
                rows["list"].append(_content(members))
                rows["members"].append(members)
        listed = len(rows["list"])
        for name in ("a", "b", "times", "two"):
            rows[name] += [None] * listed
        for name in ("least", "list", "members"):
            rows[name] = [None] * blank + rows[name]
        return pa.Table.from_pydict(rows, schema=schema)

    return posted.groupBy("bucket").applyInArrow(meet, _MET)


def _content(members: np.ndarray) -> int:
    return int(mixed(members.view(np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def list_members(met: DataFrame) -> DataFrame:
    """Members (list, node) of the lists of all buckets, gathered by their smallest one like those of a bucket.

    A group of near copies meets under many keys, in lists that differ in few members: together
    they have little more than one of them.
    """
    parts = materialized(
        met.where("list IS NOT NULL")
        .groupBy("least", "list", F.size("members").cast("long").alias("size"))
        .agg(F.first("members").alias("members"))
    )
    members = parts.select("least", "list", F.explode("members").alias("node"))
    together = members.select("least", "node").distinct().groupBy("least").agg(F.count(F.lit(1)).alias("many"))
    wide = (
        parts.groupBy("least")
        .agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
        .join(together, "least")
        .where(F.col("many") * F.col("many") > MERGED * F.col("pairs"))
        .select("least", F.lit(True).alias("wide"))
    )
    return (
        members.join(wide, "least", "left")
        .select(F.when(F.col("wide"), F.xxhash64("least", "list")).otherwise(F.col("least")).alias("list"), "node")
        .distinct()
    )


def not_far(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that their sizes and bitmaps do not rule out."""
    side = [
        nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        for x in "ab"
    ]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kept(batches):
        for batch in batches:
            n = [batch.column(f"n_{x}").to_numpy().astype(np.int64) for x in "ab"]
            one, other = (Bitmaps(batch.column(f"bits_{x}")) for x in "ab")
            every = np.arange(batch.num_rows)
            near = one.apart(every, every, other) <= most_apart(*n)
            near &= PER_CENT * np.maximum(*n) <= 100 * np.minimum(*n)
            yield batch.select(["a", "b"]).filter(pa.array(near)).cast(schema)

    return (
        pairs.join(side[0], "a")
        .join(side[1], "b")
        .select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        .mapInArrow(kept, "a long, b long")
    )


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """Pairs that are linked, verified on the whole sets of their texts.

    Texts, which take less room than their sets, are brought together; only those of the
    pairs are.
    """
    wanted = compacted(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    chosen = nodes.join(wanted, "node").select(F.col("first_id").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted, chosen = F.broadcast(wanted), F.broadcast(chosen)
    same_id = docs["doc_id"].eqNullSafe(chosen["doc_id"])

    def named(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"])
            yield {"node": [fingerprint(s, seed) for s in sets], "text": batch["text"]}

    texts = (
        docs.join(chosen, same_id, "left_semi")
        .select("text")
        .transform(batchwise(named, "node long, text string"))
        .join(wanted, "node", "left_semi")
    )

    def verify(batches):
        known, held = None, None
        for batch in batches:
            rows = {"a": [], "b": []}
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                if a != known:
                    known, held = a, shingle_sets([x])[0]
                if _similar(held, shingle_sets([y])[0]):
                    rows["a"].append(a)
                    rows["b"].append(b)
            yield rows

    return (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        .select("a", "b", "x", "y")
        .transform(batchwise(verify, "a long, b long"))
        .distinct()
    )


def _similar(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= PER_CENT * (len(one) + len(other) - both)


def across(
    lists: DataFrame, named: DataFrame, nodes: DataFrame, tasks: int, most: int, left: DataFrame | None
) -> DataFrame:
    """Pairs of a list's members in different components, as far as sizes and bitmaps allow.

    Lists within one component have nothing to add.  Others are compared in blocks.  Of
    two components a task gives the ``most`` pairs with the nearest bitmaps; where it had
    others they are named in ``in_a`` and ``in_b``.  Only members of the components in
    ``left``, if given, are compared.
    """
    members = (
        lists.join(named, "node", "left")
        .select("list", "node", F.coalesce("component", "node").alias("component"))
    )
    if left is not None:
        members = members.join(left, "component", "left_semi")
    # A list is as long as it was; only those of several components are taken apart again.
    mixed_lists = (
        members.groupBy("list")
        .agg(
            F.min("component").alias("least"),
            F.max("component").alias("most"),
            F.collect_list(F.struct("node", "component")).alias("rows"),
        )
        .where("least != most")
    )
    blocks = F.ceil(F.size("rows") / BLOCK).cast("int")
    compared = (
        mixed_lists.select("list", blocks.alias("blocks"), F.inline("rows"))
        .join(nodes.select("node", "n", "bits"), "node")
        .transform(lambda df: paired_blocks(df, "node", "blocks"))
        .withColumn("block", F.xxhash64("list", "low", "high"))
        .withColumn("task", F.pmod("block", F.lit(tasks)))
        .select("task", "block", "side", "low", "high", "node", "component", "n", "bits")
    )

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("block")
        block, node = rows["block"].to_numpy(), rows["node"].to_numpy()
        part, size = rows["component"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        side, diagonal = rows["side"].to_numpy(), rows["low"].to_numpy() == rows["high"].to_numpy()
        bits = Bitmaps(rows["bits"].combine_chunks())
        found = [np.zeros((0, 5), np.int64)]
        # Rows that are so many places apart, all blocks at a time.
        for step in range(1, len(node)):
            i = np.flatnonzero(block[step:] == block[:-step])
            if not len(i):
                break
            j = i + step
            near = (part[i] != part[j]) & (diagonal[i] | (side[i] != side[j]))
            near &= PER_CENT * np.maximum(size[i], size[j]) <= 100 * np.minimum(size[i], size[j])
            i, j = i[near], j[near]
            apart = bits.apart(i, j)
            near = apart <= most_apart(size[i], size[j])
            i, j, apart = i[near], j[near], apart[near]
            sides = [(f(x[i], x[j])) for x in (part, node) for f in (np.minimum, np.maximum)]
            found.append(np.stack([sides[0], sides[1], apart, sides[2], sides[3]], axis=1))
        # In order of components and distance, once each.
        pairs = np.unique(np.concatenate(found), axis=0)
        first = np.ones(len(pairs), bool)
        first[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
        start = np.flatnonzero(first)
        rank = np.arange(len(pairs)) - np.repeat(start, np.diff(np.append(start, len(pairs))))
        kept = rank < most
        cut = np.repeat(np.diff(np.append(start, len(pairs))) > most, np.diff(np.append(start, len(pairs))))
        return pa.table(
            {"a": pairs[kept, 3], "b": pairs[kept, 4]}
            | {name: pa.array(pairs[kept, k], mask=~cut[kept]) for k, name in enumerate(("in_a", "in_b"))}
        )

    return compared.groupBy("task").applyInArrow(compare, "a long, b long, in_a long, in_b long")


def still_apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Of pairs of former components those that are still two, as one column of components."""
    part = {x: named.select(F.col("node").alias(f"in_{x}"), F.col("component").alias(x)) for x in "ab"}
    now = (
        pairs.join(part["a"], "in_a", "left")
        .join(part["b"], "in_b", "left")
        .select(F.coalesce("a", "in_a").alias("a"), F.coalesce("b", "in_b").alias("b"))
        .where("a != b")
    )
    return now.select(F.explode(F.array("a", "b")).alias("component")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Per document its set's size, the set's node, the component and its smallest id; the nodes' seed."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    seed = 1
    while True:
        sets = materialized(document_sets(texts, seed))
        filled = sets.where("n > 0")
        clash = filled.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y")
        if clash.isEmpty():
            break
        # Two different sets share a fingerprint: take others.
        seed += 1
    nodes = materialized(
        filled.groupBy("node").agg(
            F.first("n").alias("n"), F.min("doc_id").alias("first_id"), F.first("bits").alias("bits")
        )
    )
    many, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    met = materialized(meetings(posted_keys(texts, seed, max(8, total // BUCKET_KEYS))))
    lists = compacted(list_members(met))
    # Neighbours that met once, in a longer list, are left to the comparison of its members.
    pairs = (
        met.where("list IS NULL")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "times", "two")
        .groupBy("a", "b")
        .agg(F.sum("times").alias("times"), F.max("two").alias("two"))
        .where("two OR times > 1")
        .drop("two")
    )
    pairs = compacted(pairs)
    candidates = compacted(not_far(pairs, nodes).join(pairs, ["a", "b"]))
    # First each set with the one that it met most often.
    often = F.struct(F.col("times"), F.col("a"), F.col("b"))
    best = (
        candidates.groupBy("a").agg(F.max(often).alias("p"))
        .union(candidates.groupBy("b").agg(F.max(often).alias("p")))
        .select("p.a", "p.b").distinct()
    )
    best = compacted(best)
    named = compacted(components(linked(best, texts, nodes, seed)))
    # Then the candidates that would join different components.
    part = {x: named.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}")) for x in "ab"}
    apart = F.coalesce("in_a", "a") != F.coalesce("in_b", "b")
    rest = candidates.join(part["a"], "a", "left").join(part["b"], "b", "left").where(apart).select("a", "b")
    rest = compacted(rest.join(best, ["a", "b"], "left_anti"))
    named = joined(named, linked(rest, texts, nodes, seed))
    # At last the members of lists that still hold several components, the nearest first:
    # a link joins two components and settles all other pairs between them.
    tried, most, left = best.union(rest), FIRST_PAIRS, None
    while True:
        near = compacted(across(lists, named, nodes, max(8, many // COMPARED), most, left))
        fresh = compacted(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        named = joined(named, linked(fresh, texts, nodes, seed))
        # Components that gave all their pairs, or are now one, are done with.
        cut = near.where("in_a IS NOT NULL").select("in_a", "in_b").distinct()
        left = compacted(still_apart(cut, named))
        if left.isEmpty():
            break
        tried, most = tried.union(fresh), 32 * most
    final = named.join(nodes.select("node", "first_id"), "node")
    least = final.groupBy("component").agg(F.min("first_id").alias("least_id"))
    ids = (
        nodes.select("node", "first_id")
        .join(final.join(least, "component").select("node", "component", "least_id"), "node", "left")
        .select(
            "node",
            F.coalesce("component", "node").alias("component"),
            F.coalesce("least_id", "first_id").alias("least_id"),
        )
    )
    found = (
        sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
        .join(ids, "node", "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            "node",
            "component",
            F.coalesce("least_id", "doc_id").alias("component_id"),
        )
    )
    return found, seed


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicate texts: doc_id, n_shingles, component_id.

    One row per input row.  Documents link where the Jaccard similarity of their shingle
    sets is at least 0.75; component_id is the smallest doc_id reachable by links.  NULL and
    empty texts have no shingle and link with nothing.  Rows with equal sets always link,
    rows that repeat an id among them; a row without id takes the smallest id of its group.
    Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col)[0].drop("node", "component")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest id stays.

    Rows keep their own columns.  Texts without a shingle stay, and of rows that repeat both
    id and text one.  Where an id repeats or is missing, each row is judged by its own text:
    of rows of a group that share the smallest id one stays, and a row without id only where
    no other has one.
    """
    groups, seed = _grouped(docs, "doc_id", "text")
    groups = materialized(groups)
    filled = groups.where("n_shingles > 0")
    if not filled.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return _one_row_of_each_group(docs, filled, seed)
    dropped = compacted(groups.where("doc_id != component_id").select("doc_id").distinct())
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti")


def _one_row_of_each_group(docs: DataFrame, filled: DataFrame, seed: int) -> DataFrame:
    """The rows that stay, where the id of a row does not tell which text it has."""
    doc_id, text = F.col("doc_id").cast("long"), text_or_empty("text")
    keyed = docs.select(
        F.struct("*").alias("row"),
        doc_id.alias("doc_id"),
        text.alias("text"),
        F.xxhash64(doc_id, text).alias("k1"),
        F.xxhash64(F.lit("second"), text, doc_id).alias("k2"),
    )

    def named(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"])
            nodes = [fingerprint(s, seed) if len(s) else None for s in sets]
            yield {name: batch[name] for name in ("doc_id", "k1", "k2")} | {"node": nodes}

    rows = materialized(
        keyed.select("doc_id", "text", "k1", "k2").transform(
            batchwise(named, "doc_id long, k1 long, k2 long, node long")
        )
    )
    components_of = filled.select("node", "component").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "k1", "k2")
    first = (
        rows.join(components_of, "node").groupBy("component").agg(F.min(order).alias("o")).select("o.k1", "o.k2")
    )
    stays = first.union(rows.where("node IS NULL").select("k1", "k2")).distinct()
    return (
        keyed.join(stays, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row").select("row.*")
    )
