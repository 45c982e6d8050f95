"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Regular expressions find candidates in every text.  Their values, as 128-bit hashes, are
counted by distinct owners and repositories: a value that several owners hold is a copied
example, one that stays with few looks live.  Live-looking opaque values are reported
besides the base kinds.  Texts are read once and never shuffled; what moves are places and
hashes of candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import materialized, text_or_empty

# Fixed values of the format: kinds in the order they are listed, their patterns, and which
# part of a match is the value.
KINDS = ("assign", "access", "hex", "opaque")
_PATTERNS = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"AKIA[A-Z0-9]+",
    r"[0-9a-f]{24,}",
    r"[A-Za-z0-9+/_-]{32,}",
)
_VALUE = (2, 0, 0, 0)
BASE_KINDS = 3


@dataclass(frozen=True)
class Ownership:
    """Which columns name a document's owner and repository, and when a value counts as copied."""

    owner: str = "source"
    repository: tuple[str, ...] = ("source", "lang")
    # A value held by so many owners, or in so many repositories, is an example.
    example_owners: int = 3
    example_repositories: int = 6


def _accepted(kind: int, value: Column) -> Column:
    """Whether a match of a kind counts; NULL is what lies behind the last match."""
    if kind == 0:
        return F.length(value) >= 6
    if kind == 1:
        return F.length(value) >= 20
    if kind == 2:
        return value.isNotNull()
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _matches(kind: int, text: Column) -> Column:
    """All matches of a kind in order: what lies before each, its length, and its hashed value.

    Splitting at a pattern gives the stretches between the matches, hence their places.
    """
    pattern = _PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(_VALUE[kind]))
    return F.when(
        text.rlike(pattern),
        F.transform(
            F.arrays_zip(found.alias("found"), values.alias("value"), gaps.alias("gap")),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("nth"),
                m["gap"].alias("gap"),
                F.length(m["found"]).alias("size"),
                F.coalesce(_accepted(kind, m["value"]), F.lit(False)).alias("accepted"),
                F.xxhash64(m["value"]).alias("v1"),
                F.xxhash64(F.lit("second"), m["value"]).alias("v2"),
            ),
        ),
    )


def candidates(docs: DataFrame, ownership: Ownership, id_col: str, text_col: str) -> DataFrame:
    """Per input row (``row_id``) its matches of all kinds, without the text."""
    text = F.col("text")
    kind = "array<struct<kind:int,nth:int,gap:int,size:int,accepted:boolean,v1:bigint,v2:bigint>>"
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ownership.repository]
    return materialized(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            text_or_empty(text_col).alias("text"),
            F.xxhash64(F.coalesce(F.col(ownership.owner).cast("string"), F.lit(""))).alias("owner"),
            F.xxhash64(*part).alias("repository"),
        ).select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            "owner",
            "repository",
            F.concat(
                *[
                    F.coalesce(_matches(k, text).cast(kind), F.array().cast(kind))
                    for k in range(len(KINDS))
                ]
            ).alias("matches"),
        )
    )


def _spans(found: DataFrame) -> DataFrame:
    """Accepted matches with their places in code points."""
    so_far = Window.partitionBy("row_id", "kind").orderBy("nth")
    return (
        found.where(F.size("matches") > 0)
        .select("row_id", "owner", "repository", F.inline("matches"))
        .withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far))
        .where("accepted")
        .withColumn("start", F.col("stop") - F.col("size"))
        .select("row_id", "owner", "repository", "kind", "start", "stop", "v1", "v2")
    )


def value_owners(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value; added up by owner first, so copies never meet."""
    return (
        spans.groupBy("v1", "v2", "owner", "repository")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("v1", "v2")
        .agg(
            F.count(F.lit(1)).alias("n_repositories"),
            F.count_distinct("owner").alias("n_owners"),
        )
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.element_at(names, s["kind"] + 1),
                s["start"].cast("string"),
                s["stop"].cast("string"),
            ),
        ),
        ",",
    )


def secret_spans(
    docs: DataFrame,
    ownership: Ownership = Ownership(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Secrets of every whole text, one row per input row.

    doc_id; n_assign, n_access, n_hex; base_sha256 of the base spans as kind:start:end;
    spans, which adds live-looking opaque values that touch no base span; n_examples and
    n_live, the base spans by ownership.  NULL texts are empty, NULL owners one owner.
    Repeated rows have rows of their own.  Other columns are ignored.
    """
    found = candidates(docs, ownership, id_col, text_col)
    spans = _spans(found)
    # Values that several owners hold; every other one is live.  Far fewer than values.
    copied = (
        value_owners(spans)
        .where(
            (F.col("n_owners") >= ownership.example_owners)
            | (F.col("n_repositories") >= ownership.example_repositories)
        )
        .select("v1", "v2", F.lit(True).alias("copied"))
    )
    per_row = (
        spans.join(copied, ["v1", "v2"], "left")
        .groupBy("row_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("start", "kind", "stop", F.col("copied").isNotNull().alias("copied"))
                )
            ).alias("all")
        )
        .select("row_id", "all", F.filter("all", lambda s: s["kind"] < BASE_KINDS).alias("base"))
        .select(
            "row_id",
            "base",
            F.filter(
                "all",
                lambda s: (s["kind"] < BASE_KINDS)
                | ~s["copied"]
                & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])),
            ).alias("kept"),
        )
    )

    def many(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    digests = per_row.select(
        "row_id",
        *[many(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)],
        _listed(F.col("base")).alias("base"),
        _listed(F.col("kept")).alias("spans"),
        F.size(F.filter("base", lambda s: s["copied"])).cast("long").alias("n_examples"),
        F.size(F.filter("base", lambda s: ~s["copied"])).cast("long").alias("n_live"),
    )
    counts = [f"n_{k}" for k in KINDS[:BASE_KINDS]]
    return (
        found.select("row_id", "doc_id")
        .join(digests, "row_id", "left")
        .select(
            "doc_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_examples", "n_live")],
        )
    )
