"""Decimal rounding of doubles by their exact binary value.

``F.round`` works on the shortest decimal text of a double, so 7.965 (which is a
little less than that in binary) becomes 7.97.  The published results round the
binary value and give 7.96.  Here x * 10**n is computed without error as p + e by
splitting x into two halves whose products are exact, and the fraction is compared
with one half.  Only plain arithmetic is used, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# 2**27 + 1 splits a 53-bit number into two halves of at most 26 bits.
_SPLIT = "CAST(134217729 AS DOUBLE)"
# Up to this many digits the half products are exact.
_EXACT_DIGITS = 6


def round_sql(value: str, digits: int, ties_to_even: bool = False) -> str:
    """SQL text for ``value`` rounded to ``digits``; ties go away from zero or to even."""
    if digits > _EXACT_DIGITS:
        return f"round({value}, {digits})"
    x = f"abs({value})"
    scale = f"CAST({10**digits} AS DOUBLE)"
    high = f"({x} * {_SPLIT} - ({x} * {_SPLIT} - {x}))"
    low = f"({x} - {high})"
    product = f"({x} * {scale})"
    error = f"(({high} * {scale} - {product}) + {low} * {scale})"
    whole = f"floor({product})"
    needed = f"(CAST(0.5 AS DOUBLE) - ({product} - {whole}))"
    if ties_to_even:
        up = f"{error} > {needed} OR ({error} = {needed} AND {whole} % 2 = 1)"
    else:
        up = f"{error} >= {needed}"
    rounded = f"(CASE WHEN {up} THEN {whole} + 1 ELSE {whole} END) / {scale}"
    return f"(CASE WHEN {value} < 0 THEN -({rounded}) ELSE {rounded} END)"


def with_rounded(
    df: DataFrame, columns: Mapping[str, str], digits: int, ties_to_even: bool = False
) -> DataFrame:
    """Add (or replace) rounded columns, given as name -> SQL expression.

    The same arithmetic as ``round_sql`` in three projections, so that each part is
    written and evaluated once.
    """
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    if digits > _EXACT_DIGITS:
        return df.selectExpr(*kept, *[f"round({v}, {digits}) AS {c}" for c, v in columns.items()])
    scale = f"CAST({10**digits} AS DOUBLE)"
    valued = df.selectExpr("*", *[f"CAST({v} AS DOUBLE) AS _v_{c}" for c, v in columns.items()])
    parts = []
    for c in columns:
        x = f"abs(_v_{c})"
        parts += [
            f"{x} * {scale} AS _p_{c}",
            f"({x} * {_SPLIT} - ({x} * {_SPLIT} - {x})) AS _h_{c}",
        ]
    split = valued.selectExpr(*kept, *[f"_v_{c}" for c in columns], *parts)

    def rounded(c: str) -> str:
        error = f"((_h_{c} * {scale} - _p_{c}) + (abs(_v_{c}) - _h_{c}) * {scale})"
        needed = f"(0.5D - (_p_{c} - floor(_p_{c})))"
        up = f"{error} >= {needed}"
        if ties_to_even:
            up = f"{error} > {needed} OR ({error} = {needed} AND floor(_p_{c}) % 2 = 1)"
        size = f"(floor(_p_{c}) + CASE WHEN {up} THEN 1 ELSE 0 END) / {scale}"
        return f"CASE WHEN _v_{c} < 0 THEN -({size}) ELSE {size} END AS {c}"

    return split.selectExpr(*kept, *[rounded(c) for c in columns])
