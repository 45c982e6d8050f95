"""Text and number expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\x0b\x0c"


def text_or_null(col: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(F.btrim(col, F.lit(_BLANKS)), F.lit(""))


def first_number(col: Column) -> Column:
    """The first plain decimal number in a cell, thousands commas ignored.

    Exponents are not part of the pattern (``1e3`` reads 1.0) and words such as
    ``NaN`` read NULL, so a plain cast to double would give other results.
    """
    digits = F.regexp_extract(F.translate(col, ",", ""), r"[-+]?\d+(?:\.\d+)?", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def decimal_text(value: str, digits: int) -> Column:
    """``%.<digits>f`` of a SQL expression, NULL printed as zero.

    Rounds half up on the decimal value, without going through a formatter.
    """
    return F.expr(_fixed(value, digits))


def number_text(value: str, digits: int = 10) -> Column:
    """A double in plain digits without trailing zeros, at least one decimal (``81.0``)."""
    plain = f"CAST(CAST({value} AS DECIMAL(38,{digits})) AS STRING)"
    return F.expr(rf"regexp_replace(regexp_replace({plain}, '0+$', ''), '[.]$', '.0')")


def percent_text(value: str, digits: int = 1) -> Column:
    return F.expr(f"concat({_fixed(value, digits)}, '%')")


def _fixed(value: str, digits: int) -> str:
    exact = f"CAST(coalesce(CAST({value} AS DOUBLE), 0D) AS DECIMAL(38,9))"
    return f"CAST(CAST({exact} AS DECIMAL(38,{digits})) AS STRING)"


def clamp(col: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def whole_score(text: Column) -> Column:
    """A score's text as a whole number, halves up; text that is no number stays as it is."""
    value = text.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.floor(value + F.lit(0.5)).cast("string")).otherwise(text)


def whole_width(text: Column) -> Column:
    """The same as a width, ``0%`` for text that is no number."""
    value = text.try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.concat(whole_score(text), F.lit("%"))).otherwise(F.lit("0%"))


def clean_source_file(col: Column) -> Column:
    """Keep up to the first ``.csv``; failing that, up to the first ``;``."""
    text = F.btrim(col, F.lit(_BLANKS))
    archive = F.nullif(F.regexp_extract(text, r"(?is)^(.*?\.csv)", 1), F.lit(""))
    return F.coalesce(archive, F.btrim(F.substring_index(text, ";", 1), F.lit(_BLANKS)))


def between_markers(col: Column, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the first ``end`` behind it, else NULL."""
    tail = F.substr(col, F.instr(col, start) + F.lit(len(start)))
    return F.when(
        (F.instr(col, start) > 0) & (F.instr(tail, end) > 0), F.substring_index(tail, end, 1)
    )


def iso_text(value: str) -> Column:
    """UTC moment as ISO text with milliseconds."""
    return F.expr(f"date_format({value}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")")
