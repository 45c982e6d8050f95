"""Column names of drive logs: which source column feeds which gauge.

Matching is column expressions over the array of a file's header names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted header names per column, best match first.
DRIVE_ALIASES: dict[str, tuple[str, ...]] = {
    "ts": ("ts", "timestamp", "time", "datetime"),
    "rpm": ("rpm", "engine rpm", "engine rpm(rpm)", "engine rpm (rpm)", "engine rpm[rpm]"),
    "speed_kph": (
        "speed_kph",
        "speed",
        "speed (km/h)",
        "vehicle speed(km/h)",
        "vehicle speed[km/h]",
    ),
    "engine_load_pct": (
        "engine_load_pct",
        "engine load",
        "engine load(%)",
        "engine load (%)",
        "absolute load[%]",
    ),
    "coolant_temp_c": (
        "coolant_temp_c",
        "coolant temp",
        "coolant temp(c)",
        "engine coolant temperature(c)",
    ),
    "intake_temp_c": ("intake_temp_c", "intake temp", "intake air temp(c)"),
    "maf_gps": ("maf_gps", "maf", "maf(g/s)", "mass air flow(g/s)", "maf[g/sec]"),
    "throttle_pct": ("throttle_pct", "throttle position(%)", "throttle position"),
    "stft_b1_pct": (
        "stft_b1_pct",
        "short fuel trim bank 1(%)",
        "short fuel trim 1",
        "short term fuel trim bank 1[%]",
    ),
    "ltft_b1_pct": (
        "ltft_b1_pct",
        "long fuel trim bank 1(%)",
        "long fuel trim 1",
        "long term fuel trim bank 1[%]",
    ),
    "timing_adv_deg": ("timing_adv_deg", "timing advance", "timing advance(deg)"),
    "fuel_press_kpa": ("fuel_press_kpa", "fuel pressure(kpa)", "fuel pressure"),
    "o2_b1s1_v": ("o2_b1s1_v", "o2 b1s1(v)", "o2_b1s1", "bank 1 sensor 1 voltage(v)"),
    "dtc_code": ("dtc_code", "dtc", "code", "trouble code"),
    "dtc_status": ("dtc_status", "status", "dtc status"),
    "dtc_description": ("dtc_description", "description", "dtc description"),
}

# Header fragments per column, strongest first.
FUZZY_FRAGMENTS: dict[str, tuple[str, ...]] = {
    "rpm": ("engine_rpm", "rpm", "engine speed"),
    "speed_kph": (
        "vehicle_speed",
        "speed_kph",
        "speed_kmh",
        "speed (",
        "vehicle speed",
        "speed",
    ),
    "engine_load_pct": ("engine_load", "calculated_load", "load_pct", "engine load", "load"),
    "coolant_temp_c": ("coolant_temp", "coolant", "ect", "engine_coolant"),
    "intake_temp_c": ("intake_air_temp", "intake_temp", "iat", "intake air"),
    "maf_gps": ("maf", "mass_air_flow", "air_flow", "airflow"),
    "throttle_pct": ("relative_throttle", "throttle_pos", "throttle (", " throttle", "throttle"),
    "stft_b1_pct": (
        "short_term_fuel_trim_bank_1",
        "short_term_fuel_trim",
        "stft",
        "short term fuel",
    ),
    "ltft_b1_pct": (
        "long_term_fuel_trim_bank_1",
        "long_term_fuel_trim",
        "ltft",
        "long term fuel",
    ),
    "timing_adv_deg": ("timing_advance", "timing_adv", "ignition_timing", "timing"),
}


# A cell, quoted or not, and the comma or end behind it.
_CELL = r'(?s)("(?:[^"]|"")*"|[^,]*)(?:,|$)'


def header_cells(header: Column) -> Column:
    """Names in a CSV header as an array; a byte order mark in front is dropped."""
    text = F.regexp_replace(header, "^\ufeff", "")
    # The pattern matches once more, with nothing, behind the last cell.
    cells = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(_CELL), F.lit(1))
    cells = F.slice(cells, 1, F.size(cells) - 1)
    return F.transform(
        cells,
        lambda c: F.when(
            c.startswith('"'),
            F.replace(F.substring(c, F.lit(2), F.length(c) - F.lit(2)), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


def _plain(name: Column) -> Column:
    """Lower case, underscores as blanks, single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " ")))


def _first(names: Column, accept: Callable[[Column], Column]) -> Column:
    """Position of the first accepted name, NULL if there is none."""
    return F.nullif(F.array_position(F.transform(names, accept), True), F.lit(0)).cast("int") - F.lit(1)


def _last(names: Column, accept: Callable[[Column], Column]) -> Column:
    return F.size(names) - F.lit(1) - _first(F.reverse(names), accept)


def _equal(text: str) -> Callable[[Column], Column]:
    return lambda name: name == text


def _named(text: str) -> Callable[[Column], Column]:
    return lambda name: _plain(name) == text


def _holding(text: str) -> Callable[[Column], Column]:
    return lambda name: name.contains(text)


def match_aliases(names: Column) -> dict[str, Column]:
    """Position per gauge by exact name; of equal names the last column counts."""
    return {
        gauge: F.coalesce(*[_last(names, _named(plain_name(alias))) for alias in aliases])
        for gauge, aliases in DRIVE_ALIASES.items()
    }


def match_fragments(
    names: Column, fragments: Mapping[str, Sequence[str]] = FUZZY_FRAGMENTS
) -> dict[str, Column]:
    """Position per gauge by fragment: strongest fragment first, then file order."""

    def shown(name: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")

    return {
        gauge: F.coalesce(
            *[_first(F.transform(names, shown), _holding(fragment)) for fragment in options]
        )
        for gauge, options in fragments.items()
    }


def match_exact(names: Column, wanted: Mapping[str, str]) -> dict[str, Column]:
    """Position per output name by the exact header text."""
    return {out: _last(names, _equal(source)) for out, source in wanted.items()}


def plain_name(name: str) -> str:
    return re.sub(r"\s+", " ", name.replace("_", " ")).strip().lower()
