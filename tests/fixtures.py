"""Two control drives, typed in, and the tables built from them."""

from __future__ import annotations

from gaugeflow.plans.ingest import ingest_drives
from gaugeflow.sources.drive_logs import normalise_drive_rows
from gaugeflow.sources.headers import DRIVE_ALIASES
from gaugeflow.testing.views import profiles

SAMPLE = {
    "rpm": "720 760 1150 1680 2120 2380 2450 2310 1960 1420 820 760",
    "speed_kph": "0 0 12 34 54 72 80 78 64 38 0 0",
    "engine_load_pct": "24 25 31 39 46 52 49 43 37 30 26 25",
    "coolant_temp_c": "82 83 84 86 88 90 91 92 92 91 90 89",
    "maf_gps": "5.9 6.1 9.8 16.4 24.7 31.2 32.8 28.4 20.9 12.6 6.8 6.2",
    "stft_b1_pct": "2.3 2.0 3.8 5.1 6.8 8.6 9.1 8.7 7.9 6.1 4.2 3.6",
    "ltft_b1_pct": "4.1 4.4 5.0 6.2 7.9 9.8 10.7 11.2 11.5 10.9 9.7 8.4",
    "timing_adv_deg": "18 18 21 25 29 31 32 34 36 30 20 19",
}
EMULATED = {
    "rpm": "690 730 1280 1840 2260 2710 2880 2500 2050 1510 850 720",
    "speed_kph": "0 0 18 42 61 83 91 88 70 44 0 0",
    "engine_load_pct": "21 22 33 41 48 57 61 50 39 31 23 21",
    "coolant_temp_c": "80 81 83 85 87 89 90 91 91 90 89 88",
    "maf_gps": "5.4 5.7 11.1 18.8 26.9 39.3 44.1 35.7 23.8 14.0 6.9 5.6",
    "stft_b1_pct": "1.1 1.4 2.0 2.8 3.2 3.7 4.1 3.8 3.0 2.4 1.8 1.3",
    "ltft_b1_pct": "2.0 2.2 2.5 3.1 3.8 4.6 5.2 5.0 4.5 4.0 3.4 2.8",
    "timing_adv_deg": "17 18 22 27 30 32 33 34 32 28 20 18",
}
FAULTS = {
    "sample.csv": ("P0171", "pending", "System Too Lean Bank 1"),
    "emulated.csv": ("P0301", "stored", "Cylinder 1 Misfire Detected"),
}
STARTS = {"sample.csv": "2026-06-01T09:00:", "emulated.csv": "2026-06-02T18:30:"}


def raw_rows(spark):
    """Text rows as the CSV reader gives them; three rows per file split."""
    names = list(DRIVE_ALIASES)
    rows = []
    for file, gauges in (("sample.csv", SAMPLE), ("emulated.csv", EMULATED)):
        values = {g: text.split() for g, text in gauges.items()}
        for i in range(12):
            cells = {g: v[i] for g, v in values.items()}
            cells["ts"] = f"{STARTS[file]}{i:02d}Z"
            if i == 5:
                fault = dict(zip(("dtc_code", "dtc_status", "dtc_description"), FAULTS[file]))
                cells.update(fault)
            rows.append((file, i // 3 * 100, i % 3, *[cells.get(n) for n in names]))
    schema = "source_file STRING, block_start BIGINT, line_no BIGINT, " + ", ".join(
        f"{n} STRING" for n in names
    )
    return spark.createDataFrame(rows, schema)


def sources(spark):
    return spark.createDataFrame(
        [
            ("sample.csv", 1, None, "Chevrolet", "Corvette", 2002, "LS1 5.7L V8", None, "csv", 21.0,
             "control"),
            ("emulated.csv", 2, None, "Chevrolet", "Corvette", 2002, "LS1 5.7L V8", None,
             "emulator", 22.0, None),
        ],
        "source_file STRING, source_order INT, vin STRING, make STRING, model STRING, year INT, "
        "engine STRING, vehicle_notes STRING, source STRING, ambient_c DOUBLE, "
        "session_notes STRING",
    )


def control_fleet(spark):
    rows = normalise_drive_rows(raw_rows(spark))
    return ingest_drives(rows, sources(spark), profiles(spark))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple(map(str, t)))
