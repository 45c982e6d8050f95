"""Readers and row logic of raw logs, against brute force on small inputs."""

import csv
import io
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fixtures import rows_of
from gaugeflow.plans import ingest
from gaugeflow.sources import csv_files
from gaugeflow.sources import drive_logs as logs
from gaugeflow.sources.headers import header_cells, match_aliases, match_exact, match_fragments
from gaugeflow.testing.views import profiles


def _matched(spark, header, match):
    row = spark.createDataFrame([(header,)], "header STRING").select(header_cells(F.col("header")).alias("n"))
    found = match(F.col("n"))
    got = row.select(*[c.alias(g) for g, c in found.items()]).first().asDict()
    return {g: at for g, at in got.items() if at is not None}


def test_header_matching(spark):
    header = "\ufeffTime,Engine_RPM (rpm),Speed,MAF(g/s),\"Engine Load, (%)\",Trouble  Code"
    assert _matched(spark, header, match_aliases) == {
        "ts": 0, "rpm": 1, "speed_kph": 2, "maf_gps": 3, "dtc_code": 5,
    }
    # The first alias wins over later ones, and of equal names the last column.
    assert _matched(spark, "time,ts,TS ", match_aliases)["ts"] == 2
    header = "GPS speed,Vehicle_Speed,Relative_Throttle,Throttle,Electric"
    assert _matched(spark, header, match_fragments) == {"speed_kph": 1, "throttle_pct": 2, "coolant_temp_c": 4}


@pytest.mark.parametrize("header", ["a", "a,", ",a", ",", "a,b c,", '"x, ""y""",z', '"two\nlines",b'])
def test_header_cells_equal_the_csv_module(spark, header):
    row = spark.createDataFrame([(header,)], "header STRING").select(header_cells(F.col("header"))).first()
    assert row[0] == next(csv.reader(io.StringIO(header)))


def test_headers_are_found_in_any_file(spark, tmp_path):
    """Blank first lines, odd file names, a very long header, a line break in a quoted name."""
    wide = ",".join(f"column {i}" for i in range(9000))
    write(tmp_path / "my drive 90°.csv", "\n\nts,rpm\n2026-01-01T00:00:00Z,1\n")
    write(tmp_path / "wide.csv", f"ts,{wide},rpm\n2026-01-01T00:00:01Z,{',' * 8999},2\n")
    write(tmp_path / "plain+1.csv", "rpm,ts\n3,2026-01-01T00:00:02Z\n")
    write(tmp_path / "quoted.csv", '"no\nname",ts,rpm\nx,2026-01-01T00:00:03Z,4\n')
    write(tmp_path / "empty.csv", "\n\n")
    got = logs.scan_drive_csv(spark, str(tmp_path), multiline=True)
    assert rows_of(got, "rpm", "ts") == [(float(i + 1), datetime(2026, 1, 1, 0, 0, i)) for i in range(4)]
    with pytest.raises(ValueError, match="no header line"):
        logs.scan_drive_csv(spark, str(tmp_path / "empty.csv"))
    write(tmp_path / "quoted.csv", "\n  \nts,rpm\n2026-01-01T00:00:03Z,4\n")
    got = logs.scan_drive_csv(spark, str(tmp_path))
    assert rows_of(got, "rpm", "ts") == [(float(i + 1), datetime(2026, 1, 1, 0, 0, i)) for i in range(4)]


def test_a_header_over_many_lines(spark, tmp_path):
    name = "\n".join(f"part {i}" for i in range(40))
    write(tmp_path / "a.csv", f'"{name}",Engine RPM\n1,7\n"x ""y""\n, z",8\n')
    write(tmp_path / "b.csv", 'Engine RPM\n"9"\n"1,0"\n')
    got = logs.scan_fuzzy_csv(spark, str(tmp_path), multiline=True)
    assert rows_of(got, "rpm") == [("1,0",), ("7",), ("8",), ("9",)]


@pytest.mark.parametrize("multiline", [False, True])
def test_cells_equal_the_csv_reader(spark, tmp_path, multiline):
    """Quotes, escapes, blanks, short and long rows come out as one plain CSV read has them."""
    lines = ["a,b,c", '1,"x, ""y""",3', '"",,"z"', "only", '"one, cell"', " 4 , 5,6", "7,8,9,10", ",,", '"un,quoted', "é,\t,'"]
    if not multiline:
        lines.insert(2, " \t ")
    path = write(tmp_path / "f.csv", "\r\n".join(lines) + "\r\n")
    wanted = {c: c for c in "cab"}
    got = csv_files.scan(spark, path, list(wanted), lambda names: match_exact(names, wanted), multiline)
    plain = spark.read.schema("a STRING, b STRING, c STRING").option("header", True)
    plain = plain.option("escape", '"').option("multiLine", multiline).csv(path)
    assert [tuple(r) for r in got.orderBy("line_no").select("a", "b", "c").collect()] == [
        tuple(r) for r in plain.collect()
    ]


def test_files_are_read_once_and_rows_numbered_in_place(spark, tmp_path):
    """The plan reads stored records only, and samples get their ids without an exchange."""
    for name, head in (("a.csv", "ts,rpm"), ("b.csv", "Time,Speed,Engine RPM")):
        cells = "1," * head.count(",")
        rows = "".join(f"2026-01-01T00:00:{i // 60:02d}Z,{cells[:-2]}{i}\n" for i in range(600))
        write(tmp_path / name, head + "\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ingest.by_file_name(logs.scan_drive_csv(spark, str(tmp_path)))
        sources = _sources(spark, ["a.csv", "b.csv"])
        fleet = ingest.ingest_drives(rows, sources, profiles(spark), first_sample_id=11)
        got = [tuple(r) for r in fleet.telemetry_samples.select("sample_id", "session_id", "rpm").collect()]
        thinned = ingest.ingest_drives(rows.filter("rpm % 3 = 0"), sources, profiles(spark))
        kept = [tuple(r) for r in thinned.telemetry_samples.select("sample_id", "session_id", "rpm").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == [(11 + 600 * s + i, s + 1, float(i)) for s in (0, 1) for i in range(600)]
    assert sorted(kept) == [(1 + 200 * s + i, s + 1, 3.0 * i) for s in (0, 1) for i in range(200)]
    plan = fleet.telemetry_samples._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "FileScan text" not in plan and "FileScan parquet" in plan
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_quoted_line_breaks_in_rows(spark, tmp_path):
    path = write(tmp_path / "f.csv", 'note,Engine RPM\n"two\nlines",7\n')
    assert rows_of(logs.scan_fuzzy_csv(spark, path, multiline=True), "rpm") == [("7",)]


def test_staggered_log_file(spark, tmp_path):
    names = ["Time", *logs.STAGGERED_COLUMNS.values()]
    lines = [",".join(names), "10:00:00.25,700,,,,,", "10:00:00.5,,0,82,20,5.5,12", "10:00:01,800,,,,,"]
    path = write(tmp_path / "2018-03-26_Car_RT.csv", "\n".join(lines) + "\n")
    drives = logs.staggered_drives(logs.scan_staggered_log(spark, path))
    assert rows_of(drives, "ts", "rpm", "maf_gps") == [
        (datetime(2018, 3, 26, 10, 0, 0, 500000), "700", "5.5"),
        (datetime(2018, 3, 26, 10, 0, 1), "800", "5.5"),
    ]
    write(tmp_path / "2018-03-27_Car_RT.csv", "\n".join([*lines, "late,,,,,,"]) + "\n")
    with pytest.raises(Exception, match="no readable time"):
        logs.scan_staggered_log(spark, str(tmp_path)).collect()


def test_rows_without_a_time_stay(spark):
    rows = [("f", 0, i, datetime(2026, 1, 1) if i < 2 else None, str(i)) for i in range(5)]
    table = spark.createDataFrame(
        rows, "source_file STRING, block_start BIGINT, line_no BIGINT, ts TIMESTAMP_NTZ, rpm STRING"
    )
    assert rows_of(logs.one_row_per_second(table), "rpm") == [("0",), ("2",), ("3",), ("4",)]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_mixed_headers_become_one_table(spark, tmp_path):
    write(tmp_path / "a.csv", 'ts,rpm,coolant_temp_c,dtc\n2026-01-01T00:00:00Z,"1,234.5 rpm",NaN,p0171\n')
    write(
        tmp_path / "b.csv",
        "Coolant Temp,Time,Engine RPM\n.5,2026-01-01T02:00:00.25+02:00,1e3\n-7C,2026-01-01 00:00:01,\n",
    )
    write(tmp_path / "c.csv", "ts\n2026-01-01T00:00:02Z\n")
    got = logs.scan_drive_csv(spark, str(tmp_path))
    assert rows_of(got, "ts", "rpm", "coolant_temp_c", "dtc_code", "maf_gps") == [
        (datetime(2026, 1, 1, 0, 0, 0), 1234.5, None, "p0171", None),
        (datetime(2026, 1, 1, 0, 0, 0, 250000), 1.0, 5.0, None, None),
        (datetime(2026, 1, 1, 0, 0, 1), None, -7.0, None, None),
        (datetime(2026, 1, 1, 0, 0, 2), None, None, None, None),
    ]


def test_bad_timestamps_stop_the_job(spark, tmp_path):
    path = write(tmp_path / "a.csv", "ts,rpm\n2026-01-01T00:00:00Z,1\n  ,2\n")
    with pytest.raises(Exception, match="no readable timestamp"):
        logs.scan_drive_csv(spark, path).collect()
    path = write(tmp_path / "b.csv", "when,rpm\n1,2\n")
    with pytest.raises(ValueError, match="no column for one of: ts"):
        logs.scan_drive_csv(spark, path)


def test_rows_keep_file_order_over_many_splits(spark, tmp_path):
    lines = "".join(f"2026-01-01T00:00:00Z,{i}\n" for i in range(3000))
    path = write(tmp_path / "long.csv", "ts,rpm\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = logs.scan_drive_csv(spark, path)
        placed = logs.file_positions(rows).select("position", "rpm", "block_start").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r["block_start"] for r in placed}) > 3
    assert all(r["position"] == int(r["rpm"]) for r in placed) and len(placed) == 3000


def test_fault_cells(spark):
    rows = spark.createDataFrame(
        [
            ("f", 0, 0, datetime(2026, 1, 1), "p0171;\tP0301|p0171\n", None, "first"),
            ("f", 0, 1, datetime(2026, 1, 1), "P0301", None, "second"),
            ("f", 0, 2, datetime(2026, 1, 1), "P0301,,", "pending", None),
            ("f", 0, 3, datetime(2026, 1, 1), None, None, None),
        ],
        "source_file STRING, block_start BIGINT, line_no BIGINT, ts TIMESTAMP_NTZ, dtc_code STRING, "
        "dtc_status STRING, dtc_description STRING",
    )
    got = ingest.explode_dtc_codes(rows)
    assert rows_of(got, "code", "status", "description") == [
        ("P0171", "stored", "first"),
        ("P0301", "pending", None),
        ("P0301", "stored", "first"),
    ]


def _sources(spark, names):
    return spark.createDataFrame(
        [(n, None, "a", "b", 1, None, None, "csv", None, None) for n in names],
        "source_file STRING, vin STRING, make STRING, model STRING, year INT, engine STRING, "
        "vehicle_notes STRING, source STRING, ambient_c DOUBLE, session_notes STRING",
    )


def test_every_source_needs_rows_and_every_row_a_source(spark, tmp_path):
    path = write(tmp_path / "a.csv", "ts,rpm\n2026-01-01T00:00:00Z,1\n")
    rows = ingest.by_file_name(logs.scan_drive_csv(spark, path))
    fleet = ingest.ingest_drives(rows, _sources(spark, ["a.csv", "empty.csv"]), profiles(spark))
    with pytest.raises(Exception, match="no telemetry rows in empty.csv"):
        fleet.drive_sessions.collect()
    with pytest.raises(Exception, match="no source entry for a.csv"):
        ingest.ingest_drives(rows, _sources(spark, ["b.csv"]), profiles(spark))


def test_emulator_tag(spark):
    tagged = ingest.tag_source(_sources(spark, ["x"])).first()
    assert (tagged["source"], tagged["ambient_c"]) == ("emulator", 22.0)
    assert tagged["session_notes"] == ingest.EMULATOR_NOTES


def _file_rows(spark, columns, rows):
    """Rows of files 'a' (long) and 'b' with uneven splits."""
    data = [
        (file, (i // 7) * 10, i % 7, *cells)
        for file, lines in rows.items()
        for i, cells in enumerate(lines)
    ]
    random.Random(5).shuffle(data)
    schema = "source_file STRING, block_start BIGINT, line_no BIGINT, " + ", ".join(
        f"{c} STRING" for c in columns
    )
    return spark.createDataFrame(data, schema)


def _first_warm(values, rows, warm):
    def number(v):
        try:
            return float(v)
        except (TypeError, ValueError):
            return 0.0

    for i in range(max(1, len(values) - rows)):
        if sum(number(v) >= warm for v in values[i : i + rows]) >= int(0.9 * rows):
            return i
    return 0


@pytest.mark.parametrize("seed, stretch", [(0, 100_000), (1, 17)])
def test_warm_window_against_brute_force(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(logs, "STRETCH_ROWS", stretch)
    rng = random.Random(seed)
    files = {
        "a": [(rng.choice(["x", None, "95", "80"] if i > 60 else ["70", "80"]),) for i in range(160)],
        "b": [(str(60 + i),) for i in range(30)],
        "c": [("90",) for _ in range(9)],
        # Warm only in the last full run, which is never tried.
        "d": [("10",)] * 20 + [("90",)] * 10,
    }
    got = logs.pick_warm_window(_file_rows(spark, ["coolant_temp_c"], files), 10, 80.0)
    found = {}
    for r in got.collect():
        found.setdefault(r["source_file"], []).append(r["position"])
    for name, lines in files.items():
        start = _first_warm([v for (v,) in lines], 10, 80.0)
        assert sorted(found[name]) == list(range(start, min(start + 10, len(lines))))
    first = logs.regrid_1hz(got).filter("window_row = 3 AND source_file = 'c'").first()
    assert first["ts"] == datetime(2018, 6, 1, 10, 0, 3)


def _staggered_expected(lines, min_c, max_rows):
    last, warm, seen, out = [None] * 6, min_c is None, set(), []
    for n, (time, *cells) in enumerate(lines):
        last = [c.strip() if c and c.strip() else old for c, old in zip(cells, last)]
        if None in last:
            continue
        if not warm and float(last[2]) < min_c:
            continue
        warm = True
        if time[:8] in seen:
            continue
        seen.add(time[:8])
        out.append((time, *last))
        if len(out) == max_rows:
            break
    return out


@pytest.mark.parametrize("min_c", [None, 85.0])
def test_staggered_log_against_brute_force(spark, min_c):
    rng = random.Random(3)
    files = {}
    for name in ("2018-03-26_Car_A.csv", "2018-03-27_Car_B.csv"):
        lines = []
        for i in range(120):
            cells = [None] * 6
            cells[rng.randrange(6)] = rng.choice([str(70 + i // 4 + rng.randrange(5)), " ", None])
            lines.append((f"10:00:{i // 3:02d}.{i % 3}00", *cells))
        files[name] = lines
    columns = ["time", *logs.STAGGERED_COLUMNS]
    rows = logs.timestamp_from_filename(_file_rows(spark, columns, files))
    got = logs.staggered_drives(rows, min_c, 20)
    for name, lines in files.items():
        expected = _staggered_expected(lines, min_c, 20)
        actual = [
            (r["ts"].strftime("%H:%M:%S.%f")[:12], *[r[c] for c in logs.STAGGERED_COLUMNS])
            for r in got.filter(F.col("source_file") == name).orderBy("ts").collect()
        ]
        assert actual == expected and expected


def test_week_export(spark, tmp_path):
    head = (
        "DayNum,VehId,Trip,Timestamp(ms),Vehicle Speed[km/h],MAF[g/sec],Engine RPM[RPM],"
        "Absolute Load[%],OAT[DegC],Short Term Fuel Trim Bank 1[%],Long Term Fuel Trim Bank 1[%]\n"
    )
    path = write(
        tmp_path / "week.csv",
        head
        + "2.560764,8,706,820.9,46,9.8,1328,10.98,NA,NaN,na\n"
        + "2.560764,8,706,900,46,NA,1328,10.98,NA,NaN,NA\n"
        + "1,9,707,1500,0,NaN,0, 5 ,7,1.5,-2\n",
    )
    got = logs.as_samples(logs.week_trips(logs.scan_week_export(spark, path)))
    columns = ("veh_id", "ts", "speed_kph", "maf_gps", "intake_temp_c", "stft_b1_pct", "ltft_b1_pct")
    assert rows_of(got, *columns) == [
        ("8", datetime(2017, 11, 2, 13, 27, 30, 829000), 46.0, 9.8, None, None, None),
        ("9", datetime(2017, 11, 1, 0, 0, 1, 500000), 0.0, None, 7.0, 1.5, -2.0),
    ]
    only = logs.week_trips(logs.scan_week_export(spark, path), [("9", "707")], 1)
    assert only.count() == 1
