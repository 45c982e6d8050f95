"""Reports, findings, checks, sinks and text functions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fixtures import control_fleet, rows_of
from gaugeflow import load_tables, write_tables
from gaugeflow.functions.text import whole_score, whole_width
from gaugeflow.functions.text import clean_source_file, decimal_text, first_number, number_text
from gaugeflow.operators import sessions
from gaugeflow.plans import export, report
from gaugeflow.schema import Fleet, conform

NOTES = (
    "KIT/RADAR Automotive OBD-II Dataset real OBD-II entry; "
    "source_file=2018-03-26_Seat_Leon.csv; trip_ref=4; drive_label=Traffic Jam Log; "
    "license=CC BY 4.0."
)


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """The control drives; the second one is made public."""
    root = str(tmp_path_factory.mktemp("tables")) + "/t"
    write_tables(control_fleet(spark), root)
    loaded = load_tables(spark, root)
    public = F.col("session_id") == 2
    dressed = loaded.drive_sessions.withColumns(
        {
            "source": F.when(public, "public").otherwise(F.col("source")),
            "notes": F.when(public, NOTES).otherwise("Synthetic control"),
        }
    )
    return Fleet(**{**loaded.tables(), "drive_sessions": dressed})


@pytest.fixture(scope="module")
def facts(fleet):
    return report.compute_facts(fleet, keep=True)


def test_report_rejects_unknown_sessions(spark, fleet, facts):
    asked = spark.createDataFrame([(1,), (999,)], "session_id BIGINT")
    got = {r["session_id"]: r for r in report.session_report(fleet, facts, asked).collect()}
    assert got[1]["status"] == "ok" and got[1]["dtc_summary"] == report.TEXT_DTC_ROWS
    assert (got[1]["correlation_rows"], got[1]["baseline_rows"]) == (11, 5)
    assert got[999]["status"] == "error" and got[999]["error"] == "Session not found: 999"
    assert got[999]["health_score"] is None and got[999]["recommendation"] is None


def test_findings_carry_their_evidence(fleet, facts):
    found = report.build_findings(fleet, facts, run_id="r1", first_id=10)
    rows = {r["session_id"]: r for r in found.collect()}
    assert [rows[1]["finding_id"], rows[2]["finding_id"]] == [10, 11]
    first = rows[1]
    assert first["agent_trace_id"].startswith("agent-") and len(first["agent_trace_id"]) == 38
    assert json.loads(first["observed"])["health_score"] == 81.0
    evidence = json.loads(first["evidence_json"])
    assert [r["metric"] for r in evidence["sql_facts"]["baseline_deviation"]][0] == "coolant_temp_c"
    assert evidence["sql_facts"]["session_health_score"]["health_score"] == first_score(facts)
    assert evidence["evidence_rows"] == {"deviation_rows": 5, "drift_rows": 12, "correlation_rows": 11}
    assert evidence["recommendations"] == [report.TEXT_RECOMMENDATION]


def first_score(facts):
    return facts.scores.filter("session_id = 1").first()["health_score"]


def test_all_rows_are_in_the_evidence_table(fleet, facts):
    found = report.build_findings(fleet, facts, run_id="r1").filter("session_id = 1")
    rows = report.finding_evidence(facts, "r1").join(found, ["agent_trace_id", "session_id"])
    counted = rows.groupBy("fact").count()
    assert rows_of(counted, "fact", "count") == [
        ("baseline_deviation", 5),
        ("dtc_telemetry_correlation", 11),
        ("fuel_trim_drift", 12),
    ]
    trim = [
        json.loads(r["row_json"])
        for r in rows.filter("fact = 'fuel_trim_drift'").select("row_json", "sort_key").orderBy("sort_key").collect()
    ]
    assert trim[0] == {"ts": "2026-06-01T09:00:00.000Z", "ltft_b1_pct": 4.1, "ltft_30s": 4.1}
    assert trim[-1]["ltft_30s"] == 8.32


def test_replace_and_append_findings(spark, fleet, facts, tmp_path):
    old = conform(
        spark.createDataFrame(
            [(1, 1, "sql_analysis"), (2, 1, "P0171"), (3, 7, "sql_analysis"), (4, 1, None)],
            "finding_id BIGINT, session_id BIGINT, metric_or_code STRING",
        ),
        "findings",
    )
    path = str(tmp_path / "findings")
    export.write_findings(old, path)
    fresh = report.build_findings(fleet, facts, first_id=100)
    renewed = report.replace_findings(export.read_findings(spark, path), fresh)
    assert rows_of(renewed, "finding_id", "session_id") == [
        (100, 1), (101, 2), (2, 1), (3, 7), (4, 1),
    ]
    newest = sessions.latest_finding(renewed)
    assert rows_of(newest, "session_id", "finding_id") == [(1, 100), (2, 101), (7, 3)]


def test_findings_are_renewed_in_place(spark, tmp_path):
    """Only the folders of renewed sessions change, and a second run leaves the same rows."""
    columns = "finding_id BIGINT, session_id BIGINT, metric_or_code STRING, observed STRING"

    def findings(rows):
        return conform(spark.createDataFrame(rows, columns), "findings")

    old = [(i, i, key, "old") for i in range(300) for key in ("sql_analysis", "P0171")]
    path = tmp_path / "findings"
    export.write_findings(findings([*old, (900, None, "sql_analysis", "none"), (901, 5, None, "x")]), str(path))
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    fresh = findings([(1000 + i, i, "sql_analysis", "new") for i in (5, 6, 2000)])
    expected = sorted(
        [r for r in old if r[1] not in (5, 6) or r[2] != "sql_analysis"]
        + [(901, 5, None, "x"), (1005, 5, "sql_analysis", "new"), (1006, 6, "sql_analysis", "new")]
        + [(3000, 2000, "sql_analysis", "new"), (900, None, "sql_analysis", "none")],
        key=str,
    )
    for _ in range(2):
        export.renew_findings(str(path), fresh)
        stored = export.read_findings(spark, str(path)).select("finding_id", "session_id", "metric_or_code", "observed")
        assert sorted(map(tuple, stored.collect()), key=str) == expected
        after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
        changed = {f.parent.name for f in {*before} ^ {*after}} | {f.parent.name for f in before if f in after and before[f] != after[f]}
        assert 1 <= len(changed) <= 3
    export.renew_findings(str(path), fresh.limit(0))
    assert {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")} == after


def test_fact_summary(fleet, facts):
    lines = report.session_fact_summary(facts, fleet.telemetry_samples).filter("session_id = 1")
    assert rows_of(lines, "query", "output") == [
        ("baseline_deviation", "0.0% outside band for coolant_temp_c (warm)"),
        ("dtc_telemetry_correlation", "11 correlated sensor rows"),
        ("fuel_trim_drift", "Latest rolling trim 8.32%"),
        ("session_health_score", "Score 81.0; metric penalties 9.0; fault penalties 10.0"),
    ]


def test_quality_checks(fleet):
    checks = report.quality_checks(
        fleet, {"telemetry_samples": 24, "dtc_events": 3, "baselines": 10}, control_words=("Corvette",)
    )
    assert rows_of(checks.filter("NOT ok"), "check", "actual") == [
        ("control rows among public vehicles", "1"),
        ("rows in dtc_events", "2"),
        ("session sources", "csv,public"),
    ]


def test_measures_and_windows(fleet, facts):
    overview = sessions.session_overview(
        fleet.drive_sessions, fleet.vehicles, fleet.telemetry_samples, fleet.dtc_events
    )
    measures = report.fleet_measures(facts.scores, overview).first()
    assert (measures["average_health_score"], measures["total_telemetry_samples"]) == (77.5, 24)
    window = report.drive_window(facts.scores).filter("session_id = 1").first()
    assert (window["duration_sec"], window["duration"]) == (11, "11s")
    assert window["sample_pace"] == "0.9s per row"


def test_drive_window_texts(spark):
    def at(seconds):
        return datetime.fromtimestamp(1_767_225_600 + seconds)

    rows = [(1, 10, 0, 75.5), (2, 10, 5, 5), (3, 10, 9, 2), (4, 0, 0, 60)]
    scores = spark.createDataFrame(
        [(s, n, at(a), at(b)) for s, n, a, b in rows] + [(5, 0, None, None)],
        "session_id BIGINT, telemetry_samples BIGINT, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ",
    )
    got = rows_of(report.drive_window(scores), "session_id", "duration_sec", "duration", "sample_pace")
    assert got == [
        (1, 76, "1m 16s", "7.6s per row"),
        (2, 0, "—", "—"),
        (3, 0, "—", "—"),
        (4, 60, "1m 00s", "—"),
        (5, 0, "—", "—"),
    ]


def test_provenance(fleet):
    args = (fleet.drive_sessions, fleet.vehicles)
    row = sessions.provenance_records(*args).first()
    assert row["drive_label"] == "Traffic Jam Log"
    assert row["source_file"] == "2018-03-26_Seat_Leon.csv"
    assert row["dataset_name"] == "KIT/RADAR Automotive OBD-II Dataset"
    assert row["license"] == "e=CC BY 4."
    assert sessions.provenance_records(*args, clean_license=True).first()["license"] == "CC BY 4.0"


def test_text_functions(spark):
    cells = ["1,234.5 rpm", "-7C", ".5", "1e3", "NaN", "", None, "+3"]
    df = spark.createDataFrame([(c,) for c in cells], "c STRING")
    numbers = [r[0] for r in df.select(first_number(F.col("c"))).collect()]
    assert numbers == [1234.5, -7.0, 5.0, 1.0, None, None, None, 3.0]
    files = ["carOBD live1.CSV (x); y.csv", "log.txt ; trip=1", " plain ", "a.csv"]
    df = spark.createDataFrame([(c,) for c in files], "c STRING")
    cleaned = [r[0] for r in df.select(clean_source_file(F.col("c"))).collect()]
    assert cleaned == ["carOBD live1.CSV", "log.txt", "plain", "a.csv"]
    df = spark.createDataFrame([(0.125,), (None,), (12.0,), (0.0003,)], "x DOUBLE")
    assert [r[0] for r in df.select(decimal_text("x", 2)).collect()] == ["0.13", "0.00", "12.00", "0.00"]
    assert [r[0] for r in df.select(number_text("x")).collect()] == ["0.125", None, "12.0", "0.0003"]


def test_bi_pack_and_views(spark, fleet, tmp_path):
    export.export_bi_pack(fleet, str(tmp_path / "bi"))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "bi" / name))
    scores = read("health_scores")
    assert scores.columns == list(export.HEALTH_COLUMNS)
    assert scores.columns == sorted(scores.columns)
    assert scores.first()["started_at"] == "2026-06-02T18:30:00.000Z"
    assert {name: read(name).count() for name in export.EXPORT_ORDER} == {
        "vehicles": 1, "drive_sessions": 1, "telemetry_samples": 12, "dtc_events": 1,
        "baselines": 5, "session_overview": 1, "health_scores": 1, "baseline_deviation": 5,
        "fuel_trim_drift": 12, "airflow_trend": 12, "dtc_telemetry_correlation": 11, "findings": 0,
    }
    export.export_session_views(fleet, str(tmp_path / "views"))
    files = list((tmp_path / "views").glob("*.json"))
    view = json.loads("".join(f.read_text() for f in files))
    assert view["session_id"] == 2 and view["focus"]["health_score"] == "74.0"
    assert len(view["healthMatrix"]) == 5 and len(view["dtcEvidence"]) == 6
    assert len(view["trend"]) == 12 and view["trend"][0]["maf_30s"] == "5.40"
    assert view["dtcSummary"] == report.TEXT_DTC_ROWS and view["agentTraceId"].startswith("agent-")


def test_dashboard_traces_its_findings(spark, fleet, tmp_path):
    out = str(tmp_path / "dashboard")
    export.export_dashboard(fleet, out, run_id="r9", first_finding_id=50)
    views = spark.read.json(f"{out}/views")
    found = export.read_findings(spark, f"{out}/findings").filter("finding_id >= 50")
    assert rows_of(found, "session_id", "agent_trace_id") == rows_of(views, "session_id", "agentTraceId")
    assert spark.read.json(f"{out}/index").first()["defaultSessionId"] == 2
    assert {n: spark.read.json(f"{out}/{n}").count() for n in ("sessions", "entries", "records")} == {
        "sessions": 1, "entries": 1, "records": 1,
    }


def test_whole_scores(spark):
    rows = [("88.0",), ("87.5",), ("-0.5",), ("n/a",), ("NaN",), (None,)]
    df = spark.createDataFrame(rows, "t STRING")
    got = df.select(whole_score(F.col("t")), whole_width(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("88", "88%"), ("88", "88%"), ("0", "0%"), ("n/a", "0%"), ("NaN", "0%"), (None, "0%"),
    ]
