"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.config import load_score_config
from gaugeflow.functions.text import iso_text, whole_score, whole_width
from gaugeflow.operators import bands as B
from gaugeflow.operators import deviation as D
from gaugeflow.operators import faults as X
from gaugeflow.operators import profile as P
from gaugeflow.operators import sessions as S
from gaugeflow.operators import trends as T
from gaugeflow.operators.ordered import local_shared_folder
from gaugeflow.plans import export as K
from gaugeflow.plans import ingest as I
from gaugeflow.plans import report as R
from gaugeflow.schema import GAUGES, Fleet, load_tables, write_tables
from gaugeflow.sources import drive_logs as L
from gaugeflow.streaming import correlation, live, score, trim
from gaugeflow.testing import views as V

# The test events are minutes apart, so the fault window is one hour here and the
# rolling means keep ten digits instead of two.  A mean of at most 31 of these values
# ends after nine digits or never, so ten digits leave no ties for engines to differ on.
HALF_WINDOW = 3600
SCALE = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local_shared_folder(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def on_fleet(name: str, fn: Callable[[Fleet], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local_shared_folder(spark)
        return fn(V.fleet(spark, sf_dir))

    QUERIES[name] = run


def _deviation(f: Fleet) -> DataFrame:
    return D.baseline_deviation(f.telemetry_samples, f.drive_sessions, f.baselines)


def _scores(f: Fleet) -> DataFrame:
    return D.session_health_score(
        f.drive_sessions, f.telemetry_samples, f.dtc_events, f.baselines
    )


def _scored(f: Fleet) -> tuple[DataFrame, DataFrame]:
    """Scores and deviation rows from one set of counts."""
    deviation = _deviation(f)
    scores = D.session_health_score(
        f.drive_sessions, f.telemetry_samples, f.dtc_events, f.baselines, counts=deviation
    )
    return scores, deviation


def _scored_rollup(f: Fleet) -> tuple[DataFrame, DataFrame]:
    scores, deviation = _scored(f)
    return scores, D.baseline_rollup(deviation)


def _points(f: Fleet) -> DataFrame:
    return T.airflow_points(f.telemetry_samples, SCALE)


def _near(f: Fleet) -> DataFrame:
    return X.dtc_telemetry_correlation(f.dtc_events, f.telemetry_samples, HALF_WINDOW)


def _facts(f: Fleet, keep: bool = False) -> R.Facts:
    return R.compute_facts(f, half_window=HALF_WINDOW, scale=SCALE, keep=keep)


# -- sources and ingest -------------------------------------------------------------------

_CSV_HEADERS = {
    "rpm": "Engine RPM (rpm)",
    "speed_kph": "Vehicle Speed(km/h)",
    "engine_load_pct": "Engine_Load (%)",
    "coolant_temp_c": "coolant temp(C)",
    "maf_gps": "MAF(g/s)",
    "ltft_b1_pct": "Long  Fuel Trim 1",
    "dtc_code": "Trouble Code",
}


@query
def scan_drive_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header styles written as CSV and read back as one table."""
    ev = V.events(spark, sf_dir)
    # Plain digits: an exponent in a cell is not read as part of the number.
    plain_digits = {
        g: F.expr(f"CASE WHEN {g} IS NOT NULL THEN format_string('%.20f', {g}) END")
        for g in GAUGES
    }
    rows = V.drive_rows(ev).withColumns({"ts": iso_text("ts"), **plain_digits})
    folder = V.scratch(spark, "drive-csv")
    even = F.col("line_no") % 2 == 0
    plain = rows.filter(even).drop("source_file", "block_start", "line_no")
    plain.write.option("header", True).csv(f"{folder}/plain")
    rows.filter(~even).select(
        F.concat("ts").alias("Time"),
        F.concat("rpm", F.lit(" rpm")).alias(_CSV_HEADERS["rpm"]),
        F.coalesce("speed_kph", F.lit("NaN")).alias(_CSV_HEADERS["speed_kph"]),
        *[
            F.col(c).alias(_CSV_HEADERS[c])
            for c in ("engine_load_pct", "coolant_temp_c", "maf_gps", "ltft_b1_pct", "dtc_code")
        ],
    ).write.option("header", True).csv(f"{folder}/named")
    scanned = L.scan_drive_csv(spark, [f"{folder}/plain", f"{folder}/named"])
    return scanned.select("ts", *GAUGES, *L.FAULT_FIELDS)


def _ingested(spark: SparkSession, sf_dir: str) -> Fleet:
    return I.ingest_drives(
        V.drive_rows(V.events(spark, sf_dir)), V.drive_sources(spark, sf_dir), V.profiles(spark)
    )


@query
def ingest_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ingest_counts(_ingested(spark, sf_dir))


@query
def ingest_drive_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).drive_sessions


@query
def ingest_drive_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).telemetry_samples


@query
def ingest_drive_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).vehicles


@query
def ingest_drive_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).baselines


@query
def ingest_drive_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).dtc_events


@query
def ingest_tagged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = V.drive_sources(spark, sf_dir).withColumn(
        "session_notes", F.when(F.col("source_order") % 2 == 0, F.col("session_notes"))
    )
    return I.ingest_tagged_source(
        V.drive_rows(V.events(spark, sf_dir)), sources, V.profiles(spark)
    ).drive_sessions.select("session_id", "source", "ambient_c", "notes")


@query
def explode_dtc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir).withColumn(
        "ts", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    )
    return I.explode_dtc_codes(V.drive_rows(ev)).select(
        "source_file", "ts", "code", "status", "description"
    )


@query
def scan_fuzzy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten gauges by header fragment; the air flow cell carries the row's number."""
    k = F.col("k")
    folder = V.scratch(spark, "fuzzy-csv")
    V.events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("Mass_Air_Flow row"),
        (k + 700).cast("string").alias("Engine Speed (rpm)"),
        k.cast("string").alias("GPS speed"),
        F.when(k % 3 == 0, "NaN").otherwise(k.cast("string")).alias("Vehicle_Speed"),
        (k + 1).cast("string").alias("Calculated_Load value"),
        F.when(k % 5 == 0, "None").otherwise((k + 50).cast("string")).alias("Engine Coolant Temp"),
        F.when(k % 7 == 0, "  ").otherwise((k + 9).cast("string")).alias("IAT"),
        (k + 2).cast("string").alias("Ignition_Timing"),
        (k + 3).cast("string").alias("Throttle_Pos, rel"),
        (k + 4).cast("string").alias("STFT b1"),
        (k + 5).cast("string").alias("Long  Term Fuel 1"),
    ).write.option("header", True).csv(folder)
    return L.scan_fuzzy_csv(spark, folder).drop("source_file", "block_start", "line_no")


@query
def scan_staggered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staggered logs as files, one folder per day; names carry the date."""
    folder = V.scratch(spark, "staggered-csv")
    names = L.STAGGERED_COLUMNS
    V.events(spark, sf_dir).select(
        F.date_format("ts", "HH:mm:ss.SSS").alias("Time"),
        *[
            F.when(F.col("k") % 6 == at, F.col("event_id").cast("string")).alias(source)
            for at, source in enumerate(names.values())
        ],
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    ).write.partitionBy("day").option("header", True).csv(folder)
    # The reader takes the date from the file name, here from the folder's.
    raw = L.scan(spark, folder, ["time", *names], lambda n: L.match_exact(n, {"time": "Time", **names}))
    day = F.regexp_extract("source_file", "day=([0-9-]+)", 1)
    named = raw.withColumn("source_file", F.concat(day, F.lit("_Car_RT.csv")))
    return L.timestamp_from_filename(named).select("ts", *names)


@query
def pick_warm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.warm_rows(V.events(spark, sf_dir))
    return L.pick_warm_window(rows, 20, 80.0).select(
        "source_file", "line_no", "position", "window_row", "rpm", "coolant_temp_c"
    )


@query
def regrid_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.warm_rows(V.events(spark, sf_dir))
    return L.regrid_1hz(L.pick_warm_window(rows, 20, 80.0)).select("source_file", "line_no", "ts")


_READINGS = tuple(L.STAGGERED_COLUMNS)


@query
def forward_fill_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.staggered_rows(V.events(spark, sf_dir))
    return L.forward_fill_readings(rows).select("source_file", "line_no", *_READINGS)


@query
def warm_start_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = L.forward_fill_readings(V.staggered_rows(V.events(spark, sf_dir)))
    return L.warm_start_gate(filled, 150.0).select("source_file", "line_no", *_READINGS)


@query
def one_row_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = L.forward_fill_readings(V.staggered_rows(V.events(spark, sf_dir)))
    return L.one_row_per_second(filled).select("source_file", "line_no", "ts", *_READINGS)


@query
def head_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.staggered_rows(V.events(spark, sf_dir))
    return L.staggered_drives(rows, 150.0, 10).select("source_file", "line_no", "ts", *_READINGS)


@query
def timestamp_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    rows = V.events(spark, sf_dir).select(
        F.concat(
            F.lit("file:/logs/"), F.date_format(ts, "yyyy-MM-dd"), F.lit("_Car_"), F.col("user_id"),
            F.lit("_RT.csv"),
        ).alias("source_file"),
        F.concat(F.lit(" "), F.date_format(ts, "HH:mm:ss.SSS")).alias("time"),
        "event_id",
    )
    return L.timestamp_from_filename(rows).select("event_id", "source_file", "ts")


@query
def scan_week_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    day = V.day_of(F.col("ts"))
    folder = V.scratch(spark, "week-csv")
    V.events(spark, sf_dir).select(
        F.col("user_id").alias("VehId"),
        (k % 5).alias("Trip"),
        (day + F.lit(1) + (k % 4) / 4).alias("DayNum"),
        (F.col("event_id") * 100 + F.lit(0.5)).alias("Timestamp(ms)"),
        F.when(k % 11 == 0, "NA").otherwise((k + 900).cast("string")).alias("Engine RPM[RPM]"),
        k.alias("Vehicle Speed[km/h]"),
        F.when(k % 13 == 0, "").otherwise((k + 5).cast("string")).alias("Absolute Load[%]"),
        F.when(k % 17 == 0, "NaN").otherwise((k + 3).cast("string")).alias("MAF[g/sec]"),
        F.when(k % 2 == 0, "na").otherwise(k.cast("string")).alias("OAT[DegC]"),
        F.lit("NaN").alias("Short Term Fuel Trim Bank 1[%]"),
        k.alias("Long Term Fuel Trim Bank 1[%]"),
    ).write.option("header", True).csv(folder)
    trips = L.week_trips(L.scan_week_export(spark, folder))
    return L.as_samples(trips).select(
        F.col("veh_id").cast("bigint").alias("veh_id"),
        F.col("trip").cast("bigint").alias("trip"),
        "ts",
        "rpm",
        "speed_kph",
        "engine_load_pct",
        "maf_gps",
        "intake_temp_c",
        "stft_b1_pct",
        "ltft_b1_pct",
    )


on_fleet(
    "engine_class",
    lambda f: f.vehicles.select(
        "vehicle_id", "engine", B.engine_class(F.col("engine")).alias("engine_class")
    ),
)
on_fleet(
    "class_load_profiles",
    lambda f: B.class_load_profiles(f.telemetry_samples, f.drive_sessions, f.vehicles),
)
on_fleet(
    "engine_load_band",
    lambda f: B.engine_load_band(f.vehicles, V.profiles(f.vehicles.sparkSession)),
)
on_fleet(
    "reference_baselines",
    lambda f: B.reference_baselines(f.vehicles, V.profiles(f.vehicles.sparkSession)),
)
on_fleet(
    "session_derived_baselines",
    lambda f: B.session_derived_baselines(f.drive_sessions, f.telemetry_samples),
)


@query
def load_score_config_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties taken from the tables, written as a settings file, loaded and applied."""
    f = V.fleet(spark, sf_dir)
    path = V.scratch(spark, "config")
    f.vehicles.agg(
        F.lit("from data").alias("label"),
        (F.countDistinct("make") * 2.0).alias("metric_penalty_points"),
        (F.countDistinct("make") / 8.0).alias("pending_dtc_penalty"),
        ((F.countDistinct("make") + 4.0) / 8.0).alias("stored_dtc_penalty"),
        ((F.countDistinct("make") + 9.0) / 8.0).alias("permanent_dtc_penalty"),
        F.lit(5.0).alias("score_floor"),
        F.lit(90.0).alias("score_ceiling"),
    ).write.json(path)
    config = load_score_config(spark, path)
    return D.session_health_score(
        f.drive_sessions, f.telemetry_samples, f.dtc_events, f.baselines, config
    ).select("session_id", "health_score", "metric_penalty_points", "dtc_penalty_points", "score_basis")


@query
def load_tables_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the six tables, load them, score from the loaded tables."""
    root = V.scratch(spark, "tables")
    write_tables(V.fleet(spark, sf_dir), root)
    return _scores(load_tables(spark, root))


# -- analytical queries ---------------------------------------------------------------------

on_fleet("baseline_deviation", _deviation)
on_fleet("fuel_trim_drift", lambda f: T.fuel_trim_drift(f.telemetry_samples, SCALE))
# The same trend with a low limit, so that every session takes the path for long ones.
on_fleet(
    "fuel_trim_drift_in_runs", lambda f: T.fuel_trim_drift(f.telemetry_samples, SCALE, limit=40)
)


@query
def fuel_trim_drift_two_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend at its default precision, over whole numbers, whose sums are exact."""
    samples = V.events(spark, sf_dir).select(
        F.col("event_id").alias("sample_id"),
        F.col("user_id").alias("session_id"),
        "ts",
        F.col("k").cast("double").alias("ltft_b1_pct"),
    )
    return T.fuel_trim_drift(samples)


on_fleet("dtc_telemetry_correlation", _near)
on_fleet("session_baselines", lambda f: S.session_baselines(f.drive_sessions, f.baselines))
on_fleet("session_dtc_events", lambda f: X.session_dtc_events(f.dtc_events))
on_fleet("session_health_score", _scores)
on_fleet(
    "session_overview",
    lambda f: S.session_overview(
        f.drive_sessions, f.vehicles, f.telemetry_samples, f.dtc_events
    ),
)


@query
def session_overview_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview over the largest table pair: orders as sessions, lines as samples."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sessions = orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("vehicle_id"),
        F.lit("csv").alias("source"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderdate").alias("ended_at"),
    )
    samples = lines.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("sample_id")
    )
    faults = lines.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("session_id")
    )
    return S.session_overview(sessions, V.vehicles_of(customers), samples, faults)


@query
def baseline_deviation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation over the largest table: order lines as samples, two gauges."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    samples = lines.select(
        F.col("l_orderkey").alias("session_id"),
        (F.col("l_quantity") * 2).alias("coolant_temp_c"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("engine_load_pct"),
    )
    sessions = orders.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("vehicle_id")
    )
    bands = V.bands_of(V.vehicles_of(customers))
    return D.baseline_deviation(
        samples, sessions, bands, metrics=("coolant_temp_c", "engine_load_pct")
    )


on_fleet("airflow_trend", lambda f: T.airflow_trend(f.telemetry_samples, SCALE))
on_fleet("airflow_trend_sampled", lambda f: T.airflow_trend_sampled(f.telemetry_samples, SCALE))
on_fleet("dtc_evidence", lambda f: _near(f).drop("dtc_id", "sample_id"))
on_fleet("dtc_evidence_panel", lambda f: X.dtc_evidence_panel(f.drive_sessions, _near(f)))
on_fleet("baseline_rollup", lambda f: D.baseline_rollup(_deviation(f)))
on_fleet(
    "session_focus",
    lambda f: S.session_focus(f.drive_sessions, f.vehicles, *_scored_rollup(f)),
)
on_fleet(
    "session_list",
    lambda f: S.session_list(f.drive_sessions, f.vehicles, *_scored_rollup(f)),
)
on_fleet(
    "default_session",
    lambda f: S.default_session(f.drive_sessions, _scores(f), f.telemetry_samples),
)
on_fleet("provenance_records", lambda f: S.provenance_records(f.drive_sessions, f.vehicles))
on_fleet("public_source_entries", lambda f: S.public_source_entries(f.drive_sessions))
on_fleet("latest_finding", lambda f: S.latest_finding(f.findings))
on_fleet("sessions_by_label", lambda f: S.sessions_by_label(f.drive_sessions, "Traffic Jam Log"))
on_fleet("preferred_band", lambda f: B.preferred_band(f.baselines))
on_fleet(
    "single_metric_deviation",
    lambda f: D.single_metric_deviation(f.telemetry_samples, f.drive_sessions, f.baselines),
)
on_fleet("public_vehicles", lambda f: S.public_vehicles(f.vehicles, f.drive_sessions))
on_fleet("public_drive_sessions", lambda f: S.public_drive_sessions(f.drive_sessions, f.vehicles))
on_fleet(
    "public_telemetry", lambda f: S.public_telemetry(f.telemetry_samples, f.drive_sessions)
)
on_fleet("public_dtc_events", lambda f: S.public_dtc_events(f.dtc_events, f.drive_sessions))
on_fleet("public_baselines", lambda f: S.public_baselines(f.baselines, f.drive_sessions))
on_fleet("public_findings", lambda f: S.public_findings(f.findings, f.drive_sessions))


@query
def session_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers as requested ids; only those below the customer count exist."""
    f = V.fleet(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("session_id")
    )
    return S.session_exists(asked, f.drive_sessions)


# -- scoring, rules and reports ---------------------------------------------------------------

on_fleet("health_matrix", lambda f: P.health_matrix(*_scored(f), _points(f)))
on_fleet("baseline_fit_score", lambda f: P.baseline_fit_score(*_scored(f)))
on_fleet("sensor_balance_score", lambda f: P.sensor_balance_score(*_scored(f)))
on_fleet("fault_clearance_score", lambda f: P.fault_clearance_score(_scores(f)))
on_fleet(
    "airflow_stability_score",
    lambda f: P.airflow_stability_score(_points(f)).withColumn("airflow", F.round("airflow", 1)),
)
on_fleet(
    "performance_concerns",
    lambda f: P.performance_concerns(*_scored(f), _points(f)),
)
on_fleet(
    "axis_ranking",
    lambda f: P.axis_ranking(P.health_matrix(*_scored(f), _points(f))),
)


@query
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.fleet(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("session_id")
    )
    return R.session_report(f, _facts(f), asked)


_BANDS_OF_FINDING = (
    "array<struct<metric:string,context:string,sample_count:bigint,"
    "out_of_range_samples:bigint,pct_out_of_range:double>>"
)


@query
def build_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without run time and run id, and what their evidence says."""
    f = V.fleet(spark, sf_dir)
    found = R.build_findings(f, _facts(f, keep=True))

    def of(column: str, path: str, kind: str = "string"):
        return F.get_json_object(column, path).cast(kind)

    scored = ("health_score", "metric_penalty_points", "dtc_penalty_points")
    return found.select(
        "finding_id",
        "session_id",
        "severity",
        "category",
        "metric_or_code",
        *[of("observed", f"$.{c}", "double").alias(f"observed_{c}") for c in scored],
        of("observed", "$.started_at").alias("observed_start"),
        "expected_range",
        "likely_cause",
        "recommended_fix",
        "confidence",
        of("evidence_json", "$.sql_facts.session_health_score.health_score", "double").alias(
            "fact_score"
        ),
        of("evidence_json", "$.dtc_summary").alias("dtc_summary"),
        of("evidence_json", "$.correlation_summary").alias("correlation_summary"),
        of("evidence_json", "$.recommendations[0]").alias("recommendation"),
        *[
            of("evidence_json", f"$.evidence_rows.{c}", "bigint").alias(c)
            for c in ("deviation_rows", "drift_rows", "correlation_rows")
        ],
        F.col("agent_trace_id").rlike("^agent-[0-9a-f]{32}$").alias("trace_ok"),
    )


@query
def finding_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation rows inside the findings' evidence, in their order."""
    f = V.fleet(spark, sf_dir)
    rows = F.from_json(
        F.get_json_object("evidence_json", "$.sql_facts.baseline_deviation"), _BANDS_OF_FINDING
    )
    return R.build_findings(f, _facts(f, keep=True)).select(
        "session_id", F.posexplode(rows).alias("place", "band")
    ).select("session_id", "place", "band.*")


_EVIDENCE_ROW = (
    "metric STRING, context STRING, sample_count BIGINT, out_of_range_samples BIGINT, "
    "pct_out_of_range DOUBLE, ts STRING, ltft_b1_pct DOUBLE, ltft_30s DOUBLE, code STRING, "
    "status STRING, description STRING, fault_ts STRING, rpm DOUBLE, engine_load_pct DOUBLE, "
    "coolant_temp_c DOUBLE"
)


@query
def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence row, read from its JSON, and its trace id."""
    f = V.fleet(spark, sf_dir)
    return (
        R.finding_evidence(_facts(f), "run")
        .withColumn("row", F.from_json("row_json", _EVIDENCE_ROW))
        .select("session_id", "fact", "agent_trace_id", "row.*")
    )


_FINDING = ("finding_id", "session_id", "metric_or_code", "observed")


def _fresh_findings(f: Fleet) -> DataFrame:
    analysed = F.col("metric_or_code") == "sql_analysis"
    old = S.public_findings(f.findings, f.drive_sessions).filter(analysed)
    return old.withColumn("finding_id", F.col("finding_id") + 1_000_000_000)


@query
def replace_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.fleet(spark, sf_dir)
    return R.replace_findings(f.findings, _fresh_findings(f)).select(*_FINDING)


@query
def renew_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table renewed in place, twice."""
    f = V.fleet(spark, sf_dir)
    path = V.scratch(spark, "renewed-findings")
    K.write_findings(f.findings, path)
    fresh = _fresh_findings(f)
    K.renew_findings(path, fresh)
    K.renew_findings(path, fresh)
    return K.read_findings(spark, path).select(*_FINDING)


on_fleet(
    "session_fact_summary",
    lambda f: R.session_fact_summary(_facts(f), f.telemetry_samples, SCALE),
)


@query
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_checks(
        V.fleet(spark, sf_dir),
        {
            "telemetry_samples": 744, "dtc_events": 2, "baselines": 25, "public_sessions": 3,
            "public_samples": 720,
        },
        control_words=("Synthetic", "Corvette"),
    )


on_fleet(
    "fleet_measures",
    lambda f: R.fleet_measures(
        _scores(f),
        S.session_overview(f.drive_sessions, f.vehicles, f.telemetry_samples, f.dtc_events),
    ),
)
on_fleet("drive_window", lambda f: R.drive_window(_scores(f)))
on_fleet(
    "score_display",
    lambda f: S.session_focus(f.drive_sessions, f.vehicles, *_scored_rollup(f)).select(
        "session_id",
        whole_score(F.col("metric_penalty_points")).alias("whole"),
        whole_width(F.col("metric_penalty_points")).alias("width"),
        whole_score(F.col("drive_label")).alias("other"),
        whole_width(F.col("drive_label")).alias("other_width"),
    ),
)
on_fleet("trend_axes", lambda f: R.trend_axes(f.drive_sessions, _points(f)))


# -- sinks ------------------------------------------------------------------------------------


@query
def export_bi_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the twelve CSV tables and read every cell back.

    One row per filled cell: table, its row's first sort key, column, and value, numbers
    with ten digits.
    """
    out = V.scratch(spark, "bi-pack")
    K.export_bi_pack(V.fleet(spark, sf_dir), out, half_window=HALF_WINDOW, scale=SCALE)
    number = r"^-?\d+\.\d+([eE]-?\d+)?$"
    result = None
    for name, order in K.EXPORT_ORDER.items():
        table = spark.read.option("header", True).option("escape", '"').csv(f"{out}/{name}")
        cells = table.withColumn("_key", F.col(order[0])).unpivot("_key", table.columns, "field", "value")
        plain = F.col("value").cast("double").cast("decimal(38,10)").cast("string")
        part = cells.filter(F.col("value").isNotNull()).select(
            F.lit(name).alias("name"),
            F.col("_key").alias("row_key"),
            "field",
            F.when(F.col("value").rlike(number), plain).otherwise(F.col("value")).alias("value"),
        )
        result = part if result is None else result.unionByName(part)
    return result


_PANEL = ("code", "status", "description", "fault_ts", "ts", "rpm", "engine_load_pct", "coolant_temp_c")


@query
def export_session_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the nested JSON views and read them back, each array as one text."""

    def shown(name: str, *fields: str):
        entry = F.transform(name, lambda e: F.concat_ws("|", *[e[f] for f in fields]))
        return F.array_join(entry, "\n").alias(name)

    out = V.scratch(spark, "views")
    K.export_session_views(
        V.fleet(spark, sf_dir), out, run_id="run", half_window=HALF_WINDOW, scale=SCALE
    )
    views = spark.read.json(out)
    return views.select(
        "session_id",
        F.col("focus.vehicle").alias("vehicle"),
        F.col("focus.health_score").alias("health_score"),
        shown("trend", "ts", "speed_kph", "maf_gps", "maf_30s", "height_pct"),
        shown("dtcEvidence", *_PANEL),
        shown("healthMatrix", "id", "label", "value"),
        shown("performanceConcerns", "level", "text"),
        "agentTraceId",
        "dtcSummary",
    )


@query
def export_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, views and index written together: their links, read back."""
    f = V.fleet(spark, sf_dir)
    out = V.scratch(spark, "dashboard")
    K.export_dashboard(
        f, out, first_finding_id=1_000_000_000, half_window=HALF_WINDOW, scale=SCALE
    )
    stored = K.read_findings(spark, f"{out}/findings").filter("finding_id >= 1000000000")
    views = spark.read.json(f"{out}/views").select("session_id", "agentTraceId")
    lists = {n: spark.read.json(f"{out}/{n}") for n in ("sessions", "entries", "records")}
    first = spark.read.json(f"{out}/index").select(
        F.col("defaultSessionId").alias("session_id"), F.lit(True).alias("opens")
    )
    return (
        lists["sessions"]
        .select("session_id", "vehicle", "drive_label", "health_score", "baseline_width")
        .join(lists["entries"], "session_id")
        .join(lists["records"].select("session_id", "dataset_name", "license"), "session_id")
        .join(views, "session_id")
        .join(stored.select("session_id", "agent_trace_id"), "session_id")
        .join(first, "session_id", "left")
        .select(
            "session_id", "vehicle", "drive_label", "health_score", "baseline_width", "source_file",
            "dataset_name", "license", (F.col("agentTraceId") == F.col("agent_trace_id")).alias("traced"),
            F.coalesce("opens", F.lit(False)).alias("opens"),
        )
    )


@query
def export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a BI pack and a dashboard, one of whose words is in some notes."""
    f = V.fleet(spark, sf_dir)
    pack, board = V.scratch(spark, "checked-pack"), V.scratch(spark, "checked-dashboard")
    K.export_bi_pack(f, pack, half_window=HALF_WINDOW, scale=SCALE)
    K.export_dashboard(f, board, half_window=HALF_WINDOW, scale=SCALE)
    words = ("Synthetic", "trip_ref=9;")
    return R.export_checks(spark, pack, board, tuple(K.EXPORT_ORDER), words)


@query
def write_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append twice, read back."""
    f = V.fleet(spark, sf_dir)
    path = V.scratch(spark, "findings")
    K.write_findings(f.findings.filter(F.col("finding_id") % 2 == 0), path)
    K.write_findings(f.findings.filter(F.col("finding_id") % 2 == 1), path)
    return K.read_findings(spark, path)


@query
def write_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.fleet(spark, sf_dir)
    path = V.scratch(spark, "profiles")
    K.write_profiles(
        B.class_load_profiles(f.telemetry_samples, f.drive_sessions, f.vehicles), path
    )
    return K.read_profiles(spark, path)


# -- streams -----------------------------------------------------------------------------------


# Rows of a third of the events that are worth a file of their own.
ROWS_A_FILE = 250_000


def _event_stream(spark: SparkSession, sf_dir: str, closing: bool = False) -> DataFrame:
    """Events in three parts, one micro-batch each; every seventh event comes a part late.

    A part is one file, or as many as its rows need, so that a batch is read by many tasks and
    batches don't become more with the input.  A ``closing`` event a century on lets the
    watermark pass all others, and stays open itself.
    """
    folder = V.scratch(spark, "event-stream")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    third = F.floor(V.day_of(F.col("ts")) / 10) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    part_of = F.least(third, F.lit(2))
    most = ev.groupBy(part_of.alias("part")).count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-most // ROWS_A_FILE))
    for part in range(3):
        ev.filter(part_of == part).repartition(files).write.parquet(f"{folder}/{part}")
    if closing:
        later = F.col("ts") + F.expr("INTERVAL 100 YEARS")
        ev.limit(1).withColumn("ts", later).write.parquet(f"{folder}/3")
    raw = (
        spark.readStream.schema(ev.schema)
        .option("maxFilesPerTrigger", files)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(folder)
    )
    return V.with_k(raw)


@query
def live_readings_to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_readings_to_samples(V.readings_of(V.events(spark, sf_dir)))


@query
def live_readings_to_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_readings_to_faults(V.fault_readings_of(V.events(spark, sf_dir)))


@query
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.fleet(spark, sf_dir)
    declared = f.drive_sessions.join(f.vehicles.select("vehicle_id", "vin"), "vehicle_id")
    return live.live_sessions(V.fault_readings_of(V.events(spark, sf_dir)), declared)


@query
def read_only_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    guarded = live.read_only_guard(V.fault_readings_of(V.events(spark, sf_dir)))
    return guarded.select("session_id", "ts", "command", "quarantine")


@query
def missing_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.missing_commands(V.fault_readings_of(V.events(spark, sf_dir)))


@query
def stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in three batches, some of them ten days late."""
    root = V.scratch(spark, "stream-samples")
    live.stream_samples(V.readings_of(_event_stream(spark, sf_dir, closing=True)), root)
    return live.read_samples(spark, root).drop("parts")


@query
def stream_dtc_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay covers the ten days that an event may be late."""
    out, progress = V.scratch(spark, "stream-faults"), V.scratch(spark, "progress")
    pairs = correlation.stream_dtc_correlation(
        V.faults_of(_event_stream(spark, sf_dir)),
        V.samples_of(_event_stream(spark, sf_dir)),
        HALF_WINDOW,
        delay="21 days",
    )
    live.run_to_parquet(pairs, out, progress)
    return spark.read.parquet(out)


@query
def stream_session_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.fleet(spark, sf_dir)
    root = V.scratch(spark, "stream-score")
    score.stream_session_score(
        V.samples_of(_event_stream(spark, sf_dir)),
        V.faults_of(_event_stream(spark, sf_dir)),
        f.drive_sessions,
        f.baselines,
        root,
    )
    return score.current_scores(spark, root, f.drive_sessions)


@query
def stream_rolling_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = V.scratch(spark, "stream-trim")
    trim.stream_rolling_trim(V.samples_of(_event_stream(spark, sf_dir)), root, SCALE)
    return trim.read_trend(spark, root)
