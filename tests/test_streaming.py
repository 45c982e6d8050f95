"""Streams replayed over several files: stream result = batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import rows_of
from gaugeflow.operators import deviation, faults, trends
from gaugeflow.streaming import correlation, live, score, tables, trim
from gaugeflow.testing import catalog

START = datetime(2026, 1, 1)
SAMPLE = (
    "sample_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, rpm DOUBLE, engine_load_pct DOUBLE, "
    "coolant_temp_c DOUBLE, ltft_b1_pct DOUBLE, stft_b1_pct DOUBLE, timing_adv_deg DOUBLE"
)
FAULT = (
    "dtc_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, code STRING, status STRING, "
    "description STRING"
)


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


@pytest.fixture(scope="module")
def tables_(spark):
    rng = random.Random(8)
    rows, events = [], []
    for i in range(400):
        session = 1 if i % 3 == 0 else rng.randrange(2, 6)
        ts = START + timedelta(milliseconds=400 * i + rng.randrange(300))
        rows.append((i, session, ts, *[rng.randrange(0, 800) / 8 for _ in range(6)]))
        if i % 40 == 0:
            events.append((i, session, ts, "P0171", rng.choice(["stored", "pending", None]), None))
    return spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(events, FAULT)


def _replay(spark, df, folder, parts=3):
    """One file per micro-batch: roughly in time order, every fifth row a batch late."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(
        F.lit(str(START)).cast("timestamp_ntz").cast("timestamp")
    )
    part_of = F.least(
        F.floor(seconds / 55) + F.when(F.pmod(F.xxhash64(*df.columns), F.lit(5)) == 0, 1).otherwise(0),
        F.lit(parts - 1),
    )
    for part in range(parts):
        df.filter(part_of == part).coalesce(1).write.parquet(f"{folder}/p{part}")
    return (
        spark.readStream.schema(df.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


@pytest.fixture(scope="module")
def dims(spark):
    sessions = spark.range(1, 7).selectExpr("id AS session_id", "id AS vehicle_id")
    bands = spark.range(1, 7).selectExpr(
        "id AS vehicle_id",
        "stack(2, 'coolant_temp_c', 'warm', 20D, 80D, 'ltft_b1_pct', 'cruise', -10D, 60D) "
        "AS (metric, context, healthy_min, healthy_max)",
    )
    return sessions, bands


def _in_order(spark, frames, folder):
    """One micro-batch a frame."""
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{folder}/p{k:03}")
    return (
        spark.readStream.schema(frames[0].schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


def test_trim_stream(spark, tables_, tmp_path):
    samples, _ = tables_
    root = str(tmp_path / "state")
    trim.stream_rolling_trim(_replay(spark, samples, tmp_path / "in"), root)
    assert _same(trim.read_trend(spark, root), trends.fuel_trim_drift(samples))
    batches = tables.read(spark, root, "trend", trim._TREND).select("batch").distinct()
    assert batches.count() == 3


TRIM = "sample_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, ltft_b1_pct DOUBLE"


def test_late_rows_change_the_means_after_them(spark, tmp_path):
    rows = [(i, 1, START + timedelta(seconds=i), float(i * i)) for i in range(4)]
    samples = spark.createDataFrame(rows, TRIM)
    root = str(tmp_path / "state")
    parts = ["sample_id IN (0, 2)", "sample_id IN (1, 3)", "sample_id IN (1, 3)"]
    stream = _in_order(spark, [samples.filter(p) for p in parts], tmp_path / "in")
    trim.stream_rolling_trim(stream, root)
    assert rows_of(trim.read_trend(spark, root), "sample_id", "ltft_30s") == [
        (0, 0.0), (1, 0.5), (2, 1.67), (3, 3.5),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_trim_under_any_disorder(spark, tmp_path, seed, monkeypatch):
    """Rows far behind a session's state, missing values, equal times; repairs in the same batch."""
    rng = random.Random(seed)
    rows = [
        (i, i % 3, START + timedelta(seconds=i // 4), None if i % 11 == 0 else rng.randrange(99) / 8)
        for i in range(900)
    ]
    samples = spark.createDataFrame(rows, TRIM)
    late = {i: rng.random() for i in range(900)}
    batch_of = [
        [r for r in rows if min(r[0] // 180 + (rng.randrange(1, 5) if late[r[0]] < 0.1 else 0), 4) == k]
        for k in range(5)
    ]
    assert sorted(r for part in batch_of for r in part) != [] and len(batch_of[4]) > 180
    seen = {r[0] for r in batch_of[0]}
    frames = [spark.createDataFrame([r for r in batch_of[0]], TRIM)]
    for k in range(1, 5):
        frames.append(spark.createDataFrame([r for r in batch_of[k] if r[0] not in seen], TRIM))
        seen |= {r[0] for r in batch_of[k]}
    samples = samples.filter(F.col("sample_id").isin(sorted(seen)))
    repaired = []
    usual = trim._repaired
    monkeypatch.setattr(trim, "_repaired", lambda *a: (repaired.append(a[2]), usual(*a))[1])
    root = str(tmp_path / "state")
    trim.stream_rolling_trim(_in_order(spark, frames, tmp_path / "in"), root)
    assert _same(trim.read_trend(spark, root), trends.fuel_trim_drift(samples))
    assert repaired


def test_sessions_share_a_call(spark, tmp_path, monkeypatch):
    """Sessions of one group, and a few rows without one, keep their own means and rows behind."""
    monkeypatch.setattr(trim, "GROUPS", 1)
    rng = random.Random(3)
    rows = [
        (i, None if i % 50 == 0 else [7, 2**62 + 1, -5, 8][i % 4], START + timedelta(seconds=i // 10),
         None if i % 13 == 0 else rng.randrange(99) / 8)
        for i in range(1000)
    ]
    part = [min(r[0] // 300 + rng.choice([0, 0, 0, 0, 1, 2]), 3) for r in rows]
    frames = [spark.createDataFrame([r for r, p in zip(rows, part) if p == k], TRIM) for k in range(4)]
    root = str(tmp_path / "state")
    trim.stream_rolling_trim(_in_order(spark, frames, tmp_path / "in"), root)
    samples = spark.createDataFrame(rows, TRIM)
    assert _same(trim.read_trend(spark, root), trends.fuel_trim_drift(samples))


def test_a_group_is_worked_on_as_arrays():
    """One call serves all sessions of a group, and its state."""
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    state = State()
    frame = pd.DataFrame({"session": [1, 2, 1], "micros": [5, 5, 4], "sample_id": [1, 1, 1], "ltft_b1_pct": [4.0, 9.0, 2.0]})
    (out,) = trim._follow((0,), iter([frame]), state)
    assert out[["session_id", "micros", "mean"]].values.tolist() == [[1, 4, 2.0], [1, 5, 3.0], [2, 5, 9.0]]
    (out,) = trim._follow((0,), iter([frame.assign(micros=6, ltft_b1_pct=None)[:1]]), state)
    assert out[["session_id", "micros", "mean"]].values.tolist() == [[1, 6, 3.0]] and state.get[4] == []


def test_a_batch_costs_the_same_after_twenty(spark, tmp_path, monkeypatch):
    """In-order batches read nothing that earlier ones wrote, and write no more than before."""
    frames = [
        spark.createDataFrame(
            [(k * 100 + i, i % 7, START + timedelta(seconds=k * 100 + i), i / 4) for i in range(100)],
            TRIM,
        )
        for k in range(21)
    ]
    root = str(tmp_path / "state")
    reads = []
    usual = tables.read
    monkeypatch.setattr(tables, "read", lambda *a: (reads.append(a[2]), usual(*a))[1])
    trim.stream_rolling_trim(_in_order(spark, frames, tmp_path / "in"), root)
    assert reads == []
    per_batch = [
        spark.read.parquet(f"{root}/trend/batch={k}").count() for k in range(21)
    ]
    assert per_batch == [100] * 21
    everything = frames[0]
    for df in frames[1:]:
        everything = everything.unionByName(df)
    assert _same(trim.read_trend(spark, root), trends.fuel_trim_drift(everything))


def test_score_stream(spark, tables_, dims, tmp_path, monkeypatch):
    samples, events = tables_
    sessions, bands = dims
    root = str(tmp_path / "state")
    reads = []
    usual = tables.read
    monkeypatch.setattr(tables, "read", lambda *a: (reads.append(a[2]), usual(*a))[1])
    score.stream_session_score(
        _replay(spark, samples, tmp_path / "s"),
        _replay(spark, events, tmp_path / "f"),
        sessions,
        bands,
        root,
    )
    # No batch reads what earlier ones wrote.
    assert reads == []
    batch = deviation.session_health_score(sessions, samples, events, bands)
    assert _same(score.current_scores(spark, root, sessions), batch)
    written = tables.read(spark, root, "scores", score._SCORES)
    assert written.select("batch").distinct().count() == 3
    assert written.groupBy("session_id", "batch").count().filter("count > 1").isEmpty()


def test_bands_listed_twice_and_none_at_all(spark, tables_, dims, tmp_path):
    samples, events = tables_
    sessions, bands = dims
    odd = bands.filter("vehicle_id <> 3").unionByName(bands.filter("vehicle_id = 1")).unionByName(
        bands.filter("vehicle_id = 2").withColumn("healthy_max", F.lit(None).cast("double"))
    )
    root = str(tmp_path / "state")
    few = samples.withColumn("coolant_temp_c", F.when(F.col("session_id") == 2, None).otherwise(F.col("coolant_temp_c")))
    score.stream_session_score(
        _replay(spark, few, tmp_path / "s"), _replay(spark, events, tmp_path / "f"), sessions, odd, root
    )
    batch = deviation.session_health_score(sessions, few, events, odd)
    assert _same(score.current_scores(spark, root, sessions), batch)


def test_faults_alone_refresh_scores(spark, tables_, dims, tmp_path):
    samples, events = tables_
    sessions, bands = dims
    root = str(tmp_path / "state")
    few = events.filter("dtc_id < 40")
    stream = _replay(spark, few, tmp_path / "f", parts=1)
    empty = _replay(spark, samples.limit(0), tmp_path / "s", parts=1)
    score.stream_session_score(empty, stream, sessions, bands, root)
    refreshed = tables.read(spark, root, "scores", score._SCORES)
    assert rows_of(refreshed, "session_id") == rows_of(few.select("session_id").distinct(), "session_id")
    assert refreshed.filter("health_score < 100").count() == refreshed.count() > 0


def test_correlation_stream(spark, tables_, tmp_path):
    samples, events = tables_
    pairs = correlation.stream_dtc_correlation(
        _replay(spark, events, tmp_path / "f"), _replay(spark, samples, tmp_path / "s"), 5
    )
    live.run_to_parquet(pairs, str(tmp_path / "out"), str(tmp_path / "progress"))
    batch = faults.dtc_telemetry_correlation(events, samples, 5)
    assert _same(spark.read.parquet(str(tmp_path / "out")), batch)


def test_join_state_is_on_disk(spark, tables_, tmp_path):
    samples, events = tables_
    pairs = correlation.stream_dtc_correlation(
        _replay(spark, events, tmp_path / "f"), _replay(spark, samples, tmp_path / "s"), 5
    )
    live.run_to_parquet(pairs, str(tmp_path / "out"), str(tmp_path / "progress"))
    written = {f.suffix for f in (tmp_path / "progress" / "state").rglob("*.*")}
    assert written & {".changelog", ".zip"} and ".delta" not in written


def _poll(session, seconds, value=42.0):
    ts = START + timedelta(seconds=seconds)
    rows = [(session, ts, c, value, None, None, None) for c in live.COMMAND_GAUGES]
    rows.append((session, ts, "VIN", None, " TESTVIN1234567890 ", None, None))
    return rows


READING = (
    "session_id BIGINT, ts TIMESTAMP_NTZ, command STRING, value DOUBLE, text_value STRING, "
    "code STRING, description STRING"
)


@pytest.fixture(scope="module")
def readings(spark):
    end = START + timedelta(seconds=2)
    rows = [
        *_poll(1, 0),
        *_poll(1, 1),
        (1, end, "GET_DTC", None, None, "P0171", "System Too Lean Bank 1"),
        (1, end, "GET_CURRENT_DTC", None, None, "P0301", "Cylinder 1 Misfire Detected"),
        (2, START, "CLEAR_DTC", None, None, None, None),
        (2, START, "RPM", None, None, None, None),
    ]
    return spark.createDataFrame(rows, READING)


def test_live_capture(spark, readings, tmp_path):
    samples = live.live_readings_to_samples(readings)
    one = samples.filter("session_id = 1")
    assert one.count() == 2
    assert {r[g] for r in one.collect() for g in live.COMMAND_GAUGES.values()} == {42.0}
    assert rows_of(live.live_readings_to_faults(readings), "code", "status") == [
        ("P0171", "stored"),
        ("P0301", "pending"),
    ]
    declared = spark.createDataFrame([(1, "OLD"), (2, "KEPT")], "session_id BIGINT, vin STRING")
    sessions = live.live_sessions(readings, declared)
    assert rows_of(sessions, "session_id", "ended_at", "vin") == [
        (1, START + timedelta(seconds=2), "TESTVIN1234567890"),
        (2, START, "KEPT"),
    ]
    root = str(tmp_path / "live")
    # A poll's readings in two batches, then one that lets the watermark pass all others.
    closing = spark.createDataFrame(_poll(9, 10**6), READING)
    parts = [readings.filter("command < 'M'"), readings.filter("command >= 'M'"), closing]
    live.stream_samples(_in_order(spark, parts, tmp_path / "in"), root)
    got = live.read_samples(spark, root)
    assert _same(got.drop("parts"), samples)
    assert got.filter("parts > 1").isEmpty()


def test_late_readings_are_kept_aside_and_merged(spark, tmp_path):
    """The watermark closes a poll once; what comes later is a late row, and the two are merged."""
    polls = spark.createDataFrame(_poll(1, 0) + _poll(1, 3000) + _poll(2, 3000, 7.0), READING)
    far = spark.createDataFrame(_poll(9, 10**6), READING)
    is_first = F.col("ts") == F.lit(START).cast("timestamp_ntz")
    parts = [
        polls.filter(is_first & (F.col("command") != "RPM")),
        polls.filter(~is_first & (F.col("command") != "MAF")),
        # 3000 s is beyond the delay for the first poll, not for the others.
        polls.filter(is_first & (F.col("command") == "RPM")).unionByName(polls.filter(~is_first & (F.col("command") == "MAF"))),
        far,
        # A poll of which all is late.
        spark.createDataFrame(_poll(3, 0, 1.5), READING),
    ]
    root = str(tmp_path / "live")
    live.stream_samples(_in_order(spark, parts, tmp_path / "in"), root)
    written = tables.read(spark, root, "samples", live._SAMPLE)
    closed, late = (written.filter(F.col("kind") == k) for k in ("closed", "late"))
    assert closed.groupBy("session_id", "ts").count().filter("count > 1").isEmpty()
    assert (closed.count(), late.filter("session_id = 1").count(), late.filter("session_id = 2").count()) == (3, 1, 0)
    every = polls.unionByName(spark.createDataFrame(_poll(3, 0, 1.5), READING))
    got = live.read_samples(spark, root)
    assert _same(got.drop("parts"), live.live_readings_to_samples(every))
    assert rows_of(got.filter("parts > 1"), "session_id", "ts") == [(1, START)]


def test_closed_polls_alone_follow_the_watermark(spark, readings, tmp_path):
    """The streaming form of the batch operator: append mode, late readings left out and counted."""
    # The engine leaves out what the watermark of the batch before had passed.
    far = [spark.createDataFrame(_poll(9, 10**6 + k), READING) for k in range(2)]
    parts = [readings, *far, spark.createDataFrame(_poll(1, 5), READING)]
    samples = live.live_readings_to_samples(_in_order(spark, parts, tmp_path / "in"))
    query = (
        samples.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert _same(spark.read.parquet(str(tmp_path / "out")), live.live_readings_to_samples(readings))
    dropped = [p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress]
    assert sum(dropped) > 0


def test_guard(readings):
    flagged = live.read_only_guard(readings).filter("quarantine IS NOT NULL")
    assert rows_of(flagged, "command", "quarantine") == [("CLEAR_DTC", "forbidden command")]
    missing = live.missing_commands(readings).filter("session_id = 1")
    assert missing.count() == 0
    assert live.missing_commands(readings).filter("session_id = 2").count() == 14


def test_bands_of_many_sessions_are_no_broadcast(spark):
    sessions = spark.range(60_000).selectExpr("id AS session_id", "id DIV 2 AS vehicle_id")
    bands = sessions.selectExpr(
        "vehicle_id", "'stft_b1_pct' AS metric", "'idle' AS context", "1D AS healthy_min", "2D AS healthy_max"
    ).distinct()
    for part, hinted in ((sessions.limit(50), True), (sessions, False)):
        limits = score._session_limits(part, bands)
        plan = limits._jdf.queryExecution().analyzed().toString()
        assert ("strategy=broadcast" in plan) == hinted
        assert limits.count() == part.count()


def test_batches_of_the_event_stream_are_three_however_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 10, raising=False)
    events = spark.range(90).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id DIV 3)) AS ts",
        "id % 5 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'{\"k\": 1}' AS props",
    )
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    found = []
    tables.drain(
        catalog._event_stream(spark, str(tmp_path)),
        lambda batch, _: found.append([r.event_id for r in batch.select("event_id").collect()]),
        str(tmp_path / "progress"),
    )
    # Every seventh event comes a part late.
    wanted = [[], [], []]
    for i in range(90):
        wanted[min(2, i // 30 + (i % 7 == 0))].append(i)
    assert [sorted(ids) for ids in found] == wanted
