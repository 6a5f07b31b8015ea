"""Assessment, cards, sources and sinks on small inputs with known results."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wakeline.operators import assessment, cards, publish
from wakeline.operators.behavior import WEIGHTS
from wakeline.sources import readers, sinks


def test_calibration_bins(spark):
    rows = [("candidate", 0.25, 0.0, 15.0, 0.1, 1, 0.4), ("candidate", 0.24, 20.0, 14.0, 2.0, 1, 0.9), ("control", None, None, 60.0, 1.0, 0, None)]
    df = spark.createDataFrame(rows, "anchor_type string, dcpa_nm double, tcpa_min double, state_skew_s double, current_distance_nm double, observable int, actual_min_nm double")
    got = {(r.variable, r.anchor_type, r.bin): (r.anchors, r.observable, r.within_half_nm, r.within_one_nm, r.half_rate) for r in assessment.calibration(df).collect()}
    assert got["dcpa_nm", "candidate", "0.25-<0.5"] == (1, 1, 1, 1, 1.0)
    assert got["dcpa_nm", "candidate", "<0.25"] == (1, 1, 0, 1, 0.0)
    assert got["tcpa_min", "candidate", "0-<5"][0] == 1 and got["tcpa_min", "candidate", ">=15"][0] == 1
    assert got["dcpa_nm", "control", "missing_or_undefined"] == (1, 0, 0, 0, None)
    assert got["state_skew_s", "control", ">=60"][0] == 1 and len(got) == 12
    assert {(r.threshold_nm, r.anchors, r.candidates) for r in assessment.composition(df).collect()} == {(0.5, 1, 1), (1.0, 2, 2)}


def test_intervals(spark):
    """Two pairs that share a candidate's pair and day are drawn together."""
    ident = lambda i: f"{i:012d}|a{i}|b{i}"
    pairs = spark.createDataFrame([(ident(i), i, ident(100 + i), 100 + i) for i in range(6)], "candidate_id string, candidate_g long, control_id string, control_g long")
    judged = spark.createDataFrame([(ident(i), 1, 0.2) for i in range(6)] + [(ident(100 + i), 1, 0.2 if i < 3 else 0.8) for i in range(6)], "anchor_id string, observable int, actual_min_nm double")
    half, one = assessment.intervals(pairs, judged).orderBy("threshold_nm").collect()
    assert (half.pairs, half.components, half.risk_difference, half.lift) == (6, 6, 0.5, 2.0) and half.difference_low < 0.5 < half.difference_high
    assert (one.risk_difference, one.difference_low, one.difference_high, one.lift) == (0.0, 0.0, 0.0, 1.0)


def test_stages_and_fingerprint(spark):
    a, b = spark.range(8), spark.range(0)
    assert [tuple(r) for r in assessment.stages(first=a, last=b).orderBy("stage_no").collect()] == [(0, "first", 8, 100.0, 1.0), (1, "last", 0, 0.0, None)]
    one = assessment.fingerprint(a, ["id"]).first()
    assert one == assessment.fingerprint(a.repartition(3).orderBy(F.desc("id")), ["id"]).first() and one.sha256 != assessment.fingerprint(spark.range(9), ["id"]).first().sha256
    assert assessment.fingerprint(b, ["id"]).first().n_rows == 0


def test_day_overlap(spark):
    df = spark.createDataFrame([("d1", "x", 3), ("d1", "y", 2), ("d1", "z", 1), ("d2", "y", 5), ("d2", "w", 4), ("d2", "x", 1)], "date string, cell_id string, point_count int")
    assert [tuple(r) for r in assessment.day_overlap(df, 2).orderBy("date").collect()] == [("d1", 2, 1.0, None), ("d2", 2, round(1 / 3, 6), round(1 / 3, 6))]


def _points(spark, tracks):
    """tracks: mmsi, track, {reason: times}."""
    rows = []
    for mmsi, track, times in tracks:
        for i in range(max(times.values())):
            rows.append(("d", mmsi, track, 0.5, *[int(times.get(k, 0) > i) for k in WEIGHTS]))
    return spark.createDataFrame(rows, "date string, mmsi string, track_id string, anomaly_score double, " + ", ".join(f"{k} int" for k in WEIGHTS))


def test_case_selection(spark):
    points = _points(spark, [("m1", "t1", {"high_turn": 5, "high_speed": 4}), ("m1", "t2", {"high_speed": 3}), ("m2", "t3", {"high_speed": 2}), ("m3", "t4", {"implied_speed": 9}), ("m4", "t5", {"high_speed": 1})])
    got = [(r.case_reason, r.track_id) for r in cards.select_cases(points, 4).orderBy("case_no").collect()]
    # the fastest track belongs to a vessel that is chosen already, so another vessel's comes next; the last is the fullest of the rest
    assert got == [("high_turn", "t1"), ("high_speed", "t3"), ("implied_speed", "t4"), ("high_speed", "t5")]
    only = _points(spark, [("m1", "t1", {"high_turn": 5}), ("m1", "t2", {"high_speed": 3})])
    assert [r.track_id for r in cards.select_cases(only, 4).orderBy("case_no").collect()] == ["t1", "t2"]


def test_card_problems(spark):
    good = ("c1", 1.0, 0.5, 5.0, 0.0, -0.5, 0.0, 0.5, 900, 100)
    bad = [("c2", 1.0, 0.5, 5.0, 0.0, -0.5, 0.0, 0.4, 900, 100), ("c3", 1.0, 1.2, 5.0, 0.0, -0.5, 0.0, 0.5, 900, 100), ("c4", 1.0, 0.5, 5.0, 0.0, -0.5, 0.0, 0.5, 900, 901), ("c5", None, 0.5, 5.0, 0.0, -0.5, 0.0, 0.5, 900, 1)]
    df = spark.createDataFrame([good, *bad], "case_id string, current_distance_nm double, dcpa_nm double, tcpa_min double, x_a_nm double, y_a_nm double, x_b_nm double, y_b_nm double, window_s int, coverage_s int")
    assert {r.case_id: r.problems for r in cards.card_problems(df).collect()} == {"c2": ["geometry"], "c3": ["approach"], "c4": ["window"], "c5": ["distance", "geometry"]}


def test_terms(spark):
    df = publish.replace_terms(spark.createDataFrame([("old", "kept", 1), (None, "old", 2)], "a string, b string, n int"), {"old": "new", "a": "c"})
    assert df.columns == ["c", "b", "n"] and [tuple(r) for r in df.orderBy("n").collect()] == [("new", "kept", 1), (None, "new", 2)]


def test_files(spark, tmp_path):
    source, there = tmp_path / "in.bin", tmp_path / "out.bin"
    source.write_bytes(b"abc" * 1000)
    assert readers.download(source.as_uri(), str(there)) == str(there) and there.read_bytes() == source.read_bytes()
    there.write_bytes(b"mine")
    readers.download(source.as_uri(), str(there))
    assert there.read_bytes() == b"mine" and not (tmp_path / "out.bin.part").exists()
    with pytest.raises(OSError):
        readers.download((tmp_path / "none").as_uri(), str(tmp_path / "x"))
    (row,) = sinks.manifest(spark, str(tmp_path), "in.bin").collect()
    assert (row.name, row.bytes, row.sha256) == ("in.bin", 3000, hashlib.sha256(source.read_bytes()).hexdigest())
    assert json.loads(sinks.manifest_json(sinks.manifest(spark, str(tmp_path), "in.bin"), title="t"))["file_count"] == 1


def test_daily_tables(spark, tmp_path):
    f = spark.createDataFrame([("2025-05-01", "m", "t", 1), ("2025-05-02", "m", "t", 2), ("2025-05-03", "m", "t", 3), ("2025-05-01", "m", " ", 4), ("2025-05-01", "n", "t", 5)], "date string, mmsi string, track_id string, v int")
    day = dt.date(2025, 5, 1)
    got = readers.positions(f, spark.createDataFrame([("m",), ("m",)], "mmsi string"), day, day).orderBy("v")
    assert [(r.track_id, r.v) for r in got.collect()] == [("2025-05-01::t", 1), ("2025-05-02::t", 2)]
    path = str(tmp_path / "days")
    sinks.write_days(f, path)
    sinks.write_days(f.where("v = 2").withColumn("v", F.lit(20)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3, 4, 5, 20]
    one = next((tmp_path / "days" / "date=2025-05-02").glob("*.parquet"))
    assert readers.inspect_parquet(str(one))["rows"] == 1
    sinks.write_csv(f, str(tmp_path / "csv"), ["v", "mmsi"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["v", "mmsi"]


def test_enrich(spark):
    a = spark.createDataFrame([("x", 1, "g"), ("y", 2, "h")], "cell_id string, n int, geometry string")
    b = spark.createDataFrame([("x", 9, "hot")], "cell_id string, n int, kind string")
    assert [tuple(r[c] for c in ("cell_id", "n", "geometry", "kind")) for r in readers.enrich(a, b).orderBy("cell_id").collect()] == [("x", 9, "g", "hot"), ("y", 2, "h", None)]
