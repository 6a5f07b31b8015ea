"""Operators on small inputs with known results."""

import datetime as dt
import json
import math
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.config import BAY, Future, Grid
from wakeline.functions import geo
from wakeline.operators import controls, encounters, future, graph, publish, quality, ranking, tracks
from wakeline.sources import readers
from wakeline.streaming import live

RAW = "ordinal long, mmsi string, base_date_time string, longitude double, latitude double, sog double, cog double"


def _features(spark, rows):
    return tracks.features(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW))


def test_segmentation(spark):
    rows = [
        ("111", "2025-05-01 12:00:00", 0.0, 0.0, 5.0, 0.0), ("111", "2025-05-01 12:01:00", 0.001, 0.0, 5.0, 0.0), ("111", "2025-05-01 13:00:00", 0.1, 0.0, 5.0, 0.0), ("111", "2025-05-01 13:01:00", 0.1, 0.001, 5.0, 0.0),
        ("222", "2025-05-01 12:00:00", 0.0, 0.0, 5.0, 0.0), ("222", "2025-05-01 12:01:00", 0.1, 0.0, 5.0, 0.0), ("333", "2025-05-01 12:00:00", 0.0, 0.0, 5.0, 0.0), ("333", "2025-05-01 12:00:01", 0.01, 0.0, 5.0, 0.0),
    ]
    got = {(r.mmsi, r.base_date_time[11:]): r for r in _features(spark, rows).collect()}
    assert got["111", "13:00:00"].segment_break_reason == "time_gap"
    assert got["222", "12:01:00"].segment_break_reason == "distance_gap"
    assert got["333", "12:00:01"].segment_break_reason == "implied_speed_gap"
    assert all(r.bearing_deg is None for r in got.values() if r.segment_break_reason)
    assert got["111", "12:00:00"].distance_gap_nm is None and got["111", "12:01:00"].distance_gap_nm > 0
    assert got["111", "13:01:00"].bearing_deg == 0.0 and got["111", "13:01:00"].track_id == "111_0002"


def test_cleaning(spark):
    rows = [
        (0, "12345", "2025-05-01 00:00:00", -122.4, 37.8, 5.0, 0.0), (1, "367000001", "x", -122.4, 37.8, 5.0, 0.0), (2, "367000001", "2025-5-1 1:2:3", -200.0, 37.8, 5.0, 0.0), (3, "367000001", "2025-05-01 00:00:00", -122.4, 37.8, None, 0.0),
        (4, "367000001", "2025-05-01 00:00:00", -122.4, 37.8, 61.0, 0.0), (5, "367000001", "2025-05-01 00:00:00", -122.4, 37.8, 5.0, 360.0), (6, "367000001", "2025-05-01 00:00:00", -122.4, 37.8, 6.0, 0.0),
    ]
    df = spark.createDataFrame(rows, RAW).withColumn("heading", F.lit(511.0))
    reasons = {r.ordinal: r.drop_reason for r in quality.classify(df, BAY).collect()}
    assert reasons == {0: "invalid_mmsi", 1: "invalid_timestamp", 2: "invalid_position", 3: "missing_sog", 4: "invalid_sog", 5: None, 6: "duplicate_point"}
    kept = quality.clean(df, BAY).collect()
    assert [(r.ordinal, r.cog, r.heading) for r in kept] == [(5, None, None)]


def test_causal_grid(spark):
    def one(rows):
        return {(r.g % 86400, r.mmsi): r for r in encounters.causal_grid(_features(spark, rows)).collect()}

    latest = one([("111", "2025-05-01 12:00:01", -122.4, 37.8, 5.0, 90.0), ("111", "2025-05-01 12:00:30", -122.4, 37.8, 5.0, 90.0)])
    assert latest[43260, "111"].age_s == 30.0 and (43320, "111") not in latest
    hidden = one([("111", "2025-05-01 12:00:01", -122.4, 37.8, 5.0, 90.0), ("111", "2025-05-01 12:00:01", -122.4, 37.8, 5.0, 90.0), ("111", "2025-05-01 12:00:30", -122.0, 37.8, 5.0, None)])
    assert (43260, "111") not in hidden


def test_pairs_index_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(60 * (i % 3), str(100 + i), -122.4 + rng.uniform(-0.1, 0.1), 37.8 + rng.uniform(-0.1, 0.1)) for i in range(150)]
    states = spark.createDataFrame(rows, "g long, mmsi string, lon double, lat double")
    found = [{(r.g, r.mmsi_a, r.mmsi_b) for r in f(states, 2.0).collect()} for f in (encounters.pairs_within, encounters.pairs_brute)]
    assert found[0] == found[1] and found[0]


def test_pairs_near_the_poles(spark):
    rng = random.Random(3)
    rows = [(lat, f"{lat}-{i}", 20 + rng.uniform(-0.02, 0.02) * n, lat + rng.uniform(-0.02, 0.02)) for lat, n in ((58, 4), (60, 4), (70, 6), (-70, 6), (85, 30), (89, 150)) for i in range(40)]
    states = spark.createDataFrame(rows, "g long, mmsi string, lon double, lat double")
    found = [{(r.g, r.mmsi_a, r.mmsi_b) for r in f(states, 2.0).collect()} for f in (encounters.pairs_within, encounters.pairs_brute)]
    assert found[0] == found[1] and {g for g, _, _ in found[0]} == {58, 60, 70, -70, 85, 89}


def test_encounter(spark):
    """Two vessels two miles apart that head for each other meet in three minutes; one state is older than the other."""
    f = _features(spark, [("301", "2025-03-07 06:29:48", -122.5, 37.7, 18.0, 90.0), ("302", "2025-03-07 06:30:00", -122.4631, 37.7, 18.0, 270.0)])
    r = encounters.opportunities(encounters.pairs_within(encounters.causal_grid(f), 2.0), BAY).collect()
    assert len(r) == 1 and r[0].is_candidate == 1 and (r[0].age_s_a, r[0].age_s_b) == (12.0, 0.0) and 2 < r[0].tcpa_min < 4 and r[0].dcpa_nm < 0.01


def test_future_is_strict(spark):
    ep = spark.createDataFrame([("2025-05-01", "111", "222", 1000, 0.1, 5.0)], "date string, mmsi_a string, mmsi_b string, t0 long, dcpa_nm double, tcpa_min double")

    def run(times, gap=30):
        rows = [(m, t, i, -122.4 + 0.0001 * t / 30, 37.8 + d, "2025-05-01", f"{m}_0001") for m, d in (("111", 0.0), ("222", 0.001)) for i, t in enumerate(times)]
        f = spark.createDataFrame(rows, "mmsi string, t long, ordinal long, longitude double, latitude double, date string, track_id string")
        return future.backtest(ep, f, Future()).first()

    whole = run(range(1030, 1901, 30))
    assert whole.samples == 30 and whole.coverage_s == 870 and whole.uncovered_s == 30 and whole.observable == 1 and whole.supported == 1
    before = run([970, 1000])
    assert before.actual_min_nm is None and before.observable == 0
    far = run([1030, 1030 + 181])
    assert far.coverage_s == 0 and far.samples == 1 and far.observable == 0


def test_thinning(spark):
    t = spark.range(1).select(controls.thinned(F.array(*[F.lit(x * 60).cast("bigint") for x in (0, 10, 15, 31)]), 900).alias("t")).first().t
    assert t == [0, 900, 1860]


def test_matching_without_replacement(spark):
    names = [*controls.STRATUM, "anchor_type", "anchor_id", "g", *controls.VALUES]
    row = lambda kind, i, g, speed: ("2025-05-01", 3, 1, 2, 0, 1, kind, i, g, 0.2, speed, 1.0, 0.0, 5)
    df = spark.createDataFrame([row("candidate", "a", 1000, 5.0), row("candidate", "b", 1010, 5.0), row("control", "x", 1020, 5.0), row("control", "y", 1030, 9.0), row("control", "z", 9000, 5.0)], names)
    got = {r.candidate_id: r.control_id for r in controls.match(df).collect()}
    assert got == {"a": "x", "b": "y"}


def test_components_and_bootstrap(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 30)] + [("90", "91")], "a string, b string")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert set(got.values()) == {"10", "90"} and len(got) == 23
    t = [(3, 2, 1), (2, 1, 0), (5, 2, 2)]
    assert controls.bootstrap(t) == controls.bootstrap(t) and controls.bootstrap([]) == {"risk_difference": None, "lift": None}


def test_rankings(spark):
    cells = spark.createDataFrame([("a", 90.0, 0.0, 10.0), ("b", 80.0, 9.0, 8.0), ("c", 70.0, 8.0, 0.0), ("d", 100.0, 0.0, 0.0)], "cell_id string, point_count double, anomaly_component double, encounter_component double")
    targets = spark.createDataFrame([("encounter", x) for x in "aab"] + [("behavior", x) for x in "bbc"], "kind string, cell_id string")
    ev = ranking.rank_evaluation(cells, targets, budgets=(0.25,))
    got = {(r.method, r.kind): r.captured for r in ev.collect()}
    assert (got["encounter_only", "encounter"], got["encounter_only", "behavior"]) == (2, 0) and (got["fused", "encounter"], got["fused", "behavior"]) == (1, 2)
    assert {r.method for r in ranking.pareto(ev).collect()} == {"encounter_only", "behavior_only", "fused"}
    outside = ranking.rank_evaluation(cells, spark.createDataFrame([("encounter", "a"), ("encounter", "far")], "kind string, cell_id string"), budgets=(1.0,))
    assert {(r.kind, r.targets, r.capture_rate) for r in outside.collect()} == {("encounter", 2, 0.5), ("behavior", 0, None)}
    tenth = {(r.method_a, r.method_b): r.overlap for r in ranking.rank_overlap(cells).collect()}
    assert len(tenth) == 15 and tenth["fused_w0.50", "fused_w0.75"] == 1.0 and tenth["density_only", "encounter_only"] == 0.0


def test_geometry(spark):
    rng = random.Random(2)
    rows = [tuple(rng.uniform(-80, 80) for _ in range(4)) for _ in range(50)]
    c = [F.col(x) for x in "abcd"]
    for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", geo.haversine_nm(*c).alias("h"), geo.bearing_deg(*c).alias("g")).collect():
        lon1, lat1, lon2, lat2 = (math.radians(x) for x in r[:4])
        cos = math.sin(lat1) * math.sin(lat2) + math.cos(lat1) * math.cos(lat2) * math.cos(lon2 - lon1)
        assert math.isclose(r.h, geo.EARTH_RADIUS_NM * math.acos(max(-1, min(1, cos))), rel_tol=1e-6, abs_tol=1e-3) and 0 <= r.g < 360


def test_sources(spark, tmp_path):
    head, line = "MMSI,BaseDateTime,LON,LAT,SOG,COG,Heading", "367000001,2025-05-01 00:00:00,-122.4,37.8,5,90,91"
    (tmp_path / "a.csv").write_text(f"{head}\n{line}\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.csv", "a.csv")
    try:
        import zstandard

        (tmp_path / "b.csv.zst").write_bytes(zstandard.compress(f"{head}\n{line}\n".encode()))
        assert readers.read_csv(spark, str(tmp_path / "b.csv.zst")).first().sog == "5"
    except ImportError:
        pass
    for df in (readers.read_csv(spark, str(tmp_path / "a.csv")), readers.read_zip(spark, str(tmp_path / "a.zip"), head.split(","))):
        assert df.first().longitude == "-122.4" and quality.clean(df, BAY).count() == 1
    pd.DataFrame({"lat": [35.4, 35.41], "lon": [139.8, 139.81], "timestamp": [1722470401, 1722556801], "mmsi": [431000001, 431000002], "sog": [8.5, None], "type": [70, -1], "destination": ["", ""]}).to_parquet(tmp_path / "s.parquet")
    rows = readers.read_second_source(spark, str(tmp_path / "s.parquet"), 1722470400, 1722556800).collect()
    assert [(r.base_date_time, r.vessel_type) for r in rows] == [("2024-08-01 00:00:01", "70")]
    assert readers.days(dt.date(2025, 5, 1), dt.date(2025, 5, 3))[-1] == dt.date(2025, 5, 3) and readers.daily_file(dt.date(2024, 8, 1)) == "AIS_2024_08_01.zip"
    with pytest.raises(ValueError):
        readers.days(dt.date(2025, 5, 3), dt.date(2025, 5, 1))
    assert readers.read_json(spark, str(tmp_path / "no.json"), "a int", optional=True).count() == 0
    import hashlib

    data = (tmp_path / "a.csv").read_bytes()
    assert readers.verify(spark, str(tmp_path / "a.csv"), len(data), hashlib.md5(data).hexdigest()) and not readers.verify(spark, str(tmp_path / "a.csv"), len(data), "0")


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(i, "367000001", f"2025-05-01 00:00:{i:02d}", i * 60, -122.4 + i / 1000, 37.8, 0.5) for i in range(10)], "ordinal long, mmsi string, base_date_time string, t long, longitude double, latitude double, anomaly_score double")
    clean = publish.sanitise(df.drop("t"))
    assert "mmsi" not in clean.columns and publish.leaks(clean.drop("ordinal")).count() == 0 and publish.leaks(df).count() == 10
    doc = json.loads(publish.collection(publish.point_layer(df, "anomaly_score", ["anomaly_score"], limit=3), 10, "score"))
    assert doc["metadata"]["source_count"] == 10 and len(doc["features"]) == 3
    (tmp_path / "x.geojson").write_text(json.dumps(doc))
    assert readers.read_geojson(spark, str(tmp_path / "x.geojson"), "anomaly_score:double", "array<double>").count() == 3
    line = json.loads(publish.line_layer(df, ["mmsi"], most=4).first().feature)
    assert len(line["geometry"]["coordinates"]) == 4


def test_stream(spark, tmp_path):
    rows = [("367000001", "2025-05-01 12:00:00", -122.4, 37.8, 5.0)] * 2 + [("12345", "2025-05-01 12:00:00", -122.4, 37.8, 5.0)]
    schema = "mmsi string, base_date_time string, longitude double, latitude double, sog double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = live.density(live.cleaned(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Grid()), Grid())
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live_density").start()
    q.processAllAvailable()
    q.stop()
    assert [r.point_count for r in spark.table("live_density").collect()] == [1]
