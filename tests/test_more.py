"""Streams with state, nested publication, scans of dated tables."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from wakeline.config import Future
from wakeline.operators import publish, report, tracks
from wakeline.sources import readers
from wakeline.streaming import live

RAW = "ordinal long, mmsi string, base_date_time string, longitude double, latitude double, sog double, cog double"


def _drain(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_segments_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(m, f"2025-03-07 {h:02d}:{i:02d}:00", -122.5 + 0.002 * i + (0.2 if m == "302" and i > 40 else 0), 37.7, 5.0, 0.0) for m in ("301", "302") for h in (6, 9) for i in range(0, 60, 3 if m == "301" else 4)]
    batch = {(r.mmsi, r.base_date_time): (r.segment_break_reason, r.seg_no, r.point_index, r.distance_gap_nm) for r in tracks.features(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW)).collect()}
    schema = "mmsi string, base_date_time string, longitude double, latitude double"
    for part in (0, 1):  # two micro-batches
        some = [r[:4] for r in rows if (r[1] > "2025-03-07 08") == bool(part)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("base_date_time")).withWatermark("ts", "10 hours")
    got = {(r.mmsi, r.ts.strftime("%Y-%m-%d %H:%M:%S")): r for r in _drain(live.segments(stream), "live_segments")}
    assert set(got) == set(batch)
    for k, (reason, seg, point, far) in batch.items():
        r = got[k]
        assert (r.segment_break_reason, r.seg_no, r.point_index) == (reason, seg, point) and (far is None) == (r.distance_gap_nm is None) and abs((far or 0) - (r.distance_gap_nm or 0)) < 1e-5


def test_followups_on_a_stream(spark, tmp_path):
    t0 = 1_741_329_000
    spark.createDataFrame([("301", "302", t0)], "mmsi_a string, mmsi_b string, t0 long").write.parquet(str(tmp_path / "e"))
    rows = [(m, t0 + d, -122.5, 37.7) for m in ("301", "302", "303") for d in (-5, 0, 1, 450, 900, 901)]
    spark.createDataFrame(rows, "mmsi string, t long, longitude double, latitude double").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(str(tmp_path / "p"))
    episodes = spark.readStream.schema("mmsi_a string, mmsi_b string, t0 long").parquet(str(tmp_path / "e"))
    positions = spark.readStream.schema("mmsi string, longitude double, latitude double, ts timestamp").parquet(str(tmp_path / "p"))
    got = _drain(live.followups(episodes, positions).withColumn("d", F.unix_seconds("ts") - F.col("t0")), "live_followups")
    assert sorted((r.side, r.d) for r in got) == [(s, d) for s in "ab" for d in (1, 450, 900)]


def test_nested_publication(spark):
    kind = "start_time string, score struct<risk_score:double,mmsi:string,parts:array<struct<sog_a:double,lon_mid:double,kind:string>>>, geometry struct<type:string,coordinates:array<array<double>>>, note string"
    row = ("2025-03-07 06:00:00", (0.5, "367000001", [(1.0, -122.123456, "old")]), ("LineString", [[-122.123456, 37.654321]]), "old")
    df = spark.createDataFrame([row, (None, None, None, None)], kind)
    assert publish.leaks(df).count() == 2
    out = publish.replace_terms(publish.public_names(publish.sanitise(df)), {"old": "new", "note": "remark"})
    assert publish.leaks(out).count() == 0 and publish.named_fields(out.schema) & publish.HIDDEN == set()
    r = out.where("date IS NOT NULL").first().asDict(True)
    assert r == {"date": "2025-03-07", "score": {"screening_score": 0.5, "parts": [{"lon_mid": -122.1235, "kind": "new"}]}, "geometry": {"type": "LineString", "coordinates": [[-122.1235, 37.6543]]}, "remark": "new"}


def test_dated_scan(spark):
    df = spark.createDataFrame([("2025-03-01", 1), ("2025-03-02", 2), ("2025-03-04", 4)], "date string, x int")
    assert [r.x for r in readers.dated(df, dt.date(2025, 3, 1), dt.date(2025, 3, 2)).orderBy("x").collect()] == [1, 2]
    with pytest.raises(FileNotFoundError, match="2025-03-03"):
        readers.dated(df, dt.date(2025, 3, 1), dt.date(2025, 3, 4))
    assert readers.smoke(df, 2).count() == 2


def test_relative_paths(spark):
    """Two stretches of common edges: one vessel sails east, the other lies still; a lone position of a third track joins nothing."""
    t0 = 1_741_329_000
    deg = math.degrees(1 / 3440.065)  # one mile of latitude
    rows = [("301", "2025-03-07", "a", t0 + d, 0.0 + deg * d / 600, 0.0) for d in (10, 130, 400, 520)] + [("302", "2025-03-07", "b", t0 + d, 0.0, deg) for d in (40, 100, 160, 340, 460)] + [("302", "2025-03-07", "c", t0 + 600, 0.0, deg)]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, mmsi string, date string, track_id string, t long, longitude double, latitude double")
    card = spark.createDataFrame([("2025-03-07", "301", "302", t0, "enc-001", 0.0, 0.0, 1.5), ("2025-03-07", "301", "309", t0, "enc-002", 0.0, 0.0, 1.5)], "date string, mmsi_a string, mmsi_b string, t0 long, case_id string, lon_mid double, lat_mid double, tcpa_min double")
    got = sorted(tuple(r) for r in report.relative_paths(card, f, Future()).collect())
    times = {(40, 130): [40, 70, 90, 100, 130], (400, 460): [400, 430, 460]}
    want = [("enc-001", a, z, side, t, round(t / 600, 2) if side == "A" else 0.0, 0.0 if side == "A" else 1.0) for (a, z), ts in times.items() for t in ts for side in "AB"]
    assert got == sorted(want)
    assert report.relative_paths(card.limit(0), f, Future()).count() == 0


def test_card_cases(spark):
    cards = spark.createDataFrame([("hotspot_card_001", "x1_y1"), ("hotspot_card_002", "x2_y2"), ("hotspot_card_003", "x9_y9")], "card_id string, cell_id string")
    cases = spark.createDataFrame([(1, "d", "t1"), (2, "d", "t2")], "case_no int, date string, track_id string")
    cells = {"t1": ["x1_y1"] * 3 + [f"x{i}_y0" for i in range(3, 9)] + ["x9_y9"], "t2": ["x1_y1", "x2_y2", None], "t3": ["x9_y9"] * 9}
    points = spark.createDataFrame([("d", t, c) for t, cs in cells.items() for c in cs], "date string, track_id string, cell_id string")
    got = {r.card_id: r.related_case_ids for r in report.card_cases(cards, cases, points).collect()}
    assert got == {"hotspot_card_001": ["case_01", "case_02"], "hotspot_card_002": ["case_02"], "hotspot_card_003": []}  # x9_y9 is the sixth cell of the first case


def test_summary_and_markdown(spark):
    one = spark.createDataFrame([(3, 0.25, None)], "a int, b double, c int")
    rows = report.figures(first=one, second=one.select("a")).unionByName(report.counted(spark.createDataFrame([("u",), ("u",), (None,)], "kind string"), "kind"))
    assert json.loads(report.summary_json(rows, run="r")) == {"run": "r", "notice": report.NOTICE, "first": {"a": 3, "b": 0.25}, "second": {"a": 3}, "kind": {"u": 2}}
    text = report.markdown(spark.createDataFrame([("x|y", 1200, None), ("a", 1, 0.5)], "name string, n int, v double"), "Counts", ["name"], "All rows.")
    assert text.splitlines() == ["# Counts", "", "All rows.", "", "| name | n | v |", "|-|-:|-:|", "| a | 1 | 0.5 |", "| x\\|y | 1,200 |  |"]


def test_bundle(spark, tmp_path):
    good = spark.createDataFrame([("ok", 1, 1, True)], "check string, a long, b long, ok boolean")
    documents = spark.createDataFrame([("summary.json", '{"days": 3}'), ("cells.geojson", '{"cell_id": "x1_y2"}')], "name string, content string")
    made = json.loads(report.write_bundle(documents, f"file://{tmp_path}/out", good, run="r"))
    assert (tmp_path / "out/summary.json").read_text() == '{"days": 3}' and json.loads((tmp_path / "out/manifest.json").read_text()) == made
    assert made["run"] == "r" and {f["name"]: f["sha256"] for f in made["files"]}["summary.json"] == hashlib.sha256(b'{"days": 3}').hexdigest()
    for bad in ('{"mmsi": 1}', '{"note": "367000001 was there"}', '{"at": "2025-03-07 06:00"}'):
        with pytest.raises(ValueError, match="x.json holds"):
            report.write_bundle(documents.unionByName(spark.createDataFrame([("x.json", bad)], "name string, content string")), f"file://{tmp_path}/bad", good)
    with pytest.raises(ValueError, match="contradict"):
        report.write_bundle(documents, f"file://{tmp_path}/bad", good.withColumn("ok", F.lit(False)))
    assert not (tmp_path / "bad").exists()
