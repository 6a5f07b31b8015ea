"""Operators that SQL cannot say, against plain Python over rows made here."""

import collections
import itertools
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wakeline.config import BAY, Matching, PatternGates
from wakeline.operators import assessment, behavior, cards, controls, places, publish, raster, ranking

M = Matching()
FIELDS = ["anchor_type", "anchor_id", "g", *controls.STRATUM, *controls.VALUES]
TYPES = "anchor_type string, anchor_id string, g long, date string, hour_block int, block_x int, block_y int, band int, tertile int, " + ", ".join(f"{v} double" for v in controls.VALUES)


@pytest.fixture(scope="module")
def anchors():
    """Anchors in three strata, with ties, missing values and more candidates than controls in one."""
    rng, rows = random.Random(4), []
    for i in range(140):
        kind = "candidate" if rng.random() < (0.7 if i % 3 == 0 else 0.4) else "control"
        g = 86400 * 20000 + 14400 + rng.randrange(0, 14400, 600)
        values = [round(rng.uniform(0, 0.5), 2), float(rng.randrange(0, 20)), float(rng.randrange(0, 8)), float(rng.randrange(0, 60, 20)), float(rng.randrange(1, 9))]
        if i % 17 == 0:
            values[1] = None
        rows.append((kind, f"{g:012d}|{100 + i % 9}|{200 + i % 7}|{i:03d}", g, "2024-10-04", 1, i % 3, 0, 0, 1, *values))
    return rows


def greedy(rows):
    out = []
    whole = [dict(zip(FIELDS, r, strict=True)) for r in rows if None not in r]
    for _, group in itertools.groupby(sorted(whole, key=lambda r: [r[k] for k in controls.STRATUM]), key=lambda r: [r[k] for k in controls.STRATUM]):
        group = list(group)
        free = [r for r in group if r["anchor_type"] == "control"]
        for c in sorted((r for r in group if r["anchor_type"] == "candidate"), key=lambda r: r["anchor_id"]):
            best = None
            for k in free:
                t, s, z = abs(c["g"] - k["g"]), abs(c["relative_speed_kn"] - k["relative_speed_kn"]), abs(c["closing_speed_kn"] - k["closing_speed_kn"])
                if t > 3600 or s > 5 or z > 2.5:
                    continue
                most = max(1.0, abs(c["local_exposure"]), abs(k["local_exposure"]))
                terms = [t / 3600, abs(c["current_distance_nm"] - k["current_distance_nm"]) / 0.5, s / 5, z / 2.5, abs(c["state_skew_s"] - k["state_skew_s"]) / 60, abs(c["local_exposure"] - k["local_exposure"]) / most]
                key = (sum(terms), *terms, k["anchor_id"])
                if best is None or key < best[0]:
                    best = (key, k)
            if best:
                free.remove(best[1])
                out.append((c, best[1]))
    return out


def test_matches(spark, anchors):
    got = {(r.candidate_id, r.control_id) for r in controls.match(spark.createDataFrame(anchors, TYPES)).collect()}
    assert got == {(a["anchor_id"], b["anchor_id"]) for a, b in greedy(anchors)} and len(got) > 20
    assert controls.match(spark.createDataFrame([], TYPES)).count() == 0


@pytest.fixture(scope="module")
def judged(anchors):
    rng = random.Random(6)
    return {r[1]: (rng.random() < 0.8, round(rng.uniform(0, 2), 2)) for r in anchors if rng.random() < 0.95}


def _judged(spark, judged):
    return spark.createDataFrame([(i, int(ok), nm) for i, (ok, nm) in judged.items()], "anchor_id string, observable int, actual_min_nm double")


def near(a, b):
    return a is b or (a is not None and b is not None and math.isclose(a, b, abs_tol=2e-6))


def test_balance(spark, anchors, judged):
    pairs = greedy(anchors)
    every = [dict(zip(FIELDS, r, strict=True)) for r in anchors]
    both = [(a, b) for a, b in pairs if judged.get(a["anchor_id"], (0,))[0] and judged.get(b["anchor_id"], (0,))[0]]
    sides = {"pre": [[r for r in every if r["anchor_type"] == s] for s in ("candidate", "control")], "post": list(map(list, zip(*pairs, strict=True))), "joint": list(map(list, zip(*both, strict=True)))}
    df = spark.createDataFrame(anchors, TYPES)
    got = {(r.phase, r.variable): r for r in controls.balance(df, controls.match(df), _judged(spark, judged)).collect()}
    assert len(got) == 18

    def percentile(x, q):
        x, at = sorted(x), (len(x) - 1) * q
        return x[int(at)] + (x[min(int(at) + 1, len(x) - 1)] - x[int(at)]) * (at - int(at))

    for (phase, variable), r in got.items():
        values = [[x["g"] % 86400 if variable == "time_of_day_s" else x[variable] for x in side] for side in sides[phase]]
        for side, v in zip(("candidate", "control"), values, strict=True):
            there = [x for x in v if x is not None]
            assert (r[f"{side}_n"], r[f"{side}_missing"]) == (len(there), len(v) - len(there))
            assert near(r[f"{side}_mean"], statistics.mean(there)) and near(r[f"{side}_median"], percentile(there, 0.5)) and near(r[f"{side}_p90"], percentile(there, 0.9))
        a, b = ([x for x in v if x is not None] for v in values)
        assert near(r.smd, (statistics.mean(a) - statistics.mean(b)) / math.sqrt((statistics.variance(a) + statistics.variance(b)) / 2))


def test_balance_with_little_spread(spark):
    """A side with one row has no variance: that of the other side counts alone."""
    row = lambda kind, i, speed: (kind, f"{1000 + i:012d}|1|{i}", 1000 + i, "2024-10-04", 0, 0, 0, 0, 1, 0.2, speed, 1.0, 0.0, 5.0)
    df = spark.createDataFrame([row("candidate", 1, 6.0), row("control", 2, 4.0), row("control", 3, 8.0), row("control", 4, 3.0)], TYPES)
    got = {r.variable: r.smd for r in controls.balance(df, controls.match(df)).collect() if r.phase == "pre"}
    assert near(got["relative_speed_kn"], (6 - 5) / statistics.stdev([4, 8, 3])) and got["closing_speed_kn"] == 0.0 and got["state_skew_s"] == 0.0


def test_outcomes(spark, anchors, judged):
    pairs, df = greedy(anchors), spark.createDataFrame(anchors, TYPES)
    matched, later = controls.match(df), _judged(spark, judged)
    state = [(judged.get(a["anchor_id"]), judged.get(b["anchor_id"])) for a, b in pairs]
    full = [(a, b) for a, b in state if a and b]
    r = controls.observability(matched, later).first()
    count = lambda x, y: sum((a[0], b[0]) == (x, y) for a, b in full)
    assert tuple(r) == (len(pairs), len(full), count(True, True), count(True, False), count(False, True), count(False, False))
    both = [(a[1], b[1]) for a, b in full if a[0] and b[0]]
    got = {r.threshold_nm: r for r in controls.outcomes(matched, later).collect()}
    for nm, r in got.items():
        a, b = (sum(p[i] <= nm for p in both) for i in (0, 1))
        assert (r.pairs, r.candidate_hits, r.control_hits) == (len(both), a, b) and near(r.risk_difference, (a - b) / len(both)) and near(r.lift, a / b if b else None)
    for r in assessment.intervals(matched, later).collect():
        o = got[r.threshold_nm]
        assert r.pairs == o.pairs and near(r.risk_difference, o.risk_difference) and r.difference_low <= r.risk_difference <= r.difference_high


def test_match_components(spark, anchors):
    pairs = greedy(anchors)
    day = lambda x: "2024-10-04|" + "|".join(x["anchor_id"].split("|")[-2:])
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(day(a)), root(day(b))))
        parent[high] = low
    got = {r.node: r.root for r in controls.dependence(controls.match(spark.createDataFrame(anchors, TYPES))).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_match_differences(spark, anchors):
    pairs = greedy(anchors)
    got = {r.field: r for r in assessment.differences(controls.match(spark.createDataFrame(anchors, TYPES))).collect()}
    for field in controls.VALUES:
        x = [abs(a[field] - b[field]) for a, b in pairs]
        assert got[field].n == len(x) and near(got[field].median, statistics.median(x)) and near(got[field].most, max(x))
    assert near(got["reference_time_s"].most, max(abs(a["g"] - b["g"]) for a, b in pairs)) and got["normalized_distance"].n == len(pairs)


REPORT = "ordinal long, date string, mmsi string, track_id string, t long, longitude double, latitude double, sog double, cog double, bearing_deg double, accel_kn_per_min double, turn_rate_deg_per_min double, implied_sog_kn double"


def test_injections(spark):
    """Only moving, normal reports on regular routes are taken; stops lie on high-confidence cells."""
    rng, rows = random.Random(9), []
    for i in range(900):
        lane = i % 3
        lon, lat = -122.4 + 0.005 * (lane * 4) + rng.uniform(0, 0.0049), 37.8 + rng.uniform(0, 0.0049)
        odd = i % 50 == 0
        rows.append((i, "2024-01-01", str(367000000 + i % 8), f"{i % 8}_{i % 40}", 60 * i, lon, lat, 0.2 if i % 20 == 0 else 6.0, 92.0, None if i % 7 else 90.0, 9.0 if odd else 0.0, 80.0 if odd else 0.0, 40.0 if odd else 6.0))
    rows += [(1000 + i, "2024-01-01", "367000100", f"x{i}", i, -122.0, 37.5, 9.0, 10.0, None, None, None, None) for i in range(30)]  # off all routes
    f = spark.createDataFrame(rows, REPORT)
    known = raster.patterns(f, BAY, PatternGates(min_points=40, min_tracks=3))
    assert known.where("is_normal = 1").count() >= 1
    inside = {r.ordinal: r._high for r in behavior.pool(f, known, BAY).collect()}
    assert inside and all(rows[i][7] >= 1 and i % 50 and i < 900 for i in inside)
    mixed = behavior.inject(f, known, BAY, per_type=50)
    by = collections.defaultdict(list)
    for r in mixed.collect():
        by[r.injection].append(r)
    assert set(by) == set(behavior.INJECTIONS) and all(len(v) == min(50, len(inside)) or k == "unexpected_stop" for k, v in by.items())
    assert all(r.ordinal in inside for v in by.values() for r in v) and len({inside[r.ordinal] for r in by["unexpected_stop"]}) == 1
    assert all(r.bearing_deg == 270.0 for r in by["course_reversal"]) and all(r.sog == 22.0 and r._skipped == 0 for r in by["speed_surge"])
    got = {r.injection: r for r in behavior.injection_metrics(behavior.score(mixed, known, BAY)).collect()}
    assert got["normal_control"].rate == 0.0 and got["course_reversal"].rate == 1.0 and got["speed_surge"].top_reasons[0].endswith("=50")
    assert sum(r.evaluated + r.skipped for r in got.values()) == sum(map(len, by.values()))


def test_fusion_gate(spark):
    """A kind without targets counts as 0, so it hinders nothing; two budgets have to pass."""
    rate = {("2024-01-01", 0.05): (0.4, 0.2, None, None), ("2024-01-01", 0.1): (0.4, 0.2, 0.96, 1.0), ("2024-01-02", 0.05): (0.4, 0.4, 0.5, 0.5), ("2024-01-02", 0.1): (0.4, 0.2, 0.9, 1.0), ("2024-01-03", 0.05): (0.3, 0.1, 0.0, 0.0), ("2024-01-03", 0.1): (0.3, 0.1, 1.0, 1.0)}
    rows = [(fold, budget, m, k, x) for (fold, budget), (fb, eb, fe, ee) in rate.items() for m, k, x in (("fused", "behavior", fb), ("encounter_only", "behavior", eb), ("fused", "encounter", fe), ("encounter_only", "encounter", ee))]
    folds = spark.createDataFrame(rows, "fold string, budget double, method string, kind string, capture_rate double")
    assert {(r.budget, r.good_folds, r.passed, r.gate_passed) for r in ranking.fusion_gate(folds).collect()} == {(0.05, 2, 1, 1), (0.1, 2, 1, 1)}
    assert {r.gate_passed for r in ranking.fusion_gate(folds.where("budget = 0.1")).collect()} == {0}


def test_values_at_places(spark):
    rng = random.Random(12)
    columns = {"a": [rng.gauss(0, 100) for _ in range(400)], "b": [rng.choice([1.0, 1.0, 2.0, 9.0]) for _ in range(300)], "c": [5.0] * 7, "d": [1e9, *[rng.random() for _ in range(200)]]}
    df = spark.createDataFrame([(k, x) for k, v in columns.items() for x in [*v, None]], "field string, v double")
    wanted = {"first": lambda n: F.lit(0), "p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * 0.95), "last": lambda n: n - 1}
    for r in places.values_at(df, wanted, buckets=16).collect():
        x = sorted(columns[r.field])
        assert (r["first"], r.p50, r.p95, r["last"]) == (x[0], x[len(x) // 2], x[int((len(x) - 1) * 0.95)], x[-1])


def test_layers(spark):
    rng = random.Random(3)
    rows = [(i, "d", f"t{i % 4}", 60 * (i % 50), -122.4 + rng.random() / 10, 37.8 + rng.random() / 10, round(rng.random(), 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "ordinal long, date string, track_id string, t long, longitude double, latitude double, anomaly_score double")
    best = sorted(rows, key=lambda r: (-r[6], r[0]))[:25]
    got = [json.loads(r.feature) for r in publish.point_layer(df, "anomaly_score", ["anomaly_score"], limit=25).collect()]
    assert [(p["properties"]["anomaly_score"], *p["geometry"]["coordinates"]) for p in got] == [(r[6], round(r[4], 4), round(r[5], 4)) for r in best] and {p["geometry"]["type"] for p in got} == {"Point"}
    cells = spark.createDataFrame([("r1_c2", 1, 2, 7)], "cell_id string, row int, col int, point_count long")
    ring = json.loads(publish.cell_layer(cells, BAY, ["point_count"]).first().feature)["geometry"]["coordinates"][0]
    west, south = BAY.west + 2 * BAY.cell, BAY.south + BAY.cell
    assert len(ring) == 5 and ring[0] == ring[-1] and near(min(p[0] for p in ring), west) and near(max(p[1] for p in ring), south + BAY.cell)
    lines = {r.track_id: json.loads(r.feature)["geometry"]["coordinates"] for r in publish.line_layer(df, ["track_id"], most=10).collect()}
    for k, line in lines.items():
        own = [[round(r[4], 4), round(r[5], 4)] for r in sorted((r for r in rows if r[2] == k), key=lambda r: (r[3], r[0]))]
        places_ = sorted({round(i * (len(own) - 1) / 9) for i in range(10)})
        assert line == [own[i] for i in places_]


def test_case_selection(spark):
    names = list(behavior.WEIGHTS)
    rng, rows = random.Random(8), []
    for i in range(400):
        flags = [int(rng.random() < 0.15) for _ in names]
        rows.append(("2024-01-01", str(100 + i % 6), f"t{i % 23}", round(0.35 + rng.random() / 2, 3), 5.0, f"r{i % 4}_c0", ";".join(k for k, x in zip(names, flags, strict=True) if x), *flags))
    df = spark.createDataFrame(rows, "date string, mmsi string, track_id string, anomaly_score double, sog double, cell_id string, reasons string, " + ", ".join(f"{k} int" for k in names))
    tracks = collections.defaultdict(list)
    for r in rows:
        tracks[r[0], r[1], r[2]].append(r)
    chosen, used, vessels = [], set(), set()

    def order(why):
        of = {k: len(v) if why is None else sum(r[7 + names.index(why)] for r in v) for k, v in tracks.items()}
        return sorted((k for k in tracks if of[k]), key=lambda k: (-of[k], -round(sum(r[3] for r in tracks[k]) / len(tracks[k]), 6), -len(tracks[k]), k[0], k[2]))

    for why in names:
        free = [k for k in order(why) if (k[0], k[2]) not in used]
        pick = next((k for k in free if k[1] not in vessels), free[0] if free else None)
        if pick and len(chosen) < 7:
            chosen.append((why, pick))
            used.add((pick[0], pick[2]))
            vessels.add(pick[1])
    got = [(r.case_reason, (r.date, r.mmsi, r.track_id)) for r in cards.select_cases(df).orderBy("case_no").collect()]
    assert got[: len(chosen)] == chosen
