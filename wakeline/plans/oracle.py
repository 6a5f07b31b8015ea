"""The same results in DuckDB SQL, as common table expressions that build on each other."""

from __future__ import annotations

import re

R = "3440.065"
WEST, SOUTH, EAST, NORTH, CELL = "-122.62", "37.42", "-121.92", "38.18", "0.005"


def D(x: object) -> str:
    return f"CAST({x} AS DOUBLE)"


def fmod(x: str, m: str = "360") -> str:
    return f"((({x}) % {D(m)} + {D(m)}) % {D(m)})"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {D(R)} * asin(CASE WHEN {a} > 1 THEN 1 ELSE sqrt{a} END))"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d, p1, p2 = f"radians({lon2} - {lon1})", f"radians({lat1})", f"radians({lat2})"
    return fmod(f"degrees(atan2(sin({d}) * cos({p2}), cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({d}))) + {D(360)}")


def delta(a: str, b: str) -> str:
    return f"abs({fmod(f'{b} - {a} + {D(180)}')} - {D(180)})"


def sector(x: str) -> str:
    return f"CAST(floor({fmod(f'{x} + {D(22.5)}')} / {D(45)}) AS INT)"


def inside(lon: str, lat: str) -> str:
    return f"({lon} >= {D(WEST)} AND {lon} <= {D(EAST)} AND {lat} >= {D(SOUTH)} AND {lat} <= {D(NORTH)})"


def col(lon: str) -> str:
    return f"least(CAST(floor(({lon} - {D(WEST)}) / {D(CELL)}) AS INT), CAST(trunc(({D(EAST)} - {D(WEST)}) / {D(CELL)}) AS INT))"


def row(lat: str) -> str:
    return f"least(CAST(floor(({lat} - {D(SOUTH)}) / {D(CELL)}) AS INT), CAST(trunc(({D(NORTH)} - {D(SOUTH)}) / {D(CELL)}) AS INT))"


def cell(lon: str, lat: str) -> str:
    return f"CASE WHEN {inside(lon, lat)} THEN 'r' || {row(lat)} || '_c' || {col(lon)} END"


def plane_x(lon: str, ref_lon: str, ref_lat: str) -> str:
    return f"(radians({lon} - {ref_lon}) * cos(radians({ref_lat})) * {D(R)})"


def plane_y(lat: str, ref_lat: str) -> str:
    return f"(radians({lat} - {ref_lat}) * {D(R)})"


def norm(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    ml, mb = f"(({lon1} + {lon2}) / 2)", f"(({lat1} + {lat2}) / 2)"
    return norm(f"{plane_x(lon2, ml, mb)} - {plane_x(lon1, ml, mb)}", f"{plane_y(lat2, mb)} - {plane_y(lat1, mb)}")


#: Indicators and their weights, as in operators/behavior.py.
WEIGHTS = {"low_empirical_route_support": 0.35, "direction_mismatch": 0.25, "high_turn": 0.15, "high_accel": 0.10, "high_speed": 0.10, "suspicious_stop": 0.15, "implied_speed": 0.10}
PATTERN_POINTS, PATTERN_TRACKS = 20, 3

CTES: dict[str, str] = {}

CTES["raw"] = f"""
SELECT ordinal,
  CASE WHEN e % 211 = 0 THEN '12345' ELSE CAST(367000000+v AS VARCHAR) END AS mmsi,
  strftime(CAST(d AS TIMESTAMP) + to_seconds(c), '%Y-%m-%d %H:%M:%S') AS base_date_time,
  CASE WHEN e % 331 = 0 THEN {D(-200)} ELSE (-122420000 + (80000 - abs(x % 160000 - 80000)) + (e % 5)*7 + CASE WHEN e % 307 = 0 THEN 50000 ELSE 0 END) / {D(1e6)} END AS longitude,
  (37760000 + (60000 - abs(y % 120000 - 60000)) + CASE WHEN e % 401 = 0 THEN 150000 ELSE 0 END) / {D(1e6)} AS latitude,
  CASE WHEN e % 97 = 0 THEN {D(61)} WHEN e % 89 = 0 THEN NULL ELSE val / {D(10)} END AS sog,
  CASE WHEN e % 17 = 0 THEN {D(360)} ELSE CAST((e*37) % 360 AS DOUBLE) END AS cog,
  CASE WHEN e % 13 = 0 THEN {D(511)} ELSE CAST(k*3 AS DOUBLE) END AS heading,
  CASE event_type WHEN 'view' THEN '30' WHEN 'click' THEN '52' WHEN 'signup' THEN '60' WHEN 'purchase' THEN '70' ELSE '80' END AS vessel_type,
  CAST(e % 600 AS DOUBLE) AS length, CAST(e % 120 AS DOUBLE) AS width, CAST(e % 35 AS DOUBLE) AS draft
FROM (
  SELECT *, unnest(CASE WHEN e % 50 = 0 THEN [e*2, e*2+1] ELSE [e*2] END) AS ordinal FROM (
    SELECT *, (20+3*v)*c + 79190*v + 1009*di AS y, (15+2*v)*c + 104729*v + 2003*di AS x FROM (
      SELECT event_id AS e, user_id % 15 AS v, CAST(ts AS DATE) AS d, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS di,
        (epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) // 24000000 AS c,
        CAST(floor(value) AS BIGINT) AS val, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
      FROM events)))"""
CTES["classified"] = f"""
SELECT *, CASE WHEN first IS NULL AND row_number() OVER (PARTITION BY mmsi, base_date_time, longitude, latitude, first IS NULL ORDER BY ordinal) > 1 THEN 'duplicate_point' ELSE first END AS drop_reason
FROM (SELECT *, CASE WHEN NOT regexp_full_match(mmsi, '[1-9][0-9]{{8}}') THEN 'invalid_mmsi' WHEN try_strptime(base_date_time, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'invalid_timestamp'
  WHEN NOT {inside('longitude', 'latitude')} THEN 'invalid_position' WHEN sog IS NULL THEN 'missing_sog' WHEN sog < 0 OR sog > 60 THEN 'invalid_sog' END AS first FROM raw)"""
CTES["cleaned"] = """
SELECT ordinal, mmsi, base_date_time, longitude, latitude, sog, CASE WHEN cog >= 0 AND cog < 360 THEN cog END AS cog,
  CASE WHEN heading <> 511 AND heading BETWEEN 0 AND 360 THEN heading END AS heading, vessel_type,
  CASE WHEN length BETWEEN 0 AND 500 THEN length END AS length, CASE WHEN width BETWEEN 0 AND 100 THEN width END AS width, CASE WHEN draft BETWEEN 0 AND 30 THEN draft END AS draft
FROM classified WHERE drop_reason IS NULL"""
CTES["steps"] = f"""
SELECT *, CASE WHEN gap > 0 THEN far / (gap / {D(3600)}) END AS implied FROM (
  SELECT *, {haversine('plon', 'plat', 'longitude', 'latitude')} AS far FROM (
    SELECT *, row_number() OVER w AS n, t - lag(t) OVER w AS gap, lag(longitude) OVER w AS plon, lag(latitude) OVER w AS plat, lag(sog) OVER w AS psog
    FROM (SELECT *, substr(base_date_time, 1, 10) AS date, CAST(epoch(strptime(base_date_time, '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS t FROM cleaned)
    WINDOW w AS (PARTITION BY date, mmsi ORDER BY t, ordinal)))"""
CTES["broken"] = f"""
SELECT *, CASE WHEN reason = '' THEN {bearing('plon', 'plat', 'longitude', 'latitude')} END AS brg FROM (
  SELECT *, CASE WHEN n = 1 THEN 'new_mmsi' WHEN gap <= 0 THEN 'non_increasing_time' WHEN gap > 1800 THEN 'time_gap' WHEN far > 5 THEN 'distance_gap' WHEN implied > 60 THEN 'implied_speed_gap' ELSE '' END AS reason FROM steps)"""
CTES["turned"] = f"""
SELECT *, {delta('lag(brg) OVER w', 'brg')} AS turn, CASE WHEN brg IS NOT NULL THEN sog - psog END AS dsog,
  CAST(sum(CASE WHEN reason <> '' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg_no,
  n - max(CASE WHEN reason <> '' THEN n END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS point_index
FROM broken WINDOW w AS (PARTITION BY date, mmsi ORDER BY t, ordinal)"""
CTES["feat"] = f"""
SELECT ordinal, date, mmsi, t, longitude, latitude, sog, cog, reason AS segment_break_reason, seg_no, point_index, mmsi || '_' || lpad(CAST(seg_no AS VARCHAR), 4, '0') AS track_id, gap AS time_gap_s,
  round(far, 6) AS distance_gap_nm, round(implied, 6) AS implied_sog_kn, round(brg, 6) AS bearing_deg, round(turn, 6) AS bearing_delta_deg, round(dsog, 6) AS sog_delta_kn,
  round(dsog / (gap / {D(60)}), 6) AS accel_kn_per_min, round(turn / (gap / {D(60)}), 6) AS turn_rate_deg_per_min
FROM turned"""
CTES["celled"] = f"SELECT *, {cell('longitude', 'latitude')} AS cell_id, {col('longitude')} AS col, {row('latitude')} AS row FROM feat WHERE {inside('longitude', 'latitude')}"
_DENSITY = "count(*) AS point_count, count(DISTINCT mmsi) AS unique_mmsi, count(DISTINCT track_id) AS unique_tracks, round(round(sum(sog), 6) / count(sog), 6) AS mean_sog, count(*) FILTER (WHERE sog < 0.5) AS stationary_count, count(*) FILTER (WHERE sog >= 0.5) AS moving_count, count(*) FILTER (WHERE sog >= 12) AS high_speed_count"
CTES["density"] = f"SELECT cell_id, row, col, {_DENSITY} FROM celled GROUP BY cell_id, row, col"
CTES["daily_density"] = f"SELECT date, cell_id, row, col, {_DENSITY} FROM celled GROUP BY date, cell_id, row, col"
CTES["moving"] = f"SELECT *, {sector('coalesce(bearing_deg, cog)')} AS bin FROM celled WHERE sog >= 1 AND coalesce(bearing_deg, cog) IS NOT NULL"
CTES["moving_cells"] = """
SELECT a.cell_id, a.row, a.col, CAST(a.m AS BIGINT) AS moving_points, u.um AS unique_mmsi, u.ut AS unique_tracks, round(round(a.s, 6) / a.m, 6) AS mean_sog, a.bin AS dominant_direction_bin, round(a.n / CAST(a.m AS DOUBLE), 6) AS dominance_ratio
FROM (SELECT *, sum(n) OVER (PARTITION BY cell_id) AS m, sum(ss) OVER (PARTITION BY cell_id) AS s, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, first) AS r
  FROM (SELECT cell_id, row, col, bin, count(*) AS n, sum(sog) AS ss, min({'date': date, 'mmsi': mmsi, 't': t, 'ordinal': ordinal}) AS first FROM moving GROUP BY cell_id, row, col, bin)) a
JOIN (SELECT cell_id, count(DISTINCT mmsi) AS um, count(DISTINCT track_id) AS ut FROM moving GROUP BY cell_id) u USING (cell_id) WHERE a.r = 1"""
CTES["gates"] = f"""
SELECT greatest({PATTERN_POINTS}, max(moving_points) FILTER (WHERE i = CAST(floor((n - 1) * {D(0.75)}) AS BIGINT))) AS normal_threshold,
  greatest({PATTERN_POINTS}, max(moving_points) FILTER (WHERE i = CAST(floor((n - 1) * {D(0.9)}) AS BIGINT))) AS high_threshold
FROM (SELECT moving_points, row_number() OVER (ORDER BY moving_points) - 1 AS i, count(*) OVER () AS n FROM moving_cells)"""
CTES["patterns"] = f"""
SELECT m.*, CAST(moving_points >= normal_threshold AND unique_tracks >= {PATTERN_TRACKS} AS INT) AS is_normal, CAST(moving_points >= high_threshold AND unique_tracks >= {PATTERN_TRACKS} AS INT) AS is_high_confidence FROM moving_cells m, gates"""
_FLAGS = {
    "low_empirical_route_support": "sog >= 1 AND pb IS NULL", "direction_mismatch": "sog >= 1 AND least(abs(ob - pb), 8 - abs(ob - pb)) >= 2", "high_turn": "turn_rate_deg_per_min >= 30", "high_accel": "abs(accel_kn_per_min) >= 3",
    "high_speed": "sog >= 15", "suspicious_stop": "sog < 0.5 AND ph = 1", "implied_speed": "implied_sog_kn >= 30",
}
CTES["flagged"] = f"""
SELECT *, {', '.join(f'CAST(coalesce({v}, false) AS INT) AS {k}' for k, v in _FLAGS.items())} FROM (
  SELECT c.*, p.dominant_direction_bin AS pb, p.is_high_confidence AS ph, {sector('coalesce(c.bearing_deg, c.cog)')} AS ob FROM celled c LEFT JOIN (SELECT * FROM patterns WHERE is_normal = 1) p USING (cell_id))"""
CTES["scored"] = f"""
SELECT *, CASE WHEN low_empirical_route_support = 1 AND indicator_count = 1 THEN 'low_support_only' WHEN indicator_count >= 2 THEN 'corroborated_candidate' WHEN indicator_count = 1 THEN 'single_indicator_candidate' ELSE 'no_candidate_evidence' END AS evidence_tier FROM (
  SELECT *, round(least({D(1)}, {' + '.join(f'{k} * {D(w)}' for k, w in WEIGHTS.items())}), 6) AS anomaly_score, {' + '.join(WEIGHTS)} AS indicator_count,
    array_to_string(list_filter([{', '.join(f"CASE WHEN {k} = 1 THEN '{k}' END" for k in WEIGHTS)}], lambda x: x IS NOT NULL), ';') AS reasons FROM flagged)"""
CTES["points"] = "SELECT * FROM scored WHERE anomaly_score >= 0.35"
CTES["targets"] = """
SELECT date, track_id, cell_id, n, score_sum FROM (SELECT *, row_number() OVER (PARTITION BY date, track_id ORDER BY n DESC, score_sum DESC, cell_id) AS r FROM (
  SELECT date, track_id, cell_id, count(*) AS n, round(sum(anomaly_score), 6) AS score_sum FROM points WHERE evidence_tier = 'corroborated_candidate' GROUP BY ALL)) WHERE r = 1"""
CTES["coursed"] = """
SELECT *, coalesce(own, native) AS course, CASE WHEN own IS NOT NULL THEN 'segment_bearing' WHEN native IS NOT NULL THEN 'native_cog' ELSE 'none' END AS direction_source FROM (
  SELECT *, CASE WHEN segment_break_reason = '' AND point_index > 0 AND bearing_deg >= 0 AND bearing_deg < 360 THEN bearing_deg END AS own, CASE WHEN cog >= 0 AND cog < 360 THEN cog END AS native FROM feat)"""
CTES["states"] = f"""
SELECT g, mmsi, t, CASE WHEN g = t THEN longitude ELSE longitude + degrees(sog * sin(radians(course)) * ((g - t) / {D(3600)}) / ({D(R)} * cos(radians(latitude)))) END AS lon,
  CASE WHEN g = t THEN latitude ELSE latitude + degrees(sog * cos(radians(course)) * ((g - t) / {D(3600)}) / {D(R)}) END AS lat, sog, course, direction_source, track_id, CAST(g - t AS DOUBLE) AS age_s
FROM (SELECT *, row_number() OVER (PARTITION BY g, mmsi ORDER BY t DESC, date, ordinal) AS r FROM (
  SELECT *, unnest(range((t + 59) // 60 * 60, t + 61, 60)) AS g FROM coursed WHERE sog >= 1)) WHERE r = 1 AND course IS NOT NULL"""
_SIDE = "mmsi, t, lon, lat, sog, course, direction_source, track_id, age_s".split(", ")
CTES["pairs"] = f"""
SELECT * FROM (SELECT a.g, {', '.join(f'a.{c} AS {c}_a, b.{c} AS {c}_b' for c in _SIDE)} FROM states a JOIN states b ON a.g = b.g AND a.mmsi < b.mmsi) WHERE {distance('lon_a', 'lat_a', 'lon_b', 'lat_b')} <= 2"""
CTES["approach"] = f"""
SELECT *, CASE WHEN h > 0 THEN {norm('rx + ru * h', 'ry + rv * h')} ELSE d END AS dcpa FROM (
  SELECT *, {norm('rx', 'ry')} AS d, ru * ru + rv * rv AS rv2, rx * ru + ry * rv AS dot, CASE WHEN ru * ru + rv * rv > 1e-9 THEN -((rx * ru + ry * rv) / (ru * ru + rv * rv)) END AS h FROM (
    SELECT *, {plane_x('lon_b', 'ml', 'mb')} - {plane_x('lon_a', 'ml', 'mb')} AS rx, {plane_y('lat_b', 'mb')} - {plane_y('lat_a', 'mb')} AS ry,
      sog_b * sin(radians(course_b)) - sog_a * sin(radians(course_a)) AS ru, sog_b * cos(radians(course_b)) - sog_a * cos(radians(course_a)) AS rv
    FROM (SELECT *, (lon_a + lon_b) / 2 AS ml, (lat_a + lat_b) / 2 AS mb FROM pairs)))"""
CTES["opps"] = f"""
SELECT *, CASE WHEN is_candidate = 1 THEN round(greatest({D(0)}, least({D(1)}, {D(0.65)} * (1 - dc / {D(0.5)}) + {D(0.35)} * (1 - h * 60 / {D(15)}))), 6) END AS encounter_score FROM (
  SELECT strftime(make_timestamp(g * 1000000), '%Y-%m-%d') AS date, g, mmsi_a, mmsi_b, abs(t_a - t_b) AS state_skew_s, age_s_a, age_s_b,
    {', '.join(f'round({k}_{s}, 6) AS {k}_{s}' for k in ('lon', 'lat') for s in 'ab')}, {', '.join(f'round({k}_{s}, 3) AS {k}_{s}' for k in ('sog', 'course') for s in 'ab')}, track_id_a, track_id_b,
    {cell('ml', 'mb')} AS cell_id, round(d, 6) AS current_distance_nm, round(dcpa, 6) AS dcpa_nm, round(h * 60, 6) AS tcpa_min, round(sqrt(rv2), 6) AS relative_speed_kn,
    round(CASE WHEN d > 1e-12 THEN greatest({D(0)}, -(dot / d)) ELSE 0 END, 6) AS closing_speed_kn, CAST(coalesce(h > 0 AND h * 60 <= 15 AND dcpa <= 0.5, false) AS INT) AS is_candidate, dcpa AS dc, h FROM approach)"""
CTES["exposure"] = "SELECT date, cell_id, count(*) AS pair_opportunity_count, count(DISTINCT mmsi_a || '|' || mmsi_b) AS unique_pairs, round(avg(state_skew_s), 6) AS mean_state_skew_s, max(state_skew_s) AS max_state_skew_s FROM opps WHERE cell_id IS NOT NULL GROUP BY date, cell_id"
CTES["islands"] = """
SELECT *, CAST(sum(new) OVER (PARTITION BY date, mmsi_a, mmsi_b ORDER BY g ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
  SELECT *, coalesce(CAST(g - lag(g) OVER (PARTITION BY date, mmsi_a, mmsi_b ORDER BY g) > 900 AS INT), 1) AS new FROM opps WHERE is_candidate = 1)"""
CTES["episodes"] = """
SELECT date, mmsi_a, mmsi_b, island, min(g) AS t0, max(g) AS end_s, count(*) AS record_count, arg_min(dcpa_nm, g) AS dcpa_nm, arg_min(tcpa_min, g) AS tcpa_min, arg_min(encounter_score, g) AS first_score,
  arg_min(current_distance_nm, g) AS current_distance_nm, arg_min(state_skew_s, g) AS state_skew_s, arg_min(coalesce(cell_id, ''), g) AS cell_id, round((arg_min(lon_a, g) + arg_min(lon_b, g)) / 2, 7) AS lon_mid, round((arg_min(lat_a, g) + arg_min(lat_b, g)) / 2, 7) AS lat_mid,
  max(encounter_score) AS max_score, min(dcpa_nm) AS min_dcpa_nm, min(current_distance_nm) AS min_distance_nm FROM islands GROUP BY date, mmsi_a, mmsi_b, island"""

K = "date, mmsi_a, mmsi_b, t0"
CTES["after"] = f"""
SELECT e.date, e.mmsi_a, e.mmsi_b, e.t0, s.side, f.t, f.ordinal, f.longitude, f.latitude, f.date || '::' || f.track_id AS track
FROM (SELECT * FROM episodes) e CROSS JOIN (VALUES ('a'), ('b')) s(side) JOIN (SELECT * FROM feat) f ON f.mmsi = CASE WHEN s.side = 'a' THEN e.mmsi_a ELSE e.mmsi_b END AND f.t > e.t0 AND f.t <= e.t0 + 900"""
CTES["edges"] = f"""
SELECT * FROM (SELECT {K}, side, t AS s, lead(t) OVER w AS e, longitude AS x0, latitude AS y0, lead(longitude) OVER w AS x1, lead(latitude) OVER w AS y1, track, lead(track) OVER w AS nt
  FROM after WINDOW w AS (PARTITION BY {K}, side ORDER BY t, ordinal)) WHERE track = nt AND e > s AND e - s <= 180"""
_P = {f"p{c}{n}{v}": f"({v}.{c}0 + ({v}.{c}1 - {v}.{c}0) * (({t} - {v}.s) / CAST({v}.e - {v}.s AS DOUBLE)))" for v in "ab" for n, t in (("0", "greatest(a.s, b.s)"), ("1", "least(a.e, b.e)")) for c in "xy"}
CTES["meets"] = f"""
SELECT {K}, s, e, {norm('rx + dx * part', 'ry + dy * part')} AS d, s + part * (e - s) AS nearest FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy > 1e-18 THEN greatest({D(0)}, least({D(1)}, -((rx * dx + ry * dy) / (dx * dx + dy * dy)))) ELSE 0 END AS part FROM (
    SELECT {K}, s, e, x0 AS rx, y0 AS ry, x1 - x0 AS dx, y1 - y0 AS dy FROM (
      SELECT {K}, s, e, {plane_x('px0b', 'mx', 'my')} - {plane_x('px0a', 'mx', 'my')} AS x0, {plane_y('py0b', 'my')} - {plane_y('py0a', 'my')} AS y0,
        {plane_x('px1b', 'mx', 'my')} - {plane_x('px1a', 'mx', 'my')} AS x1, {plane_y('py1b', 'my')} - {plane_y('py1a', 'my')} AS y1
      FROM (SELECT *, (px0a + px0b + px1a + px1b) / 4 AS mx, (py0a + py0b + py1a + py1b) / 4 AS my FROM (
        SELECT a.date, a.mmsi_a, a.mmsi_b, a.t0, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, {', '.join(f'{v} AS {k}' for k, v in _P.items())}
        FROM (SELECT * FROM edges WHERE side = 'a') a JOIN (SELECT * FROM edges WHERE side = 'b') b USING ({K}) WHERE greatest(a.s, b.s) < least(a.e, b.e))))))"""
CTES["cover"] = f"""
SELECT {K}, CAST(sum(e - s) AS BIGINT) AS coverage_s, greatest(max(gap), t0 + 900 - max(e)) AS gap_s, min(d) AS continuous
FROM (SELECT *, s - coalesce(lag(e) OVER (PARTITION BY {K} ORDER BY s), t0) AS gap FROM meets) GROUP BY {K}"""
CTES["spots"] = f"""
SELECT {K}, side, k, x0 + (x1 - x0) * ((t0 + k * 10 - s) / CAST(e - s AS DOUBLE)) AS x, y0 + (y1 - y0) * ((t0 + k * 10 - s) / CAST(e - s AS DOUBLE)) AS y
FROM (SELECT *, unnest(range((s - t0) // 10 + 1, (e - t0 - 1) // 10 + 1)) AS k FROM edges)
UNION ALL SELECT {K}, side, (t - t0) // 10, arg_min(longitude, ordinal), arg_min(latitude, ordinal) FROM after WHERE (t - t0) % 10 = 0 GROUP BY {K}, side, t"""
CTES["samples"] = f"SELECT {K}, k, {distance('a.x', 'a.y', 'b.x', 'b.y')} AS d FROM (SELECT * FROM spots WHERE side = 'a') a JOIN (SELECT * FROM spots WHERE side = 'b') b USING ({K}, k)"
CTES["judged"] = f"""
SELECT e.date, e.mmsi_a, e.mmsi_b, e.t0, e.dcpa_nm, e.cell_id, coalesce(c.coverage_s, 0) AS coverage_s, coalesce(c.gap_s, 900) AS uncovered_s, coalesce(g.n, 0) AS samples, coalesce(p.oa, 0) AS observations_a, coalesce(p.ob, 0) AS observations_b,
  round(coalesce(c.continuous, g.sampled), 6) AS actual_min_nm
FROM (SELECT * FROM episodes) e LEFT JOIN cover c USING ({K}) LEFT JOIN (SELECT {K}, count(*) AS n, min(d) AS sampled FROM samples WHERE k % 3 = 0 GROUP BY {K}) g USING ({K})
LEFT JOIN (SELECT {K}, count(*) FILTER (WHERE side = 'a') AS oa, count(*) FILTER (WHERE side = 'b') AS ob FROM after GROUP BY {K}) p USING ({K})"""


def _verdicts(share: str, gap: int) -> str:
    can = lambda x: f"(actual_min_nm IS NOT NULL AND samples >= ceil(30 * {D(x)}) AND coverage_s >= 900 * {D(x)} AND uncovered_s <= {gap})"
    return f"""
SELECT *, CAST(ok AND actual_min_nm <= 0.5 AS INT) AS supported, CAST(ok AND actual_min_nm <= 1 AS INT) AS near_supported, CAST(ok AS INT) AS observable,
  CASE WHEN NOT ok THEN 'insufficient_synchronized_future_followup' WHEN actual_min_nm <= 0.5 THEN 'future_supported_within_threshold' ELSE 'future_observable_not_within_threshold' END AS status,
  CASE WHEN ok THEN round(abs(actual_min_nm - dcpa_nm), 6) END AS distance_error_nm
FROM (SELECT *, {can(share)} AS ok, CAST({can('0.5')} AS INT) AS observable_50, CAST({can('0.9')} AS INT) AS observable_90 FROM judged)"""


CTES["backtest"] = _verdicts("0.7", 180)
CTES["relaxed"] = _verdicts("0.3", 600)
CTES["strata"] = f"""
SELECT o.*, x.local_exposure, x.tertile, CAST(g % 86400 // 14400 AS INT) AS hour_block, CAST(floor(lon_mid / {D(0.05)}) AS INT) AS block_x, CAST(floor(lat_mid / {D(0.05)}) AS INT) AS block_y, CAST(floor(current_distance_nm / {D(0.5)}) AS INT) AS band
FROM (SELECT *, (lon_a + lon_b) / 2 AS lon_mid, (lat_a + lat_b) / 2 AS lat_mid, coalesce(cell_id, 'x' || CAST(floor((lon_a + lon_b) / 2 / {D(0.005)}) AS BIGINT) || '_y' || CAST(floor((lat_a + lat_b) / 2 / {D(0.005)}) AS BIGINT)) AS local_cell FROM opps) o
JOIN (SELECT *, least(3, CAST(floor(((low + low + ties - 1) / {D(2)} + 0.5) / days * 3) AS INT) + 1) AS tertile FROM (
  SELECT date, local_cell, local_exposure, rank() OVER (PARTITION BY date ORDER BY local_exposure) - 1 AS low, count(*) OVER (PARTITION BY date, local_exposure) AS ties, count(*) OVER (PARTITION BY date) AS days FROM (
    SELECT date, coalesce(cell_id, 'x' || CAST(floor((lon_a + lon_b) / 2 / {D(0.005)}) AS BIGINT) || '_y' || CAST(floor((lat_a + lat_b) / 2 / {D(0.005)}) AS BIGINT)) AS local_cell, count(*) AS local_exposure FROM opps GROUP BY 1, 2))) x USING (date, local_cell)"""
CTES["free"] = """
SELECT mmsi_a, mmsi_b, g, row_number() OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY g) AS n FROM (SELECT * FROM opps WHERE is_candidate = 0) f
WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM opps WHERE is_candidate = 1) c WHERE c.mmsi_a = f.mmsi_a AND c.mmsi_b = f.mmsi_b AND abs(c.g - f.g) <= 900)"""
CTES["picked"] = """
SELECT mmsi_a, mmsi_b, g FROM (WITH RECURSIVE walk AS (
  SELECT mmsi_a, mmsi_b, n, g, g AS kept, true AS own FROM free WHERE n = 1
  UNION ALL SELECT f.mmsi_a, f.mmsi_b, f.n, f.g, CASE WHEN f.g - w.kept >= 900 THEN f.g ELSE w.kept END, f.g - w.kept >= 900
  FROM walk w JOIN free f ON f.mmsi_a = w.mmsi_a AND f.mmsi_b = w.mmsi_b AND f.n = w.n + 1) SELECT * FROM walk WHERE own)"""
_ZERO = "anomaly_count low_support_count weighted_count weighted_score encounter_count encounter_score opportunities point_count moving_count is_evidence".split()


def _evidence(key: str, of: str = "") -> str:
    """``of``: before the names of the tables, for those by fold."""

    def part(table: str, flag: int, where: str = "true", **values: str) -> str:
        return f"SELECT {key}cell_id, {', '.join(f'CAST({values.get(z, flag if z == _ZERO[-1] else 0)} AS DOUBLE) AS {z}' for z in _ZERO)} FROM (SELECT * FROM {table}) WHERE {where}"

    w = "CASE WHEN evidence_tier = 'low_support_only' THEN 0.25 ELSE 1 END"
    parts = [
        part(f"{of}points", 1, anomaly_count="1", low_support_count="CASE WHEN evidence_tier = 'low_support_only' THEN 1 ELSE 0 END", weighted_count=w, weighted_score=f"({w}) * anomaly_score"),
        part(f"{of}opps", 1, "is_candidate = 1 AND cell_id IS NOT NULL", encounter_count="1", encounter_score="encounter_score"), part(f"{of}exposure", 1, opportunities="pair_opportunity_count"),
        part(f"{of}density" if of else "daily_density" if key else "density", 0, point_count="point_count", moving_count="moving_count"),
    ]
    rate = lambda n, s, of: f"CASE WHEN {n} > 0 AND {of} > 0 THEN ln(1 + {n}) * ({s} / {n}) * sqrt({n} / {of}) ELSE 0 END"
    return f"""SELECT *, round({rate('weighted_count', 'weighted_score', 'moving_count')}, 8) AS anomaly_component, round({rate('encounter_count', 'encounter_score', 'opportunities')}, 8) AS encounter_component
FROM (SELECT {key}cell_id, {', '.join(f'sum({z}) AS {z}' for z in _ZERO)} FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"""


CTES["evidence"] = _evidence("")
CTES["daily_evidence"] = _evidence("date, ")
CTES["hot"] = """
SELECT *, CAST(eligible = 1 AND row_number() OVER (PARTITION BY eligible ORDER BY risk_score DESC, cell_id) <= greatest(1, floor(n * 0.10)) AS INT) AS is_hotspot FROM (
  SELECT *, sum(eligible) OVER () AS n, coalesce(round(raw / coalesce(max(CASE WHEN eligible = 1 THEN raw END) OVER (), max(raw) OVER ()), 6), 0) AS risk_score FROM (
    SELECT *, CAST(point_count >= 20 AND moving_count >= 5 AND (anomaly_count >= 3 OR encounter_count >= 3) AS INT) AS eligible, anomaly_component + CAST(0.75 AS DOUBLE) * encounter_component AS raw FROM evidence WHERE is_evidence > 0))"""
CTES["daily_ranked"] = """
SELECT date, method, cell_id, row_number() OVER (PARTITION BY date, method ORDER BY score DESC, cell_id) AS r FROM (
  SELECT date, cell_id, 'density_only' AS method, round(point_count, 8) AS score FROM daily_evidence WHERE point_count >= 20
  UNION ALL SELECT date, cell_id, 'anomaly_only', anomaly_component FROM daily_evidence WHERE point_count >= 20 AND moving_count >= 5 AND anomaly_count >= 3
  UNION ALL SELECT date, cell_id, 'encounter_only', encounter_component FROM daily_evidence WHERE point_count >= 20 AND moving_count >= 5 AND encounter_count >= 3
  UNION ALL SELECT date, cell_id, 'fused_risk', round(anomaly_component + CAST(0.75 AS DOUBLE) * encounter_component, 8) FROM daily_evidence WHERE point_count >= 20 AND moving_count >= 5 AND (anomaly_count >= 3 OR encounter_count >= 3))"""
CTES["stable"] = """
SELECT date, method, CAST(len(cells) AS INT) AS selected_cells, coalesce(round(len(list_intersect(cells, f)) / CAST(nullif(len(list_distinct(list_concat(cells, f))), 0) AS DOUBLE), 6), 0) AS overlap_first,
  CASE WHEN p IS NOT NULL THEN coalesce(round(len(list_intersect(cells, p)) / CAST(nullif(len(list_distinct(list_concat(cells, p))), 0) AS DOUBLE), 6), 0) END AS overlap_previous, top_cells FROM (
  SELECT *, first(cells) OVER (PARTITION BY method ORDER BY date) AS f, lag(cells) OVER (PARTITION BY method ORDER BY date) AS p FROM (
    SELECT d.date, m.method, coalesce(r.cells, []) AS cells, r.top_cells FROM (SELECT DISTINCT date FROM daily_evidence) d CROSS JOIN (VALUES ('density_only'), ('anomaly_only'), ('encounter_only'), ('fused_risk')) m(method)
    LEFT JOIN (SELECT date, method, list(cell_id) AS cells, list_sort(list(cell_id) FILTER (WHERE r <= 10)) AS top_cells FROM daily_ranked WHERE r <= 25 GROUP BY 1, 2) r USING (date, method)))"""
CTES["day_counts"] = """
SELECT * FROM (SELECT date, count(*) AS clean_rows, count(DISTINCT mmsi) AS unique_mmsi FROM feat GROUP BY 1)
JOIN (SELECT date, count(*) AS tracks, count(*) FILTER (WHERE n >= 20) AS long_tracks, CAST(coalesce(sum(n) FILTER (WHERE n >= 20), 0) AS BIGINT) AS long_rows FROM (SELECT date, track_id, count(*) AS n FROM feat GROUP BY 1, 2) GROUP BY 1) USING (date)
LEFT JOIN (SELECT date, count(*) AS grid_cells, max(n) AS max_cell_count FROM (SELECT date, cell_id, count(*) AS n FROM celled GROUP BY 1, 2) GROUP BY 1) USING (date)"""
CTES["carded"] = f"""
SELECT e.*, r.actual_min_nm, r.coverage_s, r.observable, r.supported, r.near_supported, row_number() OVER (ORDER BY r.observable DESC, r.supported DESC, CAST(r.actual_min_nm IS NOT NULL AS INT) DESC, r.coverage_s DESC, e.first_score DESC, e.date, e.mmsi_a, e.mmsi_b, e.t0) AS rank
FROM (SELECT * FROM relaxed) r JOIN (SELECT * FROM episodes) e USING ({K})"""

CTES["stretches"] = f"""
SELECT {K}, i, min(s) AS b, max(e) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY {K} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (
  SELECT *, coalesce(CAST(s > max(e) OVER (PARTITION BY {K} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT), 1) AS new FROM meets)) GROUP BY {K}, i"""
CTES["moments"] = f"""
SELECT DISTINCT *, unnest(list_concat(list_transform(range(b, z + 1, 30), lambda x: CAST(x AS DOUBLE)), [CAST(z AS DOUBLE)], list_filter([t0 + tcpa_min * {D(60)}, observed], lambda x: x >= b AND x <= z))) AS tau FROM (
  SELECT {K}, b, z, c.rank, c.lon_mid, c.lat_mid, c.tcpa_min, o.observed FROM stretches JOIN (SELECT * FROM carded WHERE rank <= 12) c USING ({K})
  JOIN (SELECT {K}, arg_min(nearest, {{'d': d, 's': s}}) AS observed FROM meets GROUP BY {K}) o USING ({K}))"""
CTES["path_spots"] = f"""
SELECT rank, t0, lon_mid, lat_mid, b, z, tau, side, arg_min(x0 + (x1 - x0) * ((tau - s) / (e - s)), s) AS x, arg_min(y0 + (y1 - y0) * ((tau - s) / (e - s)), s) AS y
FROM moments JOIN edges USING ({K}) WHERE s <= tau AND tau <= e GROUP BY ALL"""


# Each day left out in turn: all tables that depend on the other days, with the day left out as a column.
CTES["fold_days"] = "SELECT DISTINCT date AS fold FROM feat"
CTES["fold_moving"] = "SELECT m.*, d.fold FROM moving m JOIN fold_days d ON m.date <> d.fold"
CTES["fold_cells"] = """
SELECT a.fold, a.cell_id, CAST(a.m AS BIGINT) AS moving_points, u.ut AS unique_tracks, a.bin AS dominant_direction_bin
FROM (SELECT *, sum(n) OVER (PARTITION BY fold, cell_id) AS m, row_number() OVER (PARTITION BY fold, cell_id ORDER BY n DESC, first) AS r
  FROM (SELECT fold, cell_id, bin, count(*) AS n, min({'date': date, 'mmsi': mmsi, 't': t, 'ordinal': ordinal}) AS first FROM fold_moving GROUP BY fold, cell_id, bin)) a
JOIN (SELECT fold, cell_id, count(DISTINCT track_id) AS ut FROM fold_moving GROUP BY fold, cell_id) u USING (fold, cell_id) WHERE a.r = 1"""
CTES["fold_gates"] = f"""
SELECT fold, greatest({PATTERN_POINTS}, max(moving_points) FILTER (WHERE i = CAST(floor((n - 1) * {D(0.75)}) AS BIGINT))) AS normal_threshold,
  greatest({PATTERN_POINTS}, max(moving_points) FILTER (WHERE i = CAST(floor((n - 1) * {D(0.9)}) AS BIGINT))) AS high_threshold
FROM (SELECT fold, moving_points, row_number() OVER (PARTITION BY fold ORDER BY moving_points) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM fold_cells) GROUP BY fold"""
CTES["fold_patterns"] = f"""
SELECT m.*, CAST(moving_points >= normal_threshold AND unique_tracks >= {PATTERN_TRACKS} AS INT) AS is_normal, CAST(moving_points >= high_threshold AND unique_tracks >= {PATTERN_TRACKS} AS INT) AS is_high_confidence
FROM fold_cells m JOIN fold_gates g USING (fold)"""
CTES["fold_scored"] = (CTES["scored"].replace("FROM flagged", f"""FROM (
    SELECT *, {', '.join(f'CAST(coalesce({v}, false) AS INT) AS {k}' for k, v in _FLAGS.items())} FROM (
      SELECT c.*, d.fold, p.dominant_direction_bin AS pb, p.is_high_confidence AS ph, {sector('coalesce(c.bearing_deg, c.cog)')} AS ob
      FROM celled c CROSS JOIN (SELECT * FROM fold_days) d LEFT JOIN (SELECT * FROM fold_patterns WHERE is_normal = 1) p ON p.fold = d.fold AND p.cell_id = c.cell_id))"""))
CTES["fold_points"] = "SELECT * FROM fold_scored WHERE date <> fold AND anomaly_score >= 0.35"
CTES["fold_opps"] = "SELECT o.*, d.fold FROM opps o JOIN fold_days d ON o.date <> d.fold"
CTES["fold_exposure"] = "SELECT fold, cell_id, count(*) AS pair_opportunity_count FROM fold_opps WHERE cell_id IS NOT NULL GROUP BY fold, cell_id"
CTES["fold_density"] = "SELECT d.fold, c.cell_id, count(*) AS point_count, count(*) FILTER (WHERE sog >= 0.5) AS moving_count FROM celled c JOIN fold_days d ON c.date <> d.fold GROUP BY d.fold, c.cell_id"
CTES["fold_evidence"] = _evidence("fold, ", "fold_")
CTES["fold_targets"] = """
SELECT 'behavior' AS kind, cell_id, date AS fold FROM (SELECT *, row_number() OVER (PARTITION BY date, track_id ORDER BY n DESC, score_sum DESC, cell_id) AS r FROM (
  SELECT date, track_id, cell_id, count(*) AS n, round(sum(anomaly_score), 6) AS score_sum FROM fold_scored WHERE date = fold AND anomaly_score >= 0.35 AND evidence_tier = 'corroborated_candidate' GROUP BY ALL)) WHERE r = 1
UNION ALL SELECT 'encounter', cell_id, date FROM relaxed WHERE supported = 1 AND cell_id <> ''"""

# Patterns and scores on grids of other cell sizes.
_SCREEN = ["celled", "moving", "moving_cells", "gates", "patterns", "flagged", "scored"]
for _size in (0.003, 0.01):
    for _name in _SCREEN:
        _text = CTES[_name].replace(D(CELL), D(_size))
        CTES[f"size{int(_size * 1000)}_{_name}"] = re.sub(rf"\b(FROM|JOIN|,)\s+({'|'.join(_SCREEN)})\b(?=\s|\)|,|$)", lambda m, z=int(_size * 1000): f"{m[1]} size{z}_{m[2]}", _text)

# Candidates and controls alike, with what followed: the chain from ``after`` to ``relaxed`` over other rows.
CTES["anchored"] = """
SELECT date, mmsi_a, mmsi_b, t0, dcpa_nm, tcpa_min, state_skew_s, current_distance_nm, cell_id, 'candidate' AS anchor_type FROM episodes
UNION ALL SELECT o.date, o.mmsi_a, o.mmsi_b, o.g, o.dcpa_nm, o.tcpa_min, o.state_skew_s, o.current_distance_nm, o.cell_id, 'control' FROM picked p JOIN opps o ON o.mmsi_a = p.mmsi_a AND o.mmsi_b = p.mmsi_b AND o.g = p.g"""
_CHAIN = ["episodes", "after", "edges", "meets", "cover", "spots", "samples", "judged", "relaxed"]
for _name in _CHAIN[1:]:
    CTES[f"x_{_name}"] = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(_CHAIN)})\b", lambda m: f"{m[1]} {'anchored' if m[2] == 'episodes' else 'x_' + m[2]}", CTES[_name])
CTES["anchors"] = f"SELECT a.*, r.observable, r.actual_min_nm FROM anchored a JOIN x_relaxed r USING ({K})"


def sql(final: str, *materialized: str) -> str:
    """``final`` with all expressions that it needs, in order."""
    need, todo = set(), [final]
    while todo:
        for name in CTES:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s*\(?{name}\b", todo[0]):
                need.add(name)
                todo.append(CTES[name])
        todo.pop(0)
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in CTES.items() if k in need) + "\n" + final
