"""GeoJSON layers and what may leave the house in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Grid
from ..functions.grid import ring

#: Fields that identify a vessel or a moment.
SENSITIVE = ("mmsi", "mmsi_a", "mmsi_b", "vessel_name", "imo", "call_sign", "track_id", "track_id_a", "track_id_b", "base_date_time", "timestamp_a", "timestamp_b", "track", "destination")
IDENTITY = r"(?<![0-9])[1-9][0-9]{8}(?![0-9])|[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"


def point_layer(df: DataFrame, score: str, properties: list[str], lon: str = "longitude", lat: str = "latitude", limit: int = 2000, digits: int = 4, tie: str = "ordinal") -> DataFrame:
    """The best rows as Point features, most first; the limit is the layer's own."""
    top = df.orderBy(F.desc(score), tie).limit(limit)
    return top.select(F.to_json(feature("Point", F.array(F.round(lon, digits), F.round(lat, digits)), properties)).alias("feature"))


def cell_layer(df: DataFrame, g: Grid, properties: list[str]) -> DataFrame:
    return df.select("cell_id", F.to_json(feature("Polygon", F.array(ring(F.col("col"), F.col("row"), g)), properties)).alias("feature"))


def line_layer(points: DataFrame, keys: list[str], digits: int = 4, most: int = 80) -> DataFrame:
    """Tracks with two positions or more as lines of at most ``most`` corners."""
    by = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "ordinal", F.round("longitude", digits).alias("x"), F.round("latitude", digits).alias("y")))).alias("p"))
    path = simplified(F.transform("p", lambda p: F.array(p["x"], p["y"])), most)
    return by.where(F.size("p") >= 2).select(*keys, F.to_json(feature("LineString", path, [])).alias("feature"))


def simplified(line: Column, most: int) -> Column:
    """At most ``most`` evenly spread corners, both ends among them."""
    last = F.size(line) - 1
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * last / (most - 1)).cast("int")))
    return F.when(F.size(line) <= most, line).otherwise(F.transform(places, lambda i: F.get(line, i)))


def feature(kind: str, coordinates: Column, properties: list[str]) -> Column:
    own = F.struct(*properties) if properties else F.create_map().cast("map<string,string>")
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), own.alias("properties"))


def collection(features: DataFrame, source_count: int, rule: str, limit: int | None = None) -> str:
    """A bounded layer as one document, with what it was chosen from."""
    rows = [r["feature"] for r in features.collect()]
    return '{"type":"FeatureCollection","metadata":{"source_count":%d,"published_count":%d,"geojson_limit":%s,"selection_rule":"%s"},"features":[%s]}' % (source_count, len(rows), "null" if limit is None else limit, rule, ",".join(rows))


#: Fields that are left out of public tables, and public names of others.
PRIVATE = (
    "mmsi mmsi_a mmsi_b track_id track_id_a track_id_b base_date_time time_bin reference_time start_time end_time prediction_time window_end predicted_closest_time actual_min_time "
    "continuous_min_time source_timestamp_a source_timestamp_b state_age_s_a state_age_s_b lon_a lat_a lon_b lat_b bearing_a bearing_b ground_track_course_a ground_track_course_b sog_a sog_b"
).split()
PUBLIC_NAMES = {
    "risk_score": "screening_score", "anomaly_score": "screening_score", "encounter_risk_score": "screening_score", "mean_anomaly_score": "mean_screening_score", "max_anomaly_score": "max_screening_score",
    "mean_encounter_score": "mean_encounter_evidence_score", "max_encounter_score": "max_encounter_evidence_score", "unique_mmsi": "unique_vessels", "unique_tracks": "unique_track_count",
    "unique_mmsi_day_sum": "unique_vessel_day_sum", "unique_tracks_day_sum": "unique_track_day_sum", "unique_anomaly_mmsi": "unique_anomaly_vessels", "unique_anomaly_tracks": "unique_anomaly_track_count",
}
HIDDEN = frozenset(SENSITIVE) | frozenset(PRIVATE)


def _walk(value: Column, kind: T.DataType, leaf: Callable[[Column, T.DataType], Column], name: Callable[[str], str | None]) -> Column:
    """A nested value with ``leaf`` applied to what is no struct, array or map, and fields under the name that ``name`` gives; None leaves one out. Of fields with one name the first stays."""
    if isinstance(kind, T.StructType):
        fields, taken = [], set()
        for f in kind.fields:
            new = name(f.name)
            if new is not None and new not in taken:
                taken.add(new)
                fields.append(_walk(value.getField(f.name), f.dataType, leaf, name).alias(new))
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, leaf, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _walk(v, kind.valueType, leaf, name))
    return leaf(value, kind)


def _walked(df: DataFrame, leaf: Callable[[Column, T.DataType], Column], name: Callable[[str], str | None]) -> DataFrame:
    columns, taken = [], set()
    for f in df.schema.fields:
        new = name(f.name)
        if new is not None and new not in taken:
            taken.add(new)
            columns.append(_walk(F.col(f"`{f.name}`"), f.dataType, leaf, name).alias(new))
    return df.select(*columns)


def sanitise(df: DataFrame, digits: int = 4) -> DataFrame:
    """Without identities and moments, at any depth; times become dates; coordinates, and arrays named ``coordinates``, are rounded."""
    for time in ("base_date_time", "time_bin", "start_time", "timestamp_a"):
        if time in df.columns and "date" not in df.columns:
            df = df.withColumn("date", F.substring(time, 1, 10))
    near = lambda x: F.floor(x * 10**digits + 0.5) / float(10**digits)
    out = _walked(df, lambda x, kind: x, lambda n: None if n in HIDDEN else n)

    def rounded(value: Column, kind: T.DataType, name: str = "") -> Column:
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[rounded(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rounded(x, kind.elementType, name))
        place = name == "coordinates" or name.startswith(("lon", "lat"))
        return near(value) if place and isinstance(kind, (T.DoubleType, T.FloatType)) else value

    return out.select(*[rounded(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in out.schema.fields])


def public_names(df: DataFrame, names: dict[str, str] = PUBLIC_NAMES) -> DataFrame:
    """Fields under their public names, at any depth."""
    return _walked(df, lambda x, kind: x, lambda n: names.get(n, n))


def named_fields(kind: T.DataType) -> set[str]:
    """Names of all fields, at any depth."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind.fields} | set().union(*[named_fields(f.dataType) for f in kind.fields]) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return named_fields(kind.elementType)
    return named_fields(kind.valueType) if isinstance(kind, T.MapType) else set()


def leaks(df: DataFrame) -> DataFrame:
    """Rows whose values hold an identity or a moment, or all of them if a field at any depth names one: there must be none."""
    if named_fields(df.schema) & HIDDEN:
        return df
    return df.where(F.to_json(F.struct(*df.columns)).rlike(IDENTITY))


def replace_terms(df: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Fields and whole text values under their public names, at any depth."""
    if not terms:
        return df
    named = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), F.lit(v))])
    text = lambda x, kind: F.coalesce(F.try_element_at(named, F.coalesce(x, F.lit(""))), x) if isinstance(kind, T.StringType) else x
    return _walked(df, text, lambda n: terms.get(n, n))
