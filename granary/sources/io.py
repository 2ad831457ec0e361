"""Readers with explicit schemas and sinks with fixed decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = "field string, date date, pixels int, clear_fraction double, haze_score double, flag string"
SCENE = "id string, ts timestamp, cloud double, baseline string, crs string, orbit_state string, relative_orbit int, assets map<string,string>"
PIXEL = "block string, row int, col int, date date, b02 int, b03 int, b04 int, b05 int, b08 int, b8a int, b11 int, scl int"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header and quoted text; empty cells are null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="")


def read_geojson(spark: SparkSession, path: str, props: list[str]) -> DataFrame:
    """(name, props..., ring) of the polygons of a FeatureCollection; fails at a missing or repeated name.

    The outer ring only; other geometries are left out.
    """
    geometry = "geometry struct<type:string,coordinates:array<array<array<double>>>>"
    kind = f"features array<struct<properties:map<string,string>,{geometry}>>"
    f = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry.type = 'Polygon'")
    out = f.select(F.col("f.properties")["name"].alias("name"), *(F.col("f.properties")[p].alias(p) for p in props), F.transform(F.col("f.geometry.coordinates")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))).alias("ring"))
    n = out.groupBy("name").agg(F.count("*").alias("n")).withColumn("ok", F.assert_true(F.col("name").isNotNull() & (F.col("n") == 1), "a field has no name or a repeated one"))
    return out.join(n.where("ok is null").select("name"), "name")


def scenes_per_day(scenes: DataFrame, max_cloud: float) -> DataFrame:
    """The least cloudy scene of each day below a limit, in order of time."""
    from granary.operators.joins import best_per_group

    return best_per_group(scenes.where(F.col("cloud") < max_cloud), [F.to_date("ts")], [F.col("cloud"), F.col("id")]).orderBy("ts")


def dominant_orbit(scenes: DataFrame) -> DataFrame:
    """The passes of the relative orbit that has most, the first seen on ties."""
    n = scenes.groupBy("relative_orbit").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return scenes.join(F.broadcast(n.orderBy(F.desc("n"), "first").limit(1).select("relative_orbit")), "relative_orbit")


def rounded(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Columns rounded half to even for a text sink."""
    return df.select(*(F.bround(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    rounded(df, decimals or {}).write.mode("overwrite").csv(path, header=True, escape='"')


def features(df: DataFrame, ring: str = "ring", digits: int = 7) -> DataFrame:
    """(value): one GeoJSON feature a row, coordinates with fixed digits, for a text sink."""
    coords = F.array(F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))
    props = F.struct(*(c for c in df.columns if c != ring))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))).alias("value"))


def map_link(lat, lon):
    return F.format_string("geo:%.6f,%.6f", lat, lon)


def wide(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide with known names; the sink's matrix."""
    return df.groupBy(key).pivot(name, names).agg(F.first(value))


def long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.unpivot([key], columns, "name", "value")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
