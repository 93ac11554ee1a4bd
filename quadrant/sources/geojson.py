"""GeoJSON FeatureCollections as DataFrames, and back.

Fields are read by a given schema, never inferred: what is absent or of another type is null, and a file that is no FeatureCollection gives no
rows. Order carries meaning in such files, so every row has its ``ordinal`` within its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: DDL of the coordinates of each geometry type, from the outermost array inwards.
COORDINATES = {"Point": "array<double>", "LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>", "MultiLineString": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def read_features(spark: SparkSession, path: str, properties: str, geometry: str = "Point") -> DataFrame:
    """(file, ordinal, the properties, then lon and lat of points or ``coordinates`` of anything else). Features without geometry stay, with nulls."""
    schema = f"type string, features array<struct<type: string, properties: struct<{_ddl(properties)}>, geometry: struct<type: string, coordinates: {COORDINATES[geometry]}>>>"
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = files.select(F.input_file_name().alias("file"), F.posexplode("features").alias("ordinal", "f"))
    rows = rows.select("file", "ordinal", "f.properties.*", F.col("f.geometry.coordinates").alias("coordinates"))
    if geometry != "Point":
        return rows
    return rows.withColumn("lon", F.get("coordinates", F.lit(0))).withColumn("lat", F.get("coordinates", F.lit(1))).drop("coordinates")


def _ddl(properties: str) -> str:
    """'name string, n int' as struct fields."""
    return ", ".join(f"{name}: {kind}" for name, kind in (p.strip().split(" ", 1) for p in properties.split(",")))


def line_points(coordinates: Column) -> Column:
    """ARRAY<STRUCT<lon, lat>> of a LineString's coordinates."""
    return F.transform(coordinates, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def polygon_rings(coordinates: Column) -> Column:
    """ARRAY<ARRAY<STRUCT<lon, lat>>> of a Polygon's coordinates."""
    return F.transform(coordinates, line_points)


def point_features(frame: DataFrame, properties: list[str]) -> DataFrame:
    """(value): one GeoJSON Feature per row, as text; absent properties are left out, a missing position gives a null geometry."""
    position = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), position.alias("geometry"))
    return frame.select(F.to_json(feature).alias("value"))


def write_features(frame: DataFrame, properties: list[str], path: str) -> None:
    """Newline-delimited GeoJSON, one file per partition."""
    point_features(frame, properties).write.mode("overwrite").text(path)
