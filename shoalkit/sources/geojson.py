"""Polygon layers from GeoJSON through Spark's JSON functions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalkit.functions.datum import WGS84, known_datum, shift_datum

_FEATURE = "struct<type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
_OBJECT = (
    f"struct<type: string, features: array<{_FEATURE}>, properties: map<string,string>, "
    "geometry: struct<type: string, coordinates: string>>"
)


def _parsed(text):
    """The JSON objects of a text as an array. In brackets, text after an object is an error too;
    what cannot be read gives one object without content."""
    unread = F.array(F.lit(None).cast(_OBJECT))
    return F.coalesce(F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{_OBJECT}>"), unread)


def _objects():
    """The JSON objects of a file: one per line if the first line is one, else the whole text."""
    lines = F.filter(F.split("value", "\n"), lambda line: F.trim(line) != "")
    by_line = F.coalesce(F.get(_parsed(F.get(lines, F.lit(0))), F.lit(0))["type"].isNotNull(), F.lit(False))
    return F.when(by_line, F.flatten(F.transform(lines, _parsed))).otherwise(_parsed(F.col("value")))


def _clean(key, _):
    return F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]+", "_")


def _rings():
    text = F.col("f.geometry.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    nested = F.when(F.col("f.geometry.type") == "Polygon", polygon).when(
        F.col("f.geometry.type") == "MultiPolygon", F.flatten(many)
    )
    return F.transform(nested, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def in_datum(polygons: DataFrame, source: int, target: int = WGS84) -> DataFrame:
    """Polygons with the corners of their rings brought from one datum to another."""
    if known_datum(source) == known_datum(target):
        return polygons
    corner = "struct<x:double,y:double>"
    moved = lambda p: shift_datum(p.x, p.y, source, target).dropFields("height").cast(corner)
    return polygons.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, moved)))


def read_polygons(spark: SparkSession, path: str, name_property="bioregion", crs=WGS84) -> DataFrame:
    """(feature, bioregion, rings, bbox) of every Polygon and MultiPolygon feature.

    ``path`` is a file or a folder. Each file is read by its own content: a
    FeatureCollection, a Feature on any number of lines, or one of these per line.
    ``feature`` is the file and the position in it, so a polygon listed twice is two
    features. Property names are compared in lower case with underscores. Coordinates
    are longitude and latitude in the datum ``crs`` (an EPSG code); they are returned in WGS84.

    Raises ``ValueError`` if a file holds no feature, a feature gives no polygon, or no
    feature has the property ``name_property``. A file is one row while it is read, as
    polygon layers are small beside the points.
    """
    known_datum(crs)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _objects().alias("objects"))
    own = lambda o: F.array(F.struct(
        o["type"].alias("type"), o["properties"].alias("properties"), o["geometry"].alias("geometry")))
    features = F.flatten(F.transform("objects", lambda o: F.coalesce(o["features"], own(o))))
    placed = files.select("file", F.posexplode_outer(features).alias("position", "f")).select(
        "file", F.concat_ws("#", "file", "position").alias("feature"),
        F.transform_keys("f.properties", _clean).alias("properties"), _rings().alias("rings"))
    # The layer is counted once before it is used: what cannot be read must not be lost.
    unread, n, named = placed.agg(
        F.count_if(F.col("rings").isNull()), F.count(F.lit(1)),
        F.count_if(F.coalesce(F.map_contains_key("properties", name_property), F.lit(False)))).first()
    if unread or not n:
        raise ValueError(f"{path}: {unread} of {n} features or files give no polygon")
    if not named:
        raise ValueError(f"{path}: no feature has the property {name_property}")
    named = placed.select("feature", F.col("properties")[name_property].alias("bioregion"), "rings")
    return with_bbox(in_datum(named, crs))


def with_bbox(polygons: DataFrame) -> DataFrame:
    """Add the bounding box of every feature."""
    points = F.flatten("rings")
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    box = F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )
    return polygons.select("feature", "bioregion", "rings", box.alias("bbox"))
