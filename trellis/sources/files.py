"""Readers with declared schemas, checks of tables, tiles, and deduplication by first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions import geo

PHOTO_RECORD = "id string, computed_geometry struct<coordinates: array<double>>, compass_angle double, computed_altitude double, captured_at long, is_pano boolean, thumb_1024_url string, quality_score double"
BUILDING_RECORD = "geometry struct<type: string, coordinates: string>, properties struct<identificatie: string, b3_h_max: double, b3_h_maaiveld: double, b3_h_70p: double, b3_bouwlagen: int, b3_dak_type: string, oorspronkelijkbouwjaar: int, b3_opp_grond: double>"


class SchemaError(ValueError):
    """A table does not have the columns that were declared."""


def checked(df: DataFrame, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """The frame, if its names and types are as declared; null in a required column fails the query."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaError(f"columns that are missing or of another type: {', '.join(wrong)}")
    out = df
    for c in required:
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast(have[c])).otherwise(F.col(c)))
    return out


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def photos(records: DataFrame) -> DataFrame:
    """Photo records as rows: without a place they go; a compass below 0 is unknown; times are epoch milliseconds."""
    place = F.col("computed_geometry.coordinates")
    bearing = F.when(F.col("compass_angle") >= 0, F.pmod(F.col("compass_angle"), F.lit(360.0)))
    return records.where(place[0].isNotNull() & place[1].isNotNull()).select(F.col("id").alias("photo_id"), place[0].alias("lon"), place[1].alias("lat"), bearing.alias("bearing_deg"), F.col("computed_altitude").alias("altitude_m"), F.timestamp_millis("captured_at").alias("captured_at"), F.coalesce("is_pano", F.lit(False)).alias("is_pano"), F.col("thumb_1024_url").alias("url"), "quality_score")


def first_by(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Of each key the first row in the order given; no row number leaves a partition of keys."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def buildings(features: DataFrame) -> DataFrame:
    """Heights above ground of building features; the eaves are those of the 70th percentile of the roof."""
    p = "properties."
    ground = F.col(p + "b3_h_maaiveld")
    return features.select(F.col(p + "identificatie").alias("building_id"), (F.col(p + "b3_h_max") - ground).alias("height_m"), (F.col(p + "b3_h_70p") - ground).alias("eaves_height_m"), ground.alias("ground_altitude_m"), F.col(p + "b3_bouwlagen").alias("floor_count"), F.col(p + "b3_dak_type").alias("roof_type"), F.col(p + "oorspronkelijkbouwjaar").alias("construction_year"), F.col(p + "b3_opp_grond").alias("footprint_area_m2"))


def lines(df: DataFrame, tag: str, *, polygons: bool = False) -> DataFrame:
    """Street or water lines as text, by id as text; a missing name is empty."""
    kinds = ["LINESTRING", "MULTILINESTRING", *(["POLYGON", "MULTIPOLYGON"] if polygons else [])]
    name = F.coalesce(F.col("name").cast("string"), F.lit("")) if "name" in df.columns else F.lit("")
    kind = F.upper(F.regexp_extract("geometry_wkt", "^\\s*([A-Za-z]+)", 1))
    value = F.coalesce(F.col(tag).cast("string"), F.lit("water")) if polygons else F.col(tag).cast("string")
    return df.where(kind.isin(kinds)).select(F.col("osm_id").cast("string").alias("osm_id"), value.alias(tag), name.alias("name"), "geometry_wkt").orderBy("osm_id")


def wkt_segments(df: DataFrame, wkt: str = "geometry_wkt") -> DataFrame:
    """The rows exploded to the segments (ax, ay, bx, by) of their lines and rings."""
    parts = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    points = F.transform(F.split(F.col("_part"), ","), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda x: x.cast("double")))
    rows = df.withColumn("_part", F.explode(parts)).withColumn("_points", points)
    pairs = F.zip_with(F.slice("_points", F.lit(1), F.size("_points") - 1), F.slice("_points", F.lit(2), F.size("_points") - 1), lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))
    return rows.where(F.size("_points") > 1).withColumn("_s", F.explode(pairs)).select(*df.columns, "_s.*")


def tiles(spark: SparkSession, box: tuple[float, float, float, float], grid: int = 4, depth: int = 0) -> DataFrame:
    """The box in grid x grid tiles, by columns; each cut in four `depth` times."""
    x0, y0, x1, y1 = box
    n = grid << depth
    cells = spark.range(n * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))
    at = lambda a, b, k: F.lit(a) + (F.lit(b) - F.lit(a)) * k / F.lit(float(n))
    return cells.select("i", "j", at(x0, x1, F.col("i")).alias("min_x"), at(y0, y1, F.col("j")).alias("min_y"), at(x0, x1, F.col("i") + 1).alias("max_x"), at(y0, y1, F.col("j") + 1).alias("max_y"))


def buffered(boxes: DataFrame, metres: float) -> DataFrame:
    """Boxes of lon/lat (min_lon, min_lat, max_lon, max_lat), wider by so many metres of the grid on each side."""
    out = boxes
    for end, sign in (("min", -metres), ("max", metres)):
        x, y = geo.to_grid(F.col(f"{end}_lon"), F.col(f"{end}_lat"))
        out = out.withColumn("_at", F.array(F.struct((x + sign).alias("x"), (y + sign).alias("y"))))
        # a lambda binds the point once; written out, each power would repeat its whole expression
        out = out.withColumn("_at", F.transform("_at", lambda p: F.struct(*(v.alias(k) for k, v in zip(("lon", "lat"), geo.to_lonlat(p["x"], p["y"]), strict=True))))[0])
        out = out.withColumn(f"{end}_lon", F.col("_at.lon")).withColumn(f"{end}_lat", F.col("_at.lat")).drop("_at")
    return out
