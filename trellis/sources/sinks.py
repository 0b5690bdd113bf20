"""Writers of results. Folders of parts, written by the tasks that hold the rows; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_rows(instances: DataFrame, fit: DataFrame, works: DataFrame) -> DataFrame:
    """A row for each detection of a fitted front: pixel box, box in parts of the front, and the building's figures."""
    own = fit.select("building_id", F.col("bag_construction_year").alias("building_year"), "facade_width_m", "facade_height_m")
    rows = instances.join(own, "building_id").join(works.select("building_id", "photo_id"), "building_id", "left")
    corner = {"x0": F.col("cx") - F.col("hw"), "y0": F.col("cy") - F.col("hw"), "x1": F.col("cx") + F.col("hw"), "y1": F.col("cy") + F.col("hw")}
    pixels = [v.cast("int").alias(k) for k, v in corner.items()]
    return rows.select("building_id", "photo_id", "cls", *pixels, "score", *[(v / 100).alias(f"{k}_norm") for k, v in corner.items()], "building_year", "facade_width_m", "facade_height_m")


def summary_line(width: int = 16) -> Column:
    """One line of text on a fitted front."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    match = F.when(F.col("n_floors_matches_bag"), "✓").when(~F.col("n_floors_matches_bag"), "✗").otherwise("—")
    gable = F.when(F.col("gable_prominence_m").isNotNull(), F.format_string("%.1fm", "gable_prominence_m")).otherwise("?")
    parts = F.right(F.col("building_id").cast("string"), F.lit(width)), known("bag_construction_year"), known("bag_roof_type"), F.col("n_floors"), known("bag_floor_count"), match, F.col("n_columns"), F.col("n_windows"), F.col("facade_width_m"), F.col("facade_height_m"), gable
    return F.format_string("  %s  yr=%s  roof=%s  floors=%d/%s%s  cols=%d  w=%d  facade=%.1fx%.1fm  gable=%s", *parts)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """JSON lines in the order of building_id, over sorted parts."""
    write_json(df.orderBy("building_id"), path)


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    """A result of several tables (rules, roots, parses, scalars): a folder of JSON lines for each."""
    for name, df in tables.items():
        write_json(df, f"{path}/{name}")


def write_masks(df: DataFrame, path: str) -> None:
    """Masks as bytes of PNG beside their keys."""
    df.withColumn("png", F.unbase64("mask")).drop("mask").write.mode("overwrite").parquet(path)
