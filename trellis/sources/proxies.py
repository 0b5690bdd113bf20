"""Tables of buildings, lines, photos and detections made of the driver's tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS building_id",
        "CAST(120000 + 12 * (p_partkey % 40) AS DOUBLE) AS x0",
        "CAST(485000 + 40 * (p_partkey div 40) AS DOUBLE) AS y0",
        "CAST(4 + p_partkey % 5 AS DOUBLE) AS w",
        "CAST(8 + p_partkey % 7 AS DOUBLE) AS d",
        "5 + p_size * CAST(0.5 AS DOUBLE) AS height_m",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 5 + p_size * CAST(0.5 AS DOUBLE) - (p_partkey % 4) END AS eaves_height_m",
        "CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1 + p_size % 6 END AS floor_count",
        "p_type AS roof_type",
        "1600 + p_partkey % 400 AS construction_year",
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building_id and its closed ring; every third one is clockwise."""
    corner = lambda x, y: F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y"))
    zero = F.lit(0.0)
    ring = F.array(corner(zero, zero), corner(F.col("w"), zero), corner(F.col("w"), F.col("d")), corner(zero, F.col("d")), corner(zero, zero))
    return buildings(spark, sf_dir).select("building_id", F.when(F.col("building_id") % 3 == 0, F.reverse(ring)).otherwise(ring).alias("ring"))


def lines(spark: SparkSession, sf_dir: str, above: float) -> DataFrame:
    y = (F.lit(485000) + 80 * F.col("n_nationkey") + F.lit(above)).cast("double")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line_id"), F.lit(119900.0).alias("ax"), y.alias("ay"), F.lit(121000.0).alias("bx"), y.alias("by"))


def waterways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, -10)


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, 34)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS photo_id",
        "CAST(120000 + (event_id * 7) % 480 AS DOUBLE) AS px",
        "CAST(485000 - 60 + (event_id * 13) % 2000 AS DOUBLE) AS py",
        "CASE WHEN event_type = 'error' THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END AS bearing_deg",
        "event_type IN ('view', 'click') AS is_pano",
        "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 500 END AS quality_score",
        "CAST(2018 + event_id % 7 AS INT) AS year",
        "CAST(1 + event_id % 12 AS INT) AS month",
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections, with their place in the building's list."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = read(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order)))
    return rows.selectExpr(
        "l_partkey AS building_id",
        "ord",
        "CASE WHEN l_linenumber <= 4 THEN 'window' WHEN l_linenumber = 5 THEN 'door' WHEN l_linenumber = 6 THEN 'chimney' ELSE 'balcony' END AS cls",
        "least(l_discount * 10, CAST(1.0 AS DOUBLE)) AS score",
        "CAST((l_orderkey * 7 + l_linenumber * 13) % 100 AS DOUBLE) AS cx",
        "CAST((l_suppkey * 11 + l_linenumber * 29) % 100 AS DOUBLE) AS cy",
        "CAST(2 + CAST(l_quantity AS INT) % 4 AS DOUBLE) AS hw",
    )
