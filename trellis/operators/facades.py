"""Footprint edges, their classes, and the photos that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.config import DEFAULTS, Options
from trellis.functions import geo


def edges(footprints: DataFrame) -> DataFrame:
    """Edges of closed rings, counter-clockwise, with midpoint and outward unit normal."""
    ring = geo.counter_clockwise(F.col("ring"))
    rows = footprints.select("building_id", ring.alias("r"))
    n = F.size("r") - 1
    pairs = F.zip_with(F.slice("r", F.lit(1), n), F.slice("r", F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    rows = rows.select("building_id", F.posexplode(pairs).alias("edge", "e")).select("building_id", "edge", "e.*")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt(dx * dx + dy * dy)
    normal = geo.outward_normal((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
    return rows.select("*", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"), (dy / size).alias("nx"), (-dx / size).alias("ny"), normal.alias("normal_deg"))


def cells_of_segments(lines: DataFrame, size: float) -> DataFrame:
    """Segments with every grid cell that their boxes cover: what makes a range join an equi-join."""
    low = lambda a, b: F.floor(F.least(a, b) / size)
    high = lambda a, b: F.floor(F.greatest(a, b) / size)
    out = lines.withColumn("gx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx"))))
    return out.withColumn("gy", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))


def faces(edge_rows: DataFrame, lines: DataFrame, near_m: float, cos_min: float) -> DataFrame:
    """building_id and edge of the edges with a line within near_m of the midpoint, ahead of it."""
    grid = cells_of_segments(lines.select("ax", "ay", "bx", "by"), near_m).select(*(F.col(c).alias(f"l_{c}") for c in ("ax", "ay", "bx", "by")), "gx", "gy")
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    mine = edge_rows.select("building_id", "edge", "mx", "my", "nx", "ny")
    mine = mine.withColumn("gx", F.explode(F.transform(around, lambda k: F.floor(F.col("mx") / near_m) + k))).withColumn("gy", F.explode(F.transform(around, lambda k: F.floor(F.col("my") / near_m) + k)))
    at = geo.nearest_on_segment((F.col("mx"), F.col("my")), (F.col("l_ax"), F.col("l_ay")), (F.col("l_bx"), F.col("l_by")))
    dx, dy = at[0] - F.col("mx"), at[1] - F.col("my")
    far = F.sqrt(dx * dx + dy * dy)
    ahead = (far < 1e-6) | ((dx * F.col("nx") + dy * F.col("ny")) / far >= cos_min)
    return mine.join(grid, ["gx", "gy"]).where((far <= near_m) & ahead).select("building_id", "edge").distinct()


def classified(edge_rows: DataFrame, waterways: DataFrame, streets: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Edges with their class: canal before street before other."""
    canal = faces(edge_rows, waterways, o.canal_near_m, o.forward_cos_min).withColumn("canal", F.lit(True))
    street = faces(edge_rows, streets, o.street_near_m, o.forward_cos_min).withColumn("street", F.lit(True))
    out = edge_rows.join(canal, ["building_id", "edge"], "left").join(street, ["building_id", "edge"], "left")
    return out.withColumn("classification", F.when(F.col("canal"), "canal").when(F.col("street"), "street").otherwise("other")).drop("canal", "street")


def longest_canal(classified_rows: DataFrame) -> DataFrame:
    """Of each building the longest canal edge; of equals the one with the greater start. One aggregation, no sort."""
    rows = classified_rows.where("classification = 'canal'")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    best = F.max_by(F.struct("edge", "ax", "ay", "bx", "by", "mx", "my", "nx", "ny", "normal_deg"), F.struct((dx * dx + dy * dy).alias("l"), "ax", "ay"))
    return rows.groupBy("building_id").agg(best.alias("f")).select("building_id", "f.*")


def candidates(facades: DataFrame, photos: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Facades with the photos in their box: the box is the key of the join, and each pair comes once."""
    size = o.photo_max_dist_m
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    left = facades.withColumn("gx", F.explode(F.transform(around, lambda k: F.floor(F.col("mx") / size) + k))).withColumn("gy", F.explode(F.transform(around, lambda k: F.floor(F.col("my") / size) + k)))
    right = photos.withColumn("gx", F.floor(F.col("px") / size)).withColumn("gy", F.floor(F.col("py") / size))
    rows = left.join(right, ["gx", "gy"]).drop("gx", "gy")
    rows = rows.where((F.abs(F.col("px") - F.col("mx")) <= size) & (F.abs(F.col("py") - F.col("my")) <= size))
    inward = F.pmod(F.col("normal_deg") + 180, F.lit(360.0))
    rows = rows.withColumn("dist_m", geo.segment_distance((F.col("px"), F.col("py")), (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))))
    rows = rows.withColumn("perp_deg", geo.angle_between(geo.azimuth(F.col("mx") - F.col("px"), F.col("my") - F.col("py")), inward))
    return rows.withColumn("ahead", (F.col("px") - F.col("mx")) * F.col("nx") + (F.col("py") - F.col("my")) * F.col("ny"))


def reject_reason(o: Options = DEFAULTS) -> F.Column:
    """The first hard filter that a candidate fails, else null."""
    inward = F.pmod(F.col("normal_deg") + 180, F.lit(360.0))
    out = F.when((F.col("dist_m") < o.photo_min_dist_m) | (F.col("dist_m") > o.photo_max_dist_m), "distance")
    out = out.when(~F.col("is_pano") & (F.col("dist_m") > o.perspective_max_dist_m), "perspective_distance").when(F.col("ahead") <= 0, "behind")
    if o.min_quality_score is not None:
        out = out.when(F.col("quality_score") < o.min_quality_score, "quality")
    out = out.when(F.col("perp_deg") > o.max_perpendicularity_deg, "perpendicularity")
    if o.winter_only:
        out = out.when(~F.col("month").isin(*o.winter_months), "winter")
    if o.pano_only:
        out = out.when(~F.col("is_pano"), "pano")
    wrong = F.col("bearing_deg").isNull() | (geo.angle_between(F.col("bearing_deg"), inward) > o.bearing_tol_deg)
    return out.when(~F.col("is_pano") & wrong, "bearing")


def with_crossing(rows: DataFrame, waterways: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Whether the line of sight meets a waterway: an equi-join on the cells that both cover."""
    size = o.photo_max_dist_m
    sights = cells_of_segments(rows.select("building_id", "photo_id", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("mx").alias("bx"), F.col("my").alias("by")), size)
    grid = cells_of_segments(waterways.select("ax", "ay", "bx", "by"), size).select(*(F.col(c).alias(f"l_{c}") for c in ("ax", "ay", "bx", "by")), "gx", "gy")
    p = lambda x, y: (F.col(x), F.col(y))
    met = sights.join(grid, ["gx", "gy"]).where(geo.segments_meet(p("ax", "ay"), p("bx", "by"), p("l_ax", "l_ay"), p("l_bx", "l_by"))).select("building_id", "photo_id").distinct()
    return rows.join(met.withColumn("crosses", F.lit(True)), ["building_id", "photo_id"], "left").withColumn("crosses_water", F.coalesce("crosses", F.lit(False))).drop("crosses")


def top_photos(rows: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """The best photos of each facade, ranked from 0: across water, newer, winter, head-on, better, nearer."""
    winter = F.col("month").isin(*o.winter_months)
    order = [F.when(F.col("crosses_water"), 0).otherwise(1), F.col("year").desc(), F.when(winter, 0).otherwise(1), F.col("perp_deg"), F.coalesce("quality_score", F.lit(0.0)).desc(), F.col("dist_m"), F.col("photo_id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("building_id").orderBy(*order)) - 1).where(F.col("rank") < o.top_k)
