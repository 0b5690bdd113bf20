"""What a photo of a front looks like: the view's bearing and pitch, and where points of the world fall in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.config import DEFAULTS, Options
from trellis.functions import geo


def focal_px(o: Options = DEFAULTS) -> Column:
    return F.lit(o.view_width / 2.0) / F.tan(F.radians(F.lit(o.view_fov_deg / 2.0)))


def vertical(altitude_m: Column, ground_m: Column, o: Options = DEFAULTS) -> tuple[Column, Column]:
    """Heights of the camera and of the ground: as known, or an eye's height above a ground of 0."""
    return F.coalesce(altitude_m, F.lit(o.camera_height_m)), F.when(altitude_m.isNotNull(), ground_m).otherwise(F.lit(0.0))


def pitch_deg(metres: Column, roof_above_m: Column, o: Options = DEFAULTS) -> Column:
    """The least upward pitch that leaves a strip of sky above the roof; 0 on the spot."""
    half = F.degrees(F.atan2(F.lit(o.view_height / 2.0), focal_px(o)))
    return F.when(metres < 1e-6, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.degrees(F.atan2(roof_above_m, metres)) - half + F.lit(o.sky_margin_deg)))


def with_pixels(rows: DataFrame, camera: geo.Point, point: geo.Point, above_m: Column, yaw_deg: Column, pitch: Column, o: Options = DEFAULTS) -> DataFrame:
    """The rows with x and y of a lon/lat point so far above the camera; null on the spot and behind the camera.

    The point is taken apart into metres ahead, to the right and above; the pitch turns ahead and above. Each step is a
    column of its own, so that none is written out again in the next.
    """
    metres, bearing = geo.geodesic(camera, point)
    out = rows.withColumns({"_far": metres, "_turn": F.radians(bearing - yaw_deg), "_tilt": F.radians(pitch), "_up": above_m})
    out = out.withColumns({"_ahead": F.col("_far") * F.cos("_turn"), "_right": F.col("_far") * F.sin("_turn")})
    out = out.withColumns({"_depth": F.col("_ahead") * F.cos("_tilt") + F.col("_up") * F.sin("_tilt"), "_rise": F.col("_up") * F.cos("_tilt") - F.col("_ahead") * F.sin("_tilt")})
    seen = (F.col("_far") >= 1e-6) & (F.col("_depth") > F.lit(1e-9) * F.sqrt(F.col("_far") * F.col("_far") + F.col("_up") * F.col("_up")))
    out = out.withColumn("_scale", F.when(seen, focal_px(o) / F.col("_depth")))
    out = out.withColumns({"x": F.lit(o.view_width / 2.0) + F.col("_right") * F.col("_scale"), "y": F.lit(o.view_height / 2.0) - F.col("_rise") * F.col("_scale")})
    return out.drop("_far", "_turn", "_tilt", "_up", "_ahead", "_right", "_depth", "_rise", "_scale")


def box(o: Options = DEFAULTS) -> Column:
    """Aggregate of x and y: struct(x0, y0, x1, y1) around the points that are not null, widened by a margin and cut to the view; null for fewer than two."""
    low_x, high_x, low_y, high_y = F.min("x"), F.max("x"), F.min("y"), F.max("y")
    dx, dy = (high_x - low_x) * o.bbox_margin, (high_y - low_y) * o.bbox_margin
    start = lambda v: F.greatest(F.lit(0), v.cast("int"))
    end = lambda v, most: F.least(F.lit(most), v.cast("int"))
    return F.when(F.count("x") >= 2, F.struct(start(low_x - dx).alias("x0"), start(low_y - dy).alias("y0"), end(high_x + dx, o.view_width).alias("x1"), end(high_y + dy, o.view_height).alias("y1")))
