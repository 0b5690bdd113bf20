"""Detections of a front: winners, statistics, rows and columns, and the grid of labelled cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.config import DEFAULTS, Options

SIDE = 100.0  # the front's box is (0, 0, SIDE, SIDE)


def first_best(value: Column, score: Column, order: Column) -> Column:
    """The value with the greatest score, of equals the first."""
    return F.max_by(value, F.struct(score, -order))


def in_container(rows: DataFrame, box: tuple[float, float, float, float], least: float) -> DataFrame:
    """Detections of at least that score whose centre lies in the box, its edges included."""
    return rows.where((F.col("score") >= least) & F.col("cx").between(box[0], box[2]) & F.col("cy").between(box[1], box[3]))


def best_candidate(rows: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Of each building the first candidate that is clear enough, or else the first: one pass."""
    best = F.min_by(F.struct("photo_id", "rank", "ratio"), F.struct(F.col("ratio") > o.max_occluder_ratio, "rank"))
    return rows.groupBy("building_id").agg(best.alias("b")).select("building_id", "b.*")


def mask_reason(o: Options = DEFAULTS) -> Column:
    """Why a mask (share, and which edges it touches) is rejected, else null."""
    return F.when(F.col("share") < o.min_mask_ratio, "tiny").when(F.col("share") > o.max_mask_ratio, "huge").when(F.col("top") & F.col("bottom"), "vertical_crop").when(F.col("left") & F.col("right"), "horizontal_crop")


def histogram_bin(v: Column, n_bins: int) -> Column:
    """The bin of a value in [0, 1], by its edges as floating-point numbers (a floor alone is off by one at some edges)."""
    step = F.lit(1.0 / n_bins)
    i = F.least(F.floor(v * n_bins), F.lit(n_bins - 1))
    return F.when(v < i * step, i - 1).when((v >= (i + 1) * step) & (i < n_bins - 1), i + 1).otherwise(i).cast("int")


def kernel(sigma: float) -> list[float]:
    radius = max(1, int(3 * sigma))
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def peaks(bins: Column, o: Options = DEFAULTS) -> Column:
    """Centres of the peaks of an array of bin numbers: counts, smoothed; inner maxima of at least a share of the greatest."""
    n, weights = o.n_bins, kernel(o.smooth_sigma)
    radius = len(weights) // 2
    counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(bins, lambda b: b == i)).cast("double"))
    at = lambda a, i: F.when((i >= 0) & (i < n), F.get(a, i)).otherwise(F.lit(0.0))

    def smooth(a: Column) -> Column:
        def value(i: Column) -> Column:
            total = None
            for k, w in enumerate(weights):
                part = F.lit(w) * at(a, i + F.lit(k - radius))
                total = part if total is None else total + part
            return total

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)

    def found(a: Column) -> Column:
        least = F.array_max(a) * F.lit(o.min_prominence)
        inner = F.filter(F.sequence(F.lit(1), F.lit(n - 2)), lambda i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) >= F.get(a, i + 1)) & (F.get(a, i) >= least))
        return F.transform(inner, lambda i: (i * F.lit(1.0 / n) + (i + 1) * F.lit(1.0 / n)) / 2)

    smoothed = F.transform(F.array(counts), smooth)
    return F.when(F.size(bins) > 0, F.get(F.transform(smoothed, found), F.lit(0))).otherwise(F.array().cast("array<double>"))


def fitted(instances: DataFrame, buildings: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """One row for each front with enough windows: rows, columns, sizes, door, gable and metres."""
    w, door = F.col("cls") == "window", F.col("cls") == "door"
    x, y = F.col("cx") / SIDE, F.col("cy") / SIDE
    size = F.least(F.greatest(2 * F.col("hw") / SIDE, F.lit(0.0)), F.lit(1.0))
    rows = instances.groupBy("building_id").agg(
        F.count_if(w).alias("n_windows"),
        F.count_if(door).alias("n_doors"),
        F.avg(F.when(w, size)).alias("window_mean"),
        F.stddev_pop(F.when(w, size)).alias("window_std"),
        F.collect_list(F.when(w, histogram_bin(y, o.n_bins))).alias("_y"),
        F.collect_list(F.when(w, histogram_bin(x, o.n_bins))).alias("_x"),
        first_best(F.when(door, F.struct(x.alias("x"), y.alias("y"))), F.when(door, F.col("score")), F.col("ord")).alias("_door"),
    ).where(F.col("n_windows") >= o.min_windows)
    rows = rows.withColumn("row_centers", peaks(F.col("_y"), o)).withColumn("col_centers", peaks(F.col("_x"), o))
    rows = rows.withColumn("n_floors", F.greatest(F.size("row_centers"), F.lit(1))).withColumn("n_columns", F.size("col_centers"))
    r = F.col("row_centers")
    gable = F.array_min(r) - F.col("window_mean") / 2
    nearest = F.array_min(F.transform(r, lambda c, i: F.struct(F.abs(c - F.col("_door.y")).alias("d"), i.alias("i"))))["i"]
    out = rows.join(buildings, "building_id")
    return out.select(
        "building_id", "n_floors", "n_columns", "row_centers", "col_centers",
        F.when(F.size(r) >= 2, F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: (a + b) / 2)).otherwise(F.array().cast("array<double>")).alias("floor_splits"),
        "window_mean", "window_std", "n_windows", "n_doors",
        F.when((F.size(r) > 0) & F.col("_door.y").isNotNull(), nearest).alias("door_floor_idx"),
        F.when(F.col("_door.x").isNotNull(), F.least(F.greatest(F.col("_door.x"), F.lit(0.0)), F.lit(1.0))).alias("door_x_center"),
        F.when(gable > 0, gable).alias("gable_y_end"),
        F.col("w").alias("facade_width_m"), F.col("height_m").alias("facade_height_m"),
        (F.col("height_m") / F.col("n_floors")).alias("floor_height_m"),
        (F.col("window_mean") * F.col("w")).alias("window_w_mean_m"), (F.col("window_mean") * F.col("height_m")).alias("window_h_mean_m"),
        (F.col("height_m") - F.col("eaves_height_m")).alias("gable_prominence_m"),
        F.col("construction_year").alias("bag_construction_year"), F.col("roof_type").alias("bag_roof_type"),
        F.col("floor_count").alias("bag_floor_count"), (F.col("n_floors") == F.col("floor_count")).alias("n_floors_matches_bag"),
    )


def boundaries(points: Column, gap: float = 0.02) -> Column:
    """Sorted distinct points, to nine places, so that sums in any order agree; one too near the last that was kept goes, and the last becomes 1."""
    ordered = F.array_sort(F.array_distinct(F.transform(points, lambda p: F.round(p, 9))))
    merged = F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), lambda out, p: F.when(p > F.element_at(out, -1) + gap, F.concat(out, F.array(p))).otherwise(out))
    return F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(F.lit(1.0)))


def around(centers: Column, half: Column) -> Column:
    """Both edges of each centre, within [0, 1]."""
    return F.flatten(F.transform(centers, lambda c: F.array(F.greatest(F.lit(0.0), c - half), F.least(F.lit(1.0), c + half))))


def with_boundaries(fit: DataFrame) -> DataFrame:
    half = F.col("window_mean") / 2
    ends = F.array(F.lit(0.0), F.lit(1.0))
    gable = F.when((F.col("gable_y_end") > 0) & (F.col("gable_y_end") < 1), F.array("gable_y_end")).otherwise(F.array().cast("array<double>"))
    cols = F.when(F.size("col_centers") > 0, boundaries(F.concat(ends, around(F.col("col_centers"), half)))).otherwise(ends)
    return fit.withColumn("row_boundaries", boundaries(F.concat(ends, gable, F.col("floor_splits"), around(F.col("row_centers"), half)))).withColumn("col_boundaries", cols)


def bin_index(v: Column, b: Column) -> Column:
    """The last boundary not above the value, as a cell number."""
    return F.least(F.greatest(F.size(F.filter(b, lambda x: x <= v)) - 1, F.lit(0)), F.size(b) - 2)


def lattice(fit: DataFrame, instances: DataFrame) -> DataFrame:
    """Every cell of every front's grid, with its best detection or else wall."""
    grids = with_boundaries(fit).select("building_id", "row_boundaries", "col_boundaries")
    x, y = F.col("cx") / SIDE, F.col("cy") / SIDE
    hits = instances.where(x.between(0, 1) & y.between(0, 1)).join(grids, "building_id")
    hits = hits.select("building_id", bin_index(y, F.col("row_boundaries")).alias("row"), bin_index(x, F.col("col_boundaries")).alias("col"), "cls", "score", "ord")
    won = hits.groupBy("building_id", "row", "col").agg(first_best(F.struct("cls", "score"), F.col("score"), F.col("ord")).alias("b"))
    cells = grids.select("building_id", F.size("col_boundaries").alias("n"), F.explode(F.sequence(F.lit(0), F.size("row_boundaries") - 2)).alias("row"))
    cells = cells.select("building_id", "row", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("col"))
    out = cells.join(won, ["building_id", "row", "col"], "left")
    return out.select("building_id", "row", "col", F.coalesce("b.cls", F.lit("wall")).alias("cls"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
