"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.config import DEFAULTS as O
from trellis.functions import camera, geo
from trellis.operators import facades, fit, grammar
from trellis.plans import grids_sql
from trellis.sources import files, proxies, sinks
from trellis.sources.tables import written


def _edges(s: SparkSession, d: str) -> DataFrame:
    return facades.edges(proxies.footprints(s, d))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return facades.classified(_edges(s, d), proxies.waterways(s, d), proxies.streets(s, d))


def _canal(s: SparkSession, d: str) -> DataFrame:
    return facades.longest_canal(_classified(s, d))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return facades.candidates(_canal(s, d), proxies.photos(s, d))


def _top(s: SparkSession, d: str) -> DataFrame:
    rows = _candidates(s, d).where(facades.reject_reason().isNull())
    return facades.top_photos(facades.with_crossing(rows, proxies.waterways(s, d)))


def _fit(s: SparkSession, d: str) -> DataFrame:
    return fit.fitted(proxies.instances(s, d), proxies.buildings(s, d))


def _lattice(s: SparkSession, d: str) -> DataFrame:
    return fit.lattice(_fit(s, d), proxies.instances(s, d))


def _parses(s: SparkSession, d: str) -> DataFrame:
    return grammar.parses(_lattice(s, d))


def _rules(s: SparkSession, d: str) -> DataFrame:
    return grammar.rules(_lattice(s, d))


def _masks(s: SparkSession, d: str) -> DataFrame:
    """Share and touched edges of each building's window boxes, as a mask of the front."""
    w = proxies.instances(s, d).where("cls = 'window'")
    return w.groupBy("building_id").agg((F.sum(4 * F.col("hw") * F.col("hw")) / 10000).alias("share"), F.max(F.col("cy") - F.col("hw") <= 0).alias("top"), F.max(F.col("cy") + F.col("hw") >= 100).alias("bottom"), F.max(F.col("cx") - F.col("hw") <= 0).alias("left"), F.max(F.col("cx") + F.col("hw") >= 100).alias("right"))


def _pixels(s: SparkSession, d: str) -> DataFrame:
    """A pixel table on a grid of 20: boxes of windows (the mask) and of balconies (what hides it)."""
    rows = proxies.instances(s, d).where("cls in ('window', 'balcony')")
    low = lambda c: F.greatest(F.floor((F.col(c) - F.col("hw")) / 5), F.lit(0))
    high = lambda c: F.least(F.floor((F.col(c) + F.col("hw")) / 5), F.lit(19))
    rows = rows.withColumn("x", F.explode(F.sequence(low("cx"), high("cx")))).withColumn("y", F.explode(F.sequence(low("cy"), high("cy"))))
    return rows.groupBy("building_id", "x", "y").agg(F.bool_or(F.col("cls") == "window").alias("mask"), F.bool_or(F.col("cls") == "balcony").alias("hides"))


def _works(s: SparkSession, d: str) -> DataFrame:
    """What became of each front: its best photo by a made-up share that is hidden."""
    top = _top(s, d).withColumn("ratio", (F.col("photo_id") % 10) / F.lit(10.0))
    return fit.best_candidate(top)


def audit_records(s: SparkSession, d: str) -> DataFrame:
    base, works = _canal(s, d).select("building_id", "mx", "my", "normal_deg"), _works(s, d)
    photos = proxies.photos(s, d).select("photo_id", "px", "py")
    rows = base.join(works, "building_id", "left").join(photos, "photo_id", "left")
    status = F.when(F.col("photo_id").isNull(), "no_candidates").when(F.col("ratio") > O.max_occluder_ratio, "error").otherwise("ok")
    perp = geo.angle_between(geo.azimuth(F.col("mx") - F.col("px"), F.col("my") - F.col("py")), F.pmod(F.col("normal_deg") + 180, F.lit(360.0)))
    return rows.select("building_id", status.alias("status"), "photo_id", F.round(perp, 6).alias("perp_deg"), F.col("ratio").alias("occluder_ratio")).orderBy("building_id")


def features_csv(s: SparkSession, d: str) -> DataFrame:
    return sinks.feature_rows(proxies.instances(s, d), _fit(s, d), _works(s, d))


def smoothed_histogram(s: SparkSession, d: str) -> DataFrame:
    """Counts of window rows by bin and their smoothed values, on a dense table of bins."""
    bins = proxies.instances(s, d).where("cls = 'window'").select("building_id", fit.histogram_bin(F.col("cy") / 100, O.n_bins).alias("bin"))
    n = bins.groupBy("building_id", "bin").count()
    dense = bins.select("building_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(O.n_bins - 1)))).join(n, ["building_id", "bin"], "left").select("building_id", "bin", F.coalesce("count", F.lit(0)).alias("n"))
    w = Window.partitionBy("building_id").orderBy("bin")
    total = None
    weights = fit.kernel(O.smooth_sigma)
    for k, x in enumerate(weights):
        shift = k - len(weights) // 2
        part = F.lit(x) * (F.lead("n", shift, 0).over(w) if shift >= 0 else F.lag("n", -shift, 0).over(w))
        total = part if total is None else total + part
    return dense.select("building_id", "bin", "n", F.round(total, 9).alias("smoothed"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Every event as a photo record: some without a place, some with an unknown compass, and most ids in two records."""
    place = "IF(event_type = 'error', CAST(NULL AS ARRAY<DOUBLE>), array(4.8D + (event_id * 7) % 480 * 0.001D, 52.3D + (event_id * 13) % 2000 * 0.0001D))"
    rows = proxies.read(s, d, "events").selectExpr(
        "CAST(event_id div 2 AS STRING) AS id", f"named_struct('coordinates', {place}) AS computed_geometry",
        "IF(event_type = 'purchase', -1D, CAST((event_id * 37) % 720 AS DOUBLE)) AS compass_angle", "CAST(NULL AS DOUBLE) AS computed_altitude",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS captured_at", "event_type IN ('view', 'click') AS is_pano", "concat('u', event_id) AS thumb_1024_url", "value / 500 AS quality_score",
    )
    return files.checked(rows, files.PHOTO_RECORD, ("id",))


def photo_clean_dedupe(s: SparkSession, d: str) -> DataFrame:
    rows = files.first_by(files.photos(_records(s, d)), "photo_id", "captured_at", "url")
    return rows.select("photo_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "bearing_deg", "is_pano", "url")


def _views(s: SparkSession, d: str) -> DataFrame:
    """Each chosen photo with its front's ends on the ellipsoid, and the distance, bearing and pitch of its view."""
    rows = _top(s, d).join(proxies.buildings(s, d).select("building_id", "height_m"), "building_id")
    for name, x, y in (("p", "px", "py"), ("a", "ax", "ay"), ("b", "bx", "by")):
        lon, lat = geo.to_lonlat(F.col(x), F.col(y))
        rows = rows.withColumn(f"{name}_lon", lon).withColumn(f"{name}_lat", lat)
    middle = (F.col("a_lon") + F.col("b_lon")) / 2, (F.col("a_lat") + F.col("b_lat")) / 2
    metres, bearing = geo.geodesic((F.col("p_lon"), F.col("p_lat")), middle)
    eye, ground = camera.vertical(F.lit(None).cast("double"), F.lit(0.0))
    rows = rows.withColumn("metres", metres).withColumn("bearing", bearing).withColumn("low", ground - eye).withColumn("high", ground + F.col("height_m") - eye)
    return rows.withColumn("pitch", camera.pitch_deg(F.col("metres"), F.col("high")))


def view_angles(s: SparkSession, d: str) -> DataFrame:
    return _views(s, d).select("building_id", "photo_id", F.round("metres", 4).alias("metres"), F.round("bearing", 4).alias("bearing"), F.round("pitch", 4).alias("pitch"))


def _corners(s: SparkSession, d: str) -> DataFrame:
    """The front's two ends, at the ground and at the roof, in pixels of each view: four rows a view."""
    ends = F.array(*[F.struct(F.col(f"{end}_lon").alias("lon"), F.col(f"{end}_lat").alias("lat"), F.col(h).alias("up")) for end in "ab" for h in ("low", "high")])
    rows = _views(s, d).select("building_id", "photo_id", "p_lon", "p_lat", "bearing", "pitch", F.posexplode(ends).alias("corner", "e"))
    return camera.with_pixels(rows, (F.col("p_lon"), F.col("p_lat")), (F.col("e.lon"), F.col("e.lat")), F.col("e.up"), F.col("bearing"), F.col("pitch"))


def view_corners(s: SparkSession, d: str) -> DataFrame:
    return _corners(s, d).select("building_id", "photo_id", "corner", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def projected_bbox(s: SparkSession, d: str) -> DataFrame:
    return _corners(s, d).groupBy("building_id", "photo_id").agg(camera.box().alias("box")).select("building_id", "photo_id", "box.*")


def front_means(s: SparkSession, d: str) -> DataFrame:
    """Means over all fitted fronts, one row: one global aggregation."""
    return _fit(s, d).agg(F.count("*").alias("fronts"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("n_floors", "n_columns", "n_windows", "n_doors")])


def class_means(s: SparkSession, d: str) -> DataFrame:
    """Mean score of each class, and its mean number of detections over the fronts that have any detection."""
    rows = proxies.instances(s, d)
    fronts = rows.agg(F.countDistinct("building_id").alias("fronts"))
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.avg("score").alias("score")).join(F.broadcast(fronts)).select("cls", F.round("score", 6).alias("mean_score"), F.round(F.col("n") / F.col("fronts"), 6).alias("per_front"))


def bbox_buffer(s: SparkSession, d: str) -> DataFrame:
    return files.buffered(s.sql("SELECT 4.88D AS min_lon, 52.37D AS min_lat, 4.89D AS max_lon, 52.38D AS max_lat"), 50.0).select(*[F.round(c, 7).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def contact_sample(s: SparkSession, d: str) -> DataFrame:
    """Twelve fronts for a sheet, by a digest of their id: the same ones in every run, and in any engine."""
    return _fit(s, d).select("building_id", "n_floors", "n_columns").orderBy(F.md5(F.concat_ws(":", F.lit(str(O.rng_seed)), F.col("building_id").cast("string")).cast("binary")), "building_id").limit(12)


def _sampled(s: SparkSession, d: str, *, top: int | None = None, each: int | None = None) -> DataFrame:
    """Samples of all root families by weight, of the best alone, or so many of each of the best."""
    rules = written(_rules(s, d), "rules")
    weights = grammar.root_weights(rules)
    if each is None:
        begin = grammar.starts(weights if top is None else grammar.top_roots(weights, top))
    else:
        place = F.row_number().over(Window.orderBy(F.desc("weight"), F.substr("family", F.lit(2)).cast("int"))) - 1  # of `top` rows
        best = grammar.top_roots(weights, top).select("family", (F.lit(O.rng_seed) + place * 1009).cast("long").alias("seed"))
        begin = best.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long"))).alias("sample"), "family")
    return grammar.sampled(begin, grammar.production_ranges(rules))


def sample_rects(s: SparkSession, d: str) -> DataFrame:
    rules = written(_rules(s, d), "rules")
    nodes = grammar.sampled(grammar.starts(grammar.root_weights(rules)), grammar.production_ranges(rules))
    return grammar.sample_layout(nodes.withColumn("seed", F.expr("seed div 10000")), rules)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "building_edges": lambda s, d: _edges(s, d).select("building_id", "ax", "ay", "bx", "by", F.round("normal_deg", 6).alias("normal_deg")),
    "classified_facades": lambda s, d: _classified(s, d).select("building_id", "ax", "ay", "bx", "by", "classification"),
    "facade_class_counts": lambda s, d: _classified(s, d).groupBy("classification").agg(F.count("*").alias("n")),
    "canal_facades": lambda s, d: _canal(s, d).select("building_id", "ax", "ay", "bx", "by", F.round("normal_deg", 6).alias("normal_deg")),
    "photo_clean_dedupe": photo_clean_dedupe,
    "tile_grid": lambda s, d: files.tiles(s, (0.0, 0.0, 4.0, 8.0), 4, 1),
    "photo_candidates": lambda s, d: _rounded(_candidates(s, d).where("ahead > 0").select("building_id", "photo_id", "dist_m", "perp_deg"), "dist_m", "perp_deg"),
    "photo_reject_reasons": lambda s, d: _candidates(s, d).groupBy(F.coalesce(facades.reject_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")),
    "across_canal_flag": lambda s, d: facades.with_crossing(_candidates(s, d).where(facades.reject_reason().isNull()), proxies.waterways(s, d)).select("building_id", "photo_id", "crosses_water"),
    "top_photos": lambda s, d: _top(s, d).select("building_id", "photo_id", "rank", "crosses_water", "year"),
    "facades_unmatched": lambda s, d: _canal(s, d).select("building_id").join(_top(s, d), "building_id", "left_anti"),
    "instance_class_counts": lambda s, d: proxies.instances(s, d).groupBy("building_id").agg(F.count_if(F.col("cls") == "window").alias("windows"), F.count_if(F.col("cls") == "door").alias("doors")),
    "instances_in_container": lambda s, d: fit.in_container(proxies.instances(s, d), (10.0, 10.0, 90.0, 90.0), 0.3).select("building_id", "ord", "cls", "score"),
    "best_door": lambda s, d: proxies.instances(s, d).where("cls = 'door'").groupBy("building_id").agg(fit.first_best(F.struct("ord", "score", "cx", "cy"), F.col("score"), F.col("ord")).alias("b")).select("building_id", "b.*"),
    "pick_best_candidate": lambda s, d: _works(s, d).select("building_id", "photo_id", "rank", "ratio"),
    "quality_filter": lambda s, d: _masks(s, d).withColumn("reason", fit.mask_reason()).where("reason is null").select("building_id", F.round("share", 6).alias("share")),
    "quality_reasons": lambda s, d: _masks(s, d).groupBy(F.coalesce(fit.mask_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")),
    "mask_bbox": lambda s, d: _pixels(s, d).where("mask").groupBy("building_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")),
    "mask_overlap": lambda s, d: _pixels(s, d).groupBy("building_id").agg(F.round(F.count_if(F.col("mask") & F.col("x").between(5, 14) & F.col("y").between(5, 14)) / F.greatest(F.count_if("mask"), F.lit(1)), 6).alias("overlap"), F.round(F.count_if(F.col("hides") & F.col("x").between(5, 14) & F.col("y").between(5, 14)) / 100, 6).alias("occluder_ratio")),
    "union_mask": lambda s, d: _pixels(s, d).where("mask").groupBy("building_id").agg(F.count("*").alias("pixels")),
    "audit_records": audit_records,
    "window_size_stats": lambda s, d: proxies.instances(s, d).where("cls = 'window'").groupBy("building_id").agg(F.round(F.avg(2 * F.col("hw") / 100), 9).alias("mean"), F.round(F.stddev_pop(2 * F.col("hw") / 100), 9).alias("std")),
    "smoothed_histogram": smoothed_histogram,
    "fitted_fronts": lambda s, d: _rounded(_fit(s, d).select("building_id", "n_floors", "n_columns", "n_windows", "n_doors", "window_mean", "window_std", "door_floor_idx", "door_x_center", "gable_y_end", "floor_height_m", "window_w_mean_m", "gable_prominence_m", "n_floors_matches_bag"), "window_mean", "window_std", "gable_y_end", "floor_height_m", "window_w_mean_m", "gable_prominence_m"),
    "peak_clusters": lambda s, d: _fit(s, d).select("building_id", F.posexplode("row_centers").alias("at", "center")).select("building_id", "at", F.round("center", 6).alias("center")),
    "floor_match": lambda s, d: _fit(s, d).groupBy(F.when(F.col("n_floors_matches_bag"), "yes").when(~F.col("n_floors_matches_bag"), "no").otherwise("unknown").alias("matches")).agg(F.count("*").alias("n")),
    "features_csv": features_csv,
    "row_boundaries": lambda s, d: fit.with_boundaries(_fit(s, d)).select("building_id", F.posexplode("row_boundaries").alias("at", "y")).withColumn("y", F.round("y", 9)),
    "col_boundaries": lambda s, d: fit.with_boundaries(_fit(s, d)).select("building_id", F.posexplode("col_boundaries").alias("at", "x")).withColumn("x", F.round("x", 9)),
    "lattice_cells": _lattice,
    "lattice_fill_rate": lambda s, d: _lattice(s, d).groupBy("building_id").agg(F.round(F.avg((F.col("cls") != "wall").cast("double")), 9).alias("fill_rate")),
    "induced_rules": lambda s, d: _rules(s, d).select("rule", "kind", "axis", "cls", "left_rule", "right_rule", "left_size", "right_size"),
    "facade_roots": lambda s, d: grammar.roots(_parses(s, d)),
    "mdl_bits": lambda s, d: _rounded(grammar.mdl_bits(_rules(s, d)), "mdl_bits"),
    "parse_edges": lambda s, d: _parses(s, d).select("building_id", "node", "parent", "child", "depth", "rule"),
    "rule_usage": lambda s, d: _rules(s, d).select("rule", "uses"),
    "family_keys": lambda s, d: _rules(s, d).select("rule", "key"),
    "grammar_families": lambda s, d: grammar.families(_rules(s, d)),
    "root_family_weights": lambda s, d: grammar.root_weights(_rules(s, d)),
    "production_probs": lambda s, d: _rounded(grammar.production_probs(_rules(s, d)), "prob"),
    "top_root_families": lambda s, d: grammar.top_roots(grammar.root_weights(_rules(s, d))),
    "synthesized": lambda s, d: _sampled(s, d),
    "photogenic": lambda s, d: _sampled(s, d, top=1),
    "archetype": lambda s, d: _sampled(s, d, top=6, each=2),
    "layout_rects": lambda s, d: grammar.layout(_parses(s, d)),
    "sample_rects": sample_rects,
    "view_angles": view_angles,
    "view_corners": view_corners,
    "projected_bbox": projected_bbox,
    "front_means": front_means,
    "class_means": class_means,
    "summary_lines": lambda s, d: _fit(s, d).select("building_id", sinks.summary_line().alias("line")),
    "bbox_buffer": bbox_buffer,
    "contact_sample": contact_sample,
    "geo_roundtrip": lambda s, d: _rounded(proxies.buildings(s, d).select("building_id", geo.to_lonlat(F.col("x0"), F.col("y0"))[0].alias("lon"), geo.to_lonlat(F.col("x0"), F.col("y0"))[1].alias("lat")), "lon", "lat"),
}

_BASE = f"""WITH buildings AS (SELECT p_partkey AS building_id, CAST(120000 + 12 * (p_partkey % 40) AS DOUBLE) x0, CAST(485000 + 40 * (p_partkey // 40) AS DOUBLE) y0,
 CAST(4 + p_partkey % 5 AS DOUBLE) w, CAST(8 + p_partkey % 7 AS DOUBLE) d, 5 + p_size * CAST(0.5 AS DOUBLE) height_m,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 5 + p_size * CAST(0.5 AS DOUBLE) - (p_partkey % 4) END eaves_height_m,
 CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1 + p_size % 6 END floor_count FROM part),
edges AS (SELECT building_id, x0 ax, y0 ay, x0 + w bx, y0 bj, 0.0::DOUBLE nx, -1.0::DOUBLE ny, 180.0::DOUBLE normal_deg FROM buildings
 UNION ALL SELECT building_id, x0 + w, y0, x0 + w, y0 + d, 1, 0, 90 FROM buildings
 UNION ALL SELECT building_id, x0 + w, y0 + d, x0, y0 + d, 0, 1, 0 FROM buildings
 UNION ALL SELECT building_id, x0, y0 + d, x0, y0, -1, 0, 270 FROM buildings),
mid AS (SELECT *, (ax + bx) / 2 mx, (ay + bj) / 2 my FROM edges),
water AS (SELECT CAST(485000 + 80 * n_nationkey - 10 AS DOUBLE) y FROM nation), street AS (SELECT CAST(485000 + 80 * n_nationkey + 34 AS DOUBLE) y FROM nation),
classified AS (SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM water l WHERE abs(l.y - my) <= {O.canal_near_m} AND (abs(l.y - my) < 1e-6 OR (l.y - my) * ny / abs(l.y - my) >= {O.forward_cos_min})) THEN 'canal'
 WHEN EXISTS (SELECT 1 FROM street l WHERE abs(l.y - my) <= {O.street_near_m} AND (abs(l.y - my) < 1e-6 OR (l.y - my) * ny / abs(l.y - my) >= {O.forward_cos_min})) THEN 'street' ELSE 'other' END classification FROM mid m),
canal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY (bx-ax)*(bx-ax)+(bj-ay)*(bj-ay) DESC, ax DESC, ay DESC) rn FROM classified WHERE classification = 'canal') WHERE rn = 1),
photos AS (SELECT event_id photo_id, CAST(120000 + (event_id * 7) % 480 AS DOUBLE) px, CAST(485000 - 60 + (event_id * 13) % 2000 AS DOUBLE) py, CASE WHEN event_type = 'error' THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END bearing_deg,
 event_type IN ('view', 'click') is_pano, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 500 END quality_score, CAST(2018 + event_id % 7 AS INT) AS year, CAST(1 + event_id % 12 AS INT) AS month FROM events),
pairs AS (SELECT c.*, p.*, sqrt(pow(px - greatest(least(px, greatest(ax, bx)), least(ax, bx)), 2) + pow(py - greatest(least(py, greatest(ay, bj)), least(ay, bj)), 2)) dist_m,
 abs(fmod(degrees(atan2(mx - px, my - py)) - (normal_deg + 180) + 1260, 360) - 180) perp_deg, (px - mx) * nx + (py - my) * ny ahead
 FROM canal c JOIN photos p ON abs(px - mx) <= {O.photo_max_dist_m} AND abs(py - my) <= {O.photo_max_dist_m}),
judged AS (SELECT *, CASE WHEN dist_m < {O.photo_min_dist_m} OR dist_m > {O.photo_max_dist_m} THEN 'distance' WHEN NOT is_pano AND dist_m > {O.perspective_max_dist_m} THEN 'perspective_distance' WHEN ahead <= 0 THEN 'behind'
 WHEN perp_deg > {O.max_perpendicularity_deg} THEN 'perpendicularity' WHEN NOT is_pano AND (bearing_deg IS NULL OR abs(fmod(bearing_deg - (normal_deg + 180) + 1260, 360) - 180) > {O.bearing_tol_deg}) THEN 'bearing' END reason FROM pairs),
kept AS (SELECT *, EXISTS (SELECT 1 FROM water l WHERE l.y BETWEEN least(py, my) AND greatest(py, my)) crosses_water FROM judged WHERE reason IS NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY CASE WHEN crosses_water THEN 0 ELSE 1 END, year DESC, CASE WHEN month IN {O.winter_months} THEN 0 ELSE 1 END, perp_deg, coalesce(quality_score, 0) DESC, dist_m, photo_id) - 1 AS rank FROM kept) WHERE rank < {O.top_k}),
works AS (SELECT building_id, photo_id, rank, ratio FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY CASE WHEN ratio > {O.max_occluder_ratio} THEN 1 ELSE 0 END, rank) k FROM (SELECT *, (photo_id % 10) / CAST(10 AS DOUBLE) ratio FROM top)) WHERE k = 1),
instances AS (SELECT l_partkey building_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord,
 CASE WHEN l_linenumber <= 4 THEN 'window' WHEN l_linenumber = 5 THEN 'door' WHEN l_linenumber = 6 THEN 'chimney' ELSE 'balcony' END cls, least(l_discount * 10, CAST(1 AS DOUBLE)) score,
 CAST((l_orderkey * 7 + l_linenumber * 13) % 100 AS DOUBLE) cx, CAST((l_suppkey * 11 + l_linenumber * 29) % 100 AS DOUBLE) cy, CAST(2 + CAST(trunc(l_quantity) AS INT) % 4 AS DOUBLE) hw FROM lineitem),
masks AS (SELECT building_id, sum(4 * hw * hw) / 10000 share, max(cy - hw <= 0) t, max(cy + hw >= 100) b, max(cx - hw <= 0) l, max(cx + hw >= 100) r FROM instances WHERE cls = 'window' GROUP BY 1),
mask_reasons AS (SELECT *, CASE WHEN share < {O.min_mask_ratio} THEN 'tiny' WHEN share > {O.max_mask_ratio} THEN 'huge' WHEN t AND b THEN 'vertical_crop' WHEN l AND r THEN 'horizontal_crop' END reason FROM masks),
pixels AS (SELECT building_id, x, y, bool_or(cls = 'window') mask, bool_or(cls = 'balcony') hides FROM (SELECT i.*, gx.x, gy.y FROM instances i, (SELECT CAST(unnest(range(20)) AS BIGINT) x) gx, (SELECT CAST(unnest(range(20)) AS BIGINT) y) gy
 WHERE cls IN ('window', 'balcony') AND gx.x BETWEEN greatest(floor((cx - hw) / 5), 0) AND least(floor((cx + hw) / 5), 19) AND gy.y BETWEEN greatest(floor((cy - hw) / 5), 0) AND least(floor((cy + hw) / 5), 19)) GROUP BY 1, 2, 3)
"""


def _bin(v: str) -> str:
    i = f"least(floor({v} * 40), 39)"
    return f"CAST(CASE WHEN {v} < {i} * CAST(0.025 AS DOUBLE) THEN {i} - 1 WHEN {v} >= ({i} + 1) * CAST(0.025 AS DOUBLE) AND {i} < 39 THEN {i} + 1 ELSE {i} END AS INT)"


def _smooth(n: str, over: str) -> str:
    parts = []
    weights = fit.kernel(O.smooth_sigma)
    for k, x in enumerate(weights):
        shift = k - len(weights) // 2
        parts.append(f"CAST({x!r} AS DOUBLE) * " + (f"lead({n}, {shift}, 0) OVER {over}" if shift >= 0 else f"lag({n}, {-shift}, 0) OVER {over}"))
    return "(" + " + ".join(parts) + ")"


def _axis(name: str, column: str) -> str:
    """Peaks of one axis as a table of buildings and sorted lists."""
    return f""", {name}_n AS (SELECT building_id, {_bin(f'({column} / 100)')} AS bin, count(*) AS n FROM instances WHERE cls = 'window' GROUP BY 1, 2),
{name}_dense AS (SELECT k.building_id, b.bin, CAST(coalesce(n.n, 0) AS DOUBLE) AS n FROM (SELECT DISTINCT building_id FROM {name}_n) k CROSS JOIN (SELECT CAST(unnest(range(40)) AS INT) AS bin) b LEFT JOIN {name}_n n ON n.building_id = k.building_id AND n.bin = b.bin),
{name}_smooth AS (SELECT *, {_smooth('n', '(PARTITION BY building_id ORDER BY bin)')} AS s FROM {name}_dense),
{name}_near AS (SELECT *, lag(s) OVER (PARTITION BY building_id ORDER BY bin) AS a, lead(s) OVER (PARTITION BY building_id ORDER BY bin) AS z, max(s) OVER (PARTITION BY building_id) AS m FROM {name}_smooth),
{name}_peaks AS (SELECT building_id, (bin * CAST(0.025 AS DOUBLE) + (bin + 1) * CAST(0.025 AS DOUBLE)) / 2 AS center, row_number() OVER (PARTITION BY building_id ORDER BY bin) - 1 AS pos FROM {name}_near WHERE bin BETWEEN 1 AND 38 AND s > a AND s >= z AND s >= m * CAST({O.min_prominence} AS DOUBLE))"""


_FIT = (
    _axis("rows", "cy")
    + _axis("cols", "cx")
    + f"""
, stats AS (SELECT building_id, count(*) FILTER (cls = 'window') AS n_windows, count(*) FILTER (cls = 'door') AS n_doors, avg(2 * hw / 100) FILTER (cls = 'window') AS window_mean, stddev_pop(2 * hw / 100) FILTER (cls = 'window') AS window_std FROM instances GROUP BY 1),
doors AS (SELECT building_id, cx / 100 AS dx, cy / 100 AS dy FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY score DESC, ord) AS k FROM instances WHERE cls = 'door') WHERE k = 1),
nearest AS (SELECT building_id, pos FROM (SELECT r.building_id, r.pos, row_number() OVER (PARTITION BY r.building_id ORDER BY abs(center - dy), pos) AS k FROM rows_peaks r JOIN doors USING (building_id)) WHERE k = 1),
rs AS (SELECT building_id, count(*) AS n, min(center) AS low FROM rows_peaks GROUP BY 1), cs AS (SELECT building_id, count(*) AS n FROM cols_peaks GROUP BY 1),
fitted AS (SELECT s.building_id, CAST(greatest(coalesce(rs.n, 0), 1) AS INT) AS n_floors, CAST(coalesce(cs.n, 0) AS INT) AS n_columns, n_windows, n_doors, window_mean, window_std, CAST(nearest.pos AS INT) AS door_floor_idx, dx AS door_x_center,
 CASE WHEN low - window_mean / 2 > 0 THEN low - window_mean / 2 END AS gable_y_end, height_m / greatest(coalesce(rs.n, 0), 1) AS floor_height_m, window_mean * w AS window_w_mean_m, height_m - eaves_height_m AS gable_prominence_m,
 greatest(coalesce(rs.n, 0), 1) = floor_count AS n_floors_matches_bag FROM stats s JOIN buildings b USING (building_id) LEFT JOIN rs USING (building_id) LEFT JOIN cs USING (building_id) LEFT JOIN doors USING (building_id) LEFT JOIN nearest USING (building_id) WHERE n_windows >= {O.min_windows})"""
)


def _poly(terms, a: str, b: str) -> str:
    parts = []
    for i, j, f in terms:
        parts.append(" * ".join([f"CAST({f!r} AS DOUBLE)", *[a] * i, *[b] * j]))
    return "(" + " + ".join(parts) + ")"


_DX, _DY = "((x0 - 155000) * CAST(1e-5 AS DOUBLE))", "((y0 - 463000) * CAST(1e-5 AS DOUBLE))"



def _lonlat(x: str, y: str, name: str) -> str:
    dx, dy = f"(({x} - 155000) * CAST(1e-5 AS DOUBLE))", f"(({y} - 463000) * CAST(1e-5 AS DOUBLE))"
    return f"CAST({geo.LON0!r} AS DOUBLE) + {_poly(geo.TO_LON, dx, dy)} / 3600 AS {name}_lon, CAST({geo.LAT0!r} AS DOUBLE) + {_poly(geo.TO_LAT, dx, dy)} / 3600 AS {name}_lat"

def _grid_of(lon: str, lat: str, name: str) -> str:
    a, b = f"(({lat} - CAST({geo.LAT0!r} AS DOUBLE)) * CAST(0.36 AS DOUBLE))", f"(({lon} - CAST({geo.LON0!r} AS DOUBLE)) * CAST(0.36 AS DOUBLE))"
    return f"CAST({geo.X0!r} AS DOUBLE) + {_poly(geo.TO_X, a, b)} AS {name}_x, CAST({geo.Y0!r} AS DOUBLE) + {_poly(geo.TO_Y, a, b)} AS {name}_y"


def _metres(a: str, b: str) -> tuple[str, str]:
    """East and north in metres and the bearing, as in `geo.geodesic`."""
    middle = f"radians(({a}_lat + {b}_lat) / 2)"
    w = f"(1 - CAST({geo.E2!r} AS DOUBLE) * sin({middle}) * sin({middle}))"
    east = f"(radians({b}_lon - {a}_lon) * {geo.SEMI_MAJOR} / sqrt({w}) * cos({middle}))"
    north = f"(radians({b}_lat - {a}_lat) * CAST({geo.SEMI_MAJOR * (1 - geo.E2)!r} AS DOUBLE) / ({w} * sqrt({w})))"
    turned = f"(degrees(atan2({east}, {north})) - degrees(radians({b}_lon - {a}_lon) * sin({middle})) / 2)"
    return f"sqrt({east} * {east} + {north} * {north})", f"fmod(fmod({turned}, 360) + 360, 360)"


_TO_MIDDLE, _TO_END = _metres("p", "m"), _metres("p", "e")
_FOCAL = f"(CAST({O.view_width / 2} AS DOUBLE) / tan(radians(CAST({O.view_fov_deg / 2} AS DOUBLE))))"
_VIEWS = f""", ends AS (SELECT t.building_id, t.photo_id, b.height_m, {_lonlat('px', 'py', 'p')}, {_lonlat('ax', 'ay', 'a')}, {_lonlat('bx', 'bj', 'b')} FROM top t JOIN buildings b USING (building_id)),
middles AS (SELECT *, (a_lon + b_lon) / 2 AS m_lon, (a_lat + b_lat) / 2 AS m_lat FROM ends),
turned AS (SELECT *, {_TO_MIDDLE[0]} AS metres, {_TO_MIDDLE[1]} AS bearing, height_m - CAST({O.camera_height_m} AS DOUBLE) AS high, CAST({-O.camera_height_m} AS DOUBLE) AS low FROM middles),
views AS (SELECT *, CASE WHEN metres < 1e-6 THEN 0 ELSE greatest(0, degrees(atan2(high, metres)) - degrees(atan2(CAST({O.view_height / 2} AS DOUBLE), {_FOCAL})) + CAST({O.sky_margin_deg} AS DOUBLE)) END AS pitch FROM turned),
four AS (SELECT *, 0 AS corner, a_lon AS e_lon, a_lat AS e_lat, low AS up FROM views UNION ALL SELECT *, 1, a_lon, a_lat, high FROM views UNION ALL SELECT *, 2, b_lon, b_lat, low FROM views UNION ALL SELECT *, 3, b_lon, b_lat, high FROM views),
seen AS (SELECT building_id, photo_id, corner, up, radians(pitch) AS tilt, {_TO_END[0]} AS far, radians({_TO_END[1]} - bearing) AS turn FROM four),
rays AS (SELECT *, far * cos(turn) * cos(tilt) + up * sin(tilt) AS depth, up * cos(tilt) - far * cos(turn) * sin(tilt) AS rise FROM seen),
corners AS (SELECT building_id, photo_id, corner, CASE WHEN far >= 1e-6 AND depth > 1e-9 * sqrt(far * far + up * up) THEN CAST({O.view_width / 2} AS DOUBLE) + far * sin(turn) * ({_FOCAL} / depth) END AS x,
 CASE WHEN far >= 1e-6 AND depth > 1e-9 * sqrt(far * far + up * up) THEN CAST({O.view_height / 2} AS DOUBLE) - rise * ({_FOCAL} / depth) END AS y FROM rays)
"""

ORACLE_SQL: dict[str, str] = {
    "building_edges": _BASE + "SELECT building_id, ax, ay, bx, bj AS by, normal_deg FROM edges",
    "classified_facades": _BASE + "SELECT building_id, ax, ay, bx, bj AS by, classification FROM classified",
    "facade_class_counts": _BASE + "SELECT classification, count(*) AS n FROM classified GROUP BY 1",
    "canal_facades": _BASE + "SELECT building_id, ax, ay, bx, bj AS by, normal_deg FROM canal",
    "photo_clean_dedupe": """SELECT photo_id, round(lon, 6) AS lon, round(lat, 6) AS lat, bearing_deg, is_pano, url FROM (SELECT CAST(event_id // 2 AS VARCHAR) AS photo_id, CAST(4.8 AS DOUBLE) + (event_id * 7) % 480 * CAST(0.001 AS DOUBLE) AS lon, CAST(52.3 AS DOUBLE) + (event_id * 13) % 2000 * CAST(0.0001 AS DOUBLE) AS lat,
 CASE WHEN event_type <> 'purchase' THEN CAST((event_id * 37) % 360 AS DOUBLE) END AS bearing_deg, event_type IN ('view', 'click') AS is_pano, 'u' || event_id AS url, row_number() OVER (PARTITION BY event_id // 2 ORDER BY epoch_ms(ts), 'u' || event_id) AS k FROM events WHERE event_type <> 'error') WHERE k = 1""",
    "tile_grid": "SELECT i, j, i * CAST(0.5 AS DOUBLE) AS min_x, CAST(j AS DOUBLE) AS min_y, (i + 1) * CAST(0.5 AS DOUBLE) AS max_x, CAST(j + 1 AS DOUBLE) AS max_y FROM (SELECT unnest(range(8)) AS i) CROSS JOIN (SELECT unnest(range(8)) AS j)",
    "photo_candidates": _BASE + "SELECT building_id, photo_id, round(dist_m, 6) AS dist_m, round(perp_deg, 6) AS perp_deg FROM pairs WHERE ahead > 0",
    "photo_reject_reasons": _BASE + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "across_canal_flag": _BASE + "SELECT building_id, photo_id, crosses_water FROM kept",
    "top_photos": _BASE + "SELECT building_id, photo_id, CAST(rank AS INT) AS rank, crosses_water, year FROM top",
    "facades_unmatched": _BASE + "SELECT building_id FROM canal WHERE building_id NOT IN (SELECT building_id FROM top)",
    "instance_class_counts": _BASE + "SELECT building_id, count(*) FILTER (cls = 'window') AS windows, count(*) FILTER (cls = 'door') AS doors FROM instances GROUP BY 1",
    "instances_in_container": _BASE + "SELECT building_id, CAST(ord AS INT) AS ord, cls, score FROM instances WHERE score >= CAST(0.3 AS DOUBLE) AND cx BETWEEN 10 AND 90 AND cy BETWEEN 10 AND 90",
    "best_door": _BASE + "SELECT building_id, CAST(ord AS INT) AS ord, score, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY score DESC, ord) AS k FROM instances WHERE cls = 'door') WHERE k = 1",
    "pick_best_candidate": _BASE + "SELECT building_id, photo_id, CAST(rank AS INT) AS rank, ratio FROM works",
    "quality_filter": _BASE + "SELECT building_id, round(share, 6) AS share FROM mask_reasons WHERE reason IS NULL",
    "quality_reasons": _BASE + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM mask_reasons GROUP BY 1",
    "mask_bbox": _BASE + "SELECT building_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM pixels WHERE mask GROUP BY 1",
    "mask_overlap": _BASE + "SELECT building_id, round((count(*) FILTER (mask AND x BETWEEN 5 AND 14 AND y BETWEEN 5 AND 14)) / CAST(greatest(count(*) FILTER (mask), 1) AS DOUBLE), 6) AS overlap, round((count(*) FILTER (hides AND x BETWEEN 5 AND 14 AND y BETWEEN 5 AND 14)) / CAST(100 AS DOUBLE), 6) AS occluder_ratio FROM pixels GROUP BY 1",
    "union_mask": _BASE + "SELECT building_id, count(*) AS pixels FROM pixels WHERE mask GROUP BY 1",
    "audit_records": _BASE + f"SELECT c.building_id, CASE WHEN w.photo_id IS NULL THEN 'no_candidates' WHEN ratio > {O.max_occluder_ratio} THEN 'error' ELSE 'ok' END AS status, w.photo_id, round(abs(fmod(degrees(atan2(mx - px, my - py)) - (normal_deg + 180) + 1260, 360) - 180), 6) AS perp_deg, ratio AS occluder_ratio FROM canal c LEFT JOIN works w USING (building_id) LEFT JOIN photos p ON p.photo_id = w.photo_id ORDER BY 1",
    "window_size_stats": _BASE + "SELECT building_id, round(avg(2 * hw / 100), 9) AS mean, round(stddev_pop(2 * hw / 100), 9) AS std FROM instances WHERE cls = 'window' GROUP BY 1",
    "smoothed_histogram": _BASE + _axis("rows", "cy") + "SELECT building_id, bin, CAST(n AS BIGINT) AS n, round(s, 9) AS smoothed FROM rows_smooth",
    "fitted_fronts": _BASE + _FIT + "SELECT building_id, n_floors, n_columns, n_windows, n_doors, round(window_mean, 6) AS window_mean, round(window_std, 6) AS window_std, door_floor_idx, door_x_center, round(gable_y_end, 6) AS gable_y_end, round(floor_height_m, 6) AS floor_height_m, round(window_w_mean_m, 6) AS window_w_mean_m, round(gable_prominence_m, 6) AS gable_prominence_m, n_floors_matches_bag FROM fitted",
    "peak_clusters": _BASE + _FIT + "SELECT building_id, CAST(pos AS INT) AS \"at\", round(center, 6) AS center FROM rows_peaks JOIN fitted USING (building_id)",
    "floor_match": _BASE + _FIT + "SELECT CASE WHEN n_floors_matches_bag THEN 'yes' WHEN NOT n_floors_matches_bag THEN 'no' ELSE 'unknown' END AS matches, count(*) AS n FROM fitted GROUP BY 1",
    "features_csv": _BASE + _FIT + "SELECT i.building_id, w.photo_id, cls, CAST(cx - hw AS INT) AS x0, CAST(cy - hw AS INT) AS y0, CAST(cx + hw AS INT) AS x1, CAST(cy + hw AS INT) AS y1, score, (cx - hw) / 100 AS x0_norm, (cy - hw) / 100 AS y0_norm, (cx + hw) / 100 AS x1_norm, (cy + hw) / 100 AS y1_norm, 1600 + i.building_id % 400 AS building_year, w_m AS facade_width_m, height_m AS facade_height_m FROM instances i JOIN fitted USING (building_id) JOIN (SELECT building_id, w AS w_m, height_m FROM buildings) USING (building_id) LEFT JOIN works w ON w.building_id = i.building_id",
    "front_means": _BASE + _FIT + "SELECT count(*) AS fronts, round(avg(n_floors), 6) AS mean_n_floors, round(avg(n_columns), 6) AS mean_n_columns, round(avg(n_windows), 6) AS mean_n_windows, round(avg(n_doors), 6) AS mean_n_doors FROM fitted",
    "class_means": _BASE + "SELECT cls, round(avg(score), 6) AS mean_score, round(count(*) / CAST((SELECT count(DISTINCT building_id) FROM instances) AS DOUBLE), 6) AS per_front FROM instances GROUP BY 1",
    "summary_lines": _BASE + _FIT + "SELECT building_id, printf('  %s  yr=%d  roof=%s  floors=%d/%s%s  cols=%d  w=%d  facade=%.1fx%.1fm  gable=%s', right(CAST(building_id AS VARCHAR), 16), 1600 + building_id % 400, coalesce(p_type, '?'), n_floors, coalesce(CAST(b.floor_count AS VARCHAR), '?'), CASE WHEN n_floors_matches_bag THEN '✓' WHEN NOT n_floors_matches_bag THEN '✗' ELSE '—' END, n_columns, n_windows, b.w, b.height_m, CASE WHEN gable_prominence_m IS NULL THEN '?' ELSE printf('%.1fm', gable_prominence_m) END) AS line FROM fitted JOIN buildings b USING (building_id) JOIN part ON p_partkey = building_id",
    "view_angles": _BASE + _VIEWS + "SELECT building_id, photo_id, round(metres, 4) AS metres, round(bearing, 4) AS bearing, round(pitch, 4) AS pitch FROM views",
    "view_corners": _BASE + _VIEWS + "SELECT building_id, photo_id, corner, round(x, 4) AS x, round(y, 4) AS y FROM corners",
    "projected_bbox": _BASE + _VIEWS + f"""SELECT v.building_id, v.photo_id, CASE WHEN n > 1 THEN greatest(0, CAST(trunc(x0 - (x1 - x0) * CAST({O.bbox_margin} AS DOUBLE)) AS INT)) END AS x0, CASE WHEN n > 1 THEN greatest(0, CAST(trunc(y0 - (y1 - y0) * CAST({O.bbox_margin} AS DOUBLE)) AS INT)) END AS y0,
 CASE WHEN n > 1 THEN least({O.view_width}, CAST(trunc(x1 + (x1 - x0) * CAST({O.bbox_margin} AS DOUBLE)) AS INT)) END AS x1, CASE WHEN n > 1 THEN least({O.view_height}, CAST(trunc(y1 + (y1 - y0) * CAST({O.bbox_margin} AS DOUBLE)) AS INT)) END AS y1
 FROM views v JOIN (SELECT building_id, photo_id, count(x) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM corners GROUP BY 1, 2) USING (building_id, photo_id)""",
    "geo_roundtrip": _BASE + f"SELECT building_id, round(CAST({geo.LON0!r} AS DOUBLE) + {_poly(geo.TO_LON, _DX, _DY)} / 3600, 6) AS lon, round(CAST({geo.LAT0!r} AS DOUBLE) + {_poly(geo.TO_LAT, _DX, _DY)} / 3600, 6) AS lat FROM buildings",
}
ORACLE_SQL |= grids_sql.queries(_BASE + _FIT)
ORACLE_SQL["bbox_buffer"] = f"""WITH grid AS (SELECT {_grid_of('CAST(4.88 AS DOUBLE)', 'CAST(52.37 AS DOUBLE)', 'a')}, {_grid_of('CAST(4.89 AS DOUBLE)', 'CAST(52.38 AS DOUBLE)', 'b')}),
wide AS (SELECT a_x - 50 AS ax, a_y - 50 AS ay, b_x + 50 AS bx, b_y + 50 AS by_ FROM grid), back AS (SELECT {_lonlat('ax', 'ay', 'a')}, {_lonlat('bx', 'by_', 'b')} FROM wide)
SELECT round(a_lon, 7) AS min_lon, round(a_lat, 7) AS min_lat, round(b_lon, 7) AS max_lon, round(b_lat, 7) AS max_lat FROM back"""
