"""A place for any detector, and what is made of its answers: screened candidates and detections of features."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.config import DEFAULTS, Options
from trellis.functions import masks

FOUND = "building_id long, photo_id long, rank int, role string, cls string, ord int, score double, x0 double, y0 double, x1 double, y1 double, mask string, error string"
Detector = Callable[[bytes, list[str]], list[list[dict]]]
Prompt = tuple[str, str, str]  # its role (front, occluder or feature), its class, and its text


def detected(views: DataFrame, detector: Detector, prompts: list[Prompt], attempts: int = 3, wait_s: float = 1.0) -> DataFrame:
    """Rows of `views` (building_id, photo_id, rank, image) as one row for each instance. All prompts go in one call.

    Of failures only TimeoutError and ConnectionError are tried again, after a wait that doubles. A failure costs its row,
    which then has only an error, never the job. An image without instances gives no row.
    """

    def asked(image: bytes) -> list[list[dict]]:
        for k in range(attempts):
            try:
                return detector(image, [text for _, _, text in prompts])
            except (TimeoutError, ConnectionError):
                if k + 1 == attempts:
                    raise
                time.sleep(wait_s * 2**k)
        return []

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                key = (r.building_id, r.photo_id, r.rank)
                try:
                    for (role, cls, _), instances in zip(prompts, asked(r.image), strict=True):
                        out += [(*key, role, cls, i, x["score"], *x["box"], x["mask"], None) for i, x in enumerate(instances)]
                except Exception as e:  # a row's failure is a result
                    out.append((*key, None, None, None, None, None, None, None, None, None, repr(e)))
            done = pd.DataFrame(out, columns=columns)
            done["ord"] = done["ord"].astype("Int32")
            yield done

    return views.select("building_id", "photo_id", "rank", "image").mapInPandas(work, FOUND)


def screened(found: DataFrame, boxes: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Candidates whose best front is sure enough, not empty, and mostly in the box where it was expected, if one was.

    `boxes` has building_id, photo_id and `box` (null for plain photos). `ratio` is the share of the front's own box that
    occluders hide. One aggregation by candidate: a candidate's instances are those of one image.
    """
    front, hides = F.col("role") == "front", F.col("role") == "occluder"
    best = F.max_by(F.when(front, F.struct("score", "mask")), F.when(front, F.struct("score", -F.col("ord"))))
    rows = found.where("error is null").groupBy("building_id", "photo_id", "rank").agg(best.alias("_best"), F.collect_list(F.when(hides, F.col("mask"))).alias("_hides"))
    rows = rows.where(F.col("_best.score") >= o.min_front_score).join(boxes, ["building_id", "photo_id"], "left")
    rows = rows.withColumn("_stats", masks.mask_stats(F.col("_best.mask"))).where("_stats.pixels > 0")
    own = F.struct("_stats.x0", "_stats.y0", "_stats.x1", "_stats.y1")
    area = (F.col("_stats.x1") - F.col("_stats.x0")) * (F.col("_stats.y1") - F.col("_stats.y0"))
    inside = masks.pixels_in(F.col("_best.mask"), F.coalesce("box", own)) / F.col("_stats.pixels")
    rows = rows.withColumn("_inside", inside).where(F.col("box").isNull() | (F.col("_inside") >= o.min_box_overlap))
    ratio = masks.pixels_in(masks.union_mask(F.col("_hides")), own) / area
    return rows.select("building_id", "photo_id", "rank", F.col("_best.score").alias("score"), F.col("_best.mask").alias("mask"), own.alias("front_box"), ratio.alias("ratio"))


def features(found: DataFrame, chosen: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Detections of features in each building's chosen photo (building_id, photo_id, front_box), with whole-pixel boxes."""
    rows = found.where("role = 'feature' and error is null").join(chosen.select("building_id", "photo_id", "front_box"), ["building_id", "photo_id"])
    x, y, b = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, "front_box."
    rows = rows.where((F.col("score") >= o.min_feature_score) & x.between(F.col(b + "x0"), F.col(b + "x1")) & y.between(F.col(b + "y0"), F.col(b + "y1")))
    whole = [F.bround(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.select("building_id", "photo_id", "cls", "ord", "score", *whole, "mask")
