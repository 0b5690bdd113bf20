"""Cameras, masks, views and detectors against plain Python and known scenes."""

import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions import camera, masks
from trellis.sources import detections, files, sinks

HERE = (4.9, 52.37)


def pixel(spark, lon, lat, above, yaw=0.0, pitch=0.0):
    lit = lambda p: (F.lit(p[0]), F.lit(p[1]))
    row = camera.with_pixels(spark.range(1), lit(HERE), lit((lon, lat)), F.lit(above), F.lit(yaw), F.lit(pitch)).first()
    return None if row.x is None and row.y is None else row


def test_pixels(spark):
    ahead = pixel(spark, 4.9, 52.371, 0.0)
    assert ahead.x == pytest.approx(640, abs=1e-6) and ahead.y == pytest.approx(480, abs=1e-6)
    assert pixel(spark, 4.9002, 52.371, 0.0).x > 640
    assert pixel(spark, 4.9, 52.371, 10.0).y < 480
    assert pixel(spark, 4.9, 52.371, 0.0, pitch=5.0).y > 480
    assert pixel(spark, 4.9, 52.369, 0.0) is None
    assert pixel(spark, *HERE, 5.0) is None


def test_pitch(spark):
    def pitch(metres, roof):
        return spark.range(1).select(camera.pitch_deg(F.lit(metres), F.lit(roof)).alias("p")).first().p

    half = math.degrees(math.atan(480 / (640 / math.tan(math.radians(22.5)))))
    assert pitch(5.0, 17.5) == pytest.approx(math.degrees(math.atan2(17.5, 5.0)) - half + 3)
    assert pitch(500.0, 1.0) == 0
    assert pitch(0.0, 10.0) == 0


def test_box_needs_two_points(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0), (1, None, None), (1, 110.0, 2000.0), (2, None, None), (2, 1.0, 1.0)], "id int, x double, y double")
    got = {r.id: r.box for r in rows.groupBy("id").agg(camera.box().alias("box")).collect()}
    assert tuple(got[1]) == (2, 0, 118, 960)
    assert got[2] is None


def test_png_round_trips():
    rng = np.random.default_rng(1)
    for shape in ((4, 6), (3, 5), (1, 1), (17, 33)):
        for a in (rng.random(shape) < 0.5, np.ones(shape, bool), np.zeros(shape, bool)):
            assert (masks.decode(masks.encode(a)) == a).all()
    image = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (masks.from_png(masks.to_png(image)) == image).all()


def test_png_filters():
    """Lines of each filter, made forwards, come back."""
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (2, 12), dtype=np.uint8)
    above, line = rows
    for kind in range(5):
        coded = []
        for i, v in enumerate(line):
            a, b, c = int(line[i - 3]) if i >= 3 else 0, int(above[i]), int(above[i - 3]) if i >= 3 else 0
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, sorted([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[0][2])[kind]
            coded.append((int(v) - guess) % 256)
        assert (masks._unfilter(kind, np.array(coded, np.uint8), above, 3) == line).all()


def test_mask_columns(spark):
    a = np.zeros((10, 10), bool)
    a[2:5, 3:8] = True
    b = np.zeros((10, 10), bool)
    b[0, :] = True
    rows = spark.createDataFrame([(1, masks.encode(a), [masks.encode(a), masks.encode(b)]), (2, masks.encode(~a & a), []), (3, None, None)], "id int, m string, ms array<string>")
    box = F.struct(F.lit(3).alias("x0"), F.lit(0).alias("y0"), F.lit(5).alias("x1"), F.lit(4).alias("y1"))
    got = {r.id: r for r in rows.select("id", masks.mask_stats("m").alias("s"), masks.union_mask("ms").alias("u"), masks.pixels_in("m", box).alias("n")).collect()}
    s = got[1].s
    assert (s.x0, s.y0, s.x1, s.y1, s.pixels, s.top) == (3, 2, 8, 5, 15, False) and s.share == pytest.approx(0.15)
    assert got[2].s.pixels == 0 and got[2].s.x0 is None
    assert got[3].s.pixels is None and got[3].u is None and got[2].u is None
    assert (masks.decode(got[1].u) == (a | b)).all()
    assert [got[i].n for i in (1, 2, 3)] == [4, 0, 0]


def test_views_look_where_they_point():
    pano = np.zeros((90, 360, 3), np.uint8)
    pano[..., 0] = (np.arange(360) * 255 // 359)[None, :]
    pano[..., 1] = (np.arange(90) * 2)[:, None]
    middle = lambda yaw, pitch, own=0.0: masks.view_of(pano, yaw, pitch, 45.0, (65, 49), own)[24, 32]
    assert abs(int(middle(0, 0)[0]) - 180 * 255 // 359) <= 1
    assert abs(int(middle(90, 0)[0]) - 270 * 255 // 359) <= 1
    assert (middle(30, 10, 30) == middle(0, 10)).all()
    assert middle(0, 45)[1] < middle(0, 0)[1] < middle(0, -45)[1]
    flat = np.full((20, 40, 3), 77, np.uint8)
    assert (masks.view_of(flat, 123, 20, 60, (16, 12)) == 77).all()


def test_pano_view_column(spark):
    flat = np.full((8, 16, 3), 9, np.uint8)
    rows = spark.createDataFrame([(bytearray(masks.to_png(flat)), None), (None, 10.0)], "image binary, own double")
    got = [r[0] for r in rows.select(masks.pano_view("image", F.lit(20.0), F.lit(0.0), "own", F.lit(45.0), F.lit(8), F.lit(6))).collect()]
    assert (masks.from_png(bytes(got[0])) == np.full((6, 8, 3), 9)).all() and got[1] is None


def test_detector(spark):
    front = np.zeros((10, 10), bool)
    front[2:8, 2:8] = True
    hidden = np.zeros((10, 10), bool)
    hidden[2:8, 2:5] = True
    code, tree = masks.encode(front), masks.encode(hidden)

    def detector(image, texts):
        if image == b"broken":
            raise ValueError("no image")
        score = 0.2 if image == b"weak" else 0.9
        mask = lambda m, s, box: {"score": s, "box": box, "mask": m}
        return [[mask(code, score, (2, 2, 8, 8)), mask(tree, 0.1, (0, 0, 1, 1))], [mask(tree, 0.8, (2, 2, 5, 8))], [mask(code, 0.9, (2.5, 3.5, 4.0, 5.0)), mask(code, 0.9, (9, 9, 10, 10)), mask(code, 0.1, (3, 3, 4, 4))]]

    prompts = [("front", "front", "a front"), ("occluder", "tree", "a tree"), ("feature", "window", "a window")]
    images = [(1, 10, 0, b"good"), (1, 11, 1, b"weak"), (2, 12, 0, b"broken"), (3, 13, 0, b"elsewhere")]
    views = spark.createDataFrame([(b, p, r, bytearray(i)) for b, p, r, i in images], "building_id long, photo_id long, rank int, image binary")
    boxes = spark.sql("SELECT 1L AS building_id, 10L AS photo_id, CAST(NULL AS struct<x0:int,y0:int,x1:int,y1:int>) AS box UNION ALL SELECT 3L, 13L, named_struct('x0', 0, 'y0', 0, 'x1', 3, 'y1', 10)")
    found = detections.detected(views, detector, prompts)
    assert [r.building_id for r in found.where("error is not null").collect()] == [2]
    kept = detections.screened(found, boxes)
    (row,) = kept.collect()
    assert (row.building_id, row.photo_id, tuple(row.front_box)) == (1, 10, (2, 2, 8, 8)) and row.ratio == pytest.approx(0.5)
    (f,) = detections.features(found, kept).collect()
    assert (f.cls, f.x0, f.y0, f.x1, f.y1) == ("window", 2, 4, 4, 5)


def test_detector_tries_again(spark):
    calls = []

    def flaky(image, texts):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return [[]]

    views = spark.createDataFrame([(1, 1, 0, bytearray(b"x"))], "building_id long, photo_id long, rank int, image binary")
    assert detections.detected(views, flaky, [("front", "front", "a front")], wait_s=0.01).count() == 0


def test_buffer(spark):
    got = files.buffered(spark.sql("SELECT 4.88D min_lon, 52.37D min_lat, 4.89D max_lon, 52.38D max_lat"), 100.0).first()
    assert got.min_lon < 4.88 and got.max_lat > 52.38
    assert (52.37 - got.min_lat) * 111_250 == pytest.approx(100, rel=0.03)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "x")], "building_id long, note string")
    sinks.write_audit(rows, str(tmp_path / "audit"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "audit").glob("part-*")))
    assert text.splitlines() == ['{"building_id":1,"note":"x"}', '{"building_id":2,"note":null}']
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["building_id", "note"]
    sinks.write_document({"rules": rows, "roots": rows}, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc/roots")).count() == 2
    mask = np.ones((2, 3), bool)
    sinks.write_masks(spark.createDataFrame([(1, masks.encode(mask))], "building_id long, mask string"), str(tmp_path / "masks"))
    assert bytes(spark.read.parquet(str(tmp_path / "masks")).first().png) == base64.b64decode(masks.encode(mask))
