"""Masks as base64 PNG of one bit a pixel, images as PNG, and views cut from panoramas. Python works in Arrow batches here:
no built-in function reads pixels."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
STATS = T.StructType([
    *[T.StructField(c, T.IntegerType()) for c in ("height", "width")], T.StructField("pixels", T.LongType()), T.StructField("share", T.DoubleType()),
    *[T.StructField(c, T.BooleanType()) for c in ("top", "bottom", "left", "right")], *[T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")],
])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(a: np.ndarray) -> bytes:
    """A PNG of a boolean mask (one bit a pixel) or of an RGB image (height, width, 3)."""
    height, width = a.shape[:2]
    depth, color, rows = (1, 0, np.packbits(a, axis=1)) if a.dtype == bool else (8, 2, a.astype(np.uint8).reshape(height, -1))
    lines = np.hstack([np.zeros((height, 1), np.uint8), rows])
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.copy()
    for i in range(len(out)):
        left, up = (int(out[i - step]) if i >= step else 0), int(above[i])
        corner = int(above[i - step]) if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up) // 2
        else:
            guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
        out[i] = (int(out[i]) + guess) & 255
    return out


def from_png(data: bytes) -> np.ndarray:
    """The pixels: booleans for one bit, else 8-bit values with their channels. Interlaced and palette images are refused."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    width, height, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if interlaced or channels is None or depth not in (1, 8):
        raise ValueError("a kind of PNG that is not read here")
    size, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, size + 1)
    rows, above = np.empty((height, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(height):
        above = rows[y] = _unfilter(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth == 1:
        return np.unpackbits(rows, axis=1)[:, :width].astype(bool)
    return rows.reshape(height, width) if channels == 1 else rows.reshape(height, width, channels)


def encode(mask: np.ndarray) -> str:
    return base64.b64encode(to_png(mask.astype(bool))).decode()


def decode(text: str) -> np.ndarray:
    a = from_png(base64.b64decode(text))
    return a if a.dtype == bool else (a if a.ndim == 2 else a.max(axis=2)) > 0


def measured(mask: np.ndarray) -> dict:
    """Size, share and touched edges of a mask, and the half-open box around its pixels (null if it has none)."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    some = len(rows) > 0
    edge = lambda a: bool(a.any())
    return {
        "height": mask.shape[0], "width": mask.shape[1], "pixels": int(mask.sum()), "share": float(mask.mean()) if mask.size else 0.0,
        "top": edge(mask[:1]), "bottom": edge(mask[-1:]), "left": edge(mask[:, :1]), "right": edge(mask[:, -1:]),
        "x0": int(cols[0]) if some else None, "y0": int(rows[0]) if some else None, "x1": int(cols[-1]) + 1 if some else None, "y1": int(rows[-1]) + 1 if some else None,
    }


def united(masks: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    for m in masks:
        out |= m
    return out


@F.pandas_udf(STATS)
def mask_stats(texts: pd.Series) -> pd.DataFrame:
    """What `measured` says of each mask; nulls for a null mask."""
    names = STATS.names
    return pd.DataFrame([dict.fromkeys(names) if t is None else measured(decode(t)) for t in texts], columns=names).astype(object)


@F.pandas_udf(T.StringType())
def union_mask(lists: pd.Series) -> pd.Series:
    """The pixelwise union of each list of masks of one size; null for an empty or null list."""
    found = ([decode(t) for t in ts if t is not None] if ts is not None else [] for ts in lists)
    return pd.Series([encode(united(ms, ms[0].shape)) if ms else None for ms in found], dtype=object)


@F.pandas_udf(T.LongType())
def pixels_in(texts: pd.Series, boxes: pd.DataFrame) -> pd.Series:
    """Pixels of each mask within a box (x0, y0, x1, y1), its end excluded; 0 without a mask."""
    out = []
    for t, b in zip(texts, boxes.itertuples(index=False), strict=True):
        out.append(0 if t is None or pd.isna(b.x0) else int(decode(t)[int(b.y0) : int(b.y1), int(b.x0) : int(b.x1)].sum()))
    return pd.Series(out)


def view_of(pano: np.ndarray, yaw_deg: float, pitch_deg: float, fov_deg: float, size: tuple[int, int], pano_yaw_deg: float = 0.0) -> np.ndarray:
    """The perspective view in a panorama of all directions, with bilinear samples; columns wrap around."""
    width, height = size
    focal = width / 2 / np.tan(np.radians(fov_deg) / 2)
    right, down = np.meshgrid(np.arange(width) - (width - 1) / 2, np.arange(height) - (height - 1) / 2)
    tilt = np.radians(pitch_deg)
    ahead, up = focal * np.cos(tilt) + down * np.sin(tilt), focal * np.sin(tilt) - down * np.cos(tilt)
    bearing = np.radians(yaw_deg - pano_yaw_deg) + np.arctan2(right, ahead)
    elevation = np.arctan2(up, np.hypot(right, ahead))
    rows, cols = pano.shape[:2]
    x = np.mod((bearing / (2 * np.pi) + 0.5) * cols, cols)
    y = np.clip((0.5 - elevation / np.pi) * rows, 0, rows - 1)
    left, above = np.floor(x).astype(int), np.floor(y).astype(int)
    part_x, part_y = (x - left)[..., None], (y - above)[..., None]
    left %= cols
    beside, below = (left + 1) % cols, np.minimum(above + 1, rows - 1)
    mixed = lambda r: pano[r, left] + (pano[r, beside].astype(float) - pano[r, left]) * part_x
    one, two = mixed(above), mixed(below)
    return np.clip(one + (two - one) * part_y, 0, 255).astype(np.uint8)


@F.pandas_udf(T.BinaryType())
def pano_view(images: pd.Series, yaw: pd.Series, pitch: pd.Series, pano_yaw: pd.Series, fov: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """PNG views of PNG panoramas; null for a null image. An unknown yaw of the panorama counts as 0."""
    rows = zip(images, yaw, pitch, pano_yaw.fillna(0.0), fov, width, height, strict=True)
    return pd.Series([None if i is None else to_png(view_of(from_png(i), a, p, f, (int(w), int(h)), b)) for i, a, p, b, f, w, h in rows], dtype=object)
