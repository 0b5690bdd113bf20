"""Column functions for plane geometry, angles, projections and short geodesics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def segment_distance(p: Point, a: Point, b: Point) -> Column:
    """Distance of a point from a segment; of a segment of no length, from its end."""
    n = nearest_on_segment(p, a, b)
    return F.sqrt((p[0] - n[0]) * (p[0] - n[0]) + (p[1] - n[1]) * (p[1] - n[1]))


def nearest_on_segment(p: Point, a: Point, b: Point) -> Point:
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return a[0] + t * dx, a[1] + t * dy


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether two segments have a point in common, ends included."""
    turn = lambda p, q, r: F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    within = lambda p, q, r: (r[0] >= F.least(p[0], q[0])) & (r[0] <= F.greatest(p[0], q[0])) & (r[1] >= F.least(p[1], q[1])) & (r[1] <= F.greatest(p[1], q[1]))
    one, two, three, four = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    touch = ((one == 0) & within(a, b, c)) | ((two == 0) & within(a, b, d)) | ((three == 0) & within(c, d, a)) | ((four == 0) & within(c, d, b))
    return ((one != two) & (three != four)) | touch


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """The wrapped absolute difference of two azimuths, in degrees."""
    return F.abs(F.pmod(a - b + F.lit(540.0), F.lit(360.0)) - F.lit(180.0))


def outward_normal(a: Point, b: Point) -> Column:
    """Azimuth of the right-hand normal of an edge of a counter-clockwise ring."""
    return azimuth(b[1] - a[1], -(b[0] - a[0]))


def signed_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring of structs (x, y)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area2(ring) > 0, ring).otherwise(F.reverse(ring))


#: Published polynomials between WGS84 and the Dutch grid (power of x, power of y, factor).
TO_LAT = ((0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.2475), (2, 1, -0.84978), (0, 3, -0.0655), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.0053), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012))
TO_LON = ((1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026))
TO_X = ((0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148))
TO_Y = ((1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054))
LAT0, LON0, X0, Y0 = 52.15517440, 5.38720621, 155000.0, 463000.0


def _powers(v, n):
    out = None
    for _ in range(n):
        out = v if out is None else out * v
    return out


def _polynomial(a, b, terms):
    total = None
    for i, j, factor in terms:
        term = F.lit(factor)
        for part in (_powers(a, i), _powers(b, j)):
            term = term if part is None else term * part
        total = term if total is None else total + term
    return total


def to_lonlat(x: Column, y: Column) -> Point:
    dx, dy = (x - F.lit(X0)) * F.lit(1e-5), (y - F.lit(Y0)) * F.lit(1e-5)
    return F.lit(LON0) + _polynomial(dx, dy, TO_LON) / F.lit(3600.0), F.lit(LAT0) + _polynomial(dx, dy, TO_LAT) / F.lit(3600.0)


def to_grid(lon: Column, lat: Column) -> Point:
    dlat, dlon = (lat - F.lit(LAT0)) * F.lit(0.36), (lon - F.lit(LON0)) * F.lit(0.36)
    return F.lit(X0) + _polynomial(dlat, dlon, TO_X), F.lit(Y0) + _polynomial(dlat, dlon, TO_Y)


#: Fixed values of the WGS84 ellipsoid.
SEMI_MAJOR, E2 = 6378137.0, 0.0066943799901413165


def geodesic(a: Point, b: Point) -> tuple[Column, Column]:
    """Metres and azimuth from one lon/lat to another, for distances of some 100 m."""
    middle = F.radians((a[1] + b[1]) / 2)
    w = F.lit(1.0) - F.lit(E2) * F.sin(middle) * F.sin(middle)
    dlon = F.radians(b[0] - a[0])
    east = dlon * F.lit(SEMI_MAJOR) / F.sqrt(w) * F.cos(middle)
    north = F.radians(b[1] - a[1]) * F.lit(SEMI_MAJOR * (1 - E2)) / (w * F.sqrt(w))
    turned = F.degrees(F.atan2(east, north)) - F.degrees(dlon * F.sin(middle)) / 2
    return F.sqrt(east * east + north * north), F.pmod(turned, F.lit(360.0))
