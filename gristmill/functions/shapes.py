"""Geometry as column expressions: points, boxes, circles, segments, polygons; boxes of any dimension, intervals of
floats, places on the globe. A null part gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the radius of the earth in metres, as the extension for great circles has it.
EARTH = 6378168.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a.x - b.x, a.y - b.y)


def slope(a: Column, b: Column) -> Column:
    """Of the line through two points; upright ones have the largest double."""
    return F.when(a.x == b.x, F.lit(1.7976931348623157e308)).otherwise((b.y - a.y) / (b.x - a.x))


def box(a: Column, b: Column) -> Column:
    """The box with two opposite corners, whichever they are."""
    return F.struct(point(F.greatest(a.x, b.x), F.greatest(a.y, b.y)).alias("high"), point(F.least(a.x, b.x), F.least(a.y, b.y)).alias("low"))


def box_overlaps(a: Column, b: Column) -> Column:
    return (a.low.x <= b.high.x) & (b.low.x <= a.high.x) & (a.low.y <= b.high.y) & (b.low.y <= a.high.y)


def box_contains(a: Column, b: Column) -> Column:
    return (a.high.x >= b.high.x) & (a.low.x <= b.low.x) & (a.high.y >= b.high.y) & (a.low.y <= b.low.y)


def box_has_point(a: Column, p: Column) -> Column:
    return p.x.between(a.low.x, a.high.x) & p.y.between(a.low.y, a.high.y)


def box_intersection(a: Column, b: Column) -> Column:
    """Null if the boxes don't meet."""
    high = point(F.least(a.high.x, b.high.x), F.least(a.high.y, b.high.y))
    low = point(F.greatest(a.low.x, b.low.x), F.greatest(a.low.y, b.low.y))
    return F.when(box_overlaps(a, b), F.struct(high.alias("high"), low.alias("low")))


def box_area(a: Column) -> Column:
    return (a.high.x - a.low.x) * (a.high.y - a.low.y)


def center(a: Column) -> Column:
    return point((a.high.x + a.low.x) / 2, (a.high.y + a.low.y) / 2)


def circle(p: Column, radius: Column) -> Column:
    return F.struct(p.alias("center"), radius.cast("double").alias("radius"))


def circle_has_point(c: Column, p: Column) -> Column:
    return distance(c.center, p) <= c.radius


def circle_overlaps(a: Column, b: Column) -> Column:
    return distance(a.center, b.center) <= a.radius + b.radius


def circle_area(c: Column) -> Column:
    return F.pi() * c.radius * c.radius


def _turn(a: Column, b: Column, c: Column) -> Column:
    """1, 0 or -1: c left of, on or right of the line from a to b."""
    return F.signum((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segment ab and segment cd have a point in common."""
    across = (_turn(a, b, c) * _turn(a, b, d) <= 0) & (_turn(c, d, a) * _turn(c, d, b) <= 0)
    return across & box_overlaps(box(a, b), box(c, d))


def _edges(polygon: Column) -> Column:
    """array<struct<a, b>> of a polygon's sides, the closing one included."""
    turned = F.concat(F.slice(polygon, F.lit(2), F.size(polygon) - 1), F.slice(polygon, 1, 1))
    return F.arrays_zip(polygon.alias("a"), turned.alias("b"))


def polygon_area(polygon: Column) -> Column:
    """Of array<point>, whatever its direction."""
    return F.abs(F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def path_length(path: Column) -> Column:
    """Of an open path, array<point>."""
    sides = F.slice(_edges(path), F.lit(1), F.size(path) - 1)
    return F.aggregate(sides, F.lit(0.0), lambda s, e: s + distance(e.a, e.b))


def polygon_has_point(polygon: Column, p: Column) -> Column:
    """Inside or on a side: a ray to the right crosses an odd number of sides."""
    sides = _edges(polygon)
    on = F.exists(sides, lambda e: (_turn(e.a, e.b, p) == 0) & box_has_point(box(e.a, e.b), p))
    crossed = F.filter(sides, lambda e: ((e.a.y > p.y) != (e.b.y > p.y)) & (p.x < (e.b.x - e.a.x) * (p.y - e.a.y) / (e.b.y - e.a.y) + e.a.x))
    return on | (F.size(crossed) % 2 == 1)


def cube(a: Column, b: Column | None = None) -> Column:
    """A box of any dimension from two corners, array<double>; one corner is a point."""
    b = a if b is None else b
    return F.struct(F.zip_with(a, b, lambda x, y: F.least(x, y)).alias("low"), F.zip_with(a, b, lambda x, y: F.greatest(x, y)).alias("high"))


def cube_union(a: Column, b: Column) -> Column:
    return F.struct(F.zip_with(a.low, b.low, lambda x, y: F.least(x, y)).alias("low"), F.zip_with(a.high, b.high, lambda x, y: F.greatest(x, y)).alias("high"))


def cube_intersection(a: Column, b: Column) -> Column:
    """Sides may be negative where the cubes don't meet."""
    return F.struct(F.zip_with(a.low, b.low, lambda x, y: F.greatest(x, y)).alias("low"), F.zip_with(a.high, b.high, lambda x, y: F.least(x, y)).alias("high"))


def _every(a: Column, b: Column, op) -> Column:
    return F.forall(F.zip_with(a, b, op), lambda x: x)


def cube_contains(a: Column, b: Column) -> Column:
    return _every(a.low, b.low, lambda x, y: x <= y) & _every(a.high, b.high, lambda x, y: x >= y)


def cube_overlaps(a: Column, b: Column) -> Column:
    return _every(a.low, b.high, lambda x, y: x <= y) & _every(b.low, a.high, lambda x, y: x <= y)


def cube_size(a: Column) -> Column:
    return F.aggregate(F.zip_with(a.high, a.low, lambda x, y: x - y), F.lit(1.0), lambda s, x: s * x)


def cube_distance(a: Column, b: Column) -> Column:
    """Between the nearest points; 0 where the cubes meet."""
    gap = F.zip_with(F.zip_with(a.low, b.high, lambda x, y: x - y), F.zip_with(b.low, a.high, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def cube_enlarge(a: Column, r: float) -> Column:
    """Each side moved out by r; sides that would cross meet in their middle."""
    middle = F.zip_with(a.low, a.high, lambda x, y: (x + y) / 2)
    return F.struct(F.zip_with(a.low, middle, lambda x, m: F.least(x - r, m) if r < 0 else x - r).alias("low"), F.zip_with(a.high, middle, lambda x, m: F.greatest(x + r, m) if r < 0 else x + r).alias("high"))


def seg(lo: Column, hi: Column) -> Column:
    """An interval of floats; a null end is open."""
    return F.struct(F.coalesce(lo.cast("double"), F.lit(float("-inf"))).alias("lo"), F.coalesce(hi.cast("double"), F.lit(float("inf"))).alias("hi"))


def seg_overlaps(a: Column, b: Column) -> Column:
    return (a.lo <= b.hi) & (b.lo <= a.hi)


def seg_contains(a: Column, b: Column) -> Column:
    return (a.lo <= b.lo) & (a.hi >= b.hi)


def seg_left(a: Column, b: Column) -> Column:
    return a.hi < b.lo


def seg_union(a: Column, b: Column) -> Column:
    return seg(F.least(a.lo, b.lo), F.greatest(a.hi, b.hi))


def seg_intersection(a: Column, b: Column) -> Column:
    return F.when(seg_overlaps(a, b), seg(F.greatest(a.lo, b.lo), F.least(a.hi, b.hi)))


def earth_distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres along the great circle; places in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a, lon_b))))


def near_in_degrees(lat: Column, lon: Column, at: tuple[float, float], metres: float) -> Column:
    """A box in degrees that holds every place within the distance, as a filter that scans can push down; check
    `earth_distance` afterwards. Near a pole or beyond a quarter of the globe it holds all longitudes."""
    import math

    up = math.degrees(metres / EARTH) * (1 + 1e-9)
    inside = lat.between(at[0] - up, at[0] + up)
    if abs(at[0]) + up >= 90:
        return inside
    aside = math.degrees(math.asin(min(1.0, math.sin(math.radians(up)) / math.cos(math.radians(at[0]))))) * (1 + 1e-9)
    west, east = at[1] - aside, at[1] + aside
    across = lon.between(west, east)
    if west < -180:
        across = across | (lon >= west + 360)
    if east > 180:
        across = across | (lon <= east - 360)
    return inside & across
