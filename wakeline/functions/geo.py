"""Geometry as column expressions. Points are structs (lon, lat), rings and lines arrays of points, polygons arrays of
rings of which the first is the outer one. Everything here stays within Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of points in degrees; not clamped, so rounding beyond 1 gives NaN."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def valid_position(lat: Column, lon: Column) -> Column:
    """Whether latitude and longitude are in their ranges, bounds included; NaN passes, null does not."""
    return F.coalesce((F.isnan(lat) | lat.between(-90, 90)) & (F.isnan(lon) | lon.between(-180, 180)), F.lit(False))


def checked(value: Column, lat: Column, lon: Column) -> Column:
    """value, or an error that names the position if that is out of range."""
    return F.when(valid_position(lat, lon), value).otherwise(
        F.raise_error(F.format_string("position out of range: lat %s, lon %s", lat.cast("string"), lon.cast("string")))
    )


def on_grid(value: Column) -> Column:
    """Six decimals, as all coordinates of GeoJSON documents have."""
    return F.round(value, 6)


def bbox(points: Column) -> Column:
    """min_lon, min_lat, max_lon, max_lat of an array of points; null for none."""
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.when(
        F.size(points) > 0,
        F.struct(F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"), F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat")),
    )


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes meet, borders included."""
    return (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"]) & (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"])


def center(points: Column) -> Column:
    """The mean of the points, a repeated last one included; (0, 0) for none."""
    mean = lambda name: F.when(
        F.size(points) > 0, F.aggregate(points, F.lit(0.0), lambda s, p: s + p[name]) / F.size(points)
    ).otherwise(F.lit(0.0))
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def closed(ring: Column) -> Column:
    """The ring, with its first point repeated at its end if it is open."""
    return F.when(F.try_element_at(ring, F.lit(1)) != F.try_element_at(ring, F.lit(-1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def is_closed(node_ids: Column) -> Column:
    """Two nodes at least, of which the first is the last."""
    return (F.size(node_ids) >= 2) & (F.try_element_at(node_ids, F.lit(1)) == F.try_element_at(node_ids, F.lit(-1)))


def _pairs(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_line(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), _pairs(points), F.lit(")"))


def wkt_polygon(rings: Column) -> Column:
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), _pairs(r), F.lit(")"))), ", "), F.lit(")"))


def edges(ring: Column) -> Column:
    """The sides of a ring, each a struct (ax, ay, bx, by)."""
    n = F.size(ring) - 1
    return F.zip_with(
        F.slice(ring, 1, n), F.slice(ring, 2, n),
        lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")),
    )


def polygon_area(rings: Column) -> Column:
    """The outer ring's area without the holes'; lon and lat as plane coordinates, taken from each ring's first point."""
    def area(ring: Column) -> Column:
        x, y = (F.try_element_at(ring, F.lit(1))[c] for c in ("lon", "lat"))
        terms = F.transform(edges(closed(ring)), lambda e: (e["ax"] - x) * (e["by"] - y) - (e["bx"] - x) * (e["ay"] - y))
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2

    areas = F.transform(rings, area)
    return F.try_element_at(areas, F.lit(1)) * 2 - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


def _inside(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside: a ray to the right crosses an odd number of sides, and no side has the point."""
    sides = edges(closed(ring))
    crossed = F.filter(
        sides, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    )
    on_side = F.exists(
        sides,
        lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    return (F.size(crossed) % 2 == 1) & ~on_side


def contains_point(rings: Column, lat: Column, lon: Column) -> Column:
    """Strictly inside the outer ring and not strictly inside a hole: on the outer border false, on a hole's true."""
    return _inside(F.try_element_at(rings, F.lit(1)), lon, lat) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: _inside(r, lon, lat))


def ring_key(ring: Column) -> Column:
    """A form that is equal for rings with the same points in the same order, wherever they start and whichever way they
    turn: from the least point on, towards the lesser neighbour."""
    def once(value: Column, use) -> Column:
        """use(value), with value evaluated once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def turned(r: Column) -> Column:
        return once(F.array_position(r, F.array_min(r)).cast("int"), lambda at: F.concat(F.slice(r, at, F.size(r)), F.slice(r, 1, at - 1)))

    points = F.when(F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return once(points, lambda p: once(F.reverse(p), lambda q: F.least(turned(p), turned(q))))
