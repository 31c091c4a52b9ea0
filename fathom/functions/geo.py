"""Points and shapes: GeoJSON, distances on the sphere, containment and relations.

Points are Columns, and so are circle, box and polygon tests of them. Shapes are GeoJSON texts, related by an Arrow UDF
after a test of bounding boxes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.plans.errors import need, only

#: Mean radius of the earth in metres, as the haversine of sorting and distance queries has it.
RADIUS = 6_371_008.7714
Ring = list[tuple[float, float]]


def point(g: dict) -> tuple[float, float]:
    need(isinstance(g, dict) and g.get("type") == "Point", "need a GeoJSON Point")
    lon, lat = g["coordinates"][:2]
    need(-180 <= lon <= 180 and -90 <= lat <= 90, "coordinates are longitude and latitude")
    return float(lon), float(lat)


def point_columns(v: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a column struct<type, coordinates>."""
    return F.get(v["coordinates"], F.lit(0)).cast("double"), F.get(v["coordinates"], F.lit(1)).cast("double")


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def in_ring(lon: Column, lat: Column, ring: Ring) -> Column:
    """Whether a ray to the east crosses the ring an odd number of times; a ring's points on its southern and western sides are inside."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if y1 != y2:
            over = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings = crossings + F.when(over & (lon < F.lit((x2 - x1) / (y2 - y1)) * (lat - F.lit(y1)) + F.lit(x1)), 1).otherwise(0)
    return crossings % 2 == 1


def polygons(g: dict) -> list[list[Ring]]:
    need(isinstance(g, dict) and g.get("type") in ("Polygon", "MultiPolygon"), "geometry is a Polygon or MultiPolygon")
    found = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
    out = [[[(float(x[0]), float(x[1])) for x in ring] for ring in poly] for poly in found]
    need(all(len(r) >= 4 and r[0] == r[-1] for p in out for r in p), "rings are closed and have four points at least")
    return out


def contains_point(shape: str, body: dict) -> Callable[[Column, Column], Column]:
    if shape == "circle":
        only(body, "center! radius!", "circle")
        need(body["radius"] >= 0, "radius must not be negative")
        lon0, lat0 = point(body["center"])
        return lambda lon, lat: distance(lon, lat, F.lit(lon0), F.lit(lat0)) <= float(body["radius"])
    if shape == "box":
        only(body, "bottomLeft! topRight!", "box")
        (w, s), (e, n) = point(body["bottomLeft"]), point(body["topRight"])
        need(w < e and s < n, "bottomLeft must be south and west of topRight")
        return lambda lon, lat: lon.between(w, e) & lat.between(s, n)
    found = polygons(body)

    def test(lon: Column, lat: Column) -> Column:
        every = []
        for outer, *holes in found:
            xs, ys = [x for x, _ in outer], [y for _, y in outer]
            inside = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & in_ring(lon, lat, outer)
            for h in holes:
                inside &= ~in_ring(lon, lat, h)
            every.append(inside)
        return reduce(or_, every)

    return test


class Shape:
    """Points, lines and polygons (rings, the first the outer one) of a GeoJSON geometry; plane geometry in degrees."""

    def __init__(self, g: dict) -> None:
        self.points: list[tuple[float, float]] = []
        self.lines: list[Ring] = []
        self.polygons: list[list[Ring]] = []
        self._add(g)
        every = [*self.points, *[p for x in self.lines for p in x], *[p for poly in self.polygons for p in poly[0]]]
        self.box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))

    def _add(self, g: dict) -> None:
        pairs = lambda line: [(float(p[0]), float(p[1])) for p in line]
        kind, x = g["type"], g.get("coordinates")
        if kind == "GeometryCollection":
            for part in g["geometries"]:
                self._add(part)
        elif kind in ("Point", "MultiPoint"):
            self.points += pairs([x] if kind == "Point" else x)
        elif kind in ("LineString", "MultiLineString"):
            self.lines += [pairs(line) for line in ([x] if kind == "LineString" else x)]
        else:
            self.polygons += [[pairs(r) for r in poly] for poly in ([x] if kind == "Polygon" else x)]

    def edges(self) -> list[tuple]:
        return [(a, b) for line in [*self.lines, *[r for p in self.polygons for r in p]] for a, b in zip(line, line[1:], strict=False)]

    def vertices(self) -> list[tuple[float, float]]:
        return [*self.points, *[p for line in self.lines for p in line], *[p for poly in self.polygons for r in poly for p in r]]

    def covers(self, p: tuple[float, float]) -> bool:
        """Whether a point is on or in the shape."""
        return p in self.points or any(_on(p, a, b) for a, b in self.edges()) or any(_in(p, poly[0]) and not any(_in(p, h) for h in poly[1:]) for poly in self.polygons)

    def intersects(self, other: Shape) -> bool:
        a, b = self.box, other.box
        if a[0] > b[2] or b[0] > a[2] or a[1] > b[3] or b[1] > a[3]:
            return False
        if any(self.covers(p) for p in other.vertices()) or any(other.covers(p) for p in self.vertices()):
            return True
        return any(_cross(e, f, True) for e in self.edges() for f in other.edges())

    def contains(self, other: Shape) -> bool:
        """All of the other's vertices and edge middles are covered, and no edges cross properly."""
        middles = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in other.edges()]
        return all(self.covers(p) for p in [*other.vertices(), *middles]) and not any(_cross(e, f, False) for e in [(a, b) for poly in self.polygons for r in poly for a, b in zip(r, r[1:], strict=False)] for f in other.edges())


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(p, a, b) -> bool:
    return abs(_side(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _in(p, ring) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def _cross(e, f, touching: bool) -> bool:
    (a, b), (c, d) = e, f
    s, t, u, v = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    return s * t < 0 and u * v < 0 or touching and (_on(c, a, b) or _on(d, a, b) or _on(a, c, d) or _on(b, c, d))


def relate(v: Column, geometry: dict, relation: str) -> Column:
    """Relation of a column's shape (GeoJSON as text, or a struct of type and coordinates) to the query's: `within` means inside the query's."""
    query = json.dumps(geometry)

    def run(shapes: pa.Array) -> pa.Array:
        other, out = Shape(json.loads(query)), []
        for s in shapes.to_pylist():
            if s is None:
                out.append(None)
                continue
            own = Shape(json.loads(s))
            out.append({"intersects": lambda: own.intersects(other), "disjoint": lambda: not own.intersects(other), "within": lambda: other.contains(own), "contains": lambda: own.contains(other)}[relation]())  # noqa: B023
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(v)
