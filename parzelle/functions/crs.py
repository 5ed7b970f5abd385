"""Coordinate reference systems as Column maths.

Transverse Mercator by the Krüger series (to the fourth power of the third
flattening, below a millimetre within a zone), and the seven-parameter shift from
DHDN to ETRS89, which is good to a few metres.
"""

from __future__ import annotations

import math
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.functions.geometry import bbox


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def rectifying(self) -> float:
        n2 = self.n ** 2
        return self.a / (1 + self.n) * (1 + n2 / 4 + n2 * n2 / 64)


GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
BESSEL = Ellipsoid(6377397.155, 1 / 299.1528128)


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid; ``lon0`` in degrees."""

    ellipsoid: Ellipsoid
    lon0: float
    k0: float
    false_easting: float


# The supported EPSG codes and their published parameters.
# 4326 is longitude/latitude in degrees and has no grid.
GRIDS = {
    25832: Grid(GRS80, 9.0, 0.9996, 500000.0),
    25833: Grid(GRS80, 15.0, 0.9996, 500000.0),
    4647: Grid(GRS80, 9.0, 0.9996, 32500000.0),
    31466: Grid(BESSEL, 6.0, 1.0, 2500000.0),
    31467: Grid(BESSEL, 9.0, 1.0, 3500000.0),
    31468: Grid(BESSEL, 12.0, 1.0, 4500000.0),
}
SUPPORTED = (4326, *sorted(GRIDS))

# Published shift DHDN -> ETRS89 (EPSG operation 1777, position vector
# convention): metres, arc seconds, parts per million.
SHIFT_METRES = (598.1, 73.7, 418.2)
SHIFT_SECONDS = (0.202, 0.045, -2.455)
SHIFT_PPM = 6.7


def _forward_coefficients(n: float) -> tuple[float, ...]:
    return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280)


def _inverse_coefficients(n: float) -> tuple[float, ...]:
    return (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280)


def _latitude_coefficients(n: float) -> tuple[float, ...]:
    return (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630)


def _sum(terms) -> Column:
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    return total


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _to_grid(point: Column, grid: Grid) -> Column:
    """Longitude/latitude in radians to easting/northing."""
    ell = grid.ellipsoid
    e = math.sqrt(ell.e2)

    def conformal(p: Column) -> Column:
        s = F.sin(p["y"])
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        dlon = p["x"] - math.radians(grid.lon0)
        return F.struct(F.atan2(t, F.cos(dlon)).alias("xi"),
                        F.atanh(F.sin(dlon) / F.sqrt(1 + t * t)).alias("eta"))

    def series(c: Column) -> Column:
        alpha = _forward_coefficients(ell.n)
        xi = c["xi"] + _sum(a * F.sin(2 * j * c["xi"]) * F.cosh(2 * j * c["eta"])
                            for j, a in enumerate(alpha, start=1))
        eta = c["eta"] + _sum(a * F.cos(2 * j * c["xi"]) * F.sinh(2 * j * c["eta"])
                              for j, a in enumerate(alpha, start=1))
        scale = grid.k0 * ell.rectifying
        return _pair(grid.false_easting + scale * eta, scale * xi)

    return _bind(_bind(point, conformal), series)


def _from_grid(point: Column, grid: Grid) -> Column:
    """Easting/northing to longitude/latitude in radians."""
    ell = grid.ellipsoid
    scale = grid.k0 * ell.rectifying

    def start(p: Column) -> Column:
        return F.struct((p["y"] / scale).alias("xi"),
                        ((p["x"] - grid.false_easting) / scale).alias("eta"))

    def series(c: Column) -> Column:
        beta = _inverse_coefficients(ell.n)
        xi = c["xi"] - _sum(b * F.sin(2 * j * c["xi"]) * F.cosh(2 * j * c["eta"])
                            for j, b in enumerate(beta, start=1))
        eta = c["eta"] - _sum(b * F.cos(2 * j * c["xi"]) * F.sinh(2 * j * c["eta"])
                              for j, b in enumerate(beta, start=1))
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def geographic(c: Column) -> Column:
        chi = F.asin(F.sin(c["xi"]) / F.cosh(c["eta"]))
        lon = math.radians(grid.lon0) + F.atan2(F.sinh(c["eta"]), F.cos(c["xi"]))
        return _bind(F.struct(chi.alias("chi"), lon.alias("lon")), lambda g: _pair(
            g["lon"], g["chi"] + _sum(d * F.sin(2 * j * g["chi"]) for j, d in
                                      enumerate(_latitude_coefficients(ell.n), start=1))))

    return _bind(_bind(_bind(point, start), series), geographic)


def _to_space(point: Column, ell: Ellipsoid) -> Column:
    def space(p: Column) -> Column:
        radius = ell.a / F.sqrt(1 - ell.e2 * F.pow(F.sin(p["y"]), F.lit(2.0)))
        return F.struct((radius * F.cos(p["y"]) * F.cos(p["x"])).alias("X"),
                        (radius * F.cos(p["y"]) * F.sin(p["x"])).alias("Y"),
                        (radius * (1 - ell.e2) * F.sin(p["y"])).alias("Z"))
    return _bind(point, space)


def _from_space(vector: Column, ell: Ellipsoid) -> Column:
    """Bowring's closed formula; exact enough at ground level."""
    b = ell.a * (1 - ell.f)
    second = ell.e2 / (1 - ell.e2)

    def geographic(v: Column) -> Column:
        p = F.sqrt(v["X"] * v["X"] + v["Y"] * v["Y"])
        theta = F.atan2(v["Z"] * ell.a, p * b)
        lat = F.atan2(v["Z"] + second * b * F.pow(F.sin(theta), F.lit(3.0)),
                      p - ell.e2 * ell.a * F.pow(F.cos(theta), F.lit(3.0)))
        return _pair(F.atan2(v["Y"], v["X"]), lat)
    return _bind(vector, geographic)


def _shift(point: Column, to_etrs: bool) -> Column:
    source, target = (BESSEL, GRS80) if to_etrs else (GRS80, BESSEL)
    sign = 1 if to_etrs else -1
    tx, ty, tz = SHIFT_METRES
    rx, ry, rz = (math.radians(s / 3600) for s in SHIFT_SECONDS)
    k = 1 + SHIFT_PPM * 1e-6

    def moved(v: Column) -> Column:
        if sign > 0:
            gx, gy, gz = v["X"], v["Y"], v["Z"]
            return F.struct((tx + k * (gx - rz * gy + ry * gz)).alias("X"),
                            (ty + k * (rz * gx + gy - rx * gz)).alias("Y"),
                            (tz + k * (-ry * gx + rx * gy + gz)).alias("Z"))
        gx, gy, gz = (v["X"] - tx) / k, (v["Y"] - ty) / k, (v["Z"] - tz) / k
        # the rotations are small: one correction step inverts them to 1e-10
        ux, uy, uz = gx + rz * gy - ry * gz, gy - rz * gx + rx * gz, gz + ry * gx - rx * gy
        return F.struct((gx + rz * uy - ry * uz).alias("X"),
                        (gy - rz * ux + rx * uz).alias("Y"),
                        (gz + ry * ux - rx * uy).alias("Z"))

    return _from_space(_bind(_to_space(point, source), moved), target)


def reproject(point: Column, src: int, dst: int) -> Column:
    """A ``struct<x,y>`` moved from one supported EPSG code to another."""
    for code in (src, dst):
        if code not in SUPPORTED:
            raise ValueError(f"unsupported EPSG code {code}; supported: {SUPPORTED}")
    if src == dst:
        return point
    source, target = GRIDS.get(src), GRIDS.get(dst)
    if source and target and (source.ellipsoid, source.lon0, source.k0) == \
            (target.ellipsoid, target.lon0, target.k0):
        return _pair(point["x"] + (target.false_easting - source.false_easting), point["y"])

    here = _from_grid(point, source) if source else _pair(
        F.radians(point["x"]), F.radians(point["y"]))
    old_source = source is not None and source.ellipsoid == BESSEL
    old_target = target is not None and target.ellipsoid == BESSEL
    if old_source != old_target:
        here = _shift(here, to_etrs=old_source)
    if target:
        return _to_grid(here, target)
    return _bind(here, lambda p: _pair(F.degrees(p["x"]), F.degrees(p["y"])))


def reproject_rings(rings: Column, src: int, dst: int) -> Column:
    """The same for every vertex of a polygon or line."""
    return F.transform(rings, lambda ring: F.transform(
        ring, lambda p: reproject(p, src, dst)))


def reproject_box(box: Column, src: int, dst: int, steps: int = 21) -> Column:
    """Bounding box of a reprojected box; its sides bend, so they are sampled."""
    at = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)),
                     lambda i: i.cast("double") / float(steps - 1))
    dx, dy = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    sides = F.concat(
        F.transform(at, lambda t: _pair(box["minx"] + t * dx, box["miny"])),
        F.transform(at, lambda t: _pair(box["minx"] + t * dx, box["maxy"])),
        F.transform(at, lambda t: _pair(box["minx"], box["miny"] + t * dy)),
        F.transform(at, lambda t: _pair(box["maxx"], box["miny"] + t * dy)))
    moved = F.transform(sides, lambda p: reproject(p, src, dst))
    return _bind(moved, lambda pts: F.struct(
        F.array_min(F.transform(pts, lambda p: p["x"])).alias("minx"),
        F.array_min(F.transform(pts, lambda p: p["y"])).alias("miny"),
        F.array_max(F.transform(pts, lambda p: p["x"])).alias("maxx"),
        F.array_max(F.transform(pts, lambda p: p["y"])).alias("maxy")))


def unified(df: DataFrame, target: int, srid: str = "srid", geom: str | None = "geom",
            point: tuple[str, str] | None = None, sources: Collection[int] = SUPPORTED) -> DataFrame:
    """All rows in the system ``target``, each moved from the one its ``srid`` names.

    ``geom`` is a column of rings, ``point`` a pair of coordinate columns (with ``geom`` of
    ``None``); box columns, where present, are taken anew from the moved rings. Rows of a
    system that isn't among ``sources``, or of none, are refused at run time, not passed on
    as they are. Naming the sources in use keeps the expression short.
    """
    if target not in SUPPORTED:
        raise ValueError(f"unsupported EPSG code {target}; supported: {SUPPORTED}")

    def moved(value: Column, move) -> Column:
        refused = F.raise_error(F.concat(F.lit("no way from SRID "), F.coalesce(
            F.col(srid).cast("string"), F.lit("null")), F.lit(f" to {target}")))
        out = F.when(F.col(srid) == target, value)
        for code in sources:
            if code != target:
                out = out.when(F.col(srid) == code, move(value, code, target))
        return out.otherwise(refused)

    if geom is None:
        x, y = point
        there = df.withColumn("__p", moved(_pair(F.col(x).cast("double"), F.col(y).cast("double")), reproject))
        there = there.withColumns({x: F.col("__p.x"), y: F.col("__p.y")}).drop("__p")
    else:
        there = df.withColumn(geom, F.when(F.col(geom).isNotNull(), moved(F.col(geom), reproject_rings)))
        if {"minx", "miny", "maxx", "maxy"} <= set(df.columns):
            there = there.withColumn("__b", F.expr(bbox(geom)))
            there = there.withColumns({k: F.col(f"__b.{k}") for k in ("minx", "miny", "maxx", "maxy")}).drop("__b")
    return there.withColumn(srid, F.lit(target))


def common_system(left: DataFrame, right: DataFrame,
                  srid: str = "srid") -> tuple[int, list[int]] | None:
    """The system to bring two tables into and those in use; ``None`` if there is just one.

    It is the grid most rows of ``right`` are in. Reads the SRID columns
    alone; what comes back is at most one number more than there are systems.
    """
    counts = (left.select(F.col(srid).alias("s"), F.lit(0).alias("n"))
              .union(right.select(F.col(srid).alias("s"), F.lit(1).alias("n")))
              .groupBy("s").agg(F.sum("n").alias("n")).limit(len(SUPPORTED) + 1).collect())
    if len(counts) <= 1:
        return None
    unknown = [r["s"] for r in counts if r["s"] not in SUPPORTED]
    if unknown:
        raise ValueError(f"tables of several systems, and no way from SRID {unknown}")
    target = max((r for r in counts if r["s"] in GRIDS), key=lambda r: (r["n"], -r["s"]))["s"]
    return target, sorted(r["s"] for r in counts)
