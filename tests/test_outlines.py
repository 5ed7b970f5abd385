"""Large outlines, tiled, against plain numpy over all their edges."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from parzelle.functions import geometry as G
from parzelle.operators import outlines as O
from parzelle.operators import spatial as S

EDGE = "array<array<struct<x:double,y:double>>>"


def star(rng, n, cx, cy, low, high, digits=3):
    """A ring of n corners around a centre, counter-clockwise, closed."""
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    radius = rng.uniform(low, high, n)
    ring = [(round(float(cx + r * math.cos(a)), digits), round(float(cy + r * math.sin(a)), digits))
            for a, r in zip(angles, radius, strict=True)]
    return [*ring, ring[0]]


def polygons(spark, data):
    return spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in ring] for ring in rings])
                                  for i, rings in data], f"id string, geom {EDGE}")


def edges_of(rings):
    return np.array([(*p, *q) for ring in rings for p, q in zip(ring, ring[1:], strict=False)])


def inside(e, px, py):
    up = (e[:, 1] <= py) != (e[:, 3] <= py)
    x1, y1, x2, y2 = e[up].T
    return int((x1 + (py - y1) * (x2 - x1) / (y2 - y1) > px).sum()) % 2 == 1


def area_in_box(e, a, b, c, d):
    """Integral of the height clamped to the box, edge by edge."""
    e = e[e[:, 0] != e[:, 2]]
    x1, y1, x2, y2 = e.T
    m = (y2 - y1) / (x2 - x1)
    lo, hi = np.maximum(np.minimum(x1, x2), a), np.minimum(np.maximum(x1, x2), b)
    on = hi > lo
    lo, hi, x1, y1, x2, m = (v[on] for v in (lo, hi, x1, y1, x2, m))
    total = np.zeros(len(lo))
    # linear between the places where the edge passes the bottom and the top
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.stack([lo, np.clip(np.where(m != 0, x1 + (c - y1) / m, lo), lo, hi),
                      np.clip(np.where(m != 0, x1 + (d - y1) / m, lo), lo, hi), hi])
    t.sort(axis=0)
    h = np.clip(y1 + m * (t - x1), c, d) - c
    for k in range(3):
        total += (t[k + 1] - t[k]) * (h[k] + h[k + 1]) / 2
    return float((np.where(x1 > x2, 1, -1) * total).sum())


def boxes(spark, data):
    return spark.createDataFrame([(i, *map(float, b)) for i, *b in data],
                                 "id int, minx double, miny double, maxx double, maxy double") \
        .withColumn("geom", F.expr(G.box_rings("minx", "miny", "maxx", "maxy")))


def grid(cx, cy, reach, step, size):
    steps = np.arange(-reach, reach, step)
    return [(k, cx + x, cy + y, cx + x + size, cy + y + size)
            for k, (x, y) in enumerate((x, y) for x in steps for y in steps)]


def test_an_outline_of_200_000_vertices_against_all_parcels(spark):
    rng = np.random.default_rng(5)
    cx, cy = 467_000.0, 5_912_000.0
    ring, hole = star(rng, 200_000, cx, cy, 1_590, 1_600), star(rng, 3_000, cx, cy, 290, 310)[::-1]
    rings = [ring, hole]
    e = edges_of(rings)
    area = polygons(spark, [("big", rings)]).cache()
    tiles = O.tiles(area, "id", "geom").cache()
    assert tiles.select(F.max(F.size("sides"))).first()[0] <= O.CHUNK
    assert tiles.select(F.max(F.size("edges"))).first()[0] <= 3 * O.CHUNK
    total = tiles.selectExpr("aggregate(edges, 0D, (s, e) -> s + (e.x1 - e.x2) * ((e.y1 + e.y2) / 2 - miny)) as a") \
        .agg(F.sum("a")).first()[0]
    assert total == pytest.approx(area_in_box(e, cx - 2e3, cx + 2e3, cy - 2e3, cy + 2e3), rel=1e-9)
    parcels = grid(cx, cy, 1_700, 100, 81.5)
    got = {r["b"]: r["shared"] for r in S.overlay(area.withColumnRenamed("id", "a"), boxes(
        spark, parcels).withColumnRenamed("id", "b"), "a", "b").collect()}
    want = {k: area_in_box(e, x0, x1, y0, y1) for k, x0, y0, x1, y1 in parcels}
    assert set(got) == {k for k, v in want.items() if v > 1e-6}
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in got)
    # touching: everything with a shared area, and the reverse up to pairs that only touch
    touched = {r["id"] for r in S.parcels_touching(area.withColumnRenamed("id", "area_id"),
                                                   boxes(spark, parcels), "area_id", "id").collect()}
    assert touched >= set(got)
    corners = {k for k, x0, y0, x1, y1 in parcels if inside(e, x0, y0)}
    assert corners <= touched
    # the tip of a spike on a parcel's side, or so little within that it could be rounding
    for k in touched - set(got):
        _, x0, y0, x1, y1 = parcels[k]
        assert want[k] < 1e-6 and ((e[:, 0] >= x0) & (e[:, 0] <= x1) & (e[:, 1] >= y0) & (e[:, 1] <= y1)).any()
    dots = [(i, round(float(x), 3), round(float(y), 3)) for i, (x, y) in enumerate(
        rng.uniform(-1_650, 1_650, (400, 2)) + (cx, cy))]
    found = S.points_in_parcels(spark.createDataFrame(dots, "point_id int, x double, y double"),
                                area, "point_id", "id")
    assert {r["point_id"] for r in found.collect()} == {i for i, x, y in dots if inside(e, x, y)}


@pytest.fixture
def few(monkeypatch):
    """Every polygon of more than twelve edges is large, cells are small, rows short."""
    for name, value in (("LARGE", 12), ("ACROSS", 1), ("LEAST_SIDE", 2.0), ("CHUNK", 5)):
        monkeypatch.setattr(O, name, value)


def shapes(seed, n=4):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        cx, cy = rng.uniform(-20, 20, 2)
        rings = [star(rng, int(rng.integers(13, 60)), cx, cy, 6, 14, 1)]
        if k % 2:
            rings.append(star(rng, 15, cx, cy, 1, 5, 1)[::-1])
        out.append((f"s{k}", rings))
    # straight sides along and across the cells, corners on whole numbers
    comb = [(0, 0), (30, 0), *((x, y) for x in range(30, 0, -2) for y in ((9, 2) if x % 4 else (2, 9)))]
    out.append(("comb", [[*((float(x), float(y)) for x, y in comb), (0.0, 0.0)]]))
    out.append(("slope", [[*((float(k), float(k)) for k in range(0, 16)), (0.0, 15.0), (0.0, 0.0)]]))
    return out


@pytest.mark.parametrize("seed", [1])
def test_tiled_equals_untiled(spark, monkeypatch, few, seed):
    data = shapes(seed)
    areas = polygons(spark, data)
    others = polygons(spark, [(f"o{i}", r) for i, r in shapes(seed + 50, 2)])
    small = boxes(spark, grid(0.0, 0.0, 36, 8, 6.0)).withColumn("id", F.concat(F.lit("b"), F.col("id").cast("string")))
    mixed = others.union(small.select("id", "geom"))
    rng = random.Random(seed)
    dots = [(i, rng.randrange(-300, 350) / 10, rng.randrange(-300, 350) / 10) for i in range(500)]
    dots += [(1_000 + i, *p) for i, p in enumerate(q for _, rings in data for q in rings[0][::7])]
    points = spark.createDataFrame(dots, "point_id int, x double, y double")

    def everything():
        left = areas.withColumnRenamed("id", "area_id")
        shared = S.overlay(left, mixed.withColumnRenamed("id", "gml_id"), "area_id", "gml_id").collect()
        return ({(r["area_id"], r["gml_id"]): r["shared"] for r in shared},
                rows(S.parcels_touching(left, mixed, "area_id", "id")),
                rows(S.parcels_touching(mixed.withColumnRenamed("id", "area_id"), areas, "area_id", "id")),
                rows(S.points_in_parcels(points, areas, "point_id", "id")))
    tiled = everything()
    monkeypatch.setattr(O, "LARGE", 10_000)
    plain = everything()
    assert tiled[1:] == plain[1:]
    assert set(tiled[0]) == set(plain[0])
    assert all(tiled[0][k] == pytest.approx(plain[0][k], abs=1e-7) for k in plain[0])
    assert len(plain[1]) > 50 and len(plain[3]) > 50


def test_kept_columns_come_along(spark, few):
    areas = polygons(spark, shapes(9)).withColumn("use", F.concat(F.lit("u"), "id"))
    parcels = boxes(spark, grid(0.0, 0.0, 20, 10, 8.0))
    got = S.overlay(areas.withColumnRenamed("id", "a"), parcels.withColumnRenamed("id", "b"), "a", "b",
                    keep_left=["use"]).collect()
    assert got and all(r["use"] == "u" + r["a"] for r in got)
    assert len({(r["a"], r["b"]) for r in got}) == len(got)


def test_cells_of_a_dense_outline_are_small(spark):
    # edges that go to and fro: sixteen of their lengths would be half of the outline
    data = polygons(spark, [("1", [star(np.random.default_rng(5), 3_000, 100, 100, 90, 110)])])
    filed = O.tiles(data, "id", "geom").filter("size(sides) > 0")
    assert filed.selectExpr("max(maxx - minx) as side").first()["side"] < 20
