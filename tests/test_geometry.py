import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parzelle.functions import crs
from parzelle.functions import geometry as G

L_WITH_HOLE = [[(0, 0), (8, 0), (8, 3), (3, 3), (3, 8), (0, 8), (0, 0)],
               [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]


def star(cx, cy, r, n=10):
    pts = []
    for i in range(n):
        rad = r if i % 2 == 0 else r / 2.5
        pts.append((cx + rad * math.cos(2 * math.pi * i / n), cy + rad * math.sin(2 * math.pi * i / n)))
    return [pts + pts[:1]]


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def frame(spark, *polygons):
    data = [tuple([[(float(x), float(y)) for x, y in ring] for ring in p] for p in polygons)]
    names = ", ".join(f"g{i} {G.RINGS}" for i in range(len(polygons)))
    return spark.createDataFrame(data, names)


def value(df, sql):
    return df.selectExpr(f"{sql} as v").first()["v"]


def shared(spark, a, b, shift=0.0):
    move = [[[(x + shift, y + shift) for x, y in r] for r in p] for p in (a, b)]
    df = frame(spark, *move).selectExpr(f"{G.edges('g0')} as a", f"{G.edges('g1')} as b")
    return value(df, G.overlap_area("a", "b"))


def inside(polygon, xs, ys):
    odd = np.zeros(xs.shape, bool)
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if y1 != y2:
                hit = ((y1 <= ys) != (y2 <= ys)) & (xs < x1 + (ys - y1) * (x2 - x1) / (y2 - y1))
                odd ^= hit
    return odd


def grid_area(a, b, lo, hi, n=1200):
    step = (hi - lo) / n
    c = lo + step * (np.arange(n) + 0.5)
    xs, ys = np.meshgrid(c, c)
    return float((inside(a, xs, ys) & inside(b, xs, ys)).sum()) * step * step


def test_area_and_box(spark):
    df = frame(spark, L_WITH_HOLE)
    assert value(df, G.area("g0")) == 38.0
    assert tuple(value(df, G.bbox("g0"))) == (0.0, 0.0, 8.0, 8.0)


def test_orient_fixes_both_rings(spark):
    wrong = [L_WITH_HOLE[0][::-1], L_WITH_HOLE[1][::-1]]
    df = frame(spark, wrong).selectExpr(f"{G.orient('g0')} as g")
    assert value(df, G.area("g")) == 38.0


@pytest.mark.parametrize("x, y, contained, covered", [
    (0.5, 0.5, True, True), (1.5, 1.5, False, False), (5, 5, False, False),
    (0, 4, False, True), (8, 3, False, True), (1, 1.5, False, True), (3, 5, False, True),
    (2.5, 2.5, True, True), (-1, 3, False, False), (9, 0, False, False)])
def test_point_tests(spark, x, y, contained, covered):
    df = frame(spark, L_WITH_HOLE).selectExpr(f"{G.edges('g0')} as e")
    assert value(df, G.contains_point("e", f"{float(x)}D", f"{float(y)}D")) is contained
    assert value(df, G.covers_point("e", f"{float(x)}D", f"{float(y)}D")) is covered


@pytest.mark.parametrize("other, meets", [
    (box(8, 0, 9, 1), True), (box(8.01, 0, 9, 1), False), (box(4, 4, 7, 7), False),
    (box(1.2, 1.2, 1.8, 1.8), False), (box(0.2, 0.2, 0.8, 0.8), True), (box(-5, -5, 20, 20), True),
    (box(1, 1, 2, 2), True), (box(3, 3, 9, 9), True), (box(8, 3, 10, 10), True)])
def test_intersects(spark, other, meets):
    df = frame(spark, L_WITH_HOLE, other).selectExpr(f"{G.edges('g0')} as a",
                                                     f"{G.edges('g1')} as b")
    assert value(df, G.intersects("a", "b")) is meets
    assert value(df, G.intersects("b", "a")) is meets


def test_overlap_of_concave_with_hole_and_star(spark):
    a, b = L_WITH_HOLE, star(3, 3, 3.5)
    assert shared(spark, a, b) == pytest.approx(grid_area(a, b, -1, 9), rel=2e-3)
    assert shared(spark, a, b) == pytest.approx(shared(spark, b, a), abs=1e-9)


def test_overlap_with_itself_is_its_area(spark):
    assert shared(spark, L_WITH_HOLE, L_WITH_HOLE) == pytest.approx(38.0, abs=1e-9)


def test_overlap_of_touching_boxes_is_zero(spark):
    assert shared(spark, box(0, 0, 1, 1), box(1, 0, 2, 1)) == 0.0
    assert shared(spark, box(0, 0, 1, 1), box(0, 1, 1, 2)) == pytest.approx(0.0, abs=1e-12)


def test_overlap_keeps_digits_at_large_coordinates(spark):
    assert shared(spark, L_WITH_HOLE, star(3, 3, 3.5), 5_900_000.0) == pytest.approx(
        shared(spark, L_WITH_HOLE, star(3, 3, 3.5)), abs=1e-6)


coordinate = st.integers(0, 12)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(coordinate, coordinate, st.integers(1, 6), st.integers(1, 6)),
                min_size=10, max_size=10))
def test_overlap_of_boxes_has_closed_form(spark, boxes):
    pairs = list(zip(boxes[:5], boxes[5:]))
    data = []
    for (ax, ay, aw, ah), (bx, by, bw, bh) in pairs:
        want = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
        data.append((box(*map(float, (ax, ay, ax + aw, ay + ah))),
                     box(*map(float, (bx, by, bx + bw, by + bh))), float(want)))
    df = spark.createDataFrame(data, f"g0 {G.RINGS}, g1 {G.RINGS}, want double").selectExpr(
        f"{G.edges('g0')} as a", f"{G.edges('g1')} as b", "want")
    for got, want in df.selectExpr(f"{G.overlap_area('a', 'b')} as got", "want").collect():
        assert got == pytest.approx(want, abs=1e-9)


def test_random_triangles_against_grid(spark):
    rng = random.Random(5)
    for _ in range(3):
        a, b = ([[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]] for _ in range(2))
        a, b = [a[0] + a[0][:1]], [b[0] + b[0][:1]]
        df = frame(spark, a, b).selectExpr(f"{G.edges(G.orient('g0'))} as a",
                                           f"{G.edges(G.orient('g1'))} as b")
        assert value(df, G.overlap_area("a", "b")) == pytest.approx(
            grid_area(a, b, 0, 10), abs=0.05)


def test_offset_line(spark):
    line = [[(0, 0), (10, 0), (10, 10)]]
    df = frame(spark, line).selectExpr("g0[0] as l")
    moved = [tuple(p) for p in value(df, G.offset_line("l", "1D"))]
    assert moved == [(0.0, 1.0), (9.0, 1.0), (9.0, 10.0)]


@pytest.mark.parametrize("wkt, first, parts", [
    ("POINT(1.5 2)", (1.5, 2.0), 1),
    ("SRID=25832;POINT (1.5 -2e3)", (1.5, -2000.0), 1),
    ("LINESTRING(0 0, 1 1, 2 0)", (0.0, 0.0), 1),
    ("MULTILINESTRING((0 0,1 1),(5 5,6 6))", (0.0, 0.0), 2),
    ("MULTIPOINT((1 2),(3 4))", (1.0, 2.0), 2),
    ("MULTIPOINT(1 2, 3 4)", (1.0, 2.0), 2),
    ("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", (0.0, 0.0), 2),
    ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", (0.0, 0.0), 2)])
def test_from_wkt(spark, wkt, first, parts):
    geom = value(spark.createDataFrame([(wkt,)], "w string"), G.from_wkt("w"))
    assert tuple(geom[0][0]) == first
    assert len(geom) == parts


def test_from_wkt_orients_and_measures(spark):
    df = spark.createDataFrame(
        [("MULTIPOLYGON(((0 0,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 2,1 1)),((5 5,6 5,6 6,5 5)))",)],
        "w string").selectExpr(f"{G.from_wkt('w')} as g")
    assert value(df, G.area("g")) == 15.5
    empty = spark.createDataFrame([("POLYGON EMPTY",), ("nonsense",)], "w string")
    assert [r[0] for r in empty.selectExpr(f"{G.from_wkt('w')} as g").collect()] == [[], None]


def test_texts(spark):
    df = frame(spark, box(0, 0, 2, 1.5))
    assert value(df, G.wkt_polygon("g0")) == (
        "POLYGON((0.000 0.000,2.000 0.000,2.000 1.500,0.000 1.500,0.000 0.000))")
    assert value(df, G.wkt_point("1.23456D", "2D")) == "POINT(1.235 2.000)"
    assert value(df, G.box_text(G.bbox("g0"))) == "BOX(0 0,2 1.5)"
    assert tuple(value(df, G.parse_box("'BOX(-1.5 2,3e2 4)'"))) == (-1.5, 2.0, 300.0, 4.0)
    assert value(df, G.parse_box("'POINT(1 2)'")) is None


# -- reference systems ----------------------------------------------------------

def moved(spark, points, src, dst):
    df = spark.createDataFrame([((float(x), float(y)),) for x, y in points],
                               "p struct<x:double,y:double>")
    return [tuple(r[0]) for r in df.select(crs.reproject(F.col("p"), src, dst)).collect()]


def test_northing_on_the_central_meridian_is_the_meridian_arc(spark):
    a, e2 = crs.GRS80.a, crs.GRS80.e2
    lat = math.radians(52.35)
    phi = (np.arange(200_000) + 0.5) * lat / 200_000
    arc = float((a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum() * lat / 200_000)
    (x, y), = moved(spark, [(9.0, 52.35)], 4326, 25832)
    assert x == pytest.approx(500_000, abs=1e-6)
    assert y == pytest.approx(0.9996 * arc, abs=1e-4)


def test_projection_is_conformal(spark):
    lon, lat, d = 11.3, 49.7, 1e-5
    east, west, north, south = moved(spark, [(lon + d, lat), (lon - d, lat), (lon, lat + d),
                                             (lon, lat - d)], 4326, 25832)
    e2, phi = crs.GRS80.e2, math.radians(lat)
    # metric of the ellipsoid: a degree of longitude against a degree of latitude
    ratio = math.cos(phi) * (1 - e2 * math.sin(phi) ** 2) / (1 - e2)
    per_lon = ((east[0] - west[0]) / ratio, (east[1] - west[1]) / ratio)
    per_lat = (north[0] - south[0], north[1] - south[1])
    assert per_lon[0] == pytest.approx(per_lat[1], rel=1e-7)
    assert per_lon[1] == pytest.approx(-per_lat[0], rel=1e-5)


@pytest.mark.parametrize("code", [25832, 25833, 4647])
def test_round_trip(spark, code):
    points = [(7.1, 47.3), (9.0, 50.0), (13.4, 54.9)]
    back = moved(spark, moved(spark, points, 4326, code), code, 4326)
    for (x, y), (u, v) in zip(points, back):
        assert abs(x - u) * 111_000 < 1e-3 and abs(y - v) * 111_000 < 1e-3


@pytest.mark.parametrize("code, lon", [(31466, 6.5), (31467, 9.5), (31468, 12.5)])
def test_datum_shift_round_trip(spark, code, lon):
    (x, y), = moved(spark, [(lon, 51.0)], 4326, code)
    (u, v), = moved(spark, [(x, y)], code, 4326)
    assert abs(lon - u) * 70_000 < 0.01 and abs(51.0 - v) * 111_000 < 0.01


def test_zone_number_prefix(spark):
    assert moved(spark, [(500_000, 5_800_000)], 25832, 4647) == [(32_500_000.0, 5_800_000.0)]
    with pytest.raises(ValueError):
        crs.reproject(F.col("p"), 25832, 3857)


def test_reproject_shapes(spark):
    df = frame(spark, box(500_000, 5_800_000, 501_000, 5_801_000))
    ring = df.select(crs.reproject_rings(F.col("g0"), 25832, 4647)).first()[0][0]
    assert tuple(ring[2]) == (32_501_000.0, 5_801_000.0)
    b = df.selectExpr(f"{G.bbox('g0')} as b").select(
        crs.reproject_box(F.col("b"), 25832, 4326, 5)).first()[0]
    assert b["minx"] == pytest.approx(9.0, abs=1e-9) and b["miny"] < b["maxy"]


def _exact_turn(x1, y1, x2, y2, px, py):
    x1, y1, x2, y2, px, py = map(Fraction, (x1, y1, x2, y2, px, py))
    d = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
    return (d > 0) - (d < 0)


def test_turn_is_exact_where_doubles_are_not(spark):
    """Against whole numbers: points on slanted edges, next to them by one unit in the last place."""
    rng = random.Random(11)
    cases = []
    for _ in range(300):
        # cadastral coordinates on a binary grid: exact points of the line exist
        ox, oy = rng.randrange(300_000, 700_000), rng.randrange(5_200_000, 6_100_000)
        dx, dy = (rng.randrange(-2**22, 2**22) / 2**20 for _ in "xy")
        n, m = rng.randrange(1, 400), rng.randrange(0, 400)
        e = (ox, oy, ox + dx * n, oy + dy * n)
        px, py = ox + dx * m, oy + dy * m
        for qx, qy in ((px, py), (math.nextafter(px, 1e9), py), (px, math.nextafter(py, 0)),
                       (math.nextafter(px, 0), math.nextafter(py, 1e9))):
            cases.append((*map(float, e), qx, qy))
    for _ in range(300):  # decimals, as they come from files
        e = [round(rng.uniform(4e5, 4.01e5), 3), round(rng.uniform(5.8e6, 5.801e6), 3)] * 2
        e[2] = round(e[0] + rng.uniform(-90, 90), 3)
        e[3] = round(e[1] + rng.uniform(-90, 90), 3)
        t = rng.random()
        cases.append((*e, e[0] + t * (e[2] - e[0]), e[1] + t * (e[3] - e[1])))
    # the differences themselves are rounded here
    cases += [(0.5 + i * 2.0**-53, 0.5 + j * 2.0**-53, 12.0, 12.0, 24.0, 24.0)
              for i in range(0, 24, 2) for j in range(0, 24, 2)]
    cases += [(0.0, 0.0, 0.5, 0.5, 12.0, 24.0), (0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
              (12.0, 12.0, 24.0, 24.0, 0.5, 0.5), (-8.0, 49.1, 9.0, 49.1, 0.0, 49.1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "id int, x1 double, y1 double, x2 double, y2 double, px double, py double")
    got = [r[0] for r in df.selectExpr("id", "px", "py", "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2) as e")
           .selectExpr("id", f"{G.turn('e', 'px', 'py')} as t").orderBy("id").select("t").collect()]
    want = [_exact_turn(*c) for c in cases]
    assert got == want
    plain = [(d > 0) - (d < 0) for d in ((c[2] - c[0]) * (c[5] - c[1]) - (c[4] - c[0]) * (c[3] - c[1]) for c in cases)]
    assert plain != want  # the cases are hard enough


def test_boundary_of_a_slanted_outline_far_from_the_origin(spark):
    ox, oy = 467_123.0, 5_912_345.0
    ring = [(ox, oy), (ox + 99, oy + 33), (ox + 66, oy + 99), (ox, oy)]
    df = spark.range(1).selectExpr("array(array(" + ", ".join(
        f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ring) + ")) as g").selectExpr(f"{G.edges('g')} as e")
    for k in range(1, 33):
        x, y = ox + 3 * k, oy + k
        above, below = math.nextafter(y, 1e9), math.nextafter(y, 0)
        assert df.selectExpr(G.on_boundary("e", f"{x}D", f"{y}D"), G.contains_point("e", f"{x}D", f"{y}D"),
                             G.contains_point("e", f"{x}D", f"{above!r}D"), G.covers_point("e", f"{x}D", f"{below!r}D")
                             ).first() == (True, False, True, False)
