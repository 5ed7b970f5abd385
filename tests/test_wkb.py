"""Well-known binary against ``struct``: every type, both byte orders, extra dimensions."""

import itertools
import math
import struct

import pytest

from parzelle.functions import geometry as G
from parzelle.functions import wkb as B
from parzelle.sources import tables

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
AWAY = [(x + 5_800_000.123, y - 0.1) for x, y in SQUARE]


def head(kind, order, dims="", srid=None, iso=False):
    code = kind
    if iso:
        code += {"": 0, "z": 1000, "m": 2000, "zm": 3000}[dims]
    else:
        code |= (0x80000000 if "z" in dims else 0) | (0x40000000 if "m" in dims else 0)
    code |= 0x20000000 if srid is not None else 0
    out = struct.pack("B", order == "<") + struct.pack(order + "I", code)
    return out + (struct.pack(order + "I", srid) if srid is not None else b"")


def dots(points, order, dims=""):
    return b"".join(struct.pack(f"{order}{2 + len(dims)}d", *p, *[7.5] * len(dims)) for p in points)


def counted(points, order, dims=""):
    return struct.pack(order + "I", len(points)) + dots(points, order, dims)


def point(p, order, **k):
    return head(1, order, **k) + dots([p], order, k.get("dims", ""))


def line(points, order, **k):
    return head(2, order, **k) + counted(points, order, k.get("dims", ""))


def polygon(rings, order, kind=3, **k):
    return (head(kind, order, **k) + struct.pack(order + "I", len(rings))
            + b"".join(counted(r, order, k.get("dims", "")) for r in rings))


def several(kind, parts, order, **k):
    return head(kind, order, **k) + struct.pack(order + "I", len(parts)) + b"".join(parts)


def parsed(spark, values):
    df = spark.createDataFrame(list(enumerate(bytearray(v) if v is not None else None for v in values)),
                               "i int, b binary")
    got = df.selectExpr("i", f"{B.from_wkb('b')} as g", f"{B.wkb_srid('b')} as s").orderBy("i").collect()
    return [(None if r.g is None else [[(p.x, p.y) for p in ring] for ring in r.g], r.s) for r in got]


def test_every_type_in_both_orders(spark):
    values, want = [], []
    for order, (dims, iso), srid in itertools.product(
            "<>", [("", False), ("z", False), ("m", True), ("zm", True), ("zm", False)], (None, 25832)):
        k = {"dims": dims, "iso": iso}
        inner = {**k}
        top = {**k, "srid": srid}
        p, ring = point((1.5, -2.25), order, **inner), polygon([SQUARE, HOLE], order, **inner)
        cases = [
            (point((1.5, -2.25), order, **top), [[(1.5, -2.25)]]),
            (line(SQUARE[:3], order, **top), [SQUARE[:3]]),
            (polygon([SQUARE, HOLE], order, **top), [SQUARE, HOLE]),
            # wound the other way round
            (polygon([SQUARE[::-1], HOLE[::-1]], order, **top), [SQUARE, HOLE]),
            (polygon([SQUARE], order, kind=17, **top), [SQUARE]),
            (several(4, [p, p], order, **top), [[(1.5, -2.25)]] * 2),
            (several(5, [line(HOLE, order, **inner), line(SQUARE, order, **inner)], order, **top),
             [HOLE, SQUARE]),
            (several(6, [ring, polygon([AWAY], order, **inner)], order, **top), [SQUARE, HOLE, AWAY]),
            (several(16, [polygon([SQUARE], order, kind=17, **inner)], order, **top), [SQUARE]),
            # a collection in a collection, the order changing within
            (several(7, [several(7, [p, several(6, [ring], order, **inner)], order, **inner),
                         line(HOLE, ">" if order == "<" else "<", **inner)], order, **top),
             [[(1.5, -2.25)], SQUARE, HOLE, HOLE]),
            (polygon([], order, **top), []), (line([], order, **top), []), (several(7, [], order, **top), []),
            (point((math.nan, math.nan), order, **top), []),
        ]
        values += [v for v, _ in cases]
        want += [(w, srid) for _, w in cases]
    assert parsed(spark, values) == want


@pytest.mark.parametrize("order", "<>")
def test_doubles_are_exact(spark, order):
    numbers = [0.0, 1.0, -1.0, 0.1, -5_812_345.678, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308,
               2.2250738585072009e-308, math.pi, 2.0**52 + 1, -math.inf, 32_500_000.001, 1e-300]
    pairs = list(zip(numbers, numbers[::-1], strict=True))
    assert parsed(spark, [line(pairs, order)])[0][0] == [pairs]
    df = spark.createDataFrame([([[{"x": x, "y": y} for x, y in pairs]],)], f"g {G.RINGS}")
    for srid in (None, 25833):
        made = df.selectExpr(f"{B.to_wkb('g', srid and str(srid), order == '>')} as b").first().b
        assert bytes(made) == polygon([pairs], order, srid=srid)


def test_broken_values(spark):
    good = polygon([SQUARE, HOLE], "<")
    cut = [good[:n] for n in range(len(good))]
    broken = [None, good + b"\0", good + good, b"\2" + good[1:], head(8, "<") + counted(SQUARE, "<"),
              several(6, [good, good], "<")[:-1], struct.pack("<BII", 1, 4, 2) + point((1.0, 2.0), "<"),
              struct.pack("<BII", 1, 2, 0xFFFFFFFF), struct.pack("<BII", 1, 4003, 0)]
    assert {g is None for g, _ in parsed(spark, cut + broken)} == {True}


def test_nulls_are_not_written(spark):
    df = spark.createDataFrame([(None,), ([[{"x": 1.0, "y": None}]],), ([],)], f"g {G.RINGS}")
    assert [r.b for r in df.selectExpr(f"{B.to_wkb('g')} as b").collect()] == [
        None, None, bytearray(polygon([], "<"))]


def test_equals_the_text_form(spark):
    text = "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1)),((9 9,9 8,8 8,9 9)))"
    value = several(6, [polygon([SQUARE, HOLE], ">"),
                        polygon([[(9.0, 9.0), (9.0, 8.0), (8.0, 8.0), (9.0, 9.0)]], "<")], "<")
    df = spark.createDataFrame([(text, bytearray(value))], "w string, b binary")
    row = df.selectExpr(f"{G.from_wkt('w')} as a", f"{B.from_wkb('b')} as b").first()
    assert row.a == row.b


def test_geometry_columns_of_tables(spark):
    value = polygon([SQUARE], "<", srid=25833)
    binary = spark.createDataFrame([(1, bytearray(value), "x")], "id int, wkb_geometry binary, geom string")
    box = (0.0, 0.0, 4.0, 4.0)
    row = tables.with_geometry(binary, "wkb_geometry").first()
    assert row["srid"] == 25833 and len(row["geom"][0]) == 5 and tuple(row)[3:] == box
    texts = [value.hex(), value.hex().upper(), "SRID=25833;POLYGON((0 0,4 0,4 4,0 4,0 0))",
             "POLYGON((0 0,4 0,4 4,0 4,0 0))", value.hex()[:-2], "nothing", None]
    got = tables.with_geometry(spark.createDataFrame(list(enumerate(texts)), "id int, g string"), "g")
    assert got.columns == ["id", "geom", "srid", "minx", "miny", "maxx", "maxy"]
    got = got.orderBy("id").collect()
    assert [r["srid"] for r in got] == [25833, 25833, 25833, None, 25833, None, None]
    assert [tuple(r)[3:] for r in got] == [box] * 4 + [(None,) * 4] * 3


def test_values_are_parsed_once(spark):
    """Merged projections would parse a value for every use of its geometry."""
    rows = spark.range(1).selectExpr("id", "unhex('00000000013FF00000000000004000000000000000') as wkb")
    parsed = tables.with_geometry(rows, "wkb").selectExpr("id", "size(geom) as n", "geom[0][0].x as x", "minx", "maxy")
    optimized = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Generate inline") == 1
    assert [tuple(r) for r in parsed.collect()] == [(0, 1, 1.0, 1.0, 2.0)]
