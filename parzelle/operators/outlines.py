"""Outlines with very many vertices, cut into tiles for the spatial joins.

A border of a million vertices should not travel with every parcel beside it. It is laid on
a square grid of its own, whose cells are some edges wide, and each cell becomes a small
feature of its own that the grid join files like any other. Where the edges lie so densely
that a cell would hold very many, cells are smaller, down to the length of an edge:

* *Edges filed by cell.* Each edge is cut at the lines of the grid, row by row and column by
  column; an array of them is never built. A tile holds the pieces of at most ``CHUNK``
  consecutive edges; a cell where more of them meet has several tiles, whose results add up.
* *Winding offset.* Where the pieces of a cell leave it, the rest of the outline is replaced
  by the cell's own upper and lower side, as often as the outline winds around them. How
  often follows from the edges that cross the line further right: a sum over the cells
  of the row, as each cell knows its own crossings.
* *Cells wholly inside* have no pieces. The run of them between two cells with pieces is one
  tile with two sides and no edges, so the interior costs as much as the border.

Areas, crossings of a ray and meetings of edges are sums over a polygon's edges, so they are
worked out tile by tile and added up by pair. Tests of points and of meeting edges look at the
uncut edges and are as exact as those of small polygons; the cells' sides lie between the
millimetres to which points are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parzelle.functions import geometry as G
from parzelle.session import materialize

#: Polygons with more edges are tiled.
LARGE = 1_000
#: Side of a cell in average edge lengths, at most and at least, and in any case at least.
ACROSS, LEAST_ACROSS, LEAST_SIDE = 16, 1, 1.0
#: Edges that a cell may hold on average over the box before cells get smaller.
DENSE = 16
#: Consecutive edges whose pieces share a row.
CHUNK = 256

_CELL = ["id", "side", "x0", "y0", "i", "j"]
_TILE = ["id", "minx", "miny", "maxx", "maxy", "edges", "sides", "lids"]


def edge_count(geom: str) -> str:
    return f"coalesce(aggregate({geom}, 0, (n, r) -> n + greatest(size(r) - 1, 0)), 0)"


def split(polygons: DataFrame, geom: str) -> tuple[DataFrame, DataFrame | None]:
    """The polygons of up to ``LARGE`` edges and the others (``None`` without any).

    A column ``n_edges`` stored with the data saves reading all geometry for it.
    """
    n = "n_edges" if "n_edges" in polygons.columns else edge_count(geom)
    most = polygons.selectExpr(f"max({n}) as n").first()["n"]
    if (most or 0) <= LARGE:
        return polygons, None
    return polygons.filter(f"{n} <= {LARGE}"), polygons.filter(f"{n} > {LARGE}")


def _edge(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"named_struct('x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2})"


def _pieces(polygons: DataFrame, ident: str, geom: str) -> DataFrame:
    """A row for each edge and cell that it passes: the piece and the sides it opens."""
    length = "sqrt(power(e.x2 - e.x1, 2) + power(e.y2 - e.y1, 2))"
    dense = f"sqrt({DENSE} * (b.maxx - b.minx) * (b.maxy - b.miny) / size(es))"
    # the least side if a vertex has no coordinates
    width = f"if(mean is null, null, greatest({LEAST_ACROSS} * mean, least({ACROSS} * mean, {dense})))"
    edges = (polygons.selectExpr(f"{ident} as id", f"{G.edges(geom)} as es", f"{G.bbox(geom)} as b")
             .selectExpr("id", "es", "b", f"aggregate(es, 0D, (sum, e) -> sum + {length}) / size(es) as mean")
             .selectExpr("id", f"greatest({LEAST_SIDE}D, ceil({width} * 1000) / 1000D) as side",
                         "floor(b.minx) - 0.0005D as x0", "floor(b.miny) - 0.0005D as y0", "es")
             .selectExpr("id", "side", "x0", "y0", "posexplode(es) as (pos, e)")
             # one outline's edges are dealt to many tasks; they are grouped there as well
             .selectExpr("id", "side", "x0", "y0", f"pos div {CHUNK} as chunk", "e").repartition("id", "chunk")
             .selectExpr("id", "side", "x0", "y0", "chunk", "e", "floor((e.y1 - y0) / side) as r1",
                         "floor((e.y2 - y0) / side) as r2"))

    def x_at(y: str) -> str:
        at = f"e.x1 + ({y} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)"
        return f"greatest(least(e.x1, e.x2), least(greatest(e.x1, e.x2), {at}))"

    def end(row: str, x: str, y: str, name: str) -> list[str]:
        return [f"case when {row} = i then {x} when {row} < i then {x_at('low')} else {x_at('high')} end as {name}x",
                f"case when {row} = i then {y} when {row} < i then low else high end as {name}y"]
    rows = (edges.selectExpr("*", "explode(sequence(least(r1, r2), greatest(r1, r2))) as i")
            .selectExpr("*", "y0 + i * side as low", "y0 + (i + 1) * side as high")
            .selectExpr("*", *end("r1", "e.x1", "e.y1", "a"), *end("r2", "e.x2", "e.y2", "b"))
            .selectExpr("*", "floor((ax - x0) / side) as c1", "floor((bx - x0) / side) as c2"))

    def y_at(x: str) -> str:
        at = f"ay + ({x} - ax) * (by - ay) / (bx - ax)"
        return f"greatest(least(ay, by), least(greatest(ay, by), {at}))"

    def cut(column: str, x: str, y: str, name: str) -> list[str]:
        return [f"case when {column} = j then {x} when {column} < j then left else right end as {name}x",
                f"case when {column} = j then {y} when {column} < j then {y_at('left')}"
                f" else {y_at('right')} end as {name}y"]
    # An edge that rises through a line has the inside to its left there, one that
    # falls to its right; the side from there to the cell's left corner is added or taken off.
    return (rows.selectExpr("*", "explode(sequence(least(c1, c2), greatest(c1, c2))) as j")
            .selectExpr("*", "x0 + j * side as left", "x0 + (j + 1) * side as right",
                        "if(greatest(r1, r2) > i and j = if(r1 > r2, c1, c2), cast(sign(r2 - r1) as int), 0) as up",
                        "if(least(r1, r2) < i and j = if(r1 < r2, c1, c2), cast(sign(r2 - r1) as int), 0) as down")
            .selectExpr("*", *cut("c1", "ax", "ay", "p"), *cut("c2", "bx", "by", "q"),
                        "if(r1 > r2, ax, bx) as xt", "if(r1 < r2, ax, bx) as xb")
            .selectExpr(
                *_CELL, "chunk", "up", "down", f"{_edge('px', 'py', 'qx', 'qy')} as piece",
                "named_struct('x1', e.x1, 'y1', e.y1, 'x2', e.x2, 'y2', e.y2, 'lo', least(px, qx),"
                " 'hi', greatest(px, qx)) as uncut",
                f"case when up > 0 then {_edge('xt', 'high', 'left', 'high')}"
                f" when up < 0 then {_edge('left', 'high', 'xt', 'high')} end as upper",
                f"case when down > 0 then {_edge('left', 'low', 'xb', 'low')}"
                f" when down < 0 then {_edge('xb', 'low', 'left', 'low')} end as lower",
                "if(up <> 0, named_struct('lo', left, 'hi', xt), null) as lid"))


def tiles(polygons: DataFrame, ident: str, geom: str) -> DataFrame:
    """The tiles of polygons: ``id``, box and, of the part in the cell, ``edges`` (closed, to add
    up areas), ``sides`` (the uncut edges, ``lo`` to ``hi`` the part of their x range in
    the cell) and ``lids`` (parts of its upper side below which it lies)."""
    chunks = materialize(
        _pieces(polygons, ident, geom).groupBy(*_CELL, "chunk").agg(
            F.concat(F.collect_list("piece"), F.collect_list("upper"), F.collect_list("lower"))
            .alias("edges"), F.collect_list("uncut").alias("sides"),
            F.collect_list("lid").alias("lids"), F.sum("up").alias("up"),
            F.sum("down").alias("down")), "tiles")
    further = Window.partitionBy("id", "i").orderBy(F.desc("j"))
    before = further.rowsBetween(Window.unboundedPreceding, -1)
    cells = (chunks.groupBy(*_CELL).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
             .withColumns({"tops": F.coalesce(F.sum("up").over(before), F.lit(0)),
                           "bottoms": F.coalesce(F.sum("down").over(before), F.lit(0)),
                           "next": F.lag("j").over(further)}))

    def frame(first: str, last: str, tops: str, bottoms: str, test: str) -> str:
        return (f"if({test}, named_struct('first', {first}, 'last', {last}, 'tops', {tops},"
                f" 'bottoms', {bottoms}), null)")
    frames = (cells.selectExpr(
        "id", "side", "x0", "y0", "i", "inline(array_compact(array("
        + frame("j", "j", "tops", "bottoms", "tops <> 0 or bottoms <> 0") + ", "
        + frame("j + 1", "next - 1", "tops", "tops", "next > j + 1 and tops <> 0") + ")))")
        .selectExpr("id", "x0 + first * side as minx", "y0 + i * side as miny",
                    "x0 + (last + 1) * side as maxx", "y0 + (i + 1) * side as maxy", "tops", "bottoms"))

    def repeated(times: str, one: str, other: str) -> str:
        return f"array_repeat(if({times} > 0, {one}, {other}), cast(abs({times}) as int))"
    up, down = _edge("maxx", "maxy", "minx", "maxy"), _edge("minx", "maxy", "maxx", "maxy")
    low, back = _edge("minx", "miny", "maxx", "miny"), _edge("maxx", "miny", "minx", "miny")
    sides = chunks.schema["sides"].dataType.simpleString()
    framed = frames.selectExpr(
        "id", "minx", "miny", "maxx", "maxy",
        f"concat({repeated('tops', up, down)}, {repeated('bottoms', low, back)}) as edges",
        f"cast(array() as {sides}) as sides",
        "array_repeat(named_struct('lo', minx, 'hi', maxx), cast(abs(tops) as int)) as lids")
    filed = chunks.selectExpr("id", "x0 + j * side as minx", "y0 + i * side as miny",
                              "x0 + (j + 1) * side as maxx", "y0 + (i + 1) * side as maxy",
                              "edges", "sides", "lids")
    return filed.unionByName(framed).select(*_TILE)


def crossings(tile: str, px: str, py: str) -> str:
    """How often the ray upwards from a point of the cell crosses the tile's part."""
    return (f"(size(filter({tile}_sides, ts -> ts.lo <= {px} and {px} < ts.hi"
            f" and {G.turn('ts', px, py)} = if(ts.x1 < ts.x2, -1, 1)))"
            f" + size(filter({tile}_lids, tl -> tl.lo <= {px} and {px} < tl.hi)))")


def holding(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the pairs whose point (``a_minx``, ``a_miny``) lies inside the polygon whose
    tiles are side b; the border is not inside. A point belongs to one cell."""
    point = ("a_minx", "a_miny")
    return (pairs.filter("a_minx >= b_minx and a_minx < b_maxx and a_miny >= b_miny and a_miny < b_maxy")
            .selectExpr(*keys, f"{crossings('b', *point)} as n",
                        f"{G.on_boundary('b_sides', *point)} as edge")
            .filter("n > 0 or edge").groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.bool_or("edge").alias("edge"))
            .filter("n % 2 = 1 and not edge").select(*keys))
