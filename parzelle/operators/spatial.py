"""Spatial joins as equi joins on grid cells.

Each side is filed in square cells and joined on the cell; the exact geometry test
runs on the pairs whose boxes meet.

*Levels.* Cell sides grow by a factor of four from level to level. A feature is
filed at the level whose cell is one to four times its size, so it always lies in at
most four cells, be it a kerb stone or a whole country. Two features meet at the
coarser of their two levels. To keep small features of both sides from meeting in a
coarse cell, the join key holds a role: role 0 pairs the left side's own level with
right features of that level or finer, role 1 pairs finer left features with the
right side's own level. A finer feature is only filed at the coarser levels that the
other side really uses.

*Profile.* Which levels a side uses (at most sixteen numbers) and how many features
it has is found by one aggregation over the box columns before the join is planned.

*Duplicates.* A pair is kept in the one cell that holds the lower left corner of the
boxes' intersection, so no ``distinct`` is needed.

*Hot cells.* A cell whose features make more than ``SLICE_WORK`` pairs is cut into
slices of about that many: a hash of the feature id picks the slice row of a left and
the slice column of a right feature, and each is copied along the other axis. The
counts come from a pass over the box columns alone and are joined back on the cell, so
every heavy cell is cut, however many there are.

*Large outlines* are cut into tiles (``outlines``) that are joined in their place.

*Reference systems.* Where both sides have a column ``srid`` and it names more than one
system, both are moved into one before they are filed; systems without a way between
them are an error. Without the column on both sides coordinates are taken as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.functions import crs
from parzelle.functions import geometry as G
from parzelle.operators import outlines

BASE_CELL = 16.0
FACTOR = 4
TOP_LEVEL = 15
SLICE_WORK = 20_000_000

_KEY = ["__role", "__level", "__cx", "__cy"]
_BOX = ["minx", "miny", "maxx", "maxy"]

# smallest level whose cell side reaches the feature's larger side
_OWN_LEVEL = (f"least(cast(ceil(log({FACTOR}, greatest("
              f"greatest(maxx - minx, maxy - miny) / {BASE_CELL}D, 1D))) as int), {TOP_LEVEL})")


@dataclass(frozen=True)
class Profile:
    """Levels a side uses and the number of its features."""

    levels: tuple[int, ...]
    n: int


def _profiles(left: DataFrame, right: DataFrame) -> tuple[Profile, Profile]:
    def summary(df: DataFrame, side: int) -> DataFrame:
        return df.select(*_BOX).agg(F.lit(side).alias("side"),
                                    F.collect_set(F.expr(_OWN_LEVEL)).alias("levels"),
                                    F.count(F.lit(1)).alias("n"))
    rows = summary(left, 0).union(summary(right, 1)).collect()
    made = {r["side"]: Profile(tuple(sorted(r["levels"])), r["n"]) for r in rows}
    return made[0], made[1]


def _file_in_cells(df: DataFrame, other: Profile, left: bool) -> DataFrame:
    """One row per role, level and cell that the feature has to appear in.

    The left side's own level serves role 0, the right side's own level role 1 and,
    for pairs of equal level, role 0 too. Entries that the other side's levels leave
    without a partner are not made.
    """
    keep = df.columns
    lowest = min(other.levels, default=TOP_LEVEL + 1)
    levels = f"array({', '.join(map(str, other.levels))})" if other.levels else \
        "cast(array() as array<int>)"

    def entry(test: str, role: int) -> str:
        return f"if({test}, named_struct('role', {role}, 'level', own), null)"
    own = [entry(f"own >= {lowest}", 0)] if left else \
        [entry(f"own > {lowest}", 1), entry(f"array_contains({levels}, own)", 0)]
    up = (f"transform(filter({levels}, lv -> lv > own),"
          f" lv -> named_struct('role', {1 if left else 0}, 'level', lv))")
    entries = f"concat(array_compact(array({', '.join(own)})), {up})"
    side = f"({BASE_CELL}D * power({FACTOR}D, __level))"

    def cells(axis: str) -> str:
        return f"sequence(floor(min{axis} / {side}), floor(max{axis} / {side}))"

    # generators sit in selects of their own: Spark allows one per select
    return (df.selectExpr(*keep, f"{_OWN_LEVEL} as own")
            .selectExpr(*keep, f"inline({entries}) as (__role, __level)")
            .selectExpr(*keep, "__role", "__level", f"floor(minx / {side}) as __c0x",
                        f"floor(miny / {side}) as __c0y", f"explode({cells('x')}) as __cx")
            .selectExpr(*keep, "__role", "__level", "__c0x", "__c0y", "__cx",
                        f"explode({cells('y')}) as __cy"))


def _hot_cells(left: DataFrame, right: DataFrame, profiles: tuple[Profile, Profile]) -> DataFrame:
    """The heavy cells with the number of slices of each side.

    Counted on the box columns alone, so the scan behind it reads neither geometry
    nor attributes; the counts combine on the map side.
    """
    counted = (_file_in_cells(left.select(*_BOX), profiles[1], True)
               .selectExpr(*_KEY, "1 as l", "0 as r")
               .union(_file_in_cells(right.select(*_BOX), profiles[0], False)
                      .selectExpr(*_KEY, "0 as l", "1 as r"))
               .groupBy(*_KEY).agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    heavy = (counted.withColumn("work", F.expr("cast(l as double) * r"))
             .filter(F.col("work") > SLICE_WORK))
    # slices in all, then shared out so that both sides' slices have a like size
    total = f"ceil(work / {SLICE_WORK}D)"
    return (heavy.selectExpr(*_KEY, "l", "r", f"{total} as slices",
                             f"least(greatest(ceil(sqrt({total} * l / r)), 1), {total}) as n_a")
            .selectExpr(*_KEY, "cast(n_a as int) as __n_a",
                        "cast(ceil(slices / n_a) as int) as __n_b"))


def _slice_hot(cells: DataFrame, hot: DataFrame, ident: str, mine: str, other: str) -> DataFrame:
    """Fix this side's slice by hash and copy the row to every slice of the other side."""
    keep = cells.columns
    return (cells.join(hot, _KEY, "left")
            .selectExpr(
                *keep,
                f"cast(pmod(xxhash64(cast({ident} as string), minx, miny),"
                f" coalesce(__n_{mine}, 1)) as int)"
                f" as __{mine}",
                f"explode(sequence(0, coalesce(__n_{other}, 1) - 1)) as __{other}"))


def candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs whose boxes meet (borders included), each exactly once.

    Both inputs need ``minx, miny, maxx, maxy``. The left columns come out with the
    prefix ``a_``, the right ones with ``b_``. Rows with a null box drop out.
    """
    left, right = left.filter("minx is not null"), right.filter("minx is not null")
    profiles = _profiles(left, right)
    a = _file_in_cells(left, profiles[1], left=True)
    b = _file_in_cells(right, profiles[0], left=False)
    hot = _hot_cells(left, right, profiles)
    a = _slice_hot(a, hot, left_id, "a", "b")
    b = _slice_hot(b, hot, right_id, "b", "a")
    keys = [*_KEY, "__a", "__b"]
    a = a.selectExpr(*keys, "__c0x", "__c0y", *[f"{c} as a_{c}" for c in left.columns])
    b = b.selectExpr(*keys, "__c0x as __d0x", "__c0y as __d0y",
                     *[f"{c} as b_{c}" for c in right.columns])
    return (a.join(b, keys, "inner")
            .filter("__cx = greatest(__c0x, __d0x) and __cy = greatest(__c0y, __d0y)"
                    " and a_minx <= b_maxx and b_minx <= a_maxx"
                    " and a_miny <= b_maxy and b_miny <= a_maxy")
            .select(*[f"a_{c}" for c in left.columns], *[f"b_{c}" for c in right.columns]))


def with_box(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add box columns; store them with the data and the joins need not read geometry."""
    return (df.withColumn("__b", F.expr(G.bbox(geom)))
            .selectExpr(*df.columns, *[f"__b.{k}" for k in _BOX]))


def _prepared(df: DataFrame, ident: str, geom: str, keep: list[str] | None = None) -> DataFrame:
    """Id, box, edges and the columns to keep of a polygon side."""
    boxed = df if set(_BOX) <= set(df.columns) else with_box(df, geom)
    return boxed.selectExpr(f"{ident} as id", *_BOX, f"{G.edges(geom)} as edges", *(keep or []))


def _one_system(left: DataFrame, right: DataFrame, left_geom: str | None,
                right_geom: str) -> tuple[DataFrame, DataFrame]:
    """Both sides in one reference system; a side without ``left_geom`` has points ``x, y``."""
    if "srid" not in left.columns or "srid" not in right.columns:
        return left, right
    systems = crs.common_system(left, right)
    if systems is None:
        return left, right
    target, used = systems
    return (crs.unified(left, target, geom=left_geom, point=("x", "y"), sources=used),
            crs.unified(right, target, geom=right_geom, sources=used))


def points_in_parcels(points: DataFrame, parcels: DataFrame, point_id: str = "point_id",
                      parcel_id: str = "gml_id", geom: str = "geom") -> DataFrame:
    """``(point_id, parcel_id)`` for every point inside a parcel, borders excluded.

    Points have columns ``x`` and ``y``; they are rounded to millimetres first.
    """
    points, parcels = _one_system(points, parcels, None, geom)
    dots = points.selectExpr(f"{point_id} as id", "round(x, 3) as minx", "round(y, 3) as miny",
                             "round(x, 3) as maxx", "round(y, 3) as maxy")
    small, large = outlines.split(parcels, geom)
    found = (candidates(dots, _prepared(small, parcel_id, geom), "id", "id")
             .filter(G.contains_point("b_edges", "a_minx", "a_miny")).select("a_id", "b_id"))
    if large is not None:
        pairs = candidates(dots, outlines.tiles(large, parcel_id, geom), "id", "id")
        found = found.union(outlines.holding(pairs, ["a_id", "b_id"]))
    return found.selectExpr(f"a_id as {point_id}", f"b_id as {parcel_id}")


def _corners(polygons: DataFrame, ident: str, geom: str) -> DataFrame:
    """A vertex of every ring, as a point feature."""
    return (polygons.selectExpr(f"{ident} as id", f"explode({geom}) as ring").filter("size(ring) > 0")
            .selectExpr("id", "ring[0].x as minx", "ring[0].y as miny", "ring[0].x as maxx",
                        "ring[0].y as maxy"))


def _touching_large(left: tuple[DataFrame, DataFrame | None], right: tuple[DataFrame, DataFrame | None],
                    left_id: str, right_id: str, geom: str) -> DataFrame:
    """Pairs ``a_id, b_id`` that touch and have a large outline on a side.

    Either edges meet, or a whole ring of one lies inside the other: then the ring's first
    vertex does.
    """
    def rows(side: tuple[DataFrame, DataFrame | None], ident: str) -> tuple[DataFrame, DataFrame | None]:
        small, large = side
        kept = ["id", *_BOX, "sides"]
        return (_prepared(small, ident, geom).withColumnRenamed("edges", "sides").select(*kept),
                None if large is None else outlines.tiles(large, ident, geom))
    (a_small, a_tiles), (b_small, b_tiles) = rows(left, left_id), rows(right, right_id)

    def of(tiles: DataFrame) -> DataFrame:
        uncut = F.transform("sides", lambda e: F.struct(*(e[c].alias(c) for c in ("x1", "y1", "x2", "y2"))))
        return tiles.filter("size(sides) > 0").select("id", *_BOX, uncut.alias("sides"))

    def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
        return candidates(a, b, "id", "id").filter(G.edges_meet("a_sides", "b_sides")).select("a_id", "b_id")

    def corners(side: tuple[DataFrame, DataFrame | None], ident: str) -> DataFrame:
        made = [_corners(part, ident, geom) for part in side if part is not None]
        return made[0] if len(made) == 1 else made[0].union(made[1])

    def inside(dots: DataFrame, b: DataFrame) -> DataFrame:
        pairs = candidates(dots.withColumn("dot", F.struct("minx", "miny")), b, "id", "id")
        return outlines.holding(pairs, ["a_id", "a_dot", "b_id"]).select("a_id", "b_id")

    def in_small(dots: DataFrame, b: DataFrame) -> DataFrame:
        return (candidates(dots, b, "id", "id")
                .filter(G.contains_point("b_sides", "a_minx", "a_miny")).select("a_id", "b_id"))
    found = []
    turned = [F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")]
    if a_tiles is not None:
        found += [meeting(of(a_tiles), b_small), in_small(_corners(left[1], left_id, geom), b_small),
                  inside(corners(right, right_id), a_tiles).select(*turned)]
    if b_tiles is not None:
        found += [meeting(a_small, of(b_tiles)), inside(corners(left, left_id), b_tiles),
                  in_small(_corners(right[1], right_id, geom), a_small).select(*turned)]
    if a_tiles is not None and b_tiles is not None:
        found.append(meeting(of(a_tiles), of(b_tiles)))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def parcels_touching(areas: DataFrame, parcels: DataFrame, area_id: str = "area_id",
                     parcel_id: str = "gml_id", geom: str = "geom") -> DataFrame:
    """``(area_id, parcel_id)`` for every parcel sharing a point with a drawn area.

    Areas whose outer ring has fewer than three corners select nothing.
    """
    areas, parcels = _one_system(areas, parcels, geom, geom)
    drawn = outlines.split(areas.filter(f"size({geom}[0]) >= 4"), geom)
    known = outlines.split(parcels, geom)
    found = (candidates(_prepared(drawn[0], area_id, geom), _prepared(known[0], parcel_id, geom),
                        "id", "id")
             .filter(G.intersects("a_edges", "b_edges")).select("a_id", "b_id"))
    if drawn[1] is not None or known[1] is not None:
        found = found.union(_touching_large(drawn, known, area_id, parcel_id, geom))
    return found.selectExpr(f"a_id as {area_id}", f"b_id as {parcel_id}")


def _parts(df: DataFrame, ident: str, geom: str, keep: list[str] | None) -> DataFrame:
    """The polygon side of an overlay; large outlines as their tiles, which add up to them."""
    small, large = outlines.split(df, geom)
    rows = _prepared(small, ident, geom, keep=keep)
    if large is None:
        return rows
    tiles = outlines.tiles(large, ident, geom).select("id", *_BOX, "edges")
    if keep:
        tiles = tiles.join(large.selectExpr(f"{ident} as id", *keep), "id")
    return rows.unionByName(tiles.select(*rows.columns))


def _shared_areas(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Add up the shared area of every pair from its pairs of edges.

    The formula is that of ``geometry.overlap_area``. Written with generators instead
    of nested lambdas, the arithmetic per pair of edges is compiled code and three to
    four times as fast. The edge pairs of a pair of polygons follow one another in
    one task, so the map side already adds them up and a single row per pair of
    polygons is shuffled.
    """
    def useful(items: str) -> str:
        return (f"filter({items}, e -> e.x1 <> e.x2 and least(e.x1, e.x2) < right"
                " and greatest(e.x1, e.x2) > left)")

    edge_pairs = (
        pairs.selectExpr(*keys, "a_edges", "b_edges", "greatest(a_minx, b_minx) as left",
                         "least(a_maxx, b_maxx) as right", "least(a_miny, b_miny) as base")
        .selectExpr(*keys, "left", "base", f"{useful('a_edges')} as a", f"{useful('b_edges')} as b")
        .selectExpr(*keys, "left", "base", "a", "inline(b) as (u1, v1, u2, v2)")
        .selectExpr(*keys, "left", "base", "u1", "v1", "u2", "v2",
                    "inline(a) as (x1, y1, x2, y2)")
        .selectExpr(*keys, "if(x1 > x2, 1D, -1D) * if(u1 > u2, 1D, -1D) as s",
                    "greatest(least(x1, x2), least(u1, u2)) - left as lo",
                    "least(greatest(x1, x2), greatest(u1, u2)) - left as hi",
                    "x1 - left as x", "y1 - base as y", "(y2 - y1) / (x2 - x1) as m",
                    "u1 - left as u", "v1 - base as v", "(v2 - v1) / (u2 - u1) as k")
        .filter("hi > lo")
        .selectExpr(*keys, "s", "hi - lo as w", "y + m * (lo - x) as e0", "y + m * (hi - x) as e1",
                    "v + k * (lo - u) as f0", "v + k * (hi - u) as f1"))
    excess = ("case when e0 <= f0 and e1 <= f1 then 0D"
              " when e0 >= f0 and e1 >= f1 then e0 - f0 + e1 - f1"
              " else power(greatest(e0 - f0, e1 - f1), 2) / (abs(e0 - f0) + abs(e1 - f1)) end")
    return (edge_pairs.selectExpr(*keys, f"s * w * (e0 + e1 - {excess}) / 2D as part",
                                  "w * (abs(e0) + abs(e1) + abs(f0) + abs(f1)) as size")
            .groupBy(*keys).agg(F.sum("part").alias("shared"), F.sum("size").alias("size"),
                                F.count(F.lit(1)).alias("terms")))


def overlay(left: DataFrame, right: DataFrame, left_id: str, right_id: str, geom: str = "geom",
            keep_left: list[str] | None = None, keep_right: list[str] | None = None) -> DataFrame:
    """``(left_id, right_id, shared, *kept)`` for every pair of overlapping interiors.

    The ids must be unique on their side. Columns in ``keep_left`` and ``keep_right``
    travel with their rows, which saves joining them back by id. Boxes that only
    touch along a side cannot share an interior and skip the geometry.
    """
    left, right = _one_system(left, right, geom, geom)
    kept = [*[(f"a_{c}", c) for c in keep_left or []], *[(f"b_{c}", c) for c in keep_right or []]]
    pairs = (candidates(_parts(left, left_id, geom, keep_left),
                        _parts(right, right_id, geom, keep_right), "id", "id")
             .filter("a_minx < b_maxx and b_minx < a_maxx and a_miny < b_maxy and b_miny < a_maxy"))
    keys = ["a_id", "b_id", *[k for k, _ in kept]]
    return (_shared_areas(pairs, keys)
            .filter(G.interiors_overlap("shared", "size", "terms"))
            .selectExpr(f"a_id as {left_id}", f"b_id as {right_id}", "shared",
                        *[f"{k} as {c}" for k, c in kept]))
