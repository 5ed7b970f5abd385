"""Planar geometry as Spark SQL expressions.

Every function takes SQL expressions (most often a column name) as text and returns
SQL text for ``F.expr`` / ``selectExpr``. Text rather than Column objects because
the formulas are long: the JVM parses one string instead of receiving thousands of
calls, which cuts the time to build a plan from seconds to milliseconds. All of it
runs on built-in functions inside the JVM.

A polygon is an array of rings, a ring a closed array of ``struct<x,y>`` (first
vertex repeated at the end). Shells run counter-clockwise and holes clockwise;
``orient`` brings rings into that form, and a multi-part polygon is simply the
concatenation of its parts' rings.

The heavy functions work on *edges* (``array<struct<x1,y1,x2,y2>>``, see
``edges``). Joins carry the edges, so they are built once per feature and not once
per candidate pair.
"""

from __future__ import annotations

RINGS = "array<array<struct<x:double,y:double>>>"

# Rounding of one operation on doubles, and how many of them a summand of the shared
# area goes through at most.
ROUNDING, STEPS = 2.0**-53, 32


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` to ``name`` inside ``body``, so that it is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


# -- building ---------------------------------------------------------------

def box_rings(minx: str, miny: str, maxx: str, maxy: str) -> str:
    """The rings of an axis-parallel rectangle."""
    corners = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    ring = ", ".join(f"named_struct('x', cast({px} as double), 'y', cast({py} as double))"
                     for px, py in corners)
    return f"array(array({ring}))"


def ring_edges(ring: str) -> str:
    """Consecutive vertex pairs of one ring or line."""
    n = f"greatest(size({ring}) - 1, 0)"
    return (f"zip_with(slice({ring}, 1, {n}), slice({ring}, 2, {n}), (p, q) -> "
            "named_struct('x1', p.x, 'y1', p.y, 'x2', q.x, 'y2', q.y))")


def edges(rings: str) -> str:
    """All edges of a polygon (or of a multi-part line)."""
    return f"flatten(transform({rings}, er -> {ring_edges('er')}))"


def signed_ring_area(ring: str) -> str:
    """Shoelace area, positive for counter-clockwise rings.

    Coordinates are taken relative to the first vertex: with northings near six
    million the plain products would lose the last digits.
    """
    return (f"aggregate({ring_edges(ring)}, 0D, (acc, e) -> acc + "
            f"((e.x1 - {ring}[0].x) * (e.y2 - {ring}[0].y)"
            f" - (e.x2 - {ring}[0].x) * (e.y1 - {ring}[0].y)) / 2D)")


def orient(rings: str) -> str:
    """Shell first in: shell counter-clockwise, every other ring clockwise out."""
    return (f"transform({rings}, (orr, ori) -> if(({signed_ring_area('orr')} >= 0)"
            " = (ori = 0), orr, reverse(orr)))")


# -- measuring --------------------------------------------------------------

def area(rings: str) -> str:
    """Area of an oriented polygon (holes count negative)."""
    return f"aggregate({rings}, 0D, (total, ar) -> total + {signed_ring_area('ar')})"


def bbox(rings: str) -> str:
    """``struct<minx,miny,maxx,maxy>`` of all vertices."""
    sides = ", ".join(
        f"'{name}', array_{name[:3]}(transform(flatten({rings}), bv -> bv.{name[3]}))"
        for name in ("minx", "miny", "maxx", "maxy"))
    return f"named_struct({sides})"


def x(point: str) -> str:
    return f"{point}.x"


def y(point: str) -> str:
    return f"{point}.y"


# -- predicates -------------------------------------------------------------

# Share of the two products by which rounding can move their difference at most.
TURN_ERROR = (3 + 16 * ROUNDING) * ROUNDING


def _grid(a: str, b: str, c: str) -> str:
    """The power of two that turns three ordinates into whole numbers of up to 61 digits."""
    largest = f"greatest(abs({a}), abs({b}), abs({c}), 1e-30D)"
    return f"power(2D, 60 - greatest(-60, cast(floor(log2({largest})) as int)))"


def turn(e: str, px: str, py: str) -> str:
    """1 when (px, py) lies to the left of the directed edge, -1 to the right, 0 on its line.

    Decided in doubles where the difference of the products is beyond what rounding can
    make of it; else by whole numbers: the ordinates of an axis are scaled by a power of two
    and the products of their differences, of up to 126 binary digits, compared as decimals.
    That is exact if the digits of an axis' three ordinates span 61 places, as they do for
    any coordinates of at least a thousandth in size; where they don't, doubles decide.
    """
    left, right = f"({e}.x2 - {e}.x1) * ({py} - {e}.y1)", f"({px} - {e}.x1) * ({e}.y2 - {e}.y1)"
    bound = f"{TURN_ERROR!r}D * (abs({left}) + abs({right}))"

    def whole(value: str, grid: str) -> str:
        return f"cast({value} * {grid} as bigint)"

    def difference(one: str, two: str, grid: str) -> str:
        return f"cast({whole(one, grid)} - {whole(two, grid)} as decimal(20, 0))"

    fits = " and ".join(f"cast({whole(v, g)} as double) = {v} * {g}" for v, g in (
        (f"{e}.x1", "tgx"), (f"{e}.x2", "tgx"), (px, "tgx"),
        (f"{e}.y1", "tgy"), (f"{e}.y2", "tgy"), (py, "tgy")))
    one = f"{difference(f'{e}.x2', f'{e}.x1', 'tgx')} * {difference(py, f'{e}.y1', 'tgy')}"
    two = f"{difference(px, f'{e}.x1', 'tgx')} * {difference(f'{e}.y2', f'{e}.y1', 'tgy')}"
    exact = let("tgx", _grid(f"{e}.x1", f"{e}.x2", px), let("tgy", _grid(f"{e}.y1", f"{e}.y2", py), (
        f"if({fits}, cast(sign({one} - {two}) as int), cast(sign({left} - {right}) as int))")))
    return (f"(case when {left} - {right} > {bound} then 1 when {right} - {left} > {bound} then -1"
            f" else {exact} end)")


def on_boundary(edge_list: str, px: str, py: str) -> str:
    return (f"exists({edge_list}, be -> {py} between least(be.y1, be.y2) and greatest(be.y1, be.y2)"
            f" and {px} between least(be.x1, be.x2) and greatest(be.x1, be.x2)"
            f" and {turn('be', px, py)} = 0)")


def _crossings_odd(edge_list: str, px: str, py: str) -> str:
    """Even-odd rule for the ray to the right of the point."""
    return (f"(size(filter({edge_list}, ce -> (ce.y1 <= {py}) <> (ce.y2 <= {py})"
            f" and {turn('ce', px, py)} = if(ce.y1 < ce.y2, 1, -1))) % 2 = 1)")


def contains_point(edge_list: str, px: str, py: str) -> str:
    """Interior test; a point on the boundary is not contained."""
    return f"({_crossings_odd(edge_list, px, py)} and not {on_boundary(edge_list, px, py)})"


def covers_point(edge_list: str, px: str, py: str) -> str:
    """Interior or boundary."""
    return f"({_crossings_odd(edge_list, px, py)} or {on_boundary(edge_list, px, py)})"


def _edges_meet(e: str, f: str) -> str:
    def overlap(axis: str) -> str:
        return (f"greatest({e}.{axis}1, {e}.{axis}2) >= least({f}.{axis}1, {f}.{axis}2)"
                f" and least({e}.{axis}1, {e}.{axis}2) <= greatest({f}.{axis}1, {f}.{axis}2)")

    def apart(one: str, two: str) -> str:
        return (f"{turn(one, two + '.x1', two + '.y1')}"
                f" * {turn(one, two + '.x2', two + '.y2')} <= 0")
    return f"({overlap('x')} and {overlap('y')} and {apart(e, f)} and {apart(f, e)})"


def edges_meet(a: str, b: str) -> str:
    """Any edges of two lists share a point."""
    return f"exists({a}, ie -> exists({b}, jf -> {_edges_meet('ie', 'jf')}))"


def intersects(a: str, b: str) -> str:
    """Edge lists share at least one point (touching counts).

    When no edges meet, one polygon may still hold a part of the other: then the
    vertices of that part lie inside.
    """
    return (f"({edges_meet(a, b)} or exists({a}, ie -> {_crossings_odd(b, 'ie.x1', 'ie.y1')})"
            f" or exists({b}, jf -> {_crossings_odd(a, 'jf.x1', 'jf.y1')}))")


# -- overlay ----------------------------------------------------------------

def overlap_area(a: str, b: str) -> str:
    """Area shared by two oriented polygons given as edge lists.

    With all ordinates made non-negative, a polygon is the signed sum of the strips
    below its edges (plus for edges running right to left). The shared area is then
    the sum over edge pairs of the product of signs times the integral of the lower
    of the two edges over their common abscissae, which has a closed form. Concave
    shapes and holes need no special case and nothing is clipped. Edges outside the
    common x range are dropped first, so a small parcel against a very long outline
    costs little.
    """
    def span(items: str, axis: str, pick: str) -> str:
        return f"{pick}(transform({items}, se -> se.{axis}1))"

    frame = (f"named_struct('x0', greatest({span(a, 'x', 'array_min')}, {span(b, 'x', 'array_min')}),"
             f" 'x1', least({span(a, 'x', 'array_max')}, {span(b, 'x', 'array_max')}),"
             f" 'y0', least({span(a, 'y', 'array_min')}, {span(b, 'y', 'array_min')}))")

    def strips(items: str) -> str:
        useful = (f"filter({items}, te -> te.x1 != te.x2"
                  " and least(te.x1, te.x2) < box.x1 and greatest(te.x1, te.x2) > box.x0)")
        return (f"transform({useful}, te -> named_struct("
                "'l', least(te.x1, te.x2) - box.x0, 'r', greatest(te.x1, te.x2) - box.x0,"
                " 'h', if(te.x1 > te.x2, te.y2, te.y1) - box.y0,"
                " 'm', (te.y2 - te.y1) / (te.x2 - te.x1),"
                " 's', if(te.x1 > te.x2, 1D, -1D)))")

    # per edge pair: common range, both heights at its ends, area below the lower edge
    ends = ("named_struct('w', least(e.r, f.r) - greatest(e.l, f.l),"
            " 'e0', e.h + e.m * (greatest(e.l, f.l) - e.l), 'e1', e.h + e.m * (least(e.r, f.r) - e.l),"
            " 'f0', f.h + f.m * (greatest(e.l, f.l) - f.l), 'f1', f.h + f.m * (least(e.r, f.r) - f.l))")
    excess = ("case when v.e0 <= v.f0 and v.e1 <= v.f1 then 0D"
              " when v.e0 >= v.f0 and v.e1 >= v.f1 then v.e0 - v.f0 + v.e1 - v.f1"
              " else power(greatest(v.e0 - v.f0, v.e1 - v.f1), 2)"
              " / (abs(v.e0 - v.f0) + abs(v.e1 - v.f1)) end")
    below = let("v", ends, f"e.s * f.s * v.w * (v.e0 + v.e1 - {excess}) / 2D")
    pair = f"if(least(e.r, f.r) > greatest(e.l, f.l), {below}, 0D)"
    inner = f"aggregate(other, 0D, (si, f) -> si + {pair})"
    summed = let("other", strips(b), f"aggregate({strips(a)}, 0D, (so, e) -> so + {inner})")
    return let("box", frame, f"if(box.x1 > box.x0, {summed}, 0D)")


def interiors_overlap(shared: str, size: str, terms: str) -> str:
    """Whether a shared area is a real overlap and not a touching boundary.

    ``size`` is the sum of the summands' sizes before they cancel out and ``terms`` their
    number: what rounding can make of an area of zero is bounded by the two, whatever
    the size of the polygons. For parcels it is some hundredths of a square millimetre.
    """
    return f"({shared} > {size} * ({STEPS} + {terms}) * {ROUNDING!r}D)"


# -- lines ------------------------------------------------------------------

def offset_line(line: str, distance: str, mitre: float = 4.0) -> str:
    """Parallel line at ``distance`` to the left, corners mitred.

    Each vertex moves along the bisector of its neighbouring edges, by at most
    ``mitre`` times the distance, so a spike turns into a bevel-like corner.
    """
    def normal(p: str, q: str) -> str:
        dx, dy = f"({q}.x - {p}.x)", f"({q}.y - {p}.y)"
        length = f"sqrt({dx} * {dx} + {dy} * {dy})"
        return (f"named_struct('x', coalesce(try_divide(-{dy}, {length}), 0D),"
                f" 'y', coalesce(try_divide({dx}, {length}), 0D))")

    last = f"(size({line}) - 1)"
    into = normal(f"{line}[greatest(i - 1, 0)]", "p")
    out = normal("p", f"{line}[least(i + 1, {last})]")
    normals = f"named_struct('a', if(i = 0, {out}, {into}), 'b', if(i = {last}, {into}, {out}))"
    # |a + b|^2 / 2 is one plus the cosine of the turn: the inverse mitre factor
    spread = ("greatest((power(n.a.x + n.b.x, 2) + power(n.a.y + n.b.y, 2)) / 2D,"
              f" {1 / mitre!r}D)")
    moved = (f"named_struct('x', p.x + {distance} * (n.a.x + n.b.x) / {spread},"
             f" 'y', p.y + {distance} * (n.a.y + n.b.y) / {spread})")
    return f"transform({line}, (p, i) -> {let('n', normals, moved)})"


# -- text forms -------------------------------------------------------------

def _plain(value: str) -> str:
    """Shortest plain decimal notation, without exponent or trailing zeros."""
    return f"regexp_replace(cast(cast({value} as decimal(30,6)) as string), '[.]?0+$', '')"


def box_text(box: str) -> str:
    """``BOX(x y,x y)`` of an extent."""
    parts = ", ".join(_plain(f"{box}.{k}") for k in ("minx", "miny", "maxx", "maxy"))
    return f"format_string('BOX(%s %s,%s %s)', {parts})"


def parse_box(text: str) -> str:
    """The extent behind a ``BOX(x y,x y)`` text; null when it is not one."""
    number = "(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = f"^BOX[(]{number} {number},{number} {number}[)]$"
    parts = ", ".join(
        f"'{name}', try_cast(regexp_extract({text}, '{pattern}', {i}) as double)"
        for i, name in enumerate(("minx", "miny", "maxx", "maxy"), start=1))
    return f"if({text} rlike '{pattern}', named_struct({parts}), null)"


def wkt_point(px: str, py: str) -> str:
    """Well-known text of a point, three decimals."""
    return f"format_string('POINT(%.3f %.3f)', {px}, {py})"


def wkt_polygon(rings: str) -> str:
    """Well-known text of a single polygon, three decimals."""
    return (f"concat('POLYGON(', array_join(transform({rings}, wr -> concat('(', array_join("
            "transform(wr, wp -> format_string('%.3f %.3f', wp.x, wp.y)), ','), ')')), ','), ')')")


def from_wkt(text: str) -> str:
    """Rings or lines behind POINT, LINESTRING, POLYGON and their MULTI forms.

    Polygon rings come out oriented. A point is one part with one vertex. An SRID
    prefix is ignored; EMPTY gives an empty array.
    """
    bare = f"upper(trim(regexp_replace({text}, '(?i)^ *SRID=[0-9]+;', '')))"
    body = (f"regexp_replace(regexp_extract(wk.t, '^[A-Z]+ *(?:ZM|Z|M)? *([(].*[)])$', 1),"
            " ' *([(),]) *', '$1')")

    def vertices(part: str) -> str:
        return (f"transform(split(regexp_replace({part}, '[()]', ''), ','), wv -> named_struct("
                "'x', cast(split(trim(wv), ' +')[0] as double),"
                " 'y', cast(split(trim(wv), ' +')[1] as double)))")

    def rings_of(part: str) -> str:
        return f"transform(split({part}, '[)],[(]'), wg -> {vertices('wg')})"

    polygons = (f"flatten(transform(split(wb, '[)][)],[(][(]'), wq ->"
                f" {let('wo', rings_of('wq'), orient('wo'))}))")
    # a multipoint appears both with and without inner brackets
    points = f"transform(split(regexp_replace(wb, '[()]', ''), ','), wm -> {vertices('wm')})"
    kind = "regexp_extract(wk.t, '^([A-Z]+)', 1)"
    parsed = let("wb", body, (
        f"case when wb = '' then if(wk.t like '%EMPTY', cast(array() as {RINGS}), null)"
        f" when {kind} in ('POLYGON', 'MULTIPOLYGON') then {polygons}"
        f" when {kind} in ('POINT', 'MULTIPOINT') then {points}"
        f" when {kind} in ('LINESTRING', 'MULTILINESTRING') then {rings_of('wb')} end"))
    return let("wk", f"named_struct('t', {bare})", parsed)
