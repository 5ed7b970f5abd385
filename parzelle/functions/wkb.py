"""Well-known binary as Spark SQL expressions, in the style of ``geometry``.

Reads WKB and EWKB (with SRID) of every plain type, in either byte order, with or
without Z and M, which are left out: points, lines, polygons, triangles, their multi
forms, surfaces and collections nested to any depth. The nesting needs no stack:
the parts follow one another, and a count of geometries still due tells whether the
value is whole. Doubles are put together from their IEEE-754 fields by exact steps.
"""

from __future__ import annotations

from parzelle.functions.geometry import RINGS, let, signed_ring_area

# Type codes and the flag bits of the extended form.
POINT, LINE, POLYGON, TRIANGLE = 1, 2, 3, 17
CONTAINERS = (4, 5, 6, 7, 15, 16)
FLAG_Z, FLAG_M, FLAG_SRID = 0x80000000, 0x40000000, 0x20000000
# The kinds of a part; a ring is the first of its polygon or a later one.
DOT, PATH, SHELL, HOLE = 1, 2, 3, 4

_PART = "struct<at:bigint,n:bigint,big:boolean,dims:int,kind:int>"


def _swapped(digits: str) -> str:
    """Hex digits of the same bytes in reverse order."""
    return f"reverse(regexp_replace({digits}, '(.)(.)', '$2$1'))"


def _bytes(at: str, length: int, big: str) -> str:
    """Hex digits of a value, most significant byte first.

    Binary slices cost their own length only; the reversed copy serves the other order.
    """
    start = f"cast(if({big}, {at}, wv.n - ({at}) - {length}) as int) + 1"
    return f"hex(substring(if({big}, wv.b, wv.r), {start}, {length}))"


def _number(digits: str) -> str:
    return f"cast(conv({digits}, 16, 10) as bigint)"


def _integer(at: str, big: str) -> str:
    """The unsigned integer at a place; null beyond the end."""
    return f"if({at} + 4 <= wv.n, {_number(_bytes(at, 4, big))}, null)"


def _double(at: str, big: str) -> str:
    fields = (f"named_struct('hi', {_number('substr(wd, 1, 8)')},"
              f" 'lo', {_number('substr(wd, 9, 8)')})")
    parts = ("named_struct('s', if(wf.hi >= 2147483648, -1D, 1D),"
             " 'e', cast(shiftright(wf.hi, 20) & 2047 as int),"
             " 'm', (wf.hi & 1048575) * 4294967296 + wf.lo)")
    # a power of two and its product with a mantissa are exact
    value = ("case when wi.e = 2047 then wi.s * if(wi.m = 0, double('Infinity'), double('NaN'))"
             " when wi.e = 0 then wi.s * wi.m * power(2D, -1074)"
             " else wi.s * (wi.m + 4503599627370496) * power(2D, wi.e - 1075) end")
    return let("wd", _bytes(at, 8, big), let("wf", fields, let("wi", parts, value)))


def _state(at: str, due: str, rings: str, big: str, dims: str, kind: str, ok: str, parts: str) -> str:
    return (f"named_struct('at', {at}, 'due', {due}, 'rings', {rings}, 'big', {big}, 'dims', {dims},"
            f" 'kind', {kind}, 'ok', coalesce({ok}, false), 'parts', {parts})")


def _part(at: str, n: str, big: str, dims: str, kind: str) -> str:
    return f"named_struct('at', {at}, 'n', {n}, 'big', {big}, 'dims', {dims}, 'kind', {kind})"


def _ring_step() -> str:
    """The next ring of the polygon at hand."""
    stop = "ws.at + 4 + 8 * ws.dims * wc"
    part = _part("ws.at + 4", "wc", "ws.big", "ws.dims", "ws.kind")
    good = _state(stop, "ws.due", "ws.rings - 1", "ws.big", "ws.dims", str(HOLE), f"{stop} <= wv.n",
                  f"concat(ws.parts, array({part}))")
    return let("wc", _integer("ws.at", "ws.big"), f"if(wc is null, {_failed()}, {good})")


def _failed() -> str:
    return _state("ws.at", "ws.due", "ws.rings", "ws.big", "ws.dims", "ws.kind", "false", "ws.parts")


def _header_step() -> str:
    """The next header, with the vertices that follow it directly."""
    order = "hex(substring(wv.b, cast(ws.at as int) + 1, 1))"
    code = let("wg", f"{order} = '00'", f"named_struct('big', wg, 't', {_integer('ws.at + 1', 'wg')})")
    iso = "((wh.t & 268435455) div 1000)"
    head = (f"named_struct('big', wh.big, 'kind', cast((wh.t & 268435455) % 1000 as int),"
            f" 'dims', 2 + if((wh.t & {FLAG_Z}) <> 0 or {iso} in (1, 3), 1, 0)"
            f" + if((wh.t & {FLAG_M}) <> 0 or {iso} in (2, 3), 1, 0),"
            f" 'known', {iso} <= 3, 'at', ws.at + 5 + if((wh.t & {FLAG_SRID}) <> 0, 4, 0))")
    stop = "wk.at + 8 * wk.dims"
    dot = _state(stop, "ws.due - 1", "0L", "wk.big", "wk.dims", str(DOT), f"{stop} <= wv.n",
                 f"concat(ws.parts, array({_part('wk.at', '1L', 'wk.big', 'wk.dims', str(DOT))}))")
    stop = "wk.at + 4 + 8 * wk.dims * wc"
    path = _state(stop, "ws.due - 1", "0L", "wk.big", "wk.dims", str(PATH), f"{stop} <= wv.n",
                  f"concat(ws.parts, array({_part('wk.at + 4', 'wc', 'wk.big', 'wk.dims', str(PATH))}))")
    polygon = _state("wk.at + 4", "ws.due - 1", "wc", "wk.big", "wk.dims", str(SHELL), "true", "ws.parts")
    several = _state("wk.at + 4", "ws.due - 1 + wc", "0L", "wk.big", "wk.dims", str(PATH), "true",
                     "ws.parts")
    counted = let("wc", _integer("wk.at", "wk.big"),
                  f"case when wc is null then {_failed()} when wk.kind = {LINE} then {path}"
                  f" when wk.kind in ({POLYGON}, {TRIANGLE}) then {polygon}"
                  f" when wk.kind in {CONTAINERS} then {several} else {_failed()} end")
    read = let("wh", code, f"if(wh.t is null, {_failed()}, "
               + let("wk", head, f"case when not wk.known then {_failed()}"
                                 f" when wk.kind = {POINT} then {dot} else {counted} end") + ")")
    return f"if(ws.due > 0 and {order} in ('00', '01'), {read}, {_failed()})"


def from_wkb(value: str) -> str:
    """Rings or lines behind a binary value, as ``geometry.from_wkt`` gives them.

    Polygon rings come out oriented. A point is one part with one vertex; empty
    geometries have no parts. Null, cut or overlong values, unknown types and curves
    give null. A column of hex digits is passed as ``unhex(column)``.
    """
    # every step takes up at least four bytes
    begun = _state("0L", "1L", "0L", "false", "2", str(PATH), "true", f"cast(array() as array<{_PART}>)")
    # checked in this order: a ring may be missing at the end
    step = (f"case when not ws.ok or (ws.at = wv.n and ws.rings = 0) then ws"
            f" when ws.rings > 0 then {_ring_step()} else {_header_step()} end")
    read = f"aggregate(sequence(0, wv.n div 4), {begun}, (ws, wn) -> {step})"
    at = "wp.at + 8 * wp.dims * wj"
    vertex = (f"named_struct('x', {_double(f'({at})', 'wp.big')},"
              f" 'y', {_double(f'({at} + 8)', 'wp.big')})")
    ring = f"transform(sequence(0L, wp.n - 1), wj -> {vertex})"
    turned = let("wr", ring, f"if(wp.kind < {SHELL} or ({signed_ring_area('wr')} >= 0)"
                             f" = (wp.kind = {SHELL}), wr, reverse(wr))")
    rings = (f"filter(transform(filter(wt.parts, wp -> wp.n > 0), wp -> {turned}),"
             " wq -> size(wq) > 1 or not isnan(wq[0].x))")
    whole = "wt.ok and wt.due = 0 and wt.rings = 0 and wt.at = wv.n"
    parsed = let("wt", read, f"if({whole}, {rings}, cast(null as {RINGS}))")
    both = let("wb", value, f"named_struct('b', wb, 'r', unhex({_swapped('hex(wb)')}),"
                            " 'n', cast(octet_length(wb) as bigint))")
    return let("wv", both, f"if(wv.b is null, cast(null as {RINGS}), {parsed})")


def wkb_srid(value: str) -> str:
    """The SRID of an EWKB value; null where it carries none."""
    both = let("wb", value, f"named_struct('b', wb, 'r', unhex({_swapped('hex(substring(wb, 1, 9))')}),"
                            " 'n', least(cast(octet_length(wb) as bigint), 9L))")
    big = "hex(substring(wv.b, 1, 1)) = '00'"
    return let("wv", both, f"if(({_integer('1L', big)} & {FLAG_SRID}) <> 0,"
                           f" cast({_integer('5L', big)} as int), null)")


# -- writing ------------------------------------------------------------------

def _double_digits(value: str) -> str:
    """The sixteen hex digits of a double, most significant byte first."""
    guess = "floor(log2(wa))"
    exponent = (f"cast(case when power(2D, {guess}) > wa then {guess} - 1"
                f" when power(2D, {guess} + 1) <= wa then {guess} + 1 else {guess} end as int)")
    # shifted in two steps: a single power may be too large
    mantissa = ("cast(wa * power(2D, least(52 - we, 1000)) * power(2D, greatest(-948 - we, 0)) as bigint)"
                " - 4503599627370496")
    tiny = "cast(wa * power(2D, 537) * power(2D, 537) as bigint)"
    bits = (f"case when wa = double('Infinity') then named_struct('e', 2047, 'm', 0L)"
            f" when wa < power(2D, -1022) then named_struct('e', 0, 'm', {tiny})"
            f" else {let('we', exponent, f'named_struct({chr(39)}e{chr(39)}, we + 1023, {chr(39)}m{chr(39)}, {mantissa})')} end")
    hi = "wz.e * 1048576L + shiftright(wz.m, 32) + if(wx < 0, 2147483648L, 0L)"
    digits = let("wa", "abs(wx)", let("wz", bits, f"concat(lpad(hex({hi}), 8, '0'),"
                                                  " lpad(hex(wz.m & 4294967295), 8, '0'))"))
    return let("wx", value, f"if(isnan(wx), '7FF8000000000000', {digits})")


def to_wkb(rings: str, srid: str | None = None, big: bool = False) -> str:
    """EWKB of a single polygon; ``srid`` is an expression, without it plain WKB.

    A null polygon or coordinate gives null.
    """
    def number(digits: str) -> str:
        return digits if big else _swapped(digits)

    def integer(value: str) -> str:
        return number(f"lpad(hex({value}), 8, '0')")

    vertex = f"concat({number(_double_digits('wp.x'))}, {number(_double_digits('wp.y'))})"
    # a join would leave nulls out without a trace
    ring = (f"concat({integer('size(wr)')}, if(exists(wr, wp -> wp.x is null or wp.y is null), null,"
            f" array_join(transform(wr, wp -> {vertex}), '')))")
    head = [f"'{'00' if big else '01'}'", integer(f"{POLYGON | (FLAG_SRID if srid else 0)}L")]
    if srid:
        head.append(integer(f"cast({srid} as bigint)"))
    bodies = let("wo", f"transform({rings}, wr -> {ring})",
                 "if(exists(wo, wq -> wq is null), null, array_join(wo, ''))")
    return f"unhex(concat({', '.join(head)}, {integer(f'size({rings})')}, {bodies}))"
