"""Label styles for the screen and for a map server."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.functions import geometry as G
from parzelle.operators.predicates import has_value, in_models, in_theme
from parzelle.operators.styles import of_catalog

# Points to map units, the measured factor between font size and letter
# height, metres per inch, default family.
POINT_UNIT, HEIGHT_FACTOR, INCH = 0.25, 1.3225, 0.0254
DEFAULT_FAMILY = "Arial"

# How the data says where a text stands, and the words for it on the screen
# (alignment, and where the text is placed) and on the server; the last row is any other.
ACROSS = (("linksbündig", "Left", "L"), ("rechtsbündig", "Right", "R"), (None, "Center", "C"))
UPRIGHT = (("oben", "Cap", "AL", "L"), ("Basis", "Base", "BL", "U"), (None, "Half", "OL", "C"))
# The words for font styles, and the server's ending for each style as a whole.
SLANTED, HEAVY = "Kursiv", "Fett"
STYLE_ENDINGS = {SLANTED: "italic", HEAVY: "bold", f"{HEAVY}, {SLANTED}": "bold-italic"}


def _words(value: Column, table, names: tuple[str, ...]) -> Column:
    """The row of a word table for a value, as a struct; its last row where none fits."""
    rows = {row[0]: F.struct(*(F.lit(w).alias(n) for w, n in zip(row[1:], names)))
            for row in table}
    known = F.create_map(*(c for word, row in rows.items() if word is not None
                           for c in (F.lit(word), row)))
    return F.coalesce(F.try_element_at(known, value), rows[None])


def _height(scale: Column) -> Column:
    """Height of a letter in map units."""
    return F.col("grad_pt") * scale * POINT_UNIT


def _with_font(labels: DataFrame, fonts: DataFrame, colors: DataFrame, catalog_id: int,
               how: str) -> DataFrame:
    """Labels with their font and colour, and how they stand (``across``, ``upright``)."""
    own, of_font = ("horizontaleausrichtung", "vertikaleausrichtung"), ("__across", "__upright")
    font = (of_catalog(fonts, catalog_id).withColumnsRenamed(dict(zip(own, of_font)))
            .select("signaturnummer", "farbe", "art", "stil", "effekt", "grad_pt", "sperrung_pt",
                    *of_font))
    tint = colors.select(F.col("id").alias("farbe"), "umn")
    rows = labels.join(font, "signaturnummer", how).join(tint, "farbe", how)
    across, upright = (F.coalesce(*pair) for pair in zip(own, of_font))
    return rows.withColumns({
        "across": _words(across, ACROSS, ("screen", "server")),
        "upright": _words(upright, UPRIGHT, ("screen", "place", "server"))})


def screen_labels(labels: DataFrame, fonts: DataFrame, colors: DataFrame, keep: list[str],
                  catalog_id: int = -1) -> DataFrame:
    """Text style columns of every label; labels without font or colour stay.

    A negative font size is an absolute size in points and is not forced to show.
    """
    rows = _with_font(labels, fonts, colors, catalog_id, "left")
    absolute = F.coalesce(F.col("grad_pt") < 0, F.lit(False))
    in_map = _height(F.coalesce("skalierung", F.lit(1))) * HEIGHT_FACTOR

    def says(word: str) -> Column:
        return F.coalesce(F.contains("stil", F.lit(word)), F.lit(False)).cast("int")

    size = F.when(absolute, -F.col("grad_pt")).otherwise(in_map)
    return rows.select(
        *keep, size.alias("tsize"), F.when(absolute, "Point").otherwise("MapUnit").alias("tunit"),
        F.when(absolute, 0).otherwise(1).alias("tshow"),
        F.col("across.screen").alias("halign"), F.col("upright.screen").alias("valign"),
        F.col("upright.place").alias("placement"), (0 - F.col("drehwinkel_grad")).alias("rotation"),
        F.coalesce("art", F.lit(DEFAULT_FAMILY)).alias("family"),
        says(SLANTED).alias("italic"), says(HEAVY).alias("bold"),
        F.coalesce(F.col("sperrung_pt") * POINT_UNIT, F.lit(0.0)).alias("spacing"),
        F.translate("umn", " ", ",").alias("tcolor"))


def server_labels(labels: DataFrame, fonts: DataFrame, colors: DataFrame, keep: list[str],
                  catalog_id: int = -1, line: str | None = None) -> DataFrame:
    """Label columns for a map server; labels without font or colour drop out.

    The font's name is its family and what is special about it, joined by hyphens. With
    ``line`` (a column of one line's vertices) the line is moved by half the text
    height and returned as ``geom``.
    """
    rows = _with_font(labels, fonts, colors, catalog_id, "inner")
    endings = F.create_map(*(F.lit(x) for pair in STYLE_ENDINGS.items() for x in pair))
    steps = F.bround(F.col("fontsperrung") / POINT_UNIT, 0).cast("int").cast("string")
    special = F.array(F.col("effekt"), F.try_element_at(endings, F.col("stil")),
                      F.when(F.col("fontsperrung") != 0, steps))
    font = F.concat(F.lower("art"), F.array_join(
        F.transform(F.array_compact(special), lambda x: F.concat(F.lit("-"), x)), ""))
    half = "(0.5D * grad_pt * skalierung * " + f"{POINT_UNIT}D)"
    moved = [F.expr(G.offset_line(line, half)).alias("geom")] if line else []
    return rows.select(
        *keep, F.col("umn").alias("color_umn"), font.alias("font_umn"),
        (_height(F.col("skalierung")) / INCH).alias("size_umn"),
        F.concat("upright.server", "across.server").alias("position_umn"), "drehwinkel_grad",
        *moved)


def placed_labels(labels: DataFrame, theme: str, models: Iterable[str], geometry: str) -> DataFrame:
    """The labels that a map layer draws: those of a theme and its models that have the
    geometry (``point`` or ``line``). Points come with ``x`` and ``y``."""
    rows = has_value(in_models(in_theme(labels, theme), models), geometry)
    if geometry != "point":
        return rows
    return rows.withColumns({c: F.expr(f"{at('point')}") for c, at in (("x", G.x), ("y", G.y))})


def label_hits(labels: DataFrame) -> DataFrame:
    """Count and extent of labels, by their point or else their line."""
    box = labels.selectExpr(f"{G.bbox('coalesce(point, line)')} as b")
    return box.agg(F.count(F.lit(1)).alias("n"), F.min("b.minx").alias("minx"),
                   F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"),
                   F.max("b.maxy").alias("maxy"))
