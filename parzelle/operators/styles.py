"""Style tables: which drawing styles the objects of each layer need.

Objects reach this module as *usage*: distinct ``(theme, sublayer, sn)``, see
``usage``. That is one aggregation over the objects, combined on the map side; all
later joins run on tables of catalogue size. The style catalogues themselves are
ordinary join sides without a broadcast hint, the optimizer measures them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYER = ["theme", "sublayer"]

# Words of the catalogue for a cut-off line end and a pointed corner,
# the symbol that is never drawn, and the factor of the blank line under a line.
CUT_OFF, POINTED = "Abgeschnitten", "Spitz"
NO_SYMBOL = "6000"
BLANK_FACTOR = 1.01


def usage(objects: DataFrame, sn: str) -> DataFrame:
    """Distinct non-empty style keys per layer."""
    return (objects.select(F.col("thema").alias("theme"), "sublayer",
                           F.col(sn).cast("string").alias("sn"))
            .filter("sn is not null and sn <> ''").distinct())


def styles_in_use(catalog: DataFrame, features: DataFrame, catalog_key: str,
                  feature_key: str) -> DataFrame:
    """Catalogue rows that at least one feature refers to."""
    used = features.select(F.col(feature_key).alias(catalog_key)).distinct()
    return catalog.join(used, catalog_key, "left_semi").distinct()


def of_catalog(table: DataFrame, catalog_id: int) -> DataFrame:
    """Rows of one style catalogue; a negative id means no choice."""
    return table if catalog_id < 0 else table.filter(F.col("katalog") == catalog_id)


def with_color(styles: DataFrame, colors: DataFrame, how: str = "inner") -> DataFrame:
    """Add the columns of the colour table for ``farbe``."""
    return styles.join(colors.withColumnRenamed("id", "farbe"), "farbe", how)


def parse_color(text: Column) -> Column:
    """``struct<r,g,b>`` of ``"r g b"``; black when absent."""
    part = F.split(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("0 0 0")), " +")
    return F.struct(*[F.element_at(part, i).cast("int").alias(n)
                      for i, n in enumerate("rgb", start=1)])


def with_label(styles: DataFrame, classes: DataFrame, fallback: str | None = None) -> DataFrame:
    """Add ``label``: the theme's text for the style, else the catalogue's name
    column if given, else the key in brackets."""
    bracket = F.concat(F.lit("("), F.col("sn"), F.lit(")"))
    options = [F.col("class_label")] + ([F.col(fallback)] if fallback else []) + [bracket]
    return (styles.join(classes, ["theme", "sn"], "left")
            .withColumn("label", F.coalesce(*options)).drop("class_label"))


def _styled(used: DataFrame, styles: DataFrame, classes: DataFrame) -> DataFrame:
    """Join the styles onto their layers and finish colour and label."""
    rows = (used.join(styles.withColumn("sn", F.col("signaturnummer").cast("string")), "sn")
            .withColumn("color", parse_color(F.col("umn")))
            .select(*LAYER, "sn", "name", F.col("darstellungsprioritaet").alias("priority"),
                    "umn", F.col("color.r").alias("r"), F.col("color.g").alias("g"),
                    F.col("color.b").alias("b"))
            .distinct())
    return with_label(rows, classes, "name")


def fill_styles(used: DataFrame, style_fill: DataFrame, colors: DataFrame, classes: DataFrame,
                catalog_id: int = -1) -> DataFrame:
    """Fill colour, priority, name and label per layer; styles without colour drop out."""
    styles = with_color(of_catalog(style_fill, catalog_id), colors.select("id", "umn"))
    return _styled(used, styles, classes)


def _line_catalog(style_line: DataFrame, line_def: DataFrame, colors: DataFrame,
                  catalog_id: int, how: str) -> DataFrame:
    """Line styles with colour; with a chosen catalogue the colour is the definition's."""
    styles = of_catalog(style_line, catalog_id)
    if catalog_id >= 0:
        colored = of_catalog(line_def, catalog_id).select("signaturnummer", "farbe")
        styles = styles.drop("farbe").join(colored, "signaturnummer", how)
    return with_color(styles, colors.select("id", "umn"), how)


def outline_styles(used: DataFrame, style_line: DataFrame, line_def: DataFrame,
                   colors: DataFrame, classes: DataFrame, catalog_id: int = -1) -> DataFrame:
    """Outline styles per layer; a style without colour stays and is drawn black."""
    return _styled(used, _line_catalog(style_line, line_def, colors, catalog_id, "left"), classes)


def line_styles(used: DataFrame, style_line: DataFrame, line_def: DataFrame, colors: DataFrame,
                classes: DataFrame, catalog_id: int = -1) -> DataFrame:
    """Line styles per layer with their rendering pass (0 for the lowest priority)."""
    rows = _styled(used, _line_catalog(style_line, line_def, colors, catalog_id, "inner"), classes)
    return rendering_pass(rows)


def rendering_pass(styles: DataFrame) -> DataFrame:
    """Position of each style within its layer by priority, from 0.

    One window group is one layer's distinct styles, so at most the catalogue.
    """
    order = Window.partitionBy(*LAYER).orderBy(F.asc_nulls_last("priority"), "sn", "name")
    return styles.withColumn("pass", F.row_number().over(order) - 1)


def style_priority(styles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Classes, mean (cut to int), lowest and highest priority per layer."""
    return (styles.groupBy(*(keys or LAYER))
            .agg(F.count(F.lit(1)).alias("classes"),
                 F.expr("cast(avg(priority) as int)").alias("zindex"),
                 F.min("priority").alias("min_priority"),
                 F.max("priority").alias("max_priority")))


# -- strokes of line styles ---------------------------------------------------

def parse_gaps(text: Column) -> Column:
    """``{a,b}`` or a single number to doubles in map units (hundredths); null is none."""
    bare = F.translate(text.cast("string"), "{} ", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<double>")).otherwise(
        F.transform(F.split(bare, ","), lambda v: v.cast("double") / 100.0))


def line_strokes(style_line: DataFrame | None, line_def: DataFrame, stroke_member: DataFrame,
                 stroke: DataFrame, colors: DataFrame, catalog_id: int = -1) -> DataFrame:
    """All strokes of every line style, lengths in map units.

    With ``style_line`` the chain starts at the style and, without a chosen
    catalogue, takes its colour; with ``None`` it starts at the definition, and without a
    chosen catalogue the caller colours the line (``r, g, b`` are null). A definition
    without strokes is a solid line, absent numbers are 0; only a stroke whose colour is
    asked for and missing is left out.
    """
    chosen = of_catalog(line_def, catalog_id)
    if style_line is None:
        lines = chosen
    else:
        styles = of_catalog(style_line, catalog_id)
        if catalog_id < 0:
            lines = styles.select("signaturnummer", "farbe") \
                .join(chosen.drop("farbe"), "signaturnummer", "left")
        else:
            lines = styles.select("signaturnummer").join(chosen, "signaturnummer", "left")
    members = stroke_member.select(F.col("stricharten").alias("__set"),
                                   F.col("strichart").alias("__stroke"))
    parts = stroke.select(F.col("id").alias("__stroke"), "laenge", "einzug", "abstand")
    rows = (lines.join(members, lines["strichart"] == members["__set"], "left")
            .join(parts, "__stroke", "left"))
    if style_line is None and catalog_id < 0:
        rows = rows.withColumns({c: F.lit(None).cast("int") for c in "rgb"})
    else:
        rows = (with_color(rows, colors.select("id", "r", "g", "b"), "left")
                .filter("r is not null and g is not null and b is not null"))

    def metres(name: str) -> Column:
        return F.coalesce(F.col(name) / 100.0, F.lit(0.0)).alias(name)
    return rows.select(F.col("signaturnummer").cast("string").alias("sn"),
                       F.col("__stroke").alias("stroke"), "abschluss", "scheitel",
                       metres("strichstaerke"), metres("laenge"), metres("einzug"),
                       parse_gaps(F.col("abstand")).alias("gaps"), "r", "g", "b")


def pattern_length(length: str = "laenge", gaps: str = "gaps") -> Column:
    """Total of dash lengths and gaps of one stroke."""
    return F.expr(f"aggregate({gaps}, 0D, (acc, g) -> acc + {length} + g)")


def line_style_check(strokes: DataFrame) -> DataFrame:
    """Per style: do its strokes fit together, and the widest stroke.

    ``same_length``: all strokes repeat after the same length. ``same_indent``: all
    dashed strokes start at the same indent (``lead``, null without any). Equality is
    tested by minimum and maximum, which combine on the map side whatever the number
    of strokes of a style; a distinct count would not.
    """
    # projected first: the pattern length is then computed once per stroke
    rows = strokes.select("sn", "strichstaerke", F.round(pattern_length(), 9).alias("total"),
                          F.when(F.col("laenge") > 0, F.col("einzug")).alias("indent"))
    grouped = rows.groupBy("sn").agg(
        F.count(F.lit(1)).alias("strokes"), F.min("total").alias("total"),
        F.max("total").alias("__total"), F.min("indent").alias("lead"),
        F.max("indent").alias("__lead"), F.min("strichstaerke").alias("__thin"),
        F.max("strichstaerke").alias("__thick"))
    return grouped.selectExpr(
        "sn", "strokes", "total", "total = __total as same_length",
        "coalesce(lead = __lead, true) as same_indent", "lead",
        "if(__thick >= abs(__thin), __thick, __thin) as widest")


def stroke_symbols(strokes: DataFrame, check: DataFrame, outline: bool = False) -> DataFrame:
    """Drawable parts of every usable line style.

    A stroke with dashes is one simple line with its dash vector, a stroke without
    length but with gaps is one marker line per gap, each offset by the gaps before
    it. Negative widths are screen millimetres. Lines (not outlines) start with a
    blank line a little wider than the widest stroke.
    """
    usable = check.filter("same_length and same_indent").select("sn", "lead", "widest")
    rows = strokes.join(usable, "sn", "inner")
    start = ("case when coalesce(lead, 0) = 0 then einzug when einzug > lead then einzug - lead"
             f" else einzug + total - lead end")
    markers = f"""transform(gaps, (g, i) -> named_struct('shape', 'marker', 'part', i + 1,
        'dashes', cast(null as array<double>), 'interval', total,
        'offset', {start} + aggregate(slice(gaps, 1, i), 0D, (a, v) -> a + v)))"""
    simple = """array(named_struct('shape', 'line', 'part', 1,
        'dashes', if(size(gaps) > 0, flatten(transform(gaps, g -> array(laenge, g))), null),
        'interval', cast(null as double), 'offset', cast(null as double)))"""
    drawn = (rows.withColumn("total", pattern_length())
             .selectExpr("sn", "stroke", "abs(strichstaerke) as width",
                         "if(strichstaerke >= 0, 'map', 'millimetre') as unit",
                         f"if(abschluss = '{CUT_OFF}', 'flat', 'round') as cap",
                         f"if(scheitel = '{POINTED}', 'miter', 'round') as `join`", "r", "g", "b",
                         f"inline(if(size(gaps) > 0 and laenge = 0, {markers}, {simple}))"))
    if outline:
        return drawn
    blank = usable.selectExpr(
        "sn", "null as stroke", f"widest * {BLANK_FACTOR}D as width", "'map' as unit",
        "'flat' as cap", "'round' as `join`", "null as r", "null as g", "null as b",
        "'blank' as shape", "0 as part", "cast(null as array<double>) as dashes",
        "cast(null as double) as interval", "cast(null as double) as offset")
    return drawn.unionByName(blank)


# -- point symbols ------------------------------------------------------------

def symbol_geometry(used: DataFrame, symbols: DataFrame, extents: DataFrame,
                    catalog_id: int = -1) -> DataFrame:
    """Centre, size, anchor and offset of every used symbol.

    The catalogue's box comes first, then the given fallback extents, then a unit
    box around the origin. Without a chosen catalogue the first one is used.
    """
    boxes = of_catalog(symbols, max(1, catalog_id)).select(
        F.col("signaturnummer").cast("string").alias("sn"), "x0", "y0", "x1", "y1")
    backup = extents.select("sn", F.col("minx").alias("e0"), F.col("miny").alias("f0"),
                            F.col("maxx").alias("e1"), F.col("maxy").alias("f1"))
    return (used.join(boxes, "sn", "left").join(backup, "sn", "left")
            .withColumns({
                "cx": F.coalesce((F.col("x0") + F.col("x1")) / 2, (F.col("e0") + F.col("e1")) / 2,
                                 F.lit(0.0)),
                "cy": F.coalesce((F.col("y0") + F.col("y1")) / 2, (F.col("f0") + F.col("f1")) / 2,
                                 F.lit(0.0)),
                "width": F.coalesce(F.col("x1") - F.col("x0"), F.col("e1") - F.col("e0"),
                                    F.lit(1.0)),
                "height": F.coalesce(F.col("y1") - F.col("y0"), F.col("f1") - F.col("f0"),
                                     F.lit(1.0))})
            .select(*used.columns, "cx", "cy", "width", "height",
                    (0.5 + F.try_divide("cx", "width")).alias("anchor_x"),
                    (0.5 + F.try_divide("cy", "height")).alias("anchor_y"),
                    (F.lit(0.0) - F.col("cx")).alias("offset_x"),
                    (F.lit(0.0) - F.col("cy")).alias("offset_y")))


def point_styles(used: DataFrame, symbols: DataFrame, extents: DataFrame, classes: DataFrame,
                 catalog_id: int = -1) -> DataFrame:
    """Symbol geometry and label per layer."""
    return with_label(symbol_geometry(used, symbols, extents, catalog_id), classes)


def missing_symbols(used: DataFrame, available: DataFrame) -> DataFrame:
    """Used style keys without a symbol, apart from the one that is never drawn."""
    return (used.select("sn").filter(F.col("sn") != NO_SYMBOL).distinct()
            .join(available.select("sn"), "sn", "left_anti"))
