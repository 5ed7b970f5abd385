"""All drawing tables of a map in one job: objects, styles, manifest and order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.operators import layers as L
from parzelle.operators import styles as S
from parzelle.operators.themes import Theme, class_table, theme_table
from parzelle.session import materialize

Tables = Mapping[str, DataFrame]


def drawing_tables(tables: Tables, themes: list[Theme], models: Iterable[str] = (),
                   catalog_id: int = -1, extents: DataFrame | None = None,
                   negate_rotation: bool = True) -> dict[str, DataFrame]:
    """Everything a renderer needs, as tables keyed by layer.

    ``extract`` holds the objects; ``fill``, ``outline``, ``line`` and ``point`` the
    styles; ``outline_strokes`` and ``line_strokes`` their drawable parts;
    ``manifest`` the non-empty layers in drawing order. Line styles whose strokes do
    not fit together are left out.

    The objects are read twice: for the inventory, which is written out and feeds
    all style tables, and for the extract itself.
    """
    spark = tables["po_polygons"].sparkSession
    models = list(models)
    polygons, lines, points, labels = (tables[f"po_{k}"] for k in
                                       ("polygons", "lines", "points", "labels"))
    extract = L.layer_extract(themes, models, polygons, lines, points, labels, negate_rotation)
    classes = class_table(spark, themes)

    inventory = materialize(
        L.layer_inventory(themes, models, polygons, lines, points, labels), "inventory")

    def used(kind: str) -> DataFrame:
        return inventory.filter(f"kind = '{kind}' and sn is not null and sn <> ''") \
            .select("theme", "sublayer", "sn")

    strokes = S.line_strokes(tables["style_line"], tables["line_def"], tables["stroke_member"],
                             tables["stroke"], tables["color"], catalog_id)
    check = S.line_style_check(strokes)
    drawable = check.filter("same_length and same_indent").select("sn")
    if extents is None:
        extents = spark.createDataFrame(
            [], "sn string, minx double, miny double, maxx double, maxy double")

    fill = S.fill_styles(used("area"), tables["style_fill"], tables["color"],
                         classes, catalog_id)
    outline = S.outline_styles(used("outline"), tables["style_line"],
                               tables["line_def"], tables["color"], classes, catalog_id) \
        .join(drawable, "sn", "left_semi")
    line = S.line_styles(used("line"), tables["style_line"], tables["line_def"],
                         tables["color"], classes, catalog_id).join(drawable, "sn", "left_semi")
    point = S.point_styles(used("point"), tables["symbol"], extents, classes,
                           catalog_id)
    every = None
    for kind, table in (("area", fill), ("outline", outline), ("line", line),
                        ("point", point.withColumn("priority", F.lit(None).cast("int")))):
        part = table.select("theme", "sublayer", F.lit(kind).alias("kind"), "sn", "priority")
        every = part if every is None else every.unionByName(part)
    # a row per layer; kept, because numbering the layers needs it twice
    manifest = materialize(L.layer_manifest(inventory, theme_table(spark, themes), every),
                           "manifest")
    types = F.create_map(*[F.lit(v) for pair in L.TYPE_OF.items() for v in pair])
    ordered = L.draw_order(
        manifest.withColumn("type", F.element_at(types, F.col("kind")))
        .withColumn("place", F.struct("theme", "sublayer", "kind")), position="place").drop("place")
    return {"extract": extract, "fill": fill, "outline": outline, "line": line, "point": point,
            "outline_strokes": S.stroke_symbols(strokes, check, outline=True),
            "line_strokes": S.stroke_symbols(strokes, check), "check": check,
            "manifest": ordered}
