"""Drawn layers: the objects behind each, what is in use, and their order."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parzelle.operators.predicates import in_models
from parzelle.operators.themes import TITLES, Theme, assign_sublayer

# Drawing order of layer types, bottom to top, the type of each kind,
# and the priority of labels.
TYPE_ORDER = ("raster", "polygon", "line", "point", "annotation")
TYPE_OF = {"area": "polygon", "outline": "polygon", "line": "line", "point": "point",
           "label": "point"}
LABEL_PRIORITY = 999


def model_inventory(tables: list[DataFrame], pre: DataFrame | None = None) -> DataFrame:
    """``(modell, n)`` over all presentation tables; a ready count is used if given.

    Order by ``n desc``.
    """
    if pre is not None:
        return pre.filter("modell is not null").select("modell", F.col("n").cast("bigint")
                                                       .alias("n"))
    tags = None
    for table in tables:
        part = table.select(F.explode("modell").alias("modell"))
        tags = part if tags is None else tags.unionByName(part)
    return (tags.filter("modell is not null").groupBy("modell")
            .agg(F.count(F.lit(1)).alias("n")))


def _routed(objects: DataFrame, themes: list[Theme], models: Iterable[str]) -> DataFrame:
    return assign_sublayer(in_models(objects, models), themes)


def _objects(themes: list[Theme], models: Iterable[str], polygons: DataFrame | None,
             lines: DataFrame | None, points: DataFrame | None, labels: DataFrame | None,
             negate_rotation: bool) -> DataFrame:
    """Objects of every layer with ``shown``: whether they are drawn at all.

    Each table is read once; a polygon serves both its area and its outline layer.
    """
    models = list(models)
    sign = "0 - " if negate_rotation else ""
    parts = []

    def kind(name: str, sn: str, shown: str) -> str:
        return f"'{name}', cast({sn} as string), {shown}"

    def add(table: DataFrame | None, kinds: list[str], rotation: str, geom: str) -> None:
        if table is None:
            return
        entries = f"stack({len(kinds)}, {', '.join(kinds)}) as (kind, sn, shown)"
        parts.append(_routed(table, themes, models).selectExpr(
            "thema as theme", "sublayer", entries, "ogc_fid", "gml_id", "layer",
            f"cast({rotation} as double) as rotation", f"{geom} as geom"))

    add(polygons, [kind("area", "sn_flaeche", "sn_flaeche is not null"),
                   kind("outline", "sn_randlinie", "polygon is not null")], "null", "polygon")
    add(lines, [kind("line", "signaturnummer", "line is not null")], "null", "line")
    add(points, [kind("point", "signaturnummer", "point is not null")],
        f"{sign}drehwinkel_grad", "point")
    add(labels, [kind("label", "signaturnummer", "point is not null or line is not null")],
        f"{sign}drehwinkel_grad", "coalesce(point, line)")
    return reduce(DataFrame.unionByName, parts)


def layer_extract(themes: list[Theme], models: Iterable[str] = (),
                  polygons: DataFrame | None = None, lines: DataFrame | None = None,
                  points: DataFrame | None = None, labels: DataFrame | None = None,
                  negate_rotation: bool = True) -> DataFrame:
    """Objects of every layer: theme, sub-layer, kind, ids, style key, rotation, geometry.

    Filled areas need a style key, all other kinds a geometry. On the screen angles
    turn the other way round, hence ``negate_rotation``. Write the result with
    ``partitionBy("theme", "kind")`` to let a layer be read alone.
    """
    found = _objects(themes, models, polygons, lines, points, labels, negate_rotation)
    return found.filter("shown").select("theme", "sublayer", "kind", "ogc_fid", "gml_id", "layer",
                                        "sn", "rotation", "geom")


def layer_inventory(themes: list[Theme], models: Iterable[str] = (),
                    polygons: DataFrame | None = None, lines: DataFrame | None = None,
                    points: DataFrame | None = None,
                    labels: DataFrame | None = None) -> DataFrame:
    """``(theme, sublayer, kind, sn, features)``: every style key in use and how many
    drawn objects carry it.

    One aggregation over all objects, combined on the map side. Its result is as
    small as layers times styles, and all style tables start from it.
    """
    found = _objects(themes, models, polygons, lines, points, labels, True)
    return (found.groupBy("theme", "sublayer", "kind", "sn")
            .agg(F.count_if("shown").alias("features")))


def layer_manifest(inventory: DataFrame, scales: DataFrame, styles: DataFrame) -> DataFrame:
    """One row per non-empty layer: features, classes, scale range, priority, title.

    ``styles`` holds ``(theme, sublayer, kind, sn, priority)`` of all usable styles.
    A layer exists when it has a usable style that one of its objects refers to;
    label layers exist as soon as they have a label.
    """
    keys = ["theme", "sublayer", "kind"]
    styled = styles.select(*keys, "sn", "priority").distinct() \
        .withColumn("usable", F.lit(1))
    layers = (inventory.join(styled, [*keys, "sn"], "left")
              .groupBy(*keys)
              .agg(F.sum("features").alias("features"),
                   F.count("usable").alias("classes"),
                   F.expr("cast(avg(priority) as int)").alias("zindex"),
                   F.min("priority").alias("min_priority"),
                   F.max("priority").alias("max_priority")))
    titles = F.create_map(*[F.lit(v) for pair in TITLES.items() for v in pair])
    return (layers.filter("if(kind = 'label', features > 0, classes > 0)")
            .join(scales, keys, "left")
            .withColumn("zindex", F.when(F.col("kind") == "label", F.lit(LABEL_PRIORITY))
                        .otherwise(F.col("zindex")))
            .withColumn("title", F.element_at(titles, F.col("kind")))
            .withColumn("group", F.when(F.col("sublayer") == "", F.col("theme"))
                        .otherwise(F.concat_ws(" / ", "theme", "sublayer"))))


def draw_order(layers: DataFrame, type_col: str = "type", z_col: str = "zindex",
               position: str = "position") -> DataFrame:
    """Add ``draw_index``: by type bottom up, then priority (absent is -1), then position.

    Layers are configuration, a few hundred at most. Even so they are numbered per
    type, and each type starts after the number of layers of the types below it.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col(type_col)) - 1
    ranked = layers.withColumn("__rank", rank.cast("int"))
    counts = ranked.agg(F.struct(*[
        F.count_if(F.col("__rank") < i).alias(f"t{i}") for i in range(len(TYPE_ORDER))])).scalar()
    order = Window.partitionBy("__rank").orderBy(
        F.coalesce(F.col(z_col), F.lit(-1)), F.col(position))
    starts = F.array(*[F.col(f"__counts.t{i}") for i in range(len(TYPE_ORDER))])
    return (ranked.withColumn("__counts", counts)
            .withColumn("draw_index", F.row_number().over(order) - 1
                        + F.get(starts, F.col("__rank")))
            .drop("__rank", "__counts"))
