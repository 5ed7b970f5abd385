"""Theme configuration: which objects a layer shows and at which scales.

Themes come from the caller (or a JSON file); the library holds none. Rules are SQL
predicates over the columns of the presentation objects, as in
``layer in ('a', 'b')`` or ``layer not like 'a%'``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of layer and their titles, bottom to top.
KINDS = ("area", "outline", "line", "point", "label")
TITLES = {"area": "Flächen", "outline": "Grenzen", "line": "Linien", "point": "Punkte",
          "label": "Beschriftungen"}

Scales = dict[str, tuple[float | None, float | None]]


@dataclass(frozen=True)
class SubLayer:
    """Part of a theme; ``scales`` overrides the theme's range of single kinds."""

    name: str
    rule: str
    scales: Scales = field(default_factory=dict)


@dataclass(frozen=True)
class Theme:
    """``scales`` maps a kind to (min, max) scale denominator, ``None`` being open;
    ``labels`` maps a style key to the text shown for it."""

    name: str
    scales: Scales
    sublayers: tuple[SubLayer, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)


def load_themes(text: str) -> list[Theme]:
    """Themes from JSON text: a list of objects with the fields of ``Theme``."""
    def scales(raw: dict | None) -> Scales:
        return {kind: tuple(bounds) for kind, bounds in (raw or {}).items()}
    return [Theme(t["name"], scales(t.get("scales")),
                  tuple(SubLayer(s["name"], s["rule"], scales(s.get("scales")))
                        for s in t.get("sublayers", ())), dict(t.get("labels", {})))
            for t in json.loads(text)]


def theme_table(spark: SparkSession, themes: list[Theme]) -> DataFrame:
    """``(theme, sublayer, kind, min_scale, max_scale)``, overrides applied."""
    rows = []
    for theme in themes:
        for sub in theme.sublayers or (SubLayer("", "true"),):
            for kind in KINDS:
                low, high = sub.scales.get(kind) or theme.scales.get(kind) or (None, None)
                rows.append((theme.name, sub.name, kind,
                             None if low is None else float(low),
                             None if high is None else float(high)))
    return spark.createDataFrame(
        rows, "theme string, sublayer string, kind string, min_scale double, max_scale double")


def class_table(spark: SparkSession, themes: list[Theme]) -> DataFrame:
    """``(theme, sn, class_label)`` of all themes."""
    rows = [(t.name, sn, label) for t in themes for sn, label in t.labels.items()]
    return spark.createDataFrame(rows, "theme string, sn string, class_label string")


def visible_at(layers: DataFrame, scale: float) -> DataFrame:
    """Layers whose range covers a scale denominator; a null bound is open."""
    return layers.filter((F.col("min_scale").isNull() | (F.col("min_scale") <= scale))
                         & (F.col("max_scale").isNull() | (F.lit(scale) <= F.col("max_scale"))))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sublayer(df: DataFrame, rule: str) -> DataFrame:
    """Rows that satisfy one sub-layer's rule."""
    return df.filter(F.expr(rule))


def assign_sublayer(df: DataFrame, themes: list[Theme]) -> DataFrame:
    """Route every object to the sub-layers of its theme, as column ``sublayer``.

    A row matching several rules comes out several times, one matching none drops
    out. Themes without sub-layers get the empty name. All rules are evaluated in a
    single pass over the objects.
    """
    tests = [f"if(thema = {_quoted(t.name)} and ({s.rule}), {_quoted(s.name)}, null)"
             for t in themes for s in (t.sublayers or (SubLayer("", "true"),))]
    if not tests:
        return df.withColumn("sublayer", F.lit("")).filter(F.lit(False))
    names = ", ".join(_quoted(t.name) for t in themes)
    return (df.filter(f"thema in ({names})")
            .withColumn("sublayer", F.explode(F.expr(f"array_compact(array({', '.join(tests)}))"))))
