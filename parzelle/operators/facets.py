"""Facets of the parcel book: districts, sections, numerators, denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.functions import numbers, text
from parzelle.operators.predicates import facet_filter


def district_names(gema_shl: DataFrame, gem_shl: DataFrame) -> DataFrame:
    """``(gemashl, label)`` of every district, with its town when known."""
    return (gema_shl.join(gem_shl.select("gemshl", "gemname"), "gemshl", "left")
            .select("gemashl", text.district_display(
                F.col("gemarkung"), F.col("gemashl"), F.col("gemname")).alias("label")))


def with_district_name(flurst: DataFrame, gema_shl: DataFrame) -> DataFrame:
    """Parcel-book rows with ``gemarkung``; rows of unknown districts stay."""
    return flurst.join(gema_shl.select("gemashl", "gemarkung"), "gemashl", "left")


def used_districts(gema_shl: DataFrame, gem_shl: DataFrame, flurst: DataFrame,
                   **parts: str | None) -> DataFrame:
    """Districts that hold at least one parcel matching the chosen parts.

    The parcels are reduced to their districts first, which combines on the map side.
    """
    matching = facet_filter(flurst, **parts).select("gemashl").distinct()
    return (district_names(gema_shl, gem_shl)
            .join(matching, "gemashl", "left_semi").distinct())


def facet_values(flurst: DataFrame, gema_shl: DataFrame, gem_shl: DataFrame,
                 **parts: str | None) -> DataFrame:
    """``(facet, value, label, n)`` for all four facets, each under all chosen parts.

    One scan feeds the four lists: every row is turned into its four (facet, value)
    entries and these are counted, which combines on the map side before the only
    shuffle. ``n`` is the number of parcels behind the value.
    """
    entries = F.expr("stack(4, 'district', gemashl, 'section', flr, "
                     "'num', num, 'den', den) as (facet, value)")
    counted = (facet_filter(flurst, **parts)
               .select("gemashl", "flr", numbers.num(F.col("flsnrk")).alias("num"),
                       numbers.den(F.col("flsnrk")).alias("den"))
               .select(entries)
               .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))
    names = district_names(gema_shl, gem_shl).distinct() \
        .withColumnRenamed("gemashl", "value").withColumn("facet", F.lit("district"))
    # a district unknown to the catalogue is not offered
    return (counted.join(names, ["facet", "value"], "left")
            .filter("facet <> 'district' or label is not null")
            .select("facet", "value", F.coalesce("label", "value").alias("label"), "n"))


def facet_hits(flurst: DataFrame, threshold: int = 1000, **parts: str | None) -> DataFrame:
    """Number of parcels under the chosen parts and whether to run the selection."""
    return (facet_filter(flurst, **parts).agg(F.count(F.lit(1)).alias("hits"))
            .withColumn("run", (F.col("hits") > 0) & (F.col("hits") < threshold)))
