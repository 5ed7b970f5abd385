"""Selections: sets of parcel ids and their algebra."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.functions import numbers
from parzelle.operators.predicates import current

def select_parcels(parcels: DataFrame, ids: Iterable[str] | None = None,
                   where: str | None = None, subquery: DataFrame | None = None) -> DataFrame:
    """Current parcels by id list, by SQL predicate or by a DataFrame of ids.

    Exactly one of the three forms must be given. ``subquery`` contributes its
    first column.
    """
    if sum(v is not None for v in (ids, where, subquery)) != 1:
        raise ValueError("give exactly one of ids, where, subquery")
    df = current(parcels)
    if where is not None:
        return df.filter(F.expr(where))
    if ids is not None:
        subquery = df.sparkSession.createDataFrame(
            [(i,) for i in dict.fromkeys(ids)], "gml_id string")
    # distinct combines on the map side, so an id named very often is one row of the join
    return df.join(subquery.select(F.col(subquery.columns[0]).alias("gml_id")).distinct(),
                   "gml_id", "left_semi")


def _ids(df: DataFrame) -> DataFrame:
    return df.select("gml_id")


def selection_add(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """Ids in either set."""
    return _ids(kept).union(_ids(hits)).distinct()


def selection_remove(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """Ids kept so far without the hits."""
    return _ids(kept).distinct().join(_ids(hits).distinct(), "gml_id", "left_anti")


def selection_replace(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits, whatever was kept before."""
    return _ids(hits).distinct()


def selection_clear(kept: DataFrame) -> DataFrame:
    return _ids(kept).filter(F.lit(False))


def parcel_number_of(ids: DataFrame, fs: DataFrame) -> DataFrame:
    """Number of each id; null unless the id is well-formed and has exactly one.

    Grouping first keeps one row per id, so an id carried by very many rows neither
    inflates the join nor lands in one task.
    """
    single = (fs.groupBy(F.col("fs_obj").alias("gml_id"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("alb_key").alias("flsnr"))
              .filter("n = 1").drop("n"))
    return (ids.join(single, "gml_id", "left")
            .withColumn("flsnr", F.when(F.length("gml_id") == numbers.ID_LENGTH,
                                        F.col("flsnr"))))


def run_if_small(hits: DataFrame, threshold: int,
                 action: Callable[[DataFrame], DataFrame]) -> tuple[int, DataFrame | None]:
    """Run an expensive follow-up only when ``0 < hits < threshold``.

    Counting stops at the threshold. Returns the (bounded) count and the follow-up's
    result, or ``None`` when it was not run.
    """
    n = hits.limit(threshold).count()
    return n, action(hits) if 0 < n < threshold else None


def extent_of(parcels: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row ``minx, miny, maxx, maxy, n`` over all parcels or a set of ids.

    Ended parcels count too, as the extent is that of the selection as kept.
    """
    if ids is not None:
        parcels = parcels.join(_ids(ids).distinct(), "gml_id", "left_semi")
    return parcels.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                       F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
                       F.count(F.lit(1)).alias("n"))
