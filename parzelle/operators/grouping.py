"""Grouping rows into arrays without letting one group outgrow a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parzelle.session import materialize

CHUNK = 1_000


def with_position(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the place of every row among those of its keys, from 0.

    The rows are dealt by ranges of keys and order, so a key may fill many tasks; a place
    is the rows of the key in the tasks before plus the place in the own one. The dealt
    rows are written at once (a job runs), as the places depend on how they were dealt.
    """
    part = "__part"
    dealt = materialize(rows.repartitionByRange(*keys, *order)
                        .withColumn(part, F.spark_partition_id()), "dealt")
    before = (W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow))
    sizes = (dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__before", F.sum("__n").over(before) - F.col("__n")).drop("__n"))
    sizes = sizes.withColumnsRenamed({c: f"__s_{c}" for c in (*keys, part)})
    same = dealt[part] == F.col(f"__s_{part}")
    for k in keys:
        same &= dealt[k].eqNullSafe(F.col(f"__s_{k}"))
    own = F.row_number().over(W.partitionBy(*keys, part).orderBy(*order)) - 1
    return (dealt.withColumn("__own", own).join(sizes, same)
            .withColumn(name, F.col("__before") + F.col("__own")).select(*rows.columns, name))


def nest(rows: DataFrame, keys: list[str], order: list[str], values: list[str], name: str,
         chunk: int = CHUNK) -> DataFrame:
    """Fold rows into sorted arrays of structs: ``(*keys, chunk, name)``.

    Every key has one row for each ``chunk`` of its rows, numbered from 0 in their order,
    so the result has the same form for small and for very large keys and no array
    outgrows the bound.
    """
    item = F.struct("__position", *order, *[v for v in values if v not in order])
    placed = with_position(rows, keys, order, "__position")
    return (placed.groupBy(*keys, F.floor(F.col("__position") / chunk).cast("int").alias("chunk"))
            .agg(F.array_sort(F.collect_list(item)).alias(name)))


def with_group_count(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the number of rows sharing the keys (nulls equal each other).

    A count joined back, not a window: a window would pull the whole group into one
    task, the count combines on the map side and the join splits skewed keys.
    """
    sizes = rows.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]) \
        .agg(F.count(F.lit(1)).alias(name))
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(sizes[f"__g_{k}"])
    return rows.join(sizes, condition, "inner").drop(*[f"__g_{k}" for k in keys])
