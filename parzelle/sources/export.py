"""Exports: key messages for a register program and rendered reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parcel_messages(parcels: DataFrame, order_by: list[str], prefix: str,
                    number: str = "flsnr") -> DataFrame:
    """``prefix#number#flag#`` per parcel; flag 0 on the last one by order, else 1.

    ``order_by`` must identify a row. The last row is found as the largest key, an
    aggregate that combines on the map side, where a window over everything would
    run in a single task. Write with ``orderBy(order_by)``.
    """
    key = F.struct(*order_by)
    last = parcels.agg(F.max(key)).scalar()
    flag = F.when(F.col("__key") == F.col("__last"), F.lit(0)).otherwise(F.lit(1))
    return (parcels.select(*dict.fromkeys([*order_by, number]), key.alias("__key"))
            .withColumn("__last", last)
            .withColumn("message", F.format_string(f"{prefix}#%s#%d#", F.col(number), flag))
            .drop("__key", "__last"))


def single_message(parcels: DataFrame, prefix: str, number: str = "flsnr") -> DataFrame:
    """``prefix#number#`` for parcels handed over one at a time."""
    return parcels.withColumn("message", F.format_string(f"{prefix}#%s#", F.col(number)))


def write_messages(messages: DataFrame, path: str, order_by: list[str]) -> None:
    """Text files whose lines are in order, within each file and from file to file."""
    messages.orderBy(*order_by).select("message").write.mode("overwrite").text(path)


def write_reports(lines: DataFrame, path: str, order_by: list[str], fmt: str = "text",
                  district: str = "gemashl", value: str = "html") -> None:
    """Report lines, in order, in one folder per district.

    Lines are placed by range over the whole order, so a parcel with very many
    lines spreads over several files instead of filling one task.
    """
    keys = [district, *order_by]
    placed = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = placed.select(district, *([value] if fmt == "text" else
                                       [c for c in lines.columns if c != district]))
    writer.write.mode("overwrite").partitionBy(district).format(fmt).save(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
