"""Audit: owner data is released only after the request has been recorded.

A record may need many rows, which no sink appends all at once. So it is made in two
steps: the rows of an attempt are appended and read back, then one row in a second log
(the name of the first with ``_commits``) commits the attempt and is read back, too. What
a failed attempt leaves behind has no such row; ``recorded`` doesn't show it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parzelle.session import materialize
from parzelle.sources.tables import _is_missing

# Parcel numbers per audit row; a larger result is recorded in several rows.
NUMBERS_PER_ROW = 1000
COMMIT = "request_id long, attempt string, parts int"


class ReleaseRefused(RuntimeError):
    """The request could not be recorded, so its result must not be shown."""


@dataclass(frozen=True)
class _Log:
    """A table that rows are appended to: files at a path, or a database's."""

    spark: SparkSession
    path: str
    fmt: str
    options: Mapping[str, str]

    def commits(self) -> _Log:
        if self.fmt == "jdbc":
            return replace(self, options={**self.options, "dbtable": self.options["dbtable"] + "_commits"})
        return replace(self, path=self.path.rstrip("/") + "_commits")

    def append(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append").format(self.fmt).options(**self.options)
        writer.option("url" if self.fmt == "jdbc" else "path", self.path).save()

    def read(self) -> DataFrame | None:
        """What it holds; ``None`` before its first row."""
        reader = self.spark.read.format(self.fmt).options(**self.options)
        try:
            return reader.option("url" if self.fmt == "jdbc" else "path", self.path).load()
        except Exception as error:
            if not _is_missing(error):
                raise
            return None

    def count(self, request: int, attempt: str | None = None) -> int:
        found = self.read()
        if found is None:
            return 0
        mine = found.filter(F.col("request_id") == request)
        return (mine if attempt is None else mine.filter(F.col("attempt") == attempt)).count()


def recorded(spark: SparkSession, log_path: str, fmt: str = "parquet",
             options: Mapping[str, str] | None = None) -> DataFrame | None:
    """The rows of committed requests, each request once; ``None`` without any."""
    log = _Log(spark, log_path, fmt, options or {})
    rows, commits = log.read(), log.commits().read()
    if rows is None or commits is None:
        return None
    # two callers may have committed the same request at once: the first attempt stands
    first = commits.groupBy("request_id").agg(F.min("attempt").alias("attempt"))
    return rows.join(first, ["request_id", "attempt"], "left_semi")


def release_with_audit(result: DataFrame, log_path: str | None, user: str, request_type: str,
                       search: str, case_no: str | None = None, case_required: bool = False,
                       number: str = "flsnr", fmt: str = "parquet",
                       options: Mapping[str, str] | None = None,
                       request: str | None = None) -> DataFrame:
    """Record the request with all parcel numbers found, then hand out the result.

    ``log_path`` of ``None`` means that logging is not set up: the result is released
    as it is. If the case number is required but missing, or the record cannot be
    written, ``ReleaseRefused`` is raised and nothing is handed out.

    The result is written out first, so that exactly the recorded rows are handed
    out even when the tables change in between. The record holds the distinct
    numbers in sorted arrays of about a thousand; all rows of one request share
    ``request_id`` and say how many ``parts`` there are. An empty result is recorded
    with one empty array.

    ``request`` names the request. A call that repeats a committed one releases
    its result without a second record, if it is the same result, and is refused if it
    is another; without a name every call is a request of its own.

    For a database log give ``fmt="jdbc"``, the URL as ``log_path`` and ``dbtable``
    with the credentials in ``options``.
    """
    if log_path is None:
        return result
    if case_required and not case_no:
        raise ReleaseRefused("a case number is required")
    spark = result.sparkSession
    log = _Log(spark, log_path, fmt, options or {})
    fixed = materialize(result, "released")
    distinct = fixed.select(F.col(number).alias("n")).distinct()
    size = distinct.count()
    parts = max(1, math.ceil(size / NUMBERS_PER_ROW))
    attempt = uuid.uuid4().hex
    key = spark.range(1).select(F.xxhash64(F.lit(request or attempt))).first()[0]
    lists = (distinct.groupBy(F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int").alias("part"))
             .agg(F.array_sort(F.collect_list("n")).alias("result")))
    # every part gets its row, also when no number fell into it
    entry = spark.range(parts).select(
        F.current_timestamp().alias("datum"), F.lit(user).alias("username"),
        F.lit(request_type).alias("requestType"), F.lit(search).alias("search"),
        F.lit(case_no).cast("string").alias("aktenzeichen"), F.expr("cast(id as int)").alias("part"),
        F.lit(parts).alias("parts"))
    rows = (entry.join(lists, "part", "left")
            .withColumn("result", F.coalesce("result", F.array().cast("array<string>")))
            .withColumn("request_id", F.lit(key)).withColumn("attempt", F.lit(attempt))
            .select("datum", "username", "requestType", "search", "result", "aktenzeichen",
                    "request_id", "part", "parts", "attempt"))
    try:
        if request and log.commits().count(key):
            _same_result(recorded(spark, log_path, fmt, options), key, distinct)
            return fixed
        log.append(rows)
        if log.count(key, attempt) != parts:
            raise ReleaseRefused("the record is incomplete")
        log.commits().append(spark.createDataFrame([(key, attempt, parts)], COMMIT))
        if log.commits().count(key, attempt) != 1:
            raise ReleaseRefused("the record was not committed")
    except ReleaseRefused:
        raise
    except Exception as error:
        raise ReleaseRefused("the request could not be recorded") from error
    return fixed


def _same_result(log: DataFrame, request: int, numbers: DataFrame) -> None:
    """Refuse a repeated request that would release other numbers than are recorded."""
    known = log.filter(F.col("request_id") == request).select(F.explode("result").alias("n"))
    sides = (known.select("n", F.lit(1).alias("k"), F.lit(0).alias("f"))
             .union(numbers.select("n", F.lit(0), F.lit(1))))
    if not sides.groupBy("n").agg(F.max("k").alias("k"), F.max("f").alias("f")).filter("k <> f").isEmpty():
        raise ReleaseRefused("the request is recorded with another result")
