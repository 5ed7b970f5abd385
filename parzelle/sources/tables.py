"""Reading the cadastral tables and their metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from parzelle.functions import geometry, text, wkb

# SRIDs above this are private and described in the data itself, the
# format of the import dates, and the style catalogue offered without a table.
PRIVATE_SRID = 100_000
IMPORT_DATE = "yyyy-MM-dd'T'HH:mm:ssX"
DEFAULT_CATALOG = (-1, "Farbe")
BOX = ("minx", "miny", "maxx", "maxy")


@dataclass(frozen=True)
class Source:
    """Where tables live.

    ``kind`` is ``parquet``, ``orc`` or another file format (``location`` is a folder
    holding ``name`` or ``name.parquet``), ``catalog`` (``location`` is a database of
    the session catalog) or ``jdbc`` (``location`` is the URL, ``schema`` the database
    schema). ``names`` maps logical table names to physical ones, ``columns``
    renames columns per logical table, ``queries`` replaces a table by a query (JDBC),
    ``options`` are passed to the reader, ``table_options`` per table: for JDBC give
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` there,
    or the table is read by a single task.
    """

    kind: str
    location: str
    schema: str | None = None
    names: Mapping[str, str] = field(default_factory=dict)
    columns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    queries: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)
    table_options: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def _read(spark: SparkSession, source: Source, name: str) -> DataFrame:
    physical = source.names.get(name, name)
    if source.kind == "catalog":
        return spark.table(f"{source.location}.{physical}")
    options = {**source.options, **source.table_options.get(name, {})}
    if source.kind == "jdbc":
        table = f"{source.schema}.{physical}" if source.schema else physical
        query = source.queries.get(name)
        options |= {"url": source.location,
                    "dbtable": f"({query}) as {physical}" if query else table}
        return spark.read.format("jdbc").options(**options).load()
    reader = spark.read.format(source.kind).options(**options)
    folder = source.location.rstrip("/")
    suffix = f".{source.kind}"
    try:
        return reader.load(f"{folder}/{physical}{suffix}")
    except Exception as error:
        if not _is_missing(error):
            raise
        return reader.load(f"{folder}/{physical}")


# How Spark and database drivers report a table that is absent or that
# the user may not read. Any other failure (no connection, say) is passed on.
ABSENT_CONDITIONS = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")
ABSENT_MESSAGES = ("does not exist", "permission denied for")


def _is_missing(error: Exception) -> bool:
    """Whether a reader failed because the table isn't there or may not be read."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    return condition.startswith(ABSENT_CONDITIONS) or any(
        m in str(error) for m in ABSENT_MESSAGES)


def read_tables(spark: SparkSession, source: Source, names: Iterable[str],
                required: Iterable[str] = ()) -> dict[str, DataFrame]:
    """The tables that exist, by logical name; a missing required one is an error.

    Nothing is loaded here: filters and column choices made later reach the scan.
    """
    tables = {}
    needed = set(required)
    for name in [*names, *(n for n in needed if n not in set(names))]:
        try:
            df = _read(spark, source, name)
        except Exception as error:
            if name in needed or not _is_missing(error):
                raise
            continue
        tables[name] = df.withColumnsRenamed(dict(source.columns.get(name, {})))
    return tables


def has_columns(df: DataFrame, *columns: str) -> bool:
    present = {c.lower() for c in df.columns}
    return all(c.lower() in present for c in columns)


def optional(tables: Mapping[str, DataFrame], *names: str) -> list[DataFrame] | None:
    """All the named tables, or ``None`` if any of them is absent."""
    if any(n not in tables for n in names):
        return None
    return [tables[n] for n in names]


def with_default(df: DataFrame, column: str, value: str = "") -> DataFrame:
    """Add a column with a default where the data lacks it."""
    return df if has_columns(df, column) else df.withColumn(column, F.lit(value))


def with_geometry(df: DataFrame, column: str, geom: str = "geom", srid: str = "srid") -> DataFrame:
    """Parse a geometry column as databases give it: add ``geom``, ``srid`` and the box columns.

    A binary column is WKB or EWKB; a text column holds, row by row, the hex digits of
    such a value or well-known text with or without ``SRID=n;``. Values that can't be
    parsed give null. The SRID is null where the value names none. The source column
    goes; columns of the new names are replaced.
    """
    if isinstance(df.schema[column].dataType, BinaryType):
        rings, code = wkb.from_wkb(f"`{column}`"), wkb.wkb_srid(f"`{column}`")
    else:
        digits = f"`{column}` rlike '^0[01]([0-9A-Fa-f]{{2}}){{4,}}$'"
        value = f"unhex(`{column}`)"
        rings = f"if({digits}, {wkb.from_wkb(value)}, {geometry.from_wkt(f'`{column}`')})"
        code = (f"if({digits}, {wkb.wkb_srid(value)},"
                f" try_cast(regexp_extract(`{column}`, '(?i)^ *SRID=([0-9]+);', 1) as int))")
    made = {geom, srid, *BOX}
    kept = [f"`{c}`" for c in df.columns if c != column and c not in made]
    # a generator's rows are worked out once; projections would be merged and parse every
    # value anew for each use of it
    return (df.selectExpr(*kept, f"inline(array(named_struct('g', {rings}, 's', {code}))) as (__g, __s)")
            .selectExpr(*kept, f"__g as `{geom}`", f"__s as `{srid}`", f"{geometry.bbox('__g')} as __b")
            .selectExpr(*kept, f"`{geom}`", f"`{srid}`", *[f"__b.{k}" for k in BOX]))


def srid_of(df: DataFrame, column: str = "srid") -> DataFrame:
    """One row ``srid`` of a geometry table (all its rows share one)."""
    return df.select(F.col(column).alias("srid")).filter("srid is not null").limit(1)


def proj_text(srids: DataFrame, spatial_ref_sys: DataFrame) -> DataFrame:
    """Add ``proj``: the stored text of private SRIDs, else a reference to the code."""
    stored = spatial_ref_sys.filter(F.col("srid") > PRIVATE_SRID).select("srid", "proj4text")
    return (srids.join(stored, "srid", "left")
            .withColumn("proj", F.when(F.col("srid") > PRIVATE_SRID, F.col("proj4text"))
                        .otherwise(F.concat(F.lit("init=epsg:"), F.col("srid").cast("string"))))
            .drop("proj4text"))


def data_currency(imports: DataFrame, as_of: date | None = None) -> DataFrame:
    """One row ``datum``: "Stand: " and the latest import date, else ``as_of`` or today."""
    latest = imports.agg(F.max(F.try_to_timestamp("datadate", F.lit(IMPORT_DATE))).alias("ts"))
    return latest.select(F.coalesce(
        F.concat(F.lit("Stand: "), text.german_date(F.col("ts"))),
        text.german_date(F.current_timestamp() if as_of is None else F.lit(as_of))).alias("datum"))


def style_catalogs(spark: SparkSession, catalogs: DataFrame | None) -> DataFrame:
    """``(id, name)`` of the style catalogues, or the default one; order by ``id``."""
    if catalogs is None:
        return spark.createDataFrame([DEFAULT_CATALOG], "id int, name string")
    return catalogs.select(F.col("id").cast("int").alias("id"), "name")
