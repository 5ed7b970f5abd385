"""Owners, register folios and the parcels they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.operators.grouping import CHUNK, nest
from parzelle.operators.predicates import current, current_book, has_all_terms
from parzelle.session import materialize

# Fixed value: kind of office that keeps the land register.
REGISTER_COURT = "1000"


def parcels_by_owner(parcels: DataFrame, fs: DataFrame, eignerart: DataFrame, eigner: DataFrame,
                     terms: str) -> DataFrame:
    """Current parcels with an owner whose first name line has all the terms.

    The chain owner, folio, parcel number, parcel id is walked with existence joins
    from the selective end, so neither a folio with many owners nor an owner with
    many folios multiplies rows; each step is reduced to its distinct keys.
    """
    folios = eigner.filter(has_all_terms(F.col("name1"), terms)).select("bestdnr").distinct()
    flsnr = eignerart.join(folios, "bestdnr", "left_semi").select("flsnr").distinct()
    ids = fs.join(flsnr, fs["alb_key"] == flsnr["flsnr"], "left_semi") \
        .select(F.col("fs_obj").alias("gml_id")).distinct()
    return current(parcels).join(ids, "gml_id", "left_semi")


def courts(districts: DataFrame, offices: DataFrame) -> DataFrame:
    """``(land, bezirk, court)``: one register court per register district.

    Where several offices qualify, the first by name is taken.
    """
    court = offices.filter(F.col("stellenart") == REGISTER_COURT) \
        .select("schluesselgesamt", "bezeichnung")
    key = F.concat("gehoertzu_land", "gehoertzu_stelle")
    return (districts.select("land", "bezirk", key.alias("schluesselgesamt"))
            .join(court, "schluesselgesamt", "inner")
            .groupBy("land", "bezirk").agg(F.min("bezeichnung").alias("court")))


def holdings(eignerart: DataFrame, bestand: DataFrame, eign_shl: DataFrame,
             court_table: DataFrame | None = None) -> DataFrame:
    """Folio rows of every parcel, with kind of holding, share and register court.

    ``anteil`` and the court are empty where the data has none. Order by ``flsnr,
    zhist, bhist, b``.
    """
    if "anteil" not in eignerart.columns:
        eignerart = eignerart.withColumn("anteil", F.lit(""))
    # a handful of kinds, each with very many rows: the planner must know that they are few
    kinds = materialize(eign_shl.groupBy("b").agg(F.min("eignerart").alias("eignerart")), "kinds")
    folio = bestand.select("bestdnr", "gbbz", "gbblnr", "bestfl", F.col("ff_stand").alias("bhist"))
    rows = (eignerart.select("flsnr", "bestdnr", "b", "bvnr", "auftlnr", "anteil",
                             F.col("ff_stand").alias("zhist"))
            .join(folio, "bestdnr", "inner").join(kinds, "b", "left")
            .withColumn("pz", F.lit("")))
    if court_table is None:
        return rows.withColumn("bezeichnung", F.lit(""))
    named = court_table.select(F.col("land").alias("__land"), F.col("bezirk").alias("gbbz"),
                               F.col("court").alias("bezeichnung"))
    return (rows.withColumn("__land", F.substring("bestdnr", 1, 2))
            .join(named, ["__land", "gbbz"], "left").drop("__land"))


def folio_owners(eigner: DataFrame) -> DataFrame:
    """Current owner rows with their sort key; order by ``bestdnr, owner_key``."""
    return current_book(eigner).withColumn(
        "owner_key", F.coalesce(F.col("namensnr").cast("string"), F.lit("0")))


def nested_owners(eigner: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(bestdnr, chunk, owners)``: the ordered owners of every folio, a row for each
    ``chunk`` of them."""
    rows = folio_owners(eigner)
    values = [c for c in rows.columns if c not in ("bestdnr", "owner_key", "ff_stand")]
    return nest(rows, ["bestdnr"], ["owner_key", *values], [], "owners", chunk)
