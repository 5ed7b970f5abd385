"""Soil surveys and valuations laid over parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.functions import text
from parzelle.operators.predicates import current
from parzelle.operators.spatial import overlay

# Land-use codes below this are arable, others grassland, and the
# labels of the description's parts.
ARABLE_BELOW = 3000


def parcel_soil(parcels: DataFrame, soil: DataFrame, parcel_id: str = "gml_id",
                soil_id: str = "soil_id", keep: list[str] | None = None) -> DataFrame:
    """``(parcel_id, soil_id, shared, *keep, number)`` of current parcels and surveys.

    ``keep`` names further parcel columns, such as the parcel number.

    ``number`` is the survey's yield number as int. It travels through the overlay:
    joined on afterwards, a survey under very many parcels would be a skewed key.
    """
    found = text.to_int(F.col("ackerzahl")) if "ackerzahl" in soil.columns \
        else F.lit(None).cast("int")
    surveys = current(soil).withColumn("number", found)
    return overlay(current(parcels), surveys, parcel_id, soil_id, keep_left=keep,
                   keep_right=["number"])


def yield_index(shared: DataFrame, parcel_id: str = "gml_id") -> DataFrame:
    """``(parcel_id, emz)``: sum over surveys of number times area over 100.

    Each survey's contribution is rounded half to even. Parcels whose surveys carry
    no number drop out. The sum combines on the map side.
    """
    part = F.bround(F.col("number") * F.col("shared") / 100.0, 0).cast("bigint")
    return (shared.filter("number is not null")
            .groupBy(parcel_id).agg(F.sum(part).alias("emz")))


def code_texts(rows: DataFrame, row_id: str, codes: str, catalog: DataFrame) -> DataFrame:
    """``(row_id, texts)``: descriptions of an array of codes, joined by ``, ``.

    Each description counts once per row, however often its code is listed. The
    arrays of codes are exploded and joined on equality; the regrouped list is no
    longer than the row's own array times the catalogue's entries per code.
    """
    entries = rows.select(row_id, F.explode(F.array_distinct(codes)).alias("wert"))
    names = catalog.select(F.col("wert").cast("string").alias("wert"), "beschreibung")
    return (entries.withColumn("wert", F.col("wert").cast("string"))
            .join(names, "wert", "inner").filter("beschreibung is not null")
            .groupBy(row_id)
            .agg(F.array_join(F.array_sort(F.collect_list("beschreibung")), ", ").alias("texts")))


def _one_text(rows: DataFrame, code: str, catalog: DataFrame | None, name: str) -> DataFrame:
    """Add the description of a single code; null when unknown or no catalogue."""
    if catalog is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    names = catalog.groupBy(F.col("wert").cast("string").alias(f"__{code}")) \
        .agg(F.min("beschreibung").alias(name))
    return (rows.withColumn(f"__{code}", F.col(code).cast("string"))
            .join(names, f"__{code}", "left").drop(f"__{code}"))


def soil_description(rows: DataFrame, soil: DataFrame, catalogs: dict[str, DataFrame],
                     soil_id: str = "soil_id") -> DataFrame:
    """Add ``klf_text`` and rounded ``fl`` to rows of ``(soil_id, shared, ...)``.

    ``catalogs`` holds code lists (``wert, beschreibung``) under the names of the
    coded columns; a missing list leaves its part out. The part about the yield uses
    integer division of the rounded area, unlike the total, which rounds each
    contribution.
    """
    texts = soil
    for code in ("nutzungsart", "bodenart", "bodenstufe", "zustandsstufe", "klimastufe"):
        if code not in texts.columns:
            texts = texts.withColumn(code, F.lit(None).cast("string"))
        texts = _one_text(texts, code, catalogs.get(code), f"t_{code}")
    for codes in ("entstehungsart", "sonstigeangaben"):
        if codes in soil.columns and codes in catalogs:
            lists = code_texts(soil, soil_id, codes, catalogs[codes])
            texts = texts.join(lists.withColumnRenamed("texts", f"t_{codes}"), soil_id, "left")
        else:
            texts = texts.withColumn(f"t_{codes}", F.lit(None).cast("string"))
    for number in ("bodenzahl", "ackerzahl"):
        if number not in texts.columns:
            texts = texts.withColumn(number, F.lit(None).cast("string"))
    arable = f"try_cast(nutzungsart as int) < {ARABLE_BELOW}"
    fl = "cast(bround(shared, 0) as int)"
    described = texts.select(
        soil_id, *[f"t_{c}" for c in ("nutzungsart", "bodenart", "bodenstufe", "zustandsstufe",
                                      "entstehungsart", "klimastufe", "sonstigeangaben")],
        F.expr(f"concat(if({arable}, 'Bodenzahl', 'Grünlandgrundzahl'), ' ', bodenzahl)")
        .alias("t_ground"),
        F.expr(f"concat(if({arable}, 'Ackerzahl', 'Grünlandzahl'), ' ', ackerzahl)")
        .alias("t_field"), F.col("ackerzahl").alias("__number"))
    parts = ["t_nutzungsart", "'Bodenart ' || t_bodenart", "t_bodenstufe",
             "'Zustandsstufe ' || t_zustandsstufe", "'Entstehungsart(en) ' || t_entstehungsart",
             "t_klimastufe", "t_ground", "t_field", "'sonstige Angaben ' || t_sonstigeangaben",
             f"'Ertragsmesszahl ' || (try_cast(__number as int) * cast({fl} as bigint) div 100)"]
    kept = [c for c in rows.columns if c != "number"]
    return rows.join(described, soil_id, "inner").selectExpr(
        *kept, f"concat_ws(', ', {', '.join(parts)}) as klf_text", f"{fl} as fl")


def valuation(parcels: DataFrame, valuations: DataFrame, catalog: DataFrame,
              parcel_id: str = "gml_id", valuation_id: str = "valuation_id",
              keep: list[str] | None = None) -> DataFrame:
    """``(parcel_id, *keep, klf_text, fl)`` of current valuations under current parcels."""
    shared = overlay(current(parcels), current(valuations), parcel_id, valuation_id,
                     keep_left=keep)
    named = _one_text(valuations.select(valuation_id, "klassifizierung"), "klassifizierung",
                      catalog, "beschreibung")
    return (shared.join(named, valuation_id, "inner")
            .select(parcel_id, *(keep or []), text.valuation_text(F.col("beschreibung"), F.col("klassifizierung"))
                    .alias("klf_text"), F.expr("cast(bround(shared, 0) as int)").alias("fl")))
