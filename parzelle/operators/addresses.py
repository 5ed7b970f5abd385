"""Streets, house numbers and the parcels they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.functions import text
from parzelle.operators.grouping import with_group_count
from parzelle.operators.predicates import current, current_book, starts_with_ci

# Columns of the street key shared by catalogue and address tables.
STREET_KEY = ["land", "regierungsbezirk", "kreis", "gemeinde", "lage"]
TOWN_KEY = ["land", "regierungsbezirk", "kreis"]

# The two house-number choices that are not numbers.
WITHOUT, ALL = "Ohne", "Alle"


def used_streets(catalog: DataFrame, numbered: DataFrame, plain: DataFrame) -> DataFrame:
    """Current catalogue streets with at least one current address of either kind.

    Both address tables are reduced to their keys and joined as one existence test,
    where two outer joins would multiply a street by its addresses.
    """
    used = current(numbered).select(*STREET_KEY).union(current(plain).select(*STREET_KEY))
    return current(catalog).join(used.distinct(), STREET_KEY, "left_semi")


def with_town(streets: DataFrame, town: DataFrame) -> DataFrame:
    """Add ``town``; municipality codes are compared as numbers (``007`` is ``7``)."""
    names = (current(town)
             .select(*TOWN_KEY, F.expr("try_cast(gemeinde as int)").alias("__g"),
                     F.col("bezeichnung").alias("town"))
             .distinct())
    return (streets.withColumn("__g", F.expr("try_cast(gemeinde as int)"))
            .join(names, [*TOWN_KEY, "__g"], "left").drop("__g"))


def _named_keys(catalog: DataFrame, numbered: DataFrame, plain: DataFrame, town: DataFrame,
                prefix: str | None) -> DataFrame:
    """Distinct ``(name, suffix, town, key)`` of used streets under the prefix."""
    streets = current(catalog)
    if prefix:
        # cut before the joins: the shown text starts with the street's name
        lowered = F.lower("bezeichnung")
        streets = streets.filter(lowered.startswith(prefix.lower())
                                 | F.lit(prefix.lower()).startswith(lowered))
    rows = (with_town(used_streets(streets, numbered, plain), town)
            .select(F.col("bezeichnung").alias("name"), F.col("kennung").alias("suffix"), "town",
                    F.col("schluesselgesamt").alias("key"))
            .withColumn("street", text.street_display(F.col("name"), F.col("town"),
                                                      F.col("suffix")))
            .filter(F.col("street").isNotNull()))
    if prefix:
        rows = rows.filter(starts_with_ci(F.col("street"), prefix))
    return rows.distinct()


def free_streets(numbered: DataFrame, plain: DataFrame, prefix: str | None = None) -> DataFrame:
    """Distinct current free-text street names of both address tables."""
    names = (current(numbered).select("unverschluesselt")
             .union(current(plain).select("unverschluesselt"))
             .filter("unverschluesselt is not null"))
    if prefix:
        names = names.filter(starts_with_ci(F.col("unverschluesselt"), prefix))
    return names.distinct().select(F.col("unverschluesselt").alias("street"))


def street_directory(catalog: DataFrame, numbered: DataFrame, plain: DataFrame, town: DataFrame,
                     prefix: str | None = None) -> DataFrame:
    """``(street, key)`` of used streets and free-text ones, optionally by prefix.

    A street shown under several keys appears once per key with the key appended;
    free-text streets have an empty key.
    """
    group = ["name", "suffix", "town"]
    keyed = with_group_count(_named_keys(catalog, numbered, plain, town, prefix), group, "n")
    shown = keyed.select(
        F.when(F.col("n") > 1, F.concat("street", F.lit(" ("), "key", F.lit(")")))
        .otherwise(F.col("street")).alias("street"), "key")
    free = free_streets(numbered, plain, prefix).withColumn("key", F.lit(""))
    return shown.union(free)


def street_key_lists(catalog: DataFrame, numbered: DataFrame, plain: DataFrame, town: DataFrame,
                     prefix: str | None = None) -> DataFrame:
    """``(street, keys)`` with the sorted keys of each street joined by ``#``.

    The list is bounded by the catalogue, in which a street's name occurs a few thousand
    times at most (once a town), not by the addresses.
    """
    rows = _named_keys(catalog, numbered, plain, town, prefix)
    keys = F.array_join(F.array_sort(F.collect_set("key")), "#").alias("keys")
    joined = rows.groupBy("name", "suffix", "town", "street").agg(keys).select("street", "keys")
    return joined.union(free_streets(numbered, plain, prefix).withColumn("keys", F.lit("")))


def house_number_choices(numbered: DataFrame, plain: DataFrame, by: list[str]) -> DataFrame:
    """The choices for every street at once: numbers, then "without", then "all".

    ``by`` names the street columns (the street key, or the free text). Order the
    result by ``by, rank, num_key``. "All" is offered when a street has more than
    one other choice. Only counts per street are shuffled, never a street's list.
    """
    numbers = (current(numbered).select(
        *by, F.col("hausnummer").alias("choice"), F.lit(0).alias("rank"),
        text.house_number_key(F.col("hausnummer")).alias("num_key")))
    without = (current(plain).select(*by).distinct()
               .select(*by, F.lit(WITHOUT).alias("choice"), F.lit(1).alias("rank"),
                       F.lit(None).cast("int").alias("num_key")))
    listed = numbers.union(without).filter(
        reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    everything = (listed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .select(*by, F.lit(ALL).alias("choice"), F.lit(2).alias("rank"),
                          F.lit(None).cast("int").alias("num_key")))
    return listed.union(everything)


def house_numbers_by_key(catalog: DataFrame, numbered: DataFrame, plain: DataFrame) -> DataFrame:
    """The choices of every street of the current catalogue, by its ``schluesselgesamt``.

    Addresses count for the catalogue street with all five parts of their key; ended
    streets and addresses of no catalogue street have no choices.
    """
    streets = current(catalog).select(*STREET_KEY, "schluesselgesamt").distinct()

    def on_street(addresses: DataFrame) -> DataFrame:
        return addresses.join(streets, STREET_KEY, "inner")
    return house_number_choices(on_street(numbered), on_street(plain), ["schluesselgesamt"])


def order_choices(choices: DataFrame, by: list[str]) -> DataFrame:
    """Numbers by their digits (those without digits last), then the special ones."""
    return choices.orderBy(*by, "rank", F.asc_nulls_last("num_key"), "choice")


def parcels_at_address(parcels: DataFrame, addresses: DataFrame, link: str) -> DataFrame:
    """``(gml_id, flsnr)`` of current parcels linked to one of the address ids.

    ``link`` is the parcel's array of address ids. It is exploded and joined on
    equality; a containment test in the join would compare every parcel with every
    address.
    """
    linked = current(parcels).select("gml_id", "flsnr", F.explode(link).alias("__address"))
    ids = addresses.select(F.col("gml_id").alias("__address"))
    return linked.join(ids, "__address", "left_semi").select("gml_id", "flsnr").distinct()


def parcels_by_typed_address(parcels: DataFrame, catalog: DataFrame, numbered: DataFrame,
                             typed: str, current_only: bool = False) -> DataFrame:
    """Parcels of a typed ``street number``; the street may be abbreviated.

    Ended address rows count unless ``current_only`` is set; text without a house
    number selects nothing.
    """
    found = text.parse_address(typed)
    if found is None:
        return parcels.select("gml_id", "flsnr").filter(F.lit(False))
    street, number = found
    rows = numbered.filter(F.col("hausnummer") == number)
    if current_only:
        rows = current(rows)
    names = catalog.select(*STREET_KEY, "bezeichnung")
    hits = rows.join(names, STREET_KEY, "left").filter(
        starts_with_ci(F.col("bezeichnung"), street)
        | starts_with_ci(F.col("unverschluesselt"), street))
    return parcels_at_address(parcels, hits, "weistauf")


def parcels_by_address(parcels: DataFrame, catalog: DataFrame, numbered: DataFrame,
                       plain: DataFrame, number: str, key: str | None = None,
                       street: str | None = None) -> DataFrame:
    """Parcels of a chosen street (by key, or by free text) and house-number choice."""
    if (key is None) == (street is None):
        raise ValueError("give exactly one of key, street")

    def on_street(addresses: DataFrame) -> DataFrame:
        if street is not None:
            return addresses.filter(F.col("unverschluesselt") == street)
        wanted = catalog.filter(F.col("schluesselgesamt") == key).select(*STREET_KEY)
        return addresses.join(wanted, STREET_KEY, "left_semi")

    without = parcels_at_address(parcels, on_street(plain), "zeigtauf")
    if number == WITHOUT:
        return without
    rows = on_street(numbered)
    if number == ALL:
        return without.union(parcels_at_address(parcels, rows, "weistauf")).distinct()
    return parcels_at_address(parcels, rows.filter(F.col("hausnummer") == number), "weistauf")


def parcel_streets(strassen: DataFrame, str_shl: DataFrame) -> DataFrame:
    """``(flsnr, strname, hausnr, num_key)`` of current parcels' streets.

    Order by ``flsnr, strname, num_key, hausnr``.
    """
    return (current_book(strassen).join(str_shl.select("strshl", "strname"), "strshl", "inner")
            .select("flsnr", "strname", "hausnr",
                    text.report_number_key(F.col("hausnr")).alias("num_key")))
