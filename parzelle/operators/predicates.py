"""Row filters. Each keeps the input's columns, so they push down to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.functions import numbers


def current(df: DataFrame) -> DataFrame:
    """Object-table rows that have not ended."""
    return df.filter(F.col("endet").isNull())


def current_book(df: DataFrame) -> DataFrame:
    """Book-table rows that are not historic."""
    return df.filter(F.col("ff_stand") == 0)


def in_theme(df: DataFrame, theme: str) -> DataFrame:
    return df.filter(F.col("thema") == theme)


def in_models(df: DataFrame, models: Iterable[str]) -> DataFrame:
    """Rows tagged with at least one of the models; no models means no filter."""
    wanted = list(models)
    if not wanted:
        return df
    return df.filter(F.arrays_overlap("modell", F.array(*[F.lit(m) for m in wanted])))


def has_value(df: DataFrame, column: str) -> DataFrame:
    """Rows whose geometry or style key is present."""
    return df.filter(F.col(column).isNotNull())


def starts_with_ci(value: Column, prefix: str) -> Column:
    """Case-insensitive prefix test; the prefix is taken literally."""
    return F.lower(value).startswith(prefix.lower())


def label_search(labels: DataFrame, term: str, partial: bool = True) -> DataFrame:
    """Map labels whose text contains (or equals) the term; empty term, no rows."""
    if term == "":
        return labels.filter(F.lit(False))
    if partial:
        return labels.filter(F.lower("text").contains(term.lower()))
    return labels.filter(F.col("text") == term)


def has_all_terms(value: Column, terms: str) -> Column:
    """Every blank-separated term occurs in the value, whatever its case."""
    wanted = terms.lower().split()
    if not wanted:
        return F.lit(False)
    test = F.lit(True)
    for term in wanted:
        test = test & F.lower(value).contains(term)
    return test


def facet_filter(df: DataFrame, district: str | None = None, section: str | None = None,
                 num: str | None = None, den: str | None = None) -> DataFrame:
    """Parcel-book rows matching every given part; empty or ``None`` means any."""
    if district:
        df = df.filter(F.col("gemashl") == district)
    if section:
        df = df.filter(F.col("flr") == section)
    if num and den:
        return df.filter(F.col("flsnrk") == f"{num}/{den}")
    if num:
        return df.filter(F.col("flsnrk").startswith(f"{num}/"))
    if den:
        return df.filter(F.col("flsnrk").endswith(f"/{den}"))
    return df


def parcels_by_parts(parcels: DataFrame, fs: DataFrame, district: str | None = None,
                     section: str | None = None, num: str | None = None,
                     den: str | None = None) -> DataFrame:
    """Current parcels whose composed number has the given parts.

    The leading parts become one prefix test (it reaches the parquet scan as
    ``StartsWith``); parts behind a gap are compared one by one.
    """
    keys = fs
    given = [part or None for part in (district, section, num, den)]
    lead, led = "", 0
    for part, stop in zip(given, ("-", "-", "/", "")):
        if part is None:
            break
        lead += part + stop
        led += 1
    if all(given):
        keys = keys.filter(F.col("alb_key") == lead)
    elif lead:
        keys = keys.filter(F.col("alb_key").startswith(lead))
    tail = F.split_part("alb_key", F.lit("-"), F.lit(-1))
    places = (F.split_part("alb_key", F.lit("-"), F.lit(1)),
              F.split_part("alb_key", F.lit("-"), F.lit(2)), numbers.num(tail), numbers.den(tail))
    for part, place in zip(given[led:], places[led:]):
        if part is not None:
            keys = keys.filter(place == part)
    # whatever is left open, a composed number has all four places
    keys = keys.filter(F.col("alb_key").rlike(numbers.COMPOSED))
    ids = keys.select(F.col("fs_obj").alias("gml_id")).distinct()
    return current(parcels).join(ids, "gml_id", "left_semi")


def matches_number(key: Column, wanted: numbers.NumberParts) -> Column:
    """Whether a fixed-width key carries the wanted parts.

    A part of more digits than usual moves those behind it.
    """
    test, at = F.lit(True), 1
    for name, part in (("district", wanted.district), ("section", wanted.section),
                       ("num", wanted.num), ("den", wanted.den)):
        width = numbers.WIDTHS[name]
        if part is not None:
            digits = f"{part:0{width}d}"
            width = len(digits)
            # the leading part is a prefix test, which reaches the scan
            test &= key.startswith(digits) if at == 1 else F.substring(key, at, width) == digits
        at += width
    return test & (F.length(key) >= at - 1)


def parcels_by_number(parcels: DataFrame, text: str) -> DataFrame:
    """Current parcels matching a typed number ``district[-section]-num[/den]``.

    Text that is no parcel number selects nothing.
    """
    wanted = numbers.parse_number(text)
    if wanted is None:
        return parcels.filter(F.lit(False))
    return current(parcels).filter(matches_number(F.col("flurstueckskennzeichen"), wanted))
