"""Text and code-list expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stand for "no value" in text output, and the pattern of
# a typed address (street, blank, number with optional letter).
EMPTY_WORDS = ("NULL", "None")
TYPED_ADDRESS = r"^(.*)\s+(\d+[a-zA-Z]?)$"

# Month names of the date line.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August",
          "September", "Oktober", "November", "Dezember")


def to_int(text: Column) -> Column:
    """Text to int, null when it is not a number."""
    return text.try_cast("int")


def district_display(name: Column, key: Column, town: Column) -> Column:
    """``name (key, town)``; the town part is left out when unknown."""
    return F.concat(name, F.lit(" ("), key, F.coalesce(F.concat(F.lit(", "), town), F.lit("")),
                    F.lit(")"))


def street_display(name: Column, town: Column, suffix: Column) -> Column:
    """``name, town (suffix)``; unknown parts are left out."""
    return F.concat(name, F.coalesce(F.concat(F.lit(", "), town), F.lit("")),
                    F.coalesce(F.concat(F.lit(" ("), suffix, F.lit(")")), F.lit("")))


def split_address(text: Column) -> Column:
    """``struct<street, number>`` of a typed address, null when it has no number."""
    return F.when(F.regexp_like(text, F.lit(TYPED_ADDRESS)), F.struct(
        F.regexp_extract(text, TYPED_ADDRESS, 1).alias("street"),
        F.upper(F.regexp_extract(text, TYPED_ADDRESS, 2)).alias("number")))


def parse_address(text: str) -> tuple[str, str] | None:
    """The same for one typed text held by the caller."""
    found = re.search(TYPED_ADDRESS, text)
    return (found.group(1), found.group(2).upper()) if found else None


def house_number_key(number: Column) -> Column:
    """Sort key of a house number: its digits as int, null without digits."""
    return F.nullif(F.regexp_replace(number, r"\D", ""), F.lit("")).try_cast("int")


def report_number_key(number: Column) -> Column:
    """Sort key in the report: a purely numeric number as int, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(number, r"^(\d+)$", 1), F.lit(""))
                      .try_cast("int"), F.lit(0))


def valuation_text(description: Column, code: Column) -> Column:
    """Code-list text, else the bare code, else a note that it is missing."""
    return F.coalesce(description, F.concat(F.lit("("), code.cast("string"), F.lit(")")),
                      F.lit("(Klassifizierung fehlt)"))


def german_date(ts: Column) -> Column:
    """``d. MMMM yyyy`` with German month names, whatever the JVM locale."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat(F.date_format(ts, "d"), F.lit(". "), F.element_at(months, F.month(ts)),
                    F.lit(" "), F.date_format(ts, "yyyy"))


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Turn scalar columns to trimmed text; null and the empty words become ``''``."""
    wanted = columns or tuple(df.columns)

    def cell(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(text.isNull() | text.isin(*EMPTY_WORDS), F.lit("")) \
            .otherwise(F.trim(text)).alias(name)
    return df.select(*[cell(c) if c in wanted else F.col(c) for c in df.columns])


def escape_html(value: Column) -> Column:
    """Text made safe for an HTML page; null becomes empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
