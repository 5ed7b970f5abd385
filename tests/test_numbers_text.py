import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parzelle.functions import numbers as N
from parzelle.functions import text as T
from parzelle.operators.predicates import parcels_by_number, parcels_by_parts
from parzelle.operators.selection import parcel_number_of


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("parts, key", [
    ((30007, 4, 12, 3), "030007004000120003"),
    ((30007, 0, 12, 3), "030007___000120003"),
    ((30007, None, 12, None), "030007___00012____"),
    ((1234567, 4, 123456, 3), "12345670041234560003"),
])
def test_parcel_key(spark, parts, key):
    cols = [F.lit(p).cast("string") for p in parts]
    assert one(spark, N.parcel_key(*cols)) == key


def test_parcel_number_without_denominator(spark):
    assert one(spark, N.parcel_number(F.lit("030007"), F.lit("004"), F.lit("12"),
                                      F.lit(None).cast("string"))) == "030007-004-12/0"


def test_number_from_key(spark):
    assert one(spark, N.number_from_key(F.lit("030007004000120003__"))) == "030007-004-12/3"
    assert one(spark, N.number_from_key(F.lit("030007___00012______"))) == "030007--12/0"


@pytest.mark.parametrize("typed, parts", [
    ("30007-4-12/3", (30007, 4, 12, 3)),
    ("30007-12/3", (30007, None, 12, 3)),
    ("30007-12", (30007, None, 12, None)),
    ("Nr. 30007-0-12/0 bitte", (30007, None, 12, None)),
])
def test_parse_number(typed, parts):
    p = N.parse_number(typed)
    assert (p.district, p.section, p.num, p.den) == parts


def test_parse_number_rejects_other_text():
    assert N.parse_number("Hauptstraße 5") is None


KEYS = [("a", "030007004000120003__", None), ("b", "030007005000120003__", None),
        ("c", "03000700400012______", None), ("d", "030007___000120003__", None),
        ("e", "030007004000120003__", dt.datetime(2020, 1, 1)), ("f", "03000700400012", None)]


def _parcels(spark):
    return spark.createDataFrame(
        KEYS, "gml_id string, flurstueckskennzeichen string, endet timestamp")


@pytest.mark.parametrize("typed, ids", [
    ("30007-4-12/3", ["a"]),
    ("30007-12/3", ["a", "b", "d"]),
    ("30007-4-12", ["a", "c"]),
    ("30008-12", []),
    ("nothing", []),
])
def test_parcels_by_number_wildcards(spark, typed, ids):
    assert [r[0] for r in rows(parcels_by_number(_parcels(spark), typed), "gml_id")] == ids


@pytest.mark.parametrize("parts, ids", [
    ({"district": "030007"}, ["a", "b", "c"]),
    ({"section": "004"}, ["a", "c", "d"]),
    ({"district": "030007", "num": "12"}, ["a", "b"]),
    ({"district": "030007", "section": "004", "num": "12", "den": "3"}, ["a"]),
    ({"den": "3"}, ["a"]),
    ({"den": ""}, ["a", "b", "c", "d"]),
])
def test_parcels_by_parts(spark, parts, ids):
    parcels = spark.createDataFrame(
        [(i, None) for i in "abcd"] + [("e", dt.datetime(2020, 1, 1))],
        "gml_id string, endet timestamp")
    fs = spark.createDataFrame(
        [("a", "030007-004-12/3"), ("b", "030007-005-12/0"), ("c", "030007-004-13/0"),
         ("d", "030008-004-1/33"), ("e", "030007-004-12/3")], "fs_obj string, alb_key string")
    assert [r[0] for r in rows(parcels_by_parts(parcels, fs, **parts), "gml_id")] == ids


def test_parcel_number_of_needs_one_number(spark):
    ids = spark.createDataFrame([("A" * 16,), ("B" * 16,), ("C" * 16,), ("short",)], "gml_id string")
    fs = spark.createDataFrame([("A" * 16, "n1"), ("B" * 16, "n2"), ("B" * 16, "n3"),
                                ("short", "n4")], "fs_obj string, alb_key string")
    assert rows(parcel_number_of(ids, fs)) == [
        ("A" * 16, "n1"), ("B" * 16, None), ("C" * 16, None), ("short", None)]


def test_displays_leave_out_unknown_parts(spark):
    none = F.lit(None).cast("string")
    assert one(spark, T.street_display(F.lit("Ring"), F.lit("Ort"), F.lit("K"))) == "Ring, Ort (K)"
    assert one(spark, T.street_display(F.lit("Ring"), none, none)) == "Ring"
    assert one(spark, T.district_display(F.lit("G"), F.lit("1"), none)) == "G (1)"
    assert one(spark, T.district_display(F.lit("G"), F.lit("1"), F.lit("T"))) == "G (1, T)"


def test_split_address(spark):
    assert T.parse_address("Am  Ring 12b") == ("Am  Ring", "12B")
    assert T.parse_address("Am Ring") is None
    got = one(spark, T.split_address(F.lit("Straße des 17. Juni 135a")))
    assert (got["street"], got["number"]) == ("Straße des 17. Juni", "135A")
    assert one(spark, T.split_address(F.lit("Am Ring"))) is None


def test_sort_keys_of_house_numbers(spark):
    df = spark.createDataFrame([("10A",), ("9",), ("",), ("x",), (None,), ("99999999999",)],
                               "h string")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "h", T.house_number_key(F.col("h")), T.report_number_key(F.col("h"))).collect()}
    assert got == {"10A": (10, 0), "9": (9, 9), "": (None, 0), "x": (None, 0), None: (None, 0),
                   "99999999999": (None, 0)}


def test_as_text(spark):
    df = spark.createDataFrame([(1, " a "), (None, "NULL"), (2, "None"), (3, None)],
                               "n int, s string")
    assert rows(T.as_text(df)) == [("", ""), ("1", "a"), ("2", ""), ("3", "")]


def test_small_texts(spark):
    none = F.lit(None).cast("string")
    assert one(spark, T.valuation_text(none, F.lit(7))) == "(7)"
    assert one(spark, T.valuation_text(none, none)) == "(Klassifizierung fehlt)"
    assert one(spark, T.to_int(F.lit("12x"))) is None
    assert one(spark, T.german_date(F.lit("2024-03-05").cast("timestamp"))) == "5. März 2024"
    assert one(spark, T.escape_html(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
