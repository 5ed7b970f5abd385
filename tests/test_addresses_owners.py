import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parzelle.operators import addresses as A
from parzelle.operators import facets, owners, selection
from parzelle.operators.grouping import nest, with_position
from parzelle.operators.predicates import facet_filter, label_search

ENDED = dt.datetime(2020, 1, 1)
KEY = ("03", "1", "51")


@pytest.fixture(scope="module")
def catalog(spark):
    data = [(*KEY, "007", "00001", "Ring", None, "k1", None),
            (*KEY, "007", "00002", "Ring", None, "k2", None),
            (*KEY, "008", "00003", "Ring", "Süd", "k3", None),
            (*KEY, "008", "00004", "Unbenutzt", None, "k4", None),
            (*KEY, "008", "00005", "Ringweg", None, "k5", ENDED),
            (*KEY, "x9", "00006", "Am Ring", None, "k6", None)]
    return spark.createDataFrame(data, "land string, regierungsbezirk string, kreis string,"
                                 " gemeinde string, lage string, bezeichnung string,"
                                 " kennung string, schluesselgesamt string, endet timestamp")


@pytest.fixture(scope="module")
def numbered(spark):
    data = [("a1", *KEY, "007", "00001", "10", None, None),
            ("a2", *KEY, "007", "00001", "9", None, None),
            ("a3", *KEY, "007", "00001", "10A", None, None),
            ("a4", *KEY, "007", "00001", "x", None, None),
            ("a5", *KEY, "007", "00002", "1", None, None),
            ("a6", *KEY, "008", "00003", "1", "Ringallee", None),
            ("a7", *KEY, "008", "00004", "1", None, ENDED),
            ("a8", *KEY, "x9", "00006", "5", None, None)]
    return spark.createDataFrame(data, "gml_id string, land string, regierungsbezirk string,"
                                 " kreis string, gemeinde string, lage string, hausnummer string,"
                                 " unverschluesselt string, endet timestamp")


@pytest.fixture(scope="module")
def plain(spark):
    data = [("b1", *KEY, "007", "00001", None, None), ("b2", *KEY, "008", "00003", "Feld", None),
            ("b3", *KEY, "008", "00004", "Alt", ENDED)]
    return spark.createDataFrame(data, "gml_id string, land string, regierungsbezirk string,"
                                 " kreis string, gemeinde string, lage string,"
                                 " unverschluesselt string, endet timestamp")


@pytest.fixture(scope="module")
def town(spark):
    return spark.createDataFrame(
        [(*KEY, "7", "Siebenau", None), (*KEY, "08", "Achtel", ENDED), (*KEY, "9", "Neun", None)],
        "land string, regierungsbezirk string, kreis string, gemeinde string,"
        " bezeichnung string, endet timestamp")


@pytest.fixture(scope="module")
def parcels(spark):
    data = [("p1", "n1", ["a1", "a2"], ["b1"], None), ("p2", "n2", ["a3"], [], None),
            ("p3", "n3", ["a6"], ["b2"], None), ("p4", "n4", ["a1"], None, ENDED),
            ("p5", "n5", None, ["b1"], None), ("p6", "n6", ["a7"], ["b3"], None)]
    return spark.createDataFrame(data, "gml_id string, flsnr string, weistauf array<string>,"
                                 " zeigtauf array<string>, endet timestamp")


def test_directory_shows_used_streets_and_keys_of_like_names(catalog, numbered, plain, town):
    got = rows(A.street_directory(catalog, numbered, plain, town))
    assert got == [("Am Ring", "k6"), ("Feld", ""), ("Ring (Süd)", "k3"),
                   ("Ring, Siebenau (k1)", "k1"), ("Ring, Siebenau (k2)", "k2"), ("Ringallee", "")]


def test_directory_prefix_ignores_case_and_reaches_into_the_town(catalog, numbered, plain, town):
    def found(prefix):
        return [r[1] for r in rows(A.street_directory(catalog, numbered, plain, town, prefix))]
    assert found("RING, sieb") == ["k1", "k2"]
    assert found("ringa") == [""]
    assert found("Ring%") == []


def test_key_lists(catalog, numbered, plain, town):
    assert ("Ring, Siebenau", "k1#k2") in rows(
        A.street_key_lists(catalog, numbered, plain, town))


def test_house_number_choices_and_order(numbered, plain):
    by = ["gemeinde", "lage"]
    choices = A.house_number_choices(numbered, plain, by)
    ordered = [r["choice"] for r in A.order_choices(choices, by).collect()
               if r["lage"] == "00001"]
    assert ordered == ["9", "10", "10A", "x", "Ohne", "Alle"]
    assert [r[2] for r in rows(choices) if r[1] == "00002"] == ["1"]
    assert [r[2] for r in rows(choices) if r[1] == "00004"] == []


@pytest.mark.parametrize("number, choice, ids", [
    ("10", {"key": "k1"}, ["p1"]), ("10A", {"key": "k1"}, ["p2"]),
    ("Ohne", {"key": "k1"}, ["p1", "p5"]), ("Alle", {"key": "k1"}, ["p1", "p2", "p5"]),
    ("Ohne", {"street": "Feld"}, ["p3"]), ("1", {"street": "Ringallee"}, ["p3"]),
    ("Alle", {"street": "Feld"}, ["p3"]), ("10", {"key": "k2"}, [])])
def test_parcels_by_address(parcels, catalog, numbered, plain, number, choice, ids):
    got = A.parcels_by_address(parcels, catalog, numbered, plain, number, **choice)
    assert [r[0] for r in rows(got)] == ids


@pytest.mark.parametrize("typed, ids", [
    ("ring 10a", ["p2"]), ("Ringal 1", ["p3"]), ("Ring", []), ("Unb 1", ["p6"]), ("% 10", [])])
def test_parcels_by_typed_address(parcels, catalog, numbered, typed, ids):
    assert [r[0] for r in rows(A.parcels_by_typed_address(parcels, catalog, numbered, typed))] == ids


def test_typed_address_of_current_rows_only(parcels, catalog, numbered):
    assert rows(A.parcels_by_typed_address(parcels, catalog, numbered, "Unb 1", True)) == []


def test_address_join_is_an_equi_join(parcels, catalog, numbered):
    plan = A.parcels_by_typed_address(parcels, catalog, numbered, "ring 10a") \
        ._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parcel_streets(spark):
    strassen = spark.createDataFrame([("n1", "1", "10", 0), ("n1", "1", "9a", 0),
                                      ("n1", "1", "2", 1)],
                                     "flsnr string, strshl string, hausnr string, ff_stand int")
    names = spark.createDataFrame([("1", "Ring")], "strshl string, strname string")
    assert rows(A.parcel_streets(strassen, names), "num_key", "hausnr") == [(0, "9a"), (10, "10")]


# -- owners ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def register(spark):
    return {
        "eignerart": spark.createDataFrame(
            [("n1", "03A1", "X", "1", "1", 0), ("n1", "03A2", "Y", "2", "1", 0),
             ("n2", "03A1", "X", "1", "2", 1)],
            "flsnr string, bestdnr string, b string, bvnr string, auftlnr string, ff_stand int"),
        "bestand": spark.createDataFrame(
            [("03A1", "B1", "11", "f", 0), ("03A2", "B2", "12", "f", 0)],
            "bestdnr string, gbbz string, gbblnr string, bestfl string, ff_stand int"),
        "eign_shl": spark.createDataFrame([("X", "Grundstück")], "b string, eignerart string"),
        "eigner": spark.createDataFrame(
            [("03A1", "Meier, Anna", "2", 0), ("03A1", "Müller, Bert", None, 0),
             ("03A1", "Alt, Carl", "1", 1), ("03A9", "Meier, Dora", "1", 0)],
            "bestdnr string, name1 string, namensnr string, ff_stand int"),
        "fs": spark.createDataFrame([("p1", "n1"), ("p2", "n2"), ("p4", "n1")],
                                    "fs_obj string, alb_key string"),
    }


@pytest.mark.parametrize("terms, ids", [("meier anna", ["p1", "p2"]), ("MÜLLER", ["p1", "p2"]),
                                        ("meier bert", []), ("dora", []), ("  ", [])])
def test_parcels_by_owner(parcels, register, terms, ids):
    got = owners.parcels_by_owner(parcels, register["fs"], register["eignerart"],
                                  register["eigner"], terms)
    assert [r[0] for r in rows(got, "gml_id")] == ids


def test_holdings_with_and_without_court(spark, register):
    e, b, s = (register[k] for k in ("eignerart", "bestand", "eign_shl"))
    plain = rows(owners.holdings(e, b, s), "flsnr", "bestdnr", "eignerart", "anteil",
                 "bezeichnung")
    assert plain == [("n1", "03A1", "Grundstück", "", ""), ("n1", "03A2", None, "", ""),
                     ("n2", "03A1", "Grundstück", "", "")]
    districts = spark.createDataFrame([("B1", "03", "03", "7"), ("B1", "04", "03", "8")],
                                      "bezirk string, land string, gehoertzu_land string,"
                                      " gehoertzu_stelle string")
    offices = spark.createDataFrame(
        [("037", "1000", "AG Stadt"), ("037", "1000", "AG Alt"), ("038", "1200", "Amt")],
        "schluesselgesamt string, stellenart string, bezeichnung string")
    court = owners.courts(districts, offices)
    assert rows(court) == [("03", "B1", "AG Alt")]
    named = rows(owners.holdings(e.withColumn("anteil", F.lit("1/2")), b, s, court),
                 "bestdnr", "anteil", "bezeichnung")
    assert named == [("03A1", "1/2", "AG Alt"), ("03A1", "1/2", "AG Alt"), ("03A2", "1/2", None)]


def test_nested_owners_are_ordered_and_bounded(register):
    nested = owners.nested_owners(register["eigner"])
    got = {(r["bestdnr"], r["chunk"]): [o["name1"] for o in r["owners"]] for r in nested.collect()}
    assert got == {("03A1", 0): ["Müller, Bert", "Meier, Anna"], ("03A9", 0): ["Meier, Dora"]}
    nested = owners.nested_owners(register["eigner"], chunk=1)
    assert {(r["bestdnr"], r["chunk"]): r["owners"][0]["name1"] for r in nested.collect()} == {
        ("03A1", 0): "Müller, Bert", ("03A1", 1): "Meier, Anna", ("03A9", 0): "Meier, Dora"}


def test_positions_of_a_key_in_many_tasks(spark):
    df = spark.range(500).selectExpr("if(id < 400, 'a', null) as k", "500 - id as v")
    placed = {(r["k"], r["p"]): r["v"] for r in with_position(
        df.repartition(7), ["k"], ["v"], "p").collect()}
    assert placed == {**{("a", i): 101 + i for i in range(400)}, **{(None, i): 1 + i for i in range(100)}}


def test_nest_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "k string, v int")
    nested = nest(df, ["k"], ["v"], [], "items")
    assert {r["k"]: [i["v"] for i in r["items"]] for r in nested.collect()} == {None: [1, 2],
                                                                               "a": [1]}


# -- facets and selections ----------------------------------------------------------

@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(
        [("030001", "001", "1/2"), ("030001", "002", "1/3"), ("030002", "001", "2/2"),
         ("030009", "001", "7")], "gemashl string, flr string, flsnrk string")


def test_facets_are_filtered_by_all_parts(spark, book):
    district = spark.createDataFrame([("030001", "A", "1"), ("030002", "B", "2"),
                                      ("030003", "C", "1")],
                                     "gemashl string, gemarkung string, gemshl string")
    towns = spark.createDataFrame([("1", "Stadt")], "gemshl string, gemname string")
    got = rows(facets.facet_values(book, district, towns, section="001", den="2"))
    assert got == [("den", "2", "2", 2), ("district", "030001", "A (030001, Stadt)", 1),
                   ("district", "030002", "B (030002)", 1), ("num", "1", "1", 1),
                   ("num", "2", "2", 1), ("section", "001", "001", 2)]
    assert [r[0] for r in rows(facets.used_districts(district, towns, book), "gemashl")] == [
        "030001", "030002"]
    assert facets.with_district_name(book, district).filter("gemarkung is null").count() == 1


@pytest.mark.parametrize("parts, n", [({"num": "1"}, 2), ({"num": "1", "den": "3"}, 1),
                                      ({"den": "2"}, 2), ({"district": ""}, 4), ({}, 4)])
def test_facet_filter(book, parts, n):
    assert facet_filter(book, **parts).count() == n


@pytest.mark.parametrize("threshold, run", [(5, True), (4, False), (1, False)])
def test_threshold(book, threshold, run):
    assert facets.facet_hits(book, threshold).first()["run"] is run
    n, result = selection.run_if_small(book, threshold, lambda df: df)
    assert (result is not None) is run and n == min(4, threshold)


def test_selection_algebra(spark, parcels):
    kept = spark.createDataFrame([("p1",), ("p2",)], "gml_id string")
    hits = spark.createDataFrame([("p2",), ("p3",), ("p3",)], "gml_id string")
    assert rows(selection.selection_add(kept, hits)) == [("p1",), ("p2",), ("p3",)]
    assert rows(selection.selection_remove(kept, hits)) == [("p1",)]
    assert rows(selection.selection_replace(kept, hits)) == [("p2",), ("p3",)]
    assert rows(selection.selection_clear(kept)) == []
    ids = lambda **how: [r[0] for r in rows(selection.select_parcels(parcels, **how), "gml_id")]
    assert ids(ids=["p1", "p4"]) == ["p1"]
    assert ids(ids=[f"p{i}" for i in range(500)]) == ["p1", "p2", "p3", "p5", "p6"]
    assert ids(where="flsnr in ('n2', 'n4')") == ["p2"]
    assert ids(subquery=hits) == ["p2", "p3"]
    with pytest.raises(ValueError):
        selection.select_parcels(parcels, ids=[], where="true")


def test_label_search(spark):
    labels = spark.createDataFrame([("Am Bach",), ("bach",), ("100%",)], "text string")
    assert label_search(labels, "BACH").count() == 2
    assert label_search(labels, "bach", partial=False).count() == 1
    assert label_search(labels, "").count() == 0
    assert label_search(labels, "0%").count() == 1
