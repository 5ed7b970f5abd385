import datetime as dt
import os
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from parzelle import registry
from parzelle import standins as V
from parzelle.functions import geometry as G
from parzelle.operators import owners
from parzelle.operators.selection import extent_of
from parzelle.plans import report as R
from parzelle.sources import audit, export
from parzelle.sources import tables as S

SF = Path("/root/testdata/sf0.001")


def test_read_tables(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "Alt").write.parquet(str(tmp_path / "phys.parquet"))
    spark.range(2).write.orc(str(tmp_path / "other"))
    source = S.Source("parquet", str(tmp_path), names={"book": "phys"},
                      columns={"book": {"Alt": "neu"}})
    got = S.read_tables(spark, source, ["book", "none"])
    assert list(got) == ["book"] and got["book"].columns == ["neu"]
    assert S.optional(got, "book") and S.optional(got, "book", "none") is None
    with pytest.raises(Exception):
        S.read_tables(spark, source, [], required=["none"])
    assert S.read_tables(spark, S.Source("orc", str(tmp_path)), ["other"])["other"].count() == 2


def test_read_catalog_tables(spark):
    spark.range(4).createOrReplaceTempView("cadastre_view")
    spark.sql("create database if not exists cadastre_test")
    got = S.read_tables(spark, S.Source("catalog", "cadastre_test"), ["nothing"])
    assert got == {}


def test_only_absent_tables_are_optional():
    assert S._is_missing(RuntimeError('ERROR: relation "x" does not exist'))
    assert S._is_missing(RuntimeError("ERROR: permission denied for table eigner"))
    assert not S._is_missing(RuntimeError("Connection refused"))


def test_columns_and_defaults(spark):
    df = spark.range(1)
    assert S.has_columns(df, "ID") and not S.has_columns(df, "id", "x")
    assert S.with_default(df, "x").first()["x"] == ""
    assert S.with_default(df, "id").first()["id"] == 0


def test_srid_and_projection(spark):
    df = spark.createDataFrame([(None,), (25832,), (25832,)], "srid int")
    assert rows(S.srid_of(df)) == [(25832,)]
    srs = spark.createDataFrame([(25832, "x"), (100001, "+proj=tmerc")], "srid int, proj4text string")
    ids = spark.createDataFrame([(25832,), (100001,), (100002,)], "srid int")
    assert rows(S.proj_text(ids, srs)) == [(25832, "init=epsg:25832"), (100001, "+proj=tmerc"),
                                           (100002, None)]


def test_data_currency(spark):
    df = spark.createDataFrame([("2023-12-31T23:00:00Z",), ("2024-03-05T01:02:03Z",), ("bad",)],
                               "datadate string")
    assert S.data_currency(df).first()["datum"] == "Stand: 5. März 2024"
    today = S.data_currency(df.filter("false")).first()["datum"]
    assert str(dt.datetime.now(dt.timezone.utc).year) in today and "Stand" not in today


def test_style_catalogs(spark):
    assert rows(S.style_catalogs(spark, None)) == [(-1, "Farbe")]
    df = spark.createDataFrame([("2", "b"), ("1", "a")], "id string, name string")
    assert rows(S.style_catalogs(spark, df)) == [(1, "a"), (2, "b")]


def test_messages(spark, tmp_path):
    df = spark.createDataFrame([("n2",), ("n1",), ("n3",)], "flsnr string")
    made = export.parcel_messages(df, ["flsnr"], "P#K")
    assert rows(made, "message") == [("P#K#n1#1#",), ("P#K#n2#1#",), ("P#K#n3#0#",)]
    export.write_messages(made, str(tmp_path / "m"), ["flsnr"])
    lines = [line for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part")
             for line in (tmp_path / "m" / f).read_text().splitlines()]
    assert lines == ["P#K#n1#1#", "P#K#n2#1#", "P#K#n3#0#"]
    assert rows(export.single_message(df, "P"), "message")[0] == ("P#n1#",)


def test_extent(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 2.0, 3.0), ("b", 5.0, 5.0, 6.0, 9.0)],
                               "gml_id string, minx double, miny double, maxx double, maxy double")
    assert rows(extent_of(df)) == [(0.0, 1.0, 6.0, 9.0, 2)]
    assert rows(extent_of(df, df.filter("gml_id = 'a'"))) == [(0.0, 1.0, 2.0, 3.0, 1)]


# -- audit ----------------------------------------------------------------------

def found(spark, n):
    return spark.range(n).select(F.format_string("n%05d", "id").alias("flsnr"))


def test_released_after_record(spark, tmp_path):
    log = str(tmp_path / "log")
    got = audit.release_with_audit(found(spark, 3), log, "u", "eigentuemerSuche", "meier", "AZ 1")
    assert got.count() == 3
    entry = spark.read.parquet(log).first()
    assert (entry["username"], entry["requestType"], entry["search"], entry["aktenzeichen"]) == (
        "u", "eigentuemerSuche", "meier", "AZ 1")
    assert entry["result"] == ["n00000", "n00001", "n00002"]
    audit.release_with_audit(found(spark, 0), log, "u", "t", "s")
    assert spark.read.parquet(log).count() == 2
    assert spark.read.parquet(log).filter("search = 's'").first()["result"] == []


def test_large_result_is_recorded_in_parts(spark, tmp_path):
    log = str(tmp_path / "log")
    audit.release_with_audit(found(spark, 2500), log, "u", "t", "s")
    entries = spark.read.parquet(log).collect()
    assert {e["parts"] for e in entries} == {3} and sorted(e["part"] for e in entries) == [0, 1, 2]
    assert len({e["request_id"] for e in entries}) == 1
    assert sorted(n for e in entries for n in e["result"]) == [f"n{i:05d}" for i in range(2500)]


def test_result_is_withheld(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("in the way")
    with pytest.raises(audit.ReleaseRefused):
        audit.release_with_audit(found(spark, 3), str(blocked / "log"), "u", "t", "s")
    with pytest.raises(audit.ReleaseRefused):
        audit.release_with_audit(found(spark, 3), str(tmp_path / "l"), "u", "t", "s",
                                 case_required=True)
    assert not (tmp_path / "l").exists()
    assert audit.release_with_audit(found(spark, 3), None, "u", "t", "s").count() == 3


def test_failed_attempts_are_not_recorded(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    whole = audit._Log.append

    def failing(self, rows):
        # the sink takes some of the parts and breaks off
        whole(self, rows.filter("part = 0") if "part" in rows.columns else rows)
        raise OSError("disk full")
    monkeypatch.setattr(audit._Log, "append", failing)
    with pytest.raises(audit.ReleaseRefused):
        audit.release_with_audit(found(spark, 2500), log, "u", "t", "s", request="r1")
    assert spark.read.parquet(log).count() == 1 and audit.recorded(spark, log) is None
    # a sink that loses parts without saying so
    monkeypatch.setattr(audit._Log, "append",
                        lambda self, rows: whole(self, rows.filter("part < 2") if "part" in rows.columns else rows))
    with pytest.raises(audit.ReleaseRefused):
        audit.release_with_audit(found(spark, 2500), log, "u", "t", "s", request="r1")
    assert audit.recorded(spark, log) is None
    monkeypatch.setattr(audit._Log, "append", whole)
    for _ in range(2):
        assert audit.release_with_audit(found(spark, 2500), log, "u", "t", "s", request="r1").count() == 2500
    entries = audit.recorded(spark, log).collect()
    assert sorted(e["part"] for e in entries) == [0, 1, 2]
    assert sorted(n for e in entries for n in e["result"]) == [f"n{i:05d}" for i in range(2500)]
    assert spark.read.parquet(log + "_commits").count() == 1
    with pytest.raises(audit.ReleaseRefused):
        audit.release_with_audit(found(spark, 2501), log, "u", "t", "s", request="r1")


# -- report ---------------------------------------------------------------------

SQUARE = "POLYGON((0 0,10 0,10 10,0 10,0 0))"


@pytest.fixture(scope="module")
def tables(spark):
    def t(schema, *data):
        return spark.createDataFrame(list(data), schema)
    geom = f"{G.from_wkt('w')} as geom"
    return {
        "flurst": t("flsnr string, gemashl string, flr string, flsnrk string, ff_stand int,"
                    " flsfl string, lagebez string, anl_verm string, blbnr string",
                    ("n1", "g1", "001", "1/0", 0, "100", "A & B", "", None),
                    ("n2", "g1", "001", "2/0", 0, "50", None, None, "77"),
                    ("twice", "g1", "001", "3/0", 0, "1", None, None, None),
                    ("twice", "g1", "001", "3/0", 0, "1", None, None, None),
                    ("old", "g1", "001", "4/0", 1, "1", None, None, None)),
        "gema_shl": t("gemashl string, gemarkung string", ("g1", "Mark")),
        "fs": t("fs_obj string, alb_key string", ("A" * 16, "n1")),
        "parcel": t("gml_id string, flsnr string, w string, endet timestamp",
                    ("A" * 16, "n1", SQUARE, None),
                    ("B" * 16, "n2", "POLYGON((20 0,30 0,30 10,20 10,20 0))", None))
        .selectExpr("gml_id", "flsnr", geom, "endet"),
        "strassen": t("flsnr string, strshl string, hausnr string, ff_stand int",
                      ("n1", "1", "10", 0), ("n1", "1", "9", 0), ("n1", "1", "1", 1),
                      ("twice", "1", "4", 0)),
        "str_shl": t("strshl string, strname string", ("1", "Ring<b>")),
        "nutz_21": t("flsnr string, nutzsl string, fl string, ff_stand int", ("n1", "u", "60", 0)),
        "nutz_shl": t("nutzshl string, nutzung string", ("u", "Wald")),
        "soil": t("soil_id string, w string, ackerzahl string, nutzungsart int, endet timestamp",
                  ("s1", "POLYGON((0 0,10 0,10 5,0 5,0 0))", "40", 1000, None),
                  ("s2", "POLYGON((0 5,10 5,10 9,0 9,0 5))", "60", 3000, None))
        .selectExpr("soil_id", geom, "ackerzahl", "nutzungsart", "endet"),
        "ausfst": t("flsnr string, ausf_st string, ff_stand int", ("n1", "a", 0)),
        "afst_shl": t("ausf_st string, afst_txt string", ("a", "Amt")),
        "eignerart": t("flsnr string, bestdnr string, b string, bvnr string, auftlnr string,"
                       " ff_stand int", ("n1", "03B", "X", "1", "1", 0),
                       ("n1", "03A", "X", "1", "1", 1), ("n2", "03C", "X", "1", "1", 0)),
        "bestand": t("bestdnr string, gbbz string, gbblnr string, bestfl string, ff_stand int",
                     ("03A", "b", "1", "", 0), ("03B", "b", "2", "", 0), ("03C", "b", "3", "", 0)),
        "eign_shl": t("b string, eignerart string", ("X", "Art")),
        "eigner": t("bestdnr string, name1 string, name2 string, namensnr string, antverh string,"
                    " ff_stand int", ("03B", "Zoe", "", "2", "1/2", 0), ("03B", "Ada", "", "1", "1/2", 0),
                    ("03A", "Old", "", None, "", 0)),
        "imports": t("datadate string", ("2024-03-05T01:02:03Z",)),
    }


def test_report_covers_unique_current_parcels(tables):
    blocks = R.report_blocks(tables)
    assert rows(blocks["master"], "flsnr", "gemarkung") == [("n1", "Mark"), ("n2", "Mark")]
    assert rows(blocks["streets"], "flsnr", "num_key") == [("n1", 9), ("n1", 10)]
    assert rows(blocks["yield"], "flsnr", "emz") == [("n1", 44)]
    assert rows(blocks["soil"], "fl") == [(40,), (50,)]
    assert "valuation" not in blocks


def document(df, flsnr):
    part = df.filter(F.col("flsnr") == flsnr).orderBy(*R.ORDER)
    return "\n".join(r["html"] for r in part.collect())


def test_document(tables):
    lines = R.parcel_report(tables, footnote="Fuß & Note")
    html = document(lines, "n1")
    order = ["Flurstücksnachweis g1-001-1/0", "Stand: 5. März 2024", "Mark", "100&nbsp;m&sup2;",
             "A &amp; B", "Straßen", "<td>Ring&lt;b&gt;</td><td>9</td>",
             "<td>Ring&lt;b&gt;</td><td>10</td>", "Wald (u)", "Ackerzahl 40", "Grünlandzahl 60",
             "Gesamtertragsmesszahl 44", "Amt", "Bestände", "03B", "Ada", "Zoe", "03A", "Old",
             "Fuß &amp; Note"]
    places = [html.find(o) for o in order]
    assert -1 not in places and places == sorted(places)
    assert html.count("<table>") == html.count("</table>")
    other = document(lines, "n2")
    assert "Keine" in other and "Kein Eigentümer gefunden." in other and "77" in other
    assert "Straßen" not in other and "Gesamtertragsmesszahl" not in other


def test_documents_are_folded_in_chunks(tables):
    lines = R.parcel_report(tables)
    nested = R.report_documents(lines)
    assert [(r["flsnr"], r["chunk"]) for r in nested.orderBy("flsnr").collect()] == [
        ("n1", 0), ("n2", 0)]
    whole = nested.filter("flsnr = 'n1'").first()["html"]
    assert document(lines, "n1") in whole
    parts = R.report_documents(lines, chunk=4).filter("flsnr = 'n1'").orderBy("chunk").collect()
    assert len(parts) > 2 and "".join(r["html"] for r in parts) == whole


def test_report_without_imports_bears_today(tables):
    lines = R.parcel_report({k: v for k, v in tables.items() if k != "imports"})
    years = {str(dt.date.today().year - 1), str(dt.date.today().year), str(dt.date.today().year + 1)}
    head = lines.filter("section = 0").first()["html"]
    assert any(f" {y}</small>" in head for y in years)


def test_parcel_of_a_district_listed_twice_has_no_report(spark, tables):
    twice = tables["gema_shl"].union(tables["gema_shl"])
    assert R.master_data({**tables, "gema_shl": twice}).count() == 0
    assert R.master_data(tables).count() == 2


def test_report_of_ids_and_numbers(spark, tables):
    asked = spark.createDataFrame([("A" * 16,), ("n2",), ("Z" * 16,), ("old",)], "arg string")
    wanted = R.resolve_numbers(asked, tables["fs"])
    assert rows(wanted) == [("n1",), ("n2",), ("old",)]
    assert rows(R.report_blocks(tables, wanted)["master"], "flsnr") == [("n1",), ("n2",)]
    assert rows(R.report_blocks(tables, wanted.filter("flsnr = 'n2'"))["landuse"]) == []


def test_optional_sections(tables):
    few = {k: tables[k] for k in ("flurst", "gema_shl")}
    assert set(R.report_blocks(few)) == {"master"}
    assert "Flurstücksnachweis" in document(R.parcel_report(few), "n1")


def test_owner_at_points(spark, tables, tmp_path):
    points = spark.createDataFrame([("q", 5.0, 5.0), ("r", 500.0, 5.0)],
                                   "point_id string, x double, y double")
    log = str(tmp_path / "log")
    lines = R.owner_at_points(tables, points, "u", log, "POINT(5.000 5.000)")
    assert {r["flsnr"] for r in lines.select("flsnr").distinct().collect()} == {"n1"}
    entry = spark.read.parquet(log).first()
    assert entry["requestType"] == "eigentuemerInfo" and entry["result"] == ["n1"]


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_registered_owner_queries_look_up_every_point(spark):
    points = [(round(r["x"], 3), round(r["y"], 3)) for r in V.view(spark, str(SF), "point").collect()]
    hit = [r for r in V.view(spark, str(SF), "parcel").collect() if r["endet"] is None and any(
        r["minx"] < x < r["maxx"] and r["miny"] < y < r["maxy"] for x, y in points)]
    assert rows(registry.QUERIES["owner_audit_log"](spark, str(SF)), "flsnr") == sorted(
        (str(r["pid"]),) for r in hit)
    assert rows(registry.QUERIES["owner_at_points"](spark, str(SF)), "flsnr", "gemashl") == sorted(
        (str(r["pid"]), r["gemashl"]) for r in hit if r["ff_stand"] == 0)


def test_owner_search_is_recorded(spark, tables, tmp_path):
    log = str(tmp_path / "log")
    assert rows(R.owner_search(tables, "ada", "u", log), "flsnr") == [("n1",)]
    assert spark.read.parquet(log).first()["result"] == ["n1"]


def test_write_reports(tables, tmp_path):
    lines = R.parcel_report(tables)
    export.write_reports(lines, str(tmp_path / "r"), R.ORDER)
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "r" / "gemashl=g1").glob("part*")))
    assert text.index("1/0") < text.index("2/0") and "Kein Eigentümer gefunden." in text
    export.write_reports(lines, str(tmp_path / "p"), R.ORDER, fmt="parquet")
    assert (tmp_path / "p" / "gemashl=g1").exists()


def test_kinds_of_holdings_deal_out_no_rows(spark):
    """Three kinds, whose size the planner doesn't know: rows must not be dealt out by kind."""
    art = spark.range(100).selectExpr("cast(id as string) as flsnr", "cast(id % 9 as string) as bestdnr", "'B' || id % 3 as b",
                                      "'1' as bvnr", "'1' as auftlnr", "0 as ff_stand")
    folio = spark.range(9).selectExpr("cast(id as string) as bestdnr", "'1' as gbbz", "'1' as gbblnr", "'1' as bestfl",
                                      "0 as ff_stand")
    kinds = spark.createDataFrame(spark.sparkContext.parallelize([(f"B{i}", f"Art {i}") for i in range(2)]),
                                  "b string, eignerart string")
    found = owners.holdings(art, folio, kinds)
    assert "hashpartitioning(b#" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("eignerart").count().orderBy("eignerart").collect() == [(None, 33), ("Art 0", 34), ("Art 1", 33)]
