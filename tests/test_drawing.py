import pytest
from conftest import rows
from pyspark.sql import functions as F

from parzelle.functions import geometry as G
from parzelle.operators import labels as LB
from parzelle.operators import layers as L
from parzelle.operators import styles as S
from parzelle.operators import themes as T
from parzelle.operators.predicates import in_models
from parzelle.plans.drawing import drawing_tables

THEMES = T.load_themes("""[
  {"name": "Flur", "scales": {"area": [0, 5000], "label": [0, null]},
   "sublayers": [{"name": "Nr", "rule": "layer in ('nummer')", "scales": {"area": [0, 100]}},
                 {"name": "Rest", "rule": "layer not like 'num%'"},
                 {"name": "All", "rule": "layer = 'x' or layer = 'nummer'"}],
   "labels": {"1": "Eins"}},
  {"name": "Haus", "scales": {"point": [10, 20]}}]""")


def test_rules_route_to_every_matching_sublayer(spark):
    df = spark.createDataFrame([(1, "Flur", "nummer"), (2, "Flur", "x"), (3, "Haus", "y"),
                                (4, "Weg", "x"), (5, "Flur", None)],
                               "id int, thema string, layer string")
    assert rows(T.assign_sublayer(df, THEMES), "id", "sublayer") == [
        (1, "All"), (1, "Nr"), (2, "All"), (2, "Rest"), (3, "")]
    assert T.assign_sublayer(df, []).count() == 0


def test_scales_and_overrides(spark):
    table = T.theme_table(spark, THEMES)
    at = lambda scale: {(r["theme"], r["sublayer"], r["kind"])
                        for r in T.visible_at(table, scale).collect()}
    assert ("Flur", "Nr", "area") in at(100) and ("Flur", "Nr", "area") not in at(101)
    assert ("Flur", "Rest", "area") in at(5000) and ("Flur", "Rest", "area") not in at(5001)
    assert ("Flur", "Nr", "label") in at(10**9)
    assert ("Haus", "", "point") not in at(9) and ("Haus", "", "point") in at(10)


def test_models(spark):
    df = spark.createDataFrame([(1, ["A", None]), (2, ["B"]), (3, None), (4, [None])],
                               "id int, modell array<string>")
    assert rows(in_models(df, ["A", "C"]), "id") == [(1,)]
    assert in_models(df, []).count() == 4
    assert rows(L.model_inventory([df, df])) == [("A", 2), ("B", 2)]
    pre = spark.createDataFrame([("Z", 9), (None, 3)], "modell string, n int")
    assert rows(L.model_inventory([df], pre)) == [("Z", 9)]


def test_colors_and_labels(spark):
    df = spark.createDataFrame([("1 2 3",), (None,), ("",)], "c string")
    assert [tuple(r[0]) for r in df.select(S.parse_color(F.col("c"))).collect()] == [
        (1, 2, 3), (0, 0, 0), (0, 0, 0)]
    styles = spark.createDataFrame([("Flur", "1", "n"), ("Flur", "2", "n"), ("Flur", "3", None)],
                                   "theme string, sn string, name string")
    classes = T.class_table(spark, THEMES)
    assert rows(S.with_label(styles, classes, "name"), "label") == [("(3)",), ("Eins",), ("n",)]
    assert rows(S.with_label(styles, classes), "label") == [("(2)",), ("(3)",), ("Eins",)]


def _strokes(spark, data):
    return spark.createDataFrame(
        [(sn, i, "Abgeschnitten", "Rund", w, length, indent, gaps, 1, 2, 3)
         for i, (sn, w, length, indent, gaps) in enumerate(data)],
        "sn string, stroke int, abschluss string, scheitel string, strichstaerke double,"
        " laenge double, einzug double, gaps array<double>, r int, g int, b int")


def test_line_style_check(spark):
    strokes = _strokes(spark, [
        ("ok", 1.0, 2.0, 0.5, [1.0]), ("ok", -3.0, 0.0, 0.7, [3.0]),
        ("long", 1.0, 2.0, 0.0, [1.0]), ("long", 1.0, 2.0, 0.0, [2.0]),
        ("lead", 1.0, 2.0, 0.0, [1.0]), ("lead", 1.0, 1.0, 0.5, [2.0]),
        ("plain", 0.5, 0.0, 0.0, [])])
    got = {r["sn"]: r for r in S.line_style_check(strokes).collect()}
    assert got["ok"]["same_length"] and got["ok"]["same_indent"] and got["ok"]["widest"] == -3.0
    assert got["ok"]["lead"] == 0.5 and got["ok"]["total"] == 3.0
    assert not got["long"]["same_length"]
    assert got["lead"]["same_length"] and not got["lead"]["same_indent"]
    assert got["plain"]["same_length"] and got["plain"]["lead"] is None


def test_stroke_symbols(spark):
    strokes = _strokes(spark, [
        ("m", 1.0, 2.0, 0.5, [1.0, 2.0]),   # dashes: 2 1 2 2, total 7
        ("m", -0.5, 0.0, 0.2, [3.0, 4.0]),  # markers, indent before the lead: wraps
        ("n", 1.0, 0.0, 2.0, [1.0, 1.0]),   # markers without a dashed stroke
        ("s", 1.0, 0.0, 0.0, [])])
    drawn = S.stroke_symbols(strokes, S.line_style_check(strokes))
    pick = lambda sn, shape: sorted(
        (r["part"], r["offset"], r["interval"], r["dashes"], r["width"], r["unit"])
        for r in drawn.filter(f"sn = '{sn}' and shape = '{shape}'").collect())
    assert pick("m", "line") == [(1, None, None, [2.0, 1.0, 2.0, 2.0], 1.0, "map")]
    markers = pick("m", "marker")
    assert [m[0] for m in markers] == [1, 2]
    assert [m[1] for m in markers] == pytest.approx([6.7, 9.7])
    assert markers[0][2:] == (7.0, None, 0.5, "millimetre")
    assert [m[1] for m in pick("n", "marker")] == [2.0, 3.0]
    assert pick("s", "line") == [(1, None, None, None, 1.0, "map")]
    assert pick("m", "blank")[0][4] == pytest.approx(1.01)
    caps = {(r["cap"], r["join"]) for r in drawn.filter("shape = 'line'").collect()}
    assert caps == {("flat", "round")}
    assert S.stroke_symbols(strokes, S.line_style_check(strokes), outline=True) \
        .filter("shape = 'blank'").count() == 0


def test_gaps(spark):
    df = spark.createDataFrame([("{100,250}",), ("150",), (None,), ("{}",)], "a string")
    assert [r[0] for r in df.select(S.parse_gaps(F.col("a"))).collect()] == [
        [1.0, 2.5], [1.5], [], []]


def test_symbols_prefer_catalog_then_extents(spark):
    used = spark.createDataFrame([("t", "", "1"), ("t", "", "2"), ("t", "", "3"), ("t", "", "6000")],
                                 "theme string, sublayer string, sn string")
    symbols = spark.createDataFrame([("1", 1, 0.0, 0.0, 4.0, 2.0), ("2", 2, 0.0, 0.0, 4.0, 2.0)],
                                    "signaturnummer string, katalog int, x0 double, y0 double,"
                                    " x1 double, y1 double")
    extents = spark.createDataFrame([("1", 9.0, 9.0, 9.0, 9.0), ("2", -1.0, -1.0, 2.0, 1.0)],
                                    "sn string, minx double, miny double, maxx double, maxy double")
    got = {r["sn"]: r for r in S.symbol_geometry(used, symbols, extents).collect()}
    assert (got["1"]["cx"], got["1"]["width"], got["1"]["anchor_x"]) == (2.0, 4.0, 1.0)
    assert (got["2"]["cx"], got["2"]["width"], got["2"]["offset_x"]) == (0.5, 3.0, -0.5)
    assert (got["3"]["cx"], got["3"]["width"], got["3"]["height"]) == (0.0, 1.0, 1.0)
    assert rows(S.missing_symbols(used, symbols.withColumnRenamed("signaturnummer", "sn"))) == [
        ("3",)]


def _fonts(spark):
    fonts = spark.createDataFrame(
        [("1", 1, "Times", "Fett, Kursiv", "schatten", 10.0, 4.0, "linksbündig", "oben", 1),
         ("2", 1, None, None, None, -7.0, None, None, None, 1),
         ("3", 9, "Arial", "Kursiv", None, 8.0, None, None, "Basis", 2)],
        "signaturnummer string, farbe int, art string, stil string, effekt string,"
        " grad_pt double, sperrung_pt double, horizontaleausrichtung string,"
        " vertikaleausrichtung string, katalog int")
    colors = spark.createDataFrame([(1, "255 0 9")], "id int, umn string")
    labels = spark.createDataFrame(
        [(1, "1", 2.0, 0.5, "rechtsbündig", None, 30.0), (2, "2", None, 0.0, None, None, 0.0),
         (3, "3", None, None, None, None, None), (4, "9", None, None, None, None, None)],
        "id int, signaturnummer string, skalierung double, fontsperrung double,"
        " horizontaleausrichtung string, vertikaleausrichtung string, drehwinkel_grad double")
    return labels, fonts, colors


def test_screen_labels(spark):
    got = {r["id"]: r for r in LB.screen_labels(*_fonts(spark), ["id"]).collect()}
    one = got[1]
    assert one["tsize"] == pytest.approx(0.25 * 2 * 10 * 1.3225)
    assert (one["halign"], one["valign"], one["placement"]) == ("Right", "Cap", "AL")
    assert (one["italic"], one["bold"], one["spacing"], one["tcolor"]) == (1, 1, 1.0, "255,0,9")
    assert one["rotation"] == -30.0
    two = got[2]
    assert (two["tsize"], two["tunit"], two["tshow"], two["family"]) == (7.0, "Point", 0, "Arial")
    assert (got[3]["valign"], got[3]["tcolor"], got[3]["placement"]) == ("Base", None, "BL")
    assert (got[4]["tsize"], got[4]["tunit"], got[4]["halign"]) == (None, "MapUnit", "Center")
    chosen = {r["id"]: r for r in LB.screen_labels(*_fonts(spark), ["id"], 2).collect()}
    assert chosen[1]["tsize"] is None and chosen[3]["tsize"] is not None


def test_server_labels(spark):
    labels, fonts, colors = _fonts(spark)
    got = {r["id"]: r for r in LB.server_labels(labels, fonts, colors, ["id"]).collect()}
    assert set(got) == {1, 2}
    assert got[1]["font_umn"] == "times-schatten-bold-italic-2"
    assert got[1]["size_umn"] == pytest.approx(0.25 / 0.0254 * 2 * 10)
    assert got[1]["position_umn"] == "LR" and got[2]["position_umn"] == "CC"
    line = labels.withColumn("line", F.expr("array(named_struct('x', 0D, 'y', 0D),"
                                            " named_struct('x', 10D, 'y', 0D))"))
    moved = LB.server_labels(line, fonts, colors, ["id"], line="line").filter("id = 1").first()
    assert [tuple(p) for p in moved["geom"]] == [(0.0, 2.5), (10.0, 2.5)]


def test_draw_order(spark):
    data = [("line", 5, 0), ("polygon", 7, 1), ("point", None, 2), ("polygon", 2, 3),
            ("point", 999, 4), ("raster", 1, 5), ("polygon", 2, 6), ("line", None, 7),
            ("annotation", 0, 8)]
    df = spark.createDataFrame(data, "type string, zindex int, position int")
    got = [r["position"] for r in L.draw_order(df).orderBy("draw_index").collect()]
    assert got == [5, 3, 6, 1, 7, 0, 2, 4, 8]
    assert sorted(r["draw_index"] for r in L.draw_order(df).collect()) == list(range(9))


def test_priority_is_cut_and_keeps_zero(spark):
    styles = spark.createDataFrame([("t", "", 0), ("t", "", 3), ("t", "", 4)],
                                   "theme string, sublayer string, priority int")
    assert rows(S.style_priority(styles)) == [("t", "", 3, 2, 0, 4)]


def test_drawing_tables(spark):
    ring = "array(array(named_struct('x', 0D, 'y', 0D)))"
    base = spark.createDataFrame(
        [(1, "Flur", "nummer", ["A"], "1"), (2, "Flur", "x", ["B"], "2"),
         (3, "Haus", "y", ["A"], None), (4, "Haus", "y", ["A"], "")],
        "ogc_fid int, thema string, layer string, modell array<string>, signaturnummer string") \
        .withColumns({"gml_id": F.col("ogc_fid").cast("string"), "drehwinkel_grad": F.lit(10.0),
                      "point": F.expr(ring), "line": F.expr(ring), "polygon": F.expr(ring),
                      "sn_flaeche": F.col("signaturnummer"),
                      "sn_randlinie": F.col("signaturnummer")})
    style = spark.createDataFrame([("1", "eins", 1, 5, 1), ("2", "zwei", 9, 1, 1)],
                                  "signaturnummer string, name string, farbe int,"
                                  " darstellungsprioritaet int, katalog int")
    tables = {f"po_{k}": base for k in ("polygons", "lines", "points")}
    tables |= {
        "po_labels": base.withColumn("line", F.expr("if(ogc_fid < 3, line, null)"))
        .withColumn("point", F.expr("if(ogc_fid = 4, point, null)")),
        "style_fill": style, "style_line": style,
        "line_def": style.select("signaturnummer", "katalog", "farbe", F.lit("s").alias("strichart"),
                                 F.lit(1.0).alias("strichstaerke"), F.lit("").alias("abschluss"),
                                 F.lit("").alias("scheitel")),
        "stroke_member": spark.createDataFrame([("s", 1)], "stricharten string, strichart int"),
        "stroke": spark.createDataFrame([(1, 100.0, 0.0, "{100}")],
                                        "id int, laenge double, einzug double, abstand string"),
        "color": spark.createDataFrame([(1, "1 2 3", 1, 2, 3)],
                                       "id int, umn string, r int, g int, b int"),
        "symbol": spark.createDataFrame([], "signaturnummer string, katalog int, x0 double,"
                                        " y0 double, x1 double, y1 double")}
    made = drawing_tables(tables, THEMES, ["A", "B"], catalog_id=-1)
    manifest = {(r["theme"], r["sublayer"], r["kind"]): r for r in made["manifest"].collect()}
    assert set(manifest) == {
        ("Flur", s, k) for s, kinds in {
            "Nr": ("area", "outline", "line", "point", "label"),
            # style 2 has no colour: no area, and no stroke to draw a line with
            "Rest": ("point", "label"),
            "All": ("area", "outline", "line", "point", "label")}.items()
        for k in kinds} | {("Haus", "", "label")}
    assert manifest["Flur", "All", "area"]["features"] == 2
    assert manifest["Flur", "All", "area"]["classes"] == 1
    assert manifest["Flur", "Nr", "area"]["max_scale"] == 100.0
    assert manifest["Flur", "Nr", "label"]["zindex"] == 999
    assert manifest["Flur", "Nr", "point"]["group"] == "Flur / Nr"
    assert manifest["Haus", "", "label"]["group"] == "Haus"
    assert made["outline"].filter("sublayer = 'Rest'").count() == 0
    assert made["extract"].filter("kind = 'point'").agg(F.max("rotation")).first()[0] == -10.0
    export = drawing_tables(tables, THEMES, [], catalog_id=1, negate_rotation=False)
    assert export["extract"].filter("kind = 'point'").agg(F.max("rotation")).first()[0] == 10.0
    assert export["line_strokes"].filter("sn = '1' and shape = 'line'").first()["dashes"] == [
        1.0, 1.0]


def test_label_hits(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (5.0, 9.0, False)], "x double, y double, p boolean")
    geom = "array(array(named_struct('x', x, 'y', y)))"
    labels = df.selectExpr(f"if(p, {geom}, null) as point", f"if(p, null, {geom}) as line")
    assert rows(LB.label_hits(labels)) == [(2, 1.0, 2.0, 5.0, 9.0)]
    assert G.x("p") == "p.x" and G.y("p") == "p.y"


def test_lines_without_strokes_are_solid_those_without_colour_are_none(spark):
    line_def = spark.createDataFrame(
        [("1", 1, "A", "x", "y", 25.0, 1), ("2", 1, "A", "x", "y", 25.0, None),
         ("3", 1, "none", "x", "y", 25.0, 1), ("4", 1, "B", "x", "y", 25.0, 1)],
        "signaturnummer string, katalog int, strichart string, abschluss string, scheitel string,"
        " strichstaerke double, farbe int")
    member = spark.createDataFrame([("A", 7), ("B", 7), ("B", 99)], "stricharten string, strichart int")
    stroke = spark.createDataFrame([(7, 100.0, 0.0, "100")],
                                   "id int, laenge double, einzug double, abstand string")
    colors = spark.createDataFrame([(1, "1 2 3")], "id int, umn string").selectExpr(
        "id", "umn", "1 as r", "2 as g", "3 as b")
    strokes = S.line_strokes(None, line_def, member, stroke, colors, 1)
    check = S.line_style_check(strokes)
    assert {(r["sn"], r["stroke"]) for r in strokes.collect()} == {
        ("1", 7), ("3", None), ("4", 7), ("4", 99)}
    # stroke 99 isn't defined: it is solid and doesn't fit the dashes beside it
    assert {r["sn"]: r["same_length"] for r in check.collect()} == {"1": True, "3": True, "4": False}
    solid = S.stroke_symbols(strokes, check).filter("sn = '3' and shape = 'line'").collect()
    assert [(r["width"], r["dashes"], r["cap"]) for r in solid] == [(0.25, None, "round")]
    # without style and catalogue the caller has the colour
    plain = S.line_strokes(None, line_def, member, stroke, colors, -1)
    assert {(r["sn"], r["r"]) for r in plain.collect()} == {(n, None) for n in "1234"}
