"""Cadastral tables derived from generic business tables.

No real cadastral data can be shipped, so the registered queries let other tables
play the roles: parts are parcels, suppliers soil surveys, customers addresses and
presentation objects, nations styles and streets, line items holdings. Every view is
a projection of a whole base table and grows with it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parzelle.functions import geometry as G
from parzelle.operators.themes import SubLayer, Theme
from parzelle.session import materialize

ENDED = "timestamp '2020-01-01 00:00:00'"

VIEWS = {
    "parcel": ("part", f"""
        p_partkey as pid, 'DEXX' || lpad(cast(p_partkey as string), 12, '0') as gml_id,
        '03' || lpad(cast(p_size as string), 4, '0') as gemashl,
        lpad(cast(p_partkey % 7 + 1 as string), 3, '0') as flr,
        cast(p_partkey % 97 + 1 as string) || '/' || cast(p_partkey % 4 as string) as flsnrk,
        case when p_partkey % 11 = 0 then {ENDED} end as endet,
        case when p_partkey % 5 = 0 then 1 else 0 end as ff_stand,
        cast(p_partkey % 50 as double) * 10 as minx,
        cast(floor(p_partkey / 50) * 10 as double) as miny,
        cast(p_partkey % 50 as double) * 10 + 8 + p_partkey % 3 as maxx,
        cast(floor(p_partkey / 50) * 10 + 8 as double) as maxy"""),
    "district": ("part", """
        distinct '03' || lpad(cast(p_size as string), 4, '0') as gemashl,
        'Gemarkung ' || cast(p_size as string) as gemarkung,
        'G' || cast(p_size % 30 as string) as gemshl"""),
    "town_name": ("nation", """
        'G' || cast(n_nationkey as string) as gemshl, n_name as gemname"""),
    "soil": ("supplier", f"""
        s_suppkey as soil_id, cast(s_suppkey % 10 as double) * 50 + 5 as minx,
        cast(floor(s_suppkey / 10) * 40 + 3 as double) as miny,
        cast(s_suppkey % 10 as double) * 50 + 40 as maxx,
        cast(floor(s_suppkey / 10) * 40 + 33 as double) as maxy,
        cast(1000 + (s_suppkey % 4) * 1000 as int) as nutzungsart,
        case when s_suppkey % 9 = 0 then null
             else cast(s_suppkey % 60 + 20 as string) end as ackerzahl,
        case when s_suppkey % 7 = 0 then null
             else cast(s_suppkey % 50 + 30 as string) end as bodenzahl,
        array(cast(s_nationkey as int), cast(s_suppkey % 25 as int)) as entstehungsart,
        cast(s_suppkey % 6 as string) as klassifizierung,
        case when s_suppkey % 13 = 0 then {ENDED} end as endet"""),
    "point": ("events", """
        event_id, cast((event_id * 37) % 5000 as double) / 10 + 0.05 as x,
        cast(event_id as double) / 25 + 0.017 as y"""),
    "po": ("customer", """
        c_custkey as ogc_fid, 'DEPO' || lpad(cast(c_custkey as string), 12, '0') as gml_id,
        c_mktsegment as thema,
        case c_custkey % 4 when 0 then 'ax_flurstueck_nummer' when 1 then 'ax_flurstueck_flur'
             when 2 then 'ax_gebaeude' else 'ax_gebaeude_funktion' end as layer,
        cast(c_nationkey as string) as sn,
        array(case when c_custkey % 2 = 0 then 'DLKM' else 'DKKM1000' end,
              case when c_custkey % 3 = 0 then 'DKKM500' end) as modell,
        case when c_custkey % 6 = 0 then null
             else cast(c_custkey % 360 as double) end as drehwinkel_grad"""),
    "style": ("nation", """
        cast(n_nationkey as string) as signaturnummer, n_name as name, n_regionkey as farbe,
        cast(n_nationkey % 6 as int) as darstellungsprioritaet,
        cast(n_nationkey % 2 as int) as katalog"""),
    "color": ("region", """
        r_regionkey as id, cast(r_regionkey * 40 as string) || ' ' ||
        cast(r_regionkey * 20 as string) || ' 0' as umn"""),
    "street": ("nation", f"""
        '03' as land, '1' as regierungsbezirk, '51' as kreis,
        lpad(cast(n_regionkey as string), 3, '0') as gemeinde, n_nationkey as lage,
        'STREET_' || cast(n_nationkey % 10 as string) as bezeichnung,
        case when n_nationkey % 5 = 0 then 'K' end as kennung,
        lpad(cast(n_nationkey as string), 5, '0') as schluesselgesamt,
        case when n_nationkey % 8 = 7 then {ENDED} end as endet"""),
    "town": ("region", f"""
        '03' as land, '1' as regierungsbezirk, '51' as kreis,
        cast(r_regionkey as string) as gemeinde, r_name as bezeichnung,
        case when r_regionkey = 4 then {ENDED} end as endet"""),
    "address": ("customer", f"""
        'DEHN' || lpad(cast(c_custkey as string), 12, '0') as gml_id,
        '03' as land, '1' as regierungsbezirk, '51' as kreis,
        lpad(cast(c_nationkey % 5 as string), 3, '0') as gemeinde, c_nationkey as lage,
        cast(c_custkey % 120 + 1 as string) ||
        case when c_custkey % 7 = 0 then 'A' else '' end as hausnummer,
        case when c_custkey % 10 = 0
             then 'Frei ' || cast(c_custkey % 20 as string) end as unverschluesselt,
        case when c_custkey % 12 = 0 then {ENDED} end as endet"""),
    "plain_address": ("supplier", f"""
        'DEOH' || lpad(cast(s_suppkey as string), 12, '0') as gml_id,
        '03' as land, '1' as regierungsbezirk, '51' as kreis,
        lpad(cast(s_nationkey % 5 as string), 3, '0') as gemeinde, s_nationkey as lage,
        case when s_suppkey % 8 = 0
             then 'Weg ' || cast(s_suppkey % 16 as string) end as unverschluesselt,
        case when s_suppkey % 12 = 0 then {ENDED} end as endet"""),
    "holding": ("lineitem", """
        cast(l_partkey as string) as flsnr, cast(l_orderkey as string) as bestdnr,
        l_returnflag as b, cast(l_linenumber as string) as bvnr,
        cast(l_suppkey as string) as auftlnr, 0 as ff_stand"""),
    "folio": ("orders", """
        cast(o_orderkey as string) as bestdnr, o_orderstatus as gbbz,
        cast(o_custkey as string) as gbblnr, o_orderpriority as bestfl,
        case when o_orderkey % 7 = 0 then 1 else 0 end as ff_stand"""),
    "stroke": ("lineitem", """
        cast(l_orderkey as string) as sn, l_linenumber as stroke,
        cast(l_linenumber % 3 as double) as laenge, l_quantity / 100 as einzug,
        chr(123) || '100,200' || chr(125) as abstand, l_discount as strichstaerke"""),
    "label": ("documents", """
        doc_id, text, cast(doc_id % 300 as double) * 10 as x,
        cast(doc_id % 200 as double) * 5 as y, cast(doc_id % 25 as string) as signaturnummer,
        case when doc_id % 4 = 0 then null else 1 + doc_id % 3 end as skalierung,
        case when doc_id % 5 = 0 then 'linksbündig' when doc_id % 5 = 1 then 'rechtsbündig'
             end as horizontaleausrichtung,
        case when doc_id % 3 = 0 then 'oben' when doc_id % 3 = 1 then 'Basis'
             end as vertikaleausrichtung,
        cast(doc_id % 3 as double) * 0.5 as fontsperrung,
        cast(doc_id % 360 as double) as drehwinkel_grad"""),
    "font": ("nation", """
        cast(n_nationkey as string) as signaturnummer, n_regionkey as farbe,
        case when n_nationkey % 6 = 0 then null else 'Arial' end as art,
        case n_nationkey % 4 when 0 then 'Kursiv' when 1 then 'Fett' when 2 then 'Fett, Kursiv'
             end as stil,
        case when n_nationkey % 7 = 0 then 'schatten' end as effekt,
        cast(case when n_nationkey % 8 = 0 then -n_nationkey - 1
                  else n_nationkey + 4 end as double) as grad_pt,
        case when n_nationkey % 3 = 0 then 10D end as sperrung_pt,
        'zentrisch' as horizontaleausrichtung,
        case when n_nationkey % 2 = 0 then 'oben' else 'Mitte' end as vertikaleausrichtung,
        cast(n_nationkey % 2 as int) as katalog"""),
}


@lru_cache(maxsize=64)
def base(spark: SparkSession, path: str) -> DataFrame:
    """A base table; its schema is read from the files once per session."""
    return spark.read.parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in table; only the base columns behind it are read."""
    table, select = VIEWS[name]
    return spark.sql(f"select {select} from {{base}}", base=base(spark, f"{sf_dir}/{table}.parquet"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with number, key, box, geometry and address links."""
    df = view(spark, sf_dir, "parcel")
    return (df.withColumn("alb_key", F.expr("gemashl || '-' || flr || '-' || flsnrk"))
            .withColumn("flsnr", F.col("alb_key"))
            .withColumn("flurstueckskennzeichen", F.expr(
                "gemashl || flr || lpad(split_part(flsnrk, '/', 1), 5, '0') ||"
                " case when pid % 4 = 0 then '____' else"
                " lpad(split_part(flsnrk, '/', 2), 4, '0') end || '__'"))
            .withColumn("geom", F.expr(G.box_rings("minx", "miny", "maxx", "maxy")))
            .withColumn("weistauf", F.expr(
                "array('DEHN' || lpad(cast((pid * 3) div 4 as string), 12, '0'),"
                " 'DEHN' || lpad(cast(pid div 2 as string), 12, '0'))"))
            .withColumn("zeigtauf", F.expr(
                "array('DEOH' || lpad(cast(pid div 20 as string), 12, '0'))")))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soil surveys with geometry."""
    return view(spark, sf_dir, "soil").withColumn(
        "geom", F.expr(G.box_rings("minx", "miny", "maxx", "maxy")))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight drawn outlines; every order is a corner of one of them."""
    orders = base(spark, f"{sf_dir}/orders.parquet")
    corners = orders.selectExpr(
        "o_custkey % 8 as outline_id", "o_orderkey", "90 + cast(o_totalprice as bigint) % 97 / 5D as radius",
        "2 * pi() * row_number() over (partition by o_custkey % 8 order by o_orderkey)"
        " / count(*) over (partition by o_custkey % 8) as angle")
    rings = corners.selectExpr(
        "outline_id", "o_orderkey", "named_struct('x', round(60 * outline_id + radius * cos(angle), 3),"
        " 'y', round(100 + radius * sin(angle), 3)) as corner").groupBy("outline_id").agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "corner"))).alias("ring"))
    # every join reads them several times
    return materialize(rings.selectExpr("outline_id", "transform(ring, r -> r.corner) as ring").selectExpr(
        "outline_id", "array(concat(ring, array(ring[0]))) as geom"), "outlines")


def point_rings(x: str, y: str) -> str:
    return f"array(array(named_struct('x', {x}, 'y', {y})))"


def objects(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four presentation tables, all from the same base rows."""
    po = view(spark, sf_dir, "po")
    place = point_rings("cast(ogc_fid % 100 as double)", "cast(ogc_fid % 70 as double)")
    return {
        "po_polygons": po.withColumnsRenamed({"sn": "sn_flaeche"})
            .withColumn("sn_randlinie", F.col("sn_flaeche"))
            .withColumn("polygon", F.expr(f"if(ogc_fid % 9 = 0, null, {place})")),
        "po_lines": po.withColumnRenamed("sn", "signaturnummer")
            .withColumn("line", F.expr(f"if(ogc_fid % 8 = 0, null, {place})")),
        "po_points": po.withColumnRenamed("sn", "signaturnummer")
            .withColumn("point", F.expr(f"if(ogc_fid % 5 = 0, null, {place})")),
        "po_labels": po.withColumnRenamed("sn", "signaturnummer")
            .withColumn("point", F.expr(f"if(ogc_fid % 3 = 0, {place}, null)"))
            .withColumn("line", F.expr(f"if(ogc_fid % 3 = 1, {place}, null)")),
    }


# Theme settings of the stand-ins: scale ranges, one open bound, one override.
THEMES = [
    Theme("AUTOMOBILE", {k: (0, 5000) for k in ("area", "outline", "line", "point", "label")}, (
        SubLayer("Nummern", "layer in ('ax_flurstueck_nummer')"),
        SubLayer("Flächen", "layer not in ('ax_flurstueck_nummer')",
                 {"area": (0, 20000), "label": (1000, None)})),
        {"3": "Grenze", "7": "Mauer"}),
    Theme("BUILDING", {"area": (0, 10000), "outline": (0, 3500), "line": (0, 3500),
                       "point": (0, 3500), "label": (0, 3500)}, (
        SubLayer("Gebäude", "layer like 'ax_gebaeude%'"),
        SubLayer("Funktion", "layer = 'ax_gebaeude_funktion'"),
        SubLayer("Sonstige", "layer not like 'ax_gebaeude%'")), {"1": "Haus"}),
    Theme("MACHINERY", {"area": (0, None), "outline": (0, None), "line": (0, 10000),
                        "point": (0, 5000), "label": (0, None)}),
]
