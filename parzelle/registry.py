"""The registered queries: every operator on the stand-in tables, over whole tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parzelle import standins as V
from parzelle.functions import crs, numbers, text, wkb
from parzelle.functions import geometry as G
from parzelle.operators import addresses as A
from parzelle.operators import facets, owners, selection, soil
from parzelle.operators import labels as LB
from parzelle.operators import layers as L
from parzelle.operators import predicates as P
from parzelle.operators import searches as SE
from parzelle.operators import spatial as S
from parzelle.operators import styles as ST
from parzelle.operators import themes as T
from parzelle.plans import drawing, report
from parzelle.session import shared_dir
from parzelle.sources import audit, export, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _base(spark, sf, name) -> DataFrame:
    return V.base(spark, f"{sf}/{name}.parquet")


def _fs(parcels: DataFrame) -> DataFrame:
    return parcels.select(F.col("gml_id").alias("fs_obj"), "alb_key")


# -- sources and metadata -------------------------------------------------------

@query
def read_current_parcels(spark, sf):
    source = tables.Source("parquet", sf, names={"book": "part"},
                           columns={"book": {"p_partkey": "pid", "p_name": "lagebez"}})
    found = tables.read_tables(spark, source, ["book", "no_such_table"], required=["book"])
    if tables.optional(found, "no_such_table") is not None:
        raise RuntimeError("a table that isn't there was found")
    book = tables.with_default(found["book"], "anl_verm")
    return book.select("pid", "lagebez", "anl_verm",
                       F.lit(tables.has_columns(book, "flurknr")).alias("has_map_no"))


@query
def text_values(spark, sf):
    rows = V.view(spark, sf, "address").select("gml_id", "unverschluesselt", "endet")
    return text.as_text(rows, "gml_id", "unverschluesselt").select("gml_id", "unverschluesselt")


@query
def data_currency(spark, sf):
    # every event stands for one import
    imports = _base(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datadate"))
    return tables.data_currency(imports)


@query
def style_catalogs(spark, sf):
    catalogs = _base(spark, sf, "customer").select(
        F.col("c_nationkey").alias("id"), F.concat(F.lit("Katalog "), "c_nationkey").alias("name"))
    return tables.style_catalogs(spark, catalogs.distinct())


@query
def reference_systems(spark, sf):
    srids = V.parcels(spark, sf).select((F.col("pid") % 3 * 50_000 + 25832).alias("srid")).distinct()
    known = _base(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 3 * 50_000 + 25832).alias("srid"),
        F.lit("+proj=utm +zone=32").alias("proj4text")).distinct()
    return tables.proj_text(srids, known)


# -- filters ------------------------------------------------------------------

@query
def current_rows(spark, sf):
    return P.current(V.parcels(spark, sf)).select("gml_id", "flsnr")


@query
def current_book_rows(spark, sf):
    return P.current_book(V.parcels(spark, sf)).select("gml_id", "flsnr")


@query
def select_ids(spark, sf):
    ids = [f"DEXX{i:012d}" for i in (3, 11, 14, 15, 92, 3)]
    return selection.select_parcels(V.parcels(spark, sf), ids=ids).select("gml_id", "flsnr")


@query
def select_where(spark, sf):
    found = selection.select_parcels(V.parcels(spark, sf),
                                     where="flr = '003' and gemashl like '0300%'")
    return found.select("gml_id", "flsnr")


@query
def select_subquery(spark, sf):
    held = V.view(spark, sf, "holding").filter("b = 'A'") \
        .selectExpr("'DEXX' || lpad(flsnr, 12, '0') as gml_id")
    return selection.select_parcels(V.parcels(spark, sf), subquery=held).select("gml_id", "flsnr")


@query
def in_models(spark, sf):
    found = P.in_models(P.in_theme(V.view(spark, sf, "po"), "BUILDING"), ["DKKM500", "DLKM"])
    return P.has_value(found, "drehwinkel_grad").select("ogc_fid", "layer", "drehwinkel_grad")


@query
def visible_at_scale(spark, sf):
    extract = L.layer_extract(V.THEMES, (), **_kinds(spark, sf))
    layers = (extract.groupBy("theme", "sublayer", "kind").agg(F.count(F.lit(1)).alias("features"))
              .join(T.theme_table(spark, V.THEMES), ["theme", "sublayer", "kind"]))
    return T.visible_at(layers, 4000.0).select("theme", "sublayer", "kind", "features")


@query
def label_search_partial(spark, sf):
    return P.label_search(V.view(spark, sf, "label"), "Que").select("doc_id", "x", "y")


@query
def label_search_exact(spark, sf):
    labels = V.view(spark, sf, "po").withColumn("text", F.col("layer"))
    return P.label_search(labels, "ax_gebaeude", partial=False).select("ogc_fid", "text")


@query
def label_hits(spark, sf):
    labels = V.view(spark, sf, "label").withColumns({
        "point": F.expr(f"if(doc_id % 3 = 0, null, {V.point_rings('x', 'y')})"),
        "line": F.expr(f"if(doc_id % 3 = 0, {V.point_rings('x + 1', 'y + 2')}, null)")})
    return LB.label_hits(P.label_search(labels, "Que"))


@query
def parcels_by_parts(spark, sf):
    parcels = V.parcels(spark, sf)
    return P.parcels_by_parts(parcels, _fs(parcels), section="004", den="3") \
        .select("gml_id", "flsnr")


@query
def parcels_by_prefix(spark, sf):
    parcels = V.parcels(spark, sf)
    return P.parcels_by_parts(parcels, _fs(parcels), district="030007") \
        .select("gml_id", "flsnr")


@query
def parcels_by_number(spark, sf):
    return P.parcels_by_number(V.parcels(spark, sf), "30007-12").select("gml_id", "flsnr")


@query
def facet_filter(spark, sf):
    return P.facet_filter(V.parcels(spark, sf), section="002", den="3").select("gml_id", "flsnr")


# -- tables of searches ---------------------------------------------------------

@query
def label_searches(spark, sf):
    searches = _base(spark, sf, "benchmark").selectExpr("item_id as search_id", "substr(text, 1, 12) as term") \
        .union(_base(spark, sf, "nation").selectExpr("1000000 + n_nationkey", "left(n_name, 2)"))
    return SE.labels_by_terms(V.view(spark, sf, "label"), searches).select("search_id", "doc_id")


@query
def street_searches(spark, sf):
    searches = _base(spark, sf, "supplier").selectExpr(
        "s_suppkey as search_id", "if(s_suppkey % 2 = 0, 'Street_' || cast(s_nationkey % 10 as string),"
        " 'fr' || left('ei 1', s_suppkey % 5)) as prefix")
    return SE.texts_beginning(street_directory(spark, sf), "street", searches)


@query
def owner_searches(spark, sf):
    r = _register(spark, sf)
    searches = _base(spark, sf, "supplier").selectExpr(
        "s_suppkey as search_id", "'CUSTOMER  ' || lpad(cast(s_suppkey as string), 4, '0') as terms")
    return SE.parcels_by_owners(r["parcel"], r["fs"], r["eignerart"], r["eigner"], searches)


@query
def typed_address_searches(spark, sf):
    a = _addresses(spark, sf)
    searches = _base(spark, sf, "supplier").selectExpr(
        "s_suppkey as search_id", "case s_suppkey % 4 when 0 then 'keine Nummer' when 1 then 'Frei  ' else"
        " 'street_' || left(cast(s_nationkey as string), s_suppkey % 2) end || ' ' ||"
        " cast(s_suppkey % 120 + 1 as string) || if(s_suppkey % 7 = 0, 'a', '') as typed")
    return SE.parcels_by_typed_addresses(V.parcels(spark, sf), a["catalog"], a["numbered"], searches)


@query
def typed_number_searches(spark, sf):
    searches = _base(spark, sf, "orders").selectExpr(
        "o_orderkey as search_id", "'Nr. ' || cast(30000 + o_custkey % 51 as string) || if(o_orderkey % 3 = 0,"
        " '-' || cast(o_orderkey % 8 as string), '') || '-' || cast(o_orderkey % 97 + 1 as string) ||"
        " if(o_orderkey % 2 = 0, '/' || cast(o_orderkey % 4 as string), '') as typed")
    return SE.parcels_by_numbers(V.parcels(spark, sf), searches).select("search_id", "gml_id", "flsnr")


@query
def part_set_searches(spark, sf):
    parcels = V.parcels(spark, sf)
    searches = _base(spark, sf, "supplier").selectExpr(
        "s_suppkey as search_id", "if(s_suppkey % 2 = 0, '03' || lpad(cast(s_suppkey % 50 as string), 4, '0'), null)"
        " as district", "if(s_suppkey % 3 = 0, lpad(cast(s_suppkey % 7 + 1 as string), 3, '0'), '') as section",
        "if(s_suppkey % 5 = 0, cast(s_suppkey % 97 + 1 as string), null) as num",
        "if(s_suppkey % 7 = 0, cast(s_suppkey % 4 as string), '') as den")
    return SE.parcels_by_part_sets(parcels, _fs(parcels), searches).select("search_id", "gml_id", "flsnr")


# -- parcel numbers -------------------------------------------------------------

@query
def parcel_keys(spark, sf):
    n, d = numbers.num(F.col("flsnrk")), numbers.den(F.col("flsnrk"))
    return V.parcels(spark, sf).select(
        "gml_id", numbers.parcel_number(F.col("gemashl"), F.col("flr"), n, d).alias("number"),
        numbers.parcel_key(F.col("gemashl"), F.col("flr"), n, d).alias("parcel_key"),
        numbers.number_from_key(F.col("flurstueckskennzeichen")).alias("from_key"))


@query
def parcel_number_of(spark, sf):
    # an id has as many numbers as its part has line items
    fs = V.view(spark, sf, "holding").selectExpr(
        "'DEXX' || lpad(flsnr, 12, '0') as fs_obj", "bestdnr as alb_key")
    parcels = V.parcels(spark, sf)
    ids = parcels.select("gml_id").union(parcels.selectExpr("'DE' || cast(pid as string)"))
    return selection.parcel_number_of(ids, fs)


@query
def parcel_messages(spark, sf):
    parcels = P.current(V.parcels(spark, sf))
    return export.parcel_messages(parcels, ["flsnr", "gml_id"], "REGISTER#ALBKEY")


# -- selections and extents -----------------------------------------------------

def _kept(parcels: DataFrame) -> DataFrame:
    return parcels.filter("gemashl < '030020'").select("gml_id")


def _hits(parcels: DataFrame) -> DataFrame:
    return P.current(parcels).filter("flr in ('002', '005')").select("gml_id")


@query
def selection_add(spark, sf):
    parcels = V.parcels(spark, sf)
    return selection.selection_add(_kept(parcels), _hits(parcels))


@query
def selection_remove(spark, sf):
    parcels = V.parcels(spark, sf)
    return selection.selection_remove(_kept(parcels), _hits(parcels))


@query
def selection_replace(spark, sf):
    parcels = V.parcels(spark, sf)
    return selection.selection_replace(_kept(parcels), _hits(parcels))


@query
def extent_all(spark, sf):
    return selection.extent_of(V.parcels(spark, sf))


@query
def extent_selection(spark, sf):
    parcels = V.parcels(spark, sf)
    return selection.extent_of(parcels, _kept(parcels))


@query
def box_text(spark, sf):
    boxes = V.parcels(spark, sf).groupBy("gemashl").agg(F.struct(
        *[F.min(c).alias(c) for c in ("minx", "miny")],
        *[F.max(c).alias(c) for c in ("maxx", "maxy")]).alias("box"))
    shown = boxes.selectExpr("gemashl", f"{G.box_text('box')} as box_text")
    return shown.selectExpr("gemashl", "box_text", f"{G.parse_box('box_text')}.maxx as maxx")


# -- facets -------------------------------------------------------------------

@query
def facet_values(spark, sf):
    return facets.facet_values(V.parcels(spark, sf), V.view(spark, sf, "district"),
                               V.view(spark, sf, "town_name"), section="003", den="1")


@query
def facet_hits(spark, sf):
    return facets.facet_hits(V.parcels(spark, sf), section="003", den="1")


@query
def used_districts(spark, sf):
    return facets.used_districts(V.view(spark, sf, "district"), V.view(spark, sf, "town_name"),
                                 V.parcels(spark, sf), num="12")


@query
def parcel_districts(spark, sf):
    named = facets.with_district_name(V.parcels(spark, sf), V.view(spark, sf, "district"))
    return named.select("gml_id", "gemarkung")


# -- streets and addresses --------------------------------------------------------

def _addresses(spark, sf) -> dict[str, DataFrame]:
    return {"catalog": V.view(spark, sf, "street"), "numbered": V.view(spark, sf, "address"),
            "plain": V.view(spark, sf, "plain_address")}


@query
def street_directory(spark, sf):
    return A.street_directory(**_addresses(spark, sf), town=V.view(spark, sf, "town"))


@query
def street_directory_prefix(spark, sf):
    return A.street_directory(**_addresses(spark, sf), town=V.view(spark, sf, "town"),
                              prefix="Street_3")


@query
def street_key_lists(spark, sf):
    return A.street_key_lists(**_addresses(spark, sf), town=V.view(spark, sf, "town"))


@query
def house_number_choices(spark, sf):
    a = _addresses(spark, sf)
    return A.house_number_choices(a["numbered"], a["plain"], ["lage"])


@query
def house_numbers_by_key(spark, sf):
    a = _addresses(spark, sf)
    return A.house_numbers_by_key(a["catalog"], a["numbered"], a["plain"])


@query
def house_number_ranks(spark, sf):
    """The order of the choices, as a number that a check can see."""
    a = _addresses(spark, sf)
    choices = A.house_numbers_by_key(a["catalog"], a["numbered"], a["plain"]) \
        .filter(F.col("choice") != A.ALL).distinct()
    order = Window.partitionBy("schluesselgesamt").orderBy(
        "rank", F.asc_nulls_last("num_key"), "choice")
    return choices.select("schluesselgesamt", "choice", F.row_number().over(order).alias("place"))


@query
def free_house_numbers(spark, sf):
    a = _addresses(spark, sf)
    return A.house_number_choices(a["numbered"], a["plain"], ["unverschluesselt"])


@query
def parcel_streets(spark, sf):
    strassen = V.view(spark, sf, "address").selectExpr(
        "gml_id as flsnr", "lage as strshl", "hausnummer as hausnr",
        "case when endet is null then 0 else 1 end as ff_stand")
    names = V.view(spark, sf, "street").selectExpr("lage as strshl", "bezeichnung as strname")
    return A.parcel_streets(strassen, names)


@query
def split_addresses(spark, sf):
    typed = V.view(spark, sf, "address").selectExpr(
        "gml_id", "case when lage % 4 = 0 then 'Am Ring' else 'Am Ring ' || lower(hausnummer) end"
        " as typed")
    return typed.withColumn("s", text.split_address(F.col("typed"))) \
        .select("gml_id", "s.street", "s.number")


@query
def parcels_at_address(spark, sf):
    addresses_ = V.view(spark, sf, "address").filter("unverschluesselt is not null")
    return A.parcels_at_address(V.parcels(spark, sf), addresses_, "weistauf")


@query
def parcels_by_typed_address(spark, sf):
    a = _addresses(spark, sf)
    return A.parcels_by_typed_address(V.parcels(spark, sf), a["catalog"], a["numbered"],
                                      "street_ 15a")


@query
def parcels_by_street(spark, sf):
    return A.parcels_by_address(V.parcels(spark, sf), **_addresses(spark, sf), number=A.ALL,
                                key="00003")


@query
def parcels_by_free_street(spark, sf):
    return A.parcels_by_address(V.parcels(spark, sf), **_addresses(spark, sf), number=A.WITHOUT,
                                street="Weg 8")


# -- owners and holdings ----------------------------------------------------------

def _register(spark, sf) -> dict[str, DataFrame]:
    """Register tables; parcel numbers are part keys, folios orders, owners customers."""
    parcels = V.parcels(spark, sf)
    owner = V.view(spark, sf, "folio").join(
        _base(spark, sf, "customer").selectExpr("cast(c_custkey as string) as gbblnr",
                                                "c_name", "c_nationkey"), "gbblnr")
    return {
        "parcel": parcels.withColumn("flsnr", F.col("pid").cast("string")),
        "fs": parcels.select(F.col("gml_id").alias("fs_obj"),
                             F.col("pid").cast("string").alias("alb_key")),
        "eignerart": V.view(spark, sf, "holding"),
        "bestand": V.view(spark, sf, "folio"),
        "eign_shl": _base(spark, sf, "lineitem").selectExpr(
            "l_returnflag as b", "'Art ' || l_returnflag as eignerart").distinct(),
        "eigner": owner.selectExpr("bestdnr", "c_name as name1", "null as name2",
                                   "nullif(cast(c_nationkey as string), '7') as namensnr",
                                   "'1/2' as antverh", "ff_stand"),
    }


@query
def parcels_by_owner(spark, sf):
    r = _register(spark, sf)
    return owners.parcels_by_owner(r["parcel"], r["fs"], r["eignerart"], r["eigner"],
                                   "customer 00011").select("gml_id", "flsnr")


@query
def owner_search_with_audit(spark, sf):
    log = shared_dir(spark, "audit")
    return report.owner_search(_register(spark, sf), "customer 00011", "tester", log)


@query
def holdings(spark, sf):
    r = _register(spark, sf)
    court = owners.courts(*_courts(spark, sf))
    rows = owners.holdings(r["eignerart"], r["bestand"], r["eign_shl"], court)
    return rows.select("flsnr", "bestdnr", "b", "bvnr", "auftlnr", "anteil", "zhist", "bhist",
                       "gbbz", "gbblnr", "bestfl", "eignerart", "bezeichnung")


def _courts(spark, sf) -> tuple[DataFrame, DataFrame]:
    districts = _base(spark, sf, "orders").selectExpr(
        "o_orderstatus as bezirk", "substr(cast(o_orderkey as string), 1, 2) as land",
        "substr(cast(o_orderkey as string), 1, 1) as gehoertzu_land",
        "cast(o_custkey % 40 as string) as gehoertzu_stelle")
    offices = _base(spark, sf, "customer").selectExpr(
        "cast(c_custkey as string) as schluesselgesamt",
        "case when c_custkey % 3 = 0 then '1000' else '1200' end as stellenart",
        "c_name as bezeichnung")
    return districts, offices


@query
def court_lookup(spark, sf):
    return owners.courts(*_courts(spark, sf))


@query
def nested_owners(spark, sf):
    return owners.nested_owners(_register(spark, sf)["eigner"], chunk=2).selectExpr(
        "bestdnr", "chunk", "array_join(transform(owners, o -> concat(o.owner_key, ':', o.name1)),"
        " ';') as owners")


# -- layers and styles --------------------------------------------------------------

def _kinds(spark, sf) -> dict[str, DataFrame]:
    return {name[3:]: df for name, df in V.objects(spark, sf).items()}


@query
def model_inventory(spark, sf):
    return L.model_inventory(list(V.objects(spark, sf).values()))


@query
def sublayer_routing(spark, sf):
    return T.assign_sublayer(V.view(spark, sf, "po"), V.THEMES) \
        .select("ogc_fid", "thema", "sublayer")


@query
def sublayer_filter(spark, sf):
    return T.sublayer(V.view(spark, sf, "po"), "layer not like 'ax_flurstueck%'") \
        .select("ogc_fid", "layer")


@query
def layer_extract(spark, sf):
    return L.layer_extract(V.THEMES, ["DLKM"], **_kinds(spark, sf)).selectExpr(
        "theme", "sublayer", "kind", "ogc_fid", "gml_id", "layer", "sn", "rotation",
        f"{G.bbox('geom')}.minx as x")


def _styles(spark, sf) -> dict[str, DataFrame]:
    style, color = V.view(spark, sf, "style"), V.view(spark, sf, "color")
    rgb = color.withColumn("c", ST.parse_color(F.col("umn"))).select("id", "umn", "c.*")
    # the definitions repeat the style key for the second catalogue, every third has no colour,
    # every seventh no strokes (a solid line)
    line_def = style.selectExpr(
        "signaturnummer", "katalog", "if(cast(signaturnummer as int) % 3 = 0, 99, farbe) as farbe",
        "if(cast(signaturnummer as int) % 7 = 4, null,"
        " 'S' || cast(cast(signaturnummer as int) % 4 as string)) as strichart",
        "cast(cast(signaturnummer as int) - 5 as double) as strichstaerke",
        "if(cast(signaturnummer as int) % 2 = 0, 'Abgeschnitten', 'Rund') as abschluss",
        "if(cast(signaturnummer as int) % 5 = 0, 'Spitz', 'Rund') as scheitel")
    strokes = _base(spark, sf, "part").selectExpr(
        "p_partkey % 8 as id", "cast(p_partkey % 2 * 100 as double) as laenge",
        "cast(50 as double) as einzug",
        "if(p_partkey % 2 = 0, chr(123) || '150,150' || chr(125), '200') as abstand").distinct()
    members = strokes.selectExpr("'S' || cast(id % 4 as string) as stricharten",
                                 "id as strichart")
    symbol = style.selectExpr("signaturnummer", "katalog", "-1D as x0", "-2D as y0",
                              "cast(darstellungsprioritaet as double) as x1", "3D as y1")
    return {"style_fill": style, "style_line": style, "line_def": line_def, "color": rgb,
            "stroke": strokes, "stroke_member": members, "symbol": symbol}


def _used(spark, sf, name: str, sn: str) -> DataFrame:
    return ST.usage(T.assign_sublayer(V.objects(spark, sf)[name], V.THEMES), sn)


@query
def styles_in_use(spark, sf):
    po = T.sublayer(P.in_theme(V.view(spark, sf, "po"), "BUILDING"), "layer = 'ax_gebaeude'")
    return ST.styles_in_use(V.view(spark, sf, "style"), po, "signaturnummer", "sn")


@query
def fill_styles(spark, sf):
    t = _styles(spark, sf)
    return ST.fill_styles(_used(spark, sf, "po_polygons", "sn_flaeche"), t["style_fill"],
                          t["color"], T.class_table(spark, V.THEMES), 1)


@query
def outline_styles(spark, sf):
    t = _styles(spark, sf)
    return ST.outline_styles(_used(spark, sf, "po_polygons", "sn_randlinie"), t["style_line"],
                             t["line_def"], t["color"], T.class_table(spark, V.THEMES), 1)


@query
def line_styles(spark, sf):
    t = _styles(spark, sf)
    return ST.line_styles(_used(spark, sf, "po_lines", "signaturnummer"), t["style_line"],
                          t["line_def"], t["color"], T.class_table(spark, V.THEMES), 0)


@query
def style_priority(spark, sf):
    return ST.style_priority(fill_styles(spark, sf))


@query
def line_strokes(spark, sf):
    t = _styles(spark, sf)
    rows = ST.line_strokes(t["style_line"], t["line_def"], t["stroke_member"], t["stroke"],
                           t["color"], 1)
    return rows.withColumn("gaps", F.concat_ws(",", F.transform(
        "gaps", lambda g: F.format_string("%.2f", g))))


@query
def line_style_check(spark, sf):
    return ST.line_style_check(_order_strokes(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("total", "lead", "widest")})


def _order_strokes(spark, sf) -> DataFrame:
    return V.view(spark, sf, "stroke").select(
        "sn", "stroke", F.lit("Abgeschnitten").alias("abschluss"), F.lit("Spitz").alias("scheitel"),
        "strichstaerke", "laenge", "einzug", ST.parse_gaps(F.col("abstand")).alias("gaps"),
        F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))


@query
def dash_offsets(spark, sf):
    strokes = _order_strokes(spark, sf)
    drawn = ST.stroke_symbols(strokes, ST.line_style_check(strokes))
    return drawn.select("sn", F.col("stroke").cast("int").alias("stroke"), "shape", "part", "unit",
                        "cap", "join", F.round("width", 6).alias("width"),
                        F.concat_ws(",", F.transform("dashes", lambda d: F.format_string(
                            "%.2f", d))).alias("dashes"),
                        F.round("interval", 6).alias("interval"),
                        F.round("offset", 6).alias("offset"))


def _extents(spark, sf) -> DataFrame:
    return _base(spark, sf, "supplier").selectExpr(
        "cast(s_suppkey % 20 as string) as sn", "-0.5D as minx", "-0.25D as miny", "1.5D as maxx",
        "cast(s_suppkey % 20 as double) as maxy").distinct()


@query
def symbol_geometry(spark, sf):
    used = _used(spark, sf, "po_points", "signaturnummer")
    rows = ST.symbol_geometry(used, _styles(spark, sf)["symbol"], _extents(spark, sf))
    return rows.select("theme", "sublayer", "sn", "cx", "cy", "width", "height",
                       F.round("anchor_x", 6).alias("anchor_x"),
                       F.round("anchor_y", 6).alias("anchor_y"), "offset_x", "offset_y")


@query
def point_styles(spark, sf):
    used = _used(spark, sf, "po_points", "signaturnummer")
    rows = ST.point_styles(used, _styles(spark, sf)["symbol"], _extents(spark, sf),
                           T.class_table(spark, V.THEMES))
    return rows.select("theme", "sublayer", "sn", "label")


@query
def missing_symbols(spark, sf):
    used = _used(spark, sf, "po_points", "signaturnummer")
    have = _base(spark, sf, "supplier").filter("s_acctbal > 9000") \
        .selectExpr("cast(s_nationkey as string) as sn").distinct()
    return ST.missing_symbols(used, have)


def _drawing(spark, sf) -> dict[str, DataFrame]:
    return drawing.drawing_tables({**V.objects(spark, sf), **_styles(spark, sf)}, V.THEMES, (), 1)


@query
def layer_manifest(spark, sf):
    return _drawing(spark, sf)["manifest"].select(
        "theme", "sublayer", "kind", "features", "classes", "zindex", "min_priority",
        "max_priority", "min_scale", "max_scale", "title", "group")


@query
def draw_order(spark, sf):
    return _drawing(spark, sf)["manifest"].select("theme", "sublayer", "kind", "type",
                                                  F.col("draw_index").cast("int")
                                                  .alias("draw_index"))


@query
def label_style_screen(spark, sf):
    rows = LB.screen_labels(V.view(spark, sf, "label"), V.view(spark, sf, "font"),
                            V.view(spark, sf, "color"), ["doc_id"], 1)
    return rows.withColumns({c: F.round(c, 6) for c in ("tsize", "spacing")})


@query
def label_style_server(spark, sf):
    rows = LB.server_labels(V.view(spark, sf, "label"), V.view(spark, sf, "font"),
                            V.view(spark, sf, "color"), ["doc_id"])
    return rows.withColumn("size_umn", F.round("size_umn", 6))


@query
def label_offset_lines(spark, sf):
    corner = ("array(named_struct('x', x, 'y', y), named_struct('x', x + 50, 'y', y),"
              " named_struct('x', x + 50, 'y', y + 80))")
    labels = V.view(spark, sf, "label").withColumn("line", F.expr(corner))
    moved = LB.server_labels(labels, V.view(spark, sf, "font"), V.view(spark, sf, "color"),
                             ["doc_id"], line="line")
    return moved.selectExpr("doc_id", *[f"round({at(f'geom[{i}]')}, 6) as {name}{i}"
                                        for i in range(3) for name, at in (("x", G.x), ("y", G.y))])


# -- geometry -----------------------------------------------------------------

@query
def geometry_measures(spark, sf):
    shaped = V.parcels(spark, sf).selectExpr("gml_id", f"{G.wkt_polygon('geom')} as wkt")
    parsed = shaped.selectExpr("gml_id", "wkt", f"{G.from_wkt('wkt')} as geom")
    return parsed.selectExpr("gml_id", "wkt", f"{G.area('geom')} as area",
                             f"{G.bbox('geom')}.minx as minx", f"{G.bbox('geom')}.maxy as maxy")


@query
def points_in_parcels(spark, sf):
    return S.points_in_parcels(V.view(spark, sf, "point"), P.current(V.parcels(spark, sf)),
                               "event_id", "pid")


@query
def geometry_from_database(spark, sf):
    """Geometry as a database hands it out, in either byte order."""
    # a small file of many rows would be read, and its geometry written and parsed, by few tasks
    stored = V.parcels(spark, sf).repartition("gml_id").selectExpr("gml_id", f"""if(pid % 2 = 0, {wkb.to_wkb('geom', '25832')},
        {wkb.to_wkb('geom', '25833', big=True)}) as wkb_geometry""")
    parsed = tables.with_geometry(stored, "wkb_geometry")
    return parsed.selectExpr("gml_id", "srid", f"{G.area('geom')} as area", "minx", "maxy")


@query
def points_in_two_systems(spark, sf):
    """Points and parcels, some of either stored with and some without the zone's number."""
    parcels = P.current(V.parcels(spark, sf)).selectExpr(
        "pid", "if(pid % 2 = 0, 25832, 4647) as srid",
        "if(pid % 2 = 0, 500000D, 32500000D) as shift", "minx", "miny", "maxx", "maxy").selectExpr(
        "pid", "srid", G.box_rings("minx + shift", "miny + 5800000", "maxx + shift", "maxy + 5800000") + " as geom")
    points = V.view(spark, sf, "point").selectExpr(
        "event_id", "if(event_id % 3 = 0, 4647, 25832) as srid",
        "x + if(event_id % 3 = 0, 32500000D, 500000D) as x", "y + 5800000 as y")
    return S.points_in_parcels(points, parcels, "event_id", "pid")


@query
def parcels_touching(spark, sf):
    # the drawn areas are the survey outlines
    return S.parcels_touching(V.surveys(spark, sf), P.current(V.parcels(spark, sf)),
                              "soil_id", "pid")


@query
def large_outline_overlay(spark, sf):
    """Outlines of thousands of corners against all parcels."""
    shared = S.overlay(V.outlines(spark, sf), P.current(V.parcels(spark, sf)), "outline_id", "pid")
    return shared.filter("shared > 0.01").select("outline_id", "pid", F.round("shared", 1).alias("shared"))


@query
def large_outline_points(spark, sf):
    return S.points_in_parcels(V.view(spark, sf, "point"), V.outlines(spark, sf), "event_id", "outline_id")


@query
def overlay_area(spark, sf):
    shared = soil.parcel_soil(V.parcels(spark, sf), V.surveys(spark, sf), "pid")
    return shared.select("pid", "soil_id", F.round("shared", 6).alias("shared"))


@query
def yield_index(spark, sf):
    shared = soil.parcel_soil(V.parcels(spark, sf), V.surveys(spark, sf), "pid")
    return soil.yield_index(shared, "pid")


def _codes(spark, sf) -> DataFrame:
    return _base(spark, sf, "supplier").selectExpr(
        "s_nationkey as wert", "'Art ' || cast(s_nationkey as string) as beschreibung").distinct()


@query
def soil_description(spark, sf):
    surveys = V.surveys(spark, sf)
    uses = surveys.selectExpr("nutzungsart as wert",
                              "'Nutzung ' || cast(nutzungsart as string) as beschreibung") \
        .filter("wert < 4000").distinct()
    shared = soil.parcel_soil(V.parcels(spark, sf), surveys, "pid")
    rows = soil.soil_description(shared, surveys, {"nutzungsart": uses,
                                                   "entstehungsart": _codes(spark, sf)})
    return rows.select("pid", "soil_id", "klf_text", "fl")


@query
def valuation_text(spark, sf):
    surveys = V.surveys(spark, sf).withColumn(
        "klassifizierung", F.nullif("klassifizierung", F.lit("5")))
    codes = _codes(spark, sf).filter("wert < 3")
    return soil.valuation(V.parcels(spark, sf), surveys, codes, "pid", "soil_id")


@query
def reproject_zone(spark, sf):
    moved = V.view(spark, sf, "point").withColumn(
        "p", crs.reproject(F.struct((F.col("x") + 500_000).alias("x"),
                                    (F.col("y") + 5_800_000).alias("y")), 25832, 4647))
    return moved.selectExpr("event_id", "round(p.x, 6) as x", "round(p.y, 6) as y")


@query
def reproject_degrees(spark, sf):
    moved = V.view(spark, sf, "point").withColumn(
        "p", crs.reproject(F.struct((F.col("x") + 500_000).alias("x"),
                                    (F.col("y") + 5_800_000).alias("y")), 25832, 4326))
    return moved.selectExpr("event_id", "round(p.x, 9) as lon", "round(p.y, 9) as lat")


# -- report -------------------------------------------------------------------

def _report_tables(spark, sf) -> dict[str, DataFrame]:
    parcels = V.parcels(spark, sf)
    numbered = parcels.withColumn("flsnr", F.col("pid").cast("string"))
    book = numbered.select("flsnr", "gemashl", "flr", "flsnrk", "ff_stand",
                           (F.col("maxx") - F.col("minx")).alias("flsfl"))
    return {
        **_register(spark, sf), "parcel": numbered, "flurst": book,
        "gema_shl": V.view(spark, sf, "district"),
        "strassen": V.view(spark, sf, "address").selectExpr(
            "cast(cast(substr(gml_id, 5) as bigint) as string) as flsnr", "lage as strshl",
            "hausnummer as hausnr", "case when endet is null then 0 else 1 end as ff_stand"),
        "str_shl": V.view(spark, sf, "street").selectExpr("lage as strshl",
                                                          "bezeichnung as strname"),
        "soil": V.surveys(spark, sf),
    }


@query
def parcel_landuse(spark, sf):
    lines = _base(spark, sf, "lineitem")
    tables = _report_tables(spark, sf)
    return report.report_blocks({
        "flurst": tables["flurst"], "gema_shl": tables["gema_shl"],
        "nutz_21": lines.selectExpr(
            "cast(l_partkey as string) as flsnr", "l_returnflag as nutzsl", "l_quantity as fl",
            "if(l_linenumber % 5 = 0, 1, 0) as ff_stand"),
        "nutz_shl": lines.filter("l_returnflag <> 'N'").selectExpr(
            "l_returnflag as nutzshl", "'Nutzung ' || l_returnflag as nutzung").distinct(),
    })["landuse"].drop("gemashl")


@query
def parcel_offices(spark, sf):
    orders = _base(spark, sf, "orders")
    tables = _report_tables(spark, sf)
    return report.report_blocks({
        "flurst": tables["flurst"], "gema_shl": tables["gema_shl"],
        "ausfst": orders.selectExpr("cast(o_custkey as string) as flsnr", "o_orderstatus as ausf_st",
                                    "if(o_orderkey % 7 = 0, 1, 0) as ff_stand"),
        "afst_shl": orders.selectExpr("o_orderstatus as ausf_st",
                                      "'Stelle ' || o_orderstatus as afst_txt").distinct(),
    })["offices"].drop("gemashl")


@query
def report_with_duplicate_district(spark, sf):
    tables = _report_tables(spark, sf)
    names = tables["gema_shl"]
    tables["gema_shl"] = names.union(names.filter("gemashl < '030010'"))
    return report.master_data(tables).select("flsnr", "gemarkung")


@query
def report_date_without_imports(spark, sf):
    tables = _report_tables(spark, sf)
    lines = report.parcel_report({k: tables[k] for k in ("flurst", "gema_shl")},
                                 as_of=datetime.date(2024, 2, 29))
    return lines.filter("section = 0").select(
        "flsnr", F.regexp_extract("html", "<small>(.*)</small>", 1).alias("datum"))


def _points_of_interest(spark, sf, log: str) -> DataFrame:
    points = V.view(spark, sf, "point").withColumnRenamed("event_id", "point_id")
    return report.owner_at_points(_report_tables(spark, sf), points, "tester", log, "Karte",
                                  case_no="Akte 7", case_required=True)


@query
def owner_at_points(spark, sf):
    lines = _points_of_interest(spark, sf, shared_dir(spark, "audit"))
    return lines.filter("section = 0").select("flsnr", "gemashl")


@query
def owner_audit_log(spark, sf):
    """What the log holds after a release, read back."""
    log = shared_dir(spark, "audit")
    _points_of_interest(spark, sf, log)
    return spark.read.parquet(log).select(
        "username", F.col("requestType").alias("request"), F.col("aktenzeichen").alias("case_no"),
        F.explode("result").alias("flsnr"))


@query
def recorded_requests(spark, sf):
    """The parts of a request that was made twice under one name: recorded once."""
    log = shared_dir(spark, "audit")
    found = V.parcels(spark, sf).select(F.col("pid").cast("string").alias("flsnr"))
    for _ in range(2):
        audit.release_with_audit(found, log, "tester", "eigentuemerSuche", "alle", "Akte 7", request="r1")
    return audit.recorded(spark, log).select(
        "username", "search", "parts", F.explode("result").alias("flsnr"))


@query
def parcel_report_flat(spark, sf):
    """Sizes of every section of every reported parcel."""
    blocks = report.report_blocks(_report_tables(spark, sf))
    flat = blocks["master"].select("flsnr", "gemarkung")
    for name in ("streets", "soil", "holdings", "owners"):
        sizes = blocks[name].groupBy("flsnr").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        flat = flat.join(sizes, "flsnr", "left").fillna(0, [f"n_{name}"])
    return flat.join(blocks["yield"].select("flsnr", "emz"), "flsnr", "left")


@query
def parcel_report_lines(spark, sf):
    """The rendered report of every parcel, line by line."""
    return report.parcel_report(_report_tables(spark, sf), footnote="Nur für den Dienstgebrauch") \
        .select("gemashl", *report.ORDER, "html")
