"""DuckDB SQL giving the same rows as the registered queries.

The stand-in tables are shared text; everything computed from them is written here a
second time, in SQL and where possible by another way (closed-form rectangles for
the geometry, correlated tests for the joins).
"""

from __future__ import annotations

from parzelle.standins import THEMES, VIEWS

ORACLES: dict[str, str] = {}


def _view(name: str) -> str:
    base, select = VIEWS[name]
    text = select.replace("array(", "list_value(").replace("10D", "10e0")
    return f"{name}_v as (select {text} from {base})"


def _with(sql: str, *views: str, more: tuple[str, ...] = ()) -> str:
    parts = [_view(v) for v in views] + list(more)
    return f"with {', '.join(parts)} {sql}" if parts else sql


# parcels with their composed number, key and address links
PARCELS = ("parcels as (select *, gemashl || '-' || flr || '-' || flsnrk as flsnr,"
           " gemashl || '-' || flr || '-' || flsnrk as alb_key,"
           " gemashl || flr || lpad(split_part(flsnrk, '/', 1), 5, '0') ||"
           " case when pid % 4 = 0 then '____' else lpad(split_part(flsnrk, '/', 2), 4, '0') end"
           " || '__' as key20,"
           " ['DEHN' || lpad(cast(pid * 3 // 4 as varchar), 12, '0'),"
           "  'DEHN' || lpad(cast(pid // 2 as varchar), 12, '0')] as weistauf,"
           " ['DEOH' || lpad(cast(pid // 20 as varchar), 12, '0')] as zeigtauf from parcel_v)")


def oracle(name: str, sql: str, *views: str, more: tuple[str, ...] = ()) -> None:
    ORACLES[name] = _with(sql, *views, more=more)


def parcel_oracle(name: str, sql: str, *views: str, more: tuple[str, ...] = ()) -> None:
    oracle(name, sql, "parcel", *views, more=(PARCELS, *more))


# -- sources and metadata -----------------------------------------------------

oracle("read_current_parcels", "select p_partkey as pid, p_name as lagebez, '' as anl_verm,"
       " false as has_map_no from part")
oracle("text_values", "select gml_id, coalesce(trim(unverschluesselt), '') as unverschluesselt"
       " from address_v", "address")
oracle("data_currency", """
    select 'Stand: ' || day(d) || '. ' || list_extract(['Januar', 'Februar', 'März', 'April',
      'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'],
      cast(month(d) as int)) || ' ' || year(d) as datum from (select max(ts) as d from events)""")
oracle("style_catalogs", "select distinct c_nationkey as id, 'Katalog ' || c_nationkey as name"
       " from customer")
oracle("reference_systems", """
    select srid, case when srid > 100000 then (select max('+proj=utm +zone=32') from supplier
        where s_suppkey % 3 * 50000 + 25832 = srid) else 'init=epsg:' || srid end as proj
    from (select distinct p_partkey % 3 * 50000 + 25832 as srid from part)""")

# -- filters ------------------------------------------------------------------

parcel_oracle("current_rows", "select gml_id, flsnr from parcels where endet is null")
parcel_oracle("current_book_rows", "select gml_id, flsnr from parcels where ff_stand = 0")
parcel_oracle("select_ids", "select gml_id, flsnr from parcels where endet is null and"
              " pid in (3, 11, 14, 15, 92)")
parcel_oracle("select_where", "select gml_id, flsnr from parcels where endet is null and"
              " flr = '003' and gemashl like '0300%'")
parcel_oracle("select_subquery", "select gml_id, flsnr from parcels where endet is null and pid in"
              " (select l_partkey from lineitem where l_returnflag = 'A')")
oracle("in_models", """
    select ogc_fid, layer, drehwinkel_grad from po_v where thema = 'BUILDING'
    and list_has_any(modell, ['DKKM500', 'DLKM']) and drehwinkel_grad is not null""", "po")
oracle("label_search_partial", "select doc_id, x, y from label_v"
       " where contains(lower(text), 'que')", "label")
oracle("label_search_exact", "select ogc_fid, layer as text from po_v"
       " where layer = 'ax_gebaeude'", "po")
oracle("label_hits", """
    select count(*) as n, min(px) as minx, min(py) as miny, max(px) as maxx, max(py) as maxy
    from (select case when doc_id % 3 = 0 then x + 1 else x end as px,
                 case when doc_id % 3 = 0 then y + 2 else y end as py from label_v
          where contains(lower(text), 'que'))""", "label")
parcel_oracle("parcels_by_parts", "select gml_id, flsnr from parcels where endet is null and"
              " alb_key like '%-004-%/3'")
parcel_oracle("parcels_by_prefix", "select gml_id, flsnr from parcels where endet is null and"
              " alb_key like '030007-%-%/%'")
parcel_oracle("parcels_by_number", "select gml_id, flsnr from parcels where endet is null and"
              " key20 like '030007___00012____%'")
parcel_oracle("facet_filter", "select gml_id, flsnr from parcels where flr = '002'"
              " and flsnrk like '%/3'")

# -- parcel numbers -----------------------------------------------------------

parcel_oracle("parcel_keys", """
    select gml_id, flsnr as number, substr(key20, 1, 18) as parcel_key,
      gemashl || '-' || flr || '-' || flsnrk as from_key from parcels""")
parcel_oracle("parcel_number_of", """
    select gml_id, case when length(gml_id) = 16 then (select case when count(*) = 1 then
        max(cast(l_orderkey as varchar)) end from lineitem
        where 'DEXX' || lpad(cast(l_partkey as varchar), 12, '0') = gml_id) end as flsnr
    from (select gml_id from parcels union all select 'DE' || pid from parcels)""")
parcel_oracle("parcel_messages", """
    select flsnr, gml_id, 'REGISTER#ALBKEY#' || flsnr || '#' ||
      case when lead(gml_id) over (order by flsnr, gml_id) is null then 0 else 1 end || '#'
      as message from parcels where endet is null""")

# -- selections and extents ---------------------------------------------------

KEPT = "select gml_id from parcels where gemashl < '030020'"
HITS = "select gml_id from parcels where endet is null and flr in ('002', '005')"
parcel_oracle("selection_add", f"{KEPT} union {HITS}")
parcel_oracle("selection_remove", f"{KEPT} except {HITS}")
parcel_oracle("selection_replace", HITS)
EXTENT = ("select min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy,"
          " count(*) as n from parcels")
parcel_oracle("extent_all", EXTENT)
parcel_oracle("extent_selection", f"{EXTENT} where gemashl < '030020'")
parcel_oracle("box_text", """
    select gemashl, printf('BOX(%d %d,%d %d)', cast(min(minx) as int), cast(min(miny) as int),
      cast(max(maxx) as int), cast(max(maxy) as int)) as box_text, max(maxx) as maxx
    from parcels group by gemashl""")

# -- facets -------------------------------------------------------------------

CHOSEN = "from parcels where flr = '003' and flsnrk like '%/1'"
DISTRICTS = ("names as (select distinct d.gemashl, d.gemarkung || ' (' || d.gemashl ||"
             " coalesce(', ' || t.gemname, '') || ')' as label from district_v d"
             " left join town_name_v t on t.gemshl = d.gemshl)")
parcel_oracle("facet_values", f"""
    select 'district' as facet, p.gemashl as value, n.label, count(*) as n
      from (select * {CHOSEN}) p join names n on n.gemashl = p.gemashl group by all
    union all select 'section', flr, flr, count(*) {CHOSEN} group by flr
    union all select 'num', split_part(flsnrk, '/', 1), split_part(flsnrk, '/', 1), count(*)
      {CHOSEN} group by 2
    union all select 'den', split_part(flsnrk, '/', 2), split_part(flsnrk, '/', 2), count(*)
      {CHOSEN} group by 2""", "district", "town_name", more=(DISTRICTS,))
parcel_oracle("facet_hits", f"select count(*) as hits, count(*) between 1 and 999 as run {CHOSEN}")
parcel_oracle("used_districts", "select gemashl, label from names n where exists (select 1 from"
              " parcels p where p.gemashl = n.gemashl and flsnrk like '12/%')",
              "district", "town_name", more=(DISTRICTS,))
parcel_oracle("parcel_districts", "select gml_id, gemarkung from parcels p left join district_v d"
              " on d.gemashl = p.gemashl", "district")

# -- streets and addresses ----------------------------------------------------

USED = """used as (
    select k.bezeichnung as name, k.kennung as suffix, t.bezeichnung as town,
      k.schluesselgesamt as key, k.bezeichnung || coalesce(', ' || t.bezeichnung, '') ||
      coalesce(' (' || k.kennung || ')', '') as street
    from street_v k left join town_v t on t.endet is null and t.land = k.land
      and t.regierungsbezirk = k.regierungsbezirk and t.kreis = k.kreis
      and try_cast(t.gemeinde as int) = try_cast(k.gemeinde as int)
    where k.endet is null and (
      exists (select 1 from address_v m where m.endet is null and m.lage = k.lage
              and m.gemeinde = k.gemeinde)
      or exists (select 1 from plain_address_v o where o.endet is null and o.lage = k.lage
              and o.gemeinde = k.gemeinde)))"""
FREE = """free as (select unverschluesselt as street from address_v
    where endet is null and unverschluesselt is not null
    union select unverschluesselt from plain_address_v
    where endet is null and unverschluesselt is not null)"""
GROUPED = """grouped as (select street, name, suffix, town, count(distinct key) as n,
    string_agg(distinct key, '#' order by key) as keys from used group by all)"""
STREETS = ("street", "address", "plain_address", "town")
DIRECTORY = """
    select * from (
      select distinct u.street || case when g.n > 1 then ' (' || u.key || ')' else '' end
        as street, u.key as key
      from used u join grouped g on g.street = u.street
        and g.name = u.name and g.suffix is not distinct from u.suffix
        and g.town is not distinct from u.town
      union all select street, '' from free)"""
oracle("street_directory", DIRECTORY, *STREETS, more=(USED, FREE, GROUPED))
oracle("street_directory_prefix", f"{DIRECTORY} where street ilike 'street\\_3%' escape '\\'",
       *STREETS, more=(USED, FREE, GROUPED))
oracle("street_key_lists", "select street, keys from grouped union all select street, ''"
       " from free", *STREETS, more=(USED, FREE, GROUPED))


def _listed(by: str) -> str:
    return f"""listed as (
      select {by}, hausnummer as choice, 0 as rank,
        try_cast(nullif(regexp_replace(hausnummer, '\\D', '', 'g'), '') as int) as num_key
      from address_v where endet is null and {by} is not null
      union all select distinct {by}, 'Ohne', 1, null from plain_address_v
      where endet is null and {by} is not null)"""


def _choices(by: str) -> str:
    return f"""select * from listed union all
    select {by}, 'Alle', 2, null from listed group by {by} having count(*) > 1"""


for _name, _by in (("house_number_choices", "lage"), ("free_house_numbers", "unverschluesselt")):
    oracle(_name, _choices(_by), "address", "plain_address", more=(_listed(_by),))
KEYED = """keyed as (
    select k.schluesselgesamt, a.hausnummer as choice, 0 as rank,
      try_cast(nullif(regexp_replace(a.hausnummer, '\\D', '', 'g'), '') as int) as num_key
    from (select distinct * from street_v where endet is null) k join address_v a
      on (a.land, a.regierungsbezirk, a.kreis, a.gemeinde, a.lage) =
         (k.land, k.regierungsbezirk, k.kreis, k.gemeinde, k.lage)
    where a.endet is null
    union all
    select schluesselgesamt, 'Ohne', 1, null from street_v k where endet is null and exists (
      select 1 from plain_address_v o where o.endet is null
      and (o.land, o.regierungsbezirk, o.kreis, o.gemeinde, o.lage) =
          (k.land, k.regierungsbezirk, k.kreis, k.gemeinde, k.lage))
    group by 1)"""
# what a keyed street offers, by correlated tests on the catalogue
oracle("house_numbers_by_key", """
    select schluesselgesamt, choice, rank, num_key from keyed
    union all select schluesselgesamt, 'Alle', 2, null from keyed group by 1 having count(*) > 1""",
       "address", "plain_address", "street", more=(KEYED,))
oracle("parcel_streets", """
    select gml_id as flsnr, k.bezeichnung as strname, hausnummer as hausnr,
      case when regexp_matches(hausnummer, '^\\d+$') then cast(hausnummer as int) else 0 end
      as num_key
    from address_v a join street_v k on k.lage = a.lage where a.endet is null""",
       "address", "street")
oracle("split_addresses", """
    select gml_id, case when lage % 4 <> 0 then 'Am Ring' end as street,
      case when lage % 4 <> 0 then hausnummer end as number from address_v""", "address")
parcel_oracle("parcels_at_address", """
    select gml_id, flsnr from parcels p where endet is null and exists (
      select 1 from address_v a where a.unverschluesselt is not null
      and list_contains(p.weistauf, a.gml_id))""", "address")
parcel_oracle("parcels_by_typed_address", """
    select gml_id, flsnr from parcels p where endet is null and exists (
      select 1 from address_v a left join street_v k using (land, regierungsbezirk, kreis,
        gemeinde, lage)
      where list_contains(p.weistauf, a.gml_id) and a.hausnummer = '15A'
      and (starts_with(lower(k.bezeichnung), 'street_')
           or starts_with(lower(a.unverschluesselt), 'street_')))""", "address", "street")
parcel_oracle("parcels_by_street", """
    select gml_id, flsnr from parcels p where endet is null and (exists (
      select 1 from address_v a join street_v k using (land, regierungsbezirk, kreis, gemeinde,
        lage) where list_contains(p.weistauf, a.gml_id) and k.schluesselgesamt = '00003')
      or exists (
      select 1 from plain_address_v a join street_v k using (land, regierungsbezirk, kreis,
        gemeinde, lage) where list_contains(p.zeigtauf, a.gml_id)
        and k.schluesselgesamt = '00003'))""", "address", "plain_address", "street")
parcel_oracle("parcels_by_free_street", """
    select gml_id, flsnr from parcels p where endet is null and exists (
      select 1 from plain_address_v a where list_contains(p.zeigtauf, a.gml_id)
      and a.unverschluesselt = 'Weg 8')""", "plain_address")

# -- tables of searches, by trying every pair ----------------------------------

oracle("label_searches", """
    select search_id, doc_id from label_v, (select item_id as search_id, substr(text, 1, 12) as term
        from benchmark union all select 1000000 + n_nationkey, left(n_name, 2) from nation)
    where contains(lower(text), lower(term))""", "label")
ORACLES["street_searches"] = f"""select search_id, street, key from ({ORACLES["street_directory"]}),
    (select s_suppkey as search_id, case when s_suppkey % 2 = 0 then 'street_' || s_nationkey % 10
      else 'fr' || left('ei 1', cast(s_suppkey % 5 as int)) end as prefix from supplier)
    where starts_with(lower(street), prefix)"""
parcel_oracle("owner_searches", """
    select distinct search_id, gml_id, cast(pid as varchar) as flsnr from (
      select s_suppkey as search_id, lpad(cast(s_suppkey as varchar), 4, '0') as term from supplier)
    join customer on contains(lower(c_name), 'customer') and contains(c_name, term)
    join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
    join parcels on pid = l_partkey and endet is null""")
parcel_oracle("typed_address_searches", """
    select distinct search_id, p.gml_id, flsnr from (
      select s_suppkey as search_id, case s_suppkey % 4 when 0 then 'keine nummer' when 1 then 'frei ' else
        'street_' || left(cast(s_nationkey as varchar), cast(s_suppkey % 2 as int)) end as street,
        cast(s_suppkey % 120 + 1 as varchar) || case when s_suppkey % 7 = 0 then 'A' else '' end as number
      from supplier) s
    join address_v a on a.hausnummer = number
    left join street_v k using (land, regierungsbezirk, kreis, gemeinde, lage)
    join parcels p on p.endet is null and list_contains(p.weistauf, a.gml_id)
    where starts_with(lower(k.bezeichnung), street) or starts_with(lower(a.unverschluesselt), street)""",
              "address", "street")
parcel_oracle("typed_number_searches", """
    select o_orderkey as search_id, gml_id, flsnr from orders join parcels on endet is null
      and gemashl = '03' || lpad(cast(o_custkey % 51 as varchar), 4, '0')
      and split_part(flsnrk, '/', 1) = cast(o_orderkey % 97 + 1 as varchar)
      and (o_orderkey % 3 <> 0 or o_orderkey % 8 = 0
        or flr = lpad(cast(o_orderkey % 8 as varchar), 3, '0'))
      and (o_orderkey % 2 <> 0 or o_orderkey % 4 = 0
        or split_part(flsnrk, '/', 2) = cast(o_orderkey % 4 as varchar) and pid % 4 <> 0)""")
parcel_oracle("part_set_searches", """
    select s_suppkey as search_id, gml_id, flsnr from supplier join parcels on endet is null
      and (s_suppkey % 2 <> 0 or gemashl = '03' || lpad(cast(s_suppkey % 50 as varchar), 4, '0'))
      and (s_suppkey % 3 <> 0 or flr = lpad(cast(s_suppkey % 7 + 1 as varchar), 3, '0'))
      and (s_suppkey % 5 <> 0 or split_part(flsnrk, '/', 1) = cast(s_suppkey % 97 + 1 as varchar))
      and (s_suppkey % 7 <> 0 or split_part(flsnrk, '/', 2) = cast(s_suppkey % 4 as varchar))""")

# -- owners and holdings ------------------------------------------------------

OWNED = """
    select gml_id, cast(pid as varchar) as flsnr from parcels where endet is null and pid in (
      select l_partkey from lineitem where l_orderkey in (
        select o_orderkey from orders join customer on o_custkey = c_custkey
        where contains(lower(c_name), 'customer') and contains(lower(c_name), '00011')))"""
parcel_oracle("parcels_by_owner", OWNED)
parcel_oracle("owner_search_with_audit", OWNED)
COURTS = """courts as (
    select substr(cast(o_orderkey as varchar), 1, 2) as land, o_orderstatus as bezirk,
      min(c_name) as court
    from orders join customer on cast(c_custkey as varchar) =
      substr(cast(o_orderkey as varchar), 1, 1) || (o_custkey % 40) and c_custkey % 3 = 0
    group by all)"""
oracle("court_lookup", "select land, bezirk, court from courts", more=(COURTS,))
oracle("holdings", """
    select h.flsnr, h.bestdnr, h.b, h.bvnr, h.auftlnr, '' as anteil, h.ff_stand as zhist,
      f.ff_stand as bhist, f.gbbz, f.gbblnr, f.bestfl, 'Art ' || h.b as eignerart,
      (select court from courts c where c.bezirk = f.gbbz and c.land = substr(f.bestdnr, 1, 2))
      as bezeichnung
    from holding_v h join folio_v f on f.bestdnr = h.bestdnr""", "holding", "folio",
       more=(COURTS,))
oracle("nested_owners", """
    select bestdnr, chunk, string_agg(owner, ';' order by place) as owners
    from (select *, cast((place - 1) // 2 as int) as chunk
      from (select *, row_number() over (partition by bestdnr order by owner) as place
        from (select cast(o_orderkey as varchar) as bestdnr, coalesce(nullif(
            cast(c_nationkey as varchar), '7'), '0') || ':' || c_name as owner
          from orders join customer on c_custkey = o_custkey where o_orderkey % 7 <> 0)))
    group by bestdnr, chunk""")

# -- layers and styles --------------------------------------------------------

oracle("model_inventory", """
    select modell, 4 * count(*) as n from (select unnest(modell) as modell from po_v)
    where modell is not null group by modell""", "po")


def _literal(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


_RULES = " union all ".join(
    f"select *, {_literal(s.name)} as sublayer from po_v where thema = {_literal(t.name)}"
    f" and ({s.rule})"
    for t in THEMES for s in (t.sublayers or (type("All", (), {"name": "", "rule": "true"}),)))
ROUTED = f"routed as ({_RULES})"
_SCALES = ", ".join(
    f"({_literal(t.name)}, {_literal(s_name)}, {_literal(kind)},"
    f" {low if low is not None else 'null'}, {high if high is not None else 'null'})"
    for t in THEMES
    for s_name, over in ([(s.name, s.scales) for s in t.sublayers] or [("", {})])
    for kind in ("area", "outline", "line", "point", "label")
    for low, high in [over.get(kind) or t.scales[kind]])
SCALES = ("scales as (select theme, sublayer, kind, cast(min_scale as double) as min_scale,"
          " cast(max_scale as double) as max_scale from (values " + _SCALES +
          ") s(theme, sublayer, kind, min_scale, max_scale))")
_CLASSES = ", ".join(f"({_literal(t.name)}, {_literal(sn)}, {_literal(label)})"
                     for t in THEMES for sn, label in t.labels.items())
CLASSES = f"classes as (select * from (values {_CLASSES}) c(theme, sn, class_label))"
# objects per kind; the place is a point whose x is the id modulo 100
EXTRACT = """extract as (
    select thema as theme, sublayer, 'area' as kind, ogc_fid, gml_id, layer, modell, sn,
      cast(null as double) as rotation,
      case when ogc_fid % 9 <> 0 then cast(ogc_fid % 100 as double) end as x from routed
    union all select thema, sublayer, 'outline', ogc_fid, gml_id, layer, modell, sn, null,
      cast(ogc_fid % 100 as double) from routed where ogc_fid % 9 <> 0
    union all select thema, sublayer, 'line', ogc_fid, gml_id, layer, modell, sn, null,
      cast(ogc_fid % 100 as double) from routed where ogc_fid % 8 <> 0
    union all select thema, sublayer, 'point', ogc_fid, gml_id, layer, modell, sn,
      0 - drehwinkel_grad, cast(ogc_fid % 100 as double) from routed where ogc_fid % 5 <> 0
    union all select thema, sublayer, 'label', ogc_fid, gml_id, layer, modell, sn,
      0 - drehwinkel_grad, cast(ogc_fid % 100 as double) from routed where ogc_fid % 3 <> 2)"""
# style keys in use count even when the object itself is not drawn
INVENTORY = """inventory as (select theme, sublayer, kind, sn, sum(shown) as n from (
    select thema as theme, sublayer, 'area' as kind, sn, 1 as shown from routed
    union all select thema, sublayer, 'outline', sn, least(ogc_fid % 9, 1) from routed
    union all select thema, sublayer, 'line', sn, least(ogc_fid % 8, 1) from routed
    union all select thema, sublayer, 'point', sn, least(ogc_fid % 5, 1) from routed
    union all select thema, sublayer, 'label', sn, least((ogc_fid + 1) % 3, 1) from routed)
    group by all)"""
oracle("sublayer_routing", "select ogc_fid, thema, sublayer from routed", "po", more=(ROUTED,))
oracle("sublayer_filter", "select ogc_fid, layer from po_v where layer not like 'ax_flurstueck%'",
       "po")
oracle("layer_extract", "select * exclude (modell) from extract"
       " where list_contains(modell, 'DLKM')", "po", more=(ROUTED, EXTRACT))
oracle("visible_at_scale", """
    select theme, sublayer, kind, count(*) as features from extract
    join scales using (theme, sublayer, kind)
    where (min_scale is null or min_scale <= 4000) and (max_scale is null or 4000 <= max_scale)
    group by all""", "po", more=(ROUTED, EXTRACT, SCALES))
oracle("styles_in_use", """
    select * from style_v s where exists (select 1 from po_v p where p.thema = 'BUILDING'
      and p.layer = 'ax_gebaeude' and p.sn = s.signaturnummer)""", "style", "po")

# line definitions repeat the style key for a second catalogue; every third has no colour,
# every seventh no strokes
LINE_DEF = """line_def as (select signaturnummer, katalog,
    case when cast(signaturnummer as int) % 3 = 0 then 99 else farbe end as farbe,
    case when cast(signaturnummer as int) % 7 = 4 then null
      else 'S' || (cast(signaturnummer as int) % 4) end as strichart,
    cast(cast(signaturnummer as int) - 5 as double) as strichstaerke,
    case when cast(signaturnummer as int) % 2 = 0 then 'Abgeschnitten' else 'Rund' end
      as abschluss,
    case when cast(signaturnummer as int) % 5 = 0 then 'Spitz' else 'Rund' end as scheitel
    from style_v)"""
USED_STYLES = "used as (select distinct thema as theme, sublayer, sn from routed)"


def _styled(catalog: int, color: str) -> str:
    return f"""
    select distinct u.theme, u.sublayer, u.sn, s.name, s.darstellungsprioritaet as priority,
      c.umn, cast(coalesce(split_part(c.umn, ' ', 1), '0') as int) as r,
      cast(coalesce(split_part(c.umn, ' ', 2), '0') as int) as g,
      cast(coalesce(split_part(c.umn, ' ', 3), '0') as int) as b,
      coalesce(class_label, s.name) as label
    from used u join style_v s on s.signaturnummer = u.sn and s.katalog = {catalog}
    {color} left join classes k on k.theme = u.theme and k.sn = u.sn"""


FILL = _styled(1, "join color_v c on c.id = s.farbe")
OUTLINE = _styled(1, "left join line_def l on l.signaturnummer = s.signaturnummer and"
                  " l.katalog = 1 left join color_v c on c.id = l.farbe")
LINE = _styled(0, "join line_def l on l.signaturnummer = s.signaturnummer and l.katalog = 0"
               " join color_v c on c.id = l.farbe")
STYLE_VIEWS, STYLE_MORE = ("po", "style", "color"), (ROUTED, USED_STYLES, CLASSES, LINE_DEF)
oracle("fill_styles", FILL, *STYLE_VIEWS, more=STYLE_MORE)
oracle("outline_styles", OUTLINE, *STYLE_VIEWS, more=STYLE_MORE)
oracle("line_styles", f"""
    select *, row_number() over (partition by theme, sublayer order by priority nulls last, sn,
      name)::int - 1 as pass from ({LINE})""", *STYLE_VIEWS, more=STYLE_MORE)
oracle("style_priority", f"""
    select theme, sublayer, count(*) as classes, cast(trunc(avg(priority)) as int) as zindex,
      min(priority) as min_priority, max(priority) as max_priority from ({FILL})
    group by all""", *STYLE_VIEWS, more=STYLE_MORE)

STROKES = """strokes as (select distinct p_partkey % 8 as id,
    case when p_partkey % 2 = 1 then 1e0 else 0e0 end as laenge, 5e-1 as einzug,
    case when p_partkey % 2 = 0 then [1.5, 1.5] else [2.0] end as gaps from part)"""
oracle("line_strokes", """
    select s.signaturnummer as sn, k.id as stroke, l.abschluss, l.scheitel,
      coalesce(l.strichstaerke / 100, 0) as strichstaerke, coalesce(k.laenge, 0) as laenge,
      coalesce(k.einzug, 0) as einzug,
      case len(gaps) when 2 then '1.50,1.50' when 1 then '2.00' else '' end as gaps,
      cast(split_part(c.umn, ' ', 1) as int) as r, cast(split_part(c.umn, ' ', 2) as int) as g,
      cast(split_part(c.umn, ' ', 3) as int) as b
    from style_v s left join line_def l on l.signaturnummer = s.signaturnummer and l.katalog = 1
    left join strokes k on 'S' || (k.id % 4) = l.strichart left join color_v c on c.id = l.farbe
    where s.katalog = 1 and c.id is not null""", "style", "color", more=(LINE_DEF, STROKES))
# per order: every stroke has the gaps 1 and 2, so its pattern is 2 * length + 3
ORDER_STROKES = """lines as (select cast(l_orderkey as varchar) as sn, l_linenumber as stroke,
    cast(l_linenumber % 3 as double) as laenge, l_quantity / 100 as einzug,
    l_discount as width from lineitem)"""
CHECK = """checked as (select sn, count(*) as strokes, 2 * min(laenge) + 3 as total,
    count(distinct laenge) = 1 as same_length,
    count(distinct case when laenge > 0 then einzug end) <= 1 as same_indent,
    min(case when laenge > 0 then einzug end) as lead, max(width) as widest
    from lines group by sn)"""
oracle("line_style_check", "select sn, strokes, round(total, 6) as total, same_length,"
       " same_indent, round(lead, 6) as lead, round(widest, 6) as widest from checked",
       more=(ORDER_STROKES, CHECK))
oracle("dash_offsets", """
    select sn, stroke, 'line' as shape, 1 as part, 'map' as unit, 'flat' as cap, 'miter' as join,
      round(width, 6) as width,
      printf('%.2f,1.00,%.2f,2.00', laenge, laenge) as dashes, cast(null as double) as interval,
      cast(null as double) as "offset"
    from lines join checked using (sn) where same_length and same_indent and laenge > 0
    union all
    select sn, stroke, 'marker', part, 'map', 'flat', 'miter', round(width, 6), '', 3.0,
      round(einzug + part - 1, 6)
    from lines join checked using (sn), (values (1), (2)) p(part)
    where same_length and same_indent and laenge = 0
    union all
    select sn, null, 'blank', 0, 'map', 'flat', 'round', round(widest * 1.01, 6), '', null, null
    from checked where same_length and same_indent""", more=(ORDER_STROKES, CHECK))
SYMBOLS = """symbols as (select signaturnummer as sn, -1.0 as x0, -2.0 as y0,
    cast(darstellungsprioritaet as double) as x1, 3.0 as y1 from style_v where katalog = 1)"""
EXTENTS = """extents as (select distinct cast(s_suppkey % 20 as varchar) as sn, -0.5 as x0,
    -0.25 as y0, 1.5 as x1, cast(s_suppkey % 20 as double) as y1 from supplier)"""
oracle("symbol_geometry", """
    select theme, sublayer, u.sn, (b.x0 + b.x1) / 2 as cx, (b.y0 + b.y1) / 2 as cy,
      b.x1 - b.x0 as width, b.y1 - b.y0 as height,
      round(0.5 + (b.x0 + b.x1) / 2 / (b.x1 - b.x0), 6) as anchor_x,
      round(0.5 + (b.y0 + b.y1) / 2 / (b.y1 - b.y0), 6) as anchor_y,
      0 - (b.x0 + b.x1) / 2 as offset_x, 0 - (b.y0 + b.y1) / 2 as offset_y
    from (select u.*, coalesce(s.x0, e.x0, -0.5) as x0, coalesce(s.y0, e.y0, -0.5) as y0,
            coalesce(s.x1, e.x1, 0.5) as x1, coalesce(s.y1, e.y1, 0.5) as y1
          from used u left join symbols s on s.sn = u.sn left join extents e on e.sn = u.sn) b,
      lateral (select b.sn) u(sn)""", "po", "style", more=(ROUTED, USED_STYLES, SYMBOLS, EXTENTS))
oracle("point_styles", """
    select u.theme, sublayer, u.sn, coalesce(class_label, '(' || u.sn || ')') as label
    from used u left join classes k on k.theme = u.theme and k.sn = u.sn""", "po",
       more=(ROUTED, USED_STYLES, CLASSES))
oracle("missing_symbols", """
    select distinct sn from used where sn <> '6000' and sn not in (
      select cast(s_nationkey as varchar) from supplier where s_acctbal > 9000)""", "po",
       more=(ROUTED, USED_STYLES))

# strokes of a style fit when they all have the same length; a definition without strokes
# is one solid line of length 0, and only lines without colour don't count
DRAWABLE = """drawable as (
    select s.signaturnummer as sn from style_v s
    left join line_def l on l.signaturnummer = s.signaturnummer and l.katalog = 1
    left join strokes k on 'S' || (k.id % 4) = l.strichart left join color_v c on c.id = l.farbe
    where s.katalog = 1 and c.id is not null group by 1
    having count(distinct coalesce(list_sum(gaps) + laenge * len(gaps), 0)) = 1)"""
LINE_1 = LINE.replace("katalog = 0", "katalog = 1")
EVERY = f"""every as (
    select 'area' as kind, theme, sublayer, sn, priority from ({FILL})
    union all select 'outline', theme, sublayer, sn, priority from ({OUTLINE})
      where sn in (select sn from drawable)
    union all select 'line', theme, sublayer, sn, priority from ({LINE_1})
      where sn in (select sn from drawable)
    union all select 'point', theme, sublayer, sn, null from used)"""
MANIFEST = """manifest as (
    select f.theme, f.sublayer, f.kind, sum(n)::bigint as features, count(e.sn) as classes,
      case when f.kind = 'label' then 999 else cast(trunc(avg(priority)) as int) end as zindex,
      min(priority) as min_priority, max(priority) as max_priority
    from inventory f
    left join every e on e.kind = f.kind and e.theme = f.theme and e.sublayer = f.sublayer
      and e.sn = f.sn
    group by f.theme, f.sublayer, f.kind having case when f.kind = 'label' then sum(n) > 0 else count(e.sn) > 0 end)"""
MANIFEST_MORE = (*STYLE_MORE, INVENTORY, SCALES, STROKES, DRAWABLE, EVERY, MANIFEST)
oracle("layer_manifest", """
    select theme, sublayer, kind, features, classes, zindex, min_priority, max_priority,
      min_scale, max_scale, case kind when 'area' then 'Flächen' when 'outline' then 'Grenzen'
        when 'line' then 'Linien' when 'point' then 'Punkte' else 'Beschriftungen' end as title,
      case when sublayer = '' then theme else theme || ' / ' || sublayer end as "group"
    from manifest join scales using (theme, sublayer, kind)""", *STYLE_VIEWS, more=MANIFEST_MORE)
oracle("draw_order", """
    select theme, sublayer, kind, type, cast(row_number() over (order by list_position(
        ['raster', 'polygon', 'line', 'point', 'annotation'], type), coalesce(zindex, -1),
        theme, sublayer, kind) - 1 as int) as draw_index
    from (select *, case when kind in ('area', 'outline') then 'polygon' when kind = 'line'
      then 'line' else 'point' end as type from manifest)""", *STYLE_VIEWS, more=MANIFEST_MORE)
# the words that alignments become, as tables
WORD_TABLES = ("""across(word, screen, server) as (
    values ('linksbündig', 'Left', 'L'), ('rechtsbündig', 'Right', 'R'))""", """
upright(word, screen, place, server) as (
    values ('oben', 'Cap', 'AL', 'L'), ('Basis', 'Base', 'BL', 'U'))""", """
ending(style, word) as (
    values ('Kursiv', '-italic'), ('Fett', '-bold'), ('Fett, Kursiv', '-bold-italic'))""", """
fonted as (select l.doc_id, l.skalierung as scale, l.fontsperrung as gap,
    l.drehwinkel_grad as angle, s.*, f.umn,
    h.screen as h_screen, h.server as h_server, v.screen as v_screen, v.place, v.server as v_server,
    s.farbe is not null as has_font, f.id is not null as has_color, e.word as ending
  from label_v l left join (select * from font_v where {fonts}) s using (signaturnummer)
  left join color_v f on f.id = s.farbe left join ending e on e.style = s.stil
  left join across h on h.word = ifnull(l.horizontaleausrichtung, s.horizontaleausrichtung)
  left join upright v on v.word = ifnull(l.vertikaleausrichtung, s.vertikaleausrichtung))""")
oracle("label_style_screen", """
    select doc_id, tsize, tunit, tshow, halign, valign, placement, rotation, family, italic, bold,
      spacing, tcolor
    from (select doc_id, grad_pt as pt, ifnull(pt < 0, false) as absolute,
        round(if(absolute, 0 - pt, pt * ifnull(scale, 1) * 1.3225 / 4), 6) as tsize,
        if(absolute, 'Point', 'MapUnit') as tunit, if(absolute, 0, 1) as tshow,
        ifnull(h_screen, 'Center') as halign, ifnull(v_screen, 'Half') as valign,
        ifnull(place, 'OL') as placement, 0 - angle as rotation,
        ifnull(art, 'Arial') as family, ifnull(contains(stil, 'Kursiv'), false)::int as italic,
        ifnull(contains(stil, 'Fett'), false)::int as bold,
        round(ifnull(sperrung_pt / 4e0, 0e0), 6) as spacing,
        array_to_string(string_split(umn, ' '), ',') as tcolor
      from fonted)""", "label", "font", "color",
       more=tuple(t.replace("{fonts}", "katalog = 1") for t in WORD_TABLES))
oracle("label_style_server", """
    select doc_id, umn as color_umn, round(pt * scale / 4 / 0.0254, 6) as size_umn,
      lower(art) || ifnull('-' || effekt, '') || ifnull(ending, '') ||
        if(gap > 0, printf('-%d', (round(gap * 4))::int), '') as font_umn,
      ifnull(v_server, 'C') || ifnull(h_server, 'C') as position_umn, angle as drehwinkel_grad
    from (select *, grad_pt as pt from fonted) where has_font and has_color""",
       "label", "font", "color", more=tuple(t.replace("{fonts}", "true") for t in WORD_TABLES))

# -- geometry -----------------------------------------------------------------

parcel_oracle("geometry_measures", """
    select gml_id, printf('POLYGON((%.3f %.3f,%.3f %.3f,%.3f %.3f,%.3f %.3f,%.3f %.3f))',
        minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny) as wkt,
      (maxx - minx) * (maxy - miny) as area, minx, maxy from parcels""")
parcel_oracle("geometry_from_database", """
    select gml_id, cast(25832 + pid % 2 as int) as srid, (maxx - minx) * (maxy - miny) as area, minx, maxy
    from parcels""")
oracle("points_in_two_systems", """
    select event_id, pid from point_v p join parcel_v f on f.endet is null
      and round(x, 3) > minx and round(x, 3) < maxx and round(y, 3) > miny
      and round(y, 3) < maxy""", "point", "parcel")
oracle("points_in_parcels", """
    select event_id, pid from point_v p join parcel_v f on f.endet is null
      and round(x, 3) > minx and round(x, 3) < maxx and round(y, 3) > miny
      and round(y, 3) < maxy""", "point", "parcel")
PAIRS = """from parcel_v p join soil_v s on p.endet is null and s.endet is null
    and p.minx < s.maxx and s.minx < p.maxx and p.miny < s.maxy and s.miny < p.maxy"""
SHARED = ("((least(p.maxx, s.maxx) - greatest(p.minx, s.minx)) *"
          " (least(p.maxy, s.maxy) - greatest(p.miny, s.miny)))")
oracle("parcels_touching", """
    select soil_id, pid from parcel_v p join soil_v s on p.endet is null
    and p.minx <= s.maxx and s.minx <= p.maxx and p.miny <= s.maxy and s.miny <= p.maxy""",
       "parcel", "soil")
# edge by edge: the height above a box' lower side, cut at its upper side, is linear
# between the places where the edge passes them
OUTLINE = """corner as (select outline_id, rank, n, round(60 * outline_id + radius * cos(angle), 3) as x,
      round(100 + radius * sin(angle), 3) as y
    from (select o_custkey % 8 as outline_id, 90 + cast(floor(o_totalprice) as bigint) % 97 / 5e0 as radius,
        row_number() over w as rank, count(*) over (partition by o_custkey % 8) as n,
        2 * pi() * (row_number() over w) / count(*) over (partition by o_custkey % 8) as angle
      from orders window w as (partition by o_custkey % 8 order by o_orderkey))),
  edge as (select a.outline_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from corner a join corner b
    on a.outline_id = b.outline_id and b.rank = a.rank % a.n + 1)"""
oracle("large_outline_overlay", """
    select outline_id, pid, round(shared, 1) as shared from (
      select outline_id, pid, sum(sign(x1 - x2) * ((t1 - t0) * (h0 + h1) + (t2 - t1) * (h1 + h2)
        + (t3 - t2) * (h2 + h3)) / 2) as shared
      from (select *, greatest(least(y1 + m * (t0 - x1), maxy), miny) - miny as h0,
          greatest(least(y1 + m * (t1 - x1), maxy), miny) - miny as h1,
          greatest(least(y1 + m * (t2 - x1), maxy), miny) - miny as h2,
          greatest(least(y1 + m * (t3 - x1), maxy), miny) - miny as h3
        from (select *, least(ta, tb) as t1, greatest(ta, tb) as t2
          from (select *, case when m = 0 then t0 else least(greatest(x1 + (miny - y1) / m, t0), t3) end as ta,
              case when m = 0 then t0 else least(greatest(x1 + (maxy - y1) / m, t0), t3) end as tb
            from (select *, (y2 - y1) / (x2 - x1) as m, greatest(least(x1, x2), minx) as t0,
                least(greatest(x1, x2), maxx) as t3
              from edge join parcel_v on endet is null and x1 <> x2 and least(x1, x2) < maxx
                and greatest(x1, x2) > minx))))
      group by outline_id, pid) where shared > 0.01""", "parcel", more=(OUTLINE,))
oracle("large_outline_points", """
    select event_id, outline_id from (select event_id, round(x, 3) as x, round(y, 3) as y from point_v) p
      join edge on (y1 <= y) <> (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    group by event_id, outline_id having count(*) % 2 = 1""", "point", more=(OUTLINE,))
oracle("overlay_area", f"select pid, soil_id, round({SHARED}, 6) as shared {PAIRS}",
       "parcel", "soil")
oracle("yield_index", f"""
    select pid, sum(cast(round_even(cast(ackerzahl as int) * {SHARED} / 100, 0) as bigint))::bigint
      as emz {PAIRS} where ackerzahl is not null group by pid""", "parcel", "soil")
oracle("soil_description", f"""
    select pid, soil_id, concat_ws(', ',
      case when nutzungsart < 4000 then 'Nutzung ' || nutzungsart end,
      'Entstehungsart(en) ' || (select string_agg(t, ', ' order by t) from (
        select distinct 'Art ' || s_nationkey as t from supplier
        where list_contains(s.entstehungsart, s_nationkey))),
      case when nutzungsart < 3000 then 'Bodenzahl ' else 'Grünlandgrundzahl ' end || bodenzahl,
      case when nutzungsart < 3000 then 'Ackerzahl ' else 'Grünlandzahl ' end || ackerzahl,
      'Ertragsmesszahl ' || (cast(ackerzahl as int) * cast({SHARED} as int) // 100)) as klf_text,
      cast({SHARED} as int) as fl {PAIRS}""", "parcel", "soil")
oracle("valuation_text", f"""
    select pid, case when klassifizierung = '5' then '(Klassifizierung fehlt)'
      when klassifizierung in ('0', '1', '2') and exists (select 1 from supplier
        where cast(s_nationkey as varchar) = klassifizierung) then 'Art ' || klassifizierung
      else '(' || klassifizierung || ')' end as klf_text, cast({SHARED} as int) as fl {PAIRS}""",
       "parcel", "soil")
oracle("reproject_zone", "select event_id, round(x + 500000 + 32000000, 6) as x,"
       " round(y + 5800000, 6) as y from point_v", "point")
# the inverse Krüger series of zone 32 on GRS80, to the fourth power of the third flattening
oracle("reproject_degrees", """
    select event_id, round(degrees(9 * pi() / 180 + atan2(sinh(eta1), cos(xi1))), 9) as lon,
      round(degrees(chi + sin(2 * chi) * (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45)
        + sin(4 * chi) * (7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45)
        + sin(6 * chi) * (56 * n**3 / 15 - 136 * n**4 / 35) + sin(8 * chi) * 4279 * n**4 / 630), 9) as lat
    from (select *, asin(sin(xi1) / cosh(eta1)) as chi from (
      select *, xi - (b1 * sin(2 * xi) * cosh(2 * eta) + b2 * sin(4 * xi) * cosh(4 * eta)
          + b3 * sin(6 * xi) * cosh(6 * eta) + b4 * sin(8 * xi) * cosh(8 * eta)) as xi1,
        eta - (b1 * cos(2 * xi) * sinh(2 * eta) + b2 * cos(4 * xi) * sinh(4 * eta)
          + b3 * cos(6 * xi) * sinh(6 * eta) + b4 * cos(8 * xi) * sinh(8 * eta)) as eta1
      from (select *, (y + 5800000) / scale as xi, x / scale as eta,
          n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 as b1,
          n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 as b2,
          17 * n**3 / 480 - 37 * n**4 / 840 as b3, 4397 * n**4 / 161280 as b4
        from (select *, 0.9996e0 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) as scale
          from (select *, 1 / (2 * 298.257222101e0 - 1) as n from point_v)))))""", "point")

# -- report -------------------------------------------------------------------

oracle("parcel_landuse", """
    select cast(pid as varchar) as flsnr, l_returnflag as nutzshl,
      'Nutzung ' || l_returnflag as nutzung, l_quantity as fl
    from lineitem join parcel_v on pid = l_partkey
    where ff_stand = 0 and l_linenumber % 5 <> 0 and l_returnflag <> 'N'""", "parcel")
oracle("parcel_offices", """
    select cast(pid as varchar) as flsnr, o_orderstatus as ausf_st,
      'Stelle ' || o_orderstatus as afst_txt
    from orders join parcel_v on pid = o_custkey where ff_stand = 0 and o_orderkey % 7 <> 0""",
       "parcel")
oracle("report_with_duplicate_district", """
    select cast(pid as varchar) as flsnr, 'Gemarkung ' || cast(substr(gemashl, 3) as int) as gemarkung
    from parcel_v where ff_stand = 0 and gemashl >= '030010'""", "parcel")
oracle("report_date_without_imports", """
    select cast(pid as varchar) as flsnr, '29. Februar 2024' as datum
    from parcel_v where ff_stand = 0""", "parcel")
AT_POINTS = """hit as (select distinct pid from point_v join parcel_v on endet is null
    and x > minx and x < maxx and y > miny and y < maxy)"""
oracle("owner_at_points", """
    select cast(pid as varchar) as flsnr, gemashl from parcel_v join hit using (pid)
    where ff_stand = 0""", "point", "parcel", more=(AT_POINTS,))
oracle("owner_audit_log", """
    select 'tester' as username, 'eigentuemerInfo' as request, 'Akte 7' as case_no,
      cast(pid as varchar) as flsnr from hit""", "point", "parcel", more=(AT_POINTS,))
oracle("recorded_requests", """
    select 'tester' as username, 'alle' as search, cast(ceil(count(*) over () / 1000e0) as int) as parts,
      cast(pid as varchar) as flsnr from parcel_v""", "parcel")
oracle("house_number_ranks", """
    select schluesselgesamt, choice, cast(row_number() over (partition by schluesselgesamt
      order by rank, num_key nulls last, choice) as int) as place
    from (select distinct * from keyed)""", "address", "plain_address", "street",
       more=(KEYED,))
# a line that turns to the left by a right angle keeps its distance from both legs; an
# unknown distance gives no line
oracle("label_offset_lines", """
    select doc_id, round(x + 0 * d, 6) as x0, round(y + d, 6) as y0, round(x + 50 - d, 6) as x1,
      round(y + d, 6) as y1, round(x + 50 - d, 6) as x2, round(y + 80 + 0 * d, 6) as y2
    from (select doc_id, x, y, skalierung * grad_pt / 8 as d from label_v
      join font_v s using (signaturnummer) join color_v c on c.id = s.farbe)""",
       "label", "font", "color")
oracle("parcel_report_flat", f"""
    select cast(p.pid as varchar) as flsnr, gemarkung,
      (select count(*) from address_v a join street_v k on k.lage = a.lage
        where a.endet is null and cast(substr(a.gml_id, 5) as bigint) = p.pid) as n_streets,
      coalesce(o.n, 0) as n_soil,
      (select count(*) from holding_v h join folio_v f on f.bestdnr = h.bestdnr
        where h.flsnr = cast(p.pid as varchar)) as n_holdings,
      (select count(*) from holding_v h join folio_v f on f.bestdnr = h.bestdnr
        where h.flsnr = cast(p.pid as varchar)) as n_owners, o.emz
    from parcel_v p left join district_v d on d.gemashl = p.gemashl
    left join (select pid, count(*) as n, sum(cast(round_even(cast(ackerzahl as int) * {SHARED}
        / 100, 0) as bigint))::bigint as emz {PAIRS} group by pid) o on o.pid = p.pid
    where p.ff_stand = 0""", "parcel", "soil", "district", "address", "street", "holding", "folio")
