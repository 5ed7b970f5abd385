"""The full parcel report for all parcels at once.

The report exists in two forms. ``report_blocks`` gives one table per section
(master data, streets, land use, ...), ``report_lines`` renders every row of every
section into one HTML line with its place in the document. Neither gathers a parcel
into one row, so a parcel with a third of all holdings is as cheap as any other.
``report_documents`` folds the lines into documents, in chunks of bounded length.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.functions import numbers as N
from parzelle.functions.text import escape_html as esc
from parzelle.functions.text import german_date
from parzelle.operators import addresses, facets, owners, soil
from parzelle.operators.grouping import CHUNK, nest
from parzelle.operators.predicates import current, current_book
from parzelle.operators.selection import parcel_number_of
from parzelle.operators.spatial import points_in_parcels
from parzelle.session import materialize
from parzelle.sources.audit import release_with_audit
from parzelle.sources.export import union_all
from parzelle.sources.tables import data_currency, has_columns, optional

Tables = Mapping[str, DataFrame]

# Order of lines within the export. Section, then up to five sort values.
PLACE = ["section", "n1", "n2", "s1", "s2", "s3", "line"]
SORT_VALUES = {"n1": "bigint", "n2": "bigint", "s1": "string", "s2": "string", "s3": "string"}
ORDER = ["flsnr", *PLACE]
SECTIONS = ("head", "master", "streets", "landuse", "valuation", "soil", "yield", "offices",
            "holdings", "foot")
MASTER = ("gemashl", "gemarkung", "flr", "flsnrk", "flurknr", "entst", "fortf", "flsfl", "blbnr",
          "lagebez", "anl_verm")


def resolve_numbers(arguments: DataFrame, fs: DataFrame) -> DataFrame:
    """``flsnr`` of arguments that are parcel ids (16 characters) or numbers."""
    ids = arguments.select(F.col(arguments.columns[0]).alias("gml_id"))
    return (parcel_number_of(ids, fs)
            .select(F.when(F.length("gml_id") == N.ID_LENGTH, F.col("flsnr"))
                    .otherwise(F.col("gml_id")).alias("flsnr"))
            .filter("flsnr is not null").distinct())


def master_data(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Current parcel-book rows with district; numbers that occur twice are left out,
    be it by the book or by a district listed twice."""
    book = current_book(tables["flurst"])
    if wanted is not None:
        book = book.join(wanted.select("flsnr").distinct(), "flsnr", "left_semi")
    named = facets.with_district_name(book, tables["gema_shl"])
    once = named.groupBy("flsnr").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("flsnr")
    return named.join(once, "flsnr", "left_semi")


def report_blocks(tables: Tables, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """One table per section, each with ``flsnr`` and the district ``gemashl``; sections
    without tables are absent.

    ``wanted`` (column ``flsnr``) limits the report. Every section is cut to the reported
    parcels by joining their unique numbers, which brings the district along. The master data is written
    out first: it is worked out once, and when only some parcels are wanted, the
    planner sees how few they are and broadcasts them instead of shuffling every
    section's table.
    """
    master = materialize(master_data(tables, wanted), "master")
    reported = master.select("flsnr", "gemashl")
    blocks = {"master": master}

    def cut(df: DataFrame) -> DataFrame:
        return df.drop("gemashl").join(reported, "flsnr", "inner")

    if found := optional(tables, "strassen", "str_shl"):
        blocks["streets"] = cut(addresses.parcel_streets(*found))
    if found := optional(tables, "nutz_21", "nutz_shl"):
        use, names = found
        blocks["landuse"] = cut(current_book(use).join(
            names.select(F.col("nutzshl").alias("nutzsl"), "nutzung"), "nutzsl", "inner")
            .select("flsnr", F.col("nutzsl").alias("nutzshl"), "nutzung", "fl"))
    if found := optional(tables, "parcel", "valuation", "valuation_code"):
        parcels, rows, codes = found
        blocks["valuation"] = cut(soil.valuation(cut(current(parcels)), rows, codes, keep=["flsnr"]))
    if found := optional(tables, "parcel", "soil"):
        parcels, surveys = found
        # both sections need the overlay: it is computed once and kept
        shared = materialize(
            soil.parcel_soil(cut(current(parcels)), surveys, keep=["flsnr"]), "soil")
        lists = {name[len("soil_"):]: df for name, df in tables.items()
                 if name.startswith("soil_")}
        blocks["soil"] = cut(soil.soil_description(shared, surveys, lists))
        blocks["yield"] = cut(soil.yield_index(shared, "flsnr"))
    if found := optional(tables, "ausfst", "afst_shl"):
        rows, names = found
        blocks["offices"] = cut(current_book(rows).join(names, "ausf_st", "inner")
                                .select("flsnr", "ausf_st", "afst_txt"))
    if found := optional(tables, "eignerart", "bestand", "eign_shl"):
        court = None
        if located := optional(tables, "register_district", "office"):
            if has_columns(located[0], "gehoertzu_land"):
                court = owners.courts(*located)
        blocks["holdings"] = cut(owners.holdings(*found, court))
        if "eigner" in tables:
            blocks["owners"] = blocks["holdings"].select(
                "flsnr", "gemashl", "bestdnr", "zhist", "bhist", "b", "bvnr", "auftlnr").join(
                owners.folio_owners(tables["eigner"]).drop("ff_stand"), "bestdnr", "left")
    return blocks


# -- rendering ----------------------------------------------------------------

def _tag(name: str, *content: Column | str, attr: str = "") -> Column:
    parts = [F.lit(c) if isinstance(c, str) else c for c in content]
    return F.concat(F.lit(f"<{name}{attr}>"), *parts, F.lit(f"</{name}>"))


def _row(*cells: Column) -> Column:
    return _tag("tr", *[_tag("td", c) for c in cells])


def _header(*names: str) -> str:
    return "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"


# Headings of the sections (German, as the readers expect them).
HEADINGS = {
    "streets": ("Straßen", _header("Straße", "Hausnummer")),
    "landuse": ("Nutzung", _header("Nutzung", "Fläche")),
    "valuation": ("Bodenschätzung, Bewertung", _header("Bewertung", "Fläche")),
    "soil": ("Bodenschätzung", _header("Beschreibung", "Fläche")),
    "offices": ("Ausführende Stellen", _header("Stelle")),
    "holdings": ("Bestände", _header("Bestand", "Grundbuchbezirk", "Blatt", "Amtsgericht",
                                     "Anteil", "Buchungsart", "Lfd. Nr.", "PZ")),
}
NO_LAND_USE = "Keine"
NO_OWNER = "Kein Eigentümer gefunden."


def _place(df: DataFrame, section: str, html: Column, line: int = 1, closing: bool = False,
           **keys: Column) -> DataFrame:
    """A line of the document with its sort values; closing lines follow their section."""
    return df.select(
        "flsnr", "gemashl", F.lit(2 * SECTIONS.index(section) + closing).alias("section"),
        *[keys.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SORT_VALUES.items()],
        F.lit(line).alias("line"), html.alias("html"))


def _area(value: Column) -> Column:
    return F.concat(esc(value), F.lit("&nbsp;m&sup2;"))


def report_lines(blocks: Mapping[str, DataFrame], currency: DataFrame | None = None,
                 footnote: str | None = None, as_of: date | None = None) -> DataFrame:
    """All lines of all documents; sort by ``ORDER`` with nulls first.

    ``currency`` is the one-row table with the date line (``data_currency``); without one
    the report bears the date ``as_of``, by default today's. All values are escaped.
    """
    master = blocks["master"]
    for name in MASTER:
        if name not in master.columns:
            master = master.withColumn(name, F.lit(None).cast("string"))
    datum = currency.select("datum").scalar() if currency is not None \
        else german_date(F.current_timestamp() if as_of is None else F.lit(as_of))
    dated = master.withColumn("datum", datum)

    number = F.concat_ws("-", esc(F.col("gemashl")), esc(F.col("flr")), esc(F.col("flsnrk")))
    head = _tag("h1", "Flurstücksnachweis ", number, F.lit(" "),
                _tag("small", esc(F.col("datum"))))

    def filled(*names: str) -> Column:
        return F.concat_ws("", *names) != ""

    def when_filled(test: Column, html: Column) -> Column:
        return F.when(test, html).otherwise(F.lit(""))

    facts = F.concat(
        F.lit("<table>" + _header("Gemarkung", "Flur", "Flurstück", "Flurkarte", "Entstehung",
                                  "Fortführung", "Fläche")),
        _row(F.concat_ws(" ", esc(F.col("gemashl")), esc(F.col("gemarkung"))),
             *[esc(F.col(c)) for c in ("flr", "flsnrk", "flurknr", "entst", "fortf")],
             _area(F.col("flsfl"))),
        when_filled(filled("blbnr"), F.concat(F.lit(_header("Baulastenblattnr.")),
                                              _row(esc(F.col("blbnr"))))),
        when_filled(filled("lagebez", "anl_verm"),
                    F.concat(F.lit(_header("Lage", "Anliegervermerk")),
                             _row(esc(F.col("lagebez")), esc(F.col("anl_verm"))))),
        F.lit("</table>"))
    lines = [_place(dated, "head", head), _place(dated, "master", facts)]
    tables: list[DataFrame] = []

    def section(name: str, html: Column, line: int = 1, **keys: Column) -> None:
        tables.append(_place(blocks[name], name, html, line, **keys))

    if "streets" in blocks:
        section("streets", _row(esc(F.col("strname")), esc(F.col("hausnr"))),
                s1=F.coalesce("strname", F.lit("")), s3=F.col("hausnr"),
                s2=F.lpad(F.col("num_key").cast("string"), 10, "0"))
    if "landuse" in blocks:
        use = F.concat(esc(F.col("nutzung")), F.lit(" ("), esc(F.col("nutzshl")), F.lit(")"))
        section("landuse", _row(use, _area(F.col("fl"))), s1=F.coalesce("nutzshl", F.lit("")))
        none = master.select("flsnr", "gemashl").join(blocks["landuse"].select("flsnr"), "flsnr", "left_anti")
        tables.append(_place(none, "landuse", _row(F.lit(NO_LAND_USE))))
    if "valuation" in blocks:
        section("valuation", _row(esc(F.col("klf_text")), _area(F.col("fl"))),
                s1=F.coalesce("klf_text", F.lit("")))
    if "soil" in blocks:
        section("soil", _row(esc(F.col("klf_text")), _area(F.col("fl"))), n1=-F.col("fl"),
                s1=F.coalesce("klf_text", F.lit("")))
        total = _tag("p", "Gesamtertragsmesszahl ", esc(F.col("emz")))
        lines.append(_place(blocks["yield"], "yield", total))
    if "offices" in blocks:
        section("offices", _row(esc(F.col("afst_txt"))), s1=F.coalesce("afst_txt", F.lit("")))
    if "holdings" in blocks:
        def folio_keys() -> dict[str, Column]:
            # absent dates sort last, as in the register
            late = F.lit(2**31)
            return {"n1": F.coalesce("zhist", late), "n2": F.coalesce("bhist", late),
                    "s1": F.coalesce("b", F.lit("")),
                    "s2": F.concat_ws("#", "bestdnr", "bvnr", "auftlnr")}
        section("holdings", _row(*[esc(F.col(c)) for c in (
            "bestdnr", "gbbz", "gbblnr", "bezeichnung", "anteil", "eignerart", "auftlnr", "pz")]),
            **folio_keys())
        if "owners" in blocks:
            owner = blocks["owners"]
            wanted = ["antverh", "namensnr", "name1", "name2", "name3", "name4"]
            for c in wanted:
                if c not in owner.columns:
                    owner = owner.withColumn(c, F.lit(None).cast("string"))
            name = F.concat(F.concat_ws(" ", esc(F.col("name1")), esc(F.col("name2"))),
                            F.lit("<br>"), esc(F.col("name3")), F.lit("<br>"),
                            esc(F.col("name4")))
            html = F.when(F.col("owner_key").isNull(), _row(F.lit(NO_OWNER))).otherwise(
                _row(esc(F.col("antverh")), esc(F.col("namensnr")), name))
            tables.append(_place(owner, "holdings", html, line=2, s3=F.coalesce(
                "owner_key", F.lit("")), **folio_keys()))
    foot = _tag("footer", esc(F.lit(footnote))) if footnote else F.lit("")
    lines.append(_place(master, "foot", foot))
    if tables:
        rows = union_all(tables)
        lines += [rows, _frames(rows)]
    return union_all(lines)


def _frames(rows: DataFrame) -> DataFrame:
    """Heading and closing line of every table section that a parcel has.

    The heading sorts first in its section because its sort values are null; the
    closing line has a section number of its own.
    """
    opening = F.create_map(*[F.lit(v) for name, (title, columns) in HEADINGS.items() for v in (
        2 * SECTIONS.index(name), f"<h2>{title}</h2><table>{columns}")])
    having = rows.select("flsnr", "gemashl", "section").distinct()
    frame = F.explode(F.array(
        F.struct(F.col("section"), F.lit(0).alias("line"),
                 F.element_at(opening, F.col("section")).alias("html")),
        F.struct((F.col("section") + 1).alias("section"), F.lit(1).alias("line"),
                 F.lit("</table>").alias("html"))))
    framed = having.select("flsnr", "gemashl", frame.alias("f"))
    return framed.select(
        "flsnr", "gemashl", "f.section", *[F.lit(None).cast(t).alias(n) for n, t in SORT_VALUES.items()],
        "f.line", "f.html")


def report_documents(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(flsnr, chunk, html)``: the document of every parcel, a row for each ``chunk`` of
    its lines in their order; one row for all but outsized parcels.

    A parcel's rows put together are its document.
    """
    nested = nest(lines.select(*ORDER, "html"), ["flsnr"], [*PLACE, "html"], [], "items", chunk)
    ends = nested.groupBy("flsnr").agg(F.max("chunk").alias("__last"))
    body = F.concat(F.array_join(F.transform("items", lambda i: i["html"]), "\n"), F.lit("\n"))
    html = F.concat(F.when(F.col("chunk") == 0, "<html><body>\n").otherwise(""), body,
                    F.when(F.col("chunk") == F.col("__last"), "</body></html>").otherwise(""))
    return nested.join(ends, "flsnr").select("flsnr", "chunk", html.alias("html"))


def parcel_report(tables: Tables, wanted: DataFrame | None = None,
                  footnote: str | None = None, as_of: date | None = None) -> DataFrame:
    """Lines of the reports of all (or the wanted) parcels, with district."""
    blocks = report_blocks(tables, wanted)
    currency = data_currency(tables["imports"], as_of) if "imports" in tables else None
    return report_lines(blocks, currency, footnote, as_of)


def owner_search(tables: Tables, terms: str, user: str, log_path: str | None,
                 case_no: str | None = None, case_required: bool = False) -> DataFrame:
    """Parcels of owners matching all terms, released after the audit entry."""
    found = owners.parcels_by_owner(tables["parcel"], tables["fs"], tables["eignerart"],
                                    tables["eigner"], terms).select("gml_id", "flsnr")
    return release_with_audit(found, log_path, user, "eigentuemerSuche", terms, case_no,
                              case_required)


def owner_at_points(tables: Tables, points: DataFrame, user: str, log_path: str | None,
                    search: str, case_no: str | None = None,
                    case_required: bool = False) -> DataFrame:
    """Reports of the parcels under given points, released after the audit entry."""
    hit = points_in_parcels(points, current(tables["parcel"]))
    ids = hit.select("gml_id").distinct()
    found = tables["parcel"].join(ids, "gml_id", "left_semi").select("gml_id", "flsnr")
    released = release_with_audit(found, log_path, user, "eigentuemerInfo", search, case_no,
                                  case_required)
    return parcel_report(tables, released.select("flsnr").distinct())
