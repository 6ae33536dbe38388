"""Readers of rating lists, certificates and results into typed tables. Every read has a schema of strings or a declared
one; nothing is inferred."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_name, country_from_listing, first_present, flexible_date, is_secondary, safe_int, safe_number
from ..operators.relational import pick_per_key

# The headings of rating lists by the column they fill, newest first.
HEADINGS = {
    "boat_name": ("Boat Name",), "sail_number": ("Sail No",), "cert_number": ("Cert No",), "issue_date": ("Issue Date", "Valid Date"),
    "cert_year": ("Cert Year", "SYSCertYear"), "tcc": ("TCC",), "endorsed": ("Endorsed", "E"), "secondary": ("Secondary", "Short Handed"),
    "non_spi_tcc": ("Non Spi TCC", "TCC Non spi"), "crew": ("Crew",), "dlr": ("DLR",), "lh": ("LH", "LOA"), "beam": ("Beam",), "draft": ("Draft",),
    "headsails": ("Headsails",), "flying_headsails": ("Flying Headsails",), "spinnakers": ("Spinnakers",), "series_date": ("Series Date",),
    "age_date": ("Age Date",), "racing_area": ("Racing Area", "Racing area"), "category": ("Category",), "valid_code": ("ValidCode",),
}
WHOLE = ("cert_year", "crew", "dlr", "headsails", "flying_headsails", "spinnakers", "series_date", "age_date")
DECIMAL = {"tcc": "decimal(6,4)", "non_spi_tcc": "decimal(6,4)", "lh": "decimal(6,2)", "beam": "decimal(6,2)", "draft": "decimal(6,2)"}


def rating_rows(raw: DataFrame) -> DataFrame:
    """A table of strings with list headings as typed columns; rows without a rating go."""
    have = {c.strip(): c for c in raw.columns}

    def column(name: str) -> Column:
        found = [F.col(f"`{have[h]}`") for h in HEADINGS[name] if h in have]
        text = first_present(*found) if found else F.lit(None).cast("string")
        if name in WHOLE:
            return safe_int(text)
        if name in DECIMAL:
            return F.trim(text).try_cast(DECIMAL[name])
        return flexible_date(text) if name == "issue_date" else text

    typed = raw.select(*[column(n).alias(n) for n in HEADINGS], *[c for c in raw.columns if c.startswith("_")]).filter("tcc IS NOT NULL")
    typed = typed.withColumn("is_secondary", is_secondary("boat_name", "secondary")).withColumn("boat_name", clean_name("boat_name"))
    return typed.withColumn("country", country_from_listing("sail_number"))


def read_rating_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Rating list files; a byte-order mark is dropped. Files in Latin-1 are read with encoding='ISO-8859-1'."""
    raw = spark.read.csv(path, header=True, encoding=encoding, enforceSchema=False)
    return rating_rows(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]).withColumn("_file", F.col("_metadata.file_name")))


def file_year(name: str | Column) -> Column:
    return F.regexp_extract(name, r"((?:19|20)\d{2})", 1).try_cast("int")


def all_known_certificates(rows: DataFrame) -> DataFrame:
    """One row a certificate, from the earliest file by name."""
    return pick_per_key(rows.filter("cert_number IS NOT NULL"), ["cert_number"], ["_file"])


def certificate_index(rows: DataFrame) -> DataFrame:
    """One row a certificate, from the newest year; of equal years the first file."""
    years = rows.filter("cert_number IS NOT NULL").withColumn("year", file_year("_file"))
    return pick_per_key(years, ["cert_number"], [F.desc_nulls_last("year"), "_file"])


def read_certificates_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Certificate index files: one ROW element a row."""
    return spark.read.format("xml").option("rowTag", "ROW").schema(schema).load(path)


def certificates_from_xml(xml: Column, schema: str) -> Column:
    """A certificate element held as text; a leading byte-order mark is dropped."""
    return F.from_xml(F.regexp_replace(xml, "^﻿", ""), schema)


def performance_fields(detail: str | Column) -> list[Column]:
    """Numbers of a detail record in JSON; upwind area is the sum of main and jib."""
    number = lambda *paths: F.coalesce(*[F.get_json_object(detail, f"$.{p}").try_cast("double") for p in paths])
    main, jib = number("Area_Main", "AreaMain"), number("Area_Jib", "AreaJib")
    return [
        number("GPH").alias("gph"),
        number("LOA").alias("loa"),
        number("Dspl_Measurement", "Dspl_Sailing").alias("displacement"),
        main.alias("area_main"),
        jib.alias("area_jib"),
        (main + jib).alias("sail_area_upwind"),
        number("Area_Sym", "Area_ASym").alias("area_downwind"),
    ]


RACE_SCHEMA = (
    "struct<eventName:string,raceName:string,date:string,competitors:array<struct<division:string,items:array<struct<boatName:string,sailNo:string,"
    "place:int,placingText:string,finishTime:string,elapsed:string,handicaps:array<struct<definition:string,value:double>>>>>>>"
)


def race_rows(payload: DataFrame, column: str) -> DataFrame:
    """Race payloads in JSON as a row a competitor; of the handicaps IRC is taken before PHS."""
    r = payload.withColumn("_r", F.from_json(column, RACE_SCHEMA)).select("*", F.explode_outer("_r.competitors").alias("_c")).select("*", F.explode_outer("_c.items").alias("_i"))
    of = lambda kind: F.try_element_at(F.filter("_i.handicaps", lambda h: h["definition"] == kind), F.lit(1))["value"]
    return r.select(
        F.col("_r.eventName").alias("event_name"),
        F.col("_r.raceName").alias("race_name"),
        flexible_date("_r.date").alias("event_date"),
        F.col("_c.division").alias("class_name"),
        F.col("_i.boatName").alias("boat_name"),
        F.col("_i.sailNo").alias("sail_number"),
        F.col("_i.place").alias("place"),
        F.upper(F.regexp_extract("_i.placingText", r"(?i)\b(DNF|DNS|DNC|DSQ|RET|OCS|RAF|RDG|ZFP)\b", 1)).alias("placing_code"),
        F.col("_i.finishTime").alias("finish_time"),
        F.coalesce(of("IRC"), of("PHS")).alias("rating_value"),
        F.when(of("IRC").isNotNull(), "irc_tcc").when(of("PHS").isNotNull(), "phs").alias("rating_type"),
    )


LIST_SCHEMA = "array<struct<series:string,series_id:string,race_date:string,sail_no:string,boat_name:string,skipper:string,club:string,irc_tcc:string>>"


def list_rows(payload: DataFrame, column: str) -> DataFrame:
    """Result lists in JSON, an array of records, as a row a record; in these the field skipper holds the boat's name and
    boat_name its hull number. Records without a name go."""
    r = payload.withColumn("_r", F.explode(F.from_json(column, LIST_SCHEMA))).select(
        *payload.columns,
        F.coalesce("_r.series", F.lit("Unknown Series")).alias("event_name"),
        flexible_date("_r.race_date").alias("event_date"),
        F.trim(F.coalesce("_r.skipper", F.lit(""))).alias("boat_name"),
        F.trim(F.coalesce("_r.sail_no", F.lit(""))).alias("sail_number"),
        F.trim(F.coalesce("_r.boat_name", F.lit(""))).alias("hull_id"),
        F.col("_r.club").alias("club"),
        safe_number("_r.irc_tcc").alias("rating_value"),
    )
    return r.filter("boat_name <> ''")


class _Tables(HTMLParser):
    """All tables of a page as lists of rows of cell texts, with their class and caption."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.stack: list[dict] = []
        self.cell: list[str] | None = None
        self.caption = False

    def close_cell(self) -> None:
        if self.cell is not None and self.stack:
            if not self.stack[-1]["rows"]:
                self.stack[-1]["rows"].append([])
            self.stack[-1]["rows"][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("tr", "td", "th"):
            self.close_cell()  # pages often leave out the end marks
        if tag == "table":
            self.stack.append({"class": dict(attrs).get("class") or "", "caption": "", "rows": []})
            self.tables.append(self.stack[-1])
        elif self.stack and tag == "tr":
            self.stack[-1]["rows"].append([])
        elif self.stack and tag in ("td", "th"):
            self.cell = []
        elif self.stack and tag == "caption":
            self.caption = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table" and self.stack:
            self.stack.pop()
        elif tag == "caption":
            self.caption = False

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        elif self.caption and self.stack:
            self.stack[-1]["caption"] += data


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, class, caption, row, cells of every table row of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(it):
        import pandas as pd

        for pdf in it:
            out = []
            for k, page in zip(pdf[key], pdf[html], strict=True):
                p = _Tables()
                p.feed(page or "")
                out += [(k, i, t["class"], t["caption"].strip(), j, cells) for i, t in enumerate(p.tables) for j, cells in enumerate(t["rows"])]
            yield pd.DataFrame(out, columns=["key", "table", "class", "caption", "row", "cells"])

    return pages.select(key, html).mapInPandas(parse, f"key {kind}, `table` int, class string, caption string, row int, cells array<string>")


# Headings of result tables by what they mean; the first match in this order counts.
RESULT_HEADINGS = {
    "place": ("rank", "place", "pos", "pl"), "boat_name": ("boat", "yacht", "name"), "sail_number": ("sailno", "sail no", "sail number", "sail"), "class_name": ("class", "division", "fleet"),
    "rating": ("tcc", "irc", "rating", "ahc", "phrf"), "elapsed": ("elapsed",), "corrected": ("corrected",), "points": ("points", "nett", "total"),
}


def result_rows(cells: DataFrame, only_class: str | None = None, only_caption: str | None = None) -> DataFrame:
    """Result tables by their headings: one row a boat, fleet size = rows of the table. only_class and only_caption
    (a pattern) choose the tables where a source marks them."""
    c = cells
    if only_class:
        c = c.filter(F.array_contains(F.split("class", " "), only_class))
    if only_caption:
        c = c.filter(F.col("caption").rlike(only_caption))
    head = c.filter("row = 0").select("key", "table", F.transform("cells", lambda x: F.lower(F.trim(F.regexp_replace(x, r"\{[^}]*\}", "")))).alias("head"))
    body = c.filter("row > 0 AND size(cells) > 1").join(head, ["key", "table"])

    def value(name: str) -> Column:
        at = lambda word: F.array_position(F.transform("head", lambda h: F.when((h == word) | h.startswith(word), "y").otherwise("n")), "y")
        places = [F.when(at(w) > 0, F.try_element_at("cells", at(w).cast("int"))) for w in RESULT_HEADINGS[name]]
        return F.coalesce(*places)

    known = F.exists("head", lambda h: h.isin(*[w for k in ("boat_name", "sail_number") for w in RESULT_HEADINGS[k]]))
    rows = body.filter(known).select("key", "table", "row", *[value(n).alias(n) for n in RESULT_HEADINGS])
    fleet = rows.groupBy("key", "table").agg(F.count("*").cast("int").alias("fleet_size"))
    place = F.regexp_extract("place", r"^\s*(\d+)", 1).try_cast("int")
    return rows.join(fleet, ["key", "table"]).withColumn("place_text", F.col("place")).withColumn("place", place).withColumn("rating", safe_number("rating"))


def line_rows(lines: DataFrame, column: str) -> DataFrame:
    """Result lines of text: place, sail, name, times in order (start, finish, elapsed, corrected), first decimal =
    rating; without place and elapsed time: DNF."""
    t = F.col(column)
    sail = F.regexp_extract(t, r"\b([A-Z]{1,5}\d{1,6})\b", 1)
    times = F.regexp_extract_all(t, F.lit(r"\d{1,3}:\d{2}:\d{2}"), F.lit(0))
    place = F.regexp_extract(t, r"^\s*(\d{1,3})\b", 1).try_cast("int")
    elapsed = F.when(F.size(times) >= 3, F.get(times, F.lit(2))).otherwise(F.when(F.size(times) == 1, F.get(times, F.lit(0))))
    name = F.trim(F.regexp_extract(t, r"\b[A-Z]{1,5}\d{1,6}\s+(.*?)\s+(?:\d{1,3}:\d{2}:\d{2}|\d\.\d{3}|-\s)", 1))
    return lines.withColumn("place", place).withColumn("sail_number", F.nullif(sail, F.lit(""))).withColumn("boat_name", F.nullif(name, F.lit(""))).withColumn(
        "elapsed", elapsed
    ).withColumn("corrected", F.get(times, F.lit(3))).withColumn("rating", F.regexp_extract(t, r"\b(\d\.\d{3,4})\b", 1).try_cast("double")).withColumn(
        "status", F.when(place.isNull() & elapsed.isNull(), "DNF").otherwise("finished")
    )


def name_parts(file_name: str | Column) -> list[Column]:
    """cert_boat_sail.pdf in three parts; further underscores stay in the last."""
    stem = F.regexp_replace(file_name, r"(?i)\.pdf$", "")
    parts = F.split(stem, "_", 3)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("cert_number", "boat_name", "sail_number"))]


def archive_listing(text: str | Column) -> Column:
    """A web archive's listing, an array of arrays with a heading row, as array<struct<timestamp, original>>."""
    rows = F.from_json(text, "array<array<string>>")
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.struct(F.get(r, F.lit(0)).alias("timestamp"), F.get(r, F.lit(1)).alias("original")))
