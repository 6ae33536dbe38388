"""Certificate pages: positioned words to lines, lines to fields, in four languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

# A word more than this below the first word of a line begins the next line.
LINE_HEIGHT = 5

# Labels of the heading by field, English, French, Spanish, Italian; the first that is found counts.
HEADING = {
    "name": (r"Name:\s*(.+?)(?:\n|$)", r"Nom:\s*(.+?)(?:\n|$)", r"Nombre:\s*(.+?)(?:\n|$)", r"Nome:\s*(.+?)(?:\n|$)"),
    "sail_number": (r"Sail Number:\s*(\S+)", r"No\. de voile:\s*(\S+)", r"N° de vela:\s*(\S+)", r"N° Velico:\s*(\S+)"),
    "design": (r"Design:\s*(.+?)(?:\n|$)", r"Type\s+(.+?)(?:CERTIFICAT|$)", r"Tipo:\s*(.+?)(?:CERTIFICADO|$)", r"Typo:\s*(.+?)(?:CERTIFICATO|$)"),
    "cert_number": (r"Cert No\.?:\s*(\d+)", r"N° de Cert\.?:\s*(\d+)", r"No\. de Cert\.?:\s*(\d+)", r"N° di Cert\.?:\s*(\d+)"),
    "crew": (r"Crew No\.?:\s*(\d+)", r"Equipiers:\s*(\d+)", r"No\. de tripulantes:\s*(\d+)", r"N° di Equipaggio:\s*(\d+)"),
    "expires": (r"Expires:\s*(.+?)(?:\n|$)", r"\bAu:\s*(\d.+?)(?:\n|$)", r"\bAl:\s*(\d.+?)(?:\n|$)", r"Hasta el:\s*(.+?)(?:\n|$)"),
}

# Fields of the body with a number that has a decimal point, by their label.
MEASURES = {
    "lh": "LH", "lwp": "LWP", "bo": "BO", "so": "SO", "p": r"\bP", "e": r"\bE", "j": r"\bJ", "stl": "STL", "spl": "SPL", "stl_fh_max": "STLFHmax", "hlp": "HLP",
    "muw": "MUW", "mtw": "MTW", "mhw": "MHW", "hlu": "HLU(?:/HLUmax)?", "huw": "HUW", "htw": "HTW", "hhw": "HHW", "hsa": "HSA",
    "spa": "SPA", "slu": "SLU", "sle": "SLE", "shw": "SHW", "sfl": "SFL", "x": r"\bx", "y": r",\s*y",
    "flu": "FLU", "fuw": "FUW", "ftw": "FTW", "fhw": "FHW", "fshw": "FSHW", "flp": "FLP", "fsfl": "FSFL",
}

# Fields of the body with labels of their own.
OTHERS = {
    "displacement": r"(?:Boat\s*Weight|Poids|Peso|Gewicht)\s*:\s*([\d,]+)(?:\s*kgs?)?",
    "draft": r"(?:Draft|Draught|Tirant\s*d['’]eau|Calado|Pescaggio|Tiefgang)\s*:\s*(\d+(?:\.\d+)?)",
    "internal_ballast": r"IB\s+(\d+)\s*kg",
    "fsa": r"FSA\s+(\d+[\.\d]*)\s*m",
}
COUNTS = {
    "dlr": r"DLR\s+(\d+)",
    "spreaders": r"(\d+)\s+Spreader",
    "headsails_max": r"headsails carried:\s*(\d+)",
    "flying_headsails_max": r"flying headsails carried:\s*(\d+)",
    "spinnakers_max": r"spinnakers carried:\s*(\d+)",
}
BALLAST, AFT_RIGGING = r"WB\s+(\d+)(?:\.\d+)?\s*L", r"Aft\b[^\n]*\n(\d+)(?:\s|$)"

# French names of months by the English ones, replaced in this order, and the months themselves.
FRENCH_MONTHS = {"Fév": "Feb", "Avr": "Apr", "Mai": "May", "Juin": "Jun", "Juil": "Jul", "Août": "Aug", "Déc": "Dec"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def page_lines(words: DataFrame, key: str) -> DataFrame:
    """key, page, line (from 1), text of positioned words (key, page, top, x, text).

    Words are read from the top to the bottom and from the left to the right, by their top rounded half to even. A line goes on
    while words lie no more than LINE_HEIGHT from its first word, however far from its last: a fold over the words of a
    page, the largest thing that one task holds. Words of one place come by text; null tops or texts are left out."""
    place = F.struct(F.bround("top", 0).alias("top"), F.col("x").cast("double").alias("x"), F.col("text").alias("text"))
    pages = words.filter("top IS NOT NULL AND text IS NOT NULL").groupBy(F.col(key).alias(key), "page").agg(F.array_sort(F.collect_list(place)).alias("words"))
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("double").alias("top"), F.array().cast("array<string>").alias("line"))

    def add(state: Column, word: Column) -> Column:
        same = F.abs(word["top"] - state["top"]) <= LINE_HEIGHT
        longer = F.struct(state["done"].alias("done"), state["top"].alias("top"), F.concat(state["line"], F.array(word["text"])).alias("line"))
        done = F.when(state["top"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.array_join(state["line"], " "))))
        return F.when(same, longer).otherwise(F.struct(done.alias("done"), word["top"].cast("double").alias("top"), F.array(word["text"]).alias("line")))

    lines = F.aggregate("words", begin, add, lambda s: F.concat(s["done"], F.array(F.array_join(s["line"], " "))))
    return pages.select(key, "page", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def certificate_pages(lines: DataFrame, key: str) -> DataFrame:
    """key, text: the lines (key, page, line, text) of a certificate below each other."""
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def found(text: Column, patterns: Sequence[str]) -> Column:
    """Array: of each pattern the first group of its first match, without white space around it, '' if there is none."""
    return F.transform(F.array(*[F.lit(f"(?i){p}") for p in patterns]), lambda p: stripped(F.call_function("regexp_extract", text, p, F.lit(1))))


def decimal(value: Column) -> Column:
    """A comma is a decimal point, one between thousands too, as in the original records; what then is no number is null."""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def expiry_date(text: Column) -> Column:
    """'31 Dec 26' or '31 Déc 2026', with or without a time of day; two-digit years from 69 are of the last century."""
    for french, english in FRENCH_MONTHS.items():
        text = F.replace(text, F.lit(french), F.lit(english))
    part = lambda i: F.regexp_extract(text, r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4}|\d{2})(?:\s+\d{1,2}:\d{1,2}:\d{1,2})?$", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    year = part(3).try_cast("int")
    year = F.when(F.length(part(3)) == 2, year + F.when(year < 69, 2000).otherwise(1900)).otherwise(year)
    return F.try_to_timestamp(F.format_string("%04d-%02d-%s", year, month, F.lpad(part(1), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def certificate_fields(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with the fields of the certificate on each: the heading from the whole text, measurements from HULL on (from the
    whole text if it has no HULL). The issue date is a year before expiry, the last of February for a leap day; a design
    loses the mark of water ballast and a draught at its end; water ballast is 0 where only the mark stands."""
    whole = F.coalesce(F.col(text), F.lit(""))
    body = F.substring(whole, F.greatest(F.instr(whole, "HULL"), F.lit(1)), F.length(whole))
    numbers = {n: rf"{label}\s+(\d+\.\d+)" for n, label in MEASURES.items()} | OTHERS | {"water_ballast": BALLAST} | COUNTS
    heads = [p for labels in HEADING.values() for p in labels]
    # behind each explode, so that nothing before it is worked out again for every field
    text_parts = F.explode(F.array(F.struct(whole.alias("whole"), body.alias("body"))))
    read = F.explode(F.array(F.struct(found(F.col("_t.whole"), heads).alias("head"), found(F.col("_t.body"), list(numbers.values())).alias("body"))))
    out = pages.withColumn("_t", text_parts).withColumn("_f", read)
    whole, body = F.col("_t.whole"), F.col("_t.body")
    at = {n: F.nullif(F.get("_f.body", F.lit(i)), F.lit("")) for i, n in enumerate(numbers)}
    fields = {}
    for i, name in enumerate(HEADING):
        fields[name] = F.coalesce(*[F.nullif(F.get("_f.head", F.lit(4 * i + k)), F.lit("")) for k in range(4)])
    out = out.withColumn("_h", F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))
    fields = {n: F.col(f"_h.{n}") for n in HEADING}
    design = fields["design"]
    fields["issue_date"] = F.add_months(expiry_date(fields.pop("expires")), -12)
    fields["crew"] = fields["crew"].try_cast("int")
    marked = F.coalesce(F.contains(F.upper(design), F.lit("WB")), F.lit(False))
    plain = stripped(F.regexp_replace(design, r"(?i)\s*WB\s*", " "))
    fields["design"] = stripped(F.regexp_replace(F.when(marked, plain).otherwise(design), r"\s+\d+\.\d+\s*$", ""))
    fields |= {n: decimal(at[n]) for n in (*MEASURES, *OTHERS)} | {n: at[n].try_cast("int") for n in COUNTS}
    fields["aft_rigging"] = F.nullif(F.regexp_extract(body, AFT_RIGGING, 1), F.lit("")).try_cast("int")
    fields["water_ballast"] = F.coalesce(decimal(at["water_ballast"]), F.when(marked, F.lit(0.0)))
    fields["mast_material"] = F.when(whole.rlike("(?i)alumin"), "aluminium").when(whole.rlike("(?i)carbon"), "carbon")
    return out.withColumns(fields).drop("_t", "_f", "_h")
