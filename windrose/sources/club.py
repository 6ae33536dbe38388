"""Club result sheets: text lines whose fields may hold blanks, and extracted tables with broken headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..operators.resolve import dealt

# Patterns of the fields, and the codes of boats that didn't finish, in the order in which tables are
# searched for them.
SAIL, TIME, NUMBER = r"[A-Z]{2,5}\d{1,6}|[A-Z]\d{2,6}", r"\d{1,2}:\d{2}:\d{2}", r"\d+\.\d+"
CODES = ("DNF", "DNS", "DSQ", "OCS", "RET", "NSC", "DNC", "RAF")
# Beginnings of lines that aren't results.
NO_RESULTS = ("Division:", "Around ", "Page ")
# The meaning of a heading; (field, words it may contain, words it may be equal to), the first that fits.
HEADINGS = (
    ("place", ("place",), ()),
    ("division", ("division", "class"), ()),
    ("sail_no", ("sail",), ()),
    ("name", ("boat",), ("name",)),
    ("skipper", ("kipper", "helm"), ()),
    ("start", ("start",), ()),
    ("finish", ("finish",), ()),
    ("elapsed", ("elapsed",), ()),
    ("rating", ("rhkati", "rating"), ("irc",)),
    ("corrected", ("corrected",), ()),
    ("additional", ("additional", "remark", "note"), ()),
)


def line_fields(line: Column) -> dict[str, Column]:
    """The fields of one line: [place] division, sail number, names, start, finish, elapsed, rating, corrected, remarks.

    Only the sail number and the times have a fixed form, so they hold the rest apart: what stands before the sail number
    is the place (digits with something after them) and the division, what stands up to the first time is the boat's
    name, its skipper included. Behind that, times count in their order, whatever stands between them, a lone '-' is a
    missing one, the first number with a point is the rating and what is left is a remark. All are null without a sail
    number. A code anywhere is the status; without one, a boat with neither place nor elapsed time didn't finish. The name
    ends before the code if no time follows; a code before the sail number cuts nothing off the name."""
    line = stripped(line)
    sail = F.nullif(F.regexp_extract(line, f"({SAIL})", 1), F.lit(""))
    before = F.regexp_extract(line, f"^(.*?)(?:{SAIL})", 1)
    after = stripped(F.substring(line, F.length(before) + F.length(sail) + 1, F.length(line)))
    head = stripped(before)
    numbered = head.rlike(r"^\d+\s")
    division = F.nullif(F.when(numbered, stripped(F.regexp_extract(head, r"^\d+\s+(.*)", 1))).otherwise(head), F.lit(""))
    code = F.nullif(F.regexp_extract(line, rf"\b({'|'.join(CODES)})\b", 1), F.lit(""))
    timed = after.rlike(TIME)
    names = stripped(F.regexp_extract(after, f"^(.*?){TIME}", 1))
    cut = F.regexp_replace(F.substring(after, F.lit(1), F.position(code, after) - 1), r"[\s-]+$", "")
    name = F.when(timed, names).when(code.isNotNull() & F.contains(after, code), stripped(cut)).otherwise(after)
    rest = F.split(F.regexp_extract(after, f"({TIME}.*)$", 1), r"\s+")
    is_time, is_number = (lambda x: x.rlike(f"^{TIME}$")), (lambda x: x.rlike(f"^{NUMBER}$"))
    times = F.transform(F.filter(rest, lambda x: is_time(x) | (x == "-")), lambda x: F.nullif(x, F.lit("-")))
    at = lambda i: F.when(timed, F.get(times, F.lit(i)))
    left = F.filter(rest, lambda x: ~is_time(x) & ~is_number(x) & (x != "-"))
    place = F.when(numbered, F.regexp_extract(head, r"^(\d+)", 1).try_cast("int"))
    return {
        "place": place,
        "division": division,
        "sail_no": sail,
        "boat_name": name,
        "start": at(0),
        "finish": at(1),
        "elapsed": at(2),
        "corrected": at(3),
        "rating": F.when(timed, F.get(F.filter(rest, is_number), F.lit(0)).try_cast("double")),
        "additional": F.when(timed, F.nullif(F.array_join(left, " "), F.lit(""))),
        "status": F.coalesce(code, F.when(place.isNull() & at(2).isNull(), "DNF").otherwise("finished")),
    }


def club_lines(lines: DataFrame, key: str, line: str = "text") -> DataFrame:
    """Result lines of sheets (key, page, line, text) with their fields and fleet_size, the results of the sheet.

    Results begin below the sheet's first line that holds place, sail and name; such lines themselves, further headings and lines
    without a sail number are none. Lines of a sheet without a heading are none either."""
    t = F.lower(line)
    heading = t.contains("place") & t.contains("sail") & t.contains("name")
    place = F.struct("page", "line")
    start = lines.filter(heading).groupBy(key).agg(F.min(place).alias("_start"))
    none = heading | stripped(line).rlike("^(" + "|".join(NO_RESULTS) + ")")
    # a line is read once, before it meets its sheet, in tasks that hold lines of any; a filter before the count would be
    # pushed down to the scan and read it again
    rows = dealt(lines.filter(~none), key, "page", "line").withColumns(line_fields(F.col(line)))
    rows = rows.join(start.hint("merge"), key).filter(place > F.col("_start")).drop("_start")
    return rows.withColumn("fleet_size", F.count("sail_no").over(Window.partitionBy(key)).cast("int")).filter("sail_no IS NOT NULL")


def heading_kinds(cells: Column) -> Column:
    """The field that each heading names, '' for none. 'Skipper' broken into 'S' and 'kipper' is where the latter stands."""

    def kind(cell: Column) -> Column:
        h = F.lower(F.replace(stripped(F.coalesce(cell, F.lit(""))), F.lit("\n"), F.lit(" ")))
        out = F.when(h == "", "")
        for field, parts, wholes in HEADINGS:
            fits = F.lit(False)
            for p in parts:
                fits = fits | h.contains(p)
            out = out.when(fits | h.isin(*wholes) if wholes else fits, field)
        return out.otherwise("")

    return F.transform(cells, kind)


def table_fields(cells: Column, kinds: Column) -> dict[str, Column]:
    """The fields of a row of a table, its cells stripped, by the kinds of its headings; of two headings of a kind the last counts.

    A missing division is what stands in unnamed columns between place and sail number, as a long one spreads over
    them. Elapsed and corrected times are null unless they begin with h:m:s; the place is made of the digits of its cell."""
    index = lambda field: F.size(kinds) - F.array_position(F.reverse(kinds), F.lit(field)).cast("int")  # noqa: E731  from 0; the size if absent
    has = lambda field: F.array_contains(kinds, field)
    cell = lambda field: F.when(has(field), F.nullif(F.get(cells, index(field)), F.lit("")))
    time = lambda field: F.when(cell(field).rlike(r"^\d+:\d+:\d+"), cell(field))
    first = F.when(has("place"), index("place")).otherwise(0)
    last = F.when(has("sail_no"), index("sail_no")).otherwise(F.size(cells))
    between = F.filter(cells, lambda x, i: (i > first) & (i < last) & (x != "") & (F.coalesce(F.get(kinds, i), F.lit("")) == ""))
    remark = F.upper(stripped(F.concat_ws(" ", F.coalesce(cell("additional"), F.lit("")), F.coalesce(cell("place"), F.lit("")))))
    status = F.coalesce(*[F.when(remark.contains(c), c) for c in CODES])
    place = F.regexp_replace(cell("place"), r"\D", "").try_cast("int")
    return {
        "place": place,
        "division": F.coalesce(cell("division"), F.nullif(F.array_join(between, " "), F.lit(""))),
        "sail_no": cell("sail_no"),
        "boat_name": cell("name"),
        "skipper": cell("skipper"),
        "elapsed": time("elapsed"),
        "corrected": time("corrected"),
        "rating": F.regexp_replace(cell("rating"), "[\u00a0,]", "").try_cast("double"),
        "additional": cell("additional"),
        "status": F.coalesce(status, F.when(place.isNull() & time("elapsed").isNull(), "DNF").otherwise("finished")),
    }


def club_tables(cells: DataFrame) -> DataFrame:
    """Results of extracted tables (key, table, row, cells): rows below a heading with place and sail or name, read by the last
    heading above them; a table without one, or of one row, has none, and rows without a boat's name are none. fleet_size: the
    results of the sheet."""
    rows = dealt(cells, "key", "table", "row").withColumn("_cells", F.explode(F.array(F.transform("cells", lambda x: stripped(F.coalesce(x, F.lit("")))))))
    text = F.lower(F.array_join("_cells", " "))
    rows = rows.withColumn("_heading", text.contains("place") & (text.contains("sail") | text.contains("name")))
    # the headings of a table: one, or one a page that it runs over
    heads = rows.filter("_heading").groupBy("key", "table").agg(F.array_sort(F.collect_list(F.struct("row", heading_kinds(F.col("cells")).alias("kinds")))).alias("_heads"))
    body = rows.filter("NOT _heading").join(heads.hint("merge"), ["key", "table"])
    last = F.element_at(F.filter("_heads", lambda h: h["row"] < F.col("row")), -1)
    body = body.filter(F.get(F.col("_heads"), F.lit(0))["row"] < F.col("row")).withColumn("_kinds", last["kinds"])
    found = body.withColumns(table_fields(F.col("_cells"), F.col("_kinds"))).drop("_heads", "_kinds", "_heading", "cells", "_cells")
    return found.withColumn("fleet_size", F.count("boat_name").over(Window.partitionBy("key")).cast("int")).filter("boat_name IS NOT NULL")
