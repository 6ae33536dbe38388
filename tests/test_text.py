"""Clean-up functions on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from windrose.functions import text as tx


def each(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_sail_tokens(spark):
    cases = {"EAUS1213": {"EAUS1213", "AUS1213", "1213"}, "AUS1213": {"AUS1213", "1213"}, "1213": {"1213"}, "E-AUS-1213": {"1213"}, "AUS 1213": {"1213"}, "2561&011": {"2561", "011"}}
    got = dict(zip(cases, each(spark, [(c,) for c in cases], "s string", tx.sail_tokens("s")), strict=True))
    assert all(want <= set(got[c]) for c, want in cases.items()) and "2561&011" not in got["2561&011"]
    assert each(spark, [(None,), ("",), ("  ",)], "s string", tx.sail_tokens("s")) == [[], [], []]


def test_secondary(spark):
    rows = [("SUN FISH - SEC", None), ("toucan - sec", None), ("VERITE  -  SEC ", None), ("SUN FISH", "Y"), ("WILD OATS XI", ""), ("WILD OATS XI", None)]
    got = each(spark, rows, "n string, f string", tx.clean_name("n"), tx.is_secondary("n", "f"))
    assert got == [("SUN FISH", True), ("toucan", True), ("VERITE", True), ("SUN FISH", True), ("WILD OATS XI", False), ("WILD OATS XI", False)]


def test_status_tells_no_value_from_no_key(spark):
    codes = [({"finish_time": "10:00:00", "status": c}, None, c) for c in tx.STATUS_CODES]
    rows = [({"finish_time": None}, None, "DNF"), ({"finish_time": ""}, None, "DNF"), ({"finish_time": None}, 12, "finished"), ({"finish_time": None, "status": "DNF"}, 12, "DNF"), ({"finish_time": "2026-04-12T15:42:11"}, 1, "finished")]
    rows += codes + [({"finish_time": None, "status": "dns"}, None, "DNS"), ({"finish_time": None, "status": "MAYBE"}, None, "DNF"), ({"x": "y"}, 3, "finished"), (None, 1, "finished"), ({}, None, "finished")]
    assert each(spark, [r[:2] for r in rows], "raw map<string,string>, place int", tx.derive_status("raw", "place")) == [r[2] for r in rows]


def test_times_dates_and_numbers(spark):
    times = {"1 - 02:03:04": 93784, "1:02:03:04": 93784, "30:00:01": 108001, "59:30": 3570, "DNF": None, None: None}
    assert each(spark, [(t,) for t in times], "s string", tx.elapsed_seconds("s")) == list(times.values())
    dates = ["2024-05-01", "01/05/2024", "1 May 2024", "2024-05-01T10:00:00Z", "Race 3 (1/5/2024)", "soon", None]
    assert [str(d) for d in each(spark, [(d,) for d in dates], "s string", tx.flexible_date("s"))] == ["2024-05-01"] * 5 + ["None"] * 2
    assert each(spark, [("196.46",), ("x",), ("",), (" 7 ",)], "s string", tx.safe_int("s")) == [196, None, None, 7]
    assert each(spark, [("1,234.5 and -2",)], "s string", tx.numbers_in("s")) == [[1234.5, -2.0]]


def test_names_and_countries(spark):
    assert each(spark, [("  sun   fish - sec",), (None,)], "s string", tx.normalize_name("s")) == ["SUN FISH", ""]
    assert each(spark, [("AUS33",), ("K99",), ("1234",), ("AUSTRALIA",), ("MLT5",)], "s string", tx.country_from_sail("s"), tx.country_from_listing("s")) == [("AUS", "AUS"), ("GBR", None), (None, None), (None, None), ("MLT", None)]
    assert each(spark, [("D3300",), ("DEN1",), ("D",), ("DX1",)], "s string", tx.country_from_listing("s")) == ["GER", "DEN", "GER", None]
    assert each(spark, [(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 111)], "n int", tx.ordinal("n")) == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]
    assert each(spark, [(9.99, 3.37), (9.9, 3.4), (None, 1.0)], "a double, b double", tx.design_from_hull("a", "b")) == ["Sunfast 3300", None, None]
    assert each(spark, [("123",), ("12345",), ("A1",)], "s string", tx.ambiguous_sail("s")) == [True, False, False]
    assert each(spark, [("BENETEAU",), ("j/109",), ("Archambault",)], "s string", tx.canonical("s", {"J/109": "J 109"})) == ["Beneteau", "J 109", "Archambault"]


@pytest.mark.parametrize("a, b, want", [("word", "two words", 4 / 11), ("SUN FISH", "SUNFISH", 6 / 11), ("", "", 0.0), ("a", "a", 1.0)])
def test_trigrams(spark, a, b, want):
    assert each(spark, [(a, b)], "a string, b string", tx.trigram_similarity("a", "b"))[0] == pytest.approx(want)


def test_class_sections(spark):
    page = "intro\n### IRC Class 1 Fleet\n" + "| a | b |\n" * 30 + "### Race - IRC Class 2 Fleet\n" + "| c | d |\n" * 30 + "z" * 10_000
    (got,) = each(spark, [(page,)], "s string", tx.class_sections("s"))
    assert [g.body[:8] for g in got] == ["intro\n", "### IRC ", "### Race"] or len(got) == 3
    assert all(page[g.offset :].startswith(g.body) for g in got)
    assert len(each(spark, [("short",)], "s string", tx.class_sections("s"))[0]) == 1
    assert spark.range(1).select(F.lit(1)).count() == 1
