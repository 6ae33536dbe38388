"""Certificate pages and club sheets."""

import datetime as dt

from windrose.sources import certificates, club


def lines_of(spark, words):
    df = spark.createDataFrame(words, "cert long, page long, top double, x double, text string")
    return {(r.cert, r.page, r.line): r.text for r in certificates.page_lines(df, "cert").collect()}


def test_a_line_ends_by_its_first_word(spark):
    """Tops of 10, 14 and 18 are two lines, though no two neighbours are more than 5 apart."""
    words = [(1, 1, 14.0, 1.0, "b"), (1, 1, 10.0, 5.0, "a"), (1, 1, 18.0, 0.0, "c"), (1, 2, 10.4, 9.0, "z"), (1, 2, 9.6, 1.0, "y"), (2, 1, 3.0, 1.0, "x"), (2, 1, None, 1.0, "lost"), (2, 1, 1.0, 1.0, None)]
    assert lines_of(spark, words) == {(1, 1, 1): "a b", (1, 1, 2): "c", (1, 2, 1): "y z", (2, 1, 1): "x"}


def test_tops_are_rounded_half_to_even(spark):
    assert lines_of(spark, [(1, 1, 0.5, 1.0, "a"), (1, 1, 5.5, 1.0, "b")]) == {(1, 1, 1): "a", (1, 1, 2): "b"}
    assert lines_of(spark, [(1, 1, 0.5, 1.0, "a"), (1, 1, 4.5, 1.0, "b")]) == {(1, 1, 1): "a b"}


def fields(spark, text):
    return certificates.certificate_fields(spark.createDataFrame([(1, text)], "id long, text string")).first()


def test_headings_of_four_languages(spark):
    c = fields(spark, "Nome: LA BELLA\nN° Velico: ITA1\nTypo: SWAN WB 45 2.10 CERTIFICATO\nN° di Cert.: 77\nN° di Equipaggio: 9\nAl: 31 Mar 1999\nHULL\nPescaggio: 2,5")
    assert (c.name, c.sail_number, c.design, c.cert_number, c.crew, c.issue_date, c.draft, c.water_ballast) == ("LA BELLA", "ITA1", "SWAN 45", "77", 9, dt.date(1998, 3, 31), 2.0, 0.0)
    c = fields(spark, "Nom: L'AUTRE\nType FIRST 30 CERTIFICAT 2025\nAu: 31 Juil 25\nHULL\nPoids: 3,200 kgs\nTirant d’eau : 1.8\nAft stays\n2 x\n")
    assert (c.name, c.design, c.issue_date, c.displacement, c.draft, c.aft_rigging, c.water_ballast) == ("L'AUTRE", "FIRST 30", dt.date(2024, 7, 31), 3.2, 1.8, 2, None)


def test_measures_come_from_the_body_only(spark):
    c = fields(spark, "Name: A\nNotes LH 6.25\nCarbon mast, aluminium boom\nHULL\nlh 10.1 LWP 9\nP 12.0 SP 13.0\nflying headsails carried: 2\n3 Spreaders")
    assert (c.lh, c.lwp, c.p, c.headsails_max, c.flying_headsails_max, c.spreaders, c.mast_material) == (10.1, None, 12.0, 2, 2, 3, "aluminium")
    c = fields(spark, "LH 6.25 no section")
    assert c.lh == 6.25 and c.name is None and c.issue_date is None


def test_empty_and_odd_certificates(spark):
    for text in (None, "", "HULL", "Expires: 99 Dec 26\nName:   "):
        c = fields(spark, text)
        assert c.name is None and c.issue_date is None
    assert fields(spark, "Expires: 30 Feb 26").issue_date is None and fields(spark, "HULL WB 5.9 L").water_ballast == 5.0
    assert certificates.certificate_fields(spark.createDataFrame([], "id long, text string")).count() == 0


def test_lines_read_around_what_has_a_form(spark):
    texts = ["1 x HKG9 before the heading", "Place Division Sail No. Name", " 1 Fast Fleet 3 HKG2548 Rampage 88 Noel Chan 11:00:00 14:34:48 3:34:48 1.377 4:55:47", "Dragon D38 Phyloong Martin Tsai 8:40:00 - - - DNF"]
    texts += ["no sail", "7 HKG12 Boat", "RAF Class GBR1 Late - -", "Division: HKG1", "2 A1 B B22 Sun - - RET", ""]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)] + [(2, 0, 0, "1 x HKG9 without a heading")], "sheet long, page long, line long, text string")
    got = {r.line: (r.place, r.division, r.sail_no, r.boat_name, r.elapsed, r.corrected, r.rating, r.additional, r.status, r.fleet_size) for r in club.club_lines(df, "sheet").collect()}
    assert got == {
        2: (1, "Fast Fleet 3", "HKG2548", "Rampage 88 Noel Chan", "3:34:48", "4:55:47", 1.377, None, "finished", 5),
        3: (None, "Dragon", "D38", "Phyloong Martin Tsai", None, None, None, "DNF", "DNF", 5),
        5: (None, "7", "HKG12", "Boat", None, None, None, None, "DNF", 5),
        6: (None, "RAF Class", "GBR1", "Late - -", None, None, None, None, "RAF", 5),
        8: (2, "A1 B", "B22", "Sun", None, None, None, None, "RET", 5),
    }


def test_tables_with_broken_headings(spark):
    head = ["Place", None, "Sail", "Boat", "S", "kipper", "Elapsed", "IRC", "Note"]
    rows = [
        (1, 0, 0, ["1", "above", "X1", "no heading yet", "", "", "", "", ""]),
        (1, 0, 1, head),
        (1, 0, 2, ["3rd", " Class A ", "GBR1", " Kite ", "x", "Ann", "1:02:03 h", "1,0 01.5", None]),
        (1, 0, 3, ["", "", "GBR2", "Moon", None, "", "soon", "-", "protest: dsq"]),
        (1, 0, 4, ["", "", "GBR3", "Sun"]),
        (1, 0, 5, ["9", "", "GBR4", " "]),
        (1, 1, 0, ["Menu"]),
        (2, 0, 0, ["Name", "Rank"]),
    ]
    got = club.club_tables(spark.createDataFrame(rows, "key long, `table` int, row int, cells array<string>")).collect()
    assert {r.row: (r.place, r.division, r.sail_no, r.boat_name, r.skipper, r.elapsed, r.rating, r.status, r.fleet_size) for r in got} == {
        2: (3, "Class A", "GBR1", "Kite", "Ann", "1:02:03 h", 1001.5, "finished", 3),
        3: (None, None, "GBR2", "Moon", None, None, None, "DSQ", 3),
        4: (None, None, "GBR3", "Sun", None, None, None, "DNF", 3),
    }
