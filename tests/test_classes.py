"""Samples of design classes, patches and sweeps."""

from pyspark.sql import functions as F

from windrose.operators import classes


def test_samples_take_raw_keys_where_the_certificate_has_nothing(spark):
    rows = [
        (1, "", None, 0, None, None, None, '{"Designer": "Raw", "Builder": "", "Age_Year": 1999, "LOA": 0, "Draft": 2.5, "Dspl_Sailing": null, "Dspl_Measurement": 4000}'),
        (2, "Own", "Yard", 2001, 0.0, 1.0, 5.0, '{"Designer": "Raw", "LOA": 9.9}'),
        (3, None, None, None, None, None, None, "not json"),
        (4, None, None, None, None, None, None, None),
        (5, None, None, None, None, None, None, '{"Age_Year": "1987", "LOA": "10.5", "Draft": "deep"}'),
    ]
    df = spark.createDataFrame(rows, "id int, designer string, builder string, year int, loa double, draft double, displacement double, raw string")
    got = {r.id: (r.designer, r.builder, r.year, r.loa, r.draft, r.displacement) for r in classes.design_samples(df).collect()}
    assert got == {
        1: ("Raw", None, 1999, None, 2.5, 4000.0),
        2: ("Own", "Yard", 2001, 0.0, 1.0, 5.0),
        3: (None,) * 6,
        4: (None,) * 6,
        5: (None, None, 1987, 10.5, None, None),
    }


def test_raw_designs_end_before_their_draught(spark):
    names = {"J 109 2.10": "J 109", "SUN FAST 3300 1.95 WB": "SUN FAST 3300", "FIRST 35 2.20 (09)": "FIRST 35", " FIRST 40 CR 2.45": "FIRST 40 CR", "J/99": "J/99", "1.5 TONNER": "1.5 TONNER", "": None}
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string").withColumn("d", classes.design_of_raw("n"))
    assert {r.n: r.d for r in df.collect()} == names | {None: None}


def test_updates_fill_empty_cells_and_report_far_ones(spark):
    table = spark.createDataFrame([(1, "Sun  Fast", None, 10.0), (2, "J 109", "Yard", 10.7), (3, "Other", None, None), (4, "sun fast ", "X", 10.4)], "id int, name string, builder string, loa double")
    derived = spark.createDataFrame([("SUN FAST", "Jeanneau", 10.45), ("j 109", "Yard", 11.3), ("new", "x", 1.0)], "name string, builder string, loa double")
    u = classes.design_updates(table, derived, "name", ["builder", "loa"])
    assert sorted((r["name"], r["column"], r.action, r.new) for r in u.collect()) == [("J 109", "loa", "differs", "11.3"), ("Sun  Fast", "builder", "fill", "Jeanneau"), ("sun fast ", "builder", "differs", "Jeanneau")]
    after = classes.apply_fills(table, u, "name")
    assert sorted((r.id, r.builder, r.loa) for r in after.collect()) == [(1, "Jeanneau", 10.0), (2, "Yard", 10.7), (3, None, None), (4, "X", 10.4)]
    assert classes.design_updates(after, derived, "name", ["builder", "loa"]).filter("action = 'fill'").count() == 0


def test_a_sweep_adds_up(spark):
    boats = spark.createDataFrame([(1, "SUN FAST"), (2, "Sun Fast"), (3, "sf"), (4, "GONE"), (5, None), (6, "SF"), (7, "lost"), (8, "J/99")], "id int, design string")
    table = spark.createDataFrame([("Sun Fast",), ("J/99",), (None,)], "name string")
    aliases = spark.createDataFrame([("SF ", "Sun Fast"), ("lost", "Found")], "alias string, name string")
    named = classes.canonical_by(aliases, boats, "design")
    s = classes.Sweep(named, table, "id", "design", F.col("canonical"), "name")
    assert sorted(map(tuple, s.audit().collect())) == [(1, "SUN FAST", "Sun Fast"), (3, "sf", "Sun Fast"), (6, "SF", "Sun Fast")]
    assert sorted(map(tuple, s.skipped().collect())) == [("Found", 1), ("Gone", 1)]
    c = s.counts().first().asDict()
    assert c["considered"] == c["kept"] + c["planned"] == 7 and c["planned"] == c["applied"] + c["skipped"] == 5
    assert (c["orphans_before"], c["orphans_before_distinct"], c["orphans_after"], c["orphans_after_distinct"]) == (5, 5, 2, 2)
    assert {r.id: r.design for r in s.boats().collect()} == {1: "Sun Fast", 2: "Sun Fast", 3: "Sun Fast", 4: "GONE", 5: None, 6: "Sun Fast", 7: "lost", 8: "J/99"}
    assert s.boats().columns == named.columns
