"""Upkeep of the table of design classes: samples from certificates, patches of empty columns, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of a sample, and the keys of a raw certificate that stand in for a missing one, in order.
RAW_KEYS = {"designer": ("Designer",), "builder": ("Builder",), "year": ("Age_Year",), "loa": ("LOA",), "draft": ("Draft",), "displacement": ("Dspl_Sailing", "Dspl_Measurement")}
KINDS = {"designer": "string", "builder": "string", "year": "int"}
# How far a derived number may be from the one in the class table before it is reported.
TOLERANCE = {"loa": 0.5, "beam": 0.3, "draft": 0.3, "displacement": 500.0}


def design_samples(certificates: DataFrame, raw: str = "raw") -> DataFrame:
    """certificates with each column of RAW_KEYS from the certificate itself, else from its raw JSON. An empty text and the
    year 0 are missing; a number is missing if it is null, and a raw 0 is none. What isn't JSON has no keys."""
    v = F.try_parse_json(raw)
    out = {}
    for column, keys in RAW_KEYS.items():
        kind = KINDS.get(column, "double")
        nothing = F.lit("") if kind == "string" else F.lit(0).cast(kind)
        own = F.col(column).cast(kind)
        own = F.nullif(own, nothing) if column in KINDS else own
        out[column] = F.coalesce(own, *[F.nullif(F.try_variant_get("_v", f"$.{k}", kind), nothing) for k in keys])
    return certificates.withColumn("_v", v).withColumns(out).drop("_v")


def design_of_raw(text: str | Column) -> Column:
    """A raw design without its draught and what stands behind it: all from the first number with a point that follows
    white space."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(text), r"(?s)\s\d+\.\d+\b.*$", "")), F.lit(""))


def design_updates(classes: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, old, new, action: what derived values would change, a row a cell. 'fill' for an empty cell; 'differs' for a number
    further from the derived one than TOLERANCE, or another text, which stay as they are. Names are compared without regard to
    case and runs of blanks; several classes of one such name get the same values."""
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    new = derived.groupBy(name(F.col(key)).alias("_k")).agg(*[F.min(c).alias(f"_{c}") for c in columns])
    both = classes.select(key, *columns, name(F.col(key)).alias("_k")).join(new, "_k")
    cells = []
    for c in columns:
        known = F.col(c).isNotNull()
        far = F.abs(F.col(c) - F.col(f"_{c}")) > TOLERANCE[c] if c in TOLERANCE else F.col(c) != F.col(f"_{c}")
        action = F.when(F.col(f"_{c}").isNull(), None).when(~known, "fill").when(far, "differs")
        cells.append(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), F.col(f"_{c}").cast("string").alias("new"), action.alias("action")))
    return both.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").filter("action IS NOT NULL")


def apply_fills(classes: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """classes with the empty cells of 'fill' updates filled."""
    columns = [c for c in classes.columns if c != key]
    wide = updates.filter("action = 'fill'").groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col("new"))).alias(f"_{c}") for c in columns])
    kinds = {f.name: f.dataType for f in classes.schema}
    return classes.join(wide, key, "left").select(*[F.col(c) if c == key else F.coalesce(c, F.col(f"_{c}").try_cast(kinds[c])).alias(c) for c in classes.columns])


class Sweep:
    """Names of boats' designs brought to their canonical form where the class table has that form. One join decides for every boat; all results
    are views of it: boats after, audit (key, old, new), skipped (target, n) and counts."""

    def __init__(self, boats: DataFrame, classes: DataFrame, key: str, design: str, canonical: Column, name: str):
        known = classes.filter(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
        target = F.coalesce(F.when(F.col(design).isNotNull(), canonical), F.col(design))
        rows = boats.withColumn("_new", target)
        rows = rows.join(known.select(F.col("_name").alias(design), F.lit(True).alias("_had")), design, "left")
        rows = rows.join(known.select(F.col("_name").alias("_new"), F.lit(True).alias("_has")), "_new", "left")
        plan = F.when(F.col(design).isNull(), "none").when(F.col("_new") == F.col(design), "kept").when(F.col("_has"), "applied").otherwise("skipped")
        self.rows, self.key, self.design, self.columns = rows.withColumn("_plan", plan), key, design, boats.columns

    def boats(self) -> DataFrame:
        after = F.when(F.col("_plan") == "applied", F.col("_new")).otherwise(F.col(self.design))
        return self.rows.select(*[after.alias(c) if c == self.design else F.col(c) for c in self.columns])

    def audit(self) -> DataFrame:
        return self.rows.filter("_plan = 'applied'").select(self.key, F.col(self.design).alias("old_value"), F.col("_new").alias("new_value"))

    def skipped(self) -> DataFrame:
        """Canonical forms that the class table lacks, and how many boats wait for each."""
        return self.rows.filter("_plan = 'skipped'").groupBy(F.col("_new").alias("target")).agg(F.count("*").alias("n"))

    def counts(self) -> DataFrame:
        """One row: considered = kept + planned, planned = applied + skipped; boats and distinct designs without a class, before and after."""
        plan, design = F.col("_plan"), F.col(self.design)
        lost = F.col(self.design).isNotNull() & F.col("_had").isNull()
        after = lost & (plan != "applied")  # a target that is applied has a class
        part = lambda *of: F.count_if(plan.isin(*of))
        return self.rows.agg(
            part("kept", "applied", "skipped").alias("considered"), part("kept").alias("kept"), part("applied", "skipped").alias("planned"), part("applied").alias("applied"), part("skipped").alias("skipped"),
            F.count_if(lost).alias("orphans_before"), F.countDistinct(F.when(lost, design)).alias("orphans_before_distinct"), F.count_if(after).alias("orphans_after"), F.countDistinct(F.when(after, design)).alias("orphans_after_distinct"),
        )


def canonical_by(aliases: DataFrame, boats: DataFrame, design: str, to: str = "canonical") -> DataFrame:
    """boats with the canonical form of their design from an alias table (alias, name) of any size, case aside; names written all
    in capitals that have no alias are put in capitalised words, others stay."""
    known = aliases.groupBy(F.lower(F.trim("alias")).alias("_a")).agg(F.min("name").alias("_n"))
    t = F.trim(design)
    return boats.withColumn("_a", F.lower(t)).join(known, "_a", "left").withColumn(to, F.coalesce("_n", F.when((t == F.upper(t)) & (t != F.lower(t)), F.initcap(t)).otherwise(t))).drop("_a", "_n")
