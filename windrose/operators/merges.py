"""Merging duplicate boats over all tables that name them: chains of merges, collisions of keys, audit, and one commit."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """How a table is merged. boat: the column that names a boat; id: a row's own id. Rows of boats that become one
    collide if they agree in all of unique (null with null too; rows with a null in needed don't collide): the one with the
    largest rank stays, among equals the winner's own, then that of the smallest losing boat. No unique: rows are only repointed."""

    boat: str
    id: str
    kind: str = "row"
    unique: Sequence[Column] = ()
    needed: Sequence[Column] = ()
    rank: Column = field(default_factory=lambda: F.lit(0))


def choose_winners(members: DataFrame, certificates: DataFrame, results: DataFrame) -> DataFrame:
    """cluster, loser, winner from members (cluster, boat_id, created_at): the boat with the latest certificate (boat_id,
    issue_date) wins, then the one with the most results (boat_id), the earliest, the smallest id. Clusters of one
    boat, as after a merge, give no rows."""
    latest = certificates.groupBy("boat_id").agg(F.max("issue_date").alias("_latest"))
    races = results.groupBy("boat_id").agg(F.count("*").alias("_races"))
    facts = members.select("cluster", "boat_id", "created_at").distinct().join(latest, "boat_id", "left").join(races, "boat_id", "left")
    order = F.struct(F.coalesce(-F.unix_date("_latest"), F.lit(2**31 - 1)), -F.coalesce("_races", F.lit(0)), F.col("created_at").isNull(), "created_at", "boat_id")
    best = facts.groupBy("cluster").agg(F.min_by("boat_id", order).alias("winner"))
    return facts.join(best, "cluster").filter("boat_id <> winner").select("cluster", F.col("boat_id").alias("loser"), "winner")


def follow(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loser, last winner) of pairs (loser, winner), and the losers whose chain runs in a circle, which are not merged.

    Every round doubles the length of the chains that are followed; of several winners of a boat the smallest counts, a boat that
    would win over itself is left alone."""
    checkpoint_dir(pairs.sparkSession)
    link = pairs.filter("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner")).checkpoint()
    longest = link.count()
    for _ in range(max(1, math.ceil(math.log2(longest + 1)))):
        on = link.select(F.col("loser").alias("winner"), F.col("winner").alias("further"))
        ahead = link.join(on, "winner", "left").select("loser", F.coalesce("further", "winner").alias("winner"), F.col("further").isNotNull().alias("open")).checkpoint()
        link = ahead.select("loser", "winner")
        if not ahead.filter("open").limit(1).count():
            break
    losers = link.select(F.col("loser").alias("winner"))
    return link.join(losers, "winner", "left_anti").select("loser", "winner"), link.join(losers, "winner", "left_semi").select("loser")


def merged(df: DataFrame, winners: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """df with losing boats (loser, winner) replaced, and the rows that went: loser, kind, row (as JSON).

    Rows are compared in the order of the merges: the winner's own, then each loser's by its id. A row that doesn't rank
    above the best so far is dropped by the loser it comes with; one that does replaces that best. Only boats that take part are touched;
    a group that is compared holds a row or so for each of them."""
    taking_part = winners.select("loser", "winner").union(winners.select("winner", "winner").distinct()).withColumnRenamed("loser", rule.boat).withColumnRenamed("winner", "_to")
    own = df.columns
    rest = df.join(taking_part.select(rule.boat), rule.boat, "left_anti").select(own)
    moved = df.join(taking_part, rule.boat).withColumn("_loser", F.when(F.col(rule.boat) != F.col("_to"), F.col(rule.boat)))
    moved = moved.withColumns({"_row": F.to_json(F.struct(*own)), "_rank": rule.rank, rule.boat: F.col("_to").cast(df.schema[rule.boat].dataType)})
    none = moved.limit(0).select("_loser", F.lit("").alias("kind"), "_row").toDF("loser", "kind", "row")
    if not rule.unique:
        return rest.unionByName(moved.select(own)), none
    fits = F.lit(True)
    for c in rule.needed:
        fits = fits & c.isNotNull()
    compared = moved.filter(fits).withColumns({f"_u{i}": c for i, c in enumerate(rule.unique)})
    group = Window.partitionBy("_to", *[f"_u{i}" for i in range(len(rule.unique))])
    turn = group.orderBy(F.col("_loser").asc_nulls_first(), rule.id)
    best = F.max("_rank").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(turn) == 1
    judged = compared.withColumns({"_best": best, "_first": first, "_any": F.min("_loser").over(group)})
    judged = judged.withColumn("_rises", F.col("_first") | F.coalesce(F.col("_rank") > F.col("_best"), F.col("_rank").isNotNull() & F.col("_best").isNull()))
    fell = judged.filter("NOT _rises AND _any IS NOT NULL").select(F.coalesce("_loser", "_any").alias("loser"), F.lit(f"{rule.kind}_collision_dropped").alias("kind"), F.col("_row").alias("row"))
    risen = judged.filter("_rises OR _any IS NULL").withColumn("_by", F.when(F.col("_any").isNotNull(), F.lead(F.coalesce("_loser", "_any")).over(turn)))
    replaced = risen.filter("_by IS NOT NULL").select(F.col("_by").alias("loser"), F.lit(f"{rule.kind}_collision_replaced_winner").alias("kind"), F.col("_row").alias("row"))
    kept = rest.unionByName(moved.filter(~fits).select(own)).unionByName(risen.filter("_by IS NULL").select(own))
    return kept, fell.unionByName(replaced)


def merge_boats(boats: DataFrame, pairs: DataFrame, tables: Mapping[str, DataFrame], rules: Mapping[str, Rule], boat_id: str = "id") -> dict[str, DataFrame]:
    """Every table with its losers' rows repointed, `boats` without them, and `boat_merges`: one row a loser with its own row
    and the rows that went with it, as JSON. pairs: loser, winner; boats that are gone already, and circles, are left out, so
    a second run changes nothing. No row that names a loser remains, as every rule repoints what it keeps."""
    known = boats.select(F.col(boat_id).alias("loser"))
    there = pairs.select("loser", "winner").join(known, "loser", "left_semi").join(known.withColumnRenamed("loser", "winner"), "winner", "left_semi")
    winners, _ = follow(there)
    out, gone = {}, None
    for name, df in tables.items():
        out[name], dropped = merged(df, winners, rules[name])
        gone = dropped if gone is None else gone.unionByName(dropped)
    rows = boats.join(winners, boats[boat_id] == winners["loser"]).select("loser", "winner", F.struct(*boats.columns).alias("boat"))
    if gone is None:
        rows = rows.withColumn("extras", F.expr("cast(array() AS array<struct<kind:string,row:string>>)"))
    else:
        extras = gone.groupBy("loser").agg(F.array_sort(F.collect_list(F.struct("kind", "row"))).alias("extras"))  # the collisions of one boat
        rows = rows.join(extras, "loser", "left")
    snapshot = F.to_json(F.struct("boat", F.coalesce("extras", F.expr("cast(array() AS array<struct<kind:string,row:string>>)")).alias("extras")))
    out["boat_merges"] = rows.select(F.col("winner").alias("winner_id"), F.col("loser").alias("loser_id"), snapshot.alias("loser_snapshot"))
    out["boats"] = boats.join(winners.select(F.col("loser").alias(boat_id)), boat_id, "left_anti").select(boats.columns)
    return out


class Versions:
    """A folder of tables that change together. A version of a table is a folder of its own; a manifest names the version
    of each table, and a commit is the renaming of one file. A reader sees all tables of a commit or none; what a failed run
    wrote is named by no manifest and goes with the next clean()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        if not self.fs.exists(self.of(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.of(self.path))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))

    def current(self) -> tuple[int, dict[str, str]]:
        """The number of the last commit, 0 before the first, and the version of each table."""
        numbers = self._manifests()
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/manifest-{numbers[-1]:09d}", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def read(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{self.path}/{name}/{version}") for name, version in self.current()[1].items()}

    def commit(self, tables: Mapping[str, DataFrame], appended: Sequence[str] = ()) -> int:
        """Write the tables, then swap the manifest. appended: tables whose rows come to those that are there. Fails if
        somebody else committed meanwhile."""
        number, versions = self.current()
        new = {}
        for name, df in tables.items():
            if name in appended and name in versions:
                df = self.spark.read.parquet(f"{self.path}/{name}/{versions[name]}").unionByName(df)
            new[name] = uuid.uuid4().hex
            df.write.parquet(f"{self.path}/{name}/{new[name]}")
        beside = self.of(f"{self.path}/.{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        out.write(bytearray(json.dumps(versions | new).encode()))
        out.close()
        at = self.of(f"{self.path}/manifest-{number + 1:09d}")
        if self.fs.exists(at) or not self.fs.rename(beside, at):
            self.fs.delete(beside, False)
            raise OSError(f"commit {number + 1} of {self.path} was made by somebody else")
        return number + 1

    def clean(self, keep: int = 1) -> None:
        """Remove all but the last `keep` commits, and versions that none of them names."""
        numbers = self._manifests()
        named: dict[str, set[str]] = {}
        for n in numbers[-keep:]:
            for name, version in json.loads(self.spark.read.text(f"{self.path}/manifest-{n:09d}", wholetext=True).first()[0]).items():
                named.setdefault(name, set()).add(version)
        for n in numbers[:-keep]:
            self.fs.delete(self.of(f"{self.path}/manifest-{n:09d}"), False)
        for s in self.fs.listStatus(self.of(self.path)):
            if s.isDirectory():
                for v in self.fs.listStatus(s.getPath()):
                    if v.getPath().getName() not in named.get(s.getPath().getName(), ()):
                        self.fs.delete(v.getPath(), True)
