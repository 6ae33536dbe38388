"""Matching as a stream: new results arrive batch by batch, and each batch is a cycle over all that have no boat yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merges import Versions
from ..operators.relational import checkpoint_dir

RESULTS, LEDGER = "results", "batches"


def run_batch(batch: DataFrame, number: int, store: Versions, match: Callable[[DataFrame], DataFrame], run: str = "") -> bool:
    """One cycle: results whose result_id is new are added without a boat, match(all results) fills boats, and both the
    results and the batch's number are committed as one. A batch whose number the ledger has, as after a failure between commit
    and checkpoint, changes nothing. run: tells the queries apart that write to the store."""
    spark = batch.sparkSession
    tables = store.read()
    ledger = tables.get(LEDGER)
    if ledger is not None and ledger.filter((F.col("batch") == number) & (F.col("run") == run)).limit(1).count():
        return False
    rows = batch.dropDuplicates(["result_id"]).withColumn("boat_id", F.lit(None).cast("long"))
    if RESULTS in tables:
        old = tables[RESULTS]
        rows = old.unionByName(rows.join(old.select("result_id"), "result_id", "left_anti"))
    entry = spark.createDataFrame([(run, number)], "run string, batch long")
    store.commit({RESULTS: match(rows), LEDGER: entry}, appended=[LEDGER])
    store.clean(keep=2)
    return True


def start_cycle(stream: DataFrame, path: str, checkpoint: str, match: Callable[[DataFrame], DataFrame], interval: str | None = None):
    """Run the cycle over a stream of results (result_id and what match() needs). match() is called anew in each cycle and
    so sees the boats of that time: results that none fits wait for the next."""
    spark: SparkSession = stream.sparkSession
    checkpoint_dir(spark)

    def cycle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            run_batch(batch, number, Versions(batch.sparkSession, path), match, checkpoint)
        finally:
            batch.unpersist()

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
