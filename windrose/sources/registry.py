"""Result sources behind one interface, as a Python data source: spark.read.format("race_results").option("module", ...).

The module has discover() -> event references, and scrape(reference) -> rows of boat_name, sail_number, place, rating,
status; it is imported where it runs, so any installed module can be a source. As a stream, references count in the order
in which discover() lists them, so a source adds new ones at its end; a module with a function done(references) is told which
ones a query has finished with."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, event string, boat_name string, sail_number string, place int, rating double, status string"


class RaceResults(DataSource):
    """A partition an event, so events are scraped in parallel and a lost one again."""

    @classmethod
    def name(cls) -> str:
        return "race_results"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["module"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["module"])


class _Event(InputPartition):
    def __init__(self, reference: str):
        self.reference = reference


class _Reader(DataSourceReader):
    def __init__(self, module: str):
        self.module = module

    def partitions(self) -> list[InputPartition]:
        return [_Event(e) for e in importlib.import_module(self.module).discover()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in importlib.import_module(self.module).scrape(partition.reference):
            yield (self.module.rpartition(".")[2], partition.reference, *row)


class _StreamReader(DataSourceStreamReader):
    """Offsets are counts of references. A batch that runs again asks for the same offsets and so reads the same events."""

    def __init__(self, module: str):
        self.module = module

    def initialOffset(self) -> dict:  # noqa: N802
        return {"events": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"events": len(list(importlib.import_module(self.module).discover()))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        references = list(importlib.import_module(self.module).discover())
        return [_Event(e) for e in references[start["events"] : end["events"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _Reader(self.module).read(partition)

    def commit(self, end: dict) -> None:
        module = importlib.import_module(self.module)
        if hasattr(module, "done"):
            module.done(list(module.discover())[: end["events"]])
