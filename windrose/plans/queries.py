"""All registered queries of the library and their SQL."""

from . import backfills, boats, classes, imports, matching, merging, operations, ordered, pages, racing, read_side, reports, search, upkeep  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES
from .racing import supplier_rai

__all__ = ["ORACLES", "QUERIES", "supplier_rai"]
