"""The library stands without the corpus operators, and its plans hold no joins of all pairs."""

import ast
import subprocess
import sys
from pathlib import Path

import pytest

from windrose.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
DIR = "/root/testdata/sf0.001"
#: One-row aggregates side by side, and a model of one group.
ALL_PAIRS = {"global_stats", "coefficient_drift"}


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")


def test_nothing_imports_the_corpus_operators():
    for path in (ROOT / "windrose").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in name or "corpus_pipeline" in name for name in imports(path)), path


def test_entry_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("windrose.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 80 and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and e.oracle_sql().keys() <= e.queries().keys()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_of_all_pairs(spark, name):
    if name in ALL_PAIRS:
        return
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["rolling_filter"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0] and "PushedFilters: [IsNotNull(ts)" in plan.replace("\n", " ") or "GreaterThan(ts" in plan
