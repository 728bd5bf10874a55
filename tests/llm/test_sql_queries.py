import importlib
import os
import subprocess
import sys

import pytest
from oracle import same

from tabiya.llm.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_all_operators_and_the_pipeline_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"} == set(range(1, 14)) and "pipeline" in QUERIES


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(importlib.import_module("tabiya").__file__))
    found = subprocess.run(["grep", "-rlE", r"tabiya\.llm|corpus_pipeline", f"{root}/tabiya", f"{root}/__spark_entry__.py", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert {os.path.relpath(f, root) for f in found if "/llm/" not in f} == {"__spark_entry__.py"}


def test_entry_works_without_it():
    code = "import sys; sys.modules['tabiya.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).returncode == 0
