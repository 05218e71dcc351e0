"""The entry without its optional part."""

import subprocess
import sys

import pytest

import conftest

BLOCKED = """
import sys
sys.modules["{name}"] = None
sys.path.insert(0, "{root}")
import __spark_entry__ as entry
from almanac.plans.catalogue import ORACLES, QUERIES
assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLES, len(entry.queries())
print(len(QUERIES))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "xxhash", "duckdb", "corpus_pipeline"])
def test_core_queries_load_alone(name):
    code = BLOCKED.format(name=name, root=conftest.ROOT)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    assert int(done.stdout) > 200
