"""The driver's entry keeps its core queries whatever the optional part lacks."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == {blocked!r} or name == {blocked!r}:
            raise ModuleNotFoundError('No module named ' + repr(name), name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as E
from histofold.plans.queries import QUERIES
assert set(E.queries()) == set(QUERIES) and set(E.oracle_sql()) == set(QUERIES), set(E.queries()) ^ set(QUERIES)
"""


@pytest.mark.parametrize("blocked", ["public_tokenizers", "histofold.llm", "corpus_pipeline", "numpy", "pyarrow"])
def test_core_queries_without_the_optional_part(blocked):
    if blocked in ("numpy", "pyarrow"):
        blocked_code = CODE.replace("import __spark_entry__", "import histofold.plans.queries\nimport __spark_entry__")
    else:
        blocked_code = CODE
    done = subprocess.run([sys.executable, "-c", blocked_code.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True)
    if "corpus_pipeline" != blocked and not os.path.isdir(f"{ROOT}/histofold/llm"):
        pytest.skip("the optional part is not there")
    assert done.returncode == 0, done.stderr[-800:]
    assert "llm queries are left out" in done.stderr
