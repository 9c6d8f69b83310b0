"""The driver contract works with and without the training-data subpackage."""
import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_stay_without_the_subpackage(scratch):
    copy = os.path.join(scratch, "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": copy})
    n, oracles, extra = out.stdout.split()[-3:]
    assert int(n) == int(oracles) >= 100 and extra == "False"
