"""The driver's entry module, with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['sorrel.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'find_callers' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_missing_library_leaves_the_operators_out_and_is_reported():
    code = "import sys, warnings; sys.modules['tokenizers'] = sys.modules['xxhash'] = None\nwith warnings.catch_warnings(record=True) as seen:\n    import __spark_entry__ as e\nassert 'find_callers' in e.queries() and not any(k.startswith('op') for k in e.queries()) and any('xxhash' in str(w.message) for w in seen)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
