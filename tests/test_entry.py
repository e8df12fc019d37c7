import subprocess
import sys

import __spark_entry__


def test_registry_is_consistent():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert "approx_vs_exact_by_label" in names


def test_entry_runs(spark, data):
    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and "agree" in df.columns


def test_nothing_else_imports_the_corpus_operators():
    code = "import sys, codebrook.registry; sys.exit(any(m.startswith('codebrook.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.ROOT).returncode == 0
