"""The driver's contract, with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.parametrize("missing", [("blockloom.llm", "corpus_pipeline"), ("regex",), ("xxhash",)])
def test_the_library_stands_alone(missing):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (
        f"import sys; sys.modules.update(dict.fromkeys({missing!r}))\n"
        "import __spark_entry__ as e; assert len(e.queries()) > 50 and e.oracle_sql(); assert not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
