import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as driver

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    assert 0 < driver.entry(spark).count() <= 10


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(driver.queries()) >= 90


RUN = """
import sys
import __spark_entry__ as e
q = e.queries()
assert 'pipeline' not in q and len(q) > 80 and not [k for k in q if k.startswith('op')] and 'opinara.llm.queries' not in sys.modules
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert q['response_status'](spark, '/root/testdata/sf0.001').count() > 0
"""


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_optional_part(tmp_path, gone):
    rest = tmp_path / "rest"
    shutil.copytree(ROOT, rest, ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    subprocess.run([sys.executable, "-c", RUN], cwd=rest, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_operators_are_left_out_without_their_vocabularies(tmp_path):
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
