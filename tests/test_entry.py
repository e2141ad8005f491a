import os
import shutil
import subprocess
import sys

from conftest import ROOT

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    for leftover in ("", "quillon/llm/__pycache__"):
        (tmp_path / "r" / leftover).mkdir(parents=True, exist_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'search_content' in q and not any(n.startswith('op') for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={"PATH": "/usr/bin:/bin"}, check=True)
    code = "from pyspark.sql import SparkSession as S; import __spark_entry__ as e; assert e.entry(S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()).count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={"PATH": os.environ["PATH"], "JAVA_HOME": os.environ.get("JAVA_HOME", "")} if os.environ.get("JAVA_HOME") else {"PATH": os.environ["PATH"]}, check=True)
