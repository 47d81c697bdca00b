"""Modules and the entry point can be imported, and queries listed, before there is a Spark session; also without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e, pkgutil, importlib, ripple\nfor m in pkgutil.walk_packages(ripple.__path__, 'ripple.'): importlib.import_module(m.name)\nprint(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def listed(root):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root)})
    assert done.returncode == 0, done.stderr
    n, fits = done.stdout.split()
    assert fits == "True"
    return int(n)


def test_import_without_session(tmp_path):
    part = tmp_path / "part"
    shutil.copytree(ROOT, part, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    assert listed(part) >= 50
    assert listed(ROOT) >= listed(part)


ELSEWHERE = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from ripple.sources import facts
files = facts.from_contents(spark.createDataFrame([("r", "a.py", bytearray(b"import os"))], "repo string, path string, content binary"))
print("rows", facts.facts_of(files).count(), len(facts.facts_of(files).first()["imports"]))
"""


def test_workers_find_the_package(tmp_path):
    """Python workers need neither the working directory nor PYTHONPATH."""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, str(ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=180, env=env)
    assert "rows 1 1" in done.stdout, done.stderr[-2000:]
