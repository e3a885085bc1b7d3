"""A session whose workers do not find the package gets it sent."""

import subprocess
import sys
import zipfile
from pathlib import Path

from caseloom import shipping

ROOT = str(Path(__file__).resolve().parent.parent)
PROGRAM = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
from caseloom.operators import similarity
from caseloom.shipping import ship
ship(spark)
print("RATIO", spark.createDataFrame([("b a", "a b")], "a string, b string").select(similarity.ratio("a", "b")).first()[0])
"""


def test_workers_get_the_package(tmp_path):
    out = subprocess.run([sys.executable, "-c", PROGRAM.format(root=ROOT)], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable, **{k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK"))}}, capture_output=True, text=True, timeout=300)
    assert "RATIO 100.0" in out.stdout, out.stderr[-2000:]


def test_archive_has_every_module(tmp_path):
    names = set(zipfile.ZipFile(shipping.archive(str(tmp_path))).namelist())
    assert {str(p.relative_to(ROOT)) for p in Path(ROOT, "caseloom").rglob("*.py")} == names
