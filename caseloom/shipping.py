"""Making the package known to executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def archive(folder: str) -> str:
    """A zip of the package's modules in ``folder``, as ``--py-files`` takes it; its path."""
    package = Path(__file__).resolve().parent
    path = str(Path(folder, "caseloom.zip"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a running session; the driver serves the file."""
    spark.sparkContext.addPyFile(archive(tempfile.mkdtemp(prefix="caseloom-")))
