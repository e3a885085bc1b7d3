"""Keyed tables as versions: a folder for each, and a marker that makes it the table only once it is whole.

A table is a folder.  Version n lies in ``data-n-<unique>``; the marker
``_versions/n`` names that folder and is written last, by a rename onto a name
that no other writer may have taken.  Readers take the greatest marker, so they
see the old version or the new one and never a part of either, and a writer that
stops anywhere leaves the table as it was.  Of two writers that start from the
same version the second gets an error and can begin again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARKS = "_versions"
#: Versions that stay, for readers that began before the last write.
KEPT = 2


class Conflict(RuntimeError):
    """Another writer made the next version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions, ascending."""
    fs, Path = _fs(spark, path)
    marks = Path(f"{path}/{MARKS}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(marks) if s.getPath().getName().isdigit()) if fs.exists(marks) else []


def _folder(spark: SparkSession, path: str, number: int) -> str:
    return f"{path}/{spark.read.text(f'{path}/{MARKS}/{number}').first()['value']}"


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The newest version (or the one of a number); None if there is none.  A plain Parquet folder is its own only version."""
    have = versions(spark, path)
    if have:
        return spark.read.parquet(_folder(spark, path, have[-1] if number is None else number))
    fs, Path = _fs(spark, path)
    plain = fs.exists(Path(path)) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(Path(path)))
    return spark.read.parquet(path) if plain else None


def write_table(spark: SparkSession, path: str, rows: DataFrame, after: int | None = None) -> int:
    """Write the next version, whole or not at all; its number.  ``after``: the version that the rows were made from."""
    base = after if after is not None else (versions(spark, path) or [0])[-1]
    number, name = base + 1, f"data-{base + 1}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    _mark(spark, path, number, name)
    _forget(spark, path)
    return number


def _mark(spark: SparkSession, path: str, number: int, name: str) -> None:
    fs, Path = _fs(spark, path)
    fs.mkdirs(Path(f"{path}/{MARKS}"))
    draft, mark = Path(f"{path}/{MARKS}/.{name}"), Path(f"{path}/{MARKS}/{number}")
    out = fs.create(draft)
    out.write(bytearray(name, "utf-8"))
    out.close()
    # A rename that does not overwrite: the one step that makes the version the table.
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, mark, spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(mark):
            raise Conflict(f"version {number} of {path} is there already") from e
        raise


def _forget(spark: SparkSession, path: str) -> None:
    """Remove versions before the last ones, the marker first."""
    fs, Path = _fs(spark, path)
    for number in versions(spark, path)[:-KEPT]:
        folder = _folder(spark, path, number)
        fs.delete(Path(f"{path}/{MARKS}/{number}"), False)
        fs.delete(Path(folder), True)
