"""Sinks: panel files, partitioned folders, summaries, keyed upserts and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.lexicon import CELL_LIMIT
from caseloom.functions.text import strip_controls, text
from caseloom.operators.rollups import upper_median
from caseloom.sources import versions


def columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Exactly these columns in this order: missing ones are empty texts, others go."""
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit("").alias(c) for c in names])


def write_panel(rows: DataFrame, folder: str, names: tuple[str, ...], name: str = "panel_caso_mes", csv: bool = True) -> None:
    """Parquet, and beside it gzip CSV part files with a header."""
    out = columns(rows, names)
    out.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    if csv:
        out.sparkSession.read.parquet(f"{folder}/{name}.parquet").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip").csv(f"{folder}/{name}.csv.gz")


def write_by_layout(rows: DataFrame, folder: str, layout: str = "formato") -> None:
    """One folder for each layout family."""
    rows.repartition(layout).write.mode("overwrite").partitionBy(layout).parquet(folder)


def layout_summary(rows: DataFrame) -> DataFrame:
    """One JSON text a layout: files, least and greatest number and year, upper median of pages, numbers, names."""
    out = rows.groupBy("formato").agg(
        F.count(F.lit(1)).alias("n_pdf"), F.min("numero").alias("n_min"), F.max("numero").alias("n_max"), F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"),
        upper_median("paginas").alias("pag_mediana"), F.array_sort(F.collect_set("numero")).alias("numeros"), F.array_sort(F.collect_list("archivo")).alias("archivos"),
    )
    return out.select("formato", F.to_json(F.struct(*[c for c in out.columns if c != "formato"])).alias("resumen"))


def sheet(rows: DataFrame) -> DataFrame:
    """What a spreadsheet takes: texts without control characters, cut to a cell's limit."""
    return rows.select(*[strip_controls(c, CELL_LIMIT).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, stamp: str) -> int:
    """Merge rows into a keyed table: the newest of each key stays.  The next version takes the table's place in one step."""
    have = versions.versions(spark, path)
    old = versions.read_table(spark, path)
    every = old.unionByName(rows) if old is not None else rows
    newest = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), stamp).alias("r")).select("r.*")
    return versions.write_table(spark, path, newest, have[-1] if have else 0)


def append_absent(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Add the rows whose key is not there yet: to a keyed table as its next version, else to the plain folder."""
    have = versions.versions(spark, path)
    old = versions.read_table(spark, path)
    if old is not None:
        rows = rows.join(old.select(key).distinct(), key, "left_anti").select(*rows.columns)
    rows = rows.filter(text(key) != "")
    if have:
        versions.write_table(spark, path, old.unionByName(rows), have[-1])
    else:
        rows.write.mode("append").parquet(path)
