"""Sources: panel and inventory files, listings, web pages and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.functions.reports import name_key, number_in_name
from caseloom.functions.text import strip_html, text


def exists(spark: SparkSession, path: str, least: int = 1) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads, with at least so many bytes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getContentSummary(p).getLength() >= least


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header, quotes doubled inside quotes and line breaks in cells; empty cells are empty texts."""
    df = spark.read.csv(path, header=True, schema=schema, sep=sep, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.na.fill("")


def panel(spark: SparkSession, folder: str, schema: str, name: str = "panel_caso_mes") -> DataFrame:
    """The panel: Parquet if there is one, else the CSV if it is not empty, else its gzip copy."""
    if exists(spark, f"{folder}/{name}.parquet"):
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    for ending in (".csv", ".csv.gz"):
        if exists(spark, f"{folder}/{name}{ending}"):
            return csv_table(spark, f"{folder}/{name}{ending}", schema)
    raise FileNotFoundError(f"no {name} in {folder}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated listing: path, size, md5, id; missing columns are empty.  Adds name, number and key."""
    cells = F.split("value", "\t")
    at = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    rows = spark.read.text(path).filter(F.trim("value") != "")
    rows = rows.select(F.monotonically_increasing_id().alias("pos"), at(0).alias("ruta"), F.coalesce(at(1).try_cast("long"), F.lit(0)).alias("size"), at(2).alias("md5"), at(3).alias("id"))
    rows = rows.withColumn("archivo", F.regexp_extract("ruta", r"([^/]*)$", 1))
    return rows.withColumn("numero", number_in_name("archivo")).withColumn("clave", name_key("archivo"))


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder: archivo, length, content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return df.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("archivo"), "path", "length", "modificationTime", "content")


def decoded_pages(documents: DataFrame, decode) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of binary documents.

    ``decode(bytes)`` yields (page, height, text, blocks); it is injected, as no
    decoder is part of this package.  A document that cannot be read becomes a
    failure row, never an exception.
    """
    schema = "doc string, page int, height double, text string, blocks array<struct<type: int, x0: double, y0: double, x1: double, y1: double, lines: array<string>>>, motivo string"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["archivo"], pdf["content"], strict=True):
                try:
                    rows += [(name, *page, None) for page in decode(bytes(content))]
                except Exception as e:  # noqa: BLE001 - any damage is a failure row
                    rows.append((name, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc", "page", "height", "text", "blocks", "motivo"])

    out = documents.select("archivo", "content").mapInPandas(run, schema)
    return out.filter("motivo is null").drop("motivo"), out.filter("motivo is not null").select(F.col("doc").alias("archivo"), "motivo")


def cover_text(pages: DataFrame, most: int = 2) -> DataFrame:
    """(doc, cover): text of the first pages."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.filter(F.col("page") <= most).groupBy("doc").agg(F.array_join(ordered, "\n").alias("cover"))


def links(html: str | Column) -> Column:
    """Array of (href, label) of the anchors of a page, in order."""
    h = F.col(html) if isinstance(html, str) else html
    tags = F.regexp_extract_all(text(h), F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r'(?is)href="([^"]*)"', 1).alias("href"), strip_html(t).alias("label")))


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row an anchor: key, pos, href, label; repeated addresses of a page keep the first."""
    rows = pages.select(key, F.posexplode(links(html)).alias("pos", "a")).select(key, "pos", "a.*").filter("href != ''")
    first = rows.groupBy(key, "href").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))
    return first.select(key, "pos", "href", "label")


RESULTS = "data struct<attributes: struct<results: array<struct<name: string, url: string, publication: string, collections: array<struct<id: int>>>>>>"


def search_results(answers: DataFrame, column: str = "json", collection: int | None = None) -> DataFrame:
    """Rows of JSON search answers: name, url, publication; of one collection if it is given."""
    found = answers.select(F.explode(F.from_json(column, RESULTS)["data"]["attributes"]["results"]).alias("r"))
    if collection is not None:
        found = found.filter(F.exists("r.collections", lambda c: c["id"] == collection))
    return found.select("r.name", "r.url", "r.publication")
