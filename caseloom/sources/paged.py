"""Listings that come in pages, as stored answers: which pages a run would have read, and what is new on them.

A run reads pages in order, keeps what it has not seen, and stops by a rule.
All of that depends on a page's place only, so it is windows over the stored
pages: rows are kept at the first page that has them, pages are counted, and the
rule gives the last page.  Only one row a page meets in the windows that run over
all pages; the answers themselves stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions import lexicon as L
from caseloom.functions.reports import file_name, is_monthly
from caseloom.functions.text import computed, strip_html, text, unescape

#: Rows of a full answer, and pages without anything new that end a search.
FULL, PATIENCE = 25, 8
ANSWER = "data struct<attributes: struct<results: array<struct<name_with_parent: string, content: string, action_url: string, publication: string>>>>"
#: How a listing page prints a card, its title and date, its files and its other pages.
CARD = r'(?is)<div class="card mb-3 col-12">(.*?)</div>\s*</div>'
CARD_TITLE = r'(?is)<a href="([^"]+)"[^>]*>\s*<h4[^>]*>(.*?)</h4>'
CARD_DATE = r'(?is)<h6[^>]*class="card-subtitle[^"]*"[^>]*>\s*<strong>(.*?)</strong>'
PAGE_LINK = r"/reportes/page/(\d+)/"
FILE = r"""(?i)(https?://[^"'\s>]+\.pdf)"""
FOUND = ("fuente", "pagina", "pos", "titulo", "url", "fecha_publicacion", "numero", "archivo")


def report_number(title: Column, url: Column) -> Column:
    """The number behind an 'n' in the title, else in the decoded address; empty if there is none."""
    plain = F.coalesce(F.try_url_decode(text(url)), text(url))
    of = lambda c: F.regexp_extract(c, L.NUMBER_MARK, 1).try_cast("int").cast("string")
    return F.coalesce(of(text(title)), of(plain), F.lit(""))


def first_seen(rows: DataFrame, source: str, url: str, *order: str) -> DataFrame:
    """Of rows with one address the first."""
    best = rows.groupBy(source, url).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in (source, url, *order)])).alias("__r"))
    return best.select(source, url, "__r.*")


def last_pages(pages: DataFrame, source: str, page: str, results: str, new: str, full: int = FULL, patience: int = PATIENCE) -> DataFrame:
    """(source, last): the last page that a search reads, of one row a page with its number of results and of new ones.

    It stops before a page without results or one that is missing, and behind
    one that is not full or is the last of ``patience`` pages without anything new.
    """
    w = W.partitionBy(source).orderBy(page)
    p = pages.withColumn("__gap", F.col(page) != F.row_number().over(w))
    # Pages since the last that had something new: the place less that page's place.
    p = p.withColumn("__fruit", F.coalesce(F.max(F.when(F.col(new) > 0, F.col(page))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    before = F.min(F.when(F.col("__gap") | (F.col(results) == 0), F.col(page) - 1))
    behind = F.min(F.when((F.col(results) < full) | (F.col(page) - F.col("__fruit") >= patience), F.col(page)))
    return p.groupBy(source).agg(F.least(before, behind, F.max(page)).alias("last"))


def search_pages(answers: DataFrame, source: str = "fuente", page: str = "sheet", column: str = "json", accept: Callable[[Column, Column], Column] = is_monthly, full: int = FULL, patience: int = PATIENCE) -> DataFrame:
    """Reports of a search's stored JSON answers: fuente, pagina, pos, titulo, url, fecha_publicacion, numero, archivo.

    An answer is taken if its address is a PDF and ``accept(title, url)`` holds.
    """
    a = computed(answers.select(F.col(source).alias("fuente"), F.col(page).cast("int").alias("pagina"), F.coalesce(F.from_json(column, ANSWER)["data"]["attributes"]["results"], F.array().cast("array<struct<name_with_parent: string, content: string, action_url: string, publication: string>>")).alias("r")), n=F.size("r"))
    rows = a.select("fuente", "pagina", F.posexplode("r").alias("pos", "r"))
    rows = computed(rows.select("fuente", "pagina", "pos", "r"), titulo=strip_html(F.coalesce(F.nullif("r.name_with_parent", F.lit("")), "r.content")), url=text("r.action_url"), fecha_publicacion=text("r.publication"))
    rows = rows.filter(F.lower("url").endswith(".pdf")).filter(accept(F.col("titulo"), F.col("url"))).drop("r")
    fresh = first_seen(rows, "fuente", "url", "pagina", "pos")
    counts = fresh.groupBy("fuente", "pagina").agg(F.count(F.lit(1)).alias("new"))
    each = a.groupBy("fuente", "pagina").agg(F.max("n").alias("results")).join(counts, ["fuente", "pagina"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return _read(fresh, last_pages(each, "fuente", "pagina", "results", "new", full, patience))


def listing_pages(pages: DataFrame, source: str = "fuente", page: str = "page", status: str = "status", html: str = "html", accept: Callable[[Column, Column], Column] = is_monthly, card: str = CARD, file: str = FILE) -> DataFrame:
    """Reports of a listing's stored HTML pages, the same columns.

    The first page's links tell how many there are; a page that is missing or
    not found ends the run.  Cards come first; then the sweep: files of the page
    that no card and no page before gave, titled by their names.
    """
    p = pages.select(F.col(source).alias("fuente"), F.col(page).cast("int").alias("pagina"), F.col(status).cast("int").alias("status"), text(html).alias("html"))
    linked = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("html", F.lit(PAGE_LINK), F.lit(1)), lambda n: n.try_cast("int"))), F.lit(1))
    most = p.filter("pagina = 1").groupBy("fuente").agg(F.max(linked).alias("most"))
    w = W.partitionBy("fuente").orderBy("pagina")
    heads = p.select("fuente", "pagina", "status").withColumn("there", (F.col("status") == 200) & (F.col("pagina") == F.row_number().over(w)))
    stop = heads.groupBy("fuente").agg(F.coalesce(F.min(F.when(~F.col("there"), F.col("pagina") - 1)), F.max("pagina")).alias("end"))
    last = stop.join(most, "fuente").select("fuente", F.least("end", "most").alias("last"))
    body = p.filter("status = 200")
    cards = body.select("fuente", "pagina", F.posexplode(F.regexp_extract_all("html", F.lit(card), F.lit(1))).alias("pos", "card"))
    part = lambda pattern, group: F.regexp_extract("card", pattern, group)
    cards = computed(cards, url=F.trim(unescape(part(CARD_TITLE, 1))), titulo=strip_html(part(CARD_TITLE, 2)), fecha_publicacion=strip_html(part(CARD_DATE, 1))).drop("card")
    cards = cards.filter(F.lower("url").endswith(".pdf")).filter(accept(F.col("titulo"), F.col("url"))).withColumn("sweep", F.lit(0))
    files = body.select("fuente", "pagina", F.posexplode(F.regexp_extract_all("html", F.lit(file), F.lit(1))).alias("pos", "url"))
    files = computed(files.withColumnRenamed("url", "raw"), url=unescape("raw"), fecha_publicacion=F.lit(""), sweep=F.lit(1)).drop("raw")
    files = files.filter(accept(F.lit(""), F.col("url"))).withColumn("titulo", F.regexp_extract(F.coalesce(F.try_url_decode("url"), "url"), r"([^/]*)$", 1))
    return _read(first_seen(cards.unionByName(files), "fuente", "url", "pagina", "sweep", "pos").drop("sweep"), last)


def _read(rows: DataFrame, last: DataFrame) -> DataFrame:
    kept = rows.join(last, "fuente").filter(F.col("pagina") <= F.col("last"))
    out = computed(kept, numero=report_number(F.col("titulo"), F.col("url")))
    return out.withColumn("archivo", file_name("url", "numero")).select(*FOUND)
