"""Stored pages of a search and of a listing against the loops that would have read them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from caseloom.sources import paged

GOOD = "Reporte mensual de conflictos sociales N° {}"


def search_loop(sheets, full, patience):
    seen, out, empty, n = set(), [], 0, 1
    while n in sheets:
        results = sheets[n]
        if not results:
            break
        new = 0
        for r in results:
            if r["action_url"].lower().endswith(".pdf") and "conflictos" in r["name_with_parent"] and r["action_url"] not in seen:
                seen.add(r["action_url"])
                out.append((n, r["action_url"]))
                new += 1
        empty = 0 if new else empty + 1
        if len(results) < full or empty >= patience:
            break
        n += 1
    return out


@pytest.mark.parametrize("kind", ["short", "barren", "blank", "missing", "all"])
def test_search(spark, kind):
    rng = random.Random(kind)
    item = lambda i, good: {"name_with_parent": GOOD.format(i) if good else "Otra cosa", "action_url": f"https://h.org/{i}.{rng.choice(['pdf', 'PDF'])}" if good else f"https://h.org/{i}.html", "publication": "hoy"}
    sheets = {n: [item(rng.randrange(60), rng.random() < 0.4) for _ in range(5)] for n in range(1, 13)}
    if kind == "short":
        sheets[6] = sheets[6][:4]
    if kind == "barren":
        sheets |= {n: [item(i, False) for i in range(5)] for n in (3, 4, 6, 7, 8, 9)}
    if kind == "blank":
        sheets[5] = []
    if kind == "missing":
        del sheets[4]
    rows = [("web", n, json.dumps({"data": {"attributes": {"results": r}}})) for n, r in sheets.items()]
    got = paged.search_pages(spark.createDataFrame(rows, "fuente string, sheet int, json string").repartition(3), full=5, patience=3)
    assert sorted((r.pagina, r.url) for r in got.collect()) == sorted(search_loop(sheets, 5, 3))
    assert all(r.numero in r.archivo for r in got.collect())


def test_damaged_answers_and_two_sources(spark):
    rows = [("a", 1, "no json"), ("b", 1, json.dumps({"data": {"attributes": {"results": [{"name_with_parent": None, "content": GOOD.format(7), "action_url": "https://h.org/x.pdf"}]}}})), ("c", 1, None), ("d", 2, "{}")]
    got = paged.search_pages(spark.createDataFrame(rows, "fuente string, sheet int, json string")).collect()
    assert [(r.fuente, r.numero, r.archivo, r.fecha_publicacion) for r in got] == [("b", "7", "n7_x.pdf", "")]


def test_listing(spark):
    """Cards, then the sweep of bare links; the number of pages from the first; a page that is not found ends the run."""
    card = lambda t, u, d="mayo": f'<div class="card mb-3 col-12"><div><a href="{u}" x="1">\n<h4 class="a">{t}</h4></a><h6 class="card-subtitle y"><strong>{d}</strong></h6></div>\n</div>'
    good = GOOD.format(12)
    one = card(f"<b>{good}</b> &amp; más", "https://h.org/u/a%20b.pdf") + card("Crisis política", "https://h.org/u/c.pdf") + card(good, "https://h.org/u/page") + "<div class='card mb-3'>x</div>" + '<a href="https://h.org/u/conflictos-2.pdf">x</a> <a href="https://h.org/u/otro.pdf">y</a>' + '<a href="https://h.org/reportes/page/3/">3</a>'
    two = card(good, "https://h.org/u/a%20b.pdf") + card(good, "https://h.org/u/conflictos-2.pdf") + card(good, "https://h.org/u/z.pdf")
    pages = [("w", 1, 200, one), ("w", 2, 200, two), ("w", 3, 200, card(good, "https://h.org/u/y.pdf")), ("w", 4, 200, card(good, "https://h.org/u/beyond.pdf")), ("v", 1, 200, one.replace("page/3", "page/9")), ("v", 2, 404, two), ("v", 3, 200, two), ("z", 1, 404, "")]
    got = {}
    for r in paged.listing_pages(spark.createDataFrame(pages, "fuente string, page int, status int, html string").repartition(3)).collect():
        got.setdefault(r.fuente, set()).add((r.pagina, r.titulo, r.url, r.fecha_publicacion, r.numero))
    first = {(1, good + " & más", "https://h.org/u/a%20b.pdf", "mayo", "12"), (1, "conflictos-2.pdf", "https://h.org/u/conflictos-2.pdf", "", "")}
    assert got == {"w": first | {(2, good, "https://h.org/u/z.pdf", "mayo", "12"), (3, good, "https://h.org/u/y.pdf", "mayo", "12")}, "v": first}


def test_no_pages(spark):
    assert paged.search_pages(spark.createDataFrame([], "fuente string, sheet int, json string")).count() == 0
    assert paged.listing_pages(spark.createDataFrame([], "fuente string, page int, status int, html string").withColumn("last", F.lit(1))).count() == 0
