"""Scalar functions on the cases their rules name."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from caseloom.functions import reports as R, text as T


def run(spark, column, *rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_fold_is_compatibility_folding(spark):
    rng = random.Random(3)
    chars = "aÁñÑüÇßœ ﬁ½№…´ÅΩ" + "".join(chr(rng.randrange(0xC0, 0x250)) for _ in range(200))
    words = ["".join(rng.choice(chars) for _ in range(12)) for _ in range(200)] + ["é", "", None]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()
    assert run(spark, T.fold("s"), *words) == [plain(w) for w in words]


def test_white_space_and_cleaning(spark):
    assert run(spark, T.norm_ws("s"), " a\t b­c \n\n\n\nd ", None) == ["a bc \n\nd", ""]
    assert run(spark, T.clean("s"), " Uno &amp; dos ;. ", "x ") == ["Uno & dos", "x"]
    assert run(spark, T.strip_html("s"), "<p>a<b>b</b>&nbsp;c</p>") == ["a b c"]
    assert run(spark, T.case_key("s"), "El caso de La Mina, y Áncash", "de la") == ["caso mina ancash", ""]


def test_cut_at_sentence(spark):
    assert run(spark, T.cut_at_sentence("s", 20), "corto", "uno dos tres. cuatro cinco", "uno. dos tres cuatro cinco seis", "x" * 30) == ["corto", "uno dos tres.", "uno. dos tres", "x" * 20]


@pytest.mark.parametrize("given,want", [("AREQUIPA / PUNO", "Arequipa / Puno"), ("Región Áncash", "Áncash"), ("cuzco", "Cusco"), ("Atlantis", None), ("AREQUIPA / ATLANTIS", None)])
def test_department(spark, given, want):
    assert run(spark, T.department("s"), given) == [want]


def test_departments_inside_words_do_not_count(spark):
    assert run(spark, T.complete_department(F.lit(""), "s"), "la política nacional", "en Ica ciudad", "cerca de La Libertad") == ["Nacional", "Ica", "La Libertad"]
    assert run(spark, T.leading_department("s")["department"], "LIMA METROPOLITANA distrito", "Limatambo") == ["Lima Metropolitana", ""]


def test_topics(spark):
    social, mining = T.topic_flags(F.lit("Sociambiental"), "s")
    texts = ["Ministerio de Energía y Minas", "el foro y la plataforma", "mina de oro", "extracción de ORO"]
    assert run(spark, mining, *texts) == [0, 0, 1, 1]
    assert run(spark, social, *texts) == [1, 1, 1, 1]


def test_catalogue_and_partner(spark):
    names, owners = T.named(T.fold("s"))
    assert run(spark, names, "Las Bambas y Yanacocha; Glencore") == [["Yanacocha", "Las Bambas"]]
    assert run(spark, owners, "Las Bambas y Yanacocha; Glencore", "Glencore") == [["Newmont", "Las Bambas", "Glencore"], []]


def test_dates_and_numbers(spark):
    cover = R.from_text("s")
    texts = ["Reporte de Conflictos Sociales N.° 252 / Febrero 2025", "Reporte N° 62 al 30 de abril de 2009", "nada", "Conflictos sociales N° 999"]
    got = run(spark, cover, *texts)
    assert [tuple(g) for g in got] == [(252, 2, 2025), (62, 4, 2009), (None, None, None), (None, None, None)]
    assert [tuple(g) for g in run(spark, R.from_name("s"), "conflictos_sociales42.pdf", "Reporte-N-101-Julio-12.pdf", "abril 2004 - Reporte 01.pdf")] == [(42, None, None), (101, 7, 2012), (1, 4, 2004)]
    assert run(spark, R.number_in_name("s"), "n12_conflictos_101.pdf", "x.pdf") == [101, None]
    assert run(spark, T.month_end(F.split("s", "-")[0], F.split("s", "-")[1]), "2024-2", "2023-13", "-") == ["2024-02-29", "", ""]


def test_monthly_titles(spark):
    got = run(spark, R.is_monthly("s", "u"), ("Reporte Mensual de Conflictos Sociales", "x"), ("Crisis política y conflictos", "x.pdf"), ("", "http://a/conflicto-12.pdf"), schema="s string, u string")
    assert got == [True, False, True]


def test_records(spark):
    good = '{"resumen": " Uno ", "tipo_normalizado": "LABORAL", "confianza": "Alta", "texto_ilegible": "no"}'
    got = run(spark, R.record("s"), good, "no json", '{"resumen": "", "confianza": "alta"}')
    assert [(g.resumen, g.tipo_normalizado, g.confianza, g.texto_ilegible) for g in got] == [("Uno", "laboral", "alta", False), ("", "otros", "baja", True), ("", "otros", "baja", True)]


def test_lists_and_names(spark):
    assert run(spark, T.parse_list(T.list_text(F.split("s", ","))), "a,b c") == [["a", "b c"]]
    assert run(spark, R.safe_name("s"), "dir/N° 1: a?.pdf", "b") == ["No 1_ a_.pdf", "b.pdf"]
    assert run(spark, R.ascii_url("s"), "http://a.b/N° 1/x.pdf?q=1") == ["http://a.b/N%C2%B0%201/x.pdf?q=1"]
    assert run(spark, R.file_name("s", F.lit("7")), "http://a/b c.pdf?x", "http://a/n7.pdf") == ["n7_b_c.pdf", "n7.pdf"]


def test_whole_words_end_at_letters_that_are_not_ascii(spark):
    """As in the SQL, a sharp s is no part of a word."""
    df = spark.createDataFrame([(1, "undßgeber"), (2, "rund"), (3, "und"), (4, "und_"), (5, "gebßund")], "i int, t string")
    assert [r.i for r in df.filter(T.any_word("t", ("und",))).orderBy("i").collect()] == [1, 3, 5]
    assert [r.i for r in df.filter(T.contained_name("t", {"und": "Und"}).isNotNull()).orderBy("i").collect()] == [1, 3, 5]


def test_covers_and_answers_are_worked_out_once(spark):
    """Each pattern stands in the plan a few times, not once for each use of what it finds."""
    df = spark.createDataFrame([("x",)], "s string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(R.from_text("s")).count("translate(") <= 2
    assert plan(R.record("s")).count("from_json(") <= 1 and plan(R.dated("s", "s")).count("translate(") <= 6
