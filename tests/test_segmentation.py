"""Cards from blocks and lines, latent tables, fields."""

from pyspark.sql import functions as F

from caseloom.operators import fields, segmentation as S
from caseloom.plans import panel

BLOCK = "doc string, page int, y double, x0 double, col string, text string"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", p, float(y), 0.0 if c == "L" else 400.0, c, t) for p, y, c, t in rows], BLOCK)


def test_cards_cross_pages_and_merge_type(spark):
    b = blocks(
        spark,
        (1, 10, "R", "dropped: no card is open"),
        (1, 20, "L", "AREQUIPA"),
        (1, 30, "L", "Código: 7"),
        (1, 40, "L", "Tipo: Laboral Caso: uno"),
        (1, 50, "R", "Hecho uno."),
        (2, 10, "L", "sigue el caso uno"),
        (2, 20, "L", "PUNO"),
        (2, 30, "L", "Tipo: Comunal"),
        (2, 40, "L", "Tipo: Otros"),
        (2, 50, "L", "Conflictos reactivados"),
        (2, 60, "L", "CASO REACTIVADO"),
        (2, 70, "L", "Tipo: Electoral"),
    )
    got = [(r.card, r.page, r.estado, r.departamento, r.left, r.right) for r in S.cards_from_blocks(b).orderBy("card").collect()]
    assert got == [
        (1, 1, "Activo", "Arequipa", ["Código: 7", "Tipo: Laboral Caso: uno", "sigue el caso uno"], ["Hecho uno."]),
        (2, 2, "Activo", "Puno", ["Tipo: Comunal"], []),
        (3, 2, "Activo", "Puno", ["Tipo: Otros"], []),
        (4, 2, "Reactivado", "Puno", ["CASO REACTIVADO", "Tipo: Electoral"], []),
    ]


def test_soft_start_opens_only_the_first(spark):
    b = blocks(spark, (1, 10, "L", "texto suelto"), (1, 20, "L", "Ingresó como caso nuevo"), (1, 30, "L", "Caso: uno"), (1, 40, "L", "Tipo: A"), (1, 50, "L", "Tipo: B"))
    assert [r.left for r in S.cards_from_blocks(b).orderBy("card").collect()] == [["Ingresó como caso nuevo", "Caso: uno", "Tipo: A"], ["Tipo: B"]]


def test_layout_blocks(spark):
    b = lambda y0, y1, x0, x1, *lines: (0, x0, y0, x1, y1, list(lines))
    page = [("d", 1, 800.0, "", [b(10.0, 54.0, 0.0, 100.0, "cabecera"), b(60.0, 80.0, 0.0, 599.8, "izquierda"), b(60.0, 80.0, 0.0, 600.0, "derecha"), b(751.0, 760.0, 0.0, 10.0, "pie"), b(90.0, 95.0, 0.0, 10.0, "12"), b(96.0, 99.0, 0.0, 10.0, "Hechos del mes")])]
    pages = spark.createDataFrame(page, "doc string, page int, height double, text string, blocks array<struct<type: int, x0: double, y0: double, x1: double, y1: double, lines: array<string>>>")
    assert {(r.col, r.text) for r in S.layout_blocks(pages).collect()} == {("L", "izquierda"), ("R", "derecha")}


def test_flow_text(spark):
    lines = ["PUNO", "1. Primer caso que tiene una descripción larga de más de cuarenta letras", "sigue", "1.1 no es otro caso sino una sección", "2. Segundo caso que también tiene una descripción larga de verdad", "15", "Conflictos resueltos", "3. corto"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, pos int, text string")
    got = S.cards_from_lines(df).orderBy("card").collect()
    assert [(r.departamento, r.estado) for r in got] == [("Puno", "Activo")] * 2
    assert got[0].body.count("\n") == 2


def test_latent_tables(spark):
    text = "Detalle de los conflictos latentes\n1. AMAZONAS Distrito de Imaza. Tipo socioambiental Oposición a la minera.\n2. Oct-22 Amazonas Kuélap Asuntos de gobierno nacional\n3. - -\n4. 05/2011 Puno Reclamo de la comunidad x. Tipo Comunal Fin\nConflictos que han pasado\n5. otra sección que no cuenta"
    got = S.latent_rows(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("n").collect()
    assert [(r.departamento, r.tipo) for r in got] == [("Amazonas", "socioambiental"), ("Amazonas", "Asuntos de gobierno nacional"), ("Puno", "Comunal")]
    assert got[1].caso == "Kuélap"


def test_fields(spark):
    body = "Tipo: Socioambiental Ingresó como: caso nuevo Caso: La comunidad reclama. Ubicación: Distrito A Actores primarios: Comunidad Actores secundarios: Municipio"
    one = spark.createDataFrame([(body,), ("CASO NUEVO\nTipo: Laboral\nMotivo: Salarios\nPoblación: Obreros\nAutoridad: Alcalde",)], "b string")
    a, b = one.select(fields.parse_card(F.col("b"), F.lit(" Marcha ; ")).alias("f")).select("f.*").collect()
    assert (a.tipo, a.caso, a.ubicacion, a.actores_primarios, a.actores_secundarios, a.hechos_del_mes) == ("Socioambiental", "La comunidad reclama", "Distrito A", "Comunidad", "Municipio", "Marcha")
    assert (b.tipo, b.caso, b.ubicacion, b.actores, b.ingreso_como) == ("Laboral", "Salarios", "Obreros", "Alcalde", "nuevo")


def test_page_range_and_status(spark):
    pages = [(1, "portada"), (2, "Detalle de los conflictos sociales activos Tipo: x"), (3, "más Tipo: y"), (4, "Detalle de los conflictos latentes\n1. Puno Algo largo otros"), (5, "x" * 100 + "\nConflictos que han pasado"), (6, "Actuaciones defensoriales"), (7, "Tipo: z")]
    df = spark.createDataFrame([("d", p, t) for p, t in pages], "doc string, page int, text string")
    inside = panel.detail_pages(df)
    assert sorted(r.page for r in inside.collect()) == [2, 3, 4, 5]
    got = {r.page: (r.status, r.latent_text is not None) for r in S.latent_spans(inside).collect()}
    assert got == {2: ("Activo", False), 3: ("Activo", False), 4: ("Latente", True), 5: ("Inactivo", True)}


def test_whole_panel(spark):
    lines = lambda t: [t]
    b = lambda y, x, t: (0, x, y, x + 100.0, y + 10, lines(t))
    text = "Detalle de los conflictos sociales activos Tipo: a"
    page = [("d", 1, 800.0, text, [b(60.0, 0.0, "PUNO"), b(80.0, 0.0, "Tipo: Socioambiental Caso: La mina de oro contamina el río."), b(90.0, 400.0, "Marcha del mes")], "unidad_sumilla"), ("e", 1, 800.0, "nada", [], "otro")]
    pages = spark.createDataFrame(page, "doc string, page int, height double, text string, blocks array<struct<type: int, x0: double, y0: double, x1: double, y1: double, lines: array<string>>>, formato string")
    cards = panel.cards(pages).cache()
    (r,) = cards.collect()
    assert (r.doc, r.departamento, r.tipo, r.es_socioambiental, r.menciona_mineria, r.hechos_del_mes) == ("d", "Puno", "Socioambiental", 1, 1, "Marcha del mes")
    assert [x.archivo for x in panel.failures(pages, cards).collect()] == ["e"]
