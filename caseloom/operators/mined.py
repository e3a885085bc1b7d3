"""One row for each case that names a mine: what its panel rows say, gathered in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions import lexicon as L
from caseloom.functions.text import any_word, ascii_bounds, case_key, computed, extract_summary, fold, list_text, month_end, squeeze, standard_type, text

#: Names that one number of bits can hold.
WORD = 60
BLOB = ("codigo", "caso", "ubicacion", "actores_primarios", "actores_secundarios", "actores_terciarios", "actores")
LONGEST = ("caso", "actores_primarios", "actores_secundarios", "actores_terciarios", "actores", "ubicacion")
#: Villages of a case, and characters of the place that stands in for them.
VILLAGES, PLACE = 6, 220


def _bits(blob: Column, catalogue) -> list[Column]:
    """Which entries of the catalogue a folded text names: a bit each, ``WORD`` of them a number."""
    hit = [F.when(any_word(blob, aliases), F.lit(1 << i % WORD)).otherwise(0).cast("long") for i, (_, _, aliases) in enumerate(catalogue)]
    return [sum(hit[at + 1 : at + WORD], hit[at]) for at in range(0, len(hit), WORD)]


def _entries(words: list[str], catalogue, field: int) -> Column:
    """The names (0) or owners (1) whose bit is set, in catalogue order, each once."""
    picks = [F.when(F.col(words[i // WORD]).bitwiseAND(F.lit(1 << i % WORD).cast("long")) != 0, F.lit(entry[field])) for i, entry in enumerate(catalogue)]
    return F.array_distinct(F.filter(F.array(*picks), lambda x: x.isNotNull()))


def _mode(values: str, name: str) -> Column:
    """The most frequent text of an array of (n, first, ...) counts, the first seen of equally frequent ones; blanks do not count."""
    kinds = F.array_distinct(F.filter(F.transform(values, lambda x: x[name]), lambda v: v != ""))
    total = lambda v: F.aggregate(F.filter(values, lambda x: x[name] == v), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    first = lambda v: F.array_min(F.transform(F.filter(values, lambda x: x[name] == v), lambda x: x["first"]))
    best = F.array_max(F.transform(kinds, lambda v: F.struct(total(v).alias("n"), (-first(v)).alias("early"), v.alias("v"))))
    return F.coalesce(best["v"], F.lit(""))


def mined_cases(panel: DataFrame, catalogue=L.MINES, partner: tuple[str, tuple[str, ...]] | None = (L.PARTNER, L.PARTNER_MINES), villages: DataFrame | None = None, summaries: DataFrame | None = None, key: str = "caso_id", order: str = "pos", blob: tuple[str, ...] = BLOB) -> DataFrame:
    """One row a case of the rows that name an entry of the catalogue.

    ``order`` is a number that puts the rows in turn.  Rows are first combined by
    (case, type, department), so that a mode comes from a few counts and no
    group's rows are ever collected; the names found are bits, joined by or.
    Types and departments take the most frequent value, the first seen of
    equals; texts the longest; dates the least and greatest month end.
    ``villages`` (mina, nombre, orden) gives the places that a case's texts name
    of its own mines, else its location stands in; ``summaries`` (caso_id,
    resumen) replaces the extracted summary.  Missing columns count as empty.
    """
    have = lambda c: text(c) if c in panel.columns else F.lit("")
    texts = [F.trim(have(c)).alias(c) for c in LONGEST]
    raw = panel.select(F.col(key), F.col(order).cast("long").alias("orden"), *texts, *[F.col(c) if c in panel.columns else F.lit(None).cast("int").alias(c) for c in ("anio", "mes", "numero_reporte")], *[(have(c) == "1").alias(c) for c in ("es_socioambiental", "menciona_mineria")], F.trim(have("departamento")).alias("departamento"), have("tipo").alias("tipo"), F.concat_ws(" ", *[have(c) for c in blob]).alias("told"))
    raw = computed(raw, blob=fold("told"))
    words = [f"bits{i}" for i in range(len(_bits(F.lit(""), catalogue)))]
    rows = computed(raw, **dict(zip(words, _bits(F.col("blob"), catalogue), strict=True)), tipo_estandar=standard_type("tipo"), fin=month_end("anio", "mes"), ilegal=F.col("blob").rlike(ascii_bounds(L.ILLEGAL)), informal=F.col("blob").rlike(ascii_bounds(L.INFORMAL)), socio=F.col("blob").contains(fold(F.lit(partner[0]))) if partner else F.lit(False))
    rows = rows.filter(" or ".join(f"{w} <> 0" for w in words))
    date = F.nullif(F.col("fin"), F.lit(""))
    number = F.col("numero_reporte").cast("string").try_cast("double")
    month = F.struct(F.col("anio").cast("string").alias("anio"), F.col("mes").cast("string").alias("mes"))
    some = rows.groupBy(key, "tipo_estandar", "departamento").agg(
        F.count(F.lit(1)).alias("n"), F.min("orden").alias("first"), *[F.bit_or(w).alias(w) for w in words], *[F.bool_or(c).alias(c) for c in ("ilegal", "informal", "socio", "es_socioambiental", "menciona_mineria")],
        F.min(date).alias("desde"), F.max(date).alias("hasta"), F.collect_set(month).alias("meses"), F.min(number).alias("nmin"), F.max(number).alias("nmax"),
        *[F.max(F.when((F.col(c) != "") & (F.lower(c) != "nan"), F.struct(F.length(c).alias("n"), (-F.col("orden")).alias("early"), F.col(c).alias("t")))).alias(c) for c in LONGEST],
    )
    cases = some.groupBy(key).agg(
        F.collect_list(F.struct("n", "first", "tipo_estandar", "departamento")).alias("kinds"), *[F.bit_or(w).alias(w) for w in words], *[F.bool_or(c).alias(c) for c in ("ilegal", "informal", "socio", "es_socioambiental", "menciona_mineria")],
        F.sum("n").alias("n_filas_panel"), F.min("desde").alias("desde"), F.max("hasta").alias("hasta"), F.size(F.array_distinct(F.flatten(F.collect_list("meses")))).cast("long").alias("n_meses"), F.min("nmin").alias("numero_reporte_min"), F.max("nmax").alias("numero_reporte_max"), *[F.max(c).alias(c) for c in LONGEST],
    )
    cases = computed(cases, minas=_entries(words, catalogue, 0), duenos=_entries(words, catalogue, 1), tipo=_mode("kinds", "tipo_estandar"), dept=_mode("kinds", "departamento"), **{f"{c}_texto": F.coalesce(F.col(f"{c}.t"), F.lit("")) for c in LONGEST})
    owners = F.when(F.col("socio") & F.arrays_overlap("minas", F.array(*[F.lit(m) for m in partner[1]])), F.array_union("duenos", F.array(F.lit(partner[0])))).otherwise(F.col("duenos")) if partner else F.col("duenos")
    place = F.left(squeeze("ubicacion_texto"), F.lit(PLACE))
    if villages is not None:
        cases = cases.join(_villages(rows, cases, villages, key).withColumnRenamed(key, "__case"), F.col(key) == F.col("__case"), "left").drop("__case")
        place = F.coalesce(F.col("pueblos"), place)
    summary, source = extract_summary("caso_texto"), F.lit("extractivo_caso")
    if summaries is not None:
        told = summaries.filter(F.trim(text("resumen")) != "").groupBy(F.col(key).cast("string").alias("__case")).agg(F.max(F.trim(F.col("resumen"))).alias("__resumen"))
        cases = cases.join(told, F.col(key).cast("string") == F.col("__case"), "left").drop("__case")
        summary, source = F.coalesce("__resumen", summary), F.when(F.col("__resumen").isNotNull(), "modelo").otherwise(source)
    yes = lambda c: F.when(F.col(c), "Sí").otherwise("No")
    whole = (F.col("caso_texto") != "") & ((F.col("tipo") != "") | (F.col("actores_primarios_texto") != "") | (F.col("actores_texto") != ""))
    named = F.concat(F.lit("Caso_"), F.col(key).cast("string"))
    return cases.select(
        named.alias("grupo"), F.col(key), summary.alias("resumen"), source.alias("fuente_resumen"), yes("ilegal").alias("es_ilegal"), yes("informal").alias("es_informal"), place.alias("pueblos"), list_text("minas").alias("minas"), list_text(owners).alias("companias"),
        whole.cast("int").alias("completo"), F.coalesce("desde", F.lit("")).alias("primera_fecha"), F.coalesce("hasta", F.lit("")).alias("ultima_fecha"), F.upper("dept").alias("departamento"), "tipo", *[F.col(f"{c}_texto").alias(c) for c in LONGEST],
        "n_meses", "n_filas_panel", "numero_reporte_min", "numero_reporte_max", F.col("es_socioambiental").cast("int").alias("es_socioambiental"), F.col("menciona_mineria").cast("int").alias("menciona_mineria"), case_key("caso_texto").alias("caso_estandarizado"),
    )


def _villages(rows: DataFrame, cases: DataFrame, villages: DataFrame, key: str) -> DataFrame:
    """(case, pueblos): up to six villages of the case's mines that one of its texts holds, mines in catalogue order, villages in theirs."""
    mines = cases.select(F.col(key).alias("__case"), F.posexplode("minas").alias("at", "mina"))
    wanted = mines.join(villages.select("mina", "nombre", F.col("orden").alias("rank"), fold("nombre").alias("folded")), "mina")
    hits = rows.select(F.col(key), "blob").join(wanted, F.col(key) == F.col("__case")).filter(F.contains("blob", "folded")).groupBy(key, "nombre").agg(F.min(F.struct("at", "rank")).alias("place"))
    kept = hits.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("place", "nombre"))).filter(F.col("r") <= VILLAGES)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "nombre"))), lambda x: x["nombre"]), "; ").alias("pueblos"))


