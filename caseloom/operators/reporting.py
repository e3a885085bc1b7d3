"""What a run hands on: inputs for a model, gaps by year, the run's summary, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.reports import content_key, prompt
from caseloom.functions.text import computed, fold, text

#: The months' names in order, what stands between sampled events, and the fields of a manifest.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre")
BETWEEN = "\n---\n"
MANIFEST = ("numero", "titulo", "fuente", "fecha_publicacion", "url", "archivo", "bytes", "sha256", "estado")
LONGEST = ("texto_crudo", "caso", "actores_primarios", "actores", "departamento", "tipo", "ubicacion")


def _real(c: str) -> Column:
    t = F.trim(text(c))
    return F.when((t != "") & (F.lower(text(c)) != "nan"), t)


def sampled_events(panel: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the first, middle and last real text of each group in order, each text once.

    Places come from a window, so only three texts of a group are ever together.
    """
    real = panel.select(F.col(key), F.col(order).alias("__o"), _real(value).alias("__t")).filter("__t is not null")
    w = W.partitionBy(key)
    placed = real.withColumn("__i", F.row_number().over(w.orderBy("__o")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    picks = placed.filter((F.col("__i") == 0) | (F.col("__i") == F.floor(F.col("__n") / 2)) | (F.col("__i") == F.col("__n") - 1))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__t"))), lambda x: x["__t"]))
    return picks.groupBy(key).agg(F.array_join(texts, BETWEEN).alias(value))


def model_inputs(panel: DataFrame, model: str, version: str, limit: int, key: str = "caso_id", order: str = "pos") -> DataFrame:
    """One request a case: key, the case's longest texts, n_meses, request, hash.

    The body is the longest raw text (else the longest case), then sampled
    events, cut to ``limit`` characters.  ``n_meses`` counts the pairs of year
    and month, blank ones included.  The hash of model, version and request
    names the answer in a cache.
    """
    have = [c for c in LONGEST if c in panel.columns]
    longest = {c: F.max(F.when(_real(c).isNotNull(), F.struct(F.length(_real(c)).alias("n"), (-F.col(order)).alias("early"), _real(c).alias("t")))) for c in have}
    month = F.struct(F.coalesce(F.col("anio").cast("string"), F.lit("")).alias("a"), F.coalesce(F.col("mes").cast("string"), F.lit("")).alias("m"))
    cases = panel.groupBy(key).agg(F.count_distinct(month).alias("n_meses"), *[c.alias(f"__{n}") for n, c in longest.items()])
    events = sampled_events(panel, key, "hechos_del_mes", order) if "hechos_del_mes" in panel.columns else None
    told = cases.join(events.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left").drop("__k") if events is not None else cases.withColumn("hechos_del_mes", F.lit(None).cast("string"))
    of = lambda c: F.coalesce(F.col(f"__{c}.t"), F.lit("")) if c in have else F.lit("")
    first = lambda a, b: F.when(a != "", a).otherwise(b)
    whole = F.concat_ws("\n\n", F.nullif(first(of("texto_crudo"), of("caso")), F.lit("")), F.nullif(F.coalesce("hechos_del_mes", F.lit("")), F.lit("")))
    rows = computed(told, departamento=of("departamento"), tipo=of("tipo"), ubicacion=of("ubicacion"), actores=first(of("actores_primarios"), of("actores")), cuerpo=F.left(whole, F.lit(limit)))
    rows = computed(rows, request=prompt("departamento", "tipo", "ubicacion", "actores", "n_meses", "cuerpo"))
    return rows.select(key, "departamento", "tipo", "ubicacion", "actores", "n_meses", "request", content_key(F.lit(model), F.lit(version), "request").alias("hash"))


def gaps_by_year(calendar: DataFrame, state: str = "estado", missing: str = "falta") -> DataFrame:
    """(anio, meses): the names of each year's missing months, in order."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    gone = calendar.filter(F.col(state) == missing).select("anio", F.col("mes").cast("int").alias("mes")).distinct()
    return gone.groupBy("anio").agg(F.array_join(F.transform(F.array_sort(F.collect_list("mes")), lambda m: F.element_at(names, m)), ", ").alias("meses"))


def run_summary(panel: DataFrame, inventory: DataFrame, failures: DataFrame, layout: str = "formato") -> DataFrame:
    """(orden, clave, valor): what a run did, then its cards by layout, most first.

    The totals are one aggregate each; the layouts are few.
    """
    said = lambda c: F.count_if(text(c) != "")
    yes = lambda c: F.count_if(text(c).isin("1", "true"))
    totals = panel.agg(F.count(F.lit(1)).alias("filas"), said("caso").alias("con_caso"), F.count_distinct("caso_id").alias("casos_unicos"), yes("es_socioambiental").alias("socioambientales"), yes("menciona_mineria").alias("mencionan_mineria"))
    totals = totals.join(inventory.agg(F.count(F.lit(1)).alias("pdf_procesados"))).join(failures.agg(F.count(F.lit(1)).alias("pdf_sin_fichas")))
    names = ("pdf_procesados", "filas", "con_caso", "casos_unicos", "socioambientales", "mencionan_mineria", "pdf_sin_fichas")
    lines = totals.select(F.explode(F.array(*[F.struct(F.lit(i).alias("orden"), F.lit(n).alias("clave"), F.col(n).cast("long").alias("valor")) for i, n in enumerate(names)])).alias("l")).select("l.*")
    kinds = panel.groupBy(F.col(layout).alias("clave")).agg(F.count(F.lit(1)).alias("valor"))
    placed = kinds.withColumn("orden", F.lit(len(names)) + F.row_number().over(W.orderBy(F.desc("valor"), "clave")) - 1)  # a row a layout
    return lines.unionByName(placed.select("orden", F.concat(F.lit("formato: "), F.coalesce("clave", F.lit(""))).alias("clave"), "valor"))


def company_column(columns: list[str], spark) -> str:
    """Of a sheet's headings the one of the mining company: by its name, else another that tells of mines, else the eighth."""
    names = [r["f"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, c string").select("i", fold("c").alias("f")).orderBy("i").collect()]  # headings only
    for column, name in zip(columns, names, strict=True):
        if "compan" in name.replace(" ", ""):
            return column
    for column, name in zip(columns, names, strict=True):
        if column != "EsMinera" and "minera" in name:
            return column
    return columns[7]


def manifest(rows: DataFrame) -> DataFrame:
    """The manifest's fields as texts, in order; missing ones are empty."""
    return rows.select(*[(text(c) if c in rows.columns else F.lit("")).alias(c) for c in MANIFEST])


def write_manifest(rows: DataFrame, folder: str) -> None:
    """The manifest as CSV with a header and as one JSON object a line, in the order of number and title."""
    number = F.coalesce(F.col("numero").try_cast("int"), F.lit(-1))
    out = manifest(rows).repartitionByRange(number, "titulo").sortWithinPartitions(number, "titulo")
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{folder}/manifiesto.csv")
    out.write.mode("overwrite").json(f"{folder}/manifiesto.jsonl")
