"""The panel plan: pages in, cards, cases and failures out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions import lexicon as L
from caseloom.functions.text import case_key, complete_department, computed, topic_flags
from caseloom.operators import fields, segmentation as S
from caseloom.operators.checkpoints import checkpoint
from caseloom.operators.rollups import keep_best, unique_cases


def detail_pages(pages: DataFrame) -> DataFrame:
    return S.latched_range(pages, ["doc"], "page", S.starts_detail(F.col("text")), S.stops_detail(F.col("text")))


def reads_columns(pages: DataFrame) -> DataFrame:
    """(doc, columns): by layout, else whether the first 55 pages have eight 'tipo:'."""
    kinds = F.sum(F.when(F.col("page") <= 55, F.regexp_count(F.lower("text"), F.lit(r"tipo\s*:"))))
    known = F.when(F.first("formato").isin(*L.FLOW_LAYOUTS), False).when(F.first("formato").isin(*L.COLUMN_LAYOUTS), True)
    return pages.groupBy("doc").agg(F.coalesce(known, kinds >= 8).alias("columns"))


def inventory(files: DataFrame) -> DataFrame:
    """One file a report number: there, then more pages, then first; files without a number all stay; specials go."""
    rows = files.filter((F.col("formato") != "especial_no_mensual") & ~F.col("archivo").startswith("MALNOMBRADO"))
    return keep_best(rows, ["numero"], F.desc("existe"), F.desc("paginas"), F.col("pos"), blank=F.col("numero").isNull())


def cards(pages: DataFrame) -> DataFrame:
    """Panel rows of pages (doc, page, height, text, blocks, formato), with flags and departments.

    Two steps are written, because several others read them: the detail pages,
    and the cards before those of the latent tables come to them.
    """
    inside = checkpoint(detail_pages(pages).join(reads_columns(pages), "doc"))
    by_line = inside.filter("not columns").select("doc", "page", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    lines = by_line.select("doc", (F.col("page").cast("long") * 1_000_000 + F.col("n")).alias("pos"), "text")
    flow = S.cards_from_lines(lines).select("doc", "card", F.lit(0).alias("page"), "estado", "departamento", F.array("body").alias("left"), F.array().cast("array<string>").alias("right"))
    found = checkpoint(fields.accepted_cards(S.cards_from_blocks(S.layout_blocks(inside.filter("columns"))).unionByName(flow)))
    spans = S.latent_spans(inside).filter("latent_text is not null")
    texts = spans.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "latent_text"))), lambda x: x["latent_text"]), "\n").alias("text"))
    extra = S.new_latent(S.latent_rows(texts), found).withColumn("estado", F.lit("Latente"))
    out = found.unionByName(extra, allowMissingColumns=True)
    names = ("codigo", "caso", "ubicacion", "actores_primarios", "actores_secundarios", "actores", "texto_crudo")
    social, mining = topic_flags("tipo", *names)
    known = out.withColumnRenamed("departamento", "encabezado")
    return computed(known, departamento=complete_department("encabezado", "ubicacion", "caso"), es_socioambiental=social, menciona_mineria=mining, caso_estandarizado=case_key("caso")).drop("encabezado")


def failures(pages: DataFrame, panel: DataFrame) -> DataFrame:
    """(archivo, motivo): documents that gave no card."""
    return pages.select("doc").distinct().join(panel.select("doc").distinct(), "doc", "left_anti").select(F.col("doc").alias("archivo"), F.lit("cero fichas").alias("motivo"))


def cases(panel: DataFrame) -> DataFrame:
    return unique_cases(panel)
