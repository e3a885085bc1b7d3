"""Label-anchored fields of a card's text, with their fallbacks, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import lexicon as L
from caseloom.functions.text import bound, clean, computed, cut_at_sentence, fold, norm_ws, text
from caseloom.operators.segmentation import is_badge, is_garbage

_NEXT = "|".join(L.LABELS)
_FLAGS = "(?iumsd)"
#: The fields of a card, in order.
FIELDS = ("codigo", "tipo", "ingreso_como", "caso", "ubicacion", "actores_primarios", "actores_secundarios", "actores_terciarios", "actores", "hechos_del_mes")


def _field(label: str, sign: str = r"\s*[:.]?\s*") -> str:
    return rf"{_FLAGS}^(?:{label}){sign}(.*?)(?=^(?:{_NEXT})\b|\z)"


def break_labels(c: Column) -> Column:
    """A line break before each label that stands inside a line."""
    t = F.replace(text(c), F.lit("­"), F.lit(""))
    for kind in ("primarios", "secundarios", "terciarios"):
        t = F.regexp_replace(t, rf"(?iu)actores\s+{kind}", f"Actores {kind}")
    inline = r"tipo|ubicaci[oó]n|actores?\s+primarios?|actores?\s+secundarios?|actores?\s+terciarios?|ingres[oó]\s+como|c[oó]digo"
    t = F.regexp_replace(t, rf"(?iu)\s+(?=(?:{inline})\s*[:.])", "\n")
    return F.regexp_replace(t, r"(?iu)(?<!como )\s+(?=caso\s*[:.])", "\n")


def parse_card(body: Column, events: Column) -> Column:
    """struct of the ten fields of a card; missing ones are empty."""
    return bound(break_labels(body), lambda t: _fields(t, events))


def _fields(t: Column, events: Column) -> Column:
    get = lambda label: clean(F.regexp_extract(t, _field(label), 1))
    first = lambda *found: F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))
    kind = F.left(F.btrim(F.regexp_replace(get("tipo"), r"(?iu)\s+ingres[\s\S]*$", ""), F.lit(" .;")), F.lit(160))
    entered = rf"{_FLAGS}^ingres[oó]\s+como(?:\s+caso)?(?:\s+(nuevo|reactivado))?\s*[:.]?\s*(.*?)(?=^(?:{_NEXT})\b|\z)"
    told = F.trim(F.concat_ws(" ", F.nullif(F.lower(F.regexp_extract(t, entered, 1)), F.lit("")), F.nullif(clean(F.regexp_extract(t, entered, 2)), F.lit(""))))
    badge = F.lower(F.regexp_extract(t, r"(?ium)^caso\s+(nuevo|reactivado)\b", 1))
    case = clean(F.regexp_extract(t, rf"{_FLAGS}^caso\s*(?!nuevo\b|reactivado\b)[:.]\s*(.*?)(?=^(?:{_NEXT})\b|\z)", 1))
    main = get(r"actores?\s+primarios?")
    happened = get("hechos|antecedentes")
    paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: clean(p)), lambda p: (F.length(p) > 40) & ~fold(p).rlike("^(?:tipo|codigo|caso n)"))
    longest = F.coalesce(F.try_element_at(paragraphs, F.lit(1)), F.lit(""))
    return F.struct(
        get("c[oó]digo").alias("codigo"),
        kind.alias("tipo"),
        first(told, badge).alias("ingreso_como"),
        first(case, get("motivo|cuestionamientos?"), cut_at_sentence(happened, L.CASE_LIMIT), cut_at_sentence(longest, L.CASE_LIMIT)).alias("caso"),
        first(get("ubicaci[oó]n"), get("poblaci[oó]n")).alias("ubicacion"),
        main.alias("actores_primarios"),
        get(r"actores?\s+secundarios?").alias("actores_secundarios"),
        get(r"actores?\s+terciarios?").alias("actores_terciarios"),
        first(F.when(main == "", get("actores")).otherwise(""), get("autoridad")).alias("actores"),
        first(clean(events), happened).alias("hechos_del_mes"),
    )


def accepted_cards(cards: DataFrame) -> DataFrame:
    """Parsed cards (doc, card, page, estado, departamento, left, right) that hold something."""
    c = computed(cards, body=F.array_join("left", "\n")).filter((F.length("body") >= 12) & ~is_badge(F.col("body")))
    c = computed(c, f=parse_card(F.col("body"), F.array_join("right", " ")))
    full = (F.col("f.caso") != "") | (F.col("f.tipo") != "") | (F.col("f.codigo") != "") | (F.length("body") > 80)
    c = c.filter(full & ~fold("f.caso").startswith(L.INSTITUTION_START))
    c = computed(c, told=F.regexp_replace("f.caso", r"^\d+\.\s*", ""))
    c = c.filter(~is_garbage({"caso": F.col("told")} | {k: F.col(f"f.{k}") for k in ("tipo", "codigo", "ubicacion")}))
    rest = [F.col(f"f.{k}") for k in FIELDS[FIELDS.index("caso") + 1 :]]
    return c.select("doc", "card", "page", "estado", "departamento", *[F.col(f"f.{k}") for k in FIELDS[: FIELDS.index("caso")]], F.col("told").alias("caso"), *rest, F.left(norm_ws("body"), F.lit(L.RAW_LIMIT)).alias("texto_crudo"))
