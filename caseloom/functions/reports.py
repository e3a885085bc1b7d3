"""Numbers, dates and names of reports, and the records of a summary model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions import lexicon as L
from caseloom.functions.text import ColumnLike, _lookup, bound, fold, text

_MONTH = "|".join(sorted(L.MONTHS, key=len, reverse=True))
MONTH_YEAR = rf"\b({_MONTH})\b[\s_.\-]*(?:de(?:l)?[\s_.\-]*)?(20\d{{2}})\b"
CLOSING_DAY = rf"al\s+(\d{{1,2}})\s+de\s+({_MONTH})\s+(?:del?\s+)?(20\d{{2}})"
NUMBER_PATTERNS = (
    r"reporte(?:\s+mensual)?(?:\s+de)?\s+conflictos\s+sociales\s+n[o.\s_-]*\s*(\d{1,3})\b",
    r"reporte\s+n[o.\s_-]*\s*(\d{1,3})\b",
    r"conflictos\s+sociales\s+n[o.\s_-]*\s*(\d{1,3})\b",
    r"(?:reporte[^\n]{0,40})?n[o.\s_-]*\s*(\d{1,3})\b",
)


def _plain(c: ColumnLike) -> Column:
    return _ordinals(fold(_ordinals(text(c))))


def _ordinals(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("º"), F.lit("o")), F.lit("°"), F.lit("o"))


def _first(*found: Column) -> Column:
    """The first that is not empty; each is worked out once, and only if none before it is there."""
    return F.coalesce(*[bound(f, lambda x: F.when(x != "", x)) for f in found])


def _number(c: Column) -> Column:
    return bound(c.try_cast("int"), lambda n: F.when(n.between(*L.REPORT_NUMBERS), n))


def month_number(c: Column) -> Column:
    return _lookup({k: str(v) for k, v in L.MONTHS.items()}, c).cast("int")


def from_text(c: ColumnLike) -> Column:
    """struct(number, month, year) of a cover text.

    The number is the first header that fits; month and year stand within 500
    characters behind it, else in the closing day, else in the first mention
    with 'conflicto' or 'reporte' nearby, else in the first mention.
    """
    return bound(_plain(c), _from_text)


def _from_text(t: Column) -> Column:
    """Each step is bound: what follows names it several times."""
    head = F.left(t, F.lit(2500))
    label = _first(F.regexp_extract(head, NUMBER_PATTERNS[0], 0), F.regexp_extract(F.left(head, F.lit(1500)), NUMBER_PATTERNS[1], 0), F.regexp_extract(head, NUMBER_PATTERNS[2], 0), F.regexp_extract(head, NUMBER_PATTERNS[3], 0))

    def behind(label: Column) -> Column:
        near = F.regexp_extract(F.substring(t, F.instr(t, label) + F.length(label), F.lit(500)), MONTH_YEAR, 0)
        closing = F.regexp_extract(F.left(t, F.lit(4000)), CLOSING_DAY, 0)
        told = F.regexp_extract(head, rf"(?:conflicto|reporte)[\s\S]{{0,80}}?({MONTH_YEAR})", 1)
        return bound(_first(near, closing, told, F.regexp_extract(head, MONTH_YEAR, 0)), lambda chosen: parts(label, chosen))

    def parts(label: Column, chosen: Column) -> Column:
        month = month_number(F.regexp_extract(chosen, rf"\b({_MONTH})\b", 1))
        year = _first(F.regexp_extract(chosen, r"(20\d{2})", 1)).cast("int")
        return F.struct(_number(F.regexp_extract(label, r"(\d{1,3})$", 1)).alias("number"), month.alias("month"), year.alias("year"))

    return bound(label, behind)


def stem(c: ColumnLike) -> Column:
    return F.regexp_replace(F.regexp_extract(text(c), r"([^/]*)$", 1), r"\.[^.]*$", "")


def from_name(c: ColumnLike) -> Column:
    """struct(number, month, year) of a file name: the last month with a year, else one with two digits."""
    return bound(_plain(stem(c)), _from_name)


def _from_name(t: Column) -> Column:
    found = _first(F.regexp_extract(t, r"n[o.\s_-]*\s*(\d{1,3})\b", 1), F.regexp_extract(t, r"conflictos(?:[_\s-]*sociales)?[_\s-]*(\d{1,3})\b", 1))
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(MONTH_YEAR), F.lit(0)), F.lit(-1))
    short = r"(ene|feb|mar|abr|may|jun|jul|ago|sep|set|oct|nov|dic)[a-z]*[_\s\-.]*(?:20)?(\d{2})\b"

    def told(last: Column) -> Column:
        month = F.coalesce(month_number(F.regexp_extract(last, rf"({_MONTH})", 1)), month_number(F.regexp_extract(t, short, 1)))
        year = F.coalesce(F.regexp_extract(last, r"(20\d{2})", 1).cast("int"), F.concat(F.lit("20"), _first(F.regexp_extract(t, short, 2))).cast("int"))
        return F.struct(month.alias("month"), year.alias("year"))

    def parts(x: Column) -> Column:
        early = F.when((x["year"] <= 2005) & x["month"].isNotNull(), _first(F.regexp_extract(t, r"reporte\s*0*(\d{1,2})\b", 1)).cast("int"))
        return F.struct(F.coalesce(_number(found), early).alias("number"), x["month"].alias("month"), x["year"].alias("year"))

    return bound(bound(last, told), parts)


def dated(name: ColumnLike, cover: ColumnLike) -> Column:
    """struct(number, month, year, origin): the cover's values, else the name's; a name that starts with month and year wins."""
    starts = fold(stem(name)).rlike(rf"^(?:(?:mitad|final)\s|(?:{_MONTH})\s+20\d{{2}}\b)")
    return bound(F.struct(from_name(name).alias("name"), from_text(cover).alias("text"), starts.alias("starts")), _dated)


def _dated(found: Column) -> Column:
    by_name, by_text = found["name"], found["text"]
    leads = found["starts"] & by_name["month"].isNotNull() & by_name["year"].isNotNull()
    pick = lambda k: F.when(leads, F.coalesce(by_name[k], by_text[k])).otherwise(F.coalesce(by_text[k], by_name[k])).alias(k)
    origin = F.when(leads, "nombre").when(by_text["month"].isNotNull() & by_text["year"].isNotNull(), "pdf").when(by_name["month"].isNotNull(), "nombre").otherwise("sin_fecha")
    return F.struct(pick("number"), pick("month"), pick("year"), origin.alias("origin"))


def number_in_name(c: ColumnLike) -> Column:
    """Report number of a listing's file name: the first of 50 or more, else the first."""
    t = _plain(stem(c))
    near = F.concat(F.regexp_extract_all(t, F.lit(r"n[o.\s_-]*\s*(\d{1,3})\b"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"conflictos(?:[_\s-]*sociales)?[_\s-]*(\d{1,3})\b"), F.lit(1)))
    near = F.when(F.size(near) > 0, near).otherwise(F.regexp_extract_all(t, F.lit(r"(\d{1,3})$"), F.lit(1)))
    valid = F.filter(F.transform(near, lambda x: x.cast("int")), lambda n: n.between(*L.REPORT_NUMBERS))
    return F.coalesce(F.try_element_at(F.filter(valid, lambda n: n >= 50), F.lit(1)), F.try_element_at(valid, F.lit(1)))


def number_in_store(c: ColumnLike) -> Column:
    """Report number of a stored file's name: the last one behind an 'n', else behind 'conflictos', else a small one behind 'reporte'.

    An inventory's own prefix 'n12_' is no report number; misnamed files and titles that are no monthly report have none.
    """
    name = fold(c)
    t = F.regexp_replace(fold(stem(c)), L.STORE_PREFIX, "")
    found = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: x.cast("int")) for p in L.STORE_NUMBERS]
    picks = [F.try_element_at(found[0], F.lit(-1)), F.try_element_at(found[1], F.lit(1)), F.try_element_at(found[2], F.lit(1))]
    valid = F.coalesce(*[F.when(n.between(1, most), n) for n, most in zip(picks, L.STORE_LIMITS, strict=True)])
    other = F.lit(False)
    for word in L.STORE_OTHERS:
        other = other | name.contains(word)
    return F.when(~other & ~fold(stem(c)).startswith("malnombrado"), valid)


def layout_features(first: ColumnLike | None, second: ColumnLike | None, pages: Column, images: Column, traits: Column | None = None) -> dict[str, Column]:
    """What ``layout`` judges by: size and scan of the first page, and phrases near the start of the first two."""
    traits = layout_traits(first, second) if traits is None else traits
    chars = traits["chars"]
    return {"pages": pages, "images": images, "chars": chars, "scanned": (chars < 250) & (images >= 1), "k_report_n": traits["k_report_n"]} | {k: traits[k] for k in L.LAYOUT_PHRASES}


def layout_traits(first: ColumnLike, second: ColumnLike) -> Column:
    """struct of what the words of the first two pages tell; as a column of its own (``computed``) it is worked out once."""
    return bound(F.struct(text(first).alias("first"), text(second).alias("second")), lambda x: bound(_ordinals(fold(F.concat(x["first"], F.lit("\n"), x["second"]))), lambda head: _traits(x["first"], head)))


def _traits(first: Column, head: Column) -> Column:
    chars = F.length(F.regexp_replace(first, r"(?U)\s+", ""))

    def has(key: str) -> Column:
        upto, phrases = L.LAYOUT_PHRASES[key]
        part = F.left(head, F.lit(upto)) if upto else head
        out = F.lit(False)
        for phrase in phrases:
            out = out | part.contains(phrase)
        return out

    report_n = F.left(head, F.lit(2500)).rlike(r"reporte\s+n[o.\s_-]*\s*\d+")
    return F.struct(chars.alias("chars"), report_n.alias("k_report_n"), *[has(k).alias(k) for k in L.LAYOUT_PHRASES])


def name_key(c: ColumnLike) -> Column:
    """Letters and digits of a file name without boilerplate."""
    return F.regexp_replace(F.regexp_replace(fold(stem(c)), "[^a-z0-9]+", ""), "reportemensualde|reportede", "")


def short_key(c: ColumnLike) -> Column:
    t = F.regexp_replace(fold(stem(c)), r"reporte[-_ ]*(?:mensual[-_ ]*de[-_ ]*)?conflictos[-_ ]*sociales[-_ ]*", "")
    return F.regexp_replace(F.regexp_replace(t, r"n[o.\s_-]*", "n"), "[^a-z0-9]+", "")


def safe_name(c: ColumnLike) -> Column:
    name = F.translate(F.regexp_replace(F.regexp_extract(text(c), r"([^/]*)$", 1), r'[<>:"/\\|?*]', "_"), "°º", "oo")
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def file_name(url: ColumnLike, number: ColumnLike) -> Column:
    """Name of a download; the report number goes in front if the name lacks it."""
    raw = F.regexp_replace(F.regexp_extract(F.try_url_decode(F.regexp_replace(text(url), r"[?#].*$", "")), r"([^/]*)$", 1), r"(?U)[^\w.\-]+", "_")
    raw = F.when(F.lower(raw).endswith(".pdf"), raw).otherwise(F.concat(F.coalesce(F.nullif(raw, F.lit("")), F.lit("reporte")), F.lit(".pdf")))
    n = text(number)
    there = F.array_contains(F.regexp_extract_all(raw, F.lit(r"(?<!\d)(\d+)(?!\d)"), F.lit(1)), n)
    return F.when((n == "") | there, raw).otherwise(F.concat(F.lit("n"), n, F.lit("_"), raw))


def ascii_url(url: ColumnLike) -> Column:
    """Percent-encoded path of an address with other letters."""
    u = text(url)
    origin = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    rest = F.regexp_extract(u, r"([?#].*)$", 1)
    encoded = F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(F.coalesce(F.try_url_decode(p), p)), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(origin, encoded, rest)


def is_monthly(title: ColumnLike, url: ColumnLike) -> Column:
    """Deny-list first, then the title's phrase, then an old file name."""
    blob = F.concat_ws(" ", text(title), F.coalesce(F.try_url_decode(text(url)), text(url)))
    name = fold(F.regexp_extract(F.regexp_replace(text(url), r"[?#].*$", ""), r"([^/]*)$", 1))
    old = name.contains("conflicto") & ~name.contains("crisis") & name.endswith(".pdf")
    return F.when(blob.rlike(f"(?iu){L.TITLE_NO}"), False).when(blob.rlike(f"(?iu){L.TITLE_YES}"), True).otherwise(old)


def layout(f: dict[str, Column], number: Column, name: ColumnLike) -> Column:
    """Layout family from page features: the first rule that holds."""
    few = lambda n: number.isNull() | (number <= n)
    return (
        F.when(fold(name).contains("especial") | (f["k_special"] & (f["pages"] < 20)), "especial_no_mensual")
        .when(f["scanned"] | ((f["chars"] < 80) & (f["images"] >= 1)), "escaneado_imagen")
        .when(f["k_cycle"], "infografia_ciclo_2024")
        .when(f["k_deputy"], "adjuntia_portada_estadistica")
        .when(f["k_direction"] | f["k_summary"], "unidad_sumilla")
        .when(f["k_unit"] & f["k_report_n"], "unidad_reporte_n")
        .when(f["k_intensity"] & ~f["k_report_n"] & few(3), "lista_narrativa_2004")
        .when(f["k_report_n"], "reporte_n_tabla_regiones")
        .when(f["k_intensity"], "lista_narrativa_2004")
        .when(number.isNotNull() & (number <= 5), "lista_narrativa_2004")
        .otherwise("otro")
    )


RECORD = "resumen string, empresa string, mineral string, comunidades string, demanda_principal string, tipo_normalizado string, confianza string, texto_ilegible string"


def record(c: ColumnLike) -> Column:
    """A model's JSON answer, repaired and normalised: known types and confidences, blanks to the lowest."""
    fixed = F.regexp_replace(text(c), r"\\u(?![0-9a-fA-F]{4})", r"\\\\u")
    raw = F.from_json(F.regexp_extract(fixed, r"(\{[\s\S]*\})", 1), RECORD)
    return bound(raw, lambda raw: bound(F.struct(*[F.trim(text(raw[k])).alias(k) for k in (f.split()[0] for f in RECORD.split(", "))]), _record))


def _record(told: Column) -> Column:
    kind, sure = F.lower(told["tipo_normalizado"]), F.lower(told["confianza"])
    empty = told["resumen"] == ""
    return F.struct(
        *[told[k].alias(k) for k in L.RECORD_FIELDS[:5]],
        F.when(kind.isin(*L.RECORD_TYPES), kind).otherwise("otros").alias("tipo_normalizado"),
        F.when(~empty & sure.isin(*L.CONFIDENCES), sure).otherwise("baja").alias("confianza"),
        (empty | F.lower(told["texto_ilegible"]).isin(*L.YES_WORDS)).alias("texto_ilegible"),
    )


def prompt(department: ColumnLike, kind: ColumnLike, place: ColumnLike, actors: ColumnLike, months: ColumnLike, body: ColumnLike) -> Column:
    told = lambda c, missing="(sin dato)": F.coalesce(F.nullif(text(c), F.lit("")), F.lit(missing))
    lines = [("Departamento: ", told(department)), ("Tipo en la ficha: ", told(kind)), ("Ubicación: ", told(place)), ("Actores: ", told(actors)), ("Meses cubiertos: ", told(months, "?"))]
    return F.concat_ws("\n", *[F.concat(F.lit(a), b) for a, b in lines], F.lit(""), F.lit("Texto de la ficha (columna de descripción y hechos del mes):"), F.regexp_replace(text(body), r"(?U)^\s+|\s+$", ""))


def content_key(*parts: ColumnLike) -> Column:
    """SHA-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[text(p) for p in parts]), 256)


