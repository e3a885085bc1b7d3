"""Cutting report pages into cards: page ranges, status, and gaps-and-islands over blocks or lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions import lexicon as L
from caseloom.functions.text import bound, clean, computed, department, fold, leading_department, norm_ws, squeeze, text

ICASE = "(?iu)"


def _any(patterns) -> str:
    return "(?:" + "|".join(patterns) + ")"


def starts_detail(c: Column) -> Column:
    """Whether a page opens the detailed part: three guards, then eleven signs."""
    return bound(squeeze(fold(c)), _starts_detail)


def _starts_detail(t: Column) -> Column:
    kinds = F.regexp_count(t, F.lit(r"tipo\s*:"))
    has = t.contains
    guard = (has("sumilla") & (kinds < 3)) | (has("informacion consolidada") & (kinds < 2)) | (has("fecha de inicio") & has("estado situacional"))
    signs = (
        (has("detalle de los conflictos sociales activos") & ((kinds >= 1) | has("desarrollados en un solo departamento") | has("en un departamento")))
        | (has("detalle de los conflictos") & (kinds >= 2))
        | (has("anexo") & has("descripcion de los conflictos"))
        | t.rlike(r"iii\.?\s+descripcion de los conflictos")
        | (t.rlike(r"1\.1\.?\s+conflictos activos") & (kinds >= 2))
        | ((kinds >= 2) & has("la defensoria del pueblo da cuenta") & has("conflictos activos"))
        | (t.rlike(r"1\.\s*conflictos activos") & has("estado:"))
        | t.rlike(r"1\.\s*(?:nuevos casos|casos nuevos)")
        | (has("conflictos vigentes") & t.rlike(r"region\s+\w+"))
        | (has("autoridad cuestionada") & has("ubicacion"))
        | (t.rlike(r"autoridad\s*:") & t.rlike(r"motivo\s*:"))
    )
    return ~guard & signs


def stops_detail(c: Column) -> Column:
    """Whether a page after the start ends the detailed part."""
    return _stops_detail(text(c), fold(c))


def _stops_detail(raw: Column, whole: Column) -> Column:
    head = fold(F.substring_index(raw, "\n", 12))
    return ~F.left(whole, F.lit(1500)).contains("sumilla") & ~raw.rlike(ICASE + r"tipo\s*:") & head.rlike(_any(L.STOP_HEADINGS))


def opens_latent(c: Column) -> Column:
    return bound(fold(c), _opens_latent)


def _opens_latent(t: Column) -> Column:
    head = F.left(t, F.lit(800))
    return t.contains("detalle de los conflictos latentes") | head.rlike(r"n\.?\s*°?\s*ubicacion\s+caso") | head.rlike(r"n\.?\s*°?\s*fecha\s+de\s+inicio\s+departamento\s+denominacion")


def page_signs(c: Column) -> Column:
    """struct(starts, stops, latent, status): the signs of a page, from one folding of its text."""
    both = F.struct(text(c).alias("raw"), fold(c).alias("whole"), fold(F.left(text(c), F.lit(2200))).alias("head"))
    return bound(both, lambda x: F.struct(bound(squeeze(x["whole"]), _starts_detail).alias("starts"), _stops_detail(x["raw"], x["whole"]).alias("stops"), _opens_latent(x["whole"]).alias("latent"), _page_status(x).alias("status")))


def block_status(c: Column) -> Column:
    """Status that a heading block sets, else null."""
    return status_of(fold(c))


def status_of(folded: Column) -> Column:
    """``block_status`` of a folded text."""
    return bound(F.btrim(squeeze(folded), F.lit(" .:")), _block_status)


def _block_status(t: Column) -> Column:
    head, full = F.left(t, F.lit(120)), lambda p: t.rlike(f"^(?:{p})$")
    number = r"(?:\d+\.\d+\s+)?"
    return (
        F.when(head.contains("detalle de los conflictos latentes"), "Latente")
        .when(head.contains("detalle de los conflictos sociales activos"), "Activo")
        .when(F.length(t) > 220, F.lit(None).cast("string"))
        .when(full(number + r"(?:detalle de los )?conflictos latentes"), "Latente")
        .when(full(r"(?:casos|conflictos) fusionados"), "Fusionado")
        .when(t.rlike("casos en observacion|conflictos inactivos") & (F.length(t) < 80), "Inactivo")
        .when(full(number + "conflictos reactivados"), "Reactivado")
        .when(t.contains("desarrollados en mas de un departamento"), "Activo")
        .when(full(number + "conflictos activos(?: desarrollados en un solo departamento.*)?"), "Activo")
        .when(full(number + "(?:conflictos resueltos|conflictos concluidos|casos resueltos)(?: o desactivados)?"), "Resuelto")
        .when(full(r"(?:\d+\.\s*)?nuevos casos"), "Nuevo")
        .when(full(r"(?:\d+\.\s*)?conflictos vigentes"), "Activo")
    )


def page_status(c: Column) -> Column:
    """Status that a page's text shows, else null: each phrase counts within its own prefix."""
    return bound(F.struct(fold(c).alias("whole"), fold(F.left(text(c), F.lit(2200))).alias("head")), _page_status)


def _page_status(both: Column) -> Column:
    whole, t = both["whole"], both["head"]
    within = lambda phrase, n: F.left(t, F.lit(n)).contains(phrase)
    return (
        F.when(whole.contains("detalle de los conflictos latentes"), "Latente")
        .when(t.contains("detalle de los conflictos sociales activos") | t.contains("activos desarrollados en un solo departamento") | t.contains("desarrollados en mas de un departamento"), "Activo")
        .when(within("casos fusionados", 600) | within("conflictos fusionados", 600), "Fusionado")
        .when(F.left(whole, F.lit(2500)).contains("casos en observacion"), "Inactivo")
        .when(within("conflictos reactivados", 900), "Reactivado")
        .when(within("conflictos resueltos", 900) & ~within("cuadro", 200), "Resuelto")
        .when(within("conflictos concluidos", 600), "Resuelto")
        .when(within("nuevos casos", 400), "Nuevo")
        .when(within("conflictos vigentes", 500), "Activo")
    )


def is_page_header(c: Column) -> Column:
    return bound(squeeze(fold(c)), _is_page_header)


def _is_page_header(t: Column) -> Column:
    hit = t.isin(*L.HEADER_TEXTS)
    for phrase in L.HEADER_PHRASES:
        hit = hit | t.contains(phrase)
    return hit


def is_badge(c: Column) -> Column:
    return squeeze(fold(c)).isin(*L.BADGES)


def is_running_title(c: Column) -> Column:
    return bound(F.btrim(squeeze(fold(c)), F.lit(" :.")), _is_running_title)


def _is_running_title(t: Column) -> Column:
    return t.isin(*L.RUNNING_TITLES) | t.rlike(r"^\d+\s+anexo")


def starts_with_kind(c: Column) -> Column:
    return F.trim(text(c)).rlike(ICASE + r"^tipo\s*[:.]")


def hard_start(c: Column, numbered: bool = False) -> Column:
    """Whether a piece surely opens a card."""
    t = norm_ws(c)
    out = squeeze(fold(c)).isin("caso nuevo", "caso reactivado") | t.rlike(ICASE + r"^(?:tipo\s*[:.]|c[oó]digo\s*[:.]|casos?\s+n[°ºo.\s]*\d+)")
    return out | (t.rlike(r"^\d{1,3}\.\s+\S") & ~t.rlike(r"^\d+\.\d+")) if numbered else out


def soft_start(c: Column) -> Column:
    """Whether a piece opens a card when none is open yet."""
    return norm_ws(c).rlike(ICASE + r"^(?:ingres[oó]\s+como\b|caso\s*(?!nuevo\b|reactivado\b)[:.])")


def is_garbage(card: dict[str, Column]) -> Column:
    """Layout remains that are no card."""
    case = F.trim(text(card["caso"]))
    starts = fold(case).rlike(f"^{_any(L.GARBAGE_STARTS)}")
    no = lambda k: text(card[k]) == ""
    few = (case != "") & (F.size(F.split(case, r"\s+")) < 4)
    return starts | ((case == "") & no("tipo") & no("codigo")) | (few & no("tipo") & no("ubicacion"))


def layout_blocks(pages: DataFrame, split: float = 300.0, header: float = 55.0, footer: float = 50.0) -> DataFrame:
    """Text blocks of pages (doc, page, height, blocks): doc, page, y, x0, col, text, without headers, footers and page numbers."""
    b = pages.select("doc", "page", "height", F.explode("blocks").alias("b")).filter((F.col("b.type") == 0) & (F.col("b.y1") >= header) & (F.col("b.y0") <= F.col("height") - footer))
    b = computed(b.select("doc", "page", F.col("b.y0").alias("y"), F.col("b.x0").alias("x0"), F.when((F.col("b.x0") + F.col("b.x1")) / 2 < split, "L").otherwise("R").alias("col"), "b.lines"), text=norm_ws(F.array_join("lines", "\n"))).drop("lines")
    return b.filter((F.col("text") != "") & ~F.col("text").rlike(r"^\d{1,3}$") & ~is_page_header(F.col("text")))


def latched_range(rows: DataFrame, by: list[str], order: str, start: Column, stop: Column) -> DataFrame:
    """Rows from the first start, inclusive, to the first stop at or after it, exclusive; the start itself can stop."""
    w = W.partitionBy(*by)
    marked = rows.withColumn("__from", F.min(F.when(start, F.col(order))).over(w))
    marked = marked.withColumn("__to", F.min(F.when(stop & (F.col(order) >= F.col("__from")), F.col(order))).over(w))
    return marked.filter((F.col(order) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(order) < F.col("__to")))).drop("__from", "__to")


def carry(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, first: str | None = None) -> DataFrame:
    """Adds ``name``: the last value that is not null so far, else ``first``."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(first)))


def islands(rows: DataFrame, by: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Adds the running number of rows that open an island; rows before the first have 0."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(w))


def latent_spans(pages: DataFrame) -> DataFrame:
    """Status of each page with the reset that closing headings bring, and the text that belongs to the latent table.

    pages: doc, page, text.  Whether a page lies in the latent part depends on
    the last page that opened or closed it: both are facts of a page alone, and
    a closing heading counts only while the part is open, so carrying the last
    fact gives the automaton's state.
    """
    heading = F.regexp_instr(F.col("text"), F.lit(ICASE + r"(?:^|\n)\s*(?:viii\.?\s*|ix\.?\s*|x\.?\s*)?" + _any(L.CLOSING_HEADINGS)))
    p = pages.withColumn("shown", page_status(F.col("text"))).withColumn("cut", heading)
    p = p.withColumn("opens", opens_latent(F.col("text")) | (F.col("shown") == "Latente"))
    w = W.partitionBy("doc").orderBy("page")
    fact = F.when(F.col("cut") > 0, F.lit(False)).when(F.coalesce("opens", F.lit(False)), F.lit(True))
    p = p.withColumn("before", F.coalesce(F.last(fact, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    p = p.withColumn("inside", F.col("before") | F.coalesce("opens", F.lit(False))).withColumn("ends", F.col("inside") & (F.col("cut") > 0))
    p = carry(p, ["doc"], ["page"], F.when(F.col("ends"), "Inactivo").otherwise(F.col("shown")), "status", "Activo")
    body = F.when(F.col("inside") & F.col("ends") & (F.col("cut") > 81), F.expr("left(text, cut - 1)")).when(F.col("inside") & ~F.col("ends"), F.col("text"))
    return p.select("doc", "page", "text", "status", body.alias("latent_text"))


def cards_from_blocks(blocks: DataFrame) -> DataFrame:
    """Cards of two-column pages: doc, card, page, estado, departamento, left, right.

    blocks: doc, page, y, x0, col, text.  Headings set status and department,
    which later rows carry.  Left blocks are cut before 'Tipo:'; a piece opens a
    card if it is a hard start, except that 'Tipo:' goes on with an open card
    that has none yet; a soft start opens only the first card.  All of it is
    window expressions over one document.
    """
    t = F.col("text")
    words = computed(blocks, folded=fold(t))
    b = computed(words, status=F.when(F.length(t) < 220, status_of(F.col("folded"))), dept=F.when(F.length(t) < 48, department(t)))
    many = F.col("folded").contains("mas de un departamento")
    b = b.withColumn("sets", F.when(F.col("status").isNotNull() & many, "Multidepartamental").when(F.col("status").isNull(), F.col("dept")))
    skipped = F.col("folded").startswith("observacion") | F.col("folded").startswith("cuadro n")
    b = b.withColumn("heading", F.col("status").isNotNull() | F.col("dept").isNotNull() | skipped)
    b = b.withColumn("sets", F.when(~(skipped & F.col("status").isNull()), F.col("sets")))
    order = ["page", "y", "col", "x0"]
    b = carry(carry(b, ["doc"], order, F.col("status"), "estado", "Activo"), ["doc"], order, F.col("sets"), "departamento", "")
    pieces = b.filter(~F.col("heading")).select("doc", *order, "estado", "departamento", F.posexplode(F.when(F.col("col") == "L", F.split(t, ICASE + r"(?=\btipo\s*[:.])")).otherwise(F.array(t))).alias("piece", "text"))
    pieces = computed(pieces.withColumnRenamed("text", "raw"), text=norm_ws("raw")).filter("text != ''")
    left, seq = F.col("col") == "L", [*order, "piece"]
    first_line = F.regexp_extract("text", r"^([^\n]*)", 1)
    pieces = computed(pieces, kind=left & starts_with_kind(F.col("text")), starts=left & hard_start(F.col("text")), soft=left & (soft_start(F.col("text")) | hard_start(first_line)))
    pieces = pieces.withColumn("hard", ~F.col("kind") & F.col("starts"))
    before = W.partitionBy("doc").orderBy(*seq).rowsBetween(W.unboundedPreceding, -1)
    none_yet = ~F.coalesce(F.max((F.col("kind") | F.col("hard") | F.col("soft")).cast("int")).over(before) == 1, F.lit(False))
    pieces = pieces.withColumn("event", F.when(F.col("kind"), "T").when(F.col("hard") | (F.col("soft") & none_yet), "S"))
    pieces = pieces.withColumn("last", F.last("event", ignorenulls=True).over(before))
    new = F.coalesce((F.col("event") == "S") | ((F.col("event") == "T") & (F.coalesce("last", F.lit("T")) == "T")), F.lit(False))
    pieces = islands(pieces, ["doc"], seq, new, "card").filter("card > 0")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("col") == c, F.struct(*seq, "text")))), lambda x: x["text"])
    head = F.min_by(F.struct("page", "estado", "departamento"), F.struct(*seq))
    return pieces.groupBy("doc", "card").agg(head.alias("h"), ordered("L").alias("left"), ordered("R").alias("right")).select("doc", "card", "h.*", "left", "right")


def cards_from_lines(lines: DataFrame) -> DataFrame:
    """Cards of running text: doc, card, estado, departamento, body.

    lines: doc, pos, text.  Status, department and starting lines close what is
    open; a number or start opens only behind other lines, which is the same as
    opening an island that begins there.
    """
    x = lines.withColumn("text", F.trim(text("text"))).filter("text != ''").filter(~F.col("text").rlike(r"^\d{1,3}$"))
    t = F.col("text")
    x = computed(x, status=F.when(F.length(t) < 80, block_status(t)), title=is_running_title(t))
    x = computed(x.filter(F.col("status").isNotNull() | ~F.col("title")), dept=F.when(F.col("status").isNull() & (F.length(t) < 48), department(t)))
    x = carry(carry(x, ["doc"], ["pos"], F.col("status"), "estado", "Activo"), ["doc"], ["pos"], F.col("dept"), "departamento", "")
    closing = F.col("status").isNotNull() | F.col("dept").isNotNull()
    new = closing | t.rlike(r"^\d{1,3}\.$") | hard_start(t, numbered=True)
    x = islands(x.withColumn("closing", closing), ["doc"], ["pos"], new, "card").filter("not closing")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n")
    cards = x.groupBy("doc", "card").agg(F.min_by("estado", "pos").alias("estado"), F.min_by("departamento", "pos").alias("departamento"), body.alias("body"))
    return computed(cards, away=is_running_title(F.col("body")) | fold("body").startswith("anexo")).filter((F.length("body") >= 40) & ~F.col("away")).drop("away")


def latent_rows(texts: DataFrame) -> DataFrame:
    """Rows of compact tables: doc, n, departamento, caso, tipo.

    texts: doc, text.  The table runs from its title to the next section; rows
    begin with a number and a full stop at the start of a line.
    """
    t = text("text")
    start = F.regexp_instr(t, F.lit(ICASE + "detalle de los conflictos latentes"))
    t = F.when(start > 0, F.substring(t, start, F.length(t))).otherwise(t)
    closing = ICASE + _any((*L.CLOSING_HEADINGS, r"(?m)^\s*(?:viii|ix|x)\."))
    at = F.regexp_instr(F.substring(t, F.lit(81), F.length(t)), F.lit(closing))
    t = F.when(at > 0, F.substring(t, F.lit(1), 79 + at)).otherwise(t)
    rows = texts.select("doc", F.posexplode(F.split(t, r"(?m)(?=^\s*\d{1,3}\.\s)")).alias("n", "row")).filter(F.col("row").rlike(r"^\s*\d{1,3}\.\s"))
    rows = rows.withColumn("row", squeeze(F.regexp_replace("row", r"^\s*\d{1,3}\.\s*", ""))).filter((F.length("row") >= 8) & ~F.col("row").rlike(r"^[-–—.\s]+$"))
    months = "|".join(sorted((m for m in L.MONTHS if len(m) > 3), key=len, reverse=True))
    short = "|".join(m for m in L.MONTHS if len(m) == 3)
    dated = ICASE + rf"^(?:(?:{short})[a-z]*[-\s/]*\d{{2,4}}\b|\d{{1,2}}[/-]\d{{2,4}}\b|(?:{months})\s+\d{{4}}\b)[ \-–—]*"
    rows = computed(rows, d=leading_department(F.regexp_replace("row", dated, "")))
    rows = computed(rows, k=split_type(F.col("d.rest")))
    out = rows.select("doc", "n", F.col("d.department").alias("departamento"), F.left(F.col("k.caso"), F.lit(L.CASE_LIMIT)).alias("caso"), F.col("k.tipo").alias("tipo"), F.left(norm_ws("row"), F.lit(L.RAW_LIMIT)).alias("texto_crudo"))
    return out.filter(~fold("caso").rlike(f"^{_any(L.TABLE_STARTS)}") & ~((F.length("caso") < 3) & (F.col("tipo") == "")))


def split_type(c: Column) -> Column:
    """struct(caso, tipo) of a row: behind 'Tipo' a known type (the longest) or a short phrase, else a known type at the end."""
    known = "|".join(sorted(L.LATENT_TYPES, key=len, reverse=True))
    short = lambda x: F.left(x, F.lit(160))
    pair = lambda a, b: F.struct(a.alias("caso"), b.alias("tipo"))

    def labelled(x: Column) -> Column:
        before, tail, name, phrase = x["before"], x["tail"], x["name"], x["phrase"]
        rest = F.regexp_replace(F.substring(tail, F.length(name) + 1, F.length(tail)), r"^[\s.:–—-]+", "")
        after = F.regexp_replace(F.substring(tail, F.length(phrase) + 1, F.length(tail)), r"^\.\s+", "")
        return F.when(name != "", pair(clean(F.concat_ws(" ", before, rest)), short(name))).when(phrase != "", pair(clean(F.concat_ws(" ", before, after)), short(clean(phrase)))).otherwise(pair(before, short(clean(tail))))

    def tailed(x: Column) -> Column:
        tail = x["tail"]
        name = F.regexp_extract(tail, ICASE + rf"^({known})(?=\s|$|[.:–—-])", 1)
        phrase = F.regexp_extract(tail, r"^(.{1,59}?)(?:(?<=\w)(?=[A-ZÁÉÍÓÚ])|\.\s+)", 1)
        return bound(F.struct(x["before"].alias("before"), tail.alias("tail"), name.alias("name"), phrase.alias("phrase")), labelled)

    def split(t: Column) -> Column:
        before = clean(F.regexp_extract(t, ICASE + r"^(.*?)\btipo\s+.+$", 1))
        tail = F.trim(F.regexp_extract(t, ICASE + r"\btipo\s+(.+)$", 1))
        at_end = F.regexp_extract(t, ICASE + rf"({known})\s*$", 1)
        ending = pair(clean(F.regexp_replace(t, ICASE + rf"(?:{known})\s*$", "")), short(clean(at_end)))
        return F.when(t.rlike(ICASE + r"\btipo\s+\S"), bound(F.struct(before.alias("before"), tail.alias("tail")), tailed)).when(at_end != "", ending).otherwise(pair(clean(t), F.lit("")))

    return bound(F.trim(text(c)), split)


def new_latent(extra: DataFrame, cards: DataFrame) -> DataFrame:
    """Latent rows whose case (first 80 folded characters) no latent card of the document has, each once; empty cases all stay."""
    key = fold(F.left(text("caso"), F.lit(80)))
    there = cards.filter("estado = 'Latente'").select(F.col("doc").alias("__doc"), key.alias("__key")).filter("__key != ''").distinct()
    e = extra.withColumn("__k", key)
    fresh = e.join(there, (F.col("doc") == F.col("__doc")) & (F.col("__k") == F.col("__key")), "left_anti")
    rank = F.row_number().over(W.partitionBy("doc", "__k").orderBy("n"))
    return fresh.withColumn("__r", rank).filter("__r = 1 or __k = ''").drop("__r", "__k")
