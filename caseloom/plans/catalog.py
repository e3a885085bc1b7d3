"""Queries of the case-panel operators over the driver's tables, with their SQL.

Each query applies one operator of the package to a whole table.  The tables are
star-schema stand-ins: documents for card texts, orders for panel rows,
conversations for the blocks of a page, customers for cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from caseloom.functions import lexicon as L, reports, text as T
from caseloom.operators import fields, identity, joins, rollups, segmentation as S
from caseloom.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FOLD = "lower(strip_accents(coalesce({0}, '')))"
WORDS = ("the", "der", "que", "license", "token", "stupid")
NAMES = (("Alpha", "First", ("that", "with")), ("Beta", "Second", ("der", "und")), ("Gamma", "First", ("est", "les")), ("Delta", "Third", ("los", "para")))
PLACES = {"apache license": "Apache", "license": "Other", "creative commons": "Commons", "token": "Secret"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to four tasks a core: a file is read by a task a row group at most, too few where a row's work is dear."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as panel rows: a customer is a case, an order an appearance in a month."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("caso_id"), F.col("o_orderkey").alias("pos"), F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("mes"), F.col("o_orderpriority").alias("tipo"), F.col("o_orderstatus").alias("estado"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("es_socioambiental"), (F.col("o_totalprice") > 400000).cast("int").alias("menciona_mineria"))


# --- scalar functions -------------------------------------------------------------------------------------------


@query("fold_normalize", rf"SELECT doc_id, sha256({FOLD.format('text')}) AS folded, length(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '[ \t\r]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS n_norm FROM documents")
def fold_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fold("text"), 256).alias("folded"), F.length(T.norm_ws("text")).cast("long").alias("n_norm"))


KEY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(" + FOLD.format("text") + r", '[^a-z0-9\s]', ' ', 'g'), '\b(?:" + "|".join(L.STOPWORDS) + r")\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("standard_key", f"SELECT doc_id, sha256({KEY_SQL}) AS case_key FROM documents")
def standard_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.case_key("text"), 256).alias("case_key"))


@query("keyword_flags", rf"SELECT doc_id, CAST(regexp_matches({FOLD.format('text')}, '\b(?:{'|'.join(WORDS)})\b') AS INTEGER) AS mentions FROM documents")
def keyword_flags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.any_word(T.fold("text"), WORDS).cast("int").alias("mentions"))


def _topic_sql() -> str:
    blob = f"regexp_replace(lower(strip_accents(coalesce(lang, '') || ' ' || coalesce(text, ''))), '{L.MINISTRY}', ' ', 'g')"
    return f"SELECT doc_id, CAST(lower(lang) LIKE '%socioambiental%' AS INTEGER) AS es_socioambiental, CAST(regexp_matches({blob}, '\\b(?:{'|'.join((*L.MINING_TERMS, *L.METALS))})\\b') AS INTEGER) AS menciona_mineria FROM documents"


@query("topic_flags", _topic_sql())
def topic_flags(spark, sf_dir):
    social, mining = T.topic_flags("lang", "text")
    return read(spark, sf_dir, "documents").select("doc_id", social.alias("es_socioambiental"), mining.alias("menciona_mineria"))


def _alias_sql() -> str:
    t = FOLD.format("text")
    hit = lambda a: f"regexp_matches({t}, '\\b(?:{'|'.join(a)})\\b')"
    names = ", ".join(f"CASE WHEN {hit(a)} THEN '{n}' END" for n, _, a in NAMES)
    owners = []
    for owner in dict.fromkeys(o for _, o, _ in NAMES):
        every = " OR ".join(hit(a) for _, o, a in NAMES if o == owner)
        owners.append(f"CASE WHEN {every} THEN '{owner}' END")
    return f"SELECT doc_id, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS names, array_to_string(list_sort(list_filter([{', '.join(owners)}], lambda x: x IS NOT NULL)), ',') AS owners FROM documents"


@query("alias_match", _alias_sql())
def alias_match(spark, sf_dir):
    found = T.bound(T.fold("text"), lambda t: F.struct(*[c.alias(n) for c, n in zip(T.named(t, NAMES), ("names", "owners"), strict=True)]))
    docs = read(spark, sf_dir, "documents").select("doc_id", found.alias("f"))
    return docs.select("doc_id", F.array_join("f.names", ",").alias("names"), F.array_join(F.array_sort("f.owners"), ",").alias("owners"))


@query("dept_first_contained", f"SELECT doc_id, CASE WHEN regexp_matches({FOLD.format('text')}, '\\bcreative commons\\b') THEN 'Commons' WHEN regexp_matches({FOLD.format('text')}, '\\bapache license\\b') THEN 'Apache' WHEN regexp_matches({FOLD.format('text')}, '\\blicense\\b') THEN 'Other' WHEN regexp_matches({FOLD.format('text')}, '\\btoken\\b') THEN 'Secret' ELSE '' END AS place FROM documents")
def dept_first_contained(spark, sf_dir):
    place = T.bound(T.fold("text"), lambda t: F.coalesce(T.contained_name(t, PLACES), F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", place.alias("place"))


@query("type_standardise", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%socioambiental%' THEN 'SOCIOAMBIENTAL' WHEN lower(p_type) LIKE '%otro%' THEN 'OTROS' ELSE left(upper(p_type), 40) END AS tipo FROM part")
def type_standardise(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.standard_type("p_type").alias("tipo"))


@query("month_end", "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, abs((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 6) AS apart, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def month_end(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return o.select("o_orderkey", T.month_end(y, m).alias("month_end"), T.months_apart(y, m, F.lit(1998), F.lit(6)).cast("long").alias("apart"), T.period(y, m).alias("period"))


@query("content_hash", "SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", reports.content_key("lang", "source", "text").alias("hash"))


@query("truncate_boundary", "WITH d AS (SELECT doc_id, text AS t, left(text, 200) AS h FROM documents), p AS (SELECT *, CASE WHEN instr(h, '. ') > 0 THEN length(h) - instr(reverse(h), ' .') END AS a, CASE WHEN instr(h, '; ') > 0 THEN length(h) - instr(reverse(h), ' ;') END AS b, CASE WHEN instr(h, ', ') > 0 THEN length(h) - instr(reverse(h), ' ,') END AS c, CASE WHEN instr(h, ' ') > 0 THEN length(h) - instr(reverse(h), ' ') END AS d FROM d) SELECT doc_id, sha256(CASE WHEN length(t) <= 200 THEN t WHEN a - 1 >= 120 THEN trim(left(h, a)) WHEN b - 1 >= 120 THEN trim(left(h, b)) WHEN c - 1 >= 120 THEN trim(left(h, c)) WHEN d > 0 THEN trim(left(h, d)) ELSE trim(h) END) AS cut FROM p")
def truncate_boundary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.cut_at_sentence("text", 200), 256).alias("cut"))


@query("extractive_summary")
def extractive_summary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.extract_summary("text").alias("summary"))


@query("control_strip", r"SELECT doc_id, sha256(left(regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) || chr(7) ELSE '' END, '[\x00-\x08\x0B-\x1F]', '', 'g'), 32767)) AS cell FROM documents")
def control_strip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_controls(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\r\n\a").otherwise(""))), 256).alias("cell"))


@query("prompt_build", "SELECT doc_id, sha256(concat_ws(chr(10), 'Departamento: (sin dato)', 'Tipo en la ficha: ' || CASE WHEN coalesce(lang, '') = '' THEN '(sin dato)' ELSE lang END, 'Ubicación: ' || CASE WHEN coalesce(source, '') = '' THEN '(sin dato)' ELSE source END, 'Actores: (sin dato)', 'Meses cubiertos: ' || n_chars, '', 'Texto de la ficha (columna de descripción y hechos del mes):', trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS prompt FROM documents")
def prompt_build(spark, sf_dir):
    p = reports.prompt(F.lit(""), "lang", "source", F.lit(None), "n_chars", "text")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(p, 256).alias("prompt"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("record_normalize", "SELECT event_id, CASE WHEN event_type IN ('laboral', 'otros') THEN event_type ELSE 'otros' END AS tipo_normalizado, 'alta' AS confianza, value > 100 AS texto_ilegible FROM events")
def record_normalize(spark, sf_dir):
    answer = F.to_json(F.struct(F.col("event_type").alias("resumen"), F.col("event_type").alias("tipo_normalizado"), F.lit(" Alta ").alias("confianza"), (F.col("value") > 100).alias("texto_ilegible")))
    return T.computed(read(spark, sf_dir, "events"), r=reports.record(answer)).select("event_id", "r.tipo_normalizado", "r.confianza", "r.texto_ilegible")


@query("text_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)thth[aeiou]')")
def text_search(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(F.col("text").rlike("(?iu)thth[aeiou]")).select("doc_id")


@query("url_names", r"SELECT page_id, coalesce(nullif(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), ''), 'reporte') || '.pdf' AS file_name FROM pages")
def url_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", reports.file_name("url", F.lit("")).alias("file_name"))


# --- segmentation -------------------------------------------------------------------------------------------------


@query("islands_cards", "SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS card FROM conversations")
def islands_cards(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.islands(c, ["conv_id"], ["turn"], F.col("role") == "user", "card")


@query("card_rollup", "WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS card FROM conversations), k AS (SELECT conv_id, card, count(*) AS n_blocks, sum(length(text)) AS n_chars FROM c WHERE card > 0 GROUP BY 1, 2) SELECT conv_id, count(*) AS n_cards, CAST(sum(n_blocks) AS BIGINT) AS n_blocks, CAST(max(n_chars) AS BIGINT) AS longest_card FROM k GROUP BY 1")
def card_rollup(spark, sf_dir):
    c = S.islands(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "card").filter("card > 0")
    cards = c.groupBy("conv_id", "card").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    return cards.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_cards"), F.sum("n_blocks").alias("n_blocks"), F.max("n_chars").alias("longest_card"))


@query("status_carry", "SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS status FROM events")
def status_carry(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return S.carry(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")), "status", "none").select("event_id", "status")


@query("latched_range", "WITH e AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS a FROM events), f AS (SELECT *, min(CASE WHEN event_type = 'error' AND event_id >= a THEN event_id END) OVER (PARTITION BY user_id) AS b FROM e) SELECT event_id, user_id FROM f WHERE event_id >= a AND (b IS NULL OR event_id < b)")
def latched_range(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return S.latched_range(e, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_type") == "error").select("event_id", "user_id")


@query("flow_lines", r"WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(line) < 48) AS n_short, max(length(line)) AS longest FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\d{1,3}$') GROUP BY doc_id")
def flow_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike(r"^\d{1,3}$"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.length("line") < 48).alias("n_short"), F.max(F.length("line")).cast("long").alias("longest"))


@query("field_extract", r"""SELECT doc_id, regexp_extract(text, 'token\s*=\s*"([0-9a-f]+)"', 1) AS token, regexp_extract(text, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', 1) AS ip, regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1) AS mail FROM documents""")
def field_extract(spark, sf_dir):
    get = lambda p: F.regexp_extract("text", p, 1)
    return read(spark, sf_dir, "documents").select("doc_id", get(r'token\s*=\s*"([0-9a-f]+)"').alias("token"), get(r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)").alias("ip"), get(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)").alias("mail"))


@query("card_fields")
def card_fields(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    body = F.concat(F.lit("Tipo: "), "role", F.lit(" Caso: "), "text")
    return c.select("conv_id", "turn", fields.parse_card(body, F.lit("")).alias("f")).select("conv_id", "turn", "f.*")


@query("page_signs")
def page_signs(spark, sf_dir):
    return T.computed(read(spark, sf_dir, "documents").select("doc_id", "text"), signs=S.page_signs(F.col("text"))).select("doc_id", "signs.*")


@query("html_cards", r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages), u AS (SELECT page_id, unnest(range(len(hs))) AS pos, unnest(hs) AS href FROM a) SELECT page_id, href, min(pos) AS pos FROM u WHERE href <> '' GROUP BY 1, 2""")
def html_cards(spark, sf_dir):
    return readers.html_links(read(spark, sf_dir, "pages")).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@query("html_text", r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) > 0 AS has_title FROM pages""")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", (F.length(T.strip_html(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))) > 0).alias("has_title"))


# --- joins and sets -----------------------------------------------------------------------------------------------


@query("enrich_left", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_left(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return joins.enrich(docs, read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("cache_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_anti(spark, sf_dir):
    return joins.pending(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("crosswalk_full_outer", "WITH a AS (SELECT doc_id % 700 AS numero, arg_min(source, doc_id) AS left_name FROM documents GROUP BY 1), b AS (SELECT doc_id % 900 AS numero, arg_min(CAST(quality AS VARCHAR), doc_id) AS right_name FROM labels GROUP BY 1) SELECT numero, left_name IS NOT NULL AS in_left, right_name IS NOT NULL AS in_right, CASE WHEN left_name IS NOT NULL AND right_name IS NOT NULL THEN 'match' WHEN left_name IS NOT NULL THEN 'solo_drive' ELSE 'solo_nuevo' END AS state, left_name, right_name FROM a FULL JOIN b USING (numero)")
def crosswalk_full_outer(spark, sf_dir):
    a = read(spark, sf_dir, "documents").select((F.col("doc_id") % 700).alias("numero"), F.col("source").alias("name"), F.col("doc_id").alias("pos"))
    b = read(spark, sf_dir, "labels").select((F.col("doc_id") % 900).alias("numero"), F.col("quality").cast("string").alias("name"), F.col("doc_id").alias("pos"))
    return joins.crosswalk(a, b, "numero", "name", "pos")


@query("calendar_gaps", "WITH g AS (SELECT CAST(d AS DATE) AS d FROM range(DATE '1994-06-01', DATE '2002-01-01', INTERVAL 1 MONTH) t(d)), r AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, bool_or(o_orderstatus = 'O' AND month(o_orderdate) % 2 = 0) AS old, bool_or(o_orderstatus <> 'O' AND year(o_orderdate) % 2 = 0) AS new FROM orders GROUP BY 1, 2) SELECT year(d) AS anio, month(d) AS mes, coalesce(old, false) AS old, coalesce(new, false) AS new, CASE WHEN old AND new THEN 'ambos' WHEN old THEN 'solo_drive' WHEN new THEN 'solo_nuevo' ELSE 'falta' END AS estado FROM g LEFT JOIN r ON y = year(d) AND m = month(d)")
def calendar_gaps(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("origen", F.when((F.col("estado") == "O") & (F.col("mes") % 2 == 0), "old").when((F.col("estado") != "O") & (F.col("anio") % 2 == 0), "new").otherwise("other")).withColumn("numero", F.col("mes"))
    return joins.calendar_coverage(rollups.month_grid(spark, "1994-06-01", "2001-12-01"), o).drop("numeros")


@query("missing_numbers", "SELECT CAST(i AS INTEGER) AS doc_id FROM (SELECT unnest(range(least(0, min(doc_id)), greatest(1500, max(doc_id)) + 1)) AS i FROM labels) WHERE i NOT IN (SELECT doc_id FROM labels)")
def missing_numbers(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    low, high = labels.agg(F.least(F.lit(0), F.min("doc_id")), F.greatest(F.lit(1500), F.max("doc_id"))).first()  # 0..1500 at least, as in the SQL
    return rollups.missing_numbers(labels, "doc_id", low, high)


@query("inventory_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r, lang FROM documents) WHERE r = 1 OR lang = 'es'")
def inventory_dedup(spark, sf_dir):
    return rollups.keep_best(read(spark, sf_dir, "documents"), ["source", "lang"], F.desc("n_chars"), F.col("doc_id"), blank=F.col("lang") == "es").select("doc_id")


@query("source_priority", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) AS k, CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END AS pr FROM pages), a AS (SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr, page_id) AS r FROM p WHERE k <> '') WHERE r = 1), b AS (SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM p WHERE k = '' AND url NOT IN (SELECT url FROM a)) WHERE r = 1) SELECT page_id FROM a UNION ALL SELECT page_id FROM b""")
def source_priority(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"/([0-9]+)(?:[?#]|$)", 1).alias("k"))
    return joins.by_priority(p, "k", "url", F.when(F.col("url").startswith("https"), 0).otherwise(1), "page_id").select("page_id")


@query("uncovered_files", """
WITH RECURSIVE b AS (SELECT DISTINCT CAST(quality + 2 * toxic AS VARCHAR) AS numero FROM labels),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, source || '-' || (doc_id % 20) AS clave, CAST(n_chars % 400 AS VARCHAR) AS numero FROM documents),
step AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS kept
  UNION ALL SELECT i, CASE WHEN free THEN list_concat(taken, mine) ELSE taken END, CASE WHEN free THEN doc_id END
  FROM (SELECT d.i, d.doc_id, taken, ['c' || clave, 'n' || numero] AS mine, numero NOT IN (SELECT numero FROM b) AND NOT list_has_any(taken, ['c' || clave, 'n' || numero]) AS free FROM step JOIN d ON d.i = step.i + 1))
SELECT kept AS doc_id FROM step WHERE kept IS NOT NULL
""")
def uncovered_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", (F.col("doc_id") % 20).cast("string")).alias("clave"), (F.col("n_chars") % 400).cast("string").alias("numero"))
    base = read(spark, sf_dir, "labels").select((F.col("quality") + 2 * F.col("toxic")).cast("string").alias("numero"), F.lit("").alias("clave"))
    return joins.uncovered(d, base, ["clave", "numero"], "doc_id").select("doc_id")


@query("set_ops", "WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b USING (k)")
def set_ops(spark, sf_dir):
    a = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.set_status(a, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("village_hits", "WITH n AS (SELECT 'Brand#' || i AS b, unnest(['thereof', 'erblest', 'thation', 'quement']) AS v FROM range(1) t(i)) SELECT doc_id, array_to_string(list_filter(['erblest', 'quement', 'thation', 'thereof'], lambda x: contains(lower(text), x)), ',') AS villages FROM documents")
def village_hits(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"), F.lit(1).alias("mina"))
    names = spark.createDataFrame([(1, v) for v in ("thereof", "erblest", "thation", "quement", "the")], "mina int, v string")
    return joins.village_hits(docs, "t", names, "mina", "v").select("doc_id", F.array_join("villages", ",").alias("villages"))


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("unique_case_rollup", "SELECT o_custkey AS caso_id, arg_min(o_orderpriority, o_orderkey) AS tipo, arg_min(o_orderstatus, o_orderkey) AS estado, count(*) AS n_apariciones, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_meses, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS es_socioambiental, max(CAST(o_totalprice > 400000 AS INTEGER)) AS menciona_mineria FROM orders GROUP BY 1")
def unique_case_rollup(spark, sf_dir):
    return rollups.unique_cases(orders(spark, sf_dir), firsts=("tipo", "estado"))


@query("mode_first_seen", "WITH c AS (SELECT o_custkey AS caso_id, o_orderpriority AS tipo, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT caso_id, tipo FROM (SELECT *, row_number() OVER (PARTITION BY caso_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1")
def mode_first_seen(spark, sf_dir):
    return rollups.first_seen_mode(orders(spark, sf_dir), "caso_id", "tipo", "pos")


@query("key_dedup_longest", "SELECT lang, source, text_len, doc_id FROM (SELECT lang, source, length(text) AS text_len, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def key_dedup_longest(spark, sf_dir):
    reps = identity.representatives(read(spark, sf_dir, "documents"), ["lang", "source"], "text", "doc_id")
    return reps.select("lang", "source", F.length("text").cast("long").alias("text_len"), "doc_id")


@query("longest_text", "SELECT lang, sha256(text) AS longest FROM (SELECT lang, trim(text) AS text, row_number() OVER (PARTITION BY lang ORDER BY length(trim(text)) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def longest_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.sha2(rollups.longest_by("text", "doc_id"), 256).alias("longest"))


@query("sample_first_mid_last", "WITH c AS (SELECT conv_id, list(role || turn ORDER BY turn) AS v FROM conversations GROUP BY 1), p AS (SELECT conv_id, v[1] AS a, v[len(v) // 2 + 1] AS b, v[len(v)] AS c FROM c) SELECT conv_id, CASE WHEN a = b AND b = c THEN a WHEN a = b THEN a || chr(10) || '---' || chr(10) || c WHEN b = c OR a = c THEN a || chr(10) || '---' || chr(10) || b ELSE a || chr(10) || '---' || chr(10) || b || chr(10) || '---' || chr(10) || c END AS sample FROM p")
def sample_first_mid_last(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("v", F.concat("role", F.col("turn").cast("string")))
    return c.groupBy("conv_id").agg(rollups.first_middle_last("v", "turn").alias("sample"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return rollups.value_counts(read(spark, sf_dir, "events"), "event_type")


@query("monthly_series", "SELECT strftime(o_orderdate, '%Y-%m') AS periodo, count(*) AS n FROM orders GROUP BY 1")
def monthly_series(spark, sf_dir):
    return rollups.value_counts(orders(spark, sf_dir).select(T.period("anio", "mes").alias("periodo")), "periodo")


@query("format_summary_upper_median", "SELECT p_brand, count(*) AS n_pdf, min(p_size) AS n_min, max(p_size) AS n_max, list_sort(list(p_size))[count(*) // 2 + 1] AS pag_mediana FROM part GROUP BY 1")
def format_summary_upper_median(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_pdf"), F.min("p_size").alias("n_min"), F.max("p_size").alias("n_max"), rollups.upper_median("p_size").alias("pag_mediana"))


@query("layout_summary")
def layout_summary(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("formato"), F.col("p_size").alias("numero"), (F.col("p_size") + 2000).alias("anio"), F.col("p_size").alias("paginas"), F.col("p_name").alias("archivo"))
    return sinks.layout_summary(p)


@query("precision_by_group", "WITH j AS (SELECT lang, unnest(['quality', 'toxic']) AS campo, unnest([quality, toxic]) AS v FROM documents JOIN labels USING (doc_id)) SELECT lang, campo, count(v) AS n, count(*) FILTER (v = 1) AS ok, round(100.0 * count(*) FILTER (v = 1) / count(v), 6) AS precision FROM j GROUP BY 1, 2")
def precision_by_group(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return rollups.precision(rows, ["quality", "toxic"], ["lang"])


@query("cluster_profile", "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS n_ids, count(*) FILTER (n = 1) AS n_single, round(100.0 * count(*) FILTER (n = 1) / count(*), 6) AS pct_single, list_sort(list(n))[count(*) // 2 + 1] AS median, max(n) AS largest FROM s")
def cluster_profile(spark, sf_dir):
    return rollups.cluster_profile(orders(spark, sf_dir), "caso_id")


@query("merge_report", "SELECT label, count(DISTINCT vec_id % 7) AS n_old, count(*) AS n_filas FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 7) > 1 ORDER BY n_old DESC, label LIMIT 10")
def merge_report(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).alias("old"), F.col("vec_id").cast("string").alias("t"))
    return rollups.merge_report(e, "label", "old", "t").drop("examples")


@query("stratified_quota", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS a FROM c) SELECT source, n, least(greatest(5, CAST(round_even(120.0 * n / a, 0) AS BIGINT)), n) AS quota FROM c, t")
def stratified_quota(spark, sf_dir):
    return rollups.quotas(read(spark, sf_dir, "documents"), "source", 120, 5)


@query("stratified_sample", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS a FROM c) SELECT source, least(greatest(5, CAST(round_even(120.0 * n / a, 0) AS BIGINT)), n) AS n FROM c, t")
def stratified_sample(spark, sf_dir):
    return rollups.value_counts(rollups.stratified_sample(read(spark, sf_dir, "documents"), "source", "doc_id", 120, 5), "source")


@query("topk_longest", "SELECT o_custkey AS caso_id, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, caso_id LIMIT 10")
def topk_longest(spark, sf_dir):
    return rollups.value_counts(orders(spark, sf_dir), "caso_id").orderBy(F.desc("n"), "caso_id").limit(10)


@query("trajectory", "SELECT o_custkey AS caso_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS paso FROM orders")
def trajectory(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("caso_id"), F.col("o_orderkey").alias("pos"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("paso"))


@query("run_totals", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (value < 10) AS n_low FROM events")
def run_totals(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("value") < 10).alias("n_low"))


@query("match_statistics", "SELECT round(100 * (avg(quality) * 0.25 + avg(toxic) * 0.2) / 0.45, 6) AS agreement FROM labels")
def match_statistics(spark, sf_dir):
    return read(spark, sf_dir, "labels").agg(F.round(rollups.match_statistics(None, {"quality": 0.25, "toxic": 0.2}), 6).alias("agreement"))


# --- identity -----------------------------------------------------------------------------------------------------


@query("exact_merge_cc", "WITH RECURSIVE d AS (SELECT doc_id, n_chars AS a, source || lang AS b FROM documents), k AS (SELECT doc_id, 'a' || a AS k FROM d UNION ALL SELECT doc_id, 'b' || b || (doc_id % 40) FROM d), e AS (SELECT DISTINCT x.doc_id AS s, y.doc_id AS t FROM k x JOIN k y USING (k)), r AS (SELECT doc_id AS node, doc_id AS label FROM d UNION SELECT e.t, r.label FROM r JOIN e ON r.node = e.s AND r.label < e.t) SELECT node AS doc_id, min(label) AS component FROM r GROUP BY 1")
def exact_merge_cc(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = d.select("doc_id", F.concat(F.lit("a"), F.col("n_chars").cast("string")).alias("k")).unionByName(d.select("doc_id", F.concat(F.lit("b"), "source", "lang", (F.col("doc_id") % 40).cast("string")).alias("k")))
    return identity.merge_by_key(k, "doc_id", "k").select(F.col("id").alias("doc_id"), "component")


@query("dense_ids", "SELECT o_custkey AS root, dense_rank() OVER (ORDER BY o_custkey) AS caso_id FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_ids(spark, sf_dir):
    roots = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root")).distinct()
    return identity.dense_ids(roots, "root").select("root", "caso_id")


from caseloom.plans import identity_catalog, panel_catalog  # noqa: E402,F401  add the queries of identity and of the panel plan
