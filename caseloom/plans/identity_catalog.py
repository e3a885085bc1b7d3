"""Queries of identity: similar pairs, clusters, leaders, linked cases and matches, with SQL that does the same step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions import text as T
from caseloom.functions.reports import content_key
from caseloom.operators import calls, graph, identity, matching, mined, phrases, similarity
from caseloom.plans.catalog import FOLD, KEY_SQL, NAMES, query, read

SWEEP = (0.15, 0.2, 0.25, 0.3)
COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def linkage_sql(name: str, points: str, threshold: float) -> str:
    """CTEs: greedy average linkage of ``points`` (block, node, embedding), merge by merge, while it is below the threshold's distance."""
    return f"""{name}_far AS MATERIALIZED (SELECT a.node AS x, b.node AS y, 1 - {COSINE} AS d FROM {points} a JOIN {points} b ON a.block = b.block AND a.node <> b.node),
{name} AS (
  SELECT 0 AS step, block, node, node AS cluster, CAST(0 AS DOUBLE) AS height FROM {points}
  UNION ALL
  SELECT w.step + 1, w.block, w.node, CASE WHEN w.cluster = m.hi THEN m.lo ELSE w.cluster END, m.h
  FROM {name} w JOIN (SELECT block, min({{'h': h, 'lo': lo, 'hi': hi}}) AS m FROM (SELECT p.block, p.cluster AS lo, q.cluster AS hi, avg(d) AS h FROM {name} p JOIN {name} q ON p.block = q.block AND p.cluster < q.cluster JOIN {name}_far ON x = p.node AND y = q.node GROUP BY ALL) GROUP BY block) b ON b.block = w.block
  WHERE m.h < 1 - {threshold}
)"""


POINTS = "points AS (SELECT CAST(label AS VARCHAR) AS block, vec_id AS node, embedding FROM embeddings)"


def embeddings(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


@query("cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE} >= 0.3")
def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(embeddings(spark, sf_dir), "label", "vec_id", "embedding", 0.3).select("a", "b")


@query("cosine_pairs_all", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE}, 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.3")
def cosine_pairs_all(spark, sf_dir):
    """Over all rows."""
    return similarity.cosine_pairs(embeddings(spark, sf_dir), None, "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 9))


@query("components_of_pairs", f"WITH RECURSIVE e AS (SELECT a.vec_id AS s, b.vec_id AS t FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {COSINE} >= 0.3), r AS (SELECT DISTINCT s AS node, s AS label FROM e UNION SELECT e.t, r.label FROM r JOIN e ON r.node = e.s AND r.label < e.t) SELECT node, min(label) AS component FROM r GROUP BY 1")
def components_of_pairs(spark, sf_dir):
    return graph.connected_components(similarity.cosine_pairs(embeddings(spark, sf_dir), "label", "vec_id", "embedding", 0.3), "a", "b")


@query("embedding_clusters", f"WITH RECURSIVE {POINTS}, {linkage_sql('walk', 'points', 0.2)} SELECT CAST(block AS INTEGER) AS block, node AS key, cluster FROM walk QUALIFY step = max(step) OVER (PARTITION BY block)")
def embedding_clusters(spark, sf_dir):
    return identity.vector_clusters(embeddings(spark, sf_dir), "label", "vec_id", "embedding", 0.2)


@query("threshold_sweep", f"WITH s AS (SELECT unnest([0.3, 0.4, 0.5]) AS umbral), p AS (SELECT umbral, a.vec_id AS a, b.vec_id AS b FROM s, embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE} >= umbral) SELECT CAST(umbral AS DOUBLE) AS umbral, count(*) AS n_pairs FROM p GROUP BY 1")
def threshold_sweep(spark, sf_dir):
    pairs = similarity.cosine_pairs(embeddings(spark, sf_dir), "label", "vec_id", "embedding", 0.3)
    steps = F.explode(F.array(*[F.lit(x) for x in (0.3, 0.4, 0.5)]))
    return pairs.withColumn("umbral", steps).filter("similarity >= umbral").groupBy("umbral").agg(F.count(F.lit(1)).alias("n_pairs"))


CUTS = f"""cuts AS (SELECT CAST(t AS DOUBLE) AS threshold, block, node, cluster FROM walk, (SELECT unnest({list(SWEEP)}) AS t) WHERE step = 0 OR height < 1 - t QUALIFY step = max(step) OVER (PARTITION BY t, block)),
sizes AS (SELECT threshold, cluster, count(*) AS n, count(DISTINCT node % 7) AS olds FROM cuts GROUP BY ALL)"""


@query("identity_sweep", f"WITH RECURSIVE {POINTS}, {linkage_sql('walk', 'points', min(SWEEP))}, {CUTS} SELECT threshold, count(*) AS n_ids, count(*) FILTER (n = 1) AS n_single, max(n) AS largest, count(*) FILTER (olds > 1) AS n_merges FROM sizes GROUP BY 1")
def identity_sweep(spark, sf_dir):
    """One merge tree a component, cut at each threshold; the ids before are told by the number modulo 7."""
    cuts = identity.cluster_sweep(embeddings(spark, sf_dir), "label", "vec_id", "embedding", list(SWEEP))
    return identity.sweep_report(cuts.withColumn("old", F.col("key") % 7), "old")


LINKED = f"""WITH RECURSIVE {POINTS}, {linkage_sql('walk', 'points', 0.3)},
local AS (SELECT node, cluster FROM walk QUALIFY step = max(step) OVER (PARTITION BY block)),
heads AS MATERIALIZED (SELECT '' AS block, cluster AS node, embedding FROM local JOIN embeddings ON vec_id = local.node QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY length(CAST(vec_id AS VARCHAR)) DESC, vec_id) = 1),
{linkage_sql('bridge', 'heads', 0.3)},
bridged AS (SELECT node, cluster FROM bridge QUALIFY step = max(step) OVER ())
SELECT local.node AS pos, dense_rank() OVER (ORDER BY bridged.cluster) AS caso_id FROM local JOIN bridged ON bridged.node = local.cluster"""


@query("link_cases", LINKED)
def link_cases(spark, sf_dir):
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("pos"), F.col("label").cast("string").alias("departamento"), F.col("vec_id").cast("string").alias("clave"), F.col("vec_id").cast("string").alias("texto_crudo"), "embedding")
    return identity.link(e, 0.3).select("pos", "caso_id")


def ratio_sql(a: str, b: str) -> str:
    """The ratio of two texts of up to 100 letters with their words in order: bits of one number are the letters of the first."""
    full = f"((1::HUGEINT << length({a})::HUGEINT) - 1)"
    mask = f"list_sum([CASE WHEN substr({a}, i, 1) = c THEN 1::HUGEINT << (i - 1)::HUGEINT ELSE 0::HUGEINT END FOR i IN range(1, length({a}) + 1)])::HUGEINT"
    state = f"list_reduce(list_prepend({full}, [{mask} FOR c IN string_split({b}, '')]), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    return f"(200.0::DOUBLE * (length({a}) - bit_count({state})) / (length({a}) + length({b})))"


NAMED = f"named AS (SELECT p_partkey, p_brand, array_to_string(list_sort(string_split({KEY_SQL.replace('text', chr(40) + 'p_name || chr(32) || p_type' + chr(41))}, ' ')), ' ') AS k FROM part)"
NODES = f"{NAMED}, nodes AS MATERIALIZED (SELECT p_brand, k, min(p_partkey) AS node, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS i FROM named GROUP BY 1, 2)"
NEAR = f"near AS MATERIALIZED (SELECT * FROM (SELECT a.node AS a, b.node AS b, {ratio_sql('a.k', 'b.k')} AS ratio FROM nodes a JOIN nodes b ON a.p_brand = b.p_brand AND a.node < b.node) WHERE ratio >= {{0}})"


def part_keys(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", T.case_key(F.concat_ws(" ", "p_name", "p_type")).alias("clave"))


@query("fuzzy_pairs", f"WITH {NODES}, {NEAR.format(80)} SELECT a, b, round(ratio, 6) AS ratio FROM near")
def fuzzy_pairs(spark, sf_dir):
    keys = part_keys(spark, sf_dir).groupBy("p_brand", similarity.sorted_words("clave").alias("clave")).agg(F.min("p_partkey").alias("node"))
    return similarity.fuzzy_pairs(keys, "p_brand", "node", "clave", 80.0).withColumn("ratio", F.round("ratio", 6))


LEADERS = f"""WITH RECURSIVE {NODES}, {NEAR.format(80)},
smaller AS (SELECT b AS node, list(a) AS those FROM near GROUP BY b),
walk AS (
  SELECT p_brand, i, node, node AS leader, [node] AS leads FROM nodes WHERE i = 1
  UNION ALL
  SELECT p_brand, i, node, coalesce(hit, node), CASE WHEN hit IS NULL THEN list_append(leads, node) ELSE leads END
  FROM (SELECT n.p_brand, n.i, n.node, w.leads, list_min(list_intersect(coalesce(s.those, []), w.leads)) AS hit FROM walk w JOIN nodes n ON n.p_brand = w.p_brand AND n.i = w.i + 1 LEFT JOIN smaller s ON s.node = n.node)
)
SELECT p_partkey, walk.leader AS leader FROM named JOIN nodes USING (p_brand, k) JOIN walk ON walk.node = nodes.node"""


@query("fuzzy_leader", LEADERS)
def fuzzy_leader(spark, sf_dir):
    return matching.fuzzy_leaders(part_keys(spark, sf_dir), "p_brand", "clave", "p_partkey", 80.0).select("p_partkey", "leader")


def greedy_sql(pairs: str) -> str:
    """CTEs: ``taken`` walks the left rows of ``pairs`` (l, r, score, rank, stop) in order; each takes its best free one."""
    return f"""choices AS (SELECT l, row_number() OVER (ORDER BY l) AS i, list({{'r': r, 's': score, 'stop': stop}} ORDER BY rank, r) AS c FROM {pairs} GROUP BY l),
taken AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS used
  UNION ALL
  SELECT i, l, best.r, best.s, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.r) END
  FROM (SELECT i, l, used, list_reduce(seen, lambda x, y: CASE WHEN y.s > x.s THEN y ELSE x END) AS best
        FROM (SELECT i, l, used, CASE WHEN cut IS NULL THEN free ELSE free[1:cut] END AS seen
              FROM (SELECT i, l, used, free, list_position([x.stop FOR x IN free], true) AS cut
                    FROM (SELECT ch.i, ch.l, t.used, [x FOR x IN ch.c IF NOT list_contains(t.used, x.r)] AS free FROM taken t JOIN choices ch ON ch.i = t.i + 1)))
       )
)"""


WORDS_SQL = f"SELECT DISTINCT {{0}} AS {{1}}, unnest(string_split_regex({FOLD.format('text')}, '\\W+')) AS w FROM {{2}}"


@query("greedy_match", f"""WITH RECURSIVE lw AS (SELECT * FROM ({WORDS_SQL.format('item_id', 'l', 'benchmark')}) WHERE length(w) > 6), rw AS (SELECT * FROM ({WORDS_SQL.format('doc_id', 'r', 'documents')}) WHERE length(w) > 6),
pairs AS MATERIALIZED (SELECT l, r, 100.0::DOUBLE * count(*) / any_value(n) AS score, r AS rank, false AS stop FROM lw JOIN rw USING (w) JOIN (SELECT l, count(*) AS n FROM lw GROUP BY l) USING (l) GROUP BY l, r HAVING 100.0::DOUBLE * count(*) / any_value(n) >= 70),
{greedy_sql('pairs')} SELECT l, r, round(score, 6) AS score FROM taken WHERE r IS NOT NULL""")
def greedy_match(spark, sf_dir):
    left = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("l"), F.explode(F.array_distinct(F.split(T.fold("text"), r"\W+"))).alias("w")).filter("length(w) > 6")
    right = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("r"), F.explode(F.array_distinct(F.split(T.fold("text"), r"\W+"))).alias("w")).filter("length(w) > 6")
    size = left.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    scored = left.join(right, "w").groupBy("l", "r").agg(F.count(F.lit(1)).alias("k")).join(size, "l").select("l", "r", (100.0 * F.col("k") / F.col("n")).alias("score"))
    return matching.greedy_matches(scored).withColumn("score", F.round("score", 6))


def curated(spark, sf_dir) -> DataFrame:
    """Parts as curated rows."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), T.case_key(F.concat_ws(" ", "p_name", "p_type")).alias("clave"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("dept"), F.col("p_type").alias("tipo"), F.array(F.concat_ws(" ", "p_type", "p_brand")).alias("minas"), F.array("p_brand").alias("companias"), _month(F.col("p_size")).alias("fecha"))


def local(spark, sf_dir) -> DataFrame:
    """The same parts as a run gives them: some with their size in the text, and other months."""
    p = read(spark, sf_dir, "part")
    more = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("n"), F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), T.case_key(F.concat_ws(" ", more, "p_type", "p_name")).alias("clave"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("dept"), F.when(F.col("p_size") % 5 > 0, F.lower("p_type")).alias("tipo"), F.array(F.concat_ws(" ", "p_type", "p_brand")).alias("minas"), F.array("p_brand").alias("companias"), _month(F.col("p_size") + F.col("p_partkey") % 12).alias("fecha"))


def _month(n: Column) -> Column:
    return F.format_string("%04d-%02d-28", (2000 + F.floor(n / 12)).cast("int"), (n % 12 + 1).cast("int"))


def _month_sql(n: str) -> str:
    return f"printf('%04d-%02d-28', (2000 + ({n}) // 12)::INTEGER, (({n}) % 12 + 1)::INTEGER)"


def _sorted_sql(c: str) -> str:
    return f"array_to_string(list_sort(string_split(lower({c}), ' ')), ' ')"


SIDES = f"""a AS (SELECT p_partkey AS l, {_sorted_sql("p_name || ' ' || p_type")} AS k, p_brand || '/' || p_size AS dept, p_type || ' ' || p_brand AS mina, p_type AS tipo, p_brand AS compania, {_month_sql('p_size')} AS fecha FROM part),
b AS (SELECT p_partkey AS r, {_sorted_sql("CASE WHEN p_size % 3 > 0 THEN 'n' || p_size || ' ' ELSE '' END || p_type || ' ' || p_name")} AS k, p_brand || '/' || p_size AS dept, p_type || ' ' || p_brand AS mina, CASE WHEN p_size % 5 > 0 THEN lower(p_type) END AS tipo, p_brand AS compania, {_month_sql('p_size + p_partkey % 12')} AS fecha FROM part),
told AS (SELECT l, r, a.dept = b.dept AS same, a.mina = b.mina AS common, {ratio_sql('a.k', 'b.k')} AS t FROM a JOIN b ON a.dept = b.dept OR a.mina = b.mina),
pairs AS MATERIALIZED (SELECT * FROM (SELECT l, r, 0.62::DOUBLE * t + (0.20::DOUBLE * CASE WHEN same THEN 100 ELSE 0 END + 0.18::DOUBLE * CASE WHEN common THEN 100 ELSE 40 END) AS score, CASE WHEN same THEN 0 ELSE 1 END AS rank, same AND t >= 96 AS stop FROM told) WHERE score >= 70),
{greedy_sql('pairs')}"""


def _matches(spark, sf_dir) -> DataFrame:
    return matching.matches(curated(spark, sf_dir), local(spark, sf_dir))


@query("scored_match", f"WITH RECURSIVE {SIDES} SELECT l, r, round(score, 6) AS score FROM taken WHERE r IS NOT NULL")
def scored_match(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("match_report", f"""WITH RECURSIVE {SIDES},
m AS (SELECT score, a.dept = b.dept AS d, coalesce(upper(a.tipo) = upper(b.tipo), false) AS t, a.mina = b.mina AS m, a.compania = b.compania AS c,
      abs((substr(a.fecha, 1, 4)::INTEGER * 12 + substr(a.fecha, 6, 2)::INTEGER) - (substr(b.fecha, 1, 4)::INTEGER * 12 + substr(b.fecha, 6, 2)::INTEGER)) <= 6 AS f FROM taken JOIN a USING (l) JOIN b USING (r)),
s AS (SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, count(*) AS n_matched, 100 * avg(d::INTEGER) AS dept_ok, 100 * avg(t::INTEGER) AS tipo_ok, 100 * avg(m::INTEGER) AS mina_ok, 100 * avg(c::INTEGER) AS compania_ok, 100 * avg(f::INTEGER) AS fecha_ok, avg(score) AS score_mean FROM m),
g AS (SELECT *, 100.0 * n_matched / n_left AS recall, 100.0 * n_matched / n_right AS precision, 0.25 * dept_ok + 0.20 * tipo_ok + 0.30 * mina_ok + 0.15 * compania_ok + 0.10 * fecha_ok AS agreement FROM s)
SELECT n_left, n_right, n_matched, {", ".join(f"round({c}, 6) AS {c}" for c in ("dept_ok", "tipo_ok", "mina_ok", "compania_ok", "fecha_ok", "score_mean", "recall", "precision", "agreement"))}, round(0.55 * recall + 0.45 * agreement, 6) AS overall FROM g""")
def match_report(spark, sf_dir):
    left, right = curated(spark, sf_dir), local(spark, sf_dir)
    out = matching.match_report(matching.compared_matches(_matches(spark, sf_dir), left, right), left, right)
    return out.select("n_left", "n_right", "n_matched", *[F.round(c, 6).alias(c) for c in ("dept_ok", "tipo_ok", "mina_ok", "compania_ok", "fecha_ok", "score_mean", "recall", "precision", "agreement", "overall")])


def _hit_sql(aliases) -> str:
    return f"regexp_matches({FOLD.format('text')}, '\\b(?:{'|'.join(aliases)})\\b')"


def _list_sql(c: str) -> str:
    return f"CASE WHEN len({c}) > 0 THEN '[' || chr(39) || array_to_string({c}, chr(39) || ', ' || chr(39)) || chr(39) || ']' ELSE '' END"


_MARKS = [f"m{i}" for i in range(len(NAMES))]
MINED = f"""WITH r AS (SELECT *, lang || '/' || coalesce(source, '') AS caso_id, {", ".join(f"{_hit_sql(entry[2])} AS m{i}" for i, entry in enumerate(NAMES))}, upper(left({FOLD.format("source")}, 40)) AS tipo, trim(coalesce(lang, '')) AS dept, trim(coalesce(text, '')) AS t,
  strftime(last_day(make_date((2000 + doc_id % 20)::INTEGER, (doc_id % 12 + 1)::INTEGER, 1)), '%Y-%m-%d') AS fin FROM documents),
k AS (SELECT * FROM r WHERE {" OR ".join(_MARKS)}),
tipos AS (SELECT caso_id, tipo, count(*) AS n, min(doc_id) AS f FROM k WHERE tipo <> '' GROUP BY ALL),
modes AS (SELECT caso_id, arg_max(tipo, n * 1000000000 - f) AS tipo FROM tipos GROUP BY 1),
c AS (SELECT caso_id, {", ".join(f"bool_or({m}) AS {m}" for m in _MARKS)}, count(*) AS n_filas_panel, count(DISTINCT (doc_id % 20) * 12 + doc_id % 12) AS n_meses, min(fin) AS primera_fecha, max(fin) AS ultima_fecha,
      arg_max(t, length(t) * 1000000000 - doc_id) FILTER (t <> '' AND lower(t) <> 'nan') AS caso, max(dept) AS dept, min(doc_id)::DOUBLE AS nmin, max(doc_id)::DOUBLE AS nmax,
      bool_or(regexp_matches({FOLD.format("text")}, '\\b(?:mineria ilegal|minero ilegal|mineros ilegales|extraccion ilegal|ilegal)\\b')) AS ilegal FROM k GROUP BY caso_id),
g AS (SELECT *, list_filter([{", ".join(f"CASE WHEN m{i} THEN '{entry[0]}' END" for i, entry in enumerate(NAMES))}], lambda x: x IS NOT NULL) AS minas,
      list_filter([{", ".join(f"CASE WHEN m{i} THEN '{entry[1]}' END" for i, entry in enumerate(NAMES))}], lambda x: x IS NOT NULL) AS duenos FROM c LEFT JOIN modes USING (caso_id))
SELECT caso_id, {_list_sql("minas")} AS minas, {_list_sql("list_filter(duenos, lambda x, i: list_position(duenos, x) = i)")} AS companias, coalesce(tipo, '') AS tipo, upper(dept) AS departamento, sha256(coalesce(caso, '')) AS caso, n_meses, n_filas_panel, primera_fecha, ultima_fecha, nmin AS numero_reporte_min, nmax AS numero_reporte_max,
       CASE WHEN ilegal THEN 'Sí' ELSE 'No' END AS es_ilegal, CAST(coalesce(caso, '') <> '' AND tipo IS NOT NULL AS INTEGER) AS completo FROM g"""


@query("mined_cases", MINED)
def mined_cases(spark, sf_dir):
    """Documents as panel rows: a language's source is a case, the source its type, the number gives the month."""
    d = read(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.col("lang"), F.lit("/"), F.coalesce("source", F.lit(""))).alias("caso_id"), F.col("doc_id").alias("pos"), F.col("text").alias("caso"), F.col("source").alias("tipo"), F.col("lang").alias("departamento"), (2000 + F.col("doc_id") % 20).cast("int").alias("anio"), (F.col("doc_id") % 12 + 1).cast("int").alias("mes"), F.col("doc_id").alias("numero_reporte"))
    out = mined.mined_cases(rows, NAMES, None)
    return out.select("caso_id", "minas", "companias", "tipo", "departamento", F.sha2("caso", 256).alias("caso"), "n_meses", "n_filas_panel", "primera_fecha", "ultima_fecha", "numero_reporte_min", "numero_reporte_max", "es_ilegal", "completo")


TOKENS = "string_split_regex({0}, '[^a-z0-9_]+')"


@query("phrase_hits", f"""WITH names AS (SELECT DISTINCT unnest({TOKENS.format(FOLD.format('text'))}) AS name FROM benchmark),
words AS (SELECT DISTINCT doc_id, unnest({TOKENS.format(FOLD.format('text'))}) AS name FROM documents) SELECT doc_id, name FROM words JOIN names USING (name) WHERE length(name) > 6""")
def phrase_hits(spark, sf_dir):
    """The longer words of the benchmark in all documents."""
    names = read(spark, sf_dir, "benchmark").select(F.explode(F.split(T.fold("text"), "[^a-z0-9_]+")).alias("name")).filter("length(name) > 6").distinct()
    return phrases.phrase_hits(read(spark, sf_dir, "documents"), "doc_id", "text", names).select("doc_id", "name")


@query("cached_answers", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'ya: ' || p_name WHEN p_size = 13 THEN NULL ELSE reverse(p_name || ' ' || p_size) END AS answer, CASE WHEN p_type <> 'ECONOMY' AND p_size = 13 THEN 'unlucky' END AS error, p_type = 'ECONOMY' AS cached FROM part")
def cached_answers(spark, sf_dir):
    """A stand-in for a service turns texts round and refuses one size; a cache answers one type."""

    def call(request: str) -> str:
        if request.endswith(" 13"):
            raise calls.GiveUp("unlucky")
        return request[::-1]

    rows = read(spark, sf_dir, "part").withColumn("request", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    known = rows.filter("p_type = 'ECONOMY'").select(content_key("p_type", "request").alias("hash"), F.concat(F.lit("ya: "), "p_name").alias("answer"))
    out, _ = calls.enriched(rows, "request", known, call, ["p_type", "request"])
    return out.select("p_partkey", "answer", "error", "cached")
