"""Aggregates of the case panel.  Ties go to the row that comes first, so each takes an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.text import text


def first_by(value: str | Column, order: str | Column) -> Column:
    return F.min_by(value, order)


def longest_by(value: str, order: str) -> Column:
    """The longest text, the first of equally long ones; blanks and 'nan' do not count."""
    t = F.trim(text(value))
    real = (t != "") & (F.lower(t) != "nan")
    return F.coalesce(F.max_by(F.when(real, t), F.when(real, F.struct(F.length(t), -F.col(order)))), F.lit(""))


def unique_cases(panel: DataFrame, key: str = "caso_id", order: str = "pos", firsts: tuple[str, ...] = ("caso", "departamento", "tipo"), flags: tuple[str, ...] = ("es_socioambiental", "menciona_mineria"), year: str = "anio", month: str = "mes") -> DataFrame:
    """One row a case: first values, appearances, distinct months (rows without year and month aside), flags by or."""
    dated = F.when(F.col(year).isNotNull() | F.col(month).isNotNull(), F.struct(year, month))
    return panel.groupBy(key).agg(*[first_by(c, order).alias(c) for c in firsts], F.count(F.lit(1)).alias("n_apariciones"), F.count_distinct(dated).alias("n_meses"), *[F.max(c).alias(c) for c in flags])


def first_seen_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the most frequent value, of equally frequent ones the first seen.  Two aggregates, no window."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias(value))


def first_middle_last(value: str, order: str) -> Column:
    """First, middle and last value in order, distinct, joined by a rule."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.trim(text(value)) != "", F.struct(order, value)))), lambda x: x[value])
    picks = F.array(F.get(ordered, F.lit(0)), F.get(ordered, (F.size(ordered) / 2).cast("int")), F.get(ordered, F.size(ordered) - 1))
    return F.array_join(F.array_distinct(F.filter(picks, lambda x: x.isNotNull())), "\n---\n")


def upper_median(value: str) -> Column:
    """The element at n div 2 of the sorted whole numbers: the discrete median from above, kept as counts of values, not as a list."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").cast("int")


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def precision(rows: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """For each annotated field (and group): answers that are numbers, right ones, percentage (null without answers)."""
    by = by or []
    marks = [F.col(f).try_cast("double").alias(f) if rows.schema[f].dataType.typeName() == "string" else F.col(f).cast("double").alias(f) for f in fields]
    long = rows.select(*by, *marks).unpivot(by, fields, "campo", "valor")
    out = long.groupBy(*by, "campo").agg(F.count("valor").alias("n"), F.count_if(F.col("valor") == 1).alias("ok"))
    return out.withColumn("precision", F.when(F.col("n") > 0, F.round(100 * F.col("ok") / F.col("n"), 6)))


def cluster_profile(rows: DataFrame, key: str) -> DataFrame:
    """One row: ids, single ones and their share, upper median and greatest number of rows.

    The median comes from the histogram of sizes: n rows have less than
    sqrt(2 n) different sizes.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_filas")).groupBy("n_filas").agg(F.count(F.lit(1)).alias("ids"))
    single = F.coalesce(F.sum(F.when(F.col("n_filas") == 1, F.col("ids"))), F.lit(0))
    whole = sizes.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("n_ids"), single.alias("n_single"), F.max("n_filas").alias("largest"), F.array_sort(F.collect_list(F.struct("n_filas", "ids"))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("median"))
    walk = lambda a, x: F.struct((a["seen"] + x["ids"]).alias("seen"), F.coalesce(a["median"], F.when(a["seen"] + x["ids"] > F.floor(F.col("n_ids") / 2), x["n_filas"])).alias("median"))
    return whole.select("n_ids", "n_single", F.round(100 * F.col("n_single") / F.col("n_ids"), 6).alias("pct_single"), F.aggregate("h", start, walk)["median"].alias("median"), "largest")


def merge_report(rows: DataFrame, new: str, old: str, sample: str, top: int = 10) -> DataFrame:
    """New ids that join several old ones, the largest first, with up to four different texts of 110 characters."""
    texts = F.slice(F.array_sort(F.collect_set(F.left(F.col(sample), F.lit(110)))), 1, 4)
    out = rows.groupBy(new).agg(F.count_distinct(old).alias("n_old"), F.count(F.lit(1)).alias("n_filas"), texts.alias("examples"))
    return out.filter("n_old > 1").orderBy(F.desc("n_old"), new).limit(top)


def match_statistics(pairs: DataFrame, fields: dict[str, float]) -> Column:
    """Weighted agreement over the fields, in per cent."""
    total = sum(fields.values())
    parts = [F.avg(F.col(f).cast("double")) * w for f, w in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return 100 * out / total


def missing_numbers(rows: DataFrame, number: str, low: int, high: int) -> DataFrame:
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(number))
    return grid.join(rows.select(F.col(number).cast("int").alias(number)).distinct(), number, "left_anti")


def month_grid(spark, first: str, last: str) -> DataFrame:
    """(anio, mes) of every month between two dates."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("d"))
    return months.select(F.year("d").alias("anio"), F.month("d").alias("mes"))


def keep_best(rows: DataFrame, by: list[str], *order: Column, blank: Column | None = None) -> DataFrame:
    """The first row of each group in an order; rows where ``blank`` holds are never merged."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    keep = F.col("__r") == 1
    return ranked.filter(keep | blank if blank is not None else keep).drop("__r")


def quotas(rows: DataFrame, stratum: str, total: int, floor: int) -> DataFrame:
    """(stratum, n, quota): max(floor, half-even share of the total), at most n."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("__all"))
    share = F.bround(F.lit(float(total)) * F.col("n") / whole.scalar(), 0).cast("long")
    return counts.withColumn("quota", F.least(F.greatest(F.lit(floor), share), F.col("n")))


def stratified_sample(rows: DataFrame, stratum: str, key: str, total: int, floor: int, seed: int = 0) -> DataFrame:
    """As many rows of each stratum as its quota, in the order of a seeded hash of the key."""
    shuffled = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key))
    q = quotas(rows, stratum, total, floor).select(F.col(stratum).alias("__s"), "quota")
    return rows.withColumn("__r", shuffled).join(q, F.col(stratum).eqNullSafe(F.col("__s"))).filter("__r <= quota").drop("__r", "__s", "quota")
