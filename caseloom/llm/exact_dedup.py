"""Exact deduplication by deterministic block naming, in DataFrame operations only.

The UTF-8 bytes of a text are cut into fixed-size blocks.  Distinct blocks are
sorted into integer names; then pairs of adjacent names are named in the same
way, again and again, until each document has one name.  Two documents have the
same (number of blocks, name) if and only if their bytes are equal: names are
ranks of the sorted contents, so no two contents share one.

A block travels once.  Sorting needs all copies of a content in one place, so
contents are first reduced to the distinct ones under their 64-bit hash, on the
map side too, and each hash with more than one content is split by the content
itself; only then is the hash a key by which rows find their name.  Names then
replace contents, and every later step moves a few bytes a block.

Defined cases: a null text is an empty one; an empty text has no block and the
name 0; null ids take part and lose against any id; of rows that repeat an id
with the same text one stays; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.llm.frames import checkpoint, join_evenly, only

BLOCK_BYTES = 4096
#: Names are bucket * 2**RANK_BITS + rank: sorting is local to one of BUCKETS ranges of the hash.
BUCKETS, RANK_BITS = 1 << 22, 40
#: A block, pair or text that more rows than this have gets its name from a broadcast: at most rows / HOT of them.
HOT = 1 << 17


def _names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of distinct keys (and how often they come): the rank in the order of (bucket of the hash, hash, keys)."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(*keys))
    return distinct.withColumn("bucket", bucket).select(*keys, (F.shiftleft("bucket", RANK_BITS) + rank).alias("name"), "times")


def name_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """One row a document: row, doc_id, text_sha256, n_blocks, name (the collision-free identity)."""
    raw = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    # F.transform with an outer array of one keeps the bytes bound: without it each block would copy the whole text
    blocks = F.element_at(F.transform(F.array("raw"), lambda r: _blocks_of(r, block_bytes)), 1)
    hashes = F.element_at(F.transform(F.array("raw"), lambda r: F.transform(_blocks_of(r, block_bytes), lambda b: F.xxhash64(b))), 1)
    contents = raw.select(F.explode(blocks).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    # Sorted reduction to distinct contents: least and greatest differ only where one hash has several contents.
    by_hash = checkpoint(contents.groupBy("h").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count(F.lit(1)).alias("times")).select("h", "times", F.when(F.col("low") != F.col("high"), True).otherwise(False).alias("clash")))
    if by_hash.filter("clash").isEmpty():
        rows = raw.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("raw", 256).alias("text_sha256"), hashes.alias("names"))
        named = _names(by_hash.select("h", "times"), ["h"])
    else:  # contents decide: (hash, content) pairs are named themselves
        torn = by_hash.filter("clash").select(F.col("h").alias("torn"))
        pairs = contents.join(torn, F.col("h") == F.col("torn"), "left").select("h", F.when(F.col("torn").isNotNull(), F.col("block")).alias("block")).distinct()
        ranked = checkpoint(pairs.select("h", "block", (F.row_number().over(W.partitionBy("h").orderBy("block"))).alias("k")))
        # The number of a row is given before its blocks become rows.
        spread = raw.select(F.monotonically_increasing_id().alias("row"), "doc_id", "raw").select("row", "doc_id", F.sha2("raw", 256).alias("text_sha256"), F.posexplode_outer(blocks).alias("pos", "block"))
        spread = spread.withColumn("h", F.when(F.col("block").isNotNull(), F.xxhash64("block")))
        mine = ranked.select(F.col("h").alias("rh"), F.col("block").alias("rb"), "k")
        met = spread.join(mine, (F.col("h") == F.col("rh")) & (F.col("rb").isNull() | (F.col("rb") == F.col("block"))), "left")
        names = _names(ranked.select("h", "k", F.lit(1).alias("times")), ["h", "k"]).drop("times")
        met = met.join(names, ["h", "k"], "left")
        rows = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "name")))), lambda x: x["name"]).alias("names"))
        named = None
    # Rows are named by their place in the scan, which reruns of a task repeat.
    state = rows if named is None else _renamed(rows, named, hot)
    return _halved(checkpoint(state.withColumn("n_blocks", F.size("names"))), hot)


def _blocks_of(raw: Column, size: int) -> Column:
    last = F.ceil(F.length(raw) / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.substring(raw, i * size + 1, F.lit(size)))
    return F.filter(cut, lambda b: F.length(b) > 0)


def _renamed(rows: DataFrame, named: DataFrame, hot: int) -> DataFrame:
    """Replace the hashes in ``names`` by the integer names of ``named`` (h, name)."""
    spread = rows.select("row", "doc_id", "text_sha256", F.posexplode_outer("names").alias("pos", "h"))
    met = join_evenly(spread.withColumn("salt", F.xxhash64("row", "pos")), named, ["h"], "name", "times", "salt", hot)
    return met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "name")))), lambda x: x["name"]).alias("names"))


def _halved(state: DataFrame, hot: int) -> DataFrame:
    """Name adjacent pairs until one name is left; documents leave the loop as soon as they have it."""
    done = state.filter("n_blocks <= 1").select("row", "doc_id", "text_sha256", "n_blocks", F.coalesce(F.try_element_at("names", F.lit(1)), F.lit(0)).alias("name"))
    parts, state = [done], state.filter("n_blocks > 1")
    longest = state.agg(F.max("n_blocks")).first()[0] or 1
    while longest > 1:
        half = F.transform(F.sequence(F.lit(0), ((F.size("names") + 1) / 2).cast("int") - 1), lambda i: F.struct(F.element_at("names", i * 2 + 1).alias("a"), F.coalesce(F.try_element_at("names", i * 2 + 2), F.lit(-1)).alias("b")))
        spread = state.select("row", "doc_id", "text_sha256", "n_blocks", F.posexplode(half).alias("pos", "ab")).select("row", "doc_id", "text_sha256", "n_blocks", "pos", "ab.a", "ab.b")
        names = checkpoint(_names(spread.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")), ["a", "b"]))
        met = join_evenly(spread.withColumn("salt", F.xxhash64("row", "pos")), names, ["a", "b"], "name", "times", "salt", hot)
        state = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_sha256", "n_blocks")], F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
        state = checkpoint(state)
        parts.append(state.filter(F.size("names") == 1).select("row", "doc_id", "text_sha256", "n_blocks", F.element_at("names", 1).alias("name")))
        state = state.filter(F.size("names") > 1)
        longest = (longest + 1) // 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the greatest id stays."""
    named = name_documents(docs, text_col, id_col, block_bytes, hot)
    identity = ["n_blocks", "name"]
    groups = named.groupBy(*identity).agg(F.struct(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best")).alias("of"), F.count(F.lit(1)).alias("times"))
    met = join_evenly(named, checkpoint(groups), identity, "of", "times", "row", hot)
    return met.select("doc_id", "of.keep_id", "of.group_size", (F.col("row") == F.col("of.best.row")).alias("kept"), "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
