"""Queries of the training-data operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm import decontamination, exact_dedup, jaccard_join, line_dedup, mixing, neighbours, pii, quality, spelling, substring_dedup, token_store, toxicity, vector_codes
from caseloom.llm.frames import shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("removed_lines", F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ","))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_store.write_store(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_digests(spark, folder)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), changed=spelling.slip)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_toxicity": op2_toxicity, "op3_line_dedup": op3_line_dedup, "op4_mixing": op4_mixing, "op5_ngram_jaccard": op5_ngram_jaccard, "op6_exact_dedup": op6_exact_dedup, "op7_decontamination": op7_decontamination, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_token_store": op10_token_store, "op11_vector_codes": op11_vector_codes, "op12_spelling_variants": op12_spelling_variants, "op13_nearest_neighbours": op13_nearest_neighbours}

OP1_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35),
runs AS (SELECT doc_id, p, list_slice(words, p, p + 34) AS run FROM win),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY run) AS n FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM twice WHERE n > 1),
marks AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, len(coalesce(gone, [])) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN marks USING (doc_id)
"""

ORACLES = {"op1_substring_dedup": OP1_SQL, "op3_line_dedup": line_dedup.SQL, "op6_exact_dedup": exact_dedup.SQL, "op11_vector_codes": vector_codes.SQL, "op12_spelling_variants": spelling.SQL}
