"""Queries of the text operators, by the result contract, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .common import documents, new_path
from .decontaminate import benchmark_overlaps
from .embeddings import near_embeddings
from .lexical import rank_documents
from .mixing import score_texts
from .near_duplicates import near_duplicates
from .packing import pack_documents
from .pages import extract_pages
from .quality import quality_filter
from .rans import read_ids, write_ids
from .secrets import find_secrets, joined
from .sharding import shard_by_bytes
from .toxicity import score_toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> F.Column:
    """crc32(doc_id as text) mod divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        n("novel").alias("n_novel"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps found, a row each; documents without any have no row."""
    found = benchmark_overlaps(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_filter(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    # a null doc_id has no remainder: it is not held out, and never learned from
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(documents(spark, sf_dir), path, tokenizer_path())
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), remainder(7) != 2)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: The same ranks from all scores: terms by pattern, every document that shares a term with an item is scored.
_RANKS = r"""
WITH term AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
wanted AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)))
  GROUP BY i, item_id, term),
total AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM term),
size AS (SELECT r, doc_id, count(*) AS n FROM term GROUP BY r, doc_id),
held AS (SELECT r, term, count(*) AS tf FROM term WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
measured AS (SELECT r, doc_id, 25 + ((75 * n * n_docs) // n_terms) AS m FROM size, total),
scored AS (
  SELECT i, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weight USING (term) JOIN measured USING (r)
  GROUP BY i, item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_decontaminate, op3_near_duplicates, op4_quality, op5_pack, op6_shard, op7_toxicity, op8_pages, op9_ids, op10_mixing, op11_alignment, op12_search, op13_embeddings)}


def oracle_sql() -> dict[str, str]:
    return {"op12_search": _RANKS}
