"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.llm import bpe, decontaminate, html_text, jaccard, line_dedup, neighbours, preference, quality, suffix_dedup, toxicity
from padlake.llm.labelled import fold


#: Rows and bytes that a Python worker holds at a time; texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, tokenizer_path())
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("token_ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, machine).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 nearest of each vector whose id is divisible by 50."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: three words a shingle, alike from 90 of 100."""
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it has a passage of; clean documents have none."""
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality.score(docs, forest).select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation: chosen as it is, rejected with the last answer of its neighbour in place of its own."""
    sides = preference.answer_pairs(table(spark, sf_dir, "conversations"))
    return preference.format_pairs(sides).withColumns({m: preference.mask_text(m) for m in ("chosen_mask", "rejected_mask")})


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, n_lines, n_removed_lines of every document."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_toxicity": op3_toxicity,
    "op4_neighbours": op4_neighbours,
    "op5_jaccard": op5_jaccard,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_preference": op9_preference,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE: dict[str, str] = {"op4_neighbours": neighbours.oracle(), "op5_jaccard": jaccard.oracle(), "op7_suffix_dedup": suffix_dedup.oracle(), "op9_preference": preference.oracle(), "op10_line_dedup": line_dedup.oracle()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
