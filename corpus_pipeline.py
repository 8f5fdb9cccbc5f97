"""A corpus, from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has kept, and returns a DataFrame
of the columns of ``documents``; the last returns tokens. Of any stage: other columns pass as they are, whatever their
names; an empty table gives an empty one; rows that are the same fare the same, but for ``near_copies``, which keeps one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.llm import bpe, decontaminate, jaccard, line_dedup, quality
from padlake.llm.graph import shared_folder
from padlake.llm.labelled import fold
from padlake.llm.registry import small_batches, table, tokenizer_path

#: Documents with a lower score of quality go.
LEAST_QUALITY = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, doesn't reject.

    A null text counts as an empty one. A row without an id, or of an id that several have, is judged by its own text;
    labels of an id stand for each of its rows. Without labels of both kinds their share decides for all.
    """
    forest = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality.score(docs, forest, out="quality_score").where(F.col("quality_score") >= LEAST_QUALITY).drop("quality_score")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that an earlier one has; n_chars is that of the text that stays.

    Null texts stay null, texts all of whose chunks go become empty. A null id is before all others; texts of one id
    are apart, the smaller row hash first, and rows that agree in both lose nothing to each other.
    """
    small_batches(spark)
    less = line_dedup.dedup(docs)
    return less.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles, 80 of 100 alike, the one of the smallest id; null ids are the largest.

    Rows that agree in id and text are one document, of which one row stays. Other texts of the same id are documents
    of their own, linked only if they are alike. Null and empty texts are like no other.
    """
    small_batches(spark)
    text = F.xxhash64("text")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text).alias("text_hash"))
    found = ids.agg(F.max("doc_id").alias("last"), F.max(F.expr("doc_id IS NULL OR n > 1")).alias("repeats")).first()
    if not found.repeats:
        groups = jaccard.join(docs, n=5, percent=80)
        return docs.join(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Texts without an id, or besides the first of their id, get numbers beyond all ids.
    repeated = ids.where("doc_id IS NOT NULL AND n > 1").select("doc_id", "text_hash", F.lit(0).cast("long").alias("part"))
    beyond = F.lit(max(found.last or 0, 0) + 1) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    own = F.col("doc_id").isNotNull() & (F.col("text_hash").isNull() | (text == F.col("text_hash")))
    # Null ids match nothing and are dealt by their texts.
    part = F.when(F.col("doc_id").isNull(), text).otherwise(0).alias("part")
    numbered = docs.select("*", part).join(repeated, ["doc_id", "part"], "left").withColumn("row_id", F.when(own, F.col("doc_id")).otherwise(beyond))
    groups = jaccard.join(numbered.select("row_id", "text"), key="row_id", n=5, percent=80)
    kept = numbered.join(groups.where(F.col("row_id") != F.col("component_id")).select("row_id"), "row_id", "left_anti")
    return kept.dropDuplicates(["row_id"]).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, ids play no part."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), out="leaks")
    return found.where(F.size("leaks") == 0).drop("leaks")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, how many, and whether they decode to it; a row for each row, null texts as empty ones."""
    small_batches(spark)
    done = bpe.round_trip(docs, tokenizer_path())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("token_ids")).alias("ids_sha256"), "token_ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]

#: Scores, edit distances and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; what one keeps is written as Parquet into the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        if k:
            path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
            before = path
        docs = stage(spark, docs, sf_dir)
    return docs
