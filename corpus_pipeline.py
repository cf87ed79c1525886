"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import decontam, jaccard, packing, secrets, toxicity
from foliolake.llm.common import if_small, new_folder, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like texts without features; rows without an id are scored like others; without
    labels of both kinds nothing is rejected; an empty table stays empty.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by near-duplicate links the one with the smallest id stays; of rows with one id, one row.

    Rows without an id link with nothing and stay, as do rows without words.  The row kept of one id is the first by its
    text's digest and its columns as JSON, so it does not depend on the order of rows.
    """
    linked = F.coalesce(F.max(F.col("doc_id") != F.col("component_id")), F.lit(False))
    by_id = jaccard.similar(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(linked.alias("linked"), F.count("*").alias("n"))
    gone = written(by_id.filter("linked OR n > 1"), "groups")
    kept = docs.join(if_small(gone.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    repeated = gone.filter("NOT linked").select("doc_id")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(row, F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.to_json(row)))
    return kept.unionByName(docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("_row")).select("_row.*").select(docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none, and rows that share an id go together."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark, and ``n_chars`` is that of the new text; all rows stay, null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in token-budget batches of length buckets; null and empty texts have length 0."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the alignment; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
