"""The page operators on a stream: new files as they come, each page text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, folder: str, schema: str = "doc string, page long, text string, at timestamp", files_per_trigger: int = 5) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_equal(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops pages whose text came before for the same document within the watermark."""
    return pages.withWatermark("at", late).withColumn("content_hash", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["doc", "content_hash"])
