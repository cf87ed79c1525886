"""Packing into optimal length buckets and token-budget batches.

A global histogram of lengths (tokens are words here unless a length column is given) is gathered; it has at most
``budget`` rows, for longer documents need no bucket.  Dynamic programming over it chooses the bucket boundaries that
minimise the padded tokens: with bucket ``(i, j]`` costing ``b_j * count(i, j] - tokens(i, j]``, which is a Monge cost,
so each layer is solved by divide and conquer in ``O(L log L)``.  Inside a bucket with boundary ``b`` every batch takes
``budget // b`` documents.

Numbering the documents of a bucket does not gather it in one task: each bucket is dealt into cells in proportion to its
share (``cells`` and one per bucket in all; as many as bring a cell to ``ROWS_OF_CELL`` rows, within fixed bounds), rows are numbered inside their cell, and the cell's start, a
running sum over the bounded cell table, is added.

Cases: null and empty texts have length 0 and go to the first bucket without padding cost beyond its boundary; a
document longer than the budget is a batch of its own in the bucket numbered -1 and has no padding; an empty table
gives an empty result; rows with the same ``doc_id`` get places of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, rows_frame, written


LEAST_CELLS, MOST_CELLS, ROWS_OF_CELL = 4096, 1 << 17, 1 << 18


def boundaries(lengths, counts, buckets: int) -> list[int]:
    """The ascending boundaries (each a length that occurs, the last the greatest) of at most ``buckets`` buckets with least padding."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(lengths)
    if not n:
        return []
    buckets = min(buckets, n)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    tokens = np.concatenate([[0], np.cumsum(lengths * np.asarray(counts, dtype=np.int64))])

    def costs(i, j):
        """Of a bucket with the histogram rows i to j - 1."""
        return lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    best = np.concatenate([[0], costs(0, np.arange(1, n + 1))])
    choice = [np.zeros(n + 1, dtype=np.int64)]
    for k in range(2, buckets + 1):
        now, cut = best.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            c = best[i] + costs(i, j)
            at = int(np.argmin(c))
            now[j], cut[j] = c[at], i[at]
            todo += [(low, j - 1, left, int(i[at])), (j + 1, high, int(i[at]), right)]
        best, choice = now, [*choice, cut]
    out, j = [], n
    for cut in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if not j:
            break
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, cells: int | None = None, length=None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, boundary, batch, slot, padding``.

    ``batch`` counts from 0 in each bucket and ``slot`` from 0 in each batch.  ``length``: a column with the tokens of
    a document; the words of ``text`` by default.
    """
    spark = docs.sparkSession
    # Rows without an id are dealt by their place; it is kept with them, so later reads agree.
    deal = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    base = docs.select("doc_id", F.coalesce(n_words(F.col("text")) if length is None else length, F.lit(0)).cast("long").alias("n_tokens"), deal.alias("_deal"))
    base = written(base, "pack-base")
    histogram = base.groupBy(F.least("n_tokens", F.lit(budget + 1)).alias("n")).count().orderBy("n").collect()
    short = [r for r in histogram if r.n <= budget]
    ends = boundaries([r.n for r in short], [r["count"] for r in short], buckets)
    held = [sum(r["count"] for r in short if (i == 0 or r.n > ends[i - 1]) and r.n <= b) for i, b in enumerate(ends)]
    held.append(sum(r["count"] for r in histogram if r.n > budget))
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, sum(held) // ROWS_OF_CELL))
    dealt = [max(1, round(cells * h / max(1, sum(held)))) for h in held]
    table = F.array(*[F.lit(b) for b in ends]) if ends else F.array().cast("array<int>")
    bucket = F.size(F.filter(table, lambda b: b < F.col("n_tokens")))
    in_cell = base.withColumn("bucket", F.when(F.col("n_tokens") > budget, -1).otherwise(bucket)).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "n_tokens", "_deal"), F.element_at(F.array(*[F.lit(d) for d in dealt]), F.when(F.col("bucket") < 0, F.lit(-1)).otherwise(F.col("bucket") + 1)))
    )
    starts = rows_frame(
        spark,
        [tuple(r) for r in in_cell.groupBy("bucket", "cell").count().withColumn("start", F.sum("count").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "cell", F.coalesce("start", F.lit(0))).collect()],
        "bucket int, cell long, start long",
    )
    nth = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "n_tokens")) - 1
    per_batch = F.when(F.col("bucket") < 0, 1).otherwise(F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))))
    boundary = F.when(F.col("bucket") < 0, F.col("n_tokens")).otherwise(F.element_at(table, F.col("bucket") + 1) if ends else F.lit(0)).cast("long")
    return (
        in_cell.withColumn("nth", nth)
        .join(F.broadcast(starts), ["bucket", "cell"])
        .select("doc_id", "n_tokens", "bucket", boundary.alias("boundary"), (F.col("start") + F.col("nth")).alias("nth"))
        .withColumn("per_batch", per_batch.cast("long"))
        .select(
            "doc_id", "n_tokens", "bucket", "boundary",
            F.floor(F.col("nth") / F.col("per_batch")).cast("long").alias("batch"),
            (F.col("nth") % F.col("per_batch")).alias("slot"),
            (F.col("boundary") - F.col("n_tokens")).alias("padding"),
        )
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
