"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

A group is all rows of one text.  It stays whole unless it exceeds a shard's fair share of bytes, tokens or rows, for
then no packing could balance the shards.  Groups that hold more than ``1 / (shards * grain)`` of any dimension are
placed one by one; there are at most three times ``shards * grain`` of them, twice that on tiny tables, whatever the input.  The light rest is
gathered by hash into ``shards * parcels`` parcels of whole groups, a stated bound on what the driver packs.

Each item, largest first, goes to the shard where the dot product of its normalised vector with the shard's residual
capacity is highest, among the shards whose residual capacity holds all its dimensions.

Rows are numbered in *cells*, of which a group or parcel has as many as bring each to about ``1 / (shards * grain)`` of
the rows, so no task numbers a hot group.  A torn group is packed by its cells, the others as a whole; the cell table that
is broadcast is bounded like the items.

Cases: null text counts as empty, and both have size 1 and are one group; an empty table gives an empty
result; further columns of the input are ignored, whatever their names; repeated rows are placed like other rows of
their group, and rows with equal or null ids get different slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_bytes, n_words, rows_frame, written

DIMENSIONS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, shards: int, weights=(4.0, 1.0, 1.0)) -> np.ndarray:
    """Shard of each item.  ``items``: one row of (bytes, tokens, rows) each."""
    where = np.zeros(len(items), dtype=np.int64)
    if not len(items):
        return where
    total = np.maximum(items.sum(axis=0), 1).astype(float)
    size = items / total * np.asarray(weights)
    residual = np.tile(np.asarray(weights) / shards, (shards, 1))
    for i in np.argsort(-size.max(axis=1), kind="stable"):
        fits = (residual >= size[i]).all(axis=1)
        # Where nothing fits, the shard with most bytes left keeps the overshoot smallest.
        best = int(np.argmax(np.where(fits, residual @ size[i], -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        where[i] = best
        residual[best] -= size[i]
    return where


def shard(docs: DataFrame, shards: int = 16, parcels: int = 256, grain: int = 256, weights=(4.0, 1.0, 1.0)) -> DataFrame:
    """One row per document: ``doc_id, size, tokens, text_crc32, parcel, shard, slot``; slots run from 0 without gaps."""
    spark = docs.sparkSession
    base = docs.select(
        "doc_id",
        (n_bytes(F.col("text")) + 1).alias("size"),
        n_words(F.col("text")).cast("long").alias("tokens"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("group"),
        # Deals the rows of a group, also where they share an id; kept with the rows, so later reads agree.
        F.xxhash64(F.monotonically_increasing_id()).alias("deal"),
    )
    base = written(base, "shard-base")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = base.agg(*sums).first()
    limit = {d: max(1, (total[d] or 0) // (shards * grain)) for d in DIMENSIONS}
    heavy = base.groupBy("group").agg(*sums).filter(" OR ".join(f"{d} > {limit[d]}" for d in DIMENSIONS))
    heavy = sorted(heavy.collect())  # at most 3 * shards * grain rows
    torn = {shards * parcels + i for i, r in enumerate(heavy) if any(r[d] * shards > total[d] for d in DIMENSIONS)}
    numbered = [(r.group, shards * parcels + i, -(-r.rows // limit["rows"])) for i, r in enumerate(heavy)]
    dealt = F.broadcast(rows_frame(spark, numbered, "group long, parcel long, cells long"))
    in_cell = base.join(dealt, "group", "left").select(
        "doc_id", "size", "tokens", "text_crc32",
        F.coalesce("parcel", F.pmod("group", F.lit(shards * parcels))).alias("parcel"),
        F.pmod("deal", F.coalesce("cells", F.lit(1))).alias("cell"),
    )
    cells = sorted(in_cell.groupBy("parcel", "cell").agg(*sums).collect())
    items: dict[tuple, np.ndarray] = {}
    item_of = lambda r: (r.parcel, r.cell if r.parcel in torn else 0)
    for r in cells:
        items[item_of(r)] = items.get(item_of(r), 0) + np.array([r[d] for d in DIMENSIONS], dtype=np.int64)
    where = dict(zip(items, pack(np.array(list(items.values()), dtype=np.int64).reshape(-1, 3), shards, weights).tolist()))
    start, offsets = [0] * shards, []
    for r in cells:
        s = where[item_of(r)]
        offsets.append((r.parcel, r.cell, s, start[s]))
        start[s] += r.rows
    offsets = F.broadcast(rows_frame(spark, offsets, "parcel long, cell long, shard int, start long"))
    inside = Window.partitionBy("parcel", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        in_cell.withColumn("nth", F.row_number().over(inside) - 1)
        .join(offsets, ["parcel", "cell"])
        .select("doc_id", "size", "tokens", "text_crc32", "parcel", "shard", (F.col("start") + F.col("nth")).alias("slot"))
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
