"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors are projected onto ``projections`` random directions, each projection kept as one byte.  Two vectors collide in a
projection when either lies in the window of fixed half width centred on the other.  A pair with at least the calibrated
number of collisions is verified by its cosine in double precision; no other pair is.

So that few pairs need a count, a table sorts the vectors of a cell (the signs of a few further projections, so that a
cell holds about ``cell_rows`` vectors however many there are) by one of the projections, and collisions are counted for
the pairs inside its window.  What travels to the tables is an id with its bytes and cell numbers, whatever the width of a
vector.  The count needs no other table, for all projections come along; a pair belongs to the first table in whose
window it meets.  The tables give the ids with a passing pair; the vectors of those alone, once for each cell where they
have such a pair, come to be verified.  What leaves a cell is one row per vector: its number of links and the smallest
vector that it is joined to there; pairs are never emitted.

Calibration: at exactly the wanted cosine, collisions are binomial, so the least count is the greatest that a quarter of
the allowed misses permits; tables are as many as keep the chance of never meeting below the rest.  Closer pairs pass
more surely.  Equal vectors are one class with a multiplicity.  Cells of more than ``block`` rows are cut into blocks, and
pairs of blocks are spread over tasks; the block doubles only while more than ``CROWDED`` cells are above it, which bounds
the table of them that is shipped.

Cases: a vector that is null, zero, or holds null or non-finite components links with nothing; vectors of different
lengths do not link; rows that repeat a ``vec_id`` with the same vector count as vectors of their own, with different
vectors they share the greatest number of links and the smallest component; a null ``vec_id`` links with nothing; an
empty table gives an empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, discard, written
from .components import components

STEP = 24.0  # projections are kept as multiples of 1 / STEP
CROWDED = 1 << 20
INSIDE = 0.95  # a pair at the wanted cosine collides so often in one projection
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def calibrated(rows: int, cosine: float, recall: float, cell_rows: int, projections: int) -> tuple[int, int, int, int]:
    """Signs in a cell, tables, half width of the window in steps, and the least count of collisions."""
    signs = min(32, max(0, math.ceil(math.log2(max(1, rows) / cell_rows))))
    width = math.ceil(1.96 * math.sqrt(2 * (1 - cosine)) * STEP) + 1  # one more for rounding both
    lost, least, below = (1 - recall) / 4, 0, 0.0
    while least < projections and below + (now := math.comb(projections, least) * INSIDE**least * (1 - INSIDE) ** (projections - least)) <= lost:
        below, least = below + now, least + 1
    meet = INSIDE * (1 - math.acos(cosine) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - recall - lost) / math.log(1 - meet))), width, least


def prepared(vectors: DataFrame, signs: int, tables: int, projections: int) -> DataFrame:
    """``vec_id, dim, h1, h2, cells, codes, vector`` of the usable rows; the last three as bytes."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    names = ["vec_id", "dim", "h1", "h2", "cells", "codes", "vector"]

    def run(batches):
        known = {}
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            usable = ids.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
            for dim in np.unique(lengths[usable]).tolist():
                at = np.flatnonzero(usable & (lengths == dim))
                x = np.asarray(flat[starts[at][:, None] + np.arange(dim)], dtype="<f4" if single else "<f8") + 0.0  # minus zero and zero are equal
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[good], np.ascontiguousarray(x[good])
                if not len(at):
                    continue
                if dim not in known:
                    g = np.random.default_rng(dim)
                    known[dim] = g.standard_normal((dim, projections)), g.standard_normal((dim, tables * signs))
                unit = _unit(x)
                codes = np.clip(np.rint(unit @ known[dim][0] * STEP), -127, 127).astype(np.int8)
                bits = (unit @ known[dim][1] > 0).reshape(len(x), tables, signs)
                cells = (bits << np.arange(signs, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype("<u4")
                raw = [v.tobytes() for v in x]
                digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(v), np.int64) for v in raw])
                columns = [ids.take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, h1 long, h2 long, cells binary, codes binary, vector binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small components finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(len(column), -1)


def _cell_keys(dims: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A number for each vector's cell in each table."""
    table = np.arange(cells.shape[1], dtype=np.uint64)
    return (dims.astype(np.uint64)[:, None] << np.uint64(44)) ^ (table << np.uint64(32)) ^ cells.astype(np.uint64)


def crowded(heads: DataFrame, block: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The block, and the cells that hold more rows (sorted numbers) with their numbers of blocks."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                key, n = np.unique(_cell_keys(b.column(0).to_numpy(), _matrix(b.column(1), "<u4")), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    counted = heads.select("dim", "cells").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    counted = written(counted, "crowded")
    while counted.filter(F.col("n") > block).count() > CROWDED:
        block *= 2
    rows = counted.filter(F.col("n") > block).toPandas()
    discard(counted)
    key = rows["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(key)
    return block, key[order], -(-rows["n"].to_numpy(np.int64)[order] // block)


def record(tables: int, projections: int) -> np.dtype:
    return np.dtype([("tile", "<u8"), ("id", "<i8"), ("hash", "<i8"), ("many", "<i8"), ("table", "<u2"), ("side", "u1"), ("cells", "<u2", (tables,)), ("codes", "i1", (projections,))])


def candidates(heads: DataFrame, tables: int, projections: int, width: int, least: int, crowd: tuple, buckets: int) -> DataFrame:
    """``tile, table, side, id, hash, many``: the vectors with a pair that passes the count and belongs to the tile."""
    kind = record(tables, projections)
    _, busy, cuts = crowd

    def deal(batches):
        for b in batches:
            step = max(1, (16 << 20) // (kind.itemsize * tables))
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                cells, codes = _matrix(part.column("cells"), "<u4"), _matrix(part.column("codes"), "i1")
                rows = np.zeros((len(cells), tables), dtype=kind)
                rows["tile"], rows["table"] = _cell_keys(part.column("dim").to_numpy(), cells), np.arange(tables)
                rows["id"], rows["hash"], rows["many"] = (part.column(c).to_numpy()[:, None] for c in ("head", "h1", "many"))
                rows["cells"], rows["codes"] = _short(cells)[:, None, :], codes[:, None, :]
                rows = _cut(rows.reshape(-1), busy, cuts)
                with np.errstate(over="ignore"):
                    bucket = ((rows["tile"] * _SPREAD >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array([p.tobytes() for p in np.split(rows, at[1:])], pa.binary())], ["bucket", "rows"])

    def bucket_of(key, table):
        rows = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column("rows")])
        out = [rows[:0]]
        for at in _tiles(rows):
            tile, alive = rows[at], np.zeros(len(at), dtype=bool)
            for i, j in passing(tile, width, least):
                alive[i] = alive[j] = True
            out.append(tile[alive])
        found = np.concatenate(out)
        return pa.table({c: pa.array(found[c].astype(np.int64), pa.int64()) for c in ("tile", "table", "side", "id", "hash", "many")})

    packed = heads.select("head", "h1", "many", "dim", "cells", "codes").mapInArrow(deal, "bucket long, rows binary")
    return packed.groupBy("bucket").applyInArrow(bucket_of, "tile long, table long, side long, id long, hash long, many long")


def _short(cells: np.ndarray) -> np.ndarray:
    """Cell numbers in two bytes; those of more than 16 signs by a hash, so that one pair in tens of thousands may seem to meet before and be lost."""
    with np.errstate(over="ignore"):
        return np.where(cells < 1 << 16, cells, cells * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _cut(rows: np.ndarray, busy: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows of crowded cells go to each pair of blocks that theirs is part of; side 0 is a block by itself, 1 and 2 are the two of a pair."""
    if not len(busy):
        return rows
    at = np.minimum(np.searchsorted(busy, rows["tile"]), len(busy) - 1)
    cut = np.where(busy[at] == rows["tile"], cuts[at], 1)
    with np.errstate(over="ignore"):
        own = ((rows["id"].astype(np.uint64) * _SPREAD >> np.uint64(33)) % cut.astype(np.uint64)).astype(np.int64)
        rows = np.repeat(rows, cut)
        own, total = np.repeat(own, cut), np.repeat(cut, cut)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(cut) - cut, cut)
        low, high = np.minimum(own, other), np.maximum(own, other)
        rows["side"] = np.where(low == high, 0, np.where(own == low, 1, 2))
        rows["tile"] ^= np.where(total > 1, (low * total + high + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
    return rows


def _tiles(rows: np.ndarray):
    """Where the rows of each tile are, in the order of its table's projection."""
    place = rows["codes"][np.arange(len(rows)), rows["table"] % rows["codes"].shape[1]]
    order = np.lexsort((rows["hash"], rows["id"], place, rows["tile"]))
    for at in np.split(order, np.flatnonzero(np.diff(rows["tile"][order])) + 1):
        if len(at) > 1:
            yield at


def passing(rows: np.ndarray, width: int, least: int, step: int = 256):
    """Index arrays of pairs inside the window that collide often enough and belong to this table."""
    table, sides = int(rows["table"][0]), bool(rows["side"][0])
    m = rows["codes"].shape[1]
    own = table % m
    place = rows["codes"][:, own].astype(np.int64)
    ends = np.searchsorted(place, place + width, side="right")
    code = np.ascontiguousarray(rows["codes"].T).view(np.uint8)
    up = code + np.uint8(width)  # a difference of at most the width, as one comparison of bytes
    first = list(range(m))[: m // 2]
    for a in range(0, len(rows), step):
        b = min(len(rows), a + step)
        for c in range(a, int(ends[b - 1]), step):
            d = min(int(ends[b - 1]), c + step)
            n = np.zeros((b - a, d - c), np.uint8)
            for k in first:
                n += up[k, a:b, None] - code[k, None, c:d] <= 2 * width
            # Too few collisions in the first half cannot be made up for in the second.
            i, j = np.nonzero(n >= max(0, least - (m - len(first))))
            count, i, j = n[i, j], i + a, j + c
            inside = (i < j) & (j < ends[i])
            if sides:
                inside &= rows["side"][i] != rows["side"][j]
            i, j, count = i[inside], j[inside], count[inside].astype(np.int64)
            for e in range(0, len(i), 50_000):
                p, q = i[e : e + 50_000], j[e : e + 50_000]
                more = (up[len(first) :, p] - code[len(first) :, q] <= 2 * width).sum(axis=0)
                enough = count[e : e + 50_000] + more >= least
                p, q = p[enough], q[enough]
                new = np.ones(len(p), dtype=bool)
                for t in range(table):
                    k = t % m
                    new &= (rows["cells"][p, t] != rows["cells"][q, t]) | (np.abs(rows["codes"][p, k].astype(np.int16) - rows["codes"][q, k]) > width)
                if new.any():
                    yield p[new], q[new]


class Joined:
    """Sets of linked rows; each is named by its row with the smallest id."""

    def __init__(self, ids: np.ndarray):
        self.rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        self.parent = np.arange(len(ids))

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.parent[p], self.parent[q]
        apart = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
        for x, y in apart.T.tolist():
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                low, high = (x, y) if self.rank[x] < self.rank[y] else (y, x)
                self.parent[high] = low
        if apart.size:
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]


def verified(found: DataFrame, base: DataFrame, cosine: float, tables: int, projections: int, width: int, least: int, buckets: int, single: bool) -> DataFrame:
    """``id, n, root`` by tile: links of a vector (weighted by multiplicity) and the smallest vector joined to it there."""
    kind = record(tables, projections)

    def bucket_of(key, table):
        order = np.lexsort([table.column(c).to_numpy() for c in ("hash", "id", "tile")])
        table = table.take(pa.array(order))
        rows = np.zeros(len(table), dtype=kind)
        for c in ("tile", "id", "hash", "many", "table", "side"):
            rows[c] = table.column(c).to_numpy()
        rows["cells"], rows["codes"] = _short(_matrix(table.column("cells"), "<u4")), _matrix(table.column("codes"), "i1")
        ids, counts, roots = [], [], []
        for at in _tiles(rows):
            x = _unit(_matrix(table.column("vector").take(pa.array(at)), "<f4" if single else "<f8"))
            tile = rows[at]
            n, joined = np.zeros(len(tile), np.int64), Joined(tile["id"])
            for p, q in passing(tile, width, least):
                near = np.einsum("nd,nd->n", x[p], x[q]) >= cosine
                p, q = p[near], q[near]
                np.add.at(n, p, tile["many"][q])
                np.add.at(n, q, tile["many"][p])
                joined.link(p, q)
            linked = np.flatnonzero(n)
            ids.append(tile["id"][linked])
            counts.append(n[linked])
            roots.append(tile["id"][joined.parent[linked]])
        out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, counts, roots)]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("id", "n", "root"), out)})

    vectors = among(base.select(F.col("vec_id").alias("id"), F.col("h1").alias("hash"), "cells", "codes", "vector"), found.select("id")).dropDuplicates(["id", "hash"])
    met = found.join(vectors, ["id", "hash"]).withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)))
    return met.groupBy("bucket").applyInArrow(bucket_of, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, cell_rows: int = 2048, projections: int = 64, block: int = 8192, bucket_bytes: int = 24 << 20) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    signs, tables, width, least = calibrated(vectors.count(), cosine, recall, cell_rows, projections)
    base = written(prepared(vectors, signs, tables, projections), "vectors")
    one = [F.first(c).alias(c) for c in ("cells", "codes")]
    heads = written(base.groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("head"), F.count("*").alias("many"), *one), "heads")
    buckets = heads.count() * tables * record(tables, projections).itemsize // bucket_bytes + 1
    found = written(candidates(heads, tables, projections, width, least, crowded(heads, block), max(parts, buckets)), "candidates")
    size, dim = found.count(), base.agg(F.coalesce(F.max("dim"), F.lit(1))).first()[0]
    links = written(verified(found, base, cosine, tables, projections, width, least, max(parts, size * (record(tables, projections).itemsize + 8 * dim) // bucket_bytes + 1), single), "links")
    discard(found)
    joined = components(links.select("id", "root"))
    by_head = heads.select(F.col("head").alias("id"), "dim", "h1", "h2", "many").join(links.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(joined, "id", "left")
    by_class = by_head.select("dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of = base.select("vec_id", "dim", "h1", "h2").distinct().join(by_class, ["dim", "h1", "h2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(of, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return every.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs in SQL; quadratic, so meant for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (
  SELECT row_number() OVER () AS r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
c AS (SELECT a, b FROM p UNION SELECT vec_id, vec_id FROM u),
t(a, b) AS (SELECT a, b FROM c UNION SELECT t.a, c.b FROM t JOIN c ON t.b = c.a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
l AS (SELECT a, min(b) AS component_id FROM t GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id, v.vec_id = coalesce(component_id, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN l ON l.a = v.vec_id
"""
