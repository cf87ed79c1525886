"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter of ids, as a power of two.
FILTER_BITS = 26
#: Rows of a narrow table that is broadcast at most.
BROADCAST_ROWS = 500_000
#: Words of the operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where that is unset and all runs on one machine, as in tests."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_ = f"file://{tempfile.mkdtemp(prefix='foliolake-')}"
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`written` that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of few bytes a row, marked for broadcast where it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def rows_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side list as a frame whose rows lie in the plan (no Python worker)."""
    return spark.createDataFrame(rows, schema)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class Filter:
    """A set of numbers as 2 ** FILTER_BITS bits: all that were added are found, and few others."""

    def __init__(self, packed: bytes | None = None):
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8) if packed is None else np.frombuffer(zlib.decompress(packed), np.uint8)

    def add(self, numbers: np.ndarray) -> None:
        place = self._place(numbers)
        np.bitwise_or.at(self.bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        place = self._place(numbers)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def packed(self) -> bytes:
        return zlib.compress(self.bits.tobytes(), 1)

    @staticmethod
    def _place(numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filter_of(ids: DataFrame) -> Filter:
    """The numbers of a frame of one long column, gathered as four filters of fixed size."""

    def mark(batches):
        f = Filter()
        for b in batches:
            f.add(b.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([f.packed()], pa.binary())], ["bits"])

    out = Filter()
    for r in ids.repartition(4).mapInArrow(mark, "bits binary").toLocalIterator():  # at most 4 rows of 8 MB
        out.bits |= Filter(bytes(r.bits)).bits
    return out


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose first column is in ``ids`` (one long column, no nulls), and few others, without a shuffle of ``rows``."""
    packed = rows.sparkSession.sparkContext.broadcast(filter_of(ids).packed())

    def run(batches):
        wanted = Filter(packed.value)
        for b in batches:
            yield b.filter(pa.array(wanted.has(b.column(0).to_numpy()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
