"""Benchmark decontamination: pairs of neighbouring words as seeds, then Smith-Waterman alignment.

A document holds an item when the best local score of their words (match 1, mismatch and gap -1) is at least
``threshold`` of the item's length, so copies with edited, inserted or lost words are found.

No such copy is lost before the alignment.  An alignment with m matches and e edits has at most e + 1 runs of matches,
so at least m - e - 1 neighbouring pairs of matched words, one less than its score; and it covers at most twice the
item's length less its score.  One scan therefore looks up every word pair of a document among those of all items and
aligns an item only around places where that many of its pairs lie that close together.  Common pairs take part like
rare ones.  The scan is narrow: no text is shuffled.

The seed table is shipped with the scan.  Its size is checked: test items are taken in blocks of at most
``block_seeds`` seeds, each block with a scan of its own, so a large benchmark costs passes instead of memory.

Cases: null and empty texts hold nothing; a score of 1 (a lone word) never counts, so items of one word match
nothing and those of two only verbatim; repeated items each count; repeated rows give repeated pairs; an empty corpus or benchmark gives an empty
result; very long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, written
from .shingles import SPACE, Words, runs

N = 2
#: Items of fewer words match nothing; one of two is found verbatim, by its one pair.
SHORTEST = 2
#: Marks that stand between words like white space, so that punctuation makes no word different.
BETWEEN = SPACE + b".,;:!?\"'()[]{}*"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score, and where in the passage it ends (exclusive)."""
    steps = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        base = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == w, 1, -1), row[1:] - 1, out=base[1:])
        np.maximum(base, 0, out=base)
        row = np.maximum.accumulate(base + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Seeds:
    """A lookup of seed hashes: a filter by 20 bits before a sorted search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted, distinct
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[hashes >> np.uint64(44)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of grams that are seeds, and the seeds' numbers."""
        at = np.flatnonzero(self.filter[grams >> np.uint64(44)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        real = self.hashes[number] == grams[at]
        return at[real], number[real]


class Items:
    """Test items with what an alignment must have: the least score, and the pairs of words it holds at least."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.score = np.maximum(np.ceil(threshold * lengths).astype(np.int64), N)
        self.pairs, self.reach = self.score - 1, 2 * lengths - self.score
        grams = [np.unique(runs(w, N)) for w in self.words]
        self.hashes, number = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.owners = owner[np.argsort(number, kind="stable")]
        self.n = np.bincount(number, minlength=len(self.hashes))
        self.first = np.cumsum(self.n) - self.n

    def near(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and positions, in order, from which enough pairs of the item lie close enough together."""
        n = self.n[number]
        item = self.owners[np.repeat(self.first[number] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        item, at = item[order], np.repeat(at, n)[order]
        last = np.arange(len(item)) + self.pairs[item] - 1
        held = last < len(item)
        item_, at_, last = item[held], at[held], last[held]
        held = (item[last] == item_) & (at[last] - at_ <= self.reach[item_] - N)
        return item_[held], at_[held]


def aligned(docs: DataFrame, items: list[tuple[int, np.ndarray]], threshold: float) -> DataFrame:
    known = Items(items, threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seeds, words = Seeds(known.hashes), Words(BETWEEN)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1)):
                sequence = words.of(text.as_py())
                if len(sequence) < N:
                    continue
                item, at = known.near(*seeds.hits(runs(sequence, N)))
                for i in np.unique(item).tolist():
                    begins, reach, best, end = at[item == i], int(known.reach[i]), 0, 0
                    # Passages that overlap are aligned as one.
                    for part in np.split(begins, np.flatnonzero(np.diff(begins) > 2 * reach) + 1):
                        left = max(0, int(part[0]) - reach)
                        score, stop = align(known.words[i], sequence[left : int(part[-1]) + reach])
                        if score > best:
                            best, end = score, left + stop
                    if best >= known.score[i]:
                        rows.append((doc.as_py(), known.ids[i], best / len(known.words[i]), end))
            yield pa.RecordBatch.from_pydict({k: [r[j] for r in rows] for j, k in enumerate(("doc_id", "item_id", "score", "end_word"))}, schema=schema)

    schema = pa.schema([("doc_id", pa.string() if kind == "string" else pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {'string' if kind == 'string' else 'long'}, item_id long, score double, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_seeds: int = 2_000_000) -> DataFrame:
    """Pairs of a document and a test item that it holds: ``doc_id, item_id, score, end_word``."""
    found, block, size, words = None, [], 0, Words(BETWEEN)

    def flush():
        nonlocal found, block, size
        if block or found is None:
            part = aligned(docs, block, threshold) if block else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
            found = part if found is None else found.unionByName(part)
        block, size = [], 0

    # Items come one at a time, a partition at most in memory; a scan runs block by block.
    for r in benchmark.select("item_id", "text").toLocalIterator():
        w = words.of(r.text)
        if len(w) >= SHORTEST:
            block.append((r.item_id, w))
            size += len(w)
        if size >= block_seeds:
            flush()
    flush()
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows with the same ``doc_id`` (null equals null) stay or go together."""
    leaks = if_small(written(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "leaks"))
    return docs.alias("d").join(leaks.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
