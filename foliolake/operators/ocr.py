"""Optical character recognition results: quality gate, engine cascade, words to lines; image bounds from pixel profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.functions import text as T


def good(confidence: Column, line_count: Column, text: Column, least_confidence: float = 0.6, least_lines: int = 3, most_odd: float = 0.3) -> Column:
    return (confidence >= least_confidence) & (line_count >= least_lines) & (T.non_printable_share(text) <= most_odd)


def cascade(items: DataFrame, engines: list[Callable[[DataFrame], DataFrame]], checks: list[Column | None]) -> DataFrame:
    """Each item's result by the first engine whose check it passes; the last engine's otherwise.

    An engine maps ``key, ...`` to ``key, text, confidence, line_count``; a stage without a check takes all.
    """
    done, left = None, items
    for stage, (engine, check) in enumerate(zip(engines, checks)):
        result = engine(left).withColumn("stage", F.lit(stage))
        last = check is None or stage == len(engines) - 1
        passed = result if last else result.filter(check)
        done = passed if done is None else done.unionByName(passed)
        if last:
            break
        left = left.join(passed.select("key"), "key", "left_anti")
    return done


def words_to_lines(words: DataFrame) -> DataFrame:
    """``page, block, par, line, text, confidence`` from recognised words with ``conf`` in percent; negative ones and blanks go."""
    kept = words.filter((F.col("conf") >= 0) & (F.trim("text") != ""))
    return kept.groupBy("page", "block", "par", "line").agg(F.array_join(F.array_sort(F.collect_list(F.struct("word", "text")))["text"], " ").alias("text"), (F.avg("conf") / 100).alias("confidence"))


def page_confidence(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.count("*").alias("line_count"))


def sample_indices(total: int, size: int = 8) -> list[int]:
    n = min(size, total)
    return np.linspace(0, total - 1, n).astype(int).tolist()


def content_bounds(stack: np.ndarray, threshold: float = 15.0, most: float = 0.95, least: float = 0.5) -> tuple[int, int, int, int] | None:
    """Left, top, right, bottom of what changes over screenshots of one size (n, height, width, 3); None where nothing useful is found."""
    if len(stack) < 3:
        return None
    spread = stack.astype(np.float32).std(axis=0).mean(axis=-1)
    box = []
    for profile in (spread.mean(axis=0), spread.mean(axis=1)):
        over = np.flatnonzero(profile > threshold)
        box.append((int(over[0]), int(over[-1])) if len(over) else (0, len(profile) - 1))
    (left, right), (top, bottom) = box
    share = (right - left + 1) * (bottom - top + 1) / spread.size
    return None if share > most or share < least else (left, top, right + 1, bottom + 1)


def column_bounds(stack: np.ndarray, threshold: float = 8.0, least_width: int = 100, gutter: int = 20) -> list[tuple[int, int]]:
    """Columns of text: runs of columns that vary, joined over small gutters, without narrow ones; the full width if none is left."""
    spread = stack.astype(np.float32).std(axis=0).mean(axis=-1).mean(axis=0)
    edge = np.diff((spread > threshold).astype(np.int8), prepend=0, append=0)
    found: list[list[int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if found and a - found[-1][1] < gutter:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found if b - a >= least_width] or [(0, len(spread))]
