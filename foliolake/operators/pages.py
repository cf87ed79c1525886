"""Operators on page rows: repeated edge lines, exact duplicates, order, gaps, text segments.

A page row has ``doc`` (document), ``page`` (its order in the document) and ``text``.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T


def edge_lines(pages: DataFrame, check: int = 3) -> DataFrame:
    """The first and last ``check`` stripped lines of each page; those of short pages come twice."""
    both = lambda of: F.concat(F.slice(of, F.lit(1), F.lit(check)), F.slice(of, F.greatest(F.size(of) - check + 1, F.lit(1)), F.lit(check)))
    ends = T.let(T.lines(T.strip(F.col("text"))), both)
    return pages.select("doc", "page", F.explode(F.transform(ends, T.strip)).alias("line"))


def repeated_lines(pages: DataFrame, least: int = 3, check: int = 3) -> DataFrame:
    """Running headers and footers: ``doc, line, n``."""
    return edge_lines(pages, check).filter("line <> ''").groupBy("doc", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def boilerplate_lines(pages: DataFrame, check: int = 3) -> DataFrame:
    return edge_lines(pages, check).filter(T.is_boilerplate(F.col("line"))).select("doc", "line").distinct()


def without_lines(pages: DataFrame, drop: DataFrame, most: int = 100_000, most_of_doc: int = 2_000) -> DataFrame:
    """Pages without the lines whose stripped text is in ``drop`` (``doc, line``): ``doc, page, text``.

    Lists of up to ``most`` lines, ``most_of_doc`` in a document, are broadcast, and lines go where pages lie; longer lists
    meet the lines one by one.  Both ways give the same.
    """
    rows = drop.select("doc", "line").distinct().limit(most + 1).collect()  # a bounded number of lines
    of_doc: dict = {}
    for r in rows:
        of_doc.setdefault(r.doc, []).append(r.line)
    if len(rows) <= most and max(map(len, of_doc.values()), default=0) <= most_of_doc:
        listed = pages.sparkSession.createDataFrame(list(of_doc.items()), f"doc {pages.schema['doc'].dataType.simpleString()}, drop array<string>")
        met = pages.select("doc", "page", "text").join(F.broadcast(listed), "doc", "left").withColumn("raw", T.lines(F.coalesce("text", F.lit(""))))
        # Hardly any line is on the list, so each page first gets its own few.
        own = met.withColumn("drop", F.when(F.col("drop").isNotNull(), F.array_intersect(F.transform("raw", T.strip), "drop")))
        kept = F.when(F.size("drop") > 0, F.filter("raw", lambda line: ~F.array_contains(F.col("drop"), T.strip(line)))).otherwise(F.col("raw"))
        return own.select("doc", "page", F.array_join(kept, "\n").alias("text"))
    each = pages.select("doc", "page", F.posexplode(T.lines(F.col("text"))).alias("at", "raw")).withColumn("line", T.strip(F.col("raw")))
    kept = each.join(drop.select("doc", "line").distinct(), ["doc", "line"], "left_anti")
    text = kept.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "raw")))["raw"], "\n").alias("text"))
    return pages.select("doc", "page").join(text, ["doc", "page"], "left").na.fill({"text": ""})


def first_of_equal(pages: DataFrame) -> DataFrame:
    """The first page of each text in a document: a partial aggregate, so a hot document is no hot task."""
    return pages.groupBy("doc", F.sha2("text", 256).alias("content_hash")).agg(F.min("page").alias("page"))


def _may_match(a: str, b: str, least: float, most: int = 100_000) -> bool:
    """Whether difflib's ratio of two texts can reach ``least``.

    The blocks it matches are a common subsequence, so their length is at most that of the longest one, which is counted
    here with a bit a character of ``a``.  Texts of more than ``most`` characters are not ruled out.
    """
    need = least * (len(a) + len(b)) / 2 - 1e-6
    if min(len(a), len(b)) < need:
        return False
    if max(len(a), len(b)) > most:
        return True
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = rest = (1 << len(a)) - 1
    for i, c in enumerate(b):
        held = rest & at.get(c, 0)
        rest = (rest + held | rest - held) & whole
        if not i & 63 and len(a) - rest.bit_count() + len(b) - 1 - i < need:
            return False
    return len(a) - rest.bit_count() >= need


def fuzzy_dedup(pages: DataFrame, same: float = 0.85, unsure: float = 0.7, ask: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Pages that differ enough from the last kept page of their document; of two alike the page with the longer text stays.

    Each decision depends on the one before, so the pages of a document are folded in order.  A document is the unit of
    work here; it is a book, not a corpus.  Between ``unsure`` and ``same``, ``ask`` decides where it is given.  Texts are
    only compared in full where their common characters leave it open whether they are alike.
    """
    lowest = same if ask is None else min(same, unsure)

    def alike(a: str, b: str) -> bool:
        ratio = 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() if _may_match(a, b, lowest) else 0.0
        return ratio >= same or (ratio >= unsure and ask is not None and ask(a, b))

    def fold(batches):
        kept: tuple | None = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if kept is not None and kept[0] == row[0] and alike(kept[2], row[2]):
                    kept = row if len(row[2]) > len(kept[2]) else kept
                    continue
                out += [kept] if kept is not None else []
                kept = row
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [()] * 3, b.schema)], schema=b.schema)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(kept, b.schema)], schema=b.schema)

    # A document lies in one partition, its pages one after another.
    of = pages.select("doc", "page", "text").na.fill({"text": ""})
    return of.repartition("doc").sortWithinPartitions("doc", F.asc_nulls_last("page"), "text").mapInArrow(fold, of.schema)


def gaps(pages: DataFrame, number: str = "page", block: int = 4096) -> DataFrame:
    """Numbers missing between the least and the greatest of a document: ``doc, missing``.

    Neighbours are found inside blocks of numbers, and between blocks over one row each, so a long document is split.
    """
    n = pages.filter(F.col(number).isNotNull()).select("doc", F.col(number).cast("long").alias("n")).distinct().withColumn("block", F.floor(F.col("n") / block))
    inside = n.withColumn("next", F.lead("n").over(Window.partitionBy("doc", "block").orderBy("n"))).select("doc", "n", "next")
    ends = n.groupBy("doc", "block").agg(F.min("n").alias("low"), F.max("n").alias("n"))
    between = ends.withColumn("next", F.lead("low").over(Window.partitionBy("doc").orderBy("block"))).select("doc", "n", "next")
    gap = inside.unionByName(between).filter("next - n > 1").select("doc", (F.col("n") + 1).alias("low"), (F.col("next") - 1).alias("high"))
    # A long gap is cut into runs first, and those of a very long one into runs of runs, so that no array is long.
    for step in (block**3, block**2, block):
        cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low")) / step))
        gap = gap.withColumn("k", F.explode(cut)).select("doc", (F.col("low") + F.col("k") * step).alias("low"), F.least(F.col("high"), F.col("low") + F.col("k") * step + (step - 1)).alias("high"))
    return gap.select("doc", F.explode(F.sequence("low", "high")).alias("missing"))


def numbered(results: DataFrame) -> DataFrame:
    """Adds ``number``, from 1 in the order of pages of a document, for sources that come in reading order."""
    return results.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("page")))


def reorder(pages: DataFrame, number: str = "number") -> DataFrame:
    """Adds ``order`` from 1 in each document: pages without a number first, in their old order, then by number."""
    return pages.withColumn("order", F.row_number().over(Window.partitionBy("doc").orderBy(F.col(number).asc_nulls_first(), "page")))


def rejoin_lines(pages: DataFrame, short: int = 15, least: int = 3) -> DataFrame:
    """``doc, page, text`` with runs of short prose lines set as one line each.

    In a run of neighbouring short lines the first that ends no sentence starts the joined line; it reaches to the run's
    end and needs ``least`` lines.  A later start in the same run would only be shorter, so each run is decided once.
    Pages are read one by one where they lie; those without a text are left out.
    """
    signs, ends = set("=+×÷∑∫√≤≥≠±<>"), tuple(".!?:;")

    def fits(bare: str) -> bool:
        return 1 < len(bare) < short and signs.isdisjoint(bare) and any(map(str.isalpha, bare))

    def rejoined(text: str, known: dict[str, bool]) -> str:
        out: list[str] = []
        run: list[tuple[str, str]] = []

        def close() -> None:
            start = next((i for i, (_, bare) in enumerate(run) if not bare.endswith(ends)), len(run))
            if len(run) - start >= least:
                out.extend(raw for raw, _ in run[:start])
                out.append(" ".join(bare for _, bare in run[start:]))
            else:
                out.extend(raw for raw, _ in run)
            run.clear()

        for raw in text.split("\n"):
            bare = raw.strip(T.BLANKS)
            fit = known.get(bare)
            if fit is None:
                fit = fits(bare)
                if len(bare) < short and len(known) < 500_000:
                    known[bare] = fit
            if fit:
                run.append((raw, bare))
            else:
                close()
                out.append(raw)
        close()
        return "\n".join(out)

    def rejoin(batches):
        known: dict[str, bool] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([rejoined(t.as_py(), known) for t in b.column(2)], b.schema.field(2).type)], ["doc", "page", "text"])

    of = pages.select("doc", "page", "text").filter("text IS NOT NULL")
    return of.mapInArrow(rejoin, of.schema)


def merge_footnotes(blocks: DataFrame) -> DataFrame:
    """Footnote blocks without a number directly after a footnote of their page continue it: ``doc, page, ord, kind, level, footnote, text``."""
    w = Window.partitionBy("doc", "page").orderBy("ord", "text")
    continues = (F.col("kind") == "footnote") & F.col("footnote").isNull() & F.coalesce(F.lag("kind").over(w) == "footnote", F.lit(False))
    one = blocks.withColumn("island", F.sum((~continues).cast("int")).over(w)).groupBy("doc", "page", "island")
    head = F.min_by(F.struct("kind", "level", "footnote"), "ord").alias("head")
    merged = one.agg(F.min("ord").alias("ord"), head, F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "\n").alias("text"))
    return merged.select("doc", "page", "ord", "head.*", "text")


def segments(pages: DataFrame) -> DataFrame:
    """Paragraphs of raw text as blocks: ``doc, page, ord, kind, level, footnote, text``."""
    parts = F.split(T.strip(F.col("text")), r"(?U)\n\s*\n", -1)
    each = pages.withColumn("parts", parts).select("doc", "page", F.size("parts").alias("total"), F.posexplode("parts").alias("ord", "raw"))
    each = each.withColumn("text", T.strip(F.col("raw"))).filter("text <> ''").filter(~T.is_boilerplate(F.col("text"), stripped=True))
    c = F.col("text")
    footnote = F.when(c.rlike(r"^(\d+)\s+\S") & (F.col("ord") >= F.floor(F.col("total") / 2)), F.regexp_extract(c, r"^(\d+)\s", 1))
    kind = F.when(T.is_all_caps_heading(c, stripped=True), "heading").when(footnote.isNotNull(), "footnote").when(T.is_caption(c), "caption").otherwise("body")
    each = each.withColumn("kind", kind)
    return each.select("doc", "page", "ord", "kind", F.when(F.col("kind") == "heading", 2).alias("level"), F.when(F.col("kind") == "footnote", footnote).alias("footnote"), "text")


def is_digital(pages: DataFrame, least_chars: int = 100, most_odd: float = 0.3, first: int = 3) -> DataFrame:
    """Whether the first pages of a document hold real text: ``doc, digital``.  ``page`` counts from 0."""
    one = pages.filter(F.col("page") < first).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text")))["text"], "").alias("text"))
    return one.select("doc", ((F.length(T.strip(F.col("text"))) >= least_chars) & (T.non_printable_share(F.col("text")) <= most_odd)).alias("digital"))
