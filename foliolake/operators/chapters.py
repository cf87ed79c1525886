"""Chapters from blocks: detection, footnote and reference linking, merging, Markdown.

A block row has ``doc, ord, kind, level, footnote, text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T


def assigned(blocks: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Adds ``chapter`` (0 for what stands before the first level-1 heading) and ``title``.

    Level-1 headings with only headings between them open one chapter, whose title joins theirs; ``in_title`` marks headings
    that are part of a title.  Without level-1 headings the first heading names the only chapter, or it is Untitled.  ``starts``
    (``doc, ord``) names the headings that open chapters in the documents that it has rows of, whatever their levels.
    """
    by_doc = Window.partitionBy("doc").orderBy("ord")
    start = (F.col("kind") == "heading") & (F.col("level") == 1)
    if starts is not None:
        told = starts.select("doc", "ord").distinct().withColumn("told", F.lit(True))
        blocks = blocks.join(told, ["doc", "ord"], "left").withColumn("any_told", F.max("told").over(Window.partitionBy("doc")))
        start = F.when(F.col("any_told"), F.coalesce("told", F.lit(False))).otherwise(F.coalesce(start, F.lit(False)))
    up_to, before = by_doc.rowsBetween(Window.unboundedPreceding, 0), by_doc.rowsBetween(Window.unboundedPreceding, -1)
    last_start = F.max(F.when(start, F.col("ord"))).over(before)
    last_other = F.max(F.when(F.col("kind") != "heading", F.col("ord"))).over(before)
    opens = start & (last_start.isNull() | F.coalesce(last_other > last_start, F.lit(False)))
    marked = blocks.withColumn("opens", opens).withColumn("chapter", F.sum(F.col("opens").cast("int")).over(up_to))
    starts = marked.filter(start & (F.col("chapter") > 0)).groupBy("doc", "chapter").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], " — ").alias("title"))
    heads = marked.groupBy("doc").agg(F.max("chapter").alias("chapters"), F.min_by(F.when(F.col("kind") == "heading", F.col("text")), F.when(F.col("kind") == "heading", F.col("ord"))).alias("first_heading"), F.min(F.when(F.col("kind") == "heading", F.col("ord"))).alias("first_ord"))
    out = marked.join(starts, ["doc", "chapter"], "left").join(heads, "doc")
    title = F.when(F.col("chapters") == 0, F.coalesce("first_heading", F.lit("Untitled"))).otherwise(F.coalesce("title", F.lit("Front Matter")))
    out = out.withColumn("title", title)
    gone = (F.col("kind") == "heading") & F.when(F.col("chapters") == 0, F.col("ord") == F.col("first_ord")).otherwise((F.col("chapter") > 0) & F.col("title").contains(F.col("text")))
    return out.select("doc", "chapter", "title", "ord", "kind", "level", "footnote", "text", F.coalesce(gone, F.lit(False)).alias("in_title"))


def detect(blocks: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Blocks with ``chapter`` and ``title``, without the headings that make the titles."""
    return assigned(blocks, starts).filter("NOT in_title").drop("in_title")


def footnotes(blocks: DataFrame) -> DataFrame:
    """``doc, chapter, footnote, text, ord``: orphans join the last footnote before them; a repeated id keeps its first place and last text."""
    w = Window.partitionBy("doc", "chapter").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    notes = blocks.filter("kind = 'footnote'").withColumn("of", F.last("footnote", ignorenulls=True).over(w)).withColumn("nth", F.sum(F.col("footnote").isNotNull().cast("int")).over(w)).filter("of IS NOT NULL")
    whole = notes.groupBy("doc", "chapter", "of", "nth").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "text")))["text"], "\n").alias("text"), F.min("ord").alias("ord"))
    return whole.groupBy("doc", "chapter", F.col("of").alias("footnote")).agg(F.max_by("text", "nth").alias("text"), F.min("ord").alias("ord"))


def bibliography(blocks: DataFrame) -> DataFrame:
    """The reference blocks of each chapter, numbered from 1: ``doc, chapter, n, text``."""
    nth = F.row_number().over(Window.partitionBy("doc", "chapter").orderBy("ord", "text"))
    return blocks.filter("kind = 'reference'").select("doc", "chapter", nth.alias("n"), "text")


def quoted(c: Column) -> Column:
    """A text as a pattern of itself."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}_\s])", r"\\$1")


def link_footnotes(blocks: DataFrame) -> DataFrame:
    """Body blocks with ``[^id]`` where an id of their chapter follows a word or sentence; footnote blocks go."""
    notes = footnotes(blocks).groupBy("doc", "chapter").agg(F.array_sort(F.collect_list(F.struct("ord", "footnote")))["footnote"].alias("ids"))
    marked = F.aggregate(
        "ids", F.col("text"),
        lambda t, i: F.regexp_replace(t, F.concat(F.lit(r"(?<=[a-zA-Z.,;:!?\"'])(\s?)("), quoted(i), F.lit(r")(?=[\s.,;:!?\"']|$)")), F.lit("$1[^$2]")),
    )
    out = blocks.filter("kind <> 'footnote'").join(notes, ["doc", "chapter"], "left")
    return out.withColumn("text", F.when((F.col("kind") == "body") & F.col("ids").isNotNull(), marked).otherwise(F.col("text"))).drop("ids")


def merge_bodies(blocks: DataFrame) -> DataFrame:
    """Neighbouring body blocks become one: sentences and words broken between them are joined."""
    w = Window.partitionBy("doc", "chapter").orderBy("ord")
    starts = (F.col("kind") != "body") | (F.lag("kind").over(w).isNull()) | (F.lag("kind").over(w) != "body")
    island = blocks.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))["text"]
    one = island.groupBy("doc", "chapter", "island").agg(F.min("ord").alias("ord"), F.first("title").alias("title"), F.first("kind").alias("kind"), F.first("level").alias("level"), parts.alias("parts"))
    joined = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1), lambda a, b: T.fix_hyphenation(T.join_broken_sentences(a, b)))
    text = F.when(F.col("kind") == "body", T.fix_hyphenation(joined)).otherwise(F.element_at("parts", 1))
    return one.select("doc", "chapter", "title", "ord", "kind", "level", text.alias("text"))


def render(blocks: DataFrame, notes: DataFrame | None = None, references: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """A chapter as Markdown: ``doc, chapter, title, markdown``.

    ``notes`` and ``references`` (from :func:`footnotes` and :func:`bibliography`) follow the blocks; ``titles`` (``doc,
    chapter, title``) names the chapters, also those without blocks.
    """
    keys = ["doc", "chapter"]
    level = F.coalesce("level", F.lit(2))
    # A blank line follows all but the entries of an index.
    piece = (
        F.when(F.col("kind") == "heading", F.concat(F.when(level <= 2, F.repeat(F.lit("#"), level + 1)).otherwise("####"), F.lit(" "), F.col("text"), F.lit("\n")))
        .when(F.col("kind") == "caption", F.concat(F.lit("> "), F.col("text"), F.lit("\n")))
        .when(F.col("kind") == "index", F.concat(F.lit("- "), F.col("text")))
        .when(F.col("kind") == "body", F.concat(F.col("text"), F.lit("\n")))
    )

    def in_order(rows: DataFrame, order, line, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("line")))))["line"]
        return rows.groupBy(*keys).agg(listed.alias(name))

    number = F.col("footnote").rlike(r"^\d+$")
    note_order = [(~number).alias("named"), F.when(number, F.lpad(F.regexp_replace("footnote", "^0+(?=.)", ""), 10, "0")).otherwise(F.col("footnote")).alias("key")]
    body = (titles if titles is not None else blocks.groupBy(*keys).agg(F.first("title").alias("title"))).select(*keys, "title")
    body = body.join(in_order(blocks, ["ord"], piece, "pieces"), keys, "left")
    none = F.array().cast("array<string>")
    parts = [F.array(F.concat(F.lit("# "), F.col("title"), F.lit("\n"))), F.coalesce("pieces", none)]
    if notes is not None:
        body = body.join(in_order(notes, note_order, F.concat(F.lit("[^"), "footnote", F.lit("]: "), "text"), "notes"), keys, "left")
        parts.append(F.when(F.size("notes") > 0, F.concat(F.array(F.lit("")), "notes", F.array(F.lit("")))).otherwise(none))
    if references is not None:
        line = F.concat(F.col("n").cast("string"), F.lit(". "), "text")
        body = body.join(in_order(references, ["n"], line, "references"), keys, "left")
        head = F.array(F.lit(""), F.lit("## References"), F.lit(""))
        parts.append(F.when(F.size("references") > 0, F.concat(head, "references", F.array(F.lit("")))).otherwise(none))
    return body.select("doc", "chapter", "title", F.array_join(F.concat(*parts), "\n").alias("markdown"))
