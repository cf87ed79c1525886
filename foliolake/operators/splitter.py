"""Splitting a book in one file at its parts, named sections and numbered items.

A line row has ``doc, line_no`` (from 0) and ``line``.  A book is the unit of order here; its lines are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T

# Sections that stand alone on a line, and those that a title follows.
NAMED = ("Preface", "Acknowledgments", "Introduction", "Notes", "Bibliography", "Index")
TITLED = ("CONCLUSION", "APPENDIX", "AFTERWORD", "FOREWORD", "EPILOGUE", "PROLOGUE")
LONGEST_TITLED, LONGEST_WRAPPED, LONGEST_NUMBER, LINES_BACK = 80, 40, 999, 9

IS_NAMED = f"^(?:<b>)?({'|'.join(NAMED)})(?:</b>)?$"
IS_PART = r"(?i)^PART\s+(\d+)\s+(.+)$"
IS_TITLED = rf"(?i)^({'|'.join(TITLED)})[.\s:]+(.+)$"
IS_CONTENTS = r"(?i)^(?:<b>)?Contents(?:</b>)?$"


def marked(lines: DataFrame) -> DataFrame:
    """Lines with ``bare`` text, the ``next`` line's and the ``kind`` and ``key`` of a boundary, after the contents or not."""
    by_doc = Window.partitionBy("doc").orderBy("line_no")
    of = lines.select("doc", "line_no", T.strip(F.col("line")).alias("bare"))
    of = of.withColumn("next", F.coalesce(F.lead("bare").over(by_doc), F.lit(""))).withColumn("before", F.lag("bare").over(by_doc))
    bare = F.col("bare")
    kind = F.when(bare.rlike(IS_NAMED), "named").when(bare.rlike(IS_PART), "part").when(bare.rlike(IS_TITLED) & (F.length(T.strip_tags(bare)) <= LONGEST_TITLED), "titled")
    of = of.withColumn("kind", kind)
    part = F.concat(F.lit("part "), F.regexp_extract(bare, IS_PART, 1))
    key = F.when(kind == "named", F.lower(F.regexp_extract(bare, IS_NAMED, 1))).when(kind == "part", part).when(kind == "titled", F.lower(F.regexp_extract(bare, IS_TITLED, 1)))
    contents = F.min(F.when(bare.rlike(IS_CONTENTS), F.col("line_no"))).over(Window.partitionBy("doc"))
    return of.withColumn("key", key).withColumn("contents", contents)


def contents_end(of: DataFrame) -> DataFrame:
    """``doc, start``: where the text begins.

    Sections that the contents list come again in the text; the earliest second one is its first line.  0 without contents.
    """
    listed = of.filter((F.col("line_no") > F.col("contents")) & F.col("kind").isin("named", "part"))
    nth = F.row_number().over(Window.partitionBy("doc", "key").orderBy("line_no"))
    second = listed.withColumn("nth", nth).filter("nth = 2").groupBy("doc").agg(F.min("line_no").alias("start"))
    return of.select("doc").distinct().join(second, "doc", "left").na.fill({"start": 0})


def _titles() -> Column:
    bare, next_ = F.col("bare"), F.col("next")
    clean = T.strip_tags(next_)
    wraps = (next_ != "") & ~next_.rlike(IS_PART) & ~next_.rlike(IS_NAMED) & ~next_.rlike(r"^\d+\.\s+[A-Z]")
    part = F.concat(F.lit("Part "), F.regexp_extract(bare, IS_PART, 1), F.lit(": "), T.strip_tags(F.regexp_extract(bare, IS_PART, 2)), F.when(wraps, F.concat(F.lit(" "), clean)).otherwise(""))
    short = (clean != "") & (F.length(clean) < LONGEST_WRAPPED) & ~next_.rlike(IS_PART)
    titled = F.concat(F.initcap(F.lower(F.regexp_extract(bare, IS_TITLED, 1))), F.lit(": "), T.strip(F.regexp_extract(bare, IS_TITLED, 2)), F.when(short, F.concat(F.lit(" "), clean)).otherwise(""))
    return F.when(F.col("kind") == "named", F.regexp_extract(bare, IS_NAMED, 1)).when(F.col("kind") == "part", part).otherwise(titled)


def boundaries(lines: DataFrame, artifacts: bool = False) -> DataFrame:
    """``doc, start, end, kind, title`` of the chapters of a book; a null ``end`` is the end of the file.

    Named and titled sections count once, where they come first after the contents; parts always.  With ``artifacts``
    the numbered items inside the parts become chapters of their own.
    """
    of = marked(lines).join(contents_end(marked(lines)).withColumnRenamed("start", "text_start"), "doc")
    found = of.filter(F.col("kind").isNotNull() & (F.col("line_no") >= F.col("text_start")))
    nth = F.row_number().over(Window.partitionBy("doc", "key").orderBy("line_no"))
    found = found.withColumn("nth", nth).filter("nth = 1 OR kind = 'part'")
    end = F.lead("line_no").over(Window.partitionBy("doc").orderBy("line_no"))
    plain = found.select("doc", F.col("line_no").alias("start"), end.alias("end"), "kind", _titles().alias("title"))
    return with_items(of, plain) if artifacts else plain


def item_titles(of: DataFrame) -> DataFrame:
    """``doc, number, title`` of numbered items: the last of each in the contents, else the first in an appendix."""
    bare, before = F.col("bare"), F.col("before")
    number = F.regexp_extract(bare, r"^(\d+)\.", 1).try_cast("int")
    title = F.regexp_extract(bare, r"^\d+\.\s+(.+)$", 1)
    sized = title.rlike(r"<math>|×|\bcm\b")
    # A number alone on its line has its title on the line before.
    alone = bare.rlike(r"^\d+\.$") & (before != "") & ~before.startswith("PART")
    listed = F.when(title != "", F.when(~sized, T.strip(title))).when(alone, before)
    in_contents = of.filter((F.col("line_no") < F.col("text_start")) & number.between(1, LONGEST_NUMBER)).select("doc", number.alias("number"), listed.alias("title"), "line_no").filter("title IS NOT NULL")
    first = in_contents.groupBy("doc", "number").agg(F.max_by("title", "line_no").alias("title"), F.lit(0).alias("source"))
    measured = F.regexp_extract(bare, r"^\d+\.\s+(.+?),\s+(?:<math>|\d)", 1)
    appendix = of.filter((F.col("line_no") >= F.col("text_start")) & number.between(1, LONGEST_NUMBER) & (measured != "")).select("doc", number.alias("number"), T.strip(measured).alias("title"), "line_no")
    second = appendix.groupBy("doc", "number").agg(F.min_by("title", "line_no").alias("title"), F.lit(1).alias("source"))
    return first.unionByName(second).groupBy("doc", "number").agg(F.min_by("title", "source").alias("title"))


def item_starts(of: DataFrame, body: DataFrame) -> DataFrame:
    """``doc, number, start`` of the items in a body (``doc, body_start, body_end, most``): a heading, else the first figure.

    The item of a figure begins after the nearest blank line among the ``LINES_BACK`` before it.
    """
    bare, w = F.col("bare"), Window.partitionBy("doc").orderBy("line_no")
    figure = r"^FIGURE\s+(\d+)\.0*1(?!\d)"
    clean = F.regexp_replace(T.strip_tags(bare), "^[> ]+", "")
    inside = of.join(body, "doc").filter((F.col("line_no") >= F.col("body_start")) & (F.col("line_no") < F.col("body_end")))
    blank = F.last(F.when(bare == "", F.col("line_no")), ignorenulls=True).over(w.rowsBetween(-LINES_BACK, -1))
    each = inside.withColumn("blank", blank).select(
        "doc", "most", "line_no", "blank",
        F.regexp_extract(bare, r"^(\d+)\.\s+[A-Z][A-Za-z]", 1).try_cast("int").alias("heading"),
        F.regexp_extract(clean, figure, 1).try_cast("int").alias("figure"),
    )
    of_kind = lambda c, source, start: each.filter(F.col(c).between(1, F.col("most"))).groupBy("doc", F.col(c).alias("number")).agg(F.min_by(start, "line_no").alias("start"), F.lit(source).alias("source"))
    both = of_kind("heading", 0, F.col("line_no")).unionByName(of_kind("figure", 1, F.coalesce(F.col("blank") + 1, F.col("line_no"))))
    return both.groupBy("doc", "number").agg(F.min_by("start", "source").alias("start"))


def with_items(of: DataFrame, plain: DataFrame) -> DataFrame:
    """Chapters with the parts replaced by their items and by what stands in them before an item."""
    titles = item_titles(of)
    most = titles.groupBy("doc").agg(F.max("number").alias("most"))
    length = of.groupBy("doc").agg((F.max("line_no") + 1).alias("length"))
    parts = plain.filter("kind = 'part'")
    body = parts.groupBy("doc").agg(F.min("start").alias("body_start"), F.max_by(F.struct("end"), "start").alias("last"))
    body = body.join(most, "doc").join(length, "doc").select("doc", "body_start", F.coalesce("last.end", "length").alias("body_end"), "most")
    starts = item_starts(of, body)
    after = F.lead("start").over(Window.partitionBy("doc").orderBy("start", "number"))
    items = starts.withColumn("end", after).join(body.select("doc", "body_end"), "doc").join(titles, ["doc", "number"], "left")
    name = F.concat(F.col("number").cast("string"), F.lit(". "), F.coalesce("title", F.concat(F.lit("Item "), F.col("number").cast("string"))))
    items = items.select("doc", "start", F.coalesce("end", "body_end").alias("end"), F.lit("item").alias("kind"), name.alias("title"))
    listed = starts.groupBy("doc").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    heads = parts.join(body, "doc").join(listed, "doc", "left")
    next_ = F.coalesce(F.array_min(F.filter("starts", lambda s: s > F.col("start"))), F.col("body_end"))
    heads = heads.filter(F.col("start") < F.coalesce(F.array_min("starts"), F.col("body_end"))).select("doc", "start", next_.alias("end"), "kind", "title")
    # Books without items or parts stay as they are.
    changed = body.select("doc")
    rest = plain.join(changed, "doc", "left_semi").filter("kind <> 'part'").unionByName(items).unionByName(heads)
    last = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("start"), F.when(F.col("kind") == "item", 0).otherwise(1))) == 1
    rest = rest.withColumn("last", last).withColumn("end", F.when(~F.col("last"), F.col("end"))).drop("last")
    return plain.join(changed, "doc", "left_anti").unionByName(rest)


def split(lines: DataFrame, chapters: DataFrame, block: int = 64) -> DataFrame:
    """The text of each chapter (``doc, start, end, title`` and maybe ``page_start, page_end``) with its place: ``doc, dir, file, text``.

    Chapters are cut at multiples of ``block`` lines, so that a line meets the chapters of its block and not all of its book.
    """
    pages = {c: F.col(c) if c in chapters.columns else F.lit(None).cast("int") for c in ("page_start", "page_end")}
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("start", "title"))
    named = chapters.withColumns(pages).withColumn("nth", nth).withColumn("slug", T.slugify(F.col("title")))
    prefix = F.format_string("%03d_", F.col("nth") * 10)
    of_pages = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.format_string("pp_%d_%d_", "page_start", "page_end")).otherwise("")
    named = named.select("doc", "nth", "start", "end", F.concat(prefix, of_pages, "slug").alias("dir"), F.concat(F.lit("chapter_01_"), "slug", F.lit(".md")).alias("file"))
    of = lines.select("doc", "line_no", "line")
    ends = of.groupBy("doc").agg((F.max("line_no") + 1).alias("length"))
    # What lies outside the book holds no lines.
    first, past = F.greatest("start", F.lit(0)), F.least(F.coalesce("end", "length"), "length")
    cut = named.join(ends, "doc").withColumns({"start": first, "end": past}).filter("start < end")
    cut = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))).drop("length")
    held = cut.join(of.withColumn("block", F.floor(F.col("line_no") / block)), ["doc", "block"]).filter((F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("end")))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    return held.groupBy("doc", "nth", "dir", "file").agg(text.alias("text")).select("doc", "dir", "file", "text")
