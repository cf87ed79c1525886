"""Blocks from page layout: font profile of a document and classification by fonts.

A span row has ``doc, page, block, line, span, text, size, font, y`` (the block's top); sizes are rounded to 0.1 at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T
from foliolake.operators.pages import merge_footnotes, rejoin_lines
from foliolake.operators.pages import segments as text_segments


def font_profile(spans: DataFrame) -> DataFrame:
    """``doc, body_size, body_font, footnote_size, heading_sizes, heading_fonts``: one partial aggregate by size and font, then one row per document."""
    n = spans.filter(F.trim("text") != "").groupBy("doc", "size", "font").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "block", "line", "span")).alias("at"))
    by_doc = n.groupBy("doc").agg(F.collect_list(F.struct("size", "font", "n", "at")).alias("fonts"))
    sizes = n.groupBy("doc", "size").agg(F.sum("n").alias("n"), F.min("at").alias("at")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", "size"))).alias("sizes"))
    both = by_doc.join(sizes, "doc").withColumn("body_size", F.get("sizes", 0)["size"])
    own = F.filter("fonts", lambda f: f["size"] == F.col("body_size"))
    both = both.withColumn("body", F.get(F.array_sort(F.transform(own, lambda f: F.struct((-f["n"]).alias("less"), f["at"].alias("at"), f["font"].alias("font")))), 0))
    heading = F.filter("fonts", lambda f: (F.abs(f["size"] - F.col("body_size")) < 1) & (f["font"] != F.col("body")["font"]) & (f["n"] < -0.3 * F.col("body")["less"]))
    note = F.aggregate("sizes", F.lit(0.0), lambda acc, s: F.when((s["size"] > 5) & (s["size"] < F.col("body_size")) & ((acc == 0) | (F.abs(s["size"] - acc) <= 1)), F.greatest(acc, s["size"].cast("double"))).otherwise(acc))
    return both.select("doc", "body_size", F.col("body")["font"].alias("body_font"), note.alias("footnote_size"), F.sort_array(F.filter(F.array_distinct(F.transform("sizes", lambda s: s["size"])), lambda s: s > F.col("body_size")), asc=False).alias("heading_sizes"), F.array_distinct(F.transform(heading, lambda f: f["font"])).alias("heading_fonts"))


def lines_of(spans: DataFrame) -> DataFrame:
    """``doc, page, block, line, text, raised``: lines put together from their spans.

    ``raised`` is the number that a line starts with as a superscript: a first span of digits, smaller than what follows.
    """
    of = F.array_sort(F.collect_list(F.struct("span", "text", "size")))
    one = spans.groupBy("doc", "page", "block", "line").agg(of.alias("spans"), F.min("y").alias("y"))
    head = F.get("spans", F.lit(0))
    later = F.get(F.filter(F.slice("spans", 2, 1 << 20), lambda s: T.strip(s["text"]) != ""), F.lit(0))
    number = T.strip(head["text"])
    raised = F.when(number.rlike(r"^\d+$") & (head["size"] < 0.8 * later["size"]), number)
    return one.select("doc", "page", "block", "line", F.array_join("spans.text", "").alias("text"), raised.alias("raised"), "y")


def footnote_parts(lines: DataFrame) -> DataFrame:
    """``doc, page, block, part, footnote, text``: a block cut before each line that starts with a raised number."""
    w = Window.partitionBy("doc", "page", "block").orderBy("line")
    part = F.sum(F.col("raised").isNotNull().cast("int")).over(w)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line", T.normalize_ligatures(F.col("text")).alias("text"))))["text"], "\n")
    one = lines.withColumn("part", part).groupBy("doc", "page", "block", "part").agg(F.max("raised").alias("raised"), T.strip(text).alias("text")).filter("text <> ''")
    number = F.regexp_extract("text", r"^(\d+)\s+", 1)
    return one.select("doc", "page", "block", "part", F.coalesce("raised", F.when(number != "", number)).alias("footnote"), "text")


def without_repeated(text: Column, repeated: Column) -> Column:
    """A block's text without the lines that run through the document."""
    return F.aggregate(T.lines(text), text, lambda t, line: F.when(F.array_contains(repeated, T.strip(line)), T.strip(F.replace(t, line, F.lit("")))).otherwise(t))


def classify(spans: DataFrame, profile: DataFrame, page_height: float = 800.0, repeated: DataFrame | None = None) -> DataFrame:
    """``doc, page, ord, kind, level, footnote, text``; the first rule that fits decides.

    ``repeated`` (``doc, line``): running headers and footers, which are erased inside blocks.  A block of footnotes gives
    a row for each; ``ord`` orders the rows of a page.
    """
    line = lines_of(spans)
    weight = spans.groupBy("doc", "page", "block", "size", "font").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("line", "span")).alias("at"))
    main = weight.groupBy("doc", "page", "block").agg(F.min(F.struct((-F.col("n")).alias("less"), "at", "size", "font")).alias("m")).select("doc", "page", "block", F.col("m.size").alias("size"), F.col("m.font").alias("font"))
    block = line.groupBy("doc", "page", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "\n").alias("text"), F.min(F.struct("line", F.col("raised").isNotNull().alias("raised")))["raised"].alias("raised"), F.min("y").alias("y"))
    b = block.withColumn("text", T.strip(T.normalize_ligatures(F.col("text")))).filter("text <> ''").filter(~T.is_boilerplate(F.col("text"), stripped=True))
    if repeated is not None:
        listed = repeated.groupBy("doc").agg(F.collect_set("line").alias("repeated"))
        erased = without_repeated(F.col("text"), F.coalesce("repeated", F.array().cast("array<string>")))
        b = b.join(listed, "doc", "left").withColumn("text", erased).drop("repeated").filter("text <> ''").filter(~T.is_boilerplate(F.col("text"), stripped=True))
    b = b.join(main, ["doc", "page", "block"]).join(profile, "doc")
    c, near = F.col("text"), F.abs(F.col("size") - F.col("body_size")) < 1.5
    nth = F.array_position(F.transform("heading_sizes", lambda s: F.abs(s - F.col("size")) < 1), True)
    footnote = F.col("raised") | ((F.col("footnote_size") > 0) & (F.abs(F.col("size") - F.col("footnote_size")) < 1) & (F.col("y") > 0.4 * page_height))
    level = (
        F.when((F.col("size") > F.col("body_size") + 1) & (F.length(c) < 200), F.when(nth > 0, F.least(nth, F.lit(3))).otherwise(1))
        .when(T.is_all_caps_heading(c, stripped=True) & near, 2)
        .when(F.array_contains("heading_fonts", F.col("font")) & near & (F.length(c) < 120) & ~c.contains("\n"), 2)
    )
    kind = F.when(level.isNotNull(), "heading").when(footnote, "footnote").when(T.is_caption(c), "caption").otherwise("body")
    ordinal = lambda part: F.col("block").cast("long") * 65536 + part
    known = b.select("doc", "page", "block", kind.alias("kind"), level.cast("int").alias("level"), "text")
    notes = known.filter("kind = 'footnote'").select("doc", "page", "block").join(footnote_parts(line), ["doc", "page", "block"])
    notes = notes.select("doc", "page", ordinal(F.col("part")).alias("ord"), F.lit("footnote").alias("kind"), F.lit(None).cast("int").alias("level"), "footnote", "text")
    rest = known.filter("kind <> 'footnote'").select("doc", "page", ordinal(F.lit(0)).alias("ord"), "kind", "level", F.lit(None).cast("string").alias("footnote"), "text")
    # Lines of a word or two in a body are set as prose.
    body = rest.filter("kind = 'body'").withColumn("place", F.struct("page", "ord"))
    prose = rejoin_lines(body.select("doc", F.col("place").alias("page"), "text")).select("doc", "page.*", F.lit("body").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("footnote"), "text")
    return rest.filter("kind <> 'body'").unionByName(prose).unionByName(notes)


def segments(spans: DataFrame, profile: DataFrame, page_height: float = 800.0, repeated: DataFrame | None = None) -> DataFrame:
    """Blocks of pages with layout, footnotes that go on in the next block joined."""
    return merge_footnotes(classify(spans, profile, page_height, repeated))


def blocks_of_pages(pages: DataFrame, spans: DataFrame | None = None, page_height: float = 800.0, repeated: DataFrame | None = None) -> DataFrame:
    """Blocks of all pages: those with spans by their layout, the others by their text; pages without text give none."""
    full = pages.filter(T.strip(F.col("text")) != "")
    if spans is None:
        return text_segments(full)
    laid_out = spans.select("doc", "page").distinct()
    of_layout = segments(spans.join(full.select("doc", "page"), ["doc", "page"], "left_semi"), font_profile(spans), page_height, repeated)
    return of_layout.unionByName(text_segments(full.join(laid_out, ["doc", "page"], "left_anti")).withColumn("ord", F.col("ord").cast("long")))
