"""Library catalogue: titles, word counts, duplicate chapters, reading progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T

# Folders that hold no chapters, by name and by a part of it.
SKIP_NAMES = ("acknowledgments", "contents", "copyright_page", "general_editors_preface", "illustrations", "index", "notes_on_contributors")
SKIP_PARTS = ("frontmatter", "copyright", "contents", "illustrations", "notes_on_contributors", "general_editors_preface", "acknowledgments")
WORDS_PER_MINUTE = 220


def is_content_folder(name: Column) -> Column:
    """Whether a folder of a volume is a chapter for the catalogue."""
    hidden = name.startswith(".") | name.endswith(".orig") | name.isin(*SKIP_NAMES)
    for part in SKIP_PARTS:
        hidden = hidden | F.contains(name, F.lit(part))
    return ~hidden


def title(markdown: Column) -> Column:
    """The first level-1 heading unless it is a number; else the first level-3 heading with the lines in capitals after it."""
    of = F.transform(T.lines(markdown), T.strip)
    first = T.strip(F.substring(F.get(F.filter(of, lambda line: line.startswith("# ")), 0), 3, 1 << 20))
    at = F.array_position(F.transform(of, lambda line: line.startswith("### ")), True).cast("int")
    rest = F.slice(of, at + 1, F.size(of))
    goes_on = lambda line: (line != "") & ((F.upper(line) == line) | line.startswith('"')) & ~line.startswith("#")
    last = F.array_position(F.transform(rest, goes_on), False).cast("int")
    more = F.slice(rest, F.lit(1), F.when(last > 0, last - 1).otherwise(F.size(rest)))
    whole = F.array_join(F.concat(F.array(T.strip(F.substring(F.get(of, at - 1), 5, 1 << 20))), more), " ")
    return F.when(first.isNotNull() & (first != "") & ~first.rlike(r"^\p{Nd}+$"), first).when(at > 0, whole).otherwise(first)


def catalogue(chapters: DataFrame) -> DataFrame:
    """``volume, chapter, title, words, words_before``; ``chapters``: ``volume, chapter, text``.

    Of chapters with equal text in a volume the first stays.  Words before a chapter are a running sum over one narrow
    row per chapter.
    """
    first = chapters.groupBy("volume", F.sha2("text", 256).alias("hash")).agg(F.min("chapter").alias("chapter")).drop("hash")
    kept = chapters.join(first, ["volume", "chapter"], "left_semi")
    counted = kept.select("volume", "chapter", title(F.col("text")).alias("title"), T.count_words(T.body(F.col("text"))).cast("long").alias("words"))
    before = Window.partitionBy("volume").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0)))


def books(listed: DataFrame) -> DataFrame:
    return listed.groupBy("volume").agg(F.count("*").alias("chapters"), F.sum("words").alias("words"), (F.sum("words") / WORDS_PER_MINUTE).alias("minutes"))


def folder_catalogue(files: DataFrame) -> DataFrame:
    """``volume, dir_name, title, path, paths, words``; ``files``: ``volume, dir_name, path, text`` of chapter files.

    Folders without content and, in a volume, folders with the text of an earlier one are left out.  The title is that of
    the last file, or the folder's name; ``paths`` is null for a single file.
    """
    listed = files.filter(is_content_folder(F.col("dir_name"))).withColumn("words", T.count_words(T.body(F.col("text"))).cast("long"))
    listed = listed.withColumn("title", title(F.col("text"))).withColumn("digest", F.sha2("text", 256))
    # Files meet by digests and titles; texts stay where they are.
    in_order = F.array_sort(F.collect_list(F.struct("path", "digest", "title")))
    one = listed.groupBy("volume", "dir_name").agg(in_order.alias("files"), F.sum("words").alias("words"))
    one = one.withColumn("digest", F.sha2(F.array_join("files.digest", ""), 256))
    first = F.min("dir_name").over(Window.partitionBy("volume", "digest"))
    kept = one.withColumn("first", first).filter("dir_name = first")
    named = F.element_at("files", -1)["title"]
    return kept.select(
        "volume", "dir_name", F.when(F.coalesce(named, F.lit("")) == "", T.prettify_dir_name(F.col("dir_name"))).otherwise(named).alias("title"),
        F.get("files.path", F.lit(0)).alias("path"), F.when(F.size("files") > 1, F.col("files.path")).alias("paths"), "words",
    )


def library_json(listed: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row per book with its entry of the catalogue file as JSON: ``volume, json``.  ``names``: titles of volumes."""
    name = T.prettify_dir_name(F.col("volume"))
    for volume, known in (names or {}).items():
        name = F.when(F.col("volume") == volume, known).otherwise(name)
    chapter = F.struct(F.col("dir_name").alias("id"), "title", "path", "paths", "words")
    book = listed.groupBy("volume").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"), F.sum("words").alias("words"))
    return book.select("volume", F.to_json(F.struct(F.col("volume").alias("id"), name.alias("title"), "chapters", "words"), {"ignoreNullFields": "false"}).alias("json"))


def page_count(scroll_width: Column, width: Column, gap: int = 48) -> Column:
    """Pages that a chapter takes on a screen."""
    return F.greatest(F.lit(1), F.ceil(scroll_width / (width + gap)))


def page_at(share: Column, pages: Column) -> Column:
    """The page (from 0) at a share of a chapter."""
    return F.floor(share * (pages - 1) + 0.5)


def word_interval(speed: Column) -> Column:
    """Milliseconds that a word is shown for in playback."""
    return F.lit(60000.0) / WORDS_PER_MINUTE / speed


def word_tokens(text: Column) -> Column:
    """The words of a chapter's body in reading order, with the white space between them."""
    return F.filter(F.regexp_extract_all(T.body(text), F.lit(r"(?U)(\s+|\S+)"), F.lit(1)), lambda t: t != "")


def progress(listed: DataFrame, volume: str, chapter, share: float) -> DataFrame:
    """Words read and the share of the book at ``share`` of a chapter."""
    read = F.floor(F.col("words") * share + 0.5) + F.col("words_before")
    total = listed.filter(F.col("volume") == volume).agg(F.sum("words").alias("total"))
    return listed.filter((F.col("volume") == volume) & (F.col("chapter") == chapter)).crossJoin(total).select("volume", "chapter", read.alias("read"), (read / F.col("total")).alias("share"))
