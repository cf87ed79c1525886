"""From pages to the chapters of a book, and a volume's index to links: what the command line runs."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T
from foliolake.operators import asked, chapters, index, layout, pages, splitter
from foliolake.sources import files, scans


def assemble(of: DataFrame, spans: DataFrame | None = None, ordered: bool = True, ask: Callable[[str], str] | None = None) -> DataFrame:
    """Pages (``doc, page, text`` and maybe ``number``) to chapters as Markdown: ``doc, chapter, title, markdown``.

    Signs are normalised, running lines go; pages that come without order are cleared of duplicates and sorted by their
    numbers; blocks become chapters, whose footnotes, references and broken sentences are put right, in this order.
    """
    of = of.withColumn("text", T.normalize_ligatures(F.col("text")))
    running = pages.repeated_lines(of).select("doc", "line").unionByName(pages.boilerplate_lines(of)).distinct()
    clean = pages.without_lines(of, running)
    if "number" in of.columns:
        clean = clean.join(of.select("doc", "page", "number"), ["doc", "page"])
    if not ordered:
        first = pages.first_of_equal(clean).select("doc", "page")
        kept = pages.fuzzy_dedup(clean.join(first, ["doc", "page"], "left_semi"))
        numbers = clean.select("doc", "page", F.col("number") if "number" in clean.columns else F.lit(None).cast("int").alias("number"))
        kept = kept.join(numbers, ["doc", "page"])
        if ask is not None:
            kept = asked.page_numbers(kept, ask)
        clean = pages.reorder(kept)
        clean = clean.withColumn("page", F.col("order"))
    blocks = layout.blocks_of_pages(clean.select("doc", "page", "text"), spans, repeated=running if spans is not None else None)
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))
    blocks = blocks.withColumn("ord", nth)
    placed = chapters.assigned(blocks)
    titles = placed.select("doc", "chapter", "title").distinct()
    placed = placed.filter("NOT in_title").drop("in_title")
    body = chapters.merge_bodies(chapters.link_footnotes(placed).filter("kind <> 'reference'"))
    return chapters.render(body, chapters.footnotes(placed), chapters.bibliography(placed), titles)


def _named(shown: DataFrame, name: str) -> DataFrame:
    return shown.withColumn("doc", F.lit(name))


def text_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with a text file for each page, in the order of names."""
    read = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    nth = F.row_number().over(Window.orderBy("path")) - 1  # one book
    return read.select(F.lit(folder).alias("doc"), nth.alias("page"), "text")


def process(spark: SparkSession, path: str, settings: files.Settings, force: bool = False, parser=scans.parse_pdf, decode=scans.decode_image, engine=None, rasterise=None, ask=None) -> list[str]:
    """A PDF, a folder of screenshots or one of page texts to chapter files; returns their paths.

    Sources whose files are as they were when they were assembled are left alone unless ``force`` is set.
    """
    cache = settings.paths["cache_dir"]
    manifest = files.load_manifest(spark, cache)
    listed = files.list_files(spark, path, recursive=True)
    at = files.hadoop(spark, path)
    full = at[0].makeQualified(at[1]).toString()
    if full.lower().endswith(".pdf"):
        hashed = files.file_hashes(spark, [path]).select(F.lit(full).alias("path"), "file_hash")
    else:
        hashed = files.folder_hashes(listed.withColumn("root", F.lit(full)))
    hashed = spark.createDataFrame(hashed.collect(), hashed.schema)  # one row
    if not force and files.pending(hashed, manifest).isEmpty():
        return []
    name = posixpath.basename(full.rstrip("/"))
    spans, ordered = None, True
    if full.lower().endswith(".pdf"):
        name = name[:-4]
        found = scans.contents(spark, path)
        if engine is not None and rasterise is not None:
            limits = settings.extraction
            of = scans.auto_pages(found, parser, rasterise, engine, limits["pymupdf_min_chars"], limits["gibberish_threshold"])
        else:
            of = scans.pdf_pages(found, parser)
        spans = scans.spans_of(of).withColumn("doc", F.lit(name))
        spans = None if spans.isEmpty() else spans
    elif files.screenshot_folders(listed).isEmpty():
        of = text_pages(spark, path)
    else:
        shown = files.images(scans.contents(spark, path))
        known = scans.is_capture(scans.is_spread(scans.shapes(shown, decode))).cache()
        kind = known.first()
        ordered = kind.is_spread or kind.is_capture
        if engine is None:
            raise ValueError("screenshots need a recognition engine")
        of = scans.screenshot_pages(shown, known, scans.in_batches(engine), decode, spread=kind.is_spread)
    if of.isEmpty():
        return []
    of = _named(of, name).select("doc", "page", "text", *(["number"] if "number" in of.columns else []))
    written = files.write_markdown(assemble(of, spans, ordered, ask), settings.paths["output_dir"])
    done = hashed.withColumn("output_path", F.lit(posixpath.dirname(written[0]) if written else None).cast("string"))
    for stage in ("extract", "order", "classify", "assemble", "output"):
        manifest = files.mark_stage(manifest, done, stage)
    files.save_manifest(manifest, cache)
    return written


def run(spark: SparkSession, settings: files.Settings, force: bool = False, **options) -> list[str]:
    """All sources of the settings."""
    out = []
    for r in files.scan(spark, settings.paths["local_pdf_dirs"]).collect():  # names of sources
        out += process(spark, r.path, settings, force, **options)
    return out


def link_index(spark: SparkSession, volume: str) -> str | None:
    """Links the index of a volume's folder to its chapters; returns the file, or None without an index or chapters.

    The index as it was is kept beside the linked one and read ever after, so linking again gives the same.
    """
    found = files.markdown_chapters(spark, volume).withColumn("volume", F.lit("v"))
    with_pages = found.filter("page_start IS NOT NULL")
    pageless = with_pages.isEmpty()
    if pageless and found.isEmpty():
        return None
    named = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "chapter_*.md").load(volume).select("path")
    at = files.index_file(named).first()
    if at is None:
        return None
    original = at.path.removesuffix(".md") + ".orig.md"
    if not files.exists(spark, original):
        files.put(spark, original, files.read(spark, at.path))
    text = spark.read.text(original, wholetext=True).select(F.lit("v").alias("volume"), F.col("value").alias("text"))
    shown = index.linked_index(index.parse_index(text), found if pageless else with_pages, pageless).first()
    if shown is None:
        return None
    files.put(spark, at.path, shown.markdown)
    return at.path


def split(spark: SparkSession, path: str, folder: str | None = None, artifacts: bool = False) -> list[str]:
    """Splits a book in one Markdown file into folders of chapters; its old folder is set aside if they lie beside it."""
    at = files.hadoop(spark, path)[1]
    own = at.getParent()
    out = folder or own.getParent().toString()
    read = spark.read.text(path, wholetext=True).select(F.lit(path).alias("doc"), F.posexplode(T.lines(F.col("value"))).alias("line_no", "line"))
    written = files.write_split(splitter.split(read, splitter.boundaries(read, artifacts)), out)
    fs, target = files.hadoop(spark, f"{own.toString()}.orig")
    if written and fs.makeQualified(own.getParent()).toString() == fs.makeQualified(files.hadoop(spark, out)[1]).toString() and not fs.exists(target):
        fs.rename(own, target)
    return written


def catalogue(spark: SparkSession, results: str) -> DataFrame:
    """The chapters of all volumes under a folder."""
    from foliolake.operators import library

    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "chapter_*.md").text(results, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = read.select(F.element_at(parts, -3).alias("volume"), F.element_at(parts, -2).alias("dir_name"), F.array_join(F.slice(parts, -4, 4), "/").alias("path"), F.col("value").alias("text"))
    return library.folder_catalogue(named.filter(~F.col("volume").startswith(".") & ~F.col("path").endswith(".orig.md")))
