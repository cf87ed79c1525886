"""Sources and sinks: folders of PDFs and images, Markdown volumes, settings, the manifest of finished stages.

Files are found, read and written through Spark and Hadoop, so any file system they know will do.
"""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T

IMAGE = r"(?i)\.(png|jpe?g|tiff|bmp|webp)$"
MANIFEST = "path string, file_hash string, stages array<string>, output_path string, last_processed string"


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and moved there."""
    fs, at = hadoop(spark, path)
    fs.mkdirs(at.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} could not be written")


def read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def list_files(spark: SparkSession, folder: str | list[str], recursive: bool = False) -> DataFrame:
    """``path, folder, name, length`` of the files of a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length")


def pdfs(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("name").endswith(".pdf"))


def screenshot_folders(files: DataFrame) -> DataFrame:
    return files.filter(F.col("name").rlike(IMAGE)).groupBy("folder").agg(F.count("*").alias("images"))


def images(files: DataFrame) -> DataFrame:
    """Image files with their ``place`` (from 0) in the order of names in a folder."""
    place = F.row_number().over(Window.partitionBy("folder").orderBy("name")) - 1
    return files.filter(F.col("name").rlike(IMAGE)).withColumn("place", place)


def scan(spark: SparkSession, sources: Iterable[str]) -> DataFrame:
    """``kind, path`` of the PDFs and screenshot folders right under the sources, in order; missing sources are skipped.

    A source may be a PDF itself.
    """
    found = None
    for source in sources:
        at = os.path.expanduser(source)
        if not exists(spark, at):
            continue
        own = pdfs(list_files(spark, at)).select(F.lit("pdf").alias("kind"), "path")
        if not at.lower().endswith(".pdf"):
            # Files one level down tell which folders hold screenshots.
            below = [c.getPath().toString() for c in hadoop(spark, at)[0].listStatus(hadoop(spark, at)[1]) if c.isDirectory()]
            if below:
                own = own.unionByName(screenshot_folders(list_files(spark, below)).select(F.lit("screenshots").alias("kind"), F.col("folder").alias("path")))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "kind string, path string")
    return found.distinct().orderBy("kind", "path")


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, file_hash`` of files, by their bytes."""
    read_ = spark.read.format("binaryFile").load(paths)
    return read_.select("path", F.sha2("content", 256).alias("file_hash"))


def folder_hashes(files: DataFrame) -> DataFrame:
    """``path, file_hash`` of folders by the names and sizes of all files in them; ``files``: ``root, path, length``."""
    relative = F.substring("path", F.length("root") + 2, F.length("path"))
    each = F.struct(relative.alias("name"), F.col("length").cast("string").alias("length"))
    one = files.groupBy(F.col("root").alias("path")).agg(F.array_sort(F.collect_list(each)).alias("files"))
    return one.select("path", F.sha2(F.array_join(F.transform("files", lambda f: F.concat(f["name"], f["length"])), ""), 256).alias("file_hash"))


def markdown_chapters(spark: SparkSession, volume: str) -> DataFrame:
    """``dir_name, page_start, page_end, paths, file, text`` of a volume's chapter folders; null pages where the name has none.

    Folders of an index, hidden and archived ones are left out; ``file`` is the last file's name, which links lead to.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "chapter_*.md").text(volume, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    named = files.withColumn("dir_name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).filter(~F.lower("dir_name").contains("index") & ~F.col("dir_name").rlike(r"^\.|\.orig$"))
    page = lambda g: F.expr(f"try_cast(regexp_extract(dir_name, '_pp_([0-9]+)_([0-9]+)_', {g}) AS int)")
    ordered = F.array_sort(F.collect_list(F.struct("path", "value")))
    return named.groupBy("dir_name").agg(ordered["path"].alias("paths"), F.array_join(ordered["value"], "\n").alias("text")).select("dir_name", page(1).alias("page_start"), page(2).alias("page_end"), "paths", F.regexp_extract(F.element_at("paths", -1), "[^/]*$", 0).alias("file"), "text")


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``path, file_hash``) that the manifest does not list as assembled with the same hash."""
    done = manifest.filter(F.array_contains("stages", "assemble")).select("path", "file_hash")
    return files.join(done, ["path", "file_hash"], "left_anti")


def completed(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, stages`` of files (``path, file_hash``) that are as they were; none for others."""
    met = files.select("path", "file_hash").join(manifest.select("path", "file_hash", "stages"), ["path", "file_hash"], "left")
    return met.select("path", F.coalesce("stages", F.array().cast("array<string>")).alias("stages"))


def mark_stage(manifest: DataFrame, files: DataFrame, stage: str) -> DataFrame:
    """The manifest after a stage of files (``path, file_hash`` and maybe ``output_path``); stages are kept, hash and time are new."""
    place = F.col("output_path") if "output_path" in files.columns else F.lit(None).cast("string")
    new = files.select("path", F.col("file_hash").alias("new_hash"), place.alias("new_output"))
    both = manifest.join(new, "path", "full_outer")
    marked, none = F.col("new_hash").isNotNull(), F.array().cast("array<string>")
    stages = F.when(marked, F.array_union(F.coalesce("stages", none), F.array(F.lit(stage)))).otherwise(F.col("stages"))
    known = lambda c: F.col(c) if c in manifest.columns else F.lit(None).cast("string")
    time = F.when(marked, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(known("last_processed"))
    return both.select("path", F.coalesce("new_hash", "file_hash").alias("file_hash"), stages.alias("stages"), F.coalesce("new_output", known("output_path")).alias("output_path"), time.alias("last_processed"))


def index_file(paths: DataFrame) -> DataFrame:
    """The file of a volume's index: ``path``, no row without one; ``paths``: ``path`` of all chapter files.

    The first folder with "index" in its name that has files; in it the first file named so, else the last one.
    """
    named = paths.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    own = named.filter(F.lower("dir").contains("index") & F.col("name").rlike(r"^chapter_.*\.md$") & ~F.col("name").endswith(".orig.md"))
    by_dir = own.groupBy("dir").agg(F.min(F.when(F.col("name").rlike("index"), F.struct("name", "path"))).alias("first"), F.max(F.struct("name", "path")).alias("last"))
    return by_dir.orderBy("dir").limit(1).select(F.coalesce("first.path", "last.path").alias("path"))


def load_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What stages are done: ``path, file_hash, stages, output_path, last_processed``; empty where there is none yet."""
    if not exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def save_manifest(manifest: DataFrame, folder: str) -> None:
    """Written beside the old one, which it then replaces; may be computed from it."""
    spark = manifest.sparkSession
    new = f"{folder}/manifest-{uuid.uuid4().hex}"
    columns = [F.col(f.name) if f.name in manifest.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], MANIFEST).schema]
    manifest.select(*columns).write.json(new)
    fs, old = hadoop(spark, f"{folder}/manifest")
    fs.delete(old, True)
    if not fs.rename(hadoop(spark, new)[1], old):
        raise OSError(f"{folder}/manifest could not be replaced")


def clear_manifest(spark: SparkSession, folder: str) -> None:
    fs, at = hadoop(spark, f"{folder}/manifest")
    fs.delete(at, True)


def status(manifest: DataFrame) -> DataFrame:
    return manifest.select("path", F.array_join("stages", ", ").alias("stages"))


def write_files(rows: DataFrame, folder: str) -> list[str]:
    """Writes each row (``dir, file, text``) as the text file ``folder/dir/file``, ended by a line end; returns the paths.

    Executors write all texts beside the folder; the driver only moves files.  Other files in the folder stay.
    """
    spark = rows.sparkSession
    staging = f"{folder}/.staging-{uuid.uuid4().hex}"
    ends = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n$", "")
    rows.select("dir", "file", ends.alias("value")).write.partitionBy("dir", "file").option("lineSep", "\n").text(staging)
    fs, at = hadoop(spark, staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    written, walk = [], fs.listFiles(at, True)
    while walk.hasNext():
        part = walk.next().getPath()
        if not part.getName().startswith("part-"):
            continue
        file = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part.getParent().getName().partition("=")[2])
        dir_ = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part.getParent().getParent().getName().partition("=")[2])
        target = path(f"{folder}/{dir_}/{file}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"{target.toString()} could not be written")
        written.append(target.toString())
    fs.delete(at, True)
    return sorted(written)


def write_markdown(chapters: DataFrame, folder: str) -> list[str]:
    """``doc, chapter, title, markdown`` as ``slug of doc/chapter_NN_slug.md``, numbered from 1 in the order of chapters."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("chapter"))
    named = chapters.withColumn("nth", nth).select(T.slugify(F.col("doc").cast("string")).alias("dir"), F.format_string("chapter_%02d_%s.md", "nth", T.slugify(F.col("title"))).alias("file"), F.col("markdown").alias("text"))
    return write_files(named, folder)


def write_split(chapters: DataFrame, folder: str) -> list[str]:
    """Chapters from the splitter, a folder each."""
    return write_files(chapters, folder)


def write_catalogue(books: DataFrame, path: str) -> tuple[int, int]:
    """The catalogue file from ``volume, json`` rows, a book at a time; returns the numbers of books and chapters."""
    listed = [json.loads(r.json) for r in books.orderBy("volume").toLocalIterator()]
    put(books.sparkSession, path, json.dumps({"books": listed}, indent=2, ensure_ascii=False))
    return len(listed), sum(len(b["chapters"]) for b in listed)


def repair_private_use(spark: SparkSession, folder: str) -> list[str]:
    """Rewrites the Markdown files under a folder that hold private-use signs; returns their paths."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    odd = texts.filter(F.col("value").rlike(f"[{T.PRIVATE[0]}-{T.PRIVATE[-1]}]")).select(F.col("_metadata.file_path").alias("path"), T.fix_private_use(F.col("value")).alias("text"))
    done = []
    for r in odd.toLocalIterator():  # a file at a time, only those that change
        put(spark, r.path, r.text)
        done.append(r.path)
    return sorted(done)


def _default(**values):
    return field(default_factory=lambda: dict(values))


@dataclass
class Settings:
    """Defaults by section; unknown sections and names in a file are ignored."""

    paths: dict = _default(google_drive_remote="gdrive:Books/Libby", local_pdf_dirs=["~/Papers", "~/Books"], output_dir="./results", cache_dir="./.foliolake_cache")
    rclone: dict = _default(flags=["--progress", "--transfers=4"])
    llm: dict = _default(base_url="http://localhost:11434", model="llama3.1:8b", timeout=120, max_retries=3)
    extraction: dict = _default(pymupdf_min_chars=100, gibberish_threshold=0.3)
    processing: dict = _default(batch_size=5)

    @classmethod
    def load(cls, path: str | Path = "config.toml") -> Settings:
        out = cls()
        if Path(path).exists():
            given = tomllib.loads(Path(path).read_text())
            for f in fields(out):
                own = getattr(out, f.name)
                own.update({k: v for k, v in given.get(f.name, {}).items() if k in own})
        return out
