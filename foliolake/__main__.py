"""Command line: ``python -m foliolake search TERM --output-dir DIR`` and the like."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliolake.operators import asked, index, library, pages
from foliolake.plans import books
from foliolake.sources import files


def lines_of(spark: SparkSession, folder: str, pattern: str):
    """``volume, path, line_no, line`` of the Markdown files under a folder; ``path`` is relative to the volume."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    parts = F.split(F.replace(F.col("_metadata.file_path"), F.lit("file://")), "/")
    named = read.select(F.element_at(parts, -3).alias("volume"), F.array_join(F.slice(parts, -2, 2), "/").alias("path"), "value")
    return named.filter(~F.col("path").endswith(".orig.md")).select("volume", "path", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))


def search(spark, args, settings) -> None:
    """Search for a term across the indexes of all volumes."""
    lines = lines_of(spark, args.output_dir or settings.paths["output_dir"], "*.md")
    texts = lines.groupBy("volume", "path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    hits = index.search(lines.filter(F.lower("path").contains("index")), texts, args.term, args.context)
    shown = index.formatted(hits).orderBy("volume", "path").select("shown")
    found = False
    for r in shown.toLocalIterator():
        found = True
        print(r.shown, end="\n\n")
    if not found:
        print(f"No results found for '{args.term}'.")


def split(spark, args, settings) -> None:
    """Split a book in one Markdown file into folders of chapters."""
    written = books.split(spark, args.path, args.output_dir, args.artifacts)
    print(f"Split into {len(written)} chapters:" if written else "No chapters detected.")
    for path in written:
        print(f"  {path}")


def scan(spark, args, settings) -> None:
    """List the PDFs and screenshot folders of a folder."""
    for r in files.scan(spark, [args.path]).toLocalIterator():
        print(r.path)


def segments(spark, args, settings) -> None:
    """Plain-text pages, a file each, as blocks in Parquet."""
    read = spark.read.text(args.path, wholetext=True)
    page = read.select(F.lit(args.path).alias("doc"), F.col("_metadata.file_path").alias("page"), F.col("value").alias("text"))
    pages.segments(page).write.mode("overwrite").parquet(args.output_dir or settings.paths["output_dir"])


def process(spark, args, settings) -> None:
    """Process a PDF, a folder of screenshots or one of page texts."""
    if args.output_dir:
        settings.paths["output_dir"] = args.output_dir
    if args.model:
        settings.llm["model"] = args.model
    print(f"Processing: {args.path}")
    for path in books.process(spark, args.path, settings, args.force):
        print(f"  Written: {path}")


def run(spark, args, settings) -> None:
    """Process all sources of the settings."""
    written = books.run(spark, settings, args.force)
    print(f"Processed {len(written)} chapters total.")
    for path in written:
        print(f"  {path}")


def status(spark, args, settings) -> None:
    """Show what stages are done."""
    rows = files.status(files.load_manifest(spark, settings.paths["cache_dir"])).orderBy("path").collect()  # a row per source
    for r in rows:
        print(f"  {r.path}: {r.stages}")
    if not rows:
        print("No files processed yet.")


def clean(spark, args, settings) -> None:
    """Forget what was done."""
    files.clear_manifest(spark, settings.paths["cache_dir"])
    print("Cache cleared.")


def sync(spark, args, settings) -> None:
    """Copy the remote folder of the settings."""
    folder = f"{settings.paths['output_dir'].rstrip('/')}/../synced"
    asked.sync(settings.paths["google_drive_remote"], folder, settings.rclone["flags"])
    print(f"Synced to {folder}")


def link_index(spark, args, settings) -> None:
    """Link the index of a volume to its chapters."""
    done = books.link_index(spark, args.path)
    print(f"Index linked: {done}" if done else "No index chapter found or no chapter directories available.")


def build_library(spark, args, settings) -> None:
    """Write the catalogue of all volumes."""
    results = args.output_dir or settings.paths["output_dir"]
    path = f"{results.rstrip('/')}/library.json"
    n = files.write_catalogue(library.library_json(books.catalogue(spark, results)), path)
    print(f"Generated {path}: {n[0]} books, {n[1]} chapters")


def fix_signs(spark, args, settings) -> None:
    """Rewrite Markdown files that hold private-use signs."""
    print(f"Fixed {len(files.repair_private_use(spark, args.path))} files")


#: By command: what it runs, its argument, and its options.
COMMANDS = {
    "search": (search, "term", ("--output-dir", "--context")),
    "split": (split, "path", ("--output-dir", "--artifacts")),
    "scan": (scan, "path", ()),
    "segments": (segments, "path", ("--output-dir",)),
    "process": (process, "path", ("--output-dir", "--force", "--model")),
    "run": (run, None, ("--force",)),
    "status": (status, None, ()),
    "clean": (clean, None, ()),
    "sync": (sync, None, ()),
    "link-index": (link_index, "path", ()),
    "library": (build_library, None, ("--output-dir",)),
    "fix-signs": (fix_signs, "path", ()),
}
OPTIONS = {
    "--output-dir": (("--output-dir",), {}),
    "--context": (("--context", "-c"), {"type": int, "default": 0}),
    "--artifacts": (("--artifacts",), {"action": "store_true"}),
    "--force": (("--force",), {"action": "store_true"}),
    "--model": (("--model",), {}),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliolake", description=__doc__)
    parser.add_argument("--config", default="config.toml")
    commands = parser.add_subparsers(required=True)
    for name, (what, argument, options) in COMMANDS.items():
        p = commands.add_parser(name, help=what.__doc__)
        if argument:
            p.add_argument(argument)
        for o in options:
            names, how = OPTIONS[o]
            p.add_argument(*names, **how)
        p.set_defaults(run=what)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("foliolake").getOrCreate(), args, files.Settings.load(args.config))


if __name__ == "__main__":
    main()
