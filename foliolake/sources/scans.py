"""Pages from PDFs and screenshots.

Parsers, decoders and recognition engines come from outside and are plain functions, so tests and clusters may bring
their own:

* a parser maps the bytes of a PDF to pages ``(text, height, spans)`` with spans ``(block, line, span, text, size, font, y)``;
* a rasteriser maps them to images; a decoder maps the bytes of an image to an array ``(height, width, 3)``;
* an engine maps a list of images to ``(text, confidence, line_count)`` each.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.operators import ocr, pages

SPANS = "array<struct<block: int, line: int, span: int, text: string, size: double, font: string, y: double>>"
PAGE = f"doc string, page int, text string, method string, number int, height double, spans {SPANS}"
RESULT = "doc string, page int, text string, method string, confidence double, line_count int"


def available(*names: str) -> list[str]:
    """The modules of those named that are installed."""
    return [n for n in names if importlib.util.find_spec(n)]


def parse_pdf(data: bytes):
    """The parser of an installed PDF library."""
    if not available("fitz"):
        raise ModuleNotFoundError("reading PDFs needs PyMuPDF, or a parser of your own")
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        for page in doc:
            spans = []
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                for k, line in enumerate(block.get("lines", [])):
                    spans += [(b, k, s, x["text"], round(x["size"], 1), x["font"], float(block["bbox"][1])) for s, x in enumerate(line["spans"])]
            yield page.get_text(), float(page.rect.height), spans


def decode_image(data: bytes) -> np.ndarray:
    if not available("PIL"):
        raise ModuleNotFoundError("reading images needs Pillow, or a decoder of your own")
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def contents(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """``path, folder, name, content`` of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")


def pdf_pages(files: DataFrame, parser: Callable = parse_pdf, default_height: float = 800.0) -> DataFrame:
    """A row per page of PDFs (``path, content``), numbered from 1."""

    def run(frames):
        import pandas as pd  # on the executors only, which keeps it out of the driver's memory

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                rows = [(path, i, text, "text", i + 1, float(height or default_height), spans) for i, (text, height, spans) in enumerate(parser(bytes(content)))]
                yield pd.DataFrame(rows, columns=["doc", "page", "text", "method", "number", "height", "spans"])

    return files.select("path", "content").mapInPandas(run, PAGE)


def spans_of(parsed: DataFrame) -> DataFrame:
    """The spans of parsed pages as rows for the layout operators."""
    return parsed.select("doc", "page", F.explode("spans").alias("s")).select("doc", "page", "s.*")


def auto_pages(files: DataFrame, parser: Callable, rasterise: Callable, engine: Callable, least_chars: int = 100, most_odd: float = 0.3) -> DataFrame:
    """Pages of PDFs: by their text where the first pages hold enough of it, else recognised from images of the pages."""
    parsed = pdf_pages(files, parser)
    digital = pages.is_digital(parsed, least_chars, most_odd).filter("digital").select("doc")

    def run(frames):
        import pandas as pd  # on the executors only, which keeps it out of the driver's memory

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                found = engine(list(rasterise(bytes(content))))
                rows = [(path, i, text, "recognised", i + 1, None, None) for i, (text, _, _) in enumerate(found)]
                yield pd.DataFrame(rows, columns=["doc", "page", "text", "method", "number", "height", "spans"])

    scanned = files.join(digital.withColumnRenamed("doc", "path"), "path", "left_anti").select("path", "content")
    return parsed.join(digital, "doc", "left_semi").unionByName(scanned.mapInPandas(run, PAGE))


def crop(image: np.ndarray, bounds) -> np.ndarray:
    """The part inside (left, top, right, bottom)."""
    left, top, right, bottom = bounds
    return image[top:bottom, left:right]


def halves(image: np.ndarray) -> list[np.ndarray]:
    middle = image.shape[1] // 2
    return [image[:, :middle], image[:, middle:]]


def columns_of(image: np.ndarray, columns) -> list[np.ndarray]:
    return [image[:, a:b] for a, b in columns]


def shapes(images: DataFrame, decode: Callable = decode_image, sample: int = 8) -> DataFrame:
    """A row per folder of images (``folder, place, content``): what they are.

    ``folder, images, width, height`` (null where sizes differ or an image cannot be read), ``bounds`` (left, top, right,
    bottom of what changes; null where nothing is to be cropped), ``columns`` (their left and right edges inside the bounds).
    Sizes are taken of all images, pixels of an even sample of at most ``sample``.
    """

    def sizes(frames):
        import pandas as pd  # on the executors only, which keeps it out of the driver's memory

        for f in frames:
            rows = []
            for folder, content in zip(f["folder"], f["content"]):
                try:
                    h, w = decode(bytes(content)).shape[:2]
                    rows.append((folder, w, h))
                except Exception:  # a file that is no image is one of unknown size
                    rows.append((folder, None, None))
            yield pd.DataFrame(rows, columns=["folder", "width", "height"])

    size = F.struct("width", "height")
    by_folder = images.select("folder", "content").mapInPandas(sizes, "folder string, width int, height int").groupBy("folder")
    counted = by_folder.agg(F.count("*").alias("images"), F.min(size).alias("low"), F.max(size).alias("high"), F.count("width").alias("known"))
    same = (F.col("low") == F.col("high")) & (F.col("known") == F.col("images"))
    counted = counted.select("folder", "images", F.when(same, F.col("low.width")).alias("width"), F.when(same, F.col("low.height")).alias("height"))
    # The places of an even sample, the last image included.
    last, n = F.col("total") - 1, F.least(F.col("total"), F.lit(sample))
    total = F.count("*").over(Window.partitionBy("folder"))
    drawn = images.select("folder", "place").withColumn("total", total)
    picked = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.floor(i * last / F.greatest(n - 1, F.lit(1))))
    drawn = drawn.filter(F.array_contains(picked, F.col("place").cast("long"))).select("folder", "place")
    chosen = images.join(drawn, ["folder", "place"], "left_semi")

    def bounds(frame):
        import pandas as pd  # on the executors only, which keeps it out of the driver's memory

        frame, box, columns = frame.sort_values("place"), None, None
        try:
            stack = [decode(bytes(c)) for c in frame["content"]]
        except Exception:
            stack = []
        if len(stack) >= 3 and len({a.shape for a in stack}) == 1:
            stack = np.stack(stack)
            box = ocr.content_bounds(stack)
            inside = stack if box is None else stack[:, box[1] : box[3], box[0] : box[2]]
            columns = [list(c) for c in ocr.column_bounds(inside)]
        return pd.DataFrame([(frame["folder"].iloc[0], None if box is None else list(box), columns)], columns=["folder", "bounds", "columns"])

    found = chosen.select("folder", "place", "content").groupBy("folder").applyInPandas(bounds, "folder string, bounds array<int>, columns array<array<int>>")
    joined = counted.join(found, "folder", "left")
    usable = F.col("width").isNotNull() & (F.col("images") >= 3)
    whole = F.array(F.array(F.lit(0), F.col("width")))
    return joined.select("folder", "images", "width", "height", F.when(usable, F.col("bounds")).alias("bounds"), F.when(usable, F.coalesce("columns", whole)).otherwise(F.when(F.col("width").isNotNull(), whole)).alias("columns"))


def is_spread(known: DataFrame) -> DataFrame:
    """Folders whose images show two pages each: one size, and what changes is half as wide again as high."""
    inner = lambda a, b, whole: F.when(F.col("bounds").isNotNull(), F.element_at("bounds", b) - F.element_at("bounds", a)).otherwise(F.col(whole))
    wide = inner(1, 3, "width") > 1.5 * inner(2, 4, "height")
    return known.withColumn("is_spread", F.coalesce(wide, F.lit(False)))


def is_capture(known: DataFrame) -> DataFrame:
    """Folders of captures of one window, which come in reading order: three images or more, one size, something to crop."""
    return known.withColumn("is_capture", (F.col("images") >= 3) & F.col("width").isNotNull() & F.col("bounds").isNotNull())


def in_batches(engine: Callable, size: int = 16) -> Callable:
    """An engine that gets at most ``size`` images at once."""
    return lambda items: [r for i in range(0, len(items), size) for r in engine(items[i : i + size])]


def by_columns(engine: Callable, columns) -> Callable:
    """An engine for pages with columns: texts are joined by line ends, confidences weighted by lines."""

    def run(items):
        parts = engine([c for image in items for c in columns_of(image, columns)])
        out = []
        for i in range(len(items)):
            own = parts[i * len(columns) : (i + 1) * len(columns)]
            n = sum(p[2] for p in own)
            out.append(("\n".join(p[0] for p in own), sum(p[1] * p[2] for p in own) / n if n else 0.0, n))
        return out

    return run


def with_detection(engine: Callable, boxes: Callable, least: int = 3) -> Callable:
    """An engine that reads only images with enough boxes of text; the others give an empty page."""

    def run(items):
        readable = [boxes(image) >= least for image in items]
        found = iter(engine([image for image, ok in zip(items, readable) if ok]))
        return [next(found) if ok else ("", 0.0, 0) for ok in readable]

    return run


def cascade(stages: list[tuple[Callable, Callable | None]]) -> Callable:
    """An engine of stages ``(engine, good enough?)``: a result that fails its check is replaced by the next stage's."""

    def run(items):
        results, left = [None] * len(items), list(range(len(items)))
        for engine, check in stages:
            if not left:
                break
            for i, r in zip(left, engine([items[i] for i in left])):
                results[i] = r
            left = [] if check is None else [i for i in left if not check(results[i])]
        return results

    return run


def good_result(result, least_confidence: float = 0.6, least_lines: int = 3, most_odd: float = 0.3) -> bool:
    """The gate of a stage: confident, enough lines, few signs that do not print."""
    text, confidence, lines = result
    odd = sum(1 for c in text if not c.isprintable() and c not in "\n\r\t")
    return confidence >= least_confidence and lines >= least_lines and (not text or odd / len(text) <= most_odd)


def default_cascade(engines: dict[str, Callable], last: Callable, columns=None) -> Callable:
    """Of ``engines`` by module name those that are installed, in their order, each behind the gate; ``last`` takes the rest."""
    wrap = (lambda e: by_columns(e, columns)) if columns else (lambda e: e)
    return cascade([(wrap(engines[n]), good_result) for n in available(*engines)] + [(last, None)])


def screenshot_pages(images: DataFrame, known: DataFrame, engine: Callable, decode: Callable = decode_image, spread: bool = False) -> DataFrame:
    """Recognised pages of folders of images (``folder, place, content``) in their order; ``known`` from :func:`shapes`.

    What stands still is cropped.  With ``spread`` an image gives its left and its right half.  An image that cannot be
    read gives an empty page with the method ``failed``.
    """

    def run(frames):
        import pandas as pd  # on the executors only, which keeps it out of the driver's memory

        for f in frames:
            rows, items = [], []
            for folder, place, content, bounds in zip(f["folder"], f["place"], f["content"], f["bounds"]):
                try:
                    image = decode(bytes(content))
                    image = image if bounds is None or spread else crop(image, [int(x) for x in bounds])
                    parts = halves(image) if spread else [image]
                except Exception:  # one bad file does not stop a folder
                    rows.append((folder, int(place) * (2 if spread else 1), "", "failed", None, 0))
                    continue
                items += [(folder, int(place) * len(parts) + k, p) for k, p in enumerate(parts)]
            for (folder, page, _), (text, confidence, lines) in zip(items, engine([p for _, _, p in items])):
                rows.append((folder, page, text, "recognised", float(confidence), int(lines)))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "method", "confidence", "line_count"])

    boxes = known.select("folder", "bounds")
    return images.select("folder", "place", "content").join(boxes, "folder", "left").mapInPandas(run, RESULT)
