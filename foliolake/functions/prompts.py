"""Questions to a language model about pages, as Column expressions, and the reading of its answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolake.functions import text as T

#: Characters of a page that a question shows.
OF_PAGE, OF_PAIR = 500, 300
ANSWER = "page_number variant, is_duplicate boolean"


def _ask(question: str, shape: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{question}\nAnswer in JSON: {shape}\n"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def page_number(text: Column) -> Column:
    """Which number does the page carry?"""
    return _ask("Which page number does this text of a scanned page show? Use null if it shows none.", '{"page_number": number or null, "confidence": 0 to 1}', "Text:\n---\n", F.substring(text, 1, OF_PAGE), "\n---")


def duplicate(a: Column, b: Column) -> Column:
    """Are two texts the same page?"""
    return _ask("Do these two texts come from the same page of a book, apart from errors of recognition?", '{"is_duplicate": true or false, "confidence": 0 to 1}', "First:\n---\n", F.substring(a, 1, OF_PAIR), "\n---\nSecond:\n---\n", F.substring(b, 1, OF_PAIR), "\n---")


def chapter_starts(headings: Column) -> Column:
    """Which headings open chapters?  ``headings``: an array of structs, in their order."""
    return _ask("These headings stand in a document in this order. Which of them open a chapter?", '[{"heading_index": number from 0, "is_chapter_start": true or false}]', "Headings:\n", F.to_json(headings))


def block_kinds(text: Column) -> Column:
    """What is each paragraph of a page?"""
    return _ask("Say of each paragraph of this page whether it is a heading (with its level from 1 to 3), body, footnote (with its number), caption, reference or index entry.", '[{"text": "...", "type": "...", "heading_level": number or null, "footnote_id": "..." or null}]', "Page:\n---\n", text, "\n---")


def number_answered(answer: Column) -> Column:
    """A positive whole number, else null."""
    n = F.try_variant_get(F.try_parse_json(T.repair_json(answer)), "$.page_number", "double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("int"))


def starts_answered(answer: Column) -> Column:
    """``array<int>``: the indices that are said to open chapters."""
    said = F.from_json(T.repair_json(answer), "array<struct<heading_index: int, is_chapter_start: boolean>>")
    return F.transform(F.filter(F.coalesce(said, F.array().cast("array<struct<heading_index: int, is_chapter_start: boolean>>")), lambda s: s["is_chapter_start"] & (s["heading_index"] >= 0)), lambda s: s["heading_index"])
