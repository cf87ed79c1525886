"""Text scalars as Column expressions: normalisation, line tests, page references, titles, citations.

Character classes follow the meaning of letters and word characters that users of Unicode text expect: ``[\\p{L}\\p{N}_]``
for a word character (no combining marks), ``\\p{L}`` for a letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures (in code-point order), control characters and private-use digits as they occur in extracted text,
# and the words before which an index term is cut, in order of preference.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"))
PRIVATE = "".join(chr(c) for c in range(0xF720, 0xF77F))
PRIVATE_AS = "".join(chr(c - 0xF700) for c in range(0xF720, 0xF77F))
CONTROL, CONTROL_AS = "\x02\x03", "ʿʾ"
PREPOSITIONS = ("in", "of", "and", "the", "on", "at", "for", "from")
WORD_CHAR = r"[\p{L}\p{N}_]"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
ODD_LINE_END = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: All characters that are white space at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Looks at the ends of a text only."""
    return F.btrim(c, F.lit(BLANKS))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(c: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    parts = F.when(c.rlike(ODD_LINE_END), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def normalize_ligatures(c: Column) -> Column:
    """Ligatures, private-use digits, control characters, and then transliteration signs."""
    for sign, letters in LIGATURES:
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return normalize_transliteration(F.translate(F.translate(c, PRIVATE, PRIVATE_AS), CONTROL, CONTROL_AS))


def normalize_transliteration(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?<=[A-Za-z])\.(?=[¯ıa-z])", "̣")
    c = F.regexp_replace(c, r"¯([A-Za-zı])(?=[A-Za-zı\s,ʾʿ()’]|$)", "$1̄")
    return F.replace(c, F.lit("ı̄"), F.lit("ī"))


def fix_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, f"({WORD_CHAR})-\\n({WORD_CHAR})", "$1$2")


def join_broken_sentences(a: Column, b: Column) -> Column:
    a, b = F.rtrim(a, F.lit(BLANKS)), F.ltrim(b, F.lit(BLANKS))
    goes_on = ~a.rlike("[.!?:;\"']$") & b.rlike(r"^\p{IsLowercase}")
    return F.when((a == "") | (b == ""), F.concat(a, F.lit("\n"), b)).when(goes_on, F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, F.lit("\n\n"), b))


def strip_tags(c: Column, attributes: bool = False) -> Column:
    return F.regexp_replace(c, r"</?(?:b|i|math|sup|a)[^>]*>", "") if attributes else strip(F.regexp_replace(c, r"</?(b|i|math|sup)>", ""))


def strip_parentheses(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s*\([^)]*\)", "")


def is_page_number(c: Column) -> Column:
    return c.rlike(r"^\s*\d{1,4}\s*$")


def is_url_line(c: Column) -> Column:
    # Length is tested first: most long paragraphs never reach the pattern.
    return (F.length(c) < 150) & c.rlike(r"https?://\S+")


def is_boilerplate(c: Column, stripped: bool = False) -> Column:
    c = c if stripped else strip(c)
    return is_url_line(c) | ((F.length(c) < 150) & is_page_number(c))


def is_all_caps_heading(c: Column, stripped: bool = False) -> Column:
    c = c if stripped else strip(c)
    return F.length(c).between(3, 120) & ~c.contains("\n") & ~c.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]") & c.rlike(r"\p{L}")


def is_caption(c: Column) -> Column:
    return c.rlike(r"(?i)^(Figure|Fig\.|Table|Plate)\s+\d")


def is_prose_fragment(c: Column) -> Column:
    bare = strip(c)
    return (F.length(bare) > 1) & ~bare.rlike(r"[=+×÷∑∫√≤≥≠±<>]") & ~F.regexp_replace(bare, "[.,]", "").rlike(r"^\p{Nd}+$") & bare.rlike(r"\p{L}")


def slugify(c: Column) -> Column:
    c = strip(F.lower(c))
    c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"(?U)[\s_]+", "_"), "^_+|_+$", ""), 1, 60)


def title_case(c: Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def prettify_dir_name(c: Column) -> Column:
    return title_case(F.replace(F.regexp_replace(F.regexp_replace(c, r"^\d+_pp_\d+_\d+_", ""), r"^\d+_", ""), F.lit("_"), F.lit(" ")))


def chapter_display_name(c: Column) -> Column:
    pages = F.regexp_extract(c, r"_pp_(\d+)_(\d+)_(.+)$", 1), F.regexp_extract(c, r"_pp_(\d+)_(\d+)_(.+)$", 2)
    return F.when(pages[0] != "", F.concat(prettify_dir_name(c), F.lit(" (pp. "), pages[0], F.lit("–"), pages[1], F.lit(")"))).otherwise(prettify_dir_name(c))


def body(c: Column) -> Column:
    """A chapter's text up to its footnotes or references."""
    c = F.element_at(F.split(c, r"(?m)^\[\^\d+\]:", 2), 1)
    return F.element_at(F.split(c, r"(?m)^## References\s*$", 2), 1)


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def expand_abbreviated_end(start: Column, end: Column) -> Column:
    full = F.concat(F.substring(start, F.lit(1), F.length(start) - F.length(end)), end)
    return F.when(F.length(end) >= F.length(start), end).otherwise(full).cast("int")


def parse_page_refs(c: Column) -> Column:
    """``array<struct<start:int,end:int>>``; the end is null for a single page."""
    pattern = r"(\d+)\s*[–-]\s*(\d+)|(\d+)"

    def one(m):
        first, last = F.regexp_extract(m, r"^(\d+)", 1), F.regexp_extract(m, r"[–-]\s*(\d+)$", 1)
        return F.struct(first.cast("int").alias("start"), F.when(last != "", expand_abbreviated_end(first, last)).alias("end"))

    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), one)


#: Page numbers at the end of an index line: digits, joined by dashes or commas, one of each may follow.
TRAILING_REFS = r",?\s*(\d+(?:[–-]\d+|[–-]?,\s*\d+)*[–-]?(?:,\s*)?)\s*$"


def split_term_and_refs(c: Column) -> tuple[Column, Column]:
    """What stands before the trailing page numbers, and those; without any the whole line."""
    term = F.regexp_extract(c, f"(?s)^(.*?){TRAILING_REFS}", 1)
    return F.regexp_replace(F.when(c.rlike(TRAILING_REFS), term).otherwise(c), "[, ]+$", ""), F.regexp_extract(c, TRAILING_REFS, 1)


def term_variants(c: Column, prepositions: bool = True) -> Column:
    """The forms under which a term may stand in a text, in order of preference.

    What several forms need (the term, its words) is computed once; an expression that repeats it doubles at each use.
    """

    def cut(t):
        def before(words):
            # The first word may be a preposition; the cut is before a later one.
            later = lambda tail: F.filter(F.transform(F.array(*map(F.lit, PREPOSITIONS)), lambda p: F.array_position(tail, p)), lambda at: at > 0)
            first = let(F.slice(words, F.lit(2), F.size(words)), lambda tail: F.get(later(tail), F.lit(0)))
            return let(first, lambda at: F.when(at.isNotNull(), F.array_join(F.slice(words, F.lit(1), at.cast("int")), " ")))

        return let(F.split(t, r"\s+"), lambda words: F.when(F.size(words) > 2, before(words)))

    def forms(t):
        comma = t.contains(", ")
        first, rest = F.substring_index(t, ", ", 1), F.substring(t, F.instr(t, ", ") + 2, F.length(t))
        bare = let(strip(strip_parentheses(t)), lambda b: F.when(b != t, b))
        # A colon goes before a semicolon, wherever they stand.
        head = F.when(t.contains(":"), F.substring_index(t, ":", 1)).when(t.contains(";"), F.substring_index(t, ";", 1))
        base = let(F.regexp_replace(strip(head), ",+$", ""), lambda b: F.when(b != t, b))
        return F.array(t, F.when(comma, F.concat(rest, F.lit(" "), first)), F.when(comma, first), bare, base, cut(t) if prepositions else F.lit(None).cast("string"))

    return F.filter(let(F.lower(strip(strip_tags(c, attributes=True))), forms), lambda v: v != "")


def is_page_heading(c: Column) -> Column:
    return c.rlike(r"^#{1,4}\s+\d+\s*$")


def is_sub_entry(c: Column) -> Column:
    """Whether an index line belongs under the entry before it."""
    return c.rlike(r"^[\p{Ll}\"]")


def starts_bibliography(c: Column) -> Column:
    """Whether an index line is spill-over of notes or of a bibliography, where the index ends."""
    return c.rlike(r"^(\[\^\d+\]:|\d{4}\s+[A-Z])")


def dir_label(c: Column) -> Column:
    """What a chapter's folder is called in a link: its name after the number."""
    label = strip(F.replace(F.regexp_replace(c, "^[^_]*_", ""), F.lit("_"), F.lit(" ")))
    return F.when(label == "", c).otherwise(label)


def citation_style(c: Column) -> Column:
    bracket = F.regexp_count(c, F.lit(r"\[(\d+)\]"))
    author = F.regexp_count(c, F.lit(r"\(([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][a-z]+))?,?\s+\d{4})\)"))
    return F.when(bracket > author, "bracket_number").when(author > 0, "author_year").otherwise("unknown")


def parse_links(c: Column) -> tuple[Column, Column]:
    """The term of a linked index line and its links, ``array<struct<label,target>>``."""
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    links = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("target"))
    return F.regexp_replace(F.regexp_replace(c, r"\[[^\]]+\]\([^)]+\).*$", ""), "[, ]+$", ""), links


def non_printable_share(c: Column) -> Column:
    odd = F.length(F.regexp_replace(c, r"[^\p{C}\p{Z}]|[ \n\r\t]", ""))
    return F.when(F.length(c) > 0, odd / F.length(c)).otherwise(0.0)


def fix_private_use(c: Column) -> Column:
    """Only the private-use digits and letters, as older output has them."""
    return F.translate(c, PRIVATE, PRIVATE_AS)


def is_toc_line(c: Column) -> Column:
    """Whether a line lists a numbered item or a part, as a table of contents does."""
    c = strip(c)
    return c.rlike(r"^\d+\.\s+[A-Z]") | c.rlike(r"(?i)^PART\s+\d+\s+")


def repair_json(c: Column) -> Column:
    """Without code fences and trailing commas; null where it still is no JSON."""
    c = F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    c = F.regexp_replace(c, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(c).isNotNull(), c)
