"""Back-of-book index: parsing, linking to chapters by page or by text, and passage search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T

ENTRY = "volume string, entry int, sub int, term string, refs string, see_also array<string>, raw string"
_REFS = re.compile(T.TRAILING_REFS)
_SEE_ALSO = re.compile(r"(?i)see also\s*(.*)$")
_SEE_ALSO_AT_END = re.compile(r"(?i)[.;]\s*see also\s*(.*?)\s*$")
_SEE = re.compile(r"(?i).*\.\s*see\s+(.+)$")
_CONTINUED = re.compile(r"(.+?)\s*\(cont\.\)\s*$")


class _Entry:
    """A main entry or sub-entry while its lines are read."""

    def __init__(self, term: str, refs: str, raw: str, n: int = -1):
        self.term, self.raw, self.n = term, raw, n
        self.refs: list[str] = [refs] if refs else []
        self.also: list[str] = []
        self.subs: list[_Entry] = []

    def goes_on(self) -> bool:
        """Whether the last line breaks off: at a comma or semicolon, or in a word after page numbers."""
        line = self.raw.rstrip().split("\n")[-1].rstrip()
        return line.endswith((",", ";")) or bool(re.search(r"\d.*[a-zA-Z]$", line))


def _split(line: str) -> tuple[str, str]:
    m = _REFS.search(line)
    return (line[: m.start()].rstrip(", "), m[1]) if m else (line.rstrip(", "), "")


def _lines_of(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The lines of a text without white space at their ends, some at a time."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size) + 1 or len(text)
        yield from map(str.strip, text[at:end].splitlines())
        at = end


def _read(text: str) -> Iterator[tuple[int, _Entry]]:
    """The numbered entries of an index text; each line is taken by the first rule that fits.

    An entry comes when the next one begins, those that a line takes up again ("(cont.)") at the end, so few are held.
    """
    taken_up = {m[1].strip().lower() for line in _lines_of(text) if (m := _CONTINUED.match(line))} if "(cont.)" in text else set()
    held: dict[int, _Entry] = {}  # by number, with terms that are taken up
    by_term: dict[str, _Entry] = {}  # the first of each, in small letters
    current, before, n, after_blank = None, None, 0, False

    def add(term: str, refs: str, raw: str) -> _Entry:
        nonlocal n
        n += 1
        return _Entry(term, refs, raw, n - 1)

    for line in _lines_of(text):
        if before is not current:
            if before is not None and before.term.lower() not in taken_up:
                held.pop(before.n, None)
                yield before.n, before
            before = current
            held |= {current.n: current} if taken_up else {}
        if taken_up and current is not None and (low := current.term.lower()) in taken_up:
            by_term.setdefault(low, current)
        if not line:
            if after_blank and n:
                break
            after_blank = True
            continue
        if n and re.match(r"\[\^\d+\]:|\d{4}\s+[A-Z]", line):
            break
        after_blank = False
        if line.startswith("#") or line[:4].upper() == "N.B.":
            continue
        if current and (m := _SEE_ALSO.match(line)):
            current.also.append(m[1].strip())  # nothing yet: the next line has it
            continue
        if m := _CONTINUED.match(line):
            # Terms grow by continuation lines, so the table above only says where to look first.
            wanted = m[1].strip()
            known = by_term.get(wanted.lower())
            if known is None or known.term.lower() != wanted.lower():
                known = next((held[i] for i in sorted(held) if held[i].term.lower() == wanted.lower()), None)
            current = known or add(wanted, "", line)
            continue
        if current and current.also and not current.also[-1]:
            current.also[-1] = line
            continue
        also = None
        if m := _SEE_ALSO_AT_END.search(line):
            line, also = line[: m.start()].rstrip(), m[1].strip()
        if m := _SEE.match(line):
            target = m[1].strip()
            if target.lower().startswith("also"):
                also = target[5:].strip()
            else:
                term, refs = _split(line.split(". See")[0].rstrip())
                current = add(term or line, refs, line)
                current.also.append(target)
                if also is not None:
                    current.also.append("")
                continue
        if current and line[:1].isdigit():
            (current.subs[-1] if current.subs else current).refs.append(line)
            current.raw += "\n" + line
        elif current and current.goes_on():
            term, refs = _split(line)
            last = current.subs[-1] if current.subs else current
            last.term += " " + term
            last.refs += [refs] if refs else []
            for e in {id(last): last, id(current): current}.values():
                e.raw += "\n" + line
            continue
        elif current and (line[:1].islower() or line[:1] == '"'):
            current.subs.append(_Entry(*_split(line), line))
        elif line:
            current = add(*_split(line), line)
        if also is not None and current:
            current.also.append(also)
    if before is not current and before is not None:
        held[before.n] = before
    if current is not None:
        held[current.n] = current
    yield from sorted(held.items())


def _entries(volume: str, text: str) -> Iterator[tuple]:
    for n, e in _read(text):
        for k, x in enumerate([e, *e.subs]):
            yield volume, n, None if x is e else k - 1, x.term, ", ".join(r.rstrip(", ") for r in x.refs), x.also, x.raw


def parse_index(indexes: DataFrame) -> DataFrame:
    """Entries of index texts (``volume, text``); a volume's lines are read in order, one volume at a time.

    ``see_also`` keeps a target as it stands; an empty one was announced, but no line followed.
    """

    def run(batches):
        fields = [("volume", pa.string()), ("entry", pa.int32()), ("sub", pa.int32()), ("term", pa.string()), ("refs", pa.string()), ("see_also", pa.list_(pa.string())), ("raw", pa.string())]
        for b in batches:
            for volume, text in zip(b.column(0), b.column(1)):
                rows = _entries(volume.as_py(), text.as_py() or "")
                while some := list(islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some), fields)], [name for name, _ in fields])

    of = indexes.select(F.col("volume").cast("string").alias("volume"), "text")
    return of.mapInArrow(run, ENTRY).withColumn("page_refs", T.parse_page_refs(F.col("refs")))


def chapter_of_page(refs: DataFrame, chapters: DataFrame, widest: int = 64) -> DataFrame:
    """The narrowest chapter that holds a page, the first on ties: ``refs`` with ``dir_name``.

    ``refs``: ``volume, page`` and more; ``chapters``: ``volume, dir_name, page_start, page_end``.  Ranges are cut at
    multiples of ``widest`` so that a page and a range meet in an equi-join on their block of pages.
    """
    cut = chapters.withColumn("block", F.explode(F.sequence(F.floor(F.col("page_start") / widest), F.floor(F.col("page_end") / widest))))
    pages = refs.select("volume", "page").distinct().withColumn("block", F.floor(F.col("page") / widest))
    held = pages.join(cut, ["volume", "block"]).filter("page BETWEEN page_start AND page_end")
    best = held.groupBy("volume", "page").agg(F.min_by("dir_name", F.struct(F.col("page_end") - F.col("page_start"), "page_start", "dir_name")).alias("dir_name"))
    return refs.join(best, ["volume", "page"], "left")


def holds_any(text: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: F.contains(text, v))


def link_references(refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """``refs`` (``volume, page, term`` and more) with the ``dir_name`` of the chapter that holds the page and names the term, else null.

    Chapters come with ``volume, dir_name, page_start, page_end, text``; only narrow rows look for their page, and texts
    join the chapters that were found.
    """
    placed = chapter_of_page(refs, chapters.drop("text"))
    texts = chapters.select("volume", "dir_name", F.lower("text").alias("_low")).dropDuplicates(["volume", "dir_name"])
    met = placed.join(texts, ["volume", "dir_name"], "left")
    named = F.coalesce(holds_any(F.col("_low"), T.term_variants(F.col("term"))), F.lit(False))
    return met.select(*refs.columns, F.when(named, F.col("dir_name")).alias("dir_name"))


def link_terms(terms: DataFrame, texts: DataFrame, prepositions: bool = True, block_bytes: int = 32 << 20) -> DataFrame:
    """Pairs of a term and a text that holds one of its variants: ``term_id, text_id``.

    ``terms``: ``term_id, term``; ``texts``: ``text_id, text``; with a column ``volume`` in both, pairs are of one volume.
    Variants are taken in blocks of at most ``block_bytes``, each with one scan: an automaton of a block finds all its
    variants in one pass over a text, so neither texts nor their words are shuffled, and common words make no hot key.
    """
    volumes = "volume" in terms.columns
    fields = [*(["volume"] if volumes else []), "term_id"]
    variants = terms.select(*fields, F.explode(F.array_distinct(T.term_variants(F.col("term"), prepositions))).alias("variant")).filter("variant <> ''")
    scanned = texts.select("text_id", F.lower("text").alias("low"), *([F.col("volume")] if volumes else [])).filter("low IS NOT NULL")
    schema = f"n long, text_id {texts.schema['text_id'].dataType.simpleString()}"
    kind = f"n long, term_id {terms.schema['term_id'].dataType.simpleString()}"
    found, block, size = None, [], 0

    def flush():
        nonlocal found, block, size
        part = _scan(scanned, [tuple(r)[:-1] if volumes else (None,) for r in block], [r.variant for r in block], schema)
        ids = terms.sparkSession.createDataFrame([(i, r.term_id) for i, r in enumerate(block)], kind)
        # A block is bounded, and so is the table of its ids.
        met = part.join(F.broadcast(ids), "n").select("term_id", "text_id")
        found = met if found is None else found.unionByName(met)
        block, size = [], 0

    for r in variants.toLocalIterator():
        block.append(r)
        size += len(r.variant) + 64
        if size >= block_bytes:
            flush()
    if block or found is None:
        flush()
    return found.distinct()


def _scan(texts: DataFrame, owners: list[tuple], variants: list[str], schema: str) -> DataFrame:
    """``n, text_id``: the numbers of the variants that a text (``text_id, low``) holds."""
    numbers: dict[str, dict[object, list[int]]] = {}  # by volume, so that a text doesn't go through those of others
    for n, v in enumerate(variants):
        numbers.setdefault(v, {}).setdefault(owners[n][0], []).append(n)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for v, ns in numbers.items():
            automaton.add_word(v, ns)
        if numbers:
            automaton.make_automaton()
        for b in batches:
            n, at = [], []
            for k, low in enumerate(b.column(1)):
                if not numbers:
                    break
                volume = b.column(2)[k].as_py() if b.num_columns > 2 else None
                seen = {id(ns): ns for _, ns in automaton.iter(low.as_py())}
                held = [i for ns in seen.values() for i in ns.get(volume, ())]
                n += held
                at += [k] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], ["n", "text_id"])

    return texts.mapInArrow(run, schema)


def matches(query: Column, term: Column) -> Column:
    """Whether a variant of one contains a variant of the other."""
    return T.let(T.term_variants(query), lambda q: _meets(q, term))


def _meets(q: Column, term: Column) -> Column:
    return T.let(T.term_variants(term), lambda t: F.exists(q, lambda a: F.exists(t, lambda b: F.contains(b, a) | F.contains(a, b))))


def _variants_of(query: str, of: DataFrame) -> Column:
    """The variants of a query, found once and not for each row."""
    return F.array(*map(F.lit, of.sparkSession.range(1).select(T.term_variants(F.lit(query))).head()[0])).cast("array<string>")


def _passages(text: Column, variants: Column, context: int) -> Column:
    """``array<struct<at,paragraph>>``: the paragraphs of a text that hold a variant, with neighbours."""
    raw = F.transform(F.split(text, r"\n\s*\n", -1), lambda p, i: F.struct(i.alias("at"), T.strip(p).alias("paragraph")))
    each = F.filter(raw, lambda p: (p["paragraph"] != "") & ~p["paragraph"].rlike(r"^#{1,4}\s+\d+\s*$"))
    hit = lambda p: holds_any(F.lower(p["paragraph"]), variants)
    if not context:
        return F.filter(each, hit)
    first = lambda i: F.greatest(i - context, F.lit(0))
    near = lambda ps, hits: F.filter(ps, lambda p, i: F.exists(F.slice(hits, first(i) + 1, i + context + 1 - first(i)), lambda h: h))
    return T.let(each, lambda ps: T.let(F.transform(ps, hit), lambda hits: near(ps, hits)))


def paragraphs(texts: DataFrame, query: str, context: int = 0) -> DataFrame:
    """Paragraphs that hold a variant of the query, with neighbours: ``text_id, at, paragraph``."""
    return texts.select("text_id", F.explode(_passages(F.col("text"), _variants_of(query, texts), context)).alias("p")).select("text_id", "p.*")


def search(lines: DataFrame, chapters: DataFrame, query: str, context: int = 0) -> DataFrame:
    """Passages behind linked index lines that match: ``volume, path, index_term, page_ref, paragraphs``.

    ``lines``: ``volume, line_no, line``; ``chapters``: ``volume, path, text``.  Links without a chapter are skipped; of
    several lines that lead to a chapter the terms and labels are gathered, each once.
    """
    term, links = T.parse_links(F.col("line"))
    variants = _variants_of(query, lines)
    named = lines.filter(F.col("line").contains("](")).select("volume", "line_no", term.alias("term"), links.alias("links")).filter(_meets(variants, F.col("term")))
    hits = named.select("volume", "line_no", "term", F.explode("links").alias("link"))
    hits = hits.select("volume", "line_no", "term", F.col("link.label").alias("label"), F.regexp_replace("link.target", r"^(\.\./)+", "").alias("path"))
    fold = lambda field: F.aggregate(
        F.array_sort(F.collect_list(F.struct("line_no", "term", "label")))[field],
        F.lit(""), lambda a, x: F.when(a == "", x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit("; " if field == "term" else ", "), x)),
    )
    found = hits.groupBy("volume", "path").agg(fold("term").alias("index_term"), fold("label").alias("page_ref"))
    met = found.join(chapters, ["volume", "path"]).withColumn("paragraphs", _passages(F.col("text"), variants, context)["paragraph"])
    return met.filter(F.size("paragraphs") > 0).select("volume", "path", "index_term", "page_ref", "paragraphs")


def formatted(hits: DataFrame) -> DataFrame:
    """Search results as text, one row each: ``volume, path, shown``."""
    name = T.chapter_display_name(F.element_at(F.split("path", "/"), 1))
    head = F.concat(F.lit("## "), "volume", F.lit(" > "), name, F.lit("\nIndex: "), "index_term", F.lit(", "), "page_ref")
    return hits.select("volume", "path", F.concat(head, F.lit("\n\n"), F.array_join("paragraphs", "\n\n")).alias("shown"))


def label(ref: Column) -> Column:
    """A page or a range of pages."""
    return F.concat_ws("–", ref["start"].cast("string"), ref["end"].cast("string"))


def chapter_label(dir_name: Column) -> Column:
    return T.dir_label(dir_name)


def _links_by_page(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    """``volume, entry, sub, shown, linked``: the page references of each entry, as links where their chapter names the term."""
    refs = entries.select("volume", "entry", "sub", "term", F.posexplode("page_refs").alias("at", "ref")).withColumn("page", F.col("ref")["start"])
    placed = link_references(refs.select("volume", "entry", "sub", "term", "at", "ref", "page"), chapters)
    files = chapters.select("volume", "dir_name", "file").dropDuplicates(["volume", "dir_name"])
    met = placed.join(files, ["volume", "dir_name"], "left")
    shown = F.when(F.col("file").isNotNull(), F.concat(F.lit("["), label(F.col("ref")), F.lit("](../"), "dir_name", F.lit("/"), "file", F.lit(")"))).otherwise(label(F.col("ref")))
    listed = F.array_join(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown"))))["shown"], ", ")
    return met.groupBy("volume", "entry", "sub").agg(listed.alias("shown"), F.max(F.col("file").isNotNull()).alias("linked"))


def _links_by_term(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    """``volume, term, shown``: links to each chapter of the volume that holds the term, once for entries of one term."""
    texts = chapters.select("volume", F.struct("dir_name", "file").alias("text_id"), "text")
    terms = entries.select("volume", "term").distinct().withColumn("term_id", F.to_json(F.struct("volume", "term")))
    pairs = link_terms(terms, texts)
    name = F.col("text_id.dir_name")
    shown = F.concat(F.lit("["), chapter_label(name), F.lit("](../"), name, F.lit("/"), F.col("text_id.file"), F.lit(")"))
    listed = F.array_join(F.array_sort(F.collect_list(F.struct(name.alias("dir_name"), shown.alias("shown"))))["shown"], ", ")
    return terms.join(pairs.groupBy("term_id").agg(listed.alias("shown")), "term_id").select("volume", "term", "shown")


def _index_lines(entries: DataFrame, links: DataFrame, pageless: bool) -> DataFrame:
    """``volume, entry, at, line, link, after``: the lines of indexes in order.

    Without pages ``link`` is the term whose links stand between ``line`` and ``after``; otherwise ``line`` holds the links.
    """
    keys = ("volume", "term") if pageless else ("volume", "entry", "sub")
    found = links.select(*keys, F.lit("").alias("shown"), F.lit(True).alias("linked")) if pageless else links
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}"))
    met = entries.alias("e").join(found.alias("l"), same, "left").select("e.*", "l.shown", F.coalesce("l.linked", F.lit(False)).alias("linked"))
    plain = F.array_join(F.transform("page_refs", label), ", ")
    raw = F.when(F.col("raw") == "", F.col("term")).otherwise(F.col("raw"))
    shown = F.when(F.col("linked") | F.lit(not pageless), F.col("shown")).otherwise(F.when(F.size("page_refs") > 0, plain))
    with_refs = F.when(shown.isNotNull(), F.concat("term", F.lit(", "), shown)).otherwise(F.col("term"))
    line = F.when(F.col("sub").isNull(), with_refs).when(F.col("linked"), with_refs).otherwise(raw)
    link = F.when(F.col("linked") & F.lit(pageless), F.col("term"))
    of_entry = F.array_sort(F.collect_list(F.struct(F.coalesce("sub", F.lit(-1)).alias("nth"), line.alias("line"), link.alias("link"))))
    main = F.max(F.when(F.col("sub").isNull(), F.struct(raw.alias("raw"), F.size("page_refs").alias("refs"), "see_also")))
    one = met.groupBy("volume", "entry").agg(of_entry.alias("lines"), main.alias("main"))
    targets = F.filter("main.see_also", lambda t: t != "")
    also = F.when(F.size(targets) > 0, F.concat(F.lit("\nSee also "), F.array_join(targets, ", "))).otherwise("")
    bare = (F.col("main.refs") == 0) & (F.size("lines") == 1) & (F.size("main.see_also") == 0)
    each = one.select("volume", "entry", F.size("lines").alias("n"), also.alias("also"), F.when(bare, F.col("main.raw")).alias("bare"), F.posexplode("lines").alias("at", "l"))
    after = F.when(F.col("at") == F.col("n") - 1, F.col("also")).otherwise("")
    return each.select("volume", "entry", "at", F.coalesce("bare", "l.line").alias("line"), F.when(F.col("bare").isNull(), F.col("l.link")).alias("link"), after.alias("after"))


def linked_index(entries: DataFrame, chapters: DataFrame, pageless: bool = False) -> DataFrame:
    """Indexes as Markdown with links to chapters: ``volume, markdown``.

    ``entries`` from :func:`parse_index`; ``chapters``: ``volume, dir_name, page_start, page_end, file, text``.  An entry
    with neither pages, sub-entries nor other targets stays as it was; so does a sub-entry without a link.
    """
    links = (_links_by_term if pageless else _links_by_page)(entries, chapters)
    lines = _index_lines(entries, links, pageless)
    if pageless:
        same = F.col("i.volume").eqNullSafe(F.col("l.volume")) & (F.col("i.link") == F.col("l.term"))
        lines = lines.alias("i").join(links.alias("l"), same, "left").select("i.volume", "entry", "at", F.concat("line", F.coalesce("shown", F.lit(""))).alias("line"), "after")
    body = F.array_join(F.array_sort(F.collect_list(F.struct("entry", "at", F.concat("line", "after").alias("line"))))["line"], "\n")
    return lines.groupBy("volume").agg(F.concat(F.lit("# INDEX\n\n"), body, F.lit("\n")).alias("markdown"))


def linked_index_digest(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    """``volume, h``: the SHA-256 of what :func:`linked_index` gives for volumes without pages.

    Each entry lists all chapters that hold its term, so the text grows with the square of a volume and soon is longer
    than a string can be.  It is hashed as its lines stream by; the links of a term are shipped and kept once a volume.
    """
    links = _links_by_term(entries, chapters)
    given = links.select("volume", F.lit(-1).alias("entry"), F.lit(0).alias("at"), F.col("shown").alias("line"), F.col("term").alias("link"), F.lit("").alias("after"))

    def run(batches):
        volume, h, texts, gap = None, None, {}, b""
        for b in batches:
            done = []
            for v, entry, _, line, link, after in zip(*b.columns):
                v, link = v.as_py(), link.as_py()
                if h is None or v != volume:
                    done += [(volume, h)] if h is not None else []
                    volume, h, texts, gap = v, hashlib.sha256(b"# INDEX\n\n"), {}, b""
                if entry.as_py() < 0:
                    texts[link] = line.as_py().encode()
                    continue
                h.update(gap + line.as_py().encode())
                h.update(b"" if link is None else texts[link])
                h.update(after.as_py().encode())
                gap = b"\n"
            yield _digests(done)
        if h is not None:
            yield _digests([(volume, h)])

    # As many partitions as are set: what is hashed is far longer than what is shuffled, by which they would be joined.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _index_lines(entries, links, True).unionByName(given).repartition(parts, "volume").sortWithinPartitions("volume", "entry", "at")
    return rows.mapInArrow(run, "volume string, h string")


def _digests(done: list) -> pa.RecordBatch:
    for _, h in done:
        h.update(b"\n")
    return pa.RecordBatch.from_arrays([pa.array([v for v, _ in done], pa.string()), pa.array([h.hexdigest() for _, h in done], pa.string())], ["volume", "h"])
