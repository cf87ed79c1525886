"""Queries over the driver's tables, and the SQL that gives the same rows.

``documents`` rows serve as pages (``source`` the document, ``doc_id`` the page), ``conversations`` turns as ordered pages,
``benchmark`` texts as index terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.functions import text as T
from foliolake.operators import chapters as C
from foliolake.operators import index as I
from foliolake.operators import layout as Y
from foliolake.operators import library as L
from foliolake.operators import ocr as O
from foliolake.operators import pages as P

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def digest(c):
    return F.sha2(c, 256)


#: Dots below, where signs of transliteration stand beside their letters (the tables have dots only).
_DOTS = "regexp_replace(regexp_replace({}, '([A-Za-z])\\.([ıa-z])', '\\1' || chr(803) || '\\2', 'g'), '([A-Za-z])\\.([ıa-z])', '\\1' || chr(803) || '\\2', 'g')"


@query(f"SELECT doc_id, sha256({_DOTS.format('text')}) AS h FROM documents")
def t01_ligatures(spark, sf_dir):
    """Ligatures that stand for letters become letters again."""
    joined = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("ff"), F.lit("ﬀ"))
    return table(spark, sf_dir, "documents").select("doc_id", digest(T.normalize_ligatures(joined)).alias("h"))


@query(f"""SELECT doc_id, sha256({_DOTS.format("translate(text, 'AE0', 'BF1')")}) AS h FROM documents""")
def t02_private_use(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest(T.normalize_ligatures(F.translate("text", "AE0", "\uf742\uf746\uf731"))).alias("h"))


@query("SELECT doc_id, sha256(regexp_replace(replace(text, 'an', E'a-\\nn'), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g')) AS h FROM documents")
def t05_hyphenation(spark, sf_dir):
    broken = F.replace("text", F.lit("an"), F.lit("a-\nn"))
    return table(spark, sf_dir, "documents").select("doc_id", digest(T.fix_hyphenation(broken)).alias("h"))


@query("SELECT page_id, sha256(regexp_replace(html, '</?(?:b|i|math|sup|a)[^>]*>', '', 'g')) AS h FROM pages")
def t08_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", digest(T.strip_tags(F.col("html"), attributes=True)).alias("h"))


@query("SELECT page_id, regexp_replace(url, '\\s*\\([^)]*\\)', '', 'g') AS term, length(url) < 150 AND regexp_matches(url, 'https?://\\S+') AS boilerplate FROM pages")
def p02_url_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_parentheses(F.col("url")).alias("term"), T.is_url_line(F.col("url")).alias("boilerplate"))


@query("""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(trim(lower(text), E' \\n\\t'), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM documents""")
def k03_slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM documents""")
def t16_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words(T.body(F.col("text"))).cast("long").alias("words"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'bracket_number' WHEN 1 THEN 'author_year' WHEN 2 THEN 'author_year' WHEN 3 THEN 'author_year' WHEN 4 THEN 'author_year' WHEN 5 THEN 'unknown' ELSE 'unknown' END AS style FROM documents""")
def t23_citation_style(spark, sf_dir):
    """Brackets must be more than names with years; a small letter, a name without a year or a lone year count for nothing."""
    forms = [" [1] (Smith 2020) [2]", " (Smith 2020)", " (Smith et al., 2020) [7]", " (Smith and Jones, 2020)", " (Smith et al 1999) [3]", " (smith, 2020) (McCoy, 2020)", " (2020) (Smith)"]
    k = (F.col("doc_id") % 7 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.citation_style(F.concat("text", F.element_at(F.array(*[F.lit(f) for f in forms]), k))).alias("style"))


@query("""SELECT o_orderkey, CASE WHEN length(e) >= length(s) THEN e::INT ELSE (substr(s, 1, length(s) - length(e)) || e)::INT END AS page_end
FROM (SELECT o_orderkey, (o_orderkey % 2000 + 1)::VARCHAR AS s, (o_custkey % 100 + 1)::VARCHAR AS e FROM orders)""")
def t19_page_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000 + 1).cast("string").alias("s"), (F.col("o_custkey") % 100 + 1).cast("string").alias("e"))
    return o.select("o_orderkey", F.element_at(T.parse_page_refs(F.concat("s", F.lit("–"), "e")), 1)["end"].alias("page_end"))


_LINES = "SELECT source AS doc, doc_id AS page, list_transform(CASE WHEN text[-1:] = E'\\n' THEN string_split(text, E'\\n')[:-2] ELSE string_split(text, E'\\n') END, lambda x: trim(x, E' \\t\\n')) AS ls FROM documents"
_REPEATED = f"SELECT doc, line, count(*) AS n FROM (SELECT doc, unnest(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):])) AS line FROM ({_LINES})) WHERE line <> '' GROUP BY doc, line HAVING count(*) >= 3"


@query(_REPEATED)
def a01_repeated_lines(spark, sf_dir):
    return P.repeated_lines(pages_of(spark, sf_dir))


@query(f"""WITH r AS ({_REPEATED}), e AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, E'\\n')) AS raw, generate_subscripts(string_split(text, E'\\n'), 1) AS pos FROM documents)
SELECT d.source AS doc, d.doc_id AS page, sha256(coalesce(x.t, '')) AS h FROM documents d LEFT JOIN
(SELECT e.doc, page, string_agg(raw, E'\\n' ORDER BY pos) AS t FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = e.doc AND r.line = trim(raw, E' \\t')) GROUP BY ALL) x ON x.doc = d.source AND x.page = d.doc_id""")
def p13_without_headers(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    return P.without_lines(pages, P.repeated_lines(pages)).select("doc", "page", digest(F.col("text")).alias("h"))


@query("SELECT source AS doc, sha256(text) AS content_hash, min(doc_id) AS page FROM documents GROUP BY ALL")
def w01_exact_dedup(spark, sf_dir):
    return P.first_of_equal(pages_of(spark, sf_dir))


@query()
def w02_fuzzy_dedup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return P.fuzzy_dedup(turns)


@query("""WITH b AS (SELECT o_custkey AS doc, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_custkey % 50 AS o_custkey, o_orderkey FROM orders) GROUP BY 1)
SELECT doc, m AS missing FROM (SELECT doc, unnest(range(lo, hi + 1)) AS m FROM b) g WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey % 50 = g.doc AND o.o_orderkey = g.m)""")
def w05_page_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc"), F.col("o_orderkey").alias("page"))
    return P.gaps(o)


@query("""SELECT doc, page, ord, CASE WHEN caps THEN 'heading' WHEN fn THEN 'footnote' WHEN regexp_matches(t, '(?i)^(Figure|Fig\\.|Table|Plate)\\s+\\d') THEN 'caption' ELSE 'body' END AS kind, sha256(t) AS h
FROM (SELECT doc, page, (pos - 1)::INT AS ord, trim(p, E' \\n\\t') AS t,
  NOT contains(trim(p, E' \\n\\t'), E'\\n') AND length(trim(p, E' \\n\\t')) BETWEEN 3 AND 120 AND regexp_matches(p, '\\p{L}') AND NOT regexp_matches(p, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]') AS caps,
  regexp_matches(trim(p, E' \\n\\t'), '^(\\d+)\\s+\\S') AND pos - 1 >= total // 2 AS fn
  FROM (SELECT source AS doc, doc_id AS page, len(ps) AS total, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT source, doc_id, string_split(replace(trim(text, E' \\n\\t'), E'\\n', E'\\n\\n'), E'\\n\\n') AS ps FROM documents)))
WHERE t <> '' AND NOT regexp_matches(t, '^\\s*\\d{1,4}\\s*$') AND NOT (regexp_matches(t, 'https?://\\S+') AND length(t) < 150)""")
def c04_segments(spark, sf_dir):
    pages = pages_of(spark, sf_dir).withColumn("text", F.replace(T.strip(F.col("text")), F.lit("\n"), F.lit("\n\n")))
    return P.segments(pages).select("doc", "page", "ord", "kind", digest(F.col("text")).alias("h"))


def _blocks(spark, sf_dir):
    """Turns of a conversation as blocks: user turns with few words are headings."""
    t = table(spark, sf_dir, "conversations")
    head = (F.col("role") == "user") & (F.col("turn") % 4 == 2)
    return t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.when(head, "heading").otherwise("body").alias("kind"), F.when(head, 1).alias("level"), F.lit(None).cast("string").alias("footnote"), "text")


@query("""WITH b AS (SELECT conv_id AS doc, turn AS ord, role = 'user' AND turn % 4 = 2 AS head, text FROM conversations),
s AS (SELECT *, max(CASE WHEN head THEN ord END) OVER w AS last_head, max(CASE WHEN NOT head THEN ord END) OVER w AS last_other FROM b WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, sum((head AND (last_head IS NULL OR coalesce(last_other > last_head, false)))::INT) OVER (PARTITION BY doc ORDER BY ord)::BIGINT AS chapter FROM s),
t AS (SELECT doc, chapter, string_agg(text, ' — ' ORDER BY ord) AS title FROM c WHERE head AND chapter > 0 GROUP BY ALL), m AS (SELECT doc, max(chapter) AS chapters FROM c GROUP BY doc),
x AS (SELECT c.*, CASE WHEN chapters = 0 THEN 'Untitled' ELSE coalesce(t.title, 'Front Matter') END AS title FROM c JOIN m ON m.doc = c.doc LEFT JOIN t ON t.doc = c.doc AND t.chapter = c.chapter)
SELECT doc, chapter, ord, CASE WHEN head THEN 'heading' ELSE 'body' END AS kind, sha256(title) AS title_hash FROM x WHERE NOT (head AND chapter > 0 AND contains(title, text))""")
def c06_chapters(spark, sf_dir):
    return C.detect(_blocks(spark, sf_dir)).select("doc", "chapter", "ord", "kind", digest(F.col("title")).alias("title_hash"))


@query()
def c10_assemble_and_render(spark, sf_dir):
    """Chapters, footnote links, merged bodies, Markdown."""
    blocks = C.detect(_blocks(spark, sf_dir))
    return C.render(C.merge_bodies(C.link_footnotes(blocks)), C.footnotes(blocks)).select("doc", "chapter", digest(F.col("markdown")).alias("h"))


@query("""WITH c AS (SELECT c_custkey AS s, c_custkey + c_custkey % 40 AS e, 'dir' || c_custkey AS dir_name FROM customer),
r AS (SELECT DISTINCT o_orderkey AS page FROM orders)
SELECT r.page, m.dir_name FROM r LEFT JOIN (SELECT r.page, arg_min(dir_name, (e - s) * 10000000 + s) AS dir_name FROM r JOIN c ON r.page BETWEEN c.s AND c.e GROUP BY r.page) m ON m.page = r.page""")
def j01_page_to_chapter(spark, sf_dir):
    chapters = table(spark, sf_dir, "customer").select(F.lit("v").alias("volume"), F.concat(F.lit("dir"), "c_custkey").alias("dir_name"), F.col("c_custkey").alias("page_start"), (F.col("c_custkey") + F.col("c_custkey") % 40).alias("page_end"))
    refs = table(spark, sf_dir, "orders").select(F.lit("v").alias("volume"), F.col("o_orderkey").alias("page")).distinct()
    return I.chapter_of_page(refs, chapters).select("page", "dir_name")


#: The words in their order of preference, before the first of which that a term holds it is cut.
_CUTS = ", ".join(f"CASE WHEN list_position(w[2:], '{p}') > 0 THEN array_to_string(w[1:list_position(w[2:], '{p}')], ' ') END" for p in T.PREPOSITIONS)
_TERMS_IN_TEXTS = f"""WITH t AS (SELECT item_id, low, regexp_split_to_array(low, '\\s+') AS w, CASE WHEN contains(low, ':') THEN string_split(low, ':')[1] WHEN contains(low, ';') THEN string_split(low, ';')[1] END AS base
FROM (SELECT item_id, lower(trim(regexp_replace(text, '</?(?:b|i|math|sup|a)[^>]*>', '', 'g'), E' \\n\\t')) AS low FROM benchmark)),
v AS (SELECT item_id, low AS v FROM t UNION SELECT item_id, substr(low, strpos(low, ', ') + 2) || ' ' || string_split(low, ', ')[1] FROM t WHERE contains(low, ', ') UNION SELECT item_id, string_split(low, ', ')[1] FROM t WHERE contains(low, ', ')
UNION SELECT item_id, trim(regexp_replace(low, '\\s*\\([^)]*\\)', '', 'g')) FROM t UNION SELECT item_id, rtrim(trim(base), ',') FROM t WHERE base IS NOT NULL UNION SELECT item_id, coalesce({_CUTS}) FROM t WHERE len(w) > 2)
SELECT DISTINCT item_id AS term_id, doc_id AS text_id FROM v JOIN documents d ON v <> '' AND contains(lower(d.text), v)"""


@query(_TERMS_IN_TEXTS)
def j03_terms_in_texts(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return I.link_terms(terms, texts)


@query(_TERMS_IN_TEXTS)
def j03_terms_in_texts_all_variants(spark, sf_dir):
    """The same under its former name."""
    return j03_terms_in_texts(spark, sf_dir)


@query("""SELECT volume, chapter, words, coalesce(sum(words) OVER (PARTITION BY volume ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before
FROM (SELECT conv_id AS volume, min(turn) AS chapter, any_value(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words FROM conversations GROUP BY conv_id, text)""")
def c20_catalogue(spark, sf_dir):
    chapters = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("volume"), F.col("turn").alias("chapter"), "text")
    return L.catalogue(chapters).select("volume", "chapter", "words", "words_before")


@query("""SELECT event_id, value / 100 >= 0.6 AND event_id % 7 >= 3 AND coalesce(length(regexp_replace(props, '[^\\p{C}\\p{Z}]|[ \\n\\r\\t]', '', 'g')) / nullif(length(props), 0), 0) <= 0.3 AS good FROM events""")
def p08_quality_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", O.good(F.col("value") / 100, F.col("event_id") % 7, F.coalesce("props", F.lit(""))).alias("good"))


@query("""SELECT l_orderkey AS page, avg(l_quantity) / 100 AS confidence, count(*) AS line_count FROM lineitem GROUP BY 1""")
def a10_page_confidence(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") / 100).alias("confidence"))
    return O.page_confidence(words)


@query("""SELECT doc_id, coalesce(length(regexp_replace(text, '[^\\p{C}\\p{Z}]|[ \\n\\r\\t]', '', 'g')) / nullif(length(text), 0), 0)::DOUBLE AS share FROM documents""")
def a13_non_printable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.non_printable_share(F.col("text")).cast("double").alias("share"))


@query(f"""SELECT doc_id, sha256({_DOTS.format("translate(text, 'qx', chr(703) || chr(702))")}) AS h FROM documents""")
def t03_control_characters(spark, sf_dir):
    """Control characters that stand for the signs of ayn and hamza."""
    return table(spark, sf_dir, "documents").select("doc_id", digest(T.normalize_ligatures(F.translate("text", "qx", T.CONTROL))).alias("h"))


@query("""WITH t AS (SELECT conv_id, turn, rtrim(text, E' \\n\\t') AS a, ltrim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text), E' \\n\\t') AS b FROM conversations)
SELECT conv_id, turn, sha256(a || CASE WHEN a = '' OR b = '' THEN E'\\n' WHEN NOT regexp_matches(a, '[.!?:;"'']$') AND regexp_matches(b, '^\\p{Ll}') THEN ' ' ELSE E'\\n\\n' END || b) AS h FROM t WHERE b IS NOT NULL""")
def t06_sentence_join(spark, sf_dir):
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    turns = table(spark, sf_dir, "conversations").withColumn("after", after).filter("after IS NOT NULL AND text IS NOT NULL")
    return turns.select("conv_id", "turn", digest(T.join_broken_sentences(F.col("text"), F.col("after"))).alias("h"))


@query("""WITH e AS (SELECT source AS doc, doc_id AS page, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM (SELECT source, doc_id, string_split(replace(text, ' ', E'\\n'), E'\\n') AS ls FROM documents)),
f AS (SELECT *, trim(raw, E' \\t\\n\\r') AS bare FROM e),
g AS (SELECT *, length(bare) BETWEEN 2 AND 14 AND regexp_matches(bare, '\\p{L}') AND NOT regexp_matches(bare, '[=+×÷∑∫√≤≥≠±<>]') AS fits FROM f),
r AS (SELECT *, sum((NOT fits)::INT) OVER (PARTITION BY doc, page ORDER BY pos) AS run FROM g),
s AS (SELECT *, min(pos) FILTER (fits AND NOT regexp_matches(bare, '[.!?:;]$')) OVER (PARTITION BY doc, page, run) AS first_at, max(pos) OVER (PARTITION BY doc, page, run) AS last_at FROM r),
j AS (SELECT *, coalesce(fits AND pos >= first_at AND last_at - first_at >= 2, false) AS joined FROM s)
SELECT doc, page, sha256(substr(string_agg(CASE WHEN joined THEN CASE WHEN pos > first_at THEN ' ' ELSE E'\\n' END || bare ELSE E'\\n' || raw END, '' ORDER BY pos), 2)) AS h FROM j GROUP BY doc, page""")
def t10_rejoin_lines(spark, sf_dir):
    """Texts with a word a line get lines of prose again."""
    pages = pages_of(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" "), F.lit("\n")))
    return P.rejoin_lines(pages).select("doc", "page", digest(F.col("text")).alias("h"))


@query("SELECT o_orderkey, 'entry ' || o_orderkey AS term, unnest([o_custkey, o_custkey + 1])::VARCHAR AS label, '../d' || unnest([o_custkey % 9, 7]) || '/c.md' AS target FROM orders")
def t17_linked_lines(spark, sf_dir):
    c = F.col("o_custkey")
    line = F.format_string("entry %d, [%d](../d%d/c.md), [%d](../d7/c.md)", F.col("o_orderkey"), c, c % 9, c + 1)
    term, links = T.parse_links(line)
    return table(spark, sf_dir, "orders").select("o_orderkey", term.alias("term"), F.explode(links).alias("l")).select("o_orderkey", "term", "l.*")


@query("""SELECT o_orderkey, o_custkey::INT AS s1, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 3 END::INT AS e1, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 500 END::INT AS s2, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 500 END::INT AS e2 FROM orders""")
def t18_page_references(spark, sf_dir):
    """A range and a page, a page and a range with a hyphen and blanks, a page among words."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.format_string("%d–%d, %d", c, c + 3, k % 500)).when(k % 3 == 1, F.format_string("p. %d; %d - %d.", c, k % 500, k % 500)).otherwise(F.format_string("see %dff –", c))
    o = table(spark, sf_dir, "orders").select("o_orderkey", T.parse_page_refs(text).alias("r"))
    return o.select("o_orderkey", *[F.get("r", k)[f].alias(f"{f[0]}{k + 1}") for k in (0, 1) for f in ("start", "end")])


@query("""SELECT c_custkey, CASE k % 6 WHEN 0 THEN 'abacus' WHEN 1 THEN 'abacus, old' WHEN 2 THEN 'Abelard, Peter' WHEN 3 THEN 'term ' || k || ', 2-5.' WHEN 4 THEN 'no pages' ELSE 'Apollo' END AS term,
CASE k % 6 WHEN 0 THEN k::VARCHAR WHEN 1 THEN k || ', ' || k + 1 || '–' || k + 4 WHEN 2 THEN k || '-' || k + 3 || ', ' WHEN 3 THEN '' WHEN 4 THEN '' ELSE k || ',12' END AS refs FROM (SELECT c_custkey, c_custkey AS k FROM customer)""")
def t20_term_and_references(spark, sf_dir):
    """Pages after a comma with or without a blank, ranges, a comma at the end, a full stop, none, a number in the term."""
    k = F.col("c_custkey")
    forms = [F.format_string("abacus,%d", k), F.format_string("abacus, old, %d, %d–%d", k, k + 1, k + 4), F.format_string("Abelard, Peter %d-%d, ", k, k + 3), F.format_string("term %d, 2-5.", k), F.lit("no pages, "), F.format_string("Apollo%d,12", k)]
    term, refs = T.split_term_and_refs(F.element_at(F.array(*forms), (k % 6 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", term.alias("term"), refs.alias("refs"))


@query("""SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(l, '^\\s*\\d{1,4}\\s*$')) AS numbers, count(*) FILTER (regexp_matches(l, 'https?://\\S+') AND length(trim(l, E' \\t\\r')) < 150 OR regexp_matches(l, '^\\s*\\d{1,4}\\s*$')) AS boilerplate,
count(*) FILTER (length(trim(l, E' \\t\\r')) BETWEEN 3 AND 120 AND regexp_matches(l, '\\p{L}') AND NOT regexp_matches(l, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')) AS headings, count(*) FILTER (regexp_matches(l, '(?i)^(Figure|Fig\\.|Table|Plate)\\s+\\d')) AS captions,
count(*) FILTER (regexp_matches(l, '^[\\p{Ll}"]')) AS sub_entries, count(*) FILTER (regexp_matches(l, '^#{1,4}\\s+\\d+\\s*$')) AS page_headings, count(*) FILTER (regexp_matches(l, '^(\\[\\^\\d+\\]:|\\d{4}\\s+[A-Z])')) AS spill_over
FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l FROM documents) GROUP BY doc_id""")
def p01_line_kinds(spark, sf_dir):
    """The tests of single lines: page numbers, boilerplate, headings, captions, index entries, spill-over (P01, P03 to P05, P09 to P11)."""
    c = F.col("l")
    tests = {"numbers": T.is_page_number(c), "boilerplate": T.is_boilerplate(c), "headings": T.is_all_caps_heading(c), "captions": T.is_caption(c), "sub_entries": T.is_sub_entry(c), "page_headings": T.is_page_heading(c), "spill_over": T.starts_bibliography(c)}
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])


@query("""SELECT DISTINCT doc, line FROM (SELECT doc, unnest(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):])) AS line FROM
(SELECT source AS doc, list_transform(string_split(text || E'\\n' || doc_id % 100, E'\\n'), lambda x: trim(x, E' \\t\\n')) AS ls FROM documents)) WHERE regexp_matches(line, '^\\s*\\d{1,4}\\s*$') OR (regexp_matches(line, 'https?://\\S+') AND length(line) < 150)""")
def a02_boilerplate_lines(spark, sf_dir):
    pages = pages_of(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), (F.col("page") % 100).cast("string")))
    return P.boilerplate_lines(pages)


@query("""SELECT l_orderkey AS page, l_linenumber % 2 AS line, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey::VARCHAR) AS text, count(*) AS n FROM lineitem WHERE l_quantity >= 5 GROUP BY ALL""")
def a09_words_to_lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    words = l.select(F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), (F.col("l_linenumber") % 2).alias("line"), F.col("l_linenumber").alias("word"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") - 5).alias("conf"))
    return O.words_to_lines(words).select("page", "line", "text", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))


@query("SELECT o_custkey AS doc, o_orderkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END NULLS FIRST, o_orderkey)::INT AS \"order\" FROM orders")
def w04_reorder(spark, sf_dir):
    number = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), number.alias("number"))
    return P.reorder(o).select("doc", "page", "order")


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS ord, l_linenumber % 3 > 0 AS note, l_linenumber % 3 = 1 AS numbered, l_partkey::VARCHAR AS text FROM lineitem),
i AS (SELECT *, sum((NOT (note AND NOT numbered AND coalesce(before, false)))::INT) OVER (PARTITION BY page ORDER BY ord, text) AS island FROM (SELECT *, lag(note) OVER (PARTITION BY page ORDER BY ord, text) AS before FROM b))
SELECT page, min(ord) AS ord, CASE WHEN arg_min(note, ord) THEN 'footnote' ELSE 'body' END AS kind, string_agg(text, E'\\n' ORDER BY ord, text) AS text FROM i GROUP BY page, island""")
def w06_footnote_continuations(spark, sf_dir):
    n = F.col("l_linenumber")
    blocks = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("page"), n.alias("ord"), F.when(n % 3 > 0, "footnote").otherwise("body").alias("kind"), F.lit(None).cast("int").alias("level"), F.when(n % 3 == 1, "1").alias("footnote"), F.col("l_partkey").cast("string").alias("text"))
    return P.merge_footnotes(blocks).select("page", "ord", "kind", "text")


@query("""WITH p AS (SELECT doc_id AS text_id, (unnest(range(len(ps))))::INT AS "at", trim(unnest(ps), E' \\t\\r\\n') AS paragraph FROM (SELECT doc_id, string_split(regexp_replace(text, '\\s*\\n\\s*', E'\\n\\n', 'g'), E'\\n\\n') AS ps FROM documents)),
q AS (SELECT * FROM p WHERE paragraph <> '' AND NOT regexp_matches(paragraph, '^#{1,4}\\s+\\d+\\s*$')),
w AS (SELECT *, max(contains(lower(paragraph), 'thtion')::INT) OVER (PARTITION BY text_id ORDER BY "at" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM q)
SELECT text_id, "at", sha256(paragraph) AS h FROM w WHERE near = 1""")
def w16_passages(spark, sf_dir):
    """Paragraphs that hold a term, and their neighbours."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.regexp_replace("text", r"\s*\n\s*", "\n\n").alias("text"))
    return I.paragraphs(texts, "Thtion", context=1).select("text_id", "at", digest(F.col("paragraph")).alias("h"))


@query("""WITH n AS (SELECT l_suppkey AS doc, (l_linenumber + 6)::DOUBLE AS size, l_returnflag AS font, length(l_partkey::VARCHAR) AS n, struct_pack(p := l_orderkey, b := 1, l := l_linenumber, s := 1) AS place FROM lineitem),
s AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY sum(n) DESC, min(place), size) AS nth FROM n GROUP BY doc, size),
f AS (SELECT doc, size, font, row_number() OVER (PARTITION BY doc, size ORDER BY sum(n) DESC, min(place), font) AS nth FROM n GROUP BY doc, size, font)
SELECT s.doc, s.size AS body_size, f.font AS body_font FROM s JOIN f ON f.doc = s.doc AND f.size = s.size AND f.nth = 1 WHERE s.nth = 1""")
def c01_font_profile(spark, sf_dir):
    """Line items as spans of text: a supplier's main size and its main font at that size."""
    n = F.col("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), n.alias("line"), F.lit(1).alias("span"), F.col("l_partkey").cast("string").alias("text"), (n + 6).cast("double").alias("size"), F.col("l_returnflag").alias("font"))
    return Y.font_profile(spans).select("doc", "body_size", "body_font")


@query("SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR)::INT AS n, l_partkey::VARCHAR AS text FROM lineitem WHERE l_linenumber % 2 = 0")
def c09_bibliography(spark, sf_dir):
    n = F.col("l_linenumber")
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("chapter"), n.alias("ord"), F.when(n % 2 == 0, "reference").otherwise("body").alias("kind"), F.col("l_partkey").cast("string").alias("text"))
    return C.bibliography(blocks).select("doc", "n", "text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_custkey || '_' ELSE 'part of ' || c_nationkey END AS label FROM customer")
def t22_folder_labels(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit("_"))).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("_part_of_"), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.dir_label(name).alias("label"))


@query("""SELECT volume, count(*) AS chapters, sum(words)::BIGINT AS words FROM (SELECT conv_id AS volume, any_value(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words FROM conversations GROUP BY conv_id, text) GROUP BY volume""")
def a12_books(spark, sf_dir):
    chapters = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("volume"), F.col("turn").alias("chapter"), "text")
    return L.books(L.catalogue(chapters)).select("volume", "chapters", "words")


@query("SELECT event_id AS key, CASE WHEN event_id % 10 >= 6 THEN 0 WHEN event_id % 10 >= 3 THEN 1 ELSE 2 END AS stage FROM events")
def w18_cascade(spark, sf_dir):
    """Each item's result by the first engine whose result is good enough."""

    def engine(add):
        return lambda items: items.select("key", F.lit("text").alias("text"), (F.col("key") % 10 / 10 + add).alias("confidence"), F.lit(5).alias("line_count"))

    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"))
    check = F.col("confidence") >= 0.595
    return O.cascade(items, [engine(0.0), engine(0.3), engine(0.0)], [check, check, None]).select("key", "stage")


@query("""WITH c AS (SELECT c_custkey AS s, c_custkey + c_custkey % 40 AS e, 'dir' || c_custkey AS dir_name, 'on chapter ' || c_nationkey AS text FROM customer),
r AS (SELECT o_orderkey AS page, 'chapter ' || o_orderkey % 25 AS term FROM orders),
m AS (SELECT r.page, arg_min(c.dir_name, (e - s) * 10000000 + s) AS dir_name FROM r JOIN c ON r.page BETWEEN c.s AND c.e GROUP BY r.page)
SELECT r.page, r.term, CASE WHEN contains(c.text, r.term) THEN m.dir_name END AS dir_name FROM r LEFT JOIN m ON m.page = r.page LEFT JOIN c ON c.dir_name = m.dir_name""")
def j02_references_to_chapters(spark, sf_dir):
    """Page references linked to the narrowest chapter around the page, if it names the term."""
    chapters = table(spark, sf_dir, "customer").select(F.lit("v").alias("volume"), F.concat(F.lit("dir"), "c_custkey").alias("dir_name"), F.col("c_custkey").alias("page_start"), (F.col("c_custkey") + F.col("c_custkey") % 40).alias("page_end"), F.concat(F.lit("On Chapter "), "c_nationkey").alias("text"))
    refs = table(spark, sf_dir, "orders").select(F.lit("v").alias("volume"), F.col("o_orderkey").alias("page"), F.concat(F.lit("chapter "), F.col("o_orderkey") % 25).alias("term"))
    return I.link_references(refs, chapters).select("page", "term", "dir_name")


@query("""SELECT 'v' AS volume, 'd' || c_custkey || '/c.md' AS path, 'Entry ' || c_nationkey AS index_term, c_custkey::VARCHAR AS page_ref, 'First entry 1' || E'\\n\\n' || 'last ENTRY 1' || c_nationkey AS shown
FROM customer WHERE contains('entry ' || c_nationkey, 'entry 1') AND c_custkey % 3 > 0""")
def c14_search(spark, sf_dir):
    """A term looked up in linked index lines, with the passages behind the links; links without a chapter are skipped."""
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("d"), "c_custkey", F.lit("/c.md"))
    lines = c.select(F.lit("v").alias("volume"), F.col("c_custkey").alias("line_no"), F.concat(F.lit("Entry "), "c_nationkey", F.lit(", ["), "c_custkey", F.lit("](../"), path, F.lit(")")).alias("line"))
    chapters = c.filter("c_custkey % 3 > 0").select(F.lit("v").alias("volume"), path.alias("path"), F.concat(F.lit("First entry 1\n\nno such thing\n\n## 12\n\nlast ENTRY 1"), "c_nationkey").alias("text"))
    return I.search(lines, chapters, "Entry 1").select("volume", "path", "index_term", "page_ref", F.array_join("paragraphs", "\n\n").alias("shown"))


@query("""SELECT 'v' AS volume, 'd' || c_custkey || '/c.md' AS path, '## v > D' || c_custkey || E'\\nIndex: Entry 7, ' || c_custkey || E'\\n\\non entry 7' AS shown FROM customer WHERE c_nationkey = 7""")
def k10_formatted_hits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_nationkey = 7")
    path = F.concat(F.lit("d"), "c_custkey", F.lit("/c.md"))
    hits = c.select(F.lit("v").alias("volume"), path.alias("path"), F.lit("Entry 7").alias("index_term"), F.col("c_custkey").cast("string").alias("page_ref"), F.array(F.lit("on entry 7")).alias("paragraphs"))
    return I.formatted(hits)


@query("""WITH c AS (SELECT c_nationkey::VARCHAR AS volume, c_custkey AS k, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS entry, chr((97 + c_custkey % 26)::INT) AS x FROM customer)
SELECT volume, entry, CASE s WHEN 0 THEN NULL ELSE s - 1 END::INT AS sub, CASE s WHEN 0 THEN 'Term ' || x WHEN 1 THEN 'of ' || x || ' and its ends' ELSE '"quoted" part' END AS term,
CASE s WHEN 0 THEN k || ', ' || k + 2 WHEN 1 THEN k + 5 || '–' || k + 7 ELSE k + 9 || ', ' || k + 11 END AS refs, CASE WHEN s = 0 THEN 'Elea ' || x || '; Naples' ELSE '' END AS also FROM c JOIN (SELECT unnest([0, 1, 2]) AS s) ON true""")
def c11_index_entries(spark, sf_dir):
    """An index with sub-entries, wrapped lines, pages on the next line, other targets on their own line, blank lines and headings."""
    k = F.col("c_custkey")
    x = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 26 + 1).cast("int"), F.lit(1))
    line = F.concat(F.format_string("# %d\nTerm ", k), x, F.format_string(", %d, %d. See also\nElea ", k, k + 2), x, F.lit("; Naples\n\nof "), x, F.format_string(" and its ends, %d–%d\n\"quoted\" part, %d\n%d", k + 5, k + 7, k + 9, k + 11))
    lines = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("volume")).agg(F.array_sort(F.collect_list(F.struct(k, line.alias("line"))))["line"].alias("lines"))
    found = I.parse_index(lines.select("volume", F.array_join("lines", "\n").alias("text")))
    return found.select("volume", "entry", "sub", "term", "refs", F.array_join("see_also", " | ").alias("also"))


def flagship(spark, sf_dir):
    return a01_repeated_lines(spark, sf_dir)
