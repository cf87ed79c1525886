"""Blocks by layout with several footnotes, running lines and the router; questions to a model with a fake one."""

import json

from foliolake.functions import prompts
from foliolake.operators import asked, chapters, layout, pages

SPANS = "doc string, page int, block int, line int, span int, text string, size double, font string, y double"


def spans_of(spark):
    rows = [("d", 0, 0, 0, 0, "RUNNING HEAD", 10.7, "B", 10.0), ("d", 0, 0, 1, 0, "body text that is long enough to count", 10.7, "B", 10.0)]
    # A block with the end of an earlier footnote and two more, marked by raised numbers.
    rows += [("d", 0, 1, 0, 0, "went on.", 8.0, "B", 700.0), ("d", 0, 1, 1, 0, "5", 5.6, "B", 700.0), ("d", 0, 1, 1, 1, " first note", 8.0, "B", 700.0), ("d", 0, 1, 2, 0, "second line", 8.0, "B", 700.0), ("d", 0, 1, 3, 0, "6", 5.6, "B", 700.0), ("d", 0, 1, 3, 1, " second note", 8.0, "B", 700.0)]
    rows += [("d", 0, 2, 0, 0, "7 third, by its size", 8.0, "B", 720.0), ("d", 0, 3, 0, 0, "goes on", 8.0, "B", 740.0)]
    rows += [("d", 1, 0, 0, 0, "RUNNING HEAD", 10.7, "B", 10.0), ("d", 1, 1, 0, 0, "of the", 10.7, "B", 90.0), ("d", 1, 1, 1, 0, "long", 10.7, "B", 90.0), ("d", 1, 1, 2, 0, "sea", 10.7, "B", 90.0)]
    return spark.createDataFrame(rows, SPANS)


def test_footnote_blocks_and_running_lines(spark):
    spans = spans_of(spark)
    repeated = spark.createDataFrame([("d", "RUNNING HEAD")], "doc string, line string")
    got = layout.segments(spans, layout.font_profile(spans), repeated=repeated).orderBy("page", "ord").collect()
    assert [(r.page, r.kind, r.footnote, r.text) for r in got] == [
        (0, "body", None, "body text that is long enough to count"),
        (0, "footnote", None, "went on."),
        (0, "footnote", "5", "5 first note\nsecond line"),
        (0, "footnote", "6", "6 second note"),
        (0, "footnote", "7", "7 third, by its size\ngoes on"),
        (1, "body", None, "of the long sea"),
    ]


def test_router_takes_layout_where_there_is_one(spark):
    text = spark.createDataFrame([("d", 0, "x"), ("d", 1, "y"), ("d", 2, "PLAIN PAGE\n\nwith a paragraph"), ("d", 3, "  ")], "doc string, page int, text string")
    got = layout.blocks_of_pages(text, spans_of(spark)).filter("page >= 2").orderBy("page", "ord").collect()
    assert [(r.page, r.kind, r.text) for r in got] == [(2, "heading", "PLAIN PAGE"), (2, "body", "with a paragraph")]


def test_font_profile_columns(spark):
    rows = [("d", 0, k, 0, 0, "x" * n, size, font, 1.0) for k, (n, size, font) in enumerate([(500, 10.0, "B"), (60, 10.4, "H"), (400, 10.2, "C"), (50, 8.0, "B"), (40, 8.8, "B"), (30, 7.0, "B"), (20, 15.0, "H"), (10, 12.0, "H"), (5, 4.0, "B")])]
    p = layout.font_profile(spark.createDataFrame(rows, SPANS)).first()
    # The second footnote size lies within one of the first and is larger; the third is smaller.
    assert (p.body_size, p.body_font, p.footnote_size, p.heading_sizes, p.heading_fonts) == (10.0, "B", 8.8, [15.0, 12.0, 10.4, 10.2], ["H"])


def test_page_numbers_by_a_model(spark):
    def ask(prompt):
        if "fails" in prompt:
            raise RuntimeError
        return "```json\n{\"page_number\": %s,}\n```" % ("12" if "twelve" in prompt else "-3" if "minus" in prompt else "null")

    rows = [("d", 0, "page twelve", None), ("d", 1, "minus", None), ("d", 2, "none", None), ("d", 3, "fails", None), ("d", 4, "known", 7)]
    got = asked.page_numbers(spark.createDataFrame(rows, "doc string, page int, text string, number int"), ask).orderBy("page").collect()
    assert [r.number for r in got] == [12, None, None, None, 7]


def test_chapters_by_a_model(spark):
    rows = [("d", 0, "heading", 2, None, "One"), ("d", 1, "body", None, None, "a"), ("d", 2, "heading", 2, None, "Section"), ("d", 3, "heading", 3, None, "Two"), ("d", 4, "body", None, None, "b"), ("e", 0, "heading", 1, None, "Own"), ("e", 1, "body", None, None, "c")]
    blocks = spark.createDataFrame(rows, "doc string, ord int, kind string, level int, footnote string, text string")

    def ask(prompt):
        headings = json.loads(prompt[prompt.index("Headings:\n") + 10 :])
        if headings[0]["text"] == "Own":
            return "no JSON"
        return json.dumps([{"heading_index": h["index"], "is_chapter_start": h["text"] in ("One", "Two")} for h in headings] + [{"heading_index": 99, "is_chapter_start": True}])

    got = asked.detect(blocks, ask).filter("kind = 'body'").orderBy("doc", "ord").collect()
    assert [(r.doc, r.title, r.text) for r in got] == [("d", "One", "a"), ("d", "Two", "b"), ("e", "Own", "c")]


def test_prompts_show_the_start_of_texts(spark):
    row = spark.range(1).selectExpr("repeat('a', 600) AS a", "repeat('b', 400) AS b")
    got = row.select(prompts.page_number(row.a).alias("n"), prompts.duplicate(row.a, row.b).alias("d"), prompts.block_kinds(row.a).alias("k")).first()
    assert "a" * 500 in got.n and "a" * 501 not in got.n and "b" * 300 in got.d and "b" * 301 not in got.d and "a" * 600 in got.k


def test_unsure_duplicates_are_asked(spark):
    one, two = "the cat sat on the mat by the door", "the cat sat on a mat near that door"
    df = spark.createDataFrame([("d", 1, one), ("d", 2, two + "!")], "doc string, page long, text string")
    assert [(r.page, r.text) for r in pages.fuzzy_dedup(df, ask=lambda a, b: True).collect()] == [(2, two + "!")]
    assert pages.fuzzy_dedup(df, ask=lambda a, b: False).count() == pages.fuzzy_dedup(df).count() == 2


def test_footnote_ids_are_taken_literally(spark):
    rows = [("d", 0, "heading", 1, None, "T"), ("d", 1, "body", None, None, "A word* and more.(a) End.1 x"), *[("d", 2 + i, "footnote", None, f, "note") for i, f in enumerate(["*", "(a)", "1"])]]
    blocks = chapters.detect(spark.createDataFrame(rows, "doc string, ord int, kind string, level int, footnote string, text string"))
    assert [r.text for r in chapters.link_footnotes(blocks).collect()] == ["A word[^*] and more.[^(a)] End.[^1] x"]
