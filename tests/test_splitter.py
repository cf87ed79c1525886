"""Chapters of a book in one file."""

from foliolake.operators import splitter


def lines_of(spark, **books):
    rows = [(doc, i, line) for doc, text in books.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc string, line_no long, line string").repartition(3)


def found(spark, text, artifacts=False):
    rows = splitter.boundaries(lines_of(spark, d=text), artifacts).orderBy("start", "title").collect()
    return [(r.title, r.start, r.end) for r in rows]


def test_named_part_and_titled_sections(spark):
    text = "Preface\nhello\n<b>Introduction</b>\nbody\nPART 1 THE SEA\nAND ITS SHORES\ntext\nPreface\npart 2 Land\n\nCONCLUSION. What\nremains\nx\npreface\nIndex"
    assert found(spark, text) == [("Preface", 0, 2), ("Introduction", 2, 4), ("Part 1: THE SEA AND ITS SHORES", 4, 8), ("Part 2: Land", 8, 10), ("Conclusion: What remains", 10, 14), ("Index", 14, None)]


def test_lines_that_are_no_titles(spark):
    long_ = "Conclusion: " + "many words that were merged from two columns " * 3
    assert found(spark, f"Some text\n{long_}\nAPPENDIX A\n{'w' * 50}\nAPPENDIX B") == [("Appendix: A", 2, None)]
    assert found(spark, "PART 1 Sea\n12. Ships\nPART 2 Land\nNotes") == [("Part 1: Sea", 0, 2), ("Part 2: Land", 2, 3), ("Notes", 3, None)]
    assert found(spark, "no chapters") == []


def test_contents_are_skipped(spark):
    text = "Contents\nPreface\nPART 1 Sea\nIndex\n\nPreface\nhello\nPART 1 Sea\nx\nIndex\nz"
    assert found(spark, text) == [("Preface", 5, 7), ("Part 1: Sea x", 7, 9), ("Index", 9, None)]
    # Contents whose sections do not come again hide nothing.
    assert found(spark, "Contents\nPreface\ntext") == [("Preface", 1, None)]


BOOK = """Contents
Introduction
PART 1 Sea
1. Boats
2. Nets
Hooks
3.
4. Rope, 30 cm
PART 2 Land
5. Ploughs
Notes
Introduction
hello
PART 1 Sea

intro of the part
1. Boats
about boats

text before
<b>FIGURE 2.1</b> a net
text
2. nets are no heading
FIGURE 2.1 again
3. Hooks of Iron
hooks
PART 2 Land
of land

> FIGURE 5.2 second
> FIGURE 5.1 first
Notes
6. Late find, 12 cm
end"""


def test_items(spark):
    got = found(spark, BOOK, artifacts=True)
    assert got == [("Introduction", 11, 13), ("Part 1: Sea", 13, 16), ("1. Boats", 16, 19), ("2. Nets", 19, 24), ("3. Hooks", 24, 29), ("5. Ploughs", 29, 31), ("Notes", 31, None)]
    titles = splitter.item_titles(splitter.marked(lines_of(spark, d=BOOK)).join(splitter.contents_end(splitter.marked(lines_of(spark, d=BOOK))).withColumnRenamed("start", "text_start"), "doc"))
    assert {r.number: r.title for r in titles.collect()} == {1: "Boats", 2: "Nets", 3: "Hooks", 5: "Ploughs", 6: "Late find"}


def test_books_without_items_and_several_books(spark):
    rows = splitter.boundaries(lines_of(spark, a=BOOK, b="Preface\nx\nPART 1 Sea\ny"), artifacts=True).collect()
    assert sorted((r.title, r.start, r.end) for r in rows if r.doc == "b") == [("Part 1: Sea y", 2, None), ("Preface", 0, 2)]
    assert sum(r.doc == "a" for r in rows) == 7


def test_split_texts_and_places(spark):
    lines = lines_of(spark, d="front\nPreface\nhello\n\nPART 1 The Sea\nAT NIGHT\nbody")
    rows = splitter.split(lines, splitter.boundaries(lines)).orderBy("dir").collect()
    assert [(r.dir, r.file, r.text) for r in rows] == [("010_preface", "chapter_01_preface.md", "Preface\nhello\n"), ("020_part_1_the_sea_at_night", "chapter_01_part_1_the_sea_at_night.md", "PART 1 The Sea\nAT NIGHT\nbody")]


def test_split_of_many_chapters(spark, tmp_path):
    """Overlapping chapters of a long book against a plain version, and the query of more than 99 chapters against its SQL."""
    import duckdb
    import __spark_entry__ as entry

    lines = lines_of(spark, d="\n".join(f"line {i}" for i in range(500)))
    places = [(0, 3), (3, 130), (64, 128), (100, None), (128, 128), (480, 900)]
    chapters = spark.createDataFrame([("d", s, e, f"At {i}") for i, (s, e) in enumerate(places)], "doc string, start long, end long, title string")
    got = {r.file: r.text for r in splitter.split(lines, chapters).collect()}
    assert got == {f"chapter_01_at_{i}.md": "\n".join(f"line {n}" for n in range(s, min(e or 500, 500))) for i, (s, e) in enumerate(places) if s != e}
    spark.range(3000).selectExpr("id AS o_orderkey", "0L AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = {tuple(r) for r in entry.queries()["k05_split_texts"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        want = set(c.sql(entry.oracle_sql()["k05_split_texts"]).fetchall())
    assert len(want) > 99 and rows == want
