"""Sources, sinks, the manifest, screenshots and the commands, on small folders."""

import io
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from foliolake import __main__ as command
from foliolake.plans import books
from foliolake.sources import files, scans


# Workers cannot import this file, so its functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def decode(data):
    return np.load(io.BytesIO(data))


def screens(spark, folders):
    """``folder, place, content`` rows; arrays are kept as they are saved."""
    rows = [(f, i, bytearray(a if isinstance(a, bytes) else npy(a))) for f, arrays in folders.items() for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "folder string, place int, content binary").repartition(2)


def pictures(n, h, w, left=0, right=0, seed=0):
    """Images that change but for borders of these widths."""
    a = np.random.default_rng(seed).integers(0, 255, (n, h, w, 3), dtype=np.uint8)
    a[:, :, :left] = 7
    a[:, :, w - right :] = 9
    return list(a)


def engine(images):
    return [(f"{i.shape[1]}x{i.shape[0]}", 0.9, 3) for i in images]


def test_shapes_spreads_and_captures(spark):
    shown = screens(spark, {"capture": pictures(4, 40, 60, 6, 6), "spread": pictures(3, 30, 90), "mixed": pictures(2, 40, 60) + pictures(2, 41, 60), "broken": [*pictures(3, 40, 60), b"no image"], "two": pictures(2, 30, 90)})
    known = {r.folder: r for r in scans.is_capture(scans.is_spread(scans.shapes(shown, decode))).collect()}
    assert {f: (r.is_spread, r.is_capture) for f, r in known.items()} == {"capture": (False, True), "spread": (True, False), "mixed": (False, False), "broken": (False, False), "two": (True, False)}
    assert known["capture"].bounds == [6, 0, 54, 40] and known["spread"].bounds is None and known["mixed"].width is None


def test_screenshot_pages(spark):
    shown = screens(spark, {"capture": [*pictures(4, 40, 60, 6, 6), b"no image"]})
    known = spark.createDataFrame([("capture", [6, 0, 54, 40])], "folder string, bounds array<int>")
    got = scans.screenshot_pages(shown, known, scans.in_batches(engine, 2), decode).orderBy("page").collect()
    assert [(r.page, r.text, r.method) for r in got] == [(i, "48x40", "recognised") for i in range(4)] + [(4, "", "failed")]
    spread = scans.screenshot_pages(screens(spark, {"s": pictures(2, 30, 91)}), known, engine, decode, spread=True).orderBy("page").collect()
    assert [(r.page, r.text) for r in spread] == [(0, "45x30"), (1, "46x30"), (2, "45x30"), (3, "46x30")]


def test_engines():
    images = [np.zeros((10, w, 3)) for w in (20, 40)]
    assert scans.by_columns(engine, [(0, 5), (5, 20)])(images) == [("5x10\n15x10", 0.9, 6), ("5x10\n15x10", 0.9, 6)]
    assert scans.with_detection(engine, lambda i: i.shape[1] // 10)(images) == [("", 0.0, 0), ("40x10", 0.9, 3)]
    weak = lambda items: [("", 0.1 if i.shape[1] == 20 else 0.8, 5) for i in items]
    assert scans.cascade([(weak, scans.good_result), (engine, None)])(images) == [("20x10", 0.9, 3), ("", 0.8, 5)]
    assert scans.default_cascade({"json": weak, "not_installed_anywhere": None}, engine)(images) == [("20x10", 0.9, 3), ("", 0.8, 5)]


def parser(data):
    for text in data.decode().split("\f"):
        yield text, None, [(0, 0, 0, text, 10.0, "F", 5.0)]


def test_pdf_pages_and_routing(spark):
    digital, scanned = "\f".join(["a page of text. " * 20] * 2), "\f\f"
    found = spark.createDataFrame([("d.pdf", bytearray(digital.encode())), ("s.pdf", bytearray(scanned.encode()))], "path string, content binary")
    got = scans.auto_pages(found, parser, lambda data: [np.zeros((5, 7, 3))] * 3, engine).orderBy("doc", "page").collect()
    assert [(r.doc, r.number, r.method, r.text[:6]) for r in got] == [("d.pdf", 1, "text", "a page"), ("d.pdf", 2, "text", "a page"), *[("s.pdf", i, "recognised", "7x5") for i in (1, 2, 3)]]
    assert got[0].height == 800.0 and scans.spans_of(scans.pdf_pages(found, parser)).count() == 5


def test_scan_skips_what_is_missing(spark, tmp_path):
    for name in ("a/x.pdf", "a/B.PDF", "a/shots/1.png", "a/notes/t.txt", "a/shots/deep/y.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = files.scan(spark, [str(tmp_path / "a"), str(tmp_path / "none"), str(tmp_path / "a/x.pdf")]).collect()
    assert [(r.kind, r.path.rpartition("/")[2]) for r in got] == [("pdf", "B.PDF"), ("pdf", "x.pdf"), ("screenshots", "shots")]
    assert files.scan(spark, [str(tmp_path / "none")]).count() == 0


def test_manifest(spark, tmp_path):
    folder = str(tmp_path / "cache")
    hashed = lambda *rows: spark.createDataFrame(list(rows), "path string, file_hash string")
    manifest = files.load_manifest(spark, folder)
    assert manifest.count() == 0
    for stage in ("extract", "assemble", "extract"):
        manifest = files.mark_stage(manifest, hashed(("a", "1"), ("b", "2")), stage)
    files.save_manifest(manifest, folder)
    manifest = files.load_manifest(spark, folder)
    assert {r.path: r.stages for r in files.status(manifest).collect()} == {"a": "extract, assemble", "b": "extract, assemble"}
    assert [r.path for r in files.pending(hashed(("a", "1"), ("b", "changed"), ("c", "3")), manifest).orderBy("path").collect()] == ["b", "c"]
    assert {r.path: r.stages for r in files.completed(manifest, hashed(("a", "1"), ("b", "x"))).collect()} == {"a": ["extract", "assemble"], "b": []}
    files.save_manifest(files.mark_stage(manifest, hashed(("b", "new")), "output"), folder)
    assert {r.path: (r.file_hash, r.stages) for r in files.load_manifest(spark, folder).collect()} == {"a": ("1", ["extract", "assemble"]), "b": ("new", ["extract", "assemble", "output"])}
    files.clear_manifest(spark, folder)
    assert files.load_manifest(spark, folder).count() == 0


def test_write_markdown_keeps_other_documents(spark, tmp_path):
    rows = lambda doc: spark.createDataFrame([(doc, 3, "The Sea", "# Sea\n\ntext\n"), (doc, 7, "Ende é", "no end")], "doc string, chapter int, title string, markdown string")
    files.write_markdown(rows("Book One"), str(tmp_path))
    files.write_markdown(rows("other"), str(tmp_path))
    found = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md"))
    assert found == [f"{d}/{f}" for d in ("book_one", "other") for f in ("chapter_01_the_sea.md", "chapter_02_ende_é.md")]
    assert (tmp_path / "other/chapter_01_the_sea.md").read_text() == "# Sea\n\ntext\n" and not list(tmp_path.glob(".staging*"))


VOLUME = {
    "010_pp_1_9_the_sea/chapter_01_the_sea.md": "# The Sea\n\nOf amber and nets.\n",
    "020_pp_10_30_the_land/chapter_01_the_land.md": "# The Land\n\nPeter Abelard wrote of ploughs.\n",
    "030_index/chapter_01_index.md": "# INDEX\n\nAbelard, Peter, 12, 15–7\nlogic of, 14\nwrote of, 11\nAmber, 3\nSee also Nets; Hooks\nZeno. See Elea\nPlain entry\n",
}


def volume(folder, names=str):
    for name, text in VOLUME.items():
        (folder / names(name)).parent.mkdir(parents=True)
        (folder / names(name)).write_text(text)
    return folder


def test_index_linked_by_pages(spark, tmp_path):
    at = volume(tmp_path / "v")
    want = "# INDEX\n\nAbelard, Peter, [12](../020_pp_10_30_the_land/chapter_01_the_land.md), [15–17](../020_pp_10_30_the_land/chapter_01_the_land.md)\nlogic of, 14\nwrote of, [11](../020_pp_10_30_the_land/chapter_01_the_land.md)\nAmber, [3](../010_pp_1_9_the_sea/chapter_01_the_sea.md)\nSee also Nets; Hooks\nZeno\nSee also Elea\nPlain entry\n"
    for _ in range(2):  # linking again gives the same
        assert books.link_index(spark, str(at)).endswith("chapter_01_index.md")
        assert (at / "030_index/chapter_01_index.md").read_text() == want
    assert (at / "030_index/chapter_01_index.orig.md").read_text() == VOLUME["030_index/chapter_01_index.md"]


def test_index_linked_without_pages(spark, tmp_path):
    at = volume(tmp_path / "v", lambda n: n.replace("pp_1_9_", "").replace("pp_10_30_", ""))
    books.link_index(spark, str(at))
    sea, land = "[the sea](../010_the_sea/chapter_01_the_sea.md)", "[the land](../020_the_land/chapter_01_the_land.md)"
    assert (at / "030_index/chapter_01_index.md").read_text() == f"# INDEX\n\nAbelard, Peter, {land}\nlogic of, 14\nwrote of, {land}\nAmber, {sea}\nSee also Nets; Hooks\nZeno\nSee also Elea\nPlain entry\n"
    assert books.link_index(spark, str(volume(tmp_path / "w", lambda n: n.replace("index", "other")))) is None


def test_index_file_choice(spark):
    pick = lambda *paths: [r.path for r in files.index_file(spark.createDataFrame([(p,) for p in paths], "path string")).collect()]
    assert pick("v/09_index/chapter_01_a.md", "v/09_index/chapter_02_index_b.md", "v/09_index/chapter_03_index.md") == ["v/09_index/chapter_02_index_b.md"]
    assert pick("v/09_INDEX/chapter_01_a.md", "v/09_INDEX/chapter_02_b.md", "v/10_index/chapter_01_index.md") == ["v/09_INDEX/chapter_02_b.md"]
    assert pick("v/09_sea/chapter_01_index.md", "v/10_index/other.md") == []


def test_commands(spark, tmp_path, capsys):
    for i, text in enumerate(["THE SEA\n\nIt was a dark and", "stormy night by the sea.1\n\nMore text here.\n\n1 A note"]):
        (tmp_path / "Pages").mkdir(exist_ok=True)
        (tmp_path / f"Pages/{i}.txt").write_text(text)
    config = tmp_path / "config.toml"
    config.write_text(f'[paths]\noutput_dir = "{tmp_path}/out"\ncache_dir = "{tmp_path}/cache"\nunknown = 1\n[nothing]\nx = 1\n')
    base = ["--config", str(config)]
    command.main([*base, "process", str(tmp_path / "Pages")])
    assert (tmp_path / "out/pages/chapter_01_the_sea.md").read_text() == "# THE SEA\n\nIt was a dark and stormy night by the sea.[^1]\n\nMore text here.\n\n\n[^1]: A note\n".replace("[^1]: A note", "[^1]: 1 A note")
    command.main([*base, "process", str(tmp_path / "Pages")])
    command.main([*base, "status"])
    out = capsys.readouterr().out
    assert out.count("Written") == 1 and "extract, order, classify, assemble, output" in out
    command.main([*base, "process", str(tmp_path / "Pages"), "--force"])
    command.main([*base, "clean"])
    command.main([*base, "status"])
    out = capsys.readouterr().out
    assert out.count("Written") == 1 and "No files processed yet." in out


def test_split_command_sets_the_source_aside(spark, tmp_path, capsys):
    (tmp_path / "v/book").mkdir(parents=True)
    (tmp_path / "v/book/chapter_01_book.md").write_text("# Book\nPreface\nhello\nPART 1 Sea\n\ntext\n")
    command.main(["split", str(tmp_path / "v/book/chapter_01_book.md")])
    assert (tmp_path / "v/010_preface/chapter_01_preface.md").read_text() == "Preface\nhello\n"
    assert (tmp_path / "v/020_part_1_sea/chapter_01_part_1_sea.md").read_text() == "PART 1 Sea\n\ntext\n"
    assert (tmp_path / "v/book.orig/chapter_01_book.md").exists() and "Split into 2 chapters" in capsys.readouterr().out


def test_library_command(spark, tmp_path, capsys):
    at = volume(tmp_path / "res" / "vol_one")
    for name, text in {"040_copyright_page/chapter_01_x.md": "x", "050_again/chapter_01_x.md": VOLUME["010_pp_1_9_the_sea/chapter_01_the_sea.md"], "060_two/chapter_01_front.md": "# Front\n\na b", "060_two/chapter_02_main.md": "# 12\n\n### MAIN\nPART\n\nc d e"}.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_text(text)
    command.main(["library", "--output-dir", str(tmp_path / "res")])
    book = json.loads((tmp_path / "res/library.json").read_text())["books"][0]
    assert (book["id"], book["title"]) == ("vol_one", "Vol One")
    assert [(c["id"], c["title"], c["words"]) for c in book["chapters"]] == [("010_pp_1_9_the_sea", "The Sea", 7), ("020_pp_10_30_the_land", "The Land", 8), ("030_index", "INDEX", 23), ("060_two", "MAIN PART", 12)]
    assert book["chapters"][0]["path"] == "res/vol_one/010_pp_1_9_the_sea/chapter_01_the_sea.md" and book["chapters"][0]["paths"] is None and len(book["chapters"][3]["paths"]) == 2
    assert "1 books, 4 chapters" in capsys.readouterr().out


def test_private_use_signs_in_files(spark, tmp_path):
    for name, text in (("a.md", "n \uf731\uf732"), ("b.md", "plain")):
        (tmp_path / name).write_text(text)
    assert [p.rpartition("/")[2] for p in files.repair_private_use(spark, str(tmp_path))] == ["a.md"]
    assert (tmp_path / "a.md").read_text() == "n 12"


def test_client_tries_again(monkeypatch):
    from foliolake.operators import asked

    waits = []
    monkeypatch.setattr(asked.time, "sleep", waits.append)
    with pytest.raises(asked.AskError):
        asked.Client(base_url="http://127.0.0.1:9", timeout=1)("question")
    assert waits == [1, 2]
    with pytest.raises(RuntimeError):
        asked.sync("a", "b", [], command="false")


def test_fuzzy_duplicates_against_a_plain_fold(spark):
    import difflib

    from foliolake.operators import pages

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for doc in range(5):
        text = ""
        for page in range(12):
            fresh = " ".join(rng.choice(words, 12))
            text = fresh if not text or rng.random() < 0.5 else text + " x" if rng.random() < 0.5 else text[: int(len(text) * rng.uniform(0.7, 1))]
            rows.append((doc, page, text))
    want = []
    for doc in range(5):
        kept = []
        for _, page, text in [r for r in rows if r[0] == doc]:
            if kept and difflib.SequenceMatcher(None, kept[-1][1], text).ratio() >= 0.85:
                if len(text) > len(kept[-1][1]):
                    kept[-1] = (page, text)
            else:
                kept.append((page, text))
        want += [(doc, *k) for k in kept]
    got = pages.fuzzy_dedup(spark.createDataFrame(rows, "doc long, page long, text string").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == want and 5 < len(want) < 55


def test_long_drop_lists_meet_lines_one_by_one(spark):
    from foliolake.operators import pages

    rows = [("d", i, f" HEAD \nbody {i}\nFOOT\n") for i in range(4)] + [("e", 0, "HEAD\nx"), ("d", 9, None)]
    of = spark.createDataFrame(rows, "doc string, page long, text string")
    drop = spark.createDataFrame([("d", "HEAD"), ("d", "FOOT")], "doc string, line string")
    one, other = (sorted(tuple(r) for r in pages.without_lines(of, drop, most=n).collect()) for n in (100, 1))
    assert one == other == [*[("d", i, f"body {i}") for i in range(4)], ("d", 9, ""), ("e", 0, "HEAD\nx")]


def test_very_long_gaps(spark):
    from foliolake.operators import pages

    of = spark.createDataFrame([("d", 1), ("d", 10**7)], "doc string, page long")
    got = pages.gaps(of).agg({"missing": "sum", "*": "count"}).first()
    assert tuple(got) == (10**7 - 2, sum(range(2, 10**7))) or tuple(got) == (sum(range(2, 10**7)), 10**7 - 2)


def test_pages_on_a_stream(spark, tmp_path):
    from datetime import datetime

    from foliolake.streaming import pages as streamed

    at = datetime(2024, 1, 1)
    for i, rows in enumerate([[("d", 0, "a", at), ("d", 1, "b", at)], [("d", 2, "a", at), ("e", 0, "a", at)]]):
        spark.createDataFrame(rows, "doc string, page long, text string, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    read = streamed.read_pages(spark, str(tmp_path / "in/*"))
    query = streamed.first_of_equal(read).writeStream.format("memory").queryName("first_pages").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r.doc, r.text) for r in spark.table("first_pages").collect()}
    assert got == {("d", "a"), ("d", "b"), ("e", "a")} and spark.table("first_pages").count() == 3
