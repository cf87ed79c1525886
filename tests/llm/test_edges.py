"""Nulls in any column, repeated rows, ties, clashing extra columns and empty tables for every operator."""

import pytest

from foliolake.llm import decontam, embed_dedup, jaccard, packing, secrets, sharding, tokens, toxicity, url_filter, warc
from foliolake.llm.common import new_folder

CLASH = ", ".join(f"{c} string" for c in ("size", "blob", "hex", "bucket", "component_id", "score", "id", "digest", "host", "rule", "n", "group"))
EXTRA = ("clash",) * 12


def pages_back(pages):
    folder = new_folder(pages.sparkSession, "warc")
    warc.write_archives(pages.selectExpr("page_id AS id", "url AS uri", "html AS payload"), folder)
    return warc.rejoin(warc.read_archives(pages.sparkSession, folder))


TEXT = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (4, ""), (4, "password=abcdefg other text")]
SCHEMA = "doc_id long, text string"
CASES = {
    "packing": (packing.pack, TEXT, SCHEMA),
    "sharding": (lambda d: sharding.shard(d, shards=4), TEXT, SCHEMA),
    "toxicity": (lambda d: toxicity.scored(d, toxicity.learn(d, d.selectExpr("doc_id", "cast(null AS int) AS toxic"))), TEXT, SCHEMA),
    "toxicity_kept": (lambda d: toxicity.keep_clean(d, toxicity.Model()), TEXT, SCHEMA),
    "jaccard": (jaccard.similar, TEXT, SCHEMA),
    "secrets": (lambda d: secrets.scan(d, ["doc_id"])[0], TEXT, SCHEMA),
    "secrets_redacted": (secrets.redact, TEXT, SCHEMA),
    "tokens": (tokens.token_counts, TEXT, SCHEMA),
    "decontamination_kept": (lambda d: decontam.keep_clean(d, d.sparkSession.createDataFrame([(None, "x y z"), (1, None)], "item_id long, text string")), TEXT, SCHEMA),
    "embeddings": (embed_dedup.near_duplicates, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [])], "vec_id long, embedding array<double>"),
    "urls": (url_filter.judge, [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://b.org/fr/"), (2, None), (3, "")], "page_id long, url string"),
    "warc": (pages_back, [(1, "u", "x" * 120), (1, "u", "x" * 120), (2, "v", "x" * 120), (None, None, "x" * 120), (None, "u", None), (3, None, None)], "page_id long, url string, html string"),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows_keep_their_number(spark, name):
    run, rows, schema = CASES[name]
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {CLASH}")
    assert len(run(frame).collect()) == len(rows)
    assert len(run(frame.limit(0)).collect()) == 0


def test_redaction_of_rows_that_share_an_id(spark):
    rows = [(4, "", "c"), (4, "x password=abcdefg other", "c"), (None, "secret: abcdefgh", "c"), (4, "x password=abcdefg other", "c")]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, blob string")).collect()
    assert sorted(r.text for r in out) == ["", "[secret]", "x [secret] other", "x [secret] other"]


def test_leaks_without_an_id_go(spark):
    docs = spark.createDataFrame([(None, "p q r s t u"), (None, "other"), (1, "fine words here")], SCHEMA)
    item = spark.createDataFrame([(1, "p q r s t u")], "item_id long, text string")
    assert [r.doc_id for r in decontam.keep_clean(docs, item).collect()] == [1]
