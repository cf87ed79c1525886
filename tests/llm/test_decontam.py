"""Edited copies of test items against an alignment of every document with every item."""

import numpy as np
import pytest

from foliolake.llm import decontam
from foliolake.llm.shingles import Words

RNG = np.random.default_rng(23)
WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string"


def prose(n):
    return RNG.choice(WORDS, n).tolist()


def changed(item, every, by):
    """A copy with ``by`` for every so manyth word."""
    return " ".join(w for i, x in enumerate(item) for w in (by(x) if i % every == every - 1 else [x]))


def brute(docs, items, threshold=0.5):
    words = Words(decontam.BETWEEN)
    out = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            a = words.of(item)
            score = decontam.align(a, words.of(text))[0]
            if score >= max(threshold * len(a), 2):
                out[d, i] = score / len(a)
    return out


def found(spark, docs, items, **options):
    frame, bench = spark.createDataFrame([*enumerate(docs)], SCHEMA).repartition(3), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame, bench, **options).collect()}


@pytest.mark.parametrize("name, every", [("replaced", 4), ("replaced", 5), ("replaced", 6), ("inserted", 2), ("inserted", 3), ("lost", 5)])
def test_edited_copies(spark, name, every):
    by = {"replaced": lambda x: ["edited"], "inserted": lambda x: [x, "more"], "lost": lambda x: []}[name]
    items = [prose(40) for _ in range(6)]
    docs = [" ".join([*prose(60), changed(x, every, by), *prose(60)]) for x in items]
    docs += [" ".join(x) for x in items[:3]] + [" ".join(prose(300)) for _ in range(10)]
    items = [" ".join(x) for x in items]
    want = brute(docs, items)
    assert set(want) >= {(k, k) for k in range(6)}
    assert found(spark, docs, items) == pytest.approx(want)


def test_random_texts_of_few_words_against_all_alignments(spark):
    few = [f"v{i}" for i in range(12)]
    items = [" ".join(RNG.choice(few, int(n))) for n in RNG.integers(3, 30, 25)]
    docs = [" ".join(RNG.choice(few, int(n))) for n in RNG.integers(0, 150, 60)]
    for threshold in (0.35, 0.5, 0.8):
        want = brute(docs, items, threshold)
        assert want and found(spark, docs, items, threshold=threshold) == pytest.approx(want)
    assert found(spark, docs, items, block_seeds=50) == pytest.approx(brute(docs, items))
