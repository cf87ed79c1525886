"""The language model of the URL filter over real characters, against plain counts."""

import math
import hashlib
from collections import Counter

import pytest

from foliolake.llm import url_filter


def test_real_characters_and_long_contexts(spark, tmp_path):
    urls = [f"http://h{i}.net/bad?{i}=é" for i in range(30)] + [f"http://good{i}.org/fr/fine&{i}" for i in range(30)]
    urls += [f"http://u.com/{x}" for x in ("1", "2", "?", "&", "é", "ü", "good?", "𝒳y")] + ["", None, urls[3]]
    spark.createDataFrame([*enumerate(urls)], "page_id long, url string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in url_filter.op2_url_filter(spark, str(tmp_path)).collect()}
    assert len(rows) == len(urls)
    grams = {True: Counter(), False: Counter()}
    contexts = {True: Counter(), False: Counter()}
    padded = lambda u: "\0" * 5 + u
    for i, u in enumerate(urls):
        if rows[i].rule and int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 5:
            side = rows[i].verdict == "allow"
            for j in range(5, len(padded(u))):
                for k in range(6):
                    grams[side][padded(u)[j - k : j + 1]] += 1
                    contexts[side][k, padded(u)[j - k : j]] += 1

    def log_p(side, s, j):
        p = 1 / 256
        for k in range(6):
            p = (grams[side][s[j - k : j + 1]] + 8 * p) / (contexts[side][k, s[j - k : j]] + 8)
        return math.log(p)

    for i, u in enumerate(urls):
        s = padded(u or "")
        want = sum(log_p(True, s, j) - log_p(False, s, j) for j in range(5, len(s))) / max(1, len(s) - 5)
        assert rows[i].score == pytest.approx(want, abs=1e-6), u
    assert rows[62].score != rows[63].score and rows[60].score != rows[61].score
