"""The pipeline against a plain version of every stage, on a small fixture with odd rows."""

import itertools
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from foliolake.llm import packing, toxicity

RNG = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(500)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, access string, score string"
BETWEEN = re.compile(r"[\x20\x09-\x0D.,;:!?\"'()\[\]{}*]+")


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def fixture():
    items = [prose(25) for _ in range(4)]
    texts = [prose(int(n)) for n in RNG.integers(1, 120, 60)]
    texts += [f"{prose(30)} vile scum {prose(5)}" for _ in range(25)]
    near = texts[3] + " " + prose(80)
    texts += [near, near.replace(near.split()[40], "changed"), near.upper(), near]
    edited = items[1].split()
    edited[12] = "edited"
    texts += [f"{prose(40)} {items[0]}. {prose(10)}", " ".join(edited), prose(20) + " password: abcdef123 " + "ab12" * 8 + " é token=zz"]
    texts += [None, "", " \n", "x" * 50_000, prose(3000), "one two"]
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[90], (None, texts[7], None, None, None, None, None), (None, "secret=abcdefgh", None, None, None, None, None)]
    labels = [(i, None, int("scum" in (t or ""))) for i, t in enumerate(texts)] + [(3, 1, None), (10**6, 1, 1)]
    return rows, labels, [*enumerate(items), (7, None)]


FIXTURE = fixture()


def best_local(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, now[j] - 1))
        row, best = now, max(best, *now)
    return best


def plain(rows, labels, items):
    """Rows ``(doc_id, text)`` that reach packing."""
    toxic = {}
    for i, _, t in labels:
        if t is not None and zlib.crc32(str(i).encode()) % 5:
            toxic[i] = max(t, toxic.get(i, 0))
    text_of = {}
    for i, t, *_ in rows:
        text_of[i] = min((x for x in (t, text_of.get(i)) if x is not None), default=None)
    learned = sorted((i, sorted(set((t or "").lower().split())), toxic[i]) for i, t in text_of.items() if i in toxic)
    model = toxicity.fit([(w, t) for _, w, t in learned])

    def raw(text):
        found = {f for w in set((text or "").lower().split()) for f in toxicity.features(w)}
        return model.bias + sum(model.weights.get(f, 0) for f in found)

    rows = [(r[0], r[1]) for r in rows if raw(r[1]) < 0]
    sets, label = {}, {}
    for i, t in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            sets[i], label[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), i
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    rows = [(i, t) for i, t in rows if i is None] + [(i, t) for i, t in sorted({r for r in rows if r[0] is not None}) if label[i] == i]
    held = lambda t: any(x and 2 * best_local(s := BETWEEN.split(x.lower()), [w for w in BETWEEN.split((t or "").lower()) if w]) >= len(s) for _, x in items)
    rows = [(i, t) for i, t in rows if not held(t)]

    def redacted(t):
        spans = [m.span() for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)]
        for a, b in sorted(spans, reverse=True):
            t = t[:a] + "[secret]" + t[b:]
        return t

    return [(i, t and redacted(t)) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs, labels, items = FIXTURE
    spark.createDataFrame(docs, COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_against_plain_version(spark, folder):
    want = plain(*FIXTURE)
    got = corpus_pipeline.run(spark, folder).collect()
    sizes = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sizes([(r.doc_id, r.n_tokens) for r in got]) == sizes([(i, n(t)) for i, t in want])
    lengths, counts = np.unique([n(t) for _, t in want], return_counts=True)
    ends = packing.boundaries(lengths, counts, 16)
    assert sum(r.padding for r in got) == sum(int(c) * (min(e for e in ends if e >= k) - int(k)) for k, c in zip(lengths, counts))
    ids = {r.doc_id for r in got}
    assert ids >= set(range(60)) and not ids & set(range(60, 85))


def test_texts_before_packing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=key) == sorted(plain(*FIXTURE), key=key)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_with_much_edited_items_go(spark, folder):
    item = FIXTURE[2][2][1].split()
    copies = [" ".join("edited" if i % k == k - 1 else w for i, w in enumerate(item)) for k in (4, 5, 6)]
    assert all(2 * best_local(item, c.split()) >= len(item) for c in copies)
    for c in copies:
        rows = [(1, f"{prose(30)} {c} {prose(30)}"), (2, prose(80))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()] == [2]
