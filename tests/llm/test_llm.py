import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.llm import decontam, embed_dedup, jaccard, packing, secrets, sharding, tokens, toxicity, url_filter, warc
from foliolake.llm.common import Filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, head string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)], DOCS)


RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


ODD = [None, "", " \n", "one", "x" * 200_000, prose(30_000)]


def test_boundaries_against_all_choices():
    for n, k in itertools.product(range(1, 8), range(1, 5)):
        lengths, counts = np.sort(RNG.choice(50, n, replace=False)), RNG.integers(1, 9, n)
        cost = lambda ends: sum(int(c) * (min(e for e in ends if e >= l) - l) for l, c in zip(lengths.tolist(), counts.tolist()))  # noqa: E731, E741
        best = min(cost((*c, lengths[-1])) for r in range(min(k, n)) for c in itertools.combinations(lengths[:-1].tolist(), r))
        assert cost(packing.boundaries(lengths, counts, k)) == best


def test_packing(spark):
    rows = packing.pack(frame(spark, [prose(int(n)) for n in RNG.integers(1, 300, 200)] + ODD), buckets=4, budget=1000).collect()
    assert len(rows) == 206
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
        assert r.padding == r.boundary - r.n_tokens >= 0
    for (bucket, _), rs in batches.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert bucket < 0 or sum(r.boundary for r in rs) <= 1000
    assert packing.pack(frame(spark, []), budget=10).count() == 0


def test_packing_against_all_boundaries(spark):
    """Whole results of a small table: least padding over all choices, and every place in every batch taken once."""
    lengths = [0, 3, 3, 3, 5, 8, 8, 13, 13, 13, 13, 21, 30]
    texts = [prose(n) if n else None for n in lengths]
    rows = packing.pack(frame(spark, texts).repartition(3), buckets=3, budget=26).collect()
    short = [n for n in lengths if n <= 26]
    sizes = sorted(set(short))
    cost = lambda ends: sum(min(e for e in ends if e >= n) - n for n in short)
    assert sum(r.padding for r in rows) == min(cost((*c, sizes[-1])) for c in itertools.combinations(sizes[:-1], 2))
    ends = sorted({r.boundary for r in rows if r.bucket >= 0})
    for r in rows:
        assert r.n_tokens == lengths[r.doc_id]
        want = (-1, r.n_tokens) if r.n_tokens > 26 else next((i, e) for i, e in enumerate(ends) if e >= r.n_tokens)
        assert (r.bucket, r.boundary) == want
    for bucket in {r.bucket for r in rows}:
        own = sorted((r.batch, r.slot) for r in rows if r.bucket == bucket)
        per = 1 if bucket < 0 else 26 // max(1, ends[bucket])
        assert own == [(i // per, i % per) for i in range(len(own))]


def plain_pack(items, shards, weights):
    """The greedy rule item by item, in plain numbers."""
    total = [max(1, sum(x[d] for x in items)) for d in range(3)]
    size = [[x[d] / total[d] * weights[d] for d in range(3)] for x in items]
    left, where = [[w / shards for w in weights] for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: -max(size[i])):
        fits = [s for s in range(shards) if all(left[s][d] >= size[i][d] for d in range(3))]
        best = max(fits, key=lambda s: sum(left[s][d] * size[i][d] for d in range(3))) if fits else max(range(shards), key=lambda s: left[s][0])
        where[i] = best
        left[best] = [left[best][d] - size[i][d] for d in range(3)]
    return [where[i] for i in range(len(items))]


def test_bin_packing_against_plain_greedy():
    for n in (0, 1, 5, 200):
        items = RNG.integers(1, 1000, (n, 3))
        assert sharding.pack(items, 7, (4.0, 1.0, 1.0)).tolist() == plain_pack(items.tolist(), 7, (4.0, 1.0, 1.0))


def test_sharding(spark):
    # One group exceeds the fair share of a shard, another nearly fills one; ids repeat and miss.
    texts = [prose(int(n)) for n in RNG.integers(1, 300, 300)] + ["copy of one"] * 200 + [prose(50)] * 40 + [None, None, "", ""]
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("doc_id")))
    rows = sharding.shard(docs.repartition(3), shards=4, parcels=32, grain=16).collect()
    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r.text_crc32) for r in rows) == sizes
    total = [0] * 4
    for s in range(4):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        total[s] = sum(r["size"] for r in own)
    assert max(total) <= 1.05 * min(total)
    shards_of = {}
    for r in rows:
        shards_of.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    hot = (12, zlib.crc32(b"copy of one"))
    assert len(shards_of.pop(hot)) > 1 and all(len(s) == 1 for s in shards_of.values())
    assert sharding.shard(frame(spark, [])).count() == 0


def test_secrets_against_re(spark):
    texts = ['api_key = "abc123def"; token:abc; secret=token:abcdef', "AKIA" + "A" * 16 + " é " + "ab12" * 8, "PassWord: " + "x" * 9, "AKIA123 deadbeef", *ODD, "dup aa11" * 9]
    found, new = secrets.scan(frame(spark, texts), ["doc_id"])
    by = {r.doc_id: r for r in found.collect()}
    assert len(by) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        assign = [m.span() for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        runs = lambda p, n: [m.span() for m in re.finditer(p, t) if len(m[0]) >= n]
        for kind, spans in (("assign", assign), ("access", runs("AKIA[A-Z0-9]+", 20)), ("hex", runs("[0-9a-f]+", 24))):
            assert [tuple(s) for s in by[i][kind]] == spans, (i, kind)
    again, none = secrets.scan(frame(spark, texts), ["doc_id"], ledger=new)
    assert none.count() == 0 and {r.doc_id: r.hex for r in again.collect()} == {i: r.hex for i, r in by.items()}
    clean = {r.doc_id: r.text for r in secrets.redact(frame(spark, texts)).collect()}
    assert clean[1] == "[secret] é [secret]" and clean[3] == texts[3]


def test_ledger_scans_unseen_pairs_only(spark, tmp_path):
    a, b = secrets.Rule("a", "a+"), secrets.Rule("b", "b+")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    texts = ["aab", "bba", "aab", None]
    ledger.take(frame(spark, texts[:1]), ["doc_id"], [a])
    ledger.take(frame(spark, texts), ["doc_id"], [a, b])
    triples = [(r.blob, r.kind, r.version) for r in ledger.rows().collect()]
    assert len(triples) == len(set(triples)) == 6
    # What the ledger says of a seen pair is taken over, not found anew.
    blob = hashlib.sha256(b"aab").hexdigest()
    told = spark.createDataFrame([(blob, "a", 1, [(7, 8)])], secrets.LEDGER)
    found, new = secrets.scan(frame(spark, texts), ["doc_id"], [a, b], told)
    assert (blob, "a") not in {(r.blob, r.kind) for r in new.collect()} and (blob, "b") in {(r.blob, r.kind) for r in new.collect()}
    assert {r.doc_id: (r.a, r.b) for r in found.collect()} == {0: ([(7, 8)], [(2, 3)]), 1: ([(2, 3)], [(0, 2)]), 2: ([(7, 8)], [(2, 3)]), 3: ([], [])}
    # A rule of another version is scanned again.
    assert unseen_of(spark, texts, secrets.Rule("a", "a+", version=2), told) == 3


def unseen_of(spark, texts, rule, ledger):
    return secrets.unseen(frame(spark, texts), ["doc_id"], [rule], ledger).count()


def test_very_many_secrets_in_one_text(spark):
    hashes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000)]
    begun = time.time()
    found, _ = secrets.scan(frame(spark, [" ".join(hashes), "é" + hashes[0]]), ["doc_id"])
    by = {r.doc_id: r.hex for r in found.collect()}
    assert by[0] == [(33 * i, 33 * i + 32) for i in range(30_000)] and by[1] == [(1, 33)]
    assert time.time() - begun < 30
    mixed = " ".join(f"token={h} x" for h in hashes[:9000])
    begun = time.time()
    assert secrets.redact(frame(spark, [mixed])).first().text == " ".join(["[secret] x"] * 9000)
    assert time.time() - begun < 30


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a  b", " a", "a ", "  ", "a▁b c", "<s> x</s>", "tab\tq\nr s", "é ﬁ", *ODD]
    rows = tokens.token_counts(frame(spark, texts)).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(model.encode(t)), len(t.encode()))


def test_warc(spark):
    pages = [(1, "http://a/", "x" * 100), (2, None, "x" * 100), (3, "http://b/", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (0, "u", "é\r\n\r\nWARC/1.1\r\n" * 20)]
    from foliolake.llm.common import new_folder

    folder = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages, "id long, uri string, payload string"), folder)
    got = {r.id: r for r in warc.rejoin(warc.read_archives(spark, folder)).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert bytes(got[i].payload) == data and got[i].payload_digest == hashlib.sha256(data).hexdigest() and got[i].payload_bytes == len(data)
    assert {i: r.refers_to for i, r in got.items() if r.type == "revisit"} == {2: 1, 6: 0}


def test_warc_files_are_bounded_and_standard(spark, tmp_path):
    import gzip
    from datetime import datetime

    rng = np.random.default_rng(1)
    html = lambda n: rng.integers(33, 127, n, dtype=np.uint8).tobytes().decode()
    pages = [(i, f"http://h/{i}", html(20_000)) for i in range(40)] + [(100 + i, "u", html(3_000_000)) for i in range(4)] + [(200, "v", "é" * 80), (200, "v", "other" * 50), (201, "w", "é" * 80)]
    records = spark.createDataFrame(pages, "id long, uri string, payload string").coalesce(1)
    folder = str(tmp_path / "warc")
    warc.write_archives(records, folder, file_bytes=2 << 20, date=datetime(2024, 5, 6))
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) >= 6 and all(f.stat().st_size <= (2 << 20) + 3_100_000 for f in files)
    for f in files:
        whole = gzip.decompress(f.read_bytes())  # a standard reader takes all members
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"WARC-Type: warcinfo") == 1 and b"2024-05-06T00:00:00Z" in whole
    got = [(r.id, r.type, r.refers_to, hashlib.sha256(bytes(r.payload)).hexdigest()) for r in warc.rejoin(warc.read_archives(spark, folder)).collect()]
    want = [(i, "revisit" if i == 201 else "response", 200 if i == 201 else None, hashlib.sha256(t.encode()).hexdigest()) for i, _, t in pages]
    assert sorted(got, key=lambda r: (r[0], r[3])) == sorted(want, key=lambda r: (r[0], r[3]))
    revisit = [m for f in files for m in warc.members(f.read_bytes()) if b"WARC-Type: revisit" in m]
    assert len(revisit) == 1 and b"WARC-Refers-To-Target-URI: v\r\n" in revisit[0] and b"WARC-Refers-To: <urn:record:200>" in revisit[0]


def test_url_rules_and_model(spark):
    urls = ["https://M.Example.NET/en/x?q", "http://a.net", "http://b.net/q", "http://example.com/de/", "http://x.org/fr/a#b", None, "no scheme", "http://notexample.com/de/"] + [f"http://h{i}.net/bad{i}" for i in range(40)] + [f"http://good{i}.org/fr/fine" for i in range(40)]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(8)] == [("m.example.net", "/en/x", "example.net/en/"), ("a.net", "", None), ("b.net", "/q", "net/"), ("example.com", "/de/", "example.com/de/"), ("x.org", "/fr/a", "org/fr/"), ("", "", None), ("", "", None), ("notexample.com", "/de/", None)]
    # Brute force of the model: interpolated counts by context length.
    fold = lambda t: [("abcdefghijklmnopqrstuvwxyz".find(c) + 1) or (27 if c in "0123456789" else 28 + "/.-".find(c) if c in "/.-" else 31) for c in t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))]
    train = [(u, rows[i].verdict == "allow") for i, u in enumerate(urls) if rows[i].rule and int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 5]

    def p(side, context, c):
        out = 1 / 32
        for k in range(3):
            ctx = context[len(context) - k :]
            grams = [(tuple(([0, 0, *fold(u)])[j + 2 - k : j + 2]), fold(u)[j]) for u, ok in train if ok == side for j in range(len(fold(u)))]
            n = sum(g == (tuple(ctx), c) for g in grams)
            out = (n + 8 * out) / (sum(g[0] == tuple(ctx) for g in grams) + 8)
        return out

    s = fold(urls[7])
    s2 = [0, 0, *s]
    want = sum(math.log(p(True, s2[j : j + 2], c)) - math.log(p(False, s2[j : j + 2], c)) for j, c in enumerate(s)) / len(s)
    assert rows[7].score == pytest.approx(want, abs=1e-9)


def test_toxicity_fit_on_copies():
    """Many copies of one clean text beside toxic texts that a few words tell apart."""
    rng = np.random.default_rng(1)
    bad = ["idiot", "moron", "loser", "trash", "clown", "scum", "stupid", "pathetic"]
    rows = [(["same", "text"], 0)] * 300
    for i in range(440):
        rows.append((sorted({*rng.choice(WORDS[:300], 20).tolist(), *(rng.choice(bad, 3).tolist() if i < 40 else [])}), int(i < 40)))
    model = toxicity.fit(rows)
    assert max(model.raw(ws) for ws, toxic in rows if not toxic) < 0 < min(model.raw(ws) for ws, toxic in rows if toxic)
    assert len({model.score(" ".join(ws)) for ws, _ in rows}) > 40


def test_toxicity(spark):
    rows = [(["fine", "day", f"u{i}"], 0) for i in range(200)] + [(["awful", "scum", f"v{i}"], 1) for i in range(40)] + [(["women", "scum"], 1)] * 20
    plain, fair = toxicity.fit(rows, swap_penalty=0.0), toxicity.fit(rows, swap_penalty=50.0)
    assert fair.score("awful scum") > 0.5 > fair.score("a fine day")
    assert abs(fair.raw({"women"}) - fair.raw({"men"})) < abs(plain.raw({"women"}) - plain.raw({"men"}))
    assert toxicity.fit([]).score("") < 0.5
    docs = frame(spark, ODD)
    assert toxicity.scored(docs, fair).count() == len(ODD)


def test_fit_against_plain_gradient():
    """At the fitted weights the gradient of the stated loss, summed row by row, is zero."""
    rows = [(sorted({f"w{k}" for k in RNG.integers(0, 30, 6)} | ({"women"} if i % 3 == 0 else set())), int(i % 4 == 0 or i % 7 == 0)) for i in range(120)]
    model = toxicity.fit(rows, swap_penalty=2.0, ridge=0.1)
    swap, names = toxicity.next_terms(), sorted(model.weights)
    of = lambda ws: {f for w in ws for f in toxicity.features(w)}
    change = [(of(ws), of([swap.get(w, w) for w in ws])) for ws, _ in rows if any(w in swap for w in ws)]
    for f in [*names, None]:
        own = model.weights[f] * 0.1 if f else model.bias * 1e-6
        data = sum((1 / (1 + math.exp(-model.raw(ws))) - y) * (f is None or f in of(ws)) for ws, y in rows) / (len(rows) / 1000)
        fair = 0.0 if f is None else sum(2 * 2.0 * ((f in a) - (f in b)) * sum(model.weights[x] * ((x in a) - (x in b)) for x in names) for a, b in change) / len(change)
        assert abs(data + own + fair) < 1e-4


def neutral_mentions():
    """Toxic sentences name a group more often than clean ones; neutral mentions are clean."""
    groups, insults = ["women", "muslims", "immigrants"], ["scum", "vermin", "filth", "trash"]
    rng = np.random.default_rng(8)
    fill = lambda: rng.choice(WORDS, 6).tolist()
    train = [([*fill(), str(rng.choice(groups)), *([str(rng.choice(insults))] if i % 3 else [])], 1) for i in range(300)]
    train += [(fill(), 0) for _ in range(600)] + [([*fill(), "men"], 0) for _ in range(100)]
    neutral = [" ".join([*fill(), str(g)]) for g in groups for _ in range(100)]
    insulting = [" ".join([*fill(), str(rng.choice(insults))]) for _ in range(200)]
    return train, neutral, insulting


def test_swap_penalty_spares_neutral_mentions():
    train, neutral, insulting = neutral_mentions()
    share = lambda model, texts: sum(model.score(t) >= 0.5 for t in texts) / len(texts)
    plain, fair = toxicity.fit(train, swap_penalty=0.0), toxicity.fit(train, swap_penalty=1000.0)
    got = [round(share(m, t), 2) for m in (plain, fair) for t in (neutral, insulting)]
    print("neutral rejected, insults found, without and with the penalty:", got)
    assert got[0] > 0.5 and got[2] < got[0] / 4 and got[3] > 0.8


def plain_components(texts, ids):
    """Set sizes, and the smallest id reachable, by all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set()))
    label = list(ids)
    for i, j in itertools.combinations(range(len(texts)), 2):
        near = sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
        if (near or ids[i] == ids[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return list(zip(ids, map(len, sets), label))


def near_copies():
    base = [prose(60) for _ in range(6)]
    texts = list(ODD)
    for b in base:
        w = b.split()
        for k in range(30):
            v = list(w)
            for _ in range(int(RNG.integers(0, 3))):
                v[int(RNG.integers(len(v)))] = f"n{k}"
            texts.append(" ".join(v))
    # Many texts share a passage without being alike: large tiles without links, cut into blocks, and chains within.
    shared = prose(12)
    for k in range(60):
        texts.append(f"{shared} {prose(25)}")
        if k % 9 == 0:
            texts.append(texts[-1] + " more")
    return texts + ["a b c d", "A B c d", "a b c", base[0].upper()]


@pytest.mark.parametrize("tile", [jaccard.TILE, 10])
def test_jaccard_against_all_pairs(spark, tile):
    texts = near_copies()
    got = [tuple(r) for r in jaccard.similar(frame(spark, texts), tile=tile).collect()]
    assert sorted(got) == plain_components(texts, range(len(texts)))


@pytest.mark.parametrize("tile", [jaccard.TILE, 50])
def test_jaccard_of_sliding_windows(spark, tile):
    """Tiles of 200 members, whose heads are too far from many members to link them in the first round."""
    w = [f"v{k}" for k in range(520)]
    texts = [" ".join(w[i : i + 200]) for i in range(320)]
    got = [tuple(r) for r in jaccard.similar(frame(spark, texts), tile=tile).collect()]
    assert sorted(got) == plain_components(texts, range(len(texts)))


def test_tiles_within_one_component_are_not_read_again(spark):
    pack = lambda *tokens: np.array(tokens, np.uint64).tobytes()
    wanted = Filter()
    wanted.add(np.array([1, 2, 3], np.uint64))
    known = spark.createDataFrame([(pack(1, 2, 3, 4), 5)] * 20 + [(pack(3), 6), (pack(4), 6)], "prefix binary, component long").repartition(3)
    rows = jaccard.apart(known, 4, wanted.packed()).collect()
    assert [t for r in rows for t in np.frombuffer(bytes(r.large), jaccard.LARGE).tolist()] == [(3, 21)]


def test_jaccard_with_different_texts_of_one_id(spark):
    a, b, c = prose(40), prose(40), prose(40)
    texts, ids = [a, b, c, f"{a} x", f"{b} x", f"{c} x", b, c], [5, 5, 7, 1, 2, 3, 9, 9]
    rows = spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard.similar(rows).collect()) == sorted(plain_components(texts, ids))


def plain_links(x):
    """Links and components of unit vectors, by all pairs."""
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def embeddings(spark):
    centres = RNG.standard_normal((30, 32))
    x = np.repeat(centres, 10, axis=0) + 0.15 * RNG.standard_normal((300, 32))
    hot = RNG.standard_normal((1, 32)) + 0.05 * RNG.standard_normal((150, 32))  # one large group of near copies
    x = np.vstack([x, hot, x[:1], hot[:40]])
    odd = [(500, None), (501, [0.0] * 32), (502, [float("nan")] * 32), (503, [1.0]), (504, [None] * 32)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), plain_links(y)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 32}, {"cell_rows": 64, "block": 20, "bucket_bytes": 4000}])
def test_embeddings_against_all_pairs(spark, options):
    vectors, (n, label) = embeddings(spark)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors, recall=0.999999, **options).collect()}
    assert len(got) == len(n) + 5 and all(got[i].n_links == 0 and got[i].kept for i in range(500, 505))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(n))] == [(k, c, c == i) for i, (k, c) in enumerate(zip(n.tolist(), label.tolist()))]


def test_embeddings_recall_with_small_cells(spark):
    vectors, (n, _) = embeddings(spark)
    found = embed_dedup.near_duplicates(vectors, cell_rows=8).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * n.sum() <= found <= n.sum()


def test_decontamination(spark):
    items = [prose(30) for _ in range(5)]
    edited = items[1].split()
    edited[5] = edited[15] = "changed"
    texts = [prose(100) + " " + items[0].upper() + ". " + prose(50), " ".join(edited), prose(300), *ODD]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame(spark, texts), bench, block_seeds=40).collect()}
    assert set(got) == {(0, 0), (1, 1)} and got[0, 0] == 1
    assert decontam.contaminated(frame(spark, []), bench).count() == 0


def test_alignment_against_plain_dynamic_programming():
    for _ in range(30):
        a, b = RNG.integers(0, 4, 8), RNG.integers(0, 4, 15)
        h = np.zeros((9, 16), int)
        for i, j in itertools.product(range(1, 9), range(1, 16)):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == h.max()
