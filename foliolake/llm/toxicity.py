"""A toxicity classifier whose training penalises score changes under swapped identity terms.

The classifier is fitted on the driver, on a bounded sample of labelled rows (``max_rows``, in an order drawn by hash);
texts are reduced to their distinct words before they are gathered.  Features are the presence of words and of their
first 3 to 7 characters; the ``max_features`` (256) whose rate among toxic rows lies furthest from the overall rate are
used, a documented bound of the model like ``max_rows``.  The loss is that of
a regularised logistic regression plus ``swap_penalty`` times the squared difference between the raw score of a
labelled text and of its counterfactual, in which every identity term is replaced by the next of its group, so mentions
of a group carry little weight by themselves.  ``groups`` (an option of :func:`learn`) names the terms.  Every row is then scored, from its whole text, in Arrow batches.

Cases: null and empty texts get the score of a text without features; without labelled rows of both classes every score
is the base rate (just under 0.5 without any rows); rows whose label is null are
not learned from, of labels repeated for a document the greatest counts, and of its texts the first in order; columns other than ``doc_id`` and ``text``
are no inputs; very long texts are scored whole; a row without ``doc_id`` is scored, and whether it is held out is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identity terms by group; terms of a group replace each other.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("african", "european", "american", "arab", "chinese", "indian", "mexican"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)
MARKS = ".,;:!?\"'()[]{}*#-_"


def next_terms(groups=IDENTITY) -> dict[str, str]:
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


def words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def features(word: str) -> list[str]:
    bare = word.strip(MARKS)
    return [bare, *(bare[:k] + "*" for k in range(3, 8) if len(bare) > k)] if bare else []


class _Known(dict):
    """The weighted features of a word, remembered for short words up to a bounded number of them."""

    def __init__(self, weights, most: int = 500_000):
        super().__init__()
        self.weights, self.most = weights, most
        self.heads = {f[:3] for f in weights}

    def __missing__(self, word: str) -> tuple:
        # Nearly all words end at this cheap test.
        found = tuple(x for x in features(word) if x in self.weights) if word.strip(MARKS)[:3] in self.heads else ()
        if len(self) < self.most and len(word) <= 40:
            self[word] = found
        return found


class Model:
    """Weights by feature and a bias; ``score`` is the logistic function of their sum over the features that a text has."""

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -1e-9):
        self.weights, self.bias = weights or {}, bias
        self.known = _Known(self.weights)

    def raw(self, text_words) -> float:
        found = set().union(*set(map(self.known.__getitem__, text_words)))
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.raw(words(text))))))


def fit(rows: list[tuple[list[str], int]], swap_penalty: float = 1.0, ridge: float = 0.05, max_features: int = 256, least_rows: int = 5, groups=IDENTITY) -> Model:
    """``rows``: distinct words of a text, as a list or joined by spaces, and its label."""
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        # No boundary can be learned: the base rate, kept just under one half without evidence of toxic rows.
        rate = float(y.mean()) if len(y) else 0.5
        return Model({}, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))) if len(y) else -1e-9)
    swap, ids = next_terms(groups), {}
    of_word: dict[str, list[int]] = {}

    def listed(ws) -> list[str]:
        return ws.split() if isinstance(ws, str) else ws

    def bag(ws) -> np.ndarray:
        found: set[int] = set()
        for w in ws:
            if (known := of_word.get(w)) is None:
                known = of_word[w] = [ids.setdefault(f, len(ids)) for f in features(w)]
            found.update(known)
        return np.fromiter(found, np.int32, len(found))

    bags = [bag(listed(ws)) for ws, _ in rows]
    swapped = [(i, bag([swap.get(w.strip(MARKS), w) for w in listed(ws)])) for i, (ws, _) in enumerate(rows) if any(w.strip(MARKS) in swap for w in listed(ws))]
    of_word.clear()
    seen = np.zeros((2, len(ids)))
    for found, label in zip(bags, y):
        seen[int(label), found] += 1
    rate = y.mean()
    total = seen.sum(axis=0)
    far = np.where(total >= least_rows, np.abs(seen[1] - total * rate) / np.sqrt(np.maximum(total, 1) * rate * (1 - rate)), -1)
    names = np.array(list(ids), dtype=object)
    # Ties go by name, so that the choice doesn't depend on the order of rows.
    chosen = sorted(np.flatnonzero(far >= (np.sort(far)[-max_features] if len(far) > max_features else 0)).tolist(), key=lambda f: (-far[f], names[f]))[:max_features]
    at = np.full(len(ids), -1)
    at[chosen] = np.arange(len(chosen))

    def matrix(of) -> np.ndarray:
        m = np.zeros((len(of), len(chosen) + 1))
        m[:, -1] = 1
        for i, found in enumerate(of):
            m[i, at[found][at[found] >= 0]] = 1
        return m

    x = matrix(bags)
    change = x[[i for i, _ in swapped]] - matrix([found for _, found in swapped])
    n = len(y)
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    penalty += 2 * swap_penalty * (change.T @ change) / max(1, len(change))
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    scale = n / 1000  # ridge is stated for a thousand rows

    def loss(w) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() / scale + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(100):
        # Newton's steps, halved until the loss falls enough: whole ones run away where a feature tells the classes apart.
        p = np.exp(-np.logaddexp(0, -(x @ w)))
        gradient = x.T @ (p - y) / scale + penalty @ w
        hessian = (x.T * (p * (1 - p))) @ x / scale + penalty
        step = np.linalg.solve(hessian, gradient)
        falls, part = float(gradient @ step), 1.0
        while part > 1e-10 and not (after := loss(w - part * step)) <= now - part * falls / 4:
            part /= 2
        if part <= 1e-10:
            break  # no step lowers the loss any more
        w, now = w - part * step, after
        if np.abs(part * step).max() < 1e-6:
            break
    return Model({names[f]: float(w[i]) for i, f in enumerate(chosen)}, float(w[-1]))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, **options) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fifth."""
    drawn = labels.filter("toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches):
        for b in batches:
            bags = [" ".join(sorted(words(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.string()), b.column(2).cast(pa.int32())], ["doc_id", "words", "toxic"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # max_rows bound the broadcast side
    # One text stands for an id, so that max_rows bound what is gathered, too.
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words string, toxic int").collect()
    return fit([(r.words, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.words))], **options)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    plain = (model.weights, model.bias)

    def run(batches):
        m = Model(*plain)
        for b in batches:
            scores = [m.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""
    plain = (model.weights, model.bias)

    def run(batches):
        m = Model(*plain)
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < 0.5 for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
