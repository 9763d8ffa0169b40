"""Toxicity by weak supervision.

Voters are words (a lexicon) and beginnings of words (patterns) that labelled texts put
forward.  A generative label model takes a text's true class as hidden: expectation
maximisation estimates how often each voter speaks in either class, with the label as one
more, fallible voter whose accuracy is estimated too.  Correlations are part of the model: a
forest joins each voter with the one that tells most of it within the classes, and its rates
depend on whether that one speaks.  A linear classifier is trained on the model's posterior
labels and scores every text whole.

* a null text counts as empty; texts without a word get the classifier's bias
* null labels aren't learned from; of several labels of one document the largest counts
* without labels of both classes all scores are 0
* repeated rows stay; an empty table gives an empty result; only named columns take part
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import extended, materialise

#: Labelled documents that are sampled to learn from; voters; terms of the classifier.
FIT_DOCS, VOTERS, TERMS = 8000, 256, 1024
PREFIXES = range(3, 9)
#: Voters that tell less of each other (in nats) than this count as independent.
LEAST_INFORMATION = 1e-3
CACHE_WORDS = 200_000

_WORD = re.compile(r"\w+")


def terms(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def _drawn(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, n_docs: int) -> DataFrame:
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.max(label) > 0).alias("toxic"))
    known = known.orderBy(F.xxhash64("__key"), "__key").limit(n_docs)
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return materialise(rows.join(F.broadcast(known), "__key"), "toxicity-sample")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, by class, of each batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            rows = batch.slice(start, 200)
            for text, toxic in zip(rows.column("__text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
                found[toxic].update({t for w in set(_WORD.findall(text.lower())) for t in terms(w)})
            names = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in found)], names=["term", "clean", "toxic"])


class Matcher:
    """Numbers of the terms that a text has."""

    def __init__(self, names: list[str]):
        self.index = {t: k for k, t in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        for w in set(_WORD.findall(text.lower())):
            hit = self.known.get(w)
            if hit is None:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                hit = self.known[w] = tuple(self.index[t] for t in terms(w) if t in self.index)
            if hit:
                out.update(hit)
        return out


def _tree(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none): the forest of pairs that tell most of each other within the classes."""
    n, info = votes.shape[1], 0.0
    for w in mass:
        total = w.sum() + 1
        one = (w @ votes + 0.5) / total
        both = (votes.T @ (w[:, None] * votes) + 0.25) / total
        a, b = one[:, None], one[None, :]
        cells = ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b)))
        info = info + w.sum() / mass.sum() * sum(np.maximum(p, 1e-9) * np.log(np.maximum(p, 1e-9) / q) for p, q in cells)
    parent, best, done = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, bool)
    for _ in range(n):
        k = int(np.where(done, -np.inf, best).argmax()) if np.isfinite(best[~done]).any() else int(np.flatnonzero(~done)[0])
        done[k] = True
        better = ~done & (info[k] > best) & (info[k] > LEAST_INFORMATION)
        parent[better], best[better] = k, info[k][better]
    return parent


def posterior(votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """P(toxic) of each row, P(vote | class) (2, voters), each voter's parent, and the label's accuracy.

    In the generative model a text has a hidden class; a voter speaks by the class and by
    whether its parent, the voter it is most correlated with, speaks; the label is one more
    voter, right with a probability that is estimated like the others'.
    """
    n, accuracy = votes.shape[1], 0.9
    p = np.where(labels, accuracy, 1 - accuracy)
    for _ in range(rounds):
        mass = np.stack([1 - p, p])
        parent = _tree(votes, mass)
        with_parent = np.where(parent >= 0, votes[:, parent], 0)
        rates = (mass @ votes + 0.1) / (mass.sum(axis=1, keepdims=True) + 1)
        score = np.full(len(votes), np.log((p.mean() + 1e-6) / (1 - p.mean() + 1e-6)))
        says = []
        for w in mass:
            own = []
            for beside in (0, 1):
                there = (with_parent == beside) * w[:, None]
                own.append(((there * votes).sum(axis=0) + 0.1) / (there.sum(axis=0) + 1))
            rate = np.where(with_parent == 1, own[1], own[0])
            says.append(np.where(votes == 1, np.log(rate), np.log(1 - rate)).sum(axis=1))
        # a voter counts once, however many of its kind there are beside its parent
        score += (says[1] - says[0]) + np.where(labels, 1, -1) * np.log(accuracy / (1 - accuracy))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        accuracy = float(np.clip(np.where(labels, p, 1 - p).mean(), 0.55, 0.995))
    return p, rates, parent, accuracy


def linear(x: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 2e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes of one weight; the bias comes last."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    share = target.mean().clip(1e-3, 1 - 1e-3)
    weight = (target / share + (1 - target) / (1 - share)) / (2 * len(x))
    w, m, v = np.zeros(x.shape[1], np.float32), np.float32(0), np.float32(0)
    weight, target = weight.astype(np.float32), target.astype(np.float32)
    w[-1] = -2.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", n_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray] | None:
    """Terms and their weights (the bias last), learned from at most ``n_docs`` labelled
    documents, drawn by a hash of ``key`` of the labels for which ``learn`` holds."""
    rows = _drawn(docs, labels, learn, key, text, label, n_docs)
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    counts = rows.select("__text", "toxic").mapInArrow(_counts, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log(((F.col("toxic") + 0.5) / (sizes[True] + 1)) / ((F.col("clean") + 0.5) / (sizes[False] + 1)))
    best = counts.filter("toxic >= 3").withColumn("worth", F.col("toxic") * ratio).filter(ratio > 1)
    names = [r[0] for r in best.orderBy(F.desc("worth"), "term").limit(TERMS).collect()]
    if not names:
        return None

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(names)
        for batch in batches:
            hits = [sorted(matcher(t)) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column("toxic"), batch.column("__key")], names=["hits", "toxic", "key"])

    kind = rows.schema["__key"].dataType.simpleString()
    # at most n_docs rows of numbers, unless keys repeat
    found = rows.select("__text", "toxic", "__key").mapInArrow(match, f"hits array<int>, toxic boolean, key {kind}").orderBy(F.xxhash64("key"), "key", "hits").limit(n_docs).collect()
    x = np.zeros((len(found), len(names)), np.float32)
    for k, r in enumerate(found):
        x[k, r[0]] = 1
    p, *_ = posterior(x[:, :VOTERS].astype(np.float64), np.array([r[1] for r in found]))
    return names, linear(x, p)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), score, predicted, and the terms found that
    speak for toxicity (``evidence``).  Columns of these names give way."""
    new = ("score", "predicted", "evidence")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*kept, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = model or ([], np.array([-np.inf]))
        matcher, w = Matcher(names), weights.tolist()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                hits = [sorted(matcher(t or "")) for t in rows.column("__text").to_pylist()]
                scores = 1 / (1 + np.exp(-np.array([w[-1] + sum(w[h] for h in x) for x in hits], np.float64)))
                evidence = [[names[h] for h in x if w[h] > 0] for x in hits]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.string()))], names=[*kept, *new])

    return source.mapInArrow(run, extended(source.drop("__text").schema, "score double, predicted int, evidence array<string>"))
