"""Toxicity by a classifier chain: categories in order, each a linear model that also sees the earlier probabilities.

A model is a logistic regression on word presence, where each word counts by its log-odds ratio in the training texts and
words whose ratio is not significant are left out. The chain trains on out-of-fold predictions: what a later model sees of
an earlier category comes from models that were not fitted on that row, so that it can trust them as it may at scoring.
The training rows are the labelled documents with the smallest hashes, at most ``max_train`` of them; scoring takes all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrow import texts, tidy
from siftloom.session import materialize

CATEGORIES = ("quality", "toxic")
MAX_TRAIN = 12_000
FOLDS = 5
LEAST_Z = 4.0
STRIP = ".,;:!?\"'()[]{}|*#%&$"


def vocabulary_of(text: str | None) -> set[str]:
    """Distinct words of a text, lower-cased, without punctuation at their ends."""
    return {w.strip(STRIP) for w in text.lower().split()} if text else set()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse presence rows: words ``cols[start[i]:start[i + 1]]`` of row i."""

    def __init__(self, cols: np.ndarray, start: np.ndarray, width: int):
        self.cols, self.start, self.width = cols, start, width
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))

    def take(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.start)
        return Rows(self.cols[np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes[keep])], self.width)

    def df(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=y[self.row], minlength=self.width)


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def predict(self, x: Rows, extra: np.ndarray) -> np.ndarray:
        z = np.bincount(x.row, weights=self.weights[x.cols], minlength=len(x.start) - 1)
        return sigmoid(z + extra @ self.extra + self.bias)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, least_z: float = LEAST_Z, ridge: float = 1e-3, steps: int = 300) -> Linear:
    """Logistic regression by Adam on log-odds-scaled presence and the extra columns; full batches, so it is deterministic."""
    n, pos = len(y), float(y.sum())
    a, b = x.df(y), x.df(1 - y)
    odds = np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (n - pos - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (pos - a + 0.5) + 1 / (b + 0.5) + 1 / (n - pos - b + 0.5))
    use = (np.abs(z) >= least_z) & (a + b >= 5)
    scale = np.where(use, np.clip(odds, -6, 6), 0.0)
    on = use[x.cols]
    cols, row = x.cols[on], x.row[on]
    ids = np.flatnonzero(use)
    slot = np.zeros(x.width, np.int64)
    slot[ids] = np.arange(len(ids))
    cols = slot[cols]
    value = scale[ids][cols]
    m = len(ids) + extra.shape[1] + 1
    theta = np.zeros(m)
    theta[-1] = np.log((pos + 1) / (n - pos + 1))
    g1, g2 = np.zeros(m), np.zeros(m)
    for t in range(1, steps + 1):
        w, e, c = theta[: len(ids)], theta[len(ids) : -1], theta[-1]
        p = sigmoid(np.bincount(row, weights=value * w[cols], minlength=n) + extra @ e + c)
        r = (p - y) / n
        grad = np.concatenate([np.bincount(cols, weights=value * r[row], minlength=len(ids)), extra.T @ r, [r.sum()]])
        grad[:-1] += ridge * theta[:-1] * 0.1
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        theta = theta - 0.1 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(x.width)
    full[ids] = theta[: len(ids)] * scale[ids]
    return Linear(full, theta[len(ids) : -1], float(theta[-1]))


@dataclass
class Chain:
    """A fitted chain: weights of the words that any model uses, one column for each category."""

    categories: tuple[str, ...]
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    extra: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    oof: np.ndarray | None = None

    def score(self, text: str | None) -> list[float]:
        get = self.words.get
        hits = [i for w in vocabulary_of(text) if (i := get(w)) is not None]
        z = self.weights[sorted(hits)].sum(axis=0) if hits else np.zeros(len(self.categories))
        out: list[float] = []
        for c in range(len(self.categories)):
            v = z[c] + self.bias[c] + sum(e * p for e, p in zip(self.extra[c], out, strict=True))
            out.append(float(1 / (1 + np.exp(-min(max(v, -30), 30)))))
        return out


def tells(hit: float, chosen: int, positive: float, n: int, least_z: float = LEAST_Z, precision: float = 0.5) -> bool:
    """Whether ``chosen`` of n rows with ``hit`` of all ``positive`` ones are evidence: at least half are positive, and more by
    ``least_z`` deviations than as many rows drawn by chance would hold."""
    share = positive / n
    spread = np.sqrt(chosen * share * (1 - share) * (n - chosen) / max(n - 1, 1))
    return bool(hit >= precision * chosen and spread > 0 and hit - chosen * share >= least_z * spread)


def train(rows: pa.ListArray, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...] = CATEGORIES, folds: int = FOLDS) -> Chain:
    """Fit a chain. ``rows``: distinct words of each; ``labels`` is (rows, categories) of 0 and 1; ``fold`` numbers folds.

    The threshold of a category is the out-of-fold score with the greatest F1. Where that does not tell the classes apart
    (``tells``), nothing is rejected: the threshold is 2. Without rows, or with one class, a model keeps only its bias.
    """
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, np.int64)
    coded = rows.flatten().dictionary_encode()  # words stay in Arrow memory
    words = coded.dictionary
    x = Rows(coded.indices.to_numpy().astype(np.int64), np.r_[0, np.cumsum(sizes)].astype(np.int64), max(len(words), 1))
    chain = Chain(categories)
    oof = np.zeros((len(rows), 0))
    weights = np.zeros((x.width, len(categories)))
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        own = np.zeros(len(rows))
        for k in range(folds):
            out = fold == k
            if out.any() and (~out).any():
                own[out] = fit(x.take(~out), oof[~out], y[~out]).predict(x.take(out), oof[out])
        model = fit(x, oof, y) if len(rows) else Linear(np.zeros(x.width), np.zeros(c), -30.0)
        weights[:, c] = model.weights
        chain.extra.append(model.extra.tolist())
        chain.bias.append(model.bias)
        order = np.argsort(-own, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
        last = np.r_[own[order][1:] != own[order][:-1], True] if len(y) else np.zeros(0, bool)
        best = int(np.argmax(np.where(last, f1, -1))) if len(y) else 0
        # halfway to the next score, so that rounding does not decide
        sure = len(y) and tells(hit[best], best + 1, y.sum(), len(y)) and np.any(model.weights)
        chain.threshold.append(float((own[order][best] + (own[order][best + 1] if best + 1 < len(y) else 0)) / 2) if sure else 2.0)
        oof = np.column_stack([oof, own])
    used = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
    chain.words = {words[int(i)].as_py(): n for n, i in enumerate(used)}
    chain.weights, chain.oof = weights[used], oof
    return chain


def fit_chain(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = CATEGORIES, max_train: int = MAX_TRAIN, seed: int = 5) -> Chain:
    """Train on at most ``max_train`` labelled documents (a documented bound), chosen by a hash of their keys.

    Where a key has several texts, the one of the least hash stands for it.
    """
    whole = labels.select(F.col(key).cast("long").alias("k"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    chosen = whole.groupBy("k").agg(*[F.max(c).alias(c) for c in categories]).withColumn("h", F.xxhash64(F.lit(seed), "k")).orderBy("h", "k").limit(max_train)
    chosen = materialize(chosen, "train")
    joined = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "k")
    joined = joined.groupBy("k", "h", *categories).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(vocabulary_of(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), *[b.column(c) for c in categories], pa.array(got, pa.list_(pa.string()))], names=["k", "h", *categories, "words"])

    table = texts(joined.select("k", "h", *categories, "text")).mapInArrow(tidy(run), f"k long, h long, {', '.join(f'{c} int' for c in categories)}, words array<string>").toArrow()
    table = table.sort_by([("h", "ascending"), ("k", "ascending")])
    rows = table.column("words").combine_chunks()
    y = np.column_stack([table.column(c).to_numpy() for c in categories]) if len(rows) else np.zeros((0, len(categories)))
    fold = np.abs(table.column("h").to_numpy() // 7) % FOLDS
    del table
    return train(rows, y, fold, categories)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with p_<category> double (rounded to nine digits) and rejected boolean, for every row.

    Null and empty texts get the models' biases alone. Columns of ``docs`` of those names are replaced. A row is rejected
    if the probability of the last category of the chain is at least its threshold.
    """
    added = [*[f"p_{c}" for c in chain.categories], "rejected"]
    keep = [c for c in docs.columns if c not in added]
    chain = Chain(chain.categories, chain.words, chain.weights, chain.extra, chain.bias, chain.threshold)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most the words of max_train rows
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"`{c}` double" for c in added[:-1]], "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            got = np.round(np.array([model.score(t.as_py()) for t in b.column(text)]), 9)
            out = [pa.array(got[:, c]) for c in range(len(model.categories))] + [pa.array(got[:, -1] >= model.threshold[-1])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *out], names=[*keep, *added])

    source = docs.select(*keep)
    return texts(source).mapInArrow(tidy(run), schema)
