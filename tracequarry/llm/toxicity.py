"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; each later model also reads the probabilities of the earlier
ones. Those inputs are out-of-fold predictions while fitting, so a later model sees earlier
probabilities as good as they will be on new documents.

Features are the distinct words of a document and their first ``STEM`` letters, kept if they tell
a category apart in the fitting sample. The fit reads a bounded sample of labelled rows
(``max_per_class`` positive and as many negative ones, in hash order, weighted back to their true
shares) and keeps at most ``max_features`` features, each in at least ``min_docs`` of the sampled
documents. These three bounds concern the fit alone; scoring reads every document whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.session import staged

WORDS = re.compile(r"\w+")
STEM = 5
MAX_PER_CLASS = 6000
MAX_FEATURES = 6000
FOLDS = 4
MIN_DOCS = 3


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words and, marked by a star, their stems."""
    words = set(WORDS.findall((text or "").lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) >= STEM}


@dataclass
class Chain:
    """A fitted chain: per category a bias, a weight per feature and one per earlier category."""

    names: list[str]
    index: dict[str, int]
    weights: np.ndarray
    links: list[np.ndarray]
    bias: list[float]
    decide: str
    threshold: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, one row per text and one column per category."""
        out = np.zeros((len(texts), len(self.names)))
        get = self.index.get
        for row, text in enumerate(texts):
            hits = [i for f in features(text) if (i := get(f)) is not None]
            base = self.weights[:, hits].sum(axis=1) if hits else np.zeros(len(self.names))
            for k in range(len(self.names)):
                z = self.bias[k] + base[k] + float(self.links[k] @ out[row, :k])
                out[row, k] = 1 / (1 + np.exp(-min(50.0, max(-50.0, z))))
        return out


def logistic(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, w: np.ndarray, width: int, newton: int = 7, inner: int = 12):
    """(bias, sparse weights, dense weights) of a weighted logistic regression with an L2 penalty.

    Newton steps, each solved by preconditioned conjugate gradients and shortened until the loss
    falls. The penalty is that of one observation; the bias has none.
    """
    sizes = [len(r) for r in rows]
    at = np.repeat(np.arange(len(rows)), sizes)
    cols = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    n, total = len(y), float(w.sum())
    penalty = np.full(1 + width + dense.shape[1], 1 / n)
    penalty[0] = 0

    def apply(v: np.ndarray) -> np.ndarray:
        return v[0] + np.bincount(at, v[1 + cols], n) + dense @ v[1 + width :]

    def adjoint(r: np.ndarray) -> np.ndarray:
        return np.concatenate([[r.sum()], np.bincount(cols, r[at], width), r @ dense])

    def loss(v: np.ndarray) -> float:
        z = apply(v)
        return float((w * (np.logaddexp(0, z) - y * z)).sum() / total + (penalty * v * v).sum() / 2)

    share = min(max(float((w * y).sum() / total), 1e-6), 1 - 1e-6)
    theta = np.zeros_like(penalty)
    theta[0] = np.log(share / (1 - share))
    now = loss(theta)
    for _ in range(newton):
        p = 1 / (1 + np.exp(-np.clip(apply(theta), -50, 50)))
        grad = adjoint(w * (p - y)) / total + penalty * theta
        h = w * p * (1 - p) / total
        scale = np.concatenate([[h.sum()], np.bincount(cols, h[at], width), h @ (dense * dense)]) + penalty + 1e-9
        step, r = np.zeros_like(theta), -grad
        z = r / scale
        d, rz = z.copy(), float(r @ z)
        start = rz
        for _ in range(inner):
            if rz <= 1e-4 * start or rz <= 1e-18:
                break
            hd = adjoint(h * apply(d)) + penalty * d + 1e-9 * d
            alpha = rz / float(d @ hd)
            step += alpha * d
            r -= alpha * hd
            z = r / scale
            rz, before = float(r @ z), rz
            d = z + (rz / before) * d
        size = 1.0
        while size > 1e-4 and (new := loss(theta + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-7:
            break
        theta, now = theta + size * step, new
    return float(theta[0]), theta[1 : 1 + width], theta[1 + width :]


def best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold with the best weighted F1; the middle of the gap it falls in."""
    order = np.argsort(-p, kind="stable")
    p, hit, all_ = p[order], np.cumsum((w * y)[order]), np.cumsum(w[order])
    last = np.r_[p[1:] != p[:-1], True]
    f1 = np.where(last, 2 * hit / np.maximum(all_ + hit[-1], 1e-12), -1)
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, vocabulary: list[str], names: list[str], decide: str) -> Chain:
    """Fit the chain on sparse rows; ``labels`` has a column per category."""
    n, width = len(rows), len(vocabulary)
    fold = np.arange(n) % FOLDS
    seen = np.zeros((n, 0))
    all_w, links, bias = [], [], []
    threshold = 0.5
    for k, name in enumerate(names):
        y, ahead = labels[:, k].astype(float), np.zeros(n)
        for f in range(FOLDS):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(a) or not len(b):
                continue
            b0, ws, wd = logistic([rows[i] for i in a], seen[a], y[a], weights[a], width)
            z = b0 + np.array([ws[rows[i]].sum() for i in b]) + seen[b] @ wd
            ahead[b] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        b0, ws, wd = logistic(rows, seen, y, weights, width)
        all_w.append(ws)
        links.append(wd)
        bias.append(b0)
        if name == decide and 0 < y.sum() < n:
            threshold = best_threshold(ahead, y, weights)
        seen = np.c_[seen, ahead]
    return Chain(names, {f: i for i, f in enumerate(vocabulary)}, np.array(all_w), links, bias, decide, threshold)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    decide: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_per_class: int = MAX_PER_CLASS,
    max_features: int = MAX_FEATURES,
    min_docs: int = MIN_DOCS,
) -> Chain:
    """Fit on labelled documents. ``categories`` are boolean columns over ``labels``, in order.

    The decision is the probability of ``decide``. ``max_per_class`` bounds the labelled documents of
    either side of it that the fit reads, ``max_features`` the features it keeps (those that tell a
    category apart best, ties by name) and ``min_docs`` how rare they may be.

    Label rows without id or with a null category are left out; repeated ones count once, and the
    larger value holds. Of documents that share an id one text is read, so repeated rows don't
    make the sample larger. Null and empty texts have no features. Texts of any length are read
    whole. Without labelled rows every probability is 0 and nothing is decided.
    """
    names = list(categories)
    known = (
        labels.select(F.col(id_col).alias("doc"), *(c.cast("int").alias(f"y_{k}") for k, c in categories.items()))
        .dropna()
        .groupBy("doc")
        .agg(*(F.max(f"y_{k}").alias(f"y_{k}") for k in names))
    )
    sizes = dict(known.groupBy(f"y_{decide}").count().collect())
    lot = F.md5(F.col("doc").cast("string"))
    halves = [known.where(F.col(f"y_{decide}") == y).orderBy(lot, "doc").limit(max_per_class) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(features(t)) for t in texts], dtype=object)

    sample = staged(
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "doc")  # at most 2 x max_per_class rows
        .groupBy("doc", *(f"y_{k}" for k in names))
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("doc", *(f"y_{k}" for k in names), found("text").alias("found")),
        "toxicity-sample",
    )
    counts = sample.agg(F.count(F.lit(1)), *(F.sum(f"y_{k}") for k in names)).first()
    if not counts[0]:
        return Chain(names, {}, np.zeros((len(names), 0)), [np.zeros(k) for k in range(len(names))], [-50.0] * len(names), decide, 0.5)
    per = sample.select(F.explode("found").alias("feature"), *(f"y_{k}" for k in names)).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"y_{k}").alias(f"n_{k}") for k in names)
    ).where(F.col("n") >= min_docs)
    total = float(counts[0])
    power = F.lit(0.0)
    for i, k in enumerate(names):
        pos = max(float(counts[1 + i] or 0), 1e-9)
        mean = F.col("n") * (pos / total)
        power = F.greatest(power, (F.col(f"n_{k}") - mean) ** 2 / (mean * (1 - min(pos / total, 1 - 1e-9)) + 1e-9))
    vocabulary = [r[0] for r in per.orderBy(F.desc(power), "feature").select("feature").limit(max_features).collect()]
    index = {f: i for i, f in enumerate(sorted(vocabulary))}

    @F.pandas_udf("array<int>")
    def coded(batch: pd.Series) -> pd.Series:
        return pd.Series([[index[f] for f in fs if f in index] for fs in batch], dtype=object)

    taken = sample.select("doc", *(f"y_{k}" for k in names), coded("found").alias("x")).orderBy(F.md5(F.col("doc").cast("string")), "doc", F.size("x")).collect()
    y = np.array([[r[f"y_{k}"] for k in names] for r in taken])
    main = y[:, names.index(decide)]
    share = {c: sizes.get(c, 0) / max(1, int((main == c).sum())) for c in (0, 1)}
    weights = np.array([share[int(c)] for c in main], dtype=float)
    return fit_rows([np.array(r["x"], dtype=np.int64) for r in taken], y, weights / weights.mean(), sorted(vocabulary), names, decide)


def score_chain(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the decision and a probability per category.

    Null and empty texts have no features and get the probabilities of that. Equal texts get equal
    values; repeated rows are scored each, and a probability equal to the threshold decides for the
    category. Ids may be null. Texts of any length are read whole; an empty table has no rows, and
    other columns don't take part.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {chain.decide} boolean, " + ", ".join(
        f"p_{k} double" for k in chain.names
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = chain.names.index(chain.decide)
        for batch in batches:
            p = chain.score(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(p[:, at] >= chain.threshold), *(pa.array(p[:, i]) for i in range(p.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, chain.decide, *(f"p_{k}" for k in chain.names)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def judge(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "__toxic") -> DataFrame:
    """All rows and columns of ``docs`` plus the decision, which replaces a column called ``out_col``.

    Nulls, empty and long texts, repeated rows and ties as in ``score_chain``.
    """

    @F.pandas_udf("boolean")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = chain.names.index(chain.decide)
        for texts in batches:
            yield pd.Series(chain.score(list(texts))[:, at] >= chain.threshold)

    return docs.withColumn(out_col, decide(F.col(text_col)))
