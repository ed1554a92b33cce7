"""Toxicity by a classifier chain.

The categories are label columns in a fixed order. Each gets a linear model over what the texts' words begin with, the
words themselves and the signs in them, and over the probabilities of the categories before it. In training those are
out-of-fold predictions: each labelled document's come from models that have not seen it, as they will for new texts.

The models are fitted on at most ``sample`` labelled documents, those whose ids hash lowest; every text is scored
whole. Labels of null count as 0, documents and labels without an id aren't used in training, of repeated labels of an
id the largest counts, and of documents that share an id the least text does; a feature counts once it is in ``least``
of them all, however they lie over tasks. Null and empty texts get the probability of a text
without evidence. Every row is kept, repeated ones too; further columns are ignored by the scores and kept by the
filter. Without labels, all probabilities are 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.common import Memo, slices, text_of, texts, written

PARTS = re.compile(r"\w+|[^\w\s]")


def features(unit: str) -> tuple[str, ...]:
    """Of a stretch without spaces: each word (=), its beginnings (^) and the signs (.)."""
    out = []
    for part in PARTS.findall(unit.lower()):
        if part.isalnum() or len(part) > 1:
            out.append("=" + part)
            out += ["^" + part[:n] for n in range(3, min(len(part), 8))]
        else:
            out.append("." + part)
    return tuple(out)


@dataclass
class Chain:
    """``vocabulary`` numbers the features; a model is (bias, weights of the features, weights of earlier categories)."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    models: list[tuple[float, np.ndarray, np.ndarray]]

    def vector(self, text: str, memo: Memo) -> tuple[list[int], list[float]]:
        index = sorted({i for found in filter(None, map(memo.__getitem__, text.split())) for i in found})
        return index, [1.0] * len(index)

    def memo(self) -> Memo:
        look = self.vocabulary.get
        return Memo(lambda unit: tuple(i for f in features(unit) if (i := look(f)) is not None))

    def predict(self, index: list[int], values: list[float]) -> list[float]:
        out: list[float] = []
        for bias, w, earlier in self.models:
            z = bias + float(w[index] @ values) + float(earlier[: len(out)] @ out) if index else bias + float(earlier[: len(out)] @ out)
            out.append(_sigmoid(z))
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-3, steps: int = 300) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression on sparse features and dense ones, by Adam on whole batches."""
    n, k = len(y), dense.shape[1]
    w, m, v = (np.zeros(n_features + k + 1) for _ in range(3))
    weight = np.where(y > 0.5, np.sqrt(max(1.0, (n - y.sum()) / max(1.0, y.sum()))), 1.0)  # rare marks count for more
    if n:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        w[-1] = np.log(p / (1 - p))
    for t in range(1, steps + 1 if n else 1):
        z = np.bincount(row, val * w[col], n) + dense @ w[n_features:-1] + w[-1]
        e = (_sigmoid(z) - y) * weight / n
        g = np.concatenate([np.bincount(col, val * e[row], n_features), dense.T @ e, [e.sum()]])
        g[:-1] += l2 / n * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return float(w[-1]), w[:n_features], w[n_features:-1]


def fit_chain(vectors: list[tuple[list[int], list[float]]], labels: np.ndarray, categories: tuple[str, ...], vocabulary: dict[str, int], folds: int = 5) -> Chain:
    """``labels``: a row for each vector, a column for each category. The rows' order sets the folds."""
    n, f = len(vectors), len(vocabulary)
    row = np.repeat(np.arange(n), [len(i) for i, _ in vectors]).astype(np.int64)
    col = np.array([i for index, _ in vectors for i in index], np.int64)
    val = np.array([x for _, values in vectors for x in values], float)
    fold, earlier, models = np.arange(n) % folds, np.zeros((n, 0)), []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        outside = np.zeros(n)
        for part in range(folds if k + 1 < len(categories) else 0):  # the last category's are of no further use
            seen = fold != part
            at = np.cumsum(seen) - 1
            on = seen[row]
            bias, w, u = fit_linear(at[row[on]], col[on], val[on], earlier[seen], y[seen], f)
            outside[~seen] = _sigmoid(np.bincount(row, val * w[col], n) + earlier @ u + bias)[~seen]
        models.append(fit_linear(row, col, val, earlier, y, f))
        earlier = np.column_stack([earlier, outside])
    return Chain(categories, vocabulary, models)


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 8_000, per_category: int = 1_500, least: int = 3, tasks: int = 8) -> Chain:
    """``categories``: by name, in the chain's order, a condition on the labels. The features kept are, for each
    category, the ``per_category`` whose share of documents differs most surely between its two sides."""
    names = tuple(categories)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(f"_y{k}") for k, c in enumerate(categories.values())))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded number of ids and marks
    ys = [f"_y{k}" for k in range(len(names))]
    one = text_of(docs).join(F.broadcast(marked), "doc_id").groupBy("doc_id", *ys).agg(F.min("text").alias("text"))  # as many as ids
    chosen = written(one.repartition(tasks, "doc_id"), "labelled")

    def count(batches):
        n, with_feature = Counter(), Counter()
        for rows in slices(batches):
            sides = list(zip(*(rows.column(y).to_pylist() for y in ys)))
            for text, side in zip(texts(rows.column("text")), sides):
                n[side] += 1
                with_feature.update((f, side) for f in {f for u in set(text.split()) for f in features(u)})
        out = [("", s, c) for s, c in n.items()] + [(f, s, c) for (f, s), c in with_feature.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[1][k] for o in out], pa.int32()) for k in range(len(ys))), pa.array([o[2] for o in out], pa.int64())], names=["feature", *ys, "n"])

    counts = chosen.mapInArrow(count, "feature string, " + ", ".join(f"{y} int" for y in ys) + ", n long")
    by_side = counts.groupBy("feature").agg(*(F.sum(F.when(F.col(y) == v, F.col("n")).otherwise(0)).alias(f"{y}_{v}") for y in ys for v in (0, 1)))
    by_side = written(by_side.where((F.col("feature") == "") | (F.col(f"{ys[0]}_0") + F.col(f"{ys[0]}_1") >= least)), "features")
    whole = by_side.where("feature = ''").first()
    vocabulary: dict[str, int] = {}
    for y in ys if whole else ():
        n0, n1 = whole[f"{y}_0"], whole[f"{y}_1"]
        if not n0 or not n1:
            continue
        p0, p1, p = (F.col(f"{y}_0") + 0.5) / (n0 + 1.0), (F.col(f"{y}_1") + 0.5) / (n1 + 1.0), (F.col(f"{y}_0") + F.col(f"{y}_1") + 1.0) / (n0 + n1 + 2.0)
        z = (p1 - p0) / F.sqrt(p * (1.0 - p) * (1.0 / n0 + 1.0 / n1))
        best = by_side.where("feature != ''").select("feature", F.abs(z).alias("z")).where("z > 4").orderBy(F.desc("z"), "feature").limit(per_category)
        for r in best.collect():
            vocabulary.setdefault(r["feature"], len(vocabulary))
    chain = Chain(names, vocabulary, [])

    def vectors(batches):
        memo = chain.memo()
        for rows in slices(batches):
            v = [chain.vector(t, memo) for t in texts(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.string()), *(rows.column(y) for y in ys), pa.array([i for i, _ in v], pa.list_(pa.int32())), pa.array([x for _, x in v], pa.list_(pa.float64()))], names=["doc_id", *ys, "index", "values"])

    got = chosen.mapInArrow(vectors, "doc_id string, " + ", ".join(f"{y} int" for y in ys) + ", index array<int>, values array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["index"]))
    marks = np.array([[r[y] for y in ys] for r in got]).reshape(len(got), len(ys))
    return fit_chain([(r["index"], r["values"]) for r in got], marks, names, vocabulary) if got else chain


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category and, for the last one, <category>: whether it reaches the threshold."""
    docs = text_of(docs)
    names = [*(f"p_{c}" for c in chain.categories), chain.categories[-1]]

    def each(batches):
        memo = chain.memo()
        for rows in slices(batches):
            p = np.array([chain.predict(*chain.vector(t, memo)) if chain.models else [0.0] * len(chain.categories) for t in texts(rows.column("text"))]).reshape(-1, len(chain.categories))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(p[:, k].copy()) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=["doc_id", *names])

    return docs.mapInArrow(each, T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.DoubleType()) for n in names[:-1]), T.StructField(names[-1], T.BooleanType())]))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text the chain's last category doesn't reach the threshold for; all columns stay."""

    def each(batches):
        memo = chain.memo()
        for rows in slices(batches):
            keep = [not chain.models or chain.predict(*chain.vector(t, memo))[-1] < threshold for t in texts(rows.column(text))]
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


#: The chain of the queries: names of categories and conditions on a label.
LABELS = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def learn_from_labels(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of low quality and toxicity from a labels table (doc_id, quality, toxic)."""
    return learn(docs, labels, {name: F.expr(condition) for name, condition in LABELS})
