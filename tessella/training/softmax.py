"""Full-rank and low-rank linear classifiers.

The full-rank trainer's examples are sparse rows, each with its labels, placed once; only its weights, at most
features x labels within the stated bound, come back between steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.models.scoring import score_full_rank, with_softmax
from tessella.operators.examples import MAX_NAMES, Names, examples, indexed, long_of, names_of, placed, sums_by
from tessella.training.sparse import KEY, index_features, sparse_rows

MAX_WEIGHTS = 5_000_000
#: Scores that a task computes at a time.
CELLS = 2_000_000


class Rprop:
    """Sign-based steps that grow while a gradient's sign holds and shrink when it turns."""

    def __init__(self, shape: tuple[int, ...], first: float = 0.1, least: float = 1e-6, most: float = 1.0):
        self.step, self.last, self.least, self.most = np.full(shape, first), np.zeros(shape), least, most

    def __call__(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        turn = self.last * g
        self.step = np.clip(np.where(turn > 0, self.step * 1.2, np.where(turn < 0, self.step * 0.5, self.step)), self.least, self.most)
        g = np.where(turn < 0, 0.0, g)
        self.last = g
        return w - np.sign(g) * self.step


class SparseBoost:
    """Steps scaled by each feature's summed squares, with shrinkage."""

    def __init__(self, squares: np.ndarray, rate: float = 1.0, shrink: float = 0.0):
        self.scale, self.rate, self.shrink = 1 / np.sqrt(np.maximum(squares, 1e-9)), rate, shrink

    def __call__(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        w = w - self.rate * g * self.scale[:, None]
        return np.sign(w) * np.maximum(0, np.abs(w) - self.shrink)


def label_entries(labels: DataFrame, ids: list[str], kinds: list) -> DataFrame:
    """(ids, indices, values): each label as its number among ``kinds``; all others as the next number, null as the one
    after it."""
    own = F.col("label")
    number = F.when(own.isNull(), len(kinds) + 1)
    if kinds:
        at = F.array_position(F.lit(kinds), own)
        number = number.when(at > 0, at - 1)
    return labels.select(*ids, F.array(number.otherwise(len(kinds)).cast("int")).alias("indices"), F.array(F.lit(1.0)).alias("values"))


def slopes(scores: np.ndarray, owners: np.ndarray, loss: str) -> np.ndarray:
    """examples x labels: the loss's slopes in the scores, added up over an example's label rows. ``owners`` counts those by
    label, with two more columns for labels that don't compete and null ones; softmax shares an example's probability
    among its label rows."""
    m, own = owners.sum(1, keepdims=True), owners[:, :-2]
    if loss == "softmax":
        e = np.exp(scores - scores.max(1, keepdims=True))
        return (m - owners[:, -1:]) * e / np.maximum(m * e.sum(1, keepdims=True), 1e-10) - own
    short, over = np.maximum(0.0, 1 - scores), np.maximum(0.0, 1 + scores)
    if loss != "squared_hinge":
        short, over = (~(short <= 0)).astype(float), (~(over <= 0)).astype(float)
    return (m - own) * over - own * short


def gradient_sums(rows: DataFrame, ids: list[str], w: np.ndarray, given: np.ndarray, loss: str) -> DataFrame:
    """(index, column, g): the summed gradient by feature and label, from ``placed`` features and label entries. ``given`` tells
    which of the weights ``w`` exist. A task holds one gradient and some megabytes of scores."""
    n_ids, (size, k) = len(ids), w.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, seen = np.zeros((size, k)), np.zeros(size, bool)
        for n, kind, example, at, x in examples(batches, n_ids):
            step = max(1, CELLS // (k + 2))
            for start in range(0, n, step):
                part, m = slice(None) if n <= step else (example >= start) & (example < start + step), min(step, n - start)
                e, i, v, labels = example[part] - start, at[part], x[part], kind[part] == 1
                owners = sums_by(m * (k + 2), e[labels] * (k + 2) + i[labels], v[labels]).reshape(m, k + 2)
                e, i, v = e[~labels], i[~labels], v[~labels]
                scores = np.stack([sums_by(m, e, np.where(given[i, j], v * w[i, j], 0.0)) for j in range(k)], 1)
                labelled = owners.sum(1) > 0
                slope, has = slopes(scores, owners, loss), labelled[e]
                e, i, v = e[has], i[has], v[has]
                seen[i] = True
                for j in range(k):
                    g[:, j] += sums_by(size, i, v * slope[e, j])
        at = np.repeat(np.flatnonzero(seen), k)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), int(seen.sum()))), pa.array(g[seen].ravel())], names=["index", "column", "g"])

    return rows.mapInArrow(work, "index int, column int, g double").groupBy("index", "column").agg(F.sum("g").alias("g"))


def gradient_full_rank(rows: DataFrame, weights: DataFrame, labels: DataFrame, ids: list[str], loss: str = "softmax") -> DataFrame:
    """(family, feature, label, g): one batch gradient, averaged over examples, of long or packed ``rows``. ``labels`` is
    (ids, label); each label of ``weights`` competes. Features and labels meet by one shuffle of rows; more than MAX_WEIGHTS
    features x labels are joined instead."""
    spark = rows.sparkSession
    long = long_of(rows, ids)
    kinds = [r["label"] for r in weights.select("label").distinct().limit(MAX_WEIGHTS + 1).collect()]
    names = names_of(long, most=min(MAX_NAMES, MAX_WEIGHTS // max(1, len(kinds))))
    if names is None or not kinds or None in kinds:
        return gradient_by_joins(long, weights, labels, ids, loss)
    kinds = sorted(kinds)
    row, column = {f: i for i, f in enumerate(names)}, {k: j for j, k in enumerate(kinds)}
    w, given = np.zeros((len(names), len(kinds))), np.zeros((len(names), len(kinds)), bool)
    known = weights.join(F.broadcast(spark.createDataFrame(names, "family string, feature string")), KEY, "left_semi")
    for r in known.groupBy(*KEY, "label").agg(F.sum("weight").alias("weight")).where("weight IS NOT NULL").collect():
        at = row[r["family"], r["feature"]], column[r["label"]]
        w[at], given[at] = r["weight"], True
    sums = gradient_sums(placed([indexed(rows, ids, Names(names)), label_entries(labels, ids, kinds)], ids), ids, w, given, loss)
    called = spark.createDataFrame([(i, *f) for f, i in row.items()], "index int, family string, feature string")
    label_of = spark.createDataFrame([(j, k) for k, j in column.items()], f"column int, label {weights.schema['label'].dataType.simpleString()}")
    out = sums.join(F.broadcast(called), "index").join(F.broadcast(label_of), "column")
    return out.select(*KEY, "label", (F.col("g") / labels.count()).alias("g"))


def gradient_by_joins(long: DataFrame, weights: DataFrame, labels: DataFrame, ids: list[str], loss: str = "softmax") -> DataFrame:
    """``gradient_full_rank`` for any number of features and labels."""
    names = weights.select("label").distinct()
    scores = score_full_rank(long, weights, ids)
    full = labels.select(*ids, F.col("label").alias("own")).join(F.broadcast(names)).join(scores, [*ids, "label"], "left").fillna(0.0, ["score"])
    own = F.col("label") == F.col("own")
    if loss == "softmax":
        slope = with_softmax(full, ids).withColumn("g", F.col("probability") - own.cast("double"))
    else:
        y = F.when(own, 1.0).otherwise(-1.0)
        short = F.greatest(F.lit(0.0), 1 - y * F.col("score"))
        slope = full.withColumn("g", -y * (short if loss == "squared_hinge" else (short > 0).cast("double")))
    n = labels.count()
    return long.join(slope.select(*ids, "label", "g"), ids).groupBy(*KEY, "label").agg((F.sum(F.col("value") * F.col("g")) / n).alias("g"))


def train_full_rank(rows: DataFrame, labels: DataFrame, ids: list[str], *, loss: str = "softmax", iterations: int = 10, shrink: float = 0.0, solver: str = "rprop", min_count: int = 0, label_min_count: int = 0) -> DataFrame:
    """(family, feature, label, weight) from long or packed ``rows``. Examples are placed once and kept; an iteration is one
    pass over them."""
    spark = rows.sparkSession
    long = long_of(rows, ids)
    index = index_features(long, min_count).select(*KEY, "index", (F.col("variance") * (F.col("count") - 1) + F.col("count") * F.col("mean") * F.col("mean")).alias("squares")).toPandas()
    kinds = sorted(r["label"] for r in labels.groupBy("label").count().where(F.col("count") >= label_min_count).collect())
    if len(index) * len(kinds) > MAX_WEIGHTS:
        raise ValueError(f"{len(index)} features x {len(kinds)} labels exceed MAX_WEIGHTS; raise min_count")
    w, n = np.zeros((len(index), len(kinds))), labels.count()
    solve = Rprop(w.shape) if solver == "rprop" else SparseBoost(index.squares.to_numpy() / max(1, n), 1.0, shrink)
    label_type = labels.schema["label"].dataType.simpleString()
    if w.size:
        names = Names(list(zip(index.family, index.feature, strict=True)))
        kept = placed([indexed(rows, ids, names), label_entries(labels, ids, kinds)], ids).persist(StorageLevel.MEMORY_AND_DISK)
        for _ in range(iterations):
            g = np.zeros_like(w)
            for r in gradient_sums(kept, ids, w, np.ones_like(w, bool), loss).collect():
                g[r["index"], r["column"]] = r["g"] / n
            w = solve(w, g + shrink * np.sign(w))
        kept.unpersist()
    frame = pd.DataFrame({"family": np.repeat(index.family, len(kinds)), "feature": np.repeat(index.feature, len(kinds)), "label": kinds * len(index), "weight": w.ravel()})
    return spark.createDataFrame(frame, f"family string, feature string, label {label_type}, weight double").where(F.abs("weight") > 1e-3 * shrink)


def train_low_rank(
    long: DataFrame, labels: DataFrame, ids: list[str], *, dimension: int = 8, iterations: int = 10, rate: float = 0.1, rank_loss: str = "non_uniform", max_norm: float = 1.0, min_count: int = 0, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Feature and label embeddings (family, feature, dim, weight) and (label, dim, weight) by sampled ranking steps:
    a wrong label that beats the right one within a margin is found by trying, and the more tries it took, the smaller
    the step. Gradients are summed over partitions."""
    spark = long.sparkSession
    index = index_features(long, min_count)
    rows = sparse_rows(long, index, labels, ids).cache()
    info = index.select(*KEY, "index").toPandas().sort_values("index")
    kinds = sorted(r[0] for r in labels.select("label").distinct().collect())
    place, n, k = {v: i for i, v in enumerate(kinds)}, len(info), len(kinds)
    random = np.random.default_rng(seed)
    v, u = random.normal(0, 0.1, (n, dimension)), random.normal(0, 0.1, (k, dimension))
    harmonic = np.cumsum(1 / np.arange(1, k + 1))

    def bounded(m: np.ndarray) -> np.ndarray:
        return m * np.minimum(1, max_norm / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))

    for it in range(iterations):
        def grads(batches, v=v, u=u, it=it):
            gv, gu, seen, r = np.zeros_like(v), np.zeros_like(u), 0, np.random.default_rng((seed, it))
            for b in batches:
                for label, at, values in zip(b["label"], b["indices"], b["values"], strict=True):
                    at, x, own = np.asarray(at, int), np.asarray(values, float), place[label]
                    e = x @ v[at]
                    scores = u @ e
                    seen += 1
                    for tries, other in enumerate(r.permutation(k), 1):
                        if other != own and scores[other] > scores[own] - 1:
                            step = harmonic[max(0, (k - 1) // tries - 1)] / harmonic[-1] if rank_loss == "non_uniform" else 1.0
                            gu[own] -= step * e
                            gu[other] += step * e
                            gv[at] += step * np.outer(x, u[other] - u[own])
                            break
            flat = np.concatenate((gv.ravel(), gu.ravel()))
            used = np.flatnonzero(flat)
            yield pd.DataFrame({"i": [*used, -1], "g": [*flat[used], float(seen)]})

        total = {r["i"]: r["g"] for r in rows.mapInPandas(grads, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()}
        seen, flat = max(1.0, total.pop(-1, 1.0)), np.zeros(v.size + u.size)
        flat[list(total)] = list(total.values())
        v = bounded(v - rate * flat[: v.size].reshape(v.shape) * n / seen)
        u = bounded(u - rate * flat[v.size :].reshape(u.shape) * k / seen)
    label_type = labels.schema["label"].dataType.simpleString()
    a = spark.createDataFrame([(f, x, d, float(v[i, d])) for f, x, i in zip(info.family, info.feature, info["index"], strict=True) for d in range(dimension)], "family string, feature string, dim int, weight double")
    return a, spark.createDataFrame([(label, d, float(u[i, d])) for label, i in place.items() for d in range(dimension)], f"label {label_type}, dim int, weight double")
