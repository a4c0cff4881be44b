"""Linear models by bagged FOBOS steps with per-feature rates, and ranking by pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.training.sparse import KEY, LOSSES, fobos, in_bags, in_shards, index_features, sparse_rows


def train_linear(
    long: DataFrame, labels: DataFrame, ids: list[str], *, loss: str = "hinge", num_bags: int = 2, iterations: int = 5, learning_rate: float = 0.1,
    l1: float = 0.0, l2: float = 0.0, rank_threshold: float = 0.0, dropout: float = 0.0, epsilon: float = 0.0, min_count: int = 0, seed: int = 1,
    prior: dict[tuple[str, str], float] | None = None, use_values: bool = False,
) -> DataFrame:
    """(family, feature, weight). ``labels`` is (ids, label). Classification losses take a label above rank_threshold as 1
    and any other as -1. String features weigh 1 unless ``use_values``."""
    index = index_features(long, min_count).cache()
    rows = in_shards(sparse_rows(long, index, labels, ids), num_bags, ids)
    names = index.select(*KEY, "index").toPandas()
    n = len(names)
    w = np.zeros(n)
    for key, value in (prior or {}).items():
        w[names.index[(names.family == key[0]) & (names.feature == key[1])]] = value
    where = names["index"].to_numpy()
    start = np.zeros(n)
    start[where] = w
    slope, binary, extra = LOSSES[loss], loss in ("hinge", "logistic"), 1.0 if loss == "hinge" else epsilon
    for it in range(iterations):
        current = start

        def walk(bag: int, current=current, it=it):
            mine, squares, random = current.copy(), np.full(n, 1e-8), np.random.default_rng((seed, it, bag))

            def feed(batch: pd.DataFrame | None) -> list[pd.DataFrame]:
                if batch is None:
                    return [pd.DataFrame({"index": np.arange(n), "weight": mine})]
                for label, at, values in zip(batch["label"], batch["indices"], batch["values"], strict=True):
                    if not len(at):
                        continue
                    at, x = np.asarray(at), np.asarray(values) if use_values else np.ones(len(at))
                    if dropout:
                        on = random.random(len(at)) >= dropout
                        at, x = at[on], x[on] / (1 - dropout)
                    y = (1.0 if label > rank_threshold else -1.0) if binary else float(label)
                    g = slope(float(mine[at] @ x), y, extra)[1]
                    if g:
                        squares[at] += (g * x) ** 2
                        rate = learning_rate / np.sqrt(1 + squares[at])
                        step = mine[at] - rate * g * x
                        mine[at] = np.sign(step) * np.maximum(0, np.abs(step) - rate * l1) / (1 + rate * l2)
                return []

            return feed

        got = in_bags(rows, seed + it, ids, walk, "index long, weight double").groupBy("index").agg(F.avg("weight").alias("weight")).toPandas()
        start = np.zeros(n)
        start[got["index"].to_numpy()] = got["weight"].to_numpy()
    out = names.assign(weight=start[where])
    return _frame(long.sparkSession, out[out.weight != 0])


def _frame(spark: SparkSession, weights: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(weights[["family", "feature", "weight"]], "family string, feature string, weight double")


def train_ranker(pairs: DataFrame, spark: SparkSession, *, iterations: int = 5, learning_rate: float = 0.1, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """Weights from pairs (better ARRAY<STRING>, worse ARRAY<STRING>) of features named family:feature that only one side
    has: batch hinge steps, each one aggregation by feature."""
    weights = spark.createDataFrame([], "name string, weight double")
    for _ in range(iterations):
        side = lambda c, sign: pairs.select("pair_id", F.explode(c).alias("name"), F.lit(sign).alias("x"))
        x = side("better", 1.0).unionByName(side("worse", -1.0))
        margin = x.join(weights, "name", "left").groupBy("pair_id").agg(F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))).alias("m")).where("m < 1")
        total = pairs.count()
        g = x.join(margin, "pair_id").groupBy("name").agg((-F.sum("x") / total).alias("g"))
        rows = g.join(weights, "name", "full").select("name", F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("g", F.lit(0.0)).alias("g")).collect()
        weights = spark.createDataFrame([(r["name"], fobos(r["w"], r["g"], learning_rate, l1, l2)) for r in rows], "name string, weight double")
    return weights
