"""Decision trees, forests, boosted forests and boosted stumps over dense rows.

Rows are (ids, label, x ARRAY<DOUBLE>) with features named by position. A tree grows level by level: candidate splits
come from approximate quantiles, and one aggregation by (node, feature, candidate) prices all splits of a level, so the
data stay distributed and the driver sees a few numbers for each candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Node = dict


def _gini(n: np.ndarray) -> float:
    t = n.sum()
    return 0.0 if t == 0 else float(1 - ((n / t) ** 2).sum())


def _entropy(n: np.ndarray) -> float:
    t = n.sum()
    p = n[n > 0] / t if t else np.zeros(0)
    return float(-(p * np.log2(p)).sum())


def _gain(of: Callable[[np.ndarray], float]) -> Callable[[np.ndarray, np.ndarray], float]:
    def value(left: np.ndarray, right: np.ndarray) -> float:
        a, b = left.sum(), right.sum()
        return of(left + right) - (a * of(left) + b * of(right)) / max(1e-12, a + b)

    return value


def _hellinger(left: np.ndarray, right: np.ndarray) -> float:
    """Squared distance between the classes' shares that go left and right; the largest over pairs of classes."""
    total = np.maximum(left + right, 1e-12)
    a, b = np.sqrt(left / total), np.sqrt(right / total)
    return max((float((a[i] - a[j]) ** 2 + (b[i] - b[j]) ** 2) for i in range(len(total)) for j in range(i)), default=0.0)


CRITERIA = {"gini": _gain(_gini), "information_gain": _gain(_entropy), "hellinger": _hellinger, "multiclass_gini": _gain(_gini), "multiclass_hellinger": _hellinger}


def variance_gain(n: float, s: float, q: float, nl: float, sl: float, ql: float) -> float:
    """Drop in summed squares from a split, from counts, sums and sums of squares of all and of the left rows."""
    ss = lambda n, s, q: q - s * s / n if n > 0 else 0.0
    return ss(n, s, q) - ss(nl, sl, ql) - ss(n - nl, s - sl, q - ql)


def node_of(nodes: Sequence[Node], at: int = 0) -> Column:
    """The number of the node that a row is in."""
    n = nodes[at]
    if "left" not in n:
        return F.lit(at)
    return F.when(F.coalesce(F.get("x", F.lit(n["axis"])) >= n["threshold"], F.lit(False)), node_of(nodes, n["right"])).otherwise(node_of(nodes, n["left"]))


def train_tree(
    rows: DataFrame, names: Sequence[tuple[str, str]], *, criterion: str = "gini", max_depth: int = 4, min_leaf_items: int = 10, candidates: int = 16, max_features: str = "all",
    classes: Sequence | None = None, seed: int = 1, sign_leaves: bool = True,
) -> list[Node]:
    """Nodes of a tree. ``names`` is (family, feature) by position. Classification leaves weigh 2p - 1 of the second class
    (or hold a distribution with more classes); regression leaves (criterion variance) weigh the mean."""
    rows = rows.select("label", "x").cache()
    regression = criterion == "variance"
    classes = None if regression else list(classes) if classes is not None else sorted(r[0] for r in rows.select("label").distinct().collect())
    cuts = rows.select(F.posexplode("x").alias("axis", "v")).groupBy("axis").agg(F.percentile_approx("v", [i / candidates for i in range(1, candidates)], 10000).alias("cuts"))
    cut_of = {r["axis"]: sorted(set(r["cuts"])) for r in cuts.collect()}
    random, axes = np.random.default_rng(seed), len(names)
    width = {"all": axes, "sqrt": max(1, math.isqrt(axes)), "log2": max(1, int(math.log2(axes)) if axes > 1 else 1)}[max_features]
    nodes: list[Node] = [{}]
    open_nodes = [0]
    measures = [F.sum("label").alias("s"), F.sum(F.col("label") * F.col("label")).alias("q")] if regression else [F.count_if(F.col("label") == c).alias(f"c{i}") for i, c in enumerate(classes)]
    for depth in range(max_depth + 1):
        if not open_nodes:
            break
        placed = rows.withColumn("node", node_of(nodes)).where(F.col("node").isin(open_nodes))
        totals = {r["node"]: r for r in placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *measures).collect()}
        chosen = {k: sorted(random.choice(axes, width, replace=False).tolist()) for k in open_nodes}
        splits = {}
        if depth < max_depth:
            tests = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(float(c)).alias("cut")) for a in range(axes) for c in cut_of.get(a, [])])
            left = placed.select("node", "label", "x", F.explode(tests).alias("t")).where(~F.coalesce(F.get("x", F.col("t.axis")) >= F.col("t.cut"), F.lit(False)))
            for r in left.groupBy("node", "t").agg(F.count(F.lit(1)).alias("n"), *measures).collect():
                whole, axis = totals[r["node"]], r["t"]["axis"]
                if axis not in chosen[r["node"]] or min(r["n"], whole["n"] - r["n"]) < min_leaf_items:
                    continue
                if regression:
                    gain = variance_gain(whole["n"], whole["s"], whole["q"], r["n"], r["s"], r["q"])
                else:
                    l, t = (np.array([x[f"c{i}"] for i in range(len(classes))], float) for x in (r, whole))
                    gain = CRITERIA[criterion](l, t - l)
                key = (gain, -axis, -r["t"]["cut"])
                if gain > 1e-9 and key > splits.get(r["node"], ((0.0,),))[0]:
                    splits[r["node"]] = (key, axis, float(r["t"]["cut"]))
        following = []
        for k in open_nodes:
            if k in splits:
                _, axis, cut = splits[k]
                nodes[k] = {"family": names[axis][0], "feature": names[axis][1], "axis": axis, "threshold": cut, "left": len(nodes), "right": len(nodes) + 1}
                following += [len(nodes), len(nodes) + 1]
                nodes += [{}, {}]
            else:
                nodes[k] = {"name": f"leaf{k}", **_leaf(totals.get(k), classes, sign_leaves)}
        open_nodes = following
    return nodes


def _leaf(total, classes, sign_leaves: bool) -> Node:
    if total is None:
        return {"weight": 0.0}
    if classes is None:
        return {"weight": float(total["s"] / total["n"])}
    n = np.array([total[f"c{i}"] for i in range(len(classes))], float)
    p = n / max(1.0, n.sum())
    if len(classes) > 2:
        return {"weight": 0.0, "distribution": {str(c): float(v) for c, v in zip(classes, p, strict=True)}}
    return {"weight": float(2 * p[-1] - 1) if sign_leaves else float(p[-1])}


def scaled(nodes: list[Node], by: float) -> list[Node]:
    return [n | {k: (n[k] * by if k == "weight" else {c: v * by for c, v in n[k].items()}) for k in ("weight", "distribution") if k in n} for n in nodes]


def train_forest(rows: DataFrame, names: Sequence[tuple[str, str]], ids: list[str], *, num_trees: int = 5, max_features: str = "sqrt", seed: int = 1, **options) -> list[list[Node]]:
    """Trees over hash buckets of rows, each scaled by 1 / num_trees."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(num_trees))
    return [scaled(train_tree(rows.where(bucket == t), names, max_features=max_features, seed=seed + t, **options), 1 / num_trees) for t in range(num_trees)]


def leaf_expression(nodes: Sequence[Node], at: int = 0) -> Column:
    n = nodes[at]
    if "left" not in n:
        return F.lit(float(n["weight"]))
    return F.when(F.coalesce(F.get("x", F.lit(n["axis"])) >= n["threshold"], F.lit(False)), leaf_expression(nodes, n["right"])).otherwise(leaf_expression(nodes, n["left"]))


def train_boosted_forest(rows: DataFrame, names: Sequence[tuple[str, str]], *, num_trees: int = 5, learning_rate: float = 0.3, loss: str = "logistic", rank_threshold: float = 0.0, **options) -> list[list[Node]]:
    """Each tree fits the loss's negative gradient of the trees so far; its leaves hold the mean gradient step."""
    y = F.when(F.col("label") > rank_threshold, 1.0).otherwise(-1.0)
    trees: list[list[Node]] = []
    for t in range(num_trees):
        score = F.lit(0.0)
        for tree in trees:
            score = score + leaf_expression(tree)
        if loss == "logistic":
            gradient = y / (1 + F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), y * score))))
        else:
            gradient = F.when(y * score < 1, y).otherwise(0.0)
        step = rows.select(gradient.alias("label"), "x")
        trees.append(scaled(train_tree(step, names, criterion="variance", seed=t, **options), learning_rate * 4))
    return trees


def train_boosted_stumps(rows: DataFrame, names: Sequence[tuple[str, str]], *, candidates: int = 8, iterations: int = 30, learning_rate: float = 1.0, rank_threshold: float = 0.0, l1: float = 0.0) -> DataFrame:
    """(family, feature, threshold, weight): batch logistic steps over the responses of all candidate stumps."""
    spark = rows.sparkSession
    cuts = rows.select(F.posexplode("x").alias("axis", "v")).groupBy("axis").agg(F.percentile_approx("v", [i / candidates for i in range(1, candidates)], 10000).alias("cuts")).collect()
    stumps = [(r["axis"], float(c)) for r in sorted(cuts, key=lambda r: r["axis"]) for c in sorted(set(r["cuts"]))]
    fired = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in stumps]), lambda s: F.when(F.get("x", s["a"]) >= s["c"], 1.0).otherwise(0.0))
    data = rows.select(F.when(F.col("label") > rank_threshold, 1.0).otherwise(-1.0).alias("y"), fired.alias("r")).cache()
    n, w = max(1, data.count()), np.zeros(len(stumps) + 1)
    for _ in range(iterations):
        weights = F.array(*[F.lit(float(v)) for v in w[:-1]])
        z = F.aggregate(F.zip_with("r", weights, lambda a, b: a * b), F.lit(float(w[-1])), lambda s, v: s + v)
        g = data.select((-F.col("y") / (1 + F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("y") * z))))).alias("g"), "r")
        sums = g.agg(F.sum("g"), *[F.sum(F.when(F.get("r", F.lit(i)) > 0, F.col("g")).otherwise(0.0)) for i in range(len(stumps))]).first()
        step = w - learning_rate * np.array([*sums[1:], sums[0]], float) / n
        w = np.sign(step) * np.maximum(0, np.abs(step) - learning_rate * l1)
    out = sorted(((names[a][0], names[a][1], c, float(v)) for (a, c), v in zip(stumps, w[:-1], strict=True) if v), key=lambda r: -abs(r[3]))
    return spark.createDataFrame([*out, ("BIAS", "B", 0.0, float(w[-1]))], "family string, feature string, threshold double, weight double")
