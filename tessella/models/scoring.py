"""Scoring. Inputs are long features (ids, family, feature, value) and tables of weights; a score is a join on
(family, feature) and a sum, which Spark combines before the shuffle. Examples without any known feature get no row;
``complete`` gives them 0. Trees are nested conditions over a feature set and need no join at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.features import FeatureSet
from tessella.functions.scalar import maxout_halves, platt
from tessella.models.functions import evaluate
from tessella.operators.joins import lookup, top_k_per
from tessella.transforms.trees import descend

KEY = ["family", "feature"]


def complete(scores: DataFrame, examples: DataFrame, ids: list[str]) -> DataFrame:
    return examples.select(*ids).join(scores, ids, "left").fillna(0.0)


def contributions(long: DataFrame, weights: DataFrame, model_type: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns of ``long``, those of ``weights`` to keep and each feature's part of the score: the explanation."""
    on = lookup(long, weights, KEY)
    if model_type == "linear":
        part = F.col("weight")
    elif model_type in ("additive", "spline"):
        part = evaluate(F.col("function_form"), F.col("value"), F.col("weights"), F.col("min_val"), F.col("max_val"))
    elif model_type == "boosted_stumps":
        part = F.when(F.col("value") >= F.col("threshold"), F.col("weight")).otherwise(0.0)
    else:
        raise ValueError(f"a {model_type!r} model isn't a sum over features")
    return on.select(*long.columns, *keep, part.alias("part"))


def score_sum(long: DataFrame, weights: DataFrame, ids: list[str], model_type: str) -> DataFrame:
    """(ids, score) for linear (string features only; give those), additive, spline and boosted_stumps models."""
    return contributions(long, weights, model_type).groupBy(*ids).agg(F.sum("part").alias("score"))


def explain(long: DataFrame, weights: DataFrame, ids: list[str], model_type: str, k: int = 15) -> DataFrame:
    """Every example's k largest parts by size, ties by name."""
    parts = contributions(long, weights, model_type).withColumn("_id", F.struct(*ids))
    return top_k_per(parts, "_id", k, F.abs("part"), "family", "feature").drop("_id")


def explain_families(long: DataFrame, weights: DataFrame, ids: list[str], model_type: str) -> DataFrame:
    return contributions(long, weights, model_type).groupBy(*ids, "family").agg(F.sum("part").alias("part"))


def explanation_diff(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
    """Two explanations side by side with the difference of their parts."""
    return _side_by_side(a.withColumn("_first", F.lit(True)).unionByName(b.withColumn("_first", F.lit(False)), allowMissingColumns=True), ids)


def models_diff(long: DataFrame, a: DataFrame, b: DataFrame, ids: list[str], model_type: str) -> DataFrame:
    """``explanation_diff`` of one table by two models: one pass finds the parts of both, which meet before the shuffle."""
    both = a.withColumn("_first", F.lit(True)).unionByName(b.withColumn("_first", F.lit(False)))
    return _side_by_side(contributions(long, both, model_type, ["_first"]), ids)


def _side_by_side(parts: DataFrame, ids: list[str]) -> DataFrame:
    part = lambda mine, name: F.sum(F.when(mine, F.col("part"))).alias(name)
    both = parts.groupBy(*ids, *KEY).agg(part(F.col("_first"), "part_a"), part(~F.col("_first"), "part_b")).fillna(0.0, ["part_a", "part_b"])
    return both.withColumn("diff", F.col("part_a") - F.col("part_b"))


def score_tree(fs: FeatureSet, nodes: Sequence[Mapping]) -> Column:
    """A decision tree's leaf weight as an expression."""
    return descend(nodes, lambda f, n: fs.floats(f)[n], lambda i: F.lit(float(nodes[i]["weight"])))


def tree_leaf(fs: FeatureSet, nodes: Sequence[Mapping]) -> Column:
    return descend(nodes, lambda f, n: fs.floats(f)[n], F.lit)


def score_forest(fs: FeatureSet, trees: Sequence[Sequence[Mapping]]) -> Column:
    """The sum, not the mean, of the trees."""
    out = F.lit(0.0)
    for t in trees:
        out = out + score_tree(fs, t)
    return out


def score_tree_classes(fs: FeatureSet, trees: Sequence[Sequence[Mapping]]) -> Column:
    """map<label,score> summed over trees whose leaves hold distributions."""
    labels = sorted({label for t in trees for n in t for label in n.get("distribution", {})})
    value = lambda t, label: descend(t, lambda f, n: fs.floats(f)[n], lambda i: F.lit(float(t[i]["distribution"].get(label, 0.0))))
    total = lambda label: sum((value(t, label) for t in trees[1:]), value(trees[0], label))
    return F.create_map(*[x for label in labels for x in (F.lit(label), total(label))])


def score_full_rank(long: DataFrame, weights: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, label, score) with weights (family, feature, label, weight)."""
    return lookup(long, weights, KEY).groupBy(*ids, "label").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def with_softmax(scores: DataFrame, ids: list[str]) -> DataFrame:
    """Column probability over an example's labels; the scores are already placed by example, so nothing is shuffled."""
    one = Window.partitionBy(*ids)
    e = scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(one)))
    return e.withColumn("probability", F.col("_e") / F.greatest(F.sum("_e").over(one), F.lit(1e-10))).drop("_e")


def score_low_rank(long: DataFrame, embedding: DataFrame, labels: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, label, score): features (family, feature, dim, weight) are summed to an embedding, then joined to the
    labels' (label, dim, weight)."""
    e = lookup(long, embedding, KEY).groupBy(*ids, "dim").agg(F.sum(F.col("value") * F.col("weight")).alias("x"))
    return e.join(labels, "dim").groupBy(*ids, "label").agg(F.sum(F.col("x") * F.col("weight")).alias("score"))


def score_maxout(long: DataFrame, hidden: DataFrame, ids: list[str], size: int) -> DataFrame:
    """(ids, score) with weights (family, feature, unit, weight) of ``size`` hidden units."""
    h = lookup(long, hidden, KEY).groupBy(*ids, "unit").agg(F.sum(F.col("value") * F.col("weight")).alias("x"))
    packed = h.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("unit", "x"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast(h.schema["unit"].dataType)), F.lit(0.0)))
    return packed.select(*ids, maxout_halves(vec).alias("score"))


KERNELS = {
    "rbf": lambda d2, dot, nx, nv, s: F.exp(-s * d2),
    "acos": lambda d2, dot, nx, nv, s: 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(dot, nx * nv), F.lit(0.0))))) / F.pi(),
}


def score_kernel(vec: Column, support: Sequence[Mapping]) -> Column:
    """Sum over support vectors {weights, kernel, scale, weight} (bounded by max_vectors) as one expression."""
    out = F.lit(0.0)
    for sv in support:
        v = F.array(*[F.lit(float(x)) for x in sv["vector"]])
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        d2, dot = add(F.zip_with(vec, v, lambda x, y: (x - y) * (x - y))), add(F.zip_with(vec, v, lambda x, y: x * y))
        nx, nv = F.sqrt(add(F.transform(vec, lambda x: x * x))), F.lit(sum(float(x) ** 2 for x in sv["vector"]) ** 0.5)
        out = out + float(sv["weight"]) * KERNELS[sv["kernel"]](d2, dot, nx, nv, float(sv.get("scale", 1.0)))
    return out


ACTIVATIONS = {
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "relu": lambda x: F.greatest(x, F.lit(0.0)), "tanh": F.tanh, "identity": lambda x: x,
}


def score_mlp(vec: Column, layers: Sequence[Mapping]) -> Column:
    """A perceptron {weights (inputs x units), bias, activation} over a dense vector, layer by layer."""
    current = vec
    for layer in layers:
        columns = list(zip(*layer["weights"], strict=True))
        act = ACTIVATIONS[layer["activation"]]
        units = [act(F.aggregate(F.zip_with(current, F.array(*[F.lit(float(w)) for w in col]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + float(b)) for col, b in zip(columns, layer["bias"], strict=True)]
        current = F.array(*units)
    return F.get(current, F.lit(0))


def with_probability(scores: DataFrame, offset: float = 0.0, slope: float = 1.0) -> DataFrame:
    return scores.withColumn("probability", platt(F.col("score"), offset, slope))
