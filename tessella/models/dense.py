"""Vectors of a fixed order out of the long layout, for models over dense rows (trees, networks, kernels)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.models.scoring import KEY, score_mlp
from tessella.models.scoring import score_kernel as kernel_score
from tessella.training.trees import leaf_expression

MAX_NAMES = 2000
SIGN = "\u0001"


def names_of(long: DataFrame, min_count: int = 0) -> list[tuple[str, str]]:
    """The (family, feature) of every position, in order of name; MAX_NAMES is what a row may hold."""
    counted = long.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).orderBy(*KEY)
    found = [(r["family"], r["feature"]) for r in counted.limit(MAX_NAMES + 1).collect()]
    if len(found) > MAX_NAMES:
        raise ValueError(f"over {MAX_NAMES} features; raise min_count or drop families")
    return found


def densify(long: DataFrame, names: Sequence[tuple[str, str]], ids: list[str], missing: float | None = None) -> DataFrame:
    """(ids, x): an example's values by position, ``missing`` where it has none."""
    name = F.concat("family", F.lit(SIGN), "feature")
    known = long.select(*ids, name.alias("k"), "value").where(F.col("k").isin([f + SIGN + x for f, x in names]))
    packed = known.groupBy(*ids, "k").agg(F.sum("value").alias("value")).groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    keys = F.array(*[F.lit(f + SIGN + x) for f, x in names]).cast("array<string>")
    return packed.select(*ids, F.transform(keys, lambda k: F.coalesce(F.col("m")[k], F.lit(missing).cast("double"))).alias("x"))


def score(kind: str, model: dict, x: Column) -> Column:
    """A dense model's score: ``model`` has trees, layers or support."""
    if kind in ("decision_tree", "forest"):
        return sum((leaf_expression(t) for t in model["trees"]), F.lit(0.0))
    return score_mlp(x, model["layers"]) if kind == "multilayer_perceptron" else kernel_score(x, model["support"])
