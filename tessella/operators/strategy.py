"""Metrics of suggested values against accepted (true) and refused offers, by key or over all.

A suggestion is lower or higher than the value it is held against: the true value of an accepted offer where there is
one, else the observed value. Its increase is relative to that value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("posSugHigher", "posSugLower", "negSugHigher", "negSugLower")
SUMS = ("trueIncreaseSum", "trueDecreaseSum", "falseIncreaseSum", "falseDecreaseSum")
#: What is kept of a model, in order.
OUTPUT = (
    "posCount", "negCount", *COUNTS, "increasePrecision", "increaseRecall", "decreasePrecision", "decreaseRecall", "trueRegret", "trueRegretMedian", "trueRegret75Percentile", "falseRegret",
    "trueIncreaseMagnitude", "trueDecreaseMagnitude", "falseDecreaseMagnitude", "falseIncreaseMagnitude",
)


def _share(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def _derived(counted: DataFrame) -> DataFrame:
    out = counted.withColumns({"posCount": F.col("posSugHigher") + F.col("posSugLower"), "negCount": F.col("negSugHigher") + F.col("negSugLower")})
    return out.withColumns({
        "increasePrecision": _share("posSugHigher", F.col("posSugHigher") + F.col("negSugHigher")), "increaseRecall": _share("posSugHigher", "posCount"),
        "decreasePrecision": _share("negSugLower", F.col("posSugLower") + F.col("negSugLower")), "decreaseRecall": _share("negSugLower", "negCount"),
        "trueRegret": _share("trueDecreaseSum", "posCount"), "falseRegret": _share("falseIncreaseSum", "negCount"),
        "trueIncreaseMagnitude": _share("trueIncreaseSum", "posSugHigher"), "trueDecreaseMagnitude": _share("trueDecreaseSum", "posSugLower"),
        "falseDecreaseMagnitude": _share("falseDecreaseSum", "negSugLower"), "falseIncreaseMagnitude": _share("falseIncreaseSum", "negSugHigher"),
    })


def binary_metrics(scored: DataFrame, key: str) -> DataFrame:
    """For every key of (key, label, prediction, observed_value, true_value): OUTPUT, SUMS and two losses.

    The median and the third quartile of true regret are the values at those places of the sorted decreases."""
    against = F.when(F.col("label") & F.col("true_value").isNotNull(), F.col("true_value")).otherwise(F.col("observed_value"))
    rows = scored.select(key, "label", (F.col("prediction") < against).alias("lower"), _share(F.col("prediction") - against, against).alias("increase"))
    case = {"posSugHigher": F.col("label") & ~F.col("lower"), "posSugLower": F.col("label") & F.col("lower"), "negSugHigher": ~F.col("label") & ~F.col("lower"), "negSugLower": ~F.col("label") & F.col("lower")}
    sums = [F.coalesce(F.sum(F.when(c, F.col("increase"))), F.lit(0.0)).alias(s) for c, s in zip(case.values(), SUMS, strict=True)]
    counted = rows.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in case.items()], *sums)
    sorted_ = rows.where(case["posSugLower"]).select(key, "increase")
    w = Window.partitionBy(key)
    placed = sorted_.withColumns({"_i": F.row_number().over(w.orderBy("increase")) - 1, "_n": F.count(F.lit(1)).over(w)})
    at = lambda p: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * p), F.col("increase")))
    regret = placed.groupBy(key).agg(at(0.5).alias("trueRegretMedian"), at(0.75).alias("trueRegret75Percentile"))
    out = _derived(counted.join(regret, key, "left").fillna(0.0, ["trueRegretMedian", "trueRegret75Percentile"]))
    return out.select(key, *OUTPUT, *SUMS, _share("falseIncreaseSum", "negSugHigher").alias("falseLoss"), _share("trueDecreaseSum", "posSugLower").alias("trueLoss"))


def combined(metrics: DataFrame) -> DataFrame:
    """One row over all keys: counts and sums add up, shares follow from them; places of regret don't add and are 0."""
    added = metrics.agg(*[F.sum(c).alias(c) for c in (*COUNTS, *SUMS)])
    return _derived(added.withColumns({"trueRegretMedian": F.lit(0.0), "trueRegret75Percentile": F.lit(0.0)})).select(*OUTPUT, *SUMS)


def model_output(models: DataFrame, metrics: DataFrame, options: list[float], model: str) -> DataFrame:
    """A typed row of a key's holdout metrics, parameters (a, b, c), loss and options, for a table partitioned by model."""
    joined = models.select("id", "a", "b", "c", "loss").join(metrics, "id")
    counts = {"posCount", "negCount", *COUNTS}
    kept = [F.col(c).cast("int").alias(c) if c in counts else F.col(c).cast("double").alias(c) for c in OUTPUT]
    numbers = F.array(*[F.lit(float(o)) for o in options]).cast("array<double>")
    return joined.select(F.col("id").cast("long").alias("id"), *kept, F.array("a", "b", "c").alias("params"), "loss", numbers.alias("options"), F.lit(model).alias("model"))
