"""Evaluation of scored records: score DOUBLE, label DOUBLE (positive above 0), is_training BOOLEAN.

Every metric is one pass of partial aggregation; what is sorted afterwards is a histogram (one row a distinct score
or bin), never the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sampling import fold
from tessella.operators.statistics import running_sums


def side() -> Column:
    return F.when(F.col("is_training"), "TRAIN").otherwise("HOLD")


def thresholds(records: DataFrame, bins: int) -> DataFrame:
    """bins + 1 equal-width edges between the least and the largest score; one where they are equal."""
    ends = records.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).where("lo IS NOT NULL")
    n = F.when(F.col("lo") == F.col("hi"), 0).otherwise(bins)
    return ends.select(F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / bins)).alias("threshold"))


def confusion(records: DataFrame, bins: int) -> DataFrame:
    """TP, FP, TN and FN of both sides at every threshold (positive where the score is above it).

    Records are first counted by the number of thresholds below their score; running sums over those bins + 1 counts
    give all thresholds at once."""
    cuts = thresholds(records, bins).agg(F.sort_array(F.collect_list("threshold")).alias("cuts"))
    binned = records.join(F.broadcast(cuts)).select(side().alias("side"), F.size(F.filter("cuts", lambda c: c < F.col("score"))).alias("bin"), (F.col("label") > 0).alias("pos"))
    counts = binned.groupBy("side", "bin").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
    grid = cuts.select(F.posexplode("cuts").alias("i", "threshold")).join(F.broadcast(counts.select("side").distinct()))
    at = grid.join(counts, "side").groupBy("side", "i", "threshold").agg(
        F.sum(F.when(F.col("bin") > F.col("i"), F.col("p")).otherwise(0)).alias("TP"), F.sum(F.when(F.col("bin") > F.col("i"), F.col("n")).otherwise(0)).alias("FP"),
        F.sum(F.when(F.col("bin") <= F.col("i"), F.col("n")).otherwise(0)).alias("TN"), F.sum(F.when(F.col("bin") <= F.col("i"), F.col("p")).otherwise(0)).alias("FN"),
    )
    return at.drop("i")


def derived(counts: DataFrame) -> DataFrame:
    """ACC, FPR, RECALL, PRECISION and F1 beside the counts; a ratio over nothing is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    out = counts.withColumns({"ACC": ratio(tp + tn, tp + fp + tn + fn), "FPR": ratio(fp, fp + tn), "RECALL": ratio(tp, tp + fn), "PRECISION": ratio(tp, tp + fp)})
    return out.withColumn("F1", ratio(2 * F.col("PRECISION") * F.col("RECALL"), F.col("PRECISION") + F.col("RECALL")))


def best_threshold(metrics: DataFrame, metric: str, of: str = "HOLD") -> DataFrame:
    """The row with the largest metric of a side; ties go to the smaller threshold."""
    return metrics.where(F.col("side") == of).orderBy(F.col(metric).desc(), "threshold").limit(1)


def _by_score(records: DataFrame, keys: list[str | Column]) -> DataFrame:
    return records.groupBy(*keys, "score").agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") <= 0).alias("n"))


def roc_auc(records: DataFrame, *keys: str | Column) -> DataFrame:
    """Area under the ROC curve of every key (one row without keys), ties between scores counting half."""
    keys = list(keys) or [F.lit(0).alias("_all")]
    names = [k if isinstance(k, str) else k._jc.toString().rpartition(" AS ")[2].strip("`") for k in keys]
    h = running_sums(_by_score(records, keys), names, "score", ["n"])
    area = h.groupBy(*names).agg(
        F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("tp"), F.sum("n").alias("tn")
    )
    return area.withColumn("AUC", F.try_divide(F.col("u"), F.col("tp") * F.col("tn"))).drop("u", "tp", "tn", "_all")


def auc_folds(records: DataFrame, ids: list[str], folds: int = 5) -> DataFrame:
    """Mean, population deviation, least and largest AUC of both sides over hashed folds."""
    with_fold = records.withColumns({"side": side(), "fold": fold(*map(F.col, ids), folds=folds)})
    auc = roc_auc(with_fold, "side", "fold")
    return auc.groupBy("side").agg(F.avg("AUC").alias("AUC"), F.stddev_pop("AUC").alias("AUC_STDDEV"), F.min("AUC").alias("AUC_MIN"), F.max("AUC").alias("AUC_MAX"))


def pr_auc(records: DataFrame) -> DataFrame:
    """Trapezoids over recall, from (precision 1, recall 0), for both sides."""
    h = _by_score(records, [side().alias("side")])
    total = h.groupBy("side").agg(F.sum("p").alias("all"))  # a row a side
    h = running_sums(h.withColumn("falling", -F.col("score")), ["side"], "falling", ["p", "n"]).join(F.broadcast(total), "side")
    before, tp, fp = F.col("below_p"), F.col("below_p") + F.col("p"), F.col("below_n") + F.col("n")
    precision, last = tp / (tp + fp), F.coalesce(F.try_divide(before, before + F.col("below_n")), F.lit(1.0))
    step = F.try_divide("p", "all") * (precision + last) / 2
    return h.select("side", step.alias("step")).groupBy("side").agg(F.sum("step").alias("PR_AUC"))


def regression(records: DataFrame) -> DataFrame:
    s, y = F.col("score"), F.col("label")
    return records.groupBy(side().alias("side")).agg(
        F.sqrt(F.avg((s - y) * (s - y))).alias("RMSE"), F.try_divide(F.sum(F.abs(y - s)), F.sum(y + s)).alias("SMAPE"), F.sum((s - y) * (s - y)).alias("SQERR"), F.count(F.lit(1)).alias("COUNT")
    )


def classification_error(records: DataFrame) -> DataFrame:
    """RMSE and SQERR of probabilities against 0/1 labels."""
    s = F.col("score")
    miss = F.when(F.col("label") > 0, 1 - s).otherwise(s)
    return records.groupBy(side().alias("side")).agg(F.sqrt(F.avg(miss * miss)).alias("RMSE"), F.sum(miss * miss).alias("SQERR"), F.count(F.lit(1)).alias("COUNT"))


def ranked(records: DataFrame, ids: list[str]) -> DataFrame:
    """From maps scores and labels: a row for every scored label with its rank (from 1; ties by name) and whether it is
    one of the record's labels."""
    long = records.select(*ids, side().alias("side"), F.explode("scores").alias("label", "score"), "labels")
    w = Window.partitionBy(*ids).orderBy(F.col("score").desc(), "label")
    return long.select(*ids, "side", "label", "score", F.map_contains_key("labels", F.col("label")).alias("hit"), F.size("labels").alias("n_labels"), F.row_number().over(w).alias("rank"))


def multiclass(records: DataFrame, ids: list[str], top: int = 10) -> DataFrame:
    """ALL_PAIRS_HINGE_LOSS, MEAN_RECIPROCAL_RANK, and PRECISION, ACCURACY and MEAN_AVERAGE_PRECISION at 1 to top, by
    side and metric."""
    r = ranked(records, ids)
    so_far = Window.partitionBy(*ids).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("hits", F.sum(F.col("hit").cast("int")).over(so_far))
    own = r.where("hit").groupBy(*ids, "side").agg(F.collect_list("score").alias("own"), F.sum(1 / F.col("rank")).alias("mrr"), F.count(F.lit(1)).alias("k"))
    hinge = r.where(~F.col("hit")).join(own.select(*ids, "own"), ids).select("side", F.explode("own").alias("o"), "score").groupBy("side").agg(F.sum(F.greatest(F.lit(0.0), 1 - F.col("o") + F.col("score"))).alias("v"))
    n = records.groupBy(side().alias("side")).agg(F.count(F.lit(1)).alias("n"))
    out = hinge.join(F.broadcast(n), "side").select("side", F.lit("ALL_PAIRS_HINGE_LOSS").alias("metric"), (F.col("v") / F.col("n")).alias("value"))
    out = out.unionByName(own.groupBy("side").agg((F.sum("mrr") / F.sum("k")).alias("value")).select("side", F.lit("MEAN_RECIPROCAL_RANK").alias("metric"), "value"))
    cuts = r.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(top)))).where(F.col("rank") <= F.col("cut"))
    per = cuts.groupBy(*ids, "side", "cut").agg(
        F.count_if("hit").alias("good"), F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"), F.first("n_labels").alias("n_labels")
    )
    at = per.groupBy("side", "cut").agg(
        F.avg(F.col("good") / F.col("cut")).alias("PRECISION"), F.avg((F.col("good") > 0).cast("double")).alias("ACCURACY"),
        F.avg(F.try_divide("ap", F.least("n_labels", "cut"))).alias("MEAN_AVERAGE_PRECISION"),
    )
    names = ("PRECISION", "ACCURACY", "MEAN_AVERAGE_PRECISION")
    stacked = at.select("side", F.inline(F.array(*[F.struct(F.concat(F.lit(f"{m}@"), F.col("cut").cast("string")).alias("metric"), F.col(m).alias("value")) for m in names])))
    return out.unionByName(stacked)


def calibration_error(records: DataFrame, width: float = 0.01) -> DataFrame:
    """Root mean square, over records, of the observed rate less the bucket's floor, in buckets of probability."""
    b = records.groupBy(F.floor(F.col("score") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") > 0).cast("double")).alias("rate"))
    gap = F.col("rate") - F.col("bucket") * width
    return b.agg(F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("calibration_error"))


def histogram_calibrator(records: DataFrame, bins: int) -> DataFrame:
    """(bucket, lo, hi, cdf): equal-width bins of score with the share of records up to the bin's end."""
    ends = records.agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count(F.lit(1)).alias("total"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("score") - F.col("a"), width)), F.lit(bins - 1)))
    counts = records.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("a", "b", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket")).join(counts, "bucket", "left")
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grid.select("bucket", (F.col("a") + F.col("bucket") * width).alias("lo"), (F.col("a") + (F.col("bucket") + 1) * width).alias("hi"), (run / F.col("total")).alias("cdf"))


def calibrate_by_histogram(records: DataFrame, calibrator: DataFrame) -> DataFrame:
    """Column calibrated: the distribution's value at the score, linear within a bin."""
    rows = calibrator.agg(F.sort_array(F.collect_list(F.struct("bucket", "lo", "hi", "cdf"))).alias("c"))
    found = F.element_at(F.filter("c", lambda b: (b["lo"] <= F.col("score")) | (b["bucket"] == 0)), -1)
    before = F.coalesce(F.get(F.col("c"), found["bucket"] - 1)["cdf"], F.lit(0.0))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("score") - found["lo"], found["hi"] - found["lo"]), F.lit(1.0))))
    return records.join(F.broadcast(rows)).withColumn("calibrated", before + part * (found["cdf"] - before)).drop("c")


def platt_fit(records: DataFrame, iterations: int = 25, ridge: float = 1e-6) -> tuple[float, float]:
    """(offset, slope) of most likelihood by Newton steps; each is one aggregation to five numbers."""
    a, b = 0.0, 1.0
    y = (F.col("label") > 0).cast("double")
    for _ in range(iterations):
        s = F.col("score")
        z = F.lit(a) + F.lit(b) * s
        p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
        w = p * (1 - p)
        r = records.agg(F.sum(y - p), F.sum((y - p) * s), F.sum(w), F.sum(w * s), F.sum(w * s * s)).first()
        if r[0] is None:
            break
        g0, g1, h00, h01, h11 = r
        h00, h11 = h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b
