"""Statistics of features in the long layout (family, feature, value), all by partial and final aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.examples import Names, indexed, long_of
from tessella.operators.joins import BROADCAST_ROWS, lookup

KEY = ("family", "feature")


def feature_statistics(long: DataFrame, min_count: int = 0, quantiles: Sequence[float] = (), accuracy: int = 10000) -> DataFrame:
    """count, min, max, mean and sample variance of every feature seen at least ``min_count`` times, and approximate
    quantiles where asked for."""
    aggs = [
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
    ]
    if quantiles:
        aggs.append(F.percentile_approx("value", list(quantiles), accuracy).alias("quantiles"))
    return long.groupBy(*KEY).agg(*aggs).where(F.col("count") >= min_count)


def exact_quantiles(long: DataFrame, quantiles: Sequence[float], min_count: int = 0) -> DataFrame:
    """(family, feature, quantiles): of every feature seen at least ``min_count`` times the smallest values that have the given
    shares of its values at or below them, for any number of values. Equal values are counted before the shuffle, and the
    counts summed over ranges, so no task holds or sorts all values of a feature."""
    counts = long.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*KEY).agg(F.sum("_n").alias("_seen"), F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))).alias("_all")).where(F.col("_seen") >= min_count)
    below = lookup(running_sums(counts.where("value IS NOT NULL"), list(KEY), "value", ["_n"]), totals, list(KEY))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("_all").cast("decimal(20,0)") * F.lit(Decimal(str(q)))).cast("long"))
    at = lambda q: F.max(F.when((F.col("below__n") < rank(q)) & (rank(q) <= F.col("below__n") + F.col("_n")), F.col("value")))
    return below.groupBy(*KEY).agg(F.array(*[at(q) for q in quantiles]).alias("quantiles"))


def label_counts(labels: DataFrame, label: str = "label", min_count: int = 0) -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)


def max_scale(long: DataFrame, min_count: int = 0) -> DataFrame:
    """1 / largest value of every feature whose largest value is above 1e-10."""
    out = long.groupBy(*KEY).agg(F.greatest(F.max("value"), F.lit(0.0)).alias("top"), F.count(F.lit(1)).alias("count"))
    return out.where((F.col("top") > 1e-10) & (F.col("count") >= min_count)).select(*KEY, (1 / F.col("top")).alias("scale"))


def dictionary(statistics: DataFrame) -> DataFrame:
    """A dense index, mean and scale for every feature; features that hardly vary keep mean 0 and scale 1.

    Indexes follow the order of names. They are made by sorting in ranges and adding each range's start, so no single
    task sees all features."""
    flat = F.col("variance") < 1e-6
    rows = statistics.select(*KEY, F.when(flat, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(flat, 1.0).otherwise(1 / F.sqrt("variance")).alias("scale"))
    return numbered(rows, list(KEY), "index")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order: a range-partitioned sort, and each partition's start from the sizes of
    those before it (one small row a partition)."""
    placed = in_ranges(df, order)
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_n", "_start")


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Column _part: the number of the range of ``order`` that a row is in. The number of ranges is fixed, so that they are
    the same wherever the table is read in one query."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id())


def running_sums(df: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    """Columns below_<name>: for every row the sum over the rows of its key with a smaller ``order`` (unique within a key).
    Ranges of rows are summed by themselves and each gets the sum of those before it, so no task sorts all rows of a key."""
    placed = in_ranges(df, [*keys, order])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(c).alias(c) for c in names])
    by_key = Window.partitionBy(*keys).orderBy("_part")
    starts = totals.select("_part", *keys, *[before(c, by_key).alias(f"_start_{c}") for c in names])
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    rows = placed.select("*", *[before(c, inside).alias(f"_in_{c}") for c in names]).join(starts, ["_part", *keys])
    return rows.select(*df.columns, *[(F.col(f"_start_{c}") + F.col(f"_in_{c}")).alias(f"below_{c}") for c in names])


def vectorise(rows: DataFrame, dictionary: DataFrame, ids: list[str]) -> DataFrame:
    """Sparse vectors (indices, values) of scaled features of long or packed ``rows``; features that the dictionary lacks are
    dropped. With a dictionary of at most BROADCAST_ROWS, a row's features become indexes where it is, and rows meet by id."""
    dictionary = dictionary.persist()
    known = dictionary.orderBy("index").limit(BROADCAST_ROWS + 1).collect()
    if len(known) <= BROADCAST_ROWS and [r["index"] for r in known] == list(range(len(known))):
        mean, scale = np.array([r["mean"] for r in known], float), np.array([r["scale"] for r in known], float)
        v = indexed(rows, ids, Names([(r["family"], r["feature"]) for r in known]), lambda at, x: scale[at] * (x - mean[at])).where(F.size("indices") > 0)
        packed = v.groupBy(*ids).agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("indices", "values")))).alias("p"))
        return packed.select(*ids, F.col("p.indices").cast("array<bigint>").alias("indices"), F.col("p.values").alias("values"))
    known = lookup(long_of(rows, ids), dictionary, list(KEY)).select(*ids, F.struct(F.col("index"), (F.col("scale") * (F.col("value") - F.col("mean"))).alias("x")).alias("p"))
    packed = known.groupBy(*ids).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return packed.select(*ids, F.col("p.index").alias("indices"), F.col("p.x").alias("values"))


def crosses(long: DataFrame, ids: list[str]) -> DataFrame:
    """Pairs of features of one example whose families are in order, as features of family `<NEW>`."""
    a = long.select(*ids, F.col("family").alias("fa"), F.col("feature").alias("na"))
    b = long.select(*ids, F.col("family").alias("fb"), F.col("feature").alias("nb"))
    pair = a.join(b, ids).where("fa < fb")
    return pair.select(*ids, F.lit("<NEW>").alias("family"), F.concat_ws("^", F.concat_ws(":", "fa", "na"), F.concat_ws(":", "fb", "nb")).alias("feature"), F.lit(1.0).alias("value"))


def mutual_information(long: DataFrame, positive: Column, ids: list[str], min_positive: int = 1) -> DataFrame:
    """log2 of how much likelier each feature is among positive examples; the row ($ALL, $POS) holds the share of
    positive examples. ``positive`` is a boolean of the long rows."""
    examples = long.select(*ids, positive.alias("pos")).distinct()
    total = examples.agg(F.count(F.lit(1)).alias("n"), F.count_if("pos").alias("n_pos"))
    seen = long.select(*ids, *KEY, positive.alias("pos")).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"), F.count_if("pos").alias("c_pos"))
    scored = seen.where(F.col("c_pos") >= min_positive).join(F.broadcast(total))  # one row
    pmi = F.log2((F.col("c_pos") / F.col("n_pos")) / (F.col("c") / F.col("n")))
    return scored.select(*KEY, pmi.alias("pmi")).unionByName(total.select(F.lit("$ALL").alias("family"), F.lit("$POS").alias("feature"), F.try_divide("n_pos", "n").alias("pmi")))


def strongest(pmi: DataFrame) -> DataFrame:
    """Of every family the feature with the largest |pmi|; ties go to the smaller name."""
    best = F.min(F.struct((-F.abs("pmi")).alias("k"), F.col("feature"), F.col("pmi")))
    return pmi.groupBy("family").agg(best.alias("b")).select("family", F.col("b.feature").alias("feature"), F.col("b.pmi").alias("pmi"))
