"""Splits and samples, all decided by hashes so that they can be repeated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digits(n: int, *parts: Column) -> Column:
    """The first n hexadecimal digits, as a number, of the md5 of the parts joined by colons (null as `null`)."""
    texts = [F.coalesce(c.cast("string"), F.lit("null")) for c in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, n), 16, 10).cast("long")


def is_training(*ids: Column, fraction: float = 0.9373) -> Column:
    """True for the share of ids that is trained on: 239 of 256 by default."""
    return _digits(2, *ids) > 255 - int(255 * fraction)


def place(*ids: Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) of 52 bits."""
    return _digits(13, F.lit(seed), *ids) / F.lit(float(1 << 52))


def fold(*ids: Column, folds: int) -> Column:
    """A repeatable number from 0 to folds - 1."""
    return F.pmod(_digits(13, F.lit("fold"), *ids), F.lit(folds)).cast("int")


def bernoulli(df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 0) -> DataFrame:
    return df.where(place(*map(F.col, ids), seed=seed) < fraction)


def downsample(df: DataFrame, label: str, weights: Mapping, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Keep rows of a named class with its weight as the probability, all others always."""
    keep = F.lit(1.0)
    for value, w in weights.items():
        keep = F.when(F.col(label) == value, F.lit(float(w))).otherwise(keep)
    return df.where(place(*map(F.col, ids), seed=seed) < keep)


def slices(df: DataFrame, key: str, ids: Sequence[str], ratios: Mapping[str, float], seed: int = 0) -> DataFrame:
    """Column slice: every key's rows in a hashed order, cut by cumulative ratios."""
    w = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), *map(F.col, ids)), *ids)
    at, out, edge = F.percent_rank().over(w), None, 0.0
    for name, ratio in ratios.items():
        edge += ratio
        hit = at < edge if edge < 1 - 1e-9 else F.lit(True)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return df.withColumn("slice", out)


def enough(df: DataFrame, key: str, least: int = 100, condition: Column | None = None, least_true: int = 0) -> DataFrame:
    """Rows of keys with at least ``least`` rows, of which ``least_true`` meet the condition. The counts are aggregated
    first and joined, so no key's rows are gathered."""
    aggs = [F.count(F.lit(1)).alias("_n")] + ([F.count_if(condition).alias("_t")] if condition is not None else [])
    good = df.groupBy(key).agg(*aggs).where(F.col("_n") >= least)
    if condition is not None:
        good = good.where(F.col("_t") >= least_true)
    return df.join(good.select(key), key, "left_semi")


def first_columns_known(df: DataFrame, n: int) -> DataFrame:
    return df.dropna(subset=df.columns[:n])


def random_order(df: DataFrame, ids: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *map(F.col, ids)))
