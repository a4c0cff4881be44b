"""Transforms of dates, which are yyyy-MM-dd strings; what isn't one is skipped."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.features import FeatureSet, Transform
from tessella.functions.scalar import day, days_between, distinct_floats, upsert
from tessella.transforms.registry import transform

PARTS = {"day_of_month": F.dayofmonth, "day_of_week": F.dayofweek, "day_of_year": F.dayofyear, "year": F.year, "month": F.month}


@transform("date_val")
def date_val(config) -> Transform:
    part = PARTS.get(config["date_type"])

    def run(fs: FeatureSet) -> FeatureSet:
        source, target = fs.strings(config["field1"]), config["output"]
        if part is None:
            return fs
        good = F.filter(source, lambda s: day(s).isNotNull())
        new = distinct_floats(F.transform(F.array_distinct(good), lambda s: F.struct(s.alias("key"), part(day(s)).cast("double").alias("value"))))
        return fs.put(floats={target: F.when(source.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run


@transform("date_diff")
def date_diff(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        ends, starts, target = fs.strings(config["field1"]), fs.strings(config["field2"]), config["output"]
        good = lambda a: F.array_distinct(F.filter(a, lambda s: day(s).isNotNull()))
        item = lambda e, s: F.struct(F.concat(e, F.lit("-m-"), s).alias("key"), days_between(day(e), day(s)).cast("double").alias("value"))
        new = distinct_floats(F.flatten(F.transform(good(ends), lambda e: F.transform(good(starts), lambda s: item(e, s)))))
        return fs.put(floats={target: F.when(ends.isNull() | starts.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run
