"""Transforms of float families."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.features import LABEL, FeatureSet, Transform
from tessella.functions.scalar import no_floats, no_strings, pairs, quantise, text, to_floats, union, upsert
from tessella.transforms.registry import transform

Change = Callable[[FeatureSet, Column], Column]


def over_family(config, change: Change, default_output: bool = True) -> Transform:
    """Put what ``change`` makes of the input family over the output family; rows without the input stay as they are."""
    source = config["field1"]
    target = config.get("output", source) if default_output else config["output"]

    def run(fs: FeatureSet) -> FeatureSet:
        m = fs.floats(source)
        return fs.put(floats={target: F.when(m.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), change(fs, m)))})

    return run


def named(m: Column, keys) -> Column:
    """The entries with these keys; all where no keys are given."""
    return m if keys is None else F.map_filter(m, lambda k, v: k.isin(list(keys)))


@transform("cap_float")
def cap_float(config) -> Transform:
    low, high = float(config["lower_bound"]), float(config["upper_bound"])
    return over_family(config, lambda fs, m: F.transform_values(named(m, config["keys"]), lambda k, v: F.least(F.greatest(v, F.lit(low)), F.lit(high))))


@transform("coalesce_float")
def coalesce_float(config) -> Transform:
    value = float(config["value"])

    def fill(fs: FeatureSet, m: Column) -> Column:
        whole = F.create_map(*[x for k in config["keys"] for x in (F.lit(k), F.lit(value))])
        return F.map_filter(whole, lambda k, v: ~F.map_contains_key(m, k))

    return over_family(config, fill)


@transform("cut_float")
def cut_float(config) -> Transform:
    source, target = config["field1"], config.get("output", config["field1"])
    low, high, keys = float(config.get("lower_bound", -math.inf)), float(config.get("upper_bound", math.inf)), list(config["keys"])

    def run(fs: FeatureSet) -> FeatureSet:
        m = fs.floats(source)
        inside = lambda v: (v >= low) & (v <= high)
        if source == target:
            return fs.put(floats={source: F.map_filter(m, lambda k, v: ~k.isin(keys) | inside(v))})
        new = F.map_filter(m, lambda k, v: k.isin(keys) & inside(v))
        return fs.put(floats={target: F.when(m.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run


MATH = {"sin": F.sin, "cos": F.cos, "log10": F.log10, "log": F.ln, "abs": F.abs}


@transform("math_float")
def math_float(config) -> Transform:
    function = MATH.get(config["function"])
    if function is None:
        return lambda fs: fs
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf)
    return over_family(config, lambda fs, m: F.map_filter(F.transform_values(named(m, config.get("keys")), lambda k, v: function(v)), lambda k, v: real(v)), False)


@transform("normalize_float")
def normalize_float(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        m = fs.floats(config["field1"])
        norm = F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v * v))
        return fs.put(floats={config["field1"]: F.when(norm > 0, F.transform_values(m, lambda k, v: v / norm)).otherwise(m)})

    return run


def with_other(config, mark: str, value: Callable[[Column, Column], Column]) -> Transform:
    """Combine chosen features of field1 with one number of field2."""

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        other = fs.floats(config["field2"])[config["key2"]]
        new = F.transform_keys(F.transform_values(named(m, config["keys"]), lambda k, v: value(v, other)), lambda k, v: F.concat(k, F.lit(f"{mark}{config['key2']}")))
        return fs.put(floats={target: F.when(m.isNull() | other.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run


@transform("divide")
def divide(config) -> Transform:
    """A zero denominator gives an infinity of the numerator's sign, or NaN for zero over zero, as doubles do."""
    constant = float(config["constant"])

    def value(v: Column, other: Column) -> Column:
        below = other + constant
        edge = F.when(v > 0, F.lit(math.inf)).when(v < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
        return F.when(below == 0, edge).otherwise(F.try_divide(v, below))

    return with_other(config, "-d-", value)


@transform("subtract")
def subtract(config) -> Transform:
    return with_other(config, "-", lambda v, other: v - other)


@transform("product")
def product(config) -> Transform:
    def value(fs: FeatureSet, m: Column) -> Column:
        out = F.lit(1.0)
        for k in config["keys"]:
            out = out * (1 + F.coalesce(m[k], F.lit(0.0)))
        return F.create_map(F.lit("*"), out)

    return over_family(config, value, False)


@transform("approximate_percentile")
def approximate_percentile(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        low, high, x = m[config["low"]], m[config["upper"]], fs.floats(config["field2"])[config["key2"]]
        spread = high - low
        part = F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(F.try_divide(x - low, spread))
        known = (spread >= float(config["minDiff"])) & x.isNotNull()
        return fs.put(floats={target: F.when(known, upsert(fs.floats(target), F.create_map(F.lit(config["outputKey"]), part))).otherwise(fs.floats(target))})

    return run


@transform("stuff_id")
def stuff_id(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        who, x, target = fs.floats(config["field1"])[config["key1"]], fs.floats(config["field2"])[config["key2"]], config["output"]
        new = F.create_map(F.concat(F.lit(config["key2"] + "@"), who.cast("long").cast("string")), x)
        return fs.put(floats={target: F.when(who.isNull() | x.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run


@transform("float_label")
def float_label(config) -> Transform:
    merge = config["merge"].lower()
    if merge not in ("override", "override_negative", "override_positive", "skip"):
        raise ValueError(f"no merge strategy is called {merge!r}")

    def run(fs: FeatureSet) -> FeatureSet:
        labels = F.coalesce(fs.floats(LABEL), no_floats())
        old, x = labels[""], fs.floats(config["field1"])[config["key1"]]
        new = F.when(x >= float(config["threshold"]), 1.0).otherwise(-1.0)
        free = {"override": F.lit(True), "override_negative": (old < 0) & (new > 0), "override_positive": (old > 0) & (new < 0), "skip": F.lit(False)}[merge]
        return fs.put(floats={LABEL: F.when(x.isNotNull() & (old.isNull() | free), upsert(labels, F.create_map(F.lit(""), new))).otherwise(labels)})

    return run


@transform("delete_float_feature")
def delete_float_feature(config) -> Transform:
    return lambda fs: fs.put(floats={config["field1"]: F.map_filter(fs.floats(config["field1"]), lambda k, v: ~k.isin(list(config["keys"])))})


@transform("delete_float_feature_family")
def delete_float_feature_family(config) -> Transform:
    return lambda fs: fs.drop(floats=config["fields"])


@transform("nearest")
def nearest(config) -> Transform:
    """Ties go to the smaller name."""

    def run(fs: FeatureSet) -> FeatureSet:
        m, x, target = fs.floats(config["field1"]), fs.floats(config["field2"])[config["key"]], config["output"]
        best = F.array_min(F.transform(pairs(m), lambda e: F.struct(F.abs(e["value"] - x).alias("far"), e["key"].alias("name"))))
        name = F.when(best["far"] < 1e10, best["name"]).otherwise(F.lit("nothing"))
        new = F.array(F.concat(F.lit(config["key"] + "~="), name))
        return fs.put({target: F.when(m.isNull() | x.isNull(), fs.strings(target)).otherwise(union(fs.strings(target), new))})

    return run


@transform("float_cross_float")
def float_cross_float(config) -> Transform:
    bucket, cap = float(config["bucket"]), float(config.get("cap", 1e10))

    def run(fs: FeatureSet) -> FeatureSet:
        a, b, target = fs.floats(config["field1"]), fs.floats(config["field2"]), config["output"]
        key = lambda e: F.concat(e["key"], F.lit("="), text(quantise(F.least(e["value"], F.lit(cap)), bucket)), F.lit("^"))
        new = to_floats(F.flatten(F.transform(pairs(a), lambda e: F.transform(pairs(b), lambda g: F.struct(F.concat(key(e), g["key"]).alias("key"), g["value"].alias("value"))))))
        return fs.put(floats={target: F.when(a.isNull() | b.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run


@transform("stump")
def stump(config) -> Transform:
    cuts = [(f, n, float(t), name) for f, n, t, name in (s.split(",") for s in config["stumps"])]

    def run(fs: FeatureSet) -> FeatureSet:
        target = config["output"]
        new = F.array_compact(F.array(*[F.when(fs.floats(f)[n] >= t, F.lit(name)) for f, n, t, name in cuts])) if cuts else no_strings()
        return fs.put({target: union(fs.strings(target), new)})

    return run
