"""Transforms from numbers to names of their ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.features import FeatureSet, Transform
from tessella.functions.scalar import log2, pairs, quantise, text, to_floats, truncated, union, upsert
from tessella.transforms.floats import named
from tessella.transforms.registry import transform


def to_strings(config, names: Callable[[Column, Column], Column], chosen: Callable[[Column], Column] = lambda m: m, many: bool = False) -> Transform:
    """Add to the output family what ``names`` makes of every feature (an array of names where ``many``)."""

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        found = F.transform(pairs(chosen(m)), lambda e: names(e["key"], e["value"]))
        new = F.flatten(found) if many else found
        return fs.put({target: F.when(m.isNull() | (F.size(m) == 0), fs.strings(target)).otherwise(union(fs.strings(target), F.array_distinct(new)))})

    return run


def selection(config) -> Callable[[Column], Column]:
    """Of a family the features that select_features names, without those of exclude_features."""
    yes, no = config.get("select_features"), config.get("exclude_features")

    def run(m: Column) -> Column:
        m = named(m, yes)
        return m if no is None else F.map_filter(m, lambda k, v: ~k.isin(list(no)))

    return run


def equals(k: Column, v: Column) -> Column:
    return F.concat(k, F.lit("="), v)


def at_scale(k: Column, b: Column | float) -> Column:
    return F.concat(k, F.lit("["), text(b if isinstance(b, Column) else F.lit(float(b))), F.lit("]"))


@transform("quantize")
def quantize(config) -> Transform:
    scale = float(config["scale"])
    return to_strings(config, lambda k, v: equals(k, truncated(v * scale).cast("string")))


def _multiscale(config, chosen) -> Transform:
    buckets = [float(b) for b in config["buckets"]]

    def names(k: Column, v: Column) -> Column:
        return F.when(v == 0, F.array(equals(k, F.lit("0")))).otherwise(F.array(*[equals(at_scale(k, b), text(quantise(v, b))) for b in buckets]))

    return to_strings(config, names, chosen, many=True)


@transform("multiscale_quantize")
def multiscale_quantize(config) -> Transform:
    return _multiscale(config, lambda m: m)


@transform("custom_multiscale_quantize")
def custom_multiscale_quantize(config) -> Transform:
    return _multiscale(config, selection(config))


LADDER = ((1.0, 1 / 32), (10.0, 0.125), (25.0, 0.25), (50.0, 5.0), (100.0, 10.0), (400.0, 25.0), (2000.0, 100.0), (10000.0, 250.0))


@transform("linear_log_quantize")
def linear_log_quantize(config) -> Transform:
    def names(k: Column, v: Column) -> Column:
        size = F.abs(v)
        said = F.when(size < 1e-2, F.lit("0"))
        for limit, step in LADDER:
            q = quantise(size, step)
            said = said.when(size <= limit, q.cast("int").cast("string") if limit > 25 else text(q))
        power = F.pow(F.lit(2.0), F.floor(log2(size))).cast("long").cast("string")
        return F.concat(k, F.lit("="), F.when(v < 0, "-").otherwise(""), said.otherwise(power))

    return to_strings(config, names)


@transform("custom_linear_log_quantize")
def custom_linear_log_quantize(config) -> Transform:
    steps = sorted((float(limit), float(step)) for pair in config["limit_bucket"] for limit, step in pair.items())
    top, last = steps[-1]

    def names(k: Column, v: Column) -> Column:
        size = F.abs(v)
        q = F.when(size >= top, quantise(F.lit(top), last))
        for limit, step in steps:
            q = q.when(size < limit, quantise(size, step))
        short = truncated(q * 1000) / 1000.0
        return F.when(size < 1e-2, equals(k, F.lit("0.0"))).otherwise(F.concat(k, F.lit("="), F.when(v < 0, "-").otherwise(""), text(short)))

    return to_strings(config, names, selection(config))


@transform("custom_range_quantize")
def custom_range_quantize(config) -> Transform:
    edges = [float(t) for t in config["thresholds"]]

    def names(k: Column, v: Column) -> Column:
        out = F.when(v <= edges[0], F.concat(k, F.lit("<="), text(F.lit(edges[0]))))
        for a, b in zip(edges, edges[1:], strict=False):
            out = out.when(v <= b, F.concat(text(F.lit(a)), F.lit("<"), k, F.lit("<="), text(F.lit(b))))
        return out.otherwise(F.concat(k, F.lit(">"), text(F.lit(edges[-1]))))

    return to_strings(config, names, selection(config))


@transform("bucket_float")
def bucket_float(config) -> Transform:
    bucket = float(config["bucket"])

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        new = to_floats(F.transform(pairs(m), lambda e: F.struct(equals(at_scale(e["key"], bucket), text(quantise(e["value"], bucket))).alias("key"), (e["value"] - quantise(e["value"], bucket)).alias("value"))))
        return fs.put(floats={target: F.when(m.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run


def _moved(fs: FeatureSet, source: str, target: str, chosen: Column, names: Column, keep: bool) -> FeatureSet:
    """Names go to a string family, and the features that gave them leave their family unless they are kept."""
    m = fs.floats(source)
    strings = F.when(m.isNull(), fs.strings(target)).otherwise(union(fs.strings(target), F.array_distinct(names)))
    left = m if keep else F.map_filter(m, lambda k, v: ~F.map_contains_key(chosen, k))
    return fs.put({target: strings}, {source: left})


@transform("float_to_string")
def float_to_string(config) -> Transform:
    values = [float(v) for v in config["values"]]

    def run(fs: FeatureSet) -> FeatureSet:
        chosen = F.map_filter(named(fs.floats(config["field1"]), config.get("keys")), lambda k, v: v.isin(values))
        return _moved(fs, config["field1"], config["string_output"], chosen, F.transform(pairs(chosen), lambda e: equals(e["key"], text(e["value"]))), False)

    return run


@transform("move_float_to_string")
def move_float_to_string(config) -> Transform:
    bucket, cap = float(config["bucket"]), float(config.get("cap", 1e10))

    def run(fs: FeatureSet) -> FeatureSet:
        chosen = named(fs.floats(config["field1"]), config.get("keys"))
        names = F.transform(pairs(chosen), lambda e: equals(e["key"], text(quantise(F.least(e["value"], F.lit(cap)), bucket))))
        return _moved(fs, config["field1"], config["output"], chosen, names, bool(config.get("keep", False)))

    return run


@transform("multiscale_move_float_to_string")
def multiscale_move_float_to_string(config) -> Transform:
    buckets, cap = [float(b) for b in config["buckets"]], float(config.get("cap", 1e10))

    def run(fs: FeatureSet) -> FeatureSet:
        chosen = named(fs.floats(config["field1"]), config["keys"])
        names = F.flatten(F.transform(pairs(chosen), lambda e: F.array(*[equals(at_scale(e["key"], b), text(quantise(F.least(e["value"], F.lit(cap)), b))) for b in buckets])))
        return _moved(fs, config["field1"], config["output"], chosen, names, False)

    return run


@transform("move_float_to_string_and_float")
def move_float_to_string_and_float(config) -> Transform:
    bucket, low, high = float(config["bucket"]), float(config["min_bucket"]), float(config["max_bucket"])

    def run(fs: FeatureSet) -> FeatureSet:
        m = fs.floats(config["field1"])
        inside = lambda v: (quantise(v, bucket) >= low) & (quantise(v, bucket) <= high)
        chosen, s, f = named(m, config.get("keys")), config["string_output"], config["float_output"]
        names = F.transform(pairs(F.map_filter(chosen, lambda k, v: inside(v))), lambda e: equals(e["key"], text(quantise(e["value"], bucket))))
        return fs.put(
            {s: F.when(m.isNull(), fs.strings(s)).otherwise(union(fs.strings(s), names))},
            {f: F.when(m.isNull(), fs.floats(f)).otherwise(upsert(fs.floats(f), F.map_filter(chosen, lambda k, v: ~inside(v))))},
        )

    return run


def _cell(x: Column, y: Column, b: float) -> Column:
    return F.concat(F.lit(f"[{b}]=("), text(quantise(x, b)), F.lit(","), text(quantise(y, b)), F.lit(")"))


@transform("multiscale_grid_quantize")
def multiscale_grid_quantize(config) -> Transform:
    buckets = [float(b) for b in config["buckets"]]

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        x, y = m[config["value1"]], m[config["value2"]]
        return fs.put({target: F.when(x.isNull() | y.isNull(), fs.strings(target)).otherwise(union(fs.strings(target), F.array(*[_cell(x, y, b) for b in buckets])))})

    return run


@transform("multiscale_grid_continuous")
def multiscale_grid_continuous(config) -> Transform:
    buckets = [float(b) for b in config["buckets"]]

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        x, y = m[config["value1"]], m[config["value2"]]
        entries = [e for b in buckets for e in (F.concat(_cell(x, y, b), F.lit("@1")), x - quantise(x, b), F.concat(_cell(x, y, b), F.lit("@2")), y - quantise(y, b))]
        return fs.put(floats={target: F.when(x.isNull() | y.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), F.create_map(*entries)))})

    return run
