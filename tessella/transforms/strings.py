"""Transforms of string families."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.features import FeatureSet, Transform
from tessella.functions.scalar import counts, no_strings, once, pairs, to_floats, union, upsert
from tessella.transforms.registry import transform


#: So many rows of a batch at once are Python's strings.
SLICE = 256


def each_string(config, change: Callable[[Column], Column]) -> Transform:
    """Map a function over a family: in place where output is the input, else added to the output."""
    source, target = config["field1"], config.get("output", config["field1"])

    def run(fs: FeatureSet) -> FeatureSet:
        new = F.array_distinct(change(fs.strings(source)))
        return fs.put({target: new if source == target else F.when(fs.strings(source).isNull(), fs.strings(target)).otherwise(union(fs.strings(target), new))})

    return run


@transform("convert_string_case")
def convert_string_case(config) -> Transform:
    case = F.upper if config["convert_to_uppercase"] else F.lower
    return each_string(config, lambda a: F.transform(a, lambda x: case(x)))


@transform("normalize_utf8")
def normalize_utf8(config) -> Transform:
    form = config.get("normalization_form", "NFD")

    @F.arrow_udf("array<string>")
    def normal(arrays: pa.Array) -> pa.Array:
        parts = [pa.array([None if a is None else [unicodedata.normalize(form, s) for s in a] for a in arrays.slice(i, SLICE).to_pylist()], pa.list_(pa.string())) for i in range(0, len(arrays), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return each_string(config, normal)


@transform("replace_all_strings")
def replace_all_strings(config) -> Transform:
    steps = [(regex, to) for step in config["replacements"] for regex, to in step.items()]

    def one(x: Column) -> Column:
        for regex, to in steps:
            x = F.regexp_replace(x, F.lit(regex), F.lit(to))
        return x

    return each_string(config, lambda a: F.transform(a, one))


def _tokens(a: Column, regex: str) -> Column:
    return F.transform(a, lambda s: F.filter(F.split(s, regex, -1), lambda t: F.length(t) > 0))


def _grams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n
    return F.when(last < 0, no_strings()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))


@transform("default_string_tokenizer")
def default_string_tokenizer(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        source = fs.strings(config["field1"])
        lists = _tokens(source, config["regex"])
        out = {config["output"]: F.flatten(lists)}
        if config.get("generate_bigrams", False):
            out[config["bigrams_output"]] = F.flatten(F.transform(lists, lambda t: _grams(t, 2)))
        return fs.put(floats={k: F.when(source.isNull(), fs.floats(k)).otherwise(upsert(fs.floats(k), counts(v))) for k, v in out.items()})

    return run


@transform("ngram")
def ngram(config) -> Transform:
    n, least = int(config["n"]), int(config.get("min_n", config["n"]))

    def run(fs: FeatureSet) -> FeatureSet:
        source, target = fs.strings(config["field1"]), config["output"]
        lists = F.filter(_tokens(source, config["regex"]), lambda t: F.size(t) >= least)
        found = counts(F.flatten(F.transform(lists, lambda t: F.concat(*[_grams(t, k) for k in range(least, n + 1)]))))
        base = F.coalesce(fs.floats(target), F.create_map().cast("map<string,double>"))
        add = lambda new: F.map_zip_with(base, new, lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        summed = once(found, lambda new: F.when(F.size(base) == 0, new).otherwise(add(new)))
        return fs.put(floats={target: F.when(source.isNull(), fs.floats(target)).otherwise(summed)})

    return run


@transform("cross")
def cross(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        a, b, target = fs.strings(config["field1"]), fs.strings(config["field2"]), config["output"]
        some = lambda x, keys: F.filter(x, lambda s: s.isin(list(keys))) if keys else x
        new = F.flatten(F.transform(some(a, config.get("keys1")), lambda x: F.transform(some(b, config.get("keys2")), lambda y: F.concat(x, F.lit("^"), y))))
        return fs.put({target: F.when(a.isNull() | b.isNull(), fs.strings(target)).otherwise(union(fs.strings(target), new))})

    return run


@transform("self_cross")
def self_cross(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        a, target = fs.strings(config["field1"]), config["output"]
        new = F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: x < y), lambda y: F.concat(x, F.lit("^"), y))))
        return fs.put({target: F.when(a.isNull(), fs.strings(target)).otherwise(union(fs.strings(target), new))})

    return run


@transform("delete_string_feature")
def delete_string_feature(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        def gone(s: Column) -> Column:
            out = F.lit(False)
            for k in config["keys"]:
                out = out | s.startswith(k)
            return out

        return fs.put({config["field1"]: F.filter(fs.strings(config["field1"]), lambda s: ~gone(s))})

    return run


@transform("delete_string_feature_family", "delete_string_feature_column")
def delete_string_feature_family(config) -> Transform:
    return lambda fs: fs.drop(strings=config["fields"])


@transform("string_cross_float")
def string_cross_float(config) -> Transform:
    def run(fs: FeatureSet) -> FeatureSet:
        a, m, target = fs.strings(config["field1"]), fs.floats(config["field2"]), config["output"]
        keys1, keys2 = config.get("keys1"), config.get("keys2")
        if keys1:
            name = lambda s: F.when(s.contains(":"), F.substring_index(s, ":", 1)).otherwise(F.lit("RAW"))
            picked = F.filter(a, lambda s: name(s).isin(list(keys1)))
        else:
            picked = a
        numbers = F.filter(pairs(m), lambda e: e["key"].isin(list(keys2))) if keys2 else pairs(m)
        new = to_floats(F.flatten(F.transform(picked, lambda s: F.transform(numbers, lambda e: F.struct(F.concat(s, F.lit("^"), e["key"]).alias("key"), e["value"].alias("value"))))))
        return fs.put(floats={target: F.when(a.isNull() | m.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), new))})

    return run
