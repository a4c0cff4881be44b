"""Transforms against the values that their definitions give."""

import math

import pytest

from tessella.features import FeatureSet
from tessella.transforms import NAMES, Transformer, build

LOC = {"lat": 37.7, "long": 40.0, "z": -20.0}
LADDER = {"a": 0.0, "b": 0.13, "c": 1.23, "d": 5.0, "e": 17.5, "f": 99.98, "g": 365.0, "h": 65537.0, "i": -1.0, "j": -23.0}


def features(spark, strings=None, floats=None, dense=None):
    strings, floats, dense = strings or {}, floats or {}, dense or {}
    schema = ["id int", *[f"`s:{k}` array<string>" for k in strings], *[f"`f:{k}` map<string,double>" for k in floats], *[f"`d:{k}` array<double>" for k in dense]]
    return FeatureSet(spark.createDataFrame([(1, *strings.values(), *floats.values(), *dense.values())], ", ".join(schema)))


def run(spark, config, family, strings=None, floats=None, dense=None, kind="s"):
    fs = build(config)(features(spark, strings, floats, dense))
    column = {"s": fs.strings, "f": fs.floats, "d": fs.dense}[kind](family)
    got = fs.df.select(column.alias("x")).first()["x"]
    return sorted(got) if isinstance(got, list) and kind == "s" else got


STRING_CASES = [
    ({"transform": "cross", "field1": "a", "field2": "b", "output": "o"}, {"a": ["aaa", "bbb"], "b": ["11", "22"]}, None, ["aaa^11", "aaa^22", "bbb^11", "bbb^22"]),
    ({"transform": "cross", "field1": "a", "field2": "b", "output": "o", "keys1": ["aaa"], "keys2": ["22"]}, {"a": ["aaa", "bbb"], "b": ["11", "22"]}, None, ["aaa^22"]),
    ({"transform": "self_cross", "field1": "a", "output": "o"}, {"a": ["aaa", "bbb"]}, None, ["aaa^bbb"]),
    ({"transform": "quantize", "field1": "loc", "scale": 10, "output": "o"}, None, {"loc": {"lat": 37.7, "long": 40.0}}, ["lat=377", "long=400"]),
    ({"transform": "multiscale_quantize", "field1": "loc", "buckets": [1.0, 10.0], "output": "o"}, None, {"loc": {"lat": 37.7, "zero": 0.0, "negative": -1.0}}, ["lat[1.0]=37.0", "lat[10.0]=30.0", "negative[1.0]=-1.0", "negative[10.0]=0.0", "zero=0"]),
    ({"transform": "linear_log_quantize", "field1": "loc", "output": "o"}, None, {"loc": LADDER}, ["a=0", "b=0.125", "c=1.125", "d=5.0", "e=17.5", "f=90", "g=350", "h=65536", "i=-1.0", "j=-23.0"]),
    (
        {"transform": "custom_linear_log_quantize", "field1": "loc", "output": "o", "limit_bucket": [{"1.0": 0.125}, {"10": 0.5}, {"25": 2}, {"50": 5}, {"100": 10}, {"400": 25}, {"2000": 100}, {"10000": 250}]},
        None, {"loc": LADDER}, ["a=0.0", "b=0.125", "c=1.0", "d=5.0", "e=16.0", "f=90.0", "g=350.0", "h=10000.0", "i=-1.0", "j=-22.0"],
    ),
    ({"transform": "custom_range_quantize", "field1": "t", "thresholds": [7, 28], "output": "o"}, None, {"t": {"short": 3.0, "med": 8.0, "long": 30.0, "low": 7.0, "high": 28.0}}, ["7.0<high<=28.0", "7.0<med<=28.0", "long>28.0", "low<=7.0", "short<=7.0"]),
    ({"transform": "multiscale_grid_quantize", "field1": "loc", "value1": "lat", "value2": "long", "buckets": [1.0, 10.0], "output": "o"}, None, {"loc": LOC}, ["[1.0]=(37.0,40.0)", "[10.0]=(30.0,40.0)"]),
    ({"transform": "move_float_to_string", "field1": "loc", "bucket": 1.0, "output": "o", "keys": ["lat"]}, None, {"loc": LOC}, ["lat=37.0"]),
    ({"transform": "move_float_to_string", "field1": "loc", "bucket": 1.0, "output": "o"}, None, {"loc": LOC}, ["lat=37.0", "long=40.0", "z=-20.0"]),
    (
        {"transform": "move_float_to_string_and_float", "field1": "f", "bucket": 1.0, "min_bucket": 0.0, "max_bucket": 10.0, "keys": list("abcdefgh"), "string_output": "o", "float_output": "p"},
        None, {"f": {"a": 0.0, "b": 10.0, "c": 9.9, "d": 10.1, "e": 11.01, "f": -0.1, "g": -1.01, "h": 21.3, "i": 2000.0}}, ["a=0.0", "b=10.0", "c=9.0", "d=10.0", "f=0.0"],
    ),
    ({"transform": "nearest", "field1": "loc", "field2": "g", "key": "foo", "output": "o"}, None, {"loc": {"lat": 37.7, "long": 40.0}, "g": {"foo": 41.0}}, ["foo~=long"]),
    ({"transform": "delete_string_feature", "field1": "o", "keys": ["a"]}, {"o": ["aaa", "bbb"]}, None, ["bbb"]),
    ({"transform": "stump", "stumps": ["loc,lat,30.0,north", "loc,long,50,east"], "output": "o"}, None, {"loc": LOC}, ["north"]),
    ({"transform": "replace_all_strings", "field1": "a", "replacements": [{"b+": "x"}, {"(a)": "$1."}], "output": "o"}, {"a": ["abba"]}, None, ["a.xa."]),
    ({"transform": "normalize_utf8", "field1": "a", "output": "o"}, {"a": ["Füße"]}, None, ["Füße"]),
    ({"transform": "float_to_string", "field1": "f", "keys": ["a"], "values": [1.0], "string_output": "o"}, None, {"f": {"a": 1.0, "b": 1.0}}, ["a=1.0"]),
]


@pytest.mark.parametrize("config, strings, floats, expected", STRING_CASES, ids=lambda v: v.get("transform") if isinstance(v, dict) and "transform" in v else "")
def test_string_outputs(spark, config, strings, floats, expected):
    assert run(spark, config, "o", strings, floats) == sorted(expected)


FLOAT_CASES = [
    ({"transform": "bucket_float", "field1": "loc", "bucket": 1.0, "output": "o"}, {"loc": {"lat": 37.7, "zero": 0.0, "negative": -1.5}}, {"lat[1.0]=37.0": 0.7, "zero[1.0]=0.0": 0.0, "negative[1.0]=-1.0": -0.5}),
    ({"transform": "divide", "field1": "loc", "keys": ["lat"], "field2": "F", "key2": "foo", "constant": 0.1, "output": "o"}, {"loc": LOC, "F": {"foo": 1.5}}, {"lat-d-foo": 37.7 / 1.6}),
    ({"transform": "divide", "field1": "loc", "keys": ["lat", "z"], "field2": "F", "key2": "foo", "constant": 0.0, "output": "o"}, {"loc": LOC, "F": {"foo": 0.0}}, {"lat-d-foo": math.inf, "z-d-foo": -math.inf}),
    ({"transform": "subtract", "field1": "loc", "keys": ["lat"], "field2": "F", "key2": "foo", "output": "o"}, {"loc": LOC, "F": {"foo": 1.5}}, {"lat-foo": 36.2}),
    ({"transform": "product", "field1": "loc", "keys": ["lat", "long"], "output": "o"}, {"loc": LOC}, {"*": 38.7 * 41}),
    ({"transform": "stuff_id", "field1": "ID", "key1": "id", "field2": "F", "key2": "searches", "output": "o"}, {"ID": {"id": 123456789.0}, "F": {"searches": 37.7}}, {"searches@123456789": 37.7}),
    ({"transform": "math_float", "field1": "loc", "keys": ["lat", "long", "z"], "function": "log10", "output": "o"}, {"loc": LOC}, {"lat": math.log10(37.7), "long": math.log10(40)}),
    ({"transform": "multiscale_grid_continuous", "field1": "loc", "value1": "lat", "value2": "long", "buckets": [5.0], "output": "o"}, {"loc": LOC}, {"[5.0]=(35.0,40.0)@1": 2.7, "[5.0]=(35.0,40.0)@2": 0.0}),
    ({"transform": "float_cross_float", "field1": "a", "bucket": 1.0, "cap": 1000.0, "field2": "b", "output": "o"}, {"a": {"x": 50.0, "z": 2000.0}, "b": {"i": 1.2}}, {"x=50.0^i": 1.2, "z=1000.0^i": 1.2}),
    ({"transform": "cap_float", "field1": "loc", "keys": ["lat", "z"], "lower_bound": -5, "upper_bound": 20, "output": "o"}, {"loc": LOC}, {"lat": 20.0, "z": -5.0}),
    ({"transform": "coalesce_float", "field1": "loc", "keys": ["lat", "new"], "value": 3, "output": "o"}, {"loc": LOC}, {"new": 3.0}),
    ({"transform": "cut_float", "field1": "loc", "keys": ["lat", "z"], "lower_bound": 0, "output": "o"}, {"loc": LOC}, {"lat": 37.7}),
    ({"transform": "approximate_percentile", "field1": "F", "low": "l", "upper": "u", "field2": "G", "key2": "x", "minDiff": 1, "output": "o", "outputKey": "p"}, {"F": {"l": 1.0, "u": 5.0}, "G": {"x": 2.0}}, {"p": 0.25}),
]


@pytest.mark.parametrize("config, floats, expected", FLOAT_CASES, ids=lambda v: v.get("transform", "") if isinstance(v, dict) else "")
def test_float_outputs(spark, config, floats, expected):
    assert run(spark, config, "o", floats=floats, kind="f") == pytest.approx(expected)


def test_winner_take_all_words(spark):
    fs = features(spark, dense={"a": [0.1, 0.9, 0.2, 0.5, 0.3, 0.7, 0.6, 0.4]})
    config = {"transform": "wta", "field_names": ["a", "none"], "output": "o", "seed": 1234, "num_words_per_feature": 3, "num_tokens_per_word": 2}
    words = build(config)(fs).df.select("s:o").first()[0]
    assert [w.split(":")[0] for w in words] == ["a0", "a1", "a2"] and all(0 <= int(w.split(":")[1]) < 16 for w in words)


def test_java_random():
    from tessella.functions.java_random import JavaRandom

    r = JavaRandom(42)
    assert [r.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]


def test_dates(spark):
    days = {"d": ["2009-03-01", "2009-02-27", "no date"]}
    for part, want in {"day_of_month": (1, 27), "day_of_week": (1, 6), "day_of_year": (60, 58), "year": (2009, 2009), "month": (3, 2)}.items():
        got = run(spark, {"transform": "date_val", "field1": "d", "date_type": part, "output": "o"}, "o", days, kind="f")
        assert got == {"2009-03-01": want[0], "2009-02-27": want[1]}
    got = run(spark, {"transform": "date_diff", "field1": "e", "field2": "s", "output": "o"}, "o", {"e": ["2009-03-01"], "s": ["2009-02-27"]}, kind="f")
    assert got == {"2009-03-01-m-2009-02-27": 2.0}


def test_tokens_and_ngrams(spark):
    text = {"t": ["I like blueberry pie, apple pie; and I also like blue!", "I'm so blue: I like blue"]}
    tokens = run(spark, {"transform": "default_string_tokenizer", "field1": "t", "regex": r"[\s\p{Punct}]", "output": "o", "generate_bigrams": True, "bigrams_output": "b"}, "o", text, kind="f")
    assert tokens["I"] == 4 and tokens["like"] == 3 and tokens["blue"] == 3 and tokens["pie"] == 2
    grams = run(spark, {"transform": "ngram", "field1": "t", "regex": r"\s+", "n": 3, "min_n": 2, "output": "o"}, "o", {"t": ["a b c", "x"]}, kind="f")
    assert grams == {"a b": 1, "b c": 1, "a b c": 1}


def test_trees(spark):
    nodes = [{"type": "x", "split": 1.0, "left": 1, "right": 2}, {"type": "leaf"}, {"type": "y", "split": 2.0, "left": 3, "right": 4}, {"type": "leaf"}, {"type": "leaf"}]
    config = {"field1": "loc", "value1": "lat", "value2": "long", "max_count": 2, "output": "o", "nodes": nodes}
    assert run(spark, {"transform": "kdtree", **config}, "o", floats={"loc": LOC}) == ["2", "4"]
    assert run(spark, {"transform": "kdtree_continuous", **config}, "o", floats={"loc": LOC}, kind="f") == pytest.approx({"2": 38.0})
    tree = {"transform": "decision_tree", "nodes": ["P,0,loc,lat,30,1,2", "L,1,0.25,low", "L,2,0.5,high"], "output_leaves": "o", "output_score_family": "s", "output_score_name": "t"}
    assert run(spark, tree, "o", floats={"loc": LOC}) == ["high"] and run(spark, tree, "o", floats={"loc": {"x": 1.0}}) == ["low"]


def test_dense(spark):
    assert run(spark, {"transform": "float_to_dense", "fields": ["loc", "loc"], "keys": ["lat", "z"]}, "lat^z", floats={"loc": LOC}, kind="d") == [37.7, -20.0]
    assert run(spark, {"transform": "float_to_dense", "fields": ["loc", "loc"], "keys": ["lat", "none"]}, "lat^none", floats={"loc": LOC}, kind="d") is None


def test_normalize(spark):
    n = math.sqrt(37.7**2 + 40**2 + 20**2)
    assert run(spark, {"transform": "normalize_float", "field1": "loc"}, "loc", floats={"loc": LOC}, kind="f") == pytest.approx({k: v / n for k, v in LOC.items()})


@pytest.mark.parametrize("merge, old, want", [("override", 1.0, -1.0), ("skip", 1.0, 1.0), ("override_negative", 1.0, 1.0), ("override_positive", 1.0, -1.0), ("override_negative", -1.0, -1.0), ("skip", None, -1.0)])
def test_float_label(spark, merge, old, want):
    floats = {"f": {"x": 1.0}} | ({"LABEL": {"": old}} if old is not None else {})
    assert run(spark, {"transform": "float_label", "field1": "f", "key1": "x", "threshold": 2, "merge": merge}, "LABEL", floats=floats, kind="f") == {"": want}


EMPTY = {
    "field1": "none", "field2": "none2", "output": "o", "keys": ["a"], "regex": "x", "n": 1, "scale": 1, "bucket": 1, "buckets": [1], "thresholds": [1], "limit_bucket": [{"1": 1}], "lower_bound": 0, "upper_bound": 1, "value": 1, "values": [1],
    "function": "abs", "constant": 1, "key": "k", "key1": "k", "key2": "k", "low": "l", "upper": "u", "minDiff": 1, "outputKey": "p", "threshold": 1, "merge": "skip", "fields": ["x", "y"], "value1": "a", "value2": "b", "max_count": 1, "date_type": "year",
    "string_output": "o", "float_output": "p", "min_bucket": 0, "max_bucket": 1, "convert_to_uppercase": True, "replacements": [], "stumps": ["a,b,1,c"], "field_names": ["v"], "seed": 1, "num_words_per_feature": 1, "num_tokens_per_word": 1,
    "output_leaves": "o", "output_score_family": "s", "output_score_name": "t",
}


def test_absent_families_are_no_error(spark):
    fs = features(spark, {"other": ["x"]}, {"others": {"y": 1.0}})
    for name in NAMES:
        config = {"transform": name, **EMPTY, "nodes": [{"type": "leaf"}]}
        if name == "decision_tree":
            config["nodes"] = ["L,0,1.0,leaf"]
        if name == "float_to_dense":
            config["keys"] = ["a", "b"]
        assert build(config)(fs).df.count() == 1, name


def test_all_names_are_there():
    assert len(NAMES) + 1 == 49  # list is dispatched by build itself


def test_unknown_transform():
    with pytest.raises(KeyError):
        build({"transform": "no such thing"})


def test_context_is_merged_once(spark):
    config = {
        "m": {"context_transform": "c", "item_transform": "i", "combined_transform": "x"},
        "c": {"transform": "convert_string_case", "field1": "who", "convert_to_uppercase": True},
        "i": {"transform": "quantize", "field1": "loc", "scale": 1, "output": "q"},
        "x": {"transform": "cross", "field1": "who", "field2": "q", "output": "o"},
    }
    items = features(spark, floats={"loc": {"a": 2.0}})
    context = features(spark, {"who": ["me"]})
    fs = Transformer(config, "m")(items, context, ["id"])
    assert fs.df.select("s:o").first()[0] == ["ME^a=2"]


def test_rows_of_a_family_are_computed_once(spark):
    """An explode of an expression comes with a filter on the same expression, which computes it again."""
    from pyspark.sql import functions as F

    from tessella.features import FeatureSet, flatten
    from tessella.queries.base import dense_rows, float_rows, string_rows

    df = spark.createDataFrame([(1, ["a", "b"], {"x": 1.0}, [1.0, 2.0]), (2, [], {}, []), (3, None, None, None), (4, ["c", None], {"y": 2.0}, [None])], "id int, s array<string>, f map<string,double>, d array<double>")
    fs = FeatureSet(df.select("id", F.transform("s", F.upper).alias("s:s"), F.transform_values("f", lambda k, v: v + 1).alias("f:f"), F.transform("d", lambda x: x * 2).alias("d:d")))
    rows = lambda made: sorted(map(tuple, made.collect()), key=repr)
    assert rows(string_rows(fs, "s", ["id"])) == [(1, "A"), (1, "B"), (4, "C"), (4, None)]
    assert rows(float_rows(fs, "f", ["id"])) == [(1, "x", 2.0), (4, "y", 3.0)]
    assert rows(dense_rows(fs, "d", ["id"])) == [(1, 0, 2.0), (1, 1, 4.0), (4, 0, None)]
    assert rows(flatten(fs, ["id"])) == [(1, "f", "x", 2.0), (1, "s", "A", 1.0), (1, "s", "B", 1.0), (4, "f", "y", 3.0), (4, "s", "C", 1.0), (4, "s", None, 1.0)]
    for made, name in ((string_rows(fs, "s", ["id"]), "upper"), (float_rows(fs, "f", ["id"]), "transform_values"), (dense_rows(fs, "d", ["id"]), "transform(")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count(name) == 1


def test_the_last_of_equal_keys_wins(spark):
    from pyspark.sql import functions as F

    from tessella.functions.scalar import to_floats, upsert

    entries = [[("a", 1.0), ("b", 2.0), ("a", 3.0), ("c", None), ("b", 4.0)], [], None]
    df = spark.createDataFrame(list(enumerate(entries)), "id int, e array<struct<key:string,value:double>>").select("id", to_floats(F.col("e")).alias("m"))
    assert [r["m"] for r in df.orderBy("id").collect()] == [{"a": 3.0, "b": 4.0, "c": None}, {}, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
    put = df.select("id", *[upsert(b, F.col("m")).alias(n) for n, b in (("none", F.lit(None).cast("map<string,double>")), ("some", F.create_map(F.lit("a"), F.lit(9.0), F.lit("z"), F.lit(8.0))))])
    assert [(r["none"], r["some"]) for r in put.orderBy("id").collect()] == [({"a": 3.0, "b": 4.0, "c": None}, {"a": 3.0, "b": 4.0, "c": None, "z": 8.0}), ({}, {"a": 9.0, "z": 8.0}), (None, None)]


def test_sparse_rows_join_without_a_shuffle_by_feature(spark):
    from pyspark.sql import functions as F

    from tessella.training.sparse import index_features, sparse_rows

    long = spark.range(60).select("id", F.lit("f").alias("family"), F.concat(F.lit("x"), F.col("id") % 3).alias("feature"), F.col("id").cast("double").alias("value"))
    rows = sparse_rows(long, index_features(long).cache(), spark.range(70).withColumn("label", F.lit(1.0)), ["id"])
    assert rows.where("size(indices) = 1 AND indices[0] = id % 3 AND values[0] = id").count() == 60 and rows.where("size(indices) = 0").count() == 10
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_of_more_rows_than_a_slice(spark):
    from pyspark.sql import functions as F

    from tessella.features import FeatureSet
    from tessella.transforms import build
    from tessella.transforms.strings import SLICE

    n = 2 * SLICE + 3
    df = spark.range(n).coalesce(1).select("id", F.when(F.col("id") % 5 != 0, F.array(F.concat(F.lit("e\u0301"), "id"), F.lit("x"))).alias("s:n"))
    out = build({"transform": "normalize_utf8", "field1": "n", "normalization_form": "NFC", "output": "o"})(FeatureSet(df)).df.collect()
    assert {r["id"]: r["s:o"] for r in out} == {i: [f"\u00e9{i}", "x"] if i % 5 else None for i in range(n)}
