"""Ingestion, metrics, models, trainers, configurations and jobs."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.features import flatten, from_nested, ingest, packed, split_name, to_nested
from tessella.models import functions, scoring, store
from tessella.operators import evaluation, joins, sampling, statistics
from tessella.plans import config, jobs
from tessella.sources import scans, sinks
from tessella.training import additive, linear, neural, perkey, search, softmax, spatial, trees


def test_ingest(spark):
    df = spark.createDataFrame([(1, 5.0, "raw", "monkey", False, 10.0, None, 12345)], "id int, LABEL double, f_RAW string, K_star string, K_good boolean, S_speed double, X_jump double, _meta_who long")
    fs = ingest(df, ["id"])
    r = fs.df.first()
    assert r["f:LABEL"] == {"": 5.0} and r["s:f"] == ["raw"] and sorted(r["s:K"]) == ["good:F", "star:monkey"] and r["f:S"] == {"speed": 10.0}
    assert r["s:MISS"] == ["X_jump"] and r["s:BIAS"] == ["B"] and r["f:X"] == {} and r["metadata"] == {"who": "12345"}


def test_names():
    assert split_name("a_b_c") == ("a", "b_c") and split_name("x") == ("", "x") and split_name("Label") == ("LABEL", "")
    with pytest.raises(ValueError):
        split_name("_x")


def test_multiclass_label_and_round_trip(spark):
    fs = ingest(spark.createDataFrame([(1, 3, "a:1,b:2")], "id int, i_x int, LABEL string"), ["id"], multiclass=True)
    assert fs.df.first()["f:LABEL"] == {"a": 1.0, "b": 2.0}
    back = from_nested(to_nested(fs), strings=["BIAS"], floats=["i", "none"])
    assert back.df.first()["f:i"] == {"x": 3.0} and back.df.first()["f:none"] is None
    assert flatten(fs, ["id"], skip=["MISS"]).count() == 4


def records(spark, rows):
    return spark.createDataFrame([(i, float(s), float(y), t) for i, (s, y, t) in enumerate(rows)], "id long, score double, label double, is_training boolean")


def test_perfect_and_opposed_scores(spark):
    good = records(spark, [(i % 2, i % 2, i % 3 > 0) for i in range(60)])
    m = jobs.metrics(good, ["id"], 10)
    for k in ("ACC", "F1", "RECALL", "PRECISION", "AUC", "PR_AUC"):
        assert m[f"!HOLD_{k}"] == pytest.approx(1.0), k
    assert m["!HOLD_RMSE"] == 0 and m["!HOLD_FPR"] == 0
    bad = good.withColumn("score", 1 - F.col("score"))
    assert evaluation.roc_auc(bad).first()["AUC"] == 0.0


def test_constant_scores_and_no_rows(spark):
    same = records(spark, [(0.5, i % 2, True) for i in range(10)])
    assert evaluation.roc_auc(same).first()["AUC"] == pytest.approx(0.5) and evaluation.thresholds(same, 10).count() == 1
    none = same.where("false")
    assert evaluation.confusion(none, 10).count() == 0 and evaluation.roc_auc(none).count() == 0 and evaluation.platt_fit(none) == (0.0, 1.0)


def test_platt_finds_the_logistic_curve(spark):
    r = np.random.default_rng(1)
    s = r.normal(size=4000)
    y = r.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * s)))
    a, b = evaluation.platt_fit(records(spark, [(x, 1.0 if t else -1.0, True) for x, t in zip(s, y, strict=True)]))
    assert abs(a - 0.5) < 0.15 and abs(b - 2) < 0.25


def test_functions():
    w = np.array([0.0, 1.0, 4.0])
    assert functions.resample(w, 5).tolist() == [0, 0.5, 1, 2.5, 4]
    curve = np.sin(np.linspace(0, 2, 16))
    fitted, error = functions.smooth(curve, 0.1)
    assert error < 0.1 and np.abs(fitted - curve).max() < 0.1
    assert additive.monotonicity(np.arange(5.0)) == 1 and additive.smoothness(np.arange(5.0)) == pytest.approx(1)
    assert functions.corner_weights(np.zeros(1), np.array([[0.0], [1.0]]), np.array([5.0, 7.0])) == 7.0


def toy(spark, n=300, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), 1.0 if x + y / 10 < 0.1 else -1.0) for i, (x, y) in enumerate(zip(r.uniform(-1, 1, n), r.uniform(-10, 10, n), strict=True))]
    return spark.createDataFrame(rows, "id long, loc_x double, loc_y double, label double").cache()


def accuracy(df):
    return df.agg(F.avg(((F.col("score") > 0) == (F.col("label") > 0)).cast("double"))).first()[0]


def test_additive_and_linear_trainers(spark):
    df = toy(spark)
    fs = ingest(df, ["id"])
    x, y = flatten(fs, ["id"], skip=["LABEL", "MISS"]), df.select("id", "label")
    model = additive.train_additive(x, y, ["id"], num_bins=8, iterations=6, learning_rate=0.5)
    s = scoring.complete(scoring.score_sum(x, model, ["id"], "additive"), df, ["id"]).join(y, "id")
    assert accuracy(s) > 0.85
    w = linear.train_linear(x, y, ["id"], iterations=5, use_values=True)
    s = x.join(w, ["family", "feature"]).groupBy("id").agg(F.sum(F.col("value") * F.col("weight")).alias("score")).join(y, "id")
    assert accuracy(s) > 0.75


def test_tree_trainers(spark):
    df = toy(spark).select("id", "label", F.array("loc_x", "loc_y").alias("x")).cache()
    names = [("loc", "x"), ("loc", "y")]
    for criterion in ("gini", "information_gain", "hellinger", "variance"):
        nodes = trees.train_tree(df, names, criterion=criterion, max_depth=4, min_leaf_items=5)
        assert accuracy(df.withColumn("score", trees.leaf_expression(nodes))) > 0.85, criterion
    forest = trees.train_boosted_forest(df, names, num_trees=3, max_depth=3, min_leaf_items=5)
    score = sum((trees.leaf_expression(t) for t in forest[1:]), trees.leaf_expression(forest[0]))
    assert accuracy(df.withColumn("score", score)) > 0.85
    assert store.tree_rows(trees.train_tree(df, names, max_depth=1))[0].startswith("P,0,loc,") and "digraph" in store.forest_dot(forest)
    stumps = trees.train_boosted_stumps(df, names, candidates=8, iterations=20)
    assert stumps.where("feature = 'x'").count() > 0


def test_neural_trainers(spark):
    df = toy(spark).select("id", "label", F.array(F.col("loc_x"), F.col("loc_y") / 10, F.lit(1.0)).alias("x")).cache()
    layers = neural.train_mlp(df, [6, 1], ["tanh", "identity"], iterations=25, rate=0.5)
    assert accuracy(df.withColumn("score", scoring.score_mlp(F.col("x"), layers))) > 0.8
    sv = neural.train_kernel(df, candidates=200, max_vectors=40, scale=1.0)
    assert accuracy(df.withColumn("score", scoring.score_kernel(F.col("x"), sv))) > 0.75
    w = neural.train_maxout(df, hidden=6, iterations=25, rate=0.5)
    pdf = df.toPandas()
    z = np.stack(pdf.x) @ w
    assert ((z[:, 3:].max(axis=1) - z[:, :3].max(axis=1) > 0) == (pdf.label > 0)).mean() > 0.8


def test_multiclass_trainers(spark):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[int(x > 0)] + "cd"[int(y > 0)], float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-1, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "id long, label string, loc_x double, loc_y double")
    x = flatten(ingest(df.drop("label"), ["id"]), ["id"], skip=["MISS"]).cache()
    w = softmax.train_full_rank(x, df.select("id", "label"), ["id"], iterations=8)
    best = scoring.score_full_rank(x, w, ["id"]).groupBy("id").agg(F.max_by("label", "score").alias("got")).join(df, "id")
    assert best.agg(F.avg((F.col("got") == F.col("label")).cast("double"))).first()[0] > 0.85
    e, u = softmax.train_low_rank(x, df.select("id", "label"), ["id"], iterations=15, dimension=4, rate=0.5)
    best = scoring.score_low_rank(x, e, u, ["id"]).groupBy("id").agg(F.max_by("label", "score").alias("got")).join(df, "id")
    assert best.agg(F.avg((F.col("got") == F.col("label")).cast("double"))).first()[0] > 0.5


def test_spatial_trees():
    p = np.random.default_rng(2).uniform(0, 1, (500, 2))
    kd, nd = spatial.build_kd(p, 4), spatial.build_nd(p, 4)
    assert kd[0]["count"] == 500 and sum(n["count"] for n in kd if n["type"] == "leaf") == 500
    leaf = spatial.nd_path(nd, p[0])[-1]
    assert nd[leaf]["axis"] == -1 and leaf in spatial.nd_box(nd, p[0], p[0]) and 0 in spatial.nd_box(nd, p[0], p[0])
    assert spatial.build_kd(np.zeros((0, 2))) == [] and spatial.nd_box([], p[0], p[0]) == []


def test_search():
    assert len(search.grid({"a": (0, 1), "b": (0, 1)}, 9)) == 9 and len(search.guided({"a": [1, 2, 3], "b": [1, 2]}, 4)) == 4
    best, loss = search.monte_carlo({"x": (0.0, 4.0), "y": (7.0,)}, lambda p: (p["x"] - 1) ** 2, 200)
    assert abs(best["x"] - 1) < 0.2 and best["y"] == 7.0 and loss < 0.05
    assert search.narrowed({"x": (0.0, 4.0)}, {"x": 1.0}, 0.5)["x"] == (0.0, 2.0)


def test_per_key(spark):
    r = np.random.default_rng(1)
    rows = [(str(i % 2), bool(i % 3), float(r.uniform()), 100.0, float(r.uniform(80, 110)), 100.0 if i % 3 else None) for i in range(300)] + [("few", True, 0.5, 100.0, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "id string, label boolean, x double, base_pivot double, observed_value double, true_value double")
    m = perkey.train_strategy(df, least=100, epochs=5)
    assert sorted(x["id"] for x in m.collect()) == ["0", "1"] and perkey.score_strategy(df, m).where("prediction IS NULL").count() == 0
    b = perkey.train_boosted(df, ["x", "observed_value"], "label", "id", rounds=3)
    assert b.count() == 3 and perkey.importance(b, ["x", "observed_value"]).count() > 0


def test_joins(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b")], "id int, token string")
    got = {(r["id"], r["other"]): r["shared"] for r in joins.nearest_by_overlap(t, 1).collect()}
    assert got == {(1, 2): 2, (2, 1): 2, (3, 1): 1}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.0]), (3, [0.0, 1.0])], "id int, vec array<double>")
    assert joins.nearest_by_min_kernel(v, v.where("id = 1"), 1, 2).first()["other"] == 2


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k")).repartition(7)
    rows = statistics.numbered(df, ["k"], "n").collect()
    assert all(int(r["k"][1:]) == r["n"] for r in rows)


def test_split_share(spark):
    n = spark.range(20000).where(sampling.is_training(F.col("id"))).count()
    assert abs(n / 20000 - 240 / 256) < 0.01


def test_config():
    c = config.parse('''
      # a comment
      base { transform : list, transforms : [a, b] }   // another
      a { transform = quantize
          field1 = loc, scale : 1.5, output: "x:y" }
      model.options.num = 3
      model { trainer : additive, from : ${base.transforms} , on : true, none : null }
      query = """select a;
      from b"""
    ''')
    assert c["a"] == {"transform": "quantize", "field1": "loc", "scale": 1.5, "output": "x:y"} and c["model"]["options"] == {"num": 3}
    assert c["model"]["from"] == ["a", "b"] and c["model"]["on"] is True and c["query"].startswith("select a;\n") and config.parse('{"a": {"b": [1, 2]}}') == {"a": {"b": [1, 2]}}
    assert config.expand({"d": {"macro": "date_minus_days", "args": ["2020-03-01", 1]}}) == {"d": "2020-02-29"}


def test_statements():
    assert scans.statements("a; -- x; y\n b ';' ;") == ["a", "b ';'"]


def test_metrics_json():
    assert json.loads(sinks.metrics_json({"!A": 1.0, "B": math.nan}, {"TRAIN": [(0.5, 1.0, 0.25)]})) == {"A": 1.0, "TRAIN_THRESHOLDS": [0.5], "TRAIN_PRECISIONS": [1.0], "TRAIN_RECALLS": [0.25]}


def test_jobs_from_examples_to_scores(spark, tmp_path):
    toy(spark).createOrReplaceTempView("toy")
    c = config.parse(f'''
      jobs : [GenericMakeExamples, GenericTrainModel, GenericEvalModel, GenericCalibrateModel, GenericDumpModel, GenericScoreTable]
      make_examples {{ query : "select id, loc_x, loc_y, label from toy", output : "{tmp_path}/examples", ids : [id] }}
      q {{ transform : custom_range_quantize, field1 : loc, thresholds : [-5, 0, 5], output : r }}
      transforms {{ item_transform : q }}
      gam {{ trainer : additive, transforms : transforms, model_output : "{tmp_path}/model", options {{ iterations : 3, num_bins : 8 }} }}
      train_model {{ input : "{tmp_path}/examples", model_config : gam, training_fraction : 0.8 }}
      eval_model {{ input : "{tmp_path}/examples", model_config : gam, output : "{tmp_path}/metrics", training_fraction : 0.8 }}
      calibrate_model {{ input : "{tmp_path}/examples", model_config : gam, calibrated_model_output : "{tmp_path}/calibrated" }}
      dump_model {{ model_output : "{tmp_path}/model", model_dump : "{tmp_path}/dump" }}
      score_table {{ query : "select loc_x, loc_y, id as UNIQUE_ID from toy", model_config : gam, output : "{tmp_path}/scores" }}
    ''')
    got = jobs.run(spark, c, [*c["jobs"], "NoSuchJob"])
    assert got["GenericEvalModel"]["!HOLD_AUC"] > 0.8 and "NoSuchJob" not in got
    assert spark.read.csv(f"{tmp_path}/scores", sep="\t").count() == 300 and scans.succeeded(spark, f"{tmp_path}/model/records")
    assert scans.latest_directory(spark, str(tmp_path)).endswith("scores") and jobs.debug_scores(spark, {**c, "debug_scores": {"input": f"{tmp_path}/examples", "model_config": "gam", "count": 2}}).count() > 300


def test_stream_scores_match_batch(spark, tmp_path):
    from tessella.features import FeatureSet
    from tessella.streaming import scoring as streaming

    path = str(tmp_path / "in")
    rows = spark.range(20).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("s:k"))
    rows.write.parquet(path)
    w = spark.createDataFrame([("k", "even", 2.0), ("k", "odd", -1.0)], "family string, feature string, weight double")
    stream = FeatureSet(streaming.read(spark, path, "id long, ts timestamp, `s:k` array<string>"))
    q = streaming.scored(stream, w, ["id"], "linear", "ts").writeStream.outputMode("update").format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["score"] for r in spark.table("scored").collect()} == {i: 2.0 if i % 2 == 0 else -1.0 for i in range(20)}


def test_overlap_counts_long_lists_exactly(spark):
    r = np.random.default_rng(4)
    rows = sorted({(int(i), f"t{k}") for i in range(60) for k in r.integers(0, 6, 3)} | {(i, "all") for i in range(60)})
    t = spark.createDataFrame(rows, "id int, token string")
    held = {i: {k for j, k in rows if j == i} for i in range(60)}
    best = {i: sorted((-len(held[i] & held[j]), j) for j in held if j != i)[:3] for i in held}
    for longest in (1000, 60, 7, 1):
        got = {(x["id"], x["rank"]): (-x["shared"], x["other"]) for x in joins.nearest_by_overlap(t, 3, longest).collect()}
        assert got == {(i, n): b for i in best for n, b in enumerate(best[i], 1)}


def test_overlap_of_asked_ids_is_that_of_all(spark):
    r = np.random.default_rng(5)
    t = spark.createDataFrame([(int(i), f"t{x}") for i in range(60) for x in r.integers(0, 9, 4)], "id long, token string")
    every = joins.nearest_by_overlap(t, 3, 7).where("id % 5 = 0")
    asked = joins.nearest_by_overlap(t, 3, 7, F.col("id") % 5 == 0)
    assert asked.count() == 36 and asked.exceptAll(every).count() == 0


def test_lookup_beyond_its_broadcast_is_the_same_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("B")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("feature"))
    keyed = spark.range(600).select(F.concat(F.lit("k"), "id").alias("feature"), F.col("id").alias("w")).unionByName(spark.createDataFrame([("B", -1)], "feature string, w long"))
    want = rows.join(keyed, "feature")
    for most in (10_000, 100):
        got = joins.lookup(rows, keyed, ["feature"], most).select(*want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    plan = joins.lookup(rows, keyed, ["feature"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_running_sums_over_ranges(spark):
    r = np.random.default_rng(3)
    rows = sorted({(k, float(x)) for k, x in zip("aab" * 400, r.normal(size=1200).round(3), strict=True)})
    df = spark.createDataFrame([(k, x, i % 7, i % 3) for i, (k, x) in enumerate(rows)], "k string, x double, p long, n long")
    got = {(g["k"], g["x"]): (g["below_p"], g["below_n"]) for g in statistics.running_sums(df, ["k"], "x", ["p", "n"]).collect()}
    sums = {}
    for i, (k, x) in enumerate(rows):
        p, n = sums.get(k, (0, 0))
        assert got[k, x] == (p, n)
        sums[k] = (p + i % 7, n + i % 3)
    plan = statistics.running_sums(df, ["k"], "x", ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_shards_follow_the_rows(spark):
    from tessella.training.sparse import in_shards

    df = spark.range(1000).withColumn("label", F.lit(1.0))
    assert in_shards(df, 2, ["id"]).select("_bag").distinct().count() == 2
    placed = in_shards(df, 2, ["id"], 100)
    assert placed.select("_bag").distinct().count() == 10 and placed.rdd.getNumPartitions() == 10


def test_per_key_above_the_bound(spark):
    r = np.random.default_rng(1)
    rows = [(str(min(i % 4, 1)), bool(i % 3), float(r.uniform()), 100.0, float(r.uniform(80, 110)), 100.0 if i % 3 else None) for i in range(2400)]
    df = spark.createDataFrame(rows, "id string, label boolean, x double, base_pivot double, observed_value double, true_value double")
    whole = {x["id"]: x for x in perkey.train_strategy(df, least=100, epochs=5).collect()}
    split = perkey.train_strategy(df, least=100, max_samples=1000, epochs=5)
    got = {x["id"]: x for x in split.collect()}
    assert set(got) == {"0", "1"} and got["0"] == whole["0"] and (got["1"]["n"], got["1"]["n_true"]) == (whole["1"]["n"], whole["1"]["n_true"])
    assert abs(got["1"]["loss"] - whole["1"]["loss"]) < 0.01 and 1 <= got["1"]["epochs"] <= 5
    scored = perkey.score_strategy(df.where("id = '1'"), split).toPandas()
    regret = np.maximum(0, scored["observed_value"] - scored["prediction"])[scored["label"]]
    assert got["1"]["regret"] == pytest.approx(float(np.median(regret)))


def test_box_query_of_all_suppliers(tmp_path, spark):
    from tessella.queries import analysis

    spark.range(1, 101).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(i, 1, float(i % 50 + 1), i % 9 / 100) for i in range(450)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(o, n, k) for o, n, q, t in rows for k in range(1, 101) if k % 40 <= q <= k % 40 + 3 and k % 7 <= t * 100 <= k % 7 + 0.5}
    rows = analysis.box_query(spark, str(tmp_path)).collect()
    point = {(r["l_orderkey"], r["l_linenumber"]): r for r in rows if r["kind"] == "line"}
    box = {r["s_suppkey"]: r for r in rows if r["kind"] == "supplier"}
    pairs = {(r["c_l_orderkey"], r["c_l_linenumber"], r["c_s_suppkey"]): r["links"] for r in rows if r["kind"] == "pair"}
    assert (len(point), len(box)) == (450, 100) and len(point) + len(box) + len(pairs) == len(rows)
    got = [(*p, k) for p, r in point.items() for k, b in box.items() if (r["c_l_orderkey"], r["c_l_linenumber"], b["c_s_suppkey"]) in pairs]
    assert len(got) == len(want) and set(got) == want and max(k for *_, k in got) > 20
    assert sum(pairs.values()) == len(want)
    assert all(r["links"] == sum(p == w[:2] for w in want) for p, r in list(point.items())[::20]) and all(b["links"] == sum(k == w[2] for w in want) for k, b in box.items())


def test_box_links_grow_with_the_rows(spark):
    """Equal points and boxes make no row a pair: 4,000 points in each of 300 boxes are a million pairs."""
    points = spark.range(4000).select(F.col("id").alias("o"), (F.col("id") % 3).alias("n"), F.when(F.col("id") != 7, 1.5).alias("px"), F.lit(2.0).alias("py"))
    boxes = spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("x0"), F.lit(2).alias("x1"), F.lit(1).alias("y0"), F.lit(3).alias("y1"))
    p, b, pairs = joins.box_links(points, ["o", "n"], boxes, ["k"], 4.0)
    assert [tuple(r) for r in pairs.collect()] == [(0, 0, 0, 3999 * 300)]
    assert p.where("links = 300 AND c_o = 0 AND c_n = 0").count() == 3999 and [tuple(r) for r in p.where("links = 0").collect()] == [(7, 1, 7, 1, 0)]
    assert b.where("links = 3999 AND c_k = 0").count() == 300


def test_overlap_makes_no_row_a_pair(spark):
    """A token that all of 20,000 ids hold: its pairs with 40 queries would be 800,000 rows of a shuffle."""
    t = spark.range(20_000).select("id", F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 5000))).alias("token"))
    near = joins.nearest_by_overlap(t, 2, 5000, F.col("id") % 500 == 0, 16)
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
    want = {(i, n): (2, o) for i in range(0, 20_000, 500) for n, o in enumerate([o for o in range(i % 5000, 20_000, 5000) if o != i][:2], 1)}
    assert {(r["id"], r["rank"]): (r["shared"], r["other"]) for r in near.collect()} == want


def test_overlap_of_many_tokens_and_null_ones(spark):
    rows = [(f"i{i:03}", f"t{t}") for i in range(40) for t in range(i * 10)] + [("i001", None), (None, "t0")]
    got = {(r["id"], r["rank"]): (r["shared"], r["other"]) for r in joins.nearest_by_overlap(spark.createDataFrame(rows, "id string, token string"), 2, 9, None, 7).collect()}
    held = {f"i{i:03}": i * 10 for i in range(1, 40)}
    best = {i: sorted((-min(n, m), j) for j, m in held.items() if j != i)[:2] for i, n in held.items()}
    assert got == {(i, r): (-s, j) for i, b in best.items() for r, (s, j) in enumerate(b, 1)}


def test_min_kernel_in_tiles_is_brute_force(spark):
    """Ties, repeated ids, other lengths, nulls and NaN among plain vectors."""
    r = np.random.default_rng(8)
    plain = [(i % 290, [float(x) for x in r.integers(0, 4, 6) / 4]) for i in range(300)]
    odd = [(1000, [0.5, 0.25]), (1001, [float("nan")] * 6), (1002, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (1003, [None] * 6), (1004, None), (1005, [1.0] * 9), (None, [1.0] * 6)]

    def score(a, b):
        if a is None or b is None:
            return None
        total = 0.0
        for i in range(max(len(a), len(b))):
            both = [v[i] for v in (a, b) if i < len(v) and v[i] is not None]
            if not both:
                return None
            total += min(both, key=lambda x: (x != x, x))
        return total

    def order(s, j):
        return (s is None, s == s if s is not None else True, -s if s is not None and s == s else 0.0, j)

    for rows in (plain, plain + odd):
        v = spark.createDataFrame(rows, "id long, vec array<double>")
        near = joins.nearest_by_min_kernel(v, v.where("id % 7 = 0 OR id > 1000"), 4, 50, 16)
        got = {(x["id"], x["rank"]): (x["similarity"], x["other"]) for x in near.collect()}
        want = {}
        for i in {i for i, _ in rows if i is not None and (i % 7 == 0 or i > 1000)}:
            pairs = sorted((order(s := score(a, b), j), s, j) for k, a in rows if k == i for j, b in rows if j is not None and j != i)
            want |= {(i, n): (s, j) for n, (_, s, j) in enumerate(pairs[:4], 1)}
        assert set(got) == set(want) and all(repr(got[k]) == repr(want[k]) for k in want)
    plan = joins.nearest_by_min_kernel(spark.createDataFrame(plain, "id long, vec array<double>"), spark.createDataFrame(plain[:5], "id long, vec array<double>"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_boosted_keys_of_any_size(spark):
    """Trees from weighted, different rows and over all partitions are those of all rows in one task."""
    import json

    r = np.random.default_rng(6)
    rows = [("abn"[i % 3], float(a), float(b), float(r.random() < 0.2 + 0.1 * a * (b > 2))) for i, (a, b) in enumerate(r.integers(0, 6, (1500, 2)))]
    rows = [(k if k != "n" else None, *rest) for k, *rest in rows]
    df = spark.createDataFrame(rows, "k string, x double, z double, y double")
    options = {"rounds": 3, "max_depth": 3}
    for most in (1_000_000, 10):
        got = {m["id"]: m for m in perkey.train_boosted(df, ["x", "z"], "y", "k", max_samples=most, **options).collect()}
        assert set(got) == {"a", "b", None}
        for k, m in got.items():
            own = np.array([v for i, *v in sorted(rows, key=repr) if i == k])
            x, y = own[:, :2], own[:, 2]
            trees = perkey.boost_key(x, y, **options)
            s = perkey.boost_score(trees, x)
            pairs = [(p > q) + (p == q) / 2 for p in s[y > 0] for q in s[y == 0]]
            nodes = lambda t: np.array([n for tree in t for n in tree])
            assert nodes(json.loads(m["trees"])) == pytest.approx(nodes(trees), abs=1e-9) and m["n"] == len(y) == 500
            assert m["auc"] == pytest.approx(float(np.mean(pairs))) and m["loss"] == pytest.approx(float(np.logaddexp(0, np.where(y > 0, -s, s)).mean()))


def test_boosted_key_meets_by_different_rows(spark, monkeypatch):
    """40,000 rows of 12 kinds: the training task gets 12."""
    import json

    df = spark.range(40_000).select(F.lit("k").alias("k"), (F.col("id") % 6).cast("double").alias("x"), (F.col("id") % 4 == 0).cast("double").alias("y"))
    monkeypatch.setattr(perkey, "boost_large", lambda *a, **b: pytest.fail("12 different rows are few"))
    one = perkey.train_boosted(df, ["x"], "y", "k", max_samples=20, rounds=1).first()
    assert one["n"] == 40_000 and json.loads(one["trees"])


def test_intervals_are_those_of_single_rows():
    pdf = pd.DataFrame([(a, p, o, t) for a in (True, False) for p in (0.0, 100.0, 90.5) for o in (0.0, 95.0, 120.0) for t in (None, 0.0, 80.0, 130.0)], columns=["label", "base_pivot", "observed_value", "true_value"])
    want = [perkey.bounds(r.label, r.base_pivot, r.observed_value, None if pd.isna(r.true_value) else r.true_value) for r in pdf.itertuples()]
    assert list(zip(*perkey._intervals(pdf), strict=True)) == want


def test_feature_map_joins_without_a_shuffle_by_feature(spark):
    from tessella.training import spatial

    long = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 2).alias("family"), F.concat(F.lit("x"), F.col("id") % 2).alias("feature"), F.col("id").cast("double").alias("value"))
    plan = spatial.feature_map(long, min_count=10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert spatial.feature_map(long, min_count=10).first()["count"] == 500


@pytest.mark.parametrize("loss", ["softmax", "hinge", "squared_hinge"])
def test_full_rank_gradient_meets_once_an_example(spark, loss):
    """Repeated and null ids, null values, names and labels, and labels that don't compete."""
    draw = np.random.default_rng(1)
    pick = lambda *x: x[draw.integers(len(x))]
    long = spark.createDataFrame([(pick(None, *range(30)), pick("a", "b"), pick("x", "y", "z", None), pick(None, 1.0, -2.5, 0.25)) for _ in range(600)], "id int, family string, feature string, value double")
    labels = spark.createDataFrame([(pick(None, *range(33)), pick("p", "q", "o", None)) for _ in range(90)], "id int, label string")
    weights = spark.createDataFrame([("a", "x", "p", 1.0), ("a", "x", "p", 0.5), ("b", "y", "q", -0.3), ("a", "zz", "r", 2.0)], "family string, feature string, label string, weight double")
    rows = lambda df: {(r["family"], r["feature"], r["label"]): r["g"] for r in df.collect()}
    got = softmax.gradient_full_rank(long, weights, labels, ["id"], loss)
    want = rows(softmax.gradient_by_joins(long.where("feature IS NOT NULL"), weights, labels, ["id"], loss))
    assert rows(got) == pytest.approx(want) and len(want) == 18
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "Generate" not in plan


def test_models_diff_meets_before_the_shuffle(spark):
    long = spark.createDataFrame([(i % 5, "a", "xyz"[i % 3], float(i)) for i in range(20)] + [(None, "a", "x", 1.0)], "id int, family string, feature string, value double")
    a = spark.createDataFrame([("a", "x", 1.5), ("a", "y", None)], "family string, feature string, weight double")
    b = spark.createDataFrame([("a", "x", 1.0), ("a", "z", 2.0), ("b", "x", 9.0)], "family string, feature string, weight double")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = scoring.models_diff(long, a, b, ["id"], "linear")
    assert rows(got) == rows(scoring.explanation_diff(scoring.contributions(long, a, "linear"), scoring.contributions(long, b, "linear"), ["id"]))
    assert (None, "a", "x", 1.5, 1.0, 0.5) in rows(got)  # a null id is one row, as in a GROUP BY
    assert "FullOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_those_of_long_rows(spark, monkeypatch):
    """Repeated and null ids, null values and unknown features; packed, long and joined alike."""
    df = spark.createDataFrame([(1, 2.0, "p"), (1, 3.0, None), (None, 5.0, "q"), (2, None, "zz"), (3, None, None)], "id int, f_x double, s_RAW string")
    fs = ingest(df, ["id"], bias=False)
    rows = packed(fs, ["id"], skip=["MISS"])
    names = spark.createDataFrame([("f", "x", 0, 1.0, 2.0), ("s", "p", 1, 0.0, 1.0), ("s", "q", 2, 0.0, 1.0)], "family string, feature string, index long, mean double, scale double")
    found = lambda v: sorted(((r["id"], r["indices"], r["values"]) for r in v.collect()), key=repr)
    got = statistics.vectorise(rows, names, ["id"])
    want = [(1, [0, 0, 1], [2.0, 4.0, 1.0]), (None, [0, 2], [8.0, 1.0])]
    assert found(got) == want and found(statistics.vectorise(flatten(fs, ["id"], skip=["MISS"]), names, ["id"])) == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(statistics, "BROADCAST_ROWS", 1)
    assert found(statistics.vectorise(rows, names, ["id"])) == want


def test_quantiles_are_exact_for_any_number_of_values(spark):
    values = [float(i * 7 % 1000) for i in range(1000)] + [3.0] * 130
    rows = [("f", "x", v) for v in values] + [("f", "y", 1.0)] * 30 + [("f", "rare", 1.0)]
    got = {r["feature"]: r["quantiles"] for r in statistics.exact_quantiles(spark.createDataFrame(rows, "family string, feature string, value double"), [0.1, 0.5, 0.9], 10).collect()}
    at = lambda p: sorted(values)[math.ceil(len(values) * p / 10) - 1]
    assert got == {"x": [at(1), at(5), at(9)], "y": [1.0, 1.0, 1.0]}
