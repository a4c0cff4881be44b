"""Queries for scoring, explanation and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.features import FeatureSet, flatten, packed
from tessella.models import scoring
from tessella.operators import joins
from tessella.queries.analysis import LONG, features, long, rounded
from tessella.queries.base import LINE, lines, query, table
from tessella.queries.transforms import TREE
from tessella.training import additive, linear, neural, perkey, softmax, spatial, trees
from tessella.transforms.trees import read_tree

WEIGHTS = [("flag", "A", 0.5), ("flag", "R", -1.25), ("status", "F", 0.25), ("BIAS", "B", 0.1)]
W_SQL = "w(family, feature, weight) AS (VALUES ('flag', 'A', 0.5::DOUBLE), ('flag', 'R', -1.25::DOUBLE), ('status', 'F', 0.25::DOUBLE), ('BIAS', 'B', 0.1::DOUBLE))"
SCHEMA = "family string, feature string, weight double"


def weights(spark):
    return spark.createDataFrame(WEIGHTS, SCHEMA)


def string_features(spark, sf_dir):
    return FeatureSet(lines(spark, sf_dir).df.select(*LINE, "s:flag", "s:status", "s:BIAS"))


def strings_only(spark, sf_dir):
    return flatten(string_features(spark, sf_dir), LINE)


@query("score_linear", f"WITH {LONG}, {W_SQL} SELECT l_orderkey, l_linenumber, round(sum(weight), 9) AS score FROM long JOIN w USING (family, feature) GROUP BY 1, 2")
def score_linear(spark, sf_dir):
    return rounded(scoring.score_sum(strings_only(spark, sf_dir), weights(spark), LINE, "linear"), "score", digits=9)


@query("score_probability", f"WITH {LONG}, {W_SQL} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.5 + 2 * sum(weight)))), 9) AS probability FROM long JOIN w USING (family, feature) GROUP BY 1, 2")
def score_probability(spark, sf_dir):
    s = scoring.score_sum(strings_only(spark, sf_dir), weights(spark), LINE, "linear")
    return rounded(scoring.with_probability(s, 0.5, 2.0).select(*LINE, "probability"), "probability", digits=9)


@query("explain_linear", f"WITH {LONG}, {W_SQL} SELECT l_orderkey, l_linenumber, family, feature, weight AS part, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY abs(weight) DESC, family, feature) AS rank FROM long JOIN w USING (family, feature)) WHERE rank <= 2")
def explain_linear(spark, sf_dir):
    return scoring.explain(strings_only(spark, sf_dir), weights(spark), LINE, "linear", 2).select(*LINE, "family", "feature", "part", "rank")


@query("explain_families", f"WITH {LONG}, {W_SQL} SELECT l_orderkey, l_linenumber, family, sum(weight) AS part FROM long JOIN w USING (family, feature) GROUP BY 1, 2, 3")
def explain_families(spark, sf_dir):
    return scoring.explain_families(strings_only(spark, sf_dir), weights(spark), LINE, "linear")


@query("explanation_diff", f"WITH {LONG}, {W_SQL} SELECT l_orderkey, l_linenumber, family, feature, sum(weight) AS part_a, sum(CASE WHEN family = 'flag' THEN 2 * weight ELSE 0.0 END) AS part_b, sum(CASE WHEN family = 'flag' THEN -weight ELSE weight END) AS diff FROM long JOIN w USING (family, feature) GROUP BY ALL")
def explanation_diff(spark, sf_dir):
    x, w = strings_only(spark, sf_dir), weights(spark)
    b = w.where("family = 'flag'").withColumn("weight", F.col("weight") * 2)
    return scoring.models_diff(x, w, b, LINE, "linear")


ADDITIVE = [("loc", "qty", "Spline", [0.0, 1.0, -1.0, 2.0, 0.5], 1.0, 50.0), ("loc", "tax", "Linear", [0.25, 3.0], 0.0, 0.08), ("BIAS", "B", "Point", [0.1], 1.0, 1.0)]
SPLINE = "(SELECT l_orderkey, l_linenumber, least(greatest((l_quantity - 1) / 49.0, 0.0), 1.0) * 4 AS t, [0.0, 1.0, -1.0, 2.0, 0.5] AS k, l_tax FROM lineitem)"


@query("score_additive", f"SELECT l_orderkey, l_linenumber, round(sum(k[least(CAST(floor(t) AS BIGINT), 4) + 1] + (t - least(floor(t), 4)) * (coalesce(k[least(CAST(floor(t) AS BIGINT), 4) + 2], k[least(CAST(floor(t) AS BIGINT), 4) + 1]) - k[least(CAST(floor(t) AS BIGINT), 4) + 1]) + 0.25 + 3.0 * (l_tax / 0.08) + 0.1), 8) AS score FROM {SPLINE} GROUP BY ALL")
def score_additive(spark, sf_dir):
    model = spark.createDataFrame(ADDITIVE, additive.SCHEMA)
    return rounded(scoring.score_sum(long(spark, sf_dir), model, LINE, "additive"), "score", digits=8)


@query("score_boosted_stumps", "SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_quantity >= 25 THEN 0.5 ELSE 0.0 END + CASE WHEN l_quantity >= 40 THEN 0.25 ELSE 0.0 END + CASE WHEN l_tax >= 0.04 THEN -1.0 ELSE 0.0 END) AS DOUBLE) AS score FROM lineitem GROUP BY ALL")
def score_boosted_stumps(spark, sf_dir):
    stumps = spark.createDataFrame([("loc", "qty", 25.0, 0.5), ("loc", "qty", 40.0, 0.25), ("loc", "tax", 0.04, -1.0)], "family string, feature string, threshold double, weight double")
    return scoring.score_sum(long(spark, sf_dir), stumps, LINE, "boosted_stumps")


@query("score_decision_tree", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN -0.5 WHEN l_discount < 0.05 THEN 0.25 ELSE 0.75 END::DOUBLE AS score FROM lineitem")
def score_decision_tree(spark, sf_dir):
    fs = lines(spark, sf_dir)
    return fs.df.select(*LINE, scoring.score_tree(fs, read_tree(TREE)).alias("score"))


@query("score_forest", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity < 25 THEN -0.5 WHEN l_discount < 0.05 THEN 0.25 ELSE 0.75 END + CASE WHEN l_tax < 0.03 THEN 1.0 ELSE -1.0 END)::DOUBLE AS score FROM lineitem")
def score_forest(spark, sf_dir):
    fs = lines(spark, sf_dir)
    other = read_tree(["P,0,loc,tax,0.03,1,2", "L,1,1.0,low", "L,2,-1.0,high"])
    return fs.df.select(*LINE, scoring.score_forest(fs, [read_tree(TREE), other]).alias("score"))


FULL = [("flag", "A", "x", 1.0), ("flag", "R", "y", 2.0), ("status", "F", "x", 0.5), ("loc", "disc", "y", 4.0), ("BIAS", "B", "z", 0.75)]
FULL_SQL = "fw(family, feature, label, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in FULL) + ")"


def full(spark):
    return spark.createDataFrame(FULL, "family string, feature string, label string, weight double")


@query("score_full_rank", f"WITH {LONG}, {FULL_SQL} SELECT l_orderkey, l_linenumber, label, round(sum(value * weight), 9) AS score FROM long JOIN fw USING (family, feature) GROUP BY 1, 2, 3")
def score_full_rank(spark, sf_dir):
    return rounded(scoring.score_full_rank(long(spark, sf_dir), full(spark), LINE), "score", digits=9)


@query("score_softmax", f"WITH {LONG}, {FULL_SQL}, s AS (SELECT l_orderkey, l_linenumber, label, sum(value * weight) AS score FROM long JOIN fw USING (family, feature) GROUP BY 1, 2, 3) SELECT l_orderkey, l_linenumber, label, round(exp(score) / sum(exp(score)) OVER (PARTITION BY l_orderkey, l_linenumber), 8) AS probability FROM s")
def score_softmax(spark, sf_dir):
    return rounded(scoring.with_softmax(scoring.score_full_rank(long(spark, sf_dir), full(spark), LINE), LINE).select(*LINE, "label", "probability"), "probability", digits=8)


@query("score_low_rank", f"WITH {LONG}, e(family, feature, dim, weight) AS (VALUES ('flag', 'R', 0, 1.0::DOUBLE), ('flag', 'A', 1, 2.0::DOUBLE), ('loc', 'disc', 0, 3.0::DOUBLE), ('BIAS', 'B', 1, 0.5::DOUBLE)), l(label, dim, lw) AS (VALUES ('p', 0, 1.0::DOUBLE), ('p', 1, -1.0::DOUBLE), ('n', 0, 0.25::DOUBLE)) SELECT l_orderkey, l_linenumber, label, round(sum(value * weight * lw), 9) AS score FROM long JOIN e USING (family, feature) JOIN l USING (dim) GROUP BY 1, 2, 3")
def score_low_rank(spark, sf_dir):
    e = spark.createDataFrame([("flag", "R", 0, 1.0), ("flag", "A", 1, 2.0), ("loc", "disc", 0, 3.0), ("BIAS", "B", 1, 0.5)], "family string, feature string, dim int, weight double")
    labels = spark.createDataFrame([("p", 0, 1.0), ("p", 1, -1.0), ("n", 0, 0.25)], "label string, dim int, weight double")
    return rounded(scoring.score_low_rank(long(spark, sf_dir), e, labels, LINE), "score", digits=9)


@query("score_maxout", f"WITH {LONG}, hw(family, feature, unit, weight) AS (VALUES ('loc', 'disc', 0, 1.0::DOUBLE), ('loc', 'tax', 1, 2.0::DOUBLE), ('BIAS', 'B', 2, 0.05::DOUBLE), ('loc', 'tax', 3, 1.0::DOUBLE)), h AS (SELECT l_orderkey, l_linenumber, unit, sum(value * weight) AS x FROM long JOIN hw USING (family, feature) GROUP BY 1, 2, 3) SELECT l_orderkey, l_linenumber, round(max(x) FILTER (unit >= 2) - max(x) FILTER (unit < 2), 9) AS score FROM h GROUP BY 1, 2")
def score_maxout(spark, sf_dir):
    h = spark.createDataFrame([("loc", "disc", 0, 1.0), ("loc", "tax", 1, 2.0), ("BIAS", "B", 2, 0.05), ("loc", "tax", 3, 1.0)], "family string, feature string, unit int, weight double")
    return rounded(scoring.score_maxout(long(spark, sf_dir), h, LINE, 4), "score", digits=9)


@query("score_kernel", "SELECT l_orderkey, l_linenumber, round(0.5 * exp(-2.0 * (pow(l_discount - 0.05, 2) + pow(l_tax - 0.02, 2))) - 0.25 * exp(-2.0 * (pow(l_discount - 0.01, 2) + pow(l_tax - 0.08, 2))), 9) AS score FROM lineitem")
def score_kernel(spark, sf_dir):
    sv = [{"vector": [0.05, 0.02], "kernel": "rbf", "scale": 2.0, "weight": 0.5}, {"vector": [0.01, 0.08], "kernel": "rbf", "scale": 2.0, "weight": -0.25}]
    t = table(spark, sf_dir, "lineitem")
    return rounded(t.select(*LINE, scoring.score_kernel(F.array("l_discount", "l_tax"), sv).alias("score")), "score", digits=9)


@query("score_mlp", "SELECT l_orderkey, l_linenumber, round(greatest(l_discount * 2 - l_tax + 0.01, 0) * 1.5 - greatest(l_tax * 3 - l_discount, 0) * 0.5 + 0.1, 9) AS score FROM lineitem")
def score_mlp(spark, sf_dir):
    layers = [{"weights": [[2.0, -1.0], [-1.0, 3.0]], "bias": [0.01, 0.0], "activation": "relu"}, {"weights": [[1.5], [-0.5]], "bias": [0.1], "activation": "identity"}]
    t = table(spark, sf_dir, "lineitem")
    return rounded(t.select(*LINE, scoring.score_mlp(F.array("l_discount", "l_tax"), layers).alias("score")), "score", digits=9)


@query("top_weights", "SELECT label, family, feature, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, family, feature) AS rank FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in FULL) + ") v(family, feature, label, weight)) WHERE rank <= 1")
def top_weights(spark, sf_dir):
    return joins.top_k_per(full(spark), "label", 1, F.col("weight"), "family", "feature").select("label", "family", "feature", "weight", "rank")


@query("full_rank_gradient", f"""WITH {LONG}, {FULL_SQL}, ex AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'x' ELSE 'y' END AS own FROM lineitem),
sc AS (SELECT l_orderkey, l_linenumber, label, sum(value * weight) AS score FROM long JOIN fw USING (family, feature) GROUP BY 1, 2, 3),
fl AS (SELECT ex.*, n.label, coalesce(score, 0) AS score FROM ex CROSS JOIN (SELECT DISTINCT label FROM fw) n LEFT JOIN sc USING (l_orderkey, l_linenumber, label)),
g AS (SELECT l_orderkey, l_linenumber, label, exp(score) / sum(exp(score)) OVER (PARTITION BY l_orderkey, l_linenumber) - CASE WHEN label = own THEN 1 ELSE 0 END AS g FROM fl)
SELECT family, feature, label, round(sum(value * g) / (SELECT count(*) FROM ex), 4) AS g FROM long JOIN g USING (l_orderkey, l_linenumber) GROUP BY 1, 2, 3""")
def full_rank_gradient(spark, sf_dir):
    labels = table(spark, sf_dir, "lineitem").select(*LINE, F.when(F.col("l_quantity") > 25, "x").otherwise("y").alias("label"))
    return rounded(softmax.gradient_full_rank(packed(features(spark, sf_dir), LINE), full(spark), labels, LINE), "g", digits=4)


# trainers: their results depend on an order or a sample, so only their rows are compared


def training_rows(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return long(spark, sf_dir).where("family <> 'status'"), t.select(*LINE, F.when(F.col("l_quantity") + 200 * F.col("l_discount") > 35, 1.0).otherwise(-1.0).alias("label"))


def dense_rows(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select(*LINE, F.when(F.col("l_quantity") + 200 * F.col("l_discount") > 35, 1.0).otherwise(-1.0).alias("label"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"))


NAMES = [("loc", "qty"), ("loc", "disc"), ("loc", "tax")]


@query("train_linear")
def train_linear(spark, sf_dir):
    x, y = training_rows(spark, sf_dir)
    return linear.train_linear(x.where("family <> 'loc'"), y, LINE, iterations=2)


@query("train_additive")
def train_additive(spark, sf_dir):
    x, y = training_rows(spark, sf_dir)
    return additive.train_additive(x, y, LINE, num_bins=8, iterations=2, smoothing_tolerance=0.05)


@query("train_full_rank")
def train_full_rank(spark, sf_dir):
    x, y = packed(features(spark, sf_dir).drop(strings=["status"], floats=["loc"]), LINE), training_rows(spark, sf_dir)[1]
    return softmax.train_full_rank(x, y.withColumn("label", F.when(F.col("label") > 0, "up").otherwise("down")), LINE, iterations=2)


@query("train_low_rank")
def train_low_rank(spark, sf_dir):
    x, y = training_rows(spark, sf_dir)
    return softmax.train_low_rank(x.where("family <> 'loc'"), y.withColumn("label", F.when(F.col("label") > 0, "up").otherwise("down")), LINE, iterations=2, dimension=4)[0]


@query("train_decision_tree")
def train_decision_tree(spark, sf_dir):
    nodes = trees.train_tree(dense_rows(spark, sf_dir), NAMES, max_depth=3, candidates=8)
    return spark.createDataFrame([(i, n.get("feature"), n.get("threshold"), n.get("weight")) for i, n in enumerate(nodes)], "node int, feature string, threshold double, weight double")


@query("train_boosted_stumps")
def train_boosted_stumps(spark, sf_dir):
    return trees.train_boosted_stumps(dense_rows(spark, sf_dir), NAMES, candidates=6, iterations=5)


@query("train_boosted_forest")
def train_boosted_forest(spark, sf_dir):
    forest = trees.train_boosted_forest(dense_rows(spark, sf_dir), NAMES, num_trees=2, max_depth=2, candidates=6)
    return spark.createDataFrame([(t, i, n.get("feature"), n.get("threshold"), n.get("weight")) for t, nodes in enumerate(forest) for i, n in enumerate(nodes)], "tree int, node int, feature string, threshold double, weight double")


@query("train_forest")
def train_forest(spark, sf_dir):
    forest = trees.train_forest(dense_rows(spark, sf_dir), NAMES, LINE, num_trees=2, max_depth=2, candidates=6)
    return spark.createDataFrame([(t, i, n.get("feature"), n.get("threshold"), n.get("weight")) for t, nodes in enumerate(forest) for i, n in enumerate(nodes)], "tree int, node int, feature string, threshold double, weight double")


@query("train_mlp")
def train_mlp(spark, sf_dir):
    layers = neural.train_mlp(dense_rows(spark, sf_dir), [4, 1], ["tanh", "identity"], iterations=3)
    return spark.createDataFrame([(i, r, c, float(w)) for i, la in enumerate(layers) for r, row in enumerate(la["weights"]) for c, w in enumerate(row)], "layer int, row int, unit int, weight double")


@query("train_maxout")
def train_maxout(spark, sf_dir):
    w = neural.train_maxout(dense_rows(spark, sf_dir), hidden=4, iterations=3)
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])], "row int, unit int, weight double")


@query("train_kernel")
def train_kernel(spark, sf_dir):
    sv = neural.train_kernel(dense_rows(spark, sf_dir), candidates=200, max_vectors=16)
    return spark.createDataFrame([(i, v["kernel"], v["vector"], v["weight"]) for i, v in enumerate(sv)], "n int, kernel string, vector array<double>, weight double")


@query("build_kdtree")
def build_kdtree(spark, sf_dir):
    nodes = spatial.build_kd(spatial.sample_points(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]), max_depth=4)
    return spark.createDataFrame([(i, n["type"], float(n["split"]), n["left"], n["right"], n["count"]) for i, n in enumerate(nodes)], "node int, type string, split double, left int, right int, count int")


@query("feature_map")
def feature_map(spark, sf_dir):
    return spatial.feature_map(long(spark, sf_dir), linear_families=("BIAS", "flag", "status"), min_count=10)


@query("train_strategy")
def train_strategy(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("id"), (F.col("o_totalprice") % 2 < 1).alias("label"), (F.col("o_totalprice") / 1e5).alias("x"), F.lit(100.0).alias("base_pivot"), (F.col("o_totalprice") % 40 + 80).alias("observed_value"),
        F.when(F.col("o_totalprice") % 2 < 1, F.col("o_totalprice") % 40 + 80).alias("true_value"),
    )
    return perkey.train_strategy(rows, least=100, epochs=5)


@query("train_boosted_per_key")
def train_boosted_per_key(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_quantity") + 200 * F.col("l_discount") > 35).cast("double"))
    return perkey.train_boosted(t, ["l_quantity", "l_discount", "l_tax"], "y", "l_returnflag", rounds=3)
