"""Queries for strategy metrics, policies, value updates, losses and differences of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.features import difference, flatten, ingest, packed
from tessella.functions import scalar
from tessella.models import policies
from tessella.operators import strategy
from tessella.queries.analysis import LONG, rounded
from tessella.queries.base import LINE, query, table
from tessella.queries.modelling import W_SQL, string_features, weights

OFFERS = """offer AS (SELECT o_custkey % 40 AS id, o_orderstatus = 'F' AS label, round(o_totalprice / 1000) AS prediction, o_orderkey % 300 + 1.0 AS observed_value,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 250 + 2.0 END AS true_value FROM orders),
seen AS (SELECT id, label, prediction < v AS lower, (prediction - v) / v AS increase FROM (SELECT *, CASE WHEN label AND true_value IS NOT NULL THEN true_value ELSE observed_value END AS v FROM offer)),
counted AS (SELECT id, count(*) FILTER (label AND NOT lower) AS ph, count(*) FILTER (label AND lower) AS pl, count(*) FILTER (NOT label AND NOT lower) AS nh, count(*) FILTER (NOT label AND lower) AS nl,
  coalesce(sum(increase) FILTER (label AND NOT lower), 0) AS ti, coalesce(sum(increase) FILTER (label AND lower), 0) AS td,
  coalesce(sum(increase) FILTER (NOT label AND NOT lower), 0) AS fi, coalesce(sum(increase) FILTER (NOT label AND lower), 0) AS fd,
  coalesce(list_sort(list(increase) FILTER (label AND lower)), []) AS regret FROM seen GROUP BY id)"""


def _share_sql(a: str, b: str) -> str:
    return f"round(coalesce(({a}) / nullif({b}, 0), 0), 8)"


def _metrics_sql(median: str, quartile: str) -> str:
    of = {
        "posCount": "ph + pl", "negCount": "nh + nl", "posSugHigher": "ph", "posSugLower": "pl", "negSugHigher": "nh", "negSugLower": "nl",
        "increasePrecision": _share_sql("ph", "ph + nh"), "increaseRecall": _share_sql("ph", "ph + pl"), "decreasePrecision": _share_sql("nl", "pl + nl"), "decreaseRecall": _share_sql("nl", "nh + nl"),
        "trueRegret": _share_sql("td", "ph + pl"), "trueRegretMedian": median, "trueRegret75Percentile": quartile, "falseRegret": _share_sql("fi", "nh + nl"),
        "trueIncreaseMagnitude": _share_sql("ti", "ph"), "trueDecreaseMagnitude": _share_sql("td", "pl"), "falseDecreaseMagnitude": _share_sql("fd", "nl"), "falseIncreaseMagnitude": _share_sql("fi", "nh"),
    }
    return ", ".join(f"{'CAST(' + v + ' AS BIGINT)' if k.endswith(('Count', 'Higher', 'Lower')) else v} AS {k}" for k, v in of.items())


def offers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 40).alias("id"), (F.col("o_orderstatus") == "F").alias("label"), F.round(F.col("o_totalprice") / 1000).alias("prediction"), (F.col("o_orderkey") % 300 + 1.0).alias("observed_value"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 250 + 2.0).alias("true_value"),
    )


def _numbers(df):
    return rounded(df, *[c for c, t in df.dtypes if t == "double"], digits=8)


NTH = "round(coalesce(regret[CAST(floor(len(regret) * {}) AS BIGINT) + 1], 0), 8)"


@query("strategy_metrics", f"WITH {OFFERS} SELECT id, {_metrics_sql(NTH.format(0.5), NTH.format(0.75))} FROM counted")
def strategy_metrics(spark, sf_dir):
    return _numbers(strategy.binary_metrics(offers(spark, sf_dir), "id").select("id", *strategy.OUTPUT))


@query("strategy_combined", f"WITH {OFFERS}, counted_all AS (SELECT sum(ph) AS ph, sum(pl) AS pl, sum(nh) AS nh, sum(nl) AS nl, sum(ti) AS ti, sum(td) AS td, sum(fi) AS fi, sum(fd) AS fd FROM counted) SELECT {_metrics_sql('0.0::DOUBLE', '0.0::DOUBLE')} FROM counted_all")
def strategy_combined(spark, sf_dir):
    return _numbers(strategy.combined(strategy.binary_metrics(offers(spark, sf_dir), "id")).select(*strategy.OUTPUT))


@query("policy_greedy", "SELECT o_custkey, arg_min(o_orderkey, (-round(o_totalprice / 50000), o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def policy_greedy(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 50000).alias("score"))
    return policies.epsilon_greedy(scores, ["o_custkey"], "o_orderkey", 0.0)


@query("policy_softmax", f"""SELECT o_custkey, arg_min(o_orderkey, (noisy, o_orderkey)) AS o_orderkey FROM (
  SELECT o_custkey, o_orderkey, -(o_totalprice / 50000 / 0.5 - ln(-ln(CAST('0x' || substr(md5('0:' || o_custkey || ':' || o_orderkey), 1, 13) AS BIGINT) / {float(1 << 52)!r}::DOUBLE + 0.5 / {float(1 << 52)!r}::DOUBLE))) AS noisy FROM orders) GROUP BY 1""")
def policy_softmax(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 50000).alias("score"))
    return policies.softmax_policy(scores, ["o_custkey"], "o_orderkey", 0.5)


@query("sarsa_update", f"""WITH {LONG}, {W_SQL}, now AS (SELECT l_orderkey, l_linenumber, sum(weight) AS q FROM long JOIN w USING (family, feature) GROUP BY 1, 2),
err AS (SELECT a.l_orderkey, a.l_linenumber, a.q - l.l_tax - 0.9 * coalesce(b.q, 0) AS e FROM now a JOIN lineitem l USING (l_orderkey, l_linenumber) LEFT JOIN now b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
step AS (SELECT family, feature, -0.001 * sum(e) AS s FROM long JOIN err USING (l_orderkey, l_linenumber) WHERE family IN ('flag', 'status', 'BIAS') GROUP BY 1, 2)
SELECT family, feature, round(coalesce(weight, 0) + coalesce(s, 0), 8) AS weight FROM w FULL JOIN step USING (family, feature)""")
def sarsa_update(spark, sf_dir):
    x = packed(string_features(spark, sf_dir), LINE)
    following = x.withColumn("l_linenumber", F.col("l_linenumber") - 1)
    rewards = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_tax").alias("reward"))
    return rounded(policies.sarsa_update(weights(spark), x, following, rewards, LINE, 0.001, 0.9), "weight", digits=8)


@query("feature_difference", """WITH a AS (SELECT o_orderkey, 'f' AS family, 'price' AS feature, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 's', o_orderstatus, 1.0 FROM orders UNION ALL SELECT o_orderkey, 'BIAS', 'B', 1.0 FROM orders),
b AS (SELECT o_orderkey, family, feature, CASE WHEN feature = 'price' THEN least(value, 100000) ELSE value END AS value FROM a WHERE feature <> 'P')
SELECT o_orderkey, family, feature, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b USING (o_orderkey, family, feature) WHERE a.value IS DISTINCT FROM b.value""")
def feature_difference(spark, sf_dir):
    flat = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("f_price"), F.col("o_orderstatus").alias("s_RAW"))
    a = flatten(ingest(flat, ["o_orderkey"]), ["o_orderkey"], skip=["MISS"])
    b = a.where("feature <> 'P'").withColumn("value", F.when(F.col("feature") == "price", F.least("value", F.lit(100000.0))).otherwise(F.col("value")))
    return difference(a, b, ["o_orderkey"])


@query("loss_functions", "SELECT l_orderkey, l_linenumber, round(-y * ln(p) - (1 - y) * ln(1 - p), 9) AS log_loss, round(abs((p - q) / q), 9) AS relative_loss FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity / 51.0 AS p, l_tax + 0.5 AS q FROM lineitem)")
def loss_functions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    y, p = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0), F.col("l_quantity") / 51.0
    return t.select(*LINE, F.round(scalar.log_loss(p, y), 9).alias("log_loss"), F.round(scalar.relative_loss(p, F.col("l_tax") + 0.5), 9).alias("relative_loss"))
