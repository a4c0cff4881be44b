"""Queries for statistics, selection, sampling, joins, evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.features import FeatureSet, flatten, from_nested, ingest, merge_context, packed, to_nested
from tessella.functions import scalar
from tessella.operators import evaluation, joins, sampling, statistics
from tessella.queries.base import LINE, lines, query, table
from tessella.sources import scans, sinks

LONG = """long AS (
  SELECT l_orderkey, l_linenumber, 'loc' AS family, 'qty' AS feature, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'loc', 'price', l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'loc', 'disc', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'loc', 'tax', l_tax FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'flag', l_returnflag, 1.0 FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'status', l_linestatus, 1.0 FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'BIAS', 'B', 1.0 FROM lineitem)"""


def features(spark, sf_dir):
    return lines(spark, sf_dir).drop(strings=["ship", "due", "MISS"])


def long(spark, sf_dir):
    return flatten(features(spark, sf_dir), LINE)


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("feature_stats", f"""WITH {LONG} SELECT family, feature, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 4) AS variance
FROM long GROUP BY family, feature HAVING count(*) >= 10""")
def feature_stats(spark, sf_dir):
    return rounded(rounded(statistics.feature_statistics(long(spark, sf_dir), 10), "mean"), "variance", digits=4)


@query("feature_quantiles", f"""WITH {LONG}, r AS (SELECT family, feature, value, row_number() OVER (PARTITION BY family, feature ORDER BY value) AS i, count(*) OVER (PARTITION BY family, feature) AS n FROM long)
SELECT family, feature, max(value) FILTER (i = ceil(n / 10.0)) AS q10, max(value) FILTER (i = ceil(n / 2.0)) AS q50, max(value) FILTER (i = ceil(n * 9 / 10.0)) AS q90 FROM r WHERE n >= 10 GROUP BY 1, 2""")
def feature_quantiles(spark, sf_dir):
    q = statistics.exact_quantiles(long(spark, sf_dir), [0.1, 0.5, 0.9], 10)
    return q.select("family", "feature", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@query("flatten_long", f"WITH {LONG} SELECT * FROM long")
def flatten_long(spark, sf_dir):
    return long(spark, sf_dir)


@query("label_counts", "SELECT l_returnflag AS label, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def label_counts(spark, sf_dir):
    return statistics.label_counts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "label"), min_count=5)


@query("max_scale", f"WITH {LONG} SELECT family, feature, 1 / max(value) AS scale FROM long GROUP BY 1, 2 HAVING max(value) > 1e-10 AND count(*) >= 5")
def max_scale(spark, sf_dir):
    return statistics.max_scale(long(spark, sf_dir), 5)


@query("dictionary", f"""WITH {LONG}, st AS (SELECT family, feature, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM long GROUP BY 1, 2)
SELECT family, feature, row_number() OVER (ORDER BY family, feature) - 1 AS index, round(CASE WHEN v < 1e-6 THEN 0 ELSE m END, 6) AS mean, round(CASE WHEN v < 1e-6 THEN 1 ELSE 1 / sqrt(v) END, 6) AS scale FROM st""")
def dictionary(spark, sf_dir):
    return rounded(statistics.dictionary(statistics.feature_statistics(long(spark, sf_dir))), "mean", "scale")


@query("vectorise", f"""WITH {LONG}, st AS (SELECT family, feature, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM long GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(CASE WHEN v < 1e-6 THEN value ELSE (value - m) / sqrt(v) END), 4) AS total FROM long JOIN st USING (family, feature) GROUP BY 1, 2""")
def vectorise(spark, sf_dir):
    x = long(spark, sf_dir)
    v = statistics.vectorise(packed(features(spark, sf_dir), LINE), statistics.dictionary(statistics.feature_statistics(x)), LINE)
    return v.select(*LINE, F.size("indices").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


PMI = f"""{LONG}, pos AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag = 'R' AS pos FROM lineitem),
tot AS (SELECT count(*) AS n, count(*) FILTER (pos) AS n_pos FROM pos),
rows_ AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS pos, unnest([{{'family': 'status', 'feature': l_linestatus}}, {{'family': 'flag', 'feature': l_returnflag}}, {{'family': 'BIAS', 'feature': 'B'}}]) AS f FROM lineitem),
seen AS (SELECT family, feature, count(*) AS c, count(*) FILTER (pos) AS c_pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, pos, f.family AS family, f.feature AS feature FROM rows_) GROUP BY 1, 2),
pmi AS (SELECT family, feature, log2((c_pos / n_pos) / (c / n)) AS pmi FROM seen, tot WHERE c_pos >= 1)"""


def pmi(spark, sf_dir):
    fs = lines(spark, sf_dir)
    x = flatten(FeatureSet(fs.df.select(*LINE, F.array_contains(fs.strings("flag"), "R").alias("pos"), "s:status", "s:BIAS", "s:flag")), [*LINE, "pos"])
    return statistics.mutual_information(x, F.col("pos"), LINE)


@query("mutual_information", f"WITH {PMI} SELECT family, feature, round(pmi, 6) AS pmi FROM pmi UNION ALL SELECT '$ALL', '$POS', round(n_pos / n, 6) FROM tot")
def mutual_information(spark, sf_dir):
    return rounded(pmi(spark, sf_dir), "pmi")


@query("max_entropy", f"WITH {PMI} SELECT family, feature, round(pmi, 6) AS pmi FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs(pmi) DESC, feature) AS r FROM pmi) WHERE r = 1")
def max_entropy(spark, sf_dir):
    return rounded(statistics.strongest(pmi(spark, sf_dir).where("family <> '$ALL'")), "pmi")


@query("feature_crosses", """SELECT o_orderkey, '<NEW>' AS family, 'flag:' || o_orderstatus || '^level:' || o_orderpriority AS feature, 1.0::DOUBLE AS value FROM orders""")
def feature_crosses(spark, sf_dir):
    fs = ingest(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("flag_RAW"), F.col("o_orderpriority").alias("level_RAW")), ["o_orderkey"], bias=False)
    return statistics.crosses(flatten(fs, ["o_orderkey"], skip=["MISS"]), ["o_orderkey"])


@query("ingest_missing", """SELECT o_orderkey, 'L_small' AS feature FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey, 'F_big' FROM orders WHERE o_totalprice <= 100000""")
def ingest_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    flat = o.select("o_orderkey", F.when(F.col("o_totalprice") <= 100000, F.col("o_orderstatus")).alias("L_small"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("F_big"))
    fs = ingest(flat, ["o_orderkey"])
    return fs.df.select("o_orderkey", F.explode(fs.strings("MISS")).alias("feature"))


@query("ingest_types", """SELECT o_orderkey, 'b' AS family, 'late:' || CASE WHEN o_orderdate > TIMESTAMP '1995-01-01' THEN 'T' ELSE 'F' END AS feature, 1.0::DOUBLE AS value FROM orders
UNION ALL SELECT o_orderkey, 's', 'status:' || o_orderstatus, 1.0 FROM orders UNION ALL SELECT o_orderkey, 'f', 'price', o_totalprice FROM orders UNION ALL SELECT o_orderkey, 'LABEL', '', o_totalprice FROM orders
UNION ALL SELECT o_orderkey, 'DEFAULT_STRING', 'priority:' || o_orderpriority, 1.0 FROM orders UNION ALL SELECT o_orderkey, 'BIAS', 'B', 1.0 FROM orders""")
def ingest_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    flat = o.select("o_orderkey", (F.col("o_orderdate") > F.lit("1995-01-01").cast("timestamp")).alias("b_late"), F.col("o_orderstatus").alias("s_status"), F.col("o_totalprice").alias("f_price"), F.col("o_totalprice").alias("label"), F.col("o_orderpriority").alias("priority"))
    return flatten(ingest(flat, ["o_orderkey"]), ["o_orderkey"], skip=["MISS"])


@query("ingest_multiclass", "SELECT o_orderkey, unnest(['a', o_orderstatus]) AS feature, unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS value FROM orders")
def ingest_multiclass(spark, sf_dir):
    flat = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a:1,"), F.col("o_orderstatus"), F.lit(":2")).alias("LABEL"))
    return ingest(flat, ["o_orderkey"], multiclass=True).df.select("o_orderkey", F.explode("f:LABEL").alias("feature", "value"))


@query("nested_round_trip", "SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_returnflag AS flag FROM lineitem")
def nested_round_trip(spark, sf_dir):
    fs = from_nested(to_nested(lines(spark, sf_dir)), strings=["flag"], floats=["loc"])
    return fs.df.select(*LINE, fs.floats("loc")["qty"].alias("qty"), F.get(fs.strings("flag"), F.lit(0)).alias("flag"))


@query("context_merge", "SELECT l_orderkey, l_linenumber, l_quantity AS qty, o_totalprice AS total, o_orderstatus AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def context_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    context = ingest(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("ctx_total"), F.col("o_orderstatus").alias("flag_RAW")), ["l_orderkey"])
    fs = merge_context(context, lines(spark, sf_dir), ["l_orderkey"])
    return fs.df.where(fs.floats("ctx").isNotNull()).select(*LINE, fs.floats("loc")["qty"].alias("qty"), fs.floats("ctx")["total"].alias("total"), F.get(fs.strings("flag"), F.lit(0)).alias("flag"))


@query("sql_script", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def sql_script(spark, sf_dir):
    return scans.run_script(spark, f"CREATE OR REPLACE TEMP VIEW rich AS SELECT * FROM parquet.`{sf_dir}/customer.parquet` WHERE c_acctbal > 0; -- with a comment; here\nSELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM rich GROUP BY 1;")


@query("json_parse", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def json_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


@query("training_split", "SELECT l_orderkey, l_linenumber, CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 2) AS BIGINT) > 16 AS is_training FROM lineitem")
def training_split(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(*LINE)
    return t.withColumn("is_training", sampling.is_training(*map(F.col, LINE)))


@query("downsample", f"SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'N' OR CAST('0x' || substr(md5('0:' || l_orderkey || ':' || l_linenumber), 1, 13) AS BIGINT) < 0.25 * {1 << 52}")
def downsample(spark, sf_dir):
    return sampling.downsample(table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag"), "l_returnflag", {"N": 0.25}, LINE)


@query("ratio_slices", """SELECT slice, count(*) AS n FROM (SELECT CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'eval' ELSE 'holdout' END AS slice FROM (
  SELECT percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)) GROUP BY 1""")
def ratio_slices(spark, sf_dir):
    s = sampling.slices(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], {"train": 0.6, "eval": 0.2, "holdout": 0.2})
    return s.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("enough_samples", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12 AND count(*) FILTER (o_totalprice > 50000) >= 5)")
def enough_samples(spark, sf_dir):
    return sampling.enough(table(spark, sf_dir, "orders"), "o_custkey", 12, F.col("o_totalprice") > 50000, 5).select("o_orderkey", "o_custkey")


# joins


@query("join_defaults", "SELECT c_custkey, coalesce(max(o_totalprice), -1.0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000 GROUP BY 1")
def join_defaults(spark, sf_dir):
    top = table(spark, sf_dir, "orders").where("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return joins.with_defaults(table(spark, sf_dir, "customer").select("c_custkey"), top, ["c_custkey"], {"top": -1.0})


@query("join_keep_best", """SELECT o_custkey, min(o_totalprice) AS loss FROM orders GROUP BY 1""")
def join_keep_best(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("loss"), "o_orderkey")
    return joins.keep_best(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "loss").select("o_custkey", "loss")


@query("join_three_way", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_three_way(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("group_samples", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_samples(spark, sf_dir):
    g = joins.group_samples(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), "o_custkey")
    return g.select("o_custkey", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["o_totalprice"]), 2).alias("total"))


@query("top_k_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k_global(spark, sf_dir):
    return joins.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, F.col("o_totalprice"), "o_orderkey")


@query("top_k_per_key", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_key(spark, sf_dir):
    return joins.top_k_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 3, F.col("o_totalprice"), "o_orderkey").withColumn("rank", F.col("rank").cast("long"))


@query("knn_token_overlap", """WITH t AS (SELECT DISTINCT o_custkey AS id, o_orderpriority || strftime(o_orderdate, '%Y%m') AS token FROM orders),
s AS (SELECT a.id, b.id AS other, count(*) AS shared FROM t a JOIN t b ON a.id % 50 = 0 AND a.token = b.token AND a.id <> b.id GROUP BY 1, 2)
SELECT id, other, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS rank FROM s) WHERE rank <= 3""")
def knn_token_overlap(spark, sf_dir):
    """Of every fiftieth customer against all."""
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyyMM")).alias("token"))
    return joins.nearest_by_overlap(t, 3, 100_000, F.col("id") % 50 == 0).withColumn("rank", F.col("rank").cast("long"))


@query("knn_min_kernel", """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS vec FROM embeddings),
s AS (SELECT q.id, v.id AS other, list_sum(list_transform(range(1, 65), lambda i: least(q.vec[i], v.vec[i]))) AS similarity FROM v q JOIN v ON q.id % 25 = 0 AND q.id <> v.id)
SELECT id, other, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s) WHERE rank <= 5""")
def knn_min_kernel(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("vec"))
    return rounded(joins.nearest_by_min_kernel(v, v.where("id % 25 = 0"), 5), "similarity").withColumn("rank", F.col("rank").cast("long"))


@query("box_query", """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS px, l_tax * 100 AS py FROM lineitem),
b AS (SELECT s_suppkey, s_suppkey % 40 AS x, s_suppkey % 7 AS y FROM supplier),
pc AS (SELECT px, py, min(l_orderkey) AS c_l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS c_l_linenumber, count(*) AS n FROM p GROUP BY 1, 2),
bc AS (SELECT x, y, min(s_suppkey) AS c_s_suppkey, count(*) AS n FROM b GROUP BY 1, 2),
pair AS (SELECT px, py, x, y, c_l_orderkey, c_l_linenumber, c_s_suppkey, pc.n AS np, bc.n AS nb FROM pc JOIN bc ON px BETWEEN x AND x + 3 AND py BETWEEN y AND y + 0.5)
SELECT 'line' AS kind, l_orderkey, l_linenumber, NULL::BIGINT AS s_suppkey, c_l_orderkey, c_l_linenumber, NULL::BIGINT AS c_s_suppkey, CAST(coalesce(links, 0) AS BIGINT) AS links
FROM p JOIN pc ON p.px IS NOT DISTINCT FROM pc.px AND p.py IS NOT DISTINCT FROM pc.py LEFT JOIN (SELECT px, py, sum(nb) AS links FROM pair GROUP BY 1, 2) l ON l.px = p.px AND l.py = p.py
UNION ALL SELECT 'supplier', NULL, NULL, s_suppkey, NULL, NULL, c_s_suppkey, CAST(coalesce(links, 0) AS BIGINT) FROM b JOIN bc USING (x, y) LEFT JOIN (SELECT x, y, sum(np) AS links FROM pair GROUP BY 1, 2) USING (x, y)
UNION ALL SELECT 'pair', NULL, NULL, NULL, c_l_orderkey, c_l_linenumber, c_s_suppkey, np * nb FROM pair""")
def box_query(spark, sf_dir):
    """All lines in every supplier's box, as classes: a row for every line (kind ``line``) and every supplier with its
    representative and number of links, and a row for every ``pair`` of representatives."""
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 40).alias("x0"), (k % 40 + 3).alias("x1"), (k % 7).alias("y0"), (k % 7 + 0.5).alias("y1"))
    points = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_quantity").alias("px"), (F.col("l_tax") * 100).alias("py"))
    parts = zip(("line", "supplier", "pair"), joins.box_links(points, LINE, boxes, ["s_suppkey"], 4.0), strict=True)
    a, b, c = [part.withColumn("kind", F.lit(kind)) for kind, part in parts]
    named = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return named.select("kind", *LINE, "s_suppkey", *[f"c_{x}" for x in (*LINE, "s_suppkey")], "links")


@query("geo_distance", "SELECT s_suppkey, round(degrees(acos(least(1.0, greatest(-1.0, sin(radians(37.7)) * sin(radians(s_suppkey % 80)) + cos(radians(37.7)) * cos(radians(s_suppkey % 80)) * cos(radians(-122.4 - s_nationkey)))))) * 60 * 1.1515 * 1.609344, 5) AS km FROM supplier")
def geo_distance(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.round(scalar.great_circle(F.lit(37.7), F.lit(-122.4), (F.col("s_suppkey") % 80).cast("double"), F.col("s_nationkey").cast("double"), "kilometers"), 5).alias("km"))


@query("scalar_functions", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount - l_tax))), 9) AS sig, round(1 - exp(-pow(l_quantity / 20.0, 1.5)), 9) AS wb, round(log2(l_quantity), 9) AS lg, greatest(l_tax - 0.04, 0) AS rl, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS days, dayofweek(l_shipdate) AS dow FROM lineitem""")
def scalar_functions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        *LINE, F.round(scalar.sigmoid(F.col("l_discount") - F.col("l_tax")), 9).alias("sig"), F.round(scalar.weibull(F.col("l_quantity"), 1.5, 20.0), 9).alias("wb"), F.round(scalar.log2(F.col("l_quantity")), 9).alias("lg"),
        scalar.relu(F.col("l_tax") - 0.04).alias("rl"), scalar.days_between(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("days"), scalar.day_of_week(F.col("l_shipdate")).cast("long").alias("dow"),
    )


@query("vector_functions", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS dot, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
round(CAST(list_max(embedding[33:64]) AS DOUBLE) - CAST(list_max(embedding[1:32]) AS DOUBLE), 6) AS maxout FROM embeddings""")
def vector_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.round(scalar.dot(F.col("v"), F.col("v")), 6).alias("dot"), F.round(scalar.l2(F.col("v")), 6).alias("norm"), F.round(scalar.maxout_halves(F.col("v")), 6).alias("maxout"))


# evaluation over records made from lineitem: the score is a number of the row, the label its flag

RECORDS = "rec AS (SELECT l_orderkey, l_linenumber, l_discount * 5 + l_tax AS score, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END AS label, CASE WHEN l_linestatus = 'F' THEN 'TRAIN' ELSE 'HOLD' END AS side FROM lineitem)"


def records(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select(*LINE, (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("label"), (F.col("l_linestatus") == "F").alias("is_training"))


CUTS = "cuts AS (SELECT lo + i * (hi - lo) / 10 AS threshold FROM (SELECT min(score) AS lo, max(score) AS hi FROM rec), range(0, 11) r(i))"
CONFUSION = f"{RECORDS}, {CUTS}, conf AS (SELECT side, threshold, count(*) FILTER (score > threshold AND label > 0) AS TP, count(*) FILTER (score > threshold AND label <= 0) AS FP, count(*) FILTER (score <= threshold AND label <= 0) AS TN, count(*) FILTER (score <= threshold AND label > 0) AS FN FROM rec, cuts GROUP BY 1, 2)"
DERIVED = f"{CONFUSION}, der AS (SELECT *, (TP + TN) / (TP + FP + TN + FN) AS ACC, coalesce(FP / nullif(FP + TN, 0), 0) AS FPR, coalesce(TP / nullif(TP + FN, 0), 0) AS RECALL, coalesce(TP / nullif(TP + FP, 0), 0) AS PRECISION FROM conf), full_ AS (SELECT *, coalesce(2 * PRECISION * RECALL / nullif(PRECISION + RECALL, 0), 0) AS F1 FROM der)"


@query("confusion", f"WITH {DERIVED} SELECT side, round(threshold, 6) AS threshold, TP, FP, TN, FN, round(ACC, 9) AS ACC, round(FPR, 9) AS FPR, round(RECALL, 9) AS RECALL, round(PRECISION, 9) AS PRECISION, round(F1, 9) AS F1 FROM full_")
def confusion(spark, sf_dir):
    return rounded(rounded(evaluation.derived(evaluation.confusion(records(spark, sf_dir), 10)), "ACC", "FPR", "RECALL", "PRECISION", "F1", digits=9), "threshold")


@query("best_threshold", f"WITH {DERIVED} SELECT side, round(threshold, 6) AS threshold, round(F1, 9) AS F1 FROM full_ WHERE side = 'HOLD' ORDER BY F1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    best = evaluation.best_threshold(evaluation.derived(evaluation.confusion(records(spark, sf_dir), 10)), "F1")
    return rounded(rounded(best.select("side", "threshold", "F1"), "F1", digits=9), "threshold")


AUC = "SELECT {k}, round(sum(CASE WHEN label > 0 THEN r END) / (count(*) FILTER (label > 0) * count(*) FILTER (label <= 0)) - (count(*) FILTER (label > 0) + 1) / 2.0 / count(*) FILTER (label <= 0), 8) AS AUC FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS r FROM rec) GROUP BY {k}"


@query("roc_auc", f"WITH {RECORDS} {AUC.format(k='side')}")
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(records(spark, sf_dir).withColumn("side", evaluation.side()), "side"), "AUC", digits=8)


@query("auc_folds", f"""WITH {RECORDS.replace("'HOLD' END AS side", "'HOLD' END AS side, CAST('0x' || substr(md5('fold:' || l_orderkey || ':' || l_linenumber), 1, 13) AS BIGINT) % 5 AS fold")},
auc AS ({AUC.format(k='side, fold').replace('round(', '(').replace(', 8) AS AUC', ') AS AUC')})
SELECT side, round(avg(AUC), 8) AS AUC, round(stddev_pop(AUC), 8) AS AUC_STDDEV, round(min(AUC), 8) AS AUC_MIN, round(max(AUC), 8) AS AUC_MAX FROM auc GROUP BY 1""")
def auc_folds(spark, sf_dir):
    return rounded(evaluation.auc_folds(records(spark, sf_dir), LINE), "AUC", "AUC_STDDEV", "AUC_MIN", "AUC_MAX", digits=8)


@query("pr_auc", f"""WITH {RECORDS}, h AS (SELECT side, score, count(*) FILTER (label > 0) AS p, count(*) FILTER (label <= 0) AS n FROM rec GROUP BY 1, 2),
c AS (SELECT side, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY side) AS tot FROM h WINDOW w AS (PARTITION BY side ORDER BY score DESC)),
d AS (SELECT side, score, tp / (tp + fp) AS pr, tp / tot AS re FROM c),
e AS (SELECT side, (re - lag(re, 1, 0.0) OVER w) * (pr + lag(pr, 1, 1.0) OVER w) / 2 AS s FROM d WINDOW w AS (PARTITION BY side ORDER BY score DESC))
SELECT side, round(sum(s), 7) AS PR_AUC FROM e GROUP BY 1""")
def pr_auc(spark, sf_dir):
    return rounded(evaluation.pr_auc(records(spark, sf_dir)), "PR_AUC", digits=7)


@query("regression_metrics", f"WITH {RECORDS} SELECT side, round(sqrt(avg((score - label) * (score - label))), 7) AS RMSE, round(sum(abs(label - score)) / sum(label + score), 7) AS SMAPE, round(sum((score - label) * (score - label)), 4) AS SQERR, count(*) AS COUNT FROM rec GROUP BY 1")
def regression_metrics(spark, sf_dir):
    return rounded(rounded(evaluation.regression(records(spark, sf_dir)), "RMSE", "SMAPE", digits=7), "SQERR", digits=4)


@query("classification_error", f"WITH {RECORDS} SELECT side, round(sqrt(avg(pow(CASE WHEN label > 0 THEN 1 - score ELSE score END, 2))), 7) AS RMSE, round(sum(pow(CASE WHEN label > 0 THEN 1 - score ELSE score END, 2)), 4) AS SQERR, count(*) AS COUNT FROM rec GROUP BY 1")
def classification_error(spark, sf_dir):
    return rounded(rounded(evaluation.classification_error(records(spark, sf_dir)), "RMSE", digits=7), "SQERR", digits=4)


@query("calibration_error", f"WITH {RECORDS}, b AS (SELECT floor(score / 0.01) AS b, count(*) AS n, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM rec GROUP BY 1) SELECT round(sqrt(sum(n * pow(rate - b * 0.01, 2)) / sum(n)), 7) AS calibration_error FROM b")
def calibration_error(spark, sf_dir):
    return rounded(evaluation.calibration_error(records(spark, sf_dir)), "calibration_error", digits=7)


HISTOGRAM = f"{RECORDS}, en AS (SELECT min(score) AS a, max(score) AS b, count(*) AS total FROM rec), ct AS (SELECT CAST(least(floor((score - a) / ((b - a) / 20)), 19) AS INTEGER) AS bucket, count(*) AS n FROM rec, en GROUP BY 1), hist AS (SELECT CAST(i AS INTEGER) AS bucket, a + i * ((b - a) / 20) AS lo, a + (i + 1) * ((b - a) / 20) AS hi, sum(coalesce(n, 0)) OVER (ORDER BY i) / total AS cdf FROM en, range(0, 20) r(i) LEFT JOIN ct ON ct.bucket = i)"


@query("histogram_calibrator", f"WITH {HISTOGRAM} SELECT bucket, round(lo, 7) AS lo, round(hi, 7) AS hi, round(cdf, 7) AS cdf FROM hist")
def histogram_calibrator(spark, sf_dir):
    return rounded(evaluation.histogram_calibrator(records(spark, sf_dir), 20), "lo", "hi", "cdf", digits=7)


@query("histogram_calibrated", f"""WITH {HISTOGRAM}, at_ AS (SELECT rec.*, h.lo, h.hi, h.cdf, coalesce(p.cdf, 0) AS below FROM rec JOIN hist h ON h.bucket = (SELECT max(bucket) FROM hist WHERE lo <= rec.score OR bucket = 0) LEFT JOIN hist p ON p.bucket = h.bucket - 1)
SELECT l_orderkey, l_linenumber, round(below + least(1.0, greatest(0.0, coalesce((score - lo) / nullif(hi - lo, 0), 1.0))) * (cdf - below), 7) AS calibrated FROM at_""")
def histogram_calibrated(spark, sf_dir):
    r = records(spark, sf_dir)
    return rounded(evaluation.calibrate_by_histogram(r, evaluation.histogram_calibrator(r, 20)).select(*LINE, "calibrated"), "calibrated", digits=7)


@query("platt_fit", f"""WITH RECURSIVE {RECORDS}, h AS (SELECT score AS s, CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, count(*) AS n FROM rec GROUP BY 1, 2),
step(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT k, a + ((h11 + 1e-6) * g0 - h01 * g1) / ((h00 + 1e-6) * (h11 + 1e-6) - h01 * h01), b + ((h00 + 1e-6) * g1 - h01 * g0) / ((h00 + 1e-6) * (h11 + 1e-6) - h01 * h01) FROM (
    SELECT k + 1 AS k, a, b, sum(n * (y - p)) AS g0, sum(n * (y - p) * s) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * s) AS h01, sum(n * p * (1 - p) * s * s) AS h11
    FROM (SELECT k, a, b, s, y, n, 1 / (1 + exp(-(a + b * s))) AS p FROM step, h WHERE k < 25) GROUP BY k, a, b))
SELECT round(a, 6) AS "offset", round(b, 6) AS slope FROM step WHERE k = 25""")
def platt_fit(spark, sf_dir):
    a, b = evaluation.platt_fit(records(spark, sf_dir))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "offset double, slope double")


def multiclass_records(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scores = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("string").alias("key"), F.get("embedding", i).cast("double").alias("value"))))
    return e.select("vec_id", scores.alias("scores"), F.create_map(F.col("label").cast("string"), F.lit(1.0)).alias("labels"), (F.col("vec_id") % 4 != 0).alias("is_training"))


@query("multiclass_metrics", """WITH r AS (SELECT vec_id, CAST(label AS VARCHAR) AS own, CASE WHEN vec_id % 4 <> 0 THEN 'TRAIN' ELSE 'HOLD' END AS side, unnest(range(0, 10)) AS i, unnest(embedding[1:10]) AS score FROM embeddings),
k AS (SELECT *, CAST(i AS VARCHAR) = own AS hit, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS rank FROM r),
n AS (SELECT side, count(DISTINCT vec_id) AS n FROM k GROUP BY 1),
h AS (SELECT a.side, sum(greatest(0, 1 - CAST(a.score AS DOUBLE) + CAST(b.score AS DOUBLE))) AS v FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.hit AND NOT b.hit GROUP BY 1),
c AS (SELECT k.*, t.c AS cut FROM k, range(1, 4) t(c)),
m AS (SELECT side, cut, vec_id, count(*) FILTER (hit AND rank <= cut) AS good, coalesce(max(1.0 / rank) FILTER (hit AND rank <= cut), 0) AS ap FROM c GROUP BY 1, 2, 3)
SELECT side, 'ALL_PAIRS_HINGE_LOSS' AS metric, round(v / n, 6) AS value FROM h JOIN n USING (side)
UNION ALL SELECT side, 'MEAN_RECIPROCAL_RANK', round(sum(1.0 / rank) / count(*), 6) FROM k WHERE hit GROUP BY 1
UNION ALL SELECT side, 'PRECISION@' || cut, round(avg(good / cut), 6) FROM m GROUP BY side, cut
UNION ALL SELECT side, 'ACCURACY@' || cut, round(avg(CASE WHEN good > 0 THEN 1.0 ELSE 0.0 END), 6) FROM m GROUP BY side, cut
UNION ALL SELECT side, 'MEAN_AVERAGE_PRECISION@' || cut, round(avg(ap), 6) FROM m GROUP BY side, cut""")
def multiclass_metrics(spark, sf_dir):
    return rounded(evaluation.multiclass(multiclass_records(spark, sf_dir), ["vec_id"], 3), "value")


@query("name_term_value", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS uid, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS response, f.name, f.term, f.value FROM (SELECT *, unnest([
{'name': 'flag', 'term': l_returnflag, 'value': 1.0::DOUBLE}, {'name': 'loc', 'term': 'qty', 'value': l_quantity}]) AS f FROM lineitem)""")
def name_term_value(spark, sf_dir):
    fs = lines(spark, sf_dir)
    small = FeatureSet(fs.df.select(F.concat_ws("-", *LINE).alias("uid"), F.map_filter("f:loc", lambda k, v: k == "qty").alias("f:loc"), "s:flag"))
    return sinks.name_term_value(small, "uid", small.floats("loc")["qty"] - 25).select("uid", "response", F.inline("features"))
