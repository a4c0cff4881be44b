"""Named jobs run from a configuration: make examples, train, evaluate, calibrate, score, search and dump.

``python -m tessella.plans.jobs CONFIG [job1,job2]``; without names the configuration's ``jobs`` are run in order.
"""

from __future__ import annotations

import json
import logging
import shutil
import sys
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.features import LABEL, FeatureSet, flatten
from tessella.models import dense, scoring, store
from tessella.operators import evaluation, sampling
from tessella.plans.config import expand, merged, parse
from tessella.sources import scans, sinks
from tessella.training import additive, linear, neural, search, softmax, spatial, trees
from tessella.transforms import Transformer

log = logging.getLogger(__name__)
JOBS: dict[str, Callable[[SparkSession, Mapping[str, Any]], Any]] = {}
SUMS = {"linear", "additive", "spline", "boosted_stumps"}
#: Model types with a score for every label.
MANY = {"full_rank_linear", "low_rank_linear"}
TREES = {"decision_tree", "forest", "boosted_forest"}
#: Trainers over dense rows.
DENSE = {*TREES, "boosted_stumps", "maxout", "mlp", "kernel"}


def job(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names:
            JOBS[n] = f
        return f

    return add


def _ids(c: Mapping[str, Any]) -> list[str]:
    return list(c.get("ids", ["id"]))


@job("GenericMakeExamples")
def make_examples(spark: SparkSession, config: Mapping[str, Any]) -> None:
    c = config["make_examples"]
    sinks.save_features(scans.examples(spark, c["query"], _ids(c), c.get("multiclass", False)), c["output"], c.get("num_shards"), c.get("mode", "overwrite"))


def _examples(spark: SparkSession, c: Mapping[str, Any]) -> FeatureSet:
    return scans.features(spark, c["input"])


def _transformed(fs: FeatureSet, config: Mapping[str, Any], key: str | None) -> FeatureSet:
    return Transformer(config, key)(fs) if key else fs


@job("GenericDebugExamples")
def debug_examples(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    c = config["debug_examples"]
    return _examples(spark, c).df.limit(int(c.get("count", 10)))


@job("GenericDebugTransforms")
def debug_transforms(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    c = config["debug_transforms"]
    return _transformed(_examples(spark, c), config, c.get("model_config")).df.limit(int(c.get("count", 10)))


def prepared(fs: FeatureSet, config: Mapping[str, Any], model: Mapping[str, Any], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(long features, labels) of a model's examples. The label family never is a feature."""
    rank = model.get("rank_key", LABEL)
    fs = _transformed(fs, config, model.get("transforms"))
    if model.get("trainer") in ("full_rank_linear", "low_rank_linear") or model.get("multiclass"):
        labels = fs.df.select(*ids, F.explode(fs.floats(rank)).alias("label", "w")).groupBy(*ids).agg(F.max_by("label", "w").alias("label"))
    else:
        labels = fs.df.select(*ids, fs.floats(rank)[model.get("rank_feature", "")].alias("label")).where("label IS NOT NULL")
    return flatten(fs, ids, skip=[rank]), labels


def train(spark: SparkSession, long: DataFrame, labels: DataFrame, ids: list[str], model: Mapping[str, Any]) -> tuple[str, DataFrame, dict[str, Any]]:
    """(model type, records, what the header holds besides) of a model's trainer. Trainers over dense rows get the
    features that occur ``min_count`` times as positions; missing values are null for trees and 0 for all others."""
    kind, options = model["trainer"], dict(model.get("options", {}))
    if kind == "linear":
        return kind, linear.train_linear(long, labels, ids, **options), {}
    if kind in ("additive", "spline"):
        return kind, (additive.train_additive if kind == "additive" else additive.train_spline)(long, labels, ids, **options), {}
    if kind == "full_rank_linear":
        return kind, softmax.train_full_rank(long, labels, ids, **options), {}
    if kind == "low_rank_linear":
        v, u = softmax.train_low_rank(long, labels, ids, **options)
        return kind, v.unionByName(u, allowMissingColumns=True), {}
    if kind not in DENSE:
        raise KeyError(f"no trainer is called {kind!r}")
    names = dense.names_of(long, options.pop("min_count", 0))
    rows = dense.densify(long, names, ids, None if kind in TREES else 0.0).join(labels, ids)
    index = spark.createDataFrame([(f, x, i) for i, (f, x) in enumerate(names)], "family string, feature string, position int")
    if kind == "boosted_stumps":
        return kind, trees.train_boosted_stumps(rows, names, **options), {}
    if kind == "maxout":
        w = neural.train_maxout(rows, **options)
        units = [(*names[i], j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
        return kind, spark.createDataFrame(units, "family string, feature string, unit int, weight double"), {"size": w.shape[1]}
    if kind == "mlp":
        layers = neural.train_mlp(rows, options.pop("node_number"), options.pop("activations"), **options)
        return "multilayer_perceptron", index, {"names": names, "layers": layers}
    if kind == "kernel":
        return kind, index, {"names": names, "support": neural.train_kernel(rows, **options)}
    grown = [trees.train_tree(rows, names, **options)] if kind == "decision_tree" else trees.train_forest(rows, names, ids, **options) if kind == "forest" else trees.train_boosted_forest(rows, names, **options)
    nodes = [(t, i, json.dumps(n)) for t, tree in enumerate(grown) for i, n in enumerate(tree)]
    return "decision_tree" if kind == "decision_tree" else "forest", spark.createDataFrame(nodes, "tree int, node int, json string"), {"names": names}


def read_trees(records: DataFrame) -> list[list[dict]]:
    """The trees of a model whose records are (tree, node, json)."""
    out: dict[int, list] = {}
    for r in records.orderBy("tree", "node").collect():
        out.setdefault(r["tree"], []).append(json.loads(r["json"]))
    return list(out.values())


def raw_scores(long: DataFrame, header: Mapping[str, Any], records: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, score) of examples by a model of any type but those of several labels."""
    kind = header["model_type"]
    if kind in SUMS:
        return scoring.score_sum(long, records, ids, kind)
    if kind == "maxout":
        return scoring.score_maxout(long, records, ids, header["size"])
    names = [tuple(n) for n in header["names"]]
    if kind in ("decision_tree", "forest"):
        model, missing = {"trees": read_trees(records)}, None
    else:
        model, missing = header, 0.0
    return dense.densify(long, names, ids, missing).select(*ids, dense.score(kind, model, F.col("x")).alias("score"))


def label_scores(long: DataFrame, header: Mapping[str, Any], records: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, label, score) by a model of several labels."""
    if header["model_type"] == "low_rank_linear":
        v, u = records.where("family IS NOT NULL").drop("label"), records.where("family IS NULL").select("label", "dim", "weight")
        return scoring.score_low_rank(long, v, u, ids)
    return scoring.score_full_rank(long, records, ids)


@job("GenericTrainModel")
def train_model(spark: SparkSession, config: Mapping[str, Any]) -> None:
    c = config["train_model"]
    model, ids = config[c["model_config"]], _ids(c)
    long, labels = prepared(_examples(spark, c), config, model, ids)
    fraction = float(c.get("training_fraction", 0.9373))
    labels = labels.where(sampling.is_training(*map(F.col, ids), fraction=fraction))
    if c.get("subsample", 1.0) < 1:
        labels = sampling.bernoulli(labels, float(c["subsample"]), ids)
    if c.get("downsample"):
        labels = sampling.downsample(labels, "label", {float(k): v for k, v in c["downsample"].items()}, ids)
    kind, records, header = train(spark, long.join(labels.select(*ids), ids, "left_semi"), labels, ids, model)
    store.save(records, model["model_output"], kind, mode="overwrite", offset=0.0, slope=1.0, **header)


def scored(spark: SparkSession, config: Mapping[str, Any], c: Mapping[str, Any]) -> DataFrame:
    """(ids, score or scores, label, is_training) of a model's examples."""
    model, ids = config[c["model_config"]], _ids(c)
    long, labels = prepared(_examples(spark, c), config, model, ids)
    header, records = store.load(spark, model["model_output"])
    kind = header["model_type"]
    side = sampling.is_training(*map(F.col, ids), fraction=float(c.get("training_fraction", 0.9373)))
    if kind not in MANY:
        scores = scoring.complete(raw_scores(long, header, records, ids), labels, ids)
        if c.get("is_probability", True):
            scores = scores.withColumn("raw", F.col("score")).withColumn("score", scoring.platt(F.col("score"), header.get("offset", 0.0), header.get("slope", 1.0)))
        return scores.join(labels, ids).withColumn("is_training", side)
    rows = scoring.with_softmax(label_scores(long, header, records, ids), ids)
    packed = rows.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("label", "probability"))).alias("scores"))
    return packed.join(labels.select(*ids, F.create_map("label", F.lit(1.0)).alias("labels")), ids).withColumn("is_training", side)


def metrics(records: DataFrame, ids: list[str], bins: int = 100, metric: str = "F1") -> dict[str, float]:
    """All metrics of a table of records by name; at most a few hundred numbers reach the driver."""
    out: dict[str, float] = {}
    if "scores" in records.columns:
        return {f"{r['side']}_{r['metric']}": r["value"] for r in evaluation.multiclass(records, ids).collect()}
    table = evaluation.derived(evaluation.confusion(records, bins)).cache()
    best = evaluation.best_threshold(table, metric).first() or evaluation.best_threshold(table, metric, "TRAIN").first()
    for r in table.where(F.col("threshold") == best["threshold"]).collect():
        out |= {f"!{r['side']}_{k}": float(r[k]) for k in ("TP", "FP", "TN", "FN", "ACC", "FPR", "RECALL", "PRECISION", "F1")}
    out["BEST_THRESHOLD"] = float(best["threshold"])
    for frame in (evaluation.auc_folds(records, ids), evaluation.pr_auc(records), evaluation.classification_error(records)):
        for r in frame.collect():
            out |= {f"!{r['side']}_{k}": float(v) for k, v in r.asDict().items() if k != "side" and v is not None}
    return out


@job("GenericEvalModel", "GenericEvalModelCalibrated")
def eval_model(spark: SparkSession, config: Mapping[str, Any]) -> dict[str, float]:
    c = config["eval_model"]
    found = metrics(scored(spark, config, c).cache(), _ids(c), int(c.get("num_bins", 100)), c.get("metric_to_maximize", "F1"))
    if c.get("output"):
        spark.createDataFrame([(sinks.metrics_json(found),)], "value string").coalesce(1).write.mode("overwrite").text(c["output"])
    return found


@job("GenericCalibrateModel")
def calibrate_model(spark: SparkSession, config: Mapping[str, Any]) -> tuple[float, float]:
    """Fit offset and slope on training records; offset 0 and slope 1 stay where they are no better calibrated."""
    c = config["calibrate_model"]
    rows = scored(spark, config, {**c, "is_probability": False}).where("is_training").cache()
    offset, slope = evaluation.platt_fit(rows)
    error = lambda a, b: evaluation.calibration_error(rows.withColumn("score", scoring.platt(F.col("score"), a, b))).first()[0]
    if error(offset, slope) > error(0.0, 1.0):
        offset, slope = 0.0, 1.0
    source = config[c["model_config"]]["model_output"]
    header, records = store.load(spark, source)
    store.save(records, c["calibrated_model_output"], header["model_type"], mode="overwrite", **{**header, "offset": offset, "slope": slope})
    return offset, slope


@job("GenericDumpModel", "DumpModelToHive")
def dump_model(spark: SparkSession, config: Mapping[str, Any]) -> None:
    c = config["dump_model"]
    header, records = store.load(spark, c["model_output"])
    if header["model_type"] in ("additive", "spline"):
        records = store.with_smoothing_errors(records)
    if c.get("table"):
        sinks.save_table(records, c["table"])
    else:
        store.dump_tsv(records, c["model_dump"], "overwrite")


@job("GenericDumpForest")
def dump_forest(spark: SparkSession, config: Mapping[str, Any]) -> str:
    """A forest's trees in graphviz's language."""
    c = config["dump_forest"]
    return store.forest_dot(read_trees(store.load(spark, c["model_output"])[1]))


@job("GenericDumpFullRankLinearModel")
def dump_full_rank(spark: SparkSession, config: Mapping[str, Any]) -> None:
    c = config["dump_full_rank"]
    _, records = store.load(spark, c["model_output"])
    sinks.top_weights(records, int(c.get("features_per_label", 10))).write.mode("overwrite").option("sep", "\t").csv(c["model_dump"])


@job("GenericScoreTable")
def score_table(spark: SparkSession, config: Mapping[str, Any]) -> None:
    """Score what a query selects; its last column has to be UNIQUE_ID."""
    c = config["score_table"]
    rows = scans.run_script(spark, c["query"])
    if rows.columns[-1] != "UNIQUE_ID":
        raise ValueError("the last column has to be UNIQUE_ID")
    from tessella.features import ingest

    fs = _transformed(ingest(rows, ["UNIQUE_ID"]), config, config[c["model_config"]].get("transforms"))
    header, records = store.load(spark, config[c["model_config"]]["model_output"])
    long = flatten(fs, ["UNIQUE_ID"], skip=[LABEL])
    if header["model_type"] not in MANY:
        s = scoring.complete(raw_scores(long, header, records, ["UNIQUE_ID"]), fs.df, ["UNIQUE_ID"])
        s = scoring.with_probability(s, header.get("offset", 0.0), header.get("slope", 1.0))
    else:
        s = scoring.with_softmax(label_scores(long, header, records, ["UNIQUE_ID"]), ["UNIQUE_ID"])
    sinks.save_scores(s, c["output"], ["UNIQUE_ID"])


@job("GenericDebugScores")
def debug_scores(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    c = config["debug_scores"]
    model, ids = config[c["model_config"]], _ids(c)
    long, _ = prepared(_examples(spark, c), config, model, ids)
    header, records = store.load(spark, model["model_output"])
    return scoring.explain(long, records, ids, header["model_type"], int(c.get("count", 15)))


@job("GenericParamSearch")
def param_search(spark: SparkSession, config: Mapping[str, Any]) -> dict[str, Any]:
    """Train and evaluate each set of options; the best model is copied to ``output``."""
    c = config["param_search"]
    tries = search.guided(c["choices"], int(c["max_round"])) if c.get("choices") else search.grid({k: tuple(v) for k, v in c["ranges"].items()}, int(c["max_round"]))
    best: tuple[float, dict, str] | None = None
    name = config["train_model"]["model_config"]
    for i, options in enumerate(tries):
        path = f"{c['model_prefix']}/{i}"
        now = merged(config, {name: {"options": options, "model_output": path}})
        train_model(spark, now)
        value = eval_model(spark, merged(now, {"eval_model": {"output": None}})).get(c["metric"], float("-inf"))
        if best is None or value > best[0]:
            best = (value, options, path)
    header, records = store.load(spark, best[2])
    store.save(records, c["output"], header.pop("model_type"), mode="overwrite", **header)
    return {"value": best[0], "options": best[1]}


@job("NDTreeBuildFeatureMap")
def build_feature_map(spark: SparkSession, config: Mapping[str, Any]) -> None:
    c = config["make_feature_map"]
    spatial.feature_map(flatten(_examples(spark, c), _ids(c), skip=[LABEL]), **dict(c.get("options", {}))).write.mode("overwrite").parquet(c["output"])


@job("ConvertExampleToPhotonMLAvro")
def convert_examples(spark: SparkSession, config: Mapping[str, Any]) -> None:
    c = config["convert_examples"]
    fs = _transformed(_examples(spark, c), config, c.get("model_config"))
    sinks.name_term_value(fs, _ids(c)[0], fs.floats(c.get("rank_key", LABEL))[""]).write.mode("overwrite").parquet(c["output"])


def run(spark: SparkSession, config: Mapping[str, Any], names: list[str] | None = None) -> dict[str, Any]:
    """Run jobs in order; unknown names are logged and passed over, failures go up."""
    config, out = expand(config), {}
    for n in names or config.get("jobs", []):
        if n not in JOBS:
            log.error("no job is called %s", n)
            continue
        out[n] = JOBS[n](spark, config)
    return out


def main(args: list[str]) -> int:
    with open(args[0], encoding="utf-8") as f:
        config = parse(f.read())
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    try:
        run(spark, config, args[1].split(",") if len(args) > 1 else None)
    except Exception:
        log.exception("a job failed")
        return 1
    return 0


if __name__ == "__main__":
    if not shutil.which("java"):
        log.warning("java isn't on the path")
    sys.exit(main(sys.argv[1:]))
