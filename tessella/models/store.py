"""Models on disk: a header row and a table of records, as Parquet; and readable dumps."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.models.functions import smooth

TYPES = ("linear", "additive", "spline", "boosted_stumps", "decision_tree", "forest", "full_rank_linear", "low_rank_linear", "kernel", "maxout", "multilayer_perceptron")
CUSTOM: dict[str, Callable[[dict, DataFrame], Any]] = {}


def model_type(name: str) -> Callable:
    """Register a loader of one's own for a model type."""

    def add(load: Callable[[dict, DataFrame], Any]) -> Callable:
        CUSTOM[name] = load
        return load

    return add


def save(records: DataFrame, path: str, kind: str, mode: str = "errorifexists", **header: Any) -> None:
    if kind not in TYPES and kind not in CUSTOM:
        raise ValueError(f"no model type is called {kind!r}")
    records.write.mode(mode).parquet(f"{path}/records")
    spark = records.sparkSession
    spark.createDataFrame([(kind, json.dumps(header))], "model_type string, header string").coalesce(1).write.mode(mode).parquet(f"{path}/header")


def load(spark: SparkSession, path: str) -> tuple[dict, Any]:
    """(header with model_type, records)."""
    row = spark.read.parquet(f"{path}/header").first()
    header = {"model_type": row["model_type"], **json.loads(row["header"])}
    records = spark.read.parquet(f"{path}/records")
    return header, CUSTOM[row["model_type"]](header, records) if row["model_type"] in CUSTOM else records


def dump_tsv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat = [F.to_json(c).alias(c) if "<" in t else F.col(c) for c, t in records.dtypes]
    records.where("feature IS NOT NULL").select(*flat).write.mode(mode).option("sep", "\t").csv(path)


def with_smoothing_errors(records: DataFrame) -> DataFrame:
    """Records of weight functions with how far each is from its smooth curve: mean absolute error, and that as a share
    of the mean absolute weight."""
    @F.pandas_udf("struct<error:double,error_share:double>")
    def errors(weights: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(smooth(np.asarray(w, float), 0.0)[1], smooth(np.asarray(w, float), 0.0, True)[1]) for w in weights], columns=["error", "error_share"])

    known = records.where("feature IS NOT NULL AND size(weights) > 0").withColumn("_e", errors("weights"))
    return known.select(*records.columns, F.col("_e.error").alias("smoothing_error"), F.col("_e.error_share").alias("smoothing_error_share"))


def tree_dot(nodes: Sequence[Mapping], name: str = "tree") -> str:
    """A tree in graphviz's language."""
    lines = [f"digraph {name} {{"]
    for i, n in enumerate(nodes):
        if "left" in n:
            lines.append(f'  {i} [label="{n["family"]}:{n["feature"]} < {n["threshold"]}"]; {i} -> {n["left"]} [label=yes]; {i} -> {n["right"]} [label=no];')
        else:
            lines.append(f'  {i} [shape=box label="{n.get("name", "")} {n.get("weight", n.get("distribution"))}"];')
    return "\n".join([*lines, "}"])


def forest_dot(trees: Sequence[Sequence[Mapping]]) -> str:
    return "\n".join(tree_dot(t, f"tree{i}") for i, t in enumerate(trees))


def tree_rows(nodes: Sequence[Mapping]) -> list[str]:
    """The text form that ``read_tree`` reads."""
    return [
        f"P,{i},{n['family']},{n['feature']},{n['threshold']},{n['left']},{n['right']}" if "left" in n else f"L,{i},{n['weight']},{n.get('name', f'leaf{i}')}" for i, n in enumerate(nodes)
    ]
