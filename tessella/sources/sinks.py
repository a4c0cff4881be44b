"""Writing: features, scores, metrics and exports. Spark's committers make every write appear whole or not at all."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.features import BIAS, LABEL, MISS, FeatureSet
from tessella.functions.scalar import no_floats, no_strings


def save_features(fs: FeatureSet, path: str, shards: int | None = None, mode: str = "errorifexists") -> None:
    df = fs.df.repartition(shards) if shards else fs.df
    df.write.mode(mode).parquet(path)


def save_if_missing(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def save_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace just the partitions that the rows belong to."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def save_table(df: DataFrame, name: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def add_partition(spark: SparkSession, table: str, spec: Mapping[str, str], location: str) -> None:
    """Point a table's partition at a folder, in place of what it was."""
    said = ", ".join(f"{k}='{v}'" for k, v in spec.items())
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({said})")
    spark.sql(f"ALTER TABLE {table} ADD PARTITION ({said}) LOCATION '{location}'")


def save_scores(scores: DataFrame, path: str, ids: Sequence[str], mode: str = "overwrite") -> None:
    """id, label where there are several, score and probability, tab-separated."""
    columns = [*ids, *[c for c in ("label", "score", "probability") if c in scores.columns]]
    scores.select(*columns).write.mode(mode).option("sep", "\t").csv(path)


def metrics_json(metrics: Mapping[str, float], curves: Mapping[str, Sequence[tuple[float, float, float]]] | None = None) -> str:
    """Metrics (a leading ! goes, NaN is skipped) and for TRAIN and HOLD arrays of threshold, precision and recall."""
    out: dict[str, Any] = {k.lstrip("!"): v for k, v in metrics.items() if not math.isnan(v)}
    for side, points in (curves or {}).items():
        for i, name in enumerate(("THRESHOLDS", "PRECISIONS", "RECALLS")):
            out[f"{side}_{name}"] = [p[i] for p in points]
    return json.dumps(out, sort_keys=True)


def _terms(family: str, floats: Column | None, strings: Column | None) -> Column:
    item = lambda name, term, value: F.struct(name.alias("name"), term.alias("term"), value.cast("double").alias("value"))
    parts = []
    if strings is not None:
        parts.append(F.transform(F.coalesce(strings, no_strings()), lambda s: item(F.lit(family), s, F.lit(1.0))))
    if floats is not None:
        parts.append(F.transform(F.map_entries(F.coalesce(floats, no_floats())), lambda e: item(F.lit(family), e["key"], e["value"])))
    return F.concat(*parts)


EXCLUDED = {BIAS.lower(), MISS.lower(), LABEL.lower(), "default_string"}


def name_term_value(fs: FeatureSet, uid: str, label: Column, metadata: Column | None = None) -> DataFrame:
    """uid, response (1 above 0), metadataMap, features[{name, term, value}] and an array for every family: the record
    form of generalised linear mixed trainers. Written as Parquet or, where its package is there, as Avro."""
    families = [f for f in dict.fromkeys([*fs.string_families, *fs.float_families]) if f.lower() not in EXCLUDED]
    columns = {f: _terms(f, fs.floats(f) if f in fs.float_families else None, fs.strings(f) if f in fs.string_families else None) for f in families}

    def of_dense(d: str) -> Column:
        values = F.coalesce(fs.dense(d), F.array().cast("array<double>"))
        return F.transform(values, lambda x, i: F.struct(F.lit(d).alias("name"), i.cast("string").alias("term"), x.alias("value")))

    dense = {d: of_dense(d) for d in fs.dense_names}
    every = F.concat(*columns.values(), *dense.values())
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    return fs.df.select(F.col(uid).cast("string").alias("uid"), F.when(label > 0, 1.0).otherwise(0.0).alias("response"), meta.alias("metadataMap"), every.alias("features"), *[c.alias(f) for f, c in {**columns, **dense}.items()])


def top_weights(weights: DataFrame, k: int) -> DataFrame:
    """Of a full-rank model every label's k largest weights."""
    from tessella.operators.joins import top_k_per

    return top_k_per(weights, "label", k, F.col("weight"), "family", "feature")
