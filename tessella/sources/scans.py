"""Reading: SQL scripts, delimited files, stored features, records of metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.features import FeatureSet, ingest


def statements(script: str) -> list[str]:
    """A script's statements; a semicolon within quotes or a comment doesn't end one."""
    out, now, quote, i = [], [], "", 0
    while i < len(script):
        c = script[i]
        if quote:
            quote = "" if c == quote and script[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else len(script)
            continue
        elif c == ";":
            out.append("".join(now))
            now = []
            i += 1
            continue
        now.append(c)
        i += 1
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def run_script(spark: SparkSession, script: str) -> DataFrame:
    """Run all statements in order and return the last one's rows."""
    parts = statements(script)
    if not parts:
        raise ValueError("the script has no statement")
    for s in parts[:-1]:
        spark.sql(s)
    return spark.sql(parts[-1])


def examples(spark: SparkSession, script: str, ids: Sequence[str] = (), multiclass: bool = False) -> FeatureSet:
    """Features from what a script selects."""
    return ingest(run_script(spark, script), ids, multiclass)


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def features(spark: SparkSession, path: str) -> FeatureSet:
    return FeatureSet(spark.read.parquet(path))


def labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) from lines of label, tab, text."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("text")).where("text IS NOT NULL")


def images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Column image (origin, height, width, nChannels, mode, data), decoded by Spark; files that aren't images are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def latest_directory(spark: SparkSession, path: str) -> str | None:
    """The last entry of a folder by name, through Spark's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []
    return found[-1] if found else None


def succeeded(spark: SparkSession, path: str) -> bool:
    """Whether a job ended writing a folder: it has a success marker and nothing temporary."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) and not fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_temporary")))


def last_partition(spark: SparkSession, table: str) -> str | None:
    """The largest partition of a table, as Spark writes it."""
    return spark.sql(f"SHOW PARTITIONS {table}").agg(F.max("partition")).first()[0]
