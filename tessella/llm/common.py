"""Shared plumbing: tables written to the cluster's shared folder, skew-safe lookups, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows; so there are at most HOT_SHARE hot keys,
#: which is the proven bound of every broadcast made here.
HOT_SHARE = 200
#: So many links (16 bytes each) may be joined by one task at the end of a contraction.
FINISH = 1 << 16
#: Bloom filters: bits a row, the most and the least bits, and the bits of one page.
BITS_A_ROW, MAX_BITS, MIN_BITS, PAGE = 16, 1 << 28, 1 << 15, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local master gets a temporary folder where none is named; a cluster
    without one is an error, as a machine's own folder is lost with the machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder and read again, so that lost executors cost nothing that
    is written, columns that nobody reads stay on disk, and the optimizer's sizes are those of the files."""
    path = f"{shared_folder(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body``: a lambda's argument is never inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def skew_lookup(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` (narrow and cheap to read again) with ``keyed``, which has one row a key.

    Rows of hot keys never meet in one task: their few lookup rows (at most HOT_SHARE) are broadcast and the rows
    stay where they are. All other rows take an ordinary shuffled join.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot_keys = counts.where(F.col("_n") > max(64, total // HOT_SHARE)).select(key)
    return _split_join(rows, keyed, hot_keys, key)


def _split_join(rows: DataFrame, keyed: DataFrame, hot_keys: DataFrame, key: str) -> DataFrame:
    if hot_keys.isEmpty():
        return rows.join(keyed, key)
    hot = rows.join(F.broadcast(keyed.join(F.broadcast(hot_keys), key, "left_semi")), key)
    cold = rows.join(F.broadcast(hot_keys), key, "left_anti").join(keyed, key)
    return hot.unionByName(cold)


def _positions(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def bit_filter(hashes: DataFrame, max_bits: int = MAX_BITS, at_least: int = 1) -> tuple[DataFrame, int]:
    """From a table with one bigint column h: the pages (page, bitmap) of a Bloom filter of two positions a hash, set
    where at least ``at_least`` rows have the position, and its number of bits: BITS_A_ROW a row, ``max_bits`` at most."""
    n, bits = hashes.count(), MIN_BITS
    while bits < min(max_bits, n * BITS_A_ROW):
        bits *= 2
    at = hashes.select(F.explode(F.array(*_positions(F.col("h"), bits))).alias("at"))
    if at_least > 1:
        at = at.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    pages = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.expr(f"bitmap_construct_agg(at & {PAGE - 1})").alias("bitmap"))
    return pages, bits


def maybe_in(rows: DataFrame, pages: DataFrame, bits: int, h: str) -> DataFrame:
    """``rows`` with boolean _maybe: false where the hash in column ``h`` certainly isn't in the filter. The pages are
    at most max_bits / 8 bytes, the proven size of their broadcast."""
    out, hits = rows, []
    for k, at in enumerate(_positions(F.col(h), bits)):
        bit = at.bitwiseAND(F.lit(PAGE - 1))
        byte = F.conv(F.hex(F.substring(F.col(f"_map{k}"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10)
        hits.append(F.coalesce(F.getbit(byte.cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)))
        page = pages.select(F.col("page").alias(f"_page{k}"), F.col("bitmap").alias(f"_map{k}"))
        out = out.join(F.broadcast(page), F.shiftright(at, 15) == F.col(f"_page{k}"), "left")
    return out.withColumn("_maybe", hits[0] & hits[1]).drop("_page0", "_map0", "_page1", "_map1")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart by value: the doc_id (0 for null) and whether there is one, and 128 bits of the text."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("_k0"), F.isnull(doc_id).alias("_k1"),
        F.xxhash64(text).alias("_k2"), F.xxhash64(F.lit(1), text).alias("_k3"),
    ]


ROW_KEY = ["_k0", "_k1", "_k2", "_k3"]


def drop_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key (as ``row_key`` gives it) is in ``gone``, and with any one of the rows of each
    key in ``repeated``. All columns stay as they were, whatever their names.

    A Bloom filter of both sets' keys lets every other row pass straight through; only rows that may be in them shuffle."""
    named = checkpointed(gone.select(*ROW_KEY, F.lit(False).alias("_one")).unionByName(repeated.select(*ROW_KEY, F.lit(True).alias("_one"))).distinct())
    pages, bits = bit_filter(named.select(F.col("_k2").alias("h")))
    packed = maybe_in(docs.select(F.struct("*").alias("_row"), *row_key()), pages, bits, "_k2")
    maybe = packed.where("_maybe")
    out = packed.where(~F.col("_maybe")).select("_row").unionByName(maybe.join(named, ROW_KEY, "left_anti").select("_row"))
    if not named.where("_one").isEmpty():
        first = maybe.join(named.where("_one"), ROW_KEY, "left_semi").groupBy(*ROW_KEY).agg(F.first("_row").alias("_row"))
        out = out.unionByName(first.select("_row"))
    return out.select("_row.*")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pick) for every node of the links (a, b) of one task: its component's smallest node, by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "pick"])


def contract(links: DataFrame, finish: int = FINISH) -> list[DataFrame]:
    """The picks (node, pick) of every round of randomised contraction of ``links`` (a, b bigint).

    In each round every node that has links picks the first of itself and its neighbours, in an order that a hash of
    (round, node) gives, and links become links between picks. The expected number of nodes that still have links falls
    to 3/4 a round at most, whatever the graph, so there are O(log nodes) rounds, and all rounds together write a
    multiple of the first one's rows. Once at most ``finish`` links are left, one task joins them in the last round.
    """
    links = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    picks: list[DataFrame] = []
    while n := links.count():
        if n <= finish:
            return [*picks, checkpointed(links.coalesce(1).mapInArrow(_forest, "node long, pick long"))]
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(picks)), c).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        best = ends.groupBy("node").agg(F.min(rank("to")).alias("best"), F.count(F.lit(1)).alias("n"))
        pick = checkpointed(best.select("node", F.least("best", rank("node"))["node"].alias("pick"), "n"))
        hot = pick.where(F.col("n") > max(64, n // HOT_SHARE)).select("node")  # at most 2 x HOT_SHARE, as n counts ends
        for end in ("a", "b"):
            of = pick.select(F.col("node").alias(end), F.col("pick").alias("at"))
            links = _split_join(links, of, hot.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("at", end)
        links = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        picks.append(pick.select("node", "pick"))
    return picks


def components(edges: DataFrame, a: str = "a", b: str = "b", finish: int = FINISH) -> DataFrame:
    """Connected components of an undirected graph given by its links.

    Returns (node, label): every node that occurs in a link to another, with the smallest node of its component. The
    graph is contracted; then the picks are followed from the last round to the first. Nothing is collected; every table
    is written to the shared folder. An empty set of links gives an empty table.
    """
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    picks = contract(links, finish)
    if not picks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
    roots = picks.pop().withColumnRenamed("pick", "root")
    while picks:
        pick = picks.pop().withColumnRenamed("pick", "at")
        root_of = pick.select("at").distinct().join(roots.withColumnRenamed("node", "at"), "at", "left")
        roots = checkpointed(skew_lookup(pick, root_of.select("at", F.coalesce("root", "at").alias("root")), "at").select("node", "root"))
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    return skew_lookup(roots, least, "root").select("node", "label")
