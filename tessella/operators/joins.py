"""Keyed joins, nearest neighbours and tree queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import min_kernel
from tessella.operators import nearest


#: A table of at most so many rows is broadcast by ``lookup``; a key with more than 1/HOT_SHARE of all rows is hot.
BROADCAST_ROWS, HOT_SHARE = 200_000, 200


def lookup(rows: DataFrame, keyed: DataFrame, on: Sequence[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of many rows with a table of few rows a key, such as a model's weights.

    The table is kept and counted. With at most ``most`` rows it is broadcast, so the rows stay where they are. Beyond
    that the entries of hot keys (at most HOT_SHARE keys) are broadcast, and all other rows take a shuffled join."""
    on, keyed = list(on), keyed.persist()
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), on)
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > max(64, rows.count() // HOT_SHARE)).select(*on)
    first = rows.join(F.broadcast(keyed.join(F.broadcast(hot), on, "left_semi")), on)
    return first.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(keyed, on))


def with_defaults(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict) -> DataFrame:
    """Left join whose missing values take defaults: samples with previous parameters or per-key options."""
    return left.join(right, list(on), "left").fillna(defaults, subset=[c for c in defaults if c in right.columns])


def keep_best(last: DataFrame, current: DataFrame, key: str, loss: str) -> DataFrame:
    """Of two tables of parameters the row with the least loss of every key; ties keep the last one's."""
    both = last.withColumn("_new", F.lit(0)).unionByName(current.withColumn("_new", F.lit(1)))
    rest = [c for c in last.columns if c not in (key, loss)]
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col("_new"), F.struct(*rest).alias("rest")))
    return both.groupBy(key).agg(best.alias("b")).select(key, F.col("b.loss").alias(loss), "b.rest.*").select(*last.columns)


def group_samples(df: DataFrame, key: str) -> DataFrame:
    """(key, samples): every key's rows as an array; for keys of bounded size."""
    return df.groupBy(key).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias("samples"))


def top_k(df: DataFrame, k: int, by: Column, *ties: str) -> DataFrame:
    """Global top k by descending value (TakeOrdered: k rows a partition, then k in all)."""
    return df.orderBy(by.desc(), *ties).limit(k)


def top_k_per(df: DataFrame, key: str, k: int, by: Column, *ties: str) -> DataFrame:
    """Per-key top k with its rank; Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(by.desc(), *ties))).where(F.col("rank") <= k)


def nearest_by_overlap(tokens: DataFrame, k: int, shard: int = 100_000, asked: Column | None = None, tile: int = 1 << 16) -> DataFrame:
    """(id, other, shared, rank) from (id, token): the k ids that share most tokens, for every id or those ``asked``; ids that
    share none aren't listed. Tiles of ``tile`` queries count, exactly, what they share with shards of ``shard`` ids
    (``nearest.search``), so no pair is a row of a shuffle, however many ids hold a token."""
    t = tokens.select("id", "token").where("id IS NOT NULL AND token IS NOT NULL")
    sets = t.groupBy("id").agg(F.collect_set("token").alias("what"))
    sizes = t.agg(F.approx_count_distinct("id" if asked is None else F.when(asked, F.col("id"))), F.approx_count_distinct("id")).first()
    lists = nearest.search(sets if asked is None else sets.where(asked), sets, k, nearest.Overlap, tuple(sizes), tile, shard)
    best = nearest.merged(lists, k).select("id", F.posexplode("best").alias("i", "x"))
    return best.select("id", F.col("x.other").alias("other"), F.col("x.score").cast("long").alias("shared"), (F.col("i") + 1).alias("rank"))


def _kernel_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, blocks: int) -> DataFrame:
    """(id, other, score): each block's best k of every query, by expressions that take any vectors."""
    q = queries.select("id", F.col("vec").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    v = vectors.select(F.col("id").alias("other"), "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    scored = q.join(v, "block").where("id <> other").select("id", "block", "other", min_kernel(F.col("q"), F.col("vec")).alias("score"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("id", "block").orderBy(F.col("score").desc(), "other")))
    return best.where(F.col("n") <= k).select("id", "other", "score")


def nearest_by_min_kernel(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 32_768, tile: int = 8192) -> DataFrame:
    """(id, other, similarity, rank) from (id, vec): the k most similar vectors of every query by histogram
    intersection, itself left out. Vectors of the commonest length without null or non-finite components meet in tiles of
    queries and shards of ``block_rows`` (``nearest.search``); pairs with any other vector are scored by expressions."""
    plain = F.coalesce(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.col("id").isNotNull()
    mark = lambda df: df.select("id", "vec", F.when(plain, F.size("vec")).otherwise(-1).alias("_dim"))
    v, q = mark(vectors), mark(queries)
    rows, asked = ({r["_dim"]: r["count"] for r in df.groupBy("_dim").count().collect()} for df in (v, q))
    dim = max((n, d) for d, n in {0: 0, **rows}.items() if d >= 0)[1]
    same = F.col("_dim") == dim
    what = lambda df: df.where(same).select("id", F.col("vec").cast("array<double>").alias("what"))
    lists = nearest.search(what(q), what(v), k, nearest.Kernel, (asked.get(dim, 0), rows.get(dim, 0)), tile, block_rows).drop("shard")
    odd = lambda n: max(16, -(-n // block_rows))
    if set(asked) - {dim}:
        lists = lists.unionByName(_kernel_by_blocks(q.where(~same), v, k, odd(sum(rows.values()))))
    if set(rows) - {dim}:
        lists = lists.unionByName(_kernel_by_blocks(q.where(same), v.where(~same), k, odd(sum(rows.values()) - rows.get(dim, 0))))
    best = nearest.merged(lists, k).select("id", F.posexplode("best").alias("i", "x"))
    return best.select("id", F.col("x.other").alias("other"), F.col("x.score").alias("similarity"), (F.col("i") + 1).alias("rank"))


def box_query(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (px, py) within boxes (x0, x1, y0, y1, both ends included), as an equi-join on grid cells of a given width:
    a range join without a product."""
    at = lambda c: F.floor(F.col(c) / cell)
    b = boxes.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    p = points.withColumns({"_cx": at("px"), "_cy": at("py")})
    return p.join(b, ["_cx", "_cy"]).where("px >= x0 AND px <= x1 AND py >= y0 AND py <= y1").drop("_cx", "_cy")


def classes_of(rows: DataFrame, ids: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows alike in ``by``: (rows with _class, classes). A class is (_class, c_<id> for every id, _n): a struct of its
    values (nulls alike), its first row by ``ids`` as representative, and how many rows it has. The ids' minima are found one
    after the other, as hashed sums of numbers are combined before the shuffle and minima of structs would be sorted."""
    rows = rows.withColumn("_class", F.struct(*by))
    classes = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"), F.min(ids[0]).alias(f"c_{ids[0]}"))
    for i, name in enumerate(ids[1:], 1):
        first = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in ids[:i]]
        tied = lookup(rows.select("_class", *ids), classes, ["_class"])
        for c in first:
            tied = tied.where(c)
        classes = tied.groupBy("_class", "_n", *[f"c_{c}" for c in ids[:i]]).agg(F.min(name).alias(f"c_{name}"))
    return rows, classes


def box_links(points: DataFrame, ids: list[str], boxes: DataFrame, box_ids: list[str], cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``box_query`` finds, without a row for every pair: the number of pairs is the product of equal points and equal
    boxes. Three tables:

    * every point (ids, c_<id>: its class's representative, links: the boxes that hold it),
    * every box (box_ids, c_<id>, links: the points in it),
    * every pair of representatives (c_<id> of both, links: the pairs it stands for).

    Points with the same coordinates, and boxes with the same ends, are classes; a point is in a box exactly where their
    representatives are a pair. Only the classes meet in the grid."""
    p, pc = classes_of(points, ids, ["px", "py"])
    b, bc = classes_of(boxes, box_ids, ["x0", "x1", "y0", "y1"])
    pc, bc = pc.persist(), bc.persist()
    at = pc.withColumnsRenamed({"_class": "_p", "_n": "_np"}).withColumns({"px": F.col("_p.px"), "py": F.col("_p.py")})
    of = bc.withColumnsRenamed({"_class": "_b", "_n": "_nb"}).withColumns({c: F.col(f"_b.{c}") for c in ("x0", "x1", "y0", "y1")})
    pairs = box_query(at, of, cell).persist()
    counts = lambda side, n: pairs.groupBy(F.col(side).alias("_class")).agg(F.sum(n).alias("links"))

    def members(rows: DataFrame, names: list[str], classes: DataFrame, links: DataFrame) -> DataFrame:
        known = classes.join(links.select(F.col("_class").alias("_k"), "links"), F.col("_class") == F.col("_k"), "left").fillna(0, ["links"])
        return lookup(rows.select(*names, "_class"), known.drop("_k", "_n"), ["_class"]).select(*names, *[f"c_{c}" for c in names], "links")

    of_pairs = pairs.select(*[f"c_{c}" for c in (*ids, *box_ids)], (F.col("_np") * F.col("_nb")).alias("links"))
    return members(p, ids, pc, counts("_p", "_nb")), members(b, box_ids, bc, counts("_b", "_np")), of_pairs


def overlapping(nodes: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """kd-tree nodes (min_x, max_x, min_y, max_y) that a box meets."""
    return nodes.where((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))


def ranking_pairs(items: DataFrame, example: str, item: str, rank: str, seed: int = 0) -> DataFrame:
    """For every example and every pair of ranks a < b one item of each, drawn by a hash."""
    pick = F.min_by(F.col(item), F.xxhash64(F.lit(seed), F.col(item)))
    drawn = items.groupBy(example, F.col(rank).cast("int").alias("rank")).agg(pick.alias("item"))
    a = drawn.select(example, F.col("rank").alias("rank_a"), F.col("item").alias("item_a"))
    return a.join(drawn.select(example, F.col("rank").alias("rank_b"), F.col("item").alias("item_b")), example).where("rank_a < rank_b")


def pair_difference(a: Column, b: Column) -> tuple[Column, Column]:
    """The features that only one of two items has, for each."""
    return F.array_except(a, b), F.array_except(b, a)
