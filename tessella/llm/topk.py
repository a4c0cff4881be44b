"""Exact top-k search by inner product: tiles of queries against shards of candidates.

Queries are dealt into tiles of at most TILE_BYTES and candidates into shards of SHARD rows. A task holds one tile and
streams one shard past it in Arrow batches: each batch is multiplied with the tile as a matrix, every query's best k of
the batch are selected, and merged with those so far. The lists of the shards are merged FAN at a time in a tree.
Nothing is broadcast; every candidate travels once a tile, every query once a shard.

Components x become floor(256 x), so scores are integers. Products are taken in float32 while every partial sum is below
2^24, in float64 below 2^53, and in Python's integers beyond (scores that exceed a bigint are clamped to it).

Edge cases: vectors that are null or hold a null or non-finite component take no part; so do rows without an id. A
query is compared with the vectors of its own length only, and gets fewer than k rows if there are fewer. Rows are told
apart by a row number, not by id: of rows that repeat an id each is a candidate, and a query of its own with a list of
its own; only the query's very row is no candidate. Ties go to the smaller vec_id. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed

TILE_BYTES = 64 << 20
SHARD = 1 << 17
FAN = 16
STEP = 1 << 21
OUT = "rid long, vec_id long, score long, shard long"
LEAST = np.iinfo(np.int64).min + 1


def integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(256 x) as float64 matrix) for each vector length in an array of lists."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, np.floor(flat[(ends[rows] - dim)[:, None] + np.arange(dim)] * 256.0)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products as int64."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(queries.shape[1], 1)
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return (queries.astype(kind) @ candidates.astype(kind).T).astype(np.int64)
    exact = [[int(x) for x in v] for v in candidates]
    full = [[sum(int(a) * b for a, b in zip(v, w, strict=True)) for w in exact] for v in queries]
    return np.array([[max(LEAST + 1, min(2**63 - 1, s)) for s in r] for r in full], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of every row's k best in order, by falling score, then smaller id; both are rows x columns."""
    k = min(k, scores.shape[1])
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else scores.min(axis=1, keepdims=True)
    most = int((scores >= cut).sum(axis=1).max(initial=0))
    at = np.argsort(scores < cut, axis=1, kind="stable")[:, :most]  # those at the cut or above it come first
    near = np.take_along_axis(scores, at, axis=1)
    order = np.lexsort((np.take_along_axis(ids, at, axis=1), -near), axis=1)[:, :k]
    return np.take_along_axis(at, order, axis=1)


class Tile:
    """The queries of one length, with the best k candidates of each so far."""

    def __init__(self, rids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(rids)
        self.rids, self.vectors, self.k = rids[order], vectors[order], k
        self.scores = np.full((len(rids), k), LEAST, np.int64)
        self.ids = np.full((len(rids), k), np.iinfo(np.int64).max, np.int64)

    def add(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((rids, ids))
        rids, ids, vectors = rids[order], ids[order], vectors[order]
        step = max(1, STEP // max(1, len(rids)))
        for i in range(0, len(self.rids), step):
            scores = products(self.vectors[i : i + step], vectors)
            _, own, column = np.intersect1d(self.rids[i : i + step], rids, return_indices=True)
            scores[own, column] = LEAST
            top = _best(scores, np.broadcast_to(ids, scores.shape), self.k)
            both = np.concatenate((self.scores[i : i + step], np.take_along_axis(scores, top, axis=1)), axis=1)
            named = np.concatenate((self.ids[i : i + step], ids[top]), axis=1)
            top = _best(both, named, self.k)
            self.scores[i : i + step], self.ids[i : i + step] = np.take_along_axis(both, top, axis=1), np.take_along_axis(named, top, axis=1)

    def lists(self, shard: int) -> pa.RecordBatch:
        row, column = np.nonzero(self.scores > LEAST)
        arrays = [self.rids[row], self.ids[row, column], self.scores[row, column], np.full(len(row), shard)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["rid", "vec_id", "score", "shard"])


def _search(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tile, shard, candidate, rid, vec_id, vec) come sorted by tile, shard and candidate: queries go first."""
        now: tuple[int, int] | None = None
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        tiles: dict[int, Tile] = {}
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                tile, shard, is_candidate = place[a].tolist()
                if (tile, shard) != now:
                    for t in tiles.values():
                        yield t.lists(now[1])
                    now, asked, tiles = (tile, shard), {}, {}
                part = batch.slice(a, b - a)
                rids, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                for rows, vectors in integers(part.column(5)):
                    dim = vectors.shape[1]
                    if not is_candidate:
                        asked.setdefault(dim, []).append((rids[rows], vectors))
                        continue
                    if dim in asked:
                        parts = asked.pop(dim)
                        tiles[dim] = Tile(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k)
                    if dim in tiles:
                        tiles[dim].add(rids[rows], ids[rows], vectors)
        for t in tiles.values():
            yield t.lists(now[1])

    return work


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, tile_bytes: int = TILE_BYTES, shard: int = SHARD) -> DataFrame:
    """For every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k best others."""
    good = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(good)
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vec"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    n, asked_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(is_query, F.size("vec") * 8 + 32).cast("long")), F.lit(0))).first()
    tiles, shards = max(1, -(-asked_bytes // tile_bytes)), max(1, -(-n // shard))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    dealt = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(m))
    asked = rows.where(is_query).select(dealt(1, tiles).alias("tile"), upto(shards).alias("shard"), F.lit(0).alias("candidate"), "rid", "vec_id", "vec")
    held = rows.select(upto(tiles).alias("tile"), dealt(2, shards).alias("shard"), F.lit(1).alias("candidate"), "rid", "vec_id", "vec")
    both = asked.unionByName(held).repartition("tile", "shard").sortWithinPartitions("tile", "shard", "candidate")
    lists = checkpointed(both.mapInArrow(_search(k), OUT))

    def merged(part: DataFrame, *keys) -> DataFrame:
        found = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worst"), "vec_id", "score")))
        return part.groupBy("rid", *keys).agg(F.slice(found, 1, k).alias("best"))

    while shards > FAN:
        shards = -(-shards // FAN)
        lists = merged(lists, F.floor(F.col("shard") / FAN).alias("shard")).select("rid", "shard", F.explode("best").alias("x")).select("rid", "shard", "x.vec_id", "x.score")
    last = merged(lists).select("rid", F.posexplode("best").alias("i", "x"))
    names = rows.where(is_query).select("rid", F.col("vec_id").alias("query_id"))
    return last.join(names, "rid").select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
