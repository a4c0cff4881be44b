"""Exact nearest neighbours of queries among all rows, by tiles of queries and shards of candidates.

The work is the product of both by nature, so it is only spread and kept small in memory: a task holds one tile of queries
and streams one shard of candidates past it in the order of their ids. Only those that beat a query's k-th best so far are
looked at; on equal scores the smaller id is there first. Nothing is broadcast and no pair is ever a row: what is shuffled is
every query once a shard, every candidate once a tile, and k rows a query and shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FAN = 64


class Best:
    """Of n queries the k best candidates so far, in order. ``add`` takes candidates in the order of ids."""

    def __init__(self, n: int, k: int, floor: float):
        self.k, self.scores, self.others = k, np.full((n, k), floor), np.full((n, k), -1, np.int64)

    @property
    def least(self) -> np.ndarray:
        """A candidate has to score above this."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        r = np.concatenate((np.repeat(touched, self.k), rows))
        s = np.concatenate((self.scores[touched].ravel(), scores.astype(float)))
        o = np.concatenate((self.others[touched].ravel(), others))
        order = np.lexsort((-s, r))  # stable: earlier ones, with smaller ids, stay first
        pick = order[np.searchsorted(r[order], touched)[:, None] + np.arange(self.k)]
        self.scores[touched], self.others[touched] = s[pick], o[pick]


class Kernel:
    """Sums of the smaller components, added in order of the components, as a fold over the array does."""

    floor, block = -np.inf, (128, 512)

    def __init__(self, vectors: pa.Array):
        self.q = self.columns(vectors)

    @staticmethod
    def columns(vectors: pa.Array) -> np.ndarray:
        return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).T)

    def __call__(self, vectors: pa.Array, own: list[tuple[int, int]], best: Best, start: int) -> None:
        v, (rows, columns) = self.columns(vectors), self.block
        total, part = np.empty(self.block), np.empty(self.block)
        for b in range(0, v.shape[1], columns):
            right = v[:, b : b + columns]
            for a in range(0, self.q.shape[1], rows):
                left = self.q[:, a : a + rows]
                t, p = (m[: left.shape[1], : right.shape[1]] for m in (total, part))
                t[:] = 0.0
                for x, y in zip(left, right, strict=True):
                    np.minimum(x[:, None], y, out=p)
                    t += p
                for i, j in own:
                    if a <= i < a + rows and b <= j < b + columns:
                        t[i - a, j - b] = -np.inf
                r, c = np.nonzero(t > best.least[a : a + rows, None])
                best.add(r + a, c + b + start, t[r, c])


class Overlap:
    """Numbers of shared tokens. A token that many of the tile's queries hold adds a row of ones, others add to those that
    hold it; rows of ones take at most DENSE bytes for each token of the tile."""

    floor, DENSE, STEP = 0.0, 16, 1 << 22

    def __init__(self, tokens: pa.Array):
        flat = tokens.flatten()
        self.n, self.names = len(tokens), pc.unique(flat)
        row = np.repeat(np.arange(self.n), tokens.value_lengths().to_numpy(zero_copy_only=False))
        code = pc.index_in(flat, value_set=self.names).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        lists = np.split(row[order], np.cumsum(np.bincount(code, minlength=len(self.names)))[:-1]) if len(self.names) else []
        most = int(tokens.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
        self.kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32
        self.held: list[tuple[bool, np.ndarray]] = []
        for at in lists:
            if dense := len(at) * self.DENSE >= self.n:
                ones = np.zeros(self.n, self.kind)
                ones[at] = 1
                at = ones
            self.held.append((dense, at))

    def __call__(self, tokens: pa.Array, own: list[tuple[int, int]], best: Best, start: int) -> None:
        ends = np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))))
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.names), -1).to_numpy(zero_copy_only=False)
        step = max(1, self.STEP // max(1, self.n))
        counts = np.empty((step, self.n), self.kind)
        for a in range(0, len(tokens), step):
            now = counts[: min(step, len(tokens) - a)]
            now[:] = 0
            for i, row in enumerate(now, a):
                for c in code[ends[i] : ends[i + 1]]:
                    if c >= 0:
                        dense, at = self.held[c]
                        if dense:
                            np.add(row, at, out=row)
                        else:
                            row[at] += 1
            for i, j in own:
                if a <= j < a + len(now):
                    now[j - a, i] = 0
            j, i = np.nonzero(now > best.least.astype(self.kind))
            best.add(i, j + a + start, now[j, i])


def _search(scorer: type, k: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(ids: pa.Array, seen: list[pa.Array], best: Best | None, shard: int) -> Iterator[pa.RecordBatch]:
        if best is not None:
            row, column = np.nonzero(best.others >= 0)
            others = pa.chunked_array(seen, type=id_type).take(pa.array(best.others[row, column]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), others.combine_chunks() if isinstance(others, pa.ChunkedArray) else others, pa.array(best.scores[row, column]), pa.array(np.full(len(row), shard), pa.int32())], ["id", "other", "score", "shard"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tile, shard, candidate, id, what) come sorted by tile, shard, candidate and id: queries go first."""
        key, asked, ids, tile, best, seen, start, place = None, [], None, None, None, [], 0, {}
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *now, is_candidate = at[a].tolist()
                if now != key:
                    yield from lists(ids, seen, best, key[1] if key else 0)
                    key, asked, ids, tile, best, seen, start, place = now, [], None, None, None, [], 0, {}
                part = batch.slice(a, b - a)
                if not is_candidate:
                    asked.append(part)
                    continue
                if best is None:
                    if not asked:
                        continue
                    held = pa.Table.from_batches(asked).combine_chunks()
                    ids, asked = held.column(3).combine_chunks(), []
                    tile, best = scorer(held.column(4).combine_chunks()), Best(len(ids), k, scorer.floor)
                    for i, x in enumerate(ids.to_pylist()):
                        place.setdefault(x, []).append(i)
                mine = np.flatnonzero(pc.is_in(part.column(3), value_set=ids).to_numpy(zero_copy_only=False))
                own = [(i, int(j)) for j in mine for i in place[part.column(3)[int(j)].as_py()]]
                tile(part.column(4), own, best, start)
                seen.append(part.column(3))
                start += len(part)
        yield from lists(ids, seen, best, key[1] if key else 0)

    return work


def merged(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    """(id, keys, best): the k best of every id, by falling score (NaN is the largest, null the least), then smaller id."""
    entry = F.struct(F.col("score").isNull().alias("none"), (~F.coalesce(F.isnan("score"), F.lit(False))).alias("less"), (-F.col("score")).alias("worst"), "other", "score")
    return lists.groupBy("id", *keys).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))


def search(queries: DataFrame, rows: DataFrame, k: int, scorer: type, sizes: tuple[int, int], tile: int, shard: int) -> DataFrame:
    """(id, other, score, shard): candidates for the k best of every query (id, what) among rows (id, what) of other ids; the k
    best in each shard. ``sizes`` is about how many queries and rows there are."""
    spark = rows.sparkSession
    tiles = max(1, -(-sizes[0] // tile))
    shards = max(min(sizes[1], max(16, 2 * spark.sparkContext.defaultParallelism // tiles)), -(-sizes[1] // shard), 1)
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(m)).cast("int")
    asked = queries.where("id IS NOT NULL").select(dealt(1, tiles).alias("tile"), upto(shards).alias("shard"), F.lit(0).alias("candidate"), "id", "what")
    held = rows.where("id IS NOT NULL").select(upto(tiles).alias("tile"), dealt(2, shards).alias("shard"), F.lit(1).alias("candidate"), "id", "what")
    both = asked.unionByName(held).repartition(tiles * shards, "tile", "shard").sortWithinPartitions("tile", "shard", "candidate", "id")
    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("other", id_type), T.StructField("score", T.DoubleType()), T.StructField("shard", T.IntegerType())])
    lists = both.mapInArrow(_search(scorer, k, to_arrow_type(id_type)), out)
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = merged(lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")), k, "shard").select("id", F.explode("best").alias("x"), "shard")
        lists = lists.select("id", "x.other", "x.score", "shard")
    return lists
