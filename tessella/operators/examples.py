"""Examples as sparse rows in Arrow batches: features become indexes within their row, all rows of an example meet by one
shuffle, and what is computed of an example needs no join with its features any more.

Rows are in the packed layout (``features.packed``) or in the long one, whose rows count as packed rows of one feature.
An example's rows are added up, as everything here is linear in an example's features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.features import ITEMS, unpacked

KEY = ["family", "feature"]
#: Names of features, which travel in closures.
MAX_NAMES = 1_000_000
#: Of an example that isn't complete yet at most so many entries are held before they are added up by feature.
HELD = 1 << 16


def long_of(rows: DataFrame, ids: list[str]) -> DataFrame:
    return unpacked(rows, ids) if ITEMS in rows.columns else rows


def packed_of(rows: DataFrame, ids: list[str]) -> DataFrame:
    if ITEMS in rows.columns:
        return rows.select(*ids, ITEMS)
    value = F.col("value").cast("double") if "value" in rows.columns else F.lit(1.0)
    return rows.select(*ids, F.array(F.struct(*KEY, value.alias("value"))).alias(ITEMS))


def names_of(*tables: DataFrame, most: int = MAX_NAMES) -> list[tuple[str, str]] | None:
    """The different (family, feature) of long tables; None if they are more than ``most``."""
    found = tables[0].select(*KEY).distinct()
    for t in tables[1:]:
        found = found.unionByName(t.select(*KEY)).distinct()
    rows = found.dropna().limit(most + 1).collect()
    return None if len(rows) > most else sorted((r["family"], r["feature"]) for r in rows)


class Names:
    """The position of each (family, feature) in a list, -1 for others, for whole Arrow arrays."""

    def __init__(self, names: Sequence[tuple[str, str]]):
        family, feature = pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string())
        self.families, self.features = family.unique(), feature.unique()
        code = self._code(family, feature)
        self.order = np.argsort(code)
        self.code = code[self.order]

    def _code(self, family: pa.Array, feature: pa.Array) -> np.ndarray:
        at = lambda a, known: pc.fill_null(pc.index_in(a.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = at(family, self.families), at(feature, self.features)
        return np.where((a < 0) | (b < 0), -1, a * len(self.features) + b)

    def __call__(self, family: pa.Array, feature: pa.Array) -> np.ndarray:
        code = self._code(family, feature)
        if not len(self.code):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.order[at], -1)


def indexed(rows: DataFrame, ids: list[str], names: Names, scaled: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda at, x: x) -> DataFrame:
    """(ids, indices, values) for every row, without a shuffle; features that ``names`` lacks are dropped. ``scaled`` makes
    values from positions and values."""
    rows = packed_of(rows, ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(len(ids))
            family, feature, value = items.flatten().flatten()
            at = names(family, feature)
            keep = at >= 0
            parents = pc.list_parent_indices(items).to_numpy(zero_copy_only=False)[keep]
            null = value.is_null().to_numpy(zero_copy_only=False)[keep]
            x = scaled(at[keep], value.fill_null(0.0).to_numpy(zero_copy_only=False)[keep])
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(parents, minlength=b.num_rows)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(at[keep].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x, pa.float64(), mask=null))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], *lists], names=[*ids, "indices", "values"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*ids).schema.fields)
    return rows.mapInArrow(work, f"{kinds}, indices array<int>, values array<double>")


def placed(parts: Sequence[DataFrame], ids: list[str]) -> DataFrame:
    """Tables (ids, indices, values) as one with column kind, their number, in which an example's rows follow each other. Rows
    with a null id are no example's, as in a join."""
    rows = None
    for kind, p in enumerate(parts):
        p = p.dropna(subset=ids).select(*ids, F.lit(kind).alias("kind"), "indices", "values")
        rows = p if rows is None else rows.unionByName(p)
    return rows.repartition(*ids).sortWithinPartitions(*ids)


def examples(batches: Iterator[pa.RecordBatch], n_ids: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole examples of a partition of ``placed``: how many, and kind, example, index and value of their entries. Null values
    are left out."""
    held, last = None, None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new, columns = np.zeros(n, bool), b.columns[:n_ids]
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = held is not None and [c[0].as_py() for c in columns] != last
        group, last = np.cumsum(new), [c[n - 1].as_py() for c in columns]
        lists, values = b.column(n_ids + 1), b.column(n_ids + 2).flatten()
        keep = values.is_valid().to_numpy(zero_copy_only=False)
        parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[keep]
        now = [b.column(n_ids).to_numpy(zero_copy_only=False)[parents], group[parents], lists.flatten().to_numpy(zero_copy_only=False)[keep], values.fill_null(0.0).to_numpy(zero_copy_only=False)[keep]]
        if held is not None:
            now = [np.concatenate(p) for p in zip(held, now, strict=True)]
        whole, done = now[1] < group[-1], int(group[-1])
        if done:
            yield done, *[a[whole] for a in now]
        held = [a[~whole] for a in now]
        held[1] = np.zeros_like(held[1])
        if len(held[0]) > HELD:
            key, inverse = np.unique(held[0].astype(np.int64) << 32 | held[2], return_inverse=True)
            held = [(key >> 32).astype(held[0].dtype), np.zeros(len(key), held[1].dtype), (key & 0xFFFFFFFF).astype(held[2].dtype), np.bincount(inverse, weights=held[3])]
    if held is not None:
        yield 1, *held


def sums_by(n: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bincount(at, weights=x, minlength=n)
