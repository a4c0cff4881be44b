"""kd-trees of two dimensions and trees of n dimensions, from a bounded hashed sample, and the map from features to
their functions' ranges or trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.joins import lookup

SAMPLE = 100_000


def sample_points(df: DataFrame, columns: list[str], size: int = SAMPLE) -> np.ndarray:
    """At most about ``size`` rows, picked by a hash."""
    n = df.count()
    share = min(1.0, size / max(1, n))
    picked = df.select(*columns).dropna().where(F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) < share * (1 << 20))
    return picked.toPandas().to_numpy(float)


def build_kd(points: np.ndarray, max_depth: int = 8, min_leaf: int = 20, tries: int = 10) -> list[dict]:
    """Nodes {type, split, left, right, min_x, max_x, min_y, max_y, count}. The longer side is split where the sum of
    counts times half-perimeters is least among evenly spaced places."""
    nodes: list[dict] = []

    def grow(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append({"type": "leaf", "split": 0.0, "left": -1, "right": -1, "min_x": lo[0], "max_x": hi[0], "min_y": lo[1], "max_y": hi[1], "count": len(p)})
        axis = int(hi[1] - lo[1] > hi[0] - lo[0])
        if depth >= max_depth or len(p) <= min_leaf or hi[axis] <= lo[axis]:
            return at
        best = None
        for cut in np.linspace(lo[axis], hi[axis], tries + 2)[1:-1]:
            n = int((p[:, axis] < cut).sum())
            other = (hi - lo)[1 - axis]
            cost = n * (cut - lo[axis] + other) + (len(p) - n) * (hi[axis] - cut + other)
            if 0 < n < len(p) and (best is None or cost < best[0]):
                best = (cost, float(cut))
        if best is None:
            return at
        cut, low = best[1], p[:, axis] < best[1]
        mid_hi, mid_lo = hi.copy(), lo.copy()
        mid_hi[axis] = mid_lo[axis] = cut
        left = grow(p[low], lo, mid_hi, depth + 1)
        nodes[at] |= {"type": "y" if axis else "x", "split": cut, "left": left, "right": grow(p[~low], mid_lo, hi, depth + 1)}
        return at

    if len(points):
        grow(points, points.min(axis=0), points.max(axis=0), 0)
    return nodes


def build_nd(points: np.ndarray, max_depth: int = 8, min_leaf: int = 10, min_width_share: float = 0.0) -> list[dict]:
    """Nodes {axis (-1: leaf), split, left, right, count, min, max}; axes take turns and are split at the median, but not
    where a leaf would get too few points or too narrow."""
    nodes: list[dict] = []
    if not len(points):
        return nodes
    least = (points.max(axis=0) - points.min(axis=0)) * min_width_share

    def grow(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append({"axis": -1, "split": 0.0, "left": -1, "right": -1, "count": len(p), "min": lo.tolist(), "max": hi.tolist()})
        if depth >= max_depth or len(p) < 2 * min_leaf:
            return at
        for turn in range(p.shape[1]):
            axis = (depth + turn) % p.shape[1]
            cut = float(np.median(p[:, axis]))
            low = p[:, axis] < cut
            if min(low.sum(), (~low).sum()) < min_leaf or min(cut - lo[axis], hi[axis] - cut) < max(least[axis], 1e-300):
                continue
            mid_hi, mid_lo = hi.copy(), lo.copy()
            mid_hi[axis] = mid_lo[axis] = cut
            left = grow(p[low], lo, mid_hi, depth + 1)
            nodes[at] |= {"axis": axis, "split": cut, "left": left, "right": grow(p[~low], mid_lo, hi, depth + 1)}
            break
        return at

    grow(points, points.min(axis=0), points.max(axis=0), 0)
    return nodes


def nd_path(nodes: list[dict], x: np.ndarray) -> list[int]:
    """Node numbers from the root to the leaf that holds a point."""
    out, at = [], 0
    while at >= 0 and nodes:
        out.append(at)
        n = nodes[at]
        at = -1 if n["axis"] < 0 else n["left"] if x[n["axis"]] < n["split"] else n["right"]
    return out


def nd_box(nodes: list[dict], lo: np.ndarray, hi: np.ndarray) -> list[int]:
    """All nodes that a box meets, in the order they are visited."""
    out, todo = [], [0] if nodes else []
    while todo:
        i = todo.pop()
        n = nodes[i]
        if all(a <= h and b >= g for a, b, g, h in zip(n["min"], n["max"], lo, hi, strict=True)):
            out.append(i)
            if n["axis"] >= 0:
                todo += [n["right"], n["left"]]
    return out


FEATURE_MAP = "family string, feature string, kind string, count long, min double, max double, nodes string"


def feature_map(long: DataFrame, *, linear_families: tuple[str, ...] = (), spline_families: tuple[str, ...] = (), min_count: int = 1, max_depth: int = 4, min_leaf: int = 10, sample_a_feature: int = 20_000) -> DataFrame:
    """For every feature its role: linear and spline families keep a range, others get a one-dimensional tree (as JSON)
    from at most ``sample_a_feature`` of their values, picked by a hash."""
    import json

    stats = long.groupBy("family", "feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("n") >= min_count)
    plain = F.when(F.col("family").isin(list(linear_families)), "linear").when(F.col("family").isin(list(spline_families)), "spline")
    ranged = stats.withColumn("kind", plain).where("kind IS NOT NULL").select("family", "feature", "kind", F.col("n").alias("count"), F.col("lo").alias("min"), F.col("hi").alias("max"), F.lit(None).cast("string").alias("nodes"))
    rest = lookup(long, stats.where(plain.isNull()), ["family", "feature"])  # a feature's rows stay where they are
    picked = rest.where(F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(1 << 20)) < F.lit(float(sample_a_feature)) / F.col("n") * (1 << 20))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = build_nd(pdf[["value"]].to_numpy(float), max_depth, min_leaf)
        return pd.DataFrame([(key[0], key[1], "tree", int(pdf["n"].iloc[0]), float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0]), json.dumps(nodes))], columns=[c.split()[0] for c in FEATURE_MAP.split(", ")])

    return ranged.unionByName(picked.groupBy("family", "feature").applyInPandas(grow, FEATURE_MAP))
