"""Kernel machines, maxout networks and perceptrons over dense rows (ids, label, x ARRAY<DOUBLE>).

Gradients of maxout and perceptron are computed a partition at a time and summed by aggregation; parameters travel in
the closure. The kernel machine grows its support vectors in order over a bounded number of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.training.sparse import LOSSES


def summed_gradient(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, float]:
    """Sum over rows of the flat gradient that ``of(x, y)`` gives for a batch, and the number of rows."""

    def work(batches):
        total, n = None, 0
        for b in batches:
            if len(b):
                g = of(np.stack(b["x"].to_list()).astype(float), b["label"].to_numpy(float))
                total, n = g if total is None else total + g, n + len(b)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total) + 1), "g": np.append(total, n)})

    got = rows.select("label", "x").mapInPandas(work, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")
    g = got["g"].to_numpy()
    return (g[:-1], float(g[-1])) if len(g) else (np.zeros(0), 0.0)


def _slopes(scores: np.ndarray, y: np.ndarray, loss: str, rank_threshold: float, margin: float) -> np.ndarray:
    if loss in ("hinge", "logistic"):
        y = np.where(y > rank_threshold, 1.0, -1.0)
    return np.array([LOSSES[loss](float(s), float(t), margin)[1] for s, t in zip(scores, y, strict=True)])


def train_mlp(
    rows: DataFrame, nodes: Sequence[int], activations: Sequence[str], *, loss: str = "hinge", margin: float = 1.0, iterations: int = 20, rate: float = 0.1, rate_decay: float = 1.0, momentum: tuple[float, float] = (0.0, 0.0),
    weight_decay: float = 0.0, dropout: float = 0.0, init_std: float = 0.3, rank_threshold: float = 0.0, subsample: float = 1.0, seed: int = 1,
) -> list[dict]:
    """Layers {weights, bias, activation}. ``nodes`` are the sizes after the input, the last is 1. Momentum moves from its
    first to its last value over the iterations."""
    width = rows.select(F.size("x")).first()[0]
    sizes, random = [width, *nodes], np.random.default_rng(seed)
    ws = [random.normal(0, init_std, (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    bs = [np.zeros(b) for b in sizes[1:]]
    act = {"sigmoid": lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30))), "relu": lambda z: np.maximum(0, z), "tanh": np.tanh, "identity": lambda z: z}
    slope = {"sigmoid": lambda a: a * (1 - a), "relu": lambda a: (a > 0).astype(float), "tanh": lambda a: 1 - a * a, "identity": np.ones_like}
    flat = lambda: np.concatenate([p.ravel() for p in (*ws, *bs)])
    speed = np.zeros(flat().size)
    for it in range(iterations):
        def of(x: np.ndarray, y: np.ndarray, ws=ws, bs=bs, it=it) -> np.ndarray:
            r, layers, masks = np.random.default_rng((seed, it)), [x], []
            for w, b, a in zip(ws, bs, activations, strict=True):
                out = act[a](layers[-1] @ w + b)
                last = len(layers) == len(ws)
                masks.append(np.ones_like(out) if last or not dropout else (r.random(out.shape) >= dropout) / (1 - dropout))
                layers.append(out * masks[-1])
            d = _slopes(layers[-1][:, 0], y, loss, rank_threshold, margin)[:, None] * slope[activations[-1]](layers[-1])
            gw, gb = [], []
            for i in range(len(ws) - 1, -1, -1):
                gw.append(layers[i].T @ d)
                gb.append(d.sum(axis=0))
                if i:
                    d = (d @ ws[i].T) * slope[activations[i - 1]](layers[i]) * masks[i - 1]
            return np.concatenate([p.ravel() for p in (*gw[::-1], *gb[::-1])])

        data = rows if subsample >= 1 else rows.where(F.pmod(F.xxhash64(F.lit(it), F.col("x")), F.lit(1000)) < subsample * 1000)
        g, n = summed_gradient(data, of)
        if not n:
            continue
        m = momentum[0] + (momentum[1] - momentum[0]) * it / max(1, iterations - 1)
        speed = m * speed - rate * rate_decay**it * (g / n + weight_decay * flat())
        params, at = flat() + speed, 0
        for group in (ws, bs):
            for i, p in enumerate(group):
                group[i] = params[at : at + p.size].reshape(p.shape)
                at += p.size
    return [{"weights": w.tolist(), "bias": b.tolist(), "activation": a} for w, b, a in zip(ws, bs, activations, strict=True)]


def train_maxout(rows: DataFrame, *, hidden: int = 8, loss: str = "hinge", iterations: int = 30, rate: float = 0.2, l1: float = 0.0, l2: float = 0.0, dropout: float = 0.0, momentum: float = 0.0, rank_threshold: float = 0.0, seed: int = 1) -> np.ndarray:
    """Weights (inputs x hidden): a score is the largest response of the second half less that of the first."""
    width = rows.select(F.size("x")).first()[0]
    w, half = np.random.default_rng(seed).normal(0, 0.3, (width, hidden)), hidden // 2
    speed = np.zeros_like(w)
    for it in range(iterations):
        def of(x: np.ndarray, y: np.ndarray, w=w, it=it) -> np.ndarray:
            if dropout:
                x = x * (np.random.default_rng((seed, it)).random(x.shape) >= dropout) / (1 - dropout)
            z = x @ w
            up, down = z[:, half : 2 * half].argmax(axis=1) + half, z[:, :half].argmax(axis=1)
            r = np.arange(len(x))
            d = _slopes(z[r, up] - z[r, down], y, loss, rank_threshold, 1.0)
            g = np.zeros_like(w)
            np.add.at(g.T, up, d[:, None] * x)
            np.add.at(g.T, down, -d[:, None] * x)
            return g.ravel()

        g, n = summed_gradient(rows, of)
        speed = momentum * speed - rate * g.reshape(w.shape) / max(1.0, n)
        w = w + speed
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1) / (1 + rate * l2)
    return w


def train_kernel(rows: DataFrame, *, kernel: str = "rbf", scale: float = 1.0, candidates: int = 500, max_vectors: int = 64, loss: str = "hinge", rate: float = 0.1, rank_threshold: float = 0.0) -> list[dict]:
    """Support vectors {vector, kernel, scale, weight} from one pass over the first ``candidates`` rows in hashed order: a
    row with a loss becomes a support vector while there is room, and moves the weights of all."""
    sample = rows.select("label", "x").orderBy(F.xxhash64("x")).limit(candidates).toPandas()
    vectors, weights = [], []
    for label, x in zip(sample["label"], sample["x"], strict=True):
        x = np.asarray(x, float)
        if vectors:
            m = np.stack(vectors)
            if kernel == "rbf":
                k = np.exp(-scale * ((m - x) ** 2).sum(axis=1))
            else:
                k = 1 - np.arccos(np.clip(m @ x / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(x), 1e-12), -1, 1)) / np.pi
            score = float(k @ np.array(weights))
        else:
            k, score = np.zeros(0), 0.0
        g = float(_slopes(np.array([score]), np.array([label]), loss, rank_threshold, 1.0)[0])
        if g:
            weights = [w - rate * g * v for w, v in zip(weights, k, strict=True)]
            if len(vectors) < max_vectors:
                vectors.append(x)
                weights.append(-rate * g)
    return [{"vector": v.tolist(), "kernel": "rbf" if kernel == "rbf" else "acos", "scale": scale, "weight": float(w)} for v, w in zip(vectors, weights, strict=True)]
