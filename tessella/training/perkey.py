"""Models by key: the bounded strategy regression and boosted trees, one group of samples of bounded size a key.

A key's samples are trained in one task, as each key has a model of its own; ``max_samples`` bounds them. Keys above it are
trained over all partitions, by ``fit_large`` (strategies) and ``boost_large`` (trees, whose equal rows count as one).
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sampling import enough

OUTPUT = "id string, a double, b double, c double, loss double, train_loss double, n long, n_true long, epochs int, precision double, recall double, regret double"


def bounds(label: bool, pivot: float, observed: float, true_value: float | None, low: float = 0.9, high: float = 1.1) -> tuple[float, float]:
    """The interval that a prediction should fall in: around the true value where it is known and accepted, below the
    observed value where the offer was refused."""
    if label:
        return (true_value if true_value is not None else observed) * low, max(observed, true_value or observed) * high
    return 0.0, min(pivot, observed)


def _intervals(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``bounds`` of all rows as columns."""
    number = lambda c: pd.to_numeric(pdf[c]).to_numpy(float)
    label, pivot, observed, true = pdf["label"].to_numpy(bool), number("base_pivot"), number("observed_value"), number("true_value")
    known = np.where(np.isnan(true), observed, true)
    top = np.where(known == 0, observed, known)
    return np.where(label, known * 0.9, 0.0), np.where(label, np.where(top > observed, top, observed) * 1.1, np.where(observed < pivot, observed, pivot))


def predict(params: Sequence[float], x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    a, b, c = params
    return (1 + a * np.tanh(b * x + c)) * pivot


def fit_key(pdf: pd.DataFrame, *, rate: float = 0.05, epochs: int = 40, batch: int = 32, box: tuple = ((0.0, 1.0), (0.01, 10.0), (-5.0, 5.0)), start: tuple = (0.2, 1.0, 0.0), seed: int = 1) -> dict:
    """The epoch of least loss of mini-batch descent, kept in its box after every step. Only predictions outside their
    interval have a loss: the distance to it, over the pivot."""
    x, pivot = pdf["x"].to_numpy(float), pdf["base_pivot"].to_numpy(float)
    lo, hi = _intervals(pdf)
    p, random = np.array(start, float), np.random.default_rng(seed)

    def loss(p: np.ndarray) -> float:
        s = predict(p, x, pivot)
        return float((np.maximum(0, lo - s) + np.maximum(0, s - hi)).sum() / pivot.sum())

    best, least, at = p.copy(), loss(p), 0
    for e in range(epochs):
        order = random.permutation(len(x))
        for i in range(0, len(x), batch):
            k = order[i : i + batch]
            t = np.tanh(p[1] * x[k] + p[2])
            s = (1 + p[0] * t) * pivot[k]
            d = ((s > hi[k]).astype(float) - (s < lo[k])) / len(k)
            slope = p[0] * (1 - t * t)
            p = p - rate / (1 + 0.1 * e) * np.array([(d * t).sum(), (d * slope * x[k]).sum(), (d * slope).sum()])
            p = np.clip(p, [b[0] for b in box], [b[1] for b in box])
        now = loss(p)
        if now < least:
            best, least, at = p.copy(), now, e
    s = predict(best, x, pivot)
    positive, lower = pdf["label"].to_numpy(bool), s < pdf["observed_value"].to_numpy(float)
    share = lambda m, of: float(m.sum() / of.sum()) if of.sum() else 0.0
    regret = np.maximum(0, pdf["observed_value"].to_numpy(float) - s)[positive]
    return {"a": best[0], "b": best[1], "c": best[2], "loss": least, "train_loss": loss(p), "n": len(x), "n_true": int(positive.sum()), "epochs": at + 1, "precision": share(lower & ~positive, lower), "recall": share(lower & ~positive, ~positive), "regret": float(np.median(regret)) if len(regret) else 0.0}


def oversized(samples: DataFrame, key: str = "id", max_samples: int = 1_000_000) -> DataFrame:
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_samples)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's spark.checkpoint.dir; a folder is made only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessella-"))
    return df.checkpoint()


def fit_large(rows: DataFrame, *, rate: float = 0.05, epochs: int = 40, batch: int = 32, box: tuple = ((0.0, 1.0), (0.01, 10.0), (-5.0, 5.0)), start: tuple = (0.2, 1.0, 0.0), seed: int = 1) -> DataFrame:
    """A row of OUTPUT for every id, whatever its number of rows: in every epoch each partition goes on from the id's
    parameters over its own rows, batch by batch, and the ids' new parameters are the partitions' means by rows. Losses
    are sums over all rows. No id's rows meet in one task; the driver holds three numbers an id."""
    spark, names = rows.sparkSession, [c.split()[0] for c in OUTPUT.split(", ")]
    rows = checkpointed(rows.select("id", "label", "x", "base_pivot", "observed_value", "true_value").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    params = {r["id"]: np.array(start, float) for r in rows.select("id").distinct().collect()}
    lows, highs = zip(*box, strict=True)

    def epoch(params: dict, e: int, learn: bool) -> dict:
        def work(parts):
            own, sums, random = {k: v.copy() for k, v in params.items()}, {}, np.random.default_rng((seed, e))
            for pdf in parts:
                for key, g in pdf.groupby("id"):
                    x, pivot, (lo, hi) = g["x"].to_numpy(float), g["base_pivot"].to_numpy(float), _intervals(g)
                    s = predict(params[key], x, pivot)
                    sums[key] = sums.get(key, 0) + np.array([(np.maximum(0, lo - s) + np.maximum(0, s - hi)).sum(), pivot.sum(), len(x)])
                    order, p = random.permutation(len(x)), own[key]
                    for i in range(0, len(x) if learn else 0, batch):
                        k = order[i : i + batch]
                        t = np.tanh(p[1] * x[k] + p[2])
                        s = (1 + p[0] * t) * pivot[k]
                        d = ((s > hi[k]).astype(float) - (s < lo[k])) / len(k)
                        slope = p[0] * (1 - t * t)
                        p = np.clip(p - rate / (1 + 0.1 * e) * np.array([(d * t).sum(), (d * slope * x[k]).sum(), (d * slope).sum()]), lows, highs)
                    own[key] = p
            yield pd.DataFrame([(k, *v, *(own[k] * v[2])) for k, v in sums.items()], columns=["id", "off", "pivot", "n", "a", "b", "c"])

        out = rows.mapInPandas(work, "id string, off double, pivot double, n double, a double, b double, c double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("off", "pivot", "n", "a", "b", "c")])
        return {r["id"]: r for r in out.collect()}

    best: dict = {}
    for e in range(epochs + 1):
        got = epoch(params, e, e < epochs)
        for k, r in got.items():
            now = r["off"] / r["pivot"]
            if k not in best or now < best[k][1]:
                best[k] = (params[k], now, max(0, e - 1))
            if e == epochs:
                best[k] += (now,)
        params = {k: np.array([r["a"], r["b"], r["c"]]) / r["n"] for k, r in got.items()}
    models = spark.createDataFrame([(k, *map(float, p), float(least), float(last), at + 1) for k, (p, least, at, last) in best.items()], "id string, a double, b double, c double, loss double, train_loss double, epochs int")
    s = rows.join(F.broadcast(models), "id").withColumn("_s", (1 + F.col("a") * F.tanh(F.col("b") * F.col("x") + F.col("c"))) * F.col("base_pivot"))
    lower, positive = F.col("_s") < F.col("observed_value"), F.col("label")
    count = lambda c: F.count_if(c).cast("double")
    ratio = lambda m, of: F.when(count(of) > 0, count(m) / count(of)).otherwise(0.0)
    facts = s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("n_true"), ratio(lower & ~positive, lower).alias("precision"), ratio(lower & ~positive, ~positive).alias("recall"))
    regrets = s.where(positive).groupBy("id", F.greatest(F.lit(0.0), F.col("observed_value") - F.col("_s")).alias("r")).agg(F.count(F.lit(1)).alias("m"))
    upto = regrets.withColumn("upto", F.sum("m").over(Window.partitionBy("id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    half = lambda k: F.min(F.when(F.col("upto") * 2 >= F.col("n_true") + k, F.col("r")))
    median = upto.join(facts.select("id", "n_true"), "id").groupBy("id").agg(((half(0) + half(1)) / 2).alias("regret"))
    return models.join(facts, "id").join(median, "id", "left").fillna(0.0, ["regret"]).select(*names)


def train_strategy(samples: DataFrame, *, least: int = 100, max_samples: int = 1_000_000, **options) -> DataFrame:
    """A row of OUTPUT for every id with enough samples (id, label, x, base_pivot, observed_value, true_value). Ids of
    over ``max_samples`` rows train over all partitions, the others in one task each."""
    samples = samples.withColumn("id", F.col("id").cast("string"))
    large = checkpointed(oversized(samples, "id", max_samples).select("id"))
    rows = enough(samples, "id", least).join(large, "id", "left_anti")
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"id": key[0], **fit_key(pdf.sort_values(["x", "observed_value", "label"]), **options)}])[names]

    small = rows.groupBy("id").applyInPandas(work, OUTPUT)
    if large.isEmpty():
        return small
    return small.unionByName(fit_large(enough(samples, "id", least).join(large, "id", "left_semi"), **options))


def search_strategy(samples: DataFrame, options: Sequence[dict], **fixed) -> DataFrame:
    """The options of least loss for every id, with their number."""
    tried = None
    for i, o in enumerate(options):
        one = train_strategy(samples, **{**fixed, **o}).withColumn("option", F.lit(i))
        tried = one if tried is None else tried.unionByName(one)
    best = F.min(F.struct("loss", "option", F.struct(*[c for c in tried.columns if c not in ("id", "loss", "option")]).alias("rest")))
    return tried.groupBy("id").agg(best.alias("m")).select("id", "m.loss", "m.option", "m.rest.*")


def score_strategy(samples: DataFrame, models: DataFrame) -> DataFrame:
    """Samples with their key's prediction; keys without a model keep their pivot."""
    j = samples.withColumn("id", F.col("id").cast("string")).join(models.select("id", "a", "b", "c"), "id", "left").fillna({"a": 0.0, "b": 1.0, "c": 0.0})
    return j.withColumn("prediction", (1 + F.col("a") * F.tanh(F.col("b") * F.col("x") + F.col("c"))) * F.col("base_pivot"))


def boost_key(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, rounds: int = 20, eta: float = 0.3, max_depth: int = 2, min_child: float = 1.0, ridge: float = 1.0) -> list[list[tuple]]:
    """Second-order boosted trees of logistic loss; a tree is a list of (axis, cut, left, right) or (-1, value, 0, 0). A row
    of weight n is n equal rows."""
    score, trees, weight = np.zeros(len(y)), [], np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h, tree = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-12), []

        def grow(rows: np.ndarray, depth: int, g=g, h=h, tree=tree) -> int:
            at, gs, hs = len(tree), g[rows].sum(), h[rows].sum()
            tree.append((-1, float(-eta * gs / (hs + ridge)), 0, 0))
            best = (1e-6, None, None)
            if depth < max_depth:
                for axis in range(x.shape[1]):
                    order = rows[np.argsort(x[rows, axis], kind="stable")]
                    v, gl, hl = x[order, axis], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain = np.where((v[1:] > v[:-1]) & (hl >= min_child) & (hs - hl >= min_child), gain, 0)
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (gain[i], axis, float((v[i] + v[i + 1]) / 2))
            if best[1] is not None:
                left = x[rows, best[1]] < best[2]
                a = grow(rows[left], depth + 1)
                tree[at] = (best[1], best[2], a, grow(rows[~left], depth + 1))
            return at

        grow(np.arange(len(y)), 0)
        trees.append(tree)
        score = score + boost_score([tree], x)
    return trees


def boost_leaf(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """The node that every row ends in."""
    at = np.zeros(len(x), int)
    axis, cut, left, right = (np.array(c) for c in zip(*tree, strict=True))
    while (axis[at] >= 0).any():
        a = axis[at]
        go = np.where(x[np.arange(len(x)), np.maximum(a, 0)] < cut[at], left[at], right[at])
        at = np.where(a >= 0, go, at)
    return at


def boost_score(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for tree in trees:
        out += np.array([n[1] for n in tree])[boost_leaf(tree, x)]
    return out


def boost_large(rows: DataFrame, features: Sequence[str], *, rounds: int = 20, eta: float = 0.3, max_depth: int = 2, min_child: float = 1.0, ridge: float = 1.0) -> dict[str, list[list[tuple]]]:
    """The trees of ``boost_key`` for every id of (id, y, w, features), whatever its number of rows: slopes are summed by id,
    node, axis and value, and running sums over ranges of values give the gain of every cut. The driver holds the trees."""
    from tessella.operators.statistics import running_sums

    names, trees = list(features), {r["id"]: [] for r in rows.select("id").distinct().collect()}
    for _ in range(rounds):
        growing = {k: [(-1, 0.0, 0, 0)] for k in trees}
        depth_of, todo = {(k, 0): 0 for k in trees}, {(k, 0) for k in trees}
        while todo:
            def slopes(parts, trees=trees, growing=growing, todo=todo):
                for pdf in parts:
                    for key, part in pdf.groupby("id"):
                        x = part[names].to_numpy(float)
                        p = 1 / (1 + np.exp(-np.clip(boost_score(trees[key], x), -30, 30)))
                        w, y, at = part["w"].to_numpy(float), part["y"].to_numpy(float), boost_leaf(growing[key], x)
                        g, h, on = w * (p - y), w * np.maximum(p * (1 - p), 1e-12), np.isin(at, [n for k, n in todo if k == key])
                        for axis in range(len(names)):
                            out = pd.DataFrame({"node": at, "value": x[:, axis], "g": g, "h": h})[on].groupby(["node", "value"], as_index=False).sum()
                            yield out.assign(id=key, axis=axis)[["id", "node", "axis", "value", "g", "h"]]

            keys = ["id", "node", "axis"]
            sums = checkpointed(rows.mapInPandas(slopes, "id string, node int, axis int, value double, g double, h double").groupBy(*keys, "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
            totals = {(r["id"], r["node"]): (r["gs"], r["hs"]) for r in sums.where("axis = 0").groupBy("id", "node").agg(F.sum("g").alias("gs"), F.sum("h").alias("hs")).collect()}
            best = {}
            deeper = [n for n in todo if depth_of[n] < max_depth]
            if deeper:
                whole = rows.sparkSession.createDataFrame([(k, n, *map(float, totals[k, n])) for k, n in deeper], "id string, node int, gs double, hs double")
                below = running_sums(sums, keys, "value", ["g", "h"]).join(F.broadcast(whole), ["id", "node"])
                gl, hl, gs, hs = (F.col(c) for c in ("below_g", "below_h", "gs", "hs"))
                gain = gl * gl / (hl + ridge) + (gs - gl) * (gs - gl) / (hs - hl + ridge) - gs * gs / (hs + ridge)
                cuts = below.where((hl >= min_child) & (hs - hl >= min_child) & (hl > 0)).withColumn("gain", gain).where("gain > 1e-6")
                found = {(r["id"], r["node"]): r["b"] for r in cuts.groupBy("id", "node").agg(F.min(F.struct((-F.col("gain")).alias("worst"), "axis", "value")).alias("b")).collect()}
                if found:
                    at = rows.sparkSession.createDataFrame([(k, n, b["axis"], b["value"]) for (k, n), b in found.items()], "id string, node int, axis int, right double")
                    for r in sums.join(F.broadcast(at), keys).where("value < right").groupBy(*keys, "right").agg(F.max("value").alias("left")).collect():
                        best[r["id"], r["node"]] = (r["axis"], (r["left"] + r["right"]) / 2)
            after = set()
            for k, n in sorted(todo):
                gs, hs = totals[k, n]
                tree = growing[k]
                tree[n] = (-1, float(-eta * gs / (hs + ridge)), 0, 0)
                if (k, n) in best:
                    tree[n] = (*best[k, n], len(tree), len(tree) + 1)
                    for child in tree[n][2:]:
                        tree.append((-1, 0.0, 0, 0))
                        depth_of[k, child] = depth_of[k, n] + 1
                        after.add((k, child))
            todo = after
        trees = {k: [*trees[k], preordered(growing[k])] for k in trees}
    return trees


def preordered(tree: list[tuple]) -> list[tuple]:
    """A tree numbered as ``boost_key`` numbers its nodes: a node, its left side, its right side."""
    out: list[tuple] = []

    def put(n: int) -> int:
        axis, cut, left, right = tree[n]
        at = len(out)
        out.append((axis, cut, 0, 0))
        if axis >= 0:
            a = put(left)
            out[at] = (axis, cut, a, put(right))
        return at

    put(0)
    return out


BOOSTED = "id string, trees string, loss double, auc double, n long"


def train_boosted(rows: DataFrame, features: Sequence[str], label: str, key: str, *, max_samples: int = 1_000_000, **options) -> DataFrame:
    """A boosted model (JSON) for every key, with its training loss and AUC. Null features are -1.

    Equal rows of a key are one row with their number as weight. A key trains in one task by its different rows; keys with
    over ``max_samples`` of them train over all partitions (``boost_large``), to the same trees."""
    import json

    data = rows.select(F.col(key).cast("string").alias("id"), F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features])
    data = checkpointed(data.groupBy("id", "y", *features).agg(F.count(F.lit(1)).alias("w")))
    large = [r["id"] for r in data.groupBy("id").count().where(F.col("count") > max_samples).select("id").collect()]

    def work(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*features, "y"])
        x, y, w = pdf[list(features)].to_numpy(float), pdf["y"].to_numpy(), pdf["w"].to_numpy(float)
        trees = boost_key(x, y, w, **options)
        s = boost_score(trees, x)
        pos = y > 0
        at = np.unique(s, return_inverse=True)[1]
        n_pos, n_neg = np.bincount(at, w * pos), np.bincount(at, w * ~pos)
        auc = float((n_pos * (np.cumsum(n_neg) - n_neg / 2)).sum() / (n_pos.sum() * n_neg.sum())) if n_pos.sum() and n_neg.sum() else float("nan")
        return pd.DataFrame([(k[0], json.dumps(trees), float((w * np.logaddexp(0, np.where(pos, -s, s))).sum() / w.sum()), auc, int(w.sum()))], columns=["id", "trees", "loss", "auc", "n"])

    if not large:
        return data.groupBy("id").applyInPandas(work, BOOSTED)
    is_large = F.coalesce(F.col("id").isin([k for k in large if k is not None]), F.lit(None in large))
    some = data.where(is_large).withColumn("id", F.coalesce("id", F.lit("\0null")))
    models = boost_large(some, features, **options)

    def scored(parts):
        for pdf in parts:
            for k, part in pdf.groupby("id"):
                yield pd.DataFrame({"id": k, "score": boost_score(models[k], part[list(features)].to_numpy(float)), "label": (part["y"] > 0).astype(float), "w": part["w"].astype(float)})

    from tessella.operators.statistics import running_sums

    s = checkpointed(some.mapInPandas(scored, "id string, score double, label double, w double"))
    z = F.when(F.col("label") > 0, -F.col("score")).otherwise(F.col("score"))
    losses = s.groupBy("id").agg((F.sum(F.col("w") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))) / F.sum("w")).alias("loss"), F.sum("w").cast("long").alias("n"))
    ties = s.groupBy("id", "score").agg(F.sum(F.when(F.col("label") > 0, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label") > 0, 0.0).otherwise(F.col("w"))).alias("q"))
    area = running_sums(ties, ["id"], "score", ["q"]).groupBy("id").agg(F.coalesce(F.try_divide(F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)), F.sum("p") * F.sum("q")), F.lit(float("nan"))).alias("auc"))
    trained = rows.sparkSession.createDataFrame([(k, json.dumps(t)) for k, t in models.items()], "id string, trees string")
    whole = trained.join(losses, "id").join(area, "id").select(F.when(F.col("id") != "\0null", F.col("id")).alias("id"), "trees", "loss", "auc", "n")
    return data.where(~is_large).groupBy("id").applyInPandas(work, BOOSTED).unionByName(whole)


def importance(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often each feature splits, by key."""
    trees = F.from_json("trees", "array<array<array<double>>>")
    nodes = models.select("id", F.explode(F.flatten(trees)).alias("n")).where(F.get("n", F.lit(0)) >= 0)
    return nodes.groupBy("id", F.get(F.array(*[F.lit(f) for f in features]), F.get("n", F.lit(0)).cast("int")).alias("feature")).agg(F.count(F.lit(1)).alias("splits"))


def keyed_metrics(scored: DataFrame, key: str) -> DataFrame:
    """AUC with ties, MSE, MAE and counts by key from (key, score, label)."""
    from tessella.operators.evaluation import roc_auc

    y = (F.col("label") > 0).cast("double")
    base = scored.groupBy(key).agg(F.avg((F.col("score") - y) * (F.col("score") - y)).alias("MSE"), F.avg(F.abs(F.col("score") - y)).alias("MAE"), F.count_if(y > 0).alias("POS"), F.count_if(y <= 0).alias("NEG"))
    return base.join(roc_auc(scored, key), key, "left")
