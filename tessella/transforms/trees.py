"""Transforms by trees and hashes, and dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.features import FeatureSet, Transform
from tessella.functions.java_random import JavaRandom
from tessella.functions.scalar import no_floats, no_strings, pairs, union, upsert
from tessella.transforms.registry import transform

#: A kd-tree is a list of nodes {type: x, y or leaf, split, left, right}; node 0 is the root.
Nodes = Sequence[Mapping]


def paths(nodes: Nodes) -> list[list[int]]:
    """Node numbers from the root to every leaf."""
    out, todo = [], [[0]]
    while todo:
        path = todo.pop()
        node = nodes[path[-1]]
        if node["type"] == "leaf":
            out.append(path)
        else:
            todo += [[*path, node["right"]], [*path, node["left"]]]
    return out


def by_leaf(nodes: Nodes, x: Column, y: Column, of: Callable[[list[int]], Column], at: int = 0, path: tuple[int, ...] = ()) -> Column:
    """Nested conditions down the tree; ``of`` makes the value from the path to a leaf."""
    node, here = nodes[at], [*path, at]
    if node["type"] == "leaf":
        return of(here)
    side = x if node["type"] == "x" else y
    return F.when(side < float(node["split"]), by_leaf(nodes, x, y, of, node["left"], tuple(here))).otherwise(by_leaf(nodes, x, y, of, node["right"], tuple(here)))


@transform("kdtree")
def kdtree(config) -> Transform:
    nodes, most = config["nodes"], int(config["max_count"])

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        x, y = m[config["value1"]], m[config["value2"]]
        new = by_leaf(nodes, x, y, lambda path: F.array(*[F.lit(str(i)) for i in path[::-1][:most]]))
        return fs.put({target: F.when(x.isNull() | y.isNull(), fs.strings(target)).otherwise(union(fs.strings(target), new))})

    return run


@transform("kdtree_continuous")
def kdtree_continuous(config) -> Transform:
    nodes, most = config["nodes"], int(config["max_count"])

    def run(fs: FeatureSet) -> FeatureSet:
        m, target = fs.floats(config["field1"]), config["output"]
        x, y = m[config["value1"]], m[config["value2"]]

        def offsets(path: list[int]) -> Column:
            out = []
            for i in path[::-1][:most]:
                if nodes[i]["type"] != "leaf":
                    out += [F.lit(str(i)), (x if nodes[i]["type"] == "x" else y) - float(nodes[i]["split"])]
            return F.create_map(*out) if out else no_floats()

        return fs.put(floats={target: F.when(x.isNull() | y.isNull(), fs.floats(target)).otherwise(upsert(fs.floats(target), by_leaf(nodes, x, y, offsets)))})

    return run


def read_tree(rows: Sequence[str]) -> list[dict]:
    """Nodes from "P,id,family,name,threshold,left,right" and "L,id,weight,name" rows."""
    out = []
    for row in rows:
        part = row.split(",")
        if "P" in part[0]:
            out.append({"family": part[2], "feature": part[3], "threshold": float(part[4]), "left": int(part[5]), "right": int(part[6])})
        else:
            out.append({"weight": float(part[2]), "name": part[3]})
    return out


def descend(nodes: Sequence[Mapping], number: Callable[[str, str], Column], of: Callable[[int], Column], at: int = 0) -> Column:
    """Nested conditions down a decision tree; a missing number goes left. ``of`` makes the value of a leaf's number."""
    node = nodes[at]
    if "left" not in node:
        return of(at)
    go_right = F.coalesce(number(node["family"], node["feature"]) >= float(node["threshold"]), F.lit(False))
    return F.when(go_right, descend(nodes, number, of, node["right"])).otherwise(descend(nodes, number, of, node["left"]))


@transform("decision_tree")
def decision_tree(config) -> Transform:
    nodes = read_tree(config["nodes"])

    def run(fs: FeatureSet) -> FeatureSet:
        leaves, family = config["output_leaves"], config["output_score_family"]
        number = lambda f, n: fs.floats(f)[n]
        name = descend(nodes, number, lambda i: F.lit(nodes[i]["name"]))
        weight = descend(nodes, number, lambda i: F.lit(nodes[i]["weight"]))
        return fs.put({leaves: union(fs.strings(leaves), F.array(name))}, {family: upsert(fs.floats(family), F.create_map(F.lit(config["output_score_name"]), weight))})

    return run


WINDOW = 4


def windows(size: int, seed: int, n: int) -> list[list[int]]:
    """The first ``n`` windows of four places drawn from seeded permutations of a vector's places."""
    random, queue, out = JavaRandom(seed), [], []
    for _ in range(n):
        if len(queue) < WINDOW:
            queue = list(range(size))
            for i in range(size):
                j = random.below(size)
                queue[i], queue[j] = queue[j], queue[i]
        out.append(queue[:WINDOW])
        queue = queue[WINDOW:]
    return out


@transform("wta")
def wta(config) -> Transform:
    """Winner-take-all words. The windows depend on seed and length alone, so they are constants of the plan; lengths
    are given by ``sizes``, or read from the first row that has the vector."""
    words, tokens = int(config["num_words_per_feature"]), int(config["num_tokens_per_word"])
    if tokens > 16:
        raise ValueError("num_tokens_per_word is 16 at most")

    def of(name: str, v: Column, size: int) -> Column:
        picks = windows(size, int(config["seed"]), words * tokens)

        def token(window: list[int]) -> Column:
            values = [F.get(v, F.lit(i)) for i in window]
            most = F.greatest(*values)
            return F.when(values[0] == most, 0).when(values[1] == most, 1).when(values[2] == most, 2).otherwise(3)

        out = []
        for w in range(words):
            word = F.lit(0)
            for i in range(tokens):
                word = word.bitwiseOR(F.shiftleft(token(picks[w * tokens + i]), 2 * i))
            out.append(F.concat(F.lit(f"{name}{w}:"), word.cast("string")))
        return F.array(*out)

    def run(fs: FeatureSet) -> FeatureSet:
        parts = []
        for name in config["field_names"]:
            v, size = fs.dense(name), (config.get("sizes") or {}).get(name)
            if size is None and name in fs.dense_names:
                first = fs.df.where(v.isNotNull()).select(F.size(v)).first()
                size = first[0] if first else None
            if size is not None and size >= WINDOW:
                parts.append(F.when(v.isNotNull(), of(name, v, size)).otherwise(no_strings()))
        return fs.put({config["output"]: F.array_distinct(F.concat(*parts)) if parts else no_strings()})

    return run


@transform("float_to_dense")
def float_to_dense(config) -> Transform:
    fields, keys = list(config["fields"]), list(config["keys"])
    if len(fields) != len(keys) or len(fields) < 2:
        raise ValueError("fields and keys have one length of at least two")

    def run(fs: FeatureSet) -> FeatureSet:
        values, name = [fs.floats(f)[k] for f, k in zip(fields, keys, strict=True)], "^".join(keys)
        full = values[0].isNotNull()
        for v in values[1:]:
            full = full & v.isNotNull()
        return fs.put(dense={name: F.when(full, F.array(*values)).otherwise(fs.dense(name))})

    return run


@transform("float_family_cross_to_two_d_dense")
def float_family_cross_to_two_d_dense(config) -> Transform:
    """All pairs as two-element vectors by name ``a^b``, in the map column ``dense_pairs``; crossed with itself a family
    gives each pair once, in order of name."""

    def run(fs: FeatureSet) -> FeatureSet:
        other = config.get("field2", config["field1"])
        a, b = fs.floats(config["field1"]), fs.floats(other)
        same = other == config["field1"]
        item = lambda e, g: F.struct(F.concat(e["key"], F.lit("^"), g["key"]).alias("key"), F.array(e["value"], g["value"]).alias("value"))
        right = lambda e: F.filter(pairs(b), lambda g: e["key"] < g["key"]) if same else pairs(b)
        found = F.map_from_entries(F.flatten(F.transform(pairs(a), lambda e: F.transform(right(e), lambda g: item(e, g)))))
        return FeatureSet(fs.df.withColumn("dense_pairs", F.when(a.isNotNull() & b.isNotNull(), found)))

    return run
