"""Feature sets: a DataFrame with one column for each family.

String families are columns ``s:name`` of array<string>, float families ``f:name`` of map<string,double>, dense
vectors ``d:name`` of array<double>. A family that a row lacks is NULL there; an empty one is an empty array or map.
Which families exist is known when a plan is made, so Catalyst prunes those that nothing reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalar import DENSE, FLOATS, STRINGS, no_floats, no_strings

LABEL, BIAS, MISS = "LABEL", "BIAS", "MISS"
#: The column of the packed layout that holds a row's features.
ITEMS = "_items"


@dataclass(frozen=True)
class FeatureSet:
    df: DataFrame

    def _names(self, kind: str) -> list[str]:
        return [c[2:] for c in self.df.columns if c.startswith(kind + ":")]

    @property
    def string_families(self) -> list[str]:
        return self._names("s")

    @property
    def float_families(self) -> list[str]:
        return self._names("f")

    @property
    def dense_names(self) -> list[str]:
        return self._names("d")

    def _column(self, kind: str, name: str, type_: str) -> Column:
        c = f"{kind}:{name}"
        return F.col(f"`{c}`") if c in self.df.columns else F.lit(None).cast(type_)

    def strings(self, family: str) -> Column:
        return self._column("s", family, STRINGS)

    def floats(self, family: str) -> Column:
        return self._column("f", family, FLOATS)

    def dense(self, name: str) -> Column:
        return self._column("d", name, "array<double>")

    def put(self, strings: dict[str, Column] | None = None, floats: dict[str, Column] | None = None, dense: dict[str, Column] | None = None) -> FeatureSet:
        new = {f"s:{k}": v for k, v in (strings or {}).items()} | {f"f:{k}": v for k, v in (floats or {}).items()} | {f"d:{k}": v for k, v in (dense or {}).items()}
        return replace(self, df=self.df.withColumns(new)) if new else self

    def drop(self, strings: Iterable[str] = (), floats: Iterable[str] = ()) -> FeatureSet:
        return replace(self, df=self.df.drop(*[f"s:{s}" for s in strings], *[f"f:{f}" for f in floats]))

    def keep_ids(self) -> list[str]:
        return [c for c in self.df.columns if c[:2] not in ("s:", "f:", "d:")]


def split_name(name: str) -> tuple[str, str]:
    """A flat column name as (family, feature); the family is empty where the type's default applies."""
    if name.lower() == "label":
        return LABEL, ""
    family, sign, feature = name.partition("_")
    if not sign:
        return "", name
    if not family or not feature:
        raise ValueError(f"no family or no feature in column name {name!r}")
    return family, feature


def ingest(df: DataFrame, ids: Iterable[str] = (), multiclass: bool = False, bias: bool = True) -> FeatureSet:
    """Features from a flat table by its column names.

    FAMILY_name is feature ``name`` of FAMILY; without an underscore the family is DEFAULT_STRING or DEFAULT_FLOAT.
    Strings become ``feature:value`` (RAW: the value alone), booleans ``feature:T`` or ``feature:F``, numbers, decimals
    among them, float features, dates and timestamps strings. Nulls put the column's name in MISS. ``_meta_x`` goes to
    the map column metadata. A multiclass label is a string "a:1,b:2". Columns named in ``ids`` stay as they are.
    """
    ids = list(ids)
    strings: dict[str, list[Column]] = {}
    floats: dict[str, list[tuple[str, Column]]] = {}
    missing, meta, labels = [], [], None
    for f in df.schema.fields:
        if f.name in ids:
            continue
        value = F.col(f"`{f.name}`")
        if f.name.startswith("_meta_"):
            meta.append(F.struct(F.lit(f.name[6:]).alias("key"), value.cast("string").alias("value")))
            continue
        family, feature = split_name(f.name)
        missing.append(F.when(value.isNull(), F.lit(f.name)))
        if multiclass and family == LABEL and isinstance(f.dataType, T.StringType):
            labels = F.map_from_entries(F.transform(F.split(value, ","), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).alias("key"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double").alias("value"))))
        elif isinstance(f.dataType, T.BooleanType):
            strings.setdefault(family or "DEFAULT_STRING", []).append(F.when(value, F.lit(f"{feature}:T")).when(~value, F.lit(f"{feature}:F")))
        elif isinstance(f.dataType, T.NumericType):
            floats.setdefault(family or "DEFAULT_FLOAT", []).append((feature, value.cast("double")))
        elif isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            said = value.cast("string")
            strings.setdefault(family or "DEFAULT_STRING", []).append(said if feature == "RAW" else F.concat(F.lit(feature + ":"), said))
        else:
            raise TypeError(f"column {f.name!r} has type {f.dataType.simpleString()}, which features can't hold")
    columns = [F.col(f"`{c}`") for c in ids]
    if bias:
        strings[BIAS] = [F.lit("B")]
    if missing:
        strings[MISS] = missing
    columns += [F.array_distinct(F.array_compact(F.array(*v))).alias(f"s:{k}") for k, v in strings.items()]
    columns += [F.map_filter(F.create_map(*[x for name, c in v for x in (F.lit(name), c)]), lambda k, x: x.isNotNull()).alias(f"f:{n}") for n, v in floats.items()]
    if labels is not None:
        columns.append(labels.alias(f"f:{LABEL}"))
    if meta:
        columns.append(F.map_from_entries(F.array(*meta)).alias("metadata"))
    return FeatureSet(df.select(*columns))


def to_nested(fs: FeatureSet) -> DataFrame:
    """One struct column ``features`` of three maps by family; families that a row lacks are absent."""

    def packed(kind: str, names: list[str], type_: str) -> Column:
        entries = [F.when(F.col(f"`{kind}:{n}`").isNotNull(), F.struct(F.lit(n).alias("key"), F.col(f"`{kind}:{n}`").alias("value"))) for n in names]
        return F.map_from_entries(F.array_compact(F.array(*entries))).cast(type_) if entries else F.lit(None).cast(type_)

    return fs.df.select(
        *fs.keep_ids(),
        F.struct(
            packed("s", fs.string_families, f"map<string,{STRINGS}>").alias("string_features"),
            packed("f", fs.float_families, f"map<string,{FLOATS}>").alias("float_features"),
            packed("d", fs.dense_names, DENSE).alias("dense_features"),
        ).alias("features"),
    )


def from_nested(df: DataFrame, strings: Iterable[str] = (), floats: Iterable[str] = (), dense: Iterable[str] = (), column: str = "features") -> FeatureSet:
    """The families named, out of a nested column."""
    take = lambda kind, part, names: [F.col(f"{column}.{part}")[n].alias(f"{kind}:{n}") for n in names]
    ids = [c for c in df.columns if c != column]
    return FeatureSet(df.select(*ids, *take("s", "string_features", strings), *take("f", "float_features", floats), *take("d", "dense_features", dense)))


def exploded(df: DataFrame, ids: Iterable[str], what: Column, *names: str, at: str | None = None) -> DataFrame:
    """(ids, at, names): a row for every element of an array or entry of a map, none for empty or null ones.

    Under an ``explode`` Spark puts a filter on the same expression, which computes it up to two times more; the outer form
    has no such filter, and its rows for empty ones, the only ones without a position, are dropped afterwards."""
    rows = df.select(*ids, F.posexplode_outer(what).alias(at or "_at", *names)).where(F.col(at or "_at").isNotNull())
    return rows if at else rows.drop("_at")


def packed(fs: FeatureSet, ids: list[str] | None = None, skip: Iterable[str] = ()) -> DataFrame:
    """The packed layout (ids, _items): a row's features as one array of (family, feature, value), which ``flatten`` makes
    rows of."""
    ids = fs.keep_ids() if ids is None else ids
    skip = set(skip)
    item = lambda n, k, v: F.struct(F.lit(n).alias("family"), k.alias("feature"), v.cast("double").alias("value"))

    def of_strings(n: str) -> Column:
        return F.transform(F.coalesce(fs.strings(n), no_strings()), lambda s: item(n, s, F.lit(1.0)))

    def of_floats(n: str) -> Column:
        return F.transform(F.map_entries(F.coalesce(fs.floats(n), no_floats())), lambda e: item(n, e["key"], e["value"]))

    arrays = [of_strings(n) for n in fs.string_families if n not in skip] + [of_floats(n) for n in fs.float_families if n not in skip]
    return fs.df.select(*ids, F.concat(*arrays).alias(ITEMS))


def unpacked(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The long layout of packed rows."""
    return exploded(rows, ids, F.col(ITEMS), "x").select(*ids, "x.family", "x.feature", "x.value")


def flatten(fs: FeatureSet, ids: list[str] | None = None, skip: Iterable[str] = (), dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """The long layout (ids, family, feature, value): strings weigh 1; a string and a float family of one name meet.
    A share ``dropout`` of the values is left out, by a hash of where they are."""
    ids = fs.keep_ids() if ids is None else ids
    long = unpacked(packed(fs, ids, skip), ids)
    return long.where(F.pmod(F.xxhash64(F.lit(seed), *ids, "family", "feature"), F.lit(1 << 20)) >= int(dropout * (1 << 20))) if dropout else long


def difference(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
    """What two long tables don't share: (ids, family, feature, value_a, value_b), null for a side that lacks a feature."""
    key = [*ids, "family", "feature"]
    both = a.select(*key, F.col("value").alias("value_a")).join(b.select(*key, F.col("value").alias("value_b")), key, "full")
    return both.where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def unflatten(long: DataFrame, ids: list[str], families: Iterable[str]) -> FeatureSet:
    """Float families back from the long layout."""
    picked = [F.map_from_entries(F.collect_list(F.when(F.col("family") == n, F.struct("feature", "value")))).alias(f"f:{n}") for n in families]
    return FeatureSet(long.groupBy(*ids).agg(*picked))


def merge_context(context: FeatureSet, items: FeatureSet, on: list[str]) -> FeatureSet:
    """Items with their context's families; a context family takes the place of an item's family of the same name."""
    mine = [c for c in context.df.columns if c[:2] in ("s:", "f:", "d:")]
    joined = items.df.join(context.df.select(*on, *[F.col(f"`{c}`").alias(f"ctx {c}") for c in mine]), on, "left")
    merged = {c: F.coalesce(F.col(f"`ctx {c}`"), F.col(f"`{c}`")) if c in items.df.columns else F.col(f"`ctx {c}`") for c in mine}
    return FeatureSet(joined.withColumns(merged).drop(*[f"ctx {c}" for c in mine]))


Transform = Callable[[FeatureSet], FeatureSet]
