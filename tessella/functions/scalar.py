"""Column expressions for numbers, maps, strings, dates and places."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INT = 2147483647
STRINGS, FLOATS, DENSE = "array<string>", "map<string,double>", "map<string,array<double>>"


def no_floats() -> Column:
    return F.create_map().cast(FLOATS)


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def truncated(x: Column) -> Column:
    """Towards zero, NaN to 0, clamped to 32 bits."""
    return F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(-float(MAX_INT) - 1)), F.lit(float(MAX_INT))).cast("int")


def quantise(x: Column, step: float | Column) -> Column:
    step = step if isinstance(step, Column) else F.lit(float(step))
    return step * truncated(x / step)


def upsert(base: Column, new: Column) -> Column:
    """Entries of ``base`` with those of ``new`` put over them; where ``base`` is empty, ``new`` as it is."""
    old = F.coalesce(base, no_floats())
    return once(new, lambda n: F.when(F.size(old) == 0, n).otherwise(F.map_zip_with(old, n, lambda k, a, b: F.coalesce(b, a))))


def union(base: Column, new: Column) -> Column:
    return F.array_union(F.coalesce(base, no_strings()), new)


def pairs(m: Column) -> Column:
    return F.map_entries(m)


def to_floats(entries: Column) -> Column:
    """A map from (key, value) structs in which the last of equal keys wins: an entry stays where the first of its key, from
    the end, is itself."""

    def last(e: Column) -> Column:
        back = F.reverse(F.transform(e, lambda x: x["key"]))
        stays = lambda b: F.filter(e, lambda x, i: F.coalesce(F.array_position(b, x["key"]) == (F.size(e) - i).cast("long"), F.lit(True)))
        return once(back, stays)

    return F.map_from_entries(once(entries, last)).cast(FLOATS)


def distinct_floats(entries: Column) -> Column:
    """A map from (key, value) structs whose keys are known to differ."""
    return F.map_from_entries(entries).cast(FLOATS)


def text(x: Column) -> Column:
    """A double as Java writes it."""
    return x.cast("double").cast("string")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row: as a lambda's argument it is never inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counts(tokens: Column) -> Column:
    """How often each string occurs, as a map: runs in the sorted array, so long texts cost no square of their length."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        entry = lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("key"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("double").alias("value")))
        return F.when(F.size(s) == 0, no_floats()).otherwise(F.map_from_entries(once(starts, entry)))

    return F.when(tokens.isNotNull(), once(F.sort_array(tokens), runs))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def platt(score: Column, offset: float = 0.0, slope: float = 1.0) -> Column:
    return sigmoid(F.lit(offset) + F.lit(slope) * score)


def softmax(xs: Column) -> Column:
    """Of an array of doubles, shifted by its largest."""
    shifted = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(shifted, lambda e: e / F.greatest(F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b), F.lit(1e-10)))


def log_loss(p: Column, y: Column) -> Column:
    return -y * F.ln(p) - (1 - y) * F.ln(1 - p)


def relative_loss(p: Column, y: Column) -> Column:
    return F.abs(F.try_divide(p - y, y))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cap_norm(a: Column, most: float) -> Column:
    """An array scaled down so that its norm is at most ``most``."""
    return F.transform(a, lambda x: x * F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(l2(a), F.lit(1e-12))))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def min_kernel(a: Column, b: Column) -> Column:
    """Histogram intersection of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def maxout_halves(a: Column) -> Column:
    """The largest of the second half less the largest of the first."""
    half = F.floor(F.size(a) / 2).cast("int")
    return F.array_max(F.slice(a, half + 1, half)) - F.array_max(F.slice(a, F.lit(1), half))


def weibull(x: Column, k: float, scale: float) -> Column:
    """Share below x."""
    return 1 - F.exp(-F.pow(x / scale, F.lit(float(k))))


def weibull_inverse(p: Column, k: float, scale: float) -> Column:
    return scale * F.pow(-F.ln(1 - p), F.lit(1.0 / k))


def log2(x: Column) -> Column:
    return F.ln(x) / math.log(2.0)


UNITS = {"miles": 60 * 1.1515, "kilometers": 60 * 1.1515 * 1.609344, "nautical_miles": 60 * 1.1515 * 0.8684}


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "miles") -> Column:
    """Spherical distance by the law of cosines."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon1 - lon2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))) * UNITS[unit]


def day(x: Column) -> Column:
    """A yyyy-MM-dd string as a date, null where it isn't one."""
    return F.try_to_date(x, "yyyy-MM-dd")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def date_range(first: Column, last: Column) -> Column:
    """Every date from first to last, both included."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def day_of_week(x: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(x) - 1


def feature_hash(family: Column, feature: Column) -> Column:
    return F.xxhash64(family, feature)
