"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document gets a number in [0, 1) from a seeded hash of its doc_id and text; inverting the Poisson distribution
whose mean is its source's target repetition rate gives its number of copies. Copies are exploded, and all rows are
dealt out and sorted by a seeded hash of (doc_id, text, copy): a global shuffle that can be repeated exactly. Rows that
repeat doc_id and text share that hash; so that no task gets all of them, rows are dealt out by it and their row number
modulo SPREAD.

A source's rate is weight x total / rows. Rates above CHUNK are the sum of independent draws of at most CHUNK each,
so that no distribution needs more than TERMS terms and e^-rate never underflows.

Edge cases: sources that ``weights`` doesn't name, null among them, form one further source of weight ``rest``;
weights count in proportion to those of the sources that have rows; weight 0 leaves a source out; rows with equal
doc_id (null is one) and text (null is empty) get equal counts; an empty table gives an empty table; extra columns are
carried whatever their names. The three new columns come last; one whose name the table has already gets `_` appended
until it is free.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import let

SEED = 7
SPREAD = 64
CHUNK = 16.0
TERMS = 96
REST = "*"
#: Production mixture: the same weight for each of twenty sources, and for all others together.
WEIGHTS = {f"src{i}": 0.05 for i in range(20)}
REST_WEIGHT = 0.05


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: float) -> list[float]:
    """P(count <= k) for k from 0 on, up to TERMS terms or the first that is 1 in double precision."""
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(TERMS):
        total += term
        out.append(total)
        term *= rate / (k + 1)
        if total + term == total and k > rate:
            break
    return out


def rates(docs: DataFrame, weights: Mapping[str, float], rest: float = 0.0, total: int | None = None) -> dict[str, float]:
    """The mean number of copies for each source that ``weights`` names, and for REST. At most len(weights) + 1 rows
    reach the driver."""
    named = F.when(F.col("source").isin(list(weights)), F.col("source")).otherwise(F.lit(REST))
    counts = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    goal = sum(counts.values()) if total is None else total
    share = {s: w for s, w in [*weights.items(), (REST, rest)] if counts.get(s)}
    whole = sum(share.values()) or 1.0
    return {s: w / whole * goal / counts[s] for s, w in share.items()}


def document_key() -> Column:
    """What a row's draws depend on: its doc_id and the md5 of its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def copies(rate_of: Mapping[str, float], seed: int, key: Column) -> Column:
    """The hash-seeded Poisson count of a row as an integer expression."""
    count: Column = F.lit(0)
    named = [s for s in rate_of if s != REST]
    for source, rate in rate_of.items():
        if rate <= 0:
            continue
        chunks = math.ceil(rate / CHUNK)
        cdf = F.array(*[F.lit(c) for c in cumulative(rate / chunks)])
        drawn = F.lit(0)
        one = lambda c: let(
            unit(F.lit(str(seed)), c.cast("string"), key), lambda u: F.size(F.filter(cdf, lambda p: p <= u))  # noqa: B023
        )
        drawn = one(F.lit(1)) if chunks == 1 else F.aggregate(F.sequence(F.lit(1), F.lit(chunks)), F.lit(0), lambda a, c: a + one(c))  # noqa: B023
        is_it = F.col("source") == source if source != REST else ~F.coalesce(F.col("source").isin(named), F.lit(False))
        count = F.when(is_it, drawn).otherwise(count)
    return count


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST_WEIGHT, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Columns of ``docs``, copies_of_doc int, copy int (from 1) and mix_key long, dealt out and ordered within every
    partition by mix_key. ``total`` is the expected number of rows, by default as many as there are."""
    rate_of = rates(docs, weights, rest, total)
    keyed = docs.select(F.struct("*").alias("_row"), F.col("source").alias("source"), document_key().alias("_key"))
    counted = keyed.select("_row", "_key", copies(rate_of, seed, F.col("_key")).cast("int").alias("_n")).where("_n > 0")
    out = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col("_copy").cast("string"), "_key")), 1, 15), 16, 10)
    dealt = out.select("_row", "_n", "_copy", order.cast("long").alias("_order"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("_spread"))
    new, taken = [], {c.lower() for c in docs.columns}
    for name in ("copies_of_doc", "copy", "mix_key"):
        while name in taken:
            name += "_"
        taken.add(name)
        new.append(name)
    placed = dealt.repartition("_order", "_spread").sortWithinPartitions("_order")
    return placed.select("_row.*", *[F.col(c).alias(n) for c, n in zip(("_n", "_copy", "_order"), new, strict=True)])
