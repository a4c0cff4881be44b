"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass one sets two positions of a bit array for every text's hash and keeps the positions that were set at least
twice; pass two tests every row against them. A row whose two positions are not both in that filter is certainly the
only one of its text and goes straight through; only the others, with a digest, are shuffled and grouped.

The filter has 16 bits a row up to ``max_bits`` (2^28 bits: 32 MB), which is the proven size of its broadcast. Past
16 million rows the filter fills up: the result stays exact, but more rows, and in the end all, take the shuffle of
narrow digests (about 80 bytes a row). Positions that are set twice are found by counting positions, combined before
the shuffle (about 10 bytes a row): bitmaps made by each partition and merged by OR would be 32 MB a partition, and OR
alone can't tell a position set in two partitions from one set in one.

Edge cases: a null text counts as empty and all empty texts are one group; a null doc_id sorts after all others; of
rows that repeat doc_id and text exactly one stays (any one, where other columns differ); an empty table gives an empty
table; extra columns are carried by ``keep_one`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import MAX_BITS, ROW_KEY, bit_filter, checkpointed, drop_rows, maybe_in, row_key, skew_lookup


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def _decide(digests: DataFrame) -> DataFrame:
    """Digests (doc_id, n, sha, rid) with keep_id, group_size and kept. Groups are pre-aggregated before the shuffle
    and a hot group's rows stay where they are."""
    groups = digests.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n")).alias("n"), F.isnull("doc_id").alias("none"), "doc_id", "rid")).alias("best"),
    )
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    return skew_lookup(digests, groups, "sha").withColumn("kept", F.col("rid") == F.col("keep_rid"))


def _digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n code points, hash h, digest sha, row number rid and ``more`` for every row, written once: texts are
    normalised here and nowhere else."""
    body = normalised(F.col("text"))
    size = F.length(F.coalesce("text", F.lit(""))).alias("n")
    one = docs.select("doc_id", size, *more, body.cast("binary").alias("body"))
    return checkpointed(one.select("doc_id", "n", *[c for c in one.columns[2:-1]], F.xxhash64("body").alias("h"), F.sha2("body", 256).alias("sha"), F.monotonically_increasing_id().alias("rid")))


def exact_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs)
    pages, bits = bit_filter(digests.select("h"), max_bits, at_least=2)
    marked = maybe_in(digests, pages, bits, "h")
    columns = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    alone = marked.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    again = checkpointed(marked.where("_maybe").select("doc_id", "n", "sha", "rid"))
    return alone.unionByName(_decide(again).select(*columns))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every text, all columns as they were. Texts are normalised once, for their digests; rows
    that certainly stay pass straight through, and only those that may go are shuffled."""
    digests = _digests(docs, *row_key())
    pages, bits = bit_filter(digests.select("h"), max_bits, at_least=2)
    again = checkpointed(maybe_in(digests.select(*ROW_KEY, "doc_id", "n", "h", "sha", "rid"), pages, bits, "h").where("_maybe").drop("_maybe", "h"))
    decided = checkpointed(_decide(again).where("group_size > 1").select(*ROW_KEY, "kept"))
    gone, stays = (decided.where(c).select(*ROW_KEY) for c in (~F.col("kept"), F.col("kept")))
    repeated = stays.join(gone.distinct(), ROW_KEY, "left_semi")
    return drop_rows(docs, gone.distinct().join(stays, ROW_KEY, "left_anti"), repeated)
