"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share
at least four positional bytes. Any four of eight positions contain one of the 20 position triples below (a covering
design), so the index is keyed by (triple, its three bytes): its lists hold N / 2^24 fingerprints where those of
single bytes would hold N / 256. Members of a list share three positional bytes. Their other bytes are tallied from
postings by (position, byte) within the list; only pairs whose tally reaches four are verified bit by bit. Lists are
cut into blocks of BLOCK fingerprints, a pair of blocks to a task, so that no list has to fit in one; each block
reports a spanning forest, not its pairs.

Identical fingerprints are merged first, so exact copies cost one entry.

Edge cases: null and empty texts have no word and fingerprint zero, and are linked like any other; texts of fewer
than four words give one shingle of all their words; repeated rows share a fingerprint; a null doc_id takes part but
is never a component_id unless nothing else is reachable; an empty table gives an empty table; the hashes of very
long texts are added up in pieces of PIECE shingles; columns other than doc_id and text are ignored, and ``keep_one``
carries them whatever their names. Of a component whose ids are all null, or that repeats its smallest id, ``keep_one``
keeps the row with the smallest hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ROW_KEY, checkpointed, components, drop_rows, row_key, skew_lookup

WORDS = 4
MAX_BITS = 4
BLOCK = 4096
PIECE = 1 << 16
SHORT = 256
#: The triples of positions: within three groups of 3, 3 and 2 positions, and two of one group with one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = sorted(
    {g for g in GROUPS if len(g) == 3}
    | {tuple(sorted((*two, one))) for i, g in enumerate(GROUPS) for two in combinations(g, 2) for one in GROUPS[(i + 1) % 3]}
)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, 42)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        j = min(n, i + PIECE)
        spans = zip(starts[i:j].tolist(), ends[i + words - 1 : j + words - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, j - i)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed bigint."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class Postings:
    """Members of one list by (position, byte): for each position their numbers in order of byte, and where each begins."""

    def __init__(self, fps: np.ndarray):
        self.bytes = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
        self.members, self.begin = [], []
        for p in range(8 if len(fps) > SHORT else 0):
            column = self.bytes[:, p]
            self.members.append(np.argsort(column, kind="stable"))
            self.begin.append([0, *np.cumsum(np.bincount(column, minlength=256)).tolist()])

    def tally(self, member: int) -> np.ndarray:
        """How many positional bytes every member shares with this one; short lists are tallied member by member."""
        if not self.members:
            return (self.bytes == self.bytes[member]).sum(axis=1)
        found = [self.members[p][self.begin[p][b] : self.begin[p][b + 1]] for p, b in enumerate(self.bytes[member].tolist())]
        return np.bincount(np.concatenate(found), minlength=len(self.bytes))


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (member, root) that join the distinct fingerprints (uint64) of one block pair just as all links would.

    Pairs are retained where the tally of shared positional bytes reaches the 8 - max_bits that a link guarantees, and
    only those are verified."""
    index, fresh, out = Postings(fps), np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not fresh[root]:
            continue
        fresh[root] = False
        frontier = [root]
        while frontier:
            member = frontier.pop()
            retained = np.flatnonzero((index.tally(member) >= 8 - max_bits) & fresh)
            near = retained[np.bitwise_count(fps[retained] ^ fps[member]) <= max_bits]
            fresh[near] = False
            frontier += near.tolist()
            out += [(int(f), int(fps[root])) for f in fps[near]]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, lo, hi, fp) sorted by (key, lo, hi): the forest of every run of equal (key, lo, hi)."""

    def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    held = np.empty((0, 4), np.int64)
    for batch in batches:
        rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        bounds = np.concatenate(([0], cuts))
        held = rows[bounds[-1] :]
        sizes = np.diff(bounds)
        found: list[tuple[int, int]] = []
        fps = rows[:, 3].view(np.uint64) if rows.flags.c_contiguous else np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        for at in np.flatnonzero(sizes > 1):
            found += forest(np.unique(fps[bounds[at] : bounds[at + 1]]))
        yield emit(found)
    if len(held) > 1:
        yield emit(forest(np.unique(np.ascontiguousarray(held[:, 3]).view(np.uint64))))


def links(distinct: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp bigint): links (a, b) whose components are those of all pairs that differ in at
    most four bits."""
    fp = F.col("fp")
    keys = []
    for n, triple in enumerate(TRIPLES):
        key = F.lit(n).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    posts = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    sizes = checkpointed(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    large = sizes.count()
    own = F.lit(0)
    if large == 0:
        blocks = posts.select("key", own.alias("lo"), own.alias("hi"), "fp")
    else:
        known = F.broadcast(sizes) if large <= 100_000 else sizes
        cut = posts.join(known, "key", "left").withColumn("c", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        mine = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
        pairs = F.transform(
            F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != mine)),
            lambda j: F.struct(F.least(j, mine).alias("lo"), F.greatest(j, mine).alias("hi")),
        )
        blocks = cut.select("key", F.explode(pairs).alias("p"), "fp").select("key", "p.lo", "p.hi", "fp")
    order = ["key", "lo", "hi"]
    blocks = blocks.select("key", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "fp")
    return blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links, "a long, b long").distinct()


def _components_of(fps: DataFrame) -> DataFrame:
    """(fp, component_id, group) for the distinct fingerprints of ``fps`` (doc_id, fp); ``group`` is the smallest
    fingerprint that is reachable."""
    reps = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(reps.select("fp")))
    linked = checkpointed(reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("group")))
    roots = linked.groupBy("group").agg(F.min("first").alias("component_id"))
    return skew_lookup(linked, roots, "group").select("fp", "component_id", "group")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id)."""
    fps = checkpointed(fingerprints(docs))
    of_fp = _components_of(fps)
    return skew_lookup(fps, of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.fromiter((fingerprint(t.as_py()) for t in batch.column(0)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(h.view(np.int64))], [*batch.schema.names[1:], "fp"])


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component, all columns as they were: the one of the smallest doc_id (null last),
    then of the smallest hash of its text. Only the keys of dropped rows are joined back."""
    keyed = docs.select("text", *row_key())
    fps = checkpointed(keyed.mapInArrow(_keyed, "_k0 long, _k1 boolean, _k2 long, _k3 long, fp long"))
    of_fp = _components_of(fps.select(F.when(~F.col("_k1"), F.col("_k0")).alias("doc_id"), "fp"))
    rows = checkpointed(skew_lookup(fps, of_fp.select("fp", "group"), "fp").select(*ROW_KEY, "group"))
    order = ["_k1", "_k0", "_k2", "_k3"]
    best = rows.groupBy("group").agg(F.min(F.struct(*order)).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    beside = checkpointed(skew_lookup(rows, best.select("group", "best"), "group").select(*ROW_KEY, (F.struct(*order) == F.col("best")).alias("stays")))
    gone = beside.where(~F.col("stays")).select(*ROW_KEY)
    repeated = beside.where("stays").groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ROW_KEY)
    return drop_rows(docs, gone, repeated)
