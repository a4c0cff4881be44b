"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (n from 1 to 3, words padded with a space), in
order of frequency. A document gets the same list from its whole text, and the language whose profile has the least
out-of-place distance: the sum over the document's n-grams of how far their ranks differ, DEPTH for those the profile
lacks. The score is 1 minus that distance over the largest possible one.

Profiles are learned from about ``docs_a_language`` different labelled documents of every language, picked by a hash of
id and text; counts are summed on the executors. A table of more than ``max_languages`` languages is an error.

Edge cases: null text and text without a letter give `und` and score 0; ties in frequency go to the smaller n-gram,
ties in distance to the first language in order of name; repeated rows get equal results; null labels are not
learned, and rows that repeat id, text and label are learned once; with no labelled row every prediction is `und`; very
long texts are counted in pieces of PIECE characters, with what precedes a seam carried over it; other columns are
ignored. ``keep_identified`` rejects texts without a letter and those whose profile is so far from every language's
that the score is under MIN_SCORE.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 400
DOCS_A_LANGUAGE = 1500
MAX_LANGUAGES = 1000
MIN_SCORE = 0.25
PIECE = 1 << 20
SPACE = np.int64(32)


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(piece: str, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in one piece, as integers of 21 bits a character, and the last two characters to carry on.

    ``before`` are the characters carried from the piece before; anything but a letter is a space, and spaces are one."""
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate((before, np.where(_letters()[points], points, SPACE)))
    points = points[np.concatenate(([True], (points[1:] != SPACE) | (points[:-1] != SPACE)))]
    k, is_letter = len(before), points != SPACE
    one = points[k:][is_letter[k:]]
    two = (points[:-1] << 21 | points[1:])[k - 1 :]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[max(0, k - 2) :][is_letter[1:-1][max(0, k - 2) :]]
    return np.concatenate((one, two, three)), points[-2:]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, ascending, and their counts."""
    text, before = (text or "").lower() + " ", np.array([SPACE])
    if len(text) <= PIECE:
        return np.unique(_codes(text, before)[0], return_counts=True)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(text), PIECE):
        more, before = _codes(text[i : i + PIECE], before)
        more, n = np.unique(more, return_counts=True)
        codes, back = np.unique(np.concatenate((codes, more)), return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, n)), len(codes)).astype(np.int64)
    return codes, counts


def profile(text: str | None, depth: int = DEPTH) -> np.ndarray:
    codes, counts = ngrams(text)
    return codes[np.argsort(-counts, kind="stable")[:depth]]


class Profiles:
    """Learned languages and their n-grams in order of rank."""

    def __init__(self, ranked: dict[str, list[int]], depth: int = DEPTH):
        self.languages, self.depth = sorted(ranked), depth
        self.codes, self.ranks = [], []
        for language in self.languages:
            codes = np.array(ranked[language], np.int64)
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = profile(text, self.depth)
        if not len(mine) or not self.languages:
            return "und", 0.0
        own, best = np.arange(len(mine)), []
        for codes, ranks in zip(self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            best.append(np.where(codes[at] == mine, np.abs(ranks[at] - own), self.depth).sum())
        least = int(np.argmin(best))
        return self.languages[least], 1.0 - float(best[least]) / (self.depth * len(mine))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes, counts = ngrams(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


def fit(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, depth: int = DEPTH, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Learn a profile for every non-null lang of ``docs`` (doc_id, text, lang). At most max_languages x depth rows reach
    the driver."""
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than max_languages = {max_languages} values of lang")
    if not found:
        return Profiles({}, depth)
    part = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, docs_a_language / max(1, r["n"])))]), F.col("lang"))
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20)).dropDuplicates(["lang", "doc_id", "h"]).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= depth).orderBy("lang", "place").collect():
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, depth)


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every row, from its text alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def keep_identified(docs: DataFrame, model: Profiles, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is `und` or whose score is under ``min_score``, all columns as they were;
    texts don't leave their task."""

    def known(text: str | None) -> bool:
        language, score = model.predict(text)
        return language != "und" and score >= min_score

    verdict = F.arrow_udf(lambda texts: pa.array([known(t.as_py()) for t in texts], pa.bool_()), "boolean")
    return docs.where(verdict(F.col("text")))
