"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is read as sentences, a sentence as units: runs of letters with inserted signs removed ("cl*wn", "m.o.r.o.n"),
neighbouring single letters joined ("i d i o t"), accents folded. The kernel of two units is the gap-weighted count of
common subsequences of three letters, each occurrence weighing DECAY to the power of its span (at most SPAN), divided
by both units' norms; values under FLOOR count as none, and the power SHARP stresses close matches. The kernel of a
sentence and a landmark is the sum over the sentence's units, so an insult with gaps or inserted letters still meets its
landmark. Without FLOOR that would be positive semidefinite; the few directions in which it isn't are left out of the
inverse root. Letters other than a to z fold to OTHER symbols by code point, which tells the letters of one alphabet
apart.

Landmarks are units whose share of toxic documents is most in excess, a few of each family of close ones, and common
units besides. Sentences of labelled
documents inherit the document's label; mapped by the landmarks' inverse root kernel matrix, they train a linear
squared-hinge SVM by Newton steps. A document's score is a logistic model, fitted on training documents, of its
strongest sentence, its summed evidence, the numbers of distinct units in evidence at LEVELS, and its length.

Bounds on what is learned from (documented parameters): about ``docs_a_class`` different labelled documents of each
class and ``n_sentences`` of their sentences, picked by hashes of id, text and sentence number, so that runs repeat.

Edge cases: null and empty texts have no unit and get the score of a text without evidence; texts of any length are
read whole, units over LONG letters in overlapping windows; repeated rows get equal scores; labels without document or
with null count for nothing, of labels that repeat a doc_id the largest; with only one class every score is that
class's; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed
from tessella.llm.langid import held_out

OTHER = 94
LETTERS = 160
ORDER = 3
SPAN = 7
DECAY = 0.7
FLOOR = 0.35
SHARP = 3
LONG = 32
LEVELS = (0.1, 0.25, 0.5)
ALIKE = 8
DOCS_A_CLASS = 1500
SENTENCES = 30_000
LANDMARKS = 160
KNOWN = 300_000

_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
_GAPPED = re.compile(r"(?<!\S)(?:[^\W\d_][\W\d_]{0,2}\s){2,}[^\W\d_](?!\w)")


class _Fold(dict):
    """Translation to a-z, OTHER symbols (from U+00A1 on) for other letters, and nothing for what isn't a letter."""

    def __missing__(self, point: int):
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        if base.isspace():
            out = " "
        elif "a" <= base <= "z":
            out = base
        else:
            out = chr(0xA1 + ord(base) % OTHER) if base.isalpha() else None
        self[point] = out
        return out


_FOLD = _Fold()


def units(sentence: str) -> list[str]:
    if _GAPPED.search(sentence):
        sentence = _GAPPED.sub(lambda m: re.sub(r"[\W\d_]", "", m[0]), sentence)
    out = []
    for unit in sentence.translate(_FOLD).split():
        if len(unit) <= LONG:
            if len(unit) >= ORDER:
                out.append(unit)
        else:
            out += [unit[i : i + LONG] for i in range(0, len(unit) - SPAN, LONG - SPAN)]
    return out


def sentences(text: str | None) -> list[list[str]]:
    return [u for s in _SENTENCE.split(text or "") if (u := units(s))]


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a unit of some length with a span of at most SPAN, and their weights."""
    at = np.array([(i, *rest) for i in range(length) for rest in combinations(range(i + 1, min(length, i + SPAN)), ORDER - 1)], np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def _triples(same_length: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(same_length[0])
    letters = np.frombuffer("".join(same_length).encode("latin-1"), np.uint8).reshape(-1, n).astype(np.int64) - 97
    at, weights = _places(n)
    code = letters[:, at[:, 0]]
    for k in range(1, ORDER):
        code = code * LETTERS + letters[:, at[:, k]]
    return code, weights


def _norms(code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(code)), code.shape[1])
    _, back = np.unique(rows * LETTERS**ORDER + code.ravel(), return_inverse=True)
    sums = np.bincount(back, np.tile(weights, len(code)))
    owner = np.zeros(len(sums), np.int64)
    owner[back] = rows
    return np.sqrt(np.bincount(owner, sums**2, len(code)))


class Landmarks:
    """Kernel values between units and the landmarks, through the landmarks' explicit subsequences."""

    def __init__(self, words: list[str]):
        self.words = words
        ids: dict[int, int] = {}
        entries = []
        for j, w in enumerate(words):
            code, weights = _triples([w])
            norm = _norms(code, weights)[0]
            for c, v in zip(code[0].tolist(), weights.tolist(), strict=True):
                entries.append((ids.setdefault(c, len(ids) + 1), j, v / norm))
        self.row = np.zeros(LETTERS**ORDER, np.int32)
        self.row[list(ids)] = list(ids.values())
        self.table = np.zeros((len(ids) + 1, len(words)), np.float32)
        for i, j, v in entries:
            self.table[i, j] += v

    def kernel(self, tokens: list[str]) -> np.ndarray:
        """One row a token: its sharpened kernel value with every landmark."""
        out = np.zeros((len(tokens), len(self.words)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            by_length.setdefault(len(t), []).append(i)
        for places in by_length.values():
            for i in range(0, len(places), 512):
                part = places[i : i + 512]
                code, weights = _triples([tokens[p] for p in part])
                rows = self.row[code]
                dots = np.zeros((len(part), len(self.words)), np.float32)
                for k in range(rows.shape[1]):
                    dots += self.table[rows[:, k]] * np.float32(weights[k])
                # the norm is at least that of the weights alone, so this leaves out only values under FLOOR
                near = np.flatnonzero(dots.max(axis=1, initial=0) >= FLOOR * np.sqrt((weights**2).sum()) * 0.999)
                if len(near):
                    value = dots[near] / _norms(code[near], weights)[:, None]
                    out[np.array(part)[near]] = np.where(value >= FLOOR, value, 0) ** SHARP
        return out


def train_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a class-balanced squared-hinge SVM, by Newton steps; y is 1 or -1."""
    x = np.hstack((x, np.ones((len(x), 1))))
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-9
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xs, cs = x[inside], cost[inside]
        new = np.linalg.solve((xs * cs[:, None]).T @ xs + keep, (xs * (cs * y[inside])[:, None]).sum(axis=0))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def train_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression by Newton steps; y is 0 or 1."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    """A trained scorer. ``unit`` weighs a unit's kernel values, ``bias`` is the SVM's, ``final`` the logistic layer's."""

    def __init__(self, words: list[str], unit: np.ndarray, bias: float, final: np.ndarray | None = None, constant: float = 0.0):
        self.words, self.unit, self.bias, self.final, self.constant = words, unit, bias, final, constant
        self.known: dict[str, float] = {}
        self.landmarks: Landmarks | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "landmarks": None}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of every text: strongest sentence, summed evidence, numbers of distinct units above each of LEVELS, length."""
        if self.landmarks is None:
            self.landmarks = Landmarks(self.words)
        if len(self.known) > KNOWN:
            self.known.clear()
        known, read = self.known, [sentences(t) for t in texts]
        new = list({u for doc in read for s in doc for u in s if u not in known})
        if new:
            known.update(zip(new, (self.landmarks.kernel(new) @ self.unit).tolist(), strict=True))
        out = np.zeros((len(texts), 3 + len(LEVELS)))
        for i, doc in enumerate(read):
            strongest = max((sum(known[u] for u in set(s)) for s in doc), default=0.0)
            every = np.array([known[u] for u in {u for s in doc for u in s}])  # a unit that is said again adds nothing
            up = [(every > level).sum() for level in LEVELS]
            out[i] = np.log1p([max(0.0, strongest), max(0.0, every[every > 0].sum()), *up, len(every)])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.final is None:
            return np.full(len(texts), self.constant)
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.final[:-1] + self.final[-1], -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units with the number of toxic and other documents of this task that have them."""
    seen: Counter = Counter()

    def emit() -> pa.RecordBatch:
        words = list(seen.items())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([w[0][0] for w in words], pa.string()), pa.array([w[0][1] for w in words], pa.int32()), pa.array([w[1] for w in words], pa.int64())], ["unit", "toxic", "n"])

    for batch in batches:
        for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            seen.update((u, toxic) for u in {u for s in sentences(text.as_py()) for u in s})
            if len(seen) > 200_000:
                yield emit()
    yield emit()


def diverse(ranked: list[str], most: int, alike: int = ALIKE, close: float = 0.5) -> list[str]:
    """The first ``most`` units in order of rank, without those that already have ``alike`` close ones before them."""
    near = Landmarks(ranked).kernel(ranked) >= close**SHARP if ranked else np.zeros((0, 0), bool)
    chosen: list[int] = []
    for i in range(len(ranked)):
        if len(chosen) < most and near[i, chosen].sum() < alike:
            chosen.append(i)
    return [ranked[i] for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, docs_a_class: int = DOCS_A_CLASS, n_sentences: int = SENTENCES, n_landmarks: int = LANDMARKS) -> Model:
    """Learn from the labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], np.zeros(0), 0.0, None, float(next(iter(sizes), 0)))
    part = lambda n: F.when(F.col("toxic") == 1, docs_a_class / max(1, n.get(1, 1))).otherwise(docs_a_class / max(1, n.get(0, 1))) * (1 << 20)
    chosen = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part(sizes)) & F.col("toxic").isin(0, 1))  # about 2 x docs_a_class rows: the broadcast's bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    met = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # more than chosen where ids repeat
    h = F.xxhash64("doc_id", "text")
    few = rows.where(F.pmod(h, F.lit(1 << 20)) < part({t: n if n > 2 * docs_a_class else 1 for t, n in met.items()}))
    sample = checkpointed(few.withColumn("h", h).dropDuplicates(["doc_id", "h"]).select("h", "toxic", "text").repartition(16, "h"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model([], np.zeros(0), 0.0, None, float(next(iter(totals), 0)))
    pos, neg = float(totals[1]), float(totals[0])
    counts = sample.mapInArrow(_count, "unit string, toxic int, n long").groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    p = (F.col("t") + F.col("c") + 1) / (pos + neg + 2)
    excess = (F.col("t") / pos - F.col("c") / neg) / F.sqrt(p * (1 - p) * (1 / pos + 1 / neg))
    ranked = checkpointed(counts.where("t + c > 1").select("unit", excess.alias("z"), (F.col("t") + F.col("c")).alias("n")))
    third = n_landmarks // 3
    strong = diverse([r["unit"] for r in ranked.where("z > 0").orderBy(F.col("z").desc(), "unit").limit(10 * n_landmarks).collect()], n_landmarks - third)
    common = [r["unit"] for r in ranked.orderBy(F.col("n").desc(), "unit").limit(third).collect()]
    words = list(dict.fromkeys(strong + common))
    landmarks = Landmarks(words)
    values, vectors = np.linalg.eigh(landmarks.kernel(words).astype(float))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])

    def per_sentence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(words)
        for batch in batches:
            for doc, toxic, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2), strict=True):
                found = sentences(text.as_py())
                if not found:
                    continue
                found = [sorted(set(s)) for s in found]
                rows = marks.kernel([u for s in found for u in s])
                sums = np.add.reduceat(rows, np.cumsum([0] + [len(s) for s in found[:-1]]), axis=0)
                columns = [pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([toxic] * len(found), pa.int32()), pa.array([v.tobytes() for v in sums], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "i", "toxic", "x"])

    mapped = checkpointed(sample.mapInArrow(per_sentence, "h long, i long, toxic int, x binary"))
    share = min(1.0, n_sentences / max(1, mapped.count()))
    rows = mapped.where(F.pmod(F.xxhash64("h", "i"), F.lit(1 << 20)) < share * (1 << 20)).select("toxic", "x").toPandas()
    x, y = np.frombuffer(b"".join(rows.x), np.float32).reshape(-1, len(words)), np.where(rows.toxic == 1, 1.0, -1.0)
    w = train_svm(x @ root, y)
    model = Model(words, (root @ w[:-1]).astype(np.float32), float(w[-1]))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                b = batch.slice(i, 128)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(model.features(b.column(2).to_pylist())), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(per_document, "toxic int, x array<double>").toPandas()
    model.final = train_logistic(np.stack(rows.x.to_list()), rows.toxic.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row, from its text alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                p = model.score(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int")


__all__ = ["Model", "fit", "held_out", "score", "sentences", "units"]
