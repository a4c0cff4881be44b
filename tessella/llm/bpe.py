"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut at special tokens, then into words by the tokenizer's pattern. Distinct words of a batch that aren't
known yet are laid end to end in one flat array of symbols; in every round each neighbouring pair's rank is looked up
by binary search over the sorted pair keys, every word merges its lowest-ranked pair (all its occurrences from left to
right, as the tokenizers library does one by one), and the array is compacted; words without a mergeable pair drop out.

Merges of a pair that overlap ("aaa") are resolved from the left. The ids of known words of up to LONG characters are
kept in a table of at most KNOWN words a Python worker; past that it starts anew. Longer ones are forgotten with their
batch, and words are merged together up to AT_ONCE characters, so memory doesn't grow with the text.

Edge cases: null text counts as empty and gives no token; the special token's string in a text is the special token,
as the library treats it; repeated rows give equal results; very long words merge in the same rounds; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN = 400_000
LONG = 128
AT_ONCE = 1 << 21
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
NONE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A tokenizer read from a tokenizers-library JSON file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode("utf-8")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.at_once = len(set(self.made.tolist())) == len(self.made)
        self.word = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of every word, all words together."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = np.append(symbols[:-1] << 32 | symbols[1:], NONE)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            inside = np.append(owner[:-1] == owner[1:], False)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            live = lowest < NONE
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, lowest = symbols[live], owner[live], rank[live], lowest[live]
                if not len(symbols):
                    break
            hit = rank == lowest
            if (hit[1:] & hit[:-1]).any():  # overlaps: of a run of hits every second one counts, from the left
                place = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
                hit &= (place - first) % 2 == 0
            if not self.at_once:  # two merges make one token: a word's next hit might no longer be its lowest pair
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                leftmost = np.minimum.reduceat(np.where(hit, np.arange(len(hit)), len(hit)), begin)
                hit &= np.arange(len(hit)) == np.repeat(leftmost, np.diff(np.append(begin, len(owner))))
            gone = np.append(False, hit[:-1])
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)[~gone]
            owner = owner[~gone]
        flat, of = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(words)))
        ids, first = flat[order].tolist(), [0, *ends.tolist()]
        return [tuple(ids[first[i] : first[i + 1]]) for i in range(len(words))]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces = []
        for text in texts:
            runs = self.cut.split(text or "") if self.cut else [text or ""]
            pieces.append([(run, None) if i % 2 else (None, self.word.findall(run)) for i, run in enumerate(runs)])
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        new = list({w for p in pieces for _, words in p if words for w in words if w not in known})
        part, size = [], 0
        for w in chain(new, (None,)):
            if part and (w is None or size + len(w) > AT_ONCE):
                known.update(zip(part, self.merge_words([p.encode("utf-8") for p in part]), strict=True))
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w)
        out = [list(chain.from_iterable((self.special[s],) if s is not None else chain.from_iterable(map(known.__getitem__, words)) for s, words in p)) for p in pieces]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, group: int = 256) -> DataFrame:
    """doc_id, ids array<int> and decoded string for every row. ``path`` is a file on every machine (by default the
    installed vocabulary's place there)."""
    return _mapped(docs, path, group, "doc_id long, ids array<int>, decoded string", lambda ids, text: (ids, text))


def encode_digests(docs: DataFrame, path: str | None = None, group: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def digest(ids: list[int], text: str) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()

    return _mapped(docs, path, group, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def encode_checked(docs: DataFrame, path: str | None = None, group: int = 256) -> DataFrame:
    """doc_id, ids array<int>, n_tokens and decoded_sha256 for every row."""

    def checked(ids: list[int], text: str) -> tuple:
        return ids, len(ids), hashlib.sha256(text.encode("utf-8")).hexdigest()

    return _mapped(docs, path, group, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string", checked)


def _mapped(docs: DataFrame, path: str | None, group: int, schema: str, result) -> DataFrame:
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path or default_path())
        for batch in batches:
            for i in range(0, batch.num_rows, group):
                part = batch.slice(i, group)
                rows = [result(ids, tool.decode(ids)) for ids in tool.encode_batch(part.column(1).to_pylist())]
                columns = [pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
