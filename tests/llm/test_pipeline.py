"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from tessella.llm import catalogue, mixing
from tests.llm.test_operators import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    from tessella.llm.bpe import default_path

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    best = {}
    for r in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[key] = min(best.get(key, (1, 0, None)), (-len(r["text"]), r["doc_id"], r), key=lambda x: x[:2])
    kept = [b[2] for b in best.values()]
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in kept}
    comp = brute_components([(a, a) for a in fp] + [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    kept = [r for r in kept if comp[r["doc_id"]] == r["doc_id"]]
    n = {}
    for r in kept:
        n[r["source"]] = n.get(r["source"], 0) + 1
    weights = {s: w for s, w in mixing.WEIGHTS.items() if s in n}
    want = []
    own = Tokenizer.from_file(default_path())
    for r in kept:
        if r["source"] in weights:
            rate = weights[r["source"]] / sum(weights.values()) * len(kept) / n[r["source"]]
            u = int(hashlib.md5(f"{mixing.SEED}:1:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
            copies = int((np.array(mixing.cumulative(rate)) <= u).sum())
            ids = own.encode(r["text"], add_special_tokens=False).ids
            want += [(r["doc_id"], ids, len(ids), hashlib.sha256(r["text"].encode()).hexdigest())] * copies
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(want)


def test_stages_return_documents_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 11))
