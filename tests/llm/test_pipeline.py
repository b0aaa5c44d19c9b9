"""The pipeline's stages on the smallest tables, each against plain Python over its own input."""

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from cmdlake.llm import packing

from .test_edges import base_spans, shingle_set

DATA = "/root/testdata/sf0.001"


def representatives(rows):
    sets = [shingle_set(r["text"]) for r in rows]
    label = list(range(len(rows)))
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    shared = Counter((a, b) for ids in by.values() for k, b in enumerate(ids) for a in ids[:k])
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for i, c in enumerate(label):
        low[c] = min(low.get(c, rows[i]["doc_id"]), rows[i]["doc_id"])
    return sorted(low.values())


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    seen = [[r.asDict() for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([r.asDict() for r in docs.collect()])
    raw, known, unique, clean, mixed, packed = seen
    assert all(set(r) == set(names) for rows in seen[:5] for r in rows)
    assert sorted(r["doc_id"] for r in known) == sorted(r["doc_id"] for r in raw if any(c.isalpha() for c in r["text"] or ""))
    assert sorted(r["doc_id"] for r in unique) == representatives(known)
    before = {r["doc_id"]: r["text"] for r in unique}
    assert len(clean) == len(unique)
    for r in clean:
        spans = base_spans(before[r["doc_id"]])
        assert not base_spans(r["text"]) and (r["text"] == before[r["doc_id"]] or spans or "[pem]" in r["text"] or "[jwt]" in r["text"])
    size = {r["doc_id"]: len(r["text"].split()) for r in clean}
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted({r["source"] for r in clean}))}
    total = {s: sum(size[r["doc_id"]] for r in clean if r["source"] == s) for s in weight}
    capped = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in weight if s not in capped and weight[s] * level >= 3 * total[s]}
        if not over:
            break
        capped |= over
    for s in weight:
        target = 3 * total[s] if s in capped else weight[s] * level
        got = sum(size[r["doc_id"]] for r in mixed if r["source"] == s)
        assert abs(got - target) <= max(size[r["doc_id"]] for r in clean if r["source"] == s) / 2 + 1
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokens = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r["length"] for r in packed) == tokens
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= 1.1 * np.ceil(tokens / 1024) + spark.sparkContext.defaultParallelism
