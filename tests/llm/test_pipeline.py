"""The pipeline against a brute-force version of its stages on a small folder of tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from emberlane.llm import base, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        rows.append((i, " ".join(w if good else [x.upper() + "$$$" for x in w])))
        if i % 2:
            labels.append((i, int(good), 0))
    for i in range(400, 430):
        w = rows[i - 400][1].split()
        if i % 3 == 0:
            w[0] = "edited"
        rows.append((i, " ".join(w)))
    benchmark = [(1, " ".join(rows[7][1].split()[:12])), (2, " ".join(rows[50][1].split()[-10:]))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), benchmark


def expected(spark, path, rows, benchmark):
    scored = quality.report(base.table(spark, path, "documents"), base.table(spark, path, "labels")).collect()
    kept = {r["doc_id"] for r in scored if r["predicted"]}
    groups = defaultdict(list)
    for i in kept:
        groups[rows[i].lower()].append(i)
    kept = {max(g) for g in groups.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in kept for w in [rows[i].lower().split()]}
    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = {i for i in kept if find(i) == i}
    cut = lambda t: re.findall("[0-9a-z]+", t.lower())
    grams = {tuple(w[k : k + 10]) for _, t in benchmark for w in [cut(t)] for k in range(len(w) - 9)}
    return {i for i in kept if not any(tuple(w[k : k + 10]) in grams for w in [cut(rows[i])] for k in range(len(w) - 9))}


def test_pipeline(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rows, benchmark = folder
    want = expected(spark, path, rows, benchmark)
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == want and 100 < len(want) < 400
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in list(want)[:40]:
        ids, at = np.array([*library.encode(rows[i], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = base.table(spark, path, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
