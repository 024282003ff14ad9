"""Brute force, round trips and edge cases of the training-data operators on small tables."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.llm import base, chat, exact, jaccard, leaks, lm, packing, pii, quality, substrings, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, sketch string, winner string"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        rows.append((i, " ".join(w)))
    for i in range(60, 75):
        w = rows[i - 60][1].split()
        if w and i % 2:
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(80, None), (81, ""), (82, "  \n\t "), (83, "A b C"), (84, "a B c"), (85, " ".join(words * 60)), (86, " ".join(words * 60)), (87, "one two three four"), (88, "same " * 200)]
    rows += [(90 + i, rows[3][1].upper()) for i in range(8)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_exact_dedup(docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[(t or "").encode().lower()].append(i)
    want = {(i, max(g), len(g), i == max(g), sha(k)) for k, g in groups.items() for i in g}
    got = {tuple(r) for r in exact.report(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == want
    assert {r["doc_id"] for r in exact.keep_one(docs).collect()} == {max(g) for g in groups.values()}


def test_perfect_hash_round_trip():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    h = exact.PerfectHash.of(digests)
    assert sorted(h.numbers(digests).tolist()) == list(range(3000))
    again = exact.PerfectHash.from_bytes(h.to_bytes())
    assert (again.numbers(digests) == h.numbers(digests)).all()
    assert exact.PerfectHash.from_bytes(exact.PerfectHash.of([]).to_bytes()).numbers(digests[:2]).tolist() == [-1, -1]


def test_jaccard_components(docs, corpus):
    sets = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.report(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(sets) - 10


def test_signatures_meet_every_similar_set():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 7, 11, 16, 33, 70, 200, 555):
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            keep = a[rng.random(len(a)) > 0.12]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, max(0, len(a) // 10), dtype=np.uint64)]))
            if not len(b) or not jaccard.similar(a, b):
                continue
            meet = False
            for band_a, ka, sa in jaccard.signatures(a):
                for band_b, kb, sb in jaccard.signatures(b):
                    if band_a == band_b:
                        # any order that both share: here by value
                        meet |= bool(set(np.sort(sa)[: ka + 1].tolist()) & set(np.sort(sb)[: kb + 1].tolist()))
            assert meet
            assert len(jaccard.possible(np.array([len(a)]), [jaccard.sketch(a)], np.array([len(b)]), [jaccard.sketch(b)])) == 1


def test_substrings(docs, corpus):
    first = {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r["doc_id"]: r for r in substrings.report(docs).collect()}
    for i, t in corpus:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone)), i
        assert got[i]["kept_sha256"] == sha(b" ".join(x for k, x in enumerate(w) if k not in gone))


def test_substrings_of_hot_anchors(docs, corpus, monkeypatch):
    """The way for passages in very many documents gives the same rows."""
    want = sorted(map(tuple, substrings.report(docs).collect()))
    monkeypatch.setattr(substrings, "HOT_CONTENTS", 1)
    assert sorted(map(tuple, substrings.report(docs).collect())) == want


def test_fm_index_matches_a_scan():
    rng = np.random.default_rng(1)
    segments = [rng.integers(0, 3, rng.integers(50, 90)).astype(np.uint64) for _ in range(12)]
    segments.append(np.concatenate([segments[0][:60], segments[1][:55]]))
    ids = rng.permutation(len(segments)) + 5
    index = substrings.FMIndex(segments, ids)
    queries = [*segments, np.concatenate([segments[2][5:58], segments[3][:52], np.array([9], np.uint64)]), np.zeros(10, np.uint64)]
    none = np.iinfo(np.int64).max
    for q, found in zip(queries, index.lowest_documents(queries)):
        for k in range(len(q) - 49):
            window = q[k : k + 50].tobytes()
            owners = [int(d) for s, d in zip(segments, ids) if any(s[j : j + 50].tobytes() == window for j in range(len(s) - 49))]
            assert found[k] == min(owners, default=none)


def test_decontamination(spark, docs, corpus):
    items = [(1, " ".join(corpus[5][1].split()[3:20])), (2, "a b c"), (3, None), (4, "..."), (5, corpus[10][1]), (11, "zzz yyy"), (2, "a b c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    grams = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(str(i))
    got = {r["doc_id"]: r for r in leaks.report(docs, benchmark).collect()}
    for i, t in corpus:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if owners := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(found)).encode())


def test_decontamination_in_blocks(spark, docs, corpus, monkeypatch):
    benchmark = spark.createDataFrame([(i, corpus[i][1]) for i in range(0, 40, 5)], "item_id long, text string")
    want = sorted(map(tuple, leaks.report(docs, benchmark).collect()))
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 400)
    assert sorted(map(tuple, leaks.report(docs, benchmark).collect())) == want
    cleaned = leaks.remove_spans(docs, benchmark)
    clean_hits = leaks.report(cleaned, spark.createDataFrame([(1, corpus[5][1])], "item_id long, text string"))
    assert clean_hits.filter("doc_id = 5 and n_hit > 0").count() == 0


def _thue_morse(n: int) -> tuple[str, str]:
    """Two words that powers of any odd base modulo 2**64 can't tell apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [200, 256, 1024, 4096])
def test_regular_words_stay_apart(spark, n):
    a, b = _thue_morse(n)
    docs = table(spark, [(1, a), (2, b), (3, " ".join(["w"] * 49 + [a])), (4, " ".join(["w"] * 49 + [b])), (5, " ".join(["w"] * 49 + [b]))])
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.report(docs).collect()}
    assert (groups[1], groups[2]) == (1, 2)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.report(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 50}


def test_decontamination_of_repeated_rows_and_null_items(spark, monkeypatch):
    """Blocks of the benchmark change no row; a null item counts and has no name."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:15])), (1, " ".join(words[:15])), (1, " ".join(words[20:34])), (None, " ".join(words[5:20])), (2, "clean text"), (3, None)]
    benchmark = spark.createDataFrame([("b", " ".join(words[2:13]), "x"), (None, " ".join(words[2:13]), "x"), ("a", " ".join(words[22:33]), "x"), ("c", "", "x"), ("d", None, "x")], "item_id string, text string, doc_id string")
    docs = table(spark, rows)
    line = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    whole = line(leaks.report(docs, benchmark))
    assert len(whole) == len(rows)
    assert [r for r in whole if r[0] == 1] == sorted([(1, 15, 11, 2, sha(b"b"), True)] * 2 + [(1, 14, 11, 1, sha(b"a"), True)], key=str)
    spans, kept = line(leaks.remove_spans(docs, benchmark)), line(leaks.remove_documents(docs, benchmark))
    assert [r[0] for r in kept] == [2, 3, None] and (1, " ".join(words[:2]) + "  " + " ".join(words[13:15])) in spans
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 10)
    assert (line(leaks.report(docs, benchmark)), line(leaks.remove_spans(docs, benchmark)), line(leaks.remove_documents(docs, benchmark))) == (whole, spans, kept)


def test_keep_one_of_repeated_ids(spark):
    rows = [(5, "A"), (5, "B"), (7, "a"), (7, "a"), (None, "only null"), (None, "ONLY null"), (3, "b")]
    docs = table(spark, rows)
    assert sorted(((r["doc_id"], r["text"]) for r in exact.keep_one(docs).collect()), key=str) in ([(5, "B"), (7, "a"), (None, "ONLY null")], [(5, "B"), (7, "a"), (None, "only null")])


def test_long_texts(spark):
    """Texts beyond a piece of two megabytes, and a word beyond it."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(450_000))
    assert len(long) > base.PIECE_BYTES
    docs = table(spark, [(1, long), (2, long + " x"), (3, "z" * (base.PIECE_BYTES + 10)), (4, "short")])
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.report(docs).collect()}
    assert removed == {1: (450_000, 0), 2: (450_001, 450_000), 3: (1, 0), 4: (1, 0)}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.report(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_tokens"] for r in lm.report(docs).collect()} == {1: 450_001, 2: 450_002, 3: 2, 4: 2}
    pieces = defaultdict(int)
    for r in packing.pack(docs.filter("doc_id <> 3")).collect():
        pieces[r["doc_id"]] += r["length"]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    assert pieces[1] == len(tokenizer.encode(long, add_special_tokens=False).ids) + 1


def test_stages_on_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (exact.keep_one(empty), jaccard.keep_one(empty), leaks.remove_documents(empty, benchmark), leaks.remove_spans(empty, benchmark), quality.keep_good(empty, labels), pii.redact(empty, pii.report(empty))):
        assert df.count() == 0
    docs = table(spark, [(1, "a"), (2, None)])
    assert leaks.remove_documents(docs, benchmark).count() == 2


def test_personal_data_report(docs, spark):
    """Counts, digest and base part of the spans of every row, against the patterns alone."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == "ip":
            return all(int(x) <= 255 for x in text.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(table(spark, [(9001, "é 10.0.0.256 1.2.3.4.5 a@b a@b.c. +1 (555) 123-4567x 4111 1111 1111 1111"), (9002, None)]).select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    texts = {r["doc_id"]: r["text"] or "" for r in found.collect()}
    for r in pii.report(found).collect():
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, texts[r["doc_id"]]) if good(k, m.group())]
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == sha(line.encode())
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert [x for x in (r["spans"] or "").split(",") if x.split(":")[0] in kinds] == (line.split(",") if line else [])


def test_token_counts_equal_the_library(docs, corpus):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.report(docs).collect()}
    for i, t in corpus:
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)


def test_chunks_compose(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, machine = sentencepiece.SentencePieceProcessor(model_file=path), tokens.load(path)
    monkeypatch.setattr(tokens, "CHUNK", 5)
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(["the", " ", "  ", "\n", "é", "日", "😀", "ing", "1", "<s>", "▁"]) for _ in range(rng.randint(0, 25)))
        assert machine.count(text) == len(model.encode(text)), repr(text)


def test_packing_round_trip(docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in corpus:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


@pytest.mark.parametrize("seed", range(4))
def test_layout_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.concatenate([np.arange(1, 64), np.arange(64, 4097, 64)]), 25, False), rng.integers(1, 90, 25))}
    layout = packing.Layout.of(histogram)
    filled = Counter()
    for n, c in histogram.items():
        sequence, offset, stream = layout.locate(n, np.arange(c))
        for s, o, at in zip(sequence, offset, stream):
            if at < 0:
                filled.update((int(s), int(o) + k) for k in range(n))
            else:
                filled.update(("stream", int(at) + k) for k in range(n))
    assert max(filled.values()) == 1
    x = packing.nnls(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([3.0, 2]))
    assert (x >= 0).all() and np.allclose(np.array([[1.0, 0, 1], [0, 1, 1]]) @ x, [3, 2])


def test_language_model(docs, corpus):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {i: [*(t or "").encode().lower().split(), "END"] for i, t in corpus}
    count = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    total, scale = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    for r in lm.report(docs).collect():
        w = words[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 0.1) / scale) for x in w))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), total)
        assert r["score"] <= 1e-9


def test_language_model_keeps_every_repeated_ngram(docs, corpus, monkeypatch):
    """Scores against brute force, alike for any number of shards, bundles, numbered words and hot contexts."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {i: [*(t or "").encode().lower().split(), "END"] for i, t in corpus}
    count = [Counter(tuple(w[k : k + n]) for i, w in words.items() if not held(i) for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, scale = sum(count[0].values()), sum(count[0].values()) + 0.1 * (len(count[0]) + 1)
    taken = defaultdict(float)
    for level in count[1:]:
        for gram, n in level.items():
            taken[gram[:-1]] += (n - lm.DISCOUNT) * (n >= 2)

    def prob(gram):
        n, context = count[len(gram) - 1][gram], gram[:-1]
        if not context:
            return (n + 0.1) / scale
        whole = count[len(context) - 1][context]
        if len(context) > 1 and whole < 2 or not whole:
            return prob(gram[1:])
        return (n - lm.DISCOUNT) * (n >= 2) / whole + max(1 - taken[context] / whole, 1e-9) * prob(gram[1:])

    # a distribution: all that may follow a context, and the unknown word
    for context in [(), *list(count[0])[:40:5], *list(count[1])[:60:7]]:
        if "END" not in context:
            assert sum(prob((*context, w)) for w in [*(w for w, in count[0]), "never"]) == pytest.approx(1)

    def level(x):
        """As the trie keeps it."""
        return float(lm._VALUES[lm.quantise(np.log10([x]))][0]) if x else 0.0

    def coded(gram):
        n, context = count[len(gram) - 1][gram], gram[:-1]
        if not context:
            return (n + 0.1) / scale
        whole = count[len(context) - 1][context]
        return level((n - lm.DISCOUNT) * (n >= 2) / max(1, whole)) + level(1 - taken[context] / max(1, whole)) * coded(gram[1:])

    def total(p):
        return {i: sum(min(0, np.log10(p(tuple(w[max(0, k - 2) : k + 1])))) for k in range(len(w))) for i, w in words.items()}

    exact, want = total(prob), total(coded)
    assert all(abs(exact[i] - want[i]) < 0.01 + 0.003 * len(words[i]) for i in words)
    few = {"BUNDLE": 500, "SHARD": 300, "WORDS": 20}
    for sizes in ({}, few, few | {"HOT": 40}, few | {"HOT": 40, "WORDS": 1000}, {"HOT": 10**6, "BUNDLE": 2000, "SHARD": 10**6, "WORDS": 0}):
        for name, value in sizes.items():
            monkeypatch.setattr(lm, name, value)
        for r in lm.report(docs).collect():
            assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6, abs=1e-6), (sizes, r["doc_id"])


def test_language_model_in_slices(spark, docs, monkeypatch):
    """A text cut into parts scores as it does in one."""
    whole = {r["doc_id"]: r.asDict() for r in lm.report(docs).collect()}
    monkeypatch.setattr(lm, "SLICE", 90)
    monkeypatch.setattr(lm, "BUNDLE", 30)
    for r in lm.report(docs).collect():
        want = whole[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (want["n_tokens"], want["n_known"])
        assert (r["base_score"], r["score"]) == pytest.approx((want["base_score"], want["score"]), rel=1e-6)  # the same codes


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe in (1, 50, 10**9, 10**14):
        values = np.unique(rng.integers(0, universe, 500))
        ef = lm.EliasFano.of(values, universe)
        assert (ef.get(np.arange(len(values))) == values).all()
        probe = np.concatenate([values, rng.integers(0, universe, 300)])
        want = np.array([{int(v): i for i, v in enumerate(values)}.get(int(p), -1) for p in probe])
        assert (ef.find(probe) == want).all()


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(30)]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, "")]
    labels += [(5000, 1, 0), (0, None, 0)]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.report(docs, known).collect()}
    assert len(got) == len(rows) and 0 <= got[1000]["score"] <= 1 and got[1000]["score"] == got[1001]["score"]
    held = [(got[i]["predicted"], q) for i, q, _ in labels[:600] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    flipped = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.report(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_personal_data_base_spans():
    e, i = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "x.y@z-1.co.uk", "1.2.3.4", "300.1.1.1", ".5.6", "4111 1111 1111 1111", "4111111111111112", "+1 (509) 555-6973", "-", " ", "+", "é", "12", "0"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [("email", *m.span()) for m in e.finditer(t)]
        want += [("ip", *m.span()) for m in i.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in c.finditer(t):
            d = re.sub("[ -]", "", m.group())
            if 13 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in p.finditer(t) if 9 <= sum(x.isdigit() for x in m.group()) <= 15]
        assert pii.base_spans(t) == want, t


def test_personal_data_adds_and_redacts(spark):
    rng = random.Random(7)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'text {i} token = "{key()}" and mail me{i}@x.org') for i in range(200)] + [(i, f"just words and the number {i}") for i in range(200, 300)] + [(300, None), (301, "")]
    docs = table(spark, rows)
    found = pii.report(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[i]["n_email"] == 1 and "secret:" in got[i]["spans"] for i in range(200))
    assert all(got[i]["spans"] == "" and got[i]["base_sha256"] == sha(b"") for i in range(200, 302))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, found).collect()}
    assert clean[5].endswith('token = "[secret]" and mail [email]') and clean[300] is None


def test_personal_data_adds_each_kind(spark):
    """Planted cases off the base spans, one per kind, among numbers that are nobody's."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def broken() -> str:
        while pii.luhn(d := digits(16)):
            pass
        return d

    rows = []
    for i in range(0, 900, 3):
        rows.append((i, rng.choice([f"write to {name()} [at] {name()} [dot] com today", f"please call (555) {digits(3)}-{digits(4)} at noon"])))
        rows.append((i + 1, f"paid by card {broken()} in May" if i % 2 else f'we set token = "{name()}{digits(12)}{name()}" there'))
        rows.append((i + 2, f"the order {digits(12)} and part {digits(3)}-{digits(3)}-{digits(4)} with mode = {name()}{name()}{name()} and file a/{digits(12)}/b"))
    got = {r["doc_id"]: r["spans"] for r in pii.report(table(spark, rows)).collect()}
    for kind, mark in (("contact", "[at]"), ("contact", "(555)"), ("number", "card"), ("secret", "token")):
        mine = [got[i].startswith(f"{kind}:") for i, t in rows if mark in t]
        assert sum(mine) > 0.95 * len(mine), (mark, sum(mine), len(mine))
    wrong = [(t, got[i]) for i, t in rows[2::3] if got[i]]
    assert len(wrong) < 0.05 * 300, wrong[:5]


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (2, None, None, "lost"), (3, 700, "ann", "late"), (3, 1, "bob", "early")]
    found = {(r["conv_id"], r["block"], r["speaker"]): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(found) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "bob"), (3, 2, "ann")}
    r = found[1, 0, "ann"]
    assert r["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\nhello<|end|>\n<|assistant|>\n<|end|>\n"
    said = [r["text"][a:b] for a, b in (map(int, s.split(":")) for s in r["mask"].split(","))]
    assert said == ["hi < |end|><|end|>\n", "<|end|>\n"] and (r["n_turns"], r["n_spoken"]) == (4, 2)
    plan = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rotation_of_long_dialogues_is_whole(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 300, "bob", "late"), (1, 301, "ann", "yes"), (1, 900, "bob", "end"), (2, None, "cy", "ok"), (2, None, "cy", "ok"), (None, 0, "di", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["block"], r["speaker"]): r for r in chat.rotate_whole(df).collect()}
    assert set(found) == {(1, b, s) for b in (0, 1, 3) for s in ("ann", "bob")} | {(2, 0, "cy"), (None, 0, "di")}
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(df, 1000).collect()}
    for speaker in ("ann", "bob"):
        parts = [found[1, b, speaker] for b in (0, 1, 3)]
        assert "".join(p["text"] for p in parts) == whole[1, speaker]["text"]
        assert ",".join(p["mask"] for p in parts if p["mask"]) == whole[1, speaker]["mask"]
    assert found[2, 0, "cy"]["n_turns"] == 2


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (exact.report(empty), jaccard.report(empty), substrings.report(empty), leaks.report(empty, benchmark), tokens.report(empty), packing.pack(empty), lm.report(empty), quality.report(empty, labels), pii.report(empty)):
        assert df.count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x")]
    docs = table(spark, rows)
    for report in (exact.report, jaccard.report, substrings.report, tokens.report, lm.report, pii.report):
        assert report(docs).count() == 3, report
    assert json.dumps([r["group_size"] for r in exact.report(docs).orderBy("doc_id").collect()]) == "[2, 2, 1]"


def test_training_bags_stay_arrays(monkeypatch):
    """The pipeline's classifier: bags leave a task in bounded pieces, without a Python object per number."""
    import pyarrow as pa
    from emberlane.llm import quality

    texts = [f"word{i} and more words {i} " * 40 for i in range(50)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(52), pa.int64()), pa.array(texts), pa.array([i % 2 for i in range(52)], pa.int32()), pa.array(range(52), pa.int64())], ["doc_id", "text", "quality", "content"])
    monkeypatch.setattr(quality, "BAGS", 100, raising=False)
    out = list(quality._bags(iter([batch])))
    assert len(out) > 5 and all(len(b.column(3).values) < 1000 for b in out)
    got = pa.Table.from_batches(out)
    assert got["doc_id"].to_pylist() == list(range(52)) and got["quality"].to_pylist() == [i % 2 for i in range(52)]
    for i, t in enumerate(texts):
        bucket, weight = quality._bag((t or "").encode())
        assert got["bucket"][i].as_py() == bucket.tolist() and got["weight"][i].values.to_numpy().tolist() == weight.tolist()
