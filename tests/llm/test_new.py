"""Line dedup, importance resampling and token alignment against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from emberlane.llm import align, base, lines, queries, resample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, digest string, bucket int, row long"
SMALL = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "l", "d", 7, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéüßñ") for _ in range(rng.randint(1, 7))) for _ in range(50)] + ["x-1", "it's", "Zürich,", "¿Qué?", "10.5", "İ"]
    common = ["  A Common Line, shared  ", "Äußerst gemeinsam", "short", "tail line of some"]
    rows = []
    for i in range(60):
        text = "\n".join(rng.choice(common) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9)))
        rows.append((i, text))
    rows += [(70, None), (71, ""), (72, "\n"), (73, " \n\t "), (74, "a common line, SHARED\n\ntail line of some\n"), (75, rows[3][1]), (76, rows[3][1].upper())]
    rows += [(80, "one two"), (81, " ".join(words * 80)), (82, "x" * 3000 + " y " + "z" * 50), (83, "  two  spaces   　 here\tand ▁ there "), (84, "say <|endoftext|> or </s> <unk>")]
    rows += [(85, "repeated row of words " * 8), (85, "repeated row of words " * 8), (86, "nul \x00 byte"), (87, "日本語 の テキスト です。" * 30)]
    return rows


# -- line dedup


def line_brute(rows, min_docs=2):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    last = lambda i: (i is None, i or 0)
    keeper = {k: min(v, key=last) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def lines_of(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_lines_match_brute_force(spark, corpus):
    assert lines_of(lines.drop_lines(table(spark, corpus))) == line_brute(corpus)
    assert lines_of(lines.drop_lines(table(spark, corpus), min_docs=4)) == line_brute(corpus, 4)


def test_line_report_is_the_digest_of_the_text(spark, corpus):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(table(spark, corpus)).collect()}
    assert got == {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in line_brute(corpus)}


def test_lines_of_null_ids_repeated_ids_and_one_document(spark):
    rows = [(None, "the same long line\nown words of nobody"), (5, "The Same Long Line\nx"), (5, "other text, the id again\nthe same long line"), (9, "a line that repeats\n" * 3), (None, "only nameless rows"), (None, "only nameless rows")]
    assert lines_of(lines.drop_lines(table(spark, rows))) == line_brute(rows)


def test_lines_of_long_texts_and_empty_tables(spark):
    rows = [(1, "\n".join(f"line number {i}" for i in range(60_000))), (2, "\n".join(f"Line number {i}" for i in range(0, 120_000, 2)))]
    assert lines_of(lines.drop_lines(table(spark, rows))) == line_brute(rows)
    assert lines.report(table(spark, [])).collect() == []


def test_salted_lines_give_the_same_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(lines, "SHARE", 7)
    assert lines_of(lines.drop_lines(table(spark, corpus))) == line_brute(corpus)


def test_lines_stay_in_the_jvm(spark, corpus):
    plan = lines.report(table(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_line_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = sorted(con.sql(queries.SQL["op12_line_dedup"]).fetchall())
    assert sorted(map(tuple, queries.op12_line_dedup(spark, SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want


# -- importance resampling

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resample_brute(rows, target, percent=5, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000))))
    out = []
    for i, n, fs in found:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=str)


def bench(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item_id string, text string")


def test_resampling_matches_brute_force(spark, corpus, monkeypatch):
    target = [t for _, t in corpus[:20]] + ["Zürich it's 10.5 shared", None, ""]
    docs = table(spark, corpus)
    assert rows_of(resample.ranked(docs, bench(spark, target), 40)) == resample_brute(corpus, target, 40)
    monkeypatch.setattr(resample, "PIECE", 64)  # slices inside texts, in the driver's process only
    segments = [s for part in resample._segments([(t or "").encode() for _, t in corpus], 64) for s in part]
    assert any(carried for _, _, carried in segments)
    grams, owner, words = resample.occurrences(segments)
    found = defaultdict(Counter)
    for k, o in enumerate(owner.tolist()):
        found[segments[o][0]][grams.bytes_of(k).decode()] += 1
    assert all(found[k] == Counter(features(t)[1]) for k, (_, t) in enumerate(corpus))


def test_resampling_query_matches_brute_force(spark):
    docs, target = (base.table(spark, SMALL, t) for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(queries.op13_importance_resampling(spark, SMALL)) == resample_brute(rows, [r.text for r in target.collect()])


def test_resampling_edges(spark):
    rows = [(None, "a b c " * 9), (3, "a b c " * 9), (3, "a b c " * 9), (4, None), (5, ""), (6, "... --"), (7, "w" * 5000 + " " + "v " * 30)]
    assert rows_of(resample.ranked(table(spark, rows), bench(spark, ["a b"]), 50)) == resample_brute(rows, ["a b"], 50)
    assert rows_of(resample.ranked(table(spark, rows), bench(spark, []), 100)) == resample_brute(rows, [], 100)
    assert resample.report(table(spark, []), bench(spark, ["a b"])).collect() == []


def test_hashes_are_the_libraries():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 30_000, np.uint8).tobytes()
    start, size = rng.integers(0, 29_000, 4000), rng.integers(1, 400, 4000)
    size[:2000] = rng.integers(1, 40, 2000)
    grams = resample.Grams(data, start, size)
    parts = [grams.bytes_of(i) for i in range(4000)]
    assert grams.keys().tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    assert grams.crc32(np.arange(4000)).tolist() == [zlib.crc32(p) for p in parts]


def test_table_tells_equal_keys_apart_by_their_bytes():
    data = b"aa bb aa cc bb aa"
    grams = resample.Grams(data, np.array([0, 3, 6, 9, 12, 15]), np.full(6, 2))
    found = resample.Table(grams, np.full(6, 11, np.uint64))  # every key collides
    names = [grams.bytes_of(i) for i in range(6)]
    assert len(found.used) == 3 and [found.count[s] for s in found.slot_of] == [names.count(n) for n in names]
    assert [found.bucket[s] for s in found.slot_of] == [zlib.crc32(n) % 10000 for n in names]


# -- token alignment


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers

    return align.Pair(public_tokenizers.path(align.MODEL_A), public_tokenizers.path(align.MODEL_B))


def align_brute(rows, pair):
    found, counts = [], Counter()
    for i, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = pair.a.encode(" " + text, add_special_tokens=False).ids
            b = pair.b.encode(text)
            want = (" " + text).encode()
            if b"".join(pair.a_bytes[x] for x in a) == want == b"".join(pair.b_bytes[x] for x in b):
                ae, be = pair.ends(a, pair.a_bytes), pair.ends(b, pair.b_bytes)
                spans = lambda ids, ends: list(zip(ids, [0, *ends], ends))
                sa, sb = spans(a, ae), spans(b, be)
                j = 0
                for x, s, e in sa:
                    while sb[j][2] <= s:
                        j += 1
                    k = j
                    while k < len(sb) and sb[k][1] < e:
                        links.append((x, sb[k][0]))
                        k += 1
                lo = 0
                for hi in sorted(set(ae) & set(be)):
                    side = lambda sp: ",".join(str(x) for x, s, e in sp if lo <= s and e <= hi)
                    groups.append(side(sa) + "|" + side(sb)) if len(text) < 1500 else groups.append(None)
                    lo = hi
            else:
                a, b = [], []
        counts.update(set(links))
        found.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (i, len(a), len(b), len(g), len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), None if None in g else hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, a, b, g, ls in found
        ),
        key=str,
    )


def aligned_rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def same_alignment(got, want):
    # long texts have no digest in the brute-force rows
    blank = {w[:-1] for w in want if w[-1] is None}
    return sorted((g[:-1] + (None,) if g[:-1] in blank else g for g in got), key=str) == want


def test_alignment_matches_brute_force(spark, corpus, pair):
    want = align_brute(corpus, pair)
    assert any(w[1] == 0 for w in want) and any(w[3] < w[1] for w in want)
    docs = table(spark, corpus)
    whole = aligned_rows(align.report(docs))
    assert same_alignment(whole, want)
    # chunks of a few bytes, levels of composition, pairs joined by a shuffle
    for size, share in ((7, 3), (60, 1)):
        assert sorted(aligned_rows(align.report(docs, chunk=size, share=share)), key=str) == sorted(whole, key=str)


def test_alignment_query_matches_brute_force(spark, pair):
    rows = [(r.doc_id, r.text) for r in base.table(spark, SMALL, "documents").collect()]
    assert same_alignment(aligned_rows(queries.op11_token_alignment(spark, SMALL)), align_brute(rows, pair))


def test_alignment_of_repeated_and_null_ids_and_empty_tables(spark, pair):
    rows = [(None, "tokens differ, don't they?"), (1, "tokens differ, don't they?"), (1, "tokens differ, don't they?"), (1, "unglaublich"), (2, None), (3, " "), (4, "\n\n x")]
    got = aligned_rows(align.report(table(spark, rows)))
    assert same_alignment(got, align_brute(rows, pair))
    assert align.report(table(spark, [])).collect() == []


def test_fragments_compose_in_any_order(pair):
    rng = random.Random(2)
    text = "Donaudampfschifffahrt unglaubliche tokens, ça n'est pas 12345 naïveté"
    a = np.array(pair.a.encode(" " + text, add_special_tokens=False).ids)
    b = np.array(pair.b.encode(text))
    a_end, b_end = (np.array(pair.ends(x.tolist(), of)) for x, of in ((a, pair.a_bytes), (b, pair.b_bytes)))
    want = groups = align.groups_of(a.tolist(), a_end.tolist(), b.tolist(), b_end.tolist(), pair.size_b)[0]
    for _ in range(50):
        borders = [0, *sorted(rng.sample(range(1, int(a_end[-1])), 6)), int(a_end[-1])]
        parts, groups = [], {}
        for k, (lo, hi) in enumerate(zip(borders, borders[1:])):
            x, y = (a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi)
            f = align._fragment(pair, a[x], a_end[x], b[y], b_end[y], lo, k)
            groups[k, 1] = f["groups"]
            parts.append(f)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            node, closed = align.compose(parts[i], parts[i + 1])
            if closed:
                groups[closed[0], 0] = align.groups_of(*(closed[1][k] for k in ("a", "a_end", "b", "b_end")), pair.size_b)[0]
            parts[i : i + 2] = [node]
        assert not any(parts[0]["suf"]["a"] + parts[0]["suf"]["b"] + parts[0]["pre"]["a"])
        assert [g for k in sorted(groups) for g in groups[k]] == want
