"""Stages keep the right rows where ids are null, repeated or shared by several texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from emberlane.llm import base, jaccard, leaks, pii

SCHEMA = "doc_id long, text string, source string, content long, label string, spans string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def table(spark, rows):
    return spark.createDataFrame([(i, t, f"s{k}", k, "x", "y") for k, (i, t) in enumerate(rows)], SCHEMA)


def lines(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_near_copies_with_null_and_repeated_ids(spark):
    near = LONG + " more"
    rows = [(7, LONG), (7, LONG), (7, "another text under the id of a copy"), (9, near), (None, near + " words"), (None, "nameless but alone here and kept"), (None, "nameless but alone here and kept"), (3, None), (None, ""), (3, " \n"), (2, "short")]
    kept = jaccard.keep_one(table(spark, rows))
    assert lines(kept) == sorted([(7, LONG), (7, "another text under the id of a copy"), (None, "nameless but alone here and kept"), (3, None), (None, ""), (3, " \n"), (2, "short")], key=str)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_of_one_id_in_a_component_one_row_stays(spark):
    assert lines(jaccard.keep_one(table(spark, [(4, LONG), (4, LONG + " more"), (5, LONG.upper())]))) in ([(4, LONG)], [(4, LONG + " more")])
    assert lines(jaccard.keep_one(table(spark, [(None, LONG), (None, LONG + " more")]))) in ([(None, LONG)], [(None, LONG + " more")])


def test_redaction_by_rows(spark):
    rows = [(1, "write a@b.com"), (1, "call +49 30 1234567 now"), (1, "write a@b.com"), (None, "nobody@x.org"), (None, None), (2, "clean")]
    docs = table(spark, rows)
    want = [(1, "write [email]"), (1, "call [phone] now"), (1, "write [email]"), (None, "[email]"), (None, None), (2, "clean")]
    assert lines(pii.redact(docs, pii.report(docs))) == sorted(want, key=str)


def test_overlapping_spans_leave_nothing():
    assert pii.masked("ab 1.2.3.4@host.org z", "email:3:19,ip:3:10") == "ab [email] z"
    assert pii.masked("0123456789", "a:2:5,b:4:8,c:8:9") == "01[a][c]9" and pii.masked(None, None) is None and pii.masked("x", "") == "x"


def test_blocks_are_written_between_passes(spark, monkeypatch):
    """One Python operator in the last stage, whatever the number of blocks, and the same hits."""
    words = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(words[4 * k : 4 * k + 12])) for k in range(12)], "item_id string, text string")
    docs = table(spark, [(1, " ".join(words[3:40])), (2, "nothing here"), (1, " ".join(words[20:33])), (None, None)])
    want = sorted(map(tuple, leaks.report(docs, bench).collect()), key=str)
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 100)
    blocks = len(list(leaks._blocks(bench)))
    got = leaks.report(docs, bench)
    assert blocks > 5 and got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_hash_of_contents_is_sparks(spark):
    texts = ["", "a", "ä" * 50, "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]
    assert base.contents([t.encode() for t in texts]).to_pylist() == got


def test_pipeline_stages_on_repeated_rows(spark):
    rows = [(1, LONG), (1, LONG), (None, LONG + " more"), (2, LONG + " more"), (2, "something else entirely under the same id"), (3, None)]
    docs = table(spark, rows)
    once = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert lines(once) == sorted([(1, LONG), (2, LONG + " more"), (2, "something else entirely under the same id"), (3, None)], key=str)
    assert lines(corpus_pipeline.drop_near_copies(spark, once, "")) == sorted([(1, LONG), (2, "something else entirely under the same id"), (3, None)], key=str)


def test_personal_data_by_shape(spark):
    """Cases without a word that names them, beside cases with one and others' numbers of the same shape."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    mixed = lambda: "".join(rng.choice("ABCDEFGHKLMNPQRSTabcdefghkmnpqrst0123456789") for _ in range(26))
    shapes = {
        "spoken": lambda: f"so {name()} at {name()} dot com said",
        "groups": lambda: f"with {digits(3)}-{digits(2)}-{digits(4)} in it",
        "area": lambda: f"then ({digits(3)}) {digits(3)}-{digits(4)} again",
        "token": lambda: f"left {mixed()} there",
        "named": lambda: f"set api_key = {mixed()} now",
        "call": lambda: f"please call ({digits(3)}) {digits(3)}-{digits(4)} soon",
    }
    clean = {
        "commit": lambda: "in commit " + "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        "order": lambda: f"the order ({digits(3)}) {digits(3)}-{digits(4)} came",
        "mode": lambda: f"mode = {name()}_{name()}_{name()}",
        "url": lambda: f"see https://{name()}.org/{name()}/{digits(12)}",
        "words": lambda: f"we met at noon and the dot was {name()}",
    }
    rows = [(i, kind, make()) for i, (kind, make) in enumerate((k, f) for _ in range(40) for k, f in [*shapes.items(), *clean.items()])]
    got = {r.doc_id: r.spans for r in pii.report(table(spark, [(i, t) for i, _, t in rows])).collect()}
    for kind in shapes:
        found = [bool(got[i]) for i, k, _ in rows if k == kind]
        assert sum(found) >= 0.9 * len(found), (kind, sum(found))
    for kind in clean:
        found = [t for i, k, t in rows if k == kind and got[i]]
        assert len(found) <= 0.05 * 40, found[:3]
