from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from emberlane.functions import cleaning, stance
from emberlane.operators import agreement, panel, ranks


@pytest.fixture(scope="module")
def dictionary(spark):
    names = spark.createDataFrame([("GME", "Gamestop Corp"), ("NKLA", "Nikola"), ("TSLA", "Tesla"), ("BBBY", "Bath Beyond"), ("A", "Agilent")], "symbol string, name string")
    return stance.compile_dictionary(names, ["ALL"], ["nikola"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I like $gme a lot", {"GME"}),
        ("GME to the moon, not gme", {"GME"}),
        ("xGME and GMEs are nothing", set()),
        ("gamestop corp opened, tesla too", {"GME", "TSLA"}),
        ("bath, beyond!", {"BBBY"}),
        ("$A only by cashtag; A is not", {"A"}),
        ("", set()),
        (None, set()),
    ],
)
def test_mentions(spark, dictionary, text, want):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert {r["symbol"] for r in stance.detect_mentions(df, "id", "text", dictionary).collect()} == want


def test_phrases_are_substrings_of_the_joined_words(spark):
    """A phrase may begin inside a longer word, if its first word stands somewhere by itself; texts stay where they are."""
    words = ["red", "ring", "hired", "ringing", "ore", "of", "bored", "\u212aelvin", "ring's", "x" * 3000 + "red"]
    texts = [" ".join(words[(k * 7 + j * j * (k + 3)) % len(words)] for j in range(k % 9)) for k in range(80)] + ["[removed]", "hired rings, red", "red hired ring", "ring red ore", "bore bored of ore", "ringing red oreo, ring"]
    phrases = ["red ring", "ring red ore", "red", "ore bored", "hired  red", "red ring\nred"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000, None)], "id int, text string")
    found = {tuple(r) for r in stance.mention_routes(df, "id", "text", spark.createDataFrame([(p, "phrase", p) for p in phrases] + [("K", "word", "kelvin")], "symbol string, route string, key string")).collect()}
    want = set()
    for i, t in enumerate(texts):
        low = re.findall("[a-z]{3,}", t.lower()) if t != "[removed]" else []
        want |= {(i, p, "phrase") for p in phrases if p.split(" ")[0] in low and p in " ".join(low)} | ({(i, "K", "word")} if "kelvin" in low else set())
    assert found == want and len({p for _, p, _ in want}) > 4
    plan = stance.mention_routes(df.repartition(3), "id", "text", spark.createDataFrame([("R", "phrase", "red ring")], "symbol string, route string, key string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "collect_set" not in plan


def test_shouting_counts_code_points(spark):
    df = spark.createDataFrame([("AB\U00010400\U00010428",), ("\U00010400A\U00010401 \u00c9\u00e9",), ("1 2",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(stance.shouts(F.col("t"))).collect()] == [True, True, False, False, False]
    assert "regexp_extract_all" not in df.select(stance.shouts(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_split_once(spark):
    """5,000 texts' worth of chunks from a few long ones: splitting each anew for every chunk takes minutes."""
    import time

    df = spark.createDataFrame([(1, "buy " * 400_000), (2, "\tsell " * 70), (3, ""), (4, None)], "id int, text string")
    began = time.time()
    rows = {r["id"]: (r["chunks"], r["n_bull"], r["n_bear"], r["label"]) for r in stance.score_long_text(df, "id", "text").collect()}
    assert time.time() - began < 60
    assert rows == {1: (6667, 6667, 0, "bull"), 2: (2, 0, 2, "bear"), 3: (1, 0, 0, "neutral")}


@pytest.mark.parametrize(
    ("text", "label"),
    [("time to buy", "bull"), ("do not buy this", "bear"), ("selling puts all day", "bull"), ("sell calls", "bear"), ("puts", "bear"), ("hello", "neutral"), (None, "neutral"), ("buy or sell", "neutral"), ("diamond hands to the moon", "bull"), ("no way I sell", "bull"), ("this will tank", "bear"), ("sold puts", "bear")],
)
def test_stance(text, label):
    assert stance.stance(text)[0] == label
    assert sum(stance.stance(text)[1:]) == pytest.approx(1)


def test_disagreement_identity(spark):
    df = spark.range(60).select((F.col("id") % 8).alias("c"), F.floor(F.col("id") / 8).alias("v"))
    for r in df.withColumn("b", panel.optimism(F.col("c"), F.col("v"))).withColumn("d", panel.disagreement(F.col("c"), F.col("v"))).collect():
        n = r["c"] + r["v"]
        if n == 0:
            assert r["d"] is None
        else:
            assert r["d"] == pytest.approx(1 - (n + 2) / n * abs(math.tanh(r["b"] / 2)))


def test_html_and_mojibake(spark):
    df = spark.createDataFrame([("<p>Caf&eacute; <script>x()</script>au</p>",), ("fÃ©e",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.clean_html(F.col("t"))).collect()] == ["Café au".encode().decode(), "fée", None]


def test_confusion_inversion_keeps_the_total(spark):
    df = spark.createDataFrame([(10, 5, 5), (0, 0, 0)], "a long, b long, c long")
    rows = panel.adjust_counts(df, ["a", "b", "c"], [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]).collect()
    assert sum(rows[0][f"{k}_adjusted"] for k in "abc") == pytest.approx(20) and sum(rows[1][f"{k}_adjusted"] for k in "abc") == 0


def test_bootstrap_moves_whole_clusters(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "c int, x int")
    out = agreement.bootstrap_clusters(df, "c", 4)
    assert out.count() == 4 * 30
    assert {r["count"] for r in out.groupBy("replica", "copy").count().collect()} == {3}


def test_bootstrap_sums_are_those_of_the_drawn_clusters(spark, monkeypatch):
    """Packed draws by block against the rows that the clusters' copies give, over several blocks and chunks of slots."""
    from pyspark import cloudpickle

    monkeypatch.setattr(agreement, "_CLUSTERS", 16)
    cloudpickle.register_pickle_by_value(agreement)
    try:
        df = spark.createDataFrame([(i * 13 % 97, i % 5, i / 8) for i in range(300)] + [(None, 3, 1.0)], "c long, n int, x double")
        found = {r["replica"]: (r["n"], r["x"]) for r in agreement.bootstrap_cluster_sums(df, "c", ["n", "x"], 7).collect()}
        rows = agreement.bootstrap_clusters(df, "c", 7).groupBy("replica").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        assert found == {r["replica"]: (r["n"], pytest.approx(r["x"])) for r in rows.collect()} and len(found) == 7
        assert agreement.bootstrap_cluster_sums(df.limit(0), "c", ["n"], 3).count() == 0
    finally:
        cloudpickle.unregister_pickle_by_value(agreement)


def test_require_raises(spark):
    with pytest.raises(ValueError, match="positive"):
        agreement.require(spark.range(3), {"positive": F.col("id") > 0})


def test_exact_tests():
    assert agreement.binomial_p(5, 10) == 1.0
    assert agreement.binomial_p(0, 5) == pytest.approx(2 / 32)
    assert agreement.exact_p(0.9, [0.1, 0.95, 0.2]) == pytest.approx(0.5)


def test_numbering_is_one_order(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 101) for i in range(500)], "id long, x long").repartition(7)
    found = [(r["_number"], r["x"], r["id"]) for r in ranks.numbered(rows, "x", "id").collect()]
    assert [(x, i) for _, x, i in sorted(found)] == sorted((x, i) for _, x, i in found)
    assert sorted(n for n, _, _ in found) == list(range(500))


def test_poisson_bootstrap(spark):
    """Weights have mean and variance 1, so the deviation of replicas is that of the mean."""
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"))
    r = agreement.bootstrap_stat(rows, "x", 3000).filter("statistic = 'mean'").first()
    assert r["n"] == 3000 and r["mean"] == pytest.approx(4.5, abs=0.02)
    assert r["se"] == pytest.approx((8.25 / 400) ** 0.5, rel=0.06)
    assert r["low"] < 4.5 - 1.7 * r["se"] and r["high"] > 4.5 + 1.7 * r["se"]


def test_placebo_p(spark):
    real, replicas = spark.createDataFrame([(2.0,)], "statistic double"), spark.createDataFrame([(float(x),) for x in (-3, 1, 0, 2)], "statistic double")
    assert tuple(agreement.placebo_p(real, replicas).first()) == (2.0, 4, 2, 0.6)


def test_words_are_whole_in_any_script(spark):
    """a letter or digit of any script beside a word makes it another word, in the queries and in their SQL."""
    import duckdb
    from emberlane.plans import q_text

    texts = ["sellóta", "ó sell", "buy sell", "sell", "SELL!", "éstock", "Stock²", "stock_", "µbuy.", "to the moon", "to the moons", "diamond hands, dip", "to  the moon", "日buy", "日 buy", "buý", "ſell", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id int, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    finance, signals = dict(docs.select("doc_id", stance.context_gate(F.col("text"))[0]).collect()), dict(docs.select("doc_id", F.array_join(stance.direction_signals(F.col("text")), "|")).collect())
    assert finance == {k: k in (1, 2, 3, 4, 14, 15, 16) for k in range(len(texts))}
    assert [signals[k] for k in range(16)] == ["", "sell", "buy|sell", "sell", "sell", "", "", "", "", "to the moon", "", "diamond hands|dip", "moon", "", "buy", "buy"]
    assert dict(con.execute(f"select doc_id, {q_text._FINANCE} from documents").fetchall()) == finance
    assert dict(con.execute(q_text.QUERIES["g8_signals"].sql).fetchall()) == {k: v or "" for k, v in signals.items()}
