"""The name dictionary and its gates on the surveyed sentences."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlane.functions import stance
from emberlane.operators import aggregates

NAMES = [("GME", "GameStop Corp."), ("AAPL", "Apple Inc"), ("AMC", "AMC Entertainment Holdings Inc"), ("TSLA", "Tesla Inc"), ("BRK", "Berkshire Hathaway Inc"), ("DTE", "DTE Energy Co"), ("STAR", "Star Holdings"), ("BAC", "Bank of America Corp"), ("XOM", "Exxon Mobil Corporation"), ("RE", "Real Estate Trust Fund"), ("NUL", None)]


@pytest.fixture(scope="module")
def dictionary(spark):
    return stance.compile_dictionary(spark.createDataFrame(NAMES, "symbol string, name string"), ["DTE"], ["star"]).cache()


def mentions(spark, dictionary, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: set() for i in range(len(texts))}
    for r in stance.detect_mentions(rows, "id", "text", dictionary).collect():
        out[r.id].add(r.symbol)
    return [out[i] for i in range(len(texts))]


def test_dictionary_entries(dictionary):
    got = {(r.symbol, r.route): r.key for r in dictionary.collect()}
    assert got["BAC", "word"] == "america" and got["TSLA", "word"] == "tesla" and got["XOM", "phrase"] == "exxon mobil" and got["BRK", "phrase"] == "berkshire hathaway"
    assert ("DTE", "token") not in got and ("RE", "token") not in got and ("RE", "phrase") not in got and ("STAR", "word") not in got and ("AMC", "word") not in got
    assert got["NUL", "cashtag"] == "NUL" and got["RE", "cashtag"] == "RE" and ("AAPL", "phrase") not in got


def test_surveyed_sentences(spark, dictionary):
    assert mentions(
        spark, dictionary, "YOLO $gme calls, apple to the moon", "Buying GME and AMC before earnings", "I love my Tesla and some berkshire hathaway", "DTE is 0 today, pure theta gang",
        "$DTE looks cheap", "the star of the show", "bank of america is up", "tesla goes up", "exxon mobil", "united states real estate", "[removed]", None,
    ) == [{"GME", "AAPL"}, {"GME", "AMC"}, {"TSLA", "BRK"}, set(), {"DTE"}, set(), {"BAC"}, {"TSLA"}, {"XOM"}, set(), set(), set()]


def routes(df):
    return {(r.id, r.symbol): r.route for r in df.collect()}


def test_gates(spark, dictionary):
    rows = spark.createDataFrame([(0, "GME and AMC now"), (1, "GME shares"), (2, "BUY GME NOW OR ELSE"), (3, "$gme GME gamestop"), (4, "the Dow, GME"), (5, "we shortlist GME"), (6, None), (7, "")], "id int, text string")
    assert routes(stance.gated_routes(rows, "id", "text", dictionary, ["GME"])) == {(0, "AMC"): "token", (1, "GME"): "token_ctx", (2, "GME"): "token_ctx", (3, "GME"): "cashtag"}
    assert routes(stance.strict_routes(rows, "id", "text", dictionary, ["AMC"])) == {(1, "GME"): "token", (3, "GME"): "cashtag", (4, "GME"): "token"}
    flags = {r.id: (r.finance, r.shouts) for r in rows.select("id", *stance.context_gate(F.col("text"))).collect()}
    assert flags[1] == (True, False) and flags[2] == (True, True) and flags[5] == (False, False) and flags[6] == flags[7] == (False, False)


def test_summary_is_rounded_once(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] * 4 + [("b", "b")] * 5 + [("b", "a")] * 6 + [("c", "a")] * 13 + [("c", "c")] * 2
    r = aggregates.classification_summary(spark.createDataFrame(pairs, "g string, p string"), "g", "p").first()
    assert r.balanced_accuracy == round((3 / 7 + 5 / 11 + 2 / 15) / 3, 6) and r.n == 33 and r.accuracy == round(10 / 33, 6)
