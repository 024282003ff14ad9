"""Error injection, samples without reuse, price panels under lives, quantiles, names that agree."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.functions import stance
from emberlane.operators import joins, panel, ranks, series

M = [[0.8, 0.05, 0.15], [0.1, 0.7, 0.2], [0.0, 0.25, 0.75]]
COLUMNS = ["m_bull", "m_bear", "m_neutral"]


def test_degraded_matrix():
    got = panel.degraded(M, 0, 0.5)
    assert got[0] == pytest.approx([0.4, 0.05 + 0.4 * 0.25, 0.15 + 0.4 * 0.75]) and got[1:] == M[1:]
    assert [sum(r) for r in got] == pytest.approx([1, 1, 1]) and panel.degraded([[1.0, 0.0, 0.0], *M[1:]], 0, 0.4)[0] == pytest.approx([0.4, 0.3, 0.3])
    assert M[0] == [0.8, 0.05, 0.15]


def test_redrawn_counts_follow_the_matrix_of_their_stratum(spark):
    rows = [(f"e{i}", i, 1000, 500, 2000, "high" if i % 2 else "low") for i in range(20)] + [("none", 0, 0, 0, 0, "low"), ("null", 0, 7, 0, 0, None)]
    df = spark.createDataFrame(rows, "event_id string, step long, m_bull long, m_bear long, m_neutral long, volume string").repartition(3)
    got = panel.perturb_counts(df, ["event_id", "step"], COLUMNS, M, 20, strata="volume", matrices={"high": panel.degraded(M, 0, 0.5)}).collect()
    assert len(got) == 22 * 20 and {r.replica for r in got} == set(range(1, 21))
    for r in got:
        assert r.m_bull + r.m_bear + r.m_neutral == {"none": 0, "null": 7}.get(r.event_id, 3500)
    for stratum, matrix in ((0, M), (1, panel.degraded(M, 0, 0.5))):
        mine = np.array([[r.m_bull, r.m_bear, r.m_neutral] for r in got if r.event_id[0] == "e" and int(r.event_id[1:]) % 2 == stratum])
        want = np.array([1000, 500, 2000]) @ np.array(matrix)
        spread = np.sqrt(sum(n * np.array(p) * (1 - np.array(p)) for n, p in zip((1000, 500, 2000), matrix)))
        assert (np.abs(mine.mean(0) - want) < 4 * spread / np.sqrt(len(mine))).all()
        assert (np.abs(mine.std(0) / spread - 1) < 0.25).all()
    again = panel.perturb_counts(df.repartition(1), ["event_id", "step"], COLUMNS, M, 20, strata="volume", matrices={"high": panel.degraded(M, 0, 0.5)}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_strata(spark):
    rows = [(i, i % 9, i, i % 3, 1) for i in range(31)]
    got = panel.with_strata(spark.createDataFrame(rows, "n long, age long, id long, m_bull long, m_bear long")).collect()
    n = [r[0] for r in rows if r[0] > 0]
    low, high = np.quantile(n, [1 / 3, 2 / 3])
    for r in got:
        assert r.volume == ("low" if r.n <= low else "middle" if r.n <= high else "high") and r.moment == ("early" if r.age <= 5 else "late") and r.side == ("bull" if r.m_bull >= 1 else "bear")


def test_capped_capture(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3500, "big").otherwise("small").alias("cell")).repartition(6)
    got = stance.capped_capture(df, ["cell"], "id", 0.25, 300)
    by = {c: [r.id for r in got.collect() if r.cell == c] for c in ("big", "small")}
    assert len(by["big"]) == 300 and abs(len(by["small"]) - 125) < 45 and got.columns == ["id", "cell"]
    whole = stance.capped_capture(df, ["cell"], "id", 0.25, 10_000).filter("cell = 'big'").collect()
    assert abs(len(whole) - 875) < 110 and set(by["big"]) < {r.id for r in whole}
    assert sorted(by["big"]) == sorted(r.id for r in stance.capped_capture(df.repartition(2), ["cell"], "id", 0.25, 300).collect() if r.cell == "big")


def test_pick_without_reuse(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).alias("k")).unionAll(spark.range(50).select("id", F.lit(3).cast("long").alias("k")))
    cells = [("low", "id < 20", 15), ("lower", "id < 25", 20), ("threes", "k = 3", 10), ("nobody", "k = 77", 5)]
    got = [(r.id, r.cell) for r in stance.pick_without_reuse(df, "id", cells, 60).collect()]
    count = {c: sum(x == c for _, x in got) for _, c in got}
    assert len({i for i, _ in got}) == len(got) == 60
    # of the 25 ids under 25 the second cell finds those that the first left
    assert count == {"low": 15, "lower": 10, "threes": 10, "filler": 25}
    ok = {"low": lambda i: i < 20, "lower": lambda i: i < 25, "threes": lambda i: i % 10 == 3 or i < 50, "filler": lambda i: True}
    assert all(ok[c](i) for i, c in got)
    assert len(stance.pick_without_reuse(df, "id", cells, 500).collect()) == 200 and stance.pick_without_reuse(df.limit(0), "id", cells, 5).collect() == []
    assert got == [(r.id, r.cell) for r in stance.pick_without_reuse(df.repartition(5), "id", cells, 60).collect()]


def test_price_panel_resolves_two_instruments(spark):
    lives = spark.createDataFrame([(1, "A", 0, 10), (2, "A", 8, None), (3, "B", 0, None), (1, "B", 20, 30)], "instrument long, symbol string, start long, end long")
    schema = "instrument long, step long, close double, ret double, volume double"
    first = spark.createDataFrame([(1, 5, -7.0, None, 1.0), (1, 9, 8.0, 0.1, 1.0), (2, 9, 9.0, 0.2, 2.0), (1, 15, 1.0, None, 1.0), (3, 25, 3.0, None, 1.0), (1, 25, 4.0, None, 1.0), (2, 99, 1.0, None, 1.0)], schema)
    second = spark.createDataFrame([(2, 9, 90.0, None, 5.0), (2, 12, 12.0, None, 5.0)], schema)
    placed = [panel.placed_prices(first, lives, "one", 50), panel.placed_prices(second, lives, "two", 50)]
    conflicts = {(r.symbol, r.step): (r.n, r.instruments) for r in panel.price_conflicts(placed[0]).collect()}
    assert conflicts == {("A", 9): (2, "1,2"), ("B", 25): (2, "1,3")}
    got = {(r.symbol, r.step): (r.instrument, r.close, r.source, r.candidates) for r in panel.price_panel(placed).collect()}
    assert got == {("A", 5): (1, 7.0, "one", 1), ("A", 9): (2, 9.0, "one", 3), ("A", 12): (2, 12.0, "two", 1), ("B", 25): (1, 4.0, "one", 2)}


def test_quantiles_and_cuts(spark):
    rng = np.random.default_rng(1)
    x = np.append(rng.normal(size=400), np.repeat(0.5, 90))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    shares = [0, 0.1, 1 / 3, 0.5, 0.99, 1]
    assert ranks.quantiles(df, "x", shares) == pytest.approx(np.quantile(x, shares).tolist())
    assert ranks.quantiles(df.filter("x is null"), "x", shares) == [] and ranks.numbered_median(df.select("x").filter("x is not null"), "x") == pytest.approx(np.median(x))
    edges = np.unique(np.quantile(x, np.arange(11) / 10))
    for r in series.qcut(df, "x", 10).collect():
        assert r.bin == (None if r.x is None else 1 + int((edges[1:-1] < r.x).sum()))


def test_pairs_of_one_name(spark):
    names = [("A", "Alpha Inc"), ("B", "ALPHA corp."), ("C", "Beta"), ("D", "alpha"), ("E", None), ("F", "Inc"), ("G", "Ltd"), ("A", "Alpha Ltd")]
    got = joins.name_pairs(spark.createDataFrame(names, "symbol string, name string"))
    assert sorted(map(tuple, got.collect())) == [("A", "B"), ("A", "D"), ("B", "D")]
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
