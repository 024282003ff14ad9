from __future__ import annotations

import random

import pandas as pd
import pytest

from emberlane.operators import detector, joins, series
from emberlane.operators.detector import Params


def dense(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, i, n) for i, n in enumerate(values)], "symbol string, step long, n long")


def test_trace(spark):
    """20 quiet steps at 5, an ignition at 60, a peak of 120, the end on the 31."""
    values = [5] * 20 + [60, 90, 120, 40, 31] + [20] * 5
    p = Params()
    (event,) = detector.catalog(dense(spark, values), p).collect()
    assert (event["start"], event["peak"], event["end"], event["peak_n"], event["censored"]) == (20, 22, 24, 120, False)
    assert event["total"] == 60 + 90 + 120 + 40 + 31 and event["principal"]


def test_an_event_freezes_the_floored_deviation(spark):
    """A base of 100 without any spread: the threshold is 110, so that 105 is below it and the event ends at once."""
    values = [100] * 40 + [180] + [105] * 12
    for found in (detector.detect(detector.scored(dense(spark, values), Params()), Params()), detector.detect_in_pandas(detector.scored(dense(spark, values), Params()), Params())):
        (event,) = found.collect()
        assert (event["start"], event["end"], event["censored"], event["sigma0"]) == (40, 40, False, 10.0)


@pytest.mark.parametrize(
    ("after", "eligible"),
    [
        ([320, 310, 300, 290, 280], 42),
        # the third step is below the threshold, the fourth isn't
        ([320, 310, 20, 290, 280], 43),
        # two steps and the confirmation of the end
        ([320, 310, 20, 20, 20, 20, 20, 20], None),
        # the total comes last
        ([90, 80, 70, 50, 40, 30], 44),
    ],
)
def test_eligibility(spark, after, eligible):
    df, p = dense(spark, [5] * 40 + after), Params()
    cat = detector.catalog(df, p)
    (row,) = detector.eligibility_table(cat, detector.detector_daily(cat, df, p), p).collect()
    assert row["eligible"] == eligible


def test_open_event_is_censored(spark):
    (event,) = detector.catalog(dense(spark, [5] * 20 + [60, 90, 120]), Params()).collect()
    assert event["censored"] and event["end"] == 22


def test_fold_equals_pandas(spark):
    rng = random.Random(5)
    rows = [(s, i, max(0, int(rng.gauss(6, 3)) + (40 if rng.random() < 0.03 else 0))) for s in "ABCD" for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, step long, n long")
    p = Params(window=20, least=10, z_on=2.5, min_abs=10, k_off=2)
    z = detector.scored(df, p)
    a = detector.detect(z, p).toPandas().sort_values(["symbol", "start"]).reset_index(drop=True)
    b = detector.detect_in_pandas(z, p).toPandas().sort_values(["symbol", "start"]).reset_index(drop=True)
    assert len(a) > 10
    pd.testing.assert_frame_equal(a, b)


def test_merge_close(spark):
    e = spark.createDataFrame([("A", 1, 5, False, 1.0, 1.0, 4.0), ("A", 8, 9, True, 2.0, 2.0, 5.0), ("A", 20, 22, False, 3.0, 3.0, 6.0)], "symbol string, start long, end long, censored boolean, mu0 double, sigma0 double, z0 double")
    found = {(r["start"], r["end"], r["censored"], r["mu0"]) for r in detector.merge_close(e, 3).collect()}
    assert found == {(1, 9, True, 1.0), (20, 22, False, 3.0)}


def test_robust_baseline_matches_pandas(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    got = [(r["mu"], r["sigma"]) for r in series.baseline_robust(dense(spark, values), 5, 3).orderBy("step").collect()]
    s = pd.Series(values, dtype=float)
    mu = s.rolling(5, min_periods=3).median().shift(1)
    sd = (s.rolling(5, min_periods=3).quantile(0.75) - s.rolling(5, min_periods=3).quantile(0.25)).shift(1) / 1.349
    for (a, b), x, y in zip(got, mu, sd):
        assert (a is None and x != x) or a == pytest.approx(x)
        assert (b is None and y != y) or b == pytest.approx(y)


@pytest.mark.parametrize("by", ["nearest", "overlap"])
def test_greedy_matching_is_one_to_one(spark, by):
    a = spark.createDataFrame([("A", 0, 10), ("A", 12, 20)], "symbol string, start long, end long")
    b = spark.createDataFrame([("A", 8, 13), ("A", 14, 15), ("B", 0, 9)], "symbol string, start long, end long")
    found = {(r["a_start"], r["b_start"]) for r in joins.match_catalogs(a, b, by).collect()}
    assert found == {(0, 8), (12, 14)}


def test_split_of_four_to_one(spark):
    rows = spark.createDataFrame([("A", 0, 100.0, 0.0, 10.0), ("A", 1, 25.0, 0.0, 40.0)], "symbol string, step long, close double, ret double, volume double")
    last = series.adjust_splits(rows).orderBy("step").collect()[-1]
    assert (last["split"], last["adjusted_close"], last["adjusted_volume"]) == (pytest.approx(0.25), pytest.approx(100.0), pytest.approx(10.0))
