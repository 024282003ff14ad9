"""Operators whose queries have no SQL, and edge cases of others, against brute force and literal rows."""

from __future__ import annotations

import itertools
import json
import random
from datetime import date
from difflib import SequenceMatcher

import numpy as np

from emberlane.functions import cleaning
from emberlane.operators import aggregates, agreement, detector, joins, near, panel, series
from emberlane.sources import posts
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_longest_consistent_against_every_subsequence(spark):
    random.seed(3)
    curves = {k: [random.randint(1, 9) for _ in range(n)] for k, n in enumerate((1, 2, 5, 8, 9, 9, 9))}
    df = spark.createDataFrame([(k, i, float(x)) for k, c in curves.items() for i, x in enumerate(c)] + [(99, 0, None)], "k int, i int, x double")
    found: dict = {}
    for r in series.longest_consistent(df, "k", "i", "x").collect():
        found.setdefault(r["k"], []).append((r["i"], r["x"], r["longest"], r["points"]))
    assert set(found) == set(curves)
    for k, c in curves.items():
        best = max(n for n in range(1, len(c) + 1) for p in itertools.combinations(range(len(c)), n) if all(c[b] >= 0.7 * c[a] for a, b in itertools.pairwise(p)))
        got = sorted(found[k])
        assert len(got) == best == got[0][2] and got[0][3] == len(c)
        assert all(y[1] >= 0.7 * x[1] for x, y in itertools.pairwise(got)) and all(c[i] == x for i, x, _, _ in got)


def test_overlap_join_against_all_pairs(spark):
    random.seed(5)
    make = lambda n: [(random.choice("ab"), s, s + random.randint(0, 90)) for s in (random.randint(0, 200) for _ in range(n))]
    a, b = make(40), make(40)
    a += [a[0], ("z", 3, 9), ("z", 3, 9), ("a", None, None)]
    want = [(k, s, e, t, f, t - s) for k, s, e in a for q, t, f in b if s is not None and k == q and s <= f and e >= t]
    alone = [(k, s, e, None, None, None) for k, s, e in a if s is None or not any(k == q and s <= f and e >= t for q, t, f in b)]
    df = [spark.createDataFrame(x, "symbol string, start long, end long") for x in (a, b)]
    assert rows(joins.overlap_join(*df, "symbol")) == sorted(want + alone, key=str)
    assert rows(joins.overlap_join(*df, "symbol", keep_unmatched=False, bucket=7)) == sorted(want, key=str)


def test_fuzzy_link_names(spark):
    a = [(1, "X", "Acme Holdings, Inc.", 5.0), (2, "X", None, 0.0), (3, "Y", "Zeta", 1.0)]
    b = [(7, "X", "ACME CORP; class A", 9.0), (8, "X", "ACME", 6.0), (9, "X", "Apex Group", 5.0), (10, "X", None, 5.0)]
    df = [spark.createDataFrame(x, "id int, key string, name string, value double") for x in (a, b)]
    found = {r["a_id"]: r for r in joins.fuzzy_link_names(*df, "key").collect()}
    assert (found[1]["b_id"], found[1]["similarity"], found[1]["tier"]) == (8, 1.0, "high")
    assert found[2]["similarity"] == 0.0 and found[2]["tier"] == "low" and 3 not in found
    assert found[2]["b_id"] == 9  # nearest value on ties
    pair = spark.createDataFrame([("abcde fgh", "abxde fg")], "a string, b string").select(joins._ratio("a", "b")).first()[0]
    assert pair == SequenceMatcher(None, "abcde fgh", "abxde fg").ratio()


def test_price_arc_bases(spark):
    p = spark.createDataFrame([("A", 0, 0.5), ("A", 1, 0.1), ("A", 2, -0.05), ("B", 0, None), ("B", 1, -0.2)], "symbol string, step long, ret double")
    first = {r["symbol"]: r for r in series.price_arc(p).collect()}
    assert abs(first["A"]["highest"] - 10) < 1e-9 and abs(first["A"]["last"] - 4.5) < 1e-9 and abs(first["A"]["given_back"] - 0.55) < 1e-9 and first["A"]["up_share"] == 0.5
    assert first["B"]["highest"] == 0 and first["B"]["given_back"] is None and abs(first["B"]["last"] + 20) < 1e-9
    before = {r["symbol"]: r for r in series.price_arc(p, "before").collect()}
    assert abs(before["A"]["highest"] - 65) < 1e-9 and before["B"]["highest"] is None and before["B"]["last"] is None


def test_coupling_turns_at_two_days(spark):
    df = spark.createDataFrame([(x,) for x in (-2, -1, 0, 1, 2, None)], "d int").select(cleaning.label_coupling(F.col("d")))
    assert [r[0] for r in df.collect()] == ["price_leads", "synchronous", "synchronous", "synchronous", "price_trails", "no_price"]


def test_json_arrays_first_id_wins(spark, tmp_path):
    files = {"a.json": [{"id": "1", "v": "x"}, {"id": "2", "error": "e"}, {"id": "1", "v": "y"}], "b.json": [{"id": "1", "v": "z"}, {"id": "2", "v": "w"}, {"v": "no id"}], "c.json": []}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content, indent=2))
    assert rows(posts.read_json_array(spark, str(tmp_path), "struct<id:string,v:string,error:string>", "id").select("id", "v")) == [("1", "x"), ("2", "w")]


def test_file_sizes_and_gaps(spark, tmp_path):
    for name, content in (("2023_posts.txt", "abc"), ("2024_posts.txt", ""), ("2023_comments.txt", "x"), ("other.txt", "x")):
        (tmp_path / name).write_text(content)
    sizes = posts.file_sizes(spark, str(tmp_path), r"/([0-9]{4})_([a-z]+)\.txt$", ["year", "kind"])
    assert rows(sizes.select("year", "kind", "length")) == [("2023", "comments", 1), ("2023", "posts", 3), ("2024", "posts", 0)]
    expected = spark.createDataFrame(list(itertools.product(("2023", "2024"), ("posts", "comments"))), "year string, kind string")
    assert rows(posts.file_gaps(expected, sizes, ["year", "kind"])) == [("2023", "comments", "there"), ("2023", "posts", "there"), ("2024", "comments", "missing"), ("2024", "posts", "empty")]


def test_ingest_metrics_counts_what_stays(spark):
    df = spark.createDataFrame([("f", 1, False, ["A", "B", "A"]), ("f", 1, True, ["C"]), ("f", 2, False, ["D"]), ("g", 2, False, None)], "file string, month int, gone boolean, s array<string>")
    found = rows(aggregates.ingest_metrics(df, "file", F.col("month") == 1, F.col("gone"), F.col("s")))
    assert found == [("f", 3, 2, 1, 3, 2), ("g", 1, 0, 0, 0, 0)]


def test_catalogs_compared_and_twins(spark):
    schema = "symbol string, start long, end long"
    a = spark.createDataFrame([("A", 1, 5), ("A", 20, 25), ("B", 4, 9)], schema)
    b = spark.createDataFrame([("A", 2, 3), ("B", 30, 31)], schema)
    assert rows(detector.compare_catalogs(a, b)) == [(3, 2, 1, 2, 1)]
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    assert rows(detector.twin_events(a, pairs)) == [("A", "B", 1), ("A", "C", 0)]
    assert rows(detector.bubble_cover(a, b)) == [(3, 1, 0.333333)]


def test_frontier_and_peaks(spark):
    events = spark.createDataFrame([("e", "A", 5, 8), ("f", "A", 20, 21), ("g", "B", 3, 4)], "event_id string, symbol string, start long, end long")
    days = spark.createDataFrame([("A", s) for s in (4, 5, 5, 7, 19, 20)], "symbol string, step long")
    assert rows(panel.coverage_frontier(events, days)) == [("e", 6, True), ("f", 21, False)]
    pairs = [("e", s, a, b, "event") for s, a, b in ((1, 5, 0), (2, 5, 1), (3, 1, 1))] + [("e", 4, 9, 9, "post"), ("f", 1, 1, 1, "event"), ("g", 1, 1, 0, "event"), ("g", 2, 1, 0, "event"), ("g", 3, 1, 0, "event")]
    found = agreement.peak_offset(spark.createDataFrame(pairs, "event_id string, step long, na long, nb long, phase string"))
    assert rows(found) == [("e", 1), ("f", None), ("g", None)]


def test_near_duplicates_at_the_edge_of_the_band(spark):
    """the smaller value may lie further below than the larger lies above; zeros meet zeros only."""
    random.seed(5)
    values = [0.0, 0.0, -3.0, -3.0]
    for _ in range(150):
        top = random.uniform(1000, 900000)
        values += [top, top * (0.995 + 1e-9), top * (0.995 - 1e-9)]
    found = series.near_duplicates(spark.createDataFrame([(k, "m", x) for k, x in enumerate(values)], "k int, m string, x double"), "k", "m", "x")
    want = [(i, j, 1) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and abs(x - y) <= 0.005 * max(x, y)]
    assert rows(found) == sorted(want, key=str)


def test_placebo_correlations_are_those_of_permutations(spark, monkeypatch):
    """counts dealt at random give the distribution of correlations under permutations, without copies of the rows."""
    random.seed(8)
    data = [(k, float(random.choice([1, 2, 2, 5, 9])), float(random.randint(1, 4))) for k in range(60)] + [(99, None, 1.0), (100, 2.0, None)]
    df = spark.createDataFrame(data, "id int, x double, y double")
    plain = df.filter("x is not null and y is not null")
    with monkeypatch.context() as m:
        m.setattr(agreement, "permuted", None)  # rows are not dealt
        counted = sorted(r["statistic"] for r in agreement.placebo_correlations(df, "id", "x", "y", 2000).collect())
    xs, ys = zip(*((x, y) for _, x, y in data if x is not None and y is not None))
    want = []
    for _ in range(2000):
        dealt = random.sample(ys, len(ys))
        want.append(np.corrcoef(xs, dealt)[0, 1])
    assert abs(np.mean(counted)) < 0.02 and abs(np.std(counted) - np.std(want)) < 0.02
    assert all(abs(a - b) < 0.04 for a, b in zip(np.quantile(counted, [0.05, 0.25, 0.5, 0.75, 0.95]), np.quantile(want, [0.05, 0.25, 0.5, 0.75, 0.95])))
    monkeypatch.setattr(agreement, "MARGIN", 2)  # by rows
    by_row = [r["statistic"] for r in agreement.placebo_correlations(df, "id", "x", "y", 200).collect()]
    assert len(by_row) == 200 and abs(np.std(by_row) - np.std(want)) < 0.04
    # a single group: every dealing is the same
    same = spark.createDataFrame([(k, 1.0, float(k)) for k in range(5)], "id int, x double, y double")
    monkeypatch.setattr(agreement, "MARGIN", 100)
    assert {r["statistic"] for r in agreement.placebo_correlations(same, "id", "x", "y", 3).collect()} == {None}
    assert plain.count() == 60


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_links_against_all_pairs_and_without_them(spark):
    """every row's best link, and no work per pair of rows that share a name."""
    random.seed(11)
    word = lambda: "".join(random.choice("ab ") for _ in range(random.randint(0, 5)))
    side = lambda lo: [(random.randint(0, 2), lo + i, random.choice([word(), word(), word(), None]), random.choice([None, *map(float, range(6)), -1.5])) for i in range(90)]
    a, b = side(0), side(1000)
    df = [spark.createDataFrame(r, "key int, id int, name string, value double") for r in (a, b)]

    def best(score, names, allowed):
        out = []
        for k, i, name, value in a:
            options = []
            for k2, j, other, v in b:
                if k2 == k and (allowed or other is not None):
                    s = score(names(name), names(other))
                    d = None if value is None or v is None else abs(value - v)
                    options.append((s is None, -(s or 0), d is None, d or 0, j, s))
            if options:
                m = min(options)
                out.append((i, m[4], m[5]))
        return sorted(out)

    edits = lambda x, y: None if x is None or y is None or not max(len(x), len(y)) else round(1 - _edits(x, y) / max(len(x), len(y)), 6)
    found = sorted((r["a_id"], r["b_id"], r["similarity"]) for r in joins.fuzzy_link(*df, "key").collect())
    assert found == best(edits, lambda x: x, True)
    ratio = lambda x, y: round(SequenceMatcher(None, x, y).ratio(), 6)
    found = sorted((r["a_id"], r["b_id"], r["similarity"]) for r in joins.fuzzy_link_names(*df, "key").collect())
    assert found == best(ratio, lambda x: (x or "").upper().strip(), False)
    # 20,000 rows of one name on each side would be 400 million pairs
    many = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id"), F.lit("one name").alias("name"), F.col("id").cast("double").alias("value"))
    for link in (joins.fuzzy_link, joins.fuzzy_link_names):
        assert link(many, many.withColumn("id", F.col("id") + 7), "key").filter("b_id <> a_id + 7").count() == 0


def test_descriptives_hold_no_group_in_a_task(spark):
    """exact quantiles by group and over all, from counts by ranges; null groups and values, repeated values."""
    random.seed(4)
    data = [(random.choice([None, 1, 2]), random.choice([None, 1.5, -2.0, *map(float, range(9))])) for _ in range(300)] + [(7, None)]
    df = spark.createDataFrame(data, "g int, x double")
    found = aggregates.describe(df, "g", "x")
    assert "percentile(" not in found._jdf.queryExecution().toString()
    q = lambda p: F.round(F.percentile("x", F.lit(p)), 6)
    want = df.rollup("g").agg(F.count("x"), F.round(F.avg("x"), 6), q(0.25), q(0.5), q(0.75), q(0.9))
    assert rows(found) == rows(want)


def test_near_duplicates_move_points_and_no_pairs(spark):
    """400 equal points are 79,800 pairs; above the product of blocks nothing is exchanged or grouped."""
    found = series.near_duplicates(spark.createDataFrame([(k, "m", 1.0) for k in range(400)], "k int, m string, x double"), "k", "m", "x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Aggregate" not in plan
    assert found.agg(F.count("*"), F.sum("steps")).first()[:] == (79800, 79800)


def test_near_pairs_whatever_the_blocks_and_strips(spark):
    """an entity stays whole in a block and a strip; values that are infinite or no numbers compare as in SQL."""
    random.seed(6)
    odd = [0.0, -0.0, -5.0, 100.0, 100.5, 99.5, 99.4999999, 1.7e308, float("inf"), -float("inf"), float("nan"), None]
    points = [(None if k == 7 else f"é{k}", None if m == 3 else date(2020, 1, 1 + m), random.choice(odd + [random.uniform(0, 200) for _ in odd])) for k in range(90) for m in random.sample(range(9), 6)]
    df = spark.createDataFrame(points, "k string, m date, x double")
    met = df.toDF("a", "m", "x").join(df.toDF("b", "m", "y"), "m").filter("a < b and abs(x - y) <= double(0.005) * greatest(x, y)")
    want = rows(met.groupBy("a", "b").count())
    assert any(r[2] > 1 for r in want)
    for sizes in ((1 << 18, 1 << 19, 1 << 20), (150, 20, 30), (1000, 1, 1)):
        assert rows(near.near_pairs(df, "k", "m", "x", 0.005, *sizes)) == want
    assert rows(near.near_pairs(df.filter("false"), "k", "m", "x", 0.005)) == []
