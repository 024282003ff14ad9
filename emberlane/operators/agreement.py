"""Resampling, placebos, agreement between sources, event studies, figures and expectations.

Replicas are rows: a statistic over all replicas is one grouped aggregation over one scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .batteries import permuted
from .fits import _weights
from .ranks import numbered, running_counts

# -- resampling


def bootstrap_clusters(df: DataFrame, cluster: str, replicas: int, seed: int = 3) -> DataFrame:
    """Rows of clusters drawn with replacement, as many as there are, for each replica; ``copy`` tells draws apart.

    Clusters are numbered; slot s of replica r draws number hash(seed, r, s) modulo their count. All rows of a cluster
    travel, so sum rows up by cluster first where the statistic allows it.
    """
    numbers = stored(numbered(df.select(cluster).distinct(), cluster), "clusters")
    count = max(1, numbers.count())
    slots = df.sparkSession.range(replicas * count).select((F.floor(F.col("id") / count) + 1).cast("int").alias("replica"), (F.col("id") % count).cast("int").alias("copy"))
    draws = slots.withColumn("_number", F.pmod(F.xxhash64(F.lit(seed), "replica", "copy"), F.lit(count)))
    return draws.join(numbers, "_number").select("replica", "copy", cluster).join(df, cluster)


#: Clusters of a block: the place of one in its block is a number of 16 bits.
_CLUSTERS = 1 << 16


def _packed_draws(count: int, held: int = 1 << 20):
    """For rows (slot, number) in order of slots: per replica and block of numbers the drawn places, as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(slots: list[np.ndarray], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            slot, number = np.concatenate(slots), np.concatenate(numbers)
            blocks = (number // _CLUSTERS).astype(np.uint16 if count // _CLUSTERS < 1 << 16 else np.int64)
            places = (number % _CLUSTERS).astype(np.uint16)
            found = []
            first, last = int(slot[0]) // count, int(slot[-1]) // count
            edges = np.searchsorted(slot, np.arange(first, last + 2) * count)
            for replica, lo, hi in zip(range(first + 1, last + 2), edges[:-1].tolist(), edges[1:].tolist()):
                order = np.argsort(blocks[lo:hi], kind="stable")
                block, place = blocks[lo:hi][order], places[lo:hi][order]
                cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
                found += [(int(block[c]), replica, place[c:e].tobytes()) for c, e in zip(cuts, [*cuts[1:], len(block)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))], ["block", "replica", "drawn"])

        slots, numbers = [], []
        for batch in batches:
            slots.append(batch.column(0).to_numpy())
            numbers.append(batch.column(1).to_numpy())
            if sum(map(len, slots)) >= held:
                yield from packed(slots, numbers)
                slots, numbers = [], []
        if slots:
            yield from packed(slots, numbers)

    return run


def _block_totals(columns: list[str]):
    """Per replica the sums of a block's clusters, each as often as it is drawn."""

    def total(drawn: pa.Table, clusters: pa.Table) -> pa.Table:
        places = clusters.column("_place").to_numpy()
        values = [clusters.column(c).to_numpy(zero_copy_only=False) for c in columns]
        times: dict[int, np.ndarray] = {}
        if len(places):
            for replica, found in zip(drawn.column("replica").to_pylist(), drawn.column("drawn")):
                w = np.bincount(np.frombuffer(found.as_buffer(), np.uint16), minlength=_CLUSTERS)[places]
                mine = np.array([(w * x).sum() for x in values], object)
                times[replica] = times[replica] + mine if replica in times else mine
        return pa.table({"replica": pa.array(list(times), pa.int32()), **{c: pa.array([t[k] for t in times.values()], clusters.schema.field(c).type) for k, c in enumerate(columns)}})

    return total


def bootstrap_cluster_sums(df: DataFrame, cluster: str, columns: list[str], replicas: int, seed: int = 3) -> DataFrame:
    """Per replica the sums of columns over the clusters that ``bootstrap_clusters`` draws: (replica, columns).

    Clusters are summed up and numbered first; the same slots draw the same numbers. Only packed numbers of drawn clusters move,
    two bytes each, to the block of clusters that they are of: a task holds a block and the draws of it.
    """
    is_known = F.col(cluster).isNotNull()
    per = df.groupBy(cluster).agg(*(F.coalesce(F.sum(F.when(is_known, F.col(c))), F.lit(0)).alias(c) for c in columns))
    placed = stored(numbered(per, cluster).select(F.expr(f"_number div {_CLUSTERS}").alias("block"), F.pmod("_number", F.lit(_CLUSTERS)).cast("int").alias("_place"), *columns), "clusters")
    count = max(1, placed.count())
    slots = df.sparkSession.range(replicas * count)
    replica, copy = F.expr(f"cast(id div {count} + 1 as int)"), F.expr(f"cast(id % {count} as int)")
    draws = slots.select("id", F.pmod(F.xxhash64(F.lit(seed), replica, copy), F.lit(count)).cast("long").alias("_number"))
    packed = draws.mapInArrow(_packed_draws(count), "block long, replica int, drawn binary")
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns)
    totals = packed.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_block_totals(columns), f"replica int, {kinds}")
    return totals.groupBy("replica").agg(*(F.sum(c).alias(c) for c in columns))


def _draws(value: float, count: int, replicas: int, seed: int) -> np.ndarray:
    """How often a replica has a value that the data have ``count`` times: Poisson numbers that depend on nothing else."""
    bits = int(np.float64(value + 0.0).view(np.uint64))
    return np.random.Generator(np.random.Philox(key=[seed, bits])).poisson(count, replicas)


def _bucket_sums(edges: np.ndarray, replicas: int, seed: int):
    """Per bucket of values: each replica's rows and their sum, over the distinct values of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for bucket, v, n in zip(np.searchsorted(edges, values, "left").tolist(), values.tolist(), counts.tolist()):
                w = _draws(v, n, replicas, seed)
                mine = held.setdefault(bucket, np.zeros((2, replicas)))
                mine[0] += w
                mine[1] += w * v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["bucket", "sums"])

    return run


def _add_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[bucket] = held[bucket] + np.frombuffer(sums) if bucket in held else np.frombuffer(sums)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["bucket", "sums"])


def _pickers(shared, replicas: int, seed: int):
    """The values at wanted places of replicas, in one bucket: running counts over its values in order."""

    def pick(key, table):
        wanted = shared.value[key[0].as_py()]  # (side, replica, place inside the bucket)
        side, replica, place = (np.array(x) for x in zip(*wanted))
        found, open_ = np.full(len(place), np.nan), np.arange(len(place))
        upto = np.zeros(replicas)
        for v, n in zip(*(table.sort_by("v").column(c).to_pylist() for c in ("v", "n"))):
            upto += _draws(v, n, replicas, seed)
            hit = upto[replica[open_]] > place[open_]
            found[open_[hit]] = v
            open_ = open_[~hit]
            if not len(open_):
                break
        return pa.table({"side": pa.array(side, pa.int32()), "replica": pa.array(replica, pa.int32()), "value": pa.array(found)})

    return pick


def bootstrap_values(df: DataFrame, value: str, replicas: int, seed: int = 3, buckets: int = 256) -> DataFrame:
    """R2: the mean and the median of each replica of a bootstrap of single rows: (replica, mean, median).

    Rows are summed up by distinct value first; a replica draws a Poisson number for each value. Means come from sums; medians
    from the bucket in which half of a replica's rows are reached, and running counts over that bucket's values. The driver
    holds two numbers per bucket and replica.
    """
    per = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    per = stored(per, "values")
    shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    edges = np.unique(np.array(per.agg(F.percentile_approx("v", shares, F.lit(100 * buckets))).first()[0] or [], float))
    rows = per.mapInArrow(_bucket_sums(edges, replicas, seed), "bucket int, sums binary").repartition("bucket").mapInArrow(_add_buckets, "bucket int, sums binary").collect()
    sums = np.zeros((len(edges) + 1, 2, replicas))
    for bucket, found in rows:
        sums[bucket] = np.frombuffer(found).reshape(2, replicas)
    upto = sums[:, 0].cumsum(0)
    size = upto[-1]
    mean = np.divide(sums[:, 1].sum(0), size, out=np.full(replicas, np.nan), where=size > 0)
    wanted: dict[int, list] = {}
    for side in (0, 1):
        place = (size - 1 + side) // 2
        bucket = (upto <= place).sum(0)
        before = np.where(bucket > 0, upto[np.maximum(bucket - 1, 0), np.arange(replicas)], 0)
        for r in np.flatnonzero(size > 0).tolist():
            wanted.setdefault(int(bucket[r]), []).append((side, r, float(place[r] - before[r])))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    placed = per.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, edges.tolist())), lambda e: e < F.col("v"))) if len(edges) else F.lit(0))
    picked = placed.filter(F.col("bucket").isin(sorted(wanted))).groupBy("bucket").applyInArrow(_pickers(shared, replicas, seed), "side int, replica int, value double")
    medians = picked.groupBy("replica").agg(F.avg("value").alias("median"))
    means = spark.createDataFrame(pa.table({"replica": pa.array(np.arange(replicas), pa.int32()), "mean": mean}))
    return means.join(medians, "replica", "left").select((F.col("replica") + 1).cast("int").alias("replica"), F.nullif(F.col("mean"), F.lit(math.nan)).alias("mean"), "median")


def bootstrap_stat(df: DataFrame, value: str, replicas: int, seed: int = 3) -> DataFrame:
    """R2: per statistic (mean, median) the mean, deviation and 2.5, 50 and 97.5 % points of its replicas."""
    found = bootstrap_values(df, value, replicas, seed).unpivot("replica", ["mean", "median"], "statistic", "value")
    return bootstrap_summary(found, ["statistic"], "value")


def bootstrap_summary(replicas: DataFrame, by: list[str], value: str, null_value: float | None = None) -> DataFrame:
    """Percentile interval and deviation of replicas, and whether the interval leaves out a value."""
    q = lambda p: F.percentile(value, F.lit(p))
    out = replicas.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))
    return out if null_value is None else out.withColumn("excludes", (F.col("low") > null_value) | (F.col("high") < null_value))


def placebo_permute(df: DataFrame, id_column: str, column: str, replicas: int, seed: int = 3) -> DataFrame:
    """A column dealt anew among the rows, per replica: rows are numbered once, a keyed bijection of numbers deals values."""
    return permuted(df.select(id_column, F.col(column).alias(f"{column}_placebo")), f"{column}_placebo", [id_column], replicas, seed)


#: Distinct values of either column up to which ``placebo_correlations`` deals counts: margins of this size travel.
MARGIN = 1 << 10


def _dealt_moments(shared):
    """Per replica the sum of products of two columns whose counts are dealt to one another at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, groups, sizes, seed = shared.value
        for batch in batches:
            replicas = batch.column(0).to_pylist()
            out = []
            for replica in replicas:
                rng = np.random.Generator(np.random.Philox(key=[seed, replica]))
                left, total = counts.copy(), 0.0
                for group, size in zip(groups.tolist(), sizes.tolist()):
                    taken = rng.multivariate_hypergeometric(left, size, method="marginals")
                    left -= taken
                    total += group * float(taken @ values)
                out.append(total)
            yield pa.RecordBatch.from_arrays([pa.array([r + 1 for r in replicas], pa.int32()), pa.array(out, pa.float64())], ["replica", "products"])

    return run


def placebo_correlations(df: DataFrame, id_column: str, x: str, y: str, replicas: int, seed: int = 3) -> DataFrame:
    """(replica, statistic): the correlation of ``x`` with ``y`` dealt anew among the rows; rows without either have no part.

    A correlation sees of a permutation only how often each value of y meets each value of x. These counts are drawn: the rows
    of one x after the other take theirs from the values of y that are left (multivariate hypergeometric), which is the law of
    counts under uniform permutations, so no replica of the rows exists. Columns with more than ``MARGIN`` distinct values, or
    tables too long for the draws, are dealt row by row.
    """
    known = df.select(id_column, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    margin = lambda c: known.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).limit(MARGIN + 1).collect()
    of_x, of_y = margin("x"), margin("y")
    n = sum(r["n"] for r in of_x)
    if max(len(of_x), len(of_y)) > MARGIN or n >= 1_000_000_000:
        dealt = placebo_permute(known, id_column, "y", replicas, seed).join(known.select(id_column, "x"), id_column)
        return dealt.groupBy("replica").agg(F.corr("x", "y_placebo").alias("statistic"))
    if not n:
        return df.sparkSession.createDataFrame([], "replica int, statistic double")
    (gx, nx), (gy, ny) = ((np.array([r[c] for r in rows], float), np.array([r["n"] for r in rows], np.int64)) for c, rows in (("x", of_x), ("y", of_y)))
    # centred, so that the sum of products is n times the covariance
    gx, gy = gx - nx @ gx / n, gy - ny @ gy / n
    scale = math.sqrt(float(nx @ gx**2) * float(ny @ gy**2))
    shared = df.sparkSession.sparkContext.broadcast((gy, ny, gx, nx, seed))
    sums = df.sparkSession.range(replicas, numPartitions=min(replicas, df.sparkSession.sparkContext.defaultParallelism)).mapInArrow(_dealt_moments(shared), "replica int, products double")
    return sums.select("replica", F.try_divide(F.col("products"), F.lit(scale)).alias("statistic"))


def placebo_trajectory(paths: DataFrame, replicas: int, bands: str | None = None, seed: int = 3) -> DataFrame:
    """Every event takes another event's path by age, the donor's last row repeated where it is shorter.

    ``paths``: event_id, age (from 0), value, and optionally a band within which donors are dealt.
    """
    cell = [bands] if bands else []
    lengths = paths.groupBy("event_id", *cell).agg((F.max("age") + 1).alias("length"))
    base = lengths.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    w = Window.partitionBy("replica", *cell)
    takers = base.select("replica", *cell, "event_id", F.col("length").alias("_own"), F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "replica", "event_id"), "event_id")).alias("_p"))
    # the donor of a place is the next place in the same random order, so no event donates to itself
    n = F.count("*").over(w)
    donors = takers.select("replica", *cell, F.col("event_id").alias("donor"), F.col("_own").alias("_donor"), (F.pmod(F.col("_p") - 2, n) + 1).cast("int").alias("_p"))
    dealt = takers.join(donors, ["replica", "_p", *cell]).filter("donor <> event_id")
    aged = dealt.withColumn("age", F.explode(F.sequence(F.lit(0), F.col("_own").cast("int") - 1))).withColumn("_from", F.least(F.col("age"), F.col("_donor").cast("int") - 1))
    values = paths.select(F.col("event_id").alias("donor"), F.col("age").cast("int").alias("_from"), "value")
    return aged.join(values, ["donor", "_from"]).select("replica", "event_id", "donor", "age", "value")


def placebo_p(real: DataFrame, replicas: DataFrame) -> DataFrame:
    """The statistic, the number of replicas, how many reach it (in absolute value), and p = (r + 1) / (n + 1).

    Both tables have a column ``statistic``; ``real`` has one row.
    """
    both = replicas.select("statistic").crossJoin(F.broadcast(real.select(F.col("statistic").alias("real"))))
    reach = F.count_if(F.abs("statistic") >= F.abs("real"))
    return both.groupBy("real").agg(F.count("*").alias("n"), reach.alias("reaching"), ((reach + 1) / (F.count("*") + 1)).alias("p"))


def exact_p(real: float, replicas: list[float]) -> float:
    """(r + 1) / (n + 1)."""
    return (sum(x >= real for x in replicas) + 1) / (len(replicas) + 1)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h, m = d, 0
    while m < 100_000:
        m += 1
        moved = 1.0
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
            moved = d * c
        if abs(moved - 1) < 1e-15:
            break
    return front * h


def binomial_p(k: int, n: int) -> float:
    """The exact two-sided sign test, for any n: the tail by the incomplete beta function."""
    low = min(k, n - k)
    return 1.0 if n == 0 or 2 * low == n else min(1.0, 2 * _beta_share(n - low, low + 1, 0.5))


def t_p(t: float, df: int) -> float:
    """Two-sided Student's t."""
    return _beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def signed_rank_p(rank_sum: float, n: int, ties: float) -> float:
    """Two-sided Wilcoxon signed ranks: exact without ties up to 50 differences, else by the normal distribution with
    ties taken off the variance (``ties``: sum of t^3 - t over equal sizes)."""
    if n == 0:
        return 1.0
    total = n * (n + 1) // 2
    if n <= 50 and ties == 0:
        ways = np.zeros(total + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        low = int(min(rank_sum, total - rank_sum))
        return float(min(1.0, 2 * ways[: low + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(rank_sum - total / 2) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else 1.0


def sign_counts(df: DataFrame, difference: str) -> DataFrame:
    """Counts for the sign test, the signed-rank sum with average ranks, and the t statistic of differences."""
    return _signs(df, difference).select("n", "n_positive", "rank_sum", "mean", "t")


def _signs(df: DataFrame, difference: str) -> DataFrame:
    moved = df.filter(F.col(difference) != 0)
    per = moved.groupBy(F.abs(F.col(difference)).alias("_a")).agg(F.count("*").alias("_n"), F.count_if(F.col(difference) > 0).alias("_up"))
    ranked = running_counts(per, "_a", "_n").withColumn("_rank", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2)
    t = df.agg(F.count(difference).alias("n_all"), F.avg(difference).alias("mean"), F.try_divide(F.avg(difference), F.stddev_samp(difference) / F.sqrt(F.count(difference))).alias("t"))
    cube = F.col("_n").cast("double") ** 3 - F.col("_n")
    return ranked.agg(F.sum("_n").alias("n"), F.sum("_up").alias("n_positive"), F.sum(F.col("_rank") * F.col("_up")).alias("rank_sum"), F.sum(cube).alias("ties")).join(t)


def paired_tests(df: DataFrame, difference: str) -> DataFrame:
    """P values of the sign test, of Wilcoxon's signed ranks and of the t test of differences (nulls left out)."""
    r = _signs(df, difference).first()
    n, up, ranks, ties = int(r["n"] or 0), int(r["n_positive"] or 0), float(r["rank_sum"] or 0), float(r["ties"] or 0)
    p_t = t_p(float(r["t"]), int(r["n_all"]) - 1) if r["t"] is not None else None
    row = (int(r["n_all"]), n, up, n - up, ranks, binomial_p(up, n), signed_rank_p(ranks, n, ties), p_t)
    return df.sparkSession.createDataFrame([row], "n long, n_moved long, positive long, negative long, rank_sum double, p_sign double, p_rank double, p_t double")


def mcnemar(df: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    """Discordant pairs of two classifiers and the exact test on them."""
    r = mcnemar_counts(df, gold, a, b).first()
    only_a, only_b = int(r["only_a"]), int(r["only_b"])
    return df.sparkSession.createDataFrame([(only_a, only_b, binomial_p(only_a, only_a + only_b))], "only_a long, only_b long, p double")


def mcnemar_counts(df: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    """Discordant pairs of two classifiers."""
    ok_a, ok_b = F.col(a) == F.col(gold), F.col(b) == F.col(gold)
    return df.agg(F.count_if(ok_a & ~ok_b).alias("only_a"), F.count_if(~ok_a & ok_b).alias("only_b"))


# -- agreement


def paired_series(events: DataFrame, a: DataFrame, b: DataFrame, pad: int = 7) -> DataFrame:
    """L1: two sources by step around events; a missing step counts 0."""
    steps = events.select("event_id", "symbol", "start", "end", F.explode(F.sequence(F.col("start") - pad, F.col("end") + pad)).alias("step"))
    out = steps.join(a.select("symbol", "step", F.col("n").alias("na")), ["symbol", "step"], "left").join(b.select("symbol", "step", F.col("n").alias("nb")), ["symbol", "step"], "left")
    phase = F.when(F.col("step") < F.col("start"), "pre").when(F.col("step") > F.col("end"), "post").otherwise("event")
    return out.na.fill(0, ["na", "nb"]).withColumn("phase", phase).withColumn("age", F.col("step") - F.col("start"))


def lead_lag(pairs: DataFrame, key: str, most: int = 3) -> DataFrame:
    """L2: correlation of log counts at each lag of b, the best lag (the smallest in size on ties)."""
    w = Window.partitionBy(key).orderBy("step")
    shifted = F.array(*(F.struct(F.lit(k).alias("lag"), (F.lag("nb", k).over(w) if k > 0 else F.lead("nb", -k).over(w) if k < 0 else F.col("nb")).alias("nb")) for k in range(-most, most + 1)))
    moved = pairs.select(key, "na", shifted.alias("s"))
    long = moved.select(key, "na", F.explode("s").alias("l")).select(key, "na", "l.*").dropna()
    corr = long.groupBy(key, "lag").agg(F.round(F.corr(F.log1p("na"), F.log1p("nb")), 6).alias("corr"))
    return corr.groupBy(key).agg(F.max_by("lag", F.struct("corr", (-F.abs("lag")).alias("c"), "lag")).alias("best_lag"), F.max("corr").alias("best_corr"))


def peak_offset(pairs: DataFrame, least: int = 3) -> DataFrame:
    """L2: steps from the peak of a to that of b inside an event (the first of equal ones), negative where b peaks first.

    Null for events of fewer than ``least`` steps and where b is 0 throughout.
    """
    first = lambda c: F.max_by("step", F.struct(c, (-F.col("step")).alias("s")))
    per = pairs.filter("phase = 'event'").groupBy("event_id").agg(F.count("*").alias("_n"), F.max("nb").alias("_b"), (first("nb") - first("na")).alias("_o"))
    return per.select("event_id", F.when((F.col("_n") >= least) & (F.col("_b") > 0), F.col("_o")).alias("peak_offset"))


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """L3: observed agreement, that expected from the margins, and Cohen's kappa."""
    by = by or []
    cells = df.dropna(subset=[a, b]).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    m = cells.withColumn("_total", F.sum("n").over(w)).withColumn("_same", F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0))
    m = m.withColumn("_row", F.sum("n").over(Window.partitionBy(*by, a))).withColumn("_col", F.sum("n").over(Window.partitionBy(*by, b)))
    # margins of one class meet on the diagonal; classes that never meet there are added from the row side
    rows = df.dropna(subset=[a, b]).select(*by, F.explode(F.array(F.struct(F.col(a).alias("c"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).alias("c"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s")).select(*by, "s.*")
    expected = rows.groupBy(*by, "c").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).groupBy(*by).agg((F.sum(F.col("x") * F.col("y")) / (F.sum("x") * F.sum("x"))).alias("expected"))
    observed = m.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("_same") / F.sum("n")).alias("observed"))
    out = observed.join(expected, by) if by else observed.join(expected)
    return out.select(*by, "n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")), 6).alias("kappa"))


def threshold_ladder(df: DataFrame, a: str, b: str, size: str, thresholds: list[int]) -> DataFrame:
    """L3: kappa of the rows at or above each signal size."""
    long = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col(size) >= F.col("threshold"))
    return kappa(long, a, b, ["threshold"])


def _cluster_replicas(replicas: int, seed: int):
    """Sums of clusters' sign tables by threshold and replica, over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            threshold, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cells = np.stack([batch.column(k).to_numpy() for k in range(2, 6)], 1).astype(float)
            for t in np.unique(threshold).tolist():
                rows = threshold == t
                sums = _weights(key[rows], list(range(1, replicas + 1)), seed).T @ cells[rows]
                held[t] = held[t] + sums if t in held else sums
        for t, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicas, t)), pa.array(np.arange(1, replicas + 1)), *map(pa.array, sums.T)], ["threshold", "replica", "pp", "pn", "np", "nn"])

    return run


def sign_agreement(df: DataFrame, a: str, b: str, size: str, cluster: str, thresholds: list[int], replicas: int = 500, seed: int = 3) -> DataFrame:
    """L3: two directional indices of the same units (``a``: the source with ``size`` directional messages, ``b``: the reference).

    Per least size: units, units with a sign in both, agreement, share of positive signs, agreement expected from them,
    kappa with the 2.5 and 97.5 % points over clusters drawn anew, how often negative signs (the rarer class) of either meet
    one of the other, and the correlation of levels. All replicas are weights on clusters' sign tables, summed in one job.
    """
    rows = df.dropna(subset=[a, b]).select(F.explode(F.array(*(F.lit(t).cast("long") for t in thresholds))).alias("threshold"), F.col(size).alias("_size"), F.xxhash64(cluster).alias("_key"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    rows = rows.filter(F.col("_size") >= F.col("threshold"))
    up, down = (lambda c: F.col(c) > 0), (lambda c: F.col(c) < 0)
    both = (F.col("_a") != 0) & (F.col("_b") != 0)
    cells = [F.count_if(x("_a") & y("_b")).alias(n) for n, x, y in (("pp", up, up), ("pn", up, down), ("np", down, up), ("nn", down, down))]
    level = F.when(both, F.col("_a"))
    found = rows.groupBy("threshold").agg(F.count("*").alias("units"), *cells, F.corr(level, F.when(both, F.col("_b"))).alias("corr"))
    n = F.col("pp") + F.col("pn") + F.col("np") + F.col("nn")
    observed, pa_, pb = (F.col("pp") + F.col("nn")) / n, (F.col("pp") + F.col("pn")) / n, (F.col("pp") + F.col("np")) / n
    expected = pa_ * pb + (1 - pa_) * (1 - pb)
    k = F.try_divide(F.try_divide(F.col("pp") + F.col("nn"), n) - expected, 1 - expected)
    per = rows.filter(both).groupBy("threshold", "_key").agg(*cells)
    drawn = per.mapInArrow(_cluster_replicas(replicas, seed), "threshold long, replica long, pp double, pn double, np double, nn double")
    drawn = drawn.groupBy("threshold", "replica").agg(*(F.sum(c).alias(c) for c in ("pp", "pn", "np", "nn"))).filter(n > 0).select("threshold", k.alias("k"))
    q = lambda p: F.percentile("k", F.lit(p))
    band = drawn.groupBy("threshold").agg(F.count("k").alias("replicas"), q(0.025).alias("kappa_low"), q(0.975).alias("kappa_high"))
    return found.join(band, "threshold", "left").filter(n > 0).select(
        "threshold", "units", n.alias("both_signed"), observed.alias("observed"), pa_.alias("positive_a"), pb.alias("positive_b"), expected.alias("expected"), k.alias("kappa"), "replicas", "kappa_low", "kappa_high",
        (F.col("pn") + F.col("nn")).alias("negative_b"), (F.col("np") + F.col("nn")).alias("negative_a"), F.col("nn").alias("negative_both"),
        F.try_divide(F.col("nn"), F.col("pn") + F.col("nn")).alias("found_of_b"), F.try_divide(F.col("nn"), F.col("np") + F.col("nn")).alias("found_of_a"), "corr",
    )


def series_agreement(df: DataFrame, key: str, x: str, y: str, size: str, least: int) -> DataFrame:
    """L4: correlation per key, and pooled (key null), of rows with enough signal."""
    rows = df.filter(F.col(size) >= least).dropna(subset=[x, y])
    found = [F.count("*").alias("n"), F.round(F.corr(x, y), 6).alias("corr")]
    # the pooled row is there without rows, too
    pooled = rows.agg(*found).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), "n", "corr")
    return rows.groupBy(key).agg(*found).unionByName(pooled)


def event_study(mentions: DataFrame, ignitions: DataFrame, span: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Mentions followed by an ignition of the symbol within [-before, after], against what chance gives.

    ``span`` has one row with ``steps``, the length of the calendar.
    """
    near = mentions.select("source", "symbol", "mention_id", F.explode(F.sequence(F.col("step") - before, F.col("step") + after)).alias("start"))
    hit = near.join(ignitions.select("symbol", "start").distinct(), ["symbol", "start"]).groupBy("mention_id").agg(F.lit(1).alias("_hit"))
    rate = ignitions.groupBy("symbol").agg(F.count("*").alias("_events")).join(F.broadcast(span)).select("symbol", F.least(F.col("_events") * (before + after + 1) / F.col("steps"), F.lit(1.0)).alias("_rate"))
    rows = mentions.join(hit, "mention_id", "left").join(rate, "symbol", "left").na.fill(0, ["_hit"]).na.fill(0.0, ["_rate"])
    return rows.groupBy("source").agg(F.count("*").alias("mentions"), F.sum("_hit").alias("hits"), F.round(F.sum("_rate"), 6).alias("expected"))


def control_mentions(mentions: DataFrame, span: DataFrame, before: int = 1, after: int = 3, times: int = 1, seed: int = 3) -> DataFrame:
    """Dates without a mention, ``times`` as many per source and symbol as there are dates with one, none of them within
    [-before, after] of a real one (or one within that of it).

    ``span`` has one row with ``first`` and ``last`` step. Fewer where a calendar has too few free dates.
    """
    real = mentions.select("source", "symbol", "step").distinct()
    sizes = real.groupBy("source", "symbol").agg((F.count("*") * times).alias("_k"))
    reach = max(before, after)
    taken = real.select("source", "symbol", F.explode(F.sequence(F.col("step") - reach, F.col("step") + reach)).alias("step")).distinct()
    free = sizes.join(F.broadcast(span.select("first", "last"))).select("source", "symbol", "_k", F.explode(F.sequence("first", "last")).alias("step")).join(taken, ["source", "symbol", "step"], "left_anti")
    # a group is one calendar
    order = Window.partitionBy("source", "symbol").orderBy(F.xxhash64(F.lit(seed), "source", "symbol", "step"), "step")
    picked = free.withColumn("_r", F.row_number().over(order)).filter("_r <= _k")
    return picked.select("source", "symbol", "step", F.concat_ws("_", F.lit("control"), "source", "symbol", F.col("step").cast("string")).alias("mention_id"))


def event_study_controls(mentions: DataFrame, ignitions: DataFrame, span: DataFrame, before: int = 1, after: int = 3, times: int = 1, seed: int = 3) -> DataFrame:
    """The study of distinct (source, symbol, date) mentions beside that of its negative controls: rates, and z of the difference."""
    steps = span.select((F.col("last") - F.col("first") + 1).alias("steps"))
    real = mentions.select("source", "symbol", "step").distinct().withColumn("mention_id", F.concat_ws("_", "source", "symbol", F.col("step").cast("string")))
    found = event_study(real, ignitions, steps, before, after)
    control = event_study(control_mentions(mentions, span, before, after, times, seed), ignitions, steps, before, after)
    both = found.join(control.select("source", F.col("mentions").alias("controls"), F.col("hits").alias("control_hits"), F.col("expected").alias("control_expected")), "source", "left").na.fill(0)
    a, b = F.try_divide(F.col("hits"), F.col("mentions")), F.try_divide(F.col("control_hits"), F.col("controls"))
    pooled = F.try_divide(F.col("hits") + F.col("control_hits"), F.col("mentions") + F.col("controls"))
    z = F.try_divide(a - b, F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("mentions")) + F.try_divide(F.lit(1), F.col("controls")))))
    return both.select("*", a.alias("rate"), b.alias("control_rate"), z.alias("z"))


def extrapolate_volume(samples: DataFrame, key: str, time: str) -> DataFrame:
    """A capped sample's volume per day, n * 1440 / minutes spanned."""
    seconds = F.timestamp_diff("MICROSECOND", F.min(time), F.max(time)) / 1e6
    return samples.groupBy(key).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("*") * 1440 * 60, seconds), 6).alias("per_day"))


def dual_panel(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """The same units labelled twice: counts by each, optimism of each, absolute difference."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    index = lambda c: F.log((1 + n(c, "bull")) / (1 + n(c, "bear")))
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.round(index(a), 6).alias("b_a"), F.round(index(b), 6).alias("b_b"), F.round(F.abs(index(a) - index(b)), 6).alias("difference"))


def dual_agreement(panel: DataFrame, key: str, other_n: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Over units of ``dual_panel``: units, correlation of the two indices, mean absolute difference, and units whose
    number of messages isn't that of ``other_n`` (key columns and ``n_other``), for each ``key`` and for all (null)."""
    rows = panel
    if other_n is not None:
        rows = rows.join(other_n, by or [key], "left").withColumn("_off", (~F.col("n").eqNullSafe(F.col("n_other"))).cast("int"))
    else:
        rows = rows.withColumn("_off", F.lit(0))
    found = [F.count("*").alias("units"), F.sum("n").alias("messages"), F.corr("b_a", "b_b").alias("corr"), F.avg("difference").alias("mean_difference"), F.sum("_off").alias("different_n")]
    return rows.groupBy(key).agg(*found).unionByName(rows.agg(*found).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), "units", "messages", "corr", "mean_difference", "different_n"))


def model_duel(rows: DataFrame, a: tuple[str, ...], b: tuple[str, ...], others: tuple[str, ...], stop: str, event: str, start: str | None = None) -> dict:
    """The same duration model with the covariates of one source and of the other, on the rows that have both."""
    from .fits import Spec, cox_fits

    complete = " and ".join(f"{c} is not null" for c in (*a, *b, *others))
    return cox_fits(rows, [Spec("a", (*others, *a), complete), Spec("b", (*others, *b), complete)], stop, event, start)


# -- figures and expectations


def figure(df: DataFrame, name: str, numerator: Column, denominator: Column, definition: str) -> DataFrame:
    """Q1: one figure with its parts and its definition."""
    return df.agg(numerator.cast("double").alias("numerator"), denominator.cast("double").alias("denominator")).select(
        F.lit(name).alias("figure"), F.lit(definition).alias("definition"), "numerator", "denominator", F.round(F.try_divide("numerator", "denominator"), 6).alias("value")
    )


def figure_registry(figures: list[DataFrame]) -> DataFrame:
    out = figures[0]
    for f in figures[1:]:
        out = out.unionByName(f)
    return out


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q2: rows and violations of each rule (a null counts as one), in one pass."""
    agg = df.agg(F.count("*").alias("rows"), *(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    return agg.unpivot("rows", list(rules), "rule", "violations")


def require(df: DataFrame, rules: dict[str, Column]) -> None:
    """Q2: raise where a rule is violated."""
    bad = [(r["rule"], r["violations"]) for r in expect(df, rules).filter("violations > 0").collect()]
    if bad:
        raise ValueError(f"violated: {bad}")


def flow_table(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Q3: rows that are left after each step in turn."""
    left, columns = F.lit(True), []
    for name, rule in steps.items():
        left = left & F.coalesce(rule, F.lit(False))
        columns.append(F.count_if(left).alias(name))
    return df.agg(F.count("*").alias("imported"), *columns).unpivot([], ["imported", *steps], "step", "n")


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q4: correlation of two builds by symbol: lowest, 10 % point, median, and number of symbols."""
    both = a.select("symbol", "step", F.col("n").alias("na")).join(b.select("symbol", "step", F.col("n").alias("nb")), ["symbol", "step"], "full_outer").na.fill(0, ["na", "nb"])
    per = both.groupBy("symbol").agg(F.corr("na", "nb").alias("c"), F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    q = lambda p: F.round(F.percentile("c", F.lit(p)), 6)
    return per.agg(F.count("*").alias("symbols"), F.round(F.min("c"), 6).alias("lowest"), q(0.1).alias("p10"), q(0.5).alias("median"), F.sum("ta").alias("total_a"), F.sum("tb").alias("total_b"))
