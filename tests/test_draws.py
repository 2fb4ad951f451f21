"""Permutation tests by random subsets, against enumeration of all of them."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import draws
from tempora.operators import resample as R


def exact_shift_p(values, tagged, alternative):
    n, k = len(values), sum(tagged)
    shift = lambda chosen: sum(values[i] for i in chosen) / k - sum(values[i] for i in range(n) if i not in chosen) / (n - k)
    seen = shift({i for i in range(n) if tagged[i]})
    extreme = {"two-sided": lambda s: abs(s) >= abs(seen) - 1e-9, "greater": lambda s: s >= seen - 1e-9, "less": lambda s: s <= seen + 1e-9}[alternative]
    every = [shift(set(c)) for c in itertools.combinations(range(n), k)]
    return seen, sum(map(extreme, every)) / len(every)


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_shift_p_is_that_of_all_subsets(spark, alternative):
    groups = {
        "a": ([3.0, 3.0, 4.0, 9.0, 1.0, 1.0, 1.0, 2.5, 7.0, 8.0], [1, 1, 0, 1, 0, 0, 0, 1, 0, 1]),
        None: ([1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0], [1, 1, 0, 0, 1, 0, 1, 0, 0]),
        "one side": ([1.0, 2.0], [1, 1]),
    }
    rows = [(k, v, bool(t)) for k, (values, tags) in groups.items() for v, t in zip(values, tags)] + [("a", None, True), ("a", 5.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, t boolean").withColumns({"rep": F.lit(1), "c": F.lit(2)})
    got = {r.k: r for r in R.group_shift(df, [], "v", F.col("t"), 20_000, 3, None, alternative, ["k"]).collect()}
    for k in ("a", None):
        seen, p = exact_shift_p(*groups[k], alternative)
        assert got[k]["shift"] == pytest.approx(seen) and abs(got[k].p_perm - p) < 4 * math.sqrt(p * (1 - p) / 20_000) + 1e-4
    assert got["one side"].p_perm is None and got["one side"].n_other == 0
    again = {r.k: r.p_perm for r in R.group_shift(df.repartition(5), [], "v", F.col("t"), 20_000, 3, None, alternative, ["k"]).collect()}
    assert again == {k: r.p_perm for k, r in got.items()}


def test_subsets_have_the_moments_of_draws_without_replacement(spark):
    rng = np.random.default_rng(0)
    values = np.repeat(np.round(rng.normal(size=400), 3), rng.integers(1, 40, 400))
    bins = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    size = len(values) // 3
    for levels in (0, 3, 7):
        sums = np.array([r.v for r in draws.subset_sums(bins, [], "n", ["v"], spark.createDataFrame([(size,)], "size long"), "size", 4000, 1, levels).collect()])
        sd = math.sqrt(size * values.var() * (1 - size / len(values)) * len(values) / (len(values) - 1))
        assert len(sums) == 4000 and abs(sums.mean() - size * values.mean()) < 4 * sd / math.sqrt(4000) and abs(sums.std() / sd - 1) < 0.05


def test_strong_effects_reach_the_least_p(spark):
    df = spark.range(400).select((F.col("id") + F.when(F.col("id") % 4 == 0, 1000).otherwise(0)).cast("double").alias("v"), (F.col("id") % 4 == 0).alias("t"))
    assert R.group_shift(df, [], "v", F.col("t"), 20_000).first().p_perm == 1 / 20_001
    angles = spark.range(400).select((F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1600) / 400.0).alias("a"), (F.col("id") % 2 == 0).alias("t"))
    row = R.circular_permutation(angles, [], "a", F.col("t"), 5000).first()
    assert row.p_perm == 1 / 5001 and row.n1 == row.n2 == 200


def test_circular_p_is_that_of_all_subsets(spark):
    angles, tags = [0.1, 0.5, 0.9, 1.0, 2.0, 2.2, 3.9, 4.4, 5.0, 6.0], [1, 1, 1, 0, 1, 0, 0, 0, 1, 0]
    ranks = 1 + np.argsort(np.argsort(angles))
    turn = 2 * np.pi * ranks / len(ranks)

    def w(chosen):
        mask = np.isin(np.arange(len(ranks)), list(chosen))
        return sum(2 / m.sum() * (np.cos(turn[m]).sum() ** 2 + np.sin(turn[m]).sum() ** 2) for m in (mask, ~mask)) / 1.0

    every = np.array([w(c) for c in itertools.combinations(range(10), 5)])
    seen = w([i for i in range(10) if tags[i]])
    p = (every >= seen - 1e-9).mean()
    got = R.circular_permutation(spark.createDataFrame(list(zip(angles, map(bool, tags))), "a double, t boolean"), [], "a", F.col("t"), 5000).first()
    assert abs(got.p_perm - p) < 4 * math.sqrt(p * (1 - p) / 5000) + 1e-3


def test_large_nodes_are_split_near_their_mean():
    rng = np.random.default_rng(2)
    sample = np.full(2000, 4 * 10**9)
    taken = draws.hypergeometric(rng, 3 * 10**9, np.int64(9 * 10**9), sample)
    sd = math.sqrt(4e9 * 0.25 * 0.75 * (8 / 12))
    assert abs(taken.mean() - 1e9) < 4 * sd / math.sqrt(2000) and abs(taken.std() / sd - 1) < 0.1
    assert draws.hypergeometric(rng, 5, np.int64(10**10), np.array([10**10 + 5, 0])).tolist() == [5, 0]


def test_bootstrap_moments(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, *map(float, rng.normal(size=3))) for g in ("a", "b", None) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double, z double")
    got = draws.bootstrap_moments(df.repartition(3), ["g"], ["x", "y", "z"], ["g", "i"], 400, 5).toPandas()
    assert len(got) == 3 * 401
    again = draws.bootstrap_moments(df.repartition(7), ["g"], ["x", "y", "z"], ["g", "i"], 400, 5).toPandas()
    order = ["g", "rep"]
    a, b = (t.fillna({"g": "-"}).sort_values(order).drop(columns="g").to_numpy() for t in (got, again))
    assert np.allclose(a, b)
    for g in ("a", "b", None):
        own = np.array([r[2:] for r in rows if r[0] == g])
        t = got[got.g.isna() if g is None else got.g == g].set_index("rep").sort_index()
        first = t.loc[0]
        assert first.w == 700 and np.allclose([first.m0, first.m1, first.m2], own.sum(0)) and np.allclose([first.c0_1, first.c2_2], [own[:, 0] @ own[:, 1], own[:, 2] @ own[:, 2]])
        weights = t.loc[1:].w
        assert abs(weights.mean() - 700) < 4 * math.sqrt(700 / 400) and 0.8 < weights.std() / math.sqrt(700) < 1.2
        means = t.loc[1:].m0 / weights
        assert abs(means.std() / (own[:, 0].std() / math.sqrt(700)) - 1) < 0.2
    assert draws.bootstrap_moments(df.limit(0), [], ["x"], ["i"], 5).count() == 0


def test_poisson_weights_have_their_frequencies():
    u = draws.uniforms(np.arange(2000), np.arange(1, 101))
    counts = np.bincount(np.searchsorted(draws._poisson_steps(), u.ravel(), side="right"), minlength=6) / u.size
    assert np.allclose(counts[:6], [math.exp(-1) / math.factorial(k) for k in range(6)], atol=0.003)


def test_axes_of_the_rows_themselves(spark):
    """Replicate 0 solves the eigen equation of its method."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3)) * [1.0, 2.0, 0.5]
    label = rng.integers(0, 3, 500)
    x += np.outer(label, [1.5, -0.5, 0.2])
    f = x @ np.array([[0.5, 1.0], [-1.0, 0.2], [0.3, 2.0]]) + rng.normal(size=(500, 2))
    df = spark.createDataFrame([(i, *map(float, x[i]), *map(float, f[i]), int(label[i])) for i in range(500)], "i int, x double, y double, z double, f double, g double, l int")
    cca = {r.rep: np.array([r.a0, r.a1, r.a2]) for r in R.axis_cca(df, ["i"], ["x", "y", "z"], ["f", "g"], 50).collect()}
    assert len(cca) == 51
    c = np.cov(np.hstack([x, f]).T, bias=True)
    m = np.linalg.inv(c[:3, :3]) @ c[:3, 3:] @ np.linalg.inv(c[3:, 3:]) @ c[3:, :3]
    top = max(np.linalg.eigvals(m).real)
    assert np.allclose(m @ cca[0], top * cca[0], atol=1e-8)
    lda = {r.rep: np.array([r.a0, r.a1, r.a2]) for r in R.axis_lda(df, ["i"], ["x", "y", "z"], "l", 50).collect()}
    means = np.array([x[label == k].mean(0) for k in range(3)])
    within = sum(np.cov(x[label == k].T, bias=True) * (label == k).sum() for k in range(3))
    between = sum((label == k).sum() * np.outer(means[k] - x.mean(0), means[k] - x.mean(0)) for k in range(3))
    m = np.linalg.inv(within) @ between
    assert len(lda) == 51 and np.allclose(m @ lda[0], max(np.linalg.eigvals(m).real) * lda[0], atol=1e-8)
    assert np.mean([v @ lda[0] for v in lda.values()]) > 0.95


@pytest.mark.parametrize("n", [1, 7, 101, 1000])
def test_permutations_of_any_part(n):
    for rep in range(1, 4):
        whole = draws.Permutation(5, rep, n, 100)
        images = whole.images(np.arange(n))
        assert sorted(images) == list(range(n)) and np.array_equal(whole.origins(images), np.arange(n))
        assert n < 9 or np.array_equal(draws.Permutation(5, rep, n, 100).images(np.arange(3, 9)), images[3:9])


def test_values_come_to_places_evenly():
    """Of more ranks than a block: every value as often in every tenth, and neighbours apart as by chance."""
    images = np.stack([draws.Permutation(1, rep, 200, 10).images(np.arange(200)) for rep in range(4000)])
    tenths = np.stack([np.bincount(column // 20, minlength=10) for column in images.T])
    assert abs((tenths - 400.0) ** 2 / 400).sum(1).mean() < 9.5 and np.abs(tenths - 400).max() < 110
    steps = np.bincount((images[:, 1:] - images[:, :-1]).ravel() % 200, minlength=200)[1:]
    assert np.abs(steps / steps.mean() - 1).max() < 0.05


def test_spatial_trend_of_blocks_is_that_of_whole_permutations(spark, monkeypatch):
    """Blocks of values meet blocks of places; replicates are no rows, so none is broadcast or sorted."""
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.normal(size=4))) for i in range(150)]
    df = spark.createDataFrame(rows + [(150, None, 1.0, 1.0, 1.0)], "id int, x double, y double, z double, v double").repartition(5)
    for name, to in (("RANKS", 64), ("AT_ONCE", 7)):
        monkeypatch.setattr(draws, name, to)
    found = R.spatial_trend(df, ["id"], ["x", "y", "z"], "v", 20, 3)
    assert "Generate explode(sequence(1, 20" not in found._jdf.queryExecution().toString()
    got = found.first()
    ranks = {r.id: r["__i"] for r in R.ranked_rows(df.dropna(), ["id"], ["x", "y", "z", "v"], 3, None).collect()}
    table = np.array([r[1:] for r in sorted(rows, key=lambda r: ranks[r[0]])])
    places = np.column_stack([np.ones(150), table[:, :3]])

    def r2(v):
        left = v - places @ np.linalg.lstsq(places, v, rcond=None)[0]
        return 1 - left @ left / ((v - v.mean()) @ (v - v.mean()))

    null = []
    for rep in range(1, 21):
        v = np.empty(150)
        v[draws.Permutation(3, rep, 150, 64).images(np.arange(150))] = table[:, 3]
        null.append(r2(v))
    assert got.n == 150 and got.r2 == pytest.approx(r2(table[:, 3])) and got.null_mean == pytest.approx(np.mean(null)) and got.null_std == pytest.approx(np.std(null, ddof=1))
    assert got.p_perm == (1 + sum(s >= got.r2 - 1e-12 for s in null)) / 21


def test_neighbour_null_is_that_of_whole_permutations(spark, monkeypatch):
    """Blocks that need each other's values give the scores of whole vectors; replicates are no rows."""
    for name, to in (("RANKS", 32), ("AT_ONCE", 7)):
        monkeypatch.setattr(draws, name, to)
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(size=4)), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, v double, fold int").repartition(3)
    got = R.knn_cv_r2(df, "id", ["x", "y", "z"], "v", "fold", 4, 1.0, 20, 6).first()
    table = np.array([r[1:5] for r in rows])
    far = np.sqrt(((table[:, None, :3] - table[None, :, :3]) ** 2).sum(-1))
    far[np.arange(120)[:, None] % 3 == np.arange(120) % 3] = np.inf
    near = np.argsort(far, axis=1)[:, :4]
    share = 1 / np.take_along_axis(far, near, 1)
    share /= share.sum(1, keepdims=True)

    def r2(v):
        return 1 - ((v - (share * v[near]).sum(1)) ** 2).sum() / ((v - v.mean()) ** 2).sum()

    low, high = table[:, :3].min(0), table[:, :3].max(0)
    steps = np.floor((table[:, :3] - low) * ((2**16 - 1) / (high - low))).astype(np.int64)
    curve = sum((steps[:, i] >> bit & 1) << (3 * bit + i) for bit in range(16) for i in range(3))
    ranks = np.argsort(curve, kind="stable")
    null = []
    for rep in range(1, 21):
        v = np.empty(120)
        v[ranks[draws.Permutation(6, rep, 120, 32).images(np.arange(120))]] = table[ranks, 3]
        null.append(r2(v))
    assert got.n == 120 and got.r2_cv == pytest.approx(r2(table[:, 3]))
    assert got.p_perm == (1 + sum(s >= got.r2_cv for s in null)) / 21
