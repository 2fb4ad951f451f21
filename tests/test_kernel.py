"""The chunked scans must equal the plain windows and a brute-force reading of the rules."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.functions import pvalues as P
from tempora.operators import ordered as O
from tempora.operators import segment as G
from tempora.operators import timejoin as J
from tempora.sizing import chunk_width

WIDTHS = [None, 3.0, O.Measured(17, 600)]


def rows(df, *order):
    pdf = df.toPandas()
    return pdf.sort_values(list(order or pdf.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(1)
    data = [
        (s, i, float(r.choice([0, 1, 2, 5, 9])) + r.randrange(40), r.choice([None, 1.0, 2.0, 3.0]))
        for s in "ab" for i in range(120 if s == "a" else 15)
    ]
    return spark.createDataFrame(data, "s string, i int, t double, v double")


def test_scans_agree(spark, points):
    scans = {
        "run": O.running(F.coalesce("v", F.lit(0.0))), "low": O.running(F.col("v"), "min"),
        "last": O.last_known(F.col("v")), "before": O.last_before(F.col("v")),
        "next": O.next_known(F.col("v")), "after": O.next_after(F.col("v")),
    }
    a = rows(O.ordered_scan(points, ["s"], ["t", "i"], scans), "s", "i")
    b = rows(O.ordered_scan(points, ["s"], ["t", "i"], scans, width=3.0), "s", "i")
    pd.testing.assert_frame_equal(a, b[a.columns])
    one = a[a.s == "b"].sort_values(["t", "i"])
    assert one["before"].tolist()[1:] == pytest.approx(one["v"].ffill().tolist()[:-1], nan_ok=True)
    assert one["next"].tolist() == pytest.approx(one["v"].bfill().tolist(), nan_ok=True)


@pytest.mark.parametrize("width", WIDTHS)
def test_ranks_quantiles_lags(points, width):
    got = rows(O.tie_ranks(points, ["s"], "t", "r", width, below="upto"), "s", "i")
    want = points.toPandas().sort_values(["s", "i"]).reset_index(drop=True)
    assert got["r"].tolist() == want.groupby("s")["t"].rank().tolist()
    assert got["upto"].tolist() == want.groupby("s")["t"].rank(method="max").tolist()
    q = rows(O.quantiles(points, ["s"], "t", {"a": 0.1, "m": 0.5, "z": 0.93}, width), "s")
    for c, p in (("a", 0.1), ("m", 0.5), ("z", 0.93)):
        assert q[c].tolist() == pytest.approx(want.groupby("s")["t"].quantile(p).tolist())
    lag = rows(O.lagged(points, ["s"], ["t", "i"], {"p": F.col("v")}, {"n": F.col("v")}, width), "s", "t", "i")
    assert lag["p"].tolist() == pytest.approx(lag.groupby("s")["v"].shift(1).tolist(), nan_ok=True)
    assert lag["n"].tolist() == pytest.approx(lag.groupby("s")["v"].shift(-1).tolist(), nan_ok=True)


@pytest.mark.parametrize("width", WIDTHS)
def test_asof_matches_merge_asof(spark, width):
    r = random.Random(2)
    left = pd.DataFrame({"s": 1, "i": range(200), "t": [r.randrange(60) / 2 for _ in range(200)]})
    right = pd.DataFrame({"s": 1, "trial": range(20), "c": sorted(r.sample(range(60), 20))}).assign(c=lambda d: d.c / 2)
    L, R = spark.createDataFrame(left), spark.createDataFrame(right)
    for op, direction in ((J.asof_backward, "backward"), (J.asof_forward, "forward")):
        want = pd.merge_asof(left.sort_values("t"), right.drop(columns="s"), left_on="t", right_on="c", direction=direction)
        got = rows(op(L, R, ["s"], "t", "c", {"trial": "trial"}, width), "i")
        assert got["trial"].tolist() == pytest.approx(want.sort_values("i")["trial"].tolist(), nan_ok=True)
    got = rows(J.previous_and_next(L, R, ["s"], "t", "c", {"p": "__at"}, {"n": "__at"}, width), "i")
    for t, p, n in got[["t", "p", "n"]].itertuples(index=False):
        before, after = right.c[right.c <= t], right.c[right.c > t]
        assert (p == before.max()) if len(before) else math.isnan(p)
        assert (n == after.min()) if len(after) else math.isnan(n)


@pytest.mark.parametrize("width", WIDTHS)
def test_window_counts_and_interval_join(spark, width):
    r = random.Random(3)
    spikes = [r.randrange(400) / 8 for _ in range(150)]
    events = [r.randrange(50) for _ in range(30)]
    S = spark.createDataFrame([("u", t) for t in spikes], "u string, t double")
    E = spark.createDataFrame([("u", i, float(t)) for i, t in enumerate(events)] + [("u", 99, None)], "u string, i int, e double")
    got = rows(J.window_stats(S, E, ["u"], "t", "e", {"w": (0.5, 2.0), "b": (-3.0, 0.0)}, width), "i")
    assert len(got) == 31 and got.loc[got.i == 99, "n_w"].item() == 0
    for i, t in enumerate(events):
        inside = [s for s in spikes if t + 0.5 <= s < t + 2.0]
        row = got[got.i == i].iloc[0]
        assert row.n_w == len(inside)
        assert row.n_b == sum(t - 3.0 <= s < t for s in spikes)
        assert (row.first_w == min(inside) - t) if inside else math.isnan(row.first_w)
    pairs = J.peri_event(S, E.where("e is not null"), ["u"], "t", "e", -1.0, 1.5)
    assert pairs.count() == sum(-1.0 <= s - t <= 1.5 for s in spikes for t in events)


@pytest.mark.parametrize("width", WIDTHS)
def test_segments_follow_the_frame_machine(spark, width):
    r = random.Random(4)
    for case in range(3):
        valid = [r.random() < 0.55 for _ in range(60)]
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(valid)], "s string, frame bigint, ok boolean")
        for gap in (0, 1, 3):
            got = rows(G.segment_movements(df, ["s"], "frame", F.col("ok"), gap, width=width), "frame")
            want, current, missed = [], [], 0
            for i, v in enumerate(valid + [False] * (gap + 2)):
                if v:
                    current = current + [i] if current else [i]
                    missed = 0
                elif current:
                    missed += 1
                    if missed > gap:
                        want.append(list(range(current[0], current[-1] + 1)))
                        current = []
            assert got.groupby("movement_id")["frame"].apply(list).tolist() == want


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("max_island", [1000, 3])
def test_refractory(spark, width, max_island):
    r = random.Random(5)
    times = sorted({r.randrange(300) / 4 for _ in range(140)})
    kept, last = [], -math.inf
    for t in times:
        if t - last > 1.1:
            kept.append(t)
            last = t
    df = spark.createDataFrame([("s", t) for t in times], "s string, t double")
    got = G.refractory_filter(df, ["s"], "t", 1.1, max_island, width)
    assert sorted(x.t for x in got.collect()) == kept


@pytest.mark.parametrize("width", WIDTHS)
def test_bouts_smoothing_regrid(spark, width):
    t = [0.0, 0.3, 0.6, 2.0, 2.4, 9.0]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(t)], "s string, i int, t double")
    got = rows(G.movement_bouts(df, ["s"], "t", 0.5, width=width), "t")
    assert got.bout_id.tolist() == [0, 0, 0, 1, 1, 2]
    assert got.bout_position.tolist() == [1, 2, 3, 1, 2, 1] and got.bout_size.tolist() == [3, 3, 3, 2, 2, 1]
    line = spark.createDataFrame([("s", i, float(i * i)) for i in range(20)], "s string, n bigint, v double")
    w = [0.25, 0.5, 0.25]
    smooth = rows(G.smooth_fir(line, ["s"], "n", "v", w, "f", width), "n").f.tolist()
    assert len(smooth) == 20 and smooth[5] == pytest.approx(0.25 * 16 + 0.5 * 25 + 0.25 * 36)
    assert smooth[0] == pytest.approx((0.5 * 0 + 0.25 * 1) / 0.75)
    gaps = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, None), ("s", 2.0, 4.0), ("s", 6.0, None)], "s string, t double, x double")
    grid = rows(G.regrid(gaps, ["s"], "t", ["x"], 1.0, width), "t")
    assert grid.t.tolist() == pytest.approx([0, 1, 2, 2 + 4 / 3, 2 + 8 / 3, 6])
    assert grid.x.tolist() == pytest.approx([0, 2, 4, 4, 4, 4])


def test_sizing(spark):
    small = spark.range(100).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"))
    assert chunk_width(small, ["k"], "t", 1000) is None
    width = chunk_width(small, ["k"], "t", 10)
    cells = small.groupBy(F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0]
    assert 1 <= cells <= 20


def test_tails(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first()[0]

    for z in (-3.0, 0.0, 1.0, 5.0, 8.0):
        assert value(P.normal_sf(F.lit(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)
    for x in (0.5, 3.0, 40.0):
        assert float(P._log_gamma(np.float64(x))) == pytest.approx(math.lgamma(x), abs=1e-9)
    assert value(P.student_p2(F.lit(1.0), F.lit(1))) == pytest.approx(0.5, rel=1e-9)
    assert value(P.student_p2(F.lit(2.0), F.lit(2))) == pytest.approx(1 - 2 / math.sqrt(6), rel=1e-9)
    assert value(P.student_p2(F.lit(2.0), F.lit(30_000))) == pytest.approx(0.0455, abs=2e-5)
    t = value(P.student_quantile(F.lit(0.05), F.lit(10.0)))
    assert t == pytest.approx(2.228139, abs=1e-5)
    exact = sum(math.comb(12, k) for k in range(4)) / 2**11
    assert value(P.binomial_half_p2(F.lit(9), F.lit(3))) == pytest.approx(exact, rel=1e-9)
    # the tea-tasting table
    assert value(P.fisher_exact_p2(*[F.lit(v) for v in (3, 1, 1, 3)])) == pytest.approx(34 / 70, rel=1e-9)


AWKWARD = [(k, v) for k in (None, "", "a") for v in (None, float("nan"), 0.2, 0.2, 0.7, 3.0, float("inf"), -1.5)]


def same_for_every_width(make):
    """The rows of `make(width)` without a width; they must be those of a small and a large one."""
    rows = [sorted(map(repr, make(width).collect())) for width in (None, 0.5, 1e6)]
    assert rows[0] == rows[1] == rows[2]
    return rows[0]


def test_awkward_keys_and_values_scan_alike(spark):
    from tempora.operators.ordered import ordered_scan, quantiles, running, tie_ranks

    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(AWKWARD)], "k string, v double, id long")
    rows = same_for_every_width(lambda w: ordered_scan(df, ["k"], ["v", "id"], {"n": running(F.lit(1).cast("bigint"))}, w))
    assert len(rows) == len(AWKWARD)
    assert len(same_for_every_width(lambda w: tie_ranks(df, ["k"], "v", "r", w))) == sum(v is not None for _, v in AWKWARD)
    assert len(same_for_every_width(lambda w: quantiles(df.where("v < 10"), ["k"], "v", {"m": 0.5, "q": 0.9}, w))) == 3


def test_fdr_keeps_null_apart_from_empty(spark):
    from tempora.operators.stats import fdr_bh

    rows = [(None, 0.02), (None, 0.5), ("", 0.02), ("", None), ("a", 0.001), ("a", 0.001), ("a", 0.04), (None, None)]
    df = spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(rows)], "k string, p double, id long")
    for keys in (["k"], []):
        assert len(same_for_every_width(lambda w: fdr_bh(df, keys, "p", "q", w).withColumn("q", F.round("q", 9)))) == len(rows)
    q = {r.id: r.q for r in fdr_bh(df, ["k"], "p", "q", 1.0).collect()}
    assert q[0] == pytest.approx(0.04) and q[2] == pytest.approx(0.02) and q[3] is None


def test_dead_time_has_one_rule_for_short_and_long_islands(spark):
    from tempora.operators.segment import refractory_filter

    times = [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 5.0, 5.2, 5.4]
    df = spark.createDataFrame([("s", t) for t in times], "k string, t double")
    kept = {tuple(sorted(r.t for r in refractory_filter(df, ["k"], "t", 0.2, max_island=m).collect())) for m in (2000, 1)}
    last, expected = None, []
    for t in times:
        if last is None or t > last + 0.2:
            last = t
            expected.append(t)
    assert kept == {tuple(expected)}


def test_neighbours_of_isolated_and_crowded_rows(spark):
    from tempora.operators.resample import neighbours

    places = [(i, 0.001 * i, 0.0, 0.0) for i in range(20)] + [(20, 400.0, 0.0, 0.0), (21, 0.001, 0.0, 0.0)]
    df = spark.createDataFrame([(*p, p[0] % 3) for p in places], "id long, x double, y double, z double, fold long")
    got = {}
    for r in neighbours(df, "id", ["x", "y", "z"], "fold", 4, 0.01).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    for i, x, _, _ in places:
        order = sorted((abs(x - y), j) for j, y, _, _ in places if j % 3 != i % 3)
        assert sorted(got[i]) == sorted(j for _, j in order[:4])


@pytest.mark.parametrize("closed", ["both", "left", "right", "none"])
def test_interval_join_at_all_lengths(spark, closed):
    rng = random.Random(closed)
    inf = float("inf")
    spans = [(rng.choice("ab"), i, s, s + rng.choice([0.0, 0.3, 2.0, 50.0, 3000.0, 90000.0]), ) for i, s in enumerate(rng.uniform(-5000, 5000) for _ in range(60))]
    spans += [("a", 100, -inf, inf), ("b", 101, 3.0, 2.0), ("b", 102, None, 4.0), ("a", 103, -1e12, 1e12), (None, 104, 0.0, 1.0), ("b", 105, 7.0, 7.0)]
    points = [(rng.choice("ab"), j, rng.choice([rng.uniform(-6000, 6000), float(rng.randrange(-20, 20))])) for j in range(300)] + [("a", 900, inf), ("a", 901, None), ("b", 902, 7.0)]
    above = (lambda t, lo: t >= lo) if closed in ("both", "left") else (lambda t, lo: t > lo)
    below = (lambda t, hi: t <= hi) if closed in ("both", "right") else (lambda t, hi: t < hi)
    expected = sorted((j, i) for k, i, lo, hi in spans for q, j, t in points if k == q and None not in (lo, hi, t) and lo <= hi and above(t, lo) and below(t, hi))
    ps, ss = spark.createDataFrame(points, "k string, j int, t double"), spark.createDataFrame(spans, "k string, i int, lo double, hi double")
    got = J.interval_join(ps, ss, ["k"], "t", "lo", "hi", 1.0, closed)
    assert sorted(map(tuple, got.select("j", "i").collect())) == expected and expected
    assert J.interval_join(ps, ss.limit(0), ["k"], "t", "lo", "hi", 1.0, closed).count() == 0


def test_an_interval_over_the_whole_axis_is_few_rows(spark):
    spans = spark.createDataFrame([(1, 0.0, 10.0**9), (1, -(10.0**6), 3.0), (1, -math.inf, math.inf), (1, 2.0, 2.1)], "k int, lo double, hi double")
    points = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 1e6).alias("t"))
    listed = J.listed_intervals(spans, "lo", "hi", 0.5).groupBy("lo", "hi").count().collect()
    assert len(listed) == 4 and max(r["count"] for r in listed) <= 2**J.NODE_BITS + 1
    assert J.interval_join(points, spans, ["k"], "t", "lo", "hi", 0.5).count() == 1000 + 1 + 1000


def test_measured_edges_are_even_on_heavy_tails(spark):
    """Every chunk stays under twice the wanted rows, whatever the shape of the column and the size of the other groups."""
    rng = np.random.default_rng(1)
    shapes = {"pareto": rng.pareto(0.4, 30_000), "lattice": np.exp(np.round(rng.normal(size=20_000), 3) * 9), "even": rng.random(9000), "small": rng.random(300)}
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, vs in shapes.items() for v in vs], columns=["k", "v"])).repartition(7)
    width = O.Measured(1000, 60_000)
    edges = {r.k: r["__edges"] for r in O.measured_edges(df, ["k"], F.col("v"), width).collect()}
    assert set(edges) == {"pareto", "lattice", "even"}
    for k, cut in edges.items():
        sizes = np.bincount(np.searchsorted(cut, shapes[k], "right"))
        assert sizes.max() < 2000 and len(sizes) < 2.5 * len(shapes[k]) / 1000
    counted = df.select("k", "v", F.xxhash64("v").alias("i")).dropDuplicates()
    plain, chunked = (O.numbered(counted, ["k"], ["v", "i"], "n", w).groupBy("k").agg(F.sum(F.col("n") * F.col("v")).alias("s"), F.count_distinct("n").alias("c")) for w in (None, width))
    a, b = ({r.k: r for r in x.collect()} for x in (plain, chunked))
    assert all(a[k].c == b[k].c and a[k].s == pytest.approx(b[k].s) for k in a)
    alone = O.tie_ranks(df.where("k = 'pareto'"), [], "v", width=O.Measured(1000, 30_000)).agg(F.sum("avg_rank")).first()[0]
    assert alone == 30_000 * 30_001 / 2


def test_neighbours_where_most_rows_share_a_place(spark, monkeypatch):
    """A dense cell and a place with a third of the rows: the same neighbours as by comparing all pairs."""
    from tempora.operators import resample as R

    monkeypatch.setattr(R, "CELL_PLACES", 8)
    rng = np.random.default_rng(7)
    xyz = np.concatenate([np.zeros((60, 3)), rng.normal(0, 0.001, (60, 3)), rng.normal(0, 5, (40, 3)), [[90.0, 0, 0]]])
    fold = np.arange(len(xyz)) % 4
    df = spark.createDataFrame([(i, *map(float, p), int(f)) for i, (p, f) in enumerate(zip(xyz, fold))], "id int, x double, y double, z double, fold int").repartition(4)
    got = {}
    for r in R.neighbours(df, "id", ["x", "y", "z"], "fold", 6, 4.0).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    for i in range(len(xyz)):
        far = np.sqrt(((xyz - xyz[i]) ** 2).sum(1))
        want = sorted((far[j], j) for j in range(len(xyz)) if fold[j] != fold[i])[:6]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want] and np.allclose([d for d, _ in sorted(got[i])], [d for d, _ in want])


def test_student_tail_does_not_jump_where_its_formula_changes():
    t = np.array([0.0, 0.3, 1.0, 2.0, 4.0, 6.0])
    below, above = (P._student_p2(t, np.full(len(t), float(df))) for df in (P.LARGE_DF, P.LARGE_DF + 1))
    assert np.allclose(below, above, rtol=2e-3, atol=0) and np.allclose(below[:4], above[:4], rtol=1e-5, atol=0)


def test_neighbours_of_a_cell_dealt_over_tasks(spark, monkeypatch):
    """Places of a cell meet in parts, and of every part only the k nearest leave the task: no pair is a row of a join."""
    from tempora.operators import resample as R

    for name, to in (("CELL_PLACES", 40), ("MET_PLACES", 64), ("HELD_DISTANCES", 500)):
        monkeypatch.setattr(R, name, to)
    rng = np.random.default_rng(9)
    xyz = np.round(rng.normal(size=(300, 3)), 1)  # many equal distances
    df = spark.createDataFrame([(i, *map(float, p), i % 3) for i, p in enumerate(xyz)], "id long, x double, y double, z double, fold int").repartition(3)
    got = {}
    for r in R.neighbours(df, "id", ["x", "y", "z"], "fold", 5, 2.0).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    for i in range(300):
        d = np.sqrt((xyz[i, 0] - xyz[:, 0]) ** 2 + (xyz[i, 1] - xyz[:, 1]) ** 2 + (xyz[i, 2] - xyz[:, 2]) ** 2)
        assert sorted(got[i]) == sorted((d[j], j) for j in range(300) if j % 3 != i % 3)[:5]
