"""Edge semantics on hand-made rows: ties, nulls, bounds, guards and a session that is too big."""

import math

import pytest
from pyspark.sql import functions as F

from tempora.functions import keys as K
from tempora.operators import checks as C
from tempora.operators import describe as D
from tempora.operators import movements as M
from tempora.operators import perievent as E
from tempora.operators import predicates as P
from tempora.operators import resample as R
from tempora.operators import stats as X
from tempora.operators import timejoin as J
from tempora.operators.registry import UnitStatsRegistry
from tempora.sizing import chunk_width
from tempora.sources import readers, sinks


def test_nearest_takes_the_earlier_frame_and_the_later_lick(spark):
    frames = spark.createDataFrame([("s", i, i * 0.01) for i in range(5)], "session string, frame bigint, t double")
    licks = spark.createDataFrame([("s", 0, 0.015), ("s", 1, 0.011), ("s", 2, 0.5)], "session string, lick_index bigint, t double")
    hits = {r.lick_index: r.frame for r in J.nearest_within(licks, frames, ["session"], "lick_index", "t", "t", 0.01, ["frame"]).collect()}
    assert hits == {0: 1, 1: 1}
    marked = J.mark_licked_frames(frames, licks, ["session"], "frame", "t", "lick_index", "t", 0.01)
    assert {r.frame: r.lick_index for r in marked.where("lick").collect()} == {1: 1}


def test_window_bounds_are_half_open_and_slices_closed(spark):
    spikes = spark.createDataFrame([("s", 1.0), ("s", 2.0)], "u string, t double")
    event = spark.createDataFrame([("s", 0.0)], "u string, e double")
    row = J.window_stats(spikes, event, ["u"], "t", "e", {"w": (1.0, 2.0)}).first()
    assert (row.n_w, row.first_w) == (1, 1.0)
    assert J.peri_event(spikes, event, ["u"], "t", "e", 1.0, 2.0).count() == 2


def test_spanning_cue_is_strict(spark):
    spans = spark.createDataFrame([("s", 0.0, 1.0, 7), ("s", 0.5, 1.5, 7), ("s", 1.0, 2.0, 7)], "session string, a double, z double, trial int")
    cues = spark.createDataFrame([("s", 1.0)], "session string, cue double")
    got = {r.a: r.trial for r in J.null_if_spans(spans, cues, ["session"], "a", "z", "cue", "trial").collect()}
    assert got == {0.0: 7, 0.5: None, 1.0: 7}


def test_criteria_reject_null_and_nan(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan")), (4, 1.0)], "i int, v double")
    assert [r.i for r in P.filter_by_criteria(df, {"v": {"bounds": [0, 1]}}).orderBy("i").collect()] == [1, 4]


def test_path_length_needs_two_points(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1.0, None, None), ("a", 2.0, 3.0, 4.0), ("b", 0.0, 1.0, 1.0)], "m string, t double, x double, y double")
    assert {r.m: r.total_distance for r in M.path_length(df, ["m"], "t").collect()} == {"a": 5.0, "b": None}


def test_gates_of_rate_by_category(spark):
    rows = spark.createDataFrame([("u", 0, 1.0)] * 4 + [("u", 1, 5.0)] * 2, "u string, c int, r double").withColumn("spike_rate_hz", F.col("r")).withColumn("baseline_rate_hz", F.col("r"))
    sane = E.rate_by_category(rows, ["u"], "c").first()
    swapped = E.rate_by_category(rows, ["u"], "c", swapped_gates=True).first()
    assert sane.mean_0_spike_rate_hz == 1.0 and sane.mean_1_spike_rate_hz is None
    assert swapped.mean_0_spike_rate_hz is None and swapped.mean_1_spike_rate_hz == 5.0


def test_bins_differ_at_the_edges(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (0, 1, 2)], "x double, y double")
    right = {r.bin: r.n for r in D.binned_mean_sem(df, [], "x", "y", 2).collect()}
    left = {r.bin: r.n for r in D.binned_mean_sem(df, [], "x", "y", 2, "left").collect()}
    assert right == {0: 2, 1: 1} and left == {0: 1, 1: 1}


def test_constant_groups_give_null_not_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)] + [("b", float(i), float(i)) for i in range(5)], "u string, x double, y double")
    rows = {r.u: r for r in X.unit_correlations(df, ["u"], "x", "y").collect()}
    assert rows["a"].pearson_r is None and rows["a"].spearman_p is None and not rows["a"].pearson_sig_fdr
    assert rows["b"].pearson_r == pytest.approx(1.0) and rows["b"].pearson_t is None


@pytest.mark.parametrize("width", [None, 0.3])
def test_fdr_with_ties_and_nulls(spark, width):
    p = [0.01, 0.02, 0.02, 0.5, None, 0.04]
    got = [r.q for r in X.fdr_bh(spark.createDataFrame(list(enumerate(p)), "i int, p double"), [], "p", "q", width).orderBy("i").collect()]
    assert got[4] is None
    assert [got[i] for i in (0, 1, 2, 3, 5)] == pytest.approx([0.02 * 5 / 3] * 3 + [0.5, 0.05])


def test_ranked_tests_against_hand_values(spark):
    df = spark.createDataFrame([(float(v), v > 3) for v in range(1, 7)], "v double, g boolean")
    assert X.mann_whitney(df, [], "v", F.col("g")).first().u == 9.0
    signed = X.wilcoxon(spark.createDataFrame([(float(v),) for v in (-1, 2, 3, 4, 0)], "d double"), [], "d").first()
    assert (signed.n, signed.w) == (4, 1.0)


def test_registry_guards(spark):
    table = spark.createDataFrame([("behavior_1_2024-01-01_10-00-00", "12.0", 0.5, 0.01, 30), ("behavior_1_2024-01-01_11-00-00", "12", 0.4, 0.2, 30)], "session string, unit_id string, r double, p double, n int")
    reg = UnitStatsRegistry()
    reg.register_cor("a", table, coef="r", p="p", n_trials="n")
    assert "a" in reg and len(reg) == 1 and reg.list_by_source("cor") == ["a"]
    rows = reg.get("a").collect()
    assert len(rows) == 1 and rows[0].unit == "12" and rows[0].session_prefix == "behavior_1_2024-01-01" and rows[0].sig_fdr
    with pytest.raises(ValueError):
        reg.register_cor("a", table, coef="r", p="p", n_trials="n")
    with pytest.raises(KeyError):
        reg.get("missing")


def test_checks_raise_and_report(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(ValueError):
        C.checked_join(a, b, ["k"], "left", "one_to_one")
    assert C.checked_join(a, b, ["k"], "left", "many_to_one").count() == 2
    with pytest.raises(ValueError):
        C.require_columns(a, ["k", "missing"])


def test_augmenting_twice_is_once(spark):
    base = spark.createDataFrame([(1, 9.0), (2, 9.0)], "id int, out_old double")
    metrics = spark.createDataFrame([(1, 0.5)], "id int, out_duration double")
    once = sinks.augmented(base, metrics, ["id"])
    twice = sinks.augmented(once, metrics, ["id"])
    assert once.columns == twice.columns == ["id", "out_duration"]
    assert sorted(map(tuple, twice.collect())) == [(1, 0.5), (2, None)]


def test_parsing(spark):
    df = spark.createDataFrame([("behavior_1_2024-01-02_03-04-05",), ("12_2024-01-02_7.json",), ("nonsense",)], "s string")
    got = [tuple(r.p) for r in df.select(K.parse_session_id(F.col("s")).alias("p")).collect()]
    assert got == [("1", "2024-01-02", 30405), ("12", "2024-01-02", 7), (None, None, None)]
    units = spark.createDataFrame([(u,) for u in ("12.0", "12.7", "KS3", "nan", "inf")], "u string")
    assert [r.u for r in units.select(K.canon_unit(F.col("u")).alias("u")).collect()] == ["12", "12", "KS3", "nan", "inf"]


def test_track_headers_fall_away(spark, tmp_path):
    folder = tmp_path / "behavior_1_2024-01-02_03-04-05"
    folder.mkdir()
    (folder / "tracks.csv").write_text("scorer,m,m,m\nbodyparts,jaw,jaw,jaw\ncoords,x,y,likelihood\n0,1.5,2.5,0.9\n1,nan,,0.1\n")
    rows = readers.scan_keypoints(spark, str(folder)).orderBy("frame").collect()
    assert [tuple(r) for r in rows] == [
        ("behavior_1_2024-01-02_03-04-05", 0, "jaw", 1.5, 2.5, 0.9), ("behavior_1_2024-01-02_03-04-05", 1, "jaw", None, None, 0.1)
    ]


def test_pareto_on_two_and_three_objectives(spark):
    points = [(i, (i * 7) % 11, (i * 5) % 13, i % 4) for i in range(60)]
    df = spark.createDataFrame(points, "id int, a int, b int, c int")

    def front(cols):
        def beats(p, q):
            return all(p[c] >= q[c] for c in cols) and any(p[c] > q[c] for c in cols)
        return sorted(q[0] for q in points if not any(beats(p, q) for p in points))

    for width in (None, 2.0):
        assert sorted(r.id for r in D.pareto_front(df, [("a", True), ("b", True)], "id", width).collect()) == front([1, 2])
    assert sorted(r.id for r in D.pareto_front(df, [("a", True), ("b", True), ("c", True)], "id").collect()) == front([1, 2, 3])


def test_permutations_keep_every_value_once(spark):
    df = spark.range(30).select("id", (F.col("id") * 2).alias("v"))
    for chunks in (None, 4):
        got = R.permuted(df, ["id"], ["v"], ["id"], 5, seed=1, chunks=chunks).toPandas()
        for _, rep in got.groupby("rep"):
            assert sorted(rep["v"]) == list(range(0, 60, 2)) and sorted(rep["id"]) == list(range(30))


def test_a_session_with_most_rows_is_cut(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("s"), F.col("id").cast("double").alias("t"))
    cold = spark.range(60).select(F.concat(F.lit("c"), F.col("id") % 3).alias("s"), F.col("id").cast("double").alias("t"))
    rows = hot.unionByName(cold)
    cues = rows.where(F.col("t") % 10 == 0).withColumn("trial", (F.col("t") / 10).cast("int"))
    width = chunk_width(rows, ["s"], "t", 200)
    assert width is not None and width <= 400
    plain = J.asof_backward(rows, cues, ["s"], "t", "t", {"trial": "trial"})
    cut = J.asof_backward(rows, cues, ["s"], "t", "t", {"trial": "trial"}, width)
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()


def test_exact_tails_are_those_of_all_orders():
    import itertools
    import math

    from tempora.functions import pvalues as P

    for n1, n2 in ((1, 1), (3, 4), (4, 3), (2, 6), (5, 5)):
        places = list(itertools.combinations(range(n1 + n2), n1))
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in places]
        for u in range(n1 * n2 + 1):
            assert P.rank_sum_tail(u, n1, n2) == pytest.approx(sum(x <= u for x in us) / len(us))

        def reach(chosen):
            i, most = 0, 0
            for t in range(n1 + n2):
                i += t in chosen
                most = max(most, abs(i * n2 - (t + 1 - i) * n1))
            return most

        reaches = [reach(set(c)) for c in places]
        for h in range(1, n1 * n2 + 1):
            assert P.path_exit(h, n1, n2) == pytest.approx(sum(x >= h for x in reaches) / len(reaches))
    for n in range(1, 9):
        ws = [sum(s) for k in range(n + 1) for s in itertools.combinations(range(1, n + 1), k)]
        for w in range(n * (n + 1) // 2 + 1):
            assert P.signed_rank_tail(w, n) == pytest.approx(sum(x <= w for x in ws) / len(ws))
    assert P.rank_sum_tail(30 * 4, 8, 30) == pytest.approx(0.5, abs=0.02) and 0 < P.rank_sum_tail(0, 8, 400) < 1e-15
    assert P.path_exit(300 * 300, 300, 300) == pytest.approx(2 / math.comb(600, 300), rel=1e-6)


def test_exact_and_normal_p_by_group(spark):
    from tempora.operators import stats as X

    groups = {"few": [(v, v > 3) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "tied": [(1.0, True), (1.0, False), (2.0, True), (3.0, False)], "many": [(float(v), v % 2 == 0) for v in range(40)]}
    df = spark.createDataFrame([(k, *r) for k, rows in groups.items() for r in rows] + [("few", None, True)], "k string, v double, g boolean")
    got = {r.k: r for r in X.mann_whitney(df, ["k"], "v", F.col("g")).collect()}
    assert got["few"].p == pytest.approx(2 / 20) and got["few"].u == 9  # complete separation of three and three
    assert 0.3 < got["tied"].p <= 1 and 0.5 < got["many"].p <= 1
    ks = {r.k: r for r in X.ks_two_sample(df, ["k"], "v", F.col("g")).collect()}
    assert ks["few"].ks == 1 and ks["few"].p == pytest.approx(2 / 20)
    signs = {r.k: r for r in X.wilcoxon(df.withColumn("d", F.when(F.col("k") == "tied", F.col("v") - 2).otherwise(F.col("v") + 1)), ["k"], "d").collect()}
    assert signs["few"].p == pytest.approx(2 / 2**6) and signs["many"].p == pytest.approx(2 / 2**40)
    assert signs["tied"].n == 3 and signs["tied"].p > 0.1  # a zero difference and ties: the normal p


def test_every_track_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "behavior_2_2024-01-02_03-04-05"
    folder.mkdir()
    (folder / "a.csv").write_text("scorer,m,m,m,m,m,m\nbodyparts,jaw,jaw,jaw,tip,tip,tip\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n")
    (folder / "b.csv").write_text("scorer,m,m,m,m,m\nbodyparts,tip,tip,jaw,jaw,jaw\ncoords,likelihood,x,y,x,likelihood\n1,0.7,30,20,10,0.6\n2,0.5\n")
    (folder / "c.csv").write_text("7,5,6,0.1\n")
    got = {(r.frame, r.keypoint): (r.x, r.y, r.confidence) for r in readers.scan_keypoints(spark, str(folder)).collect()}
    assert got == {
        (0, "jaw"): (1, 2, 0.9), (0, "tip"): (3, 4, 0.8), (1, "tip"): (30, None, 0.7), (1, "jaw"): (10, 20, 0.6), (2, "tip"): (None, None, 0.5), (2, "jaw"): (None, None, None),
    }
    head = tmp_path / "head.csv"
    head.write_text("scorer,m,m,m\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n")
    more = readers.scan_keypoints(spark, str(folder), header=str(head)).where("frame = 7").collect()
    assert [tuple(r)[2:] for r in more] == [("nose", 5, 6, 0.1)]


def test_a_failing_session_is_one_row(spark, tmp_path):
    def work(name):
        if name == "no table":
            return spark.read.parquet(str(tmp_path / "nowhere"))
        df = spark.range(5).withColumn("v", F.lit(1))
        return df.withColumn("v", F.raise_error(F.lit("broken cell"))) if name == "breaks" else df

    status = {r.session: r for r in sinks.run_sessions(spark, ["one", "no table", "two", "breaks"], work, str(tmp_path / "out"), parallel=2).collect()}
    assert {k: (r.ok, r.rows) for k, r in status.items()} == {"one": (True, 5), "two": (True, 5), "no table": (False, None), "breaks": (False, None)}
    assert status["one"].error is None and "AnalysisException" in status["no table"].error and status["breaks"].error
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.groupBy("session").count().count() == 2 and written.count() == 10
    assert sinks.run_sessions(spark, [], work, str(tmp_path / "none")).count() == 0


def test_importance_is_of_the_columns_that_matter(spark):
    import random

    rng = random.Random(8)
    rows = [(i, *(rng.gauss(0, 1) for _ in range(3))) for i in range(900)]
    df = spark.createDataFrame([(i, a, b, c, int(2 * a - b + rng.gauss(0, 0.7) > 0)) for i, a, b, c in rows], "i int, a double, b double, c double, y int")
    got = {r.feature: r for r in R.logistic_direction(df, ["a", "b", "c"], "y", "i", seed=2).collect()}
    chunked = {r.feature: r for r in R.logistic_direction(df, ["a", "b", "c"], "y", "i", seed=2, chunks=3).collect()}
    assert got["a"].importance > got["b"].importance > 0.02 > abs(got["c"].importance)
    assert got["a"].coefficient > 0 > got["b"].coefficient and {r.repeats for r in got.values()} == {30}
    for f, r in got.items():
        assert 0 < r.importance_sd < 0.1 and r.auc > 0.9 and chunked[f].importance == pytest.approx(r.importance)


def test_density_is_that_of_every_row(spark):
    values = {"a": [0.0, 1.0, 4.0, 4.5], None: [2.0, 3.0], "flat": [1.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    got = {(r.k, r.point): r for r in X.density_curve(df, ["k"], "v", -1.0, 0.5, 12).collect()}
    assert len(got) == 24
    for k in ("a", None):
        vs = values[k]
        mean = sum(vs) / len(vs)
        h = (sum((v - mean) ** 2 for v in vs) / (len(vs) - 1)) ** 0.5 * len(vs) ** -0.2
        for p in range(12):
            x = -1 + p * 0.5
            want = sum(math.exp(-(((v - x) / h) ** 2) / 2) for v in vs) / (len(vs) * h * math.sqrt(2 * math.pi))
            assert got[k, p].x == x and got[k, p].density == pytest.approx(want)


def test_classifier_scores_rows_out_of_fold_and_keeps_gaps(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.gauss(i % 2, 0.3), rng.random()) for i in range(200)] + [(900, None, 0.5), (901, 0.5, None)]
    df = spark.createDataFrame([(i, a, b, i % 2 == 1, float(i % 10)) for i, a, b in rows], "i int, a double, b double, good boolean, seen double")
    scored, auc = R.classify_sessions(df, ["a", "b"], "good", "i", trees=10, folds=3, seed=1)
    got = {r.i: r for r in scored.collect()}
    assert len(got) == 202 and auc > 0.9 and {r.fold for r in got.values()} == {0, 1, 2}
    assert got[900].pred_p_good is None and got[901].pred_out_of_fold is None
    assert all(0 <= r.pred_p_good <= 1 and 0 <= r.pred_out_of_fold <= 1 for k, r in got.items() if k < 900)
    listed = R.under_performers(scored.join(df.select("i", "seen"), "i"), "seen", 4.0, 5, tie=["i"]).collect()
    below = sorted((r for r in got.values() if r.i < 900 and r.i % 10 < 4), key=lambda r: (-r.pred_p_good, r.i))
    assert [r.i for r in listed] == [r.i for r in below[:5]]
    one_class, none = R.classify_sessions(df.where("good"), ["a", "b"], "good", "i", trees=2, folds=2)
    assert math.isnan(none) and {r.pred_p_good for r in one_class.collect()} == {None}


@pytest.mark.parametrize("width", [None, 7.0])
def test_swept_movements_are_those_of_the_frames(spark, width):
    """A setting repeats starts of movements only, and the movements are those of frames segmented once per setting."""
    import numpy as np

    from tempora.operators import segment

    rng = np.random.default_rng(5)
    rows = [(s, f, f / 10 + float(rng.random()) / 20, bool(rng.random() < 0.5), bool(rng.random() < 0.4)) for s in ("a", "b", None) for f in range(60)]
    rows += [("none", f, f / 10, False, True) for f in range(5)] + [("gap", 0, 0.0, None, True), ("gap", 1, 0.1, True, None), ("gap", 9, 0.9, True, True)]
    df = spark.createDataFrame(rows, "s string, f long, t double, v boolean, c boolean").repartition(4)
    frames = segment.segmentation_sweep(df, ["s"], "f", "t", F.col("v"), range(1, 6), width)
    want = frames.groupBy("max_dropped", "s", "movement_id").agg(F.min("f"), F.max("t") - F.min("t"), F.count_if("c")).drop("movement_id")
    got = segment.swept_movements(df, ["s"], "f", "t", F.col("v"), range(1, 6), F.col("c"), width)
    a, b = (sorted(((m, str(s), f, round(d, 9), n) for m, s, f, d, n in x.collect())) for x in (want, got))
    assert a == b and len(a) > 20


def test_session_tables_are_few_files_in_either_layout(spark, tmp_path):
    """As many files as the bytes ask for, not as there are sessions; a folder a session is still read."""
    df = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 500).alias("session"), "id")
    sinks.write_session_tables(df, f"{tmp_path}/new")
    df.where("id < 40").write.partitionBy("session").parquet(f"{tmp_path}/old")
    assert len(list((tmp_path / "new").rglob("*.parquet"))) <= 16
    for name, want in (("new", 3000), ("old", 40)):
        got = readers.scan_session_parquet(spark, f"{tmp_path}/{name}", "part").select("session", "id").collect()
        assert sorted(map(tuple, got)) == sorted((f"s{i % 500}", i) for i in range(want))


def test_a_streamed_session_costs_few_state_calls():
    import pandas as pd

    from tempora.streaming.events import LastCue

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendValue", "put", "update", "clear"):
                    self.held = self.held + [args[0]] if name == "appendValue" else list(args[0]) if name == "put" else [args] if name == "update" else []
                return bool(self.held) if name == "exists" else iter(self.held) if name == "get" and self is handle.open else self.held[0][0] if name == "get" else None
            return call

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def getListState(self, name, schema):
            self.open = State()
            return self.open

        getMapState = getListState

        def registerTimer(self, at):
            calls.append("timer")
            timers.append(at)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    handle, timers, tags = Handle(), [], LastCue()
    tags.init(handle)
    rows = pd.DataFrame({"event_id": range(2000), "micros": [1_000_000 * (2000 - i) for i in range(2000)], "is_cue": [i % 10 == 0 for i in range(2000)]})
    list(tags.handleInputRows((7,), iter([rows]), Now(0)))
    assert timers == [1999] and len(calls) == 2
    first = pd.concat(tags.handleExpiredTimer((7,), Now(1_000_000), Now(1999)))
    assert len(first) == 999 and first["trial"].tolist() == [(i + 1) // 10 - 1 for i in range(999)] and timers[1:] == [1_000_999]
    rest = pd.concat(tags.handleExpiredTimer((7,), Now(10_000_000), Now(1_000_999)))
    assert len(rest) == 1001 and rest["trial"].iloc[-1] == 199 and rest["event_id"].iloc[-1] == 0 and len(calls) < 20


def test_streamed_rows_are_out_at_the_end_of_their_second(spark, tmp_path):
    from tempora.plans import streams

    moments = [(1, 1, "signup", 10.5), (1, 2, "view", 10.25), (2, 3, "view", 9.0), (2, 4, "signup", 11.0), (3, 5, "view", 3611.0), (1, 6, "view", 10.75)]
    rows = [(e, s, k, t) for s, e, k, t in moments]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
    folder = tmp_path / "parts"
    events.coalesce(1).drop("t").write.parquet(str(folder))
    next(folder.glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    from tempora.plans.bindings import Tables

    got = sorted(map(tuple, streams.stream_asof_trial(Tables(spark, str(tmp_path))).collect()))
    assert got == [(1, 1, 0), (1, 2, -1), (1, 6, 0), (2, 3, -1)]


def test_packed_tracks_read_like_files(spark, tmp_path):
    from tempora.plans import files
    from tempora.plans.bindings import Tables

    names = [f"behavior_{i}_2024-01-02_03-04-05" for i in range(3)]
    texts = ["scorer,m,m,m\nbodyparts,jaw,jaw,jaw\ncoords,x,y,likelihood\n0,1,2,0.9\n", "scorer,m,m,m\nbodyparts,tip,tip,tip\ncoords,y,x,likelihood\n0,3,4,0.8\n1,nan\n", "5,6,7,0.1\n"]
    for name, text in zip(names, texts):
        (tmp_path / "tree" / name).mkdir(parents=True)
        (tmp_path / "tree" / name / "tracks.csv").write_text(text)
    lines = [(f"{name}/tracks.csv", line) for name, text in zip(names, texts) for line in text.splitlines()]
    sinks.write_packed(spark.createDataFrame(lines, "path string, value string"), str(tmp_path / "packed"))
    packed = readers.scan_keypoints(spark, spark.read.parquet(str(tmp_path / "packed")), header=str(tmp_path / "tree" / names[0]))
    plain = readers.scan_keypoints(spark, str(tmp_path / "tree" / "*"), header=str(tmp_path / "tree" / names[0]))
    assert sorted(map(str, packed.collect())) == sorted(map(str, plain.collect())) and packed.count() == 4
    root = files.track_files(Tables(spark, "/root/testdata/sf0.001"))
    assert spark.read.parquet(root).select("path").distinct().count() > 10  # sessions
    assert spark.read.parquet(root).select(F.input_file_name()).distinct().count() < 5


def test_packed_key_values_read_like_files(spark, tmp_path, monkeypatch):
    from tempora.plans import files
    from tempora.plans.bindings import Tables

    texts = {"behavior_1_2024-01-02_03-04-05/side_stats.txt": "Frames: 7\nMean: 1.5\nnote", "behavior_2_2024-01-02_03-04-05/bottom_stats.txt": "Frames: x\nMean : 2: 3\nFrames: 4"}
    for name, text in texts.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True)
        (tmp_path / "tree" / name).write_text(text)
    lines = [(name, line) for name, text in texts.items() for line in text.splitlines()]
    sinks.write_packed(spark.createDataFrame(lines, "path string, value string"), str(tmp_path / "packed"))
    fields = {"Frames": "n", "Mean": "m"}
    got = [
        sorted(map(tuple, readers.scan_kv_text(spark, source, fields).select("session", "camera", "n", "m").collect()))
        for source in (str(tmp_path / "tree" / "*"), spark.read.parquet(str(tmp_path / "packed")))
    ]
    assert got[0] == got[1] == [("behavior_1_2024-01-02_03-04-05", "side", 7, 1.5), ("behavior_2_2024-01-02_03-04-05", "bottom", 4, None)]
    root = str(tmp_path / "stats")
    monkeypatch.setattr(files, "scratch_path", lambda spark, name: root)
    assert files.scan_kv_text(Tables(spark, "/root/testdata/sf0.001")).count() > 10  # sessions
    assert spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).count() < 10


def test_sessions_are_found_in_folders_and_packed_files(spark, tmp_path, monkeypatch):
    from tempora.plans import files
    from tempora.plans.bindings import Tables

    names = [f"behavior_{i}_2024-01-02_03-04-05/{kind}/a.txt" for i, kind in ((1, "intermediate_data"), (2, "raw"), (3, "intermediate_data"))]
    names += ["behavior_1_2024-01-02_03-04-05/raw/b.txt", "nobody/intermediate_data/c.txt"]
    for name in names:
        (tmp_path / "tree" / name).parent.mkdir(parents=True)
        (tmp_path / "tree" / name).write_text("x")
    sinks.write_packed(spark.createDataFrame([(name, "x") for name in names], "path string, value string"), str(tmp_path / "packed"))
    for root in (str(tmp_path / "tree"), spark.read.parquet(str(tmp_path / "packed"))):
        got = sorted(r.session for r in readers.discover_sessions(spark, root).collect())
        assert got == ["behavior_1_2024-01-02_03-04-05", "behavior_3_2024-01-02_03-04-05"]
    root = str(tmp_path / "found")
    monkeypatch.setattr(files, "scratch_path", lambda spark, name: root)
    assert files.discover_sessions(Tables(spark, "/root/testdata/sf0.001")).count() > 5  # sessions
    assert spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).count() < 5


def test_detector_grid_against_brute_force(spark, monkeypatch):
    radii, dead_times, tolerances = [3.0, 10.0], [0.0, 2.0, 7.5], [0.0, 1.0, 2.5]
    near = [(s, float((i * 7 + j) % 40) / 2, float((i * 5) % 13)) for j, (s, n) in enumerate((("a", 60), ("b", 9), ("c", 4), (None, 6))) for i in range(n)]
    truth = [(s, float((i * 11 + j) % 50) / 2) for j, (s, n) in enumerate((("a", 40), ("b", 7), ("d", 3), (None, 5))) for i in range(n)]
    odd = [("b", 1.0, None), ("b", None, 1.0)]
    candidates = spark.createDataFrame(near + odd, "s string, t double, d double")
    reference = spark.createDataFrame(truth + [("b", None)], "s string, t double")
    want = {}
    for r in radii:
        for dead in dead_times:
            kept = []
            for s in ("a", "b", "c", None):
                last = None
                for x in sorted(x for who, x, d in near if who == s and d <= r):
                    if last is None or x > last + dead:
                        kept.append((s, last := x))
            for tol in tolerances:
                tp = sum(any(s == k and abs(x - at) <= tol for k, at in kept) for s, x in truth)
                want[r, dead, tol] = (tp, sum(not any(s == k and abs(x - at) <= tol for s, x in truth) for k, at in kept), len(truth) + 1 - tp)

    def run(width):
        return D.detector_grid(candidates, reference, ["s"], "t", "d", radii, dead_times, tolerances, width)

    def got(df):
        return {(r.radius, r.dead_time, r.tolerance): (r.tp, r.fp, r.fn) for r in df.collect()}

    whole = run(None)
    assert got(whole) == want
    assert "Window" not in whole._jdf.queryExecution().toString()  # rows are not sorted once per cell
    monkeypatch.setattr(D, "GRID_ROWS", 10)
    assert got(run(None)) == want
    monkeypatch.setattr(D, "ROWS_PER_CHUNK", 30)
    assert got(run(3.0)) == want
    assert run(None).where("tp > 0").count() > 0 and D.detector_grid(candidates, reference.where("false"), ["s"], "t", "d", radii, dead_times, tolerances).isEmpty()


def test_groups_to_rank_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    from tempora.plans import bindings, statistics

    def rows(plan):
        return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in plan.collect())

    plans = [statistics.partial_correlation, statistics.mann_whitney, statistics.wilcoxon_signed]
    whole = [rows(p(bindings.Tables(spark, "/root/testdata/sf0.001"))) for p in plans]
    monkeypatch.setattr(bindings, "_widths", {})
    monkeypatch.setattr(bindings, "ROWS_PER_CHUNK", 2000)
    tables = bindings.Tables(spark, "/root/testdata/sf0.001")
    n = -(-tables.lineitem.count() // 2000) * 4
    for plan, want in zip(plans, whole):
        out = plan(tables)
        assert f", {n}), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()  # not gathered again into few tasks
        assert rows(out) == want
