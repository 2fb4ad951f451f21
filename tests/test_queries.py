"""Every query with SQL must give the rows of its SQL; the others must hold their invariants."""

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    line, ok = compare(spark, con, name, FOLDER, QUERIES, ORACLES)
    assert line.startswith("OK"), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_seeded_queries_repeat(spark):
    for name in ("sample_rows", "pick_examples_random", "group_shift_p", "spatial_trend_perm", "bootstrap_std_ci"):
        a, b = (sorted(map(str, QUERIES[name](spark, FOLDER).collect())) for _ in range(2))
        assert len(a) > 0
        if name != "bootstrap_std_ci":
            assert [r[:40] for r in a] == [r[:40] for r in b]


def test_permutation_p_ranges(spark):
    row = QUERIES["spatial_trend_perm"](spark, FOLDER).first()
    assert 1 / 2001 <= row.p_perm <= 1 and 0 <= row.r2 <= 1 and 0 < row.null_mean < 1
    row = QUERIES["mardia_watson_wheeler"](spark, FOLDER).first()
    assert 1 / 5001 <= row.p_perm <= 1 and row.w >= 0


def test_bootstrap_interval_holds_the_estimate(spark):
    for row in QUERIES["bootstrap_std_ci"](spark, FOLDER).collect():
        if row.n >= 20:
            assert row.std_ci_low < row.std < row.std_ci_high


def test_axes_are_unit_and_aligned(spark):
    for name in ("axis_linear_boot", "axis_cca", "axis_lda"):
        rows = {r.rep: (r.a0, r.a1, r.a2) for r in QUERIES[name](spark, FOLDER).collect()}
        assert 0 in rows and len(rows) > 10
        for v in rows.values():
            assert sum(x * x for x in v) == pytest.approx(1.0)
            assert sum(x * y for x, y in zip(v, rows[0])) >= -1e-12


def test_classifiers(spark):
    scored = QUERIES["classify_sessions"](spark, FOLDER).collect()
    assert all(0 <= r.pred_p_good <= 1 and 0 <= r.cv_auc <= 1 for r in scored)
    weights = QUERIES["logistic_direction"](spark, FOLDER).collect()
    assert len(weights) == 7 and all(0 <= r.auc <= 1 for r in weights)
