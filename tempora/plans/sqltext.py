"""SQL text of the tail probabilities, written from other formulas than the Column forms.

The Student tail is the finite trigonometric series, the binomial a sum of terms.
"""

from __future__ import annotations

from tempora.functions.pvalues import NORMAL_DENOMINATOR, NORMAL_NUMERATOR


def _horner(coefficients, x):
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_p2(z: str) -> str:
    """Two-sided normal p for |z| below 7."""
    a = f"abs({z})"
    return f"(2 * exp(-{a} * {a} / 2) * {_horner(NORMAL_NUMERATOR, a)} / {_horner(NORMAL_DENOMINATOR, a)})"


def student_p2(t: str, df: str) -> str:
    """Two-sided t p for integer df by the cosine series."""
    theta = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    c2 = f"pow(cos({theta}), 2)"
    # terms of the series through a running product: ratios (2k-1)/(2k) for even and 2k/(2k+1) for odd df
    def series(ratio, count):
        return (
            f"(1 + coalesce(list_sum(list_transform(range(1, ({count})::BIGINT), lambda j: "
            f"exp(coalesce(list_sum(list_transform(range(1, j + 1), lambda i: ln({ratio}))), 0) + j * ln(greatest({c2}, 1e-300))))), 0))"
        )

    even = f"sin({theta}) * {series('(2 * i - 1) / (2.0::DOUBLE * i)', f'({df}) // 2')}"
    odd = (
        f"2 / pi() * ({theta} + CASE WHEN ({df}) > 1 THEN sin({theta}) * cos({theta}) * "
        f"{series('(2.0::DOUBLE * i) / (2 * i + 1)', f'(({df}) - 1) // 2')} ELSE 0 END)"
    )
    return f"(CASE WHEN ({t}) IS NULL OR ({df}) < 1 THEN NULL WHEN ({df}) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"


def log_factorial(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, ({n})::BIGINT + 1), lambda q: ln(q))), 0)"


def binomial_half_p2(pos: str, neg: str) -> str:
    n = f"({pos} + {neg})"
    lf = log_factorial
    terms = (
        f"list_sum(list_transform(range(0, least({pos}, {neg}) + 1), lambda k: "
        f"exp({lf(n)} - {lf('k')} - {lf(f'{n} - k')} - {n} * ln(2))))"
    )
    return f"(CASE WHEN {n} = 0 THEN NULL ELSE least(1, 2 * {terms}) END)"


def average_rank(value: str, on: str) -> str:
    """Average rank as a window expression; `on` is the PARTITION BY list (may be empty)."""
    part = f"PARTITION BY {on}" if on else ""
    ties = f"PARTITION BY {on}, {value}" if on else f"PARTITION BY {value}"
    return f"(rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE)"


def corr_p(r: str, n: str, lost: int = 2) -> str:
    t = f"({r}) * sqrt((({n}) - {lost}) / greatest(1 - ({r}) * ({r}), 1e-300))"
    return f"(CASE WHEN ({n}) > {lost} THEN {student_p2(t, f'({n}) - {lost}')} END)"


def fdr(source: str, p: str, q: str, keys: str = "") -> str:
    """Body of a table with q-values beside those of `source`."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
SELECT * EXCLUDE (i__, m__), CASE WHEN {p} IS NOT NULL THEN least(1, min({p} * m__ / i__) OVER ({part} ORDER BY {p} DESC NULLS LAST
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {q}
FROM (SELECT *, count({p}) OVER ({part} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i__, count({p}) OVER ({part}) AS m__ FROM {source}) s__"""


def rank_sum_tails(name: str, sizes: str) -> str:
    """Tables of a recursive WITH: P(U <= u) for k and m members of which one side has at most 8; `sizes` has n1 and n0.

    Orders are built member by member: one of the first sample adds the members of the second before it.
    """
    return f"""
{name}w AS (SELECT 0 AS k, 0 AS m, 0 AS u, 1.0::DOUBLE AS c UNION ALL SELECT k + x, m + 1 - x, u + x * m, sum(c) FROM {name}w, (VALUES (0), (1)) v(x)
  WHERE k + m < (SELECT max(n1 + n0) FROM {sizes}) AND least(k + x, m + 1 - x) <= 8 GROUP BY 1, 2, 3),
{name} AS (SELECT k, m, u, sum(c) OVER (PARTITION BY k, m ORDER BY u) / sum(c) OVER (PARTITION BY k, m) AS tail FROM {name}w)"""


def signed_rank_tails(name: str, most: int = 50) -> str:
    """Tables of a recursive WITH: P(W <= w) of n differences, from the subsets of 1..n by their sum."""
    return f"""
{name}w AS (SELECT 0 AS n, 0 AS w, 1.0::DOUBLE AS c UNION ALL SELECT n + 1, w + x * (n + 1), sum(c) FROM {name}w, (VALUES (0), (1)) v(x) WHERE n < {most} GROUP BY 1, 2),
{name} AS (SELECT n, w, sum(c) OVER (PARTITION BY n ORDER BY w) / pow(2, n) AS tail FROM {name}w)"""


def path_exits(name: str, cases: str) -> str:
    """Tables of a recursive WITH: the chance that a random order of n and m members leaves |i m - j n| < reach.

    `cases` has n, m and reach. A list holds the chances by the number of first members; what leaves it is summed.
    """
    moved = "list_transform(range(0, n + 1), lambda i: (p[i + 1] * greatest(m - t + i, 0) + coalesce(p[i], 0) * (n - i + 1)) / (n + m - t))"
    return f"""
{name}w AS (SELECT n, m, reach, 0::BIGINT AS t, list_concat([1.0::DOUBLE], list_transform(range(0, n), lambda i: 0.0::DOUBLE)) AS p, 0.0::DOUBLE AS gone FROM (SELECT DISTINCT n::BIGINT AS n, m::BIGINT AS m, reach::BIGINT AS reach FROM {cases}) c
  UNION ALL SELECT n, m, reach, t + 1, list_transform(q, lambda v, i: CASE WHEN abs((i - 1) * m - (t + 2 - i) * n) >= reach THEN 0.0::DOUBLE ELSE v END),
    gone + list_sum(list_transform(q, lambda v, i: CASE WHEN abs((i - 1) * m - (t + 2 - i) * n) >= reach THEN v ELSE 0.0::DOUBLE END))
  FROM (SELECT *, {moved} AS q FROM {name}w WHERE t < n + m)),
{name} AS (SELECT n, m, reach, least(1, gone) AS p FROM {name}w WHERE t = n + m)"""
