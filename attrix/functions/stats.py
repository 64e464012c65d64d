"""Statistical tail functions as Spark Column expressions (no Python UDF).

Spark has no gamma/erf functions, so p-values are series evaluated with
``aggregate(sequence(...))`` inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def lgamma_half(a: Column) -> Column:
    """ln Gamma(a + 1) for a = k/2 (k >= 0 integer): product of (a - j) down
    to 1 (integer a) or 1/2 (half-integer a, times sqrt(pi))."""
    n = F.ceil(a).cast("int")
    s = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda acc, j: acc + F.log(a - j))
    s = F.when(n >= 1, s).otherwise(F.lit(0.0))
    return s + F.when(F.ceil(a) != F.floor(a), F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))


def chi2_sf(x, dof) -> Column:
    """Survival function of the chi-square distribution, 1 - P(dof/2, x/2).

    Lower regularised gamma by its power series summed in log space
    (term_n = exp((a+n) ln y - y - ln Gamma(a+n+1))), with enough terms to
    pass the Poisson-like peak at n ~ y - a.  Far in the tail
    (y > a + 40 sqrt(a) + 40) the result is below 1e-30 and returned as 0.
    Infinite x (e.g. an expected count of zero) gives 0.
    """
    x, dof = _c(x).cast("double"), _c(dof).cast("double")
    a, y = dof / 2.0, x / 2.0
    l0 = a * F.log(y) - y - lgamma_half(a)
    n_terms = F.ceil(F.greatest(y - a, F.lit(0.0)) + 12.0 * F.sqrt(y) + 40.0).cast("int")
    series = F.aggregate(
        F.sequence(F.lit(1), n_terms),
        F.struct(l0.alias("l"), F.exp(l0).alias("s")),
        lambda acc, n: F.struct(
            (acc["l"] + F.log(y) - F.log(a + n)).alias("l"),
            (acc["s"] + F.exp(acc["l"] + F.log(y) - F.log(a + n))).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return (
        F.when(x.isNull() | dof.isNull() | (dof < 1), F.lit(None).cast("double"))
        .when(x == F.lit(float("inf")), F.lit(0.0))
        .when(x <= 0, F.lit(1.0))
        .when(y > a + 40.0 * F.sqrt(a) + 40.0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - series)))
    )


def kolmogorov_sf(lam) -> Column:
    """Asymptotic Kolmogorov tail 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lam^2); 1 below lam = 0.2."""
    lam = _c(lam).cast("double")
    s = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam.isNull(), F.lit(None).cast("double")).when(lam < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * s))
    )


#: Up to n1 * n2 = KS_EXACT the two-sample p-value is exact.
KS_EXACT = 10_000


def ks_exact_pvalue(d, n1, n2) -> Column:
    """Two-sided P(D >= d) of the two-sample statistic without ties, by counting
    lattice paths: u[j] is the share of paths to (i, j) that stay within the
    distance, one step of i at a time."""
    n1, n2 = _c(n1).cast("long"), _c(n2).cast("long")
    big, small = F.greatest(n1, n2), F.least(n1, n2)
    # |i / big - j / small| >= d in whole numbers, safe from the rounding of d
    most = F.floor(_c(d).cast("double") * big * small - 1e-7)

    def inside(i, j):
        return F.when(F.abs(i * small - j * big) <= most, 1.0).otherwise(0.0)

    first = F.transform(F.sequence(F.lit(0).cast("long"), small), lambda j: inside(F.lit(0).cast("long"), j))
    def row(u, i):
        w = i.cast("double") / (i + small)
        start = F.array(F.get(u, F.lit(0)) * w * inside(i, F.lit(0).cast("long")))
        return F.aggregate(
            F.sequence(F.lit(1).cast("long"), small),
            start,
            lambda v, j: F.concat(v, F.array((F.get(u, j.cast("int")) * w + F.element_at(v, -1)) * inside(i, j))),
        )

    u = F.aggregate(F.sequence(F.lit(1).cast("long"), big), first, row)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.element_at(u, -1)))


def ks_pvalue(d, n1, n2) -> Column:
    """Two-sample KS p-value from statistic d and sample sizes: exact up to
    n1 * n2 = KS_EXACT, asymptotic beyond."""
    m1, m2 = _c(n1).cast("double"), _c(n2).cast("double")
    few = (m1 * m2 <= KS_EXACT) & (m1 > 0) & (m2 > 0)
    asymptotic = kolmogorov_sf(_c(d) * F.sqrt(m1 * m2 / (m1 + m2)))
    # sizes beyond the limit never reach the recurrence
    exact = ks_exact_pvalue(_c(d), F.when(few, m1).otherwise(1.0), F.when(few, m2).otherwise(1.0))
    return F.when(_c(d).isNull() | m1.isNull() | m2.isNull(), F.lit(None).cast("double")).when(few, exact).otherwise(asymptotic)


def digamma(x) -> Column:
    """psi(x) for x > 0: six steps of psi(x) = psi(x + 1) - 1/x, then the asymptotic series."""
    x = _c(x).cast("double")
    y = x + 6.0
    w = 1.0 / (y * y)
    tail = w * (1.0 / 12 - w * (1.0 / 120 - w * (1.0 / 252 - w * (1.0 / 240 - w / 132))))
    return F.log(y) - 0.5 / y - tail - (1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5))


# DuckDB text of the same series, for oracle SQL.  {x} and {dof} are SQL expressions.
CHI2_SF_SQL = (
    "CASE WHEN ({x}) IS NULL OR ({dof}) < 1 THEN NULL "
    "WHEN isinf(({x})::DOUBLE) THEN 0.0 "
    "WHEN ({x}) <= 0 THEN 1.0 "
    "WHEN ({x})/2.0 > ({dof})/2.0 + 40*sqrt(({dof})/2.0) + 40 THEN 0.0 "
    "ELSE greatest(0.0, least(1.0, 1.0 - list_sum(list_transform("
    "range(0, CAST(ceil(greatest(({x})/2.0 - ({dof})/2.0, 0.0) + 12*sqrt(({x})/2.0) + 40) AS BIGINT) + 1), "
    "lambda n: exp((({dof})/2.0 + n) * ln(({x})/2.0) - ({x})/2.0 - lgamma(({dof})/2.0 + n + 1)))))) END"
)

KOLMOGOROV_SF_SQL = (
    "CASE WHEN ({lam}) IS NULL THEN NULL WHEN ({lam}) < 0.2 THEN 1.0 "
    "ELSE greatest(0.0, least(1.0, 2.0 * list_sum(list_transform(range(1, 101), "
    "lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * ({lam}) * ({lam})))))) END"
)


def chi2_sf_sql(x: str, dof: str) -> str:
    return CHI2_SF_SQL.format(x=x, dof=dof)


def kolmogorov_sf_sql(lam: str) -> str:
    return KOLMOGOROV_SF_SQL.format(lam=lam)


def digamma_sql(x: str) -> str:
    steps = " + ".join(f"1.0::DOUBLE / (({x}) + {i})" for i in range(6))
    y = f"(({x}) + 6.0::DOUBLE)"
    return (
        f"(ln{y} - 0.5::DOUBLE / {y} - (1 / (12::DOUBLE * pow({y}, 2)) - 1 / (120::DOUBLE * pow({y}, 4)) + 1 / (252::DOUBLE * pow({y}, 6))"
        f" - 1 / (240::DOUBLE * pow({y}, 8)) + 1 / (132::DOUBLE * pow({y}, 10))) - ({steps}))"
    )
