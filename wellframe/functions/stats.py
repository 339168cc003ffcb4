"""Column expressions and small tables of statistics, built from Spark's own functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def clean(c: Column, largest: float = 1e10) -> Column:
    """A number, with NaN, infinities and absurdly large values as NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) <= largest), x)


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def quantile(c: Column, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(c, F.lit(float(q)))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def robust_z(x: Column, centre: Column, mad: Column, floor: float = 1e-12) -> Column:
    """0.6745 (x - median) / max(MAD, floor)."""
    return 0.6745 * (x - centre) / F.greatest(mad, F.lit(floor))


def average_rank(value: Column | str, part: Sequence[str] = ()) -> Column:
    """Ranks from 1; ties share the mean of their ranks."""
    value = F.col(value) if isinstance(value, str) else value
    ordered = Window.partitionBy(*part).orderBy(value)
    same = Window.partitionBy(*part, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; NULL where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread))


def softmax(score: Column, over: WindowSpec, temperature: float = 0.1) -> Column:
    heat = max(temperature, 1e-12)
    e = F.exp((score - F.max(score).over(over)) / heat)
    return e / F.sum(e).over(over)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays as sets. Two empty sets give ``both_empty``: 0 when lists are compared, 1 for stability."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def rank_biased_overlap(a: Column, b: Column, p: float = 0.9, depth: Column | None = None) -> Column:
    """(1-p) sum over d of p^(d-1) |A_d and B_d| / d, cut at the shorter list and ``depth``."""
    n = F.least(F.size(a), F.size(b))
    n = n if depth is None else F.least(n, depth)
    part = lambda d: F.size(F.array_intersect(F.slice(a, 1, d), F.slice(b, 1, d))) / d * F.pow(F.lit(p), d - 1)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, d: acc + part(d))
    return F.when(n >= 1, (1 - p) * total).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with value computed once a row: inside a lambda an expression is computed anew for each element."""
    return F.transform(F.array(value), then)[0]


def unit(v: Column, floor: float = 1e-12) -> Column:
    """v / max(|v|, floor)."""
    return once(v, lambda w: once(F.greatest(norm(w), F.lit(floor)), lambda n: F.transform(w, lambda x: x / n)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def cityblock(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def centred(v: Column) -> Column:
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x) / F.size(w)
    return once(v, lambda w: once(mean(w), lambda m: F.transform(w, lambda x: x - m)))


def array_ranks(v: Column) -> Column:
    """Average ranks within an array; quadratic in its length, so for short vectors."""
    return F.transform(
        v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2.0
    )


def similarity_of_distance(d: Column, metric: str) -> Column:
    return 1 - d if metric in ("cosine", "correlation") else 1 / (1 + d)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q_value", nan_as_one: bool = False, part: Sequence[str] = ()) -> DataFrame:
    """Adds q-values: p n / rank, made monotone from the largest down, at most 1.

    NULL and NaN stay NULL and don't count, unless ``nan_as_one``. Ties in p get one
    q-value whatever their order. The table of tests is small beside the data (a row
    for each feature), so one window over it is right.
    """
    x = F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double"))
    x = F.coalesce(x, F.lit(1.0)) if nan_as_one else x
    df = df.withColumn("__p", x).withColumn("__ok", F.col("__p").isNotNull())
    up = Window.partitionBy("__ok", *part).orderBy("__p")
    n = F.count(F.lit(1)).over(Window.partitionBy("__ok", *part))
    df = df.withColumn("__raw", F.col("__p") * n / F.row_number().over(up))
    down = Window.partitionBy("__ok", *part).orderBy(F.desc("__p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.min("__raw").over(down), F.lit(1.0))
    return df.withColumn(out, F.when(F.col("__ok"), q)).drop("__p", "__ok", "__raw")


def normal_tail(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3 or rho != rho:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def hypergeometric_tail(observed: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= observed) when ``drawn`` of ``total`` are taken, ``marked`` of which count."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = min(marked, drawn)
    terms = [
        math.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn))
        for k in range(max(observed, 0, drawn - (total - marked)), top + 1)
    ]
    return min(1.0, sum(terms))
