"""Exact quantiles of groups that are too large for one aggregation buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketch, as a share of the rows, and half the width of the bracket around a quantile.
ACCURACY, HALF = 100_000, 1e-3


def exact_quantiles(long: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """by, probability and quantile (linear interpolation), for groups of any size.

    A sketch brackets each quantile; values under the bracket are only counted, and
    those inside, about 2 HALF of the rows, are ranked. Groups whose bracket holds
    under a thousand rows are what ``percentile`` is for, so brackets are never
    narrower than ten ranks of the sketch's error allow.
    """
    by, ps = list(by), [float(p) for p in probabilities]
    x = F.col(value).cast("double")
    known = long.where(x.isNotNull())
    ends = [max(0.0, p - HALF) for p in ps] + [min(1.0, p + HALF) for p in ps]
    sketch = known.groupBy(*by).agg(F.count(x).alias("__n"), F.percentile_approx(x, ends, ACCURACY).alias("__ends"))
    rows = known.join(F.broadcast(sketch), by) if by else known.crossJoin(F.broadcast(sketch))
    below = rows.groupBy(*by).agg(F.array(*[F.count_if(x < F.col("__ends")[i]) for i in range(len(ps))]).alias("__below"))
    inside = [F.when((x >= F.col("__ends")[i]) & (x <= F.col("__ends")[len(ps) + i]), F.struct(F.lit(i).alias("i"), F.lit(p).alias("probability"))) for i, p in enumerate(ps)]
    spread = rows.select(*by, x.alias("__x"), "__n", F.explode(F.array_compact(F.array(*inside))).alias("__p")).select(*by, "__x", "__n", "__p.*")
    # equal values are counted, so ties cost nothing and the ranked rows are distinct values
    counts = spread.groupBy(*by, "i", "probability", "__n", "__x").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.join(F.broadcast(below), by) if by else counts.crossJoin(F.broadcast(below))
    until = Window.partitionBy(*by, "i").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.get("__below", F.col("i")) + F.sum("__c").over(until) - 1
    ranked = counts.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__c") + 1)
    at = F.col("probability") * (F.col("__n") - 1)
    low, part = F.floor(at), at - F.floor(at)
    holds = lambda k: F.max(F.when((F.col("__first") <= k) & (k <= F.col("__last")), F.col("__x")))
    picked = ranked.groupBy(*by, "probability").agg(holds(low).alias("__a"), holds(low + 1).alias("__b"), F.max(part).alias("__part"))
    return picked.select(*by, "probability", F.when(F.col("__part") == 0, F.col("__a")).otherwise(F.col("__a") + F.col("__part") * (F.col("__b") - F.col("__a"))).alias("quantile"))
