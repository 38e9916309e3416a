"""Exact quantiles of many values: approximate ones bound them, and only the values between the bounds are gathered."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values up to which Spark's own exact percentile, which holds all of them in one buffer, is used.
FEW = 2_000_000
#: Accuracy of the bounds, and how far beyond a rank they are sought, as a share of all.
ACCURACY, MARGIN = 10_000, 3e-4


def large_quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """What ``percentile`` gives for the shares, or None if there are at most ``FEW`` values; nulls are none."""
    values = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = values.count()
    if n <= FEW:
        return None
    margin = max(MARGIN, 3 / n)
    at = [s for q in shares for s in (max(0.0, q - margin), min(1.0, q + margin))]
    bounds = values.agg(F.percentile_approx("v", at, ACCURACY), F.min("v"), F.max("v")).first()
    ends, least, most = bounds[0], bounds[1], bounds[2]
    low = [least if at[2 * i] == 0 else ends[2 * i] for i in range(len(shares))]
    high = [most if at[2 * i + 1] == 1 else ends[2 * i + 1] for i in range(len(shares))]
    within = F.lit(False)
    for a, b in zip(low, high, strict=True):
        within = within | F.col("v").between(a, b)
    below = values.agg(*[F.count_if(F.col("v") < a) for a in low]).first()
    got = values.where(within).groupBy("v").count().orderBy("v").toPandas()
    kept, many = got["v"].to_numpy(float), got["count"].to_numpy(np.int64)
    out = []
    for i, q in enumerate(shares):
        mine = (kept >= low[i]) & (kept <= high[i])
        v, last = kept[mine], below[i] + np.cumsum(many[mine])
        position = q * (n - 1)
        first = int(np.floor(position))
        if not len(v) or first < below[i] or min(first + 1, n - 1) >= last[-1]:
            raise RuntimeError("a quantile lies beyond its bounds")
        a, b = (float(v[np.searchsorted(last, r, "right")]) for r in (first, min(first + 1, n - 1)))
        out.append(a if a == b or position == first else (first + 1 - position) * a + (position - first) * b)
    return out
