"""Item statistics from integer moments.

One hash aggregate over responses and model totals gives, for each item, the
counts and sums n, k, sum T, sum T^2, sum T*x and those of the two extreme
groups.  All statistics are functions of these integers, so they need one
shuffle, don't depend on the order of rows, and zero variance is exact.
Sums of squares fit a long while models * items is below 3e9 a suite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SUITE

#: Rows of model totals up to which they are sent to every executor.
BROADCAST_TOTALS = 200_000
GROUP_FRACTION = 0.27


def sized(df: DataFrame, limit: int = BROADCAST_TOTALS) -> DataFrame:
    """``df``, computed once, with a broadcast hint if it has at most ``limit`` rows."""
    return hinted(df.persist(), limit)


def hinted(df: DataFrame, limit: int = BROADCAST_TOTALS) -> DataFrame:
    """``df``, which a count has to be cheap of, with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def model_totals(responses: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """Items that each model passes."""
    return responses.groupBy(*by, "model_idx", "model").agg(F.sum("passed").cast("long").alias("total"))


def ranked_totals(totals: DataFrame, by: list[str] = SUITE, group_fraction: float = GROUP_FRACTION) -> DataFrame:
    """Totals with ascending rank (ties by model order) and the size of the extreme groups, half-even rounded."""
    if not 0 < group_fraction <= 0.5:
        raise ValueError("group_fraction must be in (0, 0.5]")
    everyone = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(everyone)
    return totals.withColumns(
        {
            "rank": F.row_number().over(everyone.orderBy("total", "model_idx")),
            "models": n,
            "extreme": F.greatest(F.lit(1), F.rint(n * F.lit(float(group_fraction))).cast("int")),
        }
    )


def item_moments(responses: DataFrame, ranked: DataFrame | None = None, by: list[str] = SUITE, group_fraction: float = GROUP_FRACTION) -> DataFrame:
    """Counts and sums of each item; ``ranked`` are its suite's ranked totals, if they are at hand."""
    ranked = sized(ranked_totals(model_totals(responses, by), by, group_fraction)) if ranked is None else ranked
    x, t = F.col("passed").cast("long"), F.col("total")
    return (
        responses.select(*by, "model_idx", "item_idx", "item_id", "passed")
        .join(ranked.drop("model"), [*by, "model_idx"])
        .groupBy(*by, "item_idx", "item_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x).alias("k"),
            F.sum(t).alias("st"),
            F.sum(t * t).alias("stt"),
            F.sum(t * x).alias("stx"),
            F.min(t - x).alias("rest_lo"),
            F.max(t - x).alias("rest_hi"),
            F.sum(F.when(F.col("rank") <= F.col("extreme"), x).otherwise(0)).alias("low_passes"),
            F.sum(F.when(F.col("rank") > F.col("models") - F.col("extreme"), x).otherwise(0)).alias("high_passes"),
            F.max("extreme").alias("extreme"),
        )
    )


def _c(name: str) -> Column:
    return F.col(name)


def difficulty() -> Column:
    """Share of models that pass: the higher, the easier."""
    return _c("k") / _c("n")


def item_variance() -> Column:
    """Population variance of an item's scores."""
    return (_c("k") * (_c("n") - _c("k"))) / (_c("n") * _c("n")).cast("double")


def rest_variance_n2() -> Column:
    """n^2 times the population variance of the rest scores: a whole number."""
    rest, squares = _c("st") - _c("k"), _c("stt") - 2 * _c("stx") + _c("k")
    return _c("n") * squares - rest * rest


def correlation(corrected: bool = True, undefined: float | None = 0.0) -> Column:
    """Point-biserial correlation of item and (rest) total; ``undefined`` where either has no variance."""
    own = _c("k") if corrected else F.lit(0)
    spread = rest_variance_n2() if corrected else _c("n") * _c("stt") - _c("st") * _c("st")
    p = difficulty()
    passed, failed = (_c("stx") - own) / F.nullif(_c("k"), F.lit(0)), (_c("st") - _c("stx")) / F.nullif(_c("n") - _c("k"), F.lit(0))
    r = (passed - failed) / (F.sqrt(F.nullif(spread, F.lit(0)).cast("double")) / _c("n")) * F.sqrt(p * (1 - p))
    none = (_c("k") == 0) | (_c("k") == _c("n")) | (spread == 0)
    return F.when(none, F.lit(undefined).cast("double")).otherwise(r)


def discrimination() -> Column:
    """Pass rate of the upper group less that of the lower."""
    return _c("high_passes") / _c("extreme") - _c("low_passes") / _c("extreme")


def item_statistics(moments: DataFrame) -> DataFrame:
    """Moments with difficulty, discrimination and point_biserial."""
    return moments.withColumns({"difficulty": difficulty(), "discrimination": discrimination(), "point_biserial": correlation()})
