"""Suite statistics, selections of items, and comparisons of models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import deviate, reliability_band, verdict
from ..schema import SUITE
from .inference import benjamini_hochberg
from .items import correlation

USEFUL = ("weak", "acceptable", "strong")


def judged_items(tested: DataFrame, fdr: float, by: list[str] = SUITE) -> DataFrame:
    """Items with significance (discovered and pointing the wrong way) and verdict."""
    found = benjamini_hochberg(tested, fdr, by).withColumn("backwards_significant", F.col("discovered") & (F.col("point_biserial") < 0.0))
    return found.withColumn("verdict", verdict(F.col("k"), F.col("n"), F.col("point_biserial"), F.col("backwards_significant"))).drop("discovered")


def with_verdict(items: DataFrame, *verdicts: str) -> DataFrame:
    return items.where(F.col("verdict").isin(*verdicts))


def suspicious(items: DataFrame) -> DataFrame:
    """Point the wrong way without significance, least likely first."""
    return items.where(~F.col("backwards_significant") & F.col("backwards_p").isNotNull() & (F.col("point_biserial") < 0.0)).orderBy("backwards_p", "item_idx")


def ranked(items: DataFrame) -> DataFrame:
    """Most informative first; ties in suite order."""
    return items.orderBy(F.col("point_biserial").desc(), "item_idx")


def reliability(moments: DataFrame, totals: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """n_items, n_models, alpha and sem: two aggregates of integers.

    Alpha is 0 if all totals are equal, and may be negative; it takes two items.
    """
    of_items = moments.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("k") * (F.col("n") - F.col("k"))).alias("within"))
    of_models = totals.groupBy(*by).agg(F.count(F.lit(1)).alias("n_models"), F.sum("total").alias("st"), F.sum(F.col("total") * F.col("total")).alias("stt"))
    items = F.col("n_items")
    spread = F.col("n_models") * F.col("stt") - F.col("st") * F.col("st")
    alpha = F.when(spread == 0, 0.0).otherwise(items / F.nullif(items - 1, F.lit(0)) * (1 - F.col("within") / F.nullif(spread, F.lit(0))))
    sd = F.sqrt(spread.cast("double")) / F.col("n_models")
    return (
        of_items.join(of_models, by)
        .withColumn("alpha", alpha)
        .withColumn("sem", sd * F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("alpha"))))
        .select(*by, "n_items", "n_models", "alpha", "sem")
    )


def real_gap(sem: Column, confidence: float = 0.95) -> Column:
    """The smallest difference of totals that noise doesn't explain."""
    return F.lit(deviate(confidence)) * sem * F.lit(math.sqrt(2))


def suite_summary(items: DataFrame, moments: DataFrame, totals: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """One row a suite: reliability, its band, the real gap at 95 %, and counts and shares of verdicts."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    counts = items.groupBy(*by).agg(
        is_("dead").alias("dead"),
        F.count_if((F.col("verdict") == "dead") & (F.col("k") == F.col("n"))).alias("dead_all_pass"),
        F.count_if((F.col("verdict") == "dead") & (F.col("k") == 0)).alias("dead_none_pass"),
        *[is_(v).alias(v) for v in ("backwards", "weak", "acceptable", "strong")],
        F.count_if(~F.col("backwards_significant") & F.col("backwards_p").isNotNull() & (F.col("point_biserial") < 0.0)).alias("suspicious"),
        (is_(*USEFUL) / F.count(F.lit(1))).alias("signal_ratio"),
        (is_("dead", "backwards") / F.count(F.lit(1))).alias("wasted_fraction"),
    )
    both = reliability(moments, totals, by).join(counts, by)
    return both.withColumns({"alpha_band": reliability_band(F.col("alpha")), "min_real_gap": real_gap(F.col("sem"))})


def healthy(summary: DataFrame, most_wasted: float = 0.30) -> DataFrame:
    """A gate for continuous integration: nothing backwards, and less waste than allowed."""
    return summary.withColumn("healthy", (F.col("backwards") == 0) & (F.col("wasted_fraction") < most_wasted))


def adjacent_pairs(totals: DataFrame, summary: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """Neighbours in the ranking: gap, and whether it is real."""
    order = Window.partitionBy(*by).orderBy(F.col("total").desc(), "model_idx")
    step = totals.select(
        *by,
        F.row_number().over(order).alias("place"),
        F.col("model").alias("model_a"),
        F.col("total").alias("total_a"),
        F.lead("model").over(order).alias("model_b"),
        F.lead("total").over(order).alias("total_b"),
    ).where("model_b IS NOT NULL")
    pairs = step.join(summary.select(*by, "min_real_gap"), by)
    return pairs.withColumn("gap", F.abs(F.col("total_a") - F.col("total_b"))).withColumn("real", F.col("gap") > F.col("min_real_gap"))


def tied_for_first(totals: DataFrame, summary: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """The leader, and every model that its lead over doesn't exceed the real gap."""
    best = totals.groupBy(*by).agg(F.max("total").alias("best"))
    return totals.join(best, by).join(summary.select(*by, "min_real_gap"), by).where(F.col("best") - F.col("total") <= F.col("min_real_gap")).drop("best", "min_real_gap")


def old_rule_backwards(moments: DataFrame, by: list[str] = SUITE, threshold: float = -0.05) -> DataFrame:
    """Items below a fixed correlation: the rule that ignores chance."""
    r = correlation(undefined=None)
    return moments.groupBy(*by).agg(F.count_if(F.coalesce(r < threshold, F.lit(False))).alias("old_rule_backwards"))
