"""Is an item backwards beyond chance?  Permutation tails and false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import check_rate, normal_cdf
from ..functions.tails import EXACT_CELLS, exact_tail
from ..schema import SUITE
from .items import hinted, rest_variance_n2


def tail_method() -> Column:
    """exact, normal or undefined, from moments.

    The cost that decides is n * k * (k * range + 1), with the number of passes
    itself: it picks the answer, so it is not made symmetric.
    """
    n, k = F.col("n"), F.col("k")
    cells = n * k * (k * (F.col("rest_hi") - F.col("rest_lo")) + 1)
    none = (k == 0) | (k == n) | (rest_variance_n2() == 0)
    return F.when(none, "undefined").when(cells <= EXACT_CELLS, "exact").otherwise("normal")


def normal_tail() -> Column:
    """The lower tail of the passers' rest scores by their mean and variance, continuity-corrected."""
    n, k = F.col("n"), F.col("k")
    mean = (F.col("st") - k) / n
    variance = rest_variance_n2() / (n * n).cast("double")
    z = (F.col("stx") - k + 0.5 - k * mean) / F.sqrt(k * (n - k) / (n - 1) * variance)
    return normal_cdf(z)


def backwards_p_values(responses: DataFrame, ranked: DataFrame, moments: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """Moments with p_method and backwards_p (null where undefined).

    Vectors of rest scores are gathered for items with an exact tail only; their
    length is bounded by the exact tail's budget.  ``moments`` are counted first,
    so they should be in storage.
    """
    told = moments.withColumn("p_method", tail_method())
    exact = told.where("p_method = 'exact'").select(*by, "item_idx", F.col("k").alias("passes"), (F.col("stx") - F.col("k")).alias("observed"))
    cells = responses.select(*by, "model_idx", "item_idx", "passed").join(hinted(exact), [*by, "item_idx"]).join(ranked.select(*by, "model_idx", "total"), [*by, "model_idx"])
    rest = cells.groupBy(*by, "item_idx", "passes", "observed").agg(F.collect_list(F.col("total") - F.col("passed")).alias("rest"))
    tails = rest.select(*by, "item_idx", exact_tail("rest", "passes", "observed").alias("exact_p"))
    normal = F.when(F.col("p_method") == "normal", normal_tail())
    return told.join(tails, [*by, "item_idx"], "left").withColumn("backwards_p", F.coalesce("exact_p", normal)).drop("exact_p")


def benjamini_hochberg(tested: DataFrame, q: float = 0.05, by: list[str] = SUITE, p_col: str = "backwards_p", flag: str = "discovered") -> DataFrame:
    """Adds which p-values survive false-discovery control at ``q``; nulls never do and don't count.

    Equal p-values share their fate, so the step-up runs over distinct values and
    their counts, and what goes back to the rows is one bound a group.
    """
    check_rate(q, "q")
    steps = tested.where(F.col(p_col).isNotNull()).groupBy(*by, F.col(p_col).alias("p")).agg(F.count(F.lit(1)).alias("ties"))
    everyone = Window.partitionBy(*by)
    rank = F.sum("ties").over(everyone.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.withColumns({"rank": rank, "m": F.sum("ties").over(everyone)})
    bounds = steps.where(F.col("p") <= F.lit(float(q)) * F.col("rank") / F.col("m")).groupBy(*by).agg(F.max("p").alias("p_bound"))
    return tested.join(bounds, by, "left").withColumn(flag, F.coalesce(F.col(p_col) <= F.col("p_bound"), F.lit(False))).drop("p_bound")
