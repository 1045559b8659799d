"""Leaderboard studies: cohorts, trimming, rank agreement, resampling."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SUITE
from .items import model_totals, sized

COHORTS = (5, 10, 25, 50, 100, 134)
#: Defaults of the studies: cohort in detail, randomisations, resamples, trades a randomisation.
COHORT, RANDOMISATIONS, RESAMPLES, TRADES = 25, 200, 2000, 20_000


def ranking(totals: DataFrame, by: list[str] = SUITE) -> DataFrame:
    """Totals with place 1, 2, ...: highest first, ties in model order."""
    return totals.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("total").desc(), "model_idx")))


def top(responses: DataFrame, totals: DataFrame, n: int, by: list[str] = SUITE) -> DataFrame:
    """The responses of the n best models, numbered by place."""
    best = ranking(totals, by).where(F.col("place") <= n).select(*by, "model_idx", "place")
    return responses.join(sized(best), [*by, "model_idx"]).withColumn("model_idx", (F.col("place") - 1).cast("int")).drop("place")


def cohorts(responses: DataFrame, totals: DataFrame, sizes: tuple[int, ...] = COHORTS) -> DataFrame:
    """The responses of the best n models for every n that a suite has, under the key ``cohort``: one table, one job."""
    placed = ranking(totals).withColumn("available", F.count(F.lit(1)).over(Window.partitionBy(*SUITE)))
    size = F.explode(F.array(*map(F.lit, sizes))).alias("cohort")
    member = placed.select(*SUITE, "model_idx", "place", "available", size).where("cohort <= available AND place <= cohort").drop("available")
    return responses.join(sized(member), [*SUITE, "model_idx"]).withColumn("model_idx", (F.col("place") - 1).cast("int")).drop("place")


def spearman(scores: DataFrame, a: str, b: str, by: list[str] = SUITE) -> DataFrame:
    """Rank agreement of two columns of (model_idx, a, b); tied values keep model order, ranks aren't averaged.

    Ranks are ints, whose squares exceed an int from 46,342 models on, and the
    sum of squares a long from about three million: ``d2`` is a decimal.
    """
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).desc(), "model_idx"))
    d = F.col("rank_a").cast("long") - F.col("rank_b")
    n = F.col("n").cast("double")
    both = scores.withColumns({"rank_a": rank(a), "rank_b": rank(b)}).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((d * d).cast("decimal(20,0)")).alias("d2"))
    return both.withColumn("spearman", 1 - 6 * F.col("d2").cast("double") / F.nullif(n * (n * n - 1), F.lit(0.0)))


def trimmed_agreement(responses: DataFrame, totals: DataFrame, items: DataFrame, kept: dict[str, tuple[str, ...]], by: list[str] = SUITE) -> DataFrame:
    """Totals over the items with some verdicts against totals over all: a row for each named set of verdicts, in one pass."""
    judged = sized(items.select(*by, "item_idx", "verdict"))
    has = lambda name: F.col("verdict").isin(*kept[name])
    sums = [F.sum(F.when(has(n), F.col("passed")).otherwise(0)).cast("long").alias(n) for n in kept]
    part = responses.select(*by, "model_idx", "item_idx", "passed").join(judged, [*by, "item_idx"]).groupBy(*by, "model_idx").agg(*sums)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("kept"), F.col(n).alias("trimmed")) for n in kept]))
    both = totals.join(part, [*by, "model_idx"]).select(*by, "model_idx", "total", named.alias("t")).select(*by, "model_idx", "total", "t.*")
    sizes = judged.groupBy(*by).agg(*[F.count_if(has(n)).alias(n) for n in kept])
    told = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("kept"), F.col(n).alias("n_kept")) for n in kept])).alias("t")).select(*by, "t.*")
    return spearman(both, "total", "trimmed", [*by, "kept"]).join(told, [*by, "kept"])


def bootstrap_winners(responses: DataFrame, items: int, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """How often each model is first when items are drawn with replacement.

    Draws are hashes of resample and draw number, so reruns agree.  They are
    counted by (resample, item) before they meet the responses; ties go to the
    model that comes first.
    """
    spark = responses.sparkSession
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-" if seed else ""), F.col("resample").cast("string"), F.lit("-"), F.col("draw").cast("string"))), 1, 8), 16, 10)
    draws = spark.range(resamples).select(F.col("id").cast("int").alias("resample")).select("resample", F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("draw"))
    times = draws.groupBy("resample", (draw.cast("bigint") % items).cast("int").alias("item_idx")).agg(F.count(F.lit(1)).alias("times"))
    passes = responses.where("passed = 1").select("item_idx", "model_idx")
    everyone = sized(responses.select("model_idx", "model").distinct())
    score = times.join(passes, "item_idx").groupBy("resample", "model_idx").agg(F.sum("times").alias("score"))
    best = score.groupBy("resample").agg(F.max(F.struct("score", (-F.col("model_idx")).alias("first"))).alias("b")).select("resample", (-F.col("b.first")).alias("model_idx"))
    # a resample in which nobody passes anything is the first model's
    best = spark.range(resamples).select(F.col("id").cast("int").alias("resample")).join(best, "resample", "left").select(F.coalesce("model_idx", F.lit(0)).alias("model_idx"))
    return best.groupBy("model_idx").agg(F.count(F.lit(1)).alias("wins")).join(everyone, "model_idx").withColumn("share", F.col("wins") / resamples)


def curveball(rows: list[set[int]], trades: int, draw: random.Random) -> list[set[int]]:
    """Random 0/1 matrix with both margins kept: pairs of rows trade equally many of what only one has."""
    rows, n = [set(r) for r in rows], len(rows)
    for _ in range(trades):
        i, j = int(draw.random() * n), int(draw.random() * n)
        mine, theirs = rows[i] - rows[j], rows[j] - rows[i]
        most = min(len(mine), len(theirs))
        if not most:
            continue
        k = 1 + int(draw.random() * most)
        # members are small whole numbers, so the order of a set is the same in every worker
        give, take = draw.sample(tuple(mine), k), draw.sample(tuple(theirs), k)
        rows[i].difference_update(give)
        rows[i].update(take)
        rows[j].difference_update(take)
        rows[j].update(give)
    return rows


#: Cells of a matrix that is sent to every task of a randomisation.
MATRIX_CELLS = 20_000_000


def curveball_null(responses: DataFrame, reps: int = RANDOMISATIONS, trades: int = TRADES, seed: int = 0, threshold: float = -0.05) -> DataFrame:
    """For each randomisation, how many items a fixed correlation threshold would call backwards.

    A chain of trades is sequential, so a randomisation is one task's work; its
    seed is its own number, so a retry repeats it.  The matrix of one cohort, of
    at most ``MATRIX_CELLS`` cells, is sent to every task.
    """
    import numpy as np

    spark = responses.sparkSession
    sizes = responses.agg(F.count_distinct("item_idx").alias("items"), (F.max("model_idx") + 1).alias("models")).first()
    n, m = sizes["models"] or 0, sizes["items"]
    if n * m > MATRIX_CELLS:
        raise ValueError(f"a cohort of {n} models and {m} items exceeds {MATRIX_CELLS} cells: choose a smaller one")
    passes = responses.where("passed = 1").groupBy("item_idx").agg(F.sort_array(F.collect_list("model_idx")).alias("models")).orderBy("item_idx").collect()
    rows = [r["models"] for r in passes]
    shared = spark.sparkContext.broadcast(rows + [[]] * (m - len(rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rep in batch["id"]:
                new = curveball(shared.value, trades, random.Random(f"{seed}-{rep}"))
                x = np.zeros((len(new), n), np.int64)
                for i, r in enumerate(new):
                    x[i, list(r)] = 1
                total, k = x.sum(0), x.sum(1)
                rest = total[None, :] - x
                # the correlation's sign and size from whole numbers
                num = n * (x * rest).sum(1) - k * rest.sum(1)
                den = (k * (n - k)).astype(float) * (n * (rest * rest).sum(1) - rest.sum(1) ** 2)
                r = np.divide(num, np.sqrt(den), out=np.zeros(len(k)), where=den > 0)
                out.append((int(rep), int((r < threshold).sum()), int(k.sum()), int((total * total).sum()), int((k * k).sum())))
            yield pd.DataFrame(out, columns=["rep", "backwards", "passes", "model_margin", "item_margin"])

    return spark.range(reps).repartition(min(reps, spark.sparkContext.defaultParallelism)).mapInPandas(run, "rep long, backwards long, passes long, model_margin long, item_margin long")


def null_summary(null: DataFrame, observed: int) -> DataFrame:
    """Mean, population spread, range, and the share of the null at or above what was observed."""
    return null.agg(
        F.avg("backwards").alias("null_mean"),
        F.stddev_pop("backwards").alias("null_sd"),
        F.min("backwards").alias("null_min"),
        F.max("backwards").alias("null_max"),
        F.avg(F.when(F.col("backwards") >= observed, 1.0).otherwise(0.0)).alias("p"),
    ).withColumn("observed", F.lit(observed))
