import random

import numpy as np
from pyspark.sql import functions as F

from assayframe import analyze, leaderboard_study
from assayframe.operators import study
from assayframe.plans.demo import demo_responses, main
from assayframe.plans.fixtures import matrix
from assayframe.streaming import refresh


def test_curveball_keeps_margins():
    draw = np.random.default_rng(5)
    x = draw.random((30, 9)) < 0.4
    new = study.curveball([set(np.flatnonzero(r)) for r in x], 3000, random.Random(1))
    y = np.zeros_like(x)
    for i, r in enumerate(new):
        y[i, list(r)] = True
    assert (x.sum(0) == y.sum(0)).all() and (x.sum(1) == y.sum(1)).all() and (x != y).any()


def test_null_is_repeatable_and_summarised(spark, sf_dir):
    resp = matrix(spark, sf_dir).persist()
    null = study.curveball_null(resp, reps=4, trades=300).persist()
    again = study.curveball_null(resp, reps=4, trades=300)
    assert sorted(map(tuple, null.collect())) == sorted(map(tuple, again.collect()))
    k = resp.groupBy("item_idx").agg(F.sum("passed").alias("k")).agg(F.sum("k").alias("p"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    assert {(r["passes"], r["item_margin"]) for r in null.collect()} == {(k["p"], k["kk"])}
    told = study.null_summary(null, 0).first()
    assert told["p"] == 1.0 and told["null_min"] <= told["null_mean"] <= told["null_max"]


def test_spearman_of_ties_and_one_model(spark):
    rows = spark.createDataFrame([("s", k, a, b) for k, (a, b) in enumerate([(3, 1), (3, 2), (1, 3)])], "suite_id string, model_idx int, a int, b int")
    assert study.spearman(rows, "a", "b").first()["spearman"] == 1 - 6 * 8 / 24
    assert study.spearman(rows.limit(1), "a", "b").first()["spearman"] is None


def test_spearman_of_many_models(spark):
    """Opposite orders of so many models that the largest squares exceed an int."""
    n = 50_000
    rows = spark.range(n).select(F.lit("s").alias("suite_id"), F.col("id").cast("int").alias("model_idx"), F.col("id").alias("a"), (-F.col("id")).alias("b"))
    told = study.spearman(rows, "a", "b").first()
    assert (told["n"], told["d2"], told["spearman"]) == (n, n * (n * n - 1) // 3, -1.0)


def test_stream_of_outcomes(spark, tmp_path):
    rows = [("s", 0, "m", 0, "a", 1), ("s", 0, "m", 1, "b", 0), ("s", 1, "n", 0, "a", 1)]
    schema = "suite_id string, model_idx int, model string, item_idx int, item_id string, passed int"
    source = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        refresh.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    last = refresh.state(spark, str(tmp_path / "out"), 1)
    assert {(r["kind"], r["name"]): (r["passes"], r["cells"]) for r in last.collect()}[("item", "a")] == (4, 4)


def test_leaderboard_in_one_call(spark, sf_dir):
    resp = matrix(spark, sf_dir).persist()
    got = leaderboard_study(resp, cohort=6, sizes=(5, 8), randomisations=4, resamples=50, trades=500)
    totals = sorted((r["t"] for r in resp.groupBy("model").agg(F.sum("passed").alias("t")).collect()), reverse=True)
    assert sorted((r["total"] for r in got.cohort.totals.collect()), reverse=True) == totals[:6]
    assert got.pairs.count() == 5 and got.n_indistinct == sum(not r["real"] for r in got.pairs.collect())
    assert [r["cohort"] for r in got.sweep.orderBy("cohort").collect()] == [5, 8]
    assert {r["kept"] for r in got.agreement.collect()} == {"non-dead", "informative"}
    null = [r["backwards"] for r in got.null.collect()]
    told = got.null_summary.first()
    assert len(null) == 4 and told["observed"] == got.observed and told["p"] == sum(v >= got.observed for v in null) / 4
    assert got.winners.agg(F.sum("wins")).first()[0] == 50
    got.release()


def test_demonstration(spark, tmp_path, capsys):
    report = analyze(demo_responses(spark))
    assert list(report.model_totals.values()) == [32, 32, 32, 31, 30, 28, 26, 27, 24, 22, 19, 16]
    assert (report.figures["dead"], report.figures["backwards"], report.figures["strong"]) == (18, 3, 19)
    main([str(tmp_path / "report.html")])
    assert "19 of 40 items are worth keeping, which saves 5" in capsys.readouterr().out
    assert "<html" in (tmp_path / "report.html").read_text().lower()
