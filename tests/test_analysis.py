import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe import analyze, items_from_dicts, responses_from_scores, to_html, to_text
from assayframe.functions.scalars import detectable_with, normal_cdf
from assayframe.functions.tails import EXACT_CELLS, lower_tail
from assayframe.operators import items as it
from assayframe.operators.inference import benjamini_hochberg, tail_method
from assayframe.plans.analysis import plan
from assayframe.plans.rendering import diagnosis

SMALL = {"strong": [1, 0, 1, 1, 1], "good": [1, 0, 1, 0, 1], "weak": [1, 0, 0, 0, 1], "poor": [1, 0, 0, 0, 0]}
SMALL_ITEMS = ["always-pass", "never-pass", "splits-clean", "only-best", "most-pass"]


def responses(spark, ids, scores):
    return responses_from_scores(spark, items_from_dicts(spark, [{"id": i} for i in ids]), scores)


def twelve():
    ids = [f"fair-{i}" for i in range(20)] + ["broken"]
    return ids, {f"m{r:02d}": [int(r <= i) for i in range(20)] + [int(r >= 6)] for r in range(12)}


def demo():
    ability = [0.94, 0.91, 0.88, 0.82, 0.78, 0.71, 0.66, 0.59, 0.51, 0.45, 0.36, 0.28]
    rules = [("smoke", lambda a, i: 1)] * 12 + [("frontier", lambda a, i: 0)] * 5
    ids = [f"{name}-{k}" for k, (name, _) in enumerate(rules)]
    ids += [f"reasoning-{i}" for i in range(20)] + [f"format-{i}" for i in range(3)]
    rows = {f"model-{k}": [f(a, 0) for _, f in rules] + [int(a > 0.25 + 0.03 * i) for i in range(20)] + [int(a < 0.6)] * 3 for k, a in enumerate(ability)}
    return ids, rows


@pytest.fixture(scope="module")
def small(spark):
    return analyze(responses(spark, SMALL_ITEMS, SMALL))


def test_small_suite_by_hand(small):
    rows = {r["item_id"]: r for r in small.items.collect()}
    assert [rows[i]["difficulty"] for i in SMALL_ITEMS] == [1.0, 0.0, 0.5, 0.25, 0.75]
    r = [rows[i]["point_biserial"] for i in SMALL_ITEMS]
    assert r == pytest.approx([0, 0, 0.7071067811865475, 0.5222329678670935, 0.5222329678670935], abs=1e-14)
    assert [rows[i]["discrimination"] for i in SMALL_ITEMS] == [0, 0, 1, 1, 1]
    assert [rows[i]["verdict"] for i in SMALL_ITEMS] == ["dead", "dead", "strong", "strong", "strong"]
    assert [rows[i]["backwards_p"] for i in SMALL_ITEMS] == [None, None, 1.0, 1.0, 1.0]
    assert small.alpha == pytest.approx(0.625) and small.sem == pytest.approx(0.6846531968814576)
    assert small.min_real_gap() == pytest.approx(1.8977618396416345)
    assert small.wasted_fraction == 0.4 and small.signal_ratio == 0.6
    assert small.model_totals == {"strong": 4, "good": 3, "weak": 2, "poor": 1}
    assert small.separates("strong", "poor") and not small.separates("good", "weak")
    assert not small.backwards_detectable()
    assert [r["item_id"] for r in small.ranked().collect()][0] == "splits-clean"
    with pytest.raises(ValueError, match="unknown model"):
        small.separates("strong", "nobody")
    with pytest.raises(ValueError, match="confidence must be one of"):
        small.min_real_gap(0.75)


def test_uncorrected_correlation(spark):
    moments = it.item_moments(responses(spark, ["a", "b", "c"], {"x": [1, 0, 0], "y": [1, 0, 1], "z": [0, 1, 1], "w": [0, 1, 0]}))
    got = {r["item_id"]: r["r"] for r in moments.select("item_id", it.correlation(corrected=False).alias("r")).collect()}
    x, t = np.array([1, 1, 0, 0]), np.array([1, 2, 2, 1])
    assert got["a"] == pytest.approx(np.corrcoef(x, t)[0, 1], abs=1e-12)
    assert got["c"] == pytest.approx(1.0)


def test_swapped_item_is_suspicious_only(spark):
    rep = analyze(responses(spark, SMALL_ITEMS, SMALL | {"strong": [1, 0, 1, 1, 0], "poor": [1, 0, 0, 0, 1]}))
    assert rep.backwards_items().isEmpty()
    row = {r["item_id"]: r for r in rep.suspicious_items().collect()}["most-pass"]
    assert row["point_biserial"] < 0 and row["backwards_p"] > 0.05
    assert "noise" in rep.items.where(F.col("item_id") == row["item_id"]).select(diagnosis()).first()[0] and "NOT TESTABLE" in to_text(rep)


def test_twelve_models_convict_one_item(spark):
    rep = analyze(responses(spark, *twelve()))
    (row,) = rep.backwards_items().collect()
    assert row["item_id"] == "broken" and row["backwards_p"] == pytest.approx(1 / 924, rel=1e-12)
    assert row["point_biserial"] == pytest.approx(-0.869048, abs=1e-6)
    assert rep.alpha == pytest.approx(0.793864, abs=1e-6) and rep.sem == pytest.approx(1.374621, abs=1e-6)
    assert rep.backwards_detectable() and not rep.healthy()
    text = to_text(rep)
    assert "BACKWARDS ITEMS (1)" in text and "broken" in text


def test_demo_suite(spark):
    rep = analyze(responses(spark, *demo()))
    f = rep.figures
    assert (f["dead"], f["dead_all_pass"], f["backwards"], f["strong"]) == (18, 13, 3, 19)
    assert list(rep.model_totals.values()) == [32, 32, 32, 31, 30, 28, 26, 27, 24, 22, 19, 16]
    assert rep.alpha == pytest.approx(0.8597, abs=1e-4) and rep.sem == pytest.approx(1.9306, abs=1e-4)
    assert rep.min_real_gap() == pytest.approx(5.3515, abs=1e-4)
    for row in rep.backwards_items().collect():
        assert row["backwards_p"] == pytest.approx(2 / 792) and row["point_biserial"] == pytest.approx(-0.845366, abs=1e-6)
    assert rep.keep_list().count() == 19 and "... 20 more" in to_text(rep)


@pytest.mark.parametrize(("x", "p"), [([0, 0, 1, 1], 1 / 6), ([1, 1, 0, 0], 1.0), ([1, 0, 0, 1], 0.5)])
def test_exact_tail_by_hand(x, p):
    rest = np.array([4, 3, 2, 1]) - x
    assert lower_tail(rest, sum(x), int(rest @ x)) == pytest.approx(p)


def test_exact_tail_against_all_subsets():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = int(draw.integers(2, 11))
        rest, k = draw.integers(0, 7, n), int(draw.integers(1, n))
        sums = [int(sum(c)) for c in combinations(rest, k)]
        for s in {min(sums) - 1, *sums}:
            assert lower_tail(rest, k, s) == pytest.approx(sum(v <= s for v in sums) / len(sums), abs=1e-12)
            assert lower_tail(rest, k, s) == 0 or lower_tail(rest, k, s) >= 1 / math.comb(n, k) - 1e-12


def test_method_switches_at_the_budget(spark):
    def method(n, k, span):
        row = spark.createDataFrame([(n, k, 2 * n, 9 * n, k, 0, span)], "n long, k long, st long, stt long, stx long, rest_lo long, rest_hi long")
        return row.select(tail_method()).first()[0]

    assert EXACT_CELLS == 5_000_000
    assert method(100, 10, 499) == "exact" and method(100, 10, 500) == "normal"  # 1000 * 4991 and 1000 * 5001
    assert method(50, 0, 3) == "undefined" and method(50, 50, 3) == "undefined"


def test_normal_distribution(spark):
    z = np.linspace(-9, 9, 181)
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert np.abs(np.array(got) - [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z]).max() < 1e-14


@pytest.mark.parametrize(
    ("p", "flags"),
    [([0.001, 0.008, 0.039, 0.041, 0.9], [1, 1, 0, 0, 0]), ([0.001, 0.02, 0.03], [1, 1, 1]), ([None, None], [0, 0]), ([0.04, 0.04, None, 0.04], [1, 1, 0, 1])],
)
def test_step_up(spark, p, flags):
    rows = spark.createDataFrame([("s", k, v) for k, v in enumerate(p)], "suite_id string, item_idx int, backwards_p double")
    got = benjamini_hochberg(rows).orderBy("item_idx").collect()
    assert [int(r["discovered"]) for r in got] == flags


def test_step_up_rejects_bad_rates(spark):
    with pytest.raises(ValueError, match="q must be between"):
        benjamini_hochberg(spark.createDataFrame([], "suite_id string, backwards_p double"), 1.5)


def test_detectability():
    assert [detectable_with(n, 0.05) for n in (1, 2, 5, 6, 20)] == [False, False, False, True, True]


def test_extreme_groups(spark):
    def size(n, fraction=0.27):
        totals = spark.range(n).select(F.lit("s").alias("suite_id"), F.col("id").cast("int").alias("model_idx"), F.lit(1).alias("total"))
        return it.ranked_totals(totals, group_fraction=fraction).first()["extreme"]

    assert [size(n) for n in (1, 50, 150)] == [1, 14, 40]  # 13.5 and 40.5: half to even
    assert size(7, 0.5) == 4
    with pytest.raises(ValueError, match="group_fraction"):
        size(10, 0.9)


def test_ties_of_totals_follow_model_order(spark):
    rows = responses(spark, ["a", "b"], {"m0": [1, 0], "m1": [0, 1], "m2": [1, 0], "m3": [0, 1]})
    got = {r["item_id"]: r["d"] for r in it.item_moments(rows).select("item_id", it.discrimination().alias("d")).collect()}
    assert got == {"a": -1.0, "b": 1.0}


def test_noise_convicts_nobody_and_a_planted_item_is_found(spark):
    draw = np.random.default_rng(11)
    rate = draw.uniform(0.2, 0.9, 120)
    noise = draw.random((20, 120)) < rate
    ids = [f"i{k}" for k in range(120)]
    rep = analyze(responses(spark, ids, {f"m{k}": r.astype(int).tolist() for k, r in enumerate(noise)}))
    assert rep.figures["backwards"] == 0
    signal = np.arange(20)[:, None] / 20 > draw.random((1, 60))
    both = np.concatenate([noise[:, :60], signal, (np.arange(20) < 10)[:, None]], 1).astype(int)
    rep = analyze(responses(spark, [*ids[:60], *[f"s{k}" for k in range(60)], "planted"], {f"m{k}": r.tolist() for k, r in enumerate(both)}))
    assert "planted" in [r["item_id"] for r in rep.backwards_items().collect()]


def test_many_suites_in_one_plan(spark, small):
    other = responses(spark, *twelve()).withColumn("suite_id", F.lit("t"))
    both = plan(responses(spark, SMALL_ITEMS, SMALL).unionByName(other))
    rows = {r["suite_id"]: r for r in both.summary.collect()}
    assert rows["suite"]["alpha"] == small.alpha and rows["t"]["backwards"] == 1
    assert all(r["signal_ratio"] + r["wasted_fraction"] == pytest.approx(1) for r in rows.values())


def test_renaming_models_changes_nothing(spark):
    ids, rows = twelve()
    a = analyze(responses(spark, ids, rows)).items.select("item_id", "point_biserial", "backwards_p").orderBy("item_id").collect()
    b = analyze(responses(spark, ids, {f"x{k}": v for k, v in enumerate(rows.values())})).items.select("item_id", "point_biserial", "backwards_p").orderBy("item_id").collect()
    assert a == b


def test_arguments_are_checked_in_order(spark):
    one = responses(spark, ["a", "b"], {"m": [1, 0]})
    with pytest.raises(ValueError, match="backwards_fdr must be between 0 and 1"):
        analyze(one, 0)
    with pytest.raises(ValueError, match="at least 2 models"):
        analyze(one)
    with pytest.raises(ValueError, match="at least 2 items"):
        analyze(responses(spark, ["a"], {"m": [1], "n": [0]}))


def test_html_is_escaped_and_self_contained(spark):
    page = to_html(analyze(responses(spark, ["<script>alert(1)</script>", "b"], {"m": [1, 0], "n": [0, 1]})), title="Injection <test>")
    assert page.startswith("<!doctype html>")
    assert "<script>" not in page and "&lt;script&gt;" in page and "Injection &lt;test&gt;" in page
    assert "http://" not in page and "https://" not in page and "//cdn" not in page


@pytest.mark.parametrize(
    ("change", "said"),
    [("CASE WHEN model_idx = 0 AND item_idx = 0 THEN 7 ELSE passed END", "1 cells are not 0 or 1"), ("CASE WHEN item_idx = 1 THEN NULL ELSE passed END", "cells are not 0 or 1")],
)
def test_cells_are_checked(spark, change, said):
    rows = responses(spark, *twelve())
    with pytest.raises(ValueError, match=said):
        analyze(rows.withColumn("passed", F.expr(change).cast("int")))


def test_ragged_and_repeated_cells_are_refused(spark):
    rows = responses(spark, *twelve())
    with pytest.raises(ValueError, match="0 repeated, 1 missing"):
        analyze(rows.where("NOT (model_idx = 2 AND item_idx = 1)"))
    with pytest.raises(ValueError, match="1 repeated, 0 missing"):
        analyze(rows.union(rows.where("model_idx = 2 AND item_idx = 1")))


def test_diagnosis_of_every_kind(spark):
    got = {r["verdict"]: r["said"] for r in analyze(responses(spark, *demo())).items.select("verdict", diagnosis().alias("said")).collect()}
    assert "grader" in got["backwards"] and "(p=0.0025)" in got["backwards"] and "(r=" in got["strong"]
    dead = {r[0] for r in analyze(responses(spark, *demo())).dead_items().select(diagnosis()).collect()}
    assert {x[:5] for x in dead} == {"Every", "None "}


def test_release_frees_storage_and_tables_stay_usable(spark):
    held = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    report = analyze(responses(spark, SMALL_ITEMS, SMALL))
    first = report.items.orderBy("item_idx").collect()
    assert held() > before
    report.release()
    assert held() == before
    assert report.items.orderBy("item_idx").collect() == first
