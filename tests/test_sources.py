import json

import pytest
from pyspark.sql import functions as F

from assayframe import items_from_dicts, items_from_jsonl, responses_from_records, responses_from_scores
from assayframe.sources import results_tree as tree


def suite(spark, *ids):
    return items_from_dicts(spark, [{"id": i} for i in ids])


def test_jsonl_keeps_order_and_overflow(spark, tmp_path):
    p = tmp_path / "suite.jsonl"
    p.write_text('{"id": 7, "prompt": "q", "tags": null, "difficulty": "hard"}\n\n  \n{"id": "b", "tags": ["x", "y"], "n": 3}\n{"id": "c", "tags": "xy"}\n')
    rows = items_from_jsonl(spark, str(p)).orderBy("item_idx").select("item_id", "prompt", "tags", F.to_json("meta").alias("meta")).collect()
    assert [tuple(r) for r in rows] == [("7", "q", [], '{"difficulty":"hard"}'), ("b", "", ["x", "y"], '{"n":3}'), ("c", "", ["x", "y"], "{}")]


def test_jsonl_errors(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('\n{"id": "a"}\n{oops\n')
    with pytest.raises(ValueError, match=r"bad\.jsonl:3: invalid JSON"):
        items_from_jsonl(spark, str(bad))
    bad.write_text('{"prompt": "a"}\n')
    with pytest.raises(ValueError, match="missing required field 'id'"):
        items_from_jsonl(spark, str(bad))
    with pytest.raises(ValueError, match=r"duplicate item ids: \['1'\]"):
        items_from_dicts(spark, [{"id": 1}, {"id": "1"}])
    with pytest.raises(ValueError, match="missing required field 'id'"):
        items_from_dicts(spark, [{"prompt": "x"}])


def test_score_errors(spark):
    items = suite(spark, "a", "b")
    with pytest.raises(ValueError, match="no models in scores"):
        responses_from_scores(spark, items, {})
    with pytest.raises(ValueError, match="has 1 scores but the suite has 2 items"):
        responses_from_scores(spark, items, {"m": [1]})
    with pytest.raises(ValueError, match=r"non-binary scores: \[7\]"):
        responses_from_scores(spark, items, {"m": [1, 7]})


def test_records(spark):
    items = suite(spark, "a", "b")
    rows = [("z", "b", "false", 0), ("z", "a", "", 1), ("y", "a", "x", 2), ("y", "b", None, 3), ("z", "a", "yes", 4)]
    records = spark.createDataFrame(rows, "model string, item_id string, passed string, n int")
    got = responses_from_records(records, items, F.col("n")).orderBy("model_idx", "item_idx").collect()
    # the later record of a cell counts, any text but the empty one is a pass, null isn't; models by first place
    assert [(r["model_idx"], r["model"], r["item_id"], r["passed"]) for r in got] == [(0, "z", "a", 1), (0, "z", "b", 1), (1, "y", "a", 1), (1, "y", "b", 0)]


def test_record_errors(spark):
    items = suite(spark, "a", "b", "c", "d", "e", "f", "g")
    one = spark.createDataFrame([("m", "a", True, 0)], "model string, item_id string, passed boolean, n int")
    with pytest.raises(ValueError, match="record missing 'passed'"):
        responses_from_records(one.drop("passed"), items)
    with pytest.raises(ValueError, match="unknown item id 'q'"):
        responses_from_records(one.withColumn("item_id", F.lit("q")), items, F.col("n"))
    with pytest.raises(ValueError, match=r"has no result for 6 item\(s\): \['b', 'c', 'd', 'e', 'f'\] \.\.\."):
        responses_from_records(one, items, F.col("n"))


def test_results_tree(spark, tmp_path):
    told = {
        "s1": (["o__r-1", "o__r-2"], {"o/r": {"total": 3}}, 'name: "First"\n'),
        "s2": (["o__r-2", "p__q-9"], {"o/r": {"total": 3}, "p/q": {"total": 1}}, None),
        "s3": ([], {"o/r": {"total": 9}}, "x: 1\nname: Third  \n"),
    }
    for s, (done, totals, meta) in told.items():
        (tmp_path / s / "results").mkdir(parents=True)
        (tmp_path / s / "results" / "results.json").write_text(json.dumps({"resolved": done}))
        (tmp_path / s / "results" / "resolved_by_repo.json").write_text(json.dumps(totals, indent=1))
        if meta:
            (tmp_path / s / "metadata.yaml").write_text(meta)
    found = tree.resolved(spark, str(tmp_path))
    assert found.count() == 4
    totals = tree.usual_totals(tree.repo_totals(spark, str(tmp_path)))
    assert {r["repo"]: r["total"] for r in totals.collect()} == {"o/r": 3, "p/q": 1}
    union = found.select("item_id").distinct()
    ghosts = tree.ghost_items(union, totals, expected=4)
    assert [r["item_id"] for r in ghosts.collect()] == ["o__r__UNSOLVED-01"]
    with pytest.raises(ValueError, match="more resolved than exist"):
        tree.ghost_items(union, totals.withColumn("total", F.lit(1)))
    with pytest.raises(ValueError, match="expected 500"):
        tree.ghost_items(union, totals, expected=500)
    subs = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "submission string")
    assert {r["submission"]: r["label"] for r in tree.display_names(spark, str(tmp_path), subs).collect()} == {"s1": "First", "s2": "s2", "s3": "Third"}
    items = suite(spark, "o__r-1", "o__r-2", "p__q-9", "o__r__UNSOLVED-01")
    grid = tree.matrix(subs, items, found)
    assert grid.count() == 12 and grid.agg(F.sum("passed")).first()[0] == 4
    doc = {"item_ids": ["a", "b"], "names": {}, "scores": {"m": [1, 0], "k": [0, 1]}}
    (tmp_path / "matrix.json").write_text(json.dumps(doc, indent=1))
    got = tree.read_matrix(spark, str(tmp_path / "matrix.json")).orderBy("model", "item_idx").collect()
    assert [(r["model"], r["item_id"], r["passed"]) for r in got] == [("k", "a", 0), ("k", "b", 1), ("m", "a", 1), ("m", "b", 0)]
    tree.write_matrix(grid, str(tmp_path / "out"))
    assert {r["model"]: r["scores"] for r in spark.read.json(str(tmp_path / "out")).collect()}["s2"] == [0, 1, 1, 0]


def test_whole_tree_and_its_file(spark, tmp_path):
    told = {"b": (["o__r-2", "o__r-10"], 105, "name: 'Bee'\n"), "a": (["o__r-2"], 105, None), "c": ([], 9, None)}
    for s, (done, total, meta) in told.items():
        (tmp_path / "in" / s / "results").mkdir(parents=True)
        (tmp_path / "in" / s / "results" / "results.json").write_text(json.dumps({"resolved": done}))
        (tmp_path / "in" / s / "results" / "resolved_by_repo.json").write_text(json.dumps({"o/r": {"total": total}, "a/z": {"total": 1}}))
        (tmp_path / "in" / s / "metadata.yaml").write_text(meta or "x: 1\n")
    got = tree.read_tree(spark, str(tmp_path / "in"), expected=106)
    ids = ["o__r-10", "o__r-2", "a__z__UNSOLVED-01", *[f"o__r__UNSOLVED-{k:02d}" for k in range(1, 104)]]
    assert [r["item_id"] for r in got.items.orderBy("item_idx").collect()] == ids
    tree.write_matrix_file(got, str(tmp_path / "out"))
    (whole,) = spark.read.json(str(tmp_path / "out")).collect()
    assert whole["n_never_solved"] == 104 and whole["names"].asDict() == {"a": "a", "b": "Bee", "c": "c"}
    again = tree.read_matrix(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.responses.collect())) and again.count() == 318
    assert again.groupBy("model").agg(F.sum("passed").alias("n")).orderBy("model").collect() == [("a", 1), ("b", 2), ("c", 0)]
    with pytest.raises(ValueError, match="expected 500"):
        tree.read_tree(spark, str(tmp_path / "in"), expected=500)


def test_more_than_99_missing_items(spark):
    none = spark.createDataFrame([], "item_id string")
    ghosts = tree.ghost_items(none, spark.createDataFrame([("x/y", 120)], "repo string, total int"))
    assert sorted(r["item_id"] for r in ghosts.collect()) == sorted(f"x__y__UNSOLVED-{k:02d}" for k in range(1, 121))
