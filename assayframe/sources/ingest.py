"""Reading and validating items and outcomes.

Checks are aggregates that raise on the driver, where the message can name what
is wrong; nothing but the few offending rows is brought there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ITEMS, RESPONSES

KNOWN_KEYS = ("id", "prompt", "tags")
SHOWN = 5


# ---- items ---------------------------------------------------------------


def decode_items(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """Adds item_id, prompt, tags and meta (all other keys) from a JSON object column.

    An id of any type becomes a string; null tags are none, and a bare string of
    tags is split into characters.  Keys that a JSON object repeats are an error
    of the parser here.
    """
    doc = F.try_parse_json(F.col(json_col))
    fields = F.from_json(F.col(json_col), "map<string,variant>")
    tags = F.coalesce(
        F.try_variant_get(doc, "$.tags", "array<string>"),
        F.filter(F.split(F.try_variant_get(doc, "$.tags", "string"), ""), lambda c: c != ""),
        F.array().cast("array<string>"),
    )
    return rows.withColumns(
        {
            "item_id": F.try_variant_get(doc, "$.id", "string"),
            "prompt": F.coalesce(F.try_variant_get(doc, "$.prompt", "string"), F.lit("")),
            "tags": tags,
            "meta": F.map_filter(fields, lambda k, v: ~k.isin(*KNOWN_KEYS)),
        }
    )


def duplicate_ids(items: DataFrame) -> DataFrame:
    """Item ids that a suite has more than once."""
    return items.groupBy("suite_id", "item_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def checked_items(items: DataFrame) -> DataFrame:
    if not items.where("item_id IS NULL").isEmpty():
        raise ValueError("item missing required field 'id'")
    twice = [r["item_id"] for r in duplicate_ids(items).select("item_id").distinct().orderBy("item_id").limit(SHOWN).collect()]
    if twice:
        raise ValueError(f"duplicate item ids: {twice}")
    return items


def items_from_jsonl(spark: SparkSession, path: str, suite_id: str = "suite") -> DataFrame:
    """Items of a JSON-lines file; blank lines are skipped but keep their number.

    A file is read whole, for line numbers and order are its own.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("no", "line")).where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    bad = lines.where(F.try_parse_json("line").isNull()).orderBy("no").first()
    if bad is not None:
        raise ValueError(f"{path}:{bad['no'] + 1}: invalid JSON")
    return checked_items(_in_order(decode_items(lines, "line"), suite_id, "no"))


def items_from_dicts(spark: SparkSession, rows: Iterable[dict[str, Any]], suite_id: str = "suite") -> DataFrame:
    given = list(rows)
    if any("id" not in r for r in given):
        raise ValueError("item missing required field 'id'")
    texts = [(k, json.dumps(r | {"id": str(r["id"])})) for k, r in enumerate(given)]
    return checked_items(_in_order(decode_items(spark.createDataFrame(texts, "no int, value string")), suite_id, "no"))


def _in_order(rows: DataFrame, suite_id: str, order: str) -> DataFrame:
    """Numbers rows from 0 in order; a suite's definition, unlike its outcomes, is small."""
    idx = F.row_number().over(Window.orderBy(order)) - 1
    return rows.select(F.lit(suite_id).alias("suite_id"), idx.cast("int").alias("item_idx"), "item_id", "prompt", "tags", "meta").to(_schema(ITEMS))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


# ---- outcomes ------------------------------------------------------------


def truthy(outcome: Column, kind: str) -> Column:
    """1 for what counts as true: non-zero numbers, non-empty strings (so also "false"); null is 0."""
    yes = F.length(outcome) > 0 if kind == "string" else outcome.cast("double") != 0 if kind != "boolean" else outcome
    return F.when(F.coalesce(yes, F.lit(False)), 1).otherwise(0)


def last_wins(records: DataFrame, order: Column) -> DataFrame:
    """One record for each (suite, model, item): the last; ``first_seen`` is the model's first place."""
    return records.groupBy("suite_id", "model", "item_id").agg(F.max_by("passed", order).alias("passed"), F.min(order).alias("seen"))


def unknown_items(records: DataFrame, items: DataFrame) -> DataFrame:
    return records.join(items.select("suite_id", "item_id"), ["suite_id", "item_id"], "left_anti")


def missing_cells(records: DataFrame, items: DataFrame) -> DataFrame:
    """Models without a result for some item: how many, and the first five in suite order.

    Models of incomplete suites are found by counts; only those are laid out
    against the items.
    """
    sizes = items.groupBy("suite_id").agg(F.count(F.lit(1)).alias("size"))
    have = records.select("suite_id", "model", "item_id").distinct()
    partial = have.groupBy("suite_id", "model").agg(F.count(F.lit(1)).alias("has")).join(sizes, "suite_id").where("has < size").select("suite_id", "model")
    grid = partial.join(items.select("suite_id", "item_idx", "item_id"), "suite_id")
    absent = grid.join(have, ["suite_id", "model", "item_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("suite_id", "model").orderBy("item_idx"))
    shown = absent.withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("suite_id", "model")
    first = F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "item_id"))), lambda x: x["item_id"])
    counts = absent.groupBy("suite_id", "model").agg(F.count(F.lit(1)).alias("n_missing"))
    return counts.join(shown.agg(first.alias("first_missing")), ["suite_id", "model"])


def responses_from_records(records: DataFrame, items: DataFrame, order: Column | None = None, suite_id: str | None = None) -> DataFrame:
    """Responses from flat (model, item_id, passed) rows; of repeated cells the last in ``order`` counts."""
    lacking = [c for c in ("model", "item_id", "passed") if c not in records.columns]
    if lacking:
        raise ValueError(f"record missing {lacking[0]!r}")
    kind = dict(records.dtypes)["passed"]
    if suite_id is not None or "suite_id" not in records.columns:
        records = records.withColumn("suite_id", F.lit(suite_id or "suite"))
    order = F.monotonically_increasing_id() if order is None else order
    flat = records.select(
        "suite_id", F.col("model").cast("string").alias("model"), F.col("item_id").cast("string").alias("item_id"), truthy(F.col("passed"), kind).alias("passed"), order.alias("__order")
    )
    stranger = unknown_items(flat, items).first()
    if stranger is not None:
        raise ValueError(f"record refers to unknown item id {stranger['item_id']!r}")
    if flat.isEmpty():
        raise ValueError("no models in scores")
    cells = last_wins(flat, F.col("__order"))
    hole = missing_cells(cells, items).orderBy("model").first()
    if hole is not None:
        more = " ..." if hole["n_missing"] > SHOWN else ""
        raise ValueError(f"model {hole['model']!r} has no result for {hole['n_missing']} item(s): {hole['first_missing']}{more}")
    models = cells.groupBy("suite_id", "model").agg(F.min("seen").alias("seen"))
    models = models.withColumn("model_idx", (F.row_number().over(Window.partitionBy("suite_id").orderBy("seen", "model")) - 1).cast("int")).drop("seen")
    placed = cells.join(items.select("suite_id", "item_idx", "item_id"), ["suite_id", "item_id"]).join(models, ["suite_id", "model"])
    return placed.select("suite_id", "model_idx", "model", "item_idx", "item_id", "passed").to(_schema(RESPONSES))


def responses_from_scores(spark: SparkSession, items: DataFrame, scores: dict[str, list[int]] | DataFrame, suite_id: str = "suite") -> DataFrame:
    """Responses from one array of 0/1 a model, in suite order."""
    if not isinstance(scores, DataFrame):
        if not scores:
            raise ValueError("no models in scores")
        for model, row in scores.items():
            bad = {s for s in row if s not in (0, 1)}
            if bad:
                raise ValueError(f"model {model!r} has non-binary scores: {sorted(bad)!r}")
        rows = [(k, str(m), [int(v) for v in row]) for k, (m, row) in enumerate(scores.items())]
        scores = spark.createDataFrame(rows, "model_idx int, model string, scores array<int>")
    size = items.count()
    wrong = scores.where(F.size("scores") != size).orderBy("model_idx").first()
    if wrong is not None:
        raise ValueError(f"model {wrong['model']!r} has {len(wrong['scores'])} scores but the suite has {size} items")
    wrong = scores.where(F.exists("scores", lambda s: s.isNull() | ~s.isin(0, 1))).orderBy("model_idx").first()
    if wrong is not None:
        raise ValueError(f"model {wrong['model']!r} has non-binary scores")
    cells = scores.select("model_idx", "model", F.posexplode("scores").alias("item_idx", "passed"))
    placed = cells.join(items.select("item_idx", "item_id"), "item_idx").withColumn("suite_id", F.lit(suite_id))
    return placed.select("suite_id", "model_idx", "model", "item_idx", "item_id", "passed").to(_schema(RESPONSES))


def check_analysable(responses: DataFrame) -> None:
    """At least two models, then two items, in every suite, and one cell of 0 or 1 for each model and item: one aggregate."""
    suites = responses.groupBy("suite_id").agg(
        F.count_distinct("model_idx").alias("m"),
        F.count_distinct("item_idx").alias("i"),
        F.count_distinct("model_idx", "item_idx").alias("cells"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(~F.col("passed").isin(0, 1), F.lit(True))).alias("other"),
    )
    told = suites.agg(
        F.min("m").alias("m"), F.min("i").alias("i"), F.sum("other").alias("other"),
        F.sum(F.col("rows") - F.col("cells")).alias("repeated"), F.sum(F.col("m") * F.col("i") - F.col("cells")).alias("missing"),
    ).first()
    if (told["m"] or 0) < 2:
        raise ValueError("item analysis needs at least 2 models to compare")
    if (told["i"] or 0) < 2:
        raise ValueError("need at least 2 items to analyse a suite")
    if told["other"]:
        raise ValueError(f"{told['other']} cells are not 0 or 1")
    if told["repeated"] or told["missing"]:
        raise ValueError(f"every model needs one cell an item: {told['repeated']} repeated, {told['missing']} missing")
