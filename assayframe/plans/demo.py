"""A small suite with planted defects, to see an analysis at work: ``python -m assayframe.plans.demo [report.html]``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import analyze
from .rendering import to_html, to_text

# fixed values: the models' abilities
ABILITIES = (0.94, 0.91, 0.88, 0.82, 0.78, 0.71, 0.66, 0.59, 0.51, 0.45, 0.36, 0.28)
#: Families of items in suite order, how many, and when a model passes the i-th.
FAMILIES = (("smoke", 12, "true"), ("frontier", 5, "false"), ("reasoning", 20, "ability > 0.25D + 0.03D * i"), ("format", 3, "ability < 0.6D"))


def demo_responses(spark: SparkSession) -> DataFrame:
    """Responses of twelve models to forty items: all pass the first family, none the second, the third tells models apart, the last is inverted."""
    models = spark.createDataFrame([(k, f"model-{k:02d}", a) for k, a in enumerate(ABILITIES)], "model_idx int, model string, ability double")
    rules = "CASE family " + " ".join(f"WHEN '{name}' THEN {rule}" for name, _, rule in FAMILIES) + " END"
    ids = [(name, i) for name, n, _ in FAMILIES for i in range(n)]
    items = spark.createDataFrame([(k, name, i) for k, (name, i) in enumerate(ids)], "item_idx int, family string, i int")
    grid = models.crossJoin(items)  # the result itself is this grid
    return grid.select(F.lit("demo").alias("suite_id"), "model_idx", "model", "item_idx", F.concat_ws("-", "family", "i").alias("item_id"), F.expr(rules).cast("int").alias("passed"))


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("demo").getOrCreate()
    report = analyze(demo_responses(spark))
    print(to_text(report))
    kept = [r["item_id"] for r in report.keep_list().select("item_id").collect()]
    print(f"\n{len(kept)} of {report.n_items} items are worth keeping, which saves {1 - len(kept) / report.n_items:.0%} of a run: {', '.join(kept)}")
    if argv:
        with open(argv[0], "w", encoding="utf-8") as f:
            f.write(to_html(report))
    report.release()


if __name__ == "__main__":
    main(sys.argv[1:])
