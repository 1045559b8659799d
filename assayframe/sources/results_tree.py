"""From a tree of submissions' result files to a matrix, and the matrix file.

A submission is a folder with results/results.json ({"resolved": [ids]}), and
perhaps results/resolved_by_repo.json ({repo: {"total": n}}) and metadata.yaml
(a line "name: ..."): what no submission resolved is nowhere listed and is
filled in from the repositories' totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _files(spark: SparkSession, root: str, pattern: str, depth: int) -> DataFrame:
    """(submission, value): whole files, and the folder name that many levels above."""
    got = spark.read.text(f"{root}/{pattern}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return got.select(F.element_at(F.split("path", "/"), -depth).alias("submission"), "value")


def resolved(spark: SparkSession, root: str) -> DataFrame:
    """(submission, item_id) of resolved items."""
    told = _files(spark, root, "*/results/results.json", 3)
    return told.select("submission", F.explode(F.from_json("value", "resolved array<string>")["resolved"]).alias("item_id")).distinct()


def repo_totals(spark: SparkSession, root: str) -> DataFrame:
    """(submission, repo, total) as each submission tells it."""
    told = _files(spark, root, "*/results/resolved_by_repo.json", 3)
    return told.select("submission", F.explode(F.from_json("value", "map<string,struct<total:bigint>>")).alias("repo", "v")).select("submission", "repo", F.col("v.total").alias("total"))


def display_names(spark: SparkSession, root: str, submissions: DataFrame) -> DataFrame:
    """(submission, label): the metadata's name, else the folder's."""
    told = _files(spark, root, "*/metadata.yaml", 2)
    name = F.regexp_extract("value", r"(?m)^name:[ \t]*[\"']*(.*?)[\"']*[ \t]*$", 1)
    told = told.select("submission", F.nullif(name, F.lit("")).alias("name"))
    return submissions.join(told, "submission", "left").select("submission", F.coalesce("name", "submission").alias("label"))


def usual_totals(told: DataFrame) -> DataFrame:
    """Each repository's most frequent total; of equally frequent ones the smallest."""
    return told.groupBy("repo").agg(F.mode("total", True).alias("total"))


def ghost_items(items: DataFrame, totals: DataFrame, expected: int | None = None) -> DataFrame:
    """Ids for the items of each repository that nobody resolved, numbered from 01.

    ``items`` has item_id with the prefix "owner__"; ``totals`` has repo ("owner/name") and total.
    """
    if expected is not None:
        total = totals.agg(F.sum("total")).first()[0]
        if total != expected:
            raise ValueError(f"per-repo totals sum to {total}, expected {expected}")
    seen = items.groupBy(F.split("item_id", "__")[0].alias("owner")).agg(F.count(F.lit(1)).alias("seen"))
    both = totals.withColumn("owner", F.split("repo", "/")[0]).join(seen, "owner", "left").withColumn("missing", F.col("total") - F.coalesce("seen", F.lit(0)))
    odd = both.where("missing < 0").orderBy("repo").first()
    if odd is not None:
        raise ValueError(f"{odd['repo']}: more resolved than exist")
    number = F.explode(F.sequence(F.lit(1), F.col("missing").cast("int"))).alias("k")
    spread = both.where("missing > 0").select("repo", number)
    return spread.select("repo", F.concat(F.replace("repo", F.lit("/"), F.lit("__")), F.lit("__UNSOLVED-"), F.format_string("%02d", "k")).alias("item_id"))


def matrix(submissions: DataFrame, items: DataFrame, found: DataFrame, suite_id: str = "suite") -> DataFrame:
    """Responses: 1 where a submission resolved the item, else 0.  Order by name and id."""
    models = submissions.select("submission").distinct().withColumn("model_idx", (F.row_number().over(Window.orderBy("submission")) - 1).cast("int"))
    grid = models.crossJoin(items.select("item_idx", "item_id"))  # the result itself is this grid
    return grid.join(found.withColumn("hit", F.lit(1)), ["submission", "item_id"], "left").select(
        F.lit(suite_id).alias("suite_id"), "model_idx", F.col("submission").alias("model"), "item_idx", "item_id", F.coalesce("hit", F.lit(0)).alias("passed")
    )


def read_matrix(spark: SparkSession, path: str, suite_id: str = "suite") -> DataFrame:
    """Responses from a matrix file: one JSON object with item_ids and scores by model."""
    doc = spark.read.schema("item_ids array<string>, scores map<string,array<int>>").json(path, multiLine=True)
    cells = doc.select("item_ids", F.explode("scores").alias("model", "row"))
    order = F.dense_rank().over(Window.orderBy("model")) - 1
    rows = cells.withColumn("model_idx", order.cast("int")).select("model_idx", "model", "item_ids", F.posexplode("row").alias("item_idx", "passed"))
    return rows.select(F.lit(suite_id).alias("suite_id"), "model_idx", "model", "item_idx", F.get("item_ids", F.col("item_idx")).alias("item_id"), "passed")


def write_matrix(responses: DataFrame, path: str) -> None:
    """A matrix as rows (model, scores in suite order) of JSON, one folder of part files."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "passed"))), lambda c: c["passed"])
    responses.groupBy("suite_id", "model_idx", "model").agg(ordered.alias("scores")).write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Tree:
    """A tree of results as a suite: its responses, the labels of its submissions, and its items, of which ``unsolved`` are nobody's."""

    responses: DataFrame
    labels: DataFrame
    items: DataFrame


def read_tree(spark: SparkSession, root: str, expected: int | None = None, suite_id: str = "suite") -> Tree:
    """The whole way from a tree to a suite: resolved items in the order of their ids, then the unsolved ones of each repository.

    ``expected`` is the number of items that repositories' totals, and the suite, must have.
    """
    folders = _files(spark, root, "*/results/results.json", 3).select("submission")
    if folders.isEmpty():
        raise ValueError(f"{root}: no submission has results")
    found = resolved(spark, root)
    known = found.select("item_id").distinct()
    unsolved = ghost_items(known, usual_totals(repo_totals(spark, root)), expected)
    both = known.select(F.lit("").alias("repo"), "item_id", F.lit(False).alias("unsolved")).unionByName(unsolved.select("repo", "item_id", F.lit(True).alias("unsolved")))
    # numbers of more than two digits are longer, and come later
    order = Window.orderBy("unsolved", "repo", F.when(F.col("unsolved"), F.length("item_id")).otherwise(0), "item_id")
    items = both.select((F.row_number().over(order) - 1).cast("int").alias("item_idx"), "item_id", "unsolved")
    if expected is not None and (n := items.count()) != expected:
        raise ValueError(f"the tree gives {n} items, expected {expected}")
    return Tree(matrix(folders, items, found, suite_id), display_names(spark, root, folders), items)


def write_matrix_file(tree: Tree, path: str) -> None:
    """A suite as one JSON object (item_ids, n_never_solved, names, scores by model), which ``read_matrix`` reads again.

    The object is one row, so it is for one suite; ``write_matrix`` has a row for each model.
    """
    whole = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    row = F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "passed"))), lambda c: c["passed"])
    scores = tree.responses.groupBy("model").agg(row.alias("row")).agg(whole("model", "row").alias("scores"))
    names = tree.labels.agg(whole("submission", "label").alias("names"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "item_id"))), lambda c: c["item_id"])
    items = tree.items.agg(ids.alias("item_ids"), F.count_if("unsolved").alias("n_never_solved"))
    items.join(names).join(scores).coalesce(1).write.mode("overwrite").json(path)  # one row each
