"""Registered queries of the item analysis, each with its SQL twin.

Real numbers are rounded to nine digits on both sides; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import detectable
from ..operators import items as it
from ..operators import study, suites
from ..operators.inference import tail_method
from ..sources import ingest, results_tree
from .analysis import Analysis, cohort_sweep, plan
from .demo import demo_responses
from .rendering import diagnosis
from .fixtures import NATION, SUPPLIER, matrix, matrix_sql, raters, raters_sql, tables

Query = Callable[[SparkSession, str], DataFrame]
FDR, RESAMPLES = 0.05, study.RESAMPLES
COHORTS = (5, 10, 25)


def r9(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir, NATION).persist()


def _moments(spark: SparkSession, sf_dir: str, key: str = NATION) -> DataFrame:
    return it.item_moments(matrix(spark, sf_dir, key))


def _plan(spark: SparkSession, sf_dir: str, key: str = NATION) -> Analysis:
    return plan(matrix(spark, sf_dir, key).persist(), FDR)


# ---- item and suite statistics -------------------------------------------


def model_totals(spark, sf_dir):
    return it.model_totals(_nation(spark, sf_dir)).select("model_idx", "model", "total")


def difficulty(spark, sf_dir):
    return _moments(spark, sf_dir).select("item_id", "k", "n", r9(it.difficulty()).alias("difficulty"))


def item_variance(spark, sf_dir):
    return _moments(spark, sf_dir).select("item_id", r9(it.item_variance()).alias("variance"))


def point_biserial(spark, sf_dir):
    return _moments(spark, sf_dir).select("item_id", r9(it.correlation()).alias("r"), r9(it.correlation(undefined=None)).alias("pearson"))


def point_biserial_raw(spark, sf_dir):
    return _moments(spark, sf_dir).select("item_id", r9(it.correlation(corrected=False)).alias("r"))


def discrimination_index(spark, sf_dir):
    return _moments(spark, sf_dir, SUPPLIER).select("item_id", "extreme", r9(it.discrimination()).alias("d"))


def _reliability(spark, sf_dir):
    resp = _nation(spark, sf_dir)
    return suites.reliability(it.item_moments(resp), it.model_totals(resp))


def cronbach_alpha(spark, sf_dir):
    return _reliability(spark, sf_dir).select("n_items", "n_models", r9("alpha").alias("alpha"))


def sem(spark, sf_dir):
    return _reliability(spark, sf_dir).select(r9("sem").alias("sem"))


def min_real_gap(spark, sf_dir):
    levels = F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), suites.real_gap(F.col("sem"), c).alias("gap")) for c in (0.68, 0.80, 0.90, 0.95, 0.99)]))
    return _reliability(spark, sf_dir).select(levels.alias("g")).select("g.confidence", r9("g.gap").alias("gap"))


# ---- inference -----------------------------------------------------------


def _tested(spark, sf_dir, key=NATION):
    return _plan(spark, sf_dir, key).items


def backwards_p_exact(spark, sf_dir):
    return _tested(spark, sf_dir).where("p_method = 'exact'").select("item_id", r9("backwards_p").alias("p"))


def backwards_p_normal(spark, sf_dir):
    return _tested(spark, sf_dir, SUPPLIER).where("p_method = 'normal'").select("item_id", r9("backwards_p").alias("p"))


def backwards_p_method(spark, sf_dir):
    return _moments(spark, sf_dir, SUPPLIER).select("item_id", tail_method().alias("method"))


def benjamini_hochberg(spark, sf_dir):
    return _tested(spark, sf_dir).select("item_id", "backwards_significant")


def verdicts(spark, sf_dir):
    return _tested(spark, sf_dir).select("item_id", "verdict", r9("point_biserial").alias("r"), r9("discrimination").alias("d"), r9("backwards_p").alias("p"))


def detectability(spark, sf_dir):
    n = spark.range(1, 200).select(F.col("id").cast("int").alias("n_models"))
    return n.select("n_models", detectable(F.col("n_models"), FDR).alias("detectable"))


# ---- selections ----------------------------------------------------------


def _chosen(*names: str) -> Query:
    return lambda spark, sf_dir: suites.with_verdict(_tested(spark, sf_dir), *names).select("item_idx", "item_id")


def suspicious_items(spark, sf_dir):
    return suites.suspicious(_tested(spark, sf_dir, SUPPLIER)).select("item_id", r9("point_biserial").alias("r"), r9("backwards_p").alias("p"))


def ranked_items(spark, sf_dir):
    return suites.ranked(_moments(spark, sf_dir).withColumn("point_biserial", it.correlation())).limit(20).select("item_id", r9("point_biserial").alias("r"))


def suite_summary(spark, sf_dir):
    found = suites.healthy(_plan(spark, sf_dir).summary)
    counts = ["n_items", "n_models", "dead", "dead_all_pass", "dead_none_pass", "backwards", "weak", "acceptable", "strong", "suspicious", "healthy"]
    return found.select(*counts, *[r9(c).alias(c) for c in ("alpha", "sem", "min_real_gap", "signal_ratio", "wasted_fraction")])


def dead_split(spark, sf_dir):
    dead = suites.with_verdict(_tested(spark, sf_dir), "dead")
    return dead.select("item_id", F.when(F.col("k") == F.col("n"), "all").otherwise("none").alias("passes"))


def separates_adjacent(spark, sf_dir):
    done = _plan(spark, sf_dir)
    return suites.adjacent_pairs(done.totals, done.summary).select("place", "model_a", "model_b", "gap", "real")


def tied_for_first(spark, sf_dir):
    done = _plan(spark, sf_dir)
    return suites.tied_for_first(done.totals, done.summary).select("model", "total")


def two_raters(spark, sf_dir):
    done = plan(raters(spark, sf_dir).persist(), FDR)
    return done.items.groupBy("verdict", "p_method").agg(F.count(F.lit(1)).alias("n_items"), F.sum("k").alias("passes"))


def indistinct_pairs(spark, sf_dir):
    """Neighbours in the ranking that noise explains, counted; and the band of the suite's reliability."""
    done = _plan(spark, sf_dir)
    pairs = suites.adjacent_pairs(done.totals, done.summary).groupBy("suite_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("real")).alias("n_indistinct"))
    return pairs.join(done.summary.select("suite_id", "alpha_band"), "suite_id").select("n_pairs", "n_indistinct", "alpha_band")


def diagnoses(spark, sf_dir):
    """Each item's reading, up to its first figure."""
    said = F.regexp_extract(diagnosis(), "^[^0-9(]*", 0).alias("said")
    return _tested(spark, sf_dir).select("item_id", said)


def weak_supplier_items(spark, sf_dir):
    return suites.with_verdict(_tested(spark, sf_dir, SUPPLIER), "weak").select("item_id", r9("point_biserial").alias("r"))


def score_arrays(spark, sf_dir):
    """Responses from one array of scores a model."""
    resp = _nation(spark, sf_dir)
    cells = F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "passed"))), lambda c: c["passed"])
    arrays = resp.groupBy("model_idx", "model").agg(cells.alias("scores"))
    items = resp.select("item_idx", "item_id").distinct()
    return ingest.responses_from_scores(spark, items, arrays, "s").select("model_idx", "model", "item_idx", "item_id", "passed")


def json_items(spark, sf_dir):
    """Items from rows given as dictionaries, in their order."""
    part = tables(spark, sf_dir, "nation")["nation"].orderBy("n_nationkey").collect()
    rows = [{"id": r["n_nationkey"], "prompt": r["n_name"], "tags": [str(r["n_regionkey"])], "region": r["n_regionkey"]} for r in part]
    got = ingest.items_from_dicts(spark, rows, "s")
    return got.select("item_idx", "item_id", "prompt", F.array_join("tags", ",").alias("tags"), F.to_json("meta").alias("meta"))


def null_summary(spark, sf_dir):
    """The summary of a given null distribution: as many as a nation has customers, against 5."""
    null = tables(spark, sf_dir, "customer")["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("backwards"))
    told = study.null_summary(null, 5)
    return told.select(r9("null_mean").alias("null_mean"), r9("null_sd").alias("null_sd"), "null_min", "null_max", r9("p").alias("p"))


def tree_matrix(spark, sf_dir):
    """The matrix of submissions and the items that they resolved."""
    orders = tables(spark, sf_dir, "orders")["orders"].where("o_orderkey % 3 = 0")
    found = orders.select((F.col("o_custkey") % 9).cast("string").alias("submission"), (F.col("o_orderkey") % 40).cast("string").alias("item_id")).distinct()
    items = spark.range(45).select(F.col("id").cast("int").alias("item_idx"), F.col("id").cast("string").alias("item_id"))
    got = results_tree.matrix(found.select("submission"), items, found)
    return got.select("model_idx", "model", "item_idx", "item_id", "passed")


def demo_grid(spark, sf_dir):
    """The demonstration's responses, of which every table size has the same."""
    return demo_responses(spark).select("model_idx", "item_idx", "item_id", "passed")


# ---- ingest --------------------------------------------------------------

RECORDS = """
records AS (
  SELECT 's' AS suite_id, 'quality' AS model, CAST(doc_id AS {t}) AS item_id, quality AS passed, doc_id AS ord FROM labels
  UNION ALL SELECT 's', 'toxic', CAST(doc_id AS {t}), toxic, doc_id + 1000000 FROM labels
  UNION ALL SELECT 's', 'toxic', CAST(doc_id AS {t}), 1 - toxic, doc_id + 2000000 FROM labels WHERE doc_id % 7 = 0),
items AS (SELECT 's' AS suite_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS item_idx, CAST(doc_id AS {t}) AS item_id FROM labels)"""


def _records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from .fixtures import run_sql

    text = RECORDS.format(t="STRING")
    return tuple(run_sql(spark, sf_dir, f"WITH {text} SELECT * FROM {name}", "labels") for name in ("records", "items"))


def from_records(spark, sf_dir):
    records, items = _records(spark, sf_dir)
    return ingest.responses_from_records(records, items, F.col("ord")).select("model_idx", "model", "item_idx", "item_id", "passed")


def missing_cells(spark, sf_dir):
    records, items = _records(spark, sf_dir)
    found = ingest.missing_cells(records.where("NOT (model = 'toxic' AND ord % 11 = 0)"), items)
    return found.select("model", "n_missing", F.array_join("first_missing", ",").alias("first_missing"))


def unknown_items(spark, sf_dir):
    records, items = _records(spark, sf_dir)
    return ingest.unknown_items(records, items.where("item_idx % 5 <> 0")).select("model", "item_id", "ord")


def duplicate_ids(spark, sf_dir):
    part = tables(spark, sf_dir, "part")["part"]
    return ingest.duplicate_ids(part.select(F.lit("s").alias("suite_id"), F.concat("p_brand", F.lit("/"), "p_type").alias("item_id"))).select("item_id", "copies")


ITEM_JSON = """concat('{"id": ', event_id, ', "prompt": "', event_type, '", "tags": ["', event_type, '", "e"], ', substr(props, 2))"""


def item_json_decode(spark, sf_dir):
    events = tables(spark, sf_dir, "events")["events"].select("event_id", F.expr(ITEM_JSON).alias("value"))
    got = ingest.decode_items(events)
    return got.select("event_id", "item_id", "prompt", F.array_join("tags", ",").alias("tags"), F.size("meta").cast("long").alias("n_meta"), F.to_json("meta").alias("meta"))


# ---- studies -------------------------------------------------------------


def cohort_sweep_query(spark, sf_dir):
    told = cohort_sweep(_nation(spark, sf_dir), COHORTS, FDR)
    counts = ["cohort", "n_items", "n_models", "dead", "dead_all_pass", "dead_none_pass", "backwards", "suspicious", "detectable"]
    return told.select(*counts, r9("sem").alias("sem"), r9("gap_points").alias("gap_points"))


def trim_rank_agreement(spark, sf_dir):
    resp = _nation(spark, sf_dir)
    done = plan(resp, FDR)
    told = study.trimmed_agreement(resp, done.totals, done.items, {"non-dead": suites.USEFUL, "informative": ("acceptable", "strong")})
    return told.select("kept", "n_kept", r9("spearman").alias("spearman"))


def spearman(spark, sf_dir):
    suppliers = tables(spark, sf_dir, "supplier")["supplier"].select(F.lit("s").alias("suite_id"), F.col("s_suppkey").alias("model_idx"), F.col("s_nationkey").alias("a"), "s_acctbal")
    return study.spearman(suppliers, "a", "s_acctbal").select("n", F.col("d2").cast("long").alias("d2"), r9("spearman").alias("spearman"))


def bootstrap_winners(spark, sf_dir):
    resp = _nation(spark, sf_dir)
    items = resp.agg(F.count_distinct("item_idx")).first()[0]
    return study.bootstrap_winners(resp, items, RESAMPLES).select("model_idx", "model", "wins", r9("share").alias("share")).orderBy(F.col("wins").desc(), "model_idx").limit(8)


def old_rule(spark, sf_dir):
    return suites.old_rule_backwards(_moments(spark, sf_dir, SUPPLIER)).select("old_rule_backwards")


def curveball_null(spark, sf_dir, reps: int = study.RANDOMISATIONS, trades: int = study.TRADES):
    resp = _nation(spark, sf_dir)
    return study.curveball_null(resp, reps, trades)


def repo_mode(spark, sf_dir):
    told = tables(spark, sf_dir, "orders")["orders"].select(F.concat(F.col("o_orderpriority"), F.lit("/x")).alias("repo"), (F.col("o_custkey") % 7).alias("total"))
    return results_tree.usual_totals(told)


def ghost_items(spark, sf_dir):
    part = tables(spark, sf_dir, "part")["part"]
    items = part.select(F.concat("p_brand", F.lit("__"), F.col("p_partkey").cast("string")).alias("item_id"))
    most = part.groupBy("p_brand").count().agg(F.max("count").alias("m"))
    totals = part.select(F.concat("p_brand", F.lit("/"), F.lit("x")).alias("repo")).distinct().join(most).select("repo", (F.col("m") + 1).alias("total"))
    return results_tree.ghost_items(items, totals)


QUERIES: dict[str, Query] = {
    "model_totals": model_totals,
    "difficulty": difficulty,
    "item_variance": item_variance,
    "point_biserial": point_biserial,
    "point_biserial_raw": point_biserial_raw,
    "discrimination_index": discrimination_index,
    "cronbach_alpha": cronbach_alpha,
    "sem": sem,
    "min_real_gap": min_real_gap,
    "backwards_p_exact": backwards_p_exact,
    "backwards_p_normal": backwards_p_normal,
    "backwards_p_method": backwards_p_method,
    "benjamini_hochberg": benjamini_hochberg,
    "verdicts": verdicts,
    "detectability": detectability,
    "dead_items": _chosen("dead"),
    "backwards_items": _chosen("backwards"),
    "weak_items": _chosen("weak"),
    "strong_items": _chosen("strong"),
    "keep_list": _chosen("acceptable", "strong"),
    "dead_split": dead_split,
    "suspicious_items": suspicious_items,
    "ranked_items": ranked_items,
    "suite_summary": suite_summary,
    "separates_adjacent": separates_adjacent,
    "tied_for_first": tied_for_first,
    "two_raters": two_raters,
    "indistinct_pairs": indistinct_pairs,
    "diagnoses": diagnoses,
    "weak_supplier_items": weak_supplier_items,
    "score_arrays": score_arrays,
    "json_items": json_items,
    "null_summary": null_summary,
    "tree_matrix": tree_matrix,
    "demo_grid": demo_grid,
    "from_records": from_records,
    "missing_cells": missing_cells,
    "unknown_items": unknown_items,
    "duplicate_ids": duplicate_ids,
    "item_json_decode": item_json_decode,
    "cohort_sweep": cohort_sweep_query,
    "trim_rank_agreement": trim_rank_agreement,
    "spearman": spearman,
    "bootstrap_winners": bootstrap_winners,
    "old_rule_backwards": old_rule,
    "curveball_null": curveball_null,
    "repo_mode": repo_mode,
    "ghost_items": ghost_items,
}
