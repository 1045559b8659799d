"""Response matrices derived from general tables, for queries that can be checked in SQL.

Models are groups of suppliers, items are pairs of brand and type; a model passes
an item when it moved more than the median model did.  Some items are made dead
and some inverted on purpose.  The SQL is the same for Spark and the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Model keys: nations, and two hundred groups of suppliers.
NATION, SUPPLIER = "s_nationkey", "s_suppkey % 200"


def matrix_sql(model_key: str, text: str = "STRING") -> str:
    """suite_id, model_idx, model, item_idx, item_id, passed; ``text`` is the dialect's name of strings."""
    return f"""
cell AS (
  SELECT s.{model_key} AS model_key, concat(p.p_brand, '/', p.p_type) AS item_id, sum(l.l_quantity) AS q
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2),
model_dim AS (SELECT model_key, CAST(row_number() OVER (ORDER BY model_key) - 1 AS INT) AS model_idx FROM (SELECT DISTINCT {model_key} AS model_key FROM supplier)),
item_dim AS (SELECT item_id, p_brand, p_type, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS item_idx
             FROM (SELECT DISTINCT concat(p_brand, '/', p_type) AS item_id, p_brand, p_type FROM part)),
grid AS (
  SELECT m.model_key, m.model_idx, i.*, coalesce(c.q, CAST(0 AS DOUBLE)) AS q
  FROM model_dim m CROSS JOIN item_dim i LEFT JOIN cell c ON c.model_key = m.model_key AND c.item_id = i.item_id),
h AS (SELECT *, median(q) OVER (PARTITION BY item_id) AS med FROM grid),
resp AS (
  SELECT 's' AS suite_id, model_idx, CAST(model_key AS {text}) AS model, item_idx, item_id,
    CAST(CASE WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'PROMO' AND p_brand <> 'Brand#1' THEN 0
         WHEN p_brand = 'Brand#7' THEN CASE WHEN q <= med THEN 1 ELSE 0 END ELSE CASE WHEN q > med THEN 1 ELSE 0 END END AS INT) AS passed
  FROM h)"""


def raters_sql(text: str = "STRING") -> str:
    """Two raters over labelled documents: the least number of models."""
    return f"""
resp AS (
  SELECT 's' AS suite_id, r.model_idx, r.model, CAST(dense_rank() OVER (ORDER BY doc_id) - 1 AS INT) AS item_idx, CAST(doc_id AS {text}) AS item_id,
         CASE WHEN r.model = 'quality' THEN quality ELSE toxic END AS passed
  FROM labels CROSS JOIN (SELECT 0 AS model_idx, 'quality' AS model UNION ALL SELECT 1, 'toxic') r)"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def run_sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """SQL over the named tables, without leaving views behind."""
    import re

    given = tables(spark, sf_dir, *names)
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **given)


def matrix(spark: SparkSession, sf_dir: str, model_key: str = NATION) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH {matrix_sql(model_key)} SELECT * FROM resp", "lineitem", "supplier", "part")


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH {raters_sql()} SELECT * FROM resp", "labels")
