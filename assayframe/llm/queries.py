"""The thin query of each operator, with the parameters of production, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, exact_index, lattice_lm, line_dedup, matroska, merge_table, minhash, pairwise_quality, url_rules, warc
from .common import documents, new_path, stored

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIX_WEIGHTS = [3.0, 1.0, 2.0]
MIX_SCHEDULES = [curriculum.STEADY, curriculum.EARLY, curriculum.LATE]


def piece_model() -> str:
    """Where the public merge-type model lies on this machine and, installed alike, on the executors'."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedupe_lines(documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",").alias("removed_spans")
    return cleaned.select("doc_id", "n_lines", "removed_lines", spans, F.sha2("text", 256).alias("text_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lattice_lm.fit(docs, pairwise_quality.id_remainder(F.col("doc_id"), 5) != 1, model_path or piece_model())
    held_out = (pairwise_quality.id_remainder(F.col("doc_id"), 5) == 1).alias("held_out")
    return lattice_lm.score_texts(docs, model, unseen=False).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def quality_ranking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> pairwise_quality.Ranking:
    """Learned from the labelled rows of ``docs`` outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(pairwise_quality.id_remainder(F.col("doc_id"), 3) != 1)
    return pairwise_quality.learn(*pairwise_quality.training_sample(docs, labels, "quality"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = pairwise_quality.score_texts(docs, quality_ranking(spark, docs, sf_dir))
    held_out = (pairwise_quality.id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rank_score")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, RULES))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = exact_index.fresh_index(spark, docs.count())
    return index.dedupe(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(documents(spark, sf_dir), MIX_WEIGHTS, schedules=MIX_SCHEDULES)
    first = F.round(F.get("positions", F.lit(0)), 7).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(stored(matroska.store_texts(documents(spark, sf_dir)), "media"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    coded = merge_table.encode_texts(documents(spark, sf_dir), model_path or piece_model())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.decide(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    streams, members = new_path(spark, "warc-streams"), new_path(spark, "warc-members")
    archives = stored(warc.write_archives(records, streams), "warc-archives")
    index = stored(warc.normalise(archives, streams, members), "warc-index")
    return warc.read_records(index, members).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_minhash": op3_minhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filters": op5_url_filters,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_media_columns": op8_media_columns,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_warc": op10_warc,
}

RULE_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLES = {
    "op1_line_dedup": """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no FROM cut),
nb AS (
  SELECT doc_id, no, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS place
  FROM l WHERE trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) <> ''),
w AS (SELECT doc_id, place, s, lead(s) OVER d AS s2, lead(s, 2) OVER d AS s3 FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
f AS (SELECT doc_id, place, row_number() OVER (PARTITION BY s, s2, s3 ORDER BY doc_id, place) AS nth FROM w WHERE s3 IS NOT NULL),
cov AS (SELECT DISTINCT doc_id, place + d AS place FROM f, (VALUES (0), (1), (2)) v(d) WHERE nth > 1),
isl AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS g FROM cov),
spans AS (SELECT doc_id, min(no) AS lo, max(no) AS hi FROM isl JOIN nb USING (doc_id, place) GROUP BY doc_id, g),
told AS (SELECT doc_id, string_agg(concat(lo, '-', hi), ',' ORDER BY lo) AS removed_spans, sum(hi - lo + 1)::BIGINT AS removed_lines FROM spans GROUP BY doc_id),
stay AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM l
  WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.doc_id = l.doc_id AND no BETWEEN lo AND hi) GROUP BY doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_spans, '') AS removed_spans,
       sha256(coalesce(text, '')) AS text_sha256
FROM cut LEFT JOIN told USING (doc_id) LEFT JOIN stay USING (doc_id)
""",
    "op5_url_filters": f"""
WITH rules(rule_verdict, rh, rp) AS (VALUES {RULE_VALUES}),
cut AS (SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
met AS (
  SELECT page_id, arg_max(concat(rh, rp), length(concat(rh, rp))) AS rule, arg_max(rule_verdict, length(concat(rh, rp))) AS rule_verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, concat('.', rh))) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN met USING (page_id)
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS turn FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ordinal FROM sized GROUP BY source),
weighed AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(ordinal - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM src),
ranked AS (
  SELECT *, most * sum(weight) OVER (ORDER BY most / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= weight * (budget - coalesce(sum(most) OVER (ORDER BY most / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped FROM weighed),
goals AS (
  SELECT source, source_size, ordinal, CASE WHEN capped THEN most
         ELSE weight * ((budget - coalesce(sum(most) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()) END AS target FROM ranked),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END AS rounds FROM goals),
run AS (
  SELECT s.*, g.source_size, g.target, g.rounds, g.ordinal, g.target - g.rounds * g.source_size AS part,
         sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS through
  FROM sized s JOIN parts g ON s.source IS NOT DISTINCT FROM g.source),
following AS (
  SELECT source, through, size, part, row_number() OVER (PARTITION BY source ORDER BY through) AS nth FROM run WHERE size > 0 AND through > part QUALIFY nth <= 64),
ends AS (
  WITH RECURSIVE meet AS (
    SELECT source, 0::BIGINT AS nth, any_value(part) AS cut, []::BIGINT[] AS skipped FROM run GROUP BY source
    UNION ALL
    SELECT m.source, f.nth, CASE WHEN f.through > cut AND len(skipped) < 16 THEN cut + f.size ELSE cut END, CASE WHEN f.through > cut AND len(skipped) < 16 THEN list_append(skipped, f.through) ELSE skipped END
    FROM meet m JOIN following f ON m.source IS NOT DISTINCT FROM f.source AND f.nth = m.nth + 1)
  SELECT source, arg_max(cut, nth) AS cut, arg_max(skipped, nth) AS skipped FROM meet GROUP BY source),
based AS (
  SELECT r.*, CASE WHEN size > 0 THEN rounds + (through <= cut AND NOT list_contains(skipped, through))::INT ELSE 0 END::INT AS base
  FROM run r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source),
rests AS (SELECT source, max(part) - coalesce(sum(size) FILTER (base > rounds), 0) AS rest FROM based GROUP BY source HAVING abs(rest) > 0.5),
free1 AS (
  SELECT b.source, size, through, base, rest, floor(log2(size))::INT AS class FROM based b JOIN rests r ON b.source IS NOT DISTINCT FROM r.source WHERE size > 0),
free2 AS (SELECT *, row_number() OVER (PARTITION BY source, class, base ORDER BY through) AS nth FROM free1),
free3 AS (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY (class > floor(log2(abs(rest))) + 1)::INT, nth, class DESC) AS place FROM free2 WHERE nth <= 14),
free4 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, base) AS slot FROM free3 QUALIFY slot <= 14),
free AS (SELECT *, slot % 2 AS side, power(3, (slot - 1) // 2)::BIGINT AS unit FROM free4),
sides AS (SELECT source, side, any_value(rest) AS rest, power(3, count(*))::BIGINT AS codes FROM free GROUP BY ALL),
options AS (SELECT source, side, rest, unnest(range(codes)) AS code FROM sides),
sums AS (
  SELECT o.source, o.side, o.rest, code, sum(((code // unit) % 3 - base) * size)::BIGINT AS added
  FROM options o JOIN free f ON o.source IS NOT DISTINCT FROM f.source AND o.side = f.side GROUP BY ALL),
least1 AS (SELECT source, side, rest, added, min(code) AS code FROM sums GROUP BY ALL),
line AS (SELECT *, CASE WHEN side = 1 THEN added::DOUBLE ELSE rest - added END AS spot FROM least1),
near AS (
  SELECT source, side, spot, code, last_value(CASE WHEN side = 1 THEN {'a': added, 'c': code} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY spot, side DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below,
         first_value(CASE WHEN side = 1 THEN {'a': added, 'c': code} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY spot, side DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM line),
best AS (
  SELECT source, code0, code1 FROM (
    SELECT source, code AS code0, below.c AS code1, round(abs(spot - below.a), 6) AS miss, 0 AS over FROM near WHERE side = 0 AND below IS NOT NULL
    UNION ALL SELECT source, code, above.c, round(abs(spot - above.a), 6), 1 FROM near WHERE side = 0 AND above IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, over, code0, code1) = 1),
chosen AS (SELECT f.source, through, (CASE WHEN side = 0 THEN code0 ELSE code1 END // unit) % 3 AS copies FROM free f JOIN best b ON f.source IS NOT DISTINCT FROM b.source),
took AS (
  SELECT b.*, coalesce(c.copies, base)::BIGINT AS copies FROM based b LEFT JOIN chosen c ON b.source IS NOT DISTINCT FROM c.source AND b.through = c.through AND b.size > 0),
stream AS (
  SELECT *, (sum(CASE WHEN copies > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY through ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE) / nullif(sum(copies * size) OVER (PARTITION BY source), 0) AS x
  FROM took),
timed AS (
  SELECT *, CASE (ordinal - 1) % 3 WHEN 0 THEN x
    WHEN 1 THEN CASE WHEN x <= 0.65 THEN 2 * x / (1.6 + sqrt(greatest(2.56 - 2.4 * x, 0))) ELSE 0.5 + 2 * (x - 0.65) / (1.0 + sqrt(greatest(1.0 - 2.4 * (x - 0.65), 0))) END
    ELSE CASE WHEN x <= 0.35 THEN 2 * x / (0.4 + sqrt(0.16 + 2.4 * x)) ELSE 0.5 + 2 * (x - 0.35) / (1.0 + sqrt(1.0 + 2.4 * (x - 0.35))) END END AS place FROM stream)
SELECT doc_id, size, source_size, target, copies * size AS taken, CASE WHEN copies > 0 THEN round(least(place, 1.0), 7) END AS first_position FROM timed
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
""",
}
