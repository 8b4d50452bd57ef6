"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorlake.llm import (
    content_sort,
    conversations,
    decontaminate,
    fair_mix,
    ftrl,
    hyperminhash,
    kneser_ney,
    license_scan,
    quality_rules,
    transducer,
    url_lists,
    whitening,
    wrappers,
)
from sensorlake.llm.repair_sql import REPAIR_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries made from the hosts that the pages have: hosts that are blocked and taken off
    again, parent domains that are blocked, and allowed paths."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("h")).filter("h <> ''").distinct().withColumn(
        "x", F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("int")
    )

    def entry(rule: str, verdict: str, day: str, which: str) -> DataFrame:
        return hosts.filter(which).selectExpr(
            f"{rule} AS rule", f"'{verdict}' AS verdict", f"date_add(DATE '2024-01-01', {day}) AS listed_at"
        )

    return (
        entry("h", "block", "x % 366", "x % 3 = 0")
        .unionByName(entry("h", "drop", "x % 366 + 60", "x % 3 = 0"))
        .unionByName(entry("regexp_replace(h, '^[^.]+[.]', '')", "block", "x % 200", "x % 5 = 0"))
        .unionByName(entry("concat(h, '/en/')", "allow", "x % 100", "x % 2 = 0"))
    )


@query(
    "op1_temporal_list",
    r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
         regexp_replace(lower(regexp_extract(COALESCE(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
         regexp_extract(COALESCE(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (
  SELECT host AS h, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS x
  FROM captures WHERE host <> '' GROUP BY host),
entries AS (
  SELECT h AS rule, 'block' AS verdict, DATE '2024-01-01' + x % 366 AS valid_from FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT h, 'drop', DATE '2024-01-01' + (x % 366 + 60) FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT regexp_replace(h, '^[^.]+[.]', ''), 'block', DATE '2024-01-01' + x % 200 FROM hosts WHERE x % 5 = 0
  UNION ALL SELECT h || '/en/', 'allow', DATE '2024-01-01' + x % 100 FROM hosts WHERE x % 2 = 0),
dated AS (SELECT rule, valid_from, MIN(verdict) AS verdict FROM entries GROUP BY rule, valid_from),
listed AS (
  SELECT *, LEAD(valid_from) OVER (PARTITION BY rule ORDER BY valid_from) AS valid_to FROM dated),
tried AS (
  SELECT DISTINCT page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1),
                   lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(string_split(path, '/'))),
                   lambda i: host || array_to_string(string_split(path, '/')[1:i], '/') || '/'))) AS rule
  FROM captures WHERE host <> ''),
ranked AS (
  SELECT t.*, l.verdict, l.valid_from,
         row_number() OVER (PARTITION BY t.page_id, t.url, t.fetched ORDER BY length(t.rule) DESC, t.rule DESC) AS place
  FROM tried t JOIN listed l ON t.rule = l.rule AND t.fetched >= l.valid_from
       AND (l.valid_to IS NULL OR t.fetched < l.valid_to) AND l.verdict <> 'drop')
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, c.host, COALESCE(r.verdict, 'none') AS verdict,
       r.rule, CAST(r.valid_from AS VARCHAR) AS rule_from
FROM captures c LEFT JOIN ranked r ON c.page_id = r.page_id AND c.url = r.url AND r.place = 1
""",
)
def op1_temporal_list(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(page_id * 37 % 366 AS INT))").alias("fetched"))
    return url_lists.judge(captures, dated_entries(pages)).select(
        "page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "verdict", "rule",
        F.col("rule_from").cast("string").alias("rule_from"),
    )


@query("op2_token_transducer")
def op2_token_transducer(spark, sf_dir):
    import public_tokenizers

    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_ftrl_quality")
def op3_ftrl_quality(spark, sf_dir):
    return ftrl.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_hyperminhash")
def op4_hyperminhash(spark, sf_dir):
    return hyperminhash.near_groups(table(spark, sf_dir, "documents"), hyperminhash.Settings(words=2))


@query(
    "op5_fair_mix",
    r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS spot,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sources),
levels AS (
  SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(cap) OVER (
              ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / SUM(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final AS (
  SELECT *, MAX(CASE WHEN cap / weight >= level THEN level END) OVER () AS final FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN final IS NULL OR cap <= final * weight THEN cap ELSE final * weight END AS target
  FROM final),
queued AS (
  SELECT s.*, t.source_size, t.target,
         SUM(size) OVER (PARTITION BY s.source ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(ends + copy * source_size AS DOUBLE) / target AS time
  FROM queued, (VALUES (0), (1)) AS c(copy) WHERE size > 0),
taken AS (
  SELECT doc_id, size, SUM(size) OVER (ORDER BY time, source NULLS LAST, spot, doc_id, size
                                       ROWS UNBOUNDED PRECEDING) AS total
  FROM copies),
counted AS (
  SELECT doc_id, COUNT(*) AS copies FROM taken
  WHERE total <= (SELECT SUM(target) FROM targets) + 0.5 GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target,
       CAST(COALESCE(c.copies, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN counted c USING (doc_id)
""",
)
def op5_fair_mix(spark, sf_dir):
    return fair_mix.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op6_wrapper_induction")
def op6_wrapper_induction(spark, sf_dir):
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@query("op7_license_windows")
def op7_license_windows(spark, sf_dir):
    return license_scan.license_finds(table(spark, sf_dir, "documents"))


@query("op8_kneser_ney")
def op8_kneser_ney(spark, sf_dir):
    return kneser_ney.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_seed_align")
def op9_seed_align(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op10_content_sort",
    """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
       doc_id = MAX(doc_id) OVER w AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY COALESCE(text, ''))
""",
)
def op10_content_sort(spark, sf_dir):
    return content_sort.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op11_qdwh_whitening")
def op11_qdwh_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_decision_list")
def op12_decision_list(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_lightest_repair", REPAIR_SQL)
def op13_lightest_repair(spark, sf_dir):
    return conversations.repair_digests(conversations.damage(table(spark, sf_dir, "conversations")))
