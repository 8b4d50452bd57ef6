"""Question and command logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.operators import questions, series
from sensorlake.plans.base import FRAME, frame, query, table

ASKED = "asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def asked(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


def worded(spark, d):
    """Questions that name nodes and topics: the conversations' own text behind a short lead."""
    leads = F.array(
        *[
            F.lit(t)
            for t in (
                "Is M10 offline? ", "trend of m1 please: ", "All day for M11: ", "now: ",
                "Which module is dead: ", "M12 or m7, past hour: ",
            )
        ]
    )
    return asked(spark, d).withColumn(
        "text", F.concat(F.element_at(leads, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int")), "text")
    )


WORDED = f"""{ASKED}, worded AS (
  SELECT conv_id, turn, concat((['Is M10 offline? ', 'trend of m1 please: ', 'All day for M11: ',
    'now: ', 'Which module is dead: ', 'M12 or m7, past hour: '])[(conv_id + turn) % 6 + 1], text)
    AS text FROM asked)"""


def _any(words):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


INTENT = "CASE " + " ".join(
    f"WHEN {_any(words)} THEN '{intent}'" for intent, words in questions.INTENT_WORDS.items()
) + " ELSE 'current' END"
NODE = r"nullif(upper(regexp_extract(text, '(?i)\bM(10|11|1|4|6|7|8|9)\b', 0)), '')"


@query("b10_question_intent", f"WITH {WORDED} SELECT conv_id, turn, {INTENT} AS intent FROM worded")
def _(spark, d):
    return questions.with_intent(worded(spark, d)).select("conv_id", "turn", "intent")


@query("b11_node_mention", f"WITH {WORDED} SELECT conv_id, turn, {NODE} AS node FROM worded")
def _(spark, d):
    return questions.with_node(worded(spark, d)).select("conv_id", "turn", "node")


@query(
    "b13_question_windows",
    f"""WITH {FRAME}, {WORDED}, q AS (
      SELECT conv_id, turn, {INTENT} AS intent, {NODE} AS node FROM worded),
    sizes AS (SELECT * FROM (VALUES ('module_status', 5), ('current', 10), ('trend', 120),
      ('today', 480)) AS t(intent, n)),
    back AS (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS k FROM times),
    spans AS (
      SELECT intent, count(*) AS window_rows, least(count(*), 20) AS shown_rows,
        min(CASE WHEN k <= 20 THEN ts END) AS shown_from
      FROM sizes JOIN back ON k <= n GROUP BY intent),
    counts AS (
      SELECT q.conv_id, q.turn, count(f.value) AS n_values
      FROM q JOIN spans s USING (intent)
      JOIN frame f ON f.ts >= s.shown_from AND (q.node IS NULL OR f.node = q.node) GROUP BY 1, 2)
    SELECT q.conv_id, q.turn, q.intent, q.node, s.window_rows, s.shown_rows,
      epoch_us(s.shown_from) AS shown_from_us, c.n_values
    FROM q JOIN spans s USING (intent) JOIN counts c USING (conv_id, turn)""",
)
def _(spark, d):
    return questions.question_windows(worded(spark, d), frame(spark, d)).drop("text")


# --- commands -----------------------------------------------------------------------

COMMAND_TEXT = """CASE event_id % 12
  WHEN 0 THEN concat('/chart_day_m', user_id % 12, '_temp') WHEN 1 THEN '/chart_week_all_co2'
  WHEN 2 THEN concat('/predict_m', user_id % 12, '_humid') WHEN 3 THEN '/heatmap_tvoc'
  WHEN 4 THEN concat('/compare_m', user_id % 8, '_m', user_id % 5) WHEN 5 THEN '/rank_temp'
  WHEN 6 THEN '/chart' WHEN 7 THEN '/rank_noise' WHEN 8 THEN '/chart_year_all_temp'
  WHEN 9 THEN concat('hello ', event_type) WHEN 10 THEN '/heatmap_co2'
  ELSE concat('/predict_m', user_id % 12, '_') END"""
KIND = """CASE WHEN event_id % 12 IN (0, 1) THEN 'chart' WHEN event_id % 12 = 2 THEN 'predict'
  WHEN event_id % 12 IN (3, 10) THEN 'heatmap' WHEN event_id % 12 = 4 THEN 'compare'
  WHEN event_id % 12 = 5 THEN 'rank' WHEN event_id % 12 = 6 THEN 'menu'
  WHEN event_id % 12 IN (7, 8, 11) THEN 'invalid' END"""


def commands(spark, d):
    return table(spark, d, "events").select(
        "event_id", "user_id", "value", F.expr(COMMAND_TEXT).alias("text")
    )


@query(
    "b12_command_parse",
    f"""SELECT event_id, {KIND} AS kind,
      CASE event_id % 12 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN concat('m', user_id % 12)
        WHEN 3 THEN 'tvoc' WHEN 4 THEN concat('m', user_id % 8) WHEN 5 THEN 'temp'
        WHEN 10 THEN 'co2' END AS arg1,
      CASE event_id % 12 WHEN 0 THEN concat('m', user_id % 12) WHEN 1 THEN 'all' WHEN 2 THEN 'humid'
        WHEN 4 THEN concat('m', user_id % 5) END AS arg2,
      CASE event_id % 12 WHEN 0 THEN 'temp' WHEN 1 THEN 'co2' END AS arg3 FROM events""",
)
def _(spark, d):
    return questions.parse_commands(commands(spark, d)).select(
        "event_id", "kind", "arg1", "arg2", "arg3"
    )


@query(
    "d18_usage_rollup",
    f"""WITH log AS (
      SELECT {KIND} AS command, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
        user_id AS input_tokens, event_id % 7 AS output_tokens, event_id % 3 = 0 AS is_cached
      FROM events)
    SELECT command, count(*) AS calls, round(avg(latency_ms), 6) AS avg_latency_ms,
      sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
      round(avg(CAST(is_cached AS DOUBLE)), 6) AS cache_ratio,
      round(quantile_cont(latency_ms::DOUBLE, 0.95), 6) AS p95_latency_ms
    FROM log WHERE command IS NOT NULL GROUP BY command""",
)
def _(spark, d):
    log = questions.parse_commands(commands(spark, d)).filter("kind IS NOT NULL").select(
        F.col("kind").alias("command"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.col("user_id").alias("input_tokens"),
        (F.col("event_id") % 7).alias("output_tokens"),
        (F.col("event_id") % 3 == 0).alias("is_cached"),
    )
    return series.usage_rollup(log)


def question_log(spark, d):
    """Questions with ask times; some are asked again, word for word or changed a little."""
    first = worded(spark, d).withColumn("asked_s", F.col("conv_id") * 240 + F.col("turn") * 40)
    again = first.filter("conv_id % 3 = 0").select(
        "conv_id", (F.col("turn") + 100).alias("turn"),
        F.regexp_replace("text", "[aeiou]r", "x").alias("text"),
        (F.col("asked_s") + 60).alias("asked_s"),
    )
    copies = first.filter("conv_id % 5 = 0").select(
        "conv_id", (F.col("turn") + 200).alias("turn"),
        F.concat(F.lit(" "), F.upper("text")).alias("text"),
        (F.col("asked_s") + 170).alias("asked_s"),
    )
    return first.unionByName(again).unionByName(copies)


@query("c09_repeated_questions")
def _(spark, d):
    hits = questions.cache_hits(question_log(spark, d), ["conv_id", "turn"])
    return hits.select("conv_id", "turn", "asked_s", "score", F.sha2("matched", 256).alias("matched"))
