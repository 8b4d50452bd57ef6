"""Question and command logs: intent, node, command, repeated questions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

# Keywords per intent (first match wins), frame rows per intent, command forms.
INTENT_WORDS = {
    "module_status": [
        "dead", "offline", "disconnected", "not working", "alive", "which module", "which node",
        "status", "state",
    ],
    "trend": [
        "trend", "fluctuation", "change", "history", "this morning", "this afternoon",
        "this evening", "6h", "past hour", "hours",
    ],
    "today": ["today", "all day", "24h"],
}
DEFAULT_INTENT = "current"
INTENT_ROWS = {"module_status": 5, "current": 10, "trend": 120, "today": 480}
SHOWN_ROWS = 20
NODE_PATTERN = r"(?i)\bM(10|11|1|4|6|7|8|9)\b"
COMMAND_PATTERNS = {
    "chart": r"^/chart_(hour|day|week)_(all|m\d+)_(temp|humid|co2|tvoc)$",
    "predict": r"^/predict_(m\d+)_(temp|humid|co2|tvoc)$",
    "heatmap": r"^/heatmap_(temp|humid|co2|tvoc)$",
    "compare": r"^/compare_(m\d+)_(m\d+)$",
    "rank": r"^/rank_(temp|humid|co2|tvoc)$",
}
COMMAND_ARGS = {"chart": 3, "predict": 2, "heatmap": 1, "compare": 2, "rank": 1}
CACHE_TTL_S, CACHE_THRESHOLD = 300, 80
# End of fixed values.


def with_intent(questions: DataFrame) -> DataFrame:
    text = F.lower("text")
    chosen = F.when(F.lit(False), "")
    for intent, words in INTENT_WORDS.items():
        chosen = chosen.when(text.rlike("|".join(words)), intent)
    return questions.withColumn("intent", chosen.otherwise(DEFAULT_INTENT))


def with_node(questions: DataFrame) -> DataFrame:
    hit = F.upper(F.regexp_extract("text", NODE_PATTERN, 0))
    return questions.withColumn("node", F.when(hit != "", hit))


def parse_commands(log: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``arg1`` .. ``arg3``.

    A bare command opens a menu, a known prefix with bad arguments is invalid, other text null.
    """
    text = F.col("text")
    kind = F.when(text.isin([f"/{k}" for k in COMMAND_PATTERNS]), "menu")
    args = [F.when(F.lit(False), "") for _ in range(3)]
    for name, pattern in COMMAND_PATTERNS.items():
        # The plain prefix test spares most rows the pattern.
        hit = text.startswith(f"/{name}_") & text.rlike(pattern)
        kind = kind.when(hit, name)
        for i in range(COMMAND_ARGS[name]):
            args[i] = args[i].when(hit, F.regexp_extract(text, pattern, i + 1))
    prefixed = F.lit(False)
    for name in COMMAND_PATTERNS:
        prefixed = prefixed | text.startswith(f"/{name}_")
    kind = kind.when(prefixed, "invalid")
    return log.select(
        "*", kind.alias("kind"), *[a.alias(f"arg{i + 1}") for i, a in enumerate(args)]
    )


def question_windows(questions: DataFrame, frame: DataFrame) -> DataFrame:
    """Adds the history each question is answered from: rows in its window, rows shown, the time
    they span and the known values among the shown rows of its node (all nodes if none is named).

    Windows depend only on the intent, so they are summed once per intent and node, then joined.
    """
    asked = with_node(with_intent(questions))
    deepest = max(INTENT_ROWS.values())
    newest = (
        frame.select("ts").distinct().orderBy(F.desc("ts")).limit(deepest)
        # At most as many rows as the deepest window.
        .withColumn("k", F.row_number().over(Window.orderBy(F.desc("ts"))))
    )
    sizes = F.array(
        *[F.struct(F.lit(i).alias("intent"), F.lit(n).alias("n")) for i, n in INTENT_ROWS.items()]
    )

    def per_intent(rows):
        reaching = F.filter(sizes, lambda s: s["n"] >= F.col("k"))
        return rows.withColumn("_size", F.explode(reaching)).withColumn(
            "intent", F.col("_size.intent")
        )

    spans = per_intent(newest).groupBy("intent").agg(
        F.count(F.lit(1)).alias("window_rows"),
        F.least(F.count(F.lit(1)), F.lit(SHOWN_ROWS)).alias("shown_rows"),
        F.min(F.when(F.col("k") <= SHOWN_ROWS, F.col("ts"))).alias("shown_from"),
    )
    shown = per_intent(frame.join(newest.filter(F.col("k") <= SHOWN_ROWS), "ts"))
    counts = shown.rollup("intent", "node").agg(F.count("value").alias("n_values"))
    scoped = counts.filter("intent IS NOT NULL").select(
        "intent", F.coalesce("node", F.lit("all")).alias("scope"), "n_values"
    )
    return (
        asked.withColumn("scope", F.coalesce("node", F.lit("all")))
        .join(spans, "intent", "left")
        .join(scoped, ["intent", "scope"], "left")
        .drop("scope")
    )


def _lcs(masks: dict[str, int], length: int, text: str) -> int:
    """Longest common subsequence of a text with the one the character masks stand for."""
    full = (1 << length) - 1
    v = full
    for ch in text:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def partial_ratio(a: str, b: str, at_least: int = 0) -> int:
    """0..100: the largest share of the shorter text that an equally long window of the longer one
    has in common with it, in order.

    Scores below ``at_least`` may come out as 0. Windows are first bounded in groups: a stretch that
    covers a group's windows has at least as much in common as any of them.
    """
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << i
    windows, group, best = len(long) - n + 1, max(1, n // 4), 0
    least = (at_least - 0.5) / 100 * n
    for first in range(0, windows, group):
        last = min(first + group, windows)
        bound = _lcs(masks, n, long[first : last - 1 + n])
        if bound > best and bound >= least:
            best = max(best, *(_lcs(masks, n, long[i : i + n]) for i in range(first, last)))
    score = int(round(100 * best / n))
    return score if score >= at_least else 0


def cache_hits(
    questions: DataFrame,
    ids: list[str],
    ttl_s: int = CACHE_TTL_S,
    threshold: int = CACHE_THRESHOLD,
) -> DataFrame:
    """Questions answerable from one asked at most ``ttl_s`` seconds before.

    ``questions`` has ``ids``, ``asked_s`` and ``text``. Asks of one text in one ttl-long cell
    collapse to their first and last time, which is all that the time test against the own and
    the preceding cell needs. So copies of a text, however many, meet no pairwise work: a repeat
    finds its exact match by key, and only first asks are compared with other texts.
    """
    asked = questions.select(
        *ids,
        "asked_s",
        F.lower(F.trim("text")).alias("q"),
        F.floor(F.col("asked_s") / ttl_s).cast("bigint").alias("cell"),
    )
    known = asked.groupBy("cell", "q").agg(
        F.min("asked_s").alias("first_s"), F.max("asked_s").alias("last_s")
    )
    before = known.select((F.col("cell") + 1).alias("cell"), "q", F.col("last_s").alias("before_s"))
    seen = asked.join(known.drop("last_s"), ["cell", "q"]).join(before, ["cell", "q"], "left")
    repeat = (F.col("first_s") < F.col("asked_s")) | (
        F.coalesce(F.col("before_s") >= F.col("asked_s") - ttl_s, F.lit(False))
    )
    seen = seen.withColumn("_repeat", repeat)
    exact = seen.filter("_repeat").select(
        *ids, "asked_s", F.lit(100).alias("score"), F.col("q").alias("matched")
    )

    probes = seen.filter(~F.col("_repeat")).select(*ids, "asked_s", "q", "cell")
    own = known.select("cell", F.col("q").alias("other"), "first_s", F.lit(None).cast("bigint").alias("last_s"))
    earlier = known.select(
        (F.col("cell") + 1).alias("cell"), F.col("q").alias("other"),
        F.lit(None).cast("bigint").alias("first_s"), "last_s",
    )
    in_time = F.coalesce(
        F.col("first_s") < F.col("asked_s"), F.col("last_s") >= F.col("asked_s") - ttl_s
    )

    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio(x, y, threshold) for x, y in zip(a, b)])

    # Scoring is the costly part. Spreading the pairs evenly keeps a busy cell off one task, and the
    # fixed number keeps small but slow partitions from being merged.
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fuzzy = (
        probes.join(own.unionByName(earlier), "cell")
        .filter(in_time & (F.col("other") != F.col("q")))
        .repartition(tasks)
        .withColumn("score", score("q", "other"))
        .filter(F.col("score") >= threshold)
        .groupBy(*ids, "asked_s")
        .agg(F.max_by(F.struct("score", "other"), F.struct("score", "other")).alias("_best"))
        .select(*ids, "asked_s", "_best.score", F.col("_best.other").alias("matched"))
    )
    return exact.unionByName(fuzzy)
