"""The prediction log: ragged text, older headings, missing times, appends and rewrites."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sensorlake import schema
from sensorlake.functions.text import to_bool
from sensorlake.functions.times import from_micros, micros
from sensorlake.operators.quantile import exact_quantile
from sensorlake.session import materialise, work_dir
from sensorlake.sources.readings import SourceError, parse_time

EXTRA_COLUMN, EXTRA_AT = "ground_truth_matched", 3
FEATURE_HEADING = r"^M(?:1|4|6|7|8|9|10|11)_(Temp|Humid|CO2|TVOC)$"


TIME_COLUMNS = {"logged_at_utc": "logged_at", "forecast_issue_time": "issue_ts", "forecast_target_time": "target_ts"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, line)`` of log files: the record's number within its file, from 0, and its text.

    A quoted field may hold line breaks, and quotes inside it are doubled: a line belongs to the record
    before it while the number of quotes so far is odd. Files stay splittable. Each split counts
    its quotes and its records' starts, the counts of the splits before are added, and the lines of a
    record meet by number, also where a split ends inside it. Empty lines between records go.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    split = Window.partitionBy("file", "_split")
    earlier = split.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.withColumn("_quotes", quotes).withColumn(
        "_before", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2
    )
    # How many records start in a split follows from whether it starts inside a quoted field.
    splits = inside.groupBy("file", "_split").agg(
        F.sum("_quotes").alias("_quotes"),
        F.count_if((F.col("_before") == 0) & (F.col("line") != "")).alias("_even"),
        F.count_if((F.col("_before") == 1) & (F.col("line") != "")).alias("_odd"),
    )
    so_far = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    entered = splits.withColumn("_into", F.coalesce(F.sum("_quotes").over(so_far), F.lit(0)) % 2)
    begun = F.when(F.col("_into") == 0, F.col("_even")).otherwise(F.col("_odd"))
    offsets = entered.select(
        "file", "_split", "_into", F.coalesce(F.sum(begun).over(so_far), F.lit(0)).alias("_records")
    )
    upto = split.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        inside.join(offsets, ["file", "_split"])
        .withColumn("_between", F.col("_before") == F.col("_into"))
        .filter(~(F.col("_between") & (F.col("line") == "")))
        .withColumn("record", F.col("_records") + F.count_if("_between").over(upto) - 1)
    )
    pieces = F.array_sort(F.collect_list(F.struct("_split", "_at", "line")))
    text = F.array_join(F.transform(pieces, lambda p: p["line"]), "\n")
    return numbered.groupBy("file", "record").agg(text.alias("line"))


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path``, a file or a folder of files, ready for reconciling.

    Every file starts with its own header, which may be an older one: files of one header are parsed
    together, headings are brought up to date, and columns that a header lacks are empty text. Times
    become ``logged_at``, ``issue_ts`` and ``target_ts`` (missing targets repaired), the flag a boolean,
    predictions and truths numbers. A file with a header only has no rows; without any file's header
    the result is an error. Headers differ by release of the writer; only the distinct ones reach the
    driver.
    """
    records = materialise(read_records(spark, path))
    heads = records.filter("record = 0").select("file", F.col("line").alias("_head"))
    body = materialise(records.filter("record > 0").join(heads, "file"))
    generations = sorted(row[0] for row in heads.select("_head").distinct().collect())
    if not generations:
        raise SourceError(f"No log header under {path}.")
    log = None
    for head in generations:
        names = [name.strip() for name in next(csv.reader([head]))]
        part = parse_ragged(body.filter(F.col("_head") == head), names, options={"escape": '"'})
        part = upgrade_headings(part)
        log = part if log is None else log.unionByName(part, allowMissingColumns=True)
    typed = log.na.fill("").withColumns(
        {
            **{c: F.col(f"`{c}`").try_cast("double") for c in log.columns if c.startswith(("pred_", "gt_"))},
            **{new: parse_time(F.col(c)) for c, new in TIME_COLUMNS.items() if c in log.columns},
        }
    ).drop(*TIME_COLUMNS)
    if EXTRA_COLUMN in typed.columns:
        typed = coerce_flags(typed, [EXTRA_COLUMN])
    return repair_times(typed)


def parse_ragged(
    lines: DataFrame, header: list[str], keep: list[str] = [], options: dict[str, str] = {}
) -> DataFrame:
    """Text columns of log lines whose field count does not always fit the header.

    Short lines get empty fields, long ones lose the rest. A line with one field too many and a
    true/false in fourth place was written with the extra column the header lacks; once such a
    line occurs the result has the column, empty where a line lacks it. Quoted fields may hold
    commas. ``options`` go to the CSV parser.
    """
    wide = len(header) + 1
    # Options of the parser, not a schema guess: one more field than the header, all text.
    generic = ", ".join(f"f{i} string" for i in range(wide + 1))
    parsed = lines.filter(F.col("line") != "").withColumn(
        "_r", F.from_csv("line", F.lit(generic), {"mode": "PERMISSIVE", "emptyValue": "", **options})
    )
    fields = F.array(*[F.col("_r")[f"f{i}"] for i in range(wide + 1)])
    extra = (
        F.lit(EXTRA_COLUMN not in header)
        & F.col("_r")[f"f{wide - 1}"].isNotNull()
        & F.col("_r")[f"f{wide}"].isNull()
        & F.col("_r")[f"f{EXTRA_AT}"].isin("True", "False", "true", "false")
    )
    shaped = parsed.withColumn("_f", fields).withColumn("_extra", extra)

    def cell(i):
        moved = i + 1 if i >= EXTRA_AT else i
        picked = F.when(F.col("_extra"), F.col("_f")[moved]).otherwise(F.col("_f")[i])
        return F.coalesce(picked, F.lit("")).alias(header[i])

    matched = F.when(F.col("_extra"), F.col("_f")[EXTRA_AT]).otherwise("").alias(EXTRA_COLUMN)
    columns = [cell(i) for i in range(len(header))]
    if EXTRA_COLUMN not in header:
        columns.insert(EXTRA_AT, matched)
    return shaped.select(*keep, *columns)


def upgrade_headings(log: DataFrame) -> DataFrame:
    """Bare channel headings of older logs become predictions."""
    names = {
        c: f"pred_{c}"
        for c in log.columns
        if re.match(FEATURE_HEADING, c) and f"pred_{c}" not in log.columns
    }
    return log.withColumnsRenamed(names)


def coerce_flags(log: DataFrame, columns: list[str]) -> DataFrame:
    return log.withColumns({c: to_bool(F.col(c)) for c in columns})


def repair_times(log: DataFrame, default_us: int = schema.DEFAULT_STEP_US) -> DataFrame:
    """Missing target times become issue time plus the median step of the complete rows."""
    step = log.select((micros("target_ts") - micros("issue_ts")).alias("step")).filter("step >= 0")
    median = exact_quantile(step, [], "step").agg(
        F.max(F.when(F.col("quantile") > 0, F.col("quantile"))).alias("us")
    )
    inferred = F.coalesce(median.scalar(), F.lit(float(default_us)))
    repaired = from_micros((micros("issue_ts") + inferred).cast("bigint"))
    return log.withColumn("target_ts", F.coalesce("target_ts", repaired))


def to_long(log: DataFrame, channels: list[str]) -> DataFrame:
    """Long predictions of a wide log: ``(issue_ts, target_ts, node, metric, pred)``."""
    columns = [f"pred_{c}" for c in channels if f"pred_{c}" in log.columns]
    name = F.split(F.expr("substring(channel, 6)"), "_", 2)
    return log.unpivot(["issue_ts", "target_ts"], columns, "channel", "pred").select(
        "issue_ts", "target_ts", name[0].alias("node"), name[1].alias("metric"),
        F.col("pred").try_cast("double").alias("pred"),
    )


def append(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by name, then the last appended row per key: a new row beats an existing one, and of
    rows that came together the last logged one stays. A row is taken whole."""
    both = existing.withColumn("_late", F.lit(0)).unionByName(
        new.withColumn("_late", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in keys and c != "_late"]
    last = F.max_by(F.struct(*rest), F.struct("_late", "logged_at")).alias("_row")
    return both.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def newest(log: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most recent log rows."""
    return log.orderBy(F.desc("issue_ts"), *[F.col(k) for k in keys]).limit(n)


def rewrite(log: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Overwrites ``path`` with ``log``, which may itself read from ``path``.

    The new content is staged first. A failure while it is computed leaves the old log in place; one
    during the copy does not, but the staged copy then holds the whole log.
    """
    spark = log.sparkSession
    staged = work_dir(spark)
    log.write.mode("overwrite").parquet(staged)
    writer = spark.read.parquet(staged).write.mode("overwrite").format(fmt)
    options = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    writer.options(**options).save(path)
    reader = spark.read.format(fmt).options(**options)
    return reader.schema(log.schema).load(path)
