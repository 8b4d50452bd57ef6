"""Wide CSV exports to readings: timestamp choice, channel names, numbers, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorlake.functions.text import channel_name_col, to_number
from sensorlake.operators.clean import latest_per_timestamp

# Words that mark a time column.
TIME_WORDS = ["timestamp", "datetime", "date", "time", "created", "thoigian"]
#: Fixed value: the fleet's zone.
LOCAL_ZONE = "Asia/Bangkok"
TIME_FORMATS = [
    "M/d/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "yyyy/M/d[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]", "M.d.yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "MMM d, yyyy[ H:mm[:ss]]",
    "MMMM d, yyyy[ H:mm[:ss]]", "d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]",
]


class SourceError(RuntimeError):
    """The source is empty, or has no usable timestamp or channel."""


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every cell as text; the types follow from the cell rules, not inference."""
    df = spark.read.option("header", True).csv(path)
    if df.isEmpty():
        raise SourceError("The CSV source is empty.")
    return df


def parse_time(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """Lenient zone-less timestamp in the fleet's local time; null when the text is none.

    A text with an offset or ``Z``, and whole seconds or milliseconds since 1970, name an instant, which
    is given as its label in ``zone``. Any other text is a local label already. Month comes before day
    where both are possible. The session zone must be UTC.
    """
    trimmed = F.trim(text)
    parsed = [F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS]
    label = F.coalesce(trimmed.try_cast("timestamp_ntz"), *parsed)
    digits = trimmed.try_cast("bigint")
    instant = (
        F.when(trimmed.rlike(r"^[0-9]{9,10}$"), F.timestamp_seconds(digits))
        .when(trimmed.rlike(r"^[0-9]{12,13}$"), F.timestamp_millis(digits))
        .when(trimmed.rlike(r":[0-9]{2}(\.[0-9]+)? ?(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})$"), _zoned(trimmed))
    )
    epoch_or_zoned = trimmed.rlike(r"^[0-9]{9,13}$") | trimmed.rlike(r":[0-9]{2}(\.[0-9]+)? ?(Z|UTC|GMT|[+-][0-9]{2}(:?[0-9]{2})?)$")
    return F.when(epoch_or_zoned, F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")).otherwise(label)


def _zoned(text: Column) -> Column:
    # Offsets as the cast takes them: +0700 as +07:00, no blank before.
    spelled = F.regexp_replace(F.regexp_replace(text, " ?(Z|UTC|GMT)$", "Z"), " ?([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    return F.regexp_replace(spelled, " ?([+-][0-9]{2})$", "$1:00").try_cast("timestamp")


def time_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(w in c.strip().lower() for w in TIME_WORDS)]


def time_scores(df: DataFrame) -> DataFrame:
    """Share of cells that parse, per candidate column, in one aggregate: ``(ord, name, score)``."""
    names = time_candidates(df)
    if not names:
        raise SourceError("No timestamp column.")
    parsed = [F.avg(parse_time(F.col(f"`{c}`")).isNotNull().cast("double")) for c in names]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name"), p.alias("score"))
            for i, (c, p) in enumerate(zip(names, parsed))
        ]
    )
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def choose_time_column(df: DataFrame) -> str:
    """Best parse ratio, the first column on ties; nothing parseable is an error."""
    best = time_scores(df).orderBy(F.desc("score"), "ord").first()
    if best is None or not best["score"]:
        raise SourceError("No timestamp column parses.")
    return best["name"]


def drop_bad_times(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("ts", parse_time(F.col(f"`{column}`"))).filter(F.col("ts").isNotNull())


def channel_columns(spark: SparkSession, columns: list[str], strict: bool = True) -> dict[str, str]:
    """Canonical channel -> source column; the first of several spellings, unknown ones dropped."""
    if not columns:
        return {}
    headings = spark.createDataFrame(list(enumerate(columns)), "at int, heading string")
    named = headings.withColumn("name", channel_name_col(F.col("heading"), strict)).filter("name IS NOT NULL")
    first = named.groupBy("name").agg(F.min(F.struct("at", "heading")).alias("first")).orderBy("first.at")
    return {row["name"]: row["first"]["heading"] for row in first.collect()}


def select_channels(df: DataFrame, strict: bool = True, keep: list[str] = ["ts"]) -> DataFrame:
    chosen = channel_columns(df.sparkSession, [c for c in df.columns if c not in keep], strict)
    if not chosen:
        raise SourceError("No sensor channel found.")
    return df.select(*keep, *[F.col(f"`{source}`").alias(name) for name, source in chosen.items()])


def to_numeric(wide: DataFrame) -> DataFrame:
    return wide.select(
        "ts", *[to_number(F.col(c)).alias(c) for c in wide.columns if c != "ts"]
    )


def to_long(wide: DataFrame) -> DataFrame:
    """``readings(ts, node, metric, value)`` of a wide frame; missing cells keep their row."""
    channels = [c for c in wide.columns if c != "ts"]
    parts = F.split("channel", "_", 2)
    return wide.unpivot("ts", channels, "channel", "value").select(
        "ts", parts[0].alias("node"), parts[1].alias("metric"), "value"
    )


def normalise(
    raw: DataFrame, order: str, time_column: str | None = None, strict: bool = True
) -> DataFrame:
    """Wide numeric frame of a raw export.

    ``order`` is a column with the source row order; of rows with equal time the last one wins.
    """
    column = time_column or choose_time_column(raw.drop(order))
    timed = drop_bad_times(raw, column).drop(column)
    wide = select_channels(timed, strict, ["ts", order])
    return to_numeric(latest_per_timestamp(wide, ["ts"], order).drop(order))


def read_readings(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Readings of a wide CSV export. Source order is by file name, then by the place in the file;
    splits of a file begin at its block starts, and ids rise inside a split."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    raw = scan_csv(spark, path).withColumn("_order", place)
    return to_long(normalise(raw, "_order", strict=strict))
