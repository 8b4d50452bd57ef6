"""Text rules for messy sensor input, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Module and feature names, true words. Missing-value words (unknown, Unknown, nan,
# None) are no numbers and need no list.
MODULE_PATTERN = "M(?:10|11|1|4|6|7|8|9)"
FEATURE_PATTERN = "TEMP|HUMID|HUM|CO2|TVOC"
FEATURE_NAMES = {"TEMP": "Temp", "HUMID": "Humid", "HUM": "Humid", "CO2": "CO2", "TVOC": "TVOC"}
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _module_pattern(strict: bool) -> str:
    # M12 must not read as M1; the non-strict form keeps the older prefix match.
    return MODULE_PATTERN + ("(?![0-9])" if strict else "")


def channel_name_col(raw: Column, strict: bool = True) -> Column:
    """Canonical ``M<node>_<Metric>`` of a column of headings, null where a heading names no channel."""
    token = F.regexp_replace(F.upper(raw), "[^A-Za-z0-9]", "")
    module = F.regexp_extract(token, _module_pattern(strict), 0)
    feature = F.regexp_extract(token, FEATURE_PATTERN, 0)
    names = F.create_map(*[F.lit(x) for pair in FEATURE_NAMES.items() for x in pair])
    return F.when((module != "") & (feature != ""), F.concat_ws("_", module, names[feature]))


def to_number(raw: Column) -> Column:
    """Decimal comma or point, missing words and bad text become null."""
    text = F.replace(F.trim(raw), F.lit(","), F.lit("."))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_bool(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def fixed_text(value: Column, decimals: int = 2) -> Column:
    """Fixed decimals without grouping. Six decimals are taken first, so that sums that differ in their
    last bit have one text; then the exact binary value is rounded."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", F.round(value, 6), F.lit(pattern))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
