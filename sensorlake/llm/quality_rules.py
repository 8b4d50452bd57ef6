"""Quality rules as a learned decision list.

Every text is reduced to counts (words, symbols, repeated lines, words in repeated windows and so on).
Sequential covering learns from labelled documents: a rule is a conjunction of thresholds on shares of
those counts, grown one threshold at a time by information gain on two thirds of the rows and pruned
from its end on the other third; rows that a rule covers leave, and the next rule is learned from the
rest. The ordered rules become one Spark conditional expression over the counts, so they can be read,
stored and applied without Python.

Counts are exact: words, windows and lines are numbered by a dictionary of their whole bytes, not by
hashes. Texts are worked off in stretches of about a megabyte; a longer text is a stretch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sensorlake.llm import tokens
from sensorlake.session import materialise

SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_short", "n_distinct", "n_loud",
)
#: What rules may test: shares of the counts, zero where nothing is counted.
MEASURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_case": ("n_upper", "word_chars"),
    "short_words": ("n_short", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "loud_marks": ("n_loud", "n_words"),
}


@dataclass(frozen=True)
class Settings:
    #: Bound of the labelled rows that are learned from, the first ones by a hash of their id.
    most_rows: int = 20_000
    most_rules: int = 32
    most_conditions: int = 4
    #: A pruned rule must be right on this share of the pruning rows it covers.
    precision: float = 0.9
    #: A rule must cover at least this many growing rows.
    least_rows: int = 3
    #: The base rules.
    least_words: int = 50
    most_repeated: int = 50


# Counts


def _flags(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


_BLANK = _flags(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Bytes that open a code point of a word.
_OPENS = ~_BLANK & _flags(lambda b: b & 0xC0 != 0x80)
_BYTE_COUNTS = {
    "word_chars": _OPENS,
    "n_symbols": _flags(lambda b: b < 0x80 and chr(b) in SYMBOLS),
    "n_upper": _flags(lambda b: 65 <= b <= 90),
    "n_loud": _flags(lambda b: b in b"!?"),
}


def _numbered(values: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers, from 0 without gaps."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a stretch without nulls."""
    n = len(texts)
    data, offsets = tokens.utf8(texts)
    out = {}
    for name, table in _BYTE_COUNTS.items():
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out[name] = sums[offsets[1:]] - sums[offsets[:-1]]

    split = pc.ascii_split_whitespace(texts)
    words, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    words, of = words.filter(real), of[real.to_numpy(zero_copy_only=False)]
    out["n_words"] = np.bincount(of, minlength=n)
    out["n_short"] = np.bincount(of, weights=pc.equal(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False), minlength=n)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    vocabulary = int(ids.max(initial=0)) + 1
    out["n_distinct"] = np.bincount(np.unique(ids * n + of) % n, minlength=n)
    covered = np.zeros(len(ids), bool)
    if len(ids) > 2:
        pair = _numbered(ids[:-1] * vocabulary + ids[1:])
        inside = np.flatnonzero(of[:-2] == of[2:])
        window = _numbered(pair[inside] * vocabulary + ids[inside + 2]) * n + of[inside]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        again = np.zeros(len(inside), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        starts = inside[again]
        for k in range(3):
            covered[starts + k] = True
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)

    split = pc.split_pattern(texts, "\n")
    lines, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, of = lines.filter(real), of[real.to_numpy(zero_copy_only=False)]
    ids = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(ids * n + of) % n, minlength=n)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text of a string column; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    _, offsets = tokens.utf8(column)
    parts = [_counts(column.slice(a, b - a)) for a, b in tokens.slices(offsets)]
    return {name: np.concatenate([np.zeros(0, np.int64), *(p[name] for p in parts)]) for name in COUNTS}


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[name]) for name in COUNTS)], names=["doc_id", *COUNTS]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in COUNTS)
    )


# Learning


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.measure].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for condition in rule:
        out &= condition.holds(rows)
    return out


def _best_condition(rows: pd.DataFrame, bad: np.ndarray, least: int) -> tuple[float, Condition] | None:
    """The threshold that gains most: bad rows kept times the bits by which their share rises."""
    total, p0 = len(rows), int(bad.sum())
    before = np.log2(p0 / total)
    best = None
    for measure in MEASURES:
        values = rows[measure].to_numpy()
        order = np.argsort(values, kind="stable")
        sorted_values, sums = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(sorted_values[1:] > sorted_values[:-1])
        if not len(cuts):
            continue
        threshold = (sorted_values[cuts] + sorted_values[cuts + 1]) / 2
        for above in (False, True):
            size = total - cuts - 1 if above else cuts + 1
            p = p0 - sums[cuts] if above else sums[cuts]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((p > 0) & (size >= least), p * (np.log2(p / size) - before), -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > 0 and (best is None or gain[at] > best[0] + 1e-12):
                best = (float(gain[at]), Condition(measure, above, float(threshold[at])))
    return best


def grow(rows: pd.DataFrame, bad: np.ndarray, settings: Settings) -> Rule:
    rule: Rule = ()
    while len(rule) < settings.most_conditions and 0 < bad.sum() < len(bad):
        found = _best_condition(rows, bad, settings.least_rows)
        if found is None:
            break
        held = found[1].holds(rows)
        rows, bad = rows[held], bad[held]
        rule = (*rule, found[1])
    return rule


def prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of ``rule`` with the greatest share of bad minus good among the rows it covers,
    and how many bad and good ones those are. The shortest one wins a tie."""
    best: tuple[float, Rule, int, int] | None = None
    for length in range(1, len(rule) + 1):
        held = covers(rule[:length], rows)
        p, q = int((held & bad).sum()), int((held & ~bad).sum())
        worth = (p - q) / (p + q) if p + q else -1.0
        if best is None or worth > best[0]:
            best = (worth, rule[:length], p, q)
    return best[1], best[2], best[3]


def learn_list(rows: pd.DataFrame, bad: np.ndarray, pruning: np.ndarray, settings: Settings = Settings()) -> list[Rule]:
    """Ordered rules for bad rows. ``rows`` has the ``MEASURES``, ``pruning`` marks the pruning rows."""
    rules: list[Rule] = []
    left = np.ones(len(rows), bool)
    while len(rules) < settings.most_rules:
        growing, judging = left & ~pruning, left & pruning
        if not bad[growing].any():
            break
        rule = grow(rows[growing], bad[growing], settings)
        if not rule:
            break
        rule, p, q = prune(rule, rows[judging], bad[judging])
        if p + q == 0 or p < settings.precision * (p + q):
            break
        held = covers(rule, rows)
        if not (held & left & bad & ~pruning).any():
            break
        rules.append(rule)
        left &= ~held
    return rules


def measures(counts: DataFrame) -> dict[str, Column]:
    """Spark expressions of the ``MEASURES`` over the counts."""
    out = {}
    for name, (over, under) in MEASURES.items():
        value = F.col(over).cast("double")
        out[name] = value if under is None else F.when(F.col(under) > 0, value / F.col(under)).otherwise(0.0)
    return out


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The decision list as one conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        condition = F.lit(True)
        for c in rule:
            tested = of[c.measure] > c.threshold if c.above else of[c.measure] <= c.threshold
            condition = condition & tested
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(settings: Settings) -> Column:
    return (F.col("n_words") < settings.least_words) | (
        100 * F.col("n_repeat_words") > settings.most_repeated * F.col("n_words")
    )


def train(counts: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """Learns from the labelled rows of ``counts`` that pass the base rules; 0 in ``quality`` is bad.

    One task learns from at most ``settings.most_rows`` rows of a few numbers each. Rows without a
    label or id are left out; of a document's labels the largest counts. Without rows or bad rows
    there are no rules.
    """
    labelled = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    rows = (
        counts.filter(~base_failed(settings))
        .join(labelled, "doc_id")
        .select("doc_id", *(c.alias(n) for n, c in measures(counts).items()), (F.col("quality") <= 0).alias("bad"))
        .withColumn("at", F.xxhash64("doc_id"))
        .orderBy("at", "doc_id", *MEASURES)
        .limit(settings.most_rows)
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "doc_id", *MEASURES], kind="stable", ignore_index=True)
        pruning = (group["at"].to_numpy() % 3) == 0
        rules = learn_list(group[list(MEASURES)], group["bad"].to_numpy(bool), pruning, settings)
        return pd.DataFrame(
            [(i, k, c.measure, c.above, c.threshold) for i, rule in enumerate(rules) for k, c in enumerate(rule)],
            columns=["rule", "place", "measure", "above", "threshold"],
        )

    found = rows.groupBy(F.lit(1).alias("one")).applyInPandas(
        fit, "rule int, place int, measure string, above boolean, threshold double"
    )
    rules: dict[int, Rule] = {}
    for row in sorted(found.collect(), key=lambda r: (r["rule"], r["place"])):
        condition = Condition(row["measure"], row["above"], row["threshold"])
        rules[row["rule"]] = (*rules.get(row["rule"], ()), condition)
    return list(rules.values())


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of
    every row of ``docs``, repeated rows and rows without an id included.

    Null, empty and blank texts have zero counts and fail the base rules. Texts are read once. Columns
    other than ``doc_id`` and ``text`` are ignored. An empty table gives no rows.
    """
    counts = materialise(counted(docs))
    rules = train(counts, labels, settings)
    return counts.select(
        "doc_id",
        *COUNTS[:5],
        base_failed(settings).alias("base_failed"),
        (~base_failed(settings) & verdict(rules, measures(counts))).alias("kept"),
    )
