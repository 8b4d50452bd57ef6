"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of a source are shuffled by a hash of their id. The k-th copy of a document ends at the
virtual time ``cumulative words of its source / target of its source``. Copies of all sources are
ordered by that time and taken while their running total stays within the budget, so every source
has received about its target when the budget is used up.

Both running sums are split: the first over hash ranges of a source, the second over ranges of
virtual time. A unit of virtual time holds the same number of words everywhere, so the ranges are
even whatever the sources' sizes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorlake.llm.names import packed, unpacked
from sensorlake.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
HASH_RANGES = 256
TIME_RANGES = 1024
#: Virtual times beyond this end up in one range; at time 1 every source has its target.
LAST_TIME = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, weight, target, budget`` from ``source, source_size`` (one row per source).

    Weights repeat over the sources in code point order, null last. The budget is ``share`` of all
    words; a target stops at ``most`` times its source's words and the excess goes to the other
    sources by weight. In order of cap over weight, the capped sources come first. The level (words
    per weight) that is left for a source and those behind it rises while sources are capped and
    falls afterwards, so the final level is the largest that a source's cap reaches.
    """
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    capped = sizes.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * F.lit(float(most))
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    level = (
        F.sum("source_size").over(every) * F.lit(float(share))
        - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    levelled = capped.withColumn("level", level).withColumn(
        "final", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(every)
    )
    target = F.when(
        F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("weight")), F.col("cap")
    ).otherwise(F.col("final") * F.col("weight"))
    return levelled.select(
        "source", "source_size", "weight", target.alias("target")
    ).withColumn("budget", F.sum("target").over(every))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "",
    hash_ranges: int = HASH_RANGES,
    time_ranges: int = TIME_RANGES,
) -> DataFrame:
    """How often the mix takes every document.

    One row per input row: ``doc_id, size`` (words), ``source, source_size, target, copies`` (0 to
    ``ceil(most)``), ``taken`` (words) and ``finish`` (virtual time of its first copy; null without
    words).

    Null text has size 0; a null source is a source of its own; rows without words are taken 0
    times. Repeated rows count as separate documents; rows of one source with equal ids follow each
    other by size. Reruns give the same mix. An empty table gives no rows. The sources are assumed
    to be a list that fits one task (one row each); their documents are not.
    """
    rounds = int(-(-most // 1))
    # Texts are read and counted once.
    sized = materialise(docs.select(
        F.col("doc_id"),
        word_count(F.col("text")).alias("size"),
        F.col("source").cast("string").alias("source"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_at"),
    ).withColumn(
        "_range", F.floor(F.conv(F.substring("_at", 1, 8), 16, 10).cast("long") * hash_ranges / 2**32)
    ))
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    sizes = ranges.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        F.col("source").alias("_s"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"),
    ).join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    queue = Window.partitionBy("source", "_range").orderBy("_at", "doc_id", "size")
    # Read by three steps below.
    queued = materialise(
        sized.withColumn("_sum", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(queue))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_end", F.col("_offset") + F.col("_sum"))
    )
    copies = (
        queued.filter("size > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_copy"))
        .withColumn("_time", (F.col("_end") + F.col("_copy") * F.col("source_size")) / F.col("target"))
        .withColumn(
            "_slot",
            F.least(F.floor(F.col("_time") * time_ranges), F.lit(time_ranges * LAST_TIME)),
        )
        .select("doc_id", "source", "_range", "_nth", "size", "_at", "_time", "_slot", "budget")
    )
    slots = copies.groupBy("_slot").agg(F.sum("size").alias("_words"))
    earlier = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    running = slots.select(
        F.col("_slot").alias("_t"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base")
    )
    line = (
        Window.partitionBy("_slot")
        .orderBy("_time", F.asc_nulls_last("source"), "_at", "doc_id", "size", "_nth")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # One row per range of time: bounded by the parameter.
    taken = (
        copies.join(F.broadcast(running), F.col("_slot") == F.col("_t"))
        # Ranges that open beyond the budget have nothing to give, whatever their order.
        .filter(F.col("_base") <= F.col("budget") + F.lit(0.5))
        .withColumn("_total", F.sum("size").over(line) + F.col("_base"))
        .filter(F.col("_total") <= F.col("budget") + F.lit(0.5))
        .groupBy(F.col("source").alias("_ts"), F.col("_range").alias("_tr"), F.col("_nth").alias("_tn"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return queued.join(
        taken,
        F.col("source").eqNullSafe(F.col("_ts"))
        & (F.col("_range") == F.col("_tr"))
        & (F.col("_nth") == F.col("_tn")),
        "left",
    ).select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"),
        F.when(F.col("size") > 0, F.col("_end") / F.col("target")).alias("finish"),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix_copies`` and ``mix_finish``.

    Sorting the result by ``mix_finish`` gives the order of the first copies. Rows with the same id,
    source and size share what the mix takes of them, the first by a hash of the text the most; each
    is returned once at most. An input column named like one of the two results is replaced.
    """
    results = ("mix_copies", "mix_finish")
    names = [c for c in docs.columns if c not in results]
    same = ["_id", "_source", "_size"]
    plan = (
        mix_plan(docs, **options)
        .filter("copies > 0")
        .groupBy(F.col("doc_id").alias("_pid"), F.col("source").alias("_ps"), F.col("size").alias("_pn"))
        .agg(F.sort_array(F.collect_list(F.struct("copies", (-F.col("finish")).alias("late"))), False).alias("_taken"))
    )
    rows = docs.select(
        packed(docs, results).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.col("source").cast("string").alias("_source"),
        word_count(F.col("text")).alias("_size"),
        F.xxhash64("text").alias("_text"),
    )
    joined = rows.join(
        plan,
        F.col("_id").eqNullSafe(F.col("_pid")) & F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_size") == F.col("_pn")),
    )
    place = F.row_number().over(Window.partitionBy(*same).orderBy("_text"))
    return (
        joined.withColumn("_place", place)
        .filter(F.col("_place") <= F.size("_taken"))
        .withColumn("_own", F.col("_taken")[F.col("_place") - 1])
        .select(
            *unpacked("_row", names),
            F.col("_own.copies").alias("mix_copies"),
            (-F.col("_own.late")).alias("mix_finish"),
        )
    )
