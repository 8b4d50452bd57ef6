"""URL filter by dated lists: entries become validity intervals, captures are judged by an as-of join.

A list is a log of dated entries ``rule, verdict, listed_at``: from then on the rule has the verdict
(``block``, ``allow``, or ``drop``, which takes the rule off the list). A rule is a host name, which
covers its subdomains, or a host name with a path prefix that ends with a slash. A capture is judged
by the entries that are in force when it is fetched; the longest rule decides.

Captures meet rules in their host's suffixes and path prefixes. Equal (rule, time) probes are one
row before anything is shuffled by rule, and times are cut to the list's precision, so a host with a
third of all captures brings no more probes than there are days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorlake.llm.names import packed, unpacked

#: Scheme, optional user, host, optional port; the path ends before ``?`` or ``#``.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Host in lower case without a final dot; empty for a text that is no absolute URL, or null."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def rules_of(url: Column) -> Column:
    """Every rule that could cover a URL: the host and its parent domains, and the host with every
    path prefix that ends with a slash."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    parts = F.split(path(url), "/")
    prefixes = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host(url), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )
    return F.when(host(url) != "", F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """``rule, verdict, valid_from, valid_to`` from dated entries; ``valid_to`` is open (null) for
    the newest. Of entries of one rule and time ``allow`` comes before ``block`` before ``drop``.
    Entries with a null rule or time are left out; an unknown or null verdict counts as ``drop``.
    """
    verdict = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise("drop")
    dated = (
        entries.filter("rule IS NOT NULL AND listed_at IS NOT NULL")
        .groupBy("rule", F.col("listed_at").alias("valid_from"))
        .agg(F.min(verdict).alias("verdict"))
    )
    line = Window.partitionBy("rule").orderBy("valid_from")
    return dated.withColumn("valid_to", F.lead("valid_from").over(line)).select("rule", "verdict", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of ``captures`` (with ``url`` and ``fetched``, of the type of ``listed_at``) and
    ``host, verdict, rule, rule_from``.

    ``verdict`` is ``block``, ``allow``, or ``none`` without a rule in force. An entry is in force
    from its time on, that time included. Null or malformed URLs and null times get ``none``. Input
    columns named like an output are replaced. Repeated rows are judged each; without entries all
    get ``none``; without captures there are no rows.

    The as-of join orders the probes of a rule behind the entries of the same time and carries the
    last entry forward.
    """
    outputs = ("host", "verdict", "rule", "rule_from")
    names = [c for c in captures.columns if c not in outputs]
    kept = captures.select(packed(captures, outputs).alias("_row"), "url", "fetched")
    wanted = kept.select("url", "fetched").filter("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    tried = wanted.select("url", "fetched", F.explode(rules_of(F.col("url"))).alias("rule"))
    listed = intervals(entries)
    probes = tried.select("rule", F.col("fetched").alias("at")).distinct()
    line = Window.partitionBy("rule").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    in_force = (
        probes.join(listed.select("rule").distinct(), "rule", "left_semi")
        .select("rule", "at", F.lit(1).alias("probe"), F.lit(None).cast("string").alias("is"))
        .unionByName(
            listed.select("rule", F.col("valid_from").alias("at"), F.lit(0).alias("probe"), F.col("verdict").alias("is"))
        )
        .withColumn("verdict", F.last("is", ignorenulls=True).over(line))
        .withColumn("rule_from", F.last(F.when(F.col("probe") == 0, F.col("at")), ignorenulls=True).over(line))
        .filter("probe = 1 AND verdict <> 'drop'")
        .select("rule", F.col("at").alias("fetched"), "verdict", "rule_from")
    )
    best = F.struct(F.length("rule"), "rule")
    judged = (
        tried.join(in_force, ["rule", "fetched"])
        .groupBy("url", "fetched")
        .agg(F.max_by(F.struct("verdict", "rule", "rule_from"), best).alias("_found"))
        .select(F.col("url").alias("_url"), F.col("fetched").alias("_fetched"), "_found")
    )
    return kept.join(
        judged, (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_fetched")), "left"
    ).select(
        *unpacked("_row", names),
        host(F.col("url")).alias("host"),
        F.coalesce(F.col("_found.verdict"), F.lit("none")).alias("verdict"),
        F.col("_found.rule").alias("rule"),
        F.col("_found.rule_from").alias("rule_from"),
    )
