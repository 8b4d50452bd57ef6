"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation may hold an opening system row and then pairs of a user and an assistant row. What
to do with every row of a damaged one is a deduction: the item ``(i, state)`` says that the first
``i`` rows are settled and what the rows so far end with, the axiom ``row i`` is the i-th row, and a
rule joins both to the next item by keeping, re-roling or deleting the row, or steps to another state
by inserting one. A weight is ``(cost, audit)`` where the audit spells the edits made so far. Every rule
adds to the cost and appends to the audit of its first antecedent, so no conclusion weighs less than
its antecedents and lighter antecedents give lighter conclusions: items popped from the agenda in
order of weight are final, and the first goal popped is the lightest repair.

Audits are linked nodes with jump pointers, so two of them are compared in logarithmic time and a
conversation of n rows needs about n log n steps, not n strings of length n. Spark finds faults and
orders the rows; only one character for each row goes into the deduction, and the repaired texts are
streamed. A conversation is one audit and one text, so its rows meet in one task, which holds one
Arrow batch of them and one character for each row.

Null roles and texts count as one space, null turns come first, rows of the same turn are ordered by
role, text and copy. A null ``conv_id`` is a conversation of its own. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLANK = r"\x20\x09-\x0D"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What the settled rows end with: nothing, a system row, a user row, a pair.
NOTHING, SYSTEM, USER, PAIR = range(4)
#: The state that a row with a role's initial leads to.
NEXT = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, PAIR: USER},
    "a": {USER: PAIR},
}
ROLE_OF = {"u": "user", "a": "assistant"}
MOST_CACHED = 1_000


# Deduction


class Audit:
    """A string that only grows at its end; ``<`` is the order of the spelled strings.

    Compared strings belong to one tree of extensions, in which no two nodes spell the same.
    """

    __slots__ = ("parent", "jump", "depth", "edit")

    def __init__(self, parent: Audit | None = None, edit: str = ""):
        self.edit = edit
        if parent is None:
            self.parent = self.jump = self
            self.depth = 0
            return
        self.parent, self.depth = parent, parent.depth + 1
        near = parent.jump
        even = parent.depth - near.depth == near.depth - near.jump.depth
        self.jump = near.jump if even else parent

    def upto(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node

    def __lt__(self, other: Audit) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.upto(depth), other.upto(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.edit < b.edit

    def __str__(self) -> str:
        edits, node = [], self
        while node.depth:
            edits.append(node.edit)
            node = node.parent
        return "".join(reversed(edits))


class Weight(NamedTuple):
    cost: int
    audit: Audit


def lightest_derivation(
    axioms: Iterable[tuple[tuple, Weight]],
    conclusions: Callable[[tuple, dict[tuple, Weight]], Iterator[tuple[tuple, Weight]]],
    goal: tuple,
) -> Weight | None:
    """Weight of the lightest derivation of ``goal``, by an agenda ordered by weight.

    ``conclusions(item, final)`` yields the heads, with weights, of the rules that ``item`` completes:
    those whose antecedents are all in ``final`` now.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[tuple, Weight] = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            return weight
        for head, heavier in conclusions(item, final):
            if head not in final:
                heapq.heappush(agenda, (heavier, head))
    return None


def lightest_repair(shape: str) -> tuple[int, str]:
    """``cost, audit`` of the cheapest repair; of equally cheap ones the audit that sorts first.

    ``shape`` has a character for each row: ``x`` where the row has to go, else the initial of its
    role if that is ``s``, ``u`` or ``a``, else ``o``; in upper case where the text is truncated.
    """
    n = len(shape)
    empty = Audit()

    def then(weight: Weight, cost: int, edit: str) -> Weight:
        return Weight(weight.cost + cost, Audit(weight.audit, edit))

    def settle(i: int, state: int, weight: Weight):
        """Rules with the antecedents ``(i, state)`` and ``row i``."""
        mark = shape[i]
        yield ("settled", i + 1, state), then(weight, DELETE, "D")
        if mark == "x":
            return
        extra = TRUNCATED if mark.isupper() else 0
        kept = NEXT.get(mark.lower(), {}).get(state)
        if kept is not None:
            yield ("settled", i + 1, kept), then(weight, extra, "K")
        for initial in ROLE_OF:
            if state in NEXT[initial]:
                yield ("settled", i + 1, NEXT[initial][state]), then(weight, REROLE + extra, "R")

    def conclusions(item, final):
        if item[0] == "row":
            i = item[1]
            for state in range(4):
                if ("settled", i, state) in final:
                    yield from settle(i, state, final["settled", i, state])
            return
        _, i, state = item
        weight = final[item]
        if i < n and ("row", i) in final:
            yield from settle(i, state, weight)
        for initial in ROLE_OF:
            if state in NEXT[initial]:
                yield ("settled", i, NEXT[initial][state]), then(weight, INSERT, "I")
        if i == n and state in (NOTHING, PAIR):
            yield ("whole",), weight

    start = Weight(0, empty)
    axioms = [(("settled", 0, NOTHING), start), *((("row", i), start) for i in range(n))]
    found = lightest_derivation(axioms, conclusions, ("whole",))
    return found.cost, str(found.audit)


@lru_cache(100_000)
def common_repair(shape: str) -> tuple[int, str]:
    """``lightest_repair`` of short shapes, which many conversations share."""
    return lightest_repair(shape)


# Spark


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of ``conv_id:turn`` modulo 20: 0 drops a row (it stays with
    ``dropped``, so that its conversation is not lost), 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 makes it a user's. Nulls count as one space."""

    def or_space(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = or_space("text")
    return (
        rows.select("conv_id", "turn", or_space("role").alias("_role"), text.alias("_text"), fate.alias("_fate"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fate") == 4, "user").otherwise(F.col("_role")).alias("role"),
            F.when(F.col("_fate") == 1, "")
            .when(F.col("_fate") == 2, F.regexp_replace("_text", "[.!?]", ""))
            .otherwise(F.col("_text"))
            .alias("text"),
            "copy",
            (F.col("_fate") == 0).alias("dropped"),
        )
    )


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, role, text, dropped, fault, initial, illegal`` of every row.

    ``pos`` counts a conversation's rows that are not dropped from 1. ``fault`` is the first of
    blank, duplicate and truncated that holds; ``illegal`` marks a row whose role may not follow the
    one before. Optional columns: ``dropped`` and ``copy`` (the order of repeated rows).

    All windows share one shuffle by ``conv_id``.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    copy = F.col("copy") if "copy" in rows.columns else F.lit(1)
    clean = rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        copy.alias("copy"),
        F.coalesce(dropped, F.lit(False)).alias("dropped"),
    )
    line = Window.partitionBy("conv_id").orderBy(
        F.asc("dropped"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")
    )
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    follows = F.concat(F.lag(initial).over(line), initial)
    return (
        clean.withColumn("pos", F.row_number().over(line))
        .withColumn("illegal", ~F.coalesce(follows.isin("su", "ua", "au"), F.col("pos") == 1))
        .withColumn("_seen", F.row_number().over(same) > 1)
        .withColumn("_last", last)
        .withColumn(
            "fault",
            F.when(F.col("_last") == "", "blank")
            .when(F.col("_seen"), "duplicate")
            .when(~F.col("_last").isin(".", "!", "?"), "truncated"),
        )
        .select("conv_id", "pos", "turn", "role", "text", "dropped", "fault", initial.alias("initial"), "illegal")
    )


def reports(found: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: ``gaps, blank, duplicate, truncated, illegal`` and
    ``cost, audit`` of its lightest repair. Without rows all are zero and the audit is empty."""
    real = ~F.col("dropped")
    turn = F.when(real, F.col("turn"))
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(
        F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    )
    mark = F.when(F.col("fault") == "truncated", F.upper(mark)).otherwise(mark)
    # A turn's first row, so that distinct turns are counted without gathering them.
    first = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("dropped", "pos"))
    new_turn = real & F.col("turn").isNotNull() & (first.isNull() | (first != F.col("turn")))
    shapes = (
        found.withColumn("_new", new_turn)
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if("_new"), F.lit(0)).cast("long").alias("gaps"),
            *[
                F.count_if(real & (F.col("fault") == name)).alias(name)
                for name in ("blank", "duplicate", "truncated")
            ],
            F.count_if(real & F.col("illegal")).alias("illegal"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.when(real, F.struct("pos", mark.alias("mark"))))),
                    lambda row: row["mark"],
                ),
                "",
            ).alias("_shape"),
        )
    )

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (common_repair if len(shape) <= MOST_CACHED else lightest_repair)(shape)
                for shape in batch.column("_shape").to_pylist()
            ]
            kept = [name for name in batch.schema.names if name != "_shape"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in kept),
                    pa.array([cost for cost, _ in found], pa.int64()),
                    pa.array([audit for _, audit in found], pa.string()),
                ],
                names=[*kept, "cost", "audit"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shapes.schema if f.name != "_shape")
    return shapes.mapInArrow(repaired, f"{kept}, cost long, audit string")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``, with places from 1.

    At place 0 every conversation has a row with its ``reports`` in the columns ``gaps, blank,
    duplicate, truncated, illegal, cost, audit``; elsewhere these are null. Rows of a conversation lie
    together and in order inside a partition.
    """
    found = faults(rows)
    report = reports(found)
    kind = found.schema["conv_id"].dataType.simpleString()
    texts = found.filter(~F.col("dropped")).select("conv_id", F.col("pos").cast("int").alias("pos"), "role", "text")
    for name in REPORT:
        texts = texts.withColumn(name, F.lit(None).cast("long"))
    texts = texts.withColumn("audit", F.lit(None).cast("string"))
    heads = report.select(
        "conv_id", F.lit(0).alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), *REPORT, "audit"
    )
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    names = ["conv_id", "place", "edit", "role", "text", *REPORT, "audit"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(REPORT), pa.string()]

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, NOTHING, 0
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, pos, role, text, *report in zip(*columns):
                if pos == 0:
                    audit, at, state, place = report[-1], 0, NOTHING, 0
                    out.append((conv, 0, None, "", "", *report))
                    mine = 0
                else:
                    mine = 1
                # The edits up to the next row's: insertions, then this row's own, then insertions.
                while at < len(audit) and (mine or audit[at] == "I"):
                    edit = audit[at]
                    at += 1
                    if edit != "I":
                        mine = 0
                    if edit == "D":
                        continue
                    initial = role[:1] if edit == "K" else "a" if state == USER else "u"
                    state = NEXT[initial][state]
                    place += 1
                    said = (role, text) if edit == "K" else (ROLE_OF[initial], text if edit == "R" else "")
                    out.append((conv, place, edit, *said, *[None] * (len(REPORT) + 1)))
            if out:
                arrays = [
                    pa.array(column, kind or batch.schema.field("conv_id").type)
                    for column, kind in zip(zip(*out), types)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    longs = ", ".join(f"{name} long" for name in REPORT)
    return stream.mapInArrow(
        replayed, f"conv_id {kind}, place long, edit string, role string, text string, {longs}, audit string"
    )


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: its report and ``repaired_sha256``, the hash of the repaired
    ``role:text`` joined by line ends. Read in the order of ``repaired_rows``, a batch at a time."""
    repaired = repaired_rows(rows)
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *REPORT, "audit", "repaired_sha256"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, hashlib.sha256()
        schema = None
        for batch in batches:
            schema = pa.schema(
                [batch.schema.field("conv_id"), *(batch.schema.field(n) for n in (*REPORT, "audit")),
                 pa.field("repaired_sha256", pa.string())]
            )
            done = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, place, _, role, text, *report in zip(*columns):
                if place == 0:
                    if head is not None:
                        done.append((*head, digest.hexdigest()))
                    head, digest = (conv, *report), hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if done:
                yield _table(done, schema)
        if head is not None:
            yield _table([(*head, digest.hexdigest())], schema)

    def _table(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*done), schema)], names=names
        )

    longs = ", ".join(f"{name} long" for name in REPORT)
    return repaired.mapInArrow(digested, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
