"""Exact dedup by content sort, with DataFrame functions only.

Rows are range-partitioned by their first bytes, a content hash and a piece number: Spark samples
these short keys for its splitters, so no whole text reaches the driver. Inside a partition the rows
are sorted by (key, whole text, id) with spilling, which places equal texts side by side; a row opens
a new run where its whole text differs from that of the row before it. A text that many rows share
is dealt to several pieces by id, and the pieces' runs are joined again over a small table with one
row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorlake.llm.names import col, packed, unpacked

PREFIX_BYTES = 24
PIECE_ROWS = 2_000
#: At most this many texts are dealt to pieces, for each shuffle partition.
HOT_PER_PARTITION = 4


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise=None,
    keep: str = "smallest",
    piece_rows: int = PIECE_ROWS,
    carry: bool = False,
) -> DataFrame:
    """Groups rows with equal normalised text.

    One row per input row: the id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``
    and ``text_sha256`` of the normalised text in UTF-8. ``keep`` names the id that stays. With
    ``carry`` all input columns are returned too; an input column named like an output is replaced.

    Null text equals empty text. Rows with a null id belong to their group but stay only where no
    row of it has an id. Of repeated rows (same id and text) one stays. An empty table gives no
    rows. Memory is bounded by Spark's sort; a single text must fit in a row.

    Only the most frequent texts (a fixed number per partition) are dealt to pieces; any other text
    has too few rows to matter to a task.
    """
    rows = _grouped(docs, id_column, text_column, normalise, keep, piece_rows, carry)
    out = [F.col("_id").alias(id_column)]
    if carry:
        taken = (id_column, *RESULTS.values())
        out += [c for name, c in _inputs(docs, id_column, text_column, normalise) if name not in taken]
    return rows.select(*out, *[F.col(work).alias(name) for work, name in RESULTS.items()])


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise=None,
                keep: str = "smallest", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct normalised text, with the input's columns."""
    rows = _grouped(docs, id_column, text_column, normalise, keep, piece_rows, True)
    return rows.filter("_kept").select(*[c for _, c in _inputs(docs, id_column, text_column, normalise)])


#: Working names of the results.
RESULTS = {"_keep_id": "keep_id", "_group_size": "group_size", "_kept": "kept", "_sha": "text_sha256"}


def _inputs(docs: DataFrame, id_column: str, text_column: str, normalise) -> list[tuple[str, Column]]:
    """The input's columns, from the rows of ``_grouped``."""
    out = []
    for name in docs.columns:
        if name == id_column:
            out.append((name, F.col("_id").alias(name)))
        elif name == text_column and normalise is None:
            out.append((name, F.when(~F.col("_no_text"), F.col("_content")).alias(name)))
        else:
            out.append((name, unpacked("_rest", [name])[0]))
    return out


def _grouped(docs, id_column, text_column, normalise, keep, piece_rows, carry) -> DataFrame:
    """Rows with ``_id``, ``_content``, the results and, with ``carry``, other columns as ``_rest``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    content: Column = text if normalise is None else F.coalesce(normalise(text), F.lit(""))
    known = (id_column,) if normalise else (id_column, text_column)
    others = [packed(docs, known).alias("_rest")] if carry else []
    keyed = docs.select(
        col(id_column).alias("_id"),
        content.alias("_content"),
        *([col(text_column).isNull().alias("_no_text")] if carry and normalise is None else []),
        F.xxhash64(content).alias("_hash"),
        *others,
    )
    # The most frequent texts: bounded by the limit, hence safe to broadcast.
    hot = (
        docs.select(F.xxhash64(content).alias("_hot_hash"))
        .groupBy("_hot_hash")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > piece_rows)
        .orderBy(F.desc("_rows"))
        .limit(HOT_PER_PARTITION * partitions)
        .select("_hot_hash", F.ceil(F.col("_rows") / piece_rows).cast("long").alias("_pieces"))
    )
    ranged = (
        keyed.join(F.broadcast(hot), F.col("_hash") == F.col("_hot_hash"), "left")
        .withColumn(
            "_piece",
            F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(11)), F.col("_pieces"))
            ),
        )
        .withColumn("_prefix", F.substring(F.col("_content").cast("binary"), 1, PREFIX_BYTES))
        .drop("_hot_hash")
        .repartitionByRange(partitions, "_prefix", "_hash", "_piece")
    )
    # The window opens a run where a row's key or whole text differs from that of the row before.
    run = [*(F.col(c) for c in ("_prefix", "_hash", "_piece", "_content"))]
    largest = keep == "largest"
    line = Window.partitionBy(*run).orderBy(
        F.desc_nulls_last("_id") if largest else F.asc_nulls_last("_id")
    )
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.max if largest else F.min
    local = ranged.withColumns(
        {
            "_best": best("_id").over(every),
            "_size": F.count(F.lit(1)).over(every),
            "_place": F.row_number().over(line),
            "_sha": F.sha2(F.col("_content").cast("binary"), 256),
        }
    )
    # One row per piece of a hot text; whole texts are compared again across pieces. The piece that
    # holds the best id leads; pieces without any id have none, then the first piece does.
    leading = F.struct(F.col("_best") if largest else -F.col("_best"), -F.col("_piece"))
    whole = (
        local.filter(F.col("_pieces").isNotNull() & (F.col("_place") == 1))
        .groupBy("_content")
        .agg(
            F.first("_sha").alias("_whole_sha"),
            best("_best").alias("_all_best"),
            F.sum("_size").alias("_all_size"),
            F.max_by("_piece", leading).alias("_lead"),
        )
        .drop("_content")
    )
    # As few rows as there are hot texts, hence safe to broadcast.
    joined = local.join(
        F.broadcast(whole),
        F.col("_pieces").isNotNull() & (F.col("_sha") == F.col("_whole_sha")),
        "left",
    )
    split = F.col("_all_size").isNotNull()
    return joined.withColumns(
        {
            "_keep_id": F.when(split, F.col("_all_best")).otherwise(F.col("_best")),
            "_group_size": F.coalesce("_all_size", "_size").cast("long"),
            "_kept": (F.col("_place") == 1) & F.when(split, F.col("_piece") == F.col("_lead")).otherwise(True),
        }
    )
