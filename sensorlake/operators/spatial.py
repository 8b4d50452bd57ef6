"""Inverse-distance surfaces over a cell grid.

Positions are a short list, whose nodes become columns, or a table ``(node, px, py)`` of any length, whose
nodes are dealt to blocks that add up partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sensorlake.schema import GRID_HEIGHT, GRID_WIDTH

#: Nodes of a block and grid lines of a tile, for tables of positions.
BLOCK_NODES, TILE_ROWS = 256, 8


def _tiled(readings, positions, by, weight, nx, ny, width, height, when_empty) -> DataFrame:
    """One value per cell for every ``by`` group, from nodes given as a table.

    A snapshot's nodes are packed into blocks; a block goes to every tile of the grid, and a tile's
    blocks meet in one task, where each adds its weighted sum and its weight to the cells. Only
    blocks are shuffled, never cells. Readings of a node without a position are left out.
    """
    sites = positions.dropDuplicates(["node"])
    blocks_of = max(1, -(-sites.count() // BLOCK_NODES))
    number = F.pmod(F.xxhash64("node"), F.lit(blocks_of)).alias("_block")
    sites = sites.select("node", "px", "py", number)
    blocks = (
        readings.filter(F.col("value").isNotNull())
        .groupBy(*by, "node")
        .agg(F.first("value").alias("value"))
        .join(sites, "node")
        .groupBy(*by, "_block")
        .agg(F.collect_list(F.struct("px", "py", "value")).alias("_nodes"))
    )
    tasks = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.least(F.col("_tile") * TILE_ROWS + (TILE_ROWS - 1), F.lit(ny - 1))
    cells = (
        blocks.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit((ny - 1) // TILE_ROWS))))
        .repartition(tasks, *by, "_tile")
        .withColumn("row", F.explode(F.sequence(F.col("_tile") * TILE_ROWS, last)))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
        .withColumn("x", F.col("col") * (width / (nx - 1)))
        .withColumn("y", F.col("row") * (height / (ny - 1)))
        .select(*by, "_tile", "row", "col", "x", "y", F.inline("_nodes"))
        .withColumn("_w", weight(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    )
    # The tile stands among the keys, so that the rows are where the sum needs them already.
    sums = cells.groupBy(*by, "_tile", "row", "col", "x", "y").agg(
        F.sum(F.col("_w") * F.col("value")).alias("_top"), F.sum("_w").alias("_bottom")
    )
    z = F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).otherwise(when_empty)
    return sums.select(*by, "row", "col", "x", "y", z.alias("z"))


def _surface(
    readings: DataFrame,
    positions: list[tuple[str, float, float]] | DataFrame,
    by: list[str],
    weight,
    nx: int,
    ny: int,
    width: float,
    height: float,
    when_empty: Column,
) -> DataFrame:
    """One value per cell for every ``by`` group.

    The node values of a group become columns of one row first; the cells are generated from that
    row, so no join or shuffle sees cells. Groups are few and small while their cells are many, so
    the grid lines are spread over a fixed number of tasks before the columns are generated.
    """
    if isinstance(positions, DataFrame):
        return _tiled(readings, positions, by, weight, nx, ny, width, height, when_empty)
    nodes = [p[0] for p in positions]
    wide = readings.groupBy(*by).pivot("node", nodes).agg(F.first("value", True))
    known = F.greatest(*[F.col(n).isNotNull() for n in nodes])
    tasks = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = (
        wide.filter(known)
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
        .repartition(tasks, *by, "row")
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
        .withColumn("x", F.col("col") * (width / (nx - 1)))
        .withColumn("y", F.col("row") * (height / (ny - 1)))
    )
    top = bottom = F.lit(0.0)
    for node, px, py in positions:
        w = weight(F.col("x") - px, F.col("y") - py)
        top = top + F.when(F.col(node).isNotNull(), w * F.col(node)).otherwise(0.0)
        bottom = bottom + F.when(F.col(node).isNotNull(), w).otherwise(0.0)
    z = F.when(bottom > 0, top / bottom).otherwise(when_empty)
    return cells.select(*by, "row", "col", "x", "y", z.alias("z"))


def heat_grid(
    readings: DataFrame,
    positions: list[tuple[str, float, float]] | DataFrame,
    by: list[str] = ["metric"],
    nx: int = 300,
    ny: int = 300,
    width: float = GRID_WIDTH,
    height: float = GRID_HEIGHT,
) -> DataFrame:
    """Weight ``1 / (distance + 1e-6)^2``; one snapshot per ``by`` group."""

    def weight(dx, dy):
        distance = F.hypot(dx, dy) + 1e-6
        return F.lit(1.0) / (distance * distance)

    return _surface(readings, positions, by, weight, nx, ny, width, height, F.lit(0.0))


def frame_grid(
    frames: DataFrame,
    positions: list[tuple[str, float, float]] | DataFrame,
    by: list[str] = ["ts", "metric"],
    nx: int = 200,
    ny: int = 200,
    width: float = GRID_WIDTH,
    height: float = GRID_HEIGHT,
) -> DataFrame:
    """Weight ``1 / max(distance^2, 1e-10)``; 0 where no node has a value."""

    def weight(dx, dy):
        return F.lit(1.0) / F.greatest(dx * dx + dy * dy, F.lit(1e-10))

    return _surface(frames, positions, by, weight, nx, ny, width, height, F.lit(0.0))
