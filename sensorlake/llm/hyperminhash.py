"""Near-duplicate detection by HyperMinHash.

Every text's set of word shingles is hashed into buckets; a bucket's register holds the smallest hash
as its count of leading zeros and a few mantissa bits. Bands of registers find candidates: texts that
share a band become one cluster. Inside a cluster, pairs whose collision-corrected estimate comes near
the threshold are confirmed on the full sets.

Registers of empty buckets repeat a filled one, chosen by an order of the buckets that is fixed for
each register, so two texts' registers agree with a probability of about their similarity however
small the sets are. With 48 bands of 6 registers a pair of similarity 0.8 shares no band with a
probability below 1e-6, and less above.

Texts with equal sets count once. Clusters are compared in blocks of bounded size, each pair of
blocks on its own; only links that join two parts are emitted, at most one per text and block pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorlake.llm import tokens
from sensorlake.llm.components import connected_components
from sensorlake.llm.names import free_name
from sensorlake.session import materialise

U = np.uint64


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Similarity in hundredths: linked where 100 * common >= threshold * union.
    threshold: int = 80
    bands: int = 48
    rows: int = 6
    mantissa: int = 10
    #: Shingles in a block of a cluster.
    block: int = 200_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def register_orders(k: int) -> np.ndarray:
    """For every register, the rank of each bucket in the order in which it is tried."""
    grid = tokens.mix(np.arange(k * k, dtype=np.uint64) + U(1)).reshape(k, k)
    return np.argsort(np.argsort(grid, axis=1), axis=1).astype(np.int32)


def sketch(of: np.ndarray, values: np.ndarray, texts: int, s: Settings, orders: np.ndarray) -> np.ndarray:
    """Registers of ``texts`` sets given as sorted ``text number, shingle`` pairs; 0 without shingles."""
    k, q = s.registers, s.mantissa
    spread = tokens.mix(values ^ U(0xA0761D6478BD642F))
    bucket = ((spread >> U(32)) * U(k)) >> U(32)
    low = spread & U(0xFFFFFFFF)
    both = np.sort(((of.astype(np.uint64) * U(k) + bucket) << U(32)) | low)
    place = both >> U(32)
    first = np.ones(len(both), bool)
    first[1:] = place[1:] != place[:-1]
    place, low = place[first].astype(np.int64), (both[first] & U(0xFFFFFFFF))
    zeros = np.where(low > 0, 31 - np.floor(np.log2(np.maximum(low, 1).astype(float))), 32).astype(np.uint64)
    rest = (low << (zeros + U(1))) & U(0xFFFFFFFF)
    out = np.zeros(texts * k, np.uint16)
    out[place] = ((zeros << U(q)) | (rest >> U(32 - q))) + U(1)
    out = out.reshape(texts, k)
    filled = out > 0
    counts = filled.sum(axis=1)
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        have = np.flatnonzero(filled[t])
        empty = np.flatnonzero(~filled[t])
        out[t, empty] = out[t, have[orders[np.ix_(empty, have)].argmin(axis=1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, mantissa: int) -> np.ndarray:
    """Similarity estimates of every register row of ``a`` to those of ``b``.

    Unequal minima fall into the same register value with a probability of about 1/3 (equal
    leading zeros) times 2 ** -mantissa; that share is taken out.
    """
    chance = 2.0**-mantissa / 3
    agree = np.stack([(a == row).mean(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))
    return (agree - chance) / (1 - chance)


def _sketched(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = register_orders(s.registers)
        for batch in batches:
            data, offsets = tokens.utf8(batch.column("text"))
            for a, b in tokens.slices(offsets):
                of, values = tokens.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], s.words)
                n = np.bincount(of, minlength=b - a)
                registers = sketch(of, values, b - a, s, orders)
                with np.errstate(over="ignore"):
                    key = np.full((b - a, s.bands), U(0x27D4EB2F165667C5))
                    key += np.arange(s.bands, dtype=np.uint64)
                    for i in range(s.rows):
                        key = key * U(0xD6E8FEB86659FD93) + registers[:, i :: s.rows]
                keys = tokens.mix(key).view(np.int64)
                first, second = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    starts = (np.cumsum(n) - n)[some]
                    first[some] = np.add.reduceat(values, starts)
                    second[some] = np.add.reduceat(tokens.mix(values ^ U(0x2545F4914F6CDD1D)), starts)
                width = pa.array(np.arange(b - a + 1, dtype=np.int32) * s.bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.ListArray.from_arrays(width, pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "n", "set1", "set2", "bands"],
                )

    return run


class Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        root = self.root
        while True:
            up = root[root]
            if np.array_equal(up, root):
                return root
            root = self.root = up


def block_links(texts: list[str], blocks: np.ndarray, s: Settings, orders: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the parts of a block (one block number) or of two blocks (two numbers).

    Positions in ``texts``; of links between two parts already joined none is returned. Pairs of
    one block are not compared where there are two blocks.
    """
    data, offsets = tokens.utf8(pa.array(texts, pa.large_string()))
    n = len(texts)
    of, values = tokens.shingle_sets(data, offsets, s.words)
    sizes = np.bincount(of, minlength=n)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    registers = sketch(of, values, n, s, orders)
    by_value = np.argsort(values, kind="stable")
    owners, ordered = of[by_value], values[by_value]
    low = blocks == blocks.min()
    two = not low.all()
    margin = 6 * np.sqrt(s.threshold * (100 - s.threshold) / s.registers) / 100
    parts, links = Parts(n), []
    for x in range(n):
        if not sizes[x] or (two and not low[x]):
            continue
        others = np.flatnonzero(~low) if two else np.arange(x + 1, n)
        least, most = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[100 * least >= s.threshold * most]
        if not len(others):
            continue
        labels = parts.labels()
        others = others[labels[others] != labels[x]]
        if not len(others):
            continue
        near = estimate(registers[others], registers[x : x + 1], s.mantissa)[:, 0]
        # Small sets are too coarse for the estimate; they are compared in full.
        take = (near >= s.threshold / 100 - margin) | (np.minimum(sizes[others], sizes[x]) <= 64)
        others, near = others[take], near[take]
        if not len(others):
            continue
        mine = values[edges[x] : edges[x + 1]]
        if len(others) <= 8:
            common = np.array([len(np.intersect1d(mine, values[edges[y] : edges[y + 1]], assume_unique=True)) for y in others])
        else:
            a, b = np.searchsorted(ordered, mine, "left"), np.searchsorted(ordered, mine, "right")
            length = b - a
            at = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
            common = np.bincount(owners[at], minlength=n)[others]
        linked = others[100 * common >= s.threshold * (sizes[x] + sizes[others] - common)]
        for y in linked:
            if parts.join(x, int(y)):
                links.append((x, int(y)))
    return links


def _verified(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = register_orders(s.registers)
        held: list[tuple] = []
        now = None

        def close():
            ids = np.array([r[0] for r in held], np.int64)
            pairs = block_links([r[1] or "" for r in held], np.array([r[2] for r in held]), s, orders)
            held.clear()
            return [(int(ids[x]), int(ids[y])) for x, y in pairs]

        links: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "low", "high")))
            for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("id", "text", "block")))):
                if key != now:
                    if held:
                        links += close()
                    now = key
                held.append(row)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([l[i] for l in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
                links = []
        if held:
            links += close()
        yield pa.RecordBatch.from_arrays([pa.array([l[i] for l in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Linked are texts whose shingle sets have the wanted similarity; ``component_id`` is the smallest
    id that is reachable over links, the own one included, and ``kept`` says that it is the own one.
    Null and empty texts, and texts without words, have no shingles and no links. Rows with a null
    id are compared with nothing and keep a null ``component_id`` (``kept`` true). Rows of one id
    are one document; if their texts differ, all links of any of them count. Ids are integers. An
    empty table gives no rows.
    """
    s = settings
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialise(
        slim.mapInArrow(_sketched(s), "doc_id long, n long, set1 long, set2 long, bands array<long>")
    )
    same_set = ["n", "set1", "set2"]
    sets = materialise(
        sketches.filter("n > 0 AND doc_id IS NOT NULL")
        .groupBy(*same_set)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    banded = sets.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
    candidates = (
        banded.join(hubs.select("band", "hub"), "band").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    )
    clusters = connected_components(candidates).withColumnsRenamed({"node": "id", "component": "cluster"})
    members = materialise(clusters.join(sets.select(F.col("rep").alias("id"), "n"), "id"))
    totals = members.groupBy("cluster").agg(F.ceil(F.sum("n") / s.block).cast("int").alias("blocks"))
    dealt = members.join(totals, "cluster").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id"
    )
    links = (
        # Always by shuffle: the tasks grow with the documents.
        tasks.hint("merge").join(slim.withColumnRenamed("doc_id", "id"), "id")
        .repartition("cluster", "low", "high")
        .sortWithinPartitions("cluster", "low", "high")
        .mapInArrow(_verified(s), "a long, b long")
    )
    of_rows = sketches.drop("bands").join(sets.drop("bands"), same_set, "left")
    # Rows of one id with different sets are one document.
    of_ids = of_rows.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("b < a")
    several = of_ids.select("doc_id", "b").join(of_rows.select("doc_id", "rep").distinct(), "doc_id").filter("rep <> b")
    links = links.unionByName(several.select(F.col("rep").alias("a"), "b"))
    parts = connected_components(links).withColumnsRenamed({"node": "rep"})
    named = (
        of_rows
        .join(parts, "rep", "left")
        .withColumn("part", F.coalesce("component", "rep", "doc_id"))
        .select("doc_id", F.col("n").alias("n_shingles"), "part")
    )
    return named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("part")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("part"), F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, with the input's columns.

    Rows with a null id stay; repeated rows of a kept id stay as they are.
    """
    name = free_name(docs, "_dropped")
    dropped = near_groups(docs, settings).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti")
