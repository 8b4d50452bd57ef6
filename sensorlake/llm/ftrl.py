"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Terms are words and runs of marks. Features are single terms and pairs of neighbours, hashed into
``2 ** bits`` places; a pair of equal terms has one feature whatever the term, so that repetition
can be learned. A feature's value is the square root of its share among the text's features, which
makes texts of any length comparable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorlake.llm import tokens

U = np.uint64


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: Bound of the labelled rows that are fitted, the first ones by a hash of their id.
    most_rows: int = 12_000
    passes: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """``text number, place, value`` of all features, sorted by text and place."""
    text, _, term, _ = tokens.words(data, offsets, tokens.MIXED)
    with np.errstate(over="ignore"):
        pair = tokens.mix(term[:-1] * U(3) + term[1:] * U(0x9FB21C651E98DF25))
    pair = np.where(term[:-1] == term[1:], tokens.mix(np.array([7], np.uint64))[0], pair)
    inside = text[:-1] == text[1:]
    of = np.concatenate([text, text[:-1][inside]])
    place = (np.concatenate([term, pair[inside]]) >> U(64 - bits)).astype(np.int64)
    key, counts = np.unique((of << bits) | place, return_counts=True)
    of, place = key >> bits, key & ((1 << bits) - 1)
    total = np.bincount(of, weights=counts, minlength=len(offsets) - 1)
    return of, place, np.sqrt(counts / total[of])


def fit_ftrl(texts: list[str | None], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights of all places; the last one is the intercept. Rows are taken in the given order.

    Both classes count the same: the rarer one's steps are scaled up.
    """
    n = 1 << settings.bits
    z, squares = np.zeros(n + 1), np.zeros(n + 1)

    def weights(at):
        size = np.abs(z[at]) - settings.l1
        step = (settings.beta + np.sqrt(squares[at])) / settings.alpha + settings.l2
        return np.where(size > 0, -np.sign(z[at]) * size / step, 0.0)

    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        out = np.zeros(n + 1)
        out[n] = 0.0 if not len(labels) else (4.0 if share else -4.0)
        return out
    scale = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rows = []
    for first in range(0, len(texts), 256):
        data, offsets = tokens.utf8(pa.array(texts[first : first + 256], pa.large_string()))
        of, place, value = features(data, offsets, settings.bits)
        edges = np.searchsorted(of, np.arange(len(offsets)))
        rows += [
            (np.append(place[a:b], n).astype(np.int32), np.append(value[a:b], 1.0).astype(np.float32))
            for a, b in zip(edges[:-1], edges[1:])
        ]
    for _ in range(settings.passes):
        for (at, value), label, times in zip(rows, labels, scale):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = times * (p - label) * value
            sigma = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / settings.alpha
            z[at] += g - sigma * w
            squares[at] += g * g
    return weights(np.arange(n + 1))


def held_out(of: int, remainder: int):
    """Whether the crc32 of an id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of)) == remainder


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5, out: int = 0) -> np.ndarray:
    """Weights learned from labelled rows outside the fold ``out`` of ``folds``.

    One task fits at most ``settings.most_rows`` rows. Rows without a label, id or text are left
    out; of a document's labels the largest counts, of rows with one id the least text. Without rows,
    or with one class only, the model is constant.
    """
    labelled = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .filter(~held_out(folds, out))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.most_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .filter("text IS NOT NULL")
        .join(F.broadcast(labelled), "doc_id")
        .select(F.xxhash64("doc_id").alias("at"), "doc_id", "text", "label")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "doc_id", "text"]).drop_duplicates("doc_id")
        weights = fit_ftrl(list(group["text"]), group["label"].to_numpy(float), settings)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()]})

    fitted = rows.groupBy(F.lit(1).alias("one")).applyInPandas(fit, "weights binary").first()
    if fitted is None:
        return np.zeros((1 << settings.bits) + 1, np.float32)
    return np.frombuffer(fitted["weights"], "<f4")


def probabilities(column: pa.Array, w: np.ndarray, bits: int) -> np.ndarray:
    """Score of every text; the intercept's for null and empty ones."""
    data, offsets = tokens.utf8(column)
    total = np.full(len(offsets) - 1, w[-1])
    for a, b in tokens.slices(offsets):
        of, place, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
        total[a:b] += np.bincount(of, weights=w[place] * value, minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, bits: int, threshold: float = 0.3) -> DataFrame:
    """``score`` and ``predicted`` beside ``doc_id`` and ``held`` of every row of ``docs``.

    Null and empty texts get the intercept's score. Needs columns ``doc_id, text, held``.
    """
    model = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights, np.float64))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            p = probabilities(batch.column("text"), w, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held").mapInArrow(
        scored, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 5, out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, repeated rows included.

    The crc32 of a null id counts as that of the empty text. Only the text enters a score.
    """
    weights = train(docs, labels, settings, folds, out)
    marked = docs.select("doc_id", "text", held_out(folds, out).alias("held"))
    return score(marked, weights, settings.bits)


def good_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the input's columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings).astype(np.float64))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column("text"), model.value, settings.bits) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def crc_fold(doc_id, folds: int) -> int:
    """The fold of an id, as ``held_out`` has it."""
    return zlib.crc32(str(doc_id).encode()) % folds
