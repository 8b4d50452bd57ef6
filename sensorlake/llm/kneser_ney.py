"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary documents each get two interpolated Kneser-Ney models. One gives a word's probability:
its continuation count in the class (the different words before it), discounted, over backoff counts
that both classes share, the occurrences of words in all documents. The other spells words byte by byte
with six-grams that back off order by order, so that forms never met are judged by their parts. Discounts
follow from each order's counts of counts (one each for counts of one, two and more) and so lie below
the count they are taken from; what they free goes to the next lower order. A rare expression keeps
little of its own count and falls back to what is shared, where it says nothing about the class.

A text is judged by differences of toxic and ordinary log-likelihoods, per word: their mean over the
text, the mean of its two highest words, and the share of words beyond ``CLEAR``, from each model. A
logistic curve over these, fitted on labelled documents that the models have not seen, gives 0..1.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sensorlake.llm import tokens
from sensorlake.llm.ftrl import held_out

U = np.uint64
#: A log-likelihood difference that a word of one class only has, in nats.
CLEAR = 2.0
ORDER = 6
#: Bits of a byte of a spelled word; 257 and 258 open and close a word, 0 is no byte.
SYMBOL, OPEN, CLOSE = 9, 257, 258


@dataclass(frozen=True)
class Settings:
    #: Bound of the labelled documents of each class, the first ones by a hash of their id.
    most_rows: int = 4_000
    #: Places for the shared word counts; words that share a place share their counts.
    bits: int = 21
    threshold: float = 0.3


def _place(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> U(64 - bits)).astype(np.int64)


def _stretches(column: pa.Array):
    """``first text, last text, bytes, text of each word, begins, ends, hashes`` of stretches."""
    data, offsets = tokens.utf8(pc.utf8_lower(column))
    for a, b in tokens.slices(offsets):
        own, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        text, begin, words, _ = tokens.words(own, edges, tokens.LETTERS)
        border = np.ones(len(own) + 1, bool)
        border[:-1] = tokens.LETTERS[own] == 0
        border[edges] = True
        stops = np.flatnonzero(border)
        end = stops[np.searchsorted(stops, begin, side="right")] if len(begin) else begin
        yield a, b, own, text, begin, end, words


def _pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tokens.mix(before * U(0xD6E8FEB86659FD93) + words)


def shared_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """Occurrences of words over all documents, by place. Tasks add up in arrays of a fixed size;
    the driver gets one row per place at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for *_, words in _stretches(batch.column("text")):
                np.add.at(total, _place(words, bits), 1)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    rows = docs.select("text").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("place").to_numpy().astype("<i4").tobytes()], pa.binary()),
                    pa.array([batch.column("n").to_numpy().astype("<i8").tobytes()], pa.binary()),
                ],
                names=["place", "n"],
            )

    out = np.zeros(1 << bits)
    for row in rows.mapInArrow(packed, "place binary, n binary").toLocalIterator():
        out[np.frombuffer(row["place"], "<i4")] += np.frombuffer(row["n"], "<i8")
    return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """What counts of 1, 2 and more lose, from the counts of counts; index 0 is 0. Where these say
    nothing (a count of counts is zero), the estimate of the count before it, or a half, stands."""
    n = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(float)
    out, last = np.zeros(4), 0.5
    share = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for j in (1, 2, 3):
        if share and n[j - 1] and n[j]:
            last = j - (j + 1) * share * n[j] / n[j - 1]
        out[j] = min(max(last, 0.05), j - 0.02)
    return out


def _lost(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[np.minimum(counts, 3).astype(np.int64)]


def _look(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each of ``values`` at ``wanted``, zero where it is not among the sorted ``keys``."""
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return [np.where(known, v[at], 0.0) for v in values]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys))


class WordModel:
    """Discounted continuation counts of a class over a shared word distribution."""

    def __init__(self, columns: list[pa.Array]):
        seen = []
        for column in columns:
            for _, _, _, text, _, _, words in _stretches(column):
                before = np.zeros(len(words), U)
                before[1:] = np.where(text[1:] == text[:-1], words[:-1], U(0))
                _, first = np.unique(_pair_hash(before, words), return_index=True)
                seen.append(np.stack([before[first], words[first]]))
        both = np.concatenate(seen, axis=1) if seen else np.zeros((2, 0), U)
        _, first = np.unique(_pair_hash(both[0], both[1]), return_index=True)
        self.words, counts = np.unique(both[1][first], return_counts=True)
        lost = _lost(counts, discounts(counts))
        total = max(int(counts.sum()), 1)
        self.rate = (counts - lost) / total
        self.free = float(lost.sum() / total) if len(counts) else 1.0

    def probability(self, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return _look(self.words, words, self.rate)[0] + self.free * shared


def spelled(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the last ``ORDER`` symbols up to every symbol of the words, but for the opening. Symbols
    of a word follow one another; a code has fewer where the word opens within them."""
    length = end - begin + 2
    edge = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(edge[-1]) - np.repeat(edge[:-1], length)
    place = np.repeat(begin, length) + at - 1
    last = np.repeat(length, length) - 1
    symbols = np.where(at == 0, OPEN, np.where(at == last, CLOSE, 0)).astype(np.int64)
    inner = symbols == 0
    symbols[inner] = data[place[inner]].astype(np.int64) + 1
    code = symbols.copy()
    for i in range(1, ORDER):
        code[i:] += np.where(at[i:] >= i, symbols[:-i], 0) << (SYMBOL * i)
    return code[at > 0]


class SpellingModel:
    """Byte n-grams of a class's words. The highest order counts occurrences, as does any order at the
    opening of a word; lower ones count the different symbols before."""

    def __init__(self, columns: list[pa.Array]):
        codes, counts = [], []
        for column in columns:
            for _, _, data, _, begin, end, words in _stretches(column):
                _, first, times = np.unique(words, return_index=True, return_counts=True)
                times = np.repeat(times, end[first] - begin[first] + 1)
                code, n = _summed(spelled(data, begin[first], end[first]), times)
                codes.append(code)
                counts.append(n)
        code, count = _summed(
            np.concatenate(codes) if codes else np.zeros(0, np.int64), np.concatenate(counts) if counts else np.zeros(0)
        )
        size = _sizes(code)
        self.levels = []
        lower_code, lower_count = np.zeros(0, np.int64), np.zeros(0)
        for k in range(ORDER, 0, -1):
            own = size == k
            keys, n = _summed(np.concatenate([code[own], lower_code]), np.concatenate([count[own], lower_count]))
            lost = _lost(n, discounts(n))
            context, total = _summed(keys >> SYMBOL, n)
            free = _summed(keys >> SYMBOL, lost)[1]
            self.levels.append((keys, n - lost, context, total, free))
            lower_code = keys & ((1 << (SYMBOL * (k - 1))) - 1)
            lower_count = np.ones(len(lower_code))
        self.levels.reverse()

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Of each code's last symbol after the others."""
        p = np.full(len(code), 1 / CLOSE)
        for k, (keys, kept, context, total, free) in enumerate(self.levels, 1):
            gram = code & ((1 << (SYMBOL * k)) - 1)
            n, f = _look(context, gram >> SYMBOL, total, free)
            c = _look(keys, gram, kept)[0]
            # A code that is shorter than the order has no such history.
            known = (n > 0) & ((k == 1) | (gram >> (SYMBOL * (k - 1)) > 0))
            n = np.where(known, n, 1.0)
            p = np.where(known, c / n + f / n * p, p)
        return np.log(p)


def _sizes(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code), np.int64)
    for k in range(ORDER):
        out += code >> (SYMBOL * k) > 0
    return out


#: A task remembers the results of at most this many words; then it begins anew.
MOST_MET = 1 << 20
_NONE_MET = np.zeros(0, U), np.zeros((2, 0))


class Models:
    """Both models of both classes."""

    def __init__(self, toxic: list[pa.Array], ordinary: list[pa.Array], shared: np.ndarray, s: Settings):
        self.bits = s.bits
        self.shared = ((shared + 0.1) / (shared.sum() + 0.1 * len(shared))).astype(np.float32)
        self.words = WordModel(toxic), WordModel(ordinary)
        self.spelling = SpellingModel(toxic), SpellingModel(ordinary)
        self.met = _NONE_MET

    def state(self) -> dict:
        """Plain arrays and numbers, to be sent to other processes."""
        return {"bits": self.bits, "shared": self.shared, "words": [vars(m) for m in self.words],
                "spelling": [m.levels for m in self.spelling]}

    @classmethod
    def from_state(cls, state: dict) -> Models:
        out = cls.__new__(cls)
        out.bits, out.shared = state["bits"], state["shared"]
        out.words, out.spelling, out.met = [], [], _NONE_MET
        for fields in state["words"]:
            out.words.append(WordModel.__new__(WordModel))
            vars(out.words[-1]).update(fields)
        for levels in state["spelling"]:
            out.spelling.append(SpellingModel.__new__(SpellingModel))
            out.spelling[-1].levels = levels
        return out

    def differences(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of words, a row for each of the two models."""
        shared = self.shared[_place(words, self.bits)].astype(float)
        toxic, ordinary = (np.log(m.probability(words, shared)) for m in self.words)
        code, back = np.unique(spelled(data, begin, end), return_inverse=True)
        gain = (self.spelling[0].log_probability(code) - self.spelling[1].log_probability(code))[back]
        of = np.repeat(np.arange(len(words)), end - begin + 1)
        return np.stack([toxic - ordinary, np.bincount(of, weights=gain, minlength=len(words))])

    def of_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The same for sorted distinct words; those met before are looked up."""
        known, values = self.met if len(self.met[0]) < MOST_MET else _NONE_MET
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        new = known[at] != words if len(known) else np.ones(len(words), bool)
        out = np.empty((2, len(words)))
        out[:, ~new] = values[:, at[~new]]
        if new.any():
            out[:, new] = self.differences(data, begin[new], end[new], words[new])
            places = np.searchsorted(known, words[new])
            self.met = np.insert(known, places, words[new]), np.insert(values, places, out[:, new], axis=1)
        return out

    def features(self, column: pa.Array) -> np.ndarray:
        """Six numbers for each text; zeros without words."""
        out = np.zeros((len(column), 6))
        for a, b, data, text, begin, end, words in _stretches(column):
            if not len(words):
                continue
            _, first, back = np.unique(words, return_index=True, return_inverse=True)
            values = self.of_words(data, begin[first], end[first], words[first])[:, back]
            n = np.bincount(text, minlength=b - a)
            some = np.flatnonzero(n)
            last = np.cumsum(n)[some] - 1
            for k, v in enumerate(values):
                mean = np.bincount(text, weights=v, minlength=b - a) / np.maximum(n, 1)
                clear = np.bincount(text, weights=v > CLEAR, minlength=b - a) / np.maximum(n, 1)
                rising = v[np.lexsort((v, text))]
                top = np.zeros(b - a)
                top[some] = np.where(n[some] > 1, (rising[last] + rising[np.maximum(last - 1, 0)]) / 2, rising[last])
                out[a:b, 3 * k : 3 * k + 3] = np.stack([mean, top, clear], axis=1)
        return out


class Curve:
    """Logistic regression on standardised features, by Newton steps with a little shrinkage."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = np.zeros(x.shape[1] + 1)
        data, pull = self._data(x), np.r_[np.ones(x.shape[1]), 1e-6]
        for _ in range(60):
            p = self._chance(data)
            g = data.T @ (p - y) + pull * self.weights
            h = (data * (p * (1 - p))[:, None]).T @ data + np.diag(pull)
            step = np.linalg.solve(h, g)
            self.weights = self.weights - step
            if np.abs(step).max() < 1e-8:
                break

    def _data(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.spread, np.ones(len(x))]

    def _chance(self, data: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(data @ self.weights, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._chance(self._data(x))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), folds: int = 4, out: int = 2):
    """Models and curve from labelled rows outside fold ``out`` of ``folds`` and the words of all
    documents.

    Of each class at most ``most_rows`` labelled documents are fitted, in one task. Rows without a
    label, id or text are left out; of a document's labels the largest counts, of rows with one id the
    least text. The curve is fitted on the features that two models, each from one half, give the
    other half. Where a class has no document, all scores are alike: near 0 without toxic documents,
    near 1 without ordinary ones. Returns ``(state of Models, Curve)`` or ``(None, score)``.
    """
    spark = docs.sparkSession
    shared = shared_counts(docs, s.bits)
    base = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .filter(~held_out(folds, out))
        .withColumn("at", F.xxhash64("doc_id"))
    )
    picked = None
    for label in (0, 1):
        one = base.filter(F.col("label") == label).orderBy("at", "doc_id").limit(s.most_rows)
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id").select("at", "doc_id", "text", "label")
    counts = spark.sparkContext.broadcast(shared.astype(np.float32))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "doc_id", "text"]).drop_duplicates("doc_id")
        label, text = group["label"].to_numpy(), group["text"]
        half = np.zeros(len(group), int)
        for k in (0, 1):
            half[label == k] = np.arange((label == k).sum()) % 2

        def texts(of: np.ndarray) -> list[pa.Array]:
            return [pa.array(text[of].tolist(), pa.large_string())]

        total = counts.value.astype(float)
        if not (label == 1).any() or not (label == 0).any():
            return pd.DataFrame({"model": [pickle.dumps((None, 1.0 if (label == 1).any() else 0.0))]})
        x, y = [], []
        for side in (0, 1):
            seen, other = half == side, half != side
            if other.any() and (label[seen] == 1).any() and (label[seen] == 0).any():
                models = Models(texts(seen & (label == 1)), texts(seen & (label == 0)), total, s)
                x.append(models.features(texts(other)[0]))
                y.append(label[other])
        models = Models(texts(label == 1), texts(label == 0), total, s)
        if not x:
            x, y = [models.features(texts(label >= 0)[0])], [label]
        curve = Curve(np.concatenate(x), np.concatenate(y).astype(float))
        return pd.DataFrame({"model": [pickle.dumps((models.state(), vars(curve)), protocol=5)]})

    fitted = rows.groupBy(F.lit(1).alias("one")).applyInPandas(fit, "model binary").first()
    if fitted is None:
        return None, 0.0
    return pickle.loads(bytes(fitted["model"]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 4, out: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, repeated rows included.

    Null and empty texts and texts without words have the features zero, no evidence of either class.
    The crc32 of a null id counts as that of the empty text. Only the text enters a score. Columns
    other than ``doc_id`` and ``text`` are ignored.
    """
    s = settings
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, s, folds, out))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, curve = model.value
        if state is not None:
            models, fitted = Models.from_state(state), Curve.__new__(Curve)
            vars(fitted).update(curve)
        for batch in batches:
            column = batch.column("text")
            p = np.full(len(column), curve) if state is None else fitted(models.features(column))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held"), pa.array(p), pa.array((p >= s.threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(folds, out).alias("held")).mapInArrow(
        scored, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
