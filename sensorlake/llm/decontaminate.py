"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are runs of three words of the test items. A seed is rare if chance would hardly put it into
the corpus: its words' frequencies, counted over all documents, multiply to less than a set number
of expected occurrences. (Counting the seed itself would call a passage common that leaked often.)
Documents meet the items in the seeds; around the hits the document's words are aligned with the
item's words by local alignment, which tolerates replaced, missing and added words.

Test items are sent to the tasks in blocks of a bounded number of words, one pass over the documents
for each block, so no step depends on the benchmark being small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sensorlake.llm import tokens

SEED = 3
FLAG_BITS = 20


@dataclass(frozen=True)
class Settings:
    #: Expected occurrences by chance, in the whole corpus, up to which a seed is rare.
    chance: float = 0.5
    #: Least score, as a share of the item's highest possible one, and least number of equal words.
    score: float = 0.5
    least_words: int = 6
    #: Words of test items in one block.
    block_words: int = 400_000
    match: int = 2
    mismatch: int = -1
    gap: int = -1


def _lower_words(column: pa.Array):
    data, offsets = tokens.utf8(pc.utf8_lower(column))
    return data, offsets


def item_words(text: str | None) -> np.ndarray:
    data, offsets = _lower_words(pa.array([text or ""], pa.large_string()))
    return tokens.words(data, offsets, tokens.LETTERS)[2]


def align(doc: np.ndarray, item: np.ndarray, s: Settings) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: score, equal words, first and last doc word.

    One row of the score table at a time (rows are document words), in memory of a few numbers for each
    item word: every cell carries where its alignment began and how many words were equal, so there is
    no way back through a table. Gaps along the item are resolved by a running maximum, since a gap
    costs the same for every word. Of equally good ways a step along both comes before one along the
    document, and that before one along the item; of equal alignments the one that ends first stays.
    """
    n = len(item)
    steps, places = np.arange(n + 1) * s.gap, np.arange(n + 1)
    score, begin, equal = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, -1)
    for i, word in enumerate(doc):
        same = item == word
        both, down = score[:-1] + np.where(same, s.match, s.mismatch), score[1:] + s.gap
        along = both >= down
        row, first, hits = np.zeros(n + 1, np.int64), np.full(n + 1, i + 1, np.int64), np.zeros(n + 1, np.int64)
        np.maximum(both, down, out=row[1:])
        first[1:] = np.where(along, begin[:-1], begin[1:])
        hits[1:] = np.where(along, equal[:-1] + same, equal[1:])
        gone = row <= 0
        row[gone], first[gone], hits[gone] = 0, i + 1, 0
        # The last place up to each cell from which gaps along the item lead to most.
        lifted = row - steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, places, 0))
        score, begin, equal = np.maximum(top + steps, 0), first[source], hits[source]
        begin[score == 0], equal[score == 0] = i + 1, 0
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(equal[j]), int(begin[j]), i)
    return best


class Items:
    """One block of test items, ready for the search: sorted seeds with their item and place."""

    def __init__(self, ids: list[int], words: list[np.ndarray], rare: np.ndarray, s: Settings):
        self.ids, self.words, self.settings = ids, words, s
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        owner, value = tokens.grams(of, flat, SEED)
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        place = np.arange(len(owner)) - first[np.maximum(owner, 0)]
        # An item without a rare seed, or too short for one, is searched by all it has.
        takes = (owner >= 0) & (np.isin(value, rare) | ~np.isin(owner, owner[np.isin(value, rare)]))
        self.short = [i for i, w in enumerate(words) if 0 < len(w) < SEED]
        order = np.argsort(value[takes], kind="stable")
        self.value, self.owner, self.place = value[takes][order], owner[takes][order], place[takes][order]
        self.flags = np.zeros(1 << FLAG_BITS, bool)
        self.flags[(self.value >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True

    def find(self, words: np.ndarray, hits: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        """``item position, score share, equal words, first word, last word`` for a document with
        seeds at the word positions ``hits``."""
        s = self.settings
        low, high = np.searchsorted(self.value, values, "left"), np.searchsorted(self.value, values, "right")
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        where, item = np.repeat(hits, count), self.owner[at]
        begin = where - self.place[at]
        for i in np.unique(item):
            length = len(self.words[i])
            starts = np.sort(begin[item == i])
            # Hits whose implied beginnings lie together belong to one passage.
            breaks = np.flatnonzero(np.diff(starts) > length)
            best = None
            for a, b in zip(np.r_[0, breaks + 1], np.r_[breaks, len(starts) - 1]):
                first = max(0, int(starts[a]) - length // 2)
                last = min(len(words), int(starts[b]) + length + length // 2 + 1)
                score, equal, x, y = align(words[first:last], self.words[i], s)
                if best is None or score > best[0]:
                    best = (score, equal, first + x, first + y)
            share = best[0] / (s.match * length)
            if share >= s.score and best[1] >= min(s.least_words, length):
                yield int(i), share, best[1], best[2], best[3]


def _finds(batch: pa.RecordBatch, block: Items) -> Iterator[tuple]:
    """``row, item position, score share, equal words, first word, last word`` of a batch."""
    data, offsets = _lower_words(batch.column("text"))
    shift = np.uint64(64 - FLAG_BITS)
    for a, b in tokens.slices(offsets):
        text, _, words, _ = tokens.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tokens.LETTERS)
        of, value = tokens.grams(text, words, SEED)
        hit = np.flatnonzero(block.flags[(value >> shift).astype(np.int64)] & (of >= 0))
        if len(hit):
            place = np.searchsorted(block.value, value[hit])
            hit = hit[block.value[np.minimum(place, len(block.value) - 1)] == value[hit]]
        for t in np.unique(of[hit]):
            first, last = np.searchsorted(text, [t, t + 1])
            mine = hit[of[hit] == t]
            for found in block.find(words[first:last], mine - first, value[mine]):
                yield a + int(t), *found
        if block.short:
            counts = np.bincount(text, minlength=b - a)
            for t in np.flatnonzero((counts > 0) & (counts < SEED)):
                mine = words[text == t]
                for i in block.short:
                    if np.array_equal(mine, block.words[i]):
                        yield a + int(t), i, 1.0, len(mine), 0, len(mine) - 1


def _searched(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [(ids[t].as_py(), block.ids[found[0]], *found[1:]) for t, *found in _finds(batch, block)]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "equal", "first_word", "last_word"]),
                schema=pa.schema([("doc_id", ids.type), ("item_id", pa.int64()), ("score", pa.float64()), ("equal", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]),
                preserve_index=False,
            )

    return run


def _cleared(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[t for t, *_ in _finds(batch, items.value)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _word_counts(vocabulary):
    """Per task: counts of the items' words, and the number of all words under key 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flags = vocabulary.value
        counts, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            data, offsets = _lower_words(batch.column("text"))
            for a, b in tokens.slices(offsets):
                words = tokens.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tokens.LETTERS)[2]
                total += len(words)
                words = words[flags[(words >> np.uint64(64 - FLAG_BITS)).astype(np.int64)]]
                place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                counts += np.bincount(place[known[place] == words], minlength=len(known))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(known.view(np.int64), 0)), pa.array(np.append(counts, total))], names=["word", "n"]
        )

    return run


def rare_seeds(docs: DataFrame, words: list[np.ndarray], s: Settings) -> np.ndarray:
    """The seeds of the items that chance would hardly put into ``docs``."""
    known = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    if not len(known):
        return known
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[(known >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
    vocabulary = docs.sparkSession.sparkContext.broadcast((known, flags))
    # As many rows as the block has words.
    counted = docs.select("text").mapInArrow(_word_counts(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(counted["word"].to_numpy().astype(np.int64).view(np.uint64).tolist(), counted["n"]))
    total = max(int(n.get(0, 0)), 1)
    rare = []
    for w in words:
        of, value = tokens.grams(np.zeros(len(w), np.int64), w, SEED)
        share = np.array([n.get(x, 0) for x in w.tolist()]) / total
        for i in range(len(value)):
            if share[i : i + SEED].prod() * total <= s.chance:
                rare.append(value[i])
    return np.array(sorted(set(rare)), np.uint64)


def item_blocks(benchmark: DataFrame, s: Settings) -> list[list[tuple[int, str]]]:
    """Test items in blocks of a bounded number of words (one block is held at a time)."""
    sized = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text", F.length("text").cast("long").alias("size")
    ).distinct()
    most = s.block_words * 6
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // most))
    numbered = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for i in range(blocks):
        yield [(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == i).orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, score, equal, first_word, last_word`` of every document and test item that
    align well enough; the word numbers give the passage, among the document's words.

    ``score`` is the alignment's share of the highest score the item allows. Words are runs of
    letters and digits in lower case. Null and empty texts, and items without words, align with
    nothing; items of one or two words match only documents with the same words and no other.
    Repeated rows are reported once per row; equal items under several ids are reported for each.
    Without documents or items there are no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, equal long, first_word long, last_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in searches(docs, benchmark, settings):
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(_searched(items), schema))
    return found


def searches(docs: DataFrame, benchmark: DataFrame, s: Settings):
    """The blocks of test items, each sent to the tasks."""
    for block in item_blocks(benchmark, s):
        kept = [(i, w) for i, w in ((i, item_words(t)) for i, t in block) if len(w)]
        if kept:
            words = [w for _, w in kept]
            items = Items([i for i, _ in kept], words, rare_seeds(docs, words, s), s)
            yield docs.sparkSession.sparkContext.broadcast(items)


def decontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without a passage of a test item, with the input's columns."""
    clean = docs
    for items in searches(docs, benchmark, settings):
        clean = clean.mapInArrow(_cleared(items), docs.schema)
    return clean
