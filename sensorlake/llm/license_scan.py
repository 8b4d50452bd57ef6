"""License scan: MinHash bands over overlapping text windows find templates, exact containment of
their shingles verifies them.

Templates are grouped by length. For each group a text is read in windows half again as long as the
longest template of the group, each beginning a quarter of the shortest one after the window before,
so a template that a text holds lies whole in some window. Its similarity to that window is then at
least 1/2 (the window's other shingles), and with 40 bands of 2 minima the two share a band with a
probability above 0.99999. A find is confirmed on the shingles themselves, at the place where they
begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sensorlake.llm import tokens

U = np.uint64

# Names and wording of common licence notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("all-rights-reserved", "All rights reserved."),
]


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    bands: int = 40
    rows: int = 2
    #: Share of a template's shingles that a place must hold.
    contained: float = 0.8


def _text_words(column: pa.Array):
    data, offsets = tokens.utf8(pc.utf8_lower(column))
    for a, b in tokens.slices(offsets):
        text, _, words, _ = tokens.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tokens.LETTERS)
        yield a, text, words


class Group:
    """Templates of similar length, with the bands of their minima."""

    def __init__(self, members: list[tuple[str, np.ndarray]], s: Settings):
        self.names = [name for name, _ in members]
        self.n = min(s.shingle, min(len(w) for _, w in members))
        self.sets = [np.unique(tokens.grams(np.zeros(len(w), np.int64), w, self.n)[1]) for _, w in members]
        self.lengths = [len(w) for _, w in members]
        shortest, longest = min(self.lengths), max(self.lengths)
        self.step = max(1, shortest // 4)
        self.window = longest + self.step - 1 - self.n + 1
        self.settings = s
        k = s.bands * s.rows
        self.seeds = tokens.mix(np.arange(1, k + 1, dtype=np.uint64) * U(0x632BE59BD9B4E019))
        minima = np.array([[tokens.mix(x ^ seed).min() for seed in self.seeds] for x in self.sets], np.uint64)
        self.keys = np.sort(np.unique(np.concatenate([self.band(minima[:, b * s.rows : (b + 1) * s.rows], b) for b in range(s.bands)])))
        self.all = np.unique(np.concatenate(self.sets))

    def band(self, minima: np.ndarray, b: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = np.full(len(minima), U(b + 1))
            for i in range(minima.shape[1]):
                key = key * U(0xD6E8FEB86659FD93) + minima[:, i]
        return tokens.mix(key)

    def windows(self, of: np.ndarray, value: np.ndarray) -> np.ndarray:
        """First shingles of windows that share a band with a template. Windows cross the end of a
        text or of the table only with shingles that match nothing."""
        s = self.settings
        # A window without any template shingle can share no minimum with a template.
        known = np.isin(value, self.all) & (of >= 0)
        if not known.any():
            return np.zeros(0, np.int64)
        starts = np.arange(0, len(value), self.step)
        sums = np.concatenate([[0], np.cumsum(known)])
        starts = starts[sums[np.minimum(starts + self.window, len(value))] > sums[starts]]
        found = np.zeros(len(starts), bool)
        at = np.minimum(starts[:, None] + np.arange(self.window), len(value) - 1)
        inside = (starts[:, None] + np.arange(self.window) < len(value)) & (of[at] >= 0)
        shingles = value[at]
        for b in range(s.bands):
            rows = [np.where(inside, tokens.mix(shingles ^ seed), U(2**64 - 1)).min(axis=1) for seed in self.seeds[b * s.rows : (b + 1) * s.rows]]
            found |= np.isin(self.band(np.stack(rows, axis=1), b), self.keys)
        return starts[found]

    def places(self, of: np.ndarray, value: np.ndarray, starts: np.ndarray):
        """``text, template, first word, containment`` of confirmed finds, without overlaps."""
        least = self.settings.contained
        for name, wanted, length in zip(self.names, self.sets, self.lengths):
            span = length - self.n + 1
            best: dict[tuple[int, int], float] = {}
            for start in starts.tolist():
                for first in range(start, min(start + max(self.window - span, 0) + 1, len(value))):
                    t = int(of[first])
                    if t < 0 or value[first] not in wanted:
                        continue
                    last = min(first + span, len(value))
                    mine = value[first:last][of[first:last] == t]
                    share = len(np.intersect1d(mine, wanted)) / len(wanted)
                    if share >= least:
                        best[t, first] = share
            end = (-1, -1)
            for (t, first), share in sorted(best.items()):
                if (t, first) >= end:
                    yield t, name, first, share
                    end = (t, first + span)


def groups(templates: list[tuple[str, str]], s: Settings) -> list[Group]:
    """Templates in groups whose lengths differ by less than half; templates without words are left out."""
    sized = []
    for name, text in templates:
        for _, _, words in _text_words(pa.array([text], pa.large_string())):
            if len(words):
                sized.append((name, words))
    out: list[list] = []
    for name, words in sorted(sized, key=lambda x: (len(x[1]), x[0])):
        if out and len(words) <= 1.5 * len(out[-1][0][1]) and min(s.shingle, len(words)) == min(s.shingle, len(out[-1][0][1])):
            out[-1].append((name, words))
        else:
            out.append([(name, words)])
    return [Group(members, s) for members in out]


def license_finds(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, license, first_word, containment`` of every template found in a text.

    Words are runs of letters and digits in lower case; a template of fewer words than a shingle is
    one shingle. Finds of one template in one text do not overlap. Null and empty texts have none;
    repeated rows are reported each; without documents there are no rows. The templates are sent to
    the tasks and should be a list of at most some thousands.
    """
    found = docs.sparkSession.sparkContext.broadcast(groups(templates, settings))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for a, text, words in _text_words(batch.column("text")):
                edges = np.searchsorted(text, np.arange(text[-1] + 2 if len(text) else 1))
                for group in found.value:
                    of, value = tokens.grams(text, words, group.n)
                    if not len(value):
                        continue
                    starts = group.windows(of, value)
                    if len(starts):
                        rows += [(ids[a + t].as_py(), name, first - int(edges[t]), share) for t, name, first, share in group.places(of, value, starts)]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["doc_id", "license", "first_word", "containment"]),
                schema=pa.schema([("doc_id", ids.type), ("license", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]),
                preserve_index=False,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scanned, f"doc_id {kind}, license string, first_word long, containment double"
    )
