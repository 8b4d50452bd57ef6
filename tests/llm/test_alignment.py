"""Alignment against the whole Smith-Waterman table, and on long inputs."""

import random
import time
import tracemalloc

import numpy as np

from sensorlake.llm import decontaminate


def plain_align(doc, item, s):
    table = [[0] * (len(item) + 1) for _ in range(len(doc) + 1)]
    best, end = 0, (0, 0)
    for i, x in enumerate(doc, 1):
        for j, y in enumerate(item, 1):
            gain = s.match if x == y else s.mismatch
            table[i][j] = max(0, table[i - 1][j - 1] + gain, table[i - 1][j] + s.gap, table[i][j - 1] + s.gap)
            if table[i][j] > best:
                best, end = table[i][j], (i, j)
    (i, j), equal = end, 0
    last = i - 1
    while i and j and table[i][j]:
        same = doc[i - 1] == item[j - 1]
        if table[i][j] == table[i - 1][j - 1] + (s.match if same else s.mismatch):
            equal += same
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j] + s.gap:
            i -= 1
        else:
            j -= 1
    return best, equal, i, last


def test_alignment_equals_the_whole_table():
    rng = random.Random(1)
    for _ in range(600):
        letters = rng.randint(2, 6)
        doc = [rng.randrange(letters) for _ in range(rng.randint(0, 25))]
        item = [rng.randrange(letters) for _ in range(rng.randint(1, 15))]
        for s in (decontaminate.Settings(), decontaminate.Settings(match=3, mismatch=-2, gap=-2)):
            assert decontaminate.align(np.array(doc, np.uint64), np.array(item, np.uint64), s) == plain_align(doc, item, s)


def test_long_items_and_windows_take_little_memory():
    rng = np.random.default_rng(2)
    item = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    doc = np.concatenate([rng.integers(0, 1 << 60, 500).astype(np.uint64), item[:3_000]])
    tracemalloc.start()
    begun = time.monotonic()
    score, equal, first, last = decontaminate.align(doc, item, decontaminate.Settings())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (score, equal, first, last) == (6_000, 3_000, 500, 3_499)
    assert peak < 16e6 and time.monotonic() - begun < 60
