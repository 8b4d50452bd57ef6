"""Vectorised words and shingles of whole texts, straight from Arrow buffers.

A word is a longest run of bytes of one class (see the class tables). Words are represented by
64-bit hashes: a polynomial over the bytes, taken as a difference of prefix sums, then mixed. Texts
are processed in stretches of about a megabyte that end between words, so memory beyond the text
itself is a few bytes per byte of a stretch and 16 bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
U = np.uint64


def _classes(**members) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for number, test in enumerate(members.values(), 1):
        for b in range(256):
            if test(b):
                table[b] = number
    return table


def _blank(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


def _letter(b: int) -> bool:
    return b >= 0x80 or chr(b).isalnum()


#: Everything between white space.
WHOLE = _classes(word=lambda b: not _blank(b))
#: Letters and digits; all else separates.
LETTERS = _classes(word=_letter)
#: Letters and digits, and runs of other visible characters.
MIXED = _classes(word=_letter, mark=lambda b: b > 0x20 and b != 0x7F and not _letter(b))
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
AS_IS = np.arange(256, dtype=np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = STRETCH if n <= STRETCH else 1 << (n - 1).bit_length()
    if size not in _tables:
        _tables.clear()
        with np.errstate(over="ignore"):
            _tables[size] = (
                _powers(int(BASE), size + 1),
                _powers(pow(int(BASE), -1, 1 << 64), size + 1),
            )
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, fold: np.ndarray = AS_IS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text number, byte position, hash, class`` of every word, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    at, n = 0, len(data)
    borders = np.zeros(n + 1, bool)
    borders[offsets] = True
    while at < n:
        end = min(at + STRETCH, n)
        if end < n:
            cut = _cut(data, borders, classes, at, end)
            end = cut
        out.append(_stretch(data[at:end], borders[at:end], classes, fold, at))
        at = end
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    begin = np.concatenate([o[0] for o in out])
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text, begin, np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])


def _cut(data, borders, classes, at: int, end: int) -> int:
    """A place near ``end`` that is not inside a word."""
    step = 1 << 12
    while True:
        low = max(at + 1, end - step)
        free = np.flatnonzero((classes[data[low:end]] == 0) | borders[low:end])
        if len(free):
            return low + int(free[-1])
        if low == at + 1:
            break
        step *= 8
    while end < len(data):
        high = min(len(data), end + step)
        free = np.flatnonzero((classes[data[end:high]] == 0) | borders[end:high])
        if len(free):
            return end + int(free[0])
        end = high
    return len(data)


def _stretch(data, borders, classes, fold, at):
    kind = classes[data]
    change = np.empty(len(kind) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[:-1] |= borders
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    keep = kind[begin] != 0
    begin, end = begin[keep], end[keep]
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + U(1)) * power[: len(data)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return begin + at, hashes, kind[begin]


def grams(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``text number, hash`` of every run of ``n`` words inside one text (position = index)."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(last, U(n), np.uint64)
        for i in range(n):
            total = total * U(0xD6E8FEB86659FD93) + hashes[i : i + last]
    inside = text[:last] == text[n - 1 :]
    return np.where(inside, text[:last], -1), mix(total)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every text as sorted ``text number, hash`` pairs.

    Words are runs without white space with A-Z in lower case. A text of fewer than ``n`` words
    has its whole sequence as the only shingle; a text without words has none.
    """
    text, _, hashes, _ = words(data, offsets, WHOLE, ASCII_LOWER)
    of, value = grams(text, hashes, n)
    keep = of >= 0
    of, value = of[keep], value[keep]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        more = [_whole(hashes[first[t] : first[t] + counts[t]]) for t in short]
        of = np.concatenate([of, short])
        value = np.concatenate([value, np.array(more, np.uint64)])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    if len(of):
        new = np.empty(len(of), bool)
        new[0] = True
        np.logical_or(of[1:] != of[:-1], value[1:] != value[:-1], out=new[1:])
        of, value = of[new], value[new]
    return of, value


def _whole(hashes: np.ndarray) -> int:
    _, value = grams(np.zeros(len(hashes), np.int64), hashes, len(hashes))
    return int(value[0])


def slices(offsets: np.ndarray, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each; a longer text is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
