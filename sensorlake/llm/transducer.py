"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled, as far as the texts need it, into a deterministic transducer.
A sequence of pieces is the encoding of a text exactly if every two neighbours are the encoding of
their concatenation; hence the last piece of a prefix's encoding is found from the last pieces at
the few positions before it. Reading a character moves to the next state and emits the change of the
number of tokens. States are the prefixes met so far, each with the last piece of its encoding and
the state it came from; when there are too many, the tables start again.

No piece continues across a word's beginning, so the transducer is in a known state there. A stretch
of text therefore maps to (open head, tokens between, open tail); two such maps compose into one,
which is associative: a text may be cut anywhere, and the cuts' maps are composed by a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

MARK = "▁"
#: Characters in a stretch, and sizes at which the lazily built tables start again.
STRETCH = 1 << 16
MOST_WORDS = 600_000
MOST_STATES = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their merge scores, and whether unknown characters fall back to bytes."""

    scores: dict[str, float]
    bytes_fallback: bool = True


def read_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model of the byte-pair kind."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = {i for i in range(len(model)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(len(model)) if i not in special}
    return Vocabulary(scores, any(model.is_byte(i) for i in range(len(model))))


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.scores = vocabulary.scores
        self.fallback = vocabulary.bytes_fallback
        self.longest = max((len(p) for p in self.scores), default=1)
        joined = "".join(p for p in self.scores if len(p) > 1)
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces that continue across a word's beginning are not supported")
        if "\n" in joined:
            raise ValueError("pieces that continue across a line break are not supported")
        self.units = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.restart()

    def restart(self) -> None:
        #: For every state: state before, last character, last piece, tokens so far.
        self.before, self.char, self.piece, self.total = [-1], [""], [""], [0]
        self.moves: dict[tuple[int, str], int] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.spaced: dict[str, int] = _Table(self, MARK)
        self.bare: dict[str, int] = _Table(self, "")

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: the best-scored neighbours join, the leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether ``piece`` may come after ``before`` (empty: at the beginning)."""
        key = (before, piece)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MOST_STATES:
                self.fits.clear()
            known = self.merged(before + piece) == ([before, piece] if before else [piece])
            self.fits[key] = known
        return known

    def tokens(self, piece: str) -> int:
        if piece in self.scores or not self.fallback:
            return 1
        return len(piece.encode("utf-8", "surrogatepass"))

    def move(self, at: int, char: str) -> int:
        """The state after reading a character; ``emitted`` has the tokens of the transition."""
        before, chars, piece, scores = self.before, self.char, self.piece, self.scores
        text, start = char, at
        while not ((start == at or text in scores) and self.follows(piece[start], text)):
            text = chars[start] + text
            start = before[start]
            if start < 0 or len(text) > self.longest:
                raise AssertionError(f"no piece ends at {text!r}")
        target = len(before)
        before.append(at)
        chars.append(char)
        piece.append(text)
        self.total.append(self.total[start] + self.tokens(text))
        self.moves[at, char] = target
        return target

    def emitted(self, at: int, to: int) -> int:
        """Tokens that the transition between two states emits; negative where pieces join."""
        return self.total[to] - self.total[at]

    def run(self, unit: str) -> int:
        """Tokens of a unit: the sum of what its transitions emit."""
        if len(self.before) > MOST_STATES:
            for table in (self.before, self.char, self.piece, self.total):
                del table[1:]
            self.moves.clear()
        at, moves = 0, self.moves
        for char in unit:
            to = moves.get((at, char))
            at = self.move(at, char) if to is None else to
        return self.total[at]

    def closed(self, marked: str) -> int:
        """Tokens of a text whose spaces are already marks."""
        bare = self.bare
        return sum([bare[u] for u in self.units.findall(marked)])

    def whole(self, text: str) -> int:
        """Tokens of a text in one go."""
        if not text:
            return 0
        spaced, total = self.spaced, 0
        for i, line in enumerate(text.split("\n")):
            if i:
                total += self.bare["\n"]
            if "  " in line or line[:1] == " " or line[-1:] == " " or MARK in line:
                total += self.closed((MARK if i == 0 else "") + line.replace(" ", MARK))
                continue
            first, *rest = line.split(" ")
            if i == 0:
                total += spaced[first]
            elif first:
                total += self.bare[first]
            total += sum([spaced[w] for w in rest])
        return total

    def stretch(self, marked: str) -> tuple[str, int | None, str]:
        """Map of a stretch: (head, tokens between, tail); (text, None, "") without a boundary."""
        cuts = [m.start() for m in self.units.finditer(marked)][1:]
        if not cuts:
            return marked, None, ""
        head, tail = marked[: cuts[0]], marked[cuts[-1] :]
        return head, self.closed(marked[cuts[0] : cuts[-1]]), tail

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]):
        """Map of two neighbouring stretches."""
        if a[1] is None and b[1] is None:
            return self.stretch(a[0] + b[0])
        if a[1] is None:
            head, between, rest = self.stretch(a[0] + b[0])
            return (head, b[1], b[2]) if between is None else (head, between + self.closed(rest) + b[1], b[2])
        if b[1] is None:
            first, between, tail = self.stretch(a[2] + b[0])
            return (a[0], a[1], first) if between is None else (a[0], a[1] + self.closed(first) + between, tail)
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str | None, size: int = STRETCH) -> int:
        """Tokens of a text; long ones by stretches whose maps are composed pairwise."""
        if not text:
            return 0
        if len(text) <= size:
            return self.whole(text)
        marked = MARK + text.replace(" ", MARK)
        maps = [self.stretch(marked[i : i + size]) for i in range(0, len(marked), size)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.closed(head) + (between or 0) + self.closed(tail)


class _Table(dict):
    """Tokens of units met before; computed by the transducer on first sight."""

    def __init__(self, owner: Transducer, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, unit: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        found = self[unit] = self.owner.run(self.prefix + unit)
        return found


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, for the whole text.

    Counts are those of the model's own library without added tokens; the model is only read for its
    vocabulary, on the driver, and sent to the tasks (its size is fixed). Null text counts as empty:
    no bytes, no tokens. Repeated rows are counted each; an empty table gives no rows. The model
    must keep texts as they are but for spaces and one added in front.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(vocabulary.value)
        for batch in batches:
            column = batch.column("text")
            tokens = np.array([transducer.count(t.as_py()) for t in column], np.int64)
            size = pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
