"""Token counts by a linear longest-match automaton.

A word is cut greedily into the longest pieces of a vocabulary; only how many there are is wanted. The vocabulary is a
trie with failure links: where no transition fits, the link leads to the state that the rest of the text read so far
would have reached after its first pieces were taken, and a precomputed number says how many pieces that takes. Each
byte is read once, no piece is built, and nothing is read twice.

Words are runs of bytes other than the six ASCII spaces. A word's first piece is one that begins with a space in the
vocabulary file, the others are those that don't. A word that pieces don't cover counts as one unknown token.

Defined cases: null and empty texts count 0; long texts and words are read whole; null ids and repeated rows are rows like
any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import parts_of

#: Words whose counts a Python worker remembers; it starts afresh when they are full.
REMEMBERED = 400_000

_machines: dict[int, Automaton] = {}


class Automaton:
    """States are whole numbers; state 0 starts a word, state 1 goes on within it."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]) -> None:
        self.go: dict[int, int] = {}  # state * 256 + byte -> state
        ends, self.states = {}, 2
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                state = root
                for byte in piece:
                    key = state << 8 | byte
                    state = self.go.get(key, -1)
                    if state < 0:
                        state = self.go[key] = self.states
                        self.states += 1
                if piece:
                    ends[state] = True
        self.link, self.pops = [-1] * self.states, [0] * self.states
        after: list[list[tuple[int, int]]] = [[] for _ in range(self.states)]
        for key, state in self.go.items():
            after[key >> 8].append((key & 255, state))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, state in after[parent]:
                queue.append(state)
                if state in ends:
                    self.link[state], self.pops[state] = 1, 1
                    continue
                back, popped = self.link[parent], self.pops[parent]
                while back >= 0 and (back << 8 | byte) not in self.go:
                    popped += self.pops[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[state], self.pops[state] = self.go[back << 8 | byte], popped
        self.known = _Known(self)

    def count(self, word: bytes) -> int:
        """Pieces of a word, or -1 if they don't cover it."""
        go, link, pops = self.go, self.link, self.pops
        state, total = 0, 0
        for byte in word:
            key = state << 8 | byte
            while key not in go:
                total += pops[state]
                state = link[state]
                if state < 0:
                    return -1
                key = state << 8 | byte
            state = go[key]
        while state != 1:
            total += pops[state]
            state = link[state]
            if state < 0:
                return -1
        return total


class _Known(dict):
    def __init__(self, machine: Automaton) -> None:
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.machine.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def automaton(blob: bytes) -> Automaton:
    """One per Python worker and vocabulary file (a base64 piece and its rank in each line)."""
    key = zlib.crc32(blob)
    if key not in _machines:
        pieces = [base64.b64decode(line.split()[0]) for line in blob.splitlines() if line]
        _machines.clear()
        _machines[key] = Automaton([x for x in pieces if x[:1] == b" "], [x for x in pieces if x[:1] != b" "])
    return _machines[key]


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens, n_unknown: one row per document. Unknown words are among the tokens, one each."""
    bounded_batches(spark)
    with open(path or vocabulary_path(), "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(blob.value).known
        for batch in batches:
            for part in parts_of(batch, 1):
                out = []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode()
                    words = data.split()
                    counts = list(map(known.__getitem__, words))
                    unknown = counts.count(-1)
                    out.append((len(data), len(words), sum(counts) + 2 * unknown, unknown))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], ["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_words long, n_tokens long, n_unknown long")
