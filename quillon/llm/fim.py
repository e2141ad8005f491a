"""Fill-in-middle transformation by a byte automaton.

A text is cut into units (white space and the word after it, or white space at the end), two places between units are
drawn from the document's number, and the three parts are put in another order behind sentinels. One automaton over
bytes does all the reading: its table, states times bytes, follows UTF-8 sequences, sees where a word ends, and
recognises sentinels. The first scan runs texts in lanes of LANE bytes side by side and keeps for each lane only
how many units end and how many characters begin in it. The second pass finds by these counts the lane of a cut, and
runs that lane alone to find the byte.

A lane's first state is known without the lanes before it: after SYNC bytes, whatever they are, all states have become
one (worked out from the table when the module is loaded), so each lane is led in by the last bytes before it.

Defined cases: a null text counts as empty; an empty text is plain; white space alone is one unit; texts of any length
are read whole, lane by lane, with memory for the text, its output and a few hundredths of it for the counts; equal
texts and repeated rows get what their numbers say, each row its own; a null number is drawn for as the text `null`; an
empty table gives an empty one; other columns are not read, whatever their names. A result depends on its row alone, so
reruns on any layout agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the output contract.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, PERCENT_TRANSFORMED, PERCENT_SPM = 42, 50, 80

LANE = 256
#: So many lanes run side by side.
SLAB = 4096
#: A byte that UTF-8 never has fills a text's last lane.
PAD = 0xFF

#: States. DONE: a sentinel has just ended; NEEDS_k: k continuation bytes are to come. All from WORD on are inside a word.
START, SPACE, WORD, OPEN, NAMED, DONE, NEEDS_1, NEEDS_2, NEEDS_3 = range(9)


def _table() -> np.ndarray:
    """The state after each (state, byte)."""
    t = np.full((9, 256), WORD, np.uint8)
    t[:, [0x20, *range(9, 14)]] = SPACE
    t[:, ord("<")] = OPEN
    for s in SENTINELS:
        t[OPEN, ord(s[1])] = NAMED
    t[NAMED, ord(">")] = DONE
    t[:, 0xC0:0xE0], t[:, 0xE0:0xF0], t[:, 0xF0:0xF8] = NEEDS_1, NEEDS_2, NEEDS_3
    t[NEEDS_2, 0x80:0xC0], t[NEEDS_3, 0x80:0xC0] = NEEDS_1, NEEDS_2
    t[:, PAD] = START
    return t


def _sync_length(table: np.ndarray) -> int:
    """After how many bytes the state no longer depends on where the automaton began."""
    sets, n = {frozenset(range(len(table)))}, 0
    while any(len(s) > 1 for s in sets):
        n += 1
        if n > 64:
            raise ValueError("the automaton doesn't synchronise")
        sets = {frozenset(table[sorted(s), b].tolist()) for s in sets for b in range(table.shape[1])}
    return n


TABLE = _table()
SYNC = _sync_length(TABLE)
assert SYNC <= LANE
_FLAT = TABLE.ravel()


def _run(lanes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states after each byte of each lane, from the lanes' first states."""
    out = np.empty(lanes.shape[::-1], np.uint8)
    columns, at = np.ascontiguousarray(lanes.T), state.astype(np.uint16)
    for k in range(len(out)):
        at = np.take(_FLAT, (at << np.uint16(8)) | columns[k], out=out[k]).astype(np.uint16)
    return out.T


class Scan:
    """One text's first pass: `units`, `sentinel`, and the counts that the second pass looks cuts up in."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.n = -(-len(data) // LANE)
        self.ends, self.chars = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        self.sentinel = False

    def lanes(self, which: np.ndarray) -> np.ndarray:
        """The bytes of lanes, the last one filled up."""
        if len(which) and which[-1] == self.n - 1 and len(self.data) % LANE:
            out = np.full((len(which), LANE), PAD, np.uint8)
            tail = self.data[(self.n - 1) * LANE :]
            out[-1, : len(tail)] = tail
            which = which[:-1]
        else:
            out = np.empty((len(which), LANE), np.uint8)
        whole = self.data[: len(self.data) // LANE * LANE].reshape(-1, LANE)
        out[: len(which)] = whole[which]
        return out

    def first_states(self, which: np.ndarray) -> np.ndarray:
        """The state before each lane."""
        out = np.full(len(which), START, np.uint8)
        later = which[which > 0]
        lead = self.data[(later * LANE)[:, None] + np.arange(-SYNC, 0)[None, :]]
        state = np.full(len(later), WORD, np.uint8)
        out[which > 0] = _run(lead, state)[:, -1] if len(later) else state
        return out


def _emitted(before: np.ndarray, after: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which transitions end a unit, and which begin a character."""
    previous = np.concatenate([before[:, None], after[:, :-1]], axis=1)
    return (previous >= WORD) & (after == SPACE), ((lanes & 0xC0) != 0x80) & (lanes != PAD)


def scan(texts: list[np.ndarray]) -> list[Scan]:
    """First pass over texts as bytes, in slabs of lanes that several short texts share."""
    scans = [Scan(t) for t in texts]
    owner = np.repeat(np.arange(len(scans)), [s.n for s in scans])
    lane = np.concatenate([np.arange(s.n) for s in scans]) if scans else np.zeros(0, np.int64)
    for a in range(0, len(owner), SLAB):
        own, at = owner[a : a + SLAB], lane[a : a + SLAB]
        cuts = np.flatnonzero(np.diff(own)) + 1
        parts = [(scans[o[0]], w) for o, w in zip(np.split(own, cuts), np.split(at, cuts), strict=True)]
        lanes = np.concatenate([s.lanes(w) for s, w in parts])
        before = np.concatenate([s.first_states(w) for s, w in parts])
        after = _run(lanes, before)
        ends, chars = _emitted(before, after, lanes)
        ends, chars, done = ends.sum(1), chars.sum(1), (after == DONE).any(1)
        k = 0
        for s, w in parts:
            s.ends[w + 1], s.chars[w + 1] = ends[k : k + len(w)], chars[k : k + len(w)]
            s.sentinel |= bool(done[k : k + len(w)].any())
            k += len(w)
    for s in scans:
        np.cumsum(s.ends, out=s.ends)
        np.cumsum(s.chars, out=s.chars)
    return scans


def units(s: Scan) -> int:
    return int(s.ends[-1]) + (len(s.data) > 0)


def locate(cuts: list[tuple[Scan, int]]) -> list[tuple[int, int]]:
    """Second pass: (bytes, characters) before the end of a text's first k units, for each (scan, k)."""
    out, inner = [(0, 0)] * len(cuts), []
    for i, (s, k) in enumerate(cuts):
        if k >= units(s):
            out[i] = (len(s.data), int(s.chars[-1]))
        elif k > 0:
            inner.append((i, int(np.searchsorted(s.ends, k)) - 1))
    for a in range(0, len(inner), SLAB):
        some = inner[a : a + SLAB]
        lanes = np.concatenate([cuts[i][0].lanes(np.array([lane])) for i, lane in some])
        before = np.concatenate([cuts[i][0].first_states(np.array([lane])) for i, lane in some])
        ends, chars = _emitted(before, _run(lanes, before), lanes)
        left = np.array([cuts[i][1] - cuts[i][0].ends[lane] for i, lane in some])
        # The byte that ends the unit is the first one after it.
        at = np.argmax(np.cumsum(ends, axis=1) == left[:, None], axis=1)
        inside = np.cumsum(chars, axis=1) - chars
        for row, (i, lane) in enumerate(some):
            out[i] = (lane * LANE + int(at[row]), int(cuts[i][0].chars[lane] + inside[row, at[row]]))
    return out


def draws(doc_id: int | str | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(ids: list, texts: list[bytes]) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """(units, form, prefix_chars, middle_chars, output) of each text."""
    scans, drawn = scan([np.frombuffer(t, np.uint8) for t in texts]), [draws(i) for i in ids]
    forms, cuts = [], []
    for s, h in zip(scans, drawn, strict=True):
        n = units(s)
        plain = n == 0 or s.sentinel or h[2] % 100 >= PERCENT_TRANSFORMED
        forms.append((n, "plain" if plain else "spm" if h[3] % 100 < PERCENT_SPM else "psm"))
        if not plain:
            cuts += [(s, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
    found, out = iter(locate(cuts)), []
    p, s, m = (x.encode() for x in SENTINELS)
    for t, (n, form) in zip(texts, forms, strict=True):
        if form == "plain":
            out.append((n, form, None, None, t))
            continue
        (a, chars), (b, chars_b) = next(found), next(found)
        parts = (p, t[:a], s, t[b:], m, t[a:b]) if form == "psm" else (s, t[b:], p, t[:a], m, t[a:b])
        out.append((n, form, chars, chars_b - chars, b"".join(parts)))
    return out


#: Texts are transformed in groups of about so many bytes.
GROUP_BYTES = 4 << 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: one row a document, no shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch["t"]).to_numpy(zero_copy_only=False)
            groups = np.cumsum(sizes) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(sizes)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    done = transformed(part["doc_id"].to_pylist(), part["t"].to_pylist())
                    n, form, prefix, middle, output = zip(*done, strict=True)
                    columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. A transformed text has no sentinel of its own, so the three tell its parts."""
    parts = F.split(output, f"<[{''.join(s[1] for s in SENTINELS)}]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
