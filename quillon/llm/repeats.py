"""Removal of strings that occur twice or more anywhere in the corpus, by suffix arrays of shards.

A byte goes if some string of `length` bytes covers it that also starts at another place, in the same document or
another. No suffix array of the whole corpus is needed for that:

1. Anchors. Of every window of `length` bytes the least hash of its 64-byte strings (the leftmost of equals) is its
   anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal places. Neighbouring
   windows with the same anchor form one context, about one for 170 bytes of text; equal contexts in a row, as in a
   periodic text, count as one row. An anchor's hash decides nothing but who meets whom.
2. Contexts whose anchor occurs once cannot hold a repeat and go. Equal contexts (by 128 bits of BLAKE2b) are counted:
   one that occurs twice or more repeats as a whole, wherever it stands, and only one copy of it goes on.
3. A window has its anchor in one of four quarters, so contexts that share a window also share one of four strings
   around the anchor that are about 80 bytes shorter. Contexts that share none of these go no further.
   Those that share an anchor meet in one shard. Each shard is one string; its suffix array (suffixes.py) and
   permuted common prefixes show which windows also start elsewhere.
4. The repeated windows of a context hold for all its copies; a document's spans are merged and cut out.

A passage that a third of all documents share is one context for the shards; the joins to its many places are salted.
An anchor with more than `crowd` different contexts (a frequent string shorter than `length`) is split by those four
strings, and contexts that share one of them meet in a shard instead. What even one of these strings has more than
`crowd` contexts for shares all but 80 bytes of a window; its windows are counted by 128 bits of BLAKE2b.

Where `length` counts words, a word stands as eight bytes that are a hash of it, and all else is the same.

Defined cases: null text counts as empty; nothing shorter than `length` is removed; null ids and repeated rows are rows
like any other, and repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, many_to_one
from .hashing import digests, mixed, word_codes, word_places
from .suffixes import common_prefixes, suffix_array
from .tokens import parts_of

LENGTH, GRAM = 400, 64
#: Bytes of contexts in a shard, on average; different contexts of one anchor, or of one string around it, in a shard, at most.
SHARD_BYTES, CROWD = 2 << 20, 4096
#: Texts are read in parts of so many bytes that overlap by a window: small enough for the processor's cache.
PART = 256 << 10
#: Stands between contexts; no UTF-8 text has this byte, and no hash of a word is likely to be eight of it.
BREAK = 0xFF
#: For repeats of words: bytes of a word's hash, and words in a string for anchors.
WORD_BYTES, WORD_GRAM = 8, 8
KEYS = ("anchor", "w1", "w2")

_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Random numbers for the bytes, and powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[1]) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        base = 0x9E3779B97F4A7C15
        up = np.full(size, np.uint64(base), np.uint64)
        down = np.full(size, np.uint64(pow(base, -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        values = np.random.default_rng(64).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        _powers[:] = [values, np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


def gram_hashes(s: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of `gram` bytes or words, from running sums. Good enough to choose anchors, not to compare strings."""
    values, up, down = _tables(len(s))
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum((values[s] if s.dtype == np.uint8 else s) * up[: len(s)], out=sums[1:])
    at = np.arange(len(s) - gram + 1)
    return mixed((sums[at + gram] - sums[at]) * down[at])


def contexts(s: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, whole, start, windows, at, more) of the contexts in texts laid end to end in s; ends: where each text ends.

    anchor: a hash of the anchor's string. whole: two numbers that stand for all bytes of the context. windows: how many
    windows it has. at: where in the context the anchor stands. more: how many equal contexts follow without a gap.
    """
    n = len(s)
    none = (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)) + (np.zeros(0, np.int64),) * 4
    if n < length:
        return none
    grams = gram_hashes(s, gram)
    at = np.arange(len(grams))
    wide = length - gram + 1
    keys = grams & ~np.uint64(0xFFFFFF) | at.astype(np.uint64)
    full = -(-len(keys) // wide) * wide
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, wide)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(n - length + 1)
    least = np.minimum(right[: len(first)], left[wide - 1 : wide - 1 + len(first)])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, first, "right")
    inside = first + length <= ends[text]
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    starts = first[new & inside]
    if not len(starts):
        return none
    border = np.flatnonzero(new | ~inside)
    stop = np.append(border, len(first))[np.searchsorted(border, starts, "right")]
    windows = stop - starts
    own = anchor[starts]
    whole = digests(memoryview(s.tobytes()), starts * s.itemsize, (starts + windows + length - 1) * s.itemsize)
    again = np.zeros(len(starts), bool)
    again[1:] = (whole[1:] == whole[:-1]).all(axis=1) & (starts[1:] == stop[:-1]) & (text[starts[1:]] == text[starts[:-1]])
    head = np.flatnonzero(~again)
    more = np.diff(np.append(head, len(starts))) - 1
    return grams[own[head]], whole[head], starts[head], windows[head], (own - starts)[head], more


def symbols(text: str | None, words: bool) -> np.ndarray:
    """What repeats are looked for in: the bytes of a text or the hashes of its words."""
    s = np.frombuffer((text or "").encode(), np.uint8)
    return word_codes(s, *word_places(s)) if words else s


def quarters(data: bytes, at: int, length: int, gram: int) -> list[bytes | None]:
    """Hashes of the four strings around the anchor of which two contexts share one at least if they share a window; None where it doesn't fit."""
    step, out = (length - gram) // 4, []
    for j in range(4):
        a, b = at - step * j, at + gram + (length - gram - step * (j + 1) if j < 3 else 0)
        out.append(hashlib.blake2b(data[a:b], digest_size=8, key=bytes([j])).digest() if a >= 0 and b <= len(data) else None)
    return out


def _laid_out(texts: list[str | None], length: int, words: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of about PART bytes: (bytes or words, ends of the texts, which text, where in it the part begins)."""
    pieces, size = [], 0
    most = PART // WORD_BYTES if words else PART
    for k, text in enumerate(texts):
        data = symbols(text, words)
        if len(data) < length:
            continue
        for at in range(0, max(1, len(data) - length + 1), most - length + 1):
            piece = data[at : at + most]
            if size and size + len(piece) > most:
                yield _joined(pieces)
                pieces, size = [], 0
            pieces.append((piece, k, at))
            size += len(piece)
    if pieces:
        yield _joined(pieces)


def _joined(pieces: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, ...]:
    data, which, at = zip(*pieces, strict=True)
    return np.concatenate(data), np.cumsum([len(x) for x in data]), np.asarray(which), np.asarray(at)


def shard_hits(data: list[bytes], windows: list[int], length: int, unit: int = 1) -> list[list[tuple[int, int]]]:
    """For each context of a shard, the runs [from, to) of its windows that also start elsewhere in the shard. unit: bytes of a symbol."""
    gap = bytes([BREAK]) * unit
    s = np.frombuffer(gap.join(data) + gap, np.uint8)
    start = np.cumsum([0] + [len(x) + unit for x in data])[:-1]
    fresh = np.zeros(len(s), bool)
    fresh[start] = True
    before, lengths = common_prefixes(s, suffix_array(s, 256), 3 * length * unit, fresh)
    long_ = lengths >= length * unit
    hit = long_.copy()
    hit[before[long_]] = True
    return [_runs(hit[a : a + w * unit : unit]) for a, w in zip(start, windows, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _identified(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """A document is known by its id and a hash of its text; rows that share both are copies with the same spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id_"), F.xxhash64(text).alias("text_hash_"), text.alias("text_"), *[F.col(f"`{c}`") for c in more])


def _batch(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names.split())


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, crowd: int = CROWD, words: bool = False) -> DataFrame:
    """(id_, text_hash_, spans_): the byte spans, unmerged, of each document that has any.

    words: `length` and the spans count words, whatever spaces stand between them.
    """
    ws = Workspace(spark, "repeats")
    unit, gram, least = (WORD_BYTES, WORD_GRAM, 2 * length - 1) if words else (1, GRAM, length)
    rows = _identified(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 2):
                for s, ends, which, at in _laid_out(part.column(2).to_pylist(), length, words):
                    anchor, whole, start, windows, place, more = contexts(s, ends, length, gram)
                    text = np.searchsorted(ends, start, "right")
                    within = start - (ends - np.diff(ends, prepend=0))[text] + at[text]
                    own = pa.array(which[text])
                    numbers = [pa.array(x.astype(np.int32)) for x in (windows, place, more)]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), part.column(0).take(own), part.column(1).take(own), pa.array(within), *numbers], ["anchor", "w1", "w2", "id_", "text_hash_", "start", "windows", "at", "more"])

    found = rows.where(F.octet_length("text_") >= least).mapInArrow(find, "anchor long, w1 long, w2 long, id_ long, text_hash_ long, start long, windows int, at int, more int")
    found = ws.table(found, "contexts")
    times = F.sum(F.lit(1).cast("long") + F.col("more"))
    repeated = found.groupBy("anchor").agg(times.alias("places")).where("places > 1").select("anchor")
    kept = ws.table(many_to_one(found, repeated, ["anchor"]), "repeated")
    ws.drop("contexts")
    kinds = ws.table(kept.groupBy(*KEYS).agg(times.alias("places"), F.min(F.struct("id_", "text_hash_", "start", "windows", "at")).alias("one")).select(*KEYS, "places", "one.*"), "kinds")
    variants = kinds.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1").select("anchor")
    mixed_ = many_to_one(kinds.select(*KEYS, "id_", "text_hash_", "start", "windows", "at"), variants, ["anchor"])
    by_doc = mixed_.groupBy("id_", "text_hash_").agg(F.collect_list(F.struct(*KEYS, "start", "windows", "at")).alias("wanted"))
    wanted = rows.join(by_doc.withColumnRenamed("id_", "id_2").withColumnRenamed("text_hash_", "hash_2"), F.col("id_").eqNullSafe(F.col("id_2")) & (F.col("text_hash_") == F.col("hash_2")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 0, 1 << 20):
                out = []
                for text, many in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = symbols(text, words)
                    for x in many:
                        own = data[x["start"] : x["start"] + x["windows"] + length - 1].tobytes()
                        out.append((x["anchor"], x["w1"], x["w2"], x["windows"], own, quarters(own, x["at"] * unit, length * unit, gram * unit)))
                yield _batch(out, "anchor w1 w2 windows bytes quarters", *(pa.int64(),) * 3, pa.int32(), pa.binary(), pa.list_(pa.binary()))

    cut = wanted.select("text_", "wanted").mapInArrow(read, "anchor long, w1 long, w2 long, windows int, bytes binary, quarters array<binary>")
    cut = ws.table(cut.dropDuplicates(KEYS), "cut")  # repeated rows bring the same context again
    each = cut.select(*KEYS, F.explode("quarters").alias("quarter")).where("quarter IS NOT NULL")
    again = each.groupBy("anchor", "quarter").agg(F.count("*").alias("sharing")).where("sharing > 1")
    shared = ws.table(many_to_one(each, again, ["anchor", "quarter"]), "shared")
    cut = ws.table(cut.join(shared, list(KEYS), "left_semi").drop("quarters"), "chosen")
    ws.drop("cut")
    packed = shared.groupBy("anchor").agg(F.count("*").alias("many")).where(F.col("many") > crowd)
    size = cut.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))

    def sort(table: pa.Table) -> pa.Table:
        # A context can come with more than one of its strings; it is no repeat of itself.
        one = {key: k for k, key in enumerate(zip(*(table.column(c).to_pylist() for c in KEYS), strict=True))}
        keys, table = list(one), table.take(list(one.values()))
        runs = shard_hits(table.column("bytes").to_pylist(), table.column("windows").to_pylist(), length, unit)
        return pa.Table.from_batches([_batch([(*key, x, y) for key, own in zip(keys, runs, strict=True) for x, y in own], "anchor w1 w2 a b", *(pa.int64(),) * 3, *(pa.int32(),) * 2)])

    def sorted_(dealt: DataFrame, by: tuple[str, ...], n: int) -> DataFrame:
        dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")).select("shard", *KEYS, "windows", "bytes")
        return dealt.groupBy("shard").applyInArrow(sort, "anchor long, w1 long, w2 long, a int, b int")

    if packed.isEmpty():
        hits = sorted_(cut, ("anchor",), shards)
    else:
        marked = ws.table(many_to_one(cut, packed, ["anchor"], "left"), "marked")
        tight, groups = marked.where("many IS NOT NULL").drop("many"), many_to_one(shared, packed, ["anchor"])
        few = groups.where(F.col("sharing") <= crowd).select(*KEYS, "quarter").join(tight, list(KEYS))
        many = tight.join(groups.where(F.col("sharing") > crowd), list(KEYS), "left_semi")
        hits = sorted_(marked.where("many IS NULL"), ("anchor",), shards)
        hits = hits.unionByName(sorted_(few, ("anchor", "quarter"), 4 * shards)).unionByName(_counted(many, length, unit))
    everywhere = kinds.where("places > 1").select(*KEYS, F.lit(0).alias("a"), F.col("windows").alias("b"))
    runs = hits.unionByName(everywhere).groupBy(*KEYS).agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    runs = ws.table(runs, "runs")
    for name in ("chosen", "shared", "marked"):
        ws.drop(name)
    start = F.col("start")
    span = lambda r: F.struct((start + r["a"]).alias("from_"), (start + F.col("more").cast("long") * F.col("windows") + r["b"] + F.lit(length - 1)).alias("to_"))
    there = many_to_one(kept, runs, list(KEYS)).select("id_", "text_hash_", F.explode(F.transform("runs", span)).alias("span"))
    spans = ws.table(there.groupBy("id_", "text_hash_").agg(F.collect_set("span").alias("spans_")), "spans")
    for name in ("repeated", "kinds", "runs"):
        ws.drop(name)
    return spans


def _counted(cut: DataFrame, length: int, unit: int) -> DataFrame:
    """The same as shard_hits for contexts of which too many share a string around their anchor: windows are counted by 128 bits of BLAKE2b."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, many, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.arange(many)
                own = digests(memoryview(data), at * unit, (at + length) * unit)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(many, x)) for x in key], pa.array(at.astype(np.int32)), pa.array(own[:, 0]), pa.array(own[:, 1])], ["anchor", "w1", "w2", "a", "one", "two"])

    each = cut.select(*KEYS, "windows", "bytes").mapInArrow(windows, "anchor long, w1 long, w2 long, a int, one long, two long")
    again = each.groupBy("one", "two").agg(F.count("*").alias("places")).where("places > 1").select("one", "two")
    return many_to_one(each, again, ["one", "two"]).select(*KEYS, "a", (F.col("a") + 1).alias("b"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of a document's spans."""
    out: list[list[int]] = []
    for a, b in sorted((x["from_"], x["to_"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _byte_spans(data: bytes, spans: list[dict] | None) -> list[dict]:
    """Spans of words as spans of bytes, from the first byte of the first word to the last one of the last."""
    if not spans:
        return []
    starts, ends = word_places(np.frombuffer(data, np.uint8))
    return [{"from_": int(starts[x["from_"]]), "to_": int(ends[x["to_"] - 1])} for x in spans]


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = (), with_text: bool = False, words: int | None = None, **kinds: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns `more` and, if asked for, kept_text: one row per document.

    words: strings of so many words that occur twice or more go as well, however few bytes they have.
    kept_text drops what a cut leaves of a character of several bytes.
    """
    spans = repeated_spans(spark, docs, length, id_col, text_col, **kinds)
    if words:
        more_spans = repeated_spans(spark, docs, words, id_col, text_col, words=True)
        none = F.lit(None).cast(spans.schema["spans_"].dataType)
        both = spans.withColumn("word_spans_", none).unionByName(more_spans.select("id_", "text_hash_", none.alias("spans_"), F.col("spans_").alias("word_spans_")))
        spans = both.groupBy("id_", "text_hash_").agg(F.first("spans_", True).alias("spans_"), F.first("word_spans_", True).alias("word_spans_"))
    else:
        spans = spans.withColumn("word_spans_", F.lit(None).cast(spans.schema["spans_"].dataType))
    right = spans.select(F.col("id_").alias("id_2"), F.col("text_hash_").alias("hash_2"), "spans_", "word_spans_")
    rows = _identified(docs, id_col, text_col, more).join(right, F.col("id_").eqNullSafe(F.col("id_2")) & (F.col("text_hash_") == F.col("hash_2")), "left")
    rows = rows.select("id_", "text_", "spans_", "word_spans_", *[F.col(f"`{c}`") for c in more])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more, *["kept_text"] * with_text]
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1):
                out = []
                for text, own, by_word in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    data, at, kept = text.encode(), 0, []
                    runs = merged([*(own or ()), *_byte_spans(data, by_word)])
                    for a, b in runs:
                        kept.append(data[at:a])
                        at = b
                    rest = b"".join([*kept, data[at:]])
                    out.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else ""))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns[:4], *part.columns[4:], *columns[4:] * with_text], names)

    return rows.mapInArrow(strip, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}" + ", kept_text string" * with_text)
