"""Token ids of documents, by a published tokenizer file, and their place in one long stream of tokens."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

_encoders: dict[int, Encoder] = {}

#: Fixed value: the pattern that cuts texts for the byte-level tokenizer file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's the 1st\tprobe:  naïve çà & là,\n\n  don't  — 2024!! 中文 😀 \n"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fast(tokenizer, blob: str):
    """The same byte-level tokenizer in a faster library, or None if this file can't be said that way."""
    import tiktoken

    file = json.loads(blob)
    if (file.get("model") or {}).get("type") != "BPE" or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"] for x in file.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in piece): rank for piece, rank in file["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast if fast.encode_ordinary(_PROBE) == tokenizer.encode(_PROBE, add_special_tokens=False).ids else None


class Encoder:
    """Ids of whole texts as little-endian unsigned integers of the narrowest type that holds the vocabulary.

    The ids are those of the tokenizer file. A faster library with the same vocabulary makes them wherever it gives
    the same: not for texts with the string of a special token or very long runs of white space.
    """

    def __init__(self, blob: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = _fast(self.tokenizer, blob)
        # Long runs of white space overflow the faster library's pattern matcher.
        self.slow = re.compile("|".join([re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()] + [r"\s{4000}"]))

    def ids(self, text: str) -> list[int]:
        if self.fast and not self.slow.search(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> bytes:
        return np.asarray(self.ids(text), self.dtype).tobytes() if text else b""


def encoder(blob: str) -> Encoder:
    """One per Python worker and tokenizer file."""
    key = zlib.crc32(blob.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(blob)
    return _encoders[key]


def parts_of(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of the (string or binary) column each, one row at least."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32 if batch.column(column).type in (pa.string(), pa.binary()) else np.int64)[batch.column(column).offset :][: len(batch) + 1]) if len(batch) else np.zeros(0)
    at, used = 0, 0
    for i, n in enumerate(sizes):
        if used and used + n > limit:
            yield batch.slice(at, i - at)
            at, used = i, 0
        used += int(n)
    if at < len(batch):
        yield batch.slice(at)


def token_table(spark: SparkSession, docs: DataFrame, path: str, end_id: int, key=None, id_col: str = "doc_id", text_col: str = "text", by_file: bool = False) -> DataFrame:
    """(uid, doc_id, n, key, ids): every document's ids and then `end_id`. Null text counts as empty.

    by_file adds file, run: which rows follow one another in a task: those of a file from the row `run` on; earlier: ids before a document in its run.
    Rows that aren't read right from files are taken in the order of their partitions.
    key: maps a list of id arrays to one whole number each. ids are of the narrowest unsigned type that holds the vocabulary.
    """
    with open(path, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value)
        end = np.asarray([end_id], enc.dtype).tobytes()
        last, run, so_far = (None, -1), -1, 0
        for batch in batches:
            for part in parts_of(batch, 2):
                ids = [enc(t) + end for t in part.column(2).to_pylist()]
                keys = key([np.frombuffer(x, enc.dtype) for x in ids]) if key else np.zeros(len(ids), np.int64)
                n = [len(x) // enc.dtype.itemsize for x in ids]
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())]
                if by_file:
                    runs, earlier = [], []
                    for file, row, size in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), n, strict=True):
                        if (file, row - 1) != last:
                            run, so_far = row, 0
                        runs.append(run)
                        earlier.append(so_far)
                        last, so_far = (file, row), so_far + size
                    columns += [part.column(3), pa.array(runs, pa.int64()), pa.array(earlier, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema])

    schema = ["uid long", "doc_id long", "n long", "key long", "ids binary", *["file string", "run long", "earlier long"] * by_file]
    columns = [F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if not by_file:
        rows = docs.select(*columns)
    else:
        try:
            rows = docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:
            rows = docs.select(*columns, F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(encode, ", ".join(schema))


def in_table_order(ws: Workspace, table: DataFrame) -> DataFrame:
    """The token table with `before`: ids of all documents before each one, in the order of files and of rows in them, however they were split.

    Only the sums of the runs are added up; there is one for each split of a file, and they are broadcast up to a million.
    """
    sums = table.groupBy("file", "run").agg(F.sum("n").alias("in_run"))
    sums = ws.table(sums.select("file", "run", (F.sum("in_run").over(Window.orderBy("file", "run")) - F.col("in_run")).alias("offset_")), "runs")
    sums = F.broadcast(sums) if sums.count() <= 1_000_000 else sums.hint("merge")
    return table.join(sums, ["file", "run"]).withColumn("before", F.col("earlier") + F.col("offset_")).drop("file", "run", "offset_")


def cut(placed: DataFrame, length: int, wide: bool, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents in placed(doc_id, ids, before), laid end to end from the place `before` and cut every `length` ids.

    with_ids adds each piece's ids, deflated, as they go through a shuffle next.
    """
    dtype = np.dtype("<u4" if wide else "<u2")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1):
                out: list[tuple] = []
                for doc_id, ids, before in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = np.frombuffer(ids, dtype).astype("<u4")
                    at = 0
                    while at < len(own):
                        sequence, offset = divmod(before + at, length)
                        n = min(length - offset, len(own) - at)
                        piece = own[at : at + n]
                        out.append((doc_id, at, n, zlib.crc32(piece.tobytes()), len(own), sequence, offset) + ((zlib.compress(piece.astype(dtype).tobytes(), 1),) if with_ids else ()))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.binary()] * with_ids, strict=True)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return placed.select("doc_id", "ids", "before").mapInArrow(pieces, schema)
