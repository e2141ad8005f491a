"""Packing along a space-filling curve.

Each document becomes a hashed vector of its token counts, a seeded random projection takes that to three
dimensions, and its Hilbert key says where it stands on a curve on which neighbours are alike. The documents are
sorted by ranges of that key, laid end to end in this order, and the stream is cut every `length` ids. So every
sequence is full but the very last, and a sequence holds neighbours on the curve.

Defined cases: null and empty texts are the end id alone; repeated rows and equal keys are told apart by a row number
given when the ids are written; null ids are kept; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, running_total
from .tokens import cut, token_table, tokenizer_path

LENGTH, END_ID = 1024, 0
DIMS, BITS, BUCKETS, SEED = 3, 10, 1024, 20240229


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned whole numbers below 2**bits (the transposed form, then interleaved)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as arrays of ids."""
    plane = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS)).astype(np.float32)
    rows = np.empty((len(ids), DIMS), np.float32)
    for k, own in enumerate(ids):
        v = np.log1p(np.bincount((own.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(22)), minlength=BUCKETS)).astype(np.float32)
        rows[k] = v @ plane / max(1e-9, float(np.sqrt(v @ v)))
    unit = 1 / (1 + np.exp(-1.7 * rows))
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS) if len(ids) else np.zeros(0, np.int64)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and deflated ids if asked for."""
    ws = Workspace(spark, "packing")
    path = path or tokenizer_path()
    table = ws.table(token_table(spark, docs, path, end_id, curve_keys, id_col, text_col), "tokens")
    keyed = table.select("uid", "key", "n", F.xxhash64("uid").alias("tie"))
    places = running_total(ws, keyed, "curve", [], ["key", "tie"], "n")
    placed = table.select("uid", "doc_id", "ids").join(places.select("uid", "before").hint("shuffle_hash"), "uid")
    return cut(placed, length, wide_ids(path), with_ids)


def wide_ids(path: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() > 1 << 16
