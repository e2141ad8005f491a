"""Training-order materialisation of token ids as fixed-stride binary shards.

The documents' ids are laid end to end and cut into sequences of `length` ids. A keyed Feistel permutation with
cycle-walking gives every sequence its global slot: a shuffle of the whole corpus that needs no sort by random keys,
can be computed forwards and backwards for any sequence alone, and is the same in every run. Ranges of slots are
shards. A shard file has one record of `length` ids for each slot, so the record of a slot stands at a known byte,
and training can start at any slot and read on. The shards stand in a folder named by a fingerprint of all ids, their
order and the parameters. A shard that is already there in full size is kept, so that a broken write of the same
sequences goes on where it stopped; files appear under their name only when they are complete. A task of the last
shuffle writes a run of neighbouring shards of up to TASK_BYTES.

Defined cases: null and empty texts are the end id alone; the last sequence is filled up with the end id; repeated rows and
null ids are documents like any other; texts of any length are cut where sequences end; an empty table gives no files; other columns
are not read. Documents that are read right from Parquet files stand in the order of files and rows, however these are
split among tasks, so reruns give the same shards; other tables stand in the order of their partitions.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .packing import wide_ids
from .tokens import cut, in_table_order, token_table, tokenizer_path

LENGTH, END_ID, PER_SHARD, KEY, ROUNDS = 1024, 0, 1024, 0x5EED, 6
TASK_BYTES = 256 << 20


def _round(x: np.ndarray, key: int, k: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def permuted(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The place of each of the numbers x in a keyed permutation of 0 .. n-1, or the number at each place.

    The Feistel network permutes the least square power of two that holds n; who lands beyond n walks on.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = right ^ (_round(left, key, k) & low), left
            else:
                left, right = right, left ^ (_round(right, key, k) & low)
        return left << np.uint64(half) | right

    out = once(np.asarray(x, np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def write_shards(spark: SparkSession, docs: DataFrame, target: str, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Writes target/<fingerprint>/shard-*.bin; returns (shard, file, records) of the files, the number of sequences and the bytes of an id."""
    ws = Workspace(spark, "binary")
    path = path or tokenizer_path()
    width = 4 if wide_ids(path) else 2
    # The table is as large as the shards and lies beside them for a while, so it is compressed harder than others.
    options = {"parquet.compression.codec.zstd.level": 9, "parquet.page.size": 4 << 20}
    table = ws.table(token_table(spark, docs, path, end_id, None, id_col, text_col, by_file=True).drop("uid", "key"), "tokens", "zstd", **options)
    placed = in_table_order(ws, table)
    total, mark = placed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("before", "doc_id", "n", "ids").cast("decimal(38,0)")), F.lit(0))).first()
    n = -(-total // length)
    print_ = hashlib.blake2b(repr((total, int(mark), width, length, end_id, per_shard, key)).encode(), digest_size=8).hexdigest()
    target = f"{target}/{print_}"
    shards = max(1, -(-n // per_shard))
    in_task = max(1, min(TASK_BYTES // (per_shard * length * width), -(-shards // (4 * spark.sparkContext.defaultParallelism))))
    pieces = cut(placed, length, width == 4, True).select("sequence_id", "offset", "ids")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permuted(batch.column(0).to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), *batch.columns[1:]], ["shard", "slot", "offset", "ids"])

    dealt = pieces.mapInArrow(slots, "shard long, slot long, offset long, ids binary")
    # A shard is a range of slots, and a run of shards a partition; the number says which, so that no sample of the rows is needed.
    dealt = dealt.repartitionById(-(-shards // in_task), F.expr(f"cast(shard div {in_task} AS int)")).sortWithinPartitions("slot", "offset")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.asarray([end_id], f"<u{width}").tobytes()
        fs, folder = FileSystem.from_uri(target)
        fs.create_dir(folder, recursive=True)

        def publish(shard: int, parts: list[bytes]) -> pa.RecordBatch:
            data = b"".join(parts)
            records = min(per_shard, n - shard * per_shard)
            data += pad * (records * length - len(data) // width)
            name = f"{folder}/shard-{shard:08d}.bin"
            there = fs.get_file_info(name)
            if there.type != FileType.File or there.size != len(data):
                part = f"{name}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, name)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{target}/shard-{shard:08d}.bin"]), pa.array([records])], ["shard", "file", "records"])

        now, slot, held, size = -1, -1, [], 0
        for batch in batches:
            for shard, own, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "ids")), strict=True):
                if shard != now and held:
                    yield publish(now, held)
                    held, size = [], 0
                if own != slot and (short := -size % (length * width)):
                    held.append(pad * (short // width))  # only the corpus's last sequence is short
                    size += short
                now, slot = shard, own
                ids = zlib.decompress(ids)
                held.append(ids)
                size += len(ids)
        if held:
            yield publish(now, held)

    files = dealt.mapInArrow(store, "shard long, file string, records long")
    files = ws.table(files, "files")
    ws.drop("tokens")
    return files, n, width


def read_shards(files: DataFrame, n: int, width: int, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, start: int = 0) -> DataFrame:
    """slot, shard, sequence_id, n_tokens, ids_crc32 from slot `start` on, read file by file in order. ids_crc32: of the ids as little-endian unsigned 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = FileSystem.from_uri(file)
                skip = min(records, max(0, start - shard * per_shard))
                with fs.open_input_stream(name) if not skip else fs.open_input_file(name) as f:
                    if skip:
                        f.seek(skip * length * width)
                    data = np.frombuffer(f.read(), f"<u{width}").reshape(-1, length).astype("<u4")
                slot = shard * per_shard + skip + np.arange(len(data))
                crc = [zlib.crc32(x.tobytes()) for x in data]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(data), shard)), pa.array(permuted(slot, n, key, True)), pa.array(np.full(len(data), length)), pa.array(crc, pa.int64())], ["slot", "shard", "sequence_id", "n_tokens", "ids_crc32"])

    return files.where(F.col("shard") >= start // per_shard).select("shard", "file", "records").mapInArrow(read, "slot long, shard long, sequence_id long, n_tokens long, ids_crc32 long")


def materialise(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Writes the shards in the shared folder and reads them back."""
    ws = Workspace(spark, "shards")
    files, n, width = write_shards(spark, docs, f"{ws.path}/shards", **options)
    own = {k: v for k, v in options.items() if k in ("length", "per_shard", "key")}
    return read_shards(files, n, width, **own)
