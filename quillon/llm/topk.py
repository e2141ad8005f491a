"""Exact top-k inner products by norm order and rotated partial sums.

Vectors become whole numbers, so that every score is exact. The eigenvectors of their Gram matrix (the right singular
vectors of the table) give a rotation that puts most of the length into the first coordinates. The table is dealt by
ranges of length, longest first, and read in blocks of falling length. For a block of queries at a time:

* length: no vector of a block can beat a query's k-th score so far if the two longest lengths together don't;
* partial sums: the first coordinates' sum, plus the product of the lengths of the rest (Cauchy-Schwarz), bounds a score;
* what is left is scored exactly.

The longest vectors of all give each query a k-th score to begin with. Each task keeps its own k best, and the last
step ranks those. A pass has PASS_BYTES of queries, and its result is written before the next one begins; the Gram
matrix has the size of the dimension. So what is broadcast does not grow with the table; the number of passes does.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id;
a vector is compared with those of its own dimension; repeated rows are separate candidates and queries; equal scores go
by smaller id; an empty table gives no rows; other columns are not read. Double precision is exact for vectors with a
squared length below 2**53; pairs with a longer one are bounded in double precision and scored in whole numbers of any
size. A score beyond 64 bits counts as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

SCALE, K = 256, 5
QUERIES, SEEDS, BLOCK, PER_PART = 4096, 2048, 1024, 100_000
PASS_BYTES = 16 << 20
MOST = (1 << 63) - 1
#: A component that is finite but not after scaling.
LARGEST = np.finfo(np.float64).max
#: Coordinates of the first and second partial sum, as shares of the dimension.
STEPS = (0.25, 0.5)


def _whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(uid, vec_id, dim, norm2, wide, v): the usable vectors as 32-bit whole numbers or, if too long for exact doubles, as doubles."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            size = np.nan_to_num(batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
            with np.errstate(over="ignore"):
                x = np.clip(scale * x, -LARGEST, LARGEST)
            own = [np.floor(x[ends[k] - size[k] : ends[k]]) for k in good]
            with np.errstate(over="ignore"):
                norm2 = [float(v @ v) for v in own]
            wide = [not x < 1 << 53 for x in norm2]
            data = [v.astype("<f8" if w else "<i4").tobytes() for v, w in zip(own, wide, strict=True)]
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(size[good].astype(np.int32)), pa.array(norm2, pa.float64()), pa.array(wide, pa.bool_()), pa.array(data, pa.binary())], ["uid", "vec_id", "dim", "norm2", "wide", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    return rows.mapInArrow(convert, "uid long, vec_id long, dim int, norm2 double, wide boolean, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(-1, dim).astype(np.float64)


def _rotation(table: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, largest eigenvalue first. Each task sums up its own share of the matrix."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = _matrix(batch.column(0).to_pylist(), dim)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "value"])

    sums = table.select("v").mapInArrow(gram, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    g = np.zeros(dim * dim)
    for at, value in sums:
        g[at] = value
    return np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1]


class _Search:
    """The state of one task: k best scores and ids of each query."""

    def __init__(self, queries: dict, rotation: np.ndarray, k: int) -> None:
        self.q, self.uid, self.k, self.rotation = queries["v"], queries["uid"], k, rotation
        self.turned = self.q @ rotation
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.least = queries["least"].copy()
        n = len(self.q)
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        dim = self.q.shape[1]
        self.steps = sorted({max(1, min(dim, int(dim * x))) for x in STEPS})

    def reached(self, norm2: float) -> bool:
        """Whether vectors of up to this squared length can matter."""
        return bool((self.norm * (longest := np.sqrt(norm2)) + self.slack(longest) >= self.least).any())

    def slack(self, longest: float) -> float:
        return 1e-6 * self.norm.max(initial=1) * max(1.0, longest) + 1e-6

    def block(self, v: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> bool:
        """False if none of these vectors can matter."""
        slack = self.slack(longest := np.sqrt((v**2).sum(axis=1).max()))
        rows = np.flatnonzero(self.norm * longest + slack >= self.least)
        if not len(rows):
            return False
        turned, columns = v @ self.rotation, np.arange(len(v))
        for h in self.steps:
            bound = self.turned[rows, :h] @ turned[columns, :h].T
            bound += np.outer(np.sqrt((self.turned[rows, h:] ** 2).sum(axis=1)), np.sqrt((turned[columns, h:] ** 2).sum(axis=1)))
            open_ = bound + slack >= self.least[rows, None]
            rows, columns = rows[open_.any(axis=1)], columns[open_.any(axis=0)]
            if not len(rows):
                return True
        order = columns[np.lexsort((uid[columns], vec_id[columns]))]
        found = self.q[rows] @ v[order].T
        found[self.uid[rows, None] == uid[order][None, :]] = -np.inf
        k = min(self.k, len(order))
        kth = np.partition(found, -k, axis=1)[:, -k][:, None]
        above, equal = found > kth, found == kth
        keep = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
        at = np.nonzero(keep)[1].reshape(len(rows), k)
        score = np.concatenate([self.score[rows], np.take_along_axis(found, at, 1)], axis=1)
        ids = np.concatenate([self.id[rows], np.where(np.isneginf(np.take_along_axis(found, at, 1)), np.iinfo(np.int64).max, vec_id[order][at])], axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])
        return True

    def rows(self) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(np.isfinite(self.score))
        yield pa.RecordBatch.from_arrays([pa.array(self.uid[i]), pa.array(self.id[i, j]), pa.array(self.score[i, j].astype(np.int64))], ["query_uid", "vec_id", "score"])


def top_k(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. queries: which rows, by a condition on `vec_id`, are queries; all others are candidates, and so are they."""
    ws = Workspace(spark, "topk")
    table = ws.table(_whole(vectors, id_col, vector_col, scale), "vectors")
    where = f"{ws.path}/found"
    empty = spark.createDataFrame([], "query_uid long, vec_id long, score long")
    empty.write.parquet(where)
    for dim, n, wide in table.groupBy("dim").agg(F.count("*"), F.count_if("wide")).orderBy("dim").collect():
        own = table.where(F.col("dim") == dim)
        plain, long_ = own.where("NOT wide"), own.where("wide")
        if n > wide:
            rotation = spark.sparkContext.broadcast(_rotation(plain, dim))
            dealt = plain.repartitionByRange(-(-(n - wide) // PER_PART), F.col("norm2").desc(), "uid").sortWithinPartitions(F.col("norm2").desc(), "uid")
            dealt = ws.table(dealt, f"by_length{dim}")
            longest = dealt.orderBy(F.col("norm2").desc(), "uid").limit(SEEDS).select("uid", "v").collect()
            seeds, seed_uid = _matrix([r.v for r in longest], dim), np.array([r.uid for r in longest])
            for rows in _passes(plain.where(queries), dim, query_block):
                chosen = [{"v": _matrix([r.v for r in part], dim), "uid": np.array([r.uid for r in part])} for part in rows]
                for part in chosen:
                    part["least"] = _first_scores(part, seeds, seed_uid, k)
                shared = spark.sparkContext.broadcast(chosen)
                _pass(dealt.select("uid", "vec_id", "norm2", "v"), shared, rotation, dim, k, block).write.mode("append").parquet(where)
                shared.destroy()
            rotation.destroy()
        for asked, candidates in ((plain, long_), (long_, own)) if wide else ():
            for rows in _passes(asked.where(queries), dim, query_block):
                shared = spark.sparkContext.broadcast([(r.uid, _double(r.v, dim)) for part in rows for r in part])
                _long_pass(candidates.select("uid", "vec_id", "v"), shared, dim, k, block).write.mode("append").parquet(where)
                shared.destroy()
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = ws.read("found", empty).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = table.where(queries).select(F.col("uid").alias("query_uid"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query_uid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _passes(asked: DataFrame, dim: int, query_block: int) -> Iterator[list[list]]:
    """The queries pass by pass, each as blocks of up to about query_block rows (uid, v)."""
    n = asked.count()
    passes = -(-n // max(query_block, PASS_BYTES // (8 * dim))) if n else 0
    for b in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("uid"), F.lit(passes)) == b).select("uid", "v").collect()
        if rows:
            yield [rows[at : at + query_block] for at in range(0, len(rows), query_block)]


def _first_scores(chosen: dict, seeds: np.ndarray, seed_uid: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the seeds, or minus infinity if there are fewer."""
    least = np.full(len(chosen["v"]), -np.inf)
    for at in range(0, len(least), 512):
        found = chosen["v"][at : at + 512] @ seeds.T
        found[chosen["uid"][at : at + 512, None] == seed_uid[None, :]] = -np.inf
        if found.shape[1] >= k:
            least[at : at + 512] = np.partition(found, -k, axis=1)[:, -k]
    return least


def _pass(dealt: DataFrame, chosen, rotation, dim: int, k: int, block: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [_Search(part, rotation.value, k) for part in chosen.value]
        # A task may read several files, in any order of their lengths: a block that can't matter says nothing of later ones.
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                longest = float(pc.max(part.column("norm2")).as_py())
                if open_ := [s for s in searches if s.reached(longest)]:
                    v = _matrix(part.column("v").to_pylist(), dim)
                    ids, uid = (part.column(c).to_numpy() for c in ("vec_id", "uid"))
                    for search in open_:
                        search.block(v, ids, uid)
        for search in searches:
            yield from search.rows()

    return dealt.mapInArrow(scan, "query_uid long, vec_id long, score long")


def _double(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v, "<f8" if len(v) == 8 * dim else "<i4").astype(np.float64)


def _long_pass(candidates: DataFrame, asked, dim: int, k: int, block: int) -> DataFrame:
    """k best of each task for pairs that doubles can't score: what their error bound leaves open is scored in whole numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.slice(at, block)
                v = np.stack([_double(x, dim) for x in part.column("v").to_pylist()])
                ids, uid = (part.column(c).to_pylist() for c in ("vec_id", "uid"))
                # Scaled so that no product overflows.
                size = np.abs(v).max(axis=1, initial=1)
                unit = v / size[:, None]
                for own, q in asked.value:
                    top = max(1.0, np.abs(q).max(initial=1))
                    near = unit @ (q / top)
                    with np.errstate(over="ignore"):
                        low, high = (np.clip((near + e) * size * top, -float(MOST), float(MOST)) for e in (-1e-12 * dim, 1e-12 * dim))
                    other = np.array([x != own for x in uid])
                    have = best.setdefault(own, [])
                    floor = sorted([float(-s) for s, _ in have] + low[other].tolist(), reverse=True)[:k]
                    whole = [int(x) for x in q]
                    for i in np.flatnonzero(other & ((high >= floor[-1]) if len(floor) == k else True)):
                        score = sum(a * int(b) for a, b in zip(whole, v[i], strict=True))
                        have.append((-max(-MOST - 1, min(MOST, score)), ids[i]))
                    best[own] = sorted(have)[:k]
        rows = [(own, i, -s) for own, have in best.items() for s, i in have]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_uid", "vec_id", "score"])

    return candidates.mapInArrow(scan, "query_uid long, vec_id long, score long")
