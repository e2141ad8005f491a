"""Near duplicates by one-permutation MinHash, with every link confirmed on full shingle sets.

1. Signatures. A document's set holds the hashes of its distinct word shingles. One permutation cuts the hash range
   into bins and keeps each bin's least hash; an empty bin takes over the value of the first filled one on its own
   random walk (optimal densification), so that small sets work too. BANDS bands of ROWS bins give bucket keys.
2. Copies. Documents with equal sets form a class; only its smallest row goes on, so copies are never paired.
3. Stars. In each bucket the member that shares most buckets with others is the centre, and the others become
   candidate partners of the centre only. Pairs whose signatures or sizes rule the threshold out go; the rest are
   confirmed on the full sets. The links give provisional components.
4. What stars miss. Buckets whose members are still in different components are searched once more in memory, by
   signature, for bridges between components that sizes and signatures allow; only those that join something new
   leave the task. Components that bridges hold together form a family, and inside a family every pair that crosses
   components and may reach the threshold is compared on full sets, until it is joined otherwise. A bucket or family
   of more than BLOCK members, or BLOCK_BYTES of sets, is searched in blocks against blocks, so that no task holds it
   all. No pair is capped away.
5. Components over all confirmed links.

Defined cases: a document with fewer words than a shingle has its whole word sequence as one shingle; one without words
or text has an empty set and is linked with nothing; a null id stays null and is never a component's name unless all
its documents have null ids; repeated rows are copies; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, many_to_one
from .components import FEW, components
from .hashing import mixed, word_codes
from .tokens import parts_of

WORDS, PERCENT = 5, 85
BANDS, ROWS = 26, 5
BINS = BANDS * ROWS
#: Pairs are compared on full sets unless their signatures agree in fewer bins than this many standard deviations below the threshold.
DEVIATIONS = 5.0
#: Members of a block and bytes of their sets; of one centre a quarter of BLOCK partners are compared in a task.
BLOCK, BLOCK_BYTES = 2048, 16 << 20

_rng = np.random.default_rng(20240607)
_WALK = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_BAND = _rng.integers(1, 1 << 62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z, words end at ASCII white space."""
    data = [(t or "").encode().lower() for t in texts]
    s = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    border = np.cumsum([len(x) + 1 for x in data])
    space = (s == 32) | ((s >= 9) & (s <= 13))
    inner = ~space
    starts = np.flatnonzero(inner & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(inner & np.concatenate([space[1:], [True]])) + 1
    one = word_codes(s, starts, ends)
    first = np.searchsorted(starts, np.concatenate([[0], border[:-1]]))
    last = np.searchsorted(starts, border)
    n = len(one)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        rolled += one[k : k + len(rolled)] * _PLACE[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mixed((one[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """One value for each bin, of a sorted set that is not empty."""
    bins = ((own >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    values = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    values[bins[first]] = own[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        walk = _WALK[empty]
        values[empty] = values[walk[np.arange(len(empty)), np.argmax(filled[walk], axis=1)]]
    return values


def features(docs: DataFrame, words: int) -> DataFrame:
    """docs(id_, hash_, text_) -> (uid, id_, hash_, n, d1, d2, bands, marks): set size, set digest, bucket keys, a byte of each bin."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 3, 4 << 20):
                sets = shingle_sets(part.column(3).to_pylist(), words)
                some = [x for x in sets if len(x)]
                signs = np.stack([signature(x) for x in some]) if some else np.zeros((0, BINS), np.uint64)
                keys = mixed((signs.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64)).view(np.int64)
                marks = (mixed(signs) & np.uint64(255)).astype(np.uint8)
                digests = np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in some]).reshape(-1, 2)
                full = np.array([len(x) > 0 for x in sets], bool)
                at = np.where(full, np.cumsum(full) - 1, 0)
                lost = ~full
                pick = lambda values, kind: pa.array([None if no else values[k] for no, k in zip(lost, at, strict=True)], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pick(digests[:, 0].tolist(), pa.int64()), pick(digests[:, 1].tolist(), pa.int64()), pick(list(keys), pa.list_(pa.int64())), pick([x.tobytes() for x in marks], pa.binary())],
                    ["uid", "id_", "hash_", "n", "d1", "d2", "bands", "marks"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "id_", "hash_", "text_")
    return rows.mapInArrow(measure, "uid long, id_ long, hash_ long, n long, d1 long, d2 long, bands array<long>, marks binary")


def least_agreement(percent: int, n: np.ndarray) -> np.ndarray:
    """Bins in which signatures of sets at the threshold agree at least, the smaller with n members.

    Bins of a small set that borrow from the same member agree or differ together, so the deviation has a part in 1/n.
    """
    p = percent / 100
    return (BINS * np.maximum(0.0, p - DEVIATIONS * np.sqrt(p * (1 - p) * (1 / BINS + 2 / np.maximum(n, 1))))).astype(np.int64)


def _may_link(stars: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that neither sizes nor signatures rule out."""
    one = reps.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("m_a"))
    two = reps.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("m_b"))
    pairs = many_to_one(stars, one, ["a"]).join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", F.least("n_a", "n_b").alias("n"), "m_a", "m_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (3, 4)]
            yield batch.select(["a", "b"]).filter(pa.array((m[0] == m[1]).sum(axis=1) >= least_agreement(percent, batch.column(2).to_numpy())))

    return pairs.mapInArrow(compare, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, partners: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. A centre's set goes to a task for each `partners` of its partners."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q)) if len(p) and len(q) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / partners).cast("int").alias("tasks"))
    dealt = many_to_one(pairs, tasks, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), "tasks").cast("int").alias("task"))
    b = sets.select(F.col("cid").alias("b"), F.col("own").alias("s_b"))
    a = sets.join(tasks, F.col("cid") == F.col("a")).select("a", F.explode(F.expr("sequence(0, tasks - 1)")).alias("task"), F.col("own").alias("s_a"))
    return dealt.join(b, "b").join(a, ["a", "task"]).select("a", "b", "s_a", "s_b").mapInArrow(check, "a long, b long")


class _Union:
    """Disjoint sets over places 0 .. n-1 that begin as given."""

    def __init__(self, groups: np.ndarray) -> None:
        self.root = np.unique(groups, return_inverse=True)[1].astype(np.int64)

    def join(self, a: int, b: int) -> None:
        one, two = self.root[a], self.root[b]
        self.root[self.root == two] = one


def _cells(rows: pa.Table, percent: int, confirm: bool) -> Iterator[tuple[int, int]]:
    """Links of a cell that join components: candidates by size and signature or, with `confirm`, those whose full sets reach the threshold.

    A pair within what is joined already says nothing new, so a cell gives fewer links than it has members.
    """
    cid, n, block, comp = (rows.column(c).to_numpy() for c in ("cid", "n", "block", "comp"))
    union = _Union(comp)
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, BINS)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("own")] if confirm else []
    within = rows.column("i")[0] == rows.column("j")[0]
    for x in range(len(n)):
        y = np.arange(x + 1, len(n))
        y = y[(union.root[y] != union.root[x]) & (within | (block[y] != block[x])) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        if not len(y):
            continue
        same = (marks[y] == marks[x]).sum(axis=1)
        may = same >= least_agreement(percent, np.minimum(n[y], n[x]))
        for k in y[may][np.argsort(-same[may], kind="stable")]:
            if union.root[k] != union.root[x]:
                if confirm:
                    both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                    if 100 * both < percent * (n[x] + n[k] - both):
                        continue
                union.join(x, k)
                yield int(min(cid[x], cid[k])), int(max(cid[x], cid[k]))


def _joining(members: DataFrame, at: list[str], percent: int, confirm: bool) -> DataFrame:
    """Links (a, b) of members(*at, i, j, block, cid, comp, n, marks[, own]), cell by cell."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            links = list(_cells(pa.Table.from_batches(held), percent, confirm))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in [*at, "i", "j"]), strict=True))
            borders = [k for k in range(len(keys)) if keys[k] != (keys[k - 1] if k else last)]
            new = set(borders)
            for a, b in zip([0, *borders], [*borders, len(keys)], strict=True):
                if a in new and held:
                    yield found()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            last = keys[-1] if keys else last
        if held:
            yield found()

    return members.repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j").mapInArrow(search, "a long, b long").distinct()


def _in_blocks(members: DataFrame, parts: str) -> DataFrame:
    """Each member in the cells (i, j) of its block with every other; parts: how many blocks its bucket or family has."""
    dealt = members.withColumn("block", F.expr(f"cast(pmod(xxhash64(cid), {parts}) AS int)")).withColumn("other", F.explode(F.expr(f"sequence(0, {parts} - 1)")))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", parts)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(uid, id_, hash_, n, component_id): one row per document. hash_ is xxhash64 of the text, with null as empty."""
    ws = Workspace(spark, "neardup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.xxhash64(text).alias("hash_"), text.alias("text_"))
    found = ws.table(features(rows, words), "features")
    classes = found.where("n > 0").groupBy("d1", "d2").agg(F.min("uid").alias("uid"), F.min("id_").alias("low"))
    reps = ws.table(found.join(classes.select("uid", "low"), "uid").withColumnRenamed("uid", "cid"), "reps")
    places = reps.select("cid", F.posexplode("bands").alias("band", "key"))
    sizes = places.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    members = ws.table(many_to_one(places, sizes, ["band", "key"]), "members")
    shared = members.groupBy("cid").agg(F.sum("c").alias("shared"))
    centres = members.join(shared, "cid").groupBy("band", "key").agg((-F.max(F.struct("shared", (-F.col("cid")).alias("less")))["less"]).alias("centre"))
    stars = many_to_one(members.select("band", "key", "cid"), centres, ["band", "key"]).where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    first = ws.table(_may_link(stars, reps, percent), "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(part.column(1).to_pylist(), words)], pa.binary())], ["cid", "own"])

    wanted = reps.join(shared.select("cid"), "cid", "left_semi").select("cid", F.col("id_").alias("id_2"), F.col("hash_").alias("hash_2"))
    texts = rows.join(wanted, F.col("id_").eqNullSafe(F.col("id_2")) & (F.col("hash_") == F.col("hash_2"))).select("cid", "text_")
    # Repeated rows would give a set twice; one is as good as the other.
    sets = ws.table(texts.mapInArrow(read, "cid long, own binary"), "sets").dropDuplicates(["cid"])
    links = ws.table(_confirmed(first, sets, percent, max(1, block // 4)), "links1")
    near = components(ws, links, "near", few)
    comp = F.coalesce("comp", "cid")
    labelled = ws.table(many_to_one(members, near.withColumnRenamed("node", "cid"), ["cid"], "left").withColumn("comp", comp), "labelled")
    open_ = labelled.groupBy("band", "key").agg(F.min("comp").alias("one"), F.max("comp").alias("two"), F.ceil(F.count("*") / block).cast("int").alias("parts")).where("one <> two").select("band", "key", "parts")
    inner = many_to_one(labelled.drop("c"), open_, ["band", "key"]).join(reps.select("cid", "n", "marks"), "cid")
    bridges = ws.table(_joining(_in_blocks(inner, "parts"), ["band", "key"], percent, False), "bridges")
    whole = near
    if not bridges.isEmpty():
        # What the bridges hold together is a family: two components that may have a link are in the same one.
        groups = near.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(bridges)
        family = components(ws, groups, "family", few).withColumnRenamed("comp", "family").withColumnRenamed("node", "cid")
        known = many_to_one(family, near.withColumnRenamed("node", "cid"), ["cid"], "left").withColumn("comp", comp)
        known = ws.table(known.join(reps.select("cid", "n", "marks"), "cid"), "families")
        parts = F.ceil(F.greatest(F.count("*") / block, 8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("parts")
        apart = known.groupBy("family").agg(F.min("comp").alias("one"), F.max("comp").alias("two"), parts).where("one <> two").select("family", "parts")
        inner = many_to_one(known, apart, ["family"]).join(sets, "cid")
        more = ws.table(_joining(_in_blocks(inner, "parts"), ["family"], percent, True), "more")
        if not more.isEmpty():
            whole = components(ws, links.unionByName(more), "whole", few)
    named = reps.select("cid", "d1", "d2", "low").join(whole.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", comp)
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    names = many_to_one(named.select("d1", "d2", "comp"), lows, ["comp"]).select("d1", "d2", "component_id")
    out = many_to_one(found.select("uid", "id_", "hash_", "n", "d1", "d2"), names, ["d1", "d2"], "left")
    return out.select("uid", "id_", "hash_", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id_")).alias("component_id"))


def representatives(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component: the one with its smallest id. Rows with an empty set stay, and so does one of rows with null ids."""
    found = near_duplicates(spark, docs, percent, words, id_col, text_col)
    # Of repeated rows one stays; different texts under the smallest id of their component all stay.
    kept = found.where((F.col("n") == 0) | F.col("id_").eqNullSafe(F.col("component_id")))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").cast("long").alias("id_"), F.xxhash64(text).alias("hash_"))
    one = kept.groupBy("id_", "hash_").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    right = one.select(F.col("id_").alias("id_2"), F.col("hash_").alias("hash_2"), "rows", "n")
    joined = whole.join(right, F.col("id_").eqNullSafe(F.col("id_2")) & (F.col("hash_") == F.col("hash_2")))
    single, many = joined.where("rows = 1 OR n = 0"), joined.where("rows > 1 AND n > 0")
    first = many.groupBy("id_", "hash_").agg(F.first("whole").alias("whole"))
    return single.select("whole.*").unionByName(first.select("whole.*"))
