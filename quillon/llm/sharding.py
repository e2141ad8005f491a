"""Sharding by balanced label propagation, in DataFrame operations only.

Linked documents (by default: those with equal texts) start on hashed shards. In each round every group counts its
members by shard; members outside the group's fullest shard with room want to move there. How many may is set by
quotas: the flows between shards form a small square matrix, from which the largest accepted shares follow that
keep every shard within its fair part of all bytes. A small group moves as one, a large one in hashed shares, so
that a group of a third of all rows spreads over as many shards as it needs. Documents without links never cut an
edge; they are laid end to end in hash order and fill the shards up to even sizes.

Law: `bytes`, the sizes of the shards are near equal (within the largest document or so).

Defined cases: null and empty texts have size 1 and link with nothing; null ids and repeated rows are rows like any
other; texts of any length are only hashed and measured; an empty table gives no rows; other columns are not read. The same
rows in files or splits of another layout get the same shards and slots, as only their values are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, many_to_one, running_total

ROUNDS, SALTS = 6, 8
#: A group's members on a shard move as one up to this part of a shard's fair size.
WHOLE = 0.01


def accepted(flows: list[list[float]], room: list[float]) -> list[float]:
    """Largest shares, by target, of the wished flows[from][to] such that no target's load grows by more than its room."""
    n = len(room)
    share = [1.0] * n
    for _ in range(100):
        into = [sum(flows[s][t] for s in range(n)) for t in range(n)]
        out = [sum(flows[s][t] * share[t] for t in range(n)) for s in range(n)]
        share = [min(share[t], max(0.0, (room[t] + out[t]) / into[t])) if into[t] else 0.0 for t in range(n)]
    return share


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _by_shard(values: list[float], column: str = "shard") -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(column).cast("int") + 1)


def _loads(df: DataFrame, n: int, column: str = "shard") -> list[float]:
    found = {r[0]: float(r[1]) for r in df.groupBy(column).agg(F.sum("size")).collect()}
    return [found.get(s, 0.0) for s in range(n)]


def propagate(ws: Workspace, linked: DataFrame, room_for: float, n: int, rounds: int = ROUNDS) -> DataFrame:
    """linked(uid, g1, g2, size, mix) with `shard`. room_for: the bytes that a shard may hold at most, here and elsewhere."""
    state = ws.table(linked.withColumn("shard", F.pmod(F.xxhash64("mix", F.lit(1)), F.lit(n)).cast("int")), "labels0")
    for k in range(rounds):
        loads = _loads(state, n)
        free = [room_for - x for x in loads]
        votes = state.groupBy("g1", "g2", "shard").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))
        votes = ws.table(votes, f"votes{k}")
        # Even rounds let groups change places on full shards, odd ones send what found no room to shards that have it.
        least = 0.0 if k % 2 else -0.02 * room_for
        top = F.max(F.when(_by_shard(free) > least, F.struct("members", "bytes", (-F.col("shard")).alias("less")))).alias("top")
        best = votes.groupBy("g1", "g2").agg(top).select("g1", "g2", (-F.col("top.less")).cast("int").alias("to"), F.col("top.members").alias("there"))
        wish = votes.join(best.hint("shuffle_hash"), ["g1", "g2"]).where("to IS NOT NULL AND to <> shard AND (members < there OR members = there AND to < shard)")
        wish = ws.table(wish.select("g1", "g2", "shard", "to", "bytes"), f"wishes{k}")
        flows = [[0.0] * n for _ in range(n)]
        for a, b, size in wish.groupBy("shard", "to").agg(F.sum("bytes")).collect():
            flows[a][b] = float(size)
        if not any(map(any, flows)) and k % 2:
            break
        share = accepted(flows, free)
        wish = wish.withColumn("share", _by_shard(share, "to")).withColumn("whole", F.col("bytes") <= F.lit(WHOLE * room_for)).drop("bytes")
        luck = F.when(F.col("whole"), _unit(F.col("g1"), F.col("g2"), F.lit(k))).otherwise(_unit(F.col("mix"), F.lit(k)))
        moved = many_to_one(state, wish, ["g1", "g2", "shard"], "left", SALTS)
        moved = moved.withColumn("shard", F.when(luck < F.col("share"), F.col("to")).otherwise(F.col("shard")))
        state = ws.table(moved.select(*state.columns), f"labels{k + 1}")
        for name in (f"labels{k}", f"votes{k}", f"wishes{k}"):
            ws.drop(name)
    return state


def shard(spark: SparkSession, docs: DataFrame, n: int = 8, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per document."""
    ws = Workspace(spark, "sharding")
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), (size + 1).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(7), text, size).alias("g2"))
    # What a row hashes to must not hang on how the input is split; only equal rows are told apart, by a running number.
    twins = running_total(ws, rows.withColumn("one", F.lit(1).cast("long")), "twins", ["doc_id", "g1", "g2"], ["uid"], "one")
    rows = ws.table(twins.withColumn("mix", F.xxhash64("doc_id", "g1", "g2", "before")).drop("one", "before"), "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fair = total / n
    groups = ws.table(rows.where("size > 1").groupBy("g1", "g2").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    marked = many_to_one(rows.select("uid", "g1", "g2", "size", "mix"), groups, ["g1", "g2"], "left", SALTS)
    marked = ws.table(marked.withColumn("is_linked", F.coalesce(F.col("members") > 1, F.lit(False)) & (F.col("size") > 1)).drop("members"), "marked")
    labels = propagate(ws, marked.where("is_linked").drop("is_linked"), fair, n, rounds)
    loads = _loads(labels, n)
    # A shard above its fair part gives a hashed share of its linked documents to the pool that evens out.
    stays = ws.table(labels.withColumn("in_pool", _unit(F.col("mix"), F.lit("pool")) < _by_shard([max(0.0, 1.02 * (x - fair) / x) if x > fair else 0.0 for x in loads])), "stays")
    loads = _loads(stays.where("NOT in_pool"), n)
    pool = marked.where("NOT is_linked").select("uid", "size", "mix").unionByName(stays.where("in_pool").select("uid", "size", "mix"))
    line = running_total(ws, pool, "pool", [], ["mix", "uid"], "size")
    lacks = [max(0.0, fair - x) for x in loads]
    scale = (total - sum(loads)) / sum(lacks) if sum(lacks) else 0.0
    at, chosen = 0.0, F.lit(n - 1)
    edges = []
    for x in lacks[:-1]:
        at += x * scale
        edges.append(at)
    for s in range(n - 2, -1, -1):
        chosen = F.when(F.col("before") + F.col("size") / 2 < edges[s], F.lit(s)).otherwise(chosen)
    placed = line.select("uid", chosen.alias("shard")).unionByName(stays.where("NOT in_pool").select("uid", "shard"))
    whole = ws.table(rows.drop("g1", "g2").join(placed, "uid"), "placed")
    ranked = running_total(ws, whole.withColumn("one", F.lit(1).cast("long")), "ranked", ["shard"], ["mix", "uid"], "one")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
