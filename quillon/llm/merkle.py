"""Manifest of a dataset as a hash tree, with a proof for every row.

Rows are leaves; the leaves of a source in order, and then the sources' roots in order, are hashed in runs of ARITY up
to one root. Trees are worked on in aligned blocks of ARITY**DEPTH nodes. Going up, a task hashes each block to its root
with one open run a level; the roots are the nodes of the next, smaller round. Going down, each block is walked
by fractal traversal: for every HEIGHT levels the subtree above the current leaf exists whole, the one that comes
next is built meanwhile by a leaf at each step, and takes its place when the walk gets there. So successive
authentication paths cost a few hashes each and hold a few subtrees. What lies above a block, the proof of its
root, comes with it from the round above and is appended to each path.

Defined cases: a null field counts as `-`, a null source is a source of its own and comes first, null numbers come first in their source
and are never tampered with; of equal numbers the smaller leaf digest comes first, and of wholly equal rows any; empty texts
are values, texts of any length are hashed whole in the JVM; a source of one row is its own root; a frequent source is
cut into blocks like any other; an empty table gives an empty manifest; other columns are not read, whatever their names.
Reruns on any layout give the same rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, many_to_one, running_total

#: Fixed by the output contract.
ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block, and of a subtree of the traversal.
DEPTH, HEIGHT = 7, 3


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int, arity: int = ARITY) -> int:
    """How often n nodes are hashed in runs until one remains."""
    d = 0
    while n > 1:
        n, d = -(-n // arity), d + 1
    return d


class Subtree:
    """The nodes from level `low` to below `high` under the j-th node of level `high`, built a leaf at a time."""

    def __init__(self, leaves: list[str], low: int, high: int, j: int) -> None:
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = j * ARITY**high, min(len(leaves), (j + 1) * ARITY**high)
        self.first = [self.at // ARITY**k for k in range(low, high)]
        self.nodes: list[list[str]] = [[] for _ in range(low, high)]
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.root = ""

    def _put(self, level: int, node: str) -> None:
        while True:
            if self.low <= level < self.high:
                self.nodes[level - self.low].append(node)
            if level == self.high:
                self.root = node
                return
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node = sha(*run)
            run.clear()
            level += 1

    def step(self) -> None:
        if self.at < self.end:
            self._put(0, self.leaves[self.at])
            self.at += 1
            if self.at == self.end:  # what is left of the last runs, even one node, is hashed too
                for level, run in enumerate(self.open):
                    if run:
                        node = sha(*run)
                        run.clear()
                        self._put(level + 1, node)

    def whole(self) -> Subtree:
        while self.at < self.end:
            self.step()
        return self

    def around(self, level: int, index: int) -> tuple[str, str]:
        """The nodes before and after this one in its run, joined."""
        nodes, k = self.nodes[level - self.low], index - self.first[level - self.low]
        a = k - index % ARITY
        return "".join(nodes[a:k]), "".join(nodes[k + 1 : a + ARITY])


def block_root(leaves: list[str], depth: int) -> str:
    """The root of a block of that many levels, with one open run a level."""
    return Subtree(leaves, depth, depth, 0).whole().root if depth else leaves[0]


def paths(leaves: list[str], depth: int, height: int = HEIGHT):
    """For each leaf in order: what stands beside its path, from level 0 on, as (before, after)."""
    cuts = [*range(0, depth, height), depth]
    layers = list(zip(cuts[:-1], cuts[1:], strict=True))
    existing = [Subtree(leaves, a, b, 0).whole() for a, b in layers]
    desired = [Subtree(leaves, a, b, 1) for a, b in layers]
    for p in range(len(leaves)):
        for i, (a, b) in enumerate(layers):
            if p and p % ARITY**b == 0:
                existing[i], desired[i] = desired[i].whole(), Subtree(leaves, a, b, p // ARITY**b + 1)
            desired[i].step()
        yield [existing[i].around(level, p // ARITY**level) for i, (a, b) in enumerate(layers) for level in range(a, b)]


def fold(node: str, path) -> str:
    for before, after in path:
        node = sha(before, node, after)
    return node


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes(grp, idx, n, h) -> the roots of their blocks as nodes of the same kind."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n = t["n"][0].as_py()
        root = block_root(t["h"].to_pylist(), min(depth, levels(n)))
        return pa.table({"grp": [t["grp"][0].as_py()], "idx": [t["idx"][0].as_py() // ARITY**depth], "n": [-(-n // ARITY**depth)], "h": [root]})

    return nodes.select("grp", "idx", "n", "h", _block(depth).alias("block")).groupBy("grp", "block").applyInArrow(run, "grp string, idx long, n long, h string")


def _block(depth: int) -> Column:
    return F.floor(F.col("idx") / ARITY**depth).cast("long")


PROOF = "grp string, idx long, befores array<string>, afters array<string>, subroot string, root string"


def _down(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """The proofs of nodes, from those of their blocks' roots in above(PROOF)."""

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        befores, afters = up["befores"][0].as_py(), up["afters"][0].as_py()
        own = list(paths(t["h"].to_pylist(), min(depth, levels(t["n"][0].as_py()))))
        lists = lambda k, rest: pa.array([[x[k] for x in p] + rest for p in own], pa.list_(pa.string()))
        same = lambda c: pa.array([up[c][0].as_py()] * len(t), pa.string())
        return pa.table([t["grp"], t["idx"], lists(0, befores), lists(1, afters), same("subroot"), same("root")], names=["grp", "idx", "befores", "afters", "subroot", "root"])

    left = nodes.select("grp", "idx", "n", "h", _block(depth).alias("block")).groupBy("grp", "block")
    return left.cogroup(above.withColumn("block", F.col("idx")).groupBy("grp", "block")).applyInArrow(run, PROOF)


def _rounds(ws: Workspace, nodes: DataFrame, n: int, name: str, depth: int) -> list[DataFrame]:
    """The nodes and those of all rounds above, until one is left in each group. n: nodes of the largest group."""
    out = [nodes]
    while n > 1 or len(out) == 1:
        out.append(ws.table(_up(out[-1], depth), f"{name}{len(out)}"))
        n = -(-n // ARITY**depth)
    return out


def encoded(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(columns[f].cast("string")) for f in FIELDS]), 256)


def manifest(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row a row of docs(FIELDS). depth: levels of a block.

    folded_root: what a row's proof gives for the row, or for what has become of it where it was tampered with.
    """
    ws = Workspace(spark, "merkle")
    own = {f: F.col(f"`{f}`") for f in FIELDS}
    tampered = F.when(F.crc32(own["doc_id"].cast("string")) % 2 == 0, F.replace(own["text"], F.lit("\n"), F.lit("")))
    rows = docs.select(
        F.col("doc_id"), F.when(own["source"].isNull(), "n").otherwise(F.concat(F.lit("s"), own["source"])).alias("grp"), leaf(own).alias("h"),
        F.when(F.contains(own["text"], F.lit("\n")) & (F.crc32(own["doc_id"].cast("string")) % 2 == 0), leaf(own | {"text": tampered})).alias("changed"),
        F.monotonically_increasing_id().alias("uid"),
    )
    leaves = ws.table(_placed(ws, ws.table(rows, "rows")), "leaves")
    rounds = _rounds(ws, leaves, leaves.agg(F.max("n")).first()[0] or 0, "round", depth)
    subroots = running_total(ws, rounds[-1].select("grp", "h", F.lit(1).cast("long").alias("one")), "sources", [], ["grp"], "one")
    count = rounds[-1].count()
    sources = ws.table(subroots.select(F.lit("").alias("grp"), F.col("before").alias("idx"), F.lit(count).cast("long").alias("n"), "h", F.col("grp").alias("source_")), "tops")
    tops = _rounds(ws, sources, count, "top", depth)
    none = F.array().cast("array<string>")
    proofs = tops[-1].select("grp", "idx", none.alias("befores"), none.alias("afters"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    for k, nodes in reversed(list(enumerate(tops[:-1]))):
        proofs = ws.table(_down(nodes, proofs, depth), f"above{k}")
    named = sources.select("idx", F.col("source_").alias("grp_"), F.col("h").alias("subroot_"))
    proofs = proofs.join(named, "idx").select(F.col("grp_").alias("grp"), F.lit(0).cast("long").alias("idx"), "befores", "afters", F.col("subroot_").alias("subroot"), "root")
    for k, nodes in reversed(list(enumerate(rounds[1:-1], 1))):
        proofs = ws.table(_down(nodes, proofs, depth), f"under{k}")
    return _proven(leaves, proofs, depth)


def _placed(ws: Workspace, rows: DataFrame) -> DataFrame:
    """rows with idx, their place from 0 in their source, and n, the source's size. Ranges of rows are numbered one by one, so that a frequent source is cut like any other."""
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // 200_000)), "grp", "doc_id", "h", "uid") if n > 200_000 else rows.coalesce(1)
    dealt = ws.table(dealt.withColumn("part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy("grp", "part").agg(F.count("*").alias("in_part"))
    whole = Window.partitionBy("grp")
    sums = sums.select("grp", "part", (F.sum("in_part").over(whole.orderBy("part")) - F.col("in_part")).alias("offset_"), F.sum("in_part").over(whole).alias("n"))
    inside = dealt.withColumn("k_", F.row_number().over(Window.partitionBy("part", "grp").orderBy("doc_id", "h", "uid")))
    return many_to_one(inside, sums, ["grp", "part"]).select("doc_id", "grp", "h", "changed", "n", (F.col("offset_") + F.col("k_") - 1).cast("long").alias("idx"))


def _proven(leaves: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        upper = list(zip(up["befores"][0].as_py(), up["afters"][0].as_py(), strict=True))
        rest = "".join(a + b for a, b in upper)
        h, changed = t["h"].to_pylist(), t["changed"].to_pylist()
        proofs, folded = [], []
        for path, mine, other in zip(paths(h, min(depth, levels(t["n"][0].as_py()))), h, changed, strict=True):
            proofs.append(sha(*[a + b for a, b in path], rest))
            folded.append(fold(fold(mine if other is None else other, path), upper))
        root = up["root"][0].as_py()
        same = lambda x: pa.array([x] * len(t), pa.string())
        columns = [t["doc_id"], t["h"], same(up["subroot"][0].as_py()), same(root), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([x == root for x in folded], pa.bool_())]
        return pa.table(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = leaves.schema["doc_id"].dataType.simpleString()
    left = leaves.withColumn("block", _block(depth)).groupBy("grp", "block")
    right = above.withColumn("block", F.col("idx")).groupBy("grp", "block")
    return left.cogroup(right).applyInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
