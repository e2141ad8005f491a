"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: the sources, in code point order with null last, weigh 1, 2, 3, 1, 2, 3 ...; they share the words of the
whole corpus, but none goes beyond `most` times its own words: what is over is shared again by weight.
Blocks: the documents of a source are shuffled by a hash, laid end to end and cut into blocks of equal word count, at
most a 16th of the source's own words, so that a small source has 16 blocks as well.
Schedule: slot i takes the i-th point of van der Corput's sequence, the source on whose part of the cumulative
targets (in blocks) the point falls, and that source's next block; after its last block a source starts again. How many
earlier slots fell on the same source (the slot's rank) is counted in closed form from the binary digits of the
source's two bounds, so no task walks along a source. Each source has as many slots as come closest to its target:
those beyond stay empty, and what the points left out follows after the last slot.

Defined cases: null and empty texts have size 0 and are never taken; null source is a source; rows with equal ids are
separate rows; an empty table gives no rows; sources without words get the target 0; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, Workspace, many_to_one, running_total, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
#: A block is at most so large a part of its source.
PARTS = 16
#: Points are whole numbers below 2**BITS.
BITS = 40
#: A table of sources up to this many rows is broadcast, a larger one is joined with salts.
FEW = 20_000


@dataclass
class Mix:
    rows: DataFrame  # uid, doc_id, source, size, sid, block_words, before: one row per document
    sources: DataFrame  # sid, source, source_size, target, block_words, n_blocks, wanted, lo, hi
    slots: DataFrame  # slot, sid, block, pass: the schedule
    block_words: int  # of large sources
    n_sources: int


def reversed_bits(x: Column) -> Column:
    """The lowest BITS bits of a long, in reverse order."""
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        keep = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, step).bitwiseAND(keep).bitwiseOR(F.shiftleft(x.bitwiseAND(keep), step))
    return F.shiftrightunsigned(x, 64 - BITS)


def hits_below(slot: str, bound: str, mirrored: str) -> Column:
    """How many of the points of slots 0 .. slot-1 lie below `bound`; `mirrored` is the bound with its bits reversed.

    [0, bound) is a union of one binary interval for each set bit, and the points in a binary interval of length
    2**-j are those of the slots that leave one known remainder modulo 2**j.
    """
    total = " + ".join(f"((shiftright({mirrored}, {j - 1}) & 1L) * shiftright({slot} - ({mirrored} & {(1 << (j - 1)) - 1}L) + {(1 << j) - 1}L, {j}))" for j in range(1, BITS + 1))
    return F.expr(f"CASE WHEN {bound} >= {1 << BITS}L THEN {slot} ELSE {total} END")


def targets(ws: Workspace, sizes: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """sizes(source, source_size) with sid, weight and target, and the sum of all sizes.

    Each round finds the sources above their limit at the present share and shares what is left among the others.
    """
    named = sizes.withColumns({"null_": F.col("source").isNull().cast("int"), "one_": F.lit(1).cast("long")})
    ranked = running_total(ws, named, "ranked", [], ["null_", "source"], "one_").withColumnRenamed("before", "sid").drop("null_", "one_")
    known = ws.table(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")), "sources")
    total, free = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = total
    while True:
        over = F.col("weight").cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)") > F.col("source_size").cast("decimal(19,0)") * F.lit(most * free).cast("decimal(19,0)")
        capped, weight = known.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (total - capped, weight) == (left, free) or not weight:
            break
        left, free = total - capped, weight
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(free or 1))
    return known.withColumn("target", F.when(over, (F.col("source_size") * most).cast("double")).otherwise(share)), total


def plan(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The schedule and what it needs. block_words, of large sources: by default the 2**18th part of the corpus, from 16 to 4096."""
    ws = Workspace(spark, "mixing")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("shuffled"))
    rows = ws.table(rows, "rows")
    sources, total = targets(ws, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    words = block_words or min(4096, max(16, total >> 18))
    size, own = F.col("source_size"), F.col("block_words")
    sources = sources.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(words), F.ceil(size / PARTS))).cast("long")).withColumn("n_blocks", F.ceil(size / own).cast("long"))
    passes = F.floor(F.col("target") / F.greatest(size, F.lit(1)))
    wanted = F.least(passes * F.col("n_blocks") + F.round((F.col("target") - passes * size) / own), F.col("n_blocks") * most).cast("long")
    sources = sources.withColumn("wanted", wanted).withColumn("share", F.col("target") / own)
    share = sources.agg(F.sum("share")).first()[0] or 1.0
    # Shares as whole points, so that they add up alike in any order; rounding is lost to the last source.
    sources = sources.withColumn("points", F.floor(F.least(F.lit(1.0), F.col("share") / F.lit(float(share))) * float(1 << BITS)).cast("long"))
    sources = running_total(ws, sources, "added", [], ["sid"], "points").withColumnRenamed("before", "lo")
    last = F.col("sid") == F.lit(sources.agg(F.max("sid")).first()[0])
    sources = sources.withColumn("hi", F.when(last, F.lit(1 << BITS)).otherwise(F.col("lo") + F.col("points"))).drop("points")
    sources = ws.table(sources.withColumns({"lo_back": reversed_bits(F.col("lo")), "hi_back": reversed_bits(F.col("hi"))}), "targets")
    n_sources = sources.count()
    rows = _with_source(rows, sources.select("source", "sid", "block_words"), "source", n_sources)
    rows = ws.table(running_total(ws, rows, "dealt", ["sid"], ["shuffled", "doc_id", "uid"], "size"), "stream")
    return Mix(rows, sources, ws.table(_slots(spark, sources, math.ceil(share) if total else 0, n_sources), "schedule"), words, n_sources)


def _with_source(many: DataFrame, one: DataFrame, key: str, n: int) -> DataFrame:
    if n > FEW:
        return many_to_one(many, one, [key])
    right = F.broadcast(one.withColumnRenamed(key, "key_"))
    return many.join(right, many[key].eqNullSafe(right["key_"])).drop("key_")


def _slots(spark: SparkSession, sources: DataFrame, n: int, n_sources: int) -> DataFrame:
    bins = max(12, n_sources.bit_length() + 2)
    used = sources.where("n_blocks > 0")
    own = F.struct("sid", "lo", "hi", "lo_back", "hi_back", "wanted", "n_blocks").alias("own")
    parts = used.where("hi > lo").select(own, "lo", F.explode(F.sequence(F.shiftright("lo", BITS - bins), F.shiftright(F.col("hi") - 1, BITS - bins))).alias("bin"))
    # In a bin the sources' bounds and the points stand in one order; a point's source is that of the last bound before it.
    bounds = parts.select("bin", F.greatest("lo", F.shiftleft("bin", BITS - bins)).alias("point"), F.lit(-1).cast("long").alias("slot"), "own")
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", reversed_bits(F.col("slot")))
    slots = slots.select(F.shiftright("point", BITS - bins).alias("bin"), "point", "slot", F.lit(None).cast(bounds.schema["own"].dataType).alias("own"))
    before = Window.partitionBy("bin").orderBy("point", "slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = bounds.unionByName(slots).withColumn("own", F.last("own", True).over(before)).where("slot >= 0 AND point < own.hi").select("slot", "own.*")
    ranked = placed.withColumn("rank", hits_below("slot", "hi", "hi_back") - hits_below("slot", "lo", "lo_back")).where("rank < wanted")
    # What the points left out: the sources take turns.
    short = used.withColumn("got", hits_below(f"{n}L", "hi", "hi_back") - hits_below(f"{n}L", "lo", "lo_back")).where("got < wanted")
    rest = short.withColumn("rank", F.explode(F.sequence("got", F.col("wanted") - 1))).withColumn("slot", F.lit(n) + (F.col("rank") - F.col("got")) * n_sources + F.col("sid"))
    columns = ("slot", "sid", "rank", "n_blocks")
    return ranked.select(*columns).unionByName(rest.select(*columns)).select("slot", "sid", (F.col("rank") % F.col("n_blocks")).alias("block"), F.expr("rank div n_blocks").alias("pass"))


def pieces(mix: Mix) -> DataFrame:
    """(uid, sid, block, at, words): the part of each document in each block of its source."""
    b = F.col("block_words")
    spans = mix.rows.where("size > 0").select("uid", "sid", "size", "before", b, F.explode(F.sequence(F.expr("before div block_words"), F.expr("(before + size - 1) div block_words"))).alias("block"))
    start, end = F.greatest(F.col("block") * b, F.col("before")), F.least((F.col("block") + 1) * b, F.col("before") + F.col("size"))
    return spans.select("uid", "sid", "block", (start - F.col("before")).alias("at"), (end - start).alias("words"))


def taken(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    times = mix.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    sums = pieces(mix).join(times, ["sid", "block"]).groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = mix.rows.select("uid", "doc_id", "size", "sid").join(sums, "uid", "left")
    rows = _with_source(rows, mix.sources.select("sid", "source_size", "target"), "sid", mix.n_sources)
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def slices(mix: Mix) -> DataFrame:
    """uid, pass, at, words: what each pass takes of a document. It is one run of words, as a pass takes blocks in order."""
    joined = pieces(mix).join(mix.slots, ["sid", "block"])
    return joined.groupBy("uid", "pass").agg(F.min("at").alias("at"), F.sum("words").alias("words"))


def mixed_rows(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row of docs for each pass that takes it, with its columns; a part of a text has the words taken, as they stand.

    A column n_chars, where there is one, follows the text.
    """
    ws = Workspace(spark, "mixed")
    # The columns of docs stay in one, so that they clash with none of ours.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    kept = ws.table(docs.select(whole, F.monotonically_increasing_id().alias("row")), "docs")
    own = lambda c: F.col("whole")[c]
    mix = plan(spark, kept.select("row", own(text_col).alias("text"), own(source_col).alias("source")), weights, most, block_words, "row", "text", "source")
    runs = slices(mix).join(mix.rows.select("uid", F.col("doc_id").alias("row"), "size"), "uid")
    rows = kept.join(runs.select("row", "size", F.col("at").cast("int").alias("at"), F.col("words").cast("int").alias("words")), "row")
    spaces = r"[\x20\x09-\x0D]"
    # Words with the spaces after them.
    part = F.array_join(F.slice(F.split(F.ltrim(own(text_col), F.lit(SPACES)), f"(?<={spaces})(?!{spaces})"), F.col("at") + 1, F.col("words")), "")
    rows = rows.withColumn("taken", F.when((F.col("at") == 0) & (F.col("words") == F.col("size")), own(text_col)).otherwise(part))
    new = {text_col: F.col("taken"), "n_chars": F.length("taken").cast("long")}
    return rows.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
