"""Helpers that the training-data operators share: written intermediate tables, word rules and distributed running totals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the output contracts: a word is a run of characters other than these six.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the one in spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder
    that goes when Python ends, and a cluster uses the warehouse folder, which is shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        if spark.sparkContext.master.startswith("local"):
            _roots[app] = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, _roots[app], True)
        else:
            _roots[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return _roots[app]


#: Rows of a batch that goes to Python, where the session doesn't set it: 10,000 whole texts, Spark's own value, can pass Arrow's 2 GB.
BATCH_ROWS = 500
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


class Workspace:
    """Tables and files of one operator call, under the shared folder.

    `table` writes a DataFrame as Parquet and reads it again: that cuts the lineage, and a lost executor
    costs a reread only. `drop` deletes what no later step needs.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy", **options: str | int) -> DataFrame:
        df.write.mode("overwrite").options(compression=compression, **options).parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def word_count(text: Column) -> Column:
    """Words of a text, without building them: each word and the spaces after it become one character. Null counts 0."""
    short = F.regexp_replace(F.ltrim(text, F.lit(SPACES)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.coalesce(F.length(short), F.lit(0)).cast("long")


def running_total(ws: Workspace, df: DataFrame, name: str, groups: list[str], order: list[str], value: str, per_part: int = 200_000) -> DataFrame:
    """df with `before`: the sum of `value` over the rows of the same groups that come earlier in `order`.

    No task gets a whole group: rows are dealt by ranges of (groups, order), each range is summed, the few
    range sums give the offsets, and a window runs inside one range of one group only. `order` must tell
    rows apart, so that a frequent key is cut like any other.
    """
    n = df.count()
    dealt = df.repartitionByRange(-(-n // per_part), *groups, *order) if n > per_part else df.coalesce(1)
    dealt = ws.table(dealt.withColumn("part", F.spark_partition_id()), name)
    at = Window.partitionBy(*groups).orderBy("part")
    sums = dealt.groupBy(*groups, "part").agg(F.sum(value).alias("in_part"))
    sums = sums.withColumn("offset_", F.sum("in_part").over(at) - F.col("in_part")).drop("in_part")
    inside = Window.partitionBy("part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own_", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    if groups:
        joined = many_to_one(own, sums, [*groups, "part"])
    else:
        joined = own.join(sums.hint("shuffle_hash"), "part")
    return joined.select(*df.columns, (F.col("own_") + F.col("offset_")).alias("before"))


def many_to_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Null-safe join of many rows to the one row of their key, without all rows of a frequent key in one task.

    The rows of `many` carry one of `salts` numbers, each row of `one` comes once with every number.
    Columns: those of `many`, then those of `one` that are no key.
    """
    # A map can't be hashed; any other columns tell rows of the same key apart.
    others = [F.col(f"`{c}`") for c, kind in many.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
    left = many.withColumn("salt_", F.pmod(F.xxhash64(*others or [F.lit(0)]), F.lit(salts)).cast("int"))
    right = one.withColumn("salt_", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    right = right.select(*[F.col(c).alias(f"{c}_right") for c in keys], F.col("salt_").alias("salt_right"), *[c for c in one.columns if c not in keys])
    at = (left["salt_"] == right["salt_right"])
    for c in keys:
        at = at & left[c].eqNullSafe(right[f"{c}_right"])
    # A merge join: copies for the salts make `one` larger than the estimate that a broadcast would be chosen by.
    return left.join(right.hint("merge"), at, how).drop("salt_", "salt_right", *[f"{c}_right" for c in keys])
