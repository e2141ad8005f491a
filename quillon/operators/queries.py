"""Search queries as rows: raw text in, words, phrase and filters out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Up to so many rows a small table is held in the plan itself; up to so many bytes it is broadcast.
FEW_ROWS, FEW_BYTES = 10_000, 32 << 20


#: Spark's own switch (4.1): a job's shuffle files go when it ends, not when the driver's garbage is collected. Older versions don't know it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying, _lock = {}, Lock()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside leave no shuffle files behind. The session's own setting comes back after the last of several threads."""
    key = id(spark._jsparkSession)
    with _lock:
        n, was = _tidying.get(key) or (0, spark.conf.get(CLEANUP, None))
        _tidying[key] = (n + 1, was)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, was = _tidying.pop(key)
            if n > 1:
                _tidying[key] = (n - 1, was)
            elif was is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, was)


def held(df: DataFrame, most: int = FEW_ROWS) -> tuple[DataFrame, list[Row] | None]:
    """(the same rows, the rows themselves): computed now and once if they are few, as a relation of known size that joins broadcast.

    A larger table is left as it is, with None.
    """
    with tidy(df.sparkSession):
        rows = df.take(most + 1)
    if len(rows) > most:
        return df, None
    return F.broadcast(local(df.sparkSession, rows, df.schema)), rows


def local(spark, rows: list[Row], schema) -> DataFrame:
    """Rows as part of the plan. They go by Arrow, as Spark then knows their size and needs no job to read them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = lambda x: {k: plain(v) for k, v in x.asDict().items()} if isinstance(x, Row) else [plain(v) for v in x] if isinstance(x, list) else x
    kind = to_arrow_schema(schema)
    columns = [pa.array([plain(r[i]) for r in rows], f.type) for i, f in enumerate(kind)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kind), schema)


def attach(rows: DataFrame, table: DataFrame, few: list[Row] | None, columns: list[str]) -> DataFrame:
    """rows with columns that a table has for their query_id. Those of a single query are literals, others are joined."""
    if few is None or len(few) != 1:
        return rows.join(table.select("query_id", *columns), "query_id")
    return rows.withColumns({c: F.lit(few[0][c]).cast(table.schema[c].dataType) for c in columns})


def observed(seen: Observation, otherwise: Callable[[], dict]) -> dict:
    """What was counted on the way. A plan that turns out to be empty loses its counters; then it is counted as such."""
    try:
        return seen.get
    except Py4JJavaError:
        return otherwise()


def small(df: DataFrame) -> DataFrame:
    """With a hint to broadcast it if its size allows that."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= FEW_BYTES else df


def parse(queries: DataFrame) -> DataFrame:
    """queries(query_id, raw, page, limit) with rest, filetype, query, quoted, words, content_words, phrase, phrase_query, page, limit."""
    q = queries.withColumn("typed", T.file_type(F.col("raw")))
    q = q.select("query_id", "raw", T.page_number(F.col("page")).alias("page"), T.page_limit(F.col("limit")).alias("limit"), F.col("typed.filetype").alias("filetype"), F.lower(T.normalise_query(F.col("typed.rest"))).alias("query"))
    q = q.withColumn("quoted", T.quoted_part(F.col("query")))
    q = q.withColumn("words", T.name_tokens(F.col("query")))
    phrase = F.when(F.coalesce(F.col("quoted"), F.lit("")) != "", T.name_tokens(F.col("quoted"))).otherwise(F.col("words"))
    q = q.withColumn("phrase_words", phrase)
    return q.select("*", F.filter("words", lambda w: F.length(w) > 1).alias("content_words"), F.array_join("phrase_words", " ").alias("phrase"), (F.size("phrase_words") >= 2).alias("phrase_query"), (F.coalesce(F.col("quoted"), F.lit("")) != "").alias("is_quoted"))
