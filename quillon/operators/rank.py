"""Ranking, pages of results and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.text import url_quote
from ..schemas import struct
from .index import Index
from .queries import attach, held, local, observed, small
from .score import Asked


def ranked(scored: DataFrame, most: int | None = None) -> DataFrame:
    """With `rank` from 1: by final score to nine places, ties by document order. most: ranks beyond it are left out, in each task first."""
    # Sums of the same parts in another order differ in the last places; they are to be ties.
    rows = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("final_score", 9).desc(), "doc_seq")))
    return rows.where(F.col("rank") <= most) if most is not None else rows


def browse_matches(asked: Asked, index: Index) -> DataFrame:
    """The documents of the file type of queries that name nothing else."""
    only = asked.parsed.where((F.size("words") == 0) & F.col("filetype").isNotNull()).select("query_id", "filetype", "page", "limit")
    docs = index.documents.drop("terms")
    if asked.rows is not None:
        docs = docs.where(F.col("ext").isin(sorted({r.filetype for r in asked.rows if not r.words and r.filetype})))
    return docs.join(only, F.col("ext") == F.col("filetype"))


def browse_ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.lower("title"), "doc_seq")))
    return rows.where(F.col("rank") <= most) if most is not None else rows


def _bounds(totals: DataFrame) -> DataFrame:
    """query_id and the pagination, from query_id, page, limit, total: page is held within the pages there are."""
    whole = totals.withColumn("total_pages", F.ceil(F.col("total") / F.col("limit")).cast("int"))
    whole = whole.withColumn("page", F.least("page", "total_pages"))
    start, end = (F.col("page") - 1) * F.col("limit") + 1, F.least(F.col("page") * F.col("limit"), F.col("total"))
    return whole.withColumns({"start": start, "end": end.cast("int"), "has_next": F.col("page") < F.col("total_pages"), "has_previous": F.col("page") > 1})


#: What an order looks at, besides query_id.
SEEN = {ranked: ["final_score", "doc_seq"], browse_ranked: ["title", "doc_seq"]}
WANTS = "query_id int, own int, page int, limit int"


def paged(rows: DataFrame, order=ranked, one: Row | None = None, wants: list[Row] | None = None) -> tuple[DataFrame, list[Row] | None]:
    """The rows of each query's page of what `order` ranks, with the pagination, held if they are few. one: the only query there is. wants: WANTS, the pages wanted of rows that several queries share.

    Each task needs to keep only as many rows as the furthest page reaches. The total of a single query is counted while its
    page is cut, and only a page beyond the last one is cut again; totals of several come first, by partial aggregates. What
    is ranked is no more than names and what the order looks at; the rows of the pages are taken by name then.
    """
    columns = ["page", "limit", "total", "total_pages", "start", "end", "has_next", "has_previous"]
    if one is not None:
        seen, want = Observation(), one.page * one.limit
        top = order(rows.drop("page", "limit").observe(seen, F.count(F.lit(1)).alias("total")), want).where(F.col("rank") > want - one.limit)
        table, few = held(top)
        total = observed(seen, lambda: {"total": rows.count()})["total"]
        bounds = local(rows.sparkSession, [Row(one.query_id, one.page, one.limit, total)] if total else [], struct("query_id int, page int, limit int, total int"))
        bounds, known = held(_bounds(bounds))
        if total and want - one.limit >= total:
            table, few = held(order(rows.drop("page", "limit"), total).where(F.col("rank").between(known[0].start, known[0].end)))
        return held(attach(table, bounds, known, columns))
    if wants is None:
        totals = rows.groupBy("query_id", "page", "limit").agg(F.count("*").cast("int").alias("total")).withColumn("own", F.col("query_id"))
    else:
        asks = F.broadcast(local(rows.sparkSession, wants, struct(WANTS)))
        totals = rows.groupBy("query_id").agg(F.count("*").cast("int").alias("total")).join(asks, "query_id")
    bounds, known = held(_bounds(totals))
    last = max([r.end for r in known], default=0) if known is not None else bounds.agg(F.max("end")).first()[0]
    narrow = order(rows.select("query_id", "filename", *SEEN[order]), last).select("query_id", "filename", "doc_seq", "rank")
    found, few = held(narrow.join(bounds if known is not None else small(bounds), "query_id").where(F.col("rank").between(F.col("start"), F.col("end"))))
    whole = rows.drop("page", "limit").join(found if few is not None else small(found), ["query_id", "filename", "doc_seq"])
    return held(whole.withColumn("query_id", F.col("own")).drop("own"))


def page_strip(page: Column, total_pages: Column) -> Column:
    """The page numbers that a reader is offered, as text: all of up to seven; else the first, the last and those around this one, with `...` for gaps."""
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    start, end = F.greatest(F.lit(2), page - 1), F.least(total_pages - 1, page + 1)
    gap, none = F.array(F.lit("...")), F.array().cast("array<string>")
    around = F.when(start <= end, text(F.sequence(start, F.greatest(start, end)))).otherwise(none)
    some = F.concat(F.array(F.lit("1")), F.when(start > 2, gap).otherwise(none), around, F.when(end < total_pages - 1, gap).otherwise(none), F.array(total_pages.cast("string")))
    return F.when(total_pages <= 1, none).when(total_pages <= 7, text(F.sequence(F.lit(1), F.greatest(total_pages, F.lit(1))))).otherwise(some)


def match_type() -> Column:
    """Names the signals of a scored row."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    name, content = some(F.col("filename_matches")), some(F.col("content_matches"))
    return (
        F.when(F.col("phrase_match") & name, "Filename + Phrase").when(F.col("phrase_match"), "Phrase Match")
        .when(name & content, "Filename + Content").when(name, "Filename Match").otherwise("Content Match")
    )


def document_url(filename: Column) -> Column:
    return F.concat(F.lit("/api/documents/"), url_quote(filename))


def result_rows(page: DataFrame) -> DataFrame:
    """The response rows of scored documents with their snippets (columns snippet, snippet_page, highlights)."""
    url = document_url(F.col("filename"))
    page_url = F.when(F.col("snippet_page").isNotNull(), F.concat(url, F.lit("#page="), F.col("snippet_page").cast("string"))).otherwise(url)
    four = lambda c: F.round(c, 4).alias(c)
    return page.select(
        "query_id", "rank", "title", "path", url.alias("document_url"), page_url.alias("page_url"), "snippet", F.col("snippet_page").alias("page"), "highlights", "phrase_occurrences",
        four("filename_score"), four("content_score"), "exact_content_match", four("prefix_similarity"), four("numeric_similarity"), four("lexical_match_relevance"), four("phrase_score"),
        F.round("final_score", 4).alias("score"), match_type().alias("match_type"), "filetype", F.lit("Ranked Result").alias("tag"), page_url.alias("open_url"),
        F.struct("page", "limit", "total", "total_pages", "start", "end", "has_next", "has_previous").alias("pagination"),
    )


def browse_rows(page: DataFrame) -> DataFrame:
    """The response rows of a browse by type, in the same columns; those without meaning here are null."""
    url = document_url(F.col("filename"))
    kind = F.upper("filetype")
    zero, none = F.lit(0.0), lambda t: F.lit(None).cast(t)
    return page.select(
        "query_id", "rank", "title", "path", url.alias("document_url"), url.alias("page_url"), F.concat(F.lit("Filtered by file type: "), kind).alias("snippet"), none("int").alias("page"), F.array().cast("array<struct<start:int,end:int>>").alias("highlights"), F.lit(0).alias("phrase_occurrences"),
        zero.alias("filename_score"), zero.alias("content_score"), none("boolean").alias("exact_content_match"), none("double").alias("prefix_similarity"), none("double").alias("numeric_similarity"), none("double").alias("lexical_match_relevance"), zero.alias("phrase_score"),
        F.lit(1.0).alias("score"), F.concat(F.lit("File Type: "), kind).alias("match_type"), "filetype", F.lit("Filtered Result").alias("tag"), url.alias("open_url"),
        F.struct("page", "limit", "total", "total_pages", "start", "end", "has_next", "has_previous").alias("pagination"),
    )
