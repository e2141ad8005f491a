"""Composed searches over an index."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators.index import FEW_VALUES, Index
from ..operators.rank import browse_matches, browse_ranked, browse_rows, paged, ranked, result_rows
from ..operators.score import Asked, ask, once, score
from ..operators.snippet import snippets


_kept: list[tuple[str, DataFrame]] = []


def _hold(rows: DataFrame) -> DataFrame:
    """Holds what the steps of a search read again on the executors, until the next search of this process releases it."""
    _kept.append((rows.sparkSession.sparkContext.applicationId, rows.persist(StorageLevel.MEMORY_AND_DISK)))
    return _kept[-1][1]


def _release(spark: SparkSession) -> None:
    while _kept:
        was, old = _kept.pop()
        if was == spark.sparkContext.applicationId:
            old.unpersist()


def rank_all(queries: DataFrame, index: Index) -> DataFrame:
    """All matching documents of raw queries (query_id, raw, page, limit), scored and ranked."""
    _release(queries.sparkSession)
    return ranked(score(ask(queries, index), index, _hold))


def _titled(rows: DataFrame, names: list[str] | None, index: Index) -> DataFrame:
    """rows with title and path of their documents."""
    return rows.join(index.documents_of(names).select("filename", "title", "path"), "filename")


def ranked_pages(asked: Asked, index: Index) -> DataFrame:
    """Response rows of the pages that worded queries ask for. Evidence is gathered once and held on the executors until the pages, a few rows, are known."""
    return result_rows(_titled(*_snipped(*pages_of(asked, index), index), index))


def _snipped(page: DataFrame, few: list | None, index: Index) -> tuple[DataFrame, list[str] | None]:
    return snippets(page, index), None if few is None or len(few) > FEW_VALUES else sorted({r.filename for r in few})


def pages_of(asked: Asked, index: Index) -> tuple[DataFrame, list | None]:
    """The scored rows of the pages that worded queries ask for, and the rows themselves where they are few. Queries that differ in their page only are scored once."""
    kept: list[DataFrame] = []
    queries, wants = once(asked)

    def keep(rows: DataFrame) -> DataFrame:
        kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    try:
        page, few = paged(score(queries, index, keep), one=asked.worded_rows[0] if asked.one is not None else None, wants=wants)
        if few is None:  # more than are held: they are still to be made from the evidence
            _release(page.sparkSession)
            _kept.extend((page.sparkSession.sparkContext.applicationId, rows) for rows in kept)
            kept.clear()
        return page, few
    finally:
        for rows in kept:
            rows.unpersist()


def search(queries: DataFrame, index: Index) -> DataFrame:
    """Response rows of each query's page. Pages are cut before snippets are made. Queries without words or type, and those without a match, have no rows."""
    asked = ask(queries, index)
    some = asked.worded_rows is None or bool(asked.worded_rows)
    browsing = asked.rows is None or any(not r.words and r.filetype for r in asked.rows)
    parts = [ranked_pages(asked, index)] if some or not browsing else []
    if browsing:
        parts.append(browse_rows(paged(browse_matches(asked, index), browse_ranked)[0]))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
