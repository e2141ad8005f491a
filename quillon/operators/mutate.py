"""Changes to an index: every operation gives new tables and leaves the old ones as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, name_tokens, stem
from ..sources.extract import sanitised
from .index import Index, build_index
from .queries import tidy


def remove(index: Index, names: DataFrame) -> Index:
    """Without the documents in names(filename); terms that no document has any more vanish with their postings."""
    gone = names.select("filename").distinct()
    return Index(*[t.join(gone, "filename", "left_anti").select(*t.columns) for t in (index.documents, index.pages, index.bodies)])


def upsert(index: Index, texts: DataFrame) -> Index:
    """With the documents in texts put in or replaced. Those without a token are refused and leave what is there."""
    new = build_index(texts)
    old = remove(index, new.documents)
    three = lambda i: (i.documents, i.pages, i.bodies)
    return Index(*[a.unionByName(b.select(*a.columns)) for a, b in zip(three(old), three(new), strict=True)])


def sanitised_upload(texts: DataFrame) -> DataFrame:
    """texts with safe file names; those of unsupported types go. Of a name that comes more than once the last doc_seq counts."""
    clean = texts.withColumn("filename", sanitised(F.col("filename"))).where("filename <> ''")
    # Only names are looked at to see whether one comes twice; texts are moved for that only where one does.
    with tidy(texts.sparkSession):
        if clean.groupBy("filename").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return clean
    return clean.withColumn("n", F.row_number().over(Window.partitionBy("filename").orderBy(F.col("doc_seq").desc()))).where("n = 1").drop("n")


def upload_status(texts: DataFrame) -> DataFrame:
    """filename, status, reason for each document of an upload; filename is the safe name, or the given one if it is rejected."""
    words = F.size(content_tokens(F.col("text"))) > 0
    clean = texts.select("filename", "text", sanitised(F.col("filename")).alias("clean"))
    named = F.coalesce(F.col("clean"), F.lit("")) != ""
    status = F.when(named & words, "indexed").when(named, "failed").otherwise("rejected")
    return clean.select(F.when(named, F.col("clean")).otherwise(F.col("filename")).alias("filename"), status.alias("status"), F.when(~named, "unsupported name").when(~words, "no readable text").alias("reason"))


def delete_status(index: Index, asked: DataFrame) -> DataFrame:
    """filename, status of each distinct name asked for: deleted or not_found. Paths count by their last part."""
    names = asked.select(F.regexp_extract("filename", r"([^/]*)$", 1).alias("filename")).where("filename <> ''").distinct()
    known = index.documents.select("filename", F.lit(True).alias("known"))
    return names.join(known, "filename", "left").select("filename", F.when(F.col("known"), "deleted").otherwise("not_found").alias("status"))


def repaired_filename_terms(stored: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, report): stored(filename, position, term) made to agree with the tokenizer, without orphans; what was wrong by document.

    Stored sequences that are right stay, with positions from 0. report: filename, problem (rewritten or orphan).
    """
    held = stored.groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("held"))
    right = documents.select("filename", name_tokens(stem(F.col("filename"))).alias("right"))
    both = held.join(right, "filename", "full")
    same = F.coalesce("held", F.array().cast("array<string>")).eqNullSafe(F.col("right"))
    report = both.select("filename", F.when(F.col("right").isNull(), "orphan").when(~same, "rewritten").alias("problem")).where("problem IS NOT NULL")
    terms = both.where("right IS NOT NULL").select("filename", F.posexplode(F.when(same, F.col("held")).otherwise(F.col("right"))).alias("position", "term"))
    return terms, report


def repair_summary(report: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, rewritten, orphans."""
    counts = report.agg(F.count_if(F.col("problem") == "rewritten").alias("rewritten"), F.count_if(F.col("problem") == "orphan").alias("orphans"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(counts))


def recent_searches(searches: DataFrame, most: int = 8) -> DataFrame:
    """query, ts of each user's last searches, case ignored. searches: user_id, query, ts, id for ties."""
    text = F.lower(F.trim("query"))
    last = searches.where(text != "").withColumn("low", text).withColumn("n", F.row_number().over(Window.partitionBy("user_id", "low").orderBy(F.col("ts").desc(), F.col("id").desc()))).where("n = 1")
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("id").desc())))
    return ranked.where(F.col("rank") <= most).select("user_id", "rank", "query", "ts")


def suggestions(history: DataFrame, typed: str, most: int = 5) -> DataFrame:
    """Recent searches that hold what is typed, without it itself; all of them for blank input. history: rank, query."""
    low = typed.strip().lower()
    found = history.where(F.contains(F.lower("query"), F.lit(low)) & (F.lower(F.trim("query")) != low)) if low else history
    return found.orderBy("rank").limit(most)
