"""Snippets and highlights, for the few rows of a result page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from .index import FEW_VALUES, Index
from .queries import held, local

WINDOW = 140
HIGHLIGHTS = "array<struct<start:int,end:int>>"


def _starts(parts: Column, n: Column) -> Column:
    """Where the literal of n characters stands (from 0) that a text was split by, in one pass over the parts."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + n).cast("int").alias("at"), F.concat(a["all"], F.array((a["at"] + F.length(p)).cast("int"))).alias("all"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), zero, step, lambda a: a["all"])


def window_text(t: Column, pos: Column, length: Column, window: int = WINDOW) -> Column:
    """The text around a match, cut at spaces, with dots where something is left out."""
    start, end = F.greatest(F.lit(0), pos - window), F.least(F.length(t), pos + length + window)
    cut = F.trim(F.substring(t, start + 1, end - start))
    left = F.when(start > 0, F.concat(F.lit("... "), F.regexp_replace(cut, "^[^ ]* ", ""))).otherwise(cut)
    return F.when(end < F.length(t), F.concat(F.regexp_replace(left, "(?s)^(.*) [^ ]*$", "$1"), F.lit(" ..."))).otherwise(left)


def _texts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows(key, filename, snippet_words) with each of their pages: its number, t, low, and the words ws."""
    words = F.array_distinct(F.transform("snippet_words", lambda w: F.lower(w)))
    here = pages.join(rows.select("key", "filename", words.alias("ws")), "filename").withColumn("t", collapse(F.col("text")))
    return here.select("key", "page_number", "t", F.lower("t").alias("low"), "ws", F.array_join("ws", " ").alias("phrase"))


def _each(here: DataFrame) -> DataFrame:
    return here.select("*", F.posexplode("ws").alias("word_at", "w")).where("w <> '' AND contains(low, w)")


#: A possible place of a snippet: kind, order, and the text around it, cut where the page is read, with what to highlight.
PLACE = ["key", "page_number", "kind", "better", "word_at", "pos", "found", "mark"]


def _placed(found: DataFrame) -> DataFrame:
    return found.withColumn("found", window_text(F.col("t"), F.col("pos"), F.col("len"))).select(PLACE)


def sure_places(here: DataFrame) -> DataFrame:
    """Places of kind 1, the words as a phrase, 2, a word on its own, and 3, a word that starts a longer one."""
    one = here.where(F.size("ws") >= 2).withColumn("pos", F.expr("locate(phrase, low) - 1")).where("pos >= 0")
    one = one.withColumns({"kind": F.lit(1), "better": F.lit(0.0), "word_at": F.lit(0), "len": F.length("phrase"), "mark": F.col("phrase")})
    literal, each = r"concat('(?<![a-z0-9])\\Q', w, '\\E", _each(here)
    two = each.withColumn("pos", F.expr(f"regexp_instr(low, {literal}(?![a-z0-9])')) - 1")).where("pos >= 0")
    two = two.withColumns({"kind": F.lit(2), "better": F.lit(0.0), "len": F.length("w"), "mark": F.col("w")})
    three = each.where("length(w) >= 3").withColumn("longer", F.expr(f"regexp_extract(low, {literal}[a-z0-9]+'), 0)")).where("longer <> ''")
    three = three.withColumns({"kind": F.lit(3), "better": F.length("w").cast("double") / F.length("longer"), "pos": F.expr(f"regexp_instr(low, {literal}[a-z0-9]+')) - 1"), "len": F.length("longer"), "mark": F.col("w")})
    return _placed(one).unionByName(_placed(two)).unionByName(_placed(three))


def loose_places(here: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places of kind 4: of each word and page the place with the most different words around it, the first of equal ones."""
    starts = _starts(F.split("low", F.concat(F.lit(r"\Q"), F.col("w"), F.lit(r"\E"))), F.length("w"))
    begin = lambda pos: F.greatest(F.lit(0), pos - window)
    near = lambda pos: F.size(F.filter("ws", lambda x: F.contains(F.substring(F.col("low"), begin(pos) + 1, pos + window - begin(pos)), x)))
    four = _each(here).withColumn("top", F.array_max(F.transform(starts, lambda pos: F.struct(near(pos).alias("near"), (-pos).alias("back")))))
    return _placed(four.withColumns({"kind": F.lit(4), "better": F.col("top.near") * 1000.0 + F.length("w"), "pos": -F.col("top.back"), "len": F.length("w"), "mark": F.col("phrase")}))


def best(found: DataFrame) -> DataFrame:
    """The first place by kind; among one kind the better one, then the earlier page, word and place."""
    order = Window.partitionBy("key").orderBy("kind", F.col("better").desc(), "page_number", "word_at", "pos")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").select("key", F.col("page_number").alias("found_page"), "found", "mark")


def highlights(snippet: Column, mark: Column) -> Column:
    """Non-overlapping places of mark in snippet as merged ranges; touching ranges become one."""
    parts = F.split(F.lower(snippet), F.concat(F.lit(r"\Q"), F.lower(mark), F.lit(r"\E")))
    n = F.length(mark)
    begins = _starts(parts, n)
    empty = F.array().cast(HIGHLIGHTS)
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, b: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), (b + n).cast("int").alias("end"))))
    fold = lambda a, b: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= b), longer(a, b)).otherwise(F.concat(a, F.array(F.struct(b.cast("int").alias("start"), (b + n).cast("int").alias("end")))))
    return F.when(n > 0, F.aggregate(begins, empty, fold)).otherwise(empty)


def _chosen(keyed: DataFrame, rows: list[Row] | None, index: Index) -> DataFrame:
    """The best place of each row, from the pages of these rows' documents; the last kind is looked for only where the others found nothing."""
    if rows is None:
        here = _texts(keyed, index.pages)
        return best(sure_places(here).unionByName(loose_places(here)))
    names = lambda some: None if len(some) > FEW_VALUES else sorted({r.filename for r in some})
    sure, found = held(best(sure_places(_texts(keyed, index.pages_of(names(rows))))))
    left = {r.key for r in rows} - {r.key for r in found or ()}
    if not left:
        return sure
    open_ = [r for r in rows if r.key in left]
    some = F.broadcast(local(keyed.sparkSession, open_, keyed.schema))
    return sure.unionByName(held(best(loose_places(_texts(some, index.pages_of(names(open_))))))[0])


def snippets(rows: DataFrame, index: Index) -> DataFrame:
    """rows with snippet, snippet_page, highlights. rows: scored, those of result pages. Only the pages of their documents are read, and only the text around a place leaves its task."""
    words = F.when(F.col("phrase_match"), F.col("phrase_words")).otherwise(F.col("content_matches"))
    has_content = F.size(F.coalesce("content_matches", F.array().cast("array<string>"))) > 0
    keyed = rows.withColumn("key", F.concat_ws("|", F.col("query_id").cast("string"), "filename")).withColumn("snippet_words", words)
    asked, few = held(keyed.where(has_content).select("key", "filename", "snippet_words"))
    chosen = _chosen(asked, few, index)
    chosen = chosen.withColumn("marks", highlights(F.col("found"), F.col("mark")))
    joined = keyed.join(chosen, "key", "left")
    by_name = F.concat(F.lit("Filename matched: "), F.array_join("filename_matches", ", "))
    return joined.withColumns({
        "snippet": F.when(~has_content, by_name).otherwise(F.coalesce("found", F.lit("No matching text found."))),
        "snippet_page": F.when(has_content, F.col("found_page")),
        "highlights": F.coalesce("marks", F.array().cast(HIGHLIGHTS)),
    }).drop("key", "found", "found_page", "marks", "mark")
