"""Query words against the vocabulary: exact, prefix and numeric-substring matches, each by an equi join."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DIGIT, is_number
from ..schemas import struct
from .index import Index
from .queries import local

#: Bounds and factors of the match weights.
PREFIX_LEAST, PREFIX_MOST, NUMERIC_FACTOR, NUMERIC_LEAST, NUMERIC_MOST = 0.25, 0.90, 0.70, 0.20, 0.65


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, pos, word: the content words of parsed queries, repeats kept."""
    return queries.select("query_id", F.posexplode("content_words").alias("pos", "word"))


def _ratio() -> Column:
    return F.length("word").cast("double") / F.length("term")


def prefix_weight() -> Column:
    return F.greatest(F.lit(PREFIX_LEAST), F.least(F.lit(PREFIX_MOST), _ratio()))


def numeric_weight() -> Column:
    return F.greatest(F.lit(NUMERIC_LEAST), F.least(F.lit(NUMERIC_MOST), F.lit(NUMERIC_FACTOR) * _ratio()))


def exact(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return words.join(vocabulary, words["word"] == vocabulary["term"]).withColumn("kind", F.lit(0)).withColumn("weight", F.lit(1.0))


def prefix(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words of three characters or more that a longer term starts with. The first three characters are the join key."""
    left = words.where(F.length("word") >= 3).withColumn("head", F.left("word", F.lit(3)))
    right = vocabulary.withColumn("head", F.left("term", F.lit(3)))
    found = left.join(right, "head").where((F.col("term") != F.col("word")) & F.col("term").startswith(F.col("word"))).drop("head")
    return found.withColumn("kind", F.lit(1)).withColumn("weight", prefix_weight())


def numeric(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Numbers of two digits or more inside a term, not at its start. A term's distinct pairs of digits are the join key."""
    left = words.where(is_number(F.col("word")) & (F.length("word") >= 2)).withColumn("pair", F.left("word", F.lit(2)))
    pairs = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substring("term", i, F.lit(2))), lambda p: p.rlike(f"^{DIGIT}{{2}}$")))
    right = vocabulary.where(F.col("term").rlike(f"{DIGIT}{{2}}")).withColumn("pair", F.explode(pairs))
    found = left.join(right, "pair").where(F.col("term").contains(F.col("word")) & ~F.col("term").startswith(F.col("word"))).drop("pair")
    return found.withColumn("kind", F.lit(2)).withColumn("weight", numeric_weight())


def matches(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, pos, word, term, df, kind, weight: the three kinds exclude each other, so each (word, term) has one weight."""
    return _three(words, vocabulary)


def _three(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    columns = ["query_id", "pos", "word", "term", "df", "kind", "weight"]
    return exact(words, vocabulary).select(columns).unionByName(prefix(words, vocabulary).select(columns)).unionByName(numeric(words, vocabulary).select(columns))


def phrase_terms(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, pos, term, need: for each word of a phrase the terms that can stand there, and how many words have such.

    Between two spaces of a body stands a whole token, so the inner words of a phrase are terms of the document, the
    first word ends one and the last word begins one. Words of one character are no terms and say nothing.
    """
    words = queries.select("query_id", F.size("phrase_words").alias("n"), F.size(F.filter("phrase_words", lambda w: F.length(w) > 1)).alias("need"), F.posexplode("phrase_words").alias("pos", "word")).where(F.length("word") > 1)
    words = words.withColumn("side", F.when(F.col("pos") == 0, 0).when(F.col("pos") == F.col("n") - 1, 2).otherwise(1))
    columns = ["query_id", "pos", "need", "term"]
    vocabulary = index.vocabulary()
    by_two = lambda side, cut: words.where(f"side = {side}").withColumn("two", cut("word", F.lit(2))).join(vocabulary.select("term", cut("term", F.lit(2)).alias("two")), "two")
    out = words.where("side = 1").join(vocabulary, F.col("word") == F.col("term")).select(columns)
    out = out.unionByName(by_two(2, F.left).where(F.startswith("term", F.col("word"))).select(columns))
    return out.unionByName(by_two(0, F.right).where(F.endswith("term", F.col("word"))).select(columns))


#: Up to so many words are looked up in the ordered dictionaries by literals; more are joined with all of the vocabulary.
FEW_WORDS = 300
#: What a word is looked up for: content, or the inner, last or first place of a phrase.
CONTENT, INNER, LAST, FIRST = range(4)
WANTED = "query_id int, filetype string, n_docs long, use int, pos int, word string, need int, number boolean"


def wanted(rows: list[Row]) -> list[Row]:
    """The words of parsed queries and of their phrases, as rows of WANTED."""
    out = []
    for r in rows:
        out += [Row(r.query_id, r.filetype, r.n_docs, CONTENT, k, w, 0, w.isdigit() and len(w) >= 2) for k, w in enumerate(r.content_words)]
        if r.phrase_query:
            need, last = sum(len(w) > 1 for w in r.phrase_words), len(r.phrase_words) - 1
            out += [Row(r.query_id, r.filetype, r.n_docs, FIRST if k == 0 else LAST if k == last else INNER, k, w, need, False) for k, w in enumerate(r.phrase_words) if len(w) > 1]
    return out


def _any(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _of(words: list[Row], *uses: int) -> list[str]:
    return sorted({r[5] for r in words if r[3] in uses})


def _heads(words: list[Row]) -> list[str]:
    return sorted({r[5] for r in words if r[3] == LAST or r[3] == CONTENT and len(r[5]) >= 3})


def may_match(words: list[Row]) -> Column:
    """A condition on terms that all hold which `looked_up` finds for the words."""
    whole = F.col("term").isin(_of(words, CONTENT, INNER))
    ends = _any(F.col("term").endswith(w) for w in _of(words, FIRST))
    return whole | _any(F.col("term").startswith(h) for h in _heads(words)) | ends | _any(F.contains("term", F.lit(r[5])) for r in words if r[7])


def looked_up(words: list[Row], spark: SparkSession, index: Index) -> DataFrame:
    """The words in `words` (WANTED) with the terms that match them: term, df, kind, weight.

    The dictionary is ordered by terms, and once more by reversed terms, so that beginnings and endings are ranges of it; only
    numbers inside terms are looked for in all of its terms that have two digits side by side.
    """
    inside = F.col("with_digits") & _any(F.contains("term", F.lit(r[5])) for r in words if r[7])
    found = index.vocabulary(F.col("term").isin(_of(words, CONTENT, INNER)) | _any(F.col("term").startswith(h) for h in _heads(words)) | inside).withColumn("ending", F.lit(False))
    if _of(words, FIRST):
        found = found.unionByName(index.endings(_any(F.col("reversed").startswith(w[::-1]) for w in _of(words, FIRST))).withColumn("ending", F.lit(True)))
    w, starts = F.col("word"), F.startswith("term", F.col("word"))
    long = (F.length(w) >= 3) & starts
    content = (F.col("term") == w) | long | (F.col("number") & F.contains("term", w) & ~starts)
    fits = F.when(F.col("use") == CONTENT, content).when(F.col("use") == INNER, F.col("term") == w).when(F.col("use") == LAST, starts).otherwise(F.endswith("term", w))
    both = found.join(F.broadcast(local(spark, words, struct(WANTED))), (F.col("ending") == (F.col("use") == FIRST)) & fits)
    kind = F.when(F.col("term") == w, 0).when(long, 1).otherwise(2)
    weight = F.when(F.col("term") == w, 1.0).when(long, prefix_weight()).otherwise(numeric_weight())
    return both.withColumns({"kind": kind, "weight": weight}).drop("ending")
