"""Scores of (query, document) pairs and the final relevance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions.text import is_number, occurrences
from ..schemas import struct
from .index import FEW_VALUES, Index
from .match import CONTENT, FEW_WORDS, looked_up, matches, may_match, phrase_terms, query_words, wanted
from .queries import attach, held, local, observed, parse, small, tidy

#: Fixed values: (filename, content, phrase, lexical) weights by kind of query.
WEIGHTS = {"quoted with filename hit": (0.80, 0.05, 0.15, 0.0), "quoted": (0.05, 0.15, 0.80, 0.0), "filename hit": (0.75, 0.15, 0.10, 0.0), "other": (0.05, 0.60, 0.20, 0.15)}
#: What a term that matches a word gives to each document that has it. place: where the word stands in its query, the kind of match, and what it tells (SAME, STARTS or NUMBER), as one number.
HIT = "struct<place:int,idf:double,weight:double>"
SAME, STARTS, NUMBER = range(3)
#: Up to so many terms that match words are broadcast to the postings.
FEW_TERMS = 200_000
#: Up to so many phrases are looked for in all bodies where many documents may hold them; more are joined.
FEW_PHRASES = 64


@dataclass
class Asked:
    """Parsed queries: all of them, their rows where they are few, and those that have words."""

    parsed: DataFrame
    rows: list[Row] | None
    worded: DataFrame
    worded_rows: list[Row] | None

    @property
    def one(self) -> int | None:
        """The number of the only query with words, if there is but one."""
        return self.worded_rows[0].query_id if self.worded_rows is not None and len(self.worded_rows) == 1 else None

    def attach(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        return attach(rows, self.worded, self.worded_rows, columns)


def ask(queries: DataFrame, index: Index) -> Asked:
    """queries(query_id, raw, page, limit), parsed. Those with words get n_docs, the documents of the type that they ask for; without any they go."""
    parsed, rows = held(parse(queries))
    types = index.types()
    if rows is None:
        allowed = F.col("filetype").isNull() | (F.col("filetype") == F.col("ext"))
        sizes = types.join(small(parsed.select("query_id", "filetype")), allowed).groupBy("query_id").agg(F.sum("n").alias("n_docs"))
        return Asked(parsed, None, parsed.where(F.size("words") > 0).join(sizes, "query_id"), None)
    counts = index.type_counts()
    sized = [(r, counts.get(r.filetype, 0) if r.filetype is not None else sum(counts.values())) for r in rows if r.words]
    sized = [Row(**r.asDict(), n_docs=n) for r, n in sized if n > 0]
    kind = parsed.select("*", F.lit(0).cast("long").alias("n_docs")).schema
    return Asked(parsed, rows, F.broadcast(local(parsed.sparkSession, sized, kind)), sized)


def once(asked: Asked) -> tuple[Asked, list[Row] | None]:
    """(the same without queries that differ from another one only in the page they ask for, which page each query wants of which of them); None if there are too many to tell."""
    if asked.worded_rows is None:
        return asked, None
    first: dict[tuple, Row] = {}
    for r in sorted(asked.worded_rows, key=lambda r: r.query_id):
        first.setdefault((r.query, r.filetype), r)
    wants = [Row(query_id=first[r.query, r.filetype].query_id, own=r.query_id, page=r.page, limit=r.limit) for r in asked.worded_rows]
    if len(first) == len(wants):
        return asked, wants
    rows = list(first.values())
    return Asked(asked.parsed, asked.rows, F.broadcast(local(asked.parsed.sparkSession, rows, asked.worded.schema)), rows), wants


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def found_terms(asked: Asked, index: Index) -> tuple[DataFrame, list[Row] | None]:
    """(query_id, filetype, term, need, phrase_pos, hit): the terms that the words of queries match, and those that a phrase needs (phrase_pos not null, no hit)."""
    words = None if asked.worded_rows is None else wanted(asked.worded_rows)
    tells = F.when(F.col("term") == F.col("word"), SAME).when(is_number(F.col("word")) & F.contains("term", F.col("word")), NUMBER).otherwise(STARTS)
    hit = F.struct((F.col("pos") * 16 + F.col("kind") * 4 + tells).alias("place"), idf(F.col("n_docs"), F.col("df")).alias("idf"), "weight").cast(HIT)
    if words is not None and len(words) <= FEW_WORDS:
        own = looked_up(words, asked.parsed.sparkSession, index)
        content = F.col("use") == CONTENT
        return held(own.select("query_id", "filetype", "term", "need", F.when(~content, F.col("pos")).alias("phrase_pos"), F.when(content, hit).alias("hit")))
    own = matches(query_words(asked.worded), index.vocabulary()).join(asked.worded.select("query_id", "n_docs", "filetype"), "query_id")
    own = own.select("query_id", "filetype", "term", F.lit(0).alias("need"), F.lit(None).cast("int").alias("phrase_pos"), hit.alias("hit"))
    phrases = asked.worded.where("phrase_query")
    terms = phrase_terms(phrases, index).join(phrases.select("query_id", "filetype"), "query_id")
    return held(own.unionByName(terms.select("query_id", "filetype", "term", "need", F.col("pos").alias("phrase_pos"), F.lit(None).cast(HIT).alias("hit"))))


#: What is brought together by document: no more than numbers and the name, as there is a row for each matching posting.
EVIDENCE = ["query_id", "filename", "doc_seq", "place", "part", "weight", "phrase_pos", "filename_words", "occ"]
#: Those that only some kinds of evidence have.
NONE = {"place": "int", "part": "double", "weight": "double", "phrase_pos": "int", "filename_words": "array<string>", "occ": "int"}


def _evidence(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as EVIDENCE; columns: those of NONE that they have."""
    return rows.select("query_id", "filename", "doc_seq", *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in NONE.items()])


def term_evidence(asked: Asked, index: Index) -> DataFrame:
    """One row for each (query, word or place in a phrase, term, document of the query's type). Only the folders and row groups of the terms are read."""
    found, rows = found_terms(asked, index)
    found = found.select("term", "query_id", "filetype", "phrase_pos", "hit")
    if rows is not None:
        postings = index.postings_of(sorted({r.term for r in rows}))
    else:
        # More terms than the plan holds: postings that no word can match stay out of the join, and the terms go to the postings, not these to the terms.
        words = None if asked.worded_rows is None else wanted(asked.worded_rows)
        postings = index.postings_of(None, may_match(words) if words is not None and len(words) <= FEW_WORDS else None)
        with tidy(found.sparkSession):
            found = F.broadcast(found) if found.count() <= FEW_TERMS else found
    both = postings.join(found, "term").where("filetype IS NULL OR filetype = ext")
    part = F.col("term_count").cast("double") / F.col("total_words") * F.col("hit.idf") * F.col("hit.weight")
    return _evidence(both, place=F.col("hit.place"), part=part, weight=F.col("hit.weight"), phrase_pos=F.col("phrase_pos"))


def _near() -> Column:
    name = F.array_join("filename_words", " ")
    return F.arrays_overlap("filename_words", "words") | F.contains(name, F.col("joined")) | ((F.col("phrase") != "") & F.contains(name, F.col("phrase")))


def _grams(text: str) -> list[str]:
    return [f"g:{text[i : i + 3]}" for i in range(len(text) - 2)]


def name_evidence(asked: Asked, index: Index) -> DataFrame:
    """The documents whose name shares a word with a query, or holds its words or its phrase as a whole.

    Words are keys of the index of names. A text inside a name is looked up by the rarest of its runs of three characters, then
    compared; texts of one or two characters, which have no such run, are looked for in all names.
    """
    asks = asked.worded.select("query_id", "filetype", "words", "phrase", F.array_join("words", " ").alias("joined"))
    short = asks.where("length(joined) < 3 OR (phrase <> '' AND length(phrase) < 3)")
    if asked.worded_rows is None:
        gram = lambda c: F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.concat(F.lit("g:"), F.substring(F.col(c), i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
        keys = asks.select("query_id", F.explode(F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("t:"), w)), gram("phrase"), gram("joined")))).alias("key"))
        names, some_short = index.names_of(None), True
    else:
        rows = asked.worded_rows
        texts = {r.query_id: {t for t in (r.phrase, " ".join(r.words)) if len(t) >= 3} for r in rows}
        wanted = sorted({g for own in texts.values() for t in own for g in _grams(t)})
        df = {r.key: r.df for r in index.name_keys(F.col("key").isin(wanted)).collect()} if wanted else {}
        pairs = {(r.query_id, f"t:{w}") for r in rows for w in r.words}
        pairs |= {(i, min(_grams(t), key=lambda g: (df[g], g))) for i, own in texts.items() for t in own if all(g in df for g in _grams(t))}
        keys = F.broadcast(local(asks.sparkSession, [Row(*p) for p in sorted(pairs, key=str)], asks.select("query_id", F.lit("").alias("key")).schema))
        names, some_short = index.names_of(sorted({k for _, k in pairs})), any(len(" ".join(r.words)) < 3 or 0 < len(r.phrase) < 3 for r in rows)
    near = names.withColumn("query_id", F.lit(asked.one)) if asked.one is not None else names.join(keys, "key")
    near = asked.attach(near, ["filetype", "words", "phrase"]).withColumn("joined", F.array_join("words", " "))
    named = lambda rows: _evidence(rows, filename_words=F.col("filename_words"))
    near = named(near.where(_near() & F.expr("filetype IS NULL OR filetype = ext")))
    if some_short:
        every = index.documents.select("filename", "filename_words", "ext", "doc_seq")
        near = near.unionByName(named(every.join(short, _near() & F.expr("filetype IS NULL OR filetype = ext"))))
    return near


def silent_evidence(asked: Asked, index: Index) -> DataFrame | None:
    """Phrases of one-character words only have no terms: they are looked for in all bodies."""
    if asked.worded_rows is not None and not any(r.phrase_query and max(map(len, r.phrase_words)) < 2 for r in asked.worded_rows):
        return None
    silent = asked.worded.where("phrase_query AND NOT exists(phrase_words, w -> length(w) > 1)").select("query_id", "filetype", "phrase")
    found = index.bodies.join(silent, F.contains("body", F.col("phrase"))).select("query_id", "filetype", "filename", occurrences(F.col("body"), F.col("phrase")).alias("occ"))
    found = found.join(index.documents.select("filename", "ext", "doc_seq"), "filename").where("filetype IS NULL OR filetype = ext")
    return _evidence(found, occ=F.col("occ"))


def evidence(asked: Asked, index: Index) -> DataFrame:
    """One row for each (query, document) with anything in common: what its hits come to (content_parts), filename_words (null where the name has nothing), occ of silent phrases, and whether its terms allow the phrase.

    Rows are dealt as they are, before anything is collected: what aggregates keep of a row is several times as large.
    """
    both = term_evidence(asked, index).select(EVIDENCE).unionByName(name_evidence(asked, index).select(EVIDENCE))
    silent = silent_evidence(asked, index)
    if silent is not None:
        both = both.unionByName(silent.select(EVIDENCE))
    rows = both.repartition("query_id", "filename").groupBy("query_id", "filename").agg(
        F.first("doc_seq").alias("doc_seq"), F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "part", "weight")))).alias("hits"),
        F.size(F.collect_set("phrase_pos")).alias("places"), F.first("filename_words", ignorenulls=True).alias("filename_words"), F.coalesce(F.max("occ"), F.lit(0)).alias("occ"),
    )
    rows = asked.attach(rows, ["content_words", "phrase_words"])
    need = F.size(F.filter("phrase_words", lambda w: F.length(w) > 1))
    return rows.withColumns({"may_hold": F.col("places") >= F.greatest(F.lit(1), need), **content_parts()}).drop("hits", "places", "content_words", "phrase_words")


def phrase_counts(asked: Asked, index: Index, rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, list[Row] | None] | None:
    """query_id, filename, phrase_occurrences of the phrases in the bodies of those rows of `evidence` that may hold them; None without phrases. keep: holds them, so that bodies are gone through once."""
    if asked.worded_rows is not None and not any(r.phrase_query for r in asked.worded_rows):
        return None
    may = asked.attach(rows.where("may_hold").select("query_id", "filename"), ["phrase_query", "phrase"]).where("phrase_query").drop("phrase_query")
    may, few = held(may)
    phrases = [r for r in asked.worded_rows or () if r.phrase_query]
    if few is None and 0 < len(phrases) <= FEW_PHRASES:  # names of many documents meet what was found, so that no body is moved
        each = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), F.lit(r.phrase).alias("phrase")) for r in phrases])
        inside = index.bodies.select("filename", F.inline(F.transform(F.filter(each, lambda q: F.contains("body", q["phrase"])), lambda q: F.struct(q["query_id"].alias("query_id"), occurrences(F.col("body"), q["phrase"]).alias("phrase_occurrences")))))
        return held(keep(inside.select("query_id", "filename", "phrase_occurrences").join(may.select("query_id", "filename"), ["query_id", "filename"], "left_semi")))
    names = None if few is None or len(few) > FEW_VALUES else sorted({r.filename for r in few})
    if names is not None and asked.one is not None:
        body = asked.attach(index.bodies_of(names).withColumn("query_id", F.lit(asked.one)), ["phrase"])
    else:
        body = index.bodies_of(names).join(may if few is not None else small(may), "filename")
    found = body.where(F.contains("body", F.col("phrase"))).select("query_id", "filename", occurrences(F.col("body"), F.col("phrase")).alias("phrase_occurrences"))
    return held(found if few is not None else keep(found))


def with_queries(rows: DataFrame, asked: Asked, counts: tuple[DataFrame, list[Row] | None] | None) -> DataFrame:
    """Rows of `evidence` with phrase_occurrences and what their queries ask."""
    rows = rows.withColumn("filename_words", F.coalesce("filename_words", F.array().cast("array<string>")))
    rows = asked.attach(rows, ["words", "phrase", "phrase_query", "is_quoted", "filetype", "page", "limit", "phrase_words"])
    if counts is None or counts[1] == []:
        return rows.withColumn("phrase_occurrences", F.col("occ")).drop("occ", "may_hold")
    return rows.join(counts[0], ["query_id", "filename"], "left").withColumn("phrase_occurrences", F.coalesce("phrase_occurrences", "occ")).drop("occ", "may_hold")


def content_parts() -> dict[str, Column]:
    """content_score and the lexical signals from the hits, in the order of words, kinds and parts, and content_words."""
    tells = lambda h: h["place"] % 4
    best = lambda what: F.coalesce(F.array_max(F.transform(F.filter("hits", lambda h: tells(h) == what), lambda h: h["weight"])), F.lit(0.0))
    return {
        "content_score": F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["part"]),
        "exact_content_match": F.exists("hits", lambda h: tells(h) == SAME),
        "numeric_similarity": best(NUMBER),
        "prefix_similarity": best(STARTS),
        "content_matches": F.array_distinct(F.transform("hits", lambda h: F.get("content_words", F.shiftright(h["place"], 4)))),
    }


def filename_parts() -> dict[str, Column]:
    """filename_score, filename_matches and filename_relevance from words, filename_words."""
    words, name = F.col("words"), F.array_join("filename_words", " ")
    joined = F.array_join("words", " ")
    plain = F.filter("words", lambda w: ~is_number(w))
    related = F.arrays_overlap(plain, F.col("filename_words"))
    counted = F.filter(words, lambda w: F.array_contains("filename_words", w) & (~is_number(w) | (F.size(plain) == 0) | related))
    inside = (F.size(words) >= 2) & F.contains(name, joined)
    base = F.when(joined == name, 100.0).when(inside, 50.0).otherwise(0.0)
    present = F.size(F.filter(words, lambda w: F.array_contains("filename_words", w)))
    cover = present.cast("double") / F.size(words)
    return {
        "filename_score": base + F.size(counted) * F.lit(20.0),
        "filename_matches": F.array_distinct(counted),
        "filename_relevance": F.when(joined == name, 1.0).when(inside, 0.95).otherwise(F.lit(0.75) * cover),
    }


def phrase_parts() -> dict[str, Column]:
    """phrase_score and phrase_match from the phrase, its occurrences and the name."""
    n = F.col("phrase_occurrences")
    by_count = F.when(n <= 1, 50.0).otherwise(F.least(F.lit(100.0), F.lit(50.0) + F.lit(50.0) * F.least(F.log(n.cast("double")) / F.log(F.lit(25.0)), F.lit(1.0))))
    in_name = (F.col("phrase") != "") & F.contains(F.array_join("filename_words", " "), F.col("phrase"))
    start = F.when(F.col("is_quoted") & in_name, 30.0).otherwise(0.0)
    whole = F.when(F.col("phrase_query") & (n > 0), F.greatest(start, by_count)).otherwise(start)
    return {
        "phrase_score": whole + F.when(F.col("phrase_query") & in_name, 100.0).otherwise(0.0),
        "phrase_match": (F.col("is_quoted") & in_name) | (F.col("phrase_query") & ((n > 0) | in_name)),
    }


def scored_parts(rows: DataFrame) -> DataFrame:
    """Rows of `with_queries` with all scores but the final one; those that a quoted query doesn't allow go."""
    return rows.withColumns(filename_parts()).withColumns(phrase_parts()).where("phrase_match OR NOT is_quoted")


def best_of(rows: DataFrame, one: int | None) -> tuple[DataFrame, list[Row] | None]:
    """query_id, max_content, filename_hit, by partial aggregates; a window would bring all rows of a query into one task. one: the only query there is."""
    most = F.max("content_score").alias("max_content"), F.max(F.col("filename_score") > 0).alias("filename_hit")
    if one is None:
        return held(rows.groupBy("query_id").agg(*most))
    # The maxima of a single query are taken on the way, without a shuffle.
    seen = Observation()
    with tidy(rows.sparkSession):
        rows.select("content_score", "filename_score").observe(seen, *most).write.format("noop").mode("overwrite").save()
    best = observed(seen, lambda: rows.agg(*most).first().asDict())
    got = [Row(query_id=one, **best)] if best["max_content"] is not None else []
    return local(rows.sparkSession, got, struct("query_id int, max_content double, filename_hit boolean")), got


def final(rows: DataFrame, best: tuple[DataFrame, list[Row] | None]) -> DataFrame:
    """Scored rows with `final_score`; without those that match nothing."""
    rows = attach(rows, best[0] if best[1] is not None else small(best[0]), best[1], ["max_content", "filename_hit"])
    lexical = F.when(F.col("exact_content_match"), 1.0).when(F.col("prefix_similarity") > 0, 0.70 + 0.30 * F.col("prefix_similarity")).when(F.col("numeric_similarity") > 0, 0.30 + 0.40 * F.col("numeric_similarity")).otherwise(0.0)
    rows = rows.withColumns({
        "lexical_match_relevance": lexical,
        "content_relevance": F.when(F.col("max_content") > 0, F.col("content_score") / F.col("max_content")).otherwise(0.0),
        "phrase_relevance": F.least(F.col("phrase_score") / 100.0, F.lit(1.0)),
    })
    part = lambda k: F.when(F.col("is_quoted") & F.col("filename_hit"), WEIGHTS["quoted with filename hit"][k]).when(F.col("is_quoted"), WEIGHTS["quoted"][k]).when(F.col("filename_hit"), WEIGHTS["filename hit"][k]).otherwise(WEIGHTS["other"][k])
    whole = part(0) * F.col("filename_relevance") + part(1) * F.col("content_relevance") + part(2) * F.col("phrase_relevance") + part(3) * F.col("lexical_match_relevance")
    some = (F.col("filename_score") > 0) | (F.col("content_score") != 0) | (F.col("phrase_score") > 0)
    return rows.withColumn("final_score", whole).where(some & (F.col("final_score") > 0))


def score(asked: Asked, index: Index, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Every matching (query, document) with all scores and `final_score`. keep: holds the evidence, and what was found of phrases, for the steps that read it, e.g. in memory."""
    rows = keep(evidence(asked, index))
    parts = scored_parts(with_queries(rows, asked, phrase_counts(asked, index, rows, keep)))
    return final(parts, best_of(parts, asked.one))
