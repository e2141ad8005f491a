"""The registered queries and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as T
from ..operators import match, mutate, rank, score
from ..operators.index import Index, bucket, build_index, counters
from ..operators.queries import parse
from ..sources.corpus import texts, texts_of
from ..sources.extract import sanitised
from ..sources.snapshot import load_json, one_object, write_json
from ..sources.store import PASSES, Store, empty_index
from . import oracle as O
from .search import pages_of, rank_all, search

#: (id, raw query, page, limit)
ALL = [
    (1, "the tion 555", "1", "10"), (2, "55", "1", "10"), (3, '"of the"', "1", "10"), (4, '"module"', "1", "10"), (5, "en src1 module 1", "1", "10"), (6, "pdf", "1", "10"),
    (7, ".docx", "2", "500"), (8, "the pdf", "1", "10"), (9, "pdf the", "1", "10"), (10, '"en src1 module 1.docx"', "1", "10"), (11, "the the", "2", "7"), (12, "", "1", "10"),
    (13, '""', "1", "10"), (14, "!!!", "1", "10"), (15, "der und txt module", "999", "abc"), (16, "  The  THIS.docx ", "x", "0"), (17, "rc1 modul", "1", "10"), (18, "estion 12", "1", "50"),
]
FLAGSHIP = [(1, "the tion 555", "1", "10")]


def pick(*ids: int) -> list[tuple]:
    return [q for q in ALL if q[0] in ids]


def asked(spark: SparkSession, queries: list[tuple]) -> DataFrame:
    return spark.createDataFrame(queries, "query_id int, raw string, page string, limit string")


_indexes: dict[tuple[str, str], Store] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The corpus as a stored index, one for each session and folder, as all searches share it."""
    return _base(spark, sf_dir).load()


def _base(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        store = Store(spark, f"{_shared(spark)}/index-{uuid.uuid4().hex}")
        store.publish(build_index(texts(spark, sf_dir)))
        _indexes[key] = store
    return _indexes[key]


def six(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _ranked(queries: list[tuple], columns):
    """A query over all ranked rows. columns: makes the columns; they need a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = rank_all(asked(spark, queries), index(spark, sf_dir))
        return rows.select("query_id", "filename", *columns())

    return run


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Text functions
register("tokenize_content", lambda s, d: doc(s, d).select("doc_id", F.posexplode(T.content_tokens(F.col("text"))).alias("position", "term")),
         f"SELECT doc_id, (unnest(range(len(t))))::INT AS position, unnest(t) AS term FROM (SELECT doc_id, {O.content('text')} AS t FROM documents)")
register("tokenize_filename", lambda s, d: texts(s, d).select(F.col("doc_seq").alias("doc_id"), F.array_join(T.name_tokens(T.stem(F.col("filename"))), " ").alias("words"), T.extension(F.col("filename")).alias("ext")),
         f"WITH {O.CORPUS} SELECT doc_id, array_to_string(fwords, ' ') AS words, ext FROM named")
def _raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw query from each part's name, in one of the forms that people write them in, and those of ALL."""
    k, name = F.col("p_partkey") % 10, F.col("p_name")
    raw = (
        F.when(k == 0, name).when(k == 1, F.concat(F.lit(' "'), F.upper(name), F.lit('" '))).when(k == 2, F.concat(name, F.lit(".PDF"))).when(k == 3, F.concat(F.lit('"'), name, F.lit('.docx"'))).when(k == 4, F.concat(F.lit("txt  "), name, F.lit(" pdf")))
        .when(k == 5, F.concat(name, F.lit("\t.txt"))).when(k == 6, F.concat(F.lit('"" '), name)).when(k == 7, F.concat(F.lit('"'), name)).when(k == 8, F.concat(name, F.lit("_v2.1!"))).otherwise(F.concat(F.lit('" '), name, F.lit(' .pdf "')))
    )
    made = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") + 100).cast("int").alias("query_id"), raw.alias("raw"), (F.col("p_size") - 3).cast("string").alias("page"), F.concat("p_size", F.when(k == 9, "x").otherwise("")).alias("limit"))
    return made.unionByName(asked(spark, ALL))


RAW_SQL = O.values(ALL).replace("q(query_id, raw, page, lim)", "q0(query_id, raw, page, lim)") + """, q(query_id, raw, page, lim) AS (SELECT * FROM q0 UNION ALL SELECT (p_partkey + 100)::INT, CASE p_partkey % 10 WHEN 0 THEN p_name WHEN 1 THEN ' "' || upper(p_name) || '" ' WHEN 2 THEN p_name || '.PDF' WHEN 3 THEN '"' || p_name || '.docx"' WHEN 4 THEN 'txt  ' || p_name || ' pdf'
  WHEN 5 THEN p_name || chr(9) || '.txt' WHEN 6 THEN '"" ' || p_name WHEN 7 THEN '"' || p_name WHEN 8 THEN p_name || '_v2.1!' ELSE '" ' || p_name || ' .pdf "' END, (p_size - 3)::VARCHAR, p_size || CASE WHEN p_partkey % 10 = 9 THEN 'x' ELSE '' END FROM part)"""
register("parse_query", lambda s, d: parse(_raw_queries(s, d)).select("query_id", "filetype", "query", "quoted", F.array_join("words", " ").alias("words"), "phrase", "phrase_query", "page", "limit"),
         f"WITH {RAW_SQL},{O.parsed()} SELECT query_id, filetype, query, quoted, array_to_string(words, ' ') AS words, phrase, phrase_query, page_no AS page, limit_no AS \"limit\" FROM qq")
register("whitespace_collapse", lambda s, d: doc(s, d).select("doc_id", F.md5(T.collapse(F.col("text")).cast("binary")).alias("digest"), F.length(T.collapse(F.col("text"))).alias("n")),
         f"SELECT doc_id, md5(t) AS digest, length(t)::INT AS n FROM (SELECT doc_id, {O.collapse('text')} AS t FROM documents)")
register("url_quote", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.url_quote(F.col("url")).alias("quoted")), "SELECT page_id, url_encode(url) AS quoted FROM pages")
register("phrase_occurrences", lambda s, d: (lambda i, q: score.phrase_counts(q, i, score.evidence(q, i))[0])(index(s, d), score.ask(asked(s, pick(1, 3, 11, 18)), index(s, d))), O.search(pick(1, 3, 11, 18), "SELECT query_id, filename, occ AS phrase_occurrences FROM ph JOIN meta USING (doc_id)"))

# Index
register("documents_meta", lambda s, d: index(s, d).documents.select("filename", "title", "path", "total_words", "page_count", "ext", "doc_seq"),
         f"WITH {O.CORPUS}, pc AS (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY doc_id) SELECT filename, filename AS title, '/data/' || filename AS path, total_words::INT AS total_words, coalesce(n, 0)::INT AS page_count, ext, doc_id AS doc_seq FROM meta LEFT JOIN pc USING (doc_id)")
register("term_postings", lambda s, d: index(s, d).postings, f"WITH {O.CORPUS} SELECT term, filename, term_count::INT AS term_count FROM postings JOIN meta USING (doc_id)")
register("filename_terms", lambda s, d: index(s, d).filename_terms(), f"WITH {O.CORPUS} SELECT filename, unnest(range(len(fwords)))::INT AS position, unnest(fwords) AS term FROM meta")
register("pages_index", lambda s, d: index(s, d).pages, f"WITH {O.CORPUS} SELECT filename, page_number::INT AS page_number, text FROM pages_")
register("vocab_df", lambda s, d: index(s, d).vocabulary(), f"WITH {O.CORPUS} SELECT term, df FROM vocab")
register("corpus_counts", lambda s, d: counters(index(s, d)),
         f"WITH {O.CORPUS} SELECT (SELECT count(*) FROM meta) AS documents, (SELECT count(*) FROM vocab) AS content_terms, (SELECT count(*) FROM meta) AS filenames_indexed, (SELECT count(DISTINCT doc_id) FROM pages_) AS page_text_entries")
register("document_names", lambda s, d: index(s, d).documents.select("filename").orderBy("filename"), f"WITH {O.CORPUS} SELECT filename FROM meta ORDER BY filename")

# Matches
WORDS = pick(1, 2, 8, 11, 18)


def _matched(kind: int | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = score.ask(asked(spark, WORDS), index(spark, sf_dir))
        found = match.looked_up(match.wanted(q.worded_rows), spark, index(spark, sf_dir)).where(F.col("use") == match.CONTENT)
        return (found if kind is None else found.where(F.col("kind") == kind)).select("query_id", "pos", "word", "term", "df", "kind", six("weight"))

    return run


for name, kind in (("match_exact", 0), ("match_prefix", 1), ("match_numeric_substring", 2), ("match_best_weight", None)):
    register(name, _matched(kind), f"WITH {O.values(WORDS)},{O.CORPUS},{O.parsed()},{O.MATCH} SELECT query_id, pos::INT AS pos, word, term, df, kind, round(weight, 6) AS weight FROM hit" + ("" if kind is None else f" WHERE kind = {kind}"))

# Scores
SCORED = pick(1, 2, 3, 4, 5, 8, 9, 10, 11, 15, 16, 17, 18)


def _idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    n = i.documents.agg(F.count("*").alias("n"))
    return i.vocabulary().crossJoin(F.broadcast(n)).select("term", F.round(score.idf(F.col("n"), F.col("df")), 6).alias("idf"))


register("idf", _idf, f"WITH {O.CORPUS} SELECT term, round(ln(((SELECT count(*) FROM meta) + 1)::DOUBLE / (df + 1)) + 1, 6) AS idf FROM vocab")
register("content_score", lambda s, d: score.evidence(score.ask(asked(s, SCORED), index(s, d)), index(s, d)).where(F.size("content_matches") > 0).select("query_id", "filename", six("content_score"), "exact_content_match", six("prefix_similarity"), six("numeric_similarity")),
         O.search(SCORED, "SELECT query_id, filename, round(content_score, 6) AS content_score, exact_ AS exact_content_match, round(pre_, 6) AS prefix_similarity, round(num_, 6) AS numeric_similarity FROM cs JOIN meta USING (doc_id)"))
for name, columns, sql in (
    ("lexical_relevance", lambda: [six("lexical_match_relevance")], "round(lexical, 6) AS lexical_match_relevance"),
    ("filename_score", lambda: [six("filename_score"), F.array_join("filename_matches", " ").alias("filename_matches")], "filename_score, array_to_string(list_filter(counted, lambda x, i: list_position(counted, x) = i), ' ') AS filename_matches"),
    ("filename_relevance", lambda: [six("filename_relevance")], "round(filename_relevance, 6) AS filename_relevance"),
    ("phrase_score", lambda: ["phrase_occurrences", six("phrase_score"), "phrase_match"], "occ AS phrase_occurrences, round(phrase_score, 6) AS phrase_score, phrase_match"),
):
    register(name, _ranked(SCORED, columns), O.search(SCORED, f"SELECT query_id, filename, {sql} FROM res"))

# Searches
for name, queries in {"search_content": FLAGSHIP, "search_filename": pick(5, 17), "search_quoted": pick(3, 4, 10), "search_filtered": pick(8, 9, 15, 16), "search_batch": ALL}.items():
    register(name, _ranked(queries, lambda: [F.round("final_score", 6).alias("final_score"), "rank"]), O.search(queries, "SELECT query_id, filename, round(final_score, 6) AS final_score, rank::INT AS rank FROM res"))
register("match_type", _ranked(SCORED, lambda: [rank.match_type().alias("match_type")]),
         O.search(SCORED, "SELECT query_id, filename, CASE WHEN len(counted) > 0 AND phrase_match THEN 'Filename + Phrase' WHEN phrase_match THEN 'Phrase Match' WHEN len(counted) > 0 AND content_score <> 0 THEN 'Filename + Content' WHEN len(counted) > 0 THEN 'Filename Match' ELSE 'Content Match' END AS match_type FROM res"))
PAGED = "page", "limit", "total", "total_pages", "start", "end", "has_next", "has_previous"
PAGE_SQL = O.PAGES + """
SELECT query_id, filename, rank::INT AS rank, pno AS page, limit_no AS "limit", total::INT AS total, total_pages, (pno - 1) * limit_no + 1 AS start, least(pno * limit_no, total)::INT AS "end", pno < total_pages AS has_next, pno > 1 AS has_previous
FROM pr"""
register("search_paginated", lambda s, d: pages_of(score.ask(asked(s, ALL), index(s, d)), index(s, d))[0].select("query_id", "filename", "rank", *PAGED), O.search(ALL, PAGE_SQL.format("res")))
BROWSED = pick(6, 7, 8, 14)
register("browse_filetype", lambda s, d: rank.paged(rank.browse_matches(score.ask(asked(s, BROWSED), index(s, d)), index(s, d)), rank.browse_ranked)[0].select("query_id", "filename", "rank", *PAGED),
         f"WITH {O.values(BROWSED)},{O.CORPUS},{O.parsed()}, {O.BROWSE}" + PAGE_SQL.format("br"))

# Snippets
SNIPPED = pick(1, 3, 8, 11, 18)


RESULT = ("query_id", "rank", "title", "snippet", "page", "highlights", "match_type", "score", "page_url")
FULL = (*RESULT, "path", "document_url", "phrase_occurrences", "filename_score", "content_score", "exact_content_match", "prefix_similarity", "numeric_similarity", "lexical_match_relevance", "phrase_score", "filetype", "tag", "open_url", "page_no", "total", "total_pages")


def _results(queries: list[tuple], columns: tuple):
    """Response rows: ranked ones with their snippets and browses by type."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = search(asked(spark, queries), index(spark, sf_dir)).withColumn("highlights", F.to_json("highlights"))
        return rows.withColumns({f"{c}_no" if c == "page" else c: F.col(f"pagination.{c}") for c in ("page", "total", "total_pages")}).select(*columns)

    return run


register("search_results", _results(SNIPPED, RESULT), O.results(SNIPPED, ", ".join(RESULT)))
RANKED = [q for q in ALL if q[0] not in (6, 7)]
register("result_rows", _results(RANKED, FULL), O.results(RANKED, ", ".join(FULL)))
register("browse_rows", _results(pick(6, 7), FULL), O.browse_results(pick(6, 7), ", ".join(FULL)))


# Changes
def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("doc_seq"))
    return index(spark, sf_dir).documents.join(bad, "doc_seq").select("filename")


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = mutate.remove(index(spark, sf_dir), _toxic(spark, sf_dir))
    return left.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("term_count").alias("total"))


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose number is a benchmark item's get that item as their text; two items become new files."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("new_text"))
    old = texts(spark, sf_dir).join(b, F.col("doc_seq") == F.col("item_id")).select("filename", "path", F.col("new_text").alias("text"), "doc_seq")
    new = b.where("item_id < 2").select(F.concat(F.lit("new_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit("/data/new").alias("path"), F.col("new_text").alias("text"), (F.col("item_id") + 10**9).alias("doc_seq"))
    both = old.unionByName(new)
    return both.withColumn("page_texts", F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text"))))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = mutate.upsert(index(spark, sf_dir), _revised(spark, sf_dir))
    return now.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("term_count").alias("total"))


def _asked_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).where("doc_seq < 10").select(F.concat(F.lit("../x/"), "filename").alias("filename"))
    return docs.unionByName(spark.createDataFrame([("missing.pdf",), ("missing.pdf",), ("",)], "filename string"))


def _broken_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, documents): every fifth document lacks its second token, another fifth has its tokens in reverse, one document is gone."""
    i = index(spark, sf_dir)
    named = i.filename_terms().join(i.documents.select("filename", "doc_seq"), "filename")
    stored = named.where("NOT (position = 1 AND doc_seq % 5 = 0)").select("filename", F.expr("CASE WHEN doc_seq % 5 = 1 THEN 99 - position ELSE position END").alias("position"), "term")
    return stored.unionByName(spark.createDataFrame([("gone.pdf", 0, "gone")], "filename string, position int, term string")), i.documents


def _digests(i: Index) -> DataFrame:
    """One row for each document with digests of all that the index has of it."""
    counts = F.transform("terms", lambda t: F.concat(t["term"], F.lit(":"), t["term_count"].cast("string")))
    docs = i.documents.select("filename", "title", "path", "total_words", "page_count", "ext", F.array_join("filename_words", " ").alias("words"), F.md5(F.array_join(counts, ",").cast("binary")).alias("terms"))
    lines = F.transform("page_list", lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), p["text"]))
    pages = i.lists().select("filename", F.md5(F.array_join(lines, "\n").cast("binary")).alias("pages"))
    bodies = i.bodies.select("filename", F.md5(F.col("body").cast("binary")).alias("body"))
    return docs.join(pages, "filename", "left").join(bodies, "filename", "left")


DIGESTS_SQL = f"""tj AS (SELECT doc_id, md5(string_agg(term || ':' || term_count, ',' ORDER BY term)) AS terms FROM postings GROUP BY doc_id),
pj AS (SELECT doc_id, count(*) AS n, md5(string_agg(page_number || ':' || text, chr(10) ORDER BY page_number)) AS pages, md5({O.collapse("string_agg(text, ' ' ORDER BY page_number)")}) AS body FROM pages_ GROUP BY doc_id)
SELECT filename, filename AS title, '/data/' || filename AS path, total_words::INT AS total_words, coalesce(n, 0)::INT AS page_count, ext, array_to_string(fwords, ' ') AS words, terms, pages, body FROM meta LEFT JOIN tj USING (doc_id) LEFT JOIN pj USING (doc_id)"""


def _json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_shared(spark)}/json-{uuid.uuid4().hex}"
    write_json(index(spark, sf_dir), folder)
    return _digests(load_json(spark, folder))


def _json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot whose tables are one object each in one file; names and page texts come from what is current."""
    from ..sources.snapshot import load_json as load

    i, folder = index(spark, sf_dir), f"{_shared(spark)}/json-{uuid.uuid4().hex}"
    for name in ("inverted_index", "document_meta"):
        write_json(i, f"{folder}/lines", (name,))
        one_object(spark.read.text(f"{folder}/lines/{name}.json")).write.text(f"{folder}/{name}")
        store = Store(spark, folder)
        part = store._fs.globStatus(store._path(f"{folder}/{name}/part-*"))[0].getPath()
        store._fs.rename(part, store._path(f"{folder}/{name}.json"))
        store._fs.delete(store._path(f"{folder}/lines"), True)
    return _digests(load(spark, folder, i))


def _write_version_1(spark: SparkSession, sf_dir: str) -> Store:
    """A store as version 1 wrote it: one folder, documents without terms, postings by term without columns of their documents.

    It is made of the texts, without the index of this version; terms are counted once, and postings dealt out in passes.
    """
    i, store = build_index(texts(spark, sf_dir)), Store(spark, f"{_shared(spark)}/old-{uuid.uuid4().hex}")
    store._save(i.documents, "counted")
    counted = spark.read.schema(i.documents.schema).parquet(f"{store.root}/counted")
    store._save(counted.drop("terms"), "gen-1/documents")
    for k in range(PASSES):
        some = Index(counted, i.pages, i.bodies).postings.where(bucket(F.col("term"), PASSES) == k)
        store._save(some.repartition("term").sortWithinPartitions("term"), "gen-1/postings")
    store._fs.delete(store._path(f"{store.root}/counted"), True)
    store._save(i.pages, "gen-1/pages")
    spark.createDataFrame([('{"generation": 1, "folder": "gen-1"}',)], "value string").coalesce(1).write.text(f"{store.root}/m")
    part = store._fs.globStatus(store._path(f"{store.root}/m/part-*"))[0].getPath()
    store._fs.rename(part, store._manifest_path(1))
    return store


_folders: dict[str, str] = {}


def _shared(spark: SparkSession) -> str:
    """A folder that all executors see; only a local session may use a temporary one, which goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="quillon-index-")
        atexit.register(shutil.rmtree, _folders[app], True)
    return _folders[app]


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over a store of its own that begins with the whole corpus as its first generation."""
    root = f"{_shared(spark)}/engine-{uuid.uuid4().hex}"
    Store(spark, root).share(_base(spark, sf_dir))
    return Engine(spark, root)


def _engine_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine says of itself after documents were replaced and added."""
    e = _engine(spark, sf_dir)
    e.upsert(_revised(spark, sf_dir))
    now = e.status()
    columns = "state string, generation int, documents long, content_terms long, filenames_indexed long, page_text_entries long"
    return spark.createDataFrame([tuple(now[c.split()[0]] for c in columns.split(", "))], columns)


def _engine_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of a delete, each with the number of documents that the store has after it and whether it still has this one."""
    e = _engine(spark, sf_dir)
    names = [r.filename for r in _asked_to_delete(spark, sf_dir).collect()]
    done = e.delete(names)
    left = e.store.load().documents.select("filename", F.lit(True).alias("there"))
    return done.join(left, "filename", "left").select("filename", "status", F.coalesce("there", F.lit(False)).alias("there"), F.lit(e.store.count_documents()).cast("long").alias("documents"))


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is served when a file of the newest generation is damaged: the one before."""
    e = _engine(spark, sf_dir)
    number = e.store.remove(_toxic(spark, sf_dir))
    newest = e.store.manifest(number)["segments"][-1]
    part = e.store._fs.globStatus(e.store._path(f"{e.store.root}/{newest['folder']}/tombstones/part-*"))[0].getPath()
    e.store._fs.create(part, True).close()
    return _digests(Engine(spark, e.store.root).index)


def _emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine has and finds after all documents are deleted, and after they are put in again."""
    e, rows = _engine(spark, sf_dir), []
    names, again = e.index.documents.select("filename"), texts(spark, sf_dir)
    for step, change in (("deleted", lambda: e.store.remove(names)), ("again", lambda: e.upsert(again))):
        change()
        e = Engine(spark, e.store.root)
        now = e.status()
        rows.append((step, now["documents"], now["content_terms"], e.search("pdf").count(), e.search("the").count(), e.has_document("nobody.pdf")))
    return spark.createDataFrame(rows, "step string, documents long, content_terms long, browsed long, found long, nobody boolean")


def _new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose number is a benchmark item's, with that item's text."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("new"))
    return texts_of(doc(spark, sf_dir).join(b, F.col("doc_id") == F.col("item_id")).withColumn("text", F.col("new")))


def _changed(spark: SparkSession, sf_dir: str, compact: bool = False) -> Index:
    """The corpus after small changes, each a segment: new texts for some documents, toxic ones taken out, one put in again."""
    store = Store(spark, f"{_shared(spark)}/changed-{uuid.uuid4().hex}")
    store.share(_base(spark, sf_dir))
    store.upsert(build_index(_new_texts(spark, sf_dir)))
    store.remove(_toxic(spark, sf_dir))
    if compact:
        store.compact()
    return store.load()


CHANGED_DOCUMENTS = """documents AS (SELECT d.doc_id, coalesce(b.text, d.text) AS text, d.lang, d.source FROM main.documents d LEFT JOIN main.benchmark b ON b.item_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM main.labels WHERE toxic = 1))"""


#: A document that point lookups ask for, by number.
LOOKED_UP = 7


def _lookup(spark: SparkSession, sf_dir: str, what) -> DataFrame:
    name = texts(spark, sf_dir).where(F.col("doc_seq") == LOOKED_UP).first()
    return what(_engine(spark, sf_dir), name.filename if name else "")


#: For uploads: names that are cleaned or rejected, by the document's number modulo 6.
def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_seq") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("C:\\dir\\ "), "filename")).when(k == 1, F.concat(F.lit("../up/._"), "filename")).when(k == 2, F.concat(F.lit("Ünï ç  "), "filename"))
        .when(k == 3, F.concat("filename", F.lit(".exe"))).when(k == 4, F.concat(F.lit("a?b*"), F.upper("filename"))).otherwise(F.col("filename"))
    )
    return texts(spark, sf_dir).withColumn("filename", name)


UPLOADS_SQL = f"""{O.CORPUS}, up AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'C:\\dir\\ ' || filename WHEN 1 THEN '../up/._' || filename WHEN 2 THEN 'Ünï ç  ' || filename WHEN 3 THEN filename || '.exe' WHEN 4 THEN 'a?b*' || upper(filename) ELSE filename END AS given,
  CASE doc_id % 6 WHEN 0 THEN 'Cdir_' || filename WHEN 1 THEN filename WHEN 2 THEN 'Uni_c_' || filename WHEN 3 THEN '' WHEN 4 THEN 'ab' || upper(filename) ELSE filename END AS clean FROM named)"""


REVISED_SQL = f"""{O.CORPUS}, b AS (SELECT item_id AS k, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents) UNION ALL SELECT item_id + 1000000000, text FROM benchmark WHERE item_id < 2), bt AS (SELECT k, unnest({O.content('text')}) AS term FROM b),
bp AS (SELECT k AS doc_id, term, count(*) AS term_count FROM bt GROUP BY k, term), u AS (SELECT doc_id, term, term_count FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM bp) UNION ALL SELECT * FROM bp)"""
register("remove_documents", _removed, f"WITH {O.CORPUS} SELECT term, count(*) AS df, sum(term_count)::BIGINT AS total FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY term")
register("upsert_documents", _upserted,
         f"WITH {REVISED_SQL} SELECT term, count(*) AS df, sum(term_count)::BIGINT AS total FROM u GROUP BY term")
register("bulk_delete_status", lambda s, d: mutate.delete_status(index(s, d), _asked_to_delete(s, d)),
         f"WITH {O.CORPUS} SELECT n.filename, CASE WHEN m.doc_id IS NULL THEN 'not_found' ELSE 'deleted' END AS status FROM named n LEFT JOIN meta m USING (doc_id) WHERE n.doc_id < 10 UNION ALL SELECT 'missing.pdf', 'not_found'")
register("repair_filename_terms", lambda s, d: mutate.repaired_filename_terms(*_broken_names(s, d))[0], ORACLE_SQL["filename_terms"])
register("repair_report", lambda s, d: mutate.repaired_filename_terms(*_broken_names(s, d))[1], f"WITH {O.CORPUS} SELECT filename, 'rewritten' AS problem FROM meta WHERE doc_id % 5 IN (0, 1) UNION ALL SELECT 'gone.pdf', 'orphan'")
register("repair_summary", lambda s, d: (lambda b: mutate.repair_summary(mutate.repaired_filename_terms(*b)[1], b[1]))(_broken_names(s, d)), f"WITH {O.CORPUS} SELECT count(*) AS documents, count(*) FILTER (doc_id % 5 IN (0, 1)) AS rewritten, 1 AS orphans FROM meta")
register("rebuild_roundtrip", lambda s, d: _digests(index(s, d)), f"WITH {O.CORPUS}, {DIGESTS_SQL}")
register("segments_merged", lambda s, d: _digests(_changed(s, d)), f"WITH {CHANGED_DOCUMENTS}, {O.CORPUS}, {DIGESTS_SQL}")
register("segments_compacted", lambda s, d: _digests(_changed(s, d, compact=True)), ORACLE_SQL["segments_merged"])
register("segments_postings", lambda s, d: _changed(s, d).postings, f"WITH {CHANGED_DOCUMENTS}, {O.CORPUS} SELECT term, filename, term_count::INT AS term_count FROM postings JOIN meta USING (doc_id)")
register("segments_vocabulary", lambda s, d: _changed(s, d).vocabulary(), f"WITH {CHANGED_DOCUMENTS}, {O.CORPUS} SELECT term, df FROM vocab")
CHANGED_QUERIES = pick(1, 3, 8, 10, 17)
register("segments_search", lambda s, d: rank_all(asked(s, CHANGED_QUERIES), _changed(s, d)).select("query_id", "filename", F.round("final_score", 6).alias("final_score"), "rank"),
         O.search(CHANGED_QUERIES, "SELECT query_id, filename, round(final_score, 6) AS final_score, rank::INT AS rank FROM res").replace("WITH ", f"WITH {CHANGED_DOCUMENTS}, ", 1))
register("store_upgrade", lambda s, d: _digests(_write_version_1(s, d).load()), ORACLE_SQL["rebuild_roundtrip"])
register("engine_emptied", _emptied, f"WITH {O.CORPUS} SELECT 'deleted' AS step, 0 AS documents, 0 AS content_terms, 0 AS browsed, 0 AS found, false AS nobody UNION ALL SELECT 'again', (SELECT count(*) FROM meta), (SELECT count(*) FROM vocab), least(10, (SELECT count(*) FROM meta WHERE ext = 'pdf')), least(10, (SELECT count(DISTINCT doc_id) FROM postings WHERE starts_with(term, 'the'))), false")
register("engine_upsert", _engine_upserted, f"WITH {REVISED_SQL} SELECT 'READY' AS state, 2::INT AS generation, count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS content_terms, count(DISTINCT doc_id) AS filenames_indexed, count(DISTINCT doc_id) AS page_text_entries FROM u")
register("engine_delete", _engine_deleted,
         f"WITH {O.CORPUS} SELECT n.filename, CASE WHEN m.doc_id IS NULL THEN 'not_found' ELSE 'deleted' END AS status, false AS there, (SELECT count(*) FROM meta WHERE doc_id >= 10) AS documents FROM named n LEFT JOIN meta m USING (doc_id) WHERE n.doc_id < 10 UNION ALL SELECT 'missing.pdf', 'not_found', false, (SELECT count(*) FROM meta WHERE doc_id >= 10)")
register("engine_recovery", _recovered, ORACLE_SQL["rebuild_roundtrip"])
register("document_postings", lambda s, d: _lookup(s, d, lambda e, name: e.store.term_counts(name)), f"WITH {O.CORPUS} SELECT term, term_count::INT AS term_count FROM postings JOIN meta USING (doc_id) WHERE doc_id = {LOOKED_UP}")
register("stored_document", lambda s, d: _lookup(s, d, lambda e, name: e.get_document(name).select("filename", "path", "total_words", "ext", F.array_join("filename_words", " ").alias("words"))),
         f"WITH {O.CORPUS} SELECT filename, '/data/' || filename AS path, total_words::INT AS total_words, ext, array_to_string(fwords, ' ') AS words FROM meta WHERE doc_id = {LOOKED_UP}")
register("json_roundtrip", _json_roundtrip, ORACLE_SQL["rebuild_roundtrip"])
register("json_objects", _json_objects, ORACLE_SQL["rebuild_roundtrip"])
register("sanitize_filename", lambda s, d: _uploads(s, d).select("doc_seq", sanitised(F.col("filename")).alias("clean")), f"WITH {UPLOADS_SQL} SELECT doc_id AS doc_seq, clean FROM up")
register("upload_status", lambda s, d: mutate.upload_status(_uploads(s, d)),
         f"WITH {UPLOADS_SQL}, w AS (SELECT *, len({O.content('text')}) > 0 AS words FROM up) SELECT CASE WHEN clean = '' THEN given ELSE clean END AS filename, CASE WHEN clean = '' THEN 'rejected' WHEN words THEN 'indexed' ELSE 'failed' END AS status, "
         "CASE WHEN clean = '' THEN 'unsupported name' WHEN NOT words THEN 'no readable text' END AS reason FROM w")  # fmt: skip
def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page numbers offered under each page of searches, for a page of one result and more."""
    i = index(spark, sf_dir)
    q = score.ask(asked(spark, STRIPPED), i)
    pages = pages_of(q, i)[0].select("query_id", "page", "total_pages").distinct()
    return pages.select("query_id", "page", "total_pages", F.array_join(rank.page_strip(F.col("page"), F.col("total_pages")), " ").alias("strip"))


#: The same searches on different pages.
STRIPPED = [(10 * k + p, raw, str(page), limit) for k, (raw, limit) in enumerate((("the", "10"), ("en src1", "3"), ("555", "50"), ('"of the"', "7"))) for p, page in enumerate((1, 2, 4, 7, 999))]
register("page_strip", _strips, O.search(STRIPPED, O.PAGES.format("res") + """,
sk AS (SELECT DISTINCT query_id, pno AS p, total_pages AS n FROM pr), k AS (SELECT *, CASE WHEN n <= 1 THEN [] WHEN n <= 7 THEN range(1, n + 1) ELSE list_sort(list_distinct(list_filter([1, p - 1, p, p + 1, n], lambda x: x BETWEEN 1 AND n))) END AS shown FROM sk)
SELECT query_id, p AS page, n AS total_pages, array_to_string(list_transform(shown, lambda x, i: CASE WHEN i > 1 AND x - shown[i - 1] > 1 THEN '... ' ELSE '' END || x), ' ') AS strip FROM k"""))  # fmt: skip
register("recent_searches", lambda s, d: mutate.recent_searches(s.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_type").alias("query"), "ts", F.col("event_id").alias("id"))).select("user_id", "rank", "query"),
         "WITH a AS (SELECT user_id, event_type AS query, ts, event_id, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE trim(event_type) <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM a WHERE n = 1) SELECT user_id, rank::INT AS rank, query FROM b WHERE rank <= 8")
register("query_suggestions", lambda s, d: mutate.suggestions(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("rank"), F.col("p_name").alias("query")), "a"),
         "SELECT p_partkey AS rank, p_name AS query FROM part WHERE contains(lower(p_name), 'a') AND lower(trim(p_name)) <> 'a' ORDER BY p_partkey LIMIT 5")
