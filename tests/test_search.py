"""Search, snippets and changes on hand-made documents."""

import contextlib
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.operators import mutate
from quillon.operators.index import build_index
from quillon.plans.search import search
from quillon.sources.extract import extract, inside, sanitised, scan_folder
from quillon.sources.store import Conflict, IncompleteSnapshot, Store

SCHEMA = "filename string, path string, text string, page_texts array<struct<page int, text string>>, doc_seq bigint"
QUERIES = "query_id int, raw string, page string, limit string"


def doc(n, name, *pages):
    return (name, f"/d/{name}", " ".join(pages), [(k, p) for k, p in enumerate(pages, 1)], n)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        doc(1, "art_notes 1.pdf", "Smart workers meet.", "", "Foo, bar and foo bar again"), doc(2, "network plan.docx", "network network x55 5551"), doc(3, "empty.txt", "!"),
        doc(4, "a a b.txt", "ones 55 phrase ends", "here and goes on"), doc(5, "plain.txt", "aaaa networks " + "word " * 100 + "needle " + "tail " * 100),
    ], SCHEMA)


@pytest.fixture(scope="module")
def index(docs):
    i = build_index(docs)
    for t in (i.documents, i.pages, i.bodies):
        t.persist()
    return i


def ask(spark, index, raw, page="1", limit="10"):
    return search(spark.createDataFrame([(1, raw, page, limit)], QUERIES), index).orderBy("rank").collect()


def test_index(index):
    assert {r.filename: (r.total_words, r.page_count, r.filename_words) for r in index.documents.collect()} == {
        "art_notes 1.pdf": (9, 2, ["art", "notes", "1"]), "network plan.docx": (4, 1, ["network", "plan"]), "a a b.txt": (8, 2, ["a", "a", "b"]), "plain.txt": (203, 1, ["plain"])}


def test_short_numbers_match_inside_only(spark, index):
    assert {r.title for r in ask(spark, index, "55")} == {"network plan.docx", "a a b.txt"}
    only = [r for r in ask(spark, index, "55") if r.title == "network plan.docx"][0]
    assert (only.exact_content_match, only.prefix_similarity, only.numeric_similarity) == (False, 0.0, round(0.7 * 2 / 3, 4))


def test_phrases(spark, index):
    assert [(r.title, r.phrase_occurrences) for r in ask(spark, index, '"foo bar"')] == [("art_notes 1.pdf", 1)]
    assert [r.title for r in ask(spark, index, '"art work"')] == ["art_notes 1.pdf"]
    assert [r.title for r in ask(spark, index, '"ends here"')] == ["a a b.txt"]
    assert ask(spark, index, '"meet"') == []
    assert [r.match_type for r in ask(spark, index, '"network plan.docx"')] == ["Filename + Phrase"]


def test_score_by_hand(spark, index):
    row = {r.title: r for r in ask(spark, index, "networks")}["plain.txt"]
    assert row.content_score == round(1 / 203 * (math.log(5 / 2) + 1), 4) and row.score == 0.75


def test_repeated_words_score_twice(spark, index):
    one, two = ({r.title: r.content_score for r in ask(spark, index, q)} for q in ("network", "network network"))
    assert two["network plan.docx"] == pytest.approx(2 * one["network plan.docx"], abs=2e-4)


def test_snippet_and_highlights(spark, index):
    row = [r for r in ask(spark, index, "needle")][0]
    assert row.snippet.startswith("... word ") and row.snippet.endswith(" tail ...") and row.page == 1
    assert [row.snippet[h.start : h.end] for h in row.highlights] == ["needle"]
    row = [r for r in ask(spark, index, "foo bar") if r.title == "art_notes 1.pdf"][0]
    assert row.page == 3 and row.page_url.endswith("art_notes%201.pdf#page=3")
    assert [(h.start, h.end) for h in row.highlights] == [(13, 20)]
    touching = [r for r in ask(spark, index, "aaaa") if r.title == "plain.txt"][0]
    assert [(h.start, h.end) for h in touching.highlights] == [(0, 4)]


def test_browse_pages_and_empty(spark, index):
    rows = ask(spark, index, "txt", "99", "1")
    assert [(r.title, r.pagination.page, r.pagination.total, r.pagination.has_next, r.snippet) for r in rows] == [("plain.txt", 2, 2, False, "Filtered by file type: TXT")]
    assert [ask(spark, index, q) for q in ("", '""', "!!!", "zzzz")] == [[], [], [], []]


def test_changes(spark, index, docs):
    new = spark.createDataFrame([doc(9, "plain.txt", "fresh words"), doc(10, "bad.txt", "?")], SCHEMA)
    after = mutate.upsert(index, new)
    terms = {r.term for r in after.postings.collect()}
    assert "needle" not in terms and "fresh" in terms and after.documents.count() == 4
    assert {tuple(r) for r in mutate.upload_status(new).collect()} == {("plain.txt", "indexed", None), ("bad.txt", "failed", "no readable text")}
    left = mutate.remove(index, spark.createDataFrame([("network plan.docx",), ("nobody",)], "filename string"))
    assert "x55" not in {r.term for r in left.postings.collect()} and left.documents.count() == 3
    terms, report = mutate.repaired_filename_terms(spark.createDataFrame([("plain.txt", 0, "wrong"), ("gone", 0, "x")], "filename string, position int, term string"), index.documents)
    assert {tuple(r) for r in report.collect()} >= {("plain.txt", "rewritten"), ("gone", "orphan")}


def contents(index):
    """All rows of the tables that make an index up, and the counts that searches use."""
    rows = lambda t, *c: sorted(map(tuple, t.select(*c).collect()), key=str)
    return {
        "documents": rows(index.documents, "filename", "title", "total_words", "page_count", "ext", "doc_seq"), "postings": rows(index.postings, "term", "filename", "term_count"), "pages": rows(index.pages, "filename", "page_number", "text"),
        "bodies": rows(index.bodies, "filename", "body"), "vocabulary": rows(index.vocabulary(), "term", "df"), "name_keys": rows(index.name_keys(), "key", "df"), "types": rows(index.types(), "ext", "n"),
    }


def test_store_and_engine(spark, index, docs, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load() is None and store.publish(index) == 1 and store.publish(index) == 2
    assert contents(store.load()) == contents(index) and store.count_documents() == 4
    with pytest.raises(IncompleteSnapshot):
        store.publish(type(index)(index.documents, None, index.bodies))
    assert store.generation() == 2
    engine = Engine(spark, str(tmp_path / "e"))
    assert engine.search("needle").count() == 0 and engine.status()["documents"] == 0 and not engine.has_document("plain.txt")
    engine.upsert(docs)
    assert [r.title for r in engine.search("needle").collect()] == ["plain.txt"]
    assert {tuple(r) for r in engine.delete(["x/plain.txt", "plain.txt", "nope.pdf", "a\\b.pdf", ""]).collect()} == {("plain.txt", "deleted"), ("nope.pdf", "not_found"), ("a\\b.pdf", "not_found")}
    assert engine.search("needle").count() == 0 and engine.status()["documents"] == 3
    engine.delete([r.filename for r in engine.index.documents.collect()])
    assert engine.search("network").count() == 0 and engine.search("pdf").count() == 0 and engine.status()["documents"] == 0 and engine.get_document("plain.txt").count() == 0
    engine.upsert(docs)
    assert engine.search("network").count() == 2


def test_changes_in_segments_equal_a_rebuild(spark, docs, tmp_path):
    """Random upserts and deletes, merged when segments pile up: tables, counts and searches are those of one build of what is left."""
    import random

    r, words = random.Random(5), ["alpha", "beta", "x55", "gamma", "net", "networks", "12"]
    store, state = Store(spark, str(tmp_path / "s")), {}
    for step in range(9):
        new = {f"{r.choice('abcdefgh')}_{r.choice(['net', 'plan'])}.{r.choice(['pdf', 'txt'])}": " ".join(r.choices(words, k=6)) for _ in range(3)}
        if step % 3 == 2:
            gone = r.sample(sorted(state), 2) + ["nobody.pdf"]
            store.remove(spark.createDataFrame([(n,) for n in gone], "filename string"))
            state = {k: v for k, v in state.items() if k not in gone}
        else:
            rows = [doc(100 * step + k, name, text, "second " + text) for k, (name, text) in enumerate(sorted(new.items()))]
            store.upsert(build_index(spark.createDataFrame(rows, SCHEMA)))
            state |= {row[0]: row for row in rows}
    whole = build_index(spark.createDataFrame(list(state.values()), SCHEMA))
    assert 1 < len(store.current()[1]) < 9
    want = contents(whole)
    assert contents(store.load()) == want
    asks = [(q, [(x.title, x.score, x.snippet) for x in ask(spark, whole, q)]) for q in ("net 12", '"net"', "alpha beta pdf")]
    assert [(q, [(x.title, x.score, x.snippet) for x in ask(spark, store.load(), q)]) for q, _ in asks] == asks
    assert {(x.term, x.term_count) for x in store.term_counts(min(state)).collect()} == {(t, n) for t, f, n in want["postings"] if f == min(state)}
    store.compact()
    assert len(store.current()[1]) == 1 and contents(store.load()) == want


def test_a_small_change_writes_little(spark, tmp_path):
    from quillon.sources.corpus import texts

    corpus = texts(spark, "/root/testdata/sf0.01")
    store = Store(spark, str(tmp_path / "s"))
    store.publish(build_index(corpus))
    size = lambda s: sum(t["bytes"] for t in s["tables"].values())
    few = corpus.where("doc_seq IN (1, 2, 4, 5, 7, 8, 10, 11, 13, 14)").withColumn("text", F.lit("a few new words")).withColumn("page_texts", F.array(F.struct(F.lit(1).alias("page"), F.lit("a few new words").alias("text"))))
    store.upsert(build_index(few))
    base, change = store.current()[1]
    assert size(change) < 0.02 * size(base) and change["tables"]["documents"]["rows"] == 10
    # One term is looked up in its own bucket and row groups, a name in its own; neither plan has an exchange of a large table.

    def text(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("formatted")
        return out.getvalue()

    base_only = store._index([base])
    plan = text(base_only.postings_of(["the", "of"]))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term, [of,the])" in plan and "Exchange" not in plan
    assert "In(filename, [x,y])" in text(base_only.pages_of(["x", "y"])) and "StringStartsWith(term,mod)" in text(base_only.vocabulary(F.col("term").startswith("mod")))


def test_a_search_takes_few_jobs_and_no_page_to_the_driver(spark, tmp_path):
    from quillon.operators import queries, snippet

    engine = Engine(spark, str(tmp_path / "e"))
    long = "word " * 400_000 + "needle " + "tail " * 1000
    engine.upsert(spark.createDataFrame([doc(1, "long.txt", long), doc(2, "other.txt", "needle in short"), doc(3, "x.pdf", "nothing")], SCHEMA))
    engine.search("needle").collect()
    tracker, seen, kept = spark.sparkContext.statusTracker(), [], snippet.held

    def watched(df, most=queries.FEW_ROWS):
        out = kept(df, most)
        seen.append(sum(len(str(r)) for r in out[1] or ()))
        return out

    snippet.held = watched
    try:
        before = len(tracker.getJobIdsForGroup(None))
        rows = engine.search("needle").collect()
    finally:
        snippet.held = kept
    assert {r.title for r in rows} == {"long.txt", "other.txt"} and len(tracker.getJobIdsForGroup(None)) - before <= 25
    assert seen and max(seen) < 20_000


def test_two_writers(spark, docs, tmp_path):
    """Of two writers the second one builds on what the first has published; a rebuild keeps what was changed beside it."""
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.publish(build_index(docs))
    kept, others = two._delta, []

    def late(segments, new, names, seq):
        out = kept(segments, new, names, seq)
        if not others:
            others.append(one.upsert(build_index(spark.createDataFrame([doc(7, "first.txt", "written first")], SCHEMA))))
        return out

    two._delta = late
    assert two.upsert(build_index(spark.createDataFrame([doc(8, "second.txt", "written second")], SCHEMA))) == 3 and others == [2]
    names = {r.filename for r in two.load().documents.collect()}
    assert {"first.txt", "second.txt"} < names and len(names) == 6
    since = one.generation()
    one.remove(spark.createDataFrame([("first.txt",)], "filename string"))
    one.publish(build_index(docs.unionByName(spark.createDataFrame([doc(7, "first.txt", "written first"), doc(8, "second.txt", "old words")], SCHEMA))), since=since)
    left = one.load()
    assert "first.txt" not in {r.filename for r in left.documents.collect()} and "old" in {r.term for r in left.vocabulary().collect()} and "first" not in {r.term for r in left.vocabulary().collect()}
    with pytest.raises(Conflict):
        one._commit(one.generation(), [])


def test_manifests_on_other_file_systems(spark, tmp_path):
    """Where there are no hard links a rename that doesn't overwrite makes the manifest; here on the local file system under another name."""
    store = Store(spark, str(tmp_path / "s"))

    class Other:
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):  # noqa: N802
            return "other"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    store._fs = Other(store._fs)
    assert store._commit(1, []) == 1 and store.load().documents.count() == 0
    with pytest.raises(Conflict):
        store._commit(1, [])
    assert [p.name for p in (tmp_path / "s").glob("*.json")] == ["manifest-0000000001.json"]


def test_recovery_and_retention(spark, index, tmp_path):
    import os
    import shutil

    root = str(tmp_path / "s")
    store = Store(spark, root)
    for _ in range(5):
        store.publish(index)
    assert store.generation() == 5 and len([x for x in os.listdir(root) if x.startswith("seg-")]) == 3
    newest = f"{root}/{store.manifest(5)['segments'][0]['folder']}"
    part = next(x for x in os.listdir(f"{newest}/pages") if x.startswith("part-"))
    with open(f"{newest}/pages/{part}", "r+b") as f:
        f.truncate(100)
    assert store.current()[0] == 4 and contents(store.load()) == contents(index)
    shutil.rmtree(f"{root}/{store.manifest(4)['segments'][0]['folder']}/postings")
    assert store.current()[0] == 3
    open(f"{root}/manifest-0000000009.json", "w").write("{broken")
    assert Store(spark, root).count_documents() == 4
    assert store.publish(index) == 10
    assert {(r.term, r.term_count) for r in store.term_counts("network plan.docx").collect()} == {("network", 2), ("x55", 1), ("5551", 1)}
    assert store.term_counts("a\\'").count() == 0


def test_version_1_is_upgraded(spark, index, docs, tmp_path):
    import json
    import os

    root = str(tmp_path / "s")
    for name, df in {"documents": index.documents.drop("terms"), "postings": index.postings, "pages": index.pages}.items():
        df.write.parquet(f"{root}/gen-x/{name}")
    with open(f"{root}/manifest-0000000004.json", "w") as f:
        json.dump({"generation": 4, "folder": "gen-x"}, f)
    store = Store(spark, root)
    assert contents(store.load()) == contents(index)
    assert store.upsert(build_index(spark.createDataFrame([doc(9, "new.txt", "fresh words")], SCHEMA))) == 6
    assert store.count_documents() == 5 and all(s["tables"] for s in store.current()[1]) and os.path.isdir(f"{root}/gen-x")


def test_uploads(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    engine = Engine(spark, str(tmp_path / "e"))
    got = engine.upload([("../x/Über uns.txt", b"Plain words here"), ("a.exe", b"no"), ("empty.txt", b"?"), ("C:\\d\\b.txt", b"other words")], str(folder))
    assert {tuple(r) for r in got.collect()} == {("Uber_uns.txt", "indexed", None), ("a.exe", "rejected", "unsupported name"), ("empty.txt", "failed", "no readable text"), ("Cdb.txt", "indexed", None)}
    assert sorted(p.name for p in folder.iterdir()) == ["Cdb.txt", "Uber_uns.txt", "empty.txt"]
    assert engine.has_document("Uber_uns.txt") and not engine.has_document("a.exe")
    assert engine.document_path(str(folder), "Uber_uns.txt") == str(folder / "Uber_uns.txt")
    assert engine.document_path(str(folder), "../../etc/passwd") is None and engine.document_path(str(folder), "empty.txt") is None
    engine = Engine(spark, str(tmp_path / "e"), str(folder))
    assert {tuple(r) for r in engine.delete(["Cdb.txt", "empty.txt", "../../etc/passwd"]).collect()} == {("Cdb.txt", "deleted"), ("empty.txt", "deleted"), ("passwd", "not_found")}
    engine.rebuild()
    assert [r.filename for r in engine.index.documents.collect()] == ["Uber_uns.txt"] and sorted(p.name for p in folder.iterdir()) == ["Uber_uns.txt"]


def test_background_rebuilds_are_joined(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first words")
    engine = Engine(spark, str(tmp_path / "e"))
    assert engine.start_rebuild(str(tmp_path / "in")) is True and engine.status()["state"] == "INDEXING"
    (tmp_path / "in" / "b.txt").write_text("second words")
    assert [engine.start_rebuild(str(tmp_path / "in")) for _ in range(3)] == [False] * 3
    engine.wait(120)
    assert engine.status()["state"] == "READY" and engine.store.generation() == 2 and engine.store.count_documents() == 2
    assert engine.start_rebuild(str(tmp_path / "nowhere")) is True
    engine.wait(60)
    assert engine.status()["state"] == "ERROR" and engine.store.count_documents() == 2


def test_json_snapshots(spark, index, tmp_path):
    import json

    from quillon.sources.snapshot import load_json, write_json

    write_json(index, str(tmp_path / "j"))
    again = load_json(spark, str(tmp_path / "j"))
    rows = lambda t, *c: sorted(map(tuple, t.select(*c).collect()))
    for a, b, c in ((index.postings, again.postings, ("term", "filename", "term_count")), (index.pages, again.pages, ("filename", "page_number", "text")), (index.documents, again.documents, ("filename", "title", "total_words", "page_count", "ext", "filename_words")), (index.bodies, again.bodies, ("filename", "body"))):
        assert rows(a, *c) == rows(b, *c)
    whole = tmp_path / "k"
    whole.mkdir()
    (whole / "inverted_index.json").write_text(json.dumps({"word": {"a.txt": 2, "b.txt": 1}, "other": {"a.txt": 1}}, indent=2))
    (whole / "document_meta.json").write_text("{ broken")
    one = load_json(spark, str(whole))
    assert one.documents.count() == 0 and one.pages.count() == 0
    meta = {f"{c}.txt": {"title": f'{c} "q", {{[\\n', "path": "/p,\\", "total_words": 3, "page_count": 1} for c in "ab"}
    (whole / "document_meta.json").write_text(json.dumps(meta))
    (whole / "filename_index.json").write_text('{"a.txt": ["not", "natural"]}')
    (whole / "page_text.json").write_text(" {}\n")
    one = load_json(spark, str(whole), index)
    assert rows(one.postings, "term", "filename", "term_count") == [("other", "a.txt", 1), ("word", "a.txt", 2), ("word", "b.txt", 1)] and one.pages.count() == 0
    assert rows(one.documents, "filename", "title", "path", "filename_words") == [(f"{c}.txt", meta[f"{c}.txt"]["title"], "/p,\\", ["not", "natural"] if c == "a" else []) for c in "ab"]
    (whole / "page_text.json").unlink()
    assert rows(load_json(spark, str(whole), index).pages, "filename", "page_number", "text") == rows(index.pages, "filename", "page_number", "text")


def test_a_json_object_in_many_splits(spark, tmp_path):
    import json
    import random

    from quillon.sources.snapshot import load_json

    r = random.Random(3)
    text = lambda: "".join(r.choices(['a', '"', "\\", ",", "{", "}", "[", "]", "\n", "é", " "], k=r.choice((0, 5, 60))))
    pages = {f"{k}.txt": [{"page": p, "text": text()} for p in range(1, r.choice((1, 2, 6)))] for k in range(400)}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, value in (("plain", json.dumps(pages)), ("wide", json.dumps(pages, indent=1, ensure_ascii=False) + "\n")):
            (tmp_path / name).mkdir()
            (tmp_path / name / "page_text.json").write_text(value)
            got = sorted(map(tuple, load_json(spark, str(tmp_path / name)).pages.collect()))
            assert got == sorted((n, p["page"], p["text"]) for n, own in pages.items() for p in own)
        (tmp_path / name / "page_text.json").write_text(value[:-30])
        assert load_json(spark, str(tmp_path / name)).pages.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_digits_of_other_scripts_and_page_strip(spark):
    from quillon.functions.text import is_number
    from quillon.operators.rank import page_strip

    rows = spark.createDataFrame([("12",), ("\u0663\u0664",), ("\u00b2",), ("1a",), ("\u00bd",), ("",)], "w string")
    assert [r[0] for r in rows.select(is_number(F.col("w"))).collect()] == [w.isdigit() for w in ("12", "\u0663\u0664", "\u00b2", "1a", "\u00bd", "")]
    pages = spark.createDataFrame([(1, 1), (2, 7), (1, 9), (5, 9), (9, 9), (3, 9)], "p int, n int")
    assert [" ".join(r[0]) for r in pages.select(page_strip(F.col("p"), F.col("n"))).collect()] == ["", "1 2 3 4 5 6 7", "1 2 ... 9", "1 ... 4 5 6 ... 9", "1 ... 8 9", "1 2 3 4 ... 9"]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("Hé\r\nllo".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.md").write_text("no")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    rows = {r.filename: r for r in scan_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.TXT", "bad.txt", "b.docx"} and rows["a.TXT"].text == "hé\nllo" and rows["b.docx"].page_texts[0].text == "one\ntwo"
    assert rows["bad.txt"].text == "" and rows["bad.txt"].error and extract("x.pdf", b"junk")[2]
    names = spark.createDataFrame([("../a b.pdf",), ("é té.docx",), ("..pdf",), ("x.exe",), (None,)], "n string")
    assert [r[0] for r in names.select(sanitised(names["n"])).collect()] == ["a_b.pdf", "e_te.docx", "", "", ""]
    assert inside(str(tmp_path), "../../etc/passwd").startswith(str(tmp_path)) and inside(str(tmp_path), "..") is None


def test_stream(spark, docs, tmp_path):
    from quillon.streaming.ingest import ingest

    docs.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert store.count_documents() == 4
