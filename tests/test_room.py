"""Disk that an index and searches take while they work, on hand-made documents."""

import os
import time

from pyspark.sql import functions as F

from quillon.operators.index import build_index, counted
from quillon.sources import store as S
from quillon.sources.store import Store

SCHEMA = "filename string, path string, text string, page_texts array<struct<page int, text string>>, doc_seq bigint"


def documents(spark, n):
    return spark.createDataFrame([(f"en module {k}.pdf", "/d", f"the word{k} word{k % 7} again the thesis", [(1, f"the word{k} word{k % 7} again the thesis")], k) for k in range(n)], SCHEMA)


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return sum(f.startswith("shuffle_") for d in env.blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for f in names)


def settles(value, wanted, seconds=20):
    """Files are removed by a thread of Spark's."""
    until = time.time() + seconds
    while value() > wanted and time.time() < until:
        time.sleep(0.2)
    return value()


def test_terms_are_counted_where_the_text_is(spark):
    found = build_index(documents(spark, 30)).documents
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    row = found.where("doc_seq = 3").first()
    assert [(t.term, t.term_count) for t in row.terms] == [("again", 1), ("the", 2), ("thesis", 1), ("word3", 2)] and row.total_words == 6
    few = spark.range(1).select(counted(F.array().cast("array<string>")).alias("none"), counted(F.array(F.lit("b"))).alias("one")).first()
    assert few.none == [] and [tuple(t) for t in few.one] == [("b", 1)]


def test_a_build_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    Store(spark, str(tmp_path / "s")).publish(build_index(documents(spark, 200)))
    assert settles(lambda: shuffle_files(spark), before) <= before


def test_postings_in_passes(spark, tmp_path, monkeypatch):
    texts, rows = documents(spark, 300), {}
    for most in (S.BUCKET_ROWS, 20):  # one bucket in one pass, then many buckets in several
        monkeypatch.setattr(S, "BUCKET_ROWS", most)
        store = Store(spark, str(tmp_path / str(most)))
        store.publish(build_index(texts))
        segment = store.current()[1][0]
        rows[most] = sorted(map(tuple, store.load().postings.collect()))
        assert segment["tables"]["postings"]["rows"] == len(rows[most])
        assert {r.filename for r in store.load().postings_of(["word17"]).collect()} == {"en module 17.pdf"}
    assert segment["buckets"] >= S.PASSES and rows[20] == rows[S.BUCKET_ROWS if S.BUCKET_ROWS != 20 else 250_000]


def test_a_store_begins_with_the_segments_of_another(spark, tmp_path):
    base, own = Store(spark, str(tmp_path / "base")), Store(spark, str(tmp_path / "own"))
    base.publish(build_index(documents(spark, 40)))
    assert own.share(base) == 1 and not [x for x in os.listdir(own.root) if x.startswith("seg-")]
    for k in range(6):  # generations of the base retire from the manifests, its files stay
        own.remove(spark.createDataFrame([(f"en module {k}.pdf",)], "filename string"))
    own.compact()
    for _ in range(3):
        own.upsert(build_index(documents(spark, 1)))
    assert own.count_documents() == 35 and base.count_documents() == 40
    assert base.load().postings.count() == build_index(documents(spark, 40)).postings.count()


def test_objects_become_one_as_a_stream(spark, tmp_path):
    import json

    from quillon.sources import snapshot

    folder = str(tmp_path / "lines")
    members = [{f"k{k}": {"a\n,": k}} for k in range(1000)]
    spark.createDataFrame([(json.dumps(m),) for m in members], "value string").repartition(5).write.text(folder)
    whole = snapshot.one_object(spark.read.text(folder))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Exchange" not in plan
    rows = [r.value for r in whole.collect()]
    assert len(rows) == 1002 and json.loads("\n".join(rows)) == {k: v for m in members for k, v in m.items()}
    assert [r.value for r in snapshot.one_object(spark.createDataFrame([], "value string")).collect()] == ["{", "}"]


def test_uploads_without_repeated_names_are_not_dealt_out(spark):
    from quillon.operators import mutate

    texts = documents(spark, 20)
    assert "Exchange" not in mutate.sanitised_upload(texts)._jdf.queryExecution().executedPlan().toString()
    twice = texts.unionByName(texts.where("doc_seq = 3").withColumns({"doc_seq": F.lit(99).cast("long"), "text": F.lit("later")}))
    rows = mutate.sanitised_upload(twice).collect()
    assert len(rows) == 20 and [r.text for r in rows if r.doc_seq == 99] == ["later"] and not [r for r in rows if r.doc_seq == 3]


def test_queries_of_one_text_are_scored_once(spark, monkeypatch):
    from quillon.operators import score
    from quillon.plans import search as P

    index, seen = build_index(documents(spark, 30)), []
    monkeypatch.setattr(P, "score", lambda asked, *a: seen.append(len(asked.worded_rows)) or score.score(asked, *a))
    queries = [(1, "the", "1", "10"), (2, "the", "3", "10"), (3, "the", "99", "7"), (4, "word3", "1", "10"), (5, "the pdf", "2", "10")]
    asked = score.ask(spark.createDataFrame(queries, "query_id int, raw string, page string, limit string"), index)
    rows = P.pages_of(asked, index)[0].select("query_id", "rank", "page", "total", "doc_seq").collect()
    assert seen == [3]
    pages = {i: sorted((r["rank"], r.page, r.total) for r in rows if r.query_id == i) for i in range(1, 6)}
    assert pages[1] == [(k, 1, 30) for k in range(1, 11)] and pages[2] == [(k, 3, 30) for k in range(21, 31)]
    assert pages[3] == [(29, 5, 30), (30, 5, 30)] and pages[5] == [(k, 2, 30) for k in range(11, 21)] and pages[4]


def asked_of(spark, index, *raw):
    from quillon.operators import score

    return score.ask(spark.createDataFrame([(k, q, "1", "10") for k, q in enumerate(raw, 1)], "query_id int, raw string, page string, limit string"), index)


def test_many_terms_go_to_the_postings(spark, tmp_path, monkeypatch):
    """More terms than a plan holds: postings of other terms don't reach the join, and none is dealt out for it."""
    from quillon.operators import score

    store = Store(spark, str(tmp_path / "s"))
    store.publish(build_index(documents(spark, 60)))
    index = store.load()
    asked = asked_of(spark, index, "the word1 17", '"the word3"')
    rows = lambda: sorted(map(str, score.term_evidence(asked, index).collect()))
    few = rows()
    monkeypatch.setattr(score, "held", lambda df: (df, None))
    plan = score.term_evidence(asked, index)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "StartsWith(term" in plan
    assert rows() == few and len(few) > 60


def test_phrases_in_many_documents_move_no_body(spark, tmp_path, monkeypatch):
    from quillon.operators import score

    store = Store(spark, str(tmp_path / "s"))
    store.publish(build_index(documents(spark, 40)))
    index = store.load()
    asked = asked_of(spark, index, '"again the"', '"the word3"', "the thesis", "again")
    found = lambda: sorted(map(tuple, score.phrase_counts(asked, index, score.evidence(asked, index))[0].select("query_id", "filename", "phrase_occurrences").collect()))
    few = found()
    monkeypatch.setattr(score, "held", lambda df: (df, None))
    monkeypatch.setattr(type(index), "bodies_of", lambda *a: 1 / 0)
    assert found() == few and {r[0] for r in few} == {1, 2, 3}


def test_evidence_is_dealt_as_numbers(spark):
    from quillon.operators import score

    index = build_index(documents(spark, 20))
    rows = score.evidence(asked_of(spark, index, "the word3"), index)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") < plan.index("REPARTITION_BY_COL") and "collect_list" not in plan[plan.index("REPARTITION_BY_COL"):]
    assert [r.content_matches for r in rows.where("filename = 'en module 3.pdf'").collect()] == [["the", "word3"]]


def test_texts_are_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    texts = documents(spark, 30).withColumn("page_texts", F.when(F.col("doc_seq") == 4, F.expr("array(named_struct('page', 2, 'text', 'Second'), named_struct('page', 1, 'text', 'First  one'), named_struct('page', 3, 'text', ' '))")).otherwise(F.col("page_texts")))
    store.publish(build_index(texts))
    segment = store.current()[1][0]
    assert "bodies" not in segment["tables"] and not os.path.exists(f"{store.root}/{segment['folder']}/bodies")
    index = store.load()
    for rows in (index.bodies, index.lists(), index.pages):  # none is dealt out to be made
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in index.pages_of(["en module 4.pdf"]).orderBy("page_number").collect()] == [("en module 4.pdf", 1, "first  one"), ("en module 4.pdf", 2, "second")]
    assert [r.body for r in index.bodies_of(["en module 4.pdf"]).collect()] == ["first one second"]


def test_segments_of_version_2_are_read_and_merged(spark, tmp_path, monkeypatch):
    """Pages and bodies as tables of their own, as version 2 wrote them."""
    import json

    store = Store(spark, str(tmp_path / "s"))
    store.publish(build_index(documents(spark, 12)))
    want = [sorted(map(tuple, t.collect())) for t in (store.load().pages, store.load().bodies)]
    segment, at = store.current()[1][0], f"{store.root}/{store.current()[1][0]['folder']}"
    index = build_index(documents(spark, 12))
    for name in ("pages", "bodies"):
        (index.pages if name == "pages" else index.bodies).write.mode("overwrite").parquet(f"{at}/{name}")
        segment["tables"][name] = {"rows": 12, "bytes": store._fs.getContentSummary(store._path(f"{at}/{name}")).getLength()}
    with open(f"{store.root}/manifest-0000000002.json", "w") as f:
        json.dump({"version": 2, "generation": 2, "segments": [segment]}, f)
    assert store.current()[0] == 2 and [sorted(map(tuple, t.collect())) for t in (store.load().pages, store.load().bodies)] == want
    store.upsert(build_index(documents(spark, 13).where("doc_seq = 12")))
    store.compact()
    now = store.current()[1]
    assert len(now) == 1 and "bodies" not in now[0]["tables"] and store.load().bodies.count() == 13
    assert [r for r in sorted(map(tuple, store.load().pages.collect())) if "12" not in r[0]] == want[0]


def test_version_1_is_brought_together_in_passes(spark, tmp_path, monkeypatch):
    import json

    root, texts = str(tmp_path / "s"), documents(spark, 40)
    pages = F.when(F.col("doc_seq") == 4, F.expr("array(named_struct('page', 2, 'text', 'Second'), named_struct('page', 1, 'text', 'First  one'))")).when(F.col("doc_seq") == 5, F.expr("slice(page_texts, 1, 0)")).otherwise(F.col("page_texts"))
    index = build_index(texts.withColumn("page_texts", pages))
    for name, df in {"documents": index.documents.drop("terms"), "postings": index.postings.orderBy("term"), "pages": index.pages}.items():
        df.write.parquet(f"{root}/gen-x/{name}")
    with open(f"{root}/manifest-0000000004.json", "w") as f:
        json.dump({"generation": 4, "folder": "gen-x"}, f)
    rows = lambda i: [sorted(map(str, t.collect())) for t in (i.documents, i.pages, i.lists(), i.bodies)]
    brought = lambda: {x for x in os.listdir(f"{root}/gen-x") if x.startswith("by-document")}
    want = rows(index)
    assert rows(Store(spark, root).load()) == want and not brought()  # a small one is made when it is read
    monkeypatch.setattr(S, "PASS_BYTES", 1)
    monkeypatch.setattr(S, "PASSES", 3)
    before = shuffle_files(spark)
    now = Store(spark, root).load()
    assert settles(lambda: shuffle_files(spark), before) <= before
    for t in (now.documents, now.lists(), now.bodies):  # none is dealt out when it is read
        assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    assert rows(now) == want and len(brought()) == 1
    assert rows(Store(spark, root).load()) == want and len(brought()) == 1
    folder = f"{root}/gen-x/{brought().pop()}"
    part = next(x for x in os.listdir(f"{folder}/documents") if x.endswith(".parquet"))
    os.remove(f"{folder}/documents/{part}")
    assert rows(Store(spark, root).load()) == want and len(brought()) == 2  # one that isn't whole is made again
    store = Store(spark, root)
    store.upsert(build_index(documents(spark, 41).where("doc_seq = 40")))
    assert store.count_documents() == 41 and store.load().postings.count() == index.postings.count() + 5


def test_a_store_of_version_1_needs_no_index(spark, monkeypatch):
    from quillon.plans import catalog as C
    from quillon.sources.corpus import texts

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(C, "PASSES", 2)
    monkeypatch.setattr(C, "_base", lambda *a: 1 / 0)
    store = C._write_version_1(spark, small)
    assert not os.path.exists(f"{store.root}/counted")
    postings = spark.read.parquet(f"{store.root}/gen-1/postings")
    assert postings.columns == ["term", "filename", "term_count"] and "terms" not in spark.read.parquet(f"{store.root}/gen-1/documents").columns
    rows = lambda i: sorted(map(str, C._digests(i).collect()))
    assert rows(store.load()) == rows(build_index(texts(spark, small)))


def plans_of_writes(monkeypatch):
    """The plans of what stores write from now on, by folder."""
    seen, save = [], Store._save

    def spy(self, df, at, by=None):
        seen.append((at.split("/")[-1], df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, at, by)

    monkeypatch.setattr(Store, "_save", spy)
    return lambda name: [p for n, p in seen if n == name]


def test_a_segment_is_made_without_looking_for_ranges(spark, tmp_path, monkeypatch):
    """Documents stand in ranges of their texts already; postings are made once for each pass."""
    plans, store = plans_of_writes(monkeypatch), Store(spark, str(tmp_path / "s"))
    store.publish(build_index(documents(spark, 30)))
    assert plans("documents") and not any("Exchange" in p for p in plans("documents"))
    assert plans("postings") and not any("rangepartitioning" in p for p in plans("postings"))
    monkeypatch.setattr(S, "FEW_VALUES", 2)
    store.remove(store.load().documents.where("doc_seq < 9").select("filename"))
    assert plans("gone") and not any("SortMergeJoin" in p for p in plans("gone"))
    assert store.count_documents() == 21 and store.load().vocabulary().where("term = 'thesis'").first().df == 21


def test_a_joined_upload_is_not_taken_for_the_product_of_its_sides(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SMALL_BYTES", 0)
    monkeypatch.setattr(S, "TEXT_BYTES", 1 << 20)
    documents(spark, 60).write.parquet(str(tmp_path / "d"))
    spark.range(60).select(F.col("id").alias("doc_seq"), F.lit("new").alias("with")).write.parquet(str(tmp_path / "b"))
    joined = spark.read.parquet(str(tmp_path / "d")).join(spark.read.parquet(str(tmp_path / "b")), "doc_seq").drop("with")
    store = Store(spark, str(tmp_path / "s"))
    store.publish(build_index(joined))
    folder = f"{store.root}/{store.current()[1][0]['folder']}/documents"
    assert len([x for x in os.listdir(folder) if x.endswith(".parquet")]) <= spark.sparkContext.defaultParallelism and store.count_documents() == 60


def test_members_of_an_object_are_not_dealt_out(spark, tmp_path):
    """Only a member that goes on in the next split is brought together from two."""
    import json

    from quillon.sources.snapshot import _table

    at, was = tmp_path / "inverted_index.json", spark.conf.get("spark.sql.files.maxPartitionBytes")
    terms = {f'w{k}"{{,': {f"{d}.txt": d for d in range(k % 9)} for k in range(500)}
    rows = lambda t: sorted((r.key, sorted(r.value.items())) for r in t.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for text in (json.dumps(terms), json.dumps(terms, indent=2) + "\n\n"):
            at.write_text(text)
            found = _table(spark, str(tmp_path), "inverted_index")
            assert found.rdd.getNumPartitions() > 3 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            assert rows(found) == sorted((k, sorted(v.items())) for k, v in terms.items())
        for damaged in (text[:-3], text + "}", text + " {}", text.rstrip()[:-1] + ',"x" 1}', '{"a": {}} {"b": {}}', '"a": {}', "", "{", '{"a": {"x": 1} "b": {}}'):
            at.write_text(damaged)
            assert rows(_table(spark, str(tmp_path), "inverted_index")) == [], damaged
        for text, want in ((" { } ", []), ('{"a": {}, "b": {"x": 1}\n}', [("a", []), ("b", [("x", 1)])])):
            at.write_text(text)
            assert rows(_table(spark, str(tmp_path), "inverted_index")) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bodies_are_gone_through_once(spark, tmp_path, monkeypatch):
    from quillon.operators import score
    from quillon.plans import search as P

    store, seen = Store(spark, str(tmp_path / "s")), []
    store.publish(build_index(documents(spark, 30)))
    index = store.load()
    asked = asked_of(spark, index, '"again the"', "the thesis")
    monkeypatch.setattr(score, "held", lambda df: (df, None))
    score.phrase_counts(asked, index, score.evidence(asked, index), lambda rows: seen.append(rows) or rows)
    monkeypatch.undo()
    assert [r.columns for r in seen] == [["query_id", "filename", "phrase_occurrences"]]
    queries = spark.createDataFrame([(1, '"again the"', "1", "10")], "query_id int, raw string, page string, limit string")
    for _ in range(2):  # what a search holds goes with the next one
        rows = P.rank_all(queries, index).select("filename", "phrase_occurrences").collect()
        assert len(rows) == 30 and {r.phrase_occurrences for r in rows} == {1} and 1 <= len(P._kept) <= 2
    P._release(spark)
    assert P._kept == []
