"""Text functions against small Python models."""

import re
from urllib.parse import quote

from pyspark.sql import functions as F

from quillon.functions import text as T

CASES = ["the pdf", "pdf the", ".docx", "PDF", "a.pdf", '"a b.docx"', '".pdf"', '""', "", "   ", "x docx y .txt", "BCS Module 2.PDF", '"a.pdf" b', "a .pdf", "pdf docx", "\ta  b\n", '"', "x.txt.pdf", "été Nº2", "a_b-c"]
TYPES = ("pdf", "docx", "txt")


def split_type(q):
    q = q.strip()
    for t in TYPES:
        for tail in (f'.{t}"', f".{t}"):
            if q.lower().endswith(tail):
                rest = q[: -len(tail)].rstrip()
                return (rest + '"' if rest else "") if tail[-1] == '"' else rest, t
    words = q.split()
    kinds = [w.lower().lstrip(".") for w in words if w.lower() in {*TYPES, *(f".{t}" for t in TYPES)}]
    return " ".join(w for w in words if w.lower() not in {*TYPES, *(f".{t}" for t in TYPES)}), kinds[0] if kinds else None


def test_file_type_and_tokens(spark):
    rows = spark.createDataFrame([(c,) for c in CASES], "raw string").select("raw", T.file_type(F.col("raw")).alias("t"), T.name_tokens(F.col("raw")).alias("n"), T.collapse(F.col("raw")).alias("c"), T.url_quote(F.col("raw")).alias("u")).collect()
    for r in rows:
        assert (r.t.rest, r.t.filetype) == split_type(r.raw), r.raw
        assert r.n == re.findall(r"[^\W_]+", r.raw.lower()), r.raw
        assert r.c == " ".join(r.raw.split())
        assert r.u == quote(r.raw, safe="")


def test_numbers_and_extensions(spark):
    row = spark.createDataFrame([("abc", "0", "a..PDF", ".pdf", "a.b.txt", "noext")], "a string, b string, c string, d string, e string, f string")
    got = row.select(T.page_number(F.col("a")), T.page_limit(F.col("b")), *[T.extension(F.col(x)) for x in "cdef"], T.stem(F.col("e"))).first()
    assert list(got) == [1, 1, "pdf", "", "txt", "", "a.b"]


def test_occurrences(spark):
    df = spark.createDataFrame([("aa aaa", "aa"), ("foo, bar", "foo bar"), ("smart workers", "art work"), ("x", "")], "t string, p string")
    assert [r[0] for r in df.select(T.occurrences(F.col("t"), F.col("p"))).collect()] == [2, 0, 1, 0]


def test_collapse_passes_over_single_spaces(spark):
    import random

    from quillon.functions import text as T

    r = random.Random(5)
    rows = [("".join(r.choices(["a", "\u00e9", " ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "b "], k=r.randrange(30))),) for _ in range(500)]
    found = spark.createDataFrame(rows, "t string").select("t", T.collapse(F.col("t")).alias("c"), T.strip(F.regexp_replace("t", f"{T.SPACE}+", " ")).alias("plain"))
    assert [x for x in found.collect() if x.c != x.plain] == []
    assert "{0}(?:{0}+|(?<! ))".format(T.SPACE) in found._jdf.queryExecution().analyzed().toString()
