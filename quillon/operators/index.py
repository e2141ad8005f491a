"""From extracted texts to the tables of an index, and the lookups that searches make in them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGIT, RUN, collapse, content_tokens, extension, name_tokens, stem, strip
from ..schemas import TERMS

#: Up to so many names, terms or keys are pushed to the files as literals; more are joined.
FEW_VALUES = 2000


@dataclass
class Index:
    """documents, pages and bodies of one state of a corpus, with the tables derived from them; see schemas.py.

    `tables` gives a table by name; `buckets` says how many folders its postings and names are dealt to. Every lookup
    takes the values it looks for where they are few, so that files that can't hold them aren't read.
    """

    documents: DataFrame
    pages: DataFrame
    bodies: DataFrame
    tables: Callable[[str, Callable[[DataFrame, int], DataFrame]], DataFrame] | None = None
    #: The texts that it is to be built from, so that a store can lay them out once before anything is made of them.
    texts: DataFrame | None = None
    _counts: dict[str, int] | None = None
    #: The pages as one row for each document, where they stand so.
    page_lists: DataFrame | None = None

    def lists(self) -> DataFrame:
        """filename, page_list: the pages of each document that has any, in order."""
        return self.page_lists if self.page_lists is not None else listed(self.pages)

    def _table(self, name: str, keep: Callable[[DataFrame, int], DataFrame] = lambda t, buckets: t) -> DataFrame:
        """A derived table; keep: narrows the stored parts of it, given the number of buckets of each."""
        return self.tables(name, keep) if self.tables else keep(DERIVED[name](self.documents, 1), 1)

    @property
    def postings(self) -> DataFrame:
        """term, filename, term_count."""
        return self._table("postings").select("term", "filename", "term_count")

    def vocabulary(self, keep: Column | None = None) -> DataFrame:
        """term, df: documents that have the term. keep: a condition on terms."""
        some = (lambda t, _: t.where(keep)) if keep is not None else (lambda t, _: t)
        return self._table("vocabulary", some).select("term", "df")

    def endings(self, keep: Column) -> DataFrame:
        """term, df of the terms whose reversed form is as `keep` says of the column `reversed`."""
        return self._table("endings", lambda t, _: t.where(keep)).select(F.reverse("reversed").alias("term"), "df")

    def name_keys(self, keep: Column | None = None) -> DataFrame:
        return self._table("name_keys", (lambda t, _: t.where(keep)) if keep is not None else (lambda t, _: t))

    def types(self) -> DataFrame:
        """ext, n: documents of each file type."""
        return self._table("types")

    def type_counts(self) -> dict[str, int]:
        """The same as a mapping; an index doesn't change, so they are read once."""
        if self._counts is None:
            self._counts = {r.ext: r.n for r in self.types().collect()}
        return self._counts

    def postings_of(self, terms: Sequence[str] | None, keep: Column | None = None) -> DataFrame:
        """The postings of terms with what scoring needs of their documents; None: all. keep: a condition on terms, for more terms than are pushed."""
        some = (lambda t: t.where(keep)) if keep is not None else (lambda t: t)
        return self._table("postings", lambda t, buckets: some(_in_buckets(t, "term", terms, buckets))).drop("bucket")

    def names_of(self, keys: Sequence[str] | None) -> DataFrame:
        return self._table("names", lambda t, buckets: _in_buckets(t, "key", keys, buckets)).drop("bucket")

    def documents_of(self, names: Sequence[str] | None) -> DataFrame:
        return among(self.documents, "filename", names)

    def pages_of(self, names: Sequence[str] | None) -> DataFrame:
        return among(self.pages, "filename", names)

    def bodies_of(self, names: Sequence[str] | None) -> DataFrame:
        """filename, body: the pages of a document in order, joined by spaces, in lower case with single spaces; without documents that have no page."""
        return among(self.bodies, "filename", names)

    def filename_terms(self) -> DataFrame:
        return self.documents.select("filename", F.posexplode("filename_words").alias("position", "term"))


def listed(pages: DataFrame) -> DataFrame:
    return pages.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("page_list"))


def page_rows(lists: DataFrame) -> DataFrame:
    return lists.select("filename", F.explode("page_list").alias("p")).select("filename", "p.page_number", "p.text")


def body_rows(lists: DataFrame) -> DataFrame:
    return lists.select("filename", collapse(F.array_join(F.transform("page_list", lambda p: F.lower(p["text"])), " ")).alias("body"))


def among(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    return df if values is None or len(values) > FEW_VALUES else df.where(F.col(column).isin(list(values)))


def bucket_of(value: str, buckets: int) -> int:
    return zlib.crc32(value.encode()) % buckets


def bucket(c: Column, buckets: int) -> Column:
    return (F.crc32(c.cast("binary")) % buckets).cast("int")


def _in_buckets(t: DataFrame, column: str, values: Sequence[str] | None, buckets: int) -> DataFrame:
    if values is None or len(values) > FEW_VALUES:
        return t
    return among(t.where(F.col("bucket").isin(sorted({bucket_of(v, buckets) for v in values}))), column, values)


def pairs_of_digits(c: Column) -> Column:
    return c.rlike(f"{DIGIT}{{2}}")


def postings_table(documents: DataFrame, buckets: int) -> DataFrame:
    each = documents.select("filename", "total_words", "ext", "doc_seq", F.explode("terms").alias("t"))
    return each.select("t.term", "filename", "t.term_count", "total_words", "ext", "doc_seq", bucket(F.col("t.term"), buckets).alias("bucket"))


def keys_of_names(words: Column) -> Column:
    """The distinct keys of a file name given as its words: each word, and each three characters of the words joined by spaces."""
    joined = F.array_join(words, " ")
    grams = F.when(F.length(joined) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(joined) - 2)), lambda i: F.concat(F.lit("g:"), F.substring(joined, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("t:"), w)), grams))


def names_table(documents: DataFrame, buckets: int) -> DataFrame:
    each = documents.select(F.explode(keys_of_names(F.col("filename_words"))).alias("key"), "filename", "filename_words", "ext", "doc_seq")
    return each.withColumn("bucket", bucket(F.col("key"), buckets))


def vocabulary_table(documents: DataFrame, buckets: int = 1) -> DataFrame:
    terms = documents.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.withColumn("with_digits", pairs_of_digits(F.col("term")))


def endings_table(documents: DataFrame, buckets: int = 1) -> DataFrame:
    return vocabulary_table(documents).select(F.reverse("term").alias("reversed"), "df")


def name_keys_table(documents: DataFrame, buckets: int = 1) -> DataFrame:
    return documents.select(F.explode(keys_of_names(F.col("filename_words"))).alias("key")).groupBy("key").agg(F.count("*").alias("df"))


def types_table(documents: DataFrame, buckets: int = 1) -> DataFrame:
    return documents.groupBy("ext").agg(F.count("*").alias("n"))


DERIVED = {"postings": postings_table, "names": names_table, "vocabulary": vocabulary_table, "endings": endings_table, "name_keys": name_keys_table, "types": types_table}


def counted(words: Column) -> Column:
    """The distinct words of an array in order, each with its count: runs of the ordered words, so no word leaves its row."""
    ordered = F.sort_array(words)
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, s: F.transform(s, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w)) - i).alias("term_count")))
    with_starts = F.transform(F.array(ordered), lambda w: F.struct(w.alias("w"), F.when(F.size(w) > 0, starts(w)).otherwise(F.array().cast("array<int>")).alias("s")))
    return F.get(F.transform(with_starts, lambda x: runs(x["w"], x["s"])), 0).cast(TERMS)


def build_index(texts: DataFrame) -> Index:
    """texts(filename, path, text, page_texts array<struct<page int, text string>>, doc_seq). Documents without a content token are left out.

    A document's row holds its terms with their counts, so that a document's postings are known without a look at those of
    others. Terms are counted where the text is; only counts of the whole corpus move.
    """
    # A look for two letters or digits side by side ends at the first ones; tokens are made only where they are needed.
    texts = texts.where(F.lower("text").rlike(f"{RUN[:-1]}{{2}}"))
    base = texts.withColumn("words", content_tokens(F.col("text")))
    kept = F.filter("page_texts", lambda p: strip(p["text"]) != "")
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(p["page"].cast("int").alias("page_number"), F.lower(p["text"]).alias("text"))))
    documents = base.select(
        "filename",
        F.col("filename").alias("title"),
        "path",
        F.size("words").cast("int").alias("total_words"),
        F.size(kept).cast("int").alias("page_count"),
        name_tokens(stem(F.col("filename"))).alias("filename_words"),
        extension(F.col("filename")).alias("ext"),
        F.col("doc_seq").cast("long").alias("doc_seq"),
        counted(F.col("words")).alias("terms"),
    )
    lists = texts.where(F.size(kept) > 0).select("filename", ordered.alias("page_list"))
    return Index(documents, page_rows(lists), body_rows(lists), texts=texts, page_lists=lists)


def counters(index: Index) -> DataFrame:
    """One row: documents, content_terms, filenames_indexed, page_text_entries."""
    d = index.types().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
    t = index.vocabulary().agg(F.count("*").alias("content_terms"))
    p = index.documents.where("page_count > 0").agg(F.count("*").alias("page_text_entries"))
    return d.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(p)).select("documents", "content_terms", F.col("documents").alias("filenames_indexed"), "page_text_entries")
