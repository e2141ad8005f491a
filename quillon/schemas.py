"""Tables of an index: those that make it up, and those derived from them that searches look things up in."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql.types import StructType

TERMS = "array<struct<term string, term_count int>>"
DOCUMENTS = f"filename string, title string, path string, total_words int, page_count int, filename_words array<string>, ext string, doc_seq bigint, terms {TERMS}"
PAGES = "filename string, page_number int, text string"
BODIES = "filename string, body string"
#: How pages are stored: a row for each document, which its pages and its body are made from.
PAGE_LISTS = "filename string, page_list array<struct<page_number:int,text:string>>"
#: Postings carry what scoring needs of their documents.
POSTINGS = "term string, filename string, term_count int, total_words int, ext string, doc_seq bigint, bucket int"
#: key: t: and a word of a file name, or g: and three characters of the words joined by spaces.
NAMES = "key string, filename string, filename_words array<string>, ext string, doc_seq bigint, bucket int"
#: Counts are signed: what a segment adds to them. with_digits: a term has two digits side by side.
VOCABULARY = "term string, df bigint, with_digits boolean"
ENDINGS = "reversed string, df bigint"
NAME_KEYS = "key string, df bigint"
TYPES = "ext string, n bigint"
TOMBSTONES = "filename string"
TABLES = {"documents": DOCUMENTS, "pages": PAGES, "bodies": BODIES, "page_lists": PAGE_LISTS, "postings": POSTINGS, "names": NAMES, "vocabulary": VOCABULARY, "endings": ENDINGS, "name_keys": NAME_KEYS, "types": TYPES, "tombstones": TOMBSTONES}
#: What each table is laid out by inside its files; partition folders come first.
LAYOUT = {"documents": "filename", "pages": "filename", "bodies": "filename", "postings": "term", "names": "key", "vocabulary": "term", "endings": "reversed", "name_keys": "key", "types": "ext", "tombstones": "filename"}
FOLDERS = {"postings": "bucket", "names": "bucket", "vocabulary": "with_digits"}
VERSION = 3
#: Versions whose manifests name segments; those of 2 have pages and bodies as tables of their own, and are read as they are.
SEGMENTED = (2, 3)


@lru_cache
def struct(ddl: str) -> StructType:
    """The type that a schema's text says; Spark parses it once."""
    return StructType.fromDDL(ddl)
