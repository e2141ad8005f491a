"""JSON snapshots of an index: four tables as JSON objects.

inverted_index maps a term to its documents' counts, document_meta a name to its metadata, filename_index a name to its
tokens, page_text a name to its pages. Written, each table is a folder of lines, in gzip, that are objects with one key; a frequent term has several
lines, each with some of its documents. A file that is one object for the whole table, on one line or many, is read as well, by a
task for each split. A table that is missing leaves what is current, a damaged one counts as empty, the others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, extension
from ..operators.index import Index
from ..operators.queries import tidy
from ..schemas import TERMS

#: Table name -> type of the values.
TABLES = {
    "inverted_index": "map<string,int>",
    "document_meta": "struct<title:string,path:string,total_words:int,page_count:int>",
    "filename_index": "array<string>",
    "page_text": "array<struct<page:int,text:string>>",
}
#: Documents of a term on one line.
LINE_DOCUMENTS = 100_000


def write_json(index: Index, folder: str, only: tuple[str, ...] = tuple(TABLES)) -> None:
    """only: the tables that are written. Plain lines would take several times the room of the index."""
    pairs = lambda *c: F.map_from_entries(F.collect_list(F.struct(*c)))
    pages = F.transform("page_list", lambda p: F.struct(p["page_number"].alias("page"), p["text"].alias("text")))
    lines = index.vocabulary().select("term", F.ceil(F.col("df") / LINE_DOCUMENTS).alias("lines"))
    postings = index.postings.join(lines, "term").withColumn("line", F.pmod(F.xxhash64("filename"), F.col("lines")))
    tables = {
        "inverted_index": postings.groupBy(F.col("term").alias("key"), "line").agg(pairs("filename", "term_count").alias("value")).drop("line"),
        "document_meta": index.documents.select(F.col("filename").alias("key"), F.struct("title", "path", "total_words", "page_count").alias("value")),
        "filename_index": index.documents.select(F.col("filename").alias("key"), F.col("filename_words").alias("value")),
        "page_text": index.lists().select(F.col("filename").alias("key"), pages.alias("value")),
    }
    for name in only:
        lines = tables[name].select(F.to_json(F.create_map("key", "value")).alias("value"))
        with tidy(lines.sparkSession):
            lines.write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{name}.json")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects as the members of one, line by line; no more than a batch is held."""
    lines, first = lambda v: pa.RecordBatch.from_arrays([pa.array(v, pa.string()) if isinstance(v, list) else v], ["value"]), True
    yield lines(["{"])
    for batch in batches:
        members = pc.utf8_slice_codeunits(pc.utf8_trim_whitespace(batch["value"]), 1, -1)
        members = members.filter(pc.not_equal(pc.utf8_trim_whitespace(members), ""))
        if len(members):
            commas = pa.array(["" if first else ",", *[","] * (len(members) - 1)])
            yield lines(pc.binary_join_element_wise(commas, members, ""))
            first = False
    yield lines(["}"])


def one_object(lines: DataFrame) -> DataFrame:
    """value: the lines of a file that holds the objects of lines(value) as one. One file has one writer, which streams."""
    return lines.coalesce(1).mapInArrow(_joined, "value string")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """key, value; empty if the table is damaged, None if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    empty = spark.createDataFrame([], f"key string, value {TABLES[name]}")
    if fs.getFileStatus(path).isFile():
        lines = _members(spark, path.toString(), fs.getFileStatus(path).getLen(), "]" if TABLES[name].startswith("array") else "}")
        if lines is None:
            return empty
    else:
        lines = spark.read.text(f"{folder}/{name}.json")
    parsed = lines.select(F.from_json("value", f"map<string,{TABLES[name]}>").alias("m"))
    # One job over all lines: a look for the first damaged one would go through a sound table part after part.
    with tidy(spark):
        damaged = parsed.agg(F.max(F.col("m").isNull())).first()[0]
    return empty if damaged else parsed.select(F.explode("m"))


def _bare(fragment: str) -> tuple[str, str, bool]:
    """What of a fragment stands outside strings, if it begins outside one and if it begins inside; and whether it has the quote of one end only."""
    if "\\" in fragment:
        fragment = re.sub(r"\\.", "", fragment, flags=re.DOTALL)
    parts = fragment.split('"')
    return "".join(parts[::2]), "".join(parts[1::2]), len(parts) % 2 == 0


def _deeper(bare: str) -> int:
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of fragments, for a beginning outside and inside a string: how much deeper it ends, whether inside, and how many fragments end at which depth; with their number and bytes."""
    at: dict[tuple[int, bool], list] = {}
    for batch in batches:
        for block, value, size in zip(batch["block"].to_pylist(), batch["value"].to_pylist(), pc.binary_length(batch["value"]).to_pylist(), strict=True):
            outside, within, odd = _bare(value)
            for begin in (False, True):
                state = at.setdefault((block, begin), [0, begin, Counter(), 0, 0])
                state[0] += _deeper(within if state[1] else outside)
                state[1] ^= odd
                if not state[1]:
                    state[0] -= 1
                    state[2][state[0]] += 1
                state[3] += 1
                state[4] += size + 1
    rows = [(block, begin, *state[:2], list(state[2].items()), *state[3:]) for (block, begin), state in at.items()]
    kind = pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())]))
    columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.bool_()), (2, pa.int64()), (3, pa.bool_()), (5, pa.int64()), (6, pa.int64()))]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([[{"depth": d, "n": n} for d, n in r[4]] for r in rows], kind)], ["block", "begin", "deeper", "inside", "fragments", "bytes", "ends"])


def _members(spark: SparkSession, path: str, size: int, close: str) -> DataFrame | None:
    """value: the members of the object that a file holds, some to an object of their own; None if the file isn't one object. size: its bytes. close: what the members' values end with.

    The file is read as fragments up to each `close`, so its splits are read by different tasks on whatever line breaks it has. A first
    pass says of each split what it does to depth and quotes; from these few numbers follow the state at the beginning of each, and the number
    of the piece there. A piece is what stands up to a `close` that ends a member, so mostly one member; the second pass puts pieces together where they are read,
    and only where one goes on in the next split are those of one number brought together.
    """
    fragments = spark.read.option("lineSep", close).text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")
    told = {(r.block, r.begin): r for r in fragments.mapInArrow(_summaries, "block long, begin boolean, deeper long, inside boolean, fragments long, bytes long, ends array<struct<depth long, n long>>").collect()}
    states, depth, inside, piece, whole = {}, 0, False, 0, True
    blocks = sorted({b for b, _ in told})
    # What stands behind the last `close` of the file is a fragment that no `close` follows.
    rest = sum(told[b, False].bytes for b in blocks) != size
    for block in blocks:
        r = told[block, inside]
        states[block] = (depth, inside, piece, r.fragments if rest and block == blocks[-1] else 0)
        piece += sum(e.n for e in r.ends if e.depth + depth in (0, 1))
        depth, inside = depth + r.deeper, r.inside
        whole &= block == blocks[-1] or depth in (0, 1) and not inside
    if depth + (rest and not inside) or inside or not blocks:
        return None
    known = spark.sparkContext.broadcast(states)
    first = blocks[0]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, list] = {}
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["piece", "block", "value", "good"])

        def ended(block: int, state: list, ends: bool) -> tuple:
            """A piece, or what of it stands in this block, without what parts it from its neighbours."""
            text, good, begins, zero = "".join(state[4]), True, state[5], state[6]
            if begins:
                text = text.lstrip()
                if zero:
                    good = text.startswith("{") if block == first and state[2] == 0 else not text
                    text = text[1:]
                elif not text.startswith("}"):
                    good = text.startswith(",")
                    text = text[1:]
            if ends and state[0] == 0 and text:
                text = text.rstrip()
                good &= text.endswith("}")
                text = text[:-1]
            return state[2], block, text, good

        for batch in batches:
            rows = []
            for block, value in zip(batch["block"].to_pylist(), batch["value"].to_pylist(), strict=True):
                state = now.get(block)
                if state is None:  # depth, inside, piece, fragments to the one without a close, parts, whether they begin the piece, at depth 0
                    d, i, n, left = known.value[block]
                    state = now[block] = [d, i, n, left, [], d in (0, 1) and not i, d == 0]
                outside, within, odd = _bare(value)
                state[0] += _deeper(within if state[1] else outside)
                state[1] ^= odd
                state[3] -= 1
                state[4].append(value)
                if state[3] != 0:
                    state[4].append(close)
                    state[0] -= not state[1]
                if not state[1] and (state[0] in (0, 1) or state[3] == 0):
                    rows.append(ended(block, state, True))
                    state[2:] = [state[2] + 1, state[3], [], True, state[0] == 0]
            if rows:
                yield batch_of(rows)
        yield batch_of([ended(block, state, False) for block, state in now.items() if state[4]])

    parts = fragments.mapInArrow(put_together, "piece long, block long, value string, good boolean")
    if not whole:
        parts = parts.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "").alias("value"), F.bool_and("good").alias("good"))
    return parts.where("NOT good OR trim(value) <> ''").select(F.when(F.col("good"), F.concat(F.lit("{"), "value", F.lit("}"))).alias("value"))


def load_json(spark: SparkSession, folder: str, current: Index | None = None) -> Index:
    """The index of a snapshot. current: what tables that the snapshot lacks are taken from; without it they are empty."""
    found = {name: _table(spark, folder, name) for name in TABLES}
    empty = {name: spark.createDataFrame([], f"key string, value {kind}") for name, kind in TABLES.items()}
    terms, meta, words, pages = (found[n] if found[n] is not None else empty[n] for n in TABLES)
    if found["inverted_index"] is None and current is not None:
        counts = current.documents.select("filename", "terms")
    else:
        each = terms.select(F.col("key").alias("term"), F.explode("value").alias("filename", "term_count"))
        counts = each.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("term", "term_count"))).cast(TERMS).alias("terms"))
    if found["filename_index"] is None and current is not None:
        named = current.documents.select("filename", "filename_words")
    else:
        named = words.select(F.col("key").alias("filename"), F.col("value").alias("filename_words"))
    if found["document_meta"] is None and current is not None:
        documents = current.documents.drop("terms", "filename_words")
    else:
        documents = meta.select(F.col("key").alias("filename"), "value.title", "value.path", "value.total_words", "value.page_count", extension(F.col("key")).alias("ext"), F.xxhash64("key").alias("doc_seq"))
    documents = documents.join(counts, "filename", "left").join(named, "filename", "left")
    documents = documents.withColumn("terms", F.coalesce("terms", F.array().cast(TERMS))).withColumn("filename_words", F.coalesce("filename_words", F.array().cast("array<string>")))
    if found["page_text"] is None and current is not None:
        return Index(documents, current.pages, current.bodies)
    bodies = pages.where(F.size("value") > 0).select(F.col("key").alias("filename"), collapse(F.array_join(F.transform(F.array_sort("value"), lambda p: F.lower(p["text"])), " ")).alias("body"))
    each = pages.select(F.col("key").alias("filename"), F.explode("value").alias("p")).select("filename", F.col("p.page").alias("page_number"), F.col("p.text").alias("text"))
    return Index(documents, each, bodies)
