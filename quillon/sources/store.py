"""An index as segments: Parquet folders that are written once, and numbered manifests that say which of them are current.

A rebuild writes one segment. A change writes a small one on top: the new documents with their own tables, the names that it
takes away from all segments below (tombstones), and signed counts of what it adds to the vocabulary, the keys of names and the
file types. Readers merge: a row lives if no later segment has its document's name among its tombstones, counts are
summed. Once MERGE segments of like size stand in a row they become one.

All files of a segment are written before a manifest is created under a number that nobody has yet, on condition that it doesn't
exist; of two writers the second one looks at what the first has published and tries again. A manifest has the bytes and rows
of each table, so a damaged segment is seen, and the newest generation that is whole serves. The last KEEP generations stay.
Manifests of older versions are read through the steps in UPGRADES; what these bring together by document is written once, in the
old folder, and goes with it. Paths are Hadoop paths.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.index import DERIVED, FEW_VALUES, Index, body_rows, build_index, listed, page_rows
from ..operators.queries import observed, tidy
from ..schemas import FOLDERS, LAYOUT, PAGE_LISTS, SEGMENTED, TABLES, TERMS, VERSION, struct

KEEP = 3
#: So many segments of one size class in a row are merged; a class spans a factor of MERGE.
MERGE = 4
#: Postings of a bucket, before a segment gets more of them.
BUCKET_ROWS, MOST_BUCKETS = 250_000, 4096
#: Postings are dealt out in up to so many passes of PASS_BUCKETS buckets or more, as their shuffle is larger than all files of a segment.
PASSES, PASS_BUCKETS = 8, 4
#: Bytes of an old folder's files for each pass that brings them together by document; fewer are brought together when they are read.
PASS_BYTES = 4 << 20
#: Up to so many tombstones are broadcast.
FEW_TOMBSTONES = 200_000
ATTEMPTS = 20
#: Bytes of texts of a range of names; fewer than SMALL_BYTES are one range.
TEXT_BYTES, SMALL_BYTES = 64 << 20, 1 << 20
#: How a segment's files are compressed: texts take two thirds of what they take by Spark's default.
CODEC = "zstd"
#: Tables that are stored in another form than they are read in, and those that are made from the stored pages.
STORED, FROM_PAGES = {"pages": PAGE_LISTS}, ("pages", "bodies", "page_lists")
#: Tables that count, with their counts.
SIGNED = {"vocabulary": "df", "endings": "df", "name_keys": "df", "types": "n"}


class IncompleteSnapshot(ValueError):
    """A generation lacks a table, or part of one."""


class Conflict(OSError):
    """Someone else has published this generation."""


def empty_index(spark: SparkSession) -> Index:
    return Index(*[spark.createDataFrame([], TABLES[t]) for t in ("documents", "pages", "bodies")])


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # Manifests

    def _numbers(self) -> list[int]:
        """The generations with a manifest, newest first."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json"))
        return sorted((int(x.getPath().getName()[9:-5]) for x in found or ()), reverse=True)

    def _manifest_path(self, number: int):
        return self._path(f"{self.root}/manifest-{number:010d}.json")

    def manifest(self, number: int) -> dict:
        return self._json(self._manifest_path(number))

    def _json(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, segments: list[dict]) -> int:
        """Creates the manifest of a generation, or raises Conflict if there is one."""
        part = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(self.root))
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"version": VERSION, "generation": number, "segments": segments}).encode()))
        out.close()
        final = self._manifest_path(number)
        try:
            if self._fs.getScheme() == "file":
                source, target = (self._path.getPathWithoutSchemeAndAuthority(self._fs.makeQualified(p)).toString() for p in (part, final))
                os.link(source, target)
            else:
                fc = self.spark.sparkContext._jvm.org.apache.hadoop.fs
                fc.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(part, final, self._none_option())
        except FileExistsError as e:
            raise Conflict(f"generation {number} was published by someone else") from e
        except Py4JJavaError as e:
            if self._fs.exists(final):
                raise Conflict(f"generation {number} was published by someone else") from e
            raise
        finally:
            self._fs.delete(part, False)
        self._retire()
        return number

    def _none_option(self):
        gateway = self.spark.sparkContext._gateway
        kind = getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        return options

    def _retire(self) -> None:
        """Older generations go, with the segments that only they have."""
        numbers = self._numbers()
        folders = lambda some: {f for n in some for f in self._folders(n)}
        gone = {f for f in folders(numbers[KEEP:]) - folders(numbers[:KEEP]) if not _elsewhere(f)}
        for n in numbers[KEEP:]:
            self._fs.delete(self._manifest_path(n), False)
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/{f}"), True)

    def _folders(self, number: int) -> list[str]:
        try:
            m = self.manifest(number)
            return [m["folder"]] if m.get("version", 1) == 1 else [s["folder"] for s in m["segments"]]
        except (ValueError, KeyError, TypeError, Py4JJavaError):
            return []

    def generation(self) -> int:
        return next(iter(self._numbers()), 0)

    # Reading

    def _whole(self, segments: list[dict]) -> list[dict]:
        for s in segments:
            for t, has in s["tables"].items():
                path = self._path(f"{self._at(s['folder'])}/{t}")
                now = self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else -1
                if now != has["bytes"]:
                    raise IncompleteSnapshot(f"{path.toString()} has {now} bytes instead of {has['bytes']}")
        return segments

    def current(self) -> tuple[int, list[dict]]:
        """(number, segments) of the newest generation that is whole; (0, []) if there is none at all."""
        last: Exception | None = None
        for number in self._numbers():
            try:
                m = self.manifest(number)
                return number, self._whole(m["segments"]) if m.get("version", 1) in SEGMENTED else [{"old": m}]
            except (ValueError, KeyError, TypeError, Py4JJavaError) as e:
                last = e
        if last:
            raise IncompleteSnapshot("no generation can be read") from last
        return 0, []

    def load(self) -> Index | None:
        """The newest generation that can be read, or None if nothing was ever published."""
        number, segments = self.current()
        if not number:
            return None
        return self._index(segments)

    def _index(self, segments: list[dict]) -> Index:
        if segments and "old" in segments[0]:
            return UPGRADES[segments[0]["old"].get("version", 1)](self, segments[0]["old"])
        if not segments:
            return empty_index(self.spark)
        own = [self._live(t, segments) for t in ("documents", "pages", "bodies")]
        return Index(*own, lambda name, keep: self._live(name, segments, keep), page_lists=self._live("page_lists", segments))

    def _parts(self, name: str, segments: list[dict], keep: Callable[[DataFrame, int], DataFrame] = lambda t, _: t) -> list[tuple[dict, DataFrame]]:
        """The segments that have rows of a table, each with that table."""
        some = [s for s in segments if _rows(s, name)]
        return [(s, keep(self._table(s, name), s["buckets"])) for s in some]

    def _table(self, segment: dict, name: str) -> DataFrame:
        """A table of a segment. Pages stand as one row for each document, from which bodies are made too; segments of version 2 have both as tables."""
        if name not in FROM_PAGES:
            return self._read(segment["folder"], name)
        if "bodies" in segment["tables"]:
            return listed(self._read(segment["folder"], "pages")) if name == "page_lists" else self._read(segment["folder"], name)
        lists = self.spark.read.schema(STORED["pages"]).parquet(f"{self._at(segment['folder'])}/pages")
        return {"pages": page_rows, "bodies": body_rows, "page_lists": lambda x: x}[name](lists)

    def _live(self, name: str, segments: list[dict], keep: Callable[[DataFrame, int], DataFrame] = lambda t, _: t) -> DataFrame:
        """A table of all segments together. keep: narrows each part before they meet."""
        parts = self._parts(name, segments, keep)
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        tables = [t for _, t in parts]
        if name in SIGNED:
            return tables[0] if len(parts) == 1 else self._summed(name, tables).where(F.col(SIGNED[name]) > 0)
        tombstones = [(s, t) for s, t in self._parts("tombstones", segments) if s["seq"] > parts[0][0]["seq"]]
        if not tombstones:
            return _union(tables)
        # Only what stands below the last tombstones can be dead.
        last = tombstones[-1][0]["seq"]
        dead = _union([t.select(F.col("filename").alias("gone_"), F.lit(s["seq"]).alias("dead_")) for s, t in tombstones])
        if sum(_rows(s, "tombstones") for s, _ in tombstones) <= FEW_TOMBSTONES:
            dead = F.broadcast(dead)
        old = _union([t.withColumn("seq_", F.lit(s["seq"])) for s, t in parts if s["seq"] < last])
        old = old.join(dead, (old["filename"] == F.col("gone_")) & (old["seq_"] < F.col("dead_")), "left_anti").select(*tables[0].columns)
        return _union([old, *[t for s, t in parts if s["seq"] >= last]])

    def _summed(self, name: str, tables: list[DataFrame]) -> DataFrame:
        count = SIGNED[name]
        keys = [c for c in tables[0].columns if c != count]
        return _union(tables).groupBy(*keys).agg(F.sum(count).alias(count)).select(*tables[0].columns)

    def term_counts(self, filename: str) -> DataFrame:
        """term, term_count of one document, from its own row."""
        return self.load().documents_of([filename]).select(F.explode("terms").alias("t")).select("t.term", "t.term_count")

    def count_documents(self) -> int:
        now = self.load()
        return (now.types().agg(F.sum("n")).first()[0] or 0) if now else 0

    # Writing

    def publish(self, index: Index, since: int | None = None) -> int:
        """Writes a whole index as one segment and makes it current.

        since: the generation that this index was made beside. What others have published after it is put on top; without it, that goes.
        Conflict: they have also merged their changes into what was there before.
        """
        if any(t is None for t in (index.documents, index.pages, index.bodies)):
            raise IncompleteSnapshot("documents, pages and bodies are all needed")
        base = self._write(0, index, None, None)
        known = max((s["seq"] for s in self._segments_of(since)), default=0) if since is not None else None
        for _ in range(ATTEMPTS):
            number, segments = self._last()
            later = [s for s in segments if "old" not in s and s["seq"] > known] if known is not None else []
            top = max((s.get("seq", 0) for s in segments), default=0) + 1
            base |= {"seq": top, "low": top}
            if any(s["low"] <= known for s in later):
                self._drop([base])
                raise Conflict("changes were merged with what this index replaces")
            now = [base]
            if later:
                now.append(self._delta(now, self._index(later), self._tombstones(later), top + 1))
            try:
                return self._commit(number + 1, now)
            except Conflict:
                self._drop(now[1:])
        raise Conflict("others publish all the time")

    def share(self, other: Store) -> int:
        """Begins this store with what another one serves. Segments never change, so they are named by their places instead of copied; changes go here, and only the other store deletes what is its own.

        The other store must keep that generation for as long as this one names its segments; rebuild() and compact() end that.
        """
        number, segments = other._last()
        if self.generation():
            raise Conflict("only an empty store can begin with another one's segments")
        if not number or segments and "old" in segments[0] or other._fs.getUri().toString() != self._fs.getUri().toString():
            return self.publish(other.load() or empty_index(self.spark))
        place = lambda f: f if _elsewhere(f) else other._fs.makeQualified(other._path(f"{other.root}/{f}")).toString()
        return self._commit(1, [s | {"folder": place(s["folder"])} for s in segments])

    def _at(self, folder: str) -> str:
        """The place of a segment: under the root, or another store's."""
        return folder if _elsewhere(folder) else f"{self.root}/{folder}"

    def _segments_of(self, number: int) -> list[dict]:
        try:
            return self.manifest(number).get("segments", [])
        except Py4JJavaError:
            return []

    def _last(self) -> tuple[int, list[dict]]:
        """The number that the next generation follows, and the segments that are served. If nothing can be read, a whole index starts anew."""
        try:
            segments = self.current()[1]
        except IncompleteSnapshot:
            segments = []
        return self.generation(), segments

    def _tombstones(self, segments: list[dict]) -> DataFrame:
        parts = [t for _, t in self._parts("tombstones", segments)]
        return _union(parts or [self.spark.createDataFrame([], TABLES["tombstones"])]).distinct()

    def upsert(self, new: Index) -> int:
        """Puts the documents of an index in or replaces those of the same names."""
        return self._change(lambda segments, seq: self._delta(segments, new, None, seq))

    def remove(self, names: DataFrame) -> int:
        """Takes the documents in names(filename) out."""
        return self._change(lambda segments, seq: self._delta(segments, None, names.select("filename").distinct(), seq))

    def _change(self, make: Callable[[list[dict], int], dict]) -> int:
        def put(segments: list[dict], made: list[dict]) -> list[dict]:
            made.append(make(segments, max((s["seq"] for s in segments), default=0) + 1))
            return self._merged([*segments, made[-1]], made)

        return self._change_to(put)

    def _change_to(self, make: Callable[[list[dict], list[dict]], list[dict]]) -> int:
        """Publishes what `make` makes of the current segments; again, if someone else was faster. make notes each segment that it writes."""
        for _ in range(ATTEMPTS):
            number, segments = self.generation(), self.current()[1]
            if segments and "old" in segments[0]:
                self.publish(self._index(segments))
                continue
            made: list[dict] = []
            now = make(segments, made)
            if now == segments:
                return number
            try:
                done = self._commit(number + 1, now)
            except Conflict:
                self._drop(made)
            else:
                self._drop([s for s in made if s not in now])
                return done
        raise Conflict("others publish all the time")

    def _drop(self, segments: list[dict]) -> None:
        for s in segments:
            self._fs.delete(self._path(f"{self.root}/{s['folder']}"), True)

    def _delta(self, segments: list[dict], new: Index | None, names: DataFrame | None, seq: int) -> dict:
        """A segment over others that takes `names` and all names of `new` out of them and puts `new` in."""
        now = self._index(segments)
        rows = None
        if new is not None:
            folder = f"seg-{uuid.uuid4().hex}"
            new, dealt = self._staged(folder, new)
            rows = self._put(folder, "documents", new.documents, dealt)
            mine = self._read(folder, "documents").select("filename")
            names = mine if names is None else mine.unionByName(names).distinct()
        few = names.take(FEW_VALUES + 1)
        known = now.documents_of([r.filename for r in few] if len(few) <= FEW_VALUES else None)
        # The documents have their terms, so that names go to them wherever these aren't too many.
        narrow = len(few) <= FEW_VALUES or names.count() <= FEW_TOMBSTONES
        gone = known.join(F.broadcast(names) if narrow else names, "filename", "left_semi")
        return self._write(seq, new, names, gone, (folder, rows, dealt) if new is not None else None)

    def _read(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self._at(folder)}/{name}")

    def _staged(self, folder: str, new: Index) -> tuple[Index, bool]:
        """An index over texts that are written in ranges of names, so that they are dealt out once and what is made of them stays in place; and whether it is so."""
        if new.texts is None:
            return new, False
        size = _bytes(new.texts)
        # A text that is nothing but its pages, line by line, is dealt out and written once, as these.
        pages = F.array_join(F.transform("page_texts", lambda p: p["text"]), "\n")
        same = F.coalesce(F.col("text") == pages, F.lit(False))
        columns = ["filename", "path", F.when(~same, F.col("text")).alias("text"), "page_texts", "doc_seq", same.alias("same")]
        n = [] if size >= 1 << 60 else [max(self.spark.sparkContext.defaultParallelism, min(-(-size // TEXT_BYTES), 200_000))] if size > SMALL_BYTES else [1]
        rows = new.texts.select(*columns)
        self._save(rows.repartitionByRange(*n, "filename").sortWithinPartitions("filename"), f"{folder}/texts")
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}/texts")
        return build_index(staged.withColumn("text", F.when(F.col("same"), pages).otherwise(F.col("text"))).drop("same")), True

    def _save(self, df: DataFrame, at: str, by: str | None = None) -> None:
        """Writes files under the root; the shuffle that dealt their rows goes with the job."""
        with tidy(self.spark):
            out = df.write.mode("append").option("compression", CODEC)
            (out.partitionBy(by) if by else out).parquet(f"{self.root}/{at}")

    def _put(self, folder: str, name: str, df: DataFrame, dealt: bool = False) -> dict:
        """Writes a table of a segment in its layout; what the manifest says of it. dealt: its rows stand in ranges already."""
        seen, many = Observation(), [F.count(F.lit(1)).alias("rows")]
        if name == "documents":
            many.append(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"))
        order = [*([FOLDERS[name]] if name in FOLDERS else []), LAYOUT[name]]
        out = df.select(*struct(STORED.get(name, TABLES[name])).names)
        out = (out if dealt else out.repartitionByRange(*order)).sortWithinPartitions(*order).observe(seen, *many)
        self._save(out, f"{folder}/{name}", FOLDERS.get(name))
        path = self._path(f"{self.root}/{folder}/{name}")
        return {**observed(seen, lambda: self._read(folder, name).agg(*many).first().asDict()), "bytes": self._fs.getContentSummary(path).getLength()}

    def _put_postings(self, folder: str, documents: DataFrame, buckets: int, rows: int) -> dict:
        """The postings of a segment's documents, laid out as by one write, but the shuffle of a pass goes before the next begins. rows: so many there are."""
        name, order = "postings", [FOLDERS["postings"], LAYOUT["postings"]]
        every = DERIVED[name](documents, buckets).select(*struct(TABLES[name]).names)
        passes = max(1, min(PASSES, buckets // PASS_BUCKETS))
        # By hash, as ranges would be looked for by making all postings of a pass once more; few buckets are split by term, so that all cores have some.
        parts = max(1, min(8, self.spark.sparkContext.defaultParallelism * passes // buckets)) if rows > BUCKET_ROWS else 1
        part = F.floor(F.crc32(F.col("term").cast("binary")) / buckets) % parts
        for k in range(passes):
            some = every.where(F.col("bucket") % passes == k) if passes > 1 else every
            self._save(some.repartition(FOLDERS[name], part).sortWithinPartitions(*order), f"{folder}/{name}", FOLDERS[name])
        return {"rows": rows, "bytes": self._fs.getContentSummary(self._path(f"{self.root}/{folder}/{name}")).getLength()}

    def _write(self, seq: int, new: Index | None, names: DataFrame | None, gone: DataFrame | None, begun: tuple[str, dict, bool] | None = None) -> dict:
        """Writes a segment: the documents of `new`, tombstones for `names`, and counts without those of the documents `gone`."""
        folder, tables, dealt = begun[0] if begun else f"seg-{uuid.uuid4().hex}", {}, False
        if begun:
            tables["documents"], dealt = begun[1:]
        elif new is not None:
            new, dealt = self._staged(folder, new)
            tables["documents"] = self._put(folder, "documents", new.documents, dealt)
        documents = self._read(folder, "documents") if tables else self.spark.createDataFrame([], TABLES["documents"])
        terms = tables.get("documents", {}).pop("terms", 0)
        buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, terms / BUCKET_ROWS)))))
        if gone is not None:  # written, as three counts are taken from it
            self._save(gone, f"{folder}/gone")
            gone = self.spark.read.schema(TABLES["documents"]).parquet(f"{self.root}/{folder}/gone")

        def signed(name: str) -> DataFrame:
            count = SIGNED[name]
            plus = DERIVED[name](documents, buckets)
            if gone is None:
                return plus
            keys = [c for c in plus.columns if c != count]
            both = plus.unionByName(DERIVED[name](gone, buckets).withColumn(count, -F.col(count)))
            return both.groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) != 0)

        if new is not None:  # the texts go before the tables that are dealt anew need room
            tables["pages"] = self._put(folder, "pages", new.lists(), dealt)
            self._fs.delete(self._path(f"{self.root}/{folder}/texts"), True)
        work = {name: (lambda name=name: self._put(folder, name, signed(name))) for name in ("vocabulary", "name_keys", "types")}
        if names is not None:
            work["tombstones"] = lambda: self._put(folder, "tombstones", names)
        tables |= _at_once(work)
        self._fs.delete(self._path(f"{self.root}/{folder}/gone"), True)
        work = {"endings": lambda: self._put(folder, "endings", self._read(folder, "vocabulary").select(F.reverse("term").alias("reversed"), "df"))}
        if new is not None:
            work["names"] = lambda: self._put(folder, "names", DERIVED["names"](documents, buckets))
        tables |= _at_once(work)
        if new is not None:
            tables["postings"] = self._put_postings(folder, documents, buckets, terms)
        return {"folder": folder, "seq": seq, "low": seq, "buckets": buckets, "tables": tables}

    # Older versions

    def _by_document(self, folder: str, made: dict[str, Callable[[Callable[[DataFrame], DataFrame]], DataFrame]], size: int) -> dict[str, DataFrame]:
        """Tables that are made of an old folder's by bringing rows together by document. made: makes each from the part of its sources that a function takes. size: bytes of the sources.

        All at once, their shuffles are larger than the old folder; so they are written in passes over the names, and found there by the next reader. Where nothing can be written, they are made when they are read.
        """
        passes = min(PASSES, size // PASS_BYTES)
        at = passes > 1 and (self._brought(folder, list(made)) or self._bring(folder, made, passes))
        return {name: self._read(at, name) if at else make(lambda t: t) for name, make in made.items()}

    def _brought(self, folder: str, names: list[str]) -> str | None:
        """Where an old folder has these tables whole."""
        for x in self._fs.globStatus(self._path(f"{self.root}/{folder}/by-document-*/whole.json")) or ():
            at = f"{folder}/{x.getPath().getParent().getName()}"
            try:
                has = self._json(x.getPath())
                if all(self._fs.getContentSummary(self._path(f"{self.root}/{at}/{n}")).getLength() == has[n] for n in names):
                    return at
            except (ValueError, KeyError, TypeError, Py4JJavaError):
                continue
        return None

    def _bring(self, folder: str, made: dict[str, Callable[[Callable[[DataFrame], DataFrame]], DataFrame]], passes: int) -> str | None:
        at = f"{folder}/by-document-{uuid.uuid4().hex}"
        try:
            if not self._fs.mkdirs(self._path(f"{self.root}/{at}")):
                return None
        except Py4JJavaError:
            return None
        try:
            for name, make in made.items():
                for k in range(passes):
                    some = make(lambda t: t.where(F.pmod(F.xxhash64("filename"), F.lit(passes)) == k))  # noqa: B023
                    self._save(some.select(*struct(TABLES[name]).names).sortWithinPartitions("filename"), f"{at}/{name}")
            has = {name: self._fs.getContentSummary(self._path(f"{self.root}/{at}/{name}")).getLength() for name in made}
            out = self._fs.create(self._path(f"{self.root}/{at}/whole.json"), True)
            out.write(bytearray(json.dumps(has).encode()))
            out.close()
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/{at}"), True)
            raise
        return at

    # Merging

    def _merged(self, segments: list[dict], made: list[dict]) -> list[dict]:
        """The segments with the newest ones made one, for as long as MERGE of them are no larger in class than the newest."""
        while True:
            top, n = _size_class(segments[-1]), 1
            while n < len(segments) and _size_class(segments[-n - 1]) <= top:
                n += 1
            if n < MERGE:
                return segments
            made.append(self._merge(segments[-n:], whole=n == len(segments)))
            segments = [*segments[:-n], made[-1]]

    def _merge(self, tail: list[dict], whole: bool) -> dict:
        """One segment with what is alive in several that follow one another. whole: nothing is below them, so tombstones can go."""
        live = self._index(tail)
        folder, seq, low = f"seg-{uuid.uuid4().hex}", tail[-1]["seq"], tail[0]["low"]
        if whole:
            return self._write(seq, live, None, None) | {"low": low}
        tables = {"documents": self._put(folder, "documents", live.documents)}
        terms = tables["documents"].pop("terms")
        buckets = min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, terms / BUCKET_ROWS)))))
        documents = self._read(folder, "documents")

        def summed(name: str) -> DataFrame:
            parts = [t for _, t in self._parts(name, tail)] or [self.spark.createDataFrame([], TABLES[name])]
            return self._summed(name, parts).where(F.col(SIGNED[name]) != 0)

        work = {name: (lambda name=name: self._put(folder, name, summed(name))) for name in SIGNED}
        work |= {"pages": lambda: self._put(folder, "pages", live.lists()), "tombstones": lambda: self._put(folder, "tombstones", self._tombstones(tail))}
        work["names"] = lambda: self._put(folder, "names", DERIVED["names"](documents, buckets))
        tables |= _at_once(work)
        tables["postings"] = self._put_postings(folder, documents, buckets, terms)
        return {"folder": folder, "seq": seq, "low": low, "buckets": buckets, "tables": tables}

    def compact(self) -> int:
        """Makes all segments one."""

        def put(segments: list[dict], made: list[dict]) -> list[dict]:
            if len(segments) < 2:
                return segments
            made.append(self._merge(segments, whole=True))
            return made[:]

        return self._change_to(put)


def _elsewhere(folder: str) -> bool:
    """Whether a manifest names a segment of another store, by its whole place."""
    return folder.startswith("/") or ":/" in folder


def _at_once(work: dict[str, Callable[[], dict]]) -> dict[str, dict]:
    """Tables that don't hang on one another, written side by side."""
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(work, pool.map(lambda f: f(), work.values()), strict=True))


def _bytes(df: DataFrame) -> int:
    """About how large a table is. Spark takes a join for as large as the product of its sides; that counts as their sum."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return min(int(str(plan.stats().sizeInBytes())), sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))


def _rows(segment: dict, name: str) -> int:
    if name in FROM_PAGES and name not in segment["tables"]:
        name = "pages"
    return segment["tables"].get(name, {}).get("rows", 0)


def _size_class(segment: dict) -> int:
    return int(math.log(max(1, _rows(segment, "documents") + _rows(segment, "tombstones")), MERGE))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _from_version_1(store: Store, old: dict) -> Index:
    """Version 1: one folder with documents without terms, postings without their documents' columns, pages, and maybe bodies."""
    folder = old["folder"]
    at = lambda name: store._path(f"{store.root}/{folder}/{name}")
    read = lambda name, schema: store.spark.read.schema(schema).parquet(f"{store.root}/{folder}/{name}")
    try:
        documents = read("documents", "filename string, title string, path string, total_words int, page_count int, filename_words array<string>, ext string, doc_seq bigint")
        postings, pages = read("postings", "term string, filename string, term_count int"), read("pages", TABLES["pages"])
        bodies = read("bodies", TABLES["bodies"]).where("body <> ''") if store._fs.exists(at("bodies")) else None
    except PySparkException as e:
        raise IncompleteSnapshot(f"{folder} can't be read") from e
    terms = lambda some: some(postings).groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("term", "term_count"))).cast(TERMS).alias("terms"))
    made = {"documents": lambda some: some(documents).join(terms(some), "filename"), "page_lists": lambda some: listed(some(pages))}
    now = store._by_document(folder, made, sum(store._fs.getContentSummary(at(name)).getLength() for name in ("documents", "postings", "pages")))
    return Index(now["documents"], pages, bodies if bodies is not None else body_rows(now["page_lists"]), page_lists=now["page_lists"])


#: From a manifest of each older version to an index as it is now.
UPGRADES = {1: _from_version_1}
