"""The search engine as one object: build, search, change and look at an index in a store."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass
from time import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import mutate
from .operators.index import Index, build_index, counters
from .operators.queries import local
from .plans.search import search
from .schemas import struct
from .sources.extract import SCHEMA, inside, sanitised, scan_files, scan_folder
from .sources.store import ATTEMPTS, Conflict, Store, empty_index

QUERIES = "query_id int, raw string, page string, limit string"


@dataclass
class Status:
    state: str = "READY"
    message: str = ""
    started_at: float | None = None
    completed_at: float | None = None
    last_error: str | None = None


class Engine:
    """folder: where the documents' files are, on the driver's file system; deletes take them away, so that a rebuild doesn't bring them back."""

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None) -> None:
        self.spark, self.store, self.state, self.folder = spark, Store(spark, root), Status(), folder
        self._lock, self._thread, self._again = threading.Lock(), None, None
        self._use()

    def _use(self) -> None:
        # Segments are columnar files laid out for the searches; they are read as needed, and nothing is held in memory.
        self.index: Index = self.store.load() or empty_index(self.spark)

    def _publish(self, change: Callable[[], object], what: str) -> None:
        self.state = Status("INDEXING", what, time())
        try:
            change()
            self._use()
            self.state = Status("READY", what, self.state.started_at, time())
        except Exception as e:
            self.state = Status("ERROR", what, self.state.started_at, time(), str(e))
            raise

    def rebuild(self, folder: str | None = None) -> None:
        """Indexes the files of a folder anew. What is changed in the index meanwhile stays changed."""
        folder = folder or self.folder

        def change() -> None:
            for _ in range(ATTEMPTS):
                try:
                    return self.store.publish(build_index(scan_folder(self.spark, folder)), since=self.store.generation())
                except Conflict:
                    continue
            raise Conflict("the index changes faster than it can be rebuilt")

        self._publish(change, "rebuild")

    def start_rebuild(self, folder: str) -> bool:
        """Rebuilds in the background. False if one is running: it is followed by one more, however often it is asked for."""
        with self._lock:
            if self._thread is not None:
                self._again = folder
                return False
            self.state = Status("INDEXING", "rebuild", time())
            self._thread = threading.Thread(target=self._rebuild, args=(folder,), name="rebuild", daemon=True)
            self._thread.start()
            return True

    def _rebuild(self, folder: str | None) -> None:
        while folder is not None:
            try:
                self.rebuild(folder)
            except Exception as e:  # the status says so
                self.state = Status("ERROR", "rebuild", self.state.started_at, time(), str(e))
            with self._lock:
                folder, self._again = self._again, None
                if folder is None:
                    self._thread = None

    def wait(self, seconds: float | None = None) -> None:
        """Until no rebuild runs."""
        if thread := self._thread:
            thread.join(seconds)

    def upsert(self, texts: DataFrame) -> DataFrame:
        """Puts documents in or replaces them, under safe names; returns filename, status, reason. Names of unsupported types are rejected."""
        self._publish(lambda: self.store.upsert(build_index(mutate.sanitised_upload(texts))), "upsert")
        return mutate.upload_status(texts)

    def upload(self, files: list[tuple[str, bytes]], folder: str | None = None) -> DataFrame:
        """Saves files under safe names in the documents' folder and indexes them there; returns filename, status, reason.

        Of files whose safe names are equal the last one counts.
        """
        folder = folder or self.folder
        given = self.spark.createDataFrame([(name, k) for k, (name, _) in enumerate(files)], "given string, doc_seq long")
        named = given.select("given", "doc_seq", sanitised(given["given"]).alias("filename")).orderBy("doc_seq").collect()
        saved = {}
        for row, (_, data) in zip(named, files, strict=True):
            path = inside(folder, row.filename) if row.filename else None
            if path:
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)
                saved[row.filename] = path
        texts = scan_files(self.spark, list(saved.values())) if saved else self.spark.createDataFrame([], f"{SCHEMA}, doc_seq long")
        texts = texts.persist()
        try:
            status = mutate.upload_status(texts.unionByName(self._refused(named, saved), allowMissingColumns=True)).collect()
            self._publish(lambda: self.store.upsert(build_index(texts)), "upsert")
        finally:
            texts.unpersist()
        return self.spark.createDataFrame(status, "filename string, status string, reason string")

    def _refused(self, named: list, saved: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([(r.given, "") for r in named if r.filename not in saved], "filename string, text string")

    def delete(self, names: list[str]) -> DataFrame:
        """Removes documents and their files; returns filename, status of each distinct name: deleted, not_found (neither indexed nor a file) or failed (the file can't be removed; the document stays)."""
        asked = list(dict.fromkeys(b for n in names if n and (b := os.path.basename(n))))
        known = {r.filename for r in self.index.documents_of(asked).where(F.col("filename").isin(asked)).select("filename").collect()} if asked else set()
        status = {}
        for name in asked:
            path = inside(self.folder, name) if self.folder else None
            there = path is not None and os.path.isfile(path)
            try:
                if there:
                    os.remove(path)
                status[name] = "deleted" if there or name in known else "not_found"
            except OSError:
                status[name] = "failed"
        gone = [(n,) for n in asked if status[n] == "deleted" and n in known]
        if gone:
            self._publish(lambda: self.store.remove(self.spark.createDataFrame(gone, "filename string")), "delete")
        return self.spark.createDataFrame(list(status.items()), "filename string, status string")

    def search(self, q: str, page: str = "1", limit: str = "10") -> DataFrame:
        return self.search_many(local(self.spark, [Row(1, q, str(page), str(limit))], struct(QUERIES)))

    def search_many(self, queries: DataFrame) -> DataFrame:
        """Response rows of queries(query_id, raw, page, limit); none where nothing is indexed."""
        return search(queries, self.index)

    def get_document(self, name: str) -> DataFrame:
        return self.index.documents_of([name]).drop("terms")

    def has_document(self, name: str) -> bool:
        return not self.get_document(name).isEmpty()

    def document_path(self, folder: str, name: str) -> str | None:
        """The file of an indexed document in a local folder; None if the name leads out of it, is not indexed or has no file."""
        path = inside(folder, name)
        return path if path and os.path.isfile(path) and self.has_document(os.path.basename(path)) else None

    def status(self) -> dict:
        return {**vars(self.state), "generation": self.store.generation(), **counters(self.index).first().asDict()}
