"""A corpus of files made from a table of texts, for tests and benchmarks: names with a type, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, path, text, page_texts, doc_seq from `documents`; every third document is a pdf with a page for each line."""
    return texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def texts_of(documents: DataFrame) -> DataFrame:
    """The same from rows like those of `documents`."""
    docs = documents.select("doc_id", "text", "lang", "source")
    ext = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "docx").otherwise("txt")
    name = F.concat_ws("", F.concat_ws("_", "lang", "source", F.lit("module"), F.col("doc_id").cast("string")), F.lit("."), ext)
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))
    one = F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))
    return docs.select(name.alias("filename"), F.concat(F.lit("/data/"), name).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.when(ext == "pdf", lines).otherwise(one), F.array()).alias("page_texts"), F.col("doc_id").alias("doc_seq"))
