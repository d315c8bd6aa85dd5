"""A folder of files to formatted texts, records, JSON and a status: ``python -m quillspark.plans.batch IN OUT``."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import DEFAULT, Lookups
from ..operators import segment
from ..sources import readers
from . import record

#: A text under this length counts as not read.
LEAST_TEXT = 1


def read_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, text with marked headings; rejects: path, reason) of a scan. DOCX and RTF are read; contents of
    other kinds (PDF, old DOC) are rejected as unsupported, encrypted and damaged archives as that, and files that a reader
    finds nothing in as unreadable."""
    kinds = files.where("reason is null").withColumn("kind", readers.file_kind(F.col("content")))
    docx = readers.docx_lines(readers.read_docx(kinds.where("kind in ('docx', 'dotx')")))
    rtf = kinds.where("kind = 'rtf'").select(F.col("path").alias("doc_id"), readers.rtf_text(F.col("content")).alias("text"))
    texts = docx.unionByName(rtf).where(F.length("text") >= LEAST_TEXT)
    read = texts.select(F.col("doc_id").alias("path"))
    known = F.col("kind").isin("docx", "dotx", "rtf")
    missed = kinds.join(read, "path", "left_anti").select("path", F.when(known, "unreadable").when(F.col("kind") == "encrypted", "encrypted").when(F.col("kind") == "unknown_zip", "broken").otherwise("unsupported").alias("reason"))
    return texts, readers.rejects(files).unionByName(missed)


def format_texts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, text``: texts formatted, with the links of DOCX files put in."""
    docx = files.where("reason is null").withColumn("kind", readers.file_kind(F.col("content"))).where("kind in ('docx', 'dotx')")
    links = readers.docx_links(docx).groupBy("doc_id").agg(F.collect_list(F.struct("uri", "display_text")).alias("links"))
    return segment.format_documents(texts.join(links, "doc_id", "left"), "links")


def process(spark: SparkSession, source: str, lookups: Lookups = DEFAULT, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(formatted texts, records, rejects) of a folder."""
    files = readers.scan(spark, source)
    texts, rejects = read_texts(files)
    formatted = format_texts(files, texts)
    return formatted, record.candidate_records(formatted, lookups, as_of), rejects


def main(source: str, target: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    texts, records, rejects = process(spark, source)
    texts.write.mode("overwrite").parquet(f"{target}/texts")
    texts = spark.read.parquet(f"{target}/texts")
    record.write_json(record.candidate_records(texts), f"{target}/records")
    rejects.write.mode("overwrite").parquet(f"{target}/rejects")
    files = readers.scan(spark, source).select("path").join(spark.read.parquet(f"{target}/rejects"), "path", "left")
    record.batch_status(files, texts).write.mode("overwrite").json(f"{target}/status")


if __name__ == "__main__":
    main(*sys.argv[1:3])
