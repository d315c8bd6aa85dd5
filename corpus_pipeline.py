"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, secret scans and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but the last return
the columns of ``docs``, whatever else is among them and however it is named. ``run`` writes each stage's result to the
shared folder and reads it for the next. In every stage, no documents give no rows, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, packing, queries, secrets, simhash, toxicity
from quillspark.llm.decisions import fresh, without
from quillspark.llm.runtime import ascii_lower, written


def toxic_out(spark, docs, sf_dir):
    """Documents that the classifier chain calls toxic go; it is trained on the labelled ones among ``docs``.

    Without usable labels all stay. Null and empty texts stay; null and repeated ids are judged by their texts, row by row.
    """
    return toxicity.keep_clean(docs, queries.toxicity_chain(spark, docs, sf_dir), "toxic")


def copies_out(spark, docs, sf_dir):
    """Of equal texts (A-Z lower-cased; null is empty), the document with the largest id stays.

    Rows that repeat an id and a text become one; of an id with two texts, each is judged by its own. Rows without an id
    give way to one that has one with an equal text, but can't be told from each other: of those of one text, one stays.
    """
    judged = written(exact_dedup.exact_dedup(docs, keep="max").where("not kept"), "copies")
    body = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    kept = without(docs, judged.select("doc_id", "text_sha256"), sign=body)
    nameless = judged.where("doc_id is null and keep_id is not null").select("text_sha256").distinct()
    if not nameless.isEmpty():
        sha = fresh(docs, "text_sha256")
        kept = kept.join(nameless.toDF(sha), F.col("doc_id").isNull() & (body == F.col(sha)), "left_anti")
    return kept


def near_copies_out(spark, docs, sf_dir):
    """Of documents that SimHash links reach, the one with the smallest id stays.

    Rows that repeat an id and a text become one; of an id with two texts, each is judged by its own. Rows without an id
    stay, one for each text. Null and empty texts link like any other of fingerprint zero.
    """
    sign = F.md5(F.coalesce("text", F.lit("")))
    judged = simhash.near_dedup(docs, sign=sign)
    return without(docs, judged.where("doc_id != component_id").select("doc_id", "sign"), sign=sign)


def secrets_out(spark, docs, sf_dir):
    """All documents stay; secrets in their texts are marked, and ``n_chars`` of a changed text is its new length.

    Null and empty texts, and rows that repeat, stay as they are.
    """
    before = fresh(docs, "text_before")
    clean = secrets.redact_secrets(docs.withColumn(before, F.col("text")), queries.secrets_forest(spark))
    if "n_chars" in docs.columns:
        same = F.col("text").eqNullSafe(F.col(before))
        clean = clean.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)


def packed(spark, docs, sf_dir):
    """The remaining documents' pieces, packed into sequences of 2048 ids: null text is empty, and each row is packed."""
    return packing.pack_documents(docs, queries.tokenizer(), room=2048, separator=0)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", copies_out),
    ("simhash near-dedup", near_copies_out),
    ("secret scans", secrets_out),
    ("best-fit packing", packed),
]

#: SQL can't express a trained classifier, a fingerprint's components or BPE: tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces of all documents that pass the stages, one row each, as ``packing.pack_documents`` gives them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
