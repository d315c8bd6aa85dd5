"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; ``keep`` ("min" or "max") says whose id stays.

    The groups are made by hash and bytes together, which compares the bytes: each map task first combines its own
    copies, so a group of a third of all rows arrives as one row a task, and two texts of one hash stay two groups.
    Documents then find their group by the 128-bit hash and, for two texts of one hash, SHA-256. Were two texts to share
    both, the query would fail rather than mix them. That join carries no text, and adaptive execution splits a hot hash
    on the documents' side.

    Null text counts as empty. Null ids: a group of nothing else has a null ``keep_id`` and keeps no row; in others they
    go. Rows that repeat an id and its text are one document in two rows and share its fate; an id with two texts is
    judged by each. An empty table gives no rows; other columns are neither read nor returned, so their names can't clash.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    hashed = base.withColumn("digest", F.unhex(F.md5("body")))
    best = F.min if keep == "min" else F.max
    groups = hashed.groupBy("digest", "body").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    alone = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256"))).otherwise(F.first("keep_id"))
    by_hash = groups.groupBy("digest", "text_sha256").agg(alone.alias("keep_id"), F.first("group_size").alias("group_size"))
    slim = hashed.select("doc_id", "digest", F.sha2("body", 256).alias("text_sha256"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    # Both sides are dealt anew for the join, by a key of its own, which lets a hot hash be split on the documents' side.
    key = F.concat("digest", "text_sha256").alias("key")
    slim, by_hash = slim.select("doc_id", key, "text_sha256"), by_hash.select(key, "keep_id", "group_size")
    return slim.join(by_hash, "key").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
