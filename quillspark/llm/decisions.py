"""Applying an operator's decisions to the documents they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Decisions are broadcast up to this many (of about 50 bytes each); more are joined by a shuffle of the documents.
BROADCAST_ROWS = 200_000


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or the first name made from it that no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text", sign: Column | None = None) -> DataFrame:
    """The documents, all columns as they are, whose ids aren't in ``dropped`` (one column); rows of one id and text once.

    With ``sign``, an expression over ``docs`` that tells an id's texts apart, ``dropped`` has that sign as its second
    column, and a decision is about the rows with both: of an id with two texts, each is judged by its own.
    Rows without an id can't be named by a decision: of those with one text, one stays. Columns of ``docs`` may have any
    names. Null texts are one text. No decisions, or none about these documents: only repeats go. No documents, no rows.

    Decisions are written and counted first: up to ``BROADCAST_ROWS`` of them are broadcast, and documents only shuffle if
    some id and text come twice.
    """
    own_id, own_sign, digest = fresh(docs, "dropped_id"), fresh(docs, "dropped_sign"), fresh(docs, "text_digest")
    gone = dropped.toDF(own_id, own_sign) if sign is not None else dropped.toDF(own_id)
    gone = written(gone.where(F.col(own_id).isNotNull()).distinct(), "dropped")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    fits = docs[id_col] == gone[own_id]
    kept = docs.join(gone, fits if sign is None else fits & (sign == gone[own_sign]), "left_anti")
    keys = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("digest"))
    if keys.groupBy("id", "digest").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn(digest, F.md5(text_col)).dropDuplicates([id_col, digest]).drop(digest)
