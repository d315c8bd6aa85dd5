"""Streams: candidate texts that land in a folder, and the last state of each key after a quiet time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import DEFAULT, Lookups
from ..operators import upsert
from ..plans import record


def land(spark: SparkSession, inbox: str, master: str, checkpoint: str, lookups: Lookups = DEFAULT, as_of=None):
    """A query that turns new Parquet files (doc_id, text, source_file) into candidate rows of the master table.

    Each batch runs the batch transforms and upserts by e-mail address, so a batch run twice changes nothing.
    """
    stream = spark.readStream.schema("doc_id long, text string, source_file string").parquet(inbox)

    def save(batch: DataFrame, _: int) -> None:
        upsert.upsert_path(batch.sparkSession, master, candidates(batch, lookups, as_of), "email", "ord")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidates(docs: DataFrame, lookups: Lookups = DEFAULT, as_of=None) -> DataFrame:
    """Candidate rows of documents, with ``ord`` to tell which of one key is last."""
    records = record.candidate_records(docs, lookups, as_of).join(docs.select("doc_id", "source_file"), "doc_id")
    return records.select(upsert.candidate_row(F.col("record"), F.col("source_file"), F.lit("")).alias("c"), F.col("doc_id").alias("ord")).select("c.*", "ord")


def last_writes(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "1 second", late: str = "1 minute") -> DataFrame:
    """``key, start, end, n, value``: the last value of each run of events with no pause of ``gap``; batch or stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    grouped = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct(ts, "event_id")).alias("value"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
