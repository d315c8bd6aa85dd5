"""Keyed upserts into Parquet tables, candidate rows and the older recruiter block."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; keys don't gather: maxima are combined before they shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_x")).select(key, "_x.*").select(*rows.columns)


def upsert(master: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``master`` with rows of ``incoming`` in place of those with their key; new rows go in. Idempotent. A null key is a key."""
    new = latest(incoming, key, order).drop(order) if order else incoming
    return master.join(new.select(F.col(key).alias("_key")), master[key].eqNullSafe(F.col("_key")), "left_anti").unionByName(new.select(*master.columns))


#: Parts that the keys of a new master table are dealt into.
PARTS = 64


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """``version, part, parts, folder`` of all versions of a master table, or null if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("part int, parts int, folder string, version long").parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def current_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last version that was written whole, or null."""
    manifest = _manifest(spark, path)
    return manifest.agg(F.max("version")).first()[0] if manifest is not None else None


def _folders(spark: SparkSession, path: str, version: int) -> tuple[int, dict[int, str]]:
    """How many parts a version has, and the folder of each: no more rows than parts."""
    rows = _manifest(spark, path).where(F.col("version") == version).collect()
    return rows[0]["parts"], {r["part"]: r["folder"] for r in rows}


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _commit(spark: SparkSession, path: str, version: int, parts: int, folders: dict[int, str]) -> None:
    """One small file makes a version; a writer that was overtaken finds the version taken, and fails."""
    rows = spark.createDataFrame([(p, parts, f) for p, f in sorted(folders.items())], "part int, parts int, folder string")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def _write_parts(rows: DataFrame, path: str, key: str, parts: int) -> str:
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn("_part", _part(key, parts)).repartition("_part").write.partitionBy("_part").parquet(folder)
    return folder


def upsert_path(spark: SparkSession, path: str, incoming: DataFrame, key: str, order: str | None = None, parts: int = PARTS) -> None:
    """Upsert into the master table under ``path``, which is made if it isn't there.

    Keys are dealt into ``parts`` by hash, and a version is a manifest of each part's folder. Only the parts that
    ``incoming`` has keys of are read and written anew, beside the old ones; then the new manifest appears as a whole. A
    job that dies before leaves the old version in force, and old versions can be read. No rows, no new version. A table
    keeps the number of parts that it was made with until it is compacted.
    """
    new = (latest(incoming, key, order).drop(order) if order else incoming).persist()
    version = current_version(spark, path)
    parts, folders = (parts, {}) if version is None else _folders(spark, path, version)
    touched = [r["p"] for r in new.select(_part(key, parts).alias("p")).distinct().collect()]
    if touched:
        old = [folders[p] for p in touched if p in folders]
        master = spark.read.schema(new.schema).parquet(*old) if old else new.limit(0)
        folder = _write_parts(upsert(master, new, key), path, key, parts)
        _commit(spark, path, (version or 0) + 1, parts, folders | {p: f"{folder}/_part={p}" for p in touched})
    new.unpersist()


def read_master(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The master table as it is, or as it was in ``version``."""
    _, folders = _folders(spark, path, current_version(spark, path) if version is None else version)
    return spark.read.parquet(*folders.values())


def compact(spark: SparkSession, path: str, key: str, parts: int = PARTS) -> None:
    """A version with the same rows, each part written once, in ``parts`` parts."""
    version = current_version(spark, path)
    rows = read_master(spark, path)
    some = [r["p"] for r in rows.select(_part(key, parts).alias("p")).distinct().collect()]
    folder = _write_parts(rows, path, key, parts)
    _commit(spark, path, version + 1, parts, {p: f"{folder}/_part={p}" for p in some})


def upsert_in_place(sheet: DataFrame, incoming: DataFrame, key: str = "email", pos: str = "pos") -> DataFrame:
    """The older sheet: complete rows (both salaries and notice) replace the row of their key where it stands, or go last (positions grow, with gaps)."""
    good = incoming.where("current_salary is not null and expected_salary is not null and coalesce(notice_period, '') != ''")
    values = [c for c in sheet.columns if c not in (key, pos)]
    s, n = sheet.alias("s"), good.select(key, *values).alias("n")
    kept = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "left").select(F.col(f"s.{key}").alias(key), F.col(f"s.{pos}").cast("long").alias(pos), *[F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in values])
    last = sheet.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("_last"))
    fresh = n.join(sheet.select(F.col(key).alias("_k")), F.col(f"n.{key}") == F.col("_k"), "left_anti")
    fresh = fresh.crossJoin(F.broadcast(last)).withColumn(pos, (F.col("_last") + 1 + F.monotonically_increasing_id()).cast(kept.schema[pos].dataType))
    return kept.unionByName(fresh.select(*kept.columns))


def candidate_row(record: Column, source_file: Column, link: Column) -> Column:
    """The flat row of a candidate record; without an e-mail address the key is ``noemail_<file>``."""
    phones = F.array_distinct(F.transform(F.coalesce(record["phone_number"], F.array()), lambda p: F.regexp_replace(p["raw"], "[ -]", "")))
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        text(record["candidate_name"]["full_name"]).alias("full_name"),
        F.coalesce(F.get(record["email"], F.lit(0)), F.concat(F.lit("noemail_"), source_file)).alias("email"),
        F.array_join(phones, ", ").alias("phone"),
        text(record["location"]["city"]).alias("city"),
        text(record["location"]["country"]).alias("country"),
        record["total_years_experience"].alias("total_experience"),
        text(record["current_position"]["current_position"]).alias("current_position"),
        F.array_join(F.transform(F.coalesce(record["skills"], F.array()), lambda s: s["name"]), ", ").alias("skills"),
        F.left(F.array_join(F.coalesce(record["summary"], F.array()), " "), F.lit(1000)).alias("summary"),
        source_file.alias("source_file"),
        text(link).alias("sharepoint_url"),
    )


def sheet_row(row: Column) -> Column:
    """The spreadsheet's nine columns of a candidate row; its summary is cut at 500 characters."""
    names = {"Full Name": "full_name", "Email": "email", "Phone": "phone", "City": "city", "Country": "country", "Experience (Years)": "total_experience", "Current Role": "current_position", "Skills": "skills"}
    return F.struct(*[row[c].alias(n) for n, c in names.items()], F.left(row["summary"], F.lit(500)).alias("Summary"))


def money(amount: Column, currency: str = "INR") -> Column:
    """(value, currency, formatted) of an amount."""
    return F.when(amount.isNotNull(), F.struct(amount.cast("long").alias("value"), F.lit(currency).alias("currency"), F.concat(F.lit("₹"), F.format_number(amount, 0)).alias("formatted")))
