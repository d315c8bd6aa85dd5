"""Dictionary matching: stretches of words joined to a table of terms, and of those that overlap the best that don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import skills

#: A word: letters, digits, + and #, with . - / & between them, or a dot before (C++, C#, Node.js, CI/CD, .NET).
WORD = r"\.?[\p{L}\p{N}][\p{L}\p{N}+#]*(?:[.\-/&][\p{L}\p{N}+#]+)*"
#: A table of terms is broadcast up to so many bytes of keys; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8_000_000
#: Copies of each term in that shuffle, so that a stretch that every document holds meets its term in as many tasks.
SALT = 16


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_keys(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``key, n, term``: the words of each term, joined by spaces, how many they are, and the term; of terms with one key,
    the first in order. Terms without a word name nothing."""
    keyed = terms.select(F.col(term_col).cast("string").alias("term"), words(F.col(term_col)).alias("_w")).where(F.size("_w") > 0)
    return keyed.groupBy(F.array_join("_w", " ").alias("key")).agg(F.first(F.size("_w")).alias("n"), F.min("term").alias("term"))


def stretches(docs: DataFrame, sizes: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, key``: every stretch of so many words of each text."""
    every = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)

    def cut(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice("_w", i + 1, F.lit(n)), " ").alias("key")))

    return every.select("doc_id", F.inline(F.concat(*map(cut, sizes))))


def occurrences(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", term_col: str = "term") -> DataFrame:
    """``doc_id, start, end, term``: every place where a text has a term's words, overlapping ones too.

    The stretches of words that are as long as some term are joined to the terms by their text: one hash look-up each,
    however many terms there are. The terms are written out by the caller if they are costly; they are counted first, and
    broadcast up to ``BROADCAST_BYTES``. A larger table meets the stretches by a shuffle, each term in ``SALT`` copies.
    """
    keys = term_keys(terms, term_col)
    # A row a length: as many as the longest term has words.
    sizes = {r["n"]: r["bytes"] for r in keys.groupBy("n").agg(F.sum(F.octet_length("key") + F.octet_length("term") + 16).alias("bytes")).collect()}
    if not sizes:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("term")).where(F.lit(False))
    found = stretches(docs, sorted(sizes), id_col, text_col)
    if sum(sizes.values()) <= BROADCAST_BYTES:
        return found.join(F.broadcast(keys.drop("n")), "key").select("doc_id", "start", "end", "term")
    salted = keys.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALT)).cast("int"))
    return found.join(salted, ["key", "salt"]).select("doc_id", "start", "end", "term")


def _best(spans: Column) -> Column:
    """Of one group of overlapping spans, those chosen, by dynamic programming over their ends."""
    none = F.array().cast("array<struct<start:int,end:int,term:string>>")
    start = F.array(F.struct(F.lit(0).alias("end"), F.struct(F.lit(0).alias("covered"), F.lit(0).alias("fewer"), F.array().cast("array<int>").alias("earlier"), none.alias("picks")).alias("v")))

    def better(known: Column, x: Column) -> Column:
        s = x["s"]
        before = F.array_max(F.transform(F.filter(known, lambda k: k["end"] <= s["start"]), lambda k: k["v"]))
        with_s = T.let(
            before,
            lambda v: F.struct(
                (v["covered"] + s["end"] - s["start"]).alias("covered"),
                (v["fewer"] - 1).alias("fewer"),
                F.concat(v["earlier"], F.array(-s["start"])).alias("earlier"),
                F.concat(v["picks"], F.array(s)).alias("picks"),
            ),
        )
        return F.concat(known, F.array(F.struct(s["end"].alias("end"), F.greatest(with_s, F.element_at(known, -1)["v"]).alias("v"))))

    by_end = F.array_sort(F.transform(spans, lambda s: F.struct(s["end"].alias("end"), s["start"].alias("start"), s.alias("s"))))
    return F.element_at(F.aggregate(by_end, start, better), -1)["v"]["picks"]


def schedule(spans: DataFrame) -> DataFrame:
    """Of ``doc_id, start, end, term``, spans of each document that don't overlap: those that cover the most words; if that
    leaves a choice, the fewest; then the earliest.

    A group of overlapping spans ends where none goes on; groups are short, however long a document is, and each is
    settled by itself. A span that touches no other is taken as it is. Repeated spans count once.
    """
    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    # Repeated spans stand side by side in the order that the window below needs anyway: no table of all of them is held.
    spans = spans.withColumn("_before", F.lag(F.struct("start", "end")).over(by_start)).where(~F.col("_before").eqNullSafe(F.struct("start", "end"))).drop("_before")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    grouped = marked.withColumn("_group", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    every = grouped.groupBy("doc_id", "_group").agg(F.collect_list(F.struct("start", "end", "term")).alias("_s"))
    chosen = F.when(F.size("_s") == 1, F.col("_s")).otherwise(_best(F.col("_s")))
    return every.select("doc_id", F.inline(chosen))


def match_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", term_col: str = "term") -> DataFrame:
    """``doc_id, start, end, term``: the terms that each text has, none overlapping another, by number of word.

    Null and empty texts have none; rows of one id are taken for one document, so ids should be unique; null ids are one
    document too. No terms, no rows. Case doesn't count, nor what stands between words. Texts are dealt to all tasks first:
    stretches are many times the text, and what a task holds shall not hang on how few files the texts are read from.
    """
    docs = T.spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return schedule(occurrences(docs, terms, term_col=term_col))


def parse_skills(docs: DataFrame, terms: DataFrame | None = None, matcher: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, skills``: the distinct skills of each text, in title case, sorted.

    ``matcher`` is an outside matcher: of documents (``doc_id, text``) it gives ``doc_id, term``, a row a skill found. Without
    one, ``terms`` (a column ``term``) are looked for. With neither, texts are cut at commas and the like. Skills of two
    letters or fewer are left out, but in cut texts, which have their own rules.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if matcher is None and terms is None:
        return plain.select("doc_id", F.coalesce(skills.split_skills("text"), F.array().cast("array<string>")).alias("skills"))
    found = matcher(plain) if matcher is not None else match_terms(plain, terms)
    titled = found.select("doc_id", T.title_case(T.strip(F.lower("term"))).alias("skill")).where(F.length("skill") > 2)
    each = titled.groupBy("doc_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    ids = plain.select(F.col("doc_id").alias("_id")).distinct()
    return ids.join(each, F.col("_id").eqNullSafe(F.col("doc_id")), "left").select(F.col("_id").alias("doc_id"), F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
