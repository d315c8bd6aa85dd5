"""Work experience: jobs from lines by a running group, and the current position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import patterns as P
from ..functions import text as T


def is_job_title(line: Column) -> Column:
    x = T.strip_emoji(line)
    return ~T.is_bullet(x) & (F.length(x) <= 120) & x.rlike(P.JOB_TITLE)


def inline_job(line: Column) -> Column:
    """(title, organization, dates) of ``Title - Company 2019 - Present``, or null."""
    x = T.strip_emoji(line)
    part = lambda k: T.strip(F.regexp_extract(x, P.INLINE_JOB, k))
    return F.when(x.rlike(P.INLINE_JOB), F.struct(part(1).alias("title"), part(2).alias("organization"), part(3).alias("dates")))


def parse_experience(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per job: ``doc_id, job, job_title, organization, date_range, start_date, end_date, description, location``.

    A title line or an inline job opens a job; the first company names it, the last date range dates it (start and end
    stay from an earlier range if the later has none), other lines describe it. One shuffle, by document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(F.transform(T.raw_lines(text_col), T.strip_emoji), lambda x: (F.length(x) >= 3) & ~T.is_separator(x))).alias("pos", "line"))
    line = F.col("line")
    rows = rows.withColumn("inline", inline_job(line))
    rows = rows.withColumn("opens", F.col("inline").isNotNull() | is_job_title(line))
    rows = rows.withColumn("range", F.when(F.col("inline").isNotNull(), D.date_range(F.col("inline.dates"))).when(~F.col("opens"), D.date_range(line)))
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("job", F.sum(F.col("opens").cast("int")).over(by_pos)).where("job > 0")
    before = T.strip(F.substring(line, F.lit(1), F.position(F.col("range.raw"), line) - 1))
    short = lambda x: (F.length(x) < 80) & ~T.is_bullet(x)
    ahead = F.when(F.col("range").isNotNull() & (before != "") & short(before), before)
    company = F.when(line.rlike(P.COMPANY) & short(line), line)
    rows = rows.withColumn("org", F.when(F.col("inline").isNotNull(), F.col("inline.organization")).when(~F.col("opens"), F.when(F.col("range").isNotNull(), ahead).otherwise(company)))
    first_org = F.min(F.when(F.col("org").isNotNull(), F.col("pos"))).over(Window.partitionBy("doc_id", "job"))
    plain = ~F.col("opens") & F.col("range").isNull() & ~F.coalesce(F.col("pos") == first_org, F.lit(False))
    rows = rows.withColumn("note", F.when(plain, F.nullif(T.clean_bullet(line), F.lit(""))))
    last = lambda c: F.max_by(c, F.when(c.isNotNull() & (c != ""), F.col("pos")))
    notes = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("pos", "note"))))
    grouped = rows.groupBy("doc_id", "job").agg(
        F.coalesce(F.min_by(F.coalesce(F.col("inline.title"), line), "pos"), F.lit("")).alias("job_title"),
        F.coalesce(F.min_by("org", F.when(F.col("org").isNotNull(), F.col("pos"))), F.lit("")).alias("organization"),
        F.coalesce(last(F.col("range.raw")), F.lit("")).alias("date_range"),
        last(F.col("range.start")).alias("_start"),
        last(F.col("range.end")).alias("_end"),
        F.array_join(F.transform(notes, lambda x: x["note"]), "\n").alias("description"),
    )
    dated = lambda c: F.when(F.col(c).isNotNull(), D.parse_date(c))
    return grouped.select("doc_id", "job", "job_title", "organization", "date_range", dated("_start").alias("start_date"), dated("_end").alias("end_date"), "description", F.lit("").alias("location"))


def experience_list(jobs: DataFrame, column: str = "work_experience") -> DataFrame:
    """``doc_id, <column>``: a document's jobs as an array of structs with prefixed names."""
    prefix = "work_experience_"
    job = F.struct(*[F.col(c).alias(prefix + c) for c in ("job_title", "organization", "date_range", "start_date", "end_date", "description", "location")])
    return jobs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("job", job.alias("x")))), lambda x: x["x"]).alias(column))


# --- Current position --------------------------------------------------------------------------------------------
def clean_title(title: Column) -> Column:
    """Without adjectives before it (three at most) and odd spaces."""
    out = title
    for _ in range(3):
        out = T.strip(T.sub(T.strip(T.sub(out, P.TITLE_OPENER)), r"^[.,;:\-]+|[.,;:\-]+$"))
    return T.strip(T.sub(out, r"\s{2,}", " "))


RESULT = "struct<current_position:string,years_of_experience:string,years_of_experience_value:double,source:string>"


def _result(title: Column, years: Column, source: str, where: Column) -> Column:
    after = F.substring(where, F.position(years, where) + F.length(years), F.lit(2))
    shown = F.concat(years, F.when(after.contains("+"), "+").otherwise(""), F.lit(" years"))
    return F.struct(clean_title(title).alias("current_position"), shown.alias("years_of_experience"), years.try_cast("double").alias("years_of_experience_value"), F.lit(source).alias("source"))


def summary_position(text) -> Column:
    """The first of 15 lines that names a position with years, by two patterns; else by a loose one over all; else null."""
    rows = F.slice(F.filter(F.transform(T.raw_lines(text), T.strip_emoji), lambda x: x != ""), 1, 15)
    edge = lambda x: T.sub(T.strip(x), r"^[.,;:\-]+|[.,;:\-]+$")
    good = lambda t: (t != "") & ~t.rlike(P.POSITION_DUTY) & F.length(t).between(3, 80)

    def whole(line: Column) -> Column:
        return T.let(edge(F.regexp_extract(line, P.POSITION_WITH_YEARS, 1)), lambda t: F.when(good(t), _result(t, F.regexp_extract(line, P.POSITION_WITH_YEARS, 2), "summary", line)))

    def piped(line: Column) -> Column:
        base = edge(F.regexp_extract(line, P.POSITION_PIPE, 2))
        title = F.when(base != "", T.strip(F.concat_ws(" ", T.strip(F.regexp_extract(line, P.POSITION_PIPE, 1)), base))).otherwise("")
        return T.let(title, lambda t: F.when(good(t), _result(t, F.regexp_extract(line, P.POSITION_PIPE, 3), "summary", line)))

    def loose(block: Column) -> Column:
        return T.let(clean_title(edge(F.regexp_extract(block, P.POSITION_LOOSE, 1))), lambda t: F.when(good(t), _result(t, F.regexp_extract(block, P.POSITION_LOOSE, 2), "summary", block)))

    # All three patterns end in a number of years; where there is none, they aren't tried.
    dated = lambda x: x.rlike(P.YEARS_MENTIONED)

    def found(lines: Column) -> Column:
        each = F.transform(F.filter(lines, lambda x: dated(x) & ~x.rlike(P.POSITION_SECTION)), lambda x: F.coalesce(whole(x), piped(x)))
        return F.coalesce(F.get(F.filter(each, lambda r: r.isNotNull()), F.lit(0)), T.let(F.array_join(lines, " "), lambda block: F.when(dated(block), loose(block))))

    # Nor are lines made of a text without a number before a "y", whatever signs (emoji, line breaks) stand between.
    return F.when(T._col(text).rlike(r"\d[^a-zA-Z0-9]*+[yY]"), T.let(rows, found))


def is_current(job: Column) -> Column:
    """Of a job struct with prefixed names: it has no end, an end without year and date, or words for now in its range."""
    end, words = job["work_experience_end_date"], F.lower(F.coalesce(job["work_experience_date_range"], F.lit("")))
    open_end = end.isNull() | F.coalesce(end["is_current"], F.lit(False)) | (end["year"].isNull() & end["date"].isNull())
    return open_end | words.rlike("|".join(P.CURRENT_END_TERMS))


def job_position(work: Column) -> Column:
    """The title of the current job that began last (of the first job, if none is current), or null."""
    now = F.filter(work, is_current)
    among = F.when(F.size(now) > 0, now).otherwise(F.slice(work, 1, 1))
    year = lambda j: F.coalesce(j["work_experience_start_date"]["year"], F.lit(0))
    best = F.get(F.filter(among, lambda j: year(j) == F.array_max(F.transform(among, year))), F.lit(0))
    title = T.strip(best["work_experience_job_title"])
    none = F.lit(None)
    return F.when(title != "", F.struct(title.alias("current_position"), none.cast("string").alias("years_of_experience"), none.cast("double").alias("years_of_experience_value"), F.lit("work_experience").alias("source")))


def current_position(about: Column, others: Column, work: Column) -> Column:
    """From the summary, then other text, then the jobs; else "Not clearly identifiable"."""
    none = F.lit(None)
    unknown = F.struct(F.lit("Not clearly identifiable").alias("current_position"), none.cast("string").alias("years_of_experience"), none.cast("double").alias("years_of_experience_value"), F.lit("none").alias("source"))
    return F.coalesce(*[x.cast(RESULT) for x in (summary_position(about), summary_position(others), job_position(work), unknown)])
