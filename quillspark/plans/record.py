"""The candidate record: every parser over a document's sections, joined by document, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact as C
from ..functions import dates as D
from ..functions import text as T
from ..functions.lookups import DEFAULT, Lookups
from ..operators import education, jobs, lists, places, segment, skills

def candidate_records(docs: DataFrame, lookups: Lookups = DEFAULT, as_of: Column | None = None, pins: DataFrame | None = None, institutions: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """``doc_id, record`` for texts (``doc_id, text``): one nested struct a document, nulls for what isn't there.

    ``pins`` and ``gazetteer`` are the tables of ``places.locations``; ``institutions`` those of ``education``.
    Sections are found once, by a window over each document's lines, and pivoted into a map; most parsers are then
    expressions over that row. Jobs and projects group lines by document; all joins are on doc_id.
    """
    docs = docs.select("doc_id", "text")
    sections = segment.section_map(segment.segment(docs, lookups))
    base = docs.join(sections, "doc_id", "left")
    part = lambda name: F.coalesce(F.get(F.map_values(F.map_filter("sections", lambda k, v: k == name)), F.lit(0)), F.lit(""))
    of = lambda name: base.select("doc_id", part(name).alias("text")).where("text != ''")
    work = jobs.experience_list(jobs.parse_experience(of("experience")), "work_experience")
    interns = jobs.experience_list(jobs.parse_experience(of("internships")), "internships")
    projects = lists.parse_projects(of("projects"))
    project = F.struct(*[F.col(c).alias(f"project_{c}".replace("project_project", "project")) for c in ("title", "client", "role", "description", "technologies", "project_type")])
    projects = projects.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("project", project.alias("x")))), lambda x: x["x"]).alias("projects"))
    rows = base
    said = F.concat(skills.split_skills(F.concat_ws("\n", part("skills"), part("tools_breadth"))), skills.split_skills(part("certifications")))
    named = skills.dedupe_rows(base.select("doc_id", F.posexplode(said).alias("pos", "skill"))).select("doc_id", "pos", skills.skill_object(F.col("skill"), lookups).alias("x"))
    named = named.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_skills"))
    studies = education.education_lists(of("education"), institutions=institutions, lookups=lookups)
    where = base.select("doc_id", "text", F.concat_ws(" ", part("personal_details"), part("about"), F.substring("text", 1, 1000)).alias("place_text"))
    for more in (work, interns, projects, named, studies, places.locations(where, pins, gazetteer)):
        rows = rows.join(more, "doc_id", "left")

    text, experience = F.col("text"), F.concat_ws("\n", F.nullif(part("experience"), F.lit("")), F.nullif(part("internships"), F.lit("")))
    emails = C.best_emails(F.col("_emails"))
    some = lambda x: F.when(F.size(x) > 0, x)
    rows = rows.withColumn("_emails", C.email_candidates(text)).withColumn("_best", emails)
    record = F.struct(
        C.candidate_name(text).alias("candidate_name"),
        some(F.slice("_best", 1, 1)).alias("email"),
        some(F.col("_best")).alias("all_emails"),
        some(F.transform(C.phones(text), lambda p: F.struct(p.alias("raw"), p.alias("e164")))).alias("phone_number"),
        some(C.websites(text)).alias("websites"),
        F.col("location"),
        C.date_of_birth(text).alias("date_of_birth"),
        C.gender(text).alias("gender"),
        C.nationality(text).alias("nationality"),
        T.sentences(part("about")).alias("summary"),
        F.coalesce("_skills", F.array()).alias("skills"),
        F.col("work_experience"),
        F.col("internships"),
        D.total_experience(experience, part("about"), as_of).alias("total_years_experience"),
        jobs.current_position(part("about"), part("others"), F.col("work_experience")).alias("current_position"),
        F.col("education"),
        F.col("projects"),
        some(lists.certifications(part("certifications"))).alias("certifications"),
        some(lists.spoken_languages(part("languages_spoken"))).alias("languages"),
        *[some(T.line_list(part(c))).alias(c) for c in ("publications", "achievements", "volunteer", "interests", "references")],
        F.coalesce(F.map_keys("sections"), F.array()).alias("sections_detected"),
    )
    return rows.select("doc_id", record.alias("record"))


def to_json(records: DataFrame) -> DataFrame:
    """``doc_id, json``: keys without a value are left out."""
    return records.select("doc_id", F.to_json("record", {"ignoreNullFields": "true"}).alias("json"))


def write_json(records: DataFrame, path: str) -> None:
    to_json(records).write.mode("overwrite").json(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder a document, its formatted text in it."""
    texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text").write.mode("overwrite").partitionBy("doc_id").text(path)


def batch_status(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``ok, errors, error_files`` of a batch: files of ``files`` (path, reason) and their ``texts`` (doc_id = path, text)."""
    seen = files.join(texts.select(F.col("doc_id").alias("path"), F.length("text").alias("chars")), "path", "left")
    bad = F.col("reason").isNotNull() | F.coalesce(F.col("chars") == 0, F.lit(True))
    return seen.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("errors"), F.sort_array(F.collect_list(F.when(bad, F.col("path")))).alias("error_files"))


def text_notes(texts: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_chars``: lines that aren't blank, and characters, of each text."""
    return texts.select("doc_id", F.size(T.lines("text")).alias("n_lines"), F.length("text").alias("n_chars"))
