"""The form's data operators: skill lists, salary and URL checks, form values, and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTICE = ("Immediately", "Within 15 Days", "Within 30 Days", "Within 45 Days", "Within 60 Days", "Within 90 Days")


def distinct_names(names: Column) -> Column:
    """Trimmed names without empty ones; of names that differ in case, the first."""
    clean = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(clean, lambda x, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda o: F.lower(o) == F.lower(x)))


def add_name(names: Column, name: Column) -> Column:
    return F.when((F.trim(name) == "") | F.exists(names, lambda x: F.lower(x) == F.lower(F.trim(name))), names).otherwise(F.concat(names, F.array(F.trim(name))))


def remove_name(names: Column, name: Column) -> Column:
    return F.filter(names, lambda x: x != name)


def matches(names: Column, query: Column) -> Column:
    """(name, shown) by a case-insensitive part of the name."""
    return F.transform(names, lambda x: F.struct(x.alias("name"), F.lower(x).contains(F.lower(F.trim(query))).alias("shown")))


def salary(raw: Column) -> Column:
    """The digits as a number above 0, or null."""
    n = F.regexp_replace(raw, "[^0-9]", "").try_cast("bigint")
    return F.when(n > 0, n)


def valid_url(raw: Column, domain: str) -> Column:
    """Whether a URL (https if it has no scheme) is of a host with ``domain`` in it; an empty one is."""
    whole = F.when(raw.rlike("^(?i)https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    return F.when(F.trim(raw) == "", True).otherwise(F.coalesce(F.lower(F.try_parse_url(whole, F.lit("HOST"))).contains(domain), F.lit(False)))


def valid_notice(raw: Column) -> Column:
    return raw.isin(*NOTICE)


def problems(current_salary: Column, expected_salary: Column, notice: Column, silent: bool = False) -> Column:
    """What keeps a form from being saved; nothing does in silent saves."""
    found = F.array(F.when(salary(current_salary).isNull(), "current_salary"), F.when(salary(expected_salary).isNull(), "expected_salary"), F.when(~F.coalesce(valid_notice(notice), F.lit(False)), "notice_period"))
    return F.array().cast("array<string>") if silent else F.array_compact(found)


def form_values(record: Column) -> Column:
    """A record as flat form values."""
    link = lambda domain: F.get(F.filter(F.coalesce(record["websites"], F.array()), lambda w: w["domain"].contains(domain)), F.lit(0))["url"]
    place = F.filter(F.array(record["location"]["city"], record["location"]["state"], record["location"]["country"]), lambda x: x.isNotNull() & (x != ""))
    return F.struct(
        record["candidate_name"]["full_name"].alias("full_name"),
        F.get(record["email"], F.lit(0)).alias("email"),
        F.get(record["phone_number"], F.lit(0))["raw"].alias("phone"),
        F.array_join(place, ", ").alias("location"),
        link("linkedin").alias("linkedin"),
        link("github").alias("github"),
        distinct_names(F.transform(F.coalesce(record["skills"], F.array()), lambda s: s["name"])).alias("skills"),
    )


def summary_sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 8)


def file_size(n: Column) -> Column:
    """Bytes for people: B, or KB and MB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB")))


def escape_html(x: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x
