"""Partial dates, date ranges and merged months of experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns as P
from .text import _col, let, strip

DATE_FIELD = "struct<date:string,is_current:boolean,day:int,month:int,year:int>"


def _month_number(word: Column) -> Column:
    """Of a month's name or its first letters (3 or more; ``Sept`` too); null for other words."""
    names = {name[:k]: n for n, name in enumerate(P.MONTH_NAMES, 1) for k in range(3, len(name) + 1)}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.regexp_replace(word, r"\.$", "")))


def _field(date, is_current, day, month, year) -> Column:
    cast = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(cast(date, "string").alias("date"), cast(is_current, "boolean").alias("is_current"), cast(day, "int").alias("day"), cast(month, "int").alias("month"), cast(year, "int").alias("year"))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def parse_date(raw) -> Column:
    """A partial date: a current term; month and year; a year; day, month and year; else all null."""
    number = lambda x, pattern, k: F.regexp_extract(x, pattern, k).try_cast("int")
    words, digits = r"^([A-Za-z]{3,9}\.?),?\s+(\d{4})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"

    def read(x: Column) -> Column:
        return F.struct(F.lower(x).alias("low"), _month_number(F.regexp_extract(x, words, 1)).alias("month"), number(x, words, 2).alias("year"), number(x, r"^(\d{4})$", 1).alias("only"), number(x, digits, 1).alias("d"), number(x, digits, 2).alias("m"), number(x, digits, 3).alias("y"))

    def dated(p: Column) -> Column:
        return F.struct(_iso(p["y"], p["m"], p["d"]).alias("full"), _iso(p["y"], p["d"], p["m"]).alias("swapped"))

    def field(p: Column) -> Column:
        by_day = lambda q: F.when(q["full"].isNotNull(), _field(q["full"], False, F.dayofmonth(q["full"]), F.month(q["full"]), F.year(q["full"]))).when(q["swapped"].isNotNull(), _field(q["swapped"], False, None, F.month(q["swapped"]), F.year(q["swapped"])))
        return (
            F.when(p["low"].isin(*P.CURRENT_TERMS) | p["low"].contains("present"), _field(None, True, None, None, None))
            .when(p["month"].isNotNull(), _field(_iso(p["year"], p["month"], F.lit(1)), False, None, p["month"], p["year"]))
            .when(p["only"].isNotNull(), _field(None, False, None, None, p["only"]))
            .when(p["low"].isNotNull(), F.coalesce(let(dated(p), by_day), _field(None, False, None, None, None)))
        )

    return let(strip(_col(raw)), lambda x: let(read(x), field))


def date_range(line) -> Column:
    """(raw, start, end) of the first range on a line by three patterns in order; parts may be empty; null without one."""
    x = _col(line)
    whole = lambda pattern: F.regexp_extract(x, f"(?i)({pattern[4:]})", 1)
    made = lambda raw, text, pattern: F.struct(raw.alias("raw"), F.regexp_extract(text, pattern, 1).alias("start"), F.regexp_extract(text, pattern, 2).alias("end"))
    return F.coalesce(
        let(whole(P.ANY_RANGE), lambda raw: F.when(raw != "", made(raw, raw, P.DATE_RANGE))),
        F.when(x.rlike(P.NUMERIC_RANGE), made(whole(P.NUMERIC_RANGE), x, P.NUMERIC_RANGE)),
        F.when(x.rlike(P.YEAR_RANGE), made(whole(P.YEAR_RANGE), x, P.YEAR_RANGE)),
    )


def mentioned_years(text) -> Column:
    """The largest "N years" from 0.5 to 60, or null."""
    values = F.transform(F.regexp_extract_all(_col(text), F.lit(P.YEARS_MENTIONED), F.lit(1)), lambda x: x.try_cast("double"))
    return F.array_max(F.filter(values, lambda v: (v >= 0.5) & (v <= 60)))


def month_index(year, month) -> Column:
    return _col(year) * 12 + _col(month)


def merged_months(intervals: Column) -> Column:
    """Months covered by an array of (s, e): sorted, those that overlap or touch are one."""
    ordered = F.array_sort(intervals)
    start = F.struct(F.lit(0).alias("total"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["end"].isNull() | (x["s"] > acc["end"])
        gain = F.when(fresh, x["e"] - x["s"]).otherwise(F.greatest(x["e"] - acc["end"], F.lit(0)))
        return F.struct((acc["total"] + gain).cast("int").alias("total"), F.when(fresh, x["e"]).otherwise(F.greatest(acc["end"], x["e"])).cast("int").alias("end"))

    return F.aggregate(ordered, start, step, lambda acc: acc["total"])


def years_of(months) -> Column:
    """Months as years with one decimal, ties to even."""
    return F.bround(_col(months) / F.lit(12.0), 1)


def total_experience(text, summary=None, as_of: Column | None = None) -> Column:
    """Years of work in an experience text: its date ranges' merged months; else the most years mentioned there or in the
    summary; else 0. ``as_of`` (today by default) stands for "present", for unreadable ends, and for the missing month of
    a year. In numeric ranges the start is read day first and the end month first where it can be."""
    x = F.coalesce(_col(text), F.lit(""))
    today = as_of if as_of is not None else F.current_date()
    now = F.year(today) * 12 + F.month(today)
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)).alias("b"))

    def index(raw: Column, day_first: bool) -> Column:
        part = lambda k: F.regexp_extract(raw, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", k).try_cast("int")
        first, second = ("m", "d") if day_first else ("d", "m")
        numeric = let(F.struct(part(1).alias("d"), part(2).alias("m"), part(3).alias("y")), lambda q: q["y"] * 12 + F.when(q[first] <= 12, q[first]).otherwise(q[second]))
        return F.coalesce(numeric, let(parse_date(raw), lambda p: p["year"] * 12 + F.coalesce(p["month"], F.month(today))))

    def spans(pattern: str, day_first: bool) -> Column:
        made = F.transform(pairs(pattern), lambda p: F.struct(index(p["a"], day_first).cast("int").alias("s"), F.when(F.lower(strip(p["b"])).isin(*P.CURRENT_TERMS), now).otherwise(F.coalesce(index(p["b"], False), now)).cast("int").alias("e")))
        return F.filter(made, lambda i: i["e"] > i["s"])

    years = F.transform(pairs(P.YEAR_RANGE), lambda p: F.struct((p["a"].cast("int") * 12 + 1).alias("s"), (F.when(F.lower(p["b"]).isin(*P.CURRENT_TERMS), F.year(today)).otherwise(p["b"].try_cast("int")) * 12 + 12).alias("e")))
    found = F.concat(spans(P.DATE_RANGE, False), spans(P.NUMERIC_RANGE, True))
    months = let(found, lambda f: merged_months(F.when(F.size(f) > 0, f).otherwise(F.filter(years, lambda i: i["e"] > i["s"]))))
    said = mentioned_years(F.concat_ws("\n", x, _col(summary)) if summary is not None else x)
    return let(months, lambda m: F.when(m > 0, years_of(m)).otherwise(F.coalesce(said, F.lit(0.0))))


def merge_intervals(df: DataFrame, key: str = "key", s: str = "s", e: str = "e") -> DataFrame:
    """``key, s, e``: each key's intervals, those that overlap or touch made one. One shuffle, by key."""
    order = Window.partitionBy(key).orderBy(s, e)
    reach = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(s) <= F.col("_reach"), 0).otherwise(1)).over(order)
    rows = df.select(key, s, e, reach.alias("_reach")).withColumn("_island", island)
    return rows.groupBy(key, "_island").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("_island")
