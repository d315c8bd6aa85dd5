"""Projects, certifications, spoken languages and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def parse_projects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per project: ``doc_id, project, title, client, role, description, technologies, project_type``.

    ``Project n:`` opens one (lines before the first are one too); known ``key: value`` lines fill fields, the last one
    winning; other lines describe.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(F.transform(T.lines(text_col), T.strip_emoji), lambda x: ~T.is_separator(x))).alias("pos", "line"))
    line = F.col("line")
    opens = line.rlike(P.PROJECT_HEAD)
    rows = rows.withColumn("opens", opens).withColumn("project", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))
    key, value = F.lower(T.strip(F.split_part(line, F.lit(":"), F.lit(1)))), T.strip(F.substring(line, F.locate(":", line) + 1, F.length(line)))
    field = F.lit(None).cast("string")
    for k, name in P.PROJECT_KEYS.items():
        field = F.when(key == k, name).otherwise(field)
    rows = rows.withColumn("field", F.when(F.col("opens"), "title").when(line.contains(":"), field))
    rows = rows.withColumn("value", F.when(F.col("opens"), T.strip(T.sub(line, P.PROJECT_HEAD + r"\s*"))).otherwise(value))
    last = lambda name: F.max_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("pos")))
    note = F.when(F.col("field").isNull(), F.nullif(T.clean_bullet(line), F.lit("")))
    notes = F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("pos", note.alias("note"))))), lambda x: x["note"])
    described = last("description")
    out = rows.groupBy("doc_id", "project").agg(
        *[F.coalesce(last(c), F.lit("")).alias(c) for c in ("title", "client", "role")],
        F.concat_ws("\n", F.nullif(described, F.lit("")), F.nullif(F.array_join(notes, "\n"), F.lit(""))).alias("description"),
        F.coalesce(F.filter(F.transform(F.split(last("technologies"), "[,|;]"), T.strip), lambda x: x != ""), F.array()).alias("technologies"),
    )
    return out.withColumn("project_type", F.lit("professional"))


def certifications(text) -> Column:
    """Array of (name, date, issuer), one a line."""
    rows = F.filter(F.transform(T.lines(text), lambda x: T.clean_bullet(T.strip_emoji(x))), lambda x: (x != "") & ~T.is_separator(x))
    part = lambda x, p: F.nullif(T.strip(F.regexp_extract(x, p, 1)), F.lit(""))
    return F.transform(rows, lambda x: F.struct(x.alias("name"), part(x, P.CERT_DATE).alias("date"), part(x, P.CERT_ISSUER).alias("issuer")))


def spoken_languages(text) -> Column:
    """Array of (language, proficiency), one a line; native unless a line says otherwise."""
    rows = F.filter(F.transform(T.lines(text), T.clean_bullet), lambda x: (x != "") & ~T.is_separator(x))

    def of(x: Column) -> Column:
        level, name = F.lit(P.PROFICIENCIES["native"]), x
        for key, says in reversed(P.PROFICIENCIES.items()):
            hit = F.lower(x).contains(key)
            level = F.when(hit, says).otherwise(level)
            name = F.when(hit, T.sub(T.sub(x, f"(?i){key}"), r"^[ \-–:,]+|[ \-–:,]+$")).otherwise(name)
        return F.struct(T.strip(F.get(F.split(name, r"[-–(|]"), F.lit(0))).alias("language"), level.alias("proficiency"))

    return F.filter(F.transform(rows, of), lambda x: F.length(x["language"]) > 1)


# --- Tables ------------------------------------------------------------------------------------------------------
TABLE = r"TABLE_START\n((?s:.*?))\nTABLE_END"


def table_kind(text: Column) -> Column:
    """skills, education or experience by the first list with a word in the text; else generic."""
    low, out = F.lower(text), F.lit("generic")
    for name, words in reversed(P.TABLE_KINDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def structured_tables(text) -> Column:
    """Array of (type, headers, data, raw) of the marked tables: rows as maps from headers, or raw cells if there is one row."""

    def of(block: Column) -> Column:
        rows = F.transform(F.split(T.strip(block), "\n"), lambda r: F.split(r, r" \| ", -1))
        heads = F.transform(F.get(rows, F.lit(0)), T.strip)
        cells = lambda r: F.transform(heads, lambda h, i: F.struct(h.alias("key"), T.strip(F.coalesce(F.get(r, i), F.lit(""))).alias("value")))
        several = F.size(rows) >= 2
        # Of two columns of one name, the last counts.
        last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == p["key"]))
        data = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_entries(last(cells(r))))
        return F.struct(table_kind(F.array_join(F.flatten(rows), " ")).alias("type"), F.when(several, heads).alias("headers"), F.when(several, data).alias("data"), F.when(~several, rows).alias("raw"))

    return F.transform(F.regexp_extract_all(T._col(text), F.lit(TABLE), F.lit(1)), of)


def is_layout_artifact(cells: Column) -> Column:
    """Of an array of rows of cells: empty, with a cell over 300 characters, or of one short column."""
    filled = F.filter(F.transform(F.filter(F.flatten(F.transform(cells, lambda r: F.coalesce(r, F.array()))), lambda c: c.isNotNull() & (c != "")), lambda c: F.trim(c)), lambda c: c.isNotNull())
    narrow = F.array_max(F.transform(cells, lambda r: F.coalesce(F.size(r), F.lit(0)))) <= 1
    return F.coalesce(F.size(cells) == 0, F.lit(True)) | (F.size(filled) == 0) | F.exists(filled, lambda c: F.length(c) > 300) | (narrow & ((F.size(cells) <= 3) | F.forall(filled, lambda c: F.length(c) <= 80)))


def table_text(cells: Column) -> Column:
    """A table's rows between its marks, cells parted by bars; null for a layout artefact."""
    rows = F.filter(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), lambda r: ~r.rlike(r"^[ |]*$"))
    return F.when(~is_layout_artifact(cells) & (F.size(rows) > 0), F.concat(F.lit("TABLE_START\n"), F.array_join(rows, "\n"), F.lit("\nTABLE_END")))
