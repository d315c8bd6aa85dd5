"""Lines and sections: formatting of cleaned lines, section detection, forward fill, re-ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.lookups import DEFAULT, Lookups


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, line``: one row a line, blank ones too."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.raw_lines(text_col)).alias("pos", "line"))


def join_lines(rows: DataFrame, by=("doc_id",), line: str = "line", sep: str = "\n") -> DataFrame:
    """Lines back to one text a key, in order of ``pos``."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", line))), lambda x: x[line])
    return rows.groupBy(*by).agg(F.array_join(texts, sep).alias("text"))


# --- Sections ----------------------------------------------------------------------------------------------------
def header_key(line):
    """What of a line is compared with the section keywords."""
    return T.strip(T.sub(F.lower(T.strip_emoji(line)), r":+$"))


def detect_sections(lines: DataFrame, lookups: Lookups = DEFAULT) -> DataFrame:
    """``lines`` with ``section``, the section whose heading the line is, or null. The keyword table is a fixed small one."""
    keywords = F.broadcast(lookups.section_keywords(lines.sparkSession).select(F.col("keyword").alias("_key"), "section"))
    return lines.withColumn("_key", header_key(F.col("line"))).join(keywords, "_key", "left").drop("_key")


def fill_sections(lines: DataFrame, lookups: Lookups = DEFAULT) -> DataFrame:
    """``doc_id, pos, line, section``: each line that isn't blank or a heading, with the section it stands in."""
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    found = detect_sections(lines, lookups)
    filled = found.withColumn("in_section", F.coalesce(F.last("section", ignorenulls=True).over(by_pos), F.lit("others")))
    return filled.where(F.col("section").isNull() & (T.strip(F.col("line")) != "")).select("doc_id", "pos", "line", F.col("in_section").alias("section"))


def segment(docs: DataFrame, lookups: Lookups = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section, text``: the long form of a document's sections; repeated ones are joined."""
    filled = fill_sections(explode_lines(docs, id_col, text_col), lookups)
    return join_lines(filled, ("doc_id", "section")).withColumn("text", T.strip(F.col("text")))


def section_map(sections: DataFrame) -> DataFrame:
    """``doc_id, sections map<string,string>``."""
    return sections.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("sections"))


# --- Formatting --------------------------------------------------------------------------------------------------
# All of it works on one row's array of lines: nothing is exploded, joined or shuffled.
def formatted_lines(text: Column, marker: str = "%%H%%") -> Column:
    """The lines of a cleaned text: headings in capitals at the margin, bodies indented behind the first one, page numbers,
    doubled headings and headings without a body gone. A line that starts with ``marker`` is a heading."""
    whole = T.normalize(T.strip_stray_section_tokens(T.fix_merged_headers(T.fix_ocr_spacing(text))))

    def read(raw: Column) -> Column:
        return T.let(T.clean_line(raw), lambda line: T.let(F.struct(line.startswith(marker).alias("forced"), T.strip(F.when(line.startswith(marker), F.substr(line, F.lit(len(marker) + 1))).otherwise(line)).alias("x")), kinded))

    def kinded(r: Column) -> Column:
        x = r["x"]
        return T.let(F.struct(x.alias("x"), ((x != "") & (r["forced"] | T.is_section_header(x))).alias("header")), told)

    def told(r: Column) -> Column:
        x, header = r["x"], r["header"]
        kind = F.when(header, "header").when(x == "", "blank").otherwise("body")
        title = T.sub(F.upper(T.sub(x, r"\s+", " ")), r"[\s:\-–]+$")
        gone = F.when(header, T.is_dual_header(x)).otherwise((F.length(x) <= 3) & x.rlike(P.PAGE_NUMBER))
        line = F.when(header, title).when(x.endswith("]"), T.sub(x, P.PAGE_TAG)).otherwise(x)
        return F.struct(kind.alias("kind"), line.alias("line"), gone.alias("gone"))

    kept = F.filter(F.transform(T.raw_lines(whole), read), lambda r: ~r["gone"])
    placed = F.transform(kept, lambda r, i: F.struct(r["kind"].alias("kind"), r["line"].alias("line"), i.alias("i")))
    parts = lambda p: F.struct(F.filter(p, lambda r: r["kind"] != "blank").alias("full"), F.size(p).alias("n"), F.array_min(F.transform(F.filter(p, lambda r: r["kind"] == "header"), lambda r: r["i"])).alias("first"))
    # Lambdas share no subexpressions: the whole formatting would be done for each of the three.
    return T.let(T.let(placed, parts), lambda s: _spaced(s["full"], s["n"], s["first"]))


def _spaced(full: Column, n: Column, first: Column) -> Column:
    """Lines that aren't blank, with the blank ones that stay between them: those behind a body, and one before a heading.
    ``first`` is the place of the first heading among all ``n`` lines."""
    empty = F.array().cast("array<string>")
    blanks = lambda k: F.array_repeat(F.lit(""), F.greatest(k, F.lit(0)).cast("int"))

    def shown(r: Column, i: Column) -> Column:
        before, after = F.get(full, i - 1), F.get(full, i + 1)
        closes = F.coalesce(before["kind"] == "body", F.lit(False))
        gap = F.when(closes, blanks(r["i"] - before["i"] - 1)).otherwise(empty)
        bare = F.coalesce(after["kind"], F.lit("header")) == "header"
        heading = F.concat(F.when(closes, F.array(F.lit(""))).otherwise(empty), F.when(bare, empty).otherwise(F.array(r["line"])))
        line = F.when(r["i"] > first, F.concat(F.lit("  "), r["line"])).otherwise(r["line"])
        return F.concat(gap, F.when(r["kind"] == "header", heading).otherwise(F.array(line)))

    last = F.get(full, F.size(full) - 1)
    tail = F.when(last["kind"] == "body", blanks(n - last["i"] - 1)).otherwise(empty)
    return F.concat(F.flatten(F.transform(full, shown)), tail)


def _cut_end(body: Column, blank) -> Column:
    """An array without what is ``blank`` at its end."""
    at = F.array_position(F.reverse(F.transform(body, lambda x: ~blank(x))), True)
    return F.when(at > 0, F.slice(body, F.lit(1), F.greatest(F.size(body) - at.cast("int") + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def _cut_start(body: Column, blank) -> Column:
    return F.reverse(_cut_end(F.reverse(body), blank))


def reordered(rows: Column) -> Column:
    """Experience sections, and work history found in terminal sections, stand before the first terminal section.

    Sections are rows of an array with a rank: what stands before the first terminal section, then sections of experience
    that stood behind it, then the rest. Work history in a terminal section is its end from the first six lines on that
    hold a date and a company; it goes to the last section of experience of the first rank, or else to one of its own.
    """
    empty = F.array().cast("array<string>")
    nothing, white = lambda x: x == "", lambda x: T.strip(x) == ""
    named = lambda name, names: F.upper(T.strip(name)).isin(*names)
    starts = F.filter(F.transform(rows, lambda x, i: F.when((x != "") & ~x.startswith(" ") & T.is_section_header(T.strip(x)), i).otherwise(-1)), lambda i: i >= 0)

    def cut(bounds: Column) -> Column:
        """Each section's heading (null before the first), body, and kind; ``bounds`` is where sections begin."""

        def section(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(bounds, k + 1), F.size(rows))
            name = F.get(rows, at)
            return F.struct(name.alias("name"), F.slice(rows, at + 2, end - at - 1).alias("body"), F.coalesce(named(name, P.TERMINAL_SECTIONS), F.lit(False)).alias("last"), F.coalesce(named(name, P.EXPERIENCE_SECTIONS), F.lit(False)).alias("work"))

        whole = F.transform(bounds, section)
        return F.transform(whole, lambda s: F.struct(s["name"].alias("name"), s["body"].alias("body"), s["last"].alias("last"), s["work"].alias("work"), F.when(s["last"], history(s["body"])).alias("at")))

    def history(body: Column) -> Column:
        """Where a body's work history begins, or null."""
        near = lambda i: F.array_join(F.slice(body, i + 1, F.lit(6)), " ")
        at = F.array_position(F.transform(body, lambda x, i: near(i).rlike(P.WORK_DATE) & near(i).rlike(P.WORK_COMPANY)), True)
        return F.when((F.size(body) >= 3) & (at > 0), at.cast("int") - 1)

    def ranked(sections: Column) -> Column:
        found = F.array_position(F.transform(sections, lambda s: s["last"]), True).cast("int") - 1
        return T.let(found, lambda first: F.when(first >= 0, T.let(split_at(sections, first), put_together)).otherwise(rows))

    def split_at(sections: Column, first: Column) -> Column:
        def split(s: Column, k: Column) -> Column:
            at = s["at"]
            kept = F.when(at.isNull(), s["body"]).otherwise(F.slice(s["body"], F.lit(1), at))
            stray = F.when(at.isNull(), empty).otherwise(_cut_start(F.slice(s["body"], at + 1, F.size(s["body"])), white))
            rank = F.when(k < first, 0).when(s["work"], 1).otherwise(2)
            return F.struct(rank.alias("rank"), s["name"].alias("name"), kept.alias("body"), s["work"].alias("work"), stray.alias("stray"))

        return F.transform(sections, split)

    def put_together(sections: Column) -> Column:
        stray = F.flatten(F.transform(sections, lambda s: s["stray"]))
        home = F.array_max(F.transform(sections, lambda s, k: F.when((s["rank"] == 0) & s["work"], k)))
        return T.let(F.struct(stray.alias("stray"), home.alias("home")), lambda x: placed(sections, x["stray"], x["home"]))

    def placed(sections: Column, stray: Column, home: Column) -> Column:
        joins = F.size(stray) > 0

        def told(s: Column, k: Column) -> Column:
            more = F.when(joins & (k == home), F.concat(_cut_end(s["body"], white), F.array(F.lit("")), stray)).otherwise(s["body"])
            return F.struct(s["rank"].alias("rank"), F.concat(F.when(s["name"].isNotNull(), F.array(F.lit(""), s["name"])).otherwise(empty), _cut_end(more, nothing)).alias("lines"), more.alias("more"))

        moved = F.exists(sections, lambda s: s["rank"] == 1)
        return F.when(moved | joins, T.let(F.transform(sections, told), lambda parts: in_order(parts, stray, home))).otherwise(rows)

    def in_order(parts: Column, stray: Column, home: Column) -> Column:
        of_rank = lambda r: F.flatten(F.transform(F.filter(parts, lambda p: p["rank"] == r), lambda p: p["lines"]))
        own = F.when((F.size(stray) > 0) & home.isNull(), F.concat(F.array(F.lit(""), F.lit("EXPERIENCE")), _cut_end(stray, nothing))).otherwise(empty)
        # Blank lines at a section's end go where another follows; the very last section keeps its own.
        end = F.element_at(F.filter(parts, lambda p: p["rank"] == 2), -1)
        tail = F.slice(end["more"], F.size(_cut_end(end["more"], nothing)) + 1, F.size(end["more"]))
        return _cut_start(F.concat(of_rank(0), own, of_rank(1), of_rank(2), tail), nothing)

    return T.let(F.concat(F.array(F.lit(-1)), starts), lambda bounds: T.let(cut(bounds), ranked))


def joined_dangling(rows: Column) -> Column:
    """Lines that start with ``&`` go on the end of the line before that isn't blank."""
    dangling = lambda x: T.strip(x).rlike(P.DANGLING_AND)

    def joined(kinds: Column) -> Column:
        """``kinds``: (line, place, whether it dangles, whether it is blank)."""
        return T.let(F.transform(F.filter(kinds, lambda r: ~r["dangles"] & ~r["blank"]), lambda r: r["i"]), lambda homes: put(kinds, homes))

    def put(kinds: Column, homes: Column) -> Column:
        loose = F.transform(F.filter(kinds, lambda r: r["dangles"]), lambda r: F.struct(F.array_max(F.filter(homes, lambda h: h < r["i"])).alias("home"), T.strip(r["line"]).alias("line"), r["i"].alias("i")))

        def whole(loose: Column) -> Column:
            own = F.filter(kinds, lambda r: ~r["dangles"] | F.exists(loose, lambda d: (d["i"] == r["i"]) & d["home"].isNull()))

            def more(r: Column) -> Column:
                behind = F.transform(F.filter(loose, lambda d: d["home"] == r["i"]), lambda d: d["line"])
                return F.when(F.size(behind) > 0, F.concat_ws(" ", T.sub(r["line"], r"\s+$"), F.array_join(behind, " "))).otherwise(r["line"])

            return F.transform(own, more)

        return T.let(loose, whole)

    kinds = F.transform(rows, lambda x, i: F.struct(x.alias("line"), i.alias("i"), dangling(x).alias("dangles"), (T.strip(x) == "").alias("blank")))
    return F.when(F.exists(rows, dangling), T.let(kinds, joined)).otherwise(rows)


FOOTER = "=" * 70


def format_documents(docs: DataFrame, links_col: str | None = None, light: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: cleaned, formatted, re-ordered, with the block of links and the footer. ``light`` only cleans."""
    links = F.col(links_col) if links_col else None
    cleaned = T.settled(docs.select(F.col(id_col).alias("doc_id"), T.clean(text_col, links).alias("text"), (links if links is not None else F.lit(None).cast("string")).alias("links")))
    if light:
        body = T.normalize(T.fix_merged_headers(T.fix_ocr_spacing("text")))
    else:
        body = F.array_join(T.let(T.let(formatted_lines(F.col("text")), reordered), joined_dangling), "\n")
    block = T.links_block(F.col("links")) if links_col else F.lit(None).cast("string")
    tail = F.when(block.isNotNull(), F.concat(F.lit(f"\n\n{FOOTER}\n\n"), block)).otherwise(F.lit(""))
    return cleaned.select("doc_id", F.concat(F.coalesce(body, F.lit("")), tail, F.lit(f"\n\n{FOOTER}")).alias("text"))
