"""Text cleaning and line tests as Column functions. All run JVM-side but ``nfc``, which Spark has no function for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: White space, Unicode's included.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(x, F.lit(WHITE))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it: lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are, but what their columns say is worked out once: no filter is pushed below this, and no
    projection above it is merged with those below, so costly expressions are not copied."""
    return df.select(F.inline(F.array(F.struct("*"))))


def spread(df: DataFrame, *by) -> DataFrame:
    """The rows dealt by hash over four tasks a core, or as many as shuffles have: costly work on rows of few bytes would
    else be done by the one or two tasks that read them. Later windows and groups by these keys take no shuffle of their own."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *by)


def sub(x: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(x, pattern, to)


def each_line(text: Column, f) -> Column:
    """``f`` applied to each line between line feeds."""
    return F.array_join(F.transform(F.split(text, "\n", -1), f), "\n")


def raw_lines(text) -> Column:
    return F.split(_col(text), P.LINE_BREAK, -1)


def lines(text) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(raw_lines(text), strip), lambda x: x != "")


# --- Line tests --------------------------------------------------------------------------------------------------
def strip_emoji(x: Column) -> Column:
    return strip(sub(x, P.EMOJI))


def clean_bullet(x: Column) -> Column:
    return strip(sub(x, P.BULLET))


def is_bullet(x: Column) -> Column:
    return strip(x).rlike(P.BULLET)


def is_separator(x: Column) -> Column:
    return strip(x).rlike(P.SEPARATOR)


def is_upper(x: Column) -> Column:
    """Some letter, and none in lower case."""
    return (x == F.upper(x)) & (F.upper(x) != F.lower(x))


def is_section_header(x: Column) -> Column:
    return let(strip(x), lambda s: (s != "") & (F.length(s) <= 65) & ~s.rlike(P.HEADER_NOT) & (s.rlike(P.HEADER) | s.rlike(P.HEADER_SPACED)))


def is_strong_heading(line: Column, font_size: Column | None = None, is_bold: Column | None = None, x_pos: Column | None = None, page_width: Column | None = None) -> Column:
    """A heading by its font (points, or half points over 100), by bold capitals, or by its words."""
    s = strip(line)
    label, bold = sub(s, r"[\s:\-–]+$"), F.coalesce(is_bold, F.lit(False)) if is_bold is not None else F.lit(False)
    by_font = F.lit(False)
    if font_size is not None:
        by_font = F.coalesce(font_size >= F.when(font_size > 100, 36).otherwise(14), F.lit(False)) & (F.length(label) <= 65)
    by_caps = bold & is_upper(label) & (F.length(label) <= 65)
    return (s != "") & (F.length(s) <= 80) & (by_font | by_caps | s.rlike(P.HEADER))


def block_confidence(text: Column, font_size: Column, is_bold: Column, is_heading: Column, source: Column) -> Column:
    add = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    score = 0.5 + F.when(source == "native", 0.2).when(source == "table", 0.1).otherwise(0.0)
    score = score + add(is_bold, 0.1) + add(font_size >= 36, 0.05) + add(is_heading, 0.05) - add(F.length(strip(text)) < 10, 0.2)
    return F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def is_dual_header(line: Column) -> Column:
    """A line that is two known section names run together: letters parted by spaces, or two to four words."""
    known = "|".join(sorted(P.KNOWN_SECTIONS, key=len, reverse=True))
    s = strip(line)
    letters = F.replace(s, F.lit(" "), F.lit(""))
    spaced = s.rlike(r"^[A-Z](\s[A-Z])+$") & (F.regexp_count(letters, F.lit(known)) >= 2)
    words = F.split(F.upper(s), r"\s+")
    halves = F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda k: F.array_join(F.slice(words, F.lit(1), k), "").isin(*P.KNOWN_SECTIONS) & F.array_join(F.slice(words, k + 1, F.size(words)), "").isin(*P.KNOWN_SECTIONS))
    return spaced | (~s.rlike(r"^[A-Z](\s[A-Z])+$") & F.size(words).between(2, 4) & halves)


# --- Script ------------------------------------------------------------------------------------------------------
def detect_script(text) -> Column:
    count = lambda block: F.regexp_count(_col(text), F.lit(block))
    return F.when(count(r"[\x{0900}-\x{097F}]") > 50, "devanagari").when(count(r"[\x{0B80}-\x{0BFF}]") > 50, "tamil").otherwise("latin")


def ocr_language(script) -> Column:
    return F.when(_col(script) == "devanagari", "eng+hin").when(_col(script) == "tamil", "eng+tam").otherwise("eng")


# --- Cleaning, in the order that ``clean`` applies it ------------------------------------------------------------
def collapse_spaced_letters(text) -> Column:
    """Lines like ``S K I L L S`` lose their spaces; two or more spaces part words."""

    def joined(line: Column) -> Column:
        s = strip(line)
        groups = F.split(s, r"\s{2,}")
        tight = F.array_join(F.transform(groups, lambda g: F.when(g.rlike(r"^\S(\s+\S)*$"), sub(g, r"\s+")).otherwise(g)), " ")
        return F.when(s.rlike(r"^[A-Za-z](\s[A-Za-z])+$"), F.upper(tight)).when(s.rlike(r"^([A-Z]\s)+[A-Z](\s{2,}([A-Z]\s)*[A-Z])?$"), tight).otherwise(line)

    return each_line(_col(text), joined)


def fix_intraword_spaces(text, wide: Column) -> Column:
    """Where the extractor's tolerance was ``wide``, short lower-case fragments join the token before them."""

    def glued(line: Column) -> Column:
        parts = F.split(line, " ", -1)
        low = lambda x: x.rlike("^[a-z]")

        def step(done: Column, i: Column) -> Column:
            part, last, after = F.get(parts, i), F.element_at(done, -1), F.get(parts, i + 1)
            open_end = last.rlike("[a-z]$")
            short = part.rlike("^[a-z]{1,2}$") & open_end & F.coalesce(low(after), F.lit(False)) | part.rlike("^[a-z]{1,3}$") & open_end
            return F.when(short, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, part)))).otherwise(F.concat(done, F.array(part)))

        folded = F.aggregate(F.sequence(F.lit(1), F.size(parts) - 1), F.slice(parts, 1, 1), step)
        return F.when(F.size(parts) >= 3, F.array_join(folded, " ")).otherwise(line)

    return F.when(wide, each_line(_col(text), glued)).otherwise(_col(text))


def repair_compact_text(text) -> Column:
    """Long lines of mixed case without a space are split where case or digits turn."""

    def split(line: Column) -> Column:
        s = strip(line)
        packed = (F.length(line) > 40) & (F.length(s) > 40) & ~s.contains(" ") & s.rlike(r"\p{Ll}") & s.rlike(r"\p{Lu}")
        return F.when(packed, F.concat(F.substring(line, F.lit(1), F.length(line) - F.length(s)), sub(s, P.COMPACT_SPLIT, " "))).otherwise(line)

    return each_line(_col(text), split)


def clean_name_line(text) -> Column:
    """Of the first line that isn't blank (among five), what follows a name in capitals goes."""
    rows = F.split(_col(text), "\n", -1)
    at = F.array_position(F.transform(F.slice(rows, 1, 5), lambda x: strip(x) != ""), True)
    line = F.get(rows, (at - 1).cast("int"))
    name = strip(F.regexp_extract(strip(line), P.NAME_GARBAGE, 1))
    good = (at > 0) & (name != "") & F.forall(F.split(name, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    indent = F.regexp_extract(line, r"^(\s*)", 1)
    return F.when(good, F.array_join(F.transform(rows, lambda x, i: F.when(i == at - 1, F.concat(indent, name)).otherwise(x)), "\n")).otherwise(_col(text))


def inject_links(text, links: Column) -> Column:
    """Behind the first mention of each link's display text, ``[uri]``; ``links`` is an array of (uri, display_text)."""

    def put(done: Column, link: Column) -> Column:
        display, uri = F.trim(link["display_text"]), F.trim(link["uri"])
        usable = (display != "") & (uri != "") & ~((F.length(display) > 30) & ~display.contains(" ") & ~display.rlike(r"^[\w.\-@/:#]+$"))
        at = F.position(F.lower(display), F.lower(done))
        tail = F.substring(done, at + F.length(display), F.length(done))
        free = (at > 0) & ~tail.rlike(r"^\s*[\[(]?https?://")
        return F.when(usable & free, F.concat(F.substring(done, F.lit(1), at - 1), display, F.lit(" ["), uri, F.lit("]"), tail)).otherwise(done)

    return F.aggregate(F.coalesce(links, F.array()), _col(text), put)


def links_block(links: Column) -> Column:
    """The block of links that ends a formatted text: one line a URI, the first display text of each, garbled ones hidden."""
    uris = F.array_distinct(F.filter(F.transform(links, lambda x: F.trim(x["uri"])), lambda u: u != ""))

    def line(uri: Column) -> Column:
        shown = F.trim(F.coalesce(F.get(F.filter(links, lambda x: F.trim(x["uri"]) == uri), F.lit(0))["display_text"], F.lit("")))
        hidden = (shown == "") | (F.lower(shown) == F.lower(uri)) | ((F.length(shown) > 30) & ~shown.contains(" ") & ~shown.rlike(r"^[\w.\-@/:#]+$"))
        return F.when(hidden, F.concat(F.lit("  "), uri)).otherwise(F.concat(F.lit("  "), shown, F.lit(": "), uri))

    return F.when(F.size(uris) > 0, F.concat(F.lit("LINKS / URLS DETECTED\n"), F.array_join(F.transform(uris, line), "\n")))


def clean_pdf_artifacts(text) -> Column:
    out = sub(sub(_col(text), P.CID, " "), P.MAILTO_TAG)
    return sub(sub(sub(out, P.ID_GARBAGE, "$1"), P.EQUALS_PHONE, "$1"), P.HASH_LEAD)


def nfc(text: Column) -> Column:
    """Unicode's composed form."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return F.pandas_udf(run, "string")(text)


def clean_unicode(text, strict_compat: bool = False) -> Column:
    """Composed characters; no invisible, control or emoji ones; plain quotes and dashes; bullets as ``- ``.

    ``strict_compat`` also takes a lower-case ``e`` at a line's start for a bullet, as old extractors wrote it.
    """
    out = each_line(nfc(_col(text)), lambda x: sub(x, P.SIGN_BULLET, "$1- "))
    out = sub(out, f"{P.ZERO_WIDTH}|{P.CONTROL}|{P.EMOJI_CLEANED}")
    out = F.translate(out, "".join(P.QUOTES) + P.DELETED, "".join(P.QUOTES.values()))
    for sign, plain in P.LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    glyphs = re.escape(P.BULLET_GLYPHS) + ("e" if strict_compat else "")
    return each_line(out, lambda x: sub(x, rf"^(\s*)[{glyphs}]\s*", "$1- "))


def fix_ocr_spacing(text) -> Column:
    """Runs of single capitals are joined within parts that two or more spaces end; those spaces become one."""
    runs = r"\b[A-Z](?: [A-Z]){2,}\b"

    def joined(part: Column) -> Column:
        between, found = F.split(part, runs, -1), F.regexp_extract_all(part, F.lit(runs), F.lit(0))
        return F.when(part.rlike(runs), F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(F.replace(b, F.lit(" "), F.lit("")), F.lit("")))), "")).otherwise(part)

    return F.array_join(F.transform(F.split(_col(text), "  +", -1), joined), " ")


def rewrite(x: Column, pattern: str, table: dict[str, str]) -> Column:
    """What ``pattern`` finds becomes what ``table`` has for it, as it is or else in lower case; the rest stays.

    One alternation looks a text over once, however long the table is, and only where something changes it is cut by it;
    what is written isn't looked at again."""
    known = F.create_map(*[F.lit(y) for pair in table.items() for y in pair])

    def rewritten(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        pairs = F.transform(found, lambda w: F.struct(w.alias("old"), F.coalesce(F.try_element_at(known, w), F.try_element_at(known, F.lower(w)), w).alias("new")))
        return let(pairs, lambda pairs: F.when(F.exists(pairs, lambda w: w["old"] != w["new"]), put(x, pairs)).otherwise(x))

    def put(x: Column, pairs: Column) -> Column:
        return F.array_join(F.zip_with(F.split(x, pattern, -1), pairs, lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")

    return let(x, rewritten)


def fix_merged_headers(text) -> Column:
    """Headers whose words ran together, and misspelt ones, in one pass."""
    glued = {w.replace(" ", ""): w for w in P.MERGED_HEADERS} | P.OTHER_HEADERS
    some = rf"\b(?:(?i:{'|'.join(glued)})|{'|'.join(P.CAPITAL_HEADERS)})\b"
    return rewrite(_col(text), some, {k.lower(): v for k, v in glued.items()} | P.CAPITAL_HEADERS)


def strip_stray_section_tokens(text) -> Column:
    return each_line(_col(text), lambda x: F.when((strip(x) != "") & ~is_section_header(x), sub(sub(x, P.INLINE_SECTION), r"\s+$")).otherwise(x))


def normalize(text) -> Column:
    return strip(sub(F.replace(sub(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), "\r"), F.lit("\t"), F.lit(" ")), r"\n{3,}", "\n\n"))


def clean_line(line: Column) -> Column:
    return strip(sub(line, " {2,}", " "))


def clean(text, links: Column | None = None, wide: Column | None = None, strict_compat: bool = False) -> Column:
    """All of the above that come before lines are formatted."""
    out = collapse_spaced_letters(text)
    out = fix_intraword_spaces(out, wide) if wide is not None else out
    out = clean_name_line(repair_compact_text(out))
    out = inject_links(out, links) if links is not None else out
    return clean_unicode(clean_pdf_artifacts(out), strict_compat)


# --- Sentences and lists -----------------------------------------------------------------------------------------
def title_case(x: Column) -> Column:
    """Each run of ASCII letters with its first in upper case."""
    words, gaps = F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0)), F.split(x, "[A-Za-z]+", -1)
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(F.initcap(w), F.lit("")))), "")


def part_connectives(x: Column) -> Column:
    """A connective glued to a word of four letters or more is parted from it, but in words that only end like one."""
    # Whether a word ends in one is asked first: few do, and only those are looked for among the others.
    ends = rf"(?=[a-z]{{6}}[a-z]*+(?<={'|'.join(P.CONNECTIVES.split('|'))}))"
    return sub(x, rf"(?<![a-z]){ends}(?!(?:{'|'.join(P.NOT_GLUED)})(?![a-z]))([a-z]{{4,}})({P.CONNECTIVES})(?![a-z])", "$1 $2")


def _by_first_letter(words: tuple[str, ...]) -> str:
    """An alternation of ``words``, in order where two begin alike. Most places of a text begin none, so the first letter is
    asked for before anything else, by fours; a word that ends in a full stop begins a word, and its stop begins no other."""

    def spelt(w: str) -> str:
        rest = re.escape(w[1:])
        return rest + rf"(?<=\b{re.escape(w)})(?!NET)" if w.endswith(".") else rest

    first = list(dict.fromkeys(w[0].lower() for w in words))
    branch = {a: re.escape(a) + "(?:" + "|".join(spelt(w) for w in words if w[0].lower() == a) + ")" for a in first}
    fours = [first[i : i + 4] for i in range(0, len(first), 4)]
    return f"(?=[{''.join(first)}])(?:" + "|".join(f"(?=[{''.join(some)}])(?:{'|'.join(branch[a] for a in some)})" for some in fours) + ")"


#: Names like Node.js and abbreviations.
_SPELT = _by_first_letter(P.PROTECTED)
#: White space behind a sentence's end, which no abbreviation is.
_SENTENCE_END = r"(?<=[.!?])(?<!\b(?i:" + "|".join(re.escape(w) for w in P.PROTECTED if w.endswith(".")) + r"))\s+"


def sentences(text, least: int = 15) -> Column:
    """Sentences of ``least`` characters or more: lines joined without bullets, glued connectives parted, names like Node.js
    spelt as in the table, split behind ``. ! ?``; numbers like 2.5 and abbreviations like e.g. don't end one. Null if there
    are none. Each step is worked out once: where the text is a costly expression, ``settled`` keeps it from being copied."""
    rows = F.transform(raw_lines(sub(F.replace(strip(_col(text)), F.lit("\t"), F.lit(" ")), "\r")), lambda x: strip(sub(x, P.SUMMARY_LEAD)))
    joined = F.array_join(F.filter(rows, lambda x: x != ""), " ")
    table = {w.lower(): w for w in reversed(P.PROTECTED)}

    def cut(x: Column) -> Column:
        # Spelling changes neither a sentence's length nor where it ends, so only those that stay are looked over.
        kept = F.filter(F.transform(F.split(x, _SENTENCE_END), strip), lambda s: F.length(s) >= least)
        return F.transform(kept, lambda s: rewrite(s, f"(?i){_SPELT}", table))

    return let(let(strip(sub(part_connectives(joined), " {2,}", " ")), cut), lambda kept: F.when(F.size(kept) > 0, kept))


def line_list(text) -> Column:
    """Items of a bulleted list: a bullet opens one, other lines go on with it."""
    kept = F.filter(F.transform(lines(text), strip_emoji), lambda x: ~is_separator(x))
    rows = F.filter(F.transform(kept, lambda x: F.struct(is_bullet(x).alias("opens"), clean_bullet(x).alias("x"))), lambda r: r["x"] != "")
    # Items are joined by a mark that no line holds, then cut there: one pass, however many there are.
    marked = F.transform(rows, lambda r, i: F.concat(F.when(i == 0, "").when(r["opens"], "\n").otherwise(" "), r["x"]))
    return let(F.array_join(marked, ""), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1)))
