"""Files: scans with reasons for rejection, kinds by content, and text of DOCX, RTF and plain files.

Binary files become rows in one narrow pass over ``binaryFile``; readers use the standard library only. PDF words come
from outside (``operators.layout`` takes them); old DOC files are told apart and rejected.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

EXTENSIONS, LARGEST = ("pdf", "docx", "doc"), 50 * 1024 * 1024
#: What reading a damaged archive or its parts may raise; an encrypted one raises a RuntimeError.
BROKEN = (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, OSError, EOFError, NotImplementedError, ValueError)
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _listed(files: DataFrame) -> DataFrame:
    """``path`` of each file that Spark's index of ``files`` has, as the column of that name spells it."""
    paths = [(re.sub(r"^(\w+):///+", r"\1:/", unquote(p)),) for p in files.inputFiles()]
    return files.sparkSession.createDataFrame(paths, "path string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, ext, length, content, reason`` of a folder's files but for temporary ones; ``reason`` is null for good ones.

    Names and lengths decide before any content is read: the scan that fetches contents has the length as a pushed filter,
    and rejects are listed without the content, which stays null. Files of no bytes, which Spark's scan passes over, come
    from its index of the folder, as large as the index that it holds anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    told = lambda df: df.where(~name.startswith("~")).withColumns({"name": name, "ext": ext})
    reason = F.when(~F.col("ext").isin(*EXTENSIONS), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > LARGEST, "too large")
    good = told(files.where(F.col("length") <= LARGEST)).where(F.col("ext").isin(*EXTENSIONS))
    columns = ["path", "name", "ext", "length", "content", "reason"]
    good = good.withColumn("reason", F.lit(None).cast("string")).select(columns)
    known = files.select("path", "length")
    empty = _listed(files).join(known.select("path"), "path", "left_anti").withColumn("length", F.lit(0).cast("long"))
    bad = told(known.unionByName(empty)).withColumn("reason", reason).where("reason is not null").withColumn("content", F.lit(None).cast("binary"))
    return good.unionByName(bad.select(columns))


def rejects(files: DataFrame) -> DataFrame:
    return files.where("reason is not null").select("path", "reason")


def distinct_files(files: DataFrame) -> DataFrame:
    """One row for each content; keyed by digest, so contents aren't compared by shuffling them."""
    first = files.groupBy(F.sha2("content", 256).alias("_d")).agg(F.min("path").alias("path"))
    return files.join(first.select("path"), "path", "left_semi")


def _zip_kind(content: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            types = z.read("[Content_Types].xml").decode("utf-8", "replace") if "[Content_Types].xml" in names else None
    except RuntimeError:
        return "encrypted"
    except BROKEN:
        return "unknown_zip"
    if types is None:
        return "unknown_zip"
    for kind, mark in (("docx", "wordprocessingml.document.main"), ("dotx", "wordprocessingml.template"), ("xlsx", "spreadsheetml.sheet.main"), ("pptx", "presentationml.presentation.main")):
        if mark in types:
            return kind
    if "themeManager" in types or "theme1.xml" in types:
        return "theme_only"
    return "docx" if "word/document.xml" in names else "unknown_zip"


def zip_kind(content: Column) -> Column:
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(_zip_kind)

    return F.pandas_udf(run, "string")(content)


def file_kind(content: Column) -> Column:
    """By the first bytes: a zip's kind (encrypted, or unknown_zip if it can't be read), rtf, ole2 or unknown."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "504B0304", zip_kind(content)).when(head.startswith("7B5C"), "rtf").when(head == "D0CF11E0", "ole2").otherwise("unknown")


#: The bytes that Windows-1252 gives signs of its own.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def plain_text(content: Column) -> Column:
    """UTF-8 (a mark at its start dropped) or, where it isn't, Windows-1252."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(F.translate(F.decode(content, "iso-8859-1"), _C1, _C1.encode("latin-1").decode("cp1252")))


# --- RTF ---------------------------------------------------------------------------------------------------------
#: Groups that hold no text.
RTF_SKIPPED = {"pict", "object", "fldinst", "stylesheet", "fonttbl", "colortbl", "info", "filetbl", "rsidtbl", "themedata", "colorschememapping", "latentstyles"}
_RTF = re.compile(r"(?P<open>\{(?:\\(?P<group>[a-z]+))?)|(?P<close>\})|\\'(?P<hex>[0-9a-fA-F]{2})|\\(?P<word>[a-z]+)-?\d*\s?|\\(?P<sign>[^a-z])|(?P<text>[^{}\\]+)")


def rtf_to_text(content: bytes) -> str:
    """The text of an RTF file: a scan of tokens; what is in skipped groups doesn't count."""
    out: list[str] = []
    depth, hidden = 0, None
    raw = content.decode("latin-1")
    at = 0
    while at < len(raw):
        m = _RTF.match(raw, at)
        if m is None:
            at += 1
            continue
        at = m.end() - 1 if m["sign"] else m.end()  # only the backslash goes: a brace behind it still opens or closes
        if m["open"]:
            depth += 1
            if m["group"]:
                at = m.end("open") - len(m["group"]) - 1  # the word itself is read next
                if hidden is None and m["group"] in RTF_SKIPPED:
                    hidden = depth
        elif m["close"]:
            hidden = None if hidden == depth else hidden
            depth -= 1
        elif hidden is None:
            if m["hex"]:
                out.append(chr(int(m["hex"], 16)))
            elif m["word"]:
                out.append({"par": "\n", "pard": "\n", "line": "\n", "tab": "\t"}.get(m["word"], ""))
            else:
                out.append(m["text"] or "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", "".join(out))).strip()


def rtf_text(content: Column) -> Column:
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else rtf_to_text(c))

    return F.pandas_udf(run, "string")(content)


# --- DOCX --------------------------------------------------------------------------------------------------------
BLOCK = "pos int, kind string, text string, style string, font_size int, is_bold boolean, mixed_bold boolean, has_borders boolean, runs array<struct<text:string,bold:boolean>>"
_COLUMNS = ["pos", "kind", "text", "style", "font_size", "is_bold", "mixed_bold", "has_borders", "runs"]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def _bold(run) -> bool:
    return run.find(f"{W}rPr/{W}b") is not None


def _paragraph(p) -> tuple:
    runs = [(_text(r), _bold(r)) for r in p.iter(f"{W}r")]
    style, size = p.find(f"{W}pPr/{W}pStyle"), p.find(f".//{W}r/{W}rPr/{W}sz")
    kinds = {b for t, b in runs if t.strip()}
    points = size.get(f"{W}val", "") if size is not None else ""
    return "paragraph", _text(p), style.get(f"{W}val", "Normal") if style is not None else "Normal", int(points) if points.isdigit() else None, any(_bold(r) for r in p.iter(f"{W}r")), len(kinds) == 2, None, [{"text": t, "bold": b} for t, b in runs if t]


def _table(t) -> tuple | None:
    rows = []
    for row in t.iter(f"{W}tr"):
        cells = dict.fromkeys(x for c in row.findall(f"{W}tc") if (x := "\n".join(_text(p) for p in c.iter(f"{W}p")).strip()))
        if cells:
            rows.append(list(cells))
    edges = t.find(f"{W}tblPr/{W}tblBorders")
    framed = edges is not None and any(e.get(f"{W}val", "none").lower() not in ("none", "nil", "") for e in edges)
    body = "\n".join((" | " if framed else "  ").join(r) for r in rows)
    return ("table", f"TABLE_START\n{body}\nTABLE_END" if framed else body, None, None, None, None, framed, None) if rows else None


def docx_blocks(content: bytes) -> tuple[list[tuple], list[tuple[str, str]]]:
    """A DOCX file's blocks (page headers, then paragraphs and tables in order) and its links (URI, text). Broken files have none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
            heads = [ElementTree.fromstring(z.read(n)) for n in sorted(names) if re.fullmatch(r"word/header\d+\.xml", n)]
            rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
    except (RuntimeError, *BROKEN):
        return [], []
    lines = dict.fromkeys(x for h in heads for p in h.iter(f"{W}p") if (x := _text(p).strip()))
    blocks = [("header", x, None, None, None, None, None, None) for x in lines]
    for child in body if body is not None else []:
        block = _paragraph(child) if child.tag == f"{W}p" else _table(child) if child.tag == f"{W}tbl" else None
        if block and block[1].strip():
            blocks.append(block)
    targets = {r.get("Id"): r.get("Target") for r in rels if r.get("TargetMode") == "External"}
    links = [(targets[k], _text(h)) for h in (body.iter(f"{W}hyperlink") if body is not None else []) if (k := h.get(f"{R}id")) in targets]
    return blocks, links


def read_docx(files: DataFrame, id_col: str = "path") -> DataFrame:
    """``doc_id, pos, kind, text, style, font_size, is_bold, mixed_bold, has_borders, runs``: a row a block."""

    def run(batches):
        for pdf in batches:
            rows = [(key, n, *b) for key, c in zip(pdf["doc_id"], pdf["content"], strict=True) for n, b in enumerate(docx_blocks(c)[0])]
            yield pd.DataFrame(rows, columns=["doc_id", *_COLUMNS]).astype({"font_size": "Int64", "is_bold": object, "mixed_bold": object, "has_borders": object})

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("doc_id"), "content").mapInPandas(run, f"doc_id {kind}, {BLOCK}")


def docx_links(files: DataFrame, id_col: str = "path") -> DataFrame:
    """``doc_id, uri, display_text``: links joined to their targets."""

    def run(batches):
        for pdf in batches:
            rows = [(key, *x) for key, c in zip(pdf["doc_id"], pdf["content"], strict=True) for x in docx_blocks(c)[1]]
            yield pd.DataFrame(rows, columns=["doc_id", "uri", "display_text"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("doc_id"), "content").mapInPandas(run, f"doc_id {kind}, uri string, display_text string")


def split_inline_sections(text: Column) -> Column:
    """Array of (text, is_header): a paragraph cut at section names inside it."""
    between, found = F.split(text, P.INLINE_SECTION, -1), F.regexp_extract_all(text, F.lit(P.INLINE_SECTION), F.lit(1))
    both = F.flatten(F.zip_with(between, found, lambda a, b: F.array(F.struct(T.strip(a).alias("text"), F.lit(False).alias("is_header")), F.struct(T.strip(F.coalesce(b, F.lit(""))).alias("text"), F.lit(True).alias("is_header")))))
    return F.filter(both, lambda x: x["text"] != "")


def docx_lines(blocks: DataFrame, marker: str = "%%H%%") -> DataFrame:
    """``doc_id, text`` of blocks: headings (by style, font, bold or words) marked, long mixed paragraphs cut at section
    names, glued section names given their own line."""
    text, size, bold = T.strip(F.col("text")), F.col("font_size"), F.coalesce("is_bold", F.lit(False))
    bare = T.sub(text, r"[\s:\-–]+$")
    caps = T.is_upper(bare)
    by_font = F.coalesce(size.isNotNull() & (F.length(text) <= 65) & (text.rlike(r":( -)?$") | caps) & (caps | (size >= 36)), F.lit(False))
    heading = (F.col("kind") == "paragraph") & (F.coalesce(F.col("style"), F.lit("")).rlike(r"(?i)^Heading\d+") | by_font | T.is_strong_heading(F.col("text"), size, bold))
    blob = (F.col("kind") == "paragraph") & (F.length("text") > 200) & F.coalesce("mixed_bold", F.lit(False)) & F.col("text").rlike(P.INLINE_SECTION)
    # Neighbouring runs of one weight are one piece.
    merged = F.aggregate(F.coalesce("runs", F.array()), F.array().cast("array<struct<text:string,bold:boolean>>"), lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["bold"] == r["bold"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(F.element_at(acc, -1)["text"], r["text"]).alias("text"), r["bold"].alias("bold"))))).otherwise(F.concat(acc, F.array(r))))
    named = lambda x: (F.length(x) <= 65) & ~x.rlike(P.HEADER_NOT) & x.rlike(P.HEADER) & ~x.rlike(P.CONTENT_NOT_HEADER)
    pieces = F.flatten(F.transform(merged, lambda r: F.transform(split_inline_sections(r["text"]), lambda f: F.struct(f["text"].alias("text"), (f["is_header"] | (r["bold"] & named(f["text"]))).alias("is_header")))))
    glued = F.transform(F.filter(F.split(text, P.SECTION_SPLIT), lambda x: T.strip(x) != ""), lambda x: F.struct(T.strip(x).alias("text"), heading.alias("is_header")))
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("is_header")))
    parts = F.when(blob, pieces).when(F.col("kind") == "paragraph", glued).otherwise(whole)
    rows = blocks.select("doc_id", "pos", F.array_join(F.transform(parts, lambda x: F.concat(F.when(x["is_header"], marker).otherwise(""), x["text"])), "\n").alias("line"))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return joined.withColumn("text", T.sub(F.col("text"), P.EQUALS_PHONE, "$1"))
