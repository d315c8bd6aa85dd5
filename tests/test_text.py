"""Cleaning and line functions against expected strings."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: T.collapse_spaced_letters(F.lit("S K I L L S\nplain text\nW O R K  X P")), "SKILLS\nplain text\nWORK XP"),
        (lambda: T.fix_intraword_spaces(F.lit("Devel op er of things"), F.lit(True)), "Developerof things"),
        (lambda: T.fix_intraword_spaces(F.lit("Devel op er"), F.lit(False)), "Devel op er"),
        (lambda: T.repair_compact_text(F.lit("SeniorSoftwareEngineerAtSomeCompanyNamedAcmeCorp")), "Senior Software Engineer At Some Company Named Acme Corp"),
        (lambda: T.repair_compact_text(F.lit("ShortOne")), "ShortOne"),
        (lambda: T.clean_name_line(F.lit("\nJOHN SMITH | x9 foo\nJOHN SMITH | x9")), "\nJOHN SMITH\nJOHN SMITH | x9"),
        (lambda: T.clean_pdf_artifacts(F.lit("a(cid:12)b [mailto:x@y.z]\nSAP ID: 1234#%&\n=+9198\n# Head")), "a b\nSAP ID: 1234\n+9198\nHead"),
        (lambda: T.clean_unicode(F.lit("“q” – ﬁne​ 🙂é\n● dot\n> arrow\nend")), '"q" - fine é\n- dot\n- arrow\nend'),
        (lambda: T.clean_unicode(F.lit("email"), strict_compat=True), "- mail"),
        (lambda: T.fix_ocr_spacing(F.lit("A B C  dog E F G h")), "ABC dog EFG h"),
        (lambda: T.fix_merged_headers(F.lit("workexperience SUMARY ACADEMICQUALIFICATION")), "WORK EXPERIENCE SUMMARY EDUCATION"),
        (lambda: T.strip_stray_section_tokens(F.lit("Education\nmy Education and Summary here")), "Education\nmy  and  here"),
        (lambda: T.normalize(F.lit(" a\r\n\r\n\n\nb\tc \r")), "a\n\nb c"),
        (lambda: T.inject_links(F.lit("see My Site and my site"), F.array(F.struct(F.lit("http://s.org").alias("uri"), F.lit("My site").alias("display_text")))), "see My site [http://s.org] and my site"),
        (lambda: T.links_block(F.array(*[F.struct(F.lit(u).alias("uri"), F.lit(d).alias("display_text")) for u, d in (("http://a", "A"), ("http://a", "B"), ("http://b", ""))])), "LINKS / URLS DETECTED\n  A: http://a\n  http://b"),
        (lambda: T.title_case(F.lit("foo's b-c4d")), "Foo'S B-C4D"),
        (lambda: T.clean_bullet(F.lit("  •– ➔ x")), "– ➔ x"),
        (lambda: T.detect_script(F.lit("ह" * 51)), "devanagari"),
        (lambda: T.ocr_language(T.detect_script(F.lit("த" * 51))), "eng+tam"),
        (lambda: T.detect_script(F.lit("ह" * 50)), "latin"),
        (lambda: T.sentences(F.lit("• Worked on 2.5 things well. And then some more!\nshort.")), ["Worked on 2.5 things well.", "And then some more!"]),
        (lambda: T.sentences(F.lit("too short.")), None),
        (lambda: T.line_list(F.lit("• a\nb\n=====\n• c\n\nd")), ["a b", "c d"]),
        (lambda: T.line_list(F.lit("")), []),
        (lambda: T.block_confidence(F.lit("long enough text"), F.lit(40), F.lit(True), F.lit(True), F.lit("native")), 0.9),
        (lambda: T.block_confidence(F.lit("x"), F.lit(None).cast("int"), F.lit(False), F.lit(False), F.lit("ocr")), 0.3),
    ],
)
def test_text(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(
    "line, want",
    [("Work Experience:", True), ("My skills", False), ("S K I L L S", True), ("skills " * 12, False), ("Key Achievements & Awards", True), ("hello", False), ("", False)],
)
def test_headers(spark, line, want):
    assert one(spark, T.is_section_header(F.lit(line))) is want


def test_strong_headings_and_dual_ones(spark):
    assert one(spark, T.is_strong_heading(F.lit("Anything"), F.lit(15)))
    assert one(spark, T.is_strong_heading(F.lit("BOLD CAPS:"), F.lit(None).cast("int"), F.lit(True)))
    assert not one(spark, T.is_strong_heading(F.lit("Plain words"), F.lit(None).cast("int"), F.lit(False)))
    assert [one(spark, T.is_dual_header(F.lit(x))) for x in ("SUMMARY SKILLS", "S U M M A R Y S K I L L S", "SUMMARY", "WORK EXPERIENCE", "KEY PROJECTS SKILLS")] == [True, True, False, False, True]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab •-*=\n\t\r é ", max_size=30), min_size=1, max_size=20))
def test_lines_are_python_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.x for r in df.select("i", T.lines("t").alias("x")).collect()}
    assert got == {i: [x.strip() for x in t.splitlines() if x.strip()] for i, t in enumerate(texts)}


def test_nfc(spark):
    assert one(spark, T.nfc(F.lit("é"))) == unicodedata.normalize("NFC", "é")


def test_formatting_is_worked_out_once(spark):
    """The lines of a text are read once, not for each use that is made of them."""
    from quillspark.operators import segment

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").select(segment.formatted_lines(F.col("text"), marker="%%once%%").alias("x"))
    plan = docs._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("%%once%%") <= 2
