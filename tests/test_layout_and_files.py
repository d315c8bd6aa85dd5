"""Layout from words, files, sections, formatting, upserts, forms, streams and whole records."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions.lookups import DEFAULT, Lookups
from quillspark.operators import form, layout, segment, upsert
from quillspark.plans import record, registry
from quillspark.sources import readers
from quillspark.streaming import landing

WORDS = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double"


def words(spark, rows, page=1):
    return spark.createDataFrame([(1, page, t, float(x), float(x + 5 * len(t)), float(y), float(y + 10), 600.0, 800.0) for t, x, y in rows], WORDS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


EMPTY = "doc_id long, x0 double, x1 double, top double, bottom double, width double, height double"


# --- Layout ------------------------------------------------------------------------------------------------------
def test_buckets_round_halves_to_even(spark):
    assert [one(spark, layout.bucket(F.lit(x), 3)) for x in (1.5, 4.5, 7.6)] == [0, 6, 9]


def two_columns(spark):
    rows = [(f"left{i}.", 20 + 12 * (i % 5), 20 * i) for i in range(15)] + [(f"Right{i}", 350 + 12 * (i % 5), 20 * i) for i in range(15)]
    return words(spark, rows)


def test_desert_gap_and_layout(spark):
    w = two_columns(spark)
    assert [tuple(r) for r in layout.desert(w).collect()] == [(1, 232.5, 225)] or layout.desert(w).first().width >= 200
    assert layout.top_gaps(w, 2).where("rank = 1").first().gap == 350 - 68
    lay = layout.detect_layout(w, spark.createDataFrame([], EMPTY), spark.createDataFrame([], EMPTY)).first()
    assert lay.kind == "word_gap" and 68 < lay.col_x < 350 and lay.header_end_y == 0
    one_column = words(spark, [(f"w{i}", 10 * (i % 55), 20 * (i // 55)) for i in range(110)])
    assert layout.detect_layout(one_column, spark.createDataFrame([], EMPTY), spark.createDataFrame([], EMPTY)).first().kind == "single"
    bar = spark.createDataFrame([(1, 0.0, 150.0, 30.0, 700.0, 150.0, 670.0)], EMPTY)
    got = layout.detect_layout(one_column, spark.createDataFrame([], EMPTY), bar).first()
    assert (got.kind, got.col_x, got.header_end_y) == ("sidebar", 155.0, 30.0)
    rules = spark.createDataFrame([(1, 0.0, 280.0, 100.0, 100.0, 280.0, 0.0), (1, 300.0, 590.0, 100.0, 100.0, 290.0, 0.0)], EMPTY)
    assert layout.detect_layout(one_column, rules, spark.createDataFrame([], EMPTY)).first().kind == "paired_hlines"


def test_desert_that_reaches_the_edge(spark):
    w = words(spark, [("a", x, 0) for x in range(0, 300, 5)])
    assert tuple(layout.desert(w).first()) == (1, (60 + 96) / 2 * 5, (96 - 60) * 5)


def test_continuing_rows_are_no_columns(spark):
    w = words(spark, [("and", 100, 10 * i) for i in range(5)] + [("more", 300, 10 * i) for i in range(5)])
    border = spark.createDataFrame([(1, 200.0)], "doc_id long, col_x double")
    assert layout.is_two_column(w, border).first().real is False
    assert layout.redetect(w, border).first().col_x == 200.0


def test_date_labels_and_row_aware_text(spark):
    rows = [("March", 20, 0), ("2022", 50, 0), ("-", 80, 0), ("Employer:", 200, 0), ("Acme", 260, 0), ("Present", 20, 12), ("2019", 20, 30), ("-", 50, 30), ("2020", 60, 30), ("Role:", 200, 30), ("EDUCATION", 200, 45), ("B.Tech", 200, 60)]
    w = words(spark, rows)
    assert layout.probe_date_labels(w).first().date_labels is True
    assert layout.label_boundary(w).first().boundary == 90
    text = layout.row_aware_text(w, spark.createDataFrame([(1, 140)], "doc_id long, boundary int")).first().text
    assert text == "March 2022 - Present Employer: Acme\n 2019 - 2020 Role:\n\nEDUCATION\n B.Tech"
    assert one(spark, layout.is_date_label_layout(F.lit(140.0), F.lit(600.0))) and not one(spark, layout.is_date_label_layout(F.lit(None).cast("double"), F.lit(600.0)))


def test_two_column_text_links_and_crops(spark):
    w = two_columns(spark).where("top < 40")
    borders = spark.createDataFrame([(1, 200.0, -1.0)], "doc_id long, col_x double, header_end_y double")
    assert layout.two_column_text(w, borders).first().text == "left0.\nleft1.\nRight0\nRight1"
    links = spark.createDataFrame([(1, 1, "http://x", 19.0, 0.0, 60.0, 9.0)], "doc_id long, page int, uri string, x0 double, y0 double, x1 double, y1 double")
    assert layout.link_display(links, w).first().display_text == "left0."
    assert layout.crop(w, F.lit(0), F.lit(0), F.lit(300), F.lit(15)).count() == 1


def test_equal_links_and_characters_meet_once(spark, monkeypatch):
    """Copies of boxes and characters show as often as they are there, but one of each is compared."""
    met, real = [], layout.overlaps
    monkeypatch.setattr(layout, "overlaps", lambda a, b, *more: met.append((a.count(), b.count())) or real(a, b, *more))
    links = [(1, 1, f"u{i}", 0.0, 0.0, 30.0, 9.0) for i in range(50)] + [(1, 1, "none", None, 0.0, 30.0, 9.0), (1, 2, "far", 0.0, 0.0, 30.0, 9.0)]
    chars = [(1, 1, "b", 9.0, 12.0, 1.0, 5.0)] * 3 + [(1, 1, "a", 9.0, 12.0, 2.0, 5.0), (1, 1, "a", 9.0, 12.0, 1.0, 5.0), (1, 1, "z", 2.0, 5.0, 1.0, 5.0), (1, 1, None, 2.0, 5.0, 1.0, 5.0), (1, 1, "y", 40.0, 44.0, 1.0, 5.0)]
    got = layout.link_display(spark.createDataFrame(links, "doc_id long, page int, uri string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(chars, "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double"))
    assert {r.uri: r.display_text for r in got.collect()} == {f"u{i}": "zaabbb" for i in range(50)} | {"none": "", "far": ""}
    assert met == [(2, 6)]


def test_tolerance_sidebars_and_images(spark):
    rng, x, rows = random.Random(1), 0.0, []
    for i in range(400):
        rows.append(("c", x, 0.0))
        x += 5 + (rng.choice([0.1, 0.2, 0.3]) if i % 6 else 9 + rng.random())
    got = layout.x_tolerance(spark.createDataFrame([(1, 1, t, a, a + 5, y, y + 10, 600.0, 800.0) for t, a, y in rows], WORDS)).first()
    assert 1 <= got.tolerance <= 2
    assert layout.x_tolerance(words(spark, [("a", 0, 0)])).first().tolerance == 3
    rect = spark.createDataFrame([(1, 120.0, 120.0, 500.0, 600.0, 800.0)], "doc_id long, x1 double, width double, height double, page_width double, page_height double")
    assert layout.sidebar_share(rect).first().share == 0.2
    assert layout.is_image_based(spark.createDataFrame([(1, 10, 1), (1, 100, 0), (2, 500, 3)], "doc_id long, n_chars long, n_images long")).orderBy("doc_id").collect() == [(1, True), (2, False)]
    assert one(spark, layout.best_page_text(F.lit("ab"), F.lit("abc"))) == "abc" and one(spark, layout.has_spaced_letters(F.lit("x\nS K I L L S")))


# --- Files -------------------------------------------------------------------------------------------------------
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx():
    para = lambda t, props="", bold=False: f"<w:p>{props}<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    borders = '<w:tblPr><w:tblBorders><w:top w:val="single"/></w:tblBorders></w:tblPr>'
    blob = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Technical Skills</w:t></w:r><w:r><w:t> " + "word " * 50 + "</w:t></w:r></w:p>"
    body = para("My Part", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + para("plain text") + para("SKILLS", bold=True) + blob
    body += f"<w:tbl>{borders}<w:tr>{cell('A')}{cell('B')}{cell('A')}</w:tr></w:tbl><w:tbl><w:tr>{cell('C')}{cell('D')}</w:tr></w:tbl>"
    body += '<w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "wordprocessingml.document.main")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{para('Jane Doe')}</w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="http://x.org" TargetMode="External"/></Relationships>')
    return out.getvalue()


RTF = rb"{\rtf1{\fonttbl{\f0 Arial;}}\pard Hello\tab w\'f6rld\par {\pict 1234}Line\line end\{x}"


def test_file_scan_kinds_and_text(spark, tmp_path):
    for name, data in {"a.docx": docx(), "copy.docx": docx(), "b.doc": RTF, "c.doc": b"\xd0\xcf\x11\xe0x", "d.txt": b"x", "e.pdf": b"", "~tmp.docx": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.scan(spark, str(tmp_path))
    assert {r.name: r.reason for r in files.collect()} == {"a.docx": None, "copy.docx": None, "b.doc": None, "c.doc": None, "d.txt": "extension", "e.pdf": "empty"}
    assert readers.rejects(files).count() == 2 and readers.distinct_files(files.where("reason is null")).count() == 3
    kinds = {r.name: r.k for r in files.select("name", readers.file_kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.docx": "docx", "copy.docx": "docx", "b.doc": "rtf", "c.doc": "ole2", "d.txt": "unknown", "e.pdf": "unknown"}
    assert files.where("name = 'b.doc'").select(readers.rtf_text(F.col("content"))).first()[0] == "Hello\twörld\nLine\nendx"
    assert [one(spark, readers.plain_text(F.lit(x))) for x in (b"\xef\xbb\xbfa\xc3\xa9", b"a\xe9")] == ["aé", "aé"]
    blocks = readers.read_docx(files.where("name = 'a.docx'"))
    rows = blocks.orderBy("pos").collect()
    assert [(r.kind, r.text[:16]) for r in rows] == [("header", "Jane Doe"), ("paragraph", "My Part"), ("paragraph", "plain text"), ("paragraph", "SKILLS"), ("paragraph", "Technical Skills"), ("table", "TABLE_START\nA | "), ("table", "C  D"), ("paragraph", "site")]
    text = readers.docx_lines(blocks).first().text.split("\n")
    assert text[:5] == ["Jane Doe", "%%H%%My Part", "plain text", "%%H%%SKILLS", "%%H%%Technical Skills"] and "A | B" in text
    assert [tuple(r)[1:] for r in readers.docx_links(files.where("name = 'a.docx'")).collect()] == [("http://x.org", "site")]
    broken = files.where("name = 'c.doc'")
    assert readers.read_docx(broken).count() == 0


# --- Sections ----------------------------------------------------------------------------------------------------
def test_first_section_wins_and_lines_are_kept_once(spark):
    text = "Top\nCareer Summary:\na\nCourses\nb\n🔹 PORTFOLIO\nc\n\nSkills\nd\ncourses\ne"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.section: r.text for r in segment.segment(docs).collect()}
    assert got == {"others": "Top", "about": "a", "education": "b\ne", "projects": "c", "skills": "d"}
    own = Lookups.of({"x": ["top"], "others": []}, {}, {})
    assert {r.section: r.text.split("\n")[0] for r in segment.segment(docs, own).collect()} == {"x": "Career Summary:"}
    assert (len(DEFAULT.sections), len(DEFAULT.skills), len(DEFAULT.levels)) == (29, 22, 9)
    table = [(kind, n * 100 + k, name, word) for kind in ("sections", "skills", "levels") for n, (name, words) in enumerate(getattr(DEFAULT, kind)) for k, word in enumerate(words or [None])]
    assert Lookups.read(spark.createDataFrame(table, "kind string, ord int, name string, keyword string")) == DEFAULT


def test_formatting(spark):
    text = "John\n\n12\nwork experience:\n\nAcme\nskills\nSKILLS\nPython\n& SQL\nhobbies"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert segment.format_documents(docs).first().text == "John\n\n\nWORK EXPERIENCE\n  Acme\n\nSKILLS\n  Python & SQL\n\n\n" + "=" * 70
    assert segment.format_documents(docs, light=True).first().text.startswith("John\n\n12\nwork experience:")


def test_reordering(spark):
    def reorder(rows):
        lines = F.array(*map(F.lit, rows)) if rows else F.array().cast("array<string>")
        return spark.range(1).select(segment.reordered(lines)).first()[0]

    rows = ["EXPERIENCE", "  a", "AWARDS", "  b", "  Acme Solutions", "  Jan 2019", "  x", "PROJECTS", "  c"]
    assert reorder(rows) == ["EXPERIENCE", "  a", "", "  b", "  Acme Solutions", "  Jan 2019", "  x", "", "PROJECTS", "  c", "", "AWARDS"]
    plain = ["EXPERIENCE", "  a", "AWARDS", "  b"]
    assert reorder(plain) == plain and reorder([]) == []
    assert reorder(["AWARDS", "  b", "  Acme Solutions", "  Jan 2019", "", "SKILLS", "  c"]) == ["EXPERIENCE", "  b", "  Acme Solutions", "  Jan 2019", "", "AWARDS", "", "SKILLS", "  c"]


# --- Upserts and forms -------------------------------------------------------------------------------------------
def test_upserts(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "email string, n long, ord long")
    path = str(tmp_path / "master")
    upsert.upsert_path(spark, path, rows(("a", 1, 1), ("b", 2, 1)), "email", "ord")
    for _ in range(2):
        upsert.upsert_path(spark, path, rows(("b", 3, 1), ("b", 4, 2), ("c", 5, 1)), "email", "ord")
        assert sorted(map(tuple, upsert.read_master(spark, path).collect())) == [("a", 1), ("b", 4), ("c", 5)]
    sheet = spark.createDataFrame([(0, "a", 1, 1, "x"), (1, "b", 1, 1, "x")], "pos long, email string, current_salary long, expected_salary long, notice_period string")
    new = spark.createDataFrame([("b", 2, 3, "y"), ("c", 2, 3, "y"), ("d", None, 3, "y")], "email string, current_salary long, expected_salary long, notice_period string")
    assert [(r.email, r.current_salary) for r in upsert.upsert_in_place(sheet, new).orderBy("pos").collect()] == [("a", 1), ("b", 2), ("c", 2)]
    assert tuple(one(spark, upsert.money(F.lit(1234567)))) == (1234567, "INR", "₹1,234,567")


def test_forms(spark):
    names = F.array(*map(F.lit, (" Java", "java", "", "Go")))
    assert one(spark, form.distinct_names(names)) == ["Java", "Go"]
    assert one(spark, form.add_name(F.array(F.lit("Go")), F.lit("go "))) == ["Go"] and one(spark, form.remove_name(F.array(F.lit("Go")), F.lit("Go"))) == []
    assert [x.shown for x in one(spark, form.matches(F.array(F.lit("Java"), F.lit("Go")), F.lit("jA")))] == [True, False]
    assert [one(spark, form.salary(F.lit(x))) for x in ("₹ 12,00,000", "0", "x")] == [1200000, None, None]
    assert [one(spark, form.valid_url(F.lit(x), "linkedin.com")) for x in ("linkedin.com/in/x", "https://evil.com", "", "http://[bad")] == [True, False, True, False]
    assert one(spark, form.problems(F.lit("1"), F.lit(""), F.lit("Immediately"))) == ["expected_salary"] and one(spark, form.problems(F.lit(""), F.lit(""), F.lit(""), silent=True)) == []
    assert [one(spark, form.file_size(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert one(spark, form.escape_html(F.lit('<a b="c">&'))) == "&lt;a b=&quot;c&quot;&gt;&amp;" and one(spark, form.summary_sentences(F.lit("Short. A longer one here."))) == ["A longer one here."]


# --- Records and streams -----------------------------------------------------------------------------------------
def test_records_and_streams(spark, tmp_path):
    docs = spark.createDataFrame([(*registry.CV, "a.pdf"), (2, "nothing", "b.pdf"), (3, None, "c.pdf")], "doc_id long, text string, source_file string")
    as_of = F.lit("2024-06-15").cast("date")
    places = spark.createDataFrame([("600001", "Chennai", "Chennai", "Tamil Nadu")], "postal_code string, city string, district string, state string")
    got = {r.doc_id: json.loads(r.json) for r in record.to_json(record.candidate_records(docs, as_of=as_of, pins=places)).collect()}
    assert got[1]["email"] == ["jane.doe@gmail.com"] and got[1]["sections_detected"] and "email" not in got[2] and got[2]["total_years_experience"] == 0.0 and set(got) == {1, 2, 3}
    record.write_json(record.candidate_records(docs, as_of=as_of), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    rows = {r.email: r for r in landing.candidates(docs, as_of=as_of).collect()}
    assert set(rows) == {"jane.doe@gmail.com", "noemail_b.pdf", "noemail_c.pdf"} and rows["jane.doe@gmail.com"].phone == "+919876543210"
    assert upsert.sheet_row(F.col("x")) is not None
    inbox, master = str(tmp_path / "in"), str(tmp_path / "master")
    docs.write.parquet(inbox)
    for _ in range(2):
        landing.land(spark, inbox, master, str(tmp_path / "cp"), as_of=as_of).awaitTermination()
    batch = landing.candidates(docs, as_of=as_of).drop("ord")
    assert sorted(map(str, upsert.read_master(spark, master).collect())) == sorted(map(str, batch.collect()))
    files = spark.createDataFrame([("a", None), ("b", "empty"), ("c", None)], "path string, reason string")
    texts = spark.createDataFrame([("a", "x\n\ny"), ("c", "")], "doc_id string, text string")
    assert tuple(record.batch_status(files, texts).first()) == (1, 2, ["b", "c"]) and record.text_notes(texts).where("doc_id = 'a'").first().n_lines == 2


def test_stream_of_sessions_is_the_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = landing.last_writes(stream, gap="1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = set(map(tuple, spark.table("sessions").collect()))
    batch = set(map(tuple, landing.last_writes(events, gap="1 hour").collect()))
    assert got <= batch and len(got) > 0.9 * len(batch)


@pytest.mark.parametrize("name", ["org_similarity_pairs", "interval_union_per_customer", "master_upsert"])
def test_plans_scan_only_what_they_need(spark, tiny, name):
    plan = registry.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "p_retailprice" not in plan and "c_nationkey" not in plan and "o_orderpriority" not in plan


def test_a_folder_becomes_records(spark, tmp_path):
    from quillspark.plans import batch

    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, data in {"a.docx": docx(), "b.doc": RTF, "c.doc": b"\xd0\xcf\x11\xe0x", "d.txt": b"x", "e.docx": b"PK\x03\x04 broken"}.items():
        (source / name).write_bytes(data)
    batch.main(str(source), str(target))
    name = F.element_at(F.split("path", "/"), -1)
    assert {tuple(r) for r in spark.read.parquet(str(target / "rejects")).select(name, "reason").collect()} == {("c.doc", "unsupported"), ("d.txt", "extension"), ("e.docx", "broken")}
    texts = {r.doc_id.split("/")[-1]: r.text for r in spark.read.parquet(str(target / "texts")).collect()}
    assert set(texts) == {"a.docx", "b.doc"} and "\nMY PART\n  plain text" in texts["a.docx"] and "LINKS / URLS DETECTED\n  site: http://x.org" in texts["a.docx"]
    status = spark.read.json(str(target / "status")).first()
    assert (status.ok, status.errors) == (2, 3) and spark.read.json(str(target / "records")).count() == 2


def test_gaps_within_stretches_and_across_their_edges(spark, monkeypatch):
    """Few stretches of many places, one key with nearly all words, places that repeat, keys with one word, and nulls."""
    rng = random.Random(9)
    words = [(1, float(rng.randrange(400))) for _ in range(900)] + [(2, 5.0)] * 4 + [(3, 7.0), (None, 1.0), (None, 9.0), (4, None)]
    df = spark.createDataFrame(words, "doc_id long, x0 double")
    for n in (64, 3):
        monkeypatch.setattr(layout, "STRETCHES", n)
        got = sorted((str(r.doc_id), r["rank"], r.gap, r.mid) for r in layout.top_gaps(df, 3).collect())
        want = []
        for key in {k for k, _ in words}:
            xs = sorted(x for k, x in words if k == key and x is not None)
            gaps = sorted(((b - a, a) for a, b in zip(xs, xs[1:])), reverse=True)[:3]
            want += [(str(key), i + 1, g, a + g / 2) for i, (g, a) in enumerate(gaps)]
        assert got == sorted(want)
