"""Contacts, dates, jobs, skills, education, lists and tables."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.plans import registry
from quillspark.functions import contact as C
from quillspark.functions import dates as D
from quillspark.operators import education, jobs, lists, skills


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("email, score", [("jane.doe@gmail.com", 1.0), ("jd@gmail.com", 0.5), ("jane.doe@corp.xyz", 0.8), ("jane..doe@corp.in", 0.9), ("jane.doe@gmail.com.", 0.8), ("nothing", 0.0)])
def test_email_scores(spark, email, score):
    assert one(spark, C.score_email(F.lit(email))) == score


def test_email_sources_and_choice(spark):
    text = "Email: jane.doe@gmail.com | mailto:jd@corp.in\nuser.name@gmail\n\n.com\njane.doe@corp.xyz"
    found = one(spark, C.email_candidates(F.lit(text)))
    assert [(x.email, x.source) for x in found] == [("jane.doe@gmail.com", "labeled_field"), ("jd@corp.in", "mailto_uri"), ("user.name@gmail.com", "split_domain"), ("jane.doe@corp.xyz", "raw_regex")]
    assert one(spark, C.best_emails(C.email_candidates(F.lit(text)))) == ["jane.doe@gmail.com", "user.name@gmail.com"]
    assert one(spark, C.best_emails(C.email_candidates(F.lit("jd@corp.in and ab@corp.xyz")))) == ["jd@corp.in", "ab@corp.xyz"]
    assert one(spark, C.best_emails(C.email_candidates(F.lit("none")))) == []


def test_names(spark):
    name = lambda t: one(spark, C.candidate_name(F.lit(t)))
    assert tuple(name("Resume\n\nJane (JD) van Doe\nx")) == ("Jane", "van", "Doe", "Jane van Doe")
    assert tuple(name("12 Street\nSenior Engineer\nMadonna")) == ("Madonna", None, None, "Madonna")
    assert tuple(name("PROFESSIONAL SUMMARY"))[3] == "PROFESSIONAL SUMMARY" and name("a@b.c\n1") is None


def test_personal_facts_and_sites(spark):
    text = F.lit("DOB: 31/12/1990 Sex - male\nNationality: indian\nlinkedin.com/in/Jane-Doe https://www.blog.org/x\nPIN 600001\nAddress: 1 Road,\nChennai\n\nMore")
    assert [one(spark, f(text)) for f in (C.date_of_birth, C.gender, C.nationality, C.pin_code, C.raw_address)] == ["1990-12-31", "Male", "Indian", "600001", "1 Road,"]
    assert one(spark, C.date_of_birth(F.lit("dob: 31/02/1990"))) is None
    assert [tuple(x) for x in one(spark, C.websites(text))] == [("https://linkedin.com/in/jane-doe", "linkedin.com"), ("https://www.blog.org/x", "blog.org")]
    assert one(spark, C.phones(F.lit("098765-43210, +91 98765 43210 and 12345"))) == ["+919876543210"]
    assert one(spark, C.phones(F.lit("0044 (7911) 123-456; +1 415.555.2671; +65 1234 5678; +49 30 1234567; 2019 98765 43210"))) == ["+14155552671", "+447911123456", "+49301234567", "+919876543210"]
    assert one(spark, C.phones(F.lit("+966512345678 or 022-2345 6789"))) == ["+912223456789", "+966512345678"] and one(spark, C.phones(F.lit("+44 7911 123456 7"))) == []
    assert one(spark, C.contact_hints(F.lit("Notice period: 30 days\nCTC 5 LPA\nx.com/jd")))["notice_period"] == ["Notice period: 30 days"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Present", (None, True, None, None, None)), ("till date", (None, True, None, None, None)), ("March 2020", ("2020-03-01", False, None, 3, 2020)), ("Sept. 2019", ("2019-09-01", False, None, 9, 2019)),
        ("2018", (None, False, None, None, 2018)), ("05/06/2019", ("2019-06-05", False, 5, 6, 2019)), ("05/16/2019", ("2019-05-16", False, None, 5, 2019)), ("soon", (None, False, None, None, None)),
    ],
)
def test_partial_dates(spark, raw, want):
    assert tuple(one(spark, D.parse_date(F.lit(raw)))) == want


@pytest.mark.parametrize(
    "line, want",
    [
        ("Jan 2018 - Present x", ("Jan 2018 - Present", "Jan 2018", "Present")), ("2015–2017", ("2015–2017", "2015", "2017")), ("Jan 2018 — Mar 2019", ("Jan 2018 — Mar 2019", "", "")),
        ("Mar 2018 - Till date", ("Mar 2018 - Till date", "", "")), ("from 01/05/2019 - 01/06/2020", ("01/05/2019 - 01/06/2020", "01/05/2019", "01/06/2020")), ("none", None),
    ],
)
def test_date_ranges(spark, line, want):
    got = one(spark, D.date_range(F.lit(line)))
    assert (tuple(got) if got else None) == want


AS_OF = dt.date(2024, 6, 15)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Jan 2018 - Jan 2020\nJun 2019 - Jun 2021", 3.4), ("Jan 2018 - Jan 2019\nJan 2019 - Jan 2020", 2.0), ("Jan 2018 - Jan 2022\nJan 2019 - Jul 2019", 4.0), ("Jan 2018 - Apr 2018", 0.2), ("Jan 2018 - Oct 2018", 0.8),
        ("Jan 2018 - Apr 2019", 1.2), ("2019 - 2021", 2.0), ("Jan 2024 - Present", 0.4), ("01/05/2019 - 01/06/2020", 0.7), ("about 7.5 years of experience, 99 years", 7.5), ("nothing", 0.0),
    ],
)
def test_total_experience(spark, text, want):
    assert one(spark, D.total_experience(F.lit(text), as_of=F.lit(AS_OF))) == want


def test_merged_intervals_are_unions(spark):
    rng = random.Random(3)
    rows = [(k, s, s + rng.randint(1, 9)) for k in range(8) for s in (rng.randint(0, 40) for _ in range(rng.randint(1, 12)))]
    got = D.merge_intervals(spark.createDataFrame(rows, "key long, s int, e int")).collect()
    for k in range(8):
        cells = {m for q, s, e in rows if q == k for m in range(s, e)}
        mine = [(r.s, r.e) for r in got if r.key == k]
        assert {m for s, e in mine for m in range(s, e)} == cells and sum(e - s for s, e in mine) == len(cells)
        assert all(b[0] > a[1] for a, b in zip(sorted(mine), sorted(mine)[1:]))
    again = D.merge_intervals(spark.createDataFrame([tuple(r) for r in got], "key long, s int, e int"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_experience(spark):
    text = "intro\nSenior Developer\nAcme Pvt Ltd\nJan 2018 - Mar 2019\n• Built\nBeta Systems here\n2020 - Present\n=======\nData Analyst - Gamma Group 2015 - 2017\nReports\nProject Manager\nDelta Corp 2012 - 2013"
    rows = jobs.parse_experience(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("job").collect()
    assert [(r.job_title, r.organization, r.date_range, r.description) for r in rows] == [
        ("Senior Developer", "Acme Pvt Ltd", "2020 - Present", "Built\nBeta Systems here"), ("Data Analyst", "Gamma Group", "2015 - 2017", "Reports"), ("Project Manager", "Delta Corp", "2012 - 2013", "")]
    assert rows[0].start_date.year == 2020 and rows[0].end_date.is_current and rows[2].end_date.year == 2013
    work = jobs.experience_list(jobs.parse_experience(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    position = work.select(jobs.current_position(F.lit(""), F.lit(""), F.col("work_experience")).alias("x")).first().x
    assert (position.current_position, position.source) == ("Senior Developer", "work_experience")


@pytest.mark.parametrize(
    "text, title, years",
    [
        ("SUMMARY\nResults-driven Executive Manager with over 12 years of experience", "Executive Manager", "12 years"), ("Project Manager | 7+ Years of Experience", "Project Manager", "7+ years"),
        ("Known as a skilled Data Scientist who grew\nhaving 4.2+ yrs", None, None), ("Nothing here", None, None),
    ],
)
def test_summary_position(spark, text, title, years):
    got = one(spark, jobs.summary_position(F.lit(text)))
    if title is None:
        assert got is None or got.source == "summary"
    else:
        assert (got.current_position, got.years_of_experience) == (title, years)


def test_skill_splitting_and_noise(spark):
    assert one(spark, skills.split_skills(F.lit("• Python, Java; managed teams | and SQL\nAWS, Acme Ltd, 2019, Team Lead, Go"))) == ["AWS", "Go", "Java", "Python", "SQL"]
    noisy = ["present day", "a b", "9 lives", "a##b", "led team", "INR 5", "foo Pvt Ltd", "HUGE NEWS TODAY", "India", "iit", "process", "one two three four five six", "the", "/x"]
    assert all(one(spark, skills.is_noise(F.lit(s))) for s in noisy)
    assert not any(one(spark, skills.is_noise(F.lit(s))) for s in ("Python", "sql", "Spring Boot", "REST API"))
    assert [one(spark, skills.category(F.lit(s))) for s in ("MongoDB", "Django", "Tableau", "xyz", "Hindi")] == ["Programming Languages", "Programming Languages", "Data Science / ML / AI", "Miscellaneous", "Languages (Spoken)"]
    assert one(spark, skills.collapse_repeats(F.lit("Power power BI"))) == "Power BI" and one(spark, skills.label(F.lit("node js"))) == "Node.js"
    assert [round(one(spark, skills.token_similarity(F.lit(a), F.lit(b))), 3) for a, b in (("Anna University", "Anna University, Chennai"), ("IIT", "IIT Delhi"), ("AB", "AB CD"))] == [0.667, 0.5, 0.0]


def test_skill_dedupe(spark):
    names = ["Java", "java", "Java EE", "Python", "C#", "C++", "Spring Boot", "Boot Spring", "SQL", "SQL Server", "Node.js"]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(names)], "doc_id long, pos int, skill string")
    once = skills.dedupe_rows(rows)
    assert [r.skill for r in once.orderBy("pos").collect()] == ["Java EE", "Python", "Spring Boot", "SQL Server", "Node.js"]
    assert skills.dedupe_rows(once).count() == once.count()


EDU = {
    "Completed MCA from Anna University (2019)": [("Anna University", "MCA", "master", None, 2019, None)],
    "B.Tech in Computer Science\nAnna University, Chennai\n2008 - 2012\nCGPA: 8.4": [("Anna University, Chennai", "B.Tech", "bachelor", 2008, 2012, 8.4)],
    "SRM College\nChennai main road\nMBA 2015 - Present": [("SRM College Chennai main road", "MBA", "master", 2015, None, None)],
    "M.Sc Physics (2010). City College, Pune": [("City College", "M.Sc", "master", None, 2010, None)],
    "BCA | XYZ University | 2011\nBCA, XYZ University 2011": [("XYZ University", "BCA", "bachelor", None, 2011, None)],
    "EDUCATION\nDegree: B.Com\nInstitution: ABC College\nYear of passing: 2014\nPercentage: 71%": [("ABC College", "B.Com", "bachelor", None, 2014, 71.0)],
    "": [],
}


@pytest.mark.parametrize("text", EDU)
def test_education(spark, text):
    got = education.parse_education(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.organization, r.degree, r.level, r.start_year, r.end_year, r.grade and r.grade.score) for r in got] == EDU[text]


def test_education_order_and_lookups(spark):
    text = "MBA\nX Institute 2015\nPh.D\nY University\n2018 - Pursuing\nB.E in Physics\nZ College 2010"
    got = education.parse_education(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.degree, r.end_year, (r.end_year_label or "").lower()) for r in got] == [("Ph.D", None, "pursuing"), ("MBA", 2015, ""), ("B.E", 2010, "")]
    assert one(spark, education.normalise_degree(F.lit("Bachelor of Arts")))["label"] == "Bachelor" and one(spark, education.education_level(F.lit("xyz"))) == "other"
    assert one(spark, education.field_of_study(F.lit("Degree in Marine Biology"))) == "Marine Biology" and one(spark, education.field_of_study(F.lit("B.E CSE"))) == "Computer Science and Engineering"
    assert one(spark, education.clean_org_name(F.lit("e ABC College, Chennai, Tamil Nadu, India 2010"))) == "ABC College, Chennai"
    assert one(spark, education.is_valid_degree(F.lit("MBA"))) and not one(spark, education.is_valid_degree(F.lit("Chennai, TN")))
    assert tuple(one(spark, education.grade(F.lit("8.2 / 10"))))[:2] == (8.2, "CGPA")


def test_institution_names(spark):
    names = ["e ABC College, Kerala", "IIT, Delhi CGPA 9", "X Institute 2012", "Pune", "Y University, Jan 2010 to 2012", "Goa, India"]
    got = [one(spark, education.clean_org_name(F.lit(n))) for n in names]
    assert got == ["ABC College", "IIT, Delhi", "X Institute", "Pune", "Y University", "Goa, India"]


def test_the_scan_is_the_automaton_step_by_step(spark):
    rng, width = random.Random(3), len(education.KINDS)
    rows = [(i, [rng.randrange(width * len(education.GUARDS)) for _ in range(n)]) for i, n in enumerate([0, 1, 63, 64, 65, 200])]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, codes array<int>").select("i", education.states(F.col("codes")).alias("s")).collect()}
    for i, codes in rows:
        state, before = "closed", []
        for c in codes:
            before.append(education.STATES.index(state))
            state, _, action = education._move(state, education.KINDS[c % width], education.GUARDS[c // width])
            assert action in education.ACTIONS
        assert got[i] == before


def studies(spark, rows, **more):
    got = education.parse_education(spark.createDataFrame(rows, "doc_id long, text string"), **more).orderBy("doc_id", "pos").collect()
    return [(r.doc_id, r.organization, r.degree, r.field_of_study, r.end_year) for r in got]


def test_doubles_bare_institutions_and_repeated_documents(spark):
    text = "MBA\nAlpha Institute\nMBA 2014\nAlpha Institute\nB.E\nBeta College 2010\nM.Sc Physics\nGamma Academy 2016\nAnna University"
    once = [("Gamma Academy", "M.Sc", "Physics", 2016), ("Alpha Institute", "MBA", "", 2014), ("Beta College", "B.E", "", 2010)]
    assert studies(spark, [(1, text)]) == [(1, *x) for x in once]
    both = studies(spark, [(None, text), (None, text), (5, None), (6, ""), (7, "HSC 2001\nMumbai")])
    assert sorted(both, key=str) == sorted([(None, *x) for x in once] * 2 + [(7, "", "HSC", "", 2001)], key=str)


def test_institutions_from_outside(spark):
    names = spark.createDataFrame([(1, 0, "MBA School of Nothing"), (1, 1, "Delta College"), (1, 2, "Epsilon University")], "doc_id long, pos int, name string")
    got = studies(spark, [(1, "M.Tech 2012\nB.Sc\nEpsilon University 2009"), (2, "MCA 2015")], institutions=names)
    assert {(x[0], x[1], x[2]) for x in got} >= {(1, "MBA School of Nothing", "M.Tech"), (1, "Epsilon University", "B.Sc"), (2, "", "MCA")}
    assert any(x[1] == "Delta College" and x[2] == "" for x in got)


def test_projects(spark):
    text = "loose line\nProject 1: Alpha\nClient: Big\nclient: Bigger\nTechnologies: Spark, Kafka | Go\nDuration: 2 years\n• did it\n======\nProject Beta\nRole: Lead"
    got = lists.parse_projects(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("project").collect()
    assert [(r.title, r.client, r.role, r.description, r.technologies) for r in got] == [("", "", "", "loose line", []), ("Alpha", "Bigger", "", "Duration: 2 years\ndid it", ["Spark", "Kafka", "Go"]), ("Beta", "", "Lead", "", [])]


def test_numbers_that_are_no_dates_of_certificates(spark):
    text = "Course by 2010\nCourse by 20321\nNo. 20100 from X\nScrum 2020 by 2015\nPMP - 2019\nFrom 2018 on"
    assert [(x["date"], x["issuer"]) for x in one(spark, lists.certifications(F.lit(text)))] == [(None, "2010"), (None, "20321"), (None, "X"), ("2020", "2015"), ("2019", "2019"), ("2018", "2018 on")]


def test_certifications_and_languages(spark):
    assert [tuple(x) for x in one(spark, lists.certifications(F.lit("• AWS Developer by Amazon\nScrum Master Mar 2020 - Alliance\n-----")))] == [("AWS Developer by Amazon", None, "Amazon"), ("Scrum Master Mar 2020 - Alliance", "Mar 2020", "Alliance")]
    assert [tuple(x) for x in one(spark, lists.spoken_languages(F.lit("English - Fluent\nTamil\nHindi (basic)")))] == [("English", "Full professional proficiency"), ("Tamil", "Native or bilingual proficiency"), ("Hindi", "Elementary proficiency")]


def test_tables(spark):
    text = "x\nTABLE_START\nCompany | Key\nA | 1\nB\nTABLE_END\nTABLE_START\nJava | SQL\nTABLE_END"
    a, b = one(spark, lists.structured_tables(F.lit(text)))
    assert (a.type, a.headers, a.data) == ("experience", ["Company", "Key"], [{"Company": "A", "Key": "1"}, {"Company": "B", "Key": ""}]) and (b.type, b.raw) == ("skills", [["Java", "SQL"]])
    cells = lambda *rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    assert one(spark, lists.table_text(cells(["a", "b"], ["", "c"]))) == "TABLE_START\na | b\n | c\nTABLE_END"
    assert one(spark, lists.table_text(cells(["a"], ["b"]))) is None and one(spark, lists.is_layout_artifact(cells(["x" * 301, "b"])))


def test_fixed_patterns_compile():
    from quillspark.functions import patterns as P

    for name, value in vars(P).items():
        if name.isupper() and isinstance(value, str) and name not in ("CONTROL", "EMOJI", "EMOJI_CLEANED"):
            re.compile(value)


@pytest.mark.parametrize("name", ["personal_facts", "jobs_parsed", "education_parsed"])
def test_small_tables_are_dealt_to_all_tasks(spark, tiny, name):
    """A table of few bytes is read by one task; its texts are made and read by many."""
    assert "REPARTITION_BY_NUM" in registry.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
