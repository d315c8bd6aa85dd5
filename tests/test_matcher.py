"""The dictionary matcher: words, overlaps, the salted join, outside matchers and empty inputs."""

import itertools
import random
import re

import pytest

from quillspark.operators import matcher


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def terms(spark, words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def plain(text, names):
    """Of all places of terms, the choice without overlaps that covers most words, then has fewest, then starts earliest."""
    cut = lambda s: re.findall(r"\.?[^\W_][^\W_+#]*[+#]*(?:[.\-/&][^\W_+#]+[+#]*)*", s.lower())
    words, keys = cut(text or ""), {tuple(cut(n)) for n in names} - {()}
    spans = [(i, i + len(k)) for i in range(len(words)) for k in keys if tuple(words[i : i + len(k)]) == k]
    best = ((0, 0, ()), ())
    for n in range(1, len(spans) + 1):
        for some in itertools.combinations(sorted(spans), n):
            if all(a[1] <= b[0] for a, b in itertools.pairwise(some)):
                best = max(best, ((sum(e - s for s, e in some), -n, tuple(-s for s, _ in some)), some))
    return set(best[1])


@pytest.mark.parametrize("salted", [False, True])
def test_matches_are_the_best_that_do_not_overlap(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(matcher, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    names = ["a b", "b c", "c d e", "a", "d", "C++", "c# .net", "Node.js", "ci/cd", "power BI", "bi", "..", "A  B", "b c d e f"]
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e", "f", "c++", "c#", ".net", "node.js,", "ci/cd", "Power", "BI."]) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "A, b! C"), (103, "a b c d e f"), (104, "(C++)/C#")]
    got = matcher.match_terms(docs(spark, rows), terms(spark, names)).collect()
    for key, text in rows:
        assert {(r.start, r.end) for r in got if r.doc_id == key} == plain(text, names), text
    assert {r.term for r in got if r.doc_id == 103} == {"a", "b c d e f"}


def test_no_terms_and_no_documents(spark):
    assert matcher.match_terms(docs(spark, [(1, "a b")]), terms(spark, [])).count() == 0
    assert matcher.match_terms(docs(spark, []), terms(spark, ["a"])).count() == 0


def test_skills_by_dictionary_by_an_outside_matcher_and_by_commas(spark):
    some = docs(spark, [(1, "Worked with machine learning, Power BI and go."), (2, "nothing"), (3, None)])
    known = terms(spark, ["Machine Learning", "learning", "power bi", "Go", "sql"])
    assert {r.doc_id: r.skills for r in matcher.parse_skills(some, known).collect()} == {1: ["Machine Learning", "Power Bi"], 2: [], 3: []}
    outside = lambda d: d.where("text is not null").selectExpr("doc_id", "substring(text, 1, 6) term")
    assert {r.doc_id: r.skills for r in matcher.parse_skills(some, matcher=outside).collect()} == {1: ["Worked"], 2: ["Nothin"], 3: []}
    assert {r.doc_id: r.skills for r in matcher.parse_skills(docs(spark, [(1, "Python, SQL | and Docker")])).collect()} == {1: ["Docker", "Python", "SQL"]}


def test_a_hundred_thousand_terms(spark):
    many = spark.range(100_000).selectExpr("concat('tool', id, ' kit') term")
    got = matcher.match_terms(docs(spark, [(1, "tool7 kit and Tool99999 kit, tool100000 kit")]), many)
    assert {r.term for r in got.collect()} == {"tool7 kit", "tool99999 kit"}
