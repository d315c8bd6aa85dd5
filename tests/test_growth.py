"""Costly work on tables of few files is dealt to all tasks, and a task's memory doesn't hang on how rows are stored."""

from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import contact as C
from quillspark.functions import patterns as P
from quillspark.functions import text as T
from quillspark.operators import jobs, matcher


def test_sentences_are_cut_by_all_tasks(spark, tiny):
    assert __spark_entry__.queries()["sentence_split"](spark, tiny).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_words_spelt_by_their_first_letter(spark):
    plain = "|".join((r"\b" if w.endswith(".") else "") + w.replace(".", "[.]") + ("(?!NET)" if w.endswith(".") else "") for w in P.PROTECTED)
    texts = [f"{a}{w}{b}" for w in P.PROTECTED for a in ("", "x", "e.g.", "_", ".", "é") for b in ("", "NET", " Core", "s", " e.g.")]
    rows = spark.createDataFrame([(x,) for t in texts for x in (t, t.upper())], "x string")
    found = lambda pattern: F.regexp_extract_all("x", F.lit(f"(?i)(?:{pattern})"), F.lit(0))
    assert rows.where(found(plain) != found(T._SPELT)).count() == 0
    got = spark.range(1).select(T.sentences(F.lit("He wrote NODE.JS etc. and sKlearn here. For DR. Roy, ASP.NET CORE and asp.net.")).alias("s")).first().s
    assert got == ["He wrote Node.js etc. and sklearn here.", "For Dr. Roy, ASP.NET Core and ASP.NET."]


def test_terms_of_few_files_are_matched_by_all_tasks(spark, tiny):
    plan = __spark_entry__.queries()["terms_matched"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "end#" not in "".join(x for x in plan.split("\n") if "HashAggregate(keys=[doc_id" in x and "start" in x.split("functions")[0])


def test_repeated_spans_count_once(spark):
    spans = [(1, 0, 2, "a b"), (1, 0, 2, "a b"), (1, 1, 3, "b c"), (1, 1, 3, "b c"), (1, 5, 6, "f"), (None, 0, 1, "a"), (None, 0, 1, "a")]
    got = matcher.schedule(spark.createDataFrame(spans, "doc_id long, start int, end int, term string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 2, "a b"), (1, 5, 6, "f"), (None, 0, 1, "a")], key=str)


def test_what_skips_a_pattern_skips_no_find(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    null = F.lit(None).cast("string")
    assert one(C.phones(F.lit("call 98-7 6-5 4-3 2-1 0 now"))) == ["+919876543210"] and one(C.phones(F.lit("12 34 56"))) == [] and one(C.phones(null)) is None
    assert one(C.websites(F.lit("no address"))) == [] and one(C.websites(null)) is None
    assert one(C.websites(F.lit("GitHub.com/x"))) == [("https://github.com/x", "github.com")]
    assert one(C.candidate_name(F.lit("a b c d e f\nAnna B Cole D Eve"))).full_name == "Anna B Cole D Eve"
    assert one(jobs.summary_position(F.lit("Senior Software Engineer with 8 ☀ years"))).current_position == "Senior Software Engineer"
    assert one(jobs.summary_position(F.lit("no number"))) is None and one(jobs.summary_position(null)) is None
