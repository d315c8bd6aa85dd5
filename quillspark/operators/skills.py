"""Skills: splitting, noise, labels, categories and duplicates, as Column functions and over rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.lookups import DEFAULT, NO_CATEGORY, SPOKEN, Lookups


def clean_token(raw: Column) -> Column:
    """A skill without a leading connective and outer punctuation; empty if it is no skill."""

    def kept(x: Column) -> Column:
        bad = (F.length(x) < 2) | (F.size(F.split(T.strip(x), r"\s+")) > 4) | F.lower(x).isin(*P.SKILL_JUNK) | x.rlike(r"[.%~]$")
        for pattern in (P.SKILL_DATE, P.SKILL_COMPANY, P.SKILL_VERB, P.SKILL_METRIC, P.SKILL_TITLE):
            bad = bad | x.rlike(pattern)
        return F.when(bad, "").otherwise(x)

    return T.let(T.sub(T.strip(T.sub(raw, P.SKILL_LEAD)), r"^[.,;:()\-]+|[.,;:()\-]+$"), kept)


def split_skills(text) -> Column:
    """Distinct skills of a text, sorted: lines split at ``, ; | •``."""
    parts = F.flatten(F.transform(T.lines(text), lambda x: F.split(T.clean_bullet(x), r"[,;|•\n]", -1)))
    return F.sort_array(F.array_distinct(F.filter(F.transform(parts, lambda p: clean_token(T.strip(p))), lambda x: x != "")))


def is_noise(skill: Column) -> Column:
    s = T.strip(skill)
    low, words = F.lower(s), F.split(s, r"\s+")
    one, tech = F.size(words) == 1, s.rlike(P.SKILL_TECH)
    starts_low = s.rlike(r"^\p{Ll}") & ~low.isin(*P.SKILL_WHITELIST)
    capitals = F.size(F.filter(words, lambda w: (F.length(w) > 1) & T.is_upper(w)))
    out = F.length(s) < 2
    for rule in (
        *(s.rlike(p) for p in P.SKILL_NOISE),
        starts_low & (F.length(F.get(words, F.lit(0))) <= 3) & T.is_upper(F.upper(F.get(words, F.lit(0)))) & (F.get(words, F.lit(0)) == F.lower(F.get(words, F.lit(0)))),
        s.rlike(P.SKILL_GLUED) & ~tech,
        s.rlike(r"^[/\\]"),
        s.rlike(P.SKILL_ACTION),
        s.rlike(P.SKILL_META),
        s.rlike(P.SKILL_MONEY),
        s.rlike(P.SKILL_COMPANY_LONG),
        (capitals >= 2) & (F.size(words) <= 4) & ~tech,
        one & low.isin(*P.SKILL_COUNTRIES, *P.SKILL_COLLEGES, *P.SKILL_GENERIC),
        (F.size(words) >= 6) & ~tech,
    ):
        out = out | rule
    return out


def collapse_repeats(phrase: Column) -> Column:
    words = F.split(T.strip(phrase), r"\s+")
    return F.array_join(F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1)))), " ")


def label(skill: Column) -> Column:
    """The usual spelling of a few names."""
    s, out = T.strip(skill), T.strip(skill)
    for key, name in P.SKILL_LABELS.items():
        out = F.when(F.lower(s) == key, name).otherwise(out)
    return out


def tokens(skill: Column) -> Column:
    """The set of words (a-z, 0-9) of two letters or more that aren't stop words, sorted."""
    found = F.regexp_extract_all(F.lower(skill), F.lit("[a-z0-9]+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*P.SKILL_STOPWORDS))))


def category(skill: Column, lookups: Lookups = DEFAULT) -> Column:
    """The first category with a keyword inside the skill."""
    low, out = F.lower(skill), F.lit(NO_CATEGORY)
    for name, words in reversed([x for x in lookups.skills if x[1]]):
        out = F.when(low.rlike("|".join(map(re.escape, words))), name).otherwise(out)
    return out


def skill_object(name: Column, lookups: Lookups = DEFAULT) -> Column:
    c = category(name, lookups)
    return F.struct(name.alias("name"), c.alias("category"), F.when(c == SPOKEN, "language").otherwise("hard").alias("type"), (c == SPOKEN).alias("is_language"))


def dedupe_rows(rows: DataFrame, key: str = "doc_id", pos: str = "pos", skill: str = "skill") -> DataFrame:
    """``key, pos, skill`` without noise and duplicates: one spelling each, the longest of each set of words, and no single
    word that stands in a larger set; skills without a word of two letters (C#, R) go. Groups and an anti join."""
    shaped = rows.where(~is_noise(F.col(skill))).select(F.col(key), F.col(pos), label(collapse_repeats(F.col(skill))).alias(skill))
    spelled = shaped.groupBy(key, F.lower(skill).alias("_low")).agg(F.min_by(skill, pos).alias(skill), F.min(pos).alias(pos))
    sets = spelled.withColumn("_t", tokens(F.col(skill))).where(F.size("_t") > 0)
    best = sets.groupBy(key, "_t").agg(F.max_by(F.struct(skill, pos), F.struct(F.length(skill), -F.col(pos))).alias("_x")).select(key, "_t", "_x.*")
    wide = best.where(F.size("_t") > 1).select(F.col(key).alias("_k"), F.explode("_t").alias("_w")).distinct()
    single = best.where(F.size("_t") == 1).join(wide, (F.col(key) == F.col("_k")) & (F.get("_t", F.lit(0)) == F.col("_w")), "left_anti")
    return best.where(F.size("_t") > 1).unionByName(single).select(key, pos, skill)


def token_similarity(a, b) -> Column:
    """Shared words of three letters or more, over the larger number of them; 0 if either has none."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(T._col(x)), F.lit(r"\b\w{3,}\b"), F.lit(0)))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))
