"""Secret scans: candidates by pattern, then a random forest over DataFrame expressions to drop false positives."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import findings

#: Names that a secret is assigned to, and prefixes of known key formats.
KEYS = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{30,}|glpat-[0-9A-Za-z_-]{16,}|eyJ[A-Za-z0-9_=-]{16,}|-----BEGIN)"
#: Words of ordinary text and code.
DICTIONARY = "about|access|address|admin|after|application|auth|before|build|change|class|client|config|content|data|default|document|dummy|error|example|field|file|first|from|function|group|here|host|image|index|information|insert|key|license|list|login|manager|message|model|module|name|null|number|object|order|other|page|password|path|place|project|public|query|release|replace|report|request|response|result|sample|search|secret|server|service|session|source|state|string|system|table|test|text|that|there|this|time|title|token|true|type|update|user|value|version|which|window|with|world|xxxx|your"

#: A name of any number of parts with one of ``KEYS`` in it, which ends where a word does, also a camelCase one
#: (dbPassword, passwordHash, but not author), and the sign behind it. A cheap look ahead for that sign comes first.
_NAME, _SIGN = "[A-Za-z0-9_.-]", r"[\"']?[ \t]{0,3}[:=]"
_KEYED = rf"(?<!{_NAME})(?={_NAME}++{_SIGN})(?:{_NAME}*?(?i:(?:{KEYS})(?:key|hash|value|s)?)(?:(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Za-z]))){_NAME}*+{_SIGN}[:=]?[ \t]{{0,3}}[\"']?"
_RUN = r"(?<![A-Za-z0-9+/_=~-])(?=[A-Za-z+/_=~-]*+[0-9])[A-Za-z0-9+/_=~-]{16,}+"
#: A PEM key up to its END line, headers included; without one before the next BEGIN, its headers and lines of base64.
_ENDED = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
_ENDLESS = r"(?:\s*+(?:[A-Z][A-Za-z-]{2,20}: [^\r\n]*+|[A-Za-z0-9+/]{24,}+={0,2}+))*+(?:\r?\n[ \t]*+[A-Za-z0-9+/]{1,23}+={0,2}+(?!\S))?+"
_PEM = rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_ENDED}|{_ENDLESS})"
#: Known key formats and tokens of three parts, with a digit or without; a URL's user, and the password behind it.
_TOKEN = r"(?<![A-Za-z0-9+/_=~-])(?:eyJ[A-Za-z0-9_=-]{8,}+(?:\.[A-Za-z0-9_=-]++)++|AKIA[0-9A-Z]{16}|(?:gh[pousr]_|glpat-|xox[abprs]-|[sr]k_live_|AIza)[A-Za-z0-9_-]{16,}+)"
_USER = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s/:@\"'<>]{0,64}+:(?=[^\s/@\"'<>]{3,}+@)"
#: An assigned value: to its closing quote; without one, to white space, a quote or a sign behind it.
_QUOTED = r"(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')"
_BARE = r"(?:[^\s\"'<>,;]|[,;]++(?=[^\s\"'<>,;])){6,}+"
#: What is looked at: assigned values of 6 characters or more, PEM keys, tokens of known form, passwords in URLs, and other
#: runs of 16 or more with a digit. All are taken whole, however long: possessive loops neither go back nor nest, so the
#: time stays linear.
CANDIDATE = rf"{_KEYED}(?:{_PEM}|{_QUOTED}|{_BARE})|{_PEM}|{_TOKEN}|{_USER}[^\s/@\"'<>]++|{_RUN}"
#: A URL's user at a candidate's begin, where the sign behind the password is cut off.
_IN_URL = r"^[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s/:@\"'<>]{0,64}+:"

FEATURES = ("length", "digits", "upper", "letter_digit", "case_change", "distinct", "hex", "dictionary", "transitions", "keyed", "known", "only_digits", "before", "after", "path")
TREES, DEPTH, LEAST, FOLDS = 21, 8, 5, 4
THRESHOLD = 0.5
#: Words before and behind a candidate that count, and words that the tables hold at most.
NEAR, WORDS = 4, 200
#: How often a training finding's surroundings are left out.
LEFT_OUT = 0.4
#: Kinds of characters for transitions: a small letter, any capital, a digit, any other sign.
_KINDS = "abcdefghijklmnopqrstuvwxyzA0-"


@dataclass(frozen=True)
class Tables:
    """What is learned besides the forest: log odds of a secret for each transition between two characters, and for words
    before a candidate, behind it and in its path."""

    transitions: tuple[float, ...]
    before: dict
    after: dict
    path: dict


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _kinds(value: Column) -> Column:
    """A value's characters by kind."""
    return F.regexp_replace(F.translate(value, "BCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "A" * 25 + "0" * 9), "[^a-zA0]", "-")


def _words_of(text: Column, last: bool) -> Column:
    """The ``NEAR`` words of letters next to a candidate; what stands further away isn't cut into words."""
    near = F.substring(text, -80, 80) if last else F.substring(text, 1, 80)
    found = F.regexp_extract_all(F.lower(near), F.lit("[a-z]+|[=:]"), F.lit(0))
    return F.slice(F.reverse(found), 1, NEAR) if last else F.slice(found, 1, NEAR)


def _path_words(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(path, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def _odds(words: Column, table: dict) -> Column:
    """The sum of the words' log odds."""
    if not table:
        return F.lit(0.0)
    # One literal, which is read once: a map of many would be planned word by word.
    known = F.str_to_map(F.lit(";".join(f"{w}~{x}" for w, x in table.items())), F.lit(";"), F.lit("~")).cast("map<string,double>")
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))


def _transition_odds(value: Column, table: tuple[float, ...]) -> Column:
    """The mean log odds of a value's transitions, over all of it."""
    odds, n = F.split(F.lit(" ".join(map(str, table))), " ").cast("array<double>"), len(_KINDS)
    code = lambda c: F.instr(F.lit(_KINDS), c) - 1
    added = lambda s, c: F.struct(code(c).alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(odds, s["last"] * n + code(c)))).alias("sum"))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(_kinds(value), ""), start, added, lambda s: s["sum"]) / F.greatest(F.length(value) - 1, F.lit(1))


def _value(match: Column) -> Column:
    """A candidate without the name it is assigned to or the URL's user before it."""
    return F.regexp_replace(F.regexp_replace(match, rf"^{_KEYED}", ""), _IN_URL, "")


def features(match: Column, left: Column, right: Column, path: Column, tables: Tables) -> Column:
    """The struct of ``FEATURES`` of a candidate, what stands before and behind it, and its document's path or source."""
    keyed = match.rlike(rf"^{_KEYED}") | match.rlike(_IN_URL)
    value = _value(match)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    return F.struct(
        F.length(value).cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"),
        share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])").alias("letter_digit"),
        share("[a-z](?=[A-Z])|[A-Z](?=[a-z])").alias("case_change"),
        (F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) / F.least(n, F.lit(64.0))).alias("distinct"),
        _yes(value.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        (1 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n).alias("dictionary"),
        _transition_odds(value, tables.transitions).alias("transitions"),
        _yes(keyed).alias("keyed"),
        _yes(value.rlike(KNOWN)).alias("known"),
        _yes(value.rlike("^[0-9+_=~/-]+$")).alias("only_digits"),
        _odds(_words_of(left, True), tables.before).alias("before"),
        _odds(_words_of(right, False), tables.after).alias("after"),
        _odds(_path_words(path), tables.path).alias("path"),
    )


@dataclass(frozen=True)
class Finding:
    """A labelled finding: the match as ``CANDIDATE`` gives it, what stands around it, its path, and whether it is real."""

    match: str
    left: str
    right: str
    path: str
    secret: bool
    #: The labelled line it comes from.
    line: int = 0


def labelled_findings(spark, lines=None, copies: int = 24, seed: int = 11) -> list[Finding]:
    """The candidates in the labelled lines of ``findings``, as the scan cuts them; bounded by lines times ``copies``.

    Of all but a line's first copy, what stands around a candidate and its path are left out at times, so that no model
    leans on words alone."""
    made, rng = findings.documents(lines, copies, seed), random.Random(seed)
    text = F.col("text")
    df = spark.createDataFrame([(i, p, t) for i, p, t, _ in made], "id long, path string, text string")
    cut = df.select("id", "path", F.split(text, CANDIDATE, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found")).orderBy("id").collect()
    real = {i: r for i, _, _, r in made}
    some = lambda x, i: x if i % copies == 0 or rng.random() > LEFT_OUT else ""
    return [
        Finding(m, some(r["pieces"][k], r["id"]), some(r["pieces"][k + 1], r["id"]), some(r["path"], r["id"]), any(s in m for s in real[r["id"]]), r["id"] // copies)
        for r in cut for k, m in enumerate(r["found"])
    ]


def _log_odds(counts: dict, least: int) -> dict:
    """Smoothed log odds of each key of ``counts`` ({key: [not secret, secret]}); the commonest ``WORDS`` that come often enough."""
    no, yes = (sum(c[k] for c in counts.values()) + 1 for k in (0, 1))
    often = sorted((k for k, c in counts.items() if sum(c) >= least), key=lambda k: (-sum(counts[k]), k))[:WORDS]
    return {k: math.log((counts[k][1] + 1) / yes) - math.log((counts[k][0] + 1) / no) for k in often}


def learn_tables(rows: list[tuple[str, list[str], list[str], list[str], bool]]) -> Tables:
    """From (kinds of the value's characters, words before, behind, in the path, label)."""
    pairs = [[0.5, 0.5] for _ in range(len(_KINDS) ** 2)]
    words: tuple[dict, ...] = ({}, {}, {})
    code = {c: k for k, c in enumerate(_KINDS)}
    for kinds, *around, secret in rows:
        for a, b in zip(kinds, kinds[1:]):
            pairs[code[a] * len(_KINDS) + code[b]][secret] += 1
        for table, own in zip(words, around, strict=True):
            for w in set(own):
                table.setdefault(w, [0, 0])[secret] += 1
    no, yes = (sum(p[k] for p in pairs) for k in (0, 1))
    return Tables(tuple(math.log(p[1] / yes) - math.log(p[0] / no) for p in pairs), *(_log_odds(t, 5) for t in words))


def _grow(rows: list[tuple[tuple[float, ...], bool]], depth: int, rng: random.Random):
    """A tree: a share of secrets, or (feature, at most, tree if so, tree if not)."""
    yes = sum(y for _, y in rows)
    if depth == 0 or len(rows) < 2 * LEAST or yes in (0, len(rows)):
        return yes / len(rows)
    best = None
    for k in rng.sample(range(len(FEATURES)), math.isqrt(len(FEATURES)) + 1):
        order = sorted((x[k], y) for x, y in rows)
        left = 0
        for i in range(1, len(order)):
            left += order[i - 1][1]
            if order[i][0] == order[i - 1][0] or not LEAST <= i <= len(order) - LEAST:
                continue
            a, b = left / i, (yes - left) / (len(order) - i)
            loss = i * a * (1 - a) + (len(order) - i) * b * (1 - b)
            if best is None or loss < best[0]:
                best = (loss, k, (order[i][0] + order[i - 1][0]) / 2)
    if best is None:
        return yes / len(rows)
    _, k, cut = best
    return k, cut, _grow([r for r in rows if r[0][k] <= cut], depth - 1, rng), _grow([r for r in rows if r[0][k] > cut], depth - 1, rng)


@dataclass(frozen=True)
class Forest:
    tables: Tables
    trees: list


def train(spark, labelled: list[Finding], seed: int = 3) -> Forest:
    """A forest of ``TREES`` bagged trees over the features that the scan itself computes.

    Trees see features from tables that were learned on other lines than a finding's own, so they learn how far words and
    transitions can be trusted on text that the tables haven't seen; the scan uses tables from all lines."""
    schema = "fold int, match string, left string, right string, path string, secret boolean"
    rows = spark.createDataFrame([(f.line % FOLDS, f.match, f.left, f.right, f.path, f.secret) for f in labelled], schema)
    match, left, right, path = (F.col(c) for c in ("match", "left", "right", "path"))
    value = _value(match)
    seen = rows.select("fold", _kinds(value).alias("kinds"), _words_of(left, True).alias("before"), _words_of(right, False).alias("after"), _path_words(path).alias("path"), "secret").collect()
    data: list = []
    for k in range(FOLDS):
        tables = learn_tables([tuple(r)[1:] for r in seen if r["fold"] != k])
        own = rows.where(F.col("fold") == k).select(features(match, left, right, path, tables).alias("f"), "secret").collect()
        data += [(tuple(r["f"]), bool(r["secret"])) for r in own]
    rng = random.Random(seed)
    return Forest(learn_tables([tuple(r)[1:] for r in seen]), [_grow(rng.choices(data, k=len(data)), DEPTH, rng) for _ in range(TREES)])


def probability(forest: Forest, f: Column) -> Column:
    """The forest's vote as an expression over a struct of ``FEATURES``."""

    def tree(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        k, cut, low, high = node
        return F.when(f[FEATURES[k]] <= float(cut), tree(low)).otherwise(tree(high))

    total = tree(forest.trees[0])
    for t in forest.trees[1:]:
        total = total + tree(t)
    return total / float(len(forest.trees))


def _judged(text: Column, path: Column, forest: Forest) -> tuple[Column, Column]:
    """(pieces between candidates, candidates with ``match, p``) of a text."""
    pieces, matches = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    told = F.transform(matches, lambda m, i: F.struct(m.alias("match"), features(m, F.get(pieces, i), F.get(pieces, i + 1), path, forest.tables).alias("f")))
    return pieces, F.transform(told, lambda x: F.struct(x["match"].alias("match"), probability(forest, x["f"]).alias("p")))


def scan_secrets(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: ``doc_id, n`` (from 0, in the text's order), ``preview, length, value_sha256, p_secret, secret``.

    DataFrame functions only, row by row, no shuffle: whole texts are matched once for a filter and, where there is
    something, cut at the candidates; the forest is an expression. Values are reported by digest and first characters,
    never whole. Null and empty texts have no candidates; a null path (or ``path_col`` absent) tells nothing; null and
    repeated ids stay; no documents give no rows; other columns are not read.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    some = docs.where(F.col(text_col).rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), _judged(F.col(text_col), path, forest)[1].alias("found"))
    rows = some.select("doc_id", F.posexplode("found").alias("n", "x"))
    value = _value(F.col("x.match"))
    return rows.select(
        "doc_id", "n", F.substring(F.col("x.match"), 1, 8).alias("preview"), F.length(value).alias("length"), F.sha2(value, 256).alias("value_sha256"), F.col("x.p").alias("p_secret"), (F.col("x.p") >= threshold).alias("secret")
    )


def redact_secrets(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text", path_col: str = "source", mark: str = "<SECRET>") -> DataFrame:
    """All documents and columns; in ``text_col``, the value of each secret that ``scan_secrets`` finds becomes ``mark``.

    The name that a value is assigned to stays, and so does a URL's user. Texts without secrets stay as they are, null ones too.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    pieces, found = _judged(F.col(text_col), path, forest)
    cleaned = F.transform(found, lambda x: F.when(x["p"] >= threshold, F.concat(F.left(x["match"], F.length(x["match"]) - F.length(_value(x["match"]))), F.lit(mark))).otherwise(x["match"]))
    joined = F.array_join(F.zip_with(pieces, cleaned, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return docs.withColumn(text_col, F.when(F.col(text_col).rlike(CANDIDATE), joined).otherwise(F.col(text_col)))
