"""Periodic runs against plain loops over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from quillspark.llm import periodic_runs, queries
from quillspark.llm.runtime import slices

SCHEMA = "doc_id long, text string, start long, period int, n_runs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "r") for i, t in rows], SCHEMA)


def brute(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, 2 * q) and not any(w[i : i + size - r] == w[i + r : i + size] for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng, n):
    if rng.random() < 0.5:
        return [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
    w = []
    while len(w) < n:
        w += [rng.randrange(3) for _ in range(rng.randint(1, 9))] * rng.randint(1, 4)
        w = w[: len(w) - rng.randint(0, 2)] or w
    return w


def test_runs_are_those_of_loops():
    rng = random.Random(1)
    for _ in range(800):
        w = sequence(rng, rng.randint(0, 60))
        for least in (12, 5):
            assert periodic_runs.periodic_runs(np.array(w, np.int32), least) == brute(w, least), (w, least)


def test_end_positions_are_ordered_and_know_neighbours():
    rng = random.Random(2)
    numbers = rng.sample(range(10**6), 3000)
    some, plain = periodic_runs.EndPositions(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        before, behind = max((y for y in plain if y < x), default=-1), min((y for y in plain if y > x), default=-1)
        assert some.add(x) == (before, behind)
        plain.append(x)
    assert list(some) == sorted(plain) and len(some) == len(plain)


def plain_row(key, text, loops):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode())
    if loops and key is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (key, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_what_loops_give(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len(d[1] or "") < 6000]
    got = periodic_runs.collapse_runs(frame(spark, docs).repartition(3), change=periodic_runs.looped)
    assert Counter(map(tuple, got.collect())) == Counter(plain_row(*d, True) for d in docs)
    assert queries.op13_periodic_runs(spark, tiny).columns == got.columns


def test_nulls_ties_long_texts_and_repeats(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "  \n ", "a " * 11, "a " * 12, "x a b c d e f a b c d e f a y", "é 日 " * 9 + "\x1c \x85 " * 8, "word " * 300]
    texts += [" ".join(f"w{k}" for k in sequence(rng, rng.randint(0, 70))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(None, "a b " * 10), (None, None), (3, "q " * 30), (3, "q " * 30), (-7, "c " * 20), (2**60, "d e f " * 9)]
    got = periodic_runs.collapse_runs(frame(spark, docs))
    assert Counter(map(tuple, got.collect())) == Counter(plain_row(*d, False) for d in docs)
    both = periodic_runs.collapse_runs(frame(spark, [(1, "x a b a b a b a b a b a b y")]), with_text=True).first()
    assert both.collapsed_text == "x a b y"
    assert periodic_runs.collapse_runs(frame(spark, [])).count() == 0
    long = [(i, " ".join(rng.choice(["one", "two", "three"]) + str(k % (4000 + i)) for k in range(150_000))) for i in range(2)]
    long.append((9, " ".join(str(k % 50_000) for k in range(150_000))))
    rows = {r.doc_id: r for r in periodic_runs.collapse_runs(frame(spark, long)).collect()}
    assert (rows[9].n_runs, rows[9].start, rows[9].length, rows[9].period) == (1, 0, 150_000, 50_000) and rows[0].n_runs == 0
    data = b"ab cd\tef " + b"x" * 50 + b" y"
    for size in (1, 4, 20, 1000):
        assert b" ".join(slices(data, size)).split() == data.split()
