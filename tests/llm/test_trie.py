"""The prefix trie and the ordered scan against plain loops."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillspark.llm import prefix_trie, queries
from quillspark.llm.ordered import scan

SCHEMA = "conv_id long, turn long, role string, text string, depth int, sym string, place long, first long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], SCHEMA)


def turns_of(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            mark = f"{len(role or '')}:{role or ''}{text or ''}"
            digest = hashlib.sha256(mark.encode()).digest()
            own[c].append(((t is not None, t or 0), base64.b64encode(digest)[:16], (role or "", text or "")))
    return {c: [x[2] for x in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def brute(convs):
    """Rows of the trie, node by node."""
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, ids in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(ids) - 1) * words
    out = Counter()
    for k, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out[min(ids), len(k), parent, len(ids), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["a b", "a  b", "c", "", None, "é x\ty", "one two three"])
    role = lambda: rng.choice(["user", "assistant", None, ""])
    rows = [(c, t, role(), text()) for c in [*range(0, 64), 200, 201, -20, -3, -25, 2**40 + 1] for t in range(rng.choice([1, 2, 3, 5]))]
    long = [(role(), text()) for _ in range(120)]
    for c in (300, 301, 320, 333):
        rows += [(c, t, *x) for t, x in enumerate(long[: 120 - (c == 301) * 50])]
    rows += [(334, t, *x) for t, x in enumerate(long[:90] + [("user", "z")] * 3)]
    rows += [(335, None, "user", "n"), (335, None, "user", "n"), (335, 0, "user", "n"), (None, 1, "user", "lost"), (336, 5, "user", "a b"), (336, 5, "user", "a b"), (336, 5, "x", "c")]
    return rows


def test_trie_is_what_loops_give(spark, monkeypatch):
    """Blocks of three turns, so that long conversations are ranked in several rounds."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "SPAN", 2)
    rows = made(1)
    turns = frame(spark, rows)
    got = prefix_trie.prefix_trie(turns).cache()
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == brute(turns_of(rows))
    ends = got.selectExpr("preorder", "subtree_end", "depth").collect()
    assert sorted(r.preorder for r in ends) == list(range(len(ends)))
    inside = {r.preorder: r.depth for r in ends}
    for r in ends:
        assert all(inside[p] > r.depth for p in range(r.preorder + 1, r.subtree_end + 1)) and inside.get(r.subtree_end + 1, 0) <= r.depth
    got = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turn_marks(turns)))
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == brute(rebuilt(turns_of(rows)))


def test_trie_of_the_smallest_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(spark, tiny)
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == brute(rebuilt(turns_of(rows)))


def test_no_conversations_and_turnless_ones(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turn_marks(frame(spark, [(lone, 0, "user", "x"), (lone, 1, "user", "y")]))))
    assert [tuple(r) for r in got.select(COLUMNS).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_scan_counts_runs_sums_and_last_values_across_parts(spark):
    rng = random.Random(5)
    rows = sorted((rng.choice([None, "a", "b", "b", "c"]) or "", i, rng.randrange(9), rng.choice([None, None, rng.randrange(99)])) for i in range(500))
    rows = [(k or None, i, v, f) for k, i, v, f in rows]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i long, v long, f long")
    got = {r.i: r for r in scan(df.repartition(5), ["k", "i"], runs=("k",), sums=("v",), fill=("f",)).collect()}
    totals, runs, last = Counter(), Counter(), None
    for place, (k, i, v, f) in enumerate(rows):
        totals[k] += v
        last = last if f is None else f
        assert (got[i].place, got[i].run, got[i].v_sum, got[i].f_last) == (place, runs[k], totals[k], last)
        runs[k] += 1
    whole = {r.i: r for r in scan(df, ["k", "i"], sums=("v",)).collect()}
    assert [whole[i].v_sum for _, i, _, _ in rows] == [sum(x[2] for x in rows[: n + 1]) for n in range(len(rows))]
    assert scan(df.where(F.lit(False)), ["k", "i"], runs=("k",), sums=("v",), fill=("f",)).count() == 0
