"""The operators against brute force on small tables with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import chunked_bpe, components, exact_dedup, packing, queries, runtime, simhash, substring_dedup, topk, toxicity, url_filter
from quillspark.llm.tokens import Bpe, bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Other columns are named as the operators' own temporary and result columns are.
SCHEMA = "doc_id long, text string, digest string, body string, piece int, fp long, block int, kept boolean, keep_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "b", 1, 2, 3, True, 4) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéßÑ日") for _ in range(rng.randint(1, 5)))
    long = " ".join(word() for _ in range(9000))
    shared = " ".join(word() for _ in range(60))
    out = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 20, 200])))) for i in range(40)]
    out += [(100, None), (101, ""), (102, "  \n\t "), (103, long), (104, long), (105, long.upper()), (106, "x" * 30_000)]
    out += [(107, "a " + shared + " b"), (108, shared + " c " + shared), (109, "Hello <|endoftext|> it's  \u00a0 \u3000x"), (110, "don't\r\n\r\n 12345 \x1c\x85 🙂🙂 '''ll")]
    out += [(111, "go " * 120), (112, "go " * 36), (107, "a " + shared + " b"), (-5, "Aé"), (2**40, "aé"), (7, "aÉ")]
    return out


def unique(rows):
    return list(dict(reversed(rows)).items())


def test_round_trip_is_the_librarys(spark, rows):
    library = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, chunked_bpe.round_trip(frame(spark, rows), PATH).collect())) == want
    both = chunked_bpe.decode_documents(chunked_bpe.encode_documents(frame(spark, rows), PATH), PATH)
    assert Counter(map(tuple, both.collect())) == Counter((i, t or "") for i, t in rows)
    assert chunked_bpe.round_trip(frame(spark, []), PATH).count() == 0


def test_every_vocabulary_entry_encodes_to_itself():
    coder = bpe(PATH)
    names = {i: t for t, i in coder.library.get_vocab().items()}
    for i in range(50_256):
        assert [t.id for t in coder.library.model.tokenize(names[i])] == [i]


def test_chunks_share_and_joins_are_repaired():
    coder, rng = bpe(PATH), random.Random(2)
    text = "".join(rng.choice(["the ", "a", "b ", " ", "\n", "é", "1", ".", "'s", "'", "\u00a0", "日本", "\x1c"]) for _ in range(40_000))
    encoder = chunked_bpe.Encoder(coder)
    for t in (text, text[1000:], "x" * 20_000, "x " * 20_000, "日" * 20_000, "'re" * 5000, " \n" * 9000 + "x"):
        assert b"".join(chunked_bpe.units(t.encode())) == t.encode()
        assert encoder.encode(t).tolist() == coder.library.encode(t, add_special_tokens=False).ids
    own, other = set(chunked_bpe.units(text.encode())), list(chunked_bpe.units(("intro " + text).encode()))
    assert sum(len(x) for x in other if x in own) > 0.9 * len(text)


def test_joins_whose_units_disagree_are_widened():
    """A unit that says otherwise near the join, as a wrong table would, is not taken over."""
    coder = bpe(PATH)
    left, right = chunked_bpe.Encoder(coder).unit(b"some words that go before the jo"), chunked_bpe.Encoder(coder).unit(b"in and some that come behind it")
    stay, between, gone = chunked_bpe.joined(left, right, coder)
    ids = [*left.ids[:stay], *between, *right.ids[gone:]]
    assert ids == coder.library.encode("some words that go before the join and some that come behind it").ids
    wrong = chunked_bpe.Encoded(left.data, left.ids[::-1].copy(), coder.lengths[left.ids[::-1]].cumsum())
    assert chunked_bpe.joined(wrong, right, coder) is None


def test_shared_units_are_encoded_once_for_all_blocks(spark, rows):
    """Texts of several blocks take the units they share from one table, and give the library's ids."""
    library, rng = Tokenizer.from_file(PATH), random.Random(8)
    shared = " ".join(f"w{rng.randrange(500)}é" for _ in range(3000))
    docs = [(i, f"start {i} {shared} end {i}") for i in range(12)] + [(None, shared), (2**60 + 1, shared[5:])] + rows
    seen = spark.sparkContext.accumulator(0)

    def give(encoder, keys, texts):
        import pandas as pd

        ids = [encoder.encode(t).astype("int32") for t in texts]
        seen.add(encoder.reused)
        return pd.DataFrame({"doc_id": keys, "ids": ids})

    got = chunked_bpe._encoded(frame(spark, docs).repartition(6), PATH, "doc_id", "text", "ids array<int>", give).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert seen.value > 0.9 * 14 * len(shared)


LONG = ["a" + " " * 2_000_000 + "x", "\n" * 1_500_000, " " * 1_000_000, "a" * 2_000_000 + " b", "a" + "\t " * 300_000 + "\u3000y<|endoftext|>" + " " * 5000 + "z"]


def test_very_long_runs_are_the_librarys(spark):
    library = Tokenizer.from_file(PATH)
    docs = list(enumerate(LONG))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs}
    assert {r.doc_id: r.ids for r in chunked_bpe.encode_documents(frame(spark, docs), PATH).collect()} == want
    packed = packing.pack_documents(frame(spark, docs), PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(x) + 1 for i, x in want.items()}


def test_other_tokenizer_files_are_left_to_the_library(tmp_path):
    """A file that isn't byte-level BPE of the known form must not be read as one."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        coder, text = Bpe(str(path)), "Hello THERE, it's me"
        assert not coder.plain and coder.encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text).ids
        assert chunked_bpe.Encoder(coder).encode(text).tolist() == coder.encode(text).tolist()


@pytest.mark.parametrize("room, items", [(2048, 400_000), (64, 40)])
def test_packing_is_whole_gapless_and_tight(spark, rows, room, items, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    monkeypatch.setattr(packing, "LOCAL_ITEMS", items)
    rows = unique(rows)
    library = Tokenizer.from_file(PATH)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    got = packing.pack_documents(frame(spark, rows).repartition(5), PATH, room=room).collect()
    assert Counter(r.doc_id for r in got) == {i: max(1, -(-len(x) // room)) for i, x in ids.items()}
    bins, ends = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == ends.get(r.doc_id, 0) and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.piece == 0 or r.length == room
        ends[r.doc_id] = r.start + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ends == {i: len(x) for i, x in ids.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= room
    least = -(-sum(map(len, ids.values())) // room)
    assert len(bins) <= least * 1.1 + 1
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
    assert packing.pack_documents(frame(spark, [(None, "a"), (None, None)]), PATH).select("doc_id", "length").orderBy("length").collect() == [(None, 1), (None, 2)]


def test_packing_over_more_bins_than_a_task_holds(spark, monkeypatch):
    """Each node holds a hundred pieces, yet partners meet."""
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 100)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = random.Random(6)
    sizes = [rng.randint(33, 50) for _ in range(600)]
    sizes += [64 - n for n in sizes]
    docs = [(i, "a" + " b" * (n - 2), "d", "b", 1, 2, 3, True, 4) for i, n in enumerate(sizes)]
    got = packing.pack_documents(spark.createDataFrame(docs, SCHEMA).repartition(12), PATH, room=64)
    assert got.agg(F.sum("length")).first()[0] == 600 * 64
    assert 600 <= got.select("sequence_id").distinct().count() <= 630
    # All over half the room: nothing can be paired, so all go out at once.
    assert packing.pack_documents(spark.createDataFrame(docs[:600], SCHEMA).repartition(9), PATH, room=64).select("sequence_id").distinct().count() == 600


def test_best_fit_fills_the_tightest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert packing.best_fit([], 10) == []


@pytest.mark.parametrize("size", [35, 3])
def test_substring_dedup_is_brute_force(spark, rows, size):
    every = [words(t) for _, t in rows]
    count = Counter(tuple(w[k : k + size]) for w in every for k in range(len(w) - size + 1))
    want = Counter()
    for (i, _), w in zip(rows, every):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = substring_dedup.dedup_substrings(frame(spark, rows), size, with_text=True)
    assert Counter(map(tuple, got.collect())) == want
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def test_equal_substrings_share_interior_symbols():
    rng = np.random.default_rng(1)
    inner = rng.integers(0, 6, 400).astype(np.uint64)
    found = []
    for n in (3, 50):
        seq = np.concatenate((rng.integers(10, 99, n).astype(np.uint64), inner, rng.integers(10, 99, n).astype(np.uint64)))
        name, low, high = substring_dedup.symbols(substring_dedup.mix(seq))
        assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
        ok = (low >= n) & (high <= n + 400)
        found.append((name[ok].tolist(), (low[ok] - n).tolist()))
    assert found[0] == found[1] and len(found[0][0]) > 40


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_made_to_share_names_are_told_apart(spark, length):
    """A Thue-Morse word and its complement have one polynomial name under any base; nothing repeats, nothing goes."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(length))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = substring_dedup.Words([word.encode()]).names(), substring_dedup.Words([other.encode()]).names()
    assert a[0] == b[0]
    docs = [(1, " ".join([word] * 35)), (2, " ".join([other] * 35)), (3, " ".join([word] * 34 + [other])), (4, f"{word} " * 36), (None, "x")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(frame(spark, docs)).collect()}
    assert got == {1: (35, 35), 2: (35, 0), 3: (35, 0), 4: (36, 36), None: (1, 0)}
    assert {r.n_removed for r in substring_dedup.dedup_substrings(frame(spark, docs[:3])).collect()} == {0}


def test_one_row_many_times_is_dealt_to_many_blocks(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
    df = frame(spark, [(1, text)] * 200 + [(2, text + " x"), (2**62 + 1, "short")]).repartition(8)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == {(1, 50, 50): 200, (2, 51, 50): 1, (2**62 + 1, 1, 0): 1}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_is_brute_force(spark, rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    best = min if keep == "min" else max
    want = Counter()
    for i, t in rows:
        ids = groups[lower(t)]
        want[i, best(ids), len(ids), i == best(ids), hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect())) == want
    nulls = exact_dedup.exact_dedup(frame(spark, [(None, "q"), (None, "r"), (3, "r")])).select("doc_id", "keep_id", "kept")
    assert Counter(map(tuple, nulls.collect())) == Counter([(None, None, False), (None, 3, False), (3, 3, True)])
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def fingerprint(text):
    w = words(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


@pytest.mark.parametrize("hot", [8192, 1])
def test_simhash_is_brute_force(spark, rows, hot):
    rows = unique(rows)
    base = rows[-1][1] if len(words(rows[-1][1])) > 100 else next(t for _, t in rows if len(words(t)) == 200)
    rows = rows + [(1000 + k, base + " tail" * k) for k in range(12)] + [(2000, "one two"), (2001, "One TWO")]
    fps = {i: fingerprint(t) for i, t in rows}
    label = {i: i for i in fps}
    ids = sorted(fps)
    while True:
        new = {i: min(label[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 4) for i in ids}
        if new == label:
            break
        label = new
    got = simhash.near_dedup(frame(spark, rows), hot=hot).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", label[i]) for i in ids}
    assert len(got) == len(rows) and len(set(label.values())) < len(rows) - 10
    assert simhash.near_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [8192, 0])
def test_simhash_links_dense_groups(spark, hot):
    """A group whose members differ in few bits each, chains over 4 bits, and noise; hot keys go by shared points."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    chain = rng.getrandbits(64)
    for k in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(x, x) for x in signed], "fp long, low long"), hot=hot)
    label = {r.node: r.label for r in components.components(edges).collect()}
    want = {x: x for x in signed}
    while True:
        new = {a: min(want[b] for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4) for a in signed}
        if new == want:
            break
        want = new
    assert {x: label.get(x, x) for x in signed} == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (-3, 5000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(1, 200)) and got[5000] == -3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    clip, want, asked = lambda s: min(max(s, -(2**63)), 2**63 - 1), set(), {}
    for q, v in ok:
        if q % 50 == 0:
            asked[q] = max(asked.get(q, v), v)
    for q, v in asked.items():
        best = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return want


@pytest.mark.parametrize("query_bytes", [16_000_000, 1500])
def test_topk_is_brute_force(spark, monkeypatch, query_bytes):
    for name, value in (("SHARD", 60), ("FEW", 10), ("QUERY_BYTES", query_bytes)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.3, 16).tolist()) for i in range(300)] + [(300 + i, [0.5] * 16) for i in range(20)]
    vectors += [(400, None), (401, [0.1] * 15 + [None]), (402, [float("nan")] + [0.1] * 15), (403, [float("inf")] * 16), (450, [0.2] * 3), (500, [0.0] * 16), (None, [0.1] * 16)]
    vectors += [(600, [0.7] * 16)] * 7 + [(7, [0.4] * 16), (650, []), (600, [0.1] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, dim int, rank int")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"))
    assert set(map(tuple, got.collect())) == brute_top(vectors)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_topk_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 4)
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(200)] + [(201, [5000.0, 0.1, -0.1, 0.2]), (250, [4096.5] * 4), (202, [3e9, -2e9, 1.0, 0.5])]
    vectors += [(300, [1e38, -1e38, 1.0, 0.0]), (203, [2.0**50 + 1, 2.0**50, 0.3, 0.1]), (350, [1e12, 1.0, -1e12, 0.25])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert set(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == brute_top(vectors)


def test_topk_memory_does_not_hang_on_the_number_of_queries():
    """Queries that are vectors of the shard, others, and 30 equal vectors for ties."""
    rng, peaks = np.random.default_rng(11), []
    vectors = np.floor(rng.normal(0, 32, (1200, 24)))
    vectors[700:730] = vectors[3]
    row = SimpleNamespace(**topk.shard_row(24, np.arange(1200), vectors))
    for n in (1000, 6000):
        queries = np.concatenate((vectors, np.floor(rng.normal(0, 32, (6000, 24)))))[:n]
        best = topk.Best(np.arange(n), queries, 5)
        tracemalloc.start()
        topk.search_shard(row, best)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        scores = (queries @ vectors.T).astype(np.int64)
        for i in range(0, n, 7):
            want = sorted((-s, v) for v, s in enumerate(scores[i].tolist()) if v != i)[:5]
            assert list(zip((-best.score[i]).tolist(), best.id[i].tolist(), strict=True)) == want
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 60


@pytest.mark.parametrize("name, most", [("BROADCAST_RULES", 100_000), ("BROADCAST_RULES", 1), ("BROADCAST_BYTES", 20)])
def test_url_filter_is_brute_force(spark, name, most, monkeypatch):
    monkeypatch.setattr(url_filter, name, most)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("a.b.org", "", "block"), ("org", "", "allow"), ("org", "", "block")]
    urls = ["http://x.example.com/en/71?q", "https://EXAMPLE.com/en/7", "http://com/en/", "http://xcom/en/", "http://a.b.org#f", "ftp://c.a.b.org/p", "http://org", "no scheme", "", None, "http://", "http:///en/", "http://e.net/de", "http://e.net/de/?x", "http://e.net?/de/", "a://b://c.com/en/x", "http://." + "z." * 3000 + "com/en/" + "y" * 9000, "http://é.com/en/\nq#", "http://com./en/"]
    pages = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[0], "h")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[2:] if fits else (None, "allow"))

    got = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, host string"), url_filter.rules_table(spark, rules))
    assert Counter(map(tuple, got.collect())) == Counter((i, *judge(u)) for i, u, _ in pages)
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), url_filter.rules_table(spark, rules)).count() == 0
    none = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, host string"), spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string"))
    assert none.where("rule is not null or verdict != 'allow'").count() == 0 and none.count() == len(pages)


def test_spark_xxhash_agrees(spark):
    """The hash that fingerprints are made of is the one that SQL functions give too."""
    text = "A shingle of words, and some more of them to fill 32 bytes"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_pieces_of_a_long_text_hold_each_window_once():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abé日") for _ in range(rng.choice([1, 2, 3, 40]))) for _ in range(4000)).encode()
    whole = substring_dedup.Windows([text], 35)
    for size in (50, 700, 10**6):
        pieces = list(runtime.word_pieces(text, 34, size))
        parts = substring_dedup.Windows([x for _, x in pieces], 35)
        assert Counter(parts.keys()[0].tolist()) == Counter(whole.keys()[0].tolist())
        every = lambda w: Counter(zip(*(x.tolist() for x in w.digests(np.arange(len(w.start)))), strict=True))
        assert every(parts) == every(whole)
        words = text.split()
        assert all(x.split() == words[n : n + len(x.split())] for n, x in pieces)
    assert list(runtime.word_pieces(b"", 34)) == [(0, b"")]


def test_memory_does_not_grow_with_one_text():
    """What a worker holds for a text of 20 MB, besides the text: a tenth of what arrays of all its words would take."""
    text = b" ".join(b"w%d" % (k * k % 99991) for k in range(3_000_000))
    link = toxicity.Link("toxic", np.sort(toxicity._words([b"w1 w4"])[0]), np.ones(2), np.zeros(0), 0.0)
    tracemalloc.start()
    toxicity.probabilities([link], [text])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pdf = pd.DataFrame({"text": [text.decode()]})
    for batch in substring_dedup._batches(pdf, 35):
        substring_dedup.Windows([x for _, _, x in batch], 35).keys()
    both = held, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(both) < 250_000_000, both


def test_a_long_text_counts_as_one(spark):
    rng = random.Random(7)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(50))
    own = lambda: " ".join(f"w{rng.randrange(10**7)}" for _ in range(160_000))
    long = f"{own()} {shared} {own()}"
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, [(1, long), (2, "x " + shared), (3, long[:1_000_000])])).collect()}
    n = len(long[:1_000_000].split()) - 1  # the last word is cut
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed, got[3].n_removed) == (320_050, n + 50, 50, n)
    left = long.split()[n:]
    at = left.index(shared.split()[0])
    assert got[1].kept_sha256 == hashlib.sha256(" ".join(left[:at] + left[at + 50 :]).encode()).hexdigest()


def test_url_rules_are_the_contracts(spark):
    """Each rule's word, on its own host and path, on a subdomain, and where a longer rule reaches into a shorter one."""
    urls = {"http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/71": ("example.com/en/7", "allow"), "http://b.net/de/": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://c.org/es/q": ("org/es/", "block"), "http://c.org/en/q": (None, "allow")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rules_table(spark, queries.URL_RULES)).collect()}
    assert got == dict(enumerate(urls.values()))
