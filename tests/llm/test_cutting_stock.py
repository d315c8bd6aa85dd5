"""Packing by patterns: whole documents, full sequences, and the linear program against what can be proved."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import cutting_stock
from quillspark.llm.tokens import word_coder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, cls int, slot int, uid string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "u", "i") for i, t in rows], SCHEMA)


def test_word_coder_is_the_library():
    coder, library, rng = word_coder(PATH), Tokenizer.from_file(PATH), random.Random(1)
    assert coder.by_word
    some = ["a", "B", "é", "é", " ", "\n", "\t", "́", " ", "　", "\x1c", "\x85", "İ", "Σ", "ǅ", "'s", "'LL", "'", "1", "٣", "<|startoftext|>", "<|endoftext|>", "<|", "日本"]
    some += ["가", "가", "🙂", "̸", "=", " ", "​", "ﬁ", "_", ".", "\xff", "ß", "×", "straße", "Ÿ", "thereof", "tion", "\x00"]
    for _ in range(6000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def check_whole(rows, out, room, separator):
    """Each document's ids lie in its pieces once and in order; sequences have no gaps and need no padding."""
    library = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for key, text in rows:
        ids[key].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, separator], "<u4"))
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= room and (at == room or at & (at - 1) == 0)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[key]))
        if len(ids[key]) == 1:
            whole, at = ids[key][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(whole), zlib.crc32(whole[at : at + p.length]))
                at += p.length
        else:
            assert {p.doc_tokens for p in pieces} == {len(x) for x in ids[key]}
    return len(sequences)


def test_documents_lie_whole_in_full_sequences(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["one", "two", "tion", "été", "of", "日本", "x1."]) for _ in range(n))
    rows = [(i, text(int(rng.lognormvariate(3, 1)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, text(5000)), (None, text(30)), (None, text(40)), (2**60 + 1, text(9))]
    rows += [(7000, "same " * 20)] * 40 + [(5, text(3)), (-9, text(127)), (1004, "<|endoftext|>")]
    out = cutting_stock.pack_by_patterns(frame(spark, rows).repartition(5), PATH, room=128, separator=2).collect()
    sequences = check_whole(rows, out, 128, 2)
    tokens = sum(r.length for r in out)
    assert sequences <= tokens / 128 + 12 + 25
    uncut = sum(r.length == r.doc_tokens for r in out)
    assert uncut > 0.75 * sum(1 for _ in rows)
    assert cutting_stock.pack_by_patterns(frame(spark, []), PATH).count() == 0
    one = cutting_stock.pack_by_patterns(frame(spark, [(3, "one two three four")]), PATH, room=128).collect()
    assert sorted((r.start, r.length, r.offset) for r in one) == [(0, 4, 0), (4, 1, 0)]


def exact_cost(widths, demand, sizes):
    """The least cost of whole patterns, by trying all of them."""
    fits = []
    for s in sizes:
        for items in itertools.product(*(range(s // w + 1) for w in widths)):
            if any(items) and sum(n * w for n, w in zip(items, widths, strict=True)) <= s:
                fits.append((s + cutting_stock.EXTRA, items))

    known = {}

    def least(left):
        if not any(left):
            return 0
        if left not in known:
            known[left] = min(c + least(tuple(max(0, n - k) for n, k in zip(left, items, strict=True))) for c, items in fits if any(n and k for n, k in zip(left, items, strict=True)))
        return known[left]

    return least(tuple(demand))


@pytest.mark.parametrize("seed", range(6))
def test_the_program_costs_no_more_than_whole_patterns_and_covers_the_demand(seed):
    rng = random.Random(seed)
    sizes = [1, 2, 4, 8, 16]
    widths = sorted(rng.sample(range(3, 17), 3))
    demand = [rng.randint(1, 5) for _ in widths]
    found = cutting_stock.column_generation(widths, np.array(demand, float), sizes)
    cost = sum(v * (s + cutting_stock.EXTRA) for v, s, _ in found)
    whole = exact_cost(widths, demand, sizes)
    # Rounding a solution up costs at most one sequence a class.
    assert whole - (16 + cutting_stock.EXTRA) * len(widths) <= cost <= whole * (1 + cutting_stock.GAP) + 1e-6
    for k, n in enumerate(demand):
        assert sum(v * items.get(k, 0) for v, _, items in found) >= n - 1e-6
    assert all(sum(widths[k] * n for k, n in items.items()) <= s for _, s, items in found)


def test_knapsack_is_what_loops_give():
    rng = random.Random(4)
    widths, values = [3, 5, 7, 11], np.array([rng.random() for _ in range(4)])
    sack = cutting_stock.Knapsack(widths, 60)
    best = sack.solve(values)
    plain = [0.0] * 61
    for c in range(61):
        plain[c] = max([0.0, *(plain[c - w] + v for w, v in zip(widths, values, strict=True) if w <= c)])
    assert np.allclose(best, plain)
    for c in range(61):
        items = sack.items(c)
        assert sum(widths[k] * n for k, n in items.items()) <= c and np.isclose(sum(values[k] * n for k, n in items.items()), plain[c])


def test_patterns_take_no_more_than_there_is():
    rng = np.random.default_rng(2)
    for n in (3, 50, 5000):
        lengths, counts = np.unique(np.clip(rng.lognormal(5, 1, n).astype(int) + 1, 1, 1023), return_counts=True)
        tops, found = cutting_stock.patterns(lengths, counts, 1024)
        demand = np.bincount(np.searchsorted(tops, lengths), weights=counts, minlength=len(tops))
        rows, taken, sequences = cutting_stock._slots(found)
        assert all(taken[k] <= demand[k] for k in taken) and sum(p.size * p.uses for p in found) <= (lengths * counts).sum()
        if n == 5000:
            assert sum(taken.values()) > 0.97 * n
