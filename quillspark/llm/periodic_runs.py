"""Periodic runs: a suffix automaton's sets of end positions, merged small to large; neighbours close together seed squares."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import slices

#: Words that are joined and hashed at a time.
JOINED = 200_000


class EndPositions:
    """An ordered set of positions, in blocks, so that one more costs little wherever it goes."""

    BLOCK = 512

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [array("i", [first])], [first], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Puts ``x`` in and returns its neighbours, or -1."""
        k = max(0, bisect_right(self.lows, x) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else (self.blocks[k - 1][-1] if k else -1)
        behind = block[at] if at < len(block) else (self.lows[k + 1] if k + 1 < len(self.blocks) else -1)
        block.insert(at, x)
        self.size += 1
        if not at:
            self.lows[k] = x
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.lows.insert(k + 1, block[half])
            del block[half:]
        return before, behind


def automaton(seq: list[int]) -> tuple[array, array, array]:
    """The suffix automaton's states: suffix link, length of the longest word, and the end of the prefix (-1 for a copy).

    Most states have one way out; it stands in arrays, and only states with more have a table.
    """
    link, length, char, to, end = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for pos, c in enumerate(seq):
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        char.append(-1)
        to.append(-1)
        end.append(pos)
        p, q = last, -1
        while p != -1:
            ways = more.get(p)
            if ways is not None:
                q = ways.get(c, -1)
                if q != -1:
                    break
                ways[c] = new
            elif char[p] == c:
                q = to[p]
                break
            elif char[p] == -1:
                char[p], to[p] = c, new
            else:
                more[p] = {char[p]: to[p], c: new}
            p = link[p]
        if q != -1:
            if length[p] + 1 != length[q]:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                char.append(char[q])
                to.append(to[q])
                end.append(-1)
                if q in more:
                    more[copy] = dict(more[q])
                link[q], q_was, q = copy, q, copy
                while p != -1:
                    ways = more.get(p)
                    if ways is not None:
                        if ways.get(c) != q_was:
                            break
                        ways[c] = copy
                    elif char[p] == c and to[p] == q_was:
                        to[p] = copy
                    else:
                        break
                    p = link[p]
            link[new] = q
        last = new
    return link, length, end


def runs_of(seq: list[int], least: int) -> dict[tuple[int, int], int]:
    """The smallest period of each maximal run (start, length) of at least ``least`` and two periods.

    The ends of a state's words are gathered from the states below it, the smaller set put into the larger one by one. A
    position and its new neighbour have the state's longest word in common, and no more if the words before it differ;
    where they are no further apart than that is long, there is a square. If the words behind them differ too, the run
    that it seeds is whole: the run's end gives it. A run found with several periods has the smallest.
    """
    link, length, end = automaton(seq)
    n, found, sets = len(seq), {}, {}

    def seed(a: int, b: int, size: int) -> None:
        period = b - a
        if period <= size and period + size >= least and (b + 1 == n or seq[a + 1] != seq[b + 1]) and (a < size or seq[a - size] != seq[b - size]):
            run = (a - size + 1, size + period)
            found[run] = min(period, found.get(run, period))

    def put(into: EndPositions, x: int, size: int) -> None:
        before, behind = into.add(x)
        if before >= 0:
            seed(before, x, size)
        if behind >= 0:
            seed(x, behind, size)

    for v in np.argsort(np.frombuffer(length, np.int32), kind="stable")[:0:-1].tolist():
        own, size = sets.pop(v, None), length[v]
        if end[v] >= 0:
            if own is None:
                own = EndPositions(end[v])
            else:
                put(own, end[v], size)
        up = link[v]
        if up > 0:
            other = sets.get(up)
            if other is None:
                sets[up] = own
                continue
            if len(own) > len(other):
                own, other = other, own
                sets[up] = other
            size = length[up]
            for x in own:
                put(other, x, size)
    return found


def _stretches(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of words that hold every run: all words of a run lie in phrases of half its least length that come again,
    no further on than half the stretch. Names of phrases may coincide, which only keeps more."""
    size, work, out = least // 2, [(0, len(codes))], []
    while work:
        a, b = work.pop()
        if b - a < least:
            continue
        part = codes[a:b].astype(np.uint64) + np.uint64(1)
        name = np.zeros(b - a - size + 1, np.uint64)
        for k in range(size):
            name = name * np.uint64(0x9E3779B97F4A7C15) + part[k : len(name) + k]
            name ^= name >> np.uint64(29)
        order = np.argsort(name, kind="stable")
        same = (name[order[1:]] == name[order[:-1]]) & (np.diff(order) <= (b - a) // 2)
        steps = np.zeros(b - a + 1, np.int64)
        for starts in (order[:-1][same], order[1:][same]):
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + size, -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(steps)[:-1] > 0, [False])).astype(np.int8)))
        inner = list(zip((edges[0::2] + a).tolist(), (edges[1::2] + a).tolist(), strict=True))
        if inner == [(a, b)]:
            out.append((a, b))
        else:
            work += inner
    return out


def periodic_runs(codes: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` and two periods, by start and period."""
    out = []
    for a, b in _stretches(codes, least):
        seq = np.unique(codes[a:b], return_inverse=True)[1].tolist()
        out += [(a + start, size, period) for (start, size), period in runs_of(seq, least).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(key: int | None, codes: np.ndarray) -> np.ndarray:
    """The words, of one document in ten, with a passage of it over and over to its end: known runs of many lengths."""
    n, h = len(codes), 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((codes[:a], codes[a + np.arange(n - a) % period]))


def _joined(vocabulary: list[bytes], codes: np.ndarray):
    """The words, joined by one space, in parts."""
    for k in range(0, len(codes), JOINED):
        yield b" " * (k > 0) + b" ".join(map(vocabulary.__getitem__, codes[k : k + JOINED].tolist()))


def _document(key, text: str, least: int, change, with_text: bool) -> tuple:
    table: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts = []
    for some in slices(text.encode("utf-8", "surrogatepass")):
        words = some.split()
        parts.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
    codes, vocabulary = np.concatenate(parts), list(table)
    if change is not None:
        codes = change(key, codes)
    runs = periodic_runs(codes, least)
    gone = np.zeros(len(codes) + 1, np.int64)
    listed = hashlib.sha256()
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
        listed.update(b"%d,%d,%d\n" % (start, size, period))
    kept = codes[np.cumsum(gone[:-1]) == 0] if runs else codes
    sha, texts = hashlib.sha256(), []
    for part in _joined(vocabulary, kept):
        sha.update(part)
        if with_text:
            texts.append(part)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    out = (key, len(runs), *best, milli, listed.hexdigest(), sha.hexdigest())
    return (*out, b"".join(texts).decode("utf-8", "surrogatepass")) if with_text else out


def collapse_runs(docs: DataFrame, least: int = 12, change=None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_runs``, ``start, length, period, exponent_milli`` of its longest run (ties: the
    first, then the least period), ``runs_sha256``, ``collapsed_sha256`` (and ``collapsed_text`` if asked for).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a stretch of words with smallest period q, of at least
    ``least`` words and two periods, that no neighbouring word extends. Words that lie in some run behind its first q words
    are dropped; what stays, joined by one space, is the collapsed text. ``change``, a function of a document's id and its
    words' numbers, may put other numbers in their place first (``looped``).

    A row a document, no shuffle. Texts are read in slices into numbers of words; phrases that come again nearby bound the
    stretches that can hold a run, and only these get an automaton: some 40 bytes a word, so memory grows with the longest
    periodic passage of one text, not with the table. Null and empty texts have no words and no runs; null and repeated
    ids stay; no documents, no rows; other columns are not read.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["collapsed_text"] * with_text
    kinds = ["long"] * 6 + ["string"] * (2 + with_text)

    def collapse(batches):
        import pyarrow as pa

        types = [pa.int64() if k == "long" else pa.string() for k in kinds]
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(_document(key, text.as_py() or "", least, change, with_text))
                held += len(rows[-1][-1])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(collapse, schema)
