"""Substring dedup by recompression: long repeats share interior symbols, which reveal them; their words verify them."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import WORD_BASE, Spans, Words, mix, shuffle_parts, slices, word_pieces

#: Rounds of naming pairs; before the rounds in RUNS, runs are named too. More rounds make fewer and longer symbols, but
#: more windows without a settled one, which are looked up by their own names.
ROUNDS, RUNS = 5, (0,)
#: Neighbouring top symbols that a window is looked up by, at most.
SYMBOLS = 3
#: Bytes of text that one task compares with the names others have found.
BLOCK_BYTES = 8_000_000


def _runs(name: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Equal neighbours become one symbol, named by what repeats and how often. low, high: the words that shaped it."""
    first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    if len(first) == len(name):
        return name, begin, np.concatenate((low[:1], low[:-1])), np.concatenate((high[1:], high[-1:]))
    last = np.concatenate((first[1:], [len(name)])) - 1
    times = (last - first + 1).astype(np.uint64)
    new = np.where(times > 1, mix(name[first] + times * np.uint64(0x2545F4914F6CDD1D)), name[first])
    return new, begin[first], low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(name) - 1)]


def _pairs(name: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, salt: int):
    """Each name is a left or a right one in this round; a left one and the right one behind it become one symbol."""
    right = (mix(name ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
    joins = np.concatenate((~right[:-1] & right[1:], [False]))  # with the next
    taken = np.concatenate(([False], joins[:-1]))
    new = name.copy()
    at = np.flatnonzero(joins)
    new[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + mix(name[at + 1]))
    # A left symbol looks at the one behind it, a right one at the one before it.
    low = np.where(right, np.concatenate((low[:1], low[:-1])), low)
    high = np.where(right, high, np.concatenate((high[1:], high[-1:])))
    high[at] = np.maximum(high[at], high[at + 1])
    low[at] = np.minimum(low[at], low[at + 1])
    keep = ~taken
    return new[keep], begin[keep], low[keep], high[keep]


def symbols(words: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the top symbols over a sequence of word names, and the range [low, high) of words that settle each.

    Names are hashes of what they stand for, so every task of every machine gives equal content the same name without
    a table of names. Two equal substrings have the same symbols wherever low and high lie inside.
    """
    n = len(words)
    name, begin, low, high = words, np.arange(n), np.arange(n), np.arange(1, n + 1)
    for k in range(rounds):
        if k in RUNS:
            name, begin, low, high = _runs(name, begin, low, high)
        name, begin, low, high = _pairs(name, begin, low, high, salt=0x5851F42D4C957F2D * (k + 1) & (2**63 - 1))
    return name, np.minimum(low, begin), np.maximum(high, np.append(begin[1:], n))


class Windows:
    """Windows of ``size`` words of some texts: what each is looked up by, and its digest."""

    def __init__(self, texts: list[bytes], size: int):
        self.words, self.size = Words(texts), size
        names = mix(self.words.names(0))
        ends = self.words.first[1:]
        # A mark of its own stands before and behind each text, so that nothing that looks across it is settled in a window.
        n, k = len(names), len(texts)
        at = np.arange(n) + self.words.doc + 1
        marks = np.concatenate(([0], ends + np.arange(k) + 1))
        seq = np.empty(n + k + 1, np.uint64)
        seq[at] = names
        seq[marks] = mix(np.arange(k + 1, dtype=np.uint64) + np.uint64(0xABCD << 40))
        self.seq = seq
        run = self.words.first[1:] - self.words.first[:-1]
        starts = np.maximum(run - size + 1, 0)
        doc = np.repeat(np.arange(k), starts)
        #: Index (among words) of each window's first word.
        self.start = self.words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.place = self.start + doc + 1  # in seq

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The key each window is looked up by, and a number for what the key names.

        The key is the name of the first ``SYMBOLS`` top symbols that are settled inside the window (fewer, if there are
        fewer), or of all its words if there are none. Equal windows have equal keys: what is settled inside is the same.
        """
        name, low, high = symbols(self.seq)
        # low and high never fall from one symbol to the next, so those settled in a window stand in a row.
        first = np.searchsorted(low, self.place, "left")
        count = np.clip(np.searchsorted(high, self.place + self.size, "right") - first, 0, SYMBOLS)
        key = np.zeros(len(first), np.uint64)
        for k in range(SYMBOLS):
            more = count > k
            key[more] = mix(key[more] * np.uint64(0x9E3779B97F4A7C15) + name[first[more] + k] + np.uint64(1))
        bare = count == 0
        at = self.place[bare]
        key[bare] = mix(Spans(self.seq, WORD_BASE[0]).names(at, at + self.size)) if len(at) else key[bare]
        return key, np.where(bare, self.place + (SYMBOLS + 1) * len(self.seq), first * (SYMBOLS + 1) + count)

    def digests(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the SHA-256 of the chosen windows' words, joined by one space, as two numbers."""
        words = self.words
        size = words.end - words.start
        place = np.cumsum(size + 1) - size - 1  # of each word among all, joined by one space
        data = words.joined()
        first = place[self.start[chosen]]
        last = place[self.start[chosen] + self.size - 1] + size[self.start[chosen] + self.size - 1]
        sha = hashlib.sha256
        raw = b"".join([sha(data[a:b]).digest()[:16] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def _counted(name: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct names, and whether each came more than once."""
    order = np.lexsort((*more, name)) if more else np.argsort(name, kind="stable")
    cols = [c[order] for c in (name, *more)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols]) if len(order) else False
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(order))) > 1
    return (*(c[first] for c in cols), twice)


def _dealt(block: int, parts: int, columns: tuple[np.ndarray, ...]) -> pd.DataFrame:
    """One row for each part of the names: the names themselves and the flags, as bytes."""
    part = columns[0] % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    cut = [[x.tobytes() for x in np.split(c[order], at[1:])] if len(order) else [] for c in columns]
    names = ["a", "b", "twice"] if len(columns) == 3 else ["a", "twice"]
    return pd.DataFrame({"part": found.astype(np.int32), "block": np.int32(block)} | dict(zip(names, cut, strict=True)))


def _read(rows: pd.DataFrame, column: str, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), kind)


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block, those of its names that came more than once in all."""
    names = ["a", "b"] if "b" in pdf.columns else ["a"]
    cols, twice = [_read(pdf, c) for c in names], _read(pdf, "twice", bool)
    rows = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["a"]])
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols]) if len(order) else False
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=1 + twice[order]) > 1
    keep = order[many[group]]
    keep = keep[np.argsort(rows[keep], kind="stable")]
    found, at = np.unique(rows[keep], return_index=True)
    cut = {c: [x.tobytes() for x in np.split(v[keep], at[1:])] if len(keep) else [] for c, v in zip(names, cols, strict=True)}
    return pd.DataFrame({"block": pdf["block"].to_numpy()[found]} | cut)


def _among(sorted_names: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Where each name stands in ``sorted_names``, or -1."""
    if not len(sorted_names):
        return np.full(len(name), -1)
    at = np.minimum(np.searchsorted(sorted_names, name), len(sorted_names) - 1)
    return np.where(sorted_names[at] == name, at, -1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of numbers as values of 16 bytes, which sort as the pairs do."""
    return np.column_stack((a, b)).astype(">u8").view("V16").ravel()


def _batches(pdf: pd.DataFrame, size: int, most: int = 2_000_000):
    """Lists of (row, number of the piece's first word, piece) of about ``most`` bytes: a long text comes in pieces, each
    window in one of them."""
    out, n = [], 0
    for row, text in enumerate(pdf["text"]):
        for first, piece in word_pieces(text.encode("utf-8", "surrogatepass"), size - 1):
            out.append((row, first, piece))
            n += len(piece)
            if n >= most:
                yield out
                out, n = [], 0
    if out:
        yield out


def _kept(text: bytes, gone: np.ndarray | None, with_text: bool) -> tuple:
    """(words, words removed, SHA-256 of the kept ones) of a text, and these if asked for; read in slices."""
    sha, n, some, texts = hashlib.sha256(), 0, False, []
    for part in slices(text):
        words = part.split()
        flags = np.zeros(0, bool) if gone is None else gone[n : n + len(words)]
        stay = words if not flags.any() else [*compress(words, (~flags).tolist()), *words[len(flags) :]]
        n += len(words)
        if stay:
            joined = b" " * some + b" ".join(stay)
            some = True
            sha.update(joined)
            texts += [joined] * with_text
    out = (n, 0 if gone is None else int(gone.sum()), sha.hexdigest())
    return (*out, b"".join(texts).decode("utf-8", "surrogatepass")) if with_text else out


def dedup_substrings(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text`` if asked for).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged. Every word goes that lies in a window of ``size`` words
    whose word sequence also starts elsewhere, in the same document or another, as the input stands (so all copies go).

    Texts are dealt into blocks once. In each, rounds of recompression give runs and pairs of words names that are the
    same wherever the content is; a window is looked up by the first top symbols that lie settled in it (by all its words
    if there are none, so none is missed). Blocks send their distinct names as arrays to the task that has a range of
    names, which returns to each block those of its names that came twice or more; a passage that every document holds is
    one name a block. The windows behind such names are then verified the same way under 128 bits of the SHA-256 of their
    words, and what came twice or more is removed: names, which texts could be made to share, only choose what is
    compared. Three passes read one shuffle of the texts.

    A long text is read in pieces, so memory doesn't grow with it but for the text itself. Null text: no words. Texts under ``size`` words lose none. Null and repeated ids are documents of their own (a repeated
    row makes both its copies repeats). No documents, no rows. Other columns are not read.
    """
    # Ids travel as strings: pandas would turn whole numbers among nulls into floats.
    text = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = text.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(shuffle_parts(docs.sparkSession), n_bytes // BLOCK_BYTES + 1)
    # Repeats of one row in several splits go to several blocks.
    text = text.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for batch in _batches(pdf, size):
            key, place = Windows([x for _, _, x in batch], size).keys()
            # One occurrence for each row of symbols or window that is named, however many windows ask for it.
            _, once = np.unique(place, return_index=True)
            name, twice = _counted(key[once])
            kept[0].append(name)
            kept[1].append(twice)
        name, was = np.concatenate(kept[0]), np.concatenate(kept[1])
        name, twice = _counted(np.concatenate((name, name[was])))
        return _dealt(pdf["block"].iloc[0], blocks, (name, twice))

    def verify(pdf: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(_read(keys, "a"))
        cols = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in _batches(pdf, size) if len(known) else ():
            windows = Windows([x for _, _, x in batch], size)
            at = np.flatnonzero(_among(known, windows.keys()[0]) >= 0)
            if len(at):
                for c, x in zip(cols, windows.digests(at), strict=True):
                    c.append(x)
        return _dealt(pdf["block"].iloc[0] if len(pdf) else 0, blocks, _counted(*map(np.concatenate, cols)))

    def remove(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names, keys = found[found["b"].notna()], found[found["b"].isna()]
        repeats, known = np.sort(_pair(_read(names, "a"), _read(names, "b"))), np.sort(_read(keys, "a"))
        # Of each row that loses words, the words' flags.
        gone: dict[int, np.ndarray] = {}
        for batch in _batches(pdf, size) if len(repeats) else ():
            windows = Windows([x for _, _, x in batch], size)
            maybe = np.flatnonzero(_among(known, windows.keys()[0]) >= 0)
            if not len(maybe):
                continue
            same = _among(repeats, _pair(*windows.digests(maybe))) >= 0
            start, first = windows.start[maybe[same]], windows.words.first
            steps = np.zeros(first[-1] + 1, np.int64)
            steps[start] += 1
            np.add.at(steps, start + size, -1)
            covered = np.cumsum(steps) > 0
            for k, (row, begin, _) in enumerate(batch):
                flags = covered[first[k] : first[k + 1]]
                if flags.any():
                    known_flags = gone.get(row, np.zeros(0, bool))
                    longer = np.zeros(max(len(known_flags), begin + len(flags)), bool)
                    longer[: len(known_flags)] = known_flags
                    longer[begin : begin + len(flags)] |= flags
                    gone[row] = longer
        out = []
        for row, (key, text) in enumerate(zip(pdf["doc_id"], pdf["text"], strict=True)):
            out.append((key, *_kept(text.encode("utf-8", "surrogatepass"), gone.get(row), with_text)))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    by_block = text.groupBy("block")
    keys = by_block.applyInPandas(find, "part int, block int, a binary, twice binary")
    keys = keys.groupBy("part").applyInPandas(_repeated, "block int, a binary")
    names = by_block.cogroup(keys.groupBy("block")).applyInPandas(verify, "part int, block int, a binary, b binary, twice binary")
    names = names.groupBy("part").applyInPandas(_repeated, "block int, a binary, b binary")
    found = keys.withColumn("b", F.lit(None).cast("binary")).unionByName(names)
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    done = by_block.cogroup(found.groupBy("block")).applyInPandas(remove, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
