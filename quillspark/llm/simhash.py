"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .runtime import give_back, shuffle_parts, written

#: Shift and width of the fingerprint's segments. Two fingerprints of at most 4 differing bits differ by at most 1 bit in
#: one of the first two or not at all in the third (2 + 2 + 1 > 4).
SEGMENTS, BALLS, DISTANCE = ((0, 21), (21, 21), (42, 22)), (1, 1, 0), 4
#: A table key with more fingerprints than this (or than 3 N / 25,000) is hot, and one that 8 times as many probe.
HOT = 8192

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _vote(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``sizes`` hashes (none empty): a bit is 1 if set in over half of them."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    parts = -(-sizes // 255)  # a byte counts to 255
    owner = np.repeat(np.arange(len(sizes)), parts)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cut = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    octets = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(sizes), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], cut)
        counts = np.add.reduceat(np.ascontiguousarray(lanes, "<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for k in range(8):
            out |= (2 * counts[:, k] > sizes).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", sign: Column | None = None) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of each whole text, A-Z lower-cased: the vote of its shingles' XXH64, seed 42.

    With ``sign``, an expression of strings over ``docs``, it comes third as ``sign``."""

    signed = sign is not None

    def run(batches):
        from xxhash import xxh64_intdigest as xx

        def flush():
            fps = np.zeros(len(keys), np.uint64)
            if hashes:
                n = np.array(sizes, np.int64)
                fps[n > 0] = _vote(np.array(hashes, np.uint64), n[n > 0])
            return pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "fp": fps.view(np.int64)} | ({"sign": signs} if signed else {}))

        keys, hashes, sizes, signs = [], [], [], []
        for pdf in batches:
            for key, text, own in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["sign" if signed else "text"], strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                joined = b" ".join(words)
                before = len(hashes)
                if len(words) > shingle:
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    starts = np.concatenate(([0], ends[:-shingle])).tolist()
                    hashes += [xx(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
                elif words:
                    hashes.append(xx(joined, 42))
                keys.append(key)
                if signed:
                    signs.append(own)
                sizes.append(len(hashes) - before)
                if len(hashes) >= 500_000:
                    yield flush()
                    keys, hashes, sizes, signs = [], [], [], []
        if keys:
            yield flush()
        give_back()

    more = [] if sign is None else [sign.alias("sign")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more).mapInPandas(run, "doc_id long, fp long" + ", sign string" * len(more))


def _value(fp: np.ndarray, j: int) -> np.ndarray:
    shift, width = SEGMENTS[j]
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _ball(fp: np.ndarray, j: int) -> np.ndarray:
    """(len(fp), n) keys of the Hamming ball that segment ``j`` probes: the segment's number above 22 bits of value."""
    width, flips = SEGMENTS[j][1], [0]
    for r in range(1, BALLS[j] + 1):
        flips += [sum(1 << k for k in ks) for ks in combinations(range(width), r)]
    return (_value(fp, j)[:, None] ^ np.array(flips, np.uint64)) | np.uint64(j << 22)


def _dealt(part: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """Arrays cut into one row of bytes for each part."""
    order = np.argsort(part, kind="stable")
    parts, at = np.unique(part[order], return_index=True)
    cut = [np.split(c[order], at[1:]) if len(part) else [] for c in columns]
    return pd.DataFrame({"part": parts.astype(np.int32)} | {f"c{i}": [x.tobytes() for x in c] for i, c in enumerate(cut)})


def _edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    a, b = forest(a.view(np.int64), b.view(np.int64))
    return pd.DataFrame({"a": a, "b": b})


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Verified links of the table entries and probes of some keys, as a forest."""
    key = np.frombuffer(b"".join(pdf["c0"]), np.uint32)
    fp = np.frombuffer(b"".join(pdf["c1"]), np.uint64)
    order = np.argsort(key, kind="stable")  # a key's table entries (even) stand right before its probes (odd)
    key, fp = key[order], fp[order]
    begin, end = np.searchsorted(key, key & ~np.uint32(1), "left"), np.searchsorted(key, key & ~np.uint32(1), "right")
    probe = np.flatnonzero((key & 1 == 1) & (end > begin))
    begin, n = begin[probe], (end - begin)[probe]
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    done = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(probe):  # about 4 million pairs at a time; only links are kept, and of many only their forest
        to = max(at + 1, int(np.searchsorted(done, done[at] + 4_000_000, "right")) - 1)
        size = n[at:to]
        left = np.repeat(fp[probe[at:to]], size)
        right = fp[np.repeat(begin[at:to], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        near = (left < right) & (np.bitwise_count(left ^ right) <= DISTANCE)
        if near.any():
            a, b = forest(left[near], right[near])
            found_a.append(a)
            found_b.append(b)
        at = to
    return _edges(np.concatenate(found_a), np.concatenate(found_b))


def _points(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of fingerprints that share a point: each with the next."""
    point = np.frombuffer(b"".join(pdf["c0"]), np.uint64)
    fp = np.frombuffer(b"".join(pdf["c1"]), np.uint64)
    order = np.argsort(point, kind="stable")
    point, fp = point[order], fp[order]
    same = point[1:] == point[:-1]
    return _edges(fp[1:][same], fp[:-1][same])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """A forest ``a, b`` of the distinct fingerprints ``fp`` whose components are those of all links.

    Each fingerprint enters one table a segment and probes it with the segment's ball (45 probes). Entries and probes
    go as arrays to the task that has their key, which compares whole fingerprints and returns links as a forest, so a
    dense group gives no more rows than members. Keys with too many entries, counted first, are left out there: all
    fingerprints that touch one are linked by the points within 2 bits of them instead (two are within 4 bits if and
    only if they share one), 2,081 rows each however large the group.
    """
    spark = fps.sparkSession
    n = fps.count()
    parts = max(shuffle_parts(spark), n // 40_000 + 1)
    hot = max(hot, 3 * n // 25_000)
    keys = F.explode(F.array(*[((F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1)) + (j << 22)) for j, (s, w) in enumerate(SEGMENTS)]))
    # At most 100,000 rows, by the choice of ``hot``.
    large = {r["key"]: r["n"] for r in fps.select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot // 4).collect()}
    near = {k ^ f for k in large for f in [0, *(1 << i for i in range(SEGMENTS[k >> 22][1] if BALLS[k >> 22] else 0))]}
    probed = lambda k: sum(large.get(k ^ (1 << i), 0) for i in range(SEGMENTS[k >> 22][1])) if BALLS[k >> 22] else 0
    heavy = np.array(sorted(k for k in near if large.get(k, 0) > hot or probed(k) > 8 * hot), np.uint64)

    def deal(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for k in range(0, len(fp), 20_000):
                own = fp[k : k + 20_000]
                key = [_value(own, j)[:, None] | np.uint64(j << 22) for j in range(3)] + [_ball(own, j) for j in range(3)]
                odd = np.repeat([0, 1], [3, sum(x.shape[1] for x in key[3:])]).astype(np.uint64)
                key = np.concatenate(key, axis=1)
                flat, held = (key << np.uint64(1) | odd).ravel(), np.repeat(own, key.shape[1])
                if len(heavy):
                    light = ~np.isin(key.ravel(), heavy)
                    flat, held = flat[light], held[light]
                part = (flat >> np.uint64(1)) * np.uint64(2654435761) % np.uint64(1 << 32) % np.uint64(parts)
                yield _dealt(part, flat.astype(np.uint32), held)

    met = fps.select("fp").mapInPandas(deal, "part int, c0 binary, c1 binary").groupBy("part").applyInPandas(_met, "a long, b long")
    if not len(heavy):
        return met
    flips = np.array([0, *(sum(1 << k for k in ks) for r in (1, 2) for ks in combinations(range(64), r))], np.uint64)

    def spread(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            touch = np.zeros(len(fp), bool)
            for j in range(3):
                touch |= np.isin(_ball(fp, j), heavy).any(axis=1)
            fp = fp[touch]
            for k in range(0, len(fp), 1000):
                point = fp[k : k + 1000, None] ^ flips
                flat = point.ravel()
                yield _dealt((flat ^ (flat >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(parts), flat, np.repeat(fp[k : k + 1000], len(flips)))

    return met.unionByName(fps.select("fp").mapInPandas(spread, "part int, c0 binary, c1 binary").groupBy("part").applyInPandas(_points, "a long, b long"))


def near_dedup(docs: DataFrame, shingle: int = 4, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", sign: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id`` and, if given, ``sign``, an expression over ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a text of fewer words than ``shingle`` is one shingle, one of none
    (null too) has fingerprint zero and links like any other. Fingerprints link at 4 or fewer differing bits;
    ``component_id`` is the smallest doc_id that links reach, its own included.

    Copies meet as one fingerprint with its smallest id before anything is compared. Fingerprints, links and rounds of
    components are written to the shared folder. Null ids have a row and never name a component that has another id;
    repeated rows stay; no documents give no rows; other columns are not read.
    """
    own = written(fingerprints(docs, shingle, id_col, text_col, sign), "simhash")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash")
    labels = components(links(nodes, hot))
    nodes = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    lowest = nodes.groupBy("label").agg(F.min("low").alias("component_id"))
    found = own.join(nodes.join(lowest, "label").select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *([] if sign is None else ["sign"]))
