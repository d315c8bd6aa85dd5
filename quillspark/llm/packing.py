"""Best-fit packing in a tree: local best fit, nearly full bins go out, underfull bins meet again as items."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import give_back, written
from .tokens import bpe

#: Bins with no more room than this count as nearly full before the last round.
SLACK = 8
#: Nodes of one round for each node of the next.
FAN_IN = 16
#: Pieces that a task packs at a time, in the first round and, about, in all others.
LOCAL_ITEMS = 400_000
#: Rounds that can't have fewer nodes end when one saves less than this share of bins.
LEAST_GAIN = 0.005

ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, node long, open boolean"


def best_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each item: largest items first, each into the bin whose room it leaves smallest."""
    by_room, mask, bins, out = defaultdict(list), 0, 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := mask >> size:
            left = size + (fits & -fits).bit_length() - 1
            k = by_room[left].pop()
            if not by_room[left]:
                mask &= ~(1 << left)
        else:
            k, left, bins = bins, room, bins + 1
        out[i] = k
        by_room[left - size].append(k)
        mask |= 1 << (left - size)
    return out


def _packed(items: pd.DataFrame, room: int, node: int, first_bin: int, last: bool) -> pd.DataFrame:
    """Packs the bins that ``items`` (rows of pieces) are in; each bin of several pieces stays whole."""
    groups = items.drop_duplicates("bin").sort_values("bin")
    sizes = groups["fill"].astype(int).to_numpy()
    to = np.array(best_fit(sizes.tolist(), room), np.int64)
    order = np.lexsort((np.arange(len(to)), to))
    ahead = np.cumsum(sizes[order]) - sizes[order]
    begins = np.flatnonzero(np.diff(to[order], prepend=-1))
    ahead = ahead - np.repeat(ahead[begins], np.diff([*begins, len(to)]))
    shift = np.empty(len(to), np.int64)
    shift[order] = ahead
    fill = np.bincount(to, weights=sizes).astype(np.int64)
    stays = (fill < room - SLACK) & (not last)
    at = np.searchsorted(groups["bin"].to_numpy(), items["bin"].to_numpy())
    return items.assign(bin=first_bin + to[at], offset=items["offset"].to_numpy() + shift[at], fill=fill[to[at]], node=node, open=stays[to[at]])


def _parent(fills: dict[int, int], room: int, nodes: int, level: int) -> Column:
    """The node of each bin: about as many pieces to each, in order of the smaller of fill and room."""
    counts: dict[int, int] = defaultdict(int)
    for fill, n in fills.items():
        counts[min(fill, room - fill)] += n
    share, at, start, width = max(1, -(-sum(counts.values()) // nodes)), 0, [0] * (room + 1), [1] * (room + 1)
    for key in sorted(counts):
        start[key], width[key] = at // share, (at + counts[key] - 1) // share - at // share + 1
        at += counts[key]
    key = F.least("fill", room - F.col("fill")).cast("int")
    look = lambda values: F.get(F.array(*map(F.lit, values)), key)
    return look(start) + F.pmod(F.xxhash64("bin", F.lit(level)), look(width))


def _meet(room: int, level: int, last: bool):
    """What a node does with the underfull bins of the nodes below it."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["parent"].iloc[0])
        return _packed(pdf.drop(columns="parent"), room, node, (level << 56) + (node << 32), last)

    return meet


def pieces_of(ids: np.ndarray, room: int) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32) of a sequence's pieces; of a longer one all but the first hold ``room``."""
    first = len(ids) % room or room
    ends = range(first, len(ids) + 1, room) if len(ids) > room else [len(ids)]
    raw = np.ascontiguousarray(ids, "<u4")
    return [(a := max(0, end - room if end > first else 0), end - a, zlib.crc32(raw[a:end])) for end in ends]


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``separator``; only one longer than ``room`` is cut. A sequence holds at most ``room`` ids
    and has no gaps. Each task tokenizes its split and packs it by best fit; bins with more than ``SLACK`` ids of room
    then meet as items, round after round, at ``FAN_IN`` times fewer nodes, until one node is left. Bins are dealt to nodes
    by how well they may fit: a bin's key is its fill or its room, whichever is less, so those that can fill each other
    exactly have one key, and nodes take ranges of keys (a key with many bins is spread over several nodes). Where a node
    would have over ``LOCAL_ITEMS`` pieces there are more nodes, so no task ever holds more than about that, whatever the
    input. Before each round, bins that not even the emptiest of all could join are done. The rounds end with the one of a
    single node, or when one at the fewest nodes allowed saves less than ``LEAST_GAIN`` of its bins; what is underfull then
    goes out as it is. Texts never shuffle, and each round is written to the shared folder.

    Null text counts as empty: one separator. Null and repeated ids are packed like others. No documents, no rows.
    Other columns are not read.
    """

    def local(batches):
        coder, node, bins = bpe(tokenizer), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def flush():
            nonlocal rows, bins
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out = out.assign(bin=np.arange(len(out)), offset=0, fill=out["length"])
            out = _packed(out, room, node, (node << 32) + bins, False)
            bins, rows = bins + len(out), []
            return out

        for pdf in batches:
            for key, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids = np.append(coder.encode(text or ""), np.uint32(separator))
                rows += [(key, k, *x) for k, x in enumerate(pieces_of(ids, room))]
            if len(rows) >= LOCAL_ITEMS:
                yield flush()
        if rows:
            yield flush()
        give_back()

    # Null ids travel as such: Arrow turns them into floats in pandas, so ids are carried as nullable integers.
    items = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(local, ITEM), "packing")
    done, level = [items.where("not open")], 0
    rest = items.where("open")
    nodes, bins, held = (rest.agg(F.max("node")).first()[0] or 0) + 1, 0, False
    while True:
        # Pieces and bins by fill: no more rows than ``room``.
        fills = rest.groupBy("fill").agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("offset") == 0).alias("bins")).collect()
        most = room - min((r["fill"] for r in fills), default=0)
        if any(r["fill"] > most for r in fills):
            done.append(rest.where(F.col("fill") > most))
            rest, fills = rest.where(F.col("fill") <= most), [r for r in fills if r["fill"] <= most]
        was, bins = bins, sum(r["bins"] for r in fills)
        if not fills or (held and bins > (1 - LEAST_GAIN) * was):
            done.append(rest)
            break
        fewest = -(-sum(r["pieces"] for r in fills) // LOCAL_ITEMS)
        nodes, level = max(-(-nodes // FAN_IN), fewest), level + 1
        held, last = nodes == fewest, nodes == 1
        parent = _parent({r["fill"]: r["pieces"] for r in fills}, room, nodes, level)
        met = rest.withColumn("parent", parent).groupBy("parent").applyInPandas(_meet(room, level, last), ITEM)
        if last:
            done.append(met)
            break
        met = written(met, "packing")
        done.append(met.where("not open"))
        rest = met.where("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
