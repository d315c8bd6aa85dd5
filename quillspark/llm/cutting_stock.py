"""Packing as a cutting-stock problem: patterns of lengths by column generation, and ranked documents put into them."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import scan
from .packing import best_fit
from .runtime import written
from .tokens import word_coder

#: Classes of lengths, each a row of the linear program; with no more distinct lengths than that, each is its own.
CLASSES = 160
#: Rounds of generation at most, columns kept between rounds, and the share of the cost that may be left at the end.
ROUNDS, POOL, GAP = 400, 8_000, 5e-4
#: What a sequence costs beside its size: short ones are for what would be padded otherwise.
EXTRA = 16
#: Rooms of one cell, in which cut documents and what they fill meet.
CELL = 16
#: Bins of leftovers are worth a pattern of their own from this share of the room on.
FULL = 0.95

PIECE = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Pattern:
    """``uses`` sequences padded to ``size``; each takes ``items``: how many documents of which classes."""

    size: int
    items: dict[int, int]
    uses: int = 1


def classes(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The greatest length of each class, for ascending ``lengths``: narrow classes where lengths are frequent."""
    if len(lengths) <= most:
        return lengths
    # Rounding up costs about counts x width: least in all if widths go by the counts' inverse square root.
    share = np.cumsum(np.sqrt(counts))
    group = np.minimum((share / share[-1] * most).astype(int), most - 1)
    return lengths[np.flatnonzero(np.append(group[1:] != group[:-1], True))]


class Knapsack:
    """Unbounded knapsacks over ``widths``, for all sizes up to ``room`` at once."""

    def __init__(self, widths: list[int], room: int):
        self.widths, self.room = widths, room

    def solve(self, values: np.ndarray) -> np.ndarray:
        """The best value for each size; keeps one row an item, to tell the items of a best filling from."""
        best = np.zeros(self.room + 1)
        self.rows, self.values = [best], values
        for w, v in zip(self.widths, values.tolist(), strict=True):
            if v > 0:
                # best[c] - (c // w) v, as a running maximum over c, c + w, c + 2 w ...
                n = -(-(self.room + 1) // w)
                steps = np.arange(n)[:, None] * v
                grid = np.full(n * w, -np.inf)
                grid[: self.room + 1] = best
                best = (np.maximum.accumulate(grid.reshape(n, w) - steps, axis=0) + steps).ravel()[: self.room + 1]
            self.rows.append(best)
        return best

    def items(self, size: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for k in range(len(self.widths) - 1, -1, -1):
            while self.rows[k + 1][size] > self.rows[k][size] + 1e-12:
                out[k] = out.get(k, 0) + 1
                size -= self.widths[k]
        return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product with a vector, on one thread: the matrices are small, and the driver has other work."""
    return np.einsum("i,ij->j", a, b) if a.ndim == 1 else np.einsum("ij,j->i", a, b)


def _column(m: int, items: dict[int, int]) -> np.ndarray:
    out = np.zeros(m)
    out[list(items)] = list(items.values())
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan, on one thread too."""
    m = len(a)
    both = np.column_stack((a, np.eye(m)))
    for k in range(m):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.outer(factor, both[k])
    return both[:, m:].copy()


def column_generation(widths: list[int], demand: np.ndarray, sizes: list[int]) -> list[tuple[float, int, dict[int, int]]]:
    """Patterns (how often, size, items) of a linear program's least padded length that covers ``demand``.

    A pattern's cost is its size, and ``EXTRA`` for being a sequence. The program starts with one pattern a class. In each
    round, the dual prices go through a knapsack: the best filling of each size, and the best with each class in it, join
    the columns, and the simplex method goes on until none of these would lower the cost. Generation ends when the bound
    that prices give (Farley's, or the cost of sequences without any waste) proves that at most ``GAP`` could be saved, or
    after ``ROUNDS``, when what is found may be further from the least cost.
    """
    m, room = len(widths), max(sizes)
    basis = [(s, {k: s // w}) for k, w in enumerate(widths) for s in [min((s for s in sizes if s >= w), key=lambda s, w=w: (s + EXTRA) / (s // w))]]
    cost = np.array([s + float(EXTRA) for s, _ in basis])
    inverse = np.diag([1.0 / items[k] for k, (_, items) in enumerate(basis)])
    x, sack, size_of, pivots = _times(inverse, demand), Knapsack(widths, room), np.array(sizes), 0
    least = (np.array(widths) @ demand) * (room + EXTRA) / room
    pool: dict[tuple, tuple[int, dict[int, int]]] = {}
    for _ in range(ROUNDS):
        matrix = np.column_stack([_column(m, items) for _, items in pool.values()]) if pool else np.zeros((m, 0))
        prices_of, entries = np.array([s + float(EXTRA) for s, _ in pool.values()]), list(pool.values())
        while True:
            prices = _times(cost, inverse)
            saved = prices_of - _times(prices, matrix)
            if prices.min() < -1e-9:
                # Covering more than the demand of a class costs nothing.
                entering, price = (0, {int(np.argmin(prices)): -1}), 0.0
            elif len(saved) and saved.min() < -1e-7 * room:
                entering, price = entries[k := int(np.argmin(saved))], float(prices_of[k])
            else:
                break
            step = _times(inverse, _column(m, entering[1]))
            ratio = np.full(m, np.inf)
            ratio[step > 1e-9] = np.maximum(x[step > 1e-9], 0) / step[step > 1e-9]
            row = int(np.argmin(ratio))
            if not np.isfinite(ratio[row]):
                break
            basis[row], cost[row], pivots = entering, price, pivots + 1
            pivot = inverse[row] / step[row]
            inverse -= np.outer(step, pivot)
            inverse[row] = pivot
            if pivots % 500 == 0:
                inverse = _inverse(np.column_stack([_column(m, items) for _, items in basis]))
            x = _times(inverse, demand)
        best = sack.solve(np.maximum(prices, 0))
        total = float(cost @ np.maximum(x, 0))
        if total <= (1 + GAP) * max(least, total / max(1.0, float((best[size_of] / (size_of + float(EXTRA))).max()))):
            break
        fillings = [(s, sack.items(s)) for s in sizes if best[s] > s + EXTRA]
        for k, w in enumerate(widths):
            if prices[k] + best[room - w] > room + EXTRA:
                items = sack.items(room - w)
                fillings.append((room, items | {k: items.get(k, 0) + 1}))
        if len(pool) > POOL:
            pool.clear()
        pool |= {(s, *sorted(items.items())): (s, items) for s, items in fillings}
    return [(float(v), s, items) for v, (s, items) in zip(x, basis, strict=True) if s and v > 1e-9]


def patterns(lengths: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, list[Pattern]]:
    """Class limits, and whole numbers of patterns for a histogram of lengths.

    The program's numbers are scaled so that all patterns together are no longer than the documents are, and rounded
    down; what is left of each class is packed by best fit, and its nearly full bins are patterns used once. So there is
    always enough left over to fill what patterns leave empty.
    """
    tops = classes(lengths, counts)
    demand = np.bincount(np.searchsorted(tops, lengths), weights=counts, minlength=len(tops))
    sizes = sorted({1 << k for k in range(room.bit_length()) if 1 << k <= room} | {room})
    solved = column_generation(tops.tolist(), demand, sizes)
    tokens = int((lengths * counts).sum())
    scale = min(1.0, tokens / max(1.0, sum(v * s for v, s, _ in solved)))
    left, free, out = demand.astype(np.int64), tokens, []
    for v, size, items in sorted(solved, key=lambda p: (-p[0], -p[1])):
        uses = min(int(v * scale + 1e-6), free // size, *(int(left[k]) // n for k, n in items.items()))
        if uses > 0:
            out.append(Pattern(size, items, uses))
            free -= uses * size
            for k, n in items.items():
                left[k] -= uses * n
    # Few, whatever the input: what rounding leaves of a basis (after scaling, a share of all waits to be cut instead).
    some = np.minimum(left, [max(1, room // int(w)) for w in tops])
    rest = np.repeat(np.arange(len(tops)), some)
    bins = pd.DataFrame({"bin": best_fit(tops[rest].tolist(), room), "k": rest, "width": tops[rest]})
    full = [(int(b["width"].sum()), b["k"].value_counts().to_dict()) for _, b in bins.groupby("bin") if b["width"].sum() >= FULL * room]
    for _, items in sorted(full, key=lambda b: -b[0])[: free // room]:
        out.append(Pattern(room, items))
    return tops, out


def _slots(found: list[Pattern]) -> tuple[list[tuple], dict[int, int], int]:
    """For each class and pattern (class, its ranks from, to, documents a sequence, first sequence, first slot, slots,
    size); how many of each class have one; and the number of sequences."""
    rows, taken, sequence = [], {}, 0
    for p in found:
        slot, slots = 0, sum(p.items.values())
        for k, n in sorted(p.items.items()):
            low = taken.get(k, 0)
            taken[k] = low + n * p.uses
            rows.append((k, low, taken[k], n, sequence, slot, slots, p.size))
            slot += n
        sequence += p.uses
    return rows, taken, sequence


def _cut(room: int):
    """In one cell, documents that are cut (``what`` 1) are laid over the rooms that they fill (0), both without gaps."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        pdf = pdf.sort_values("at", kind="stable")
        docs, holes = pdf[pdf["what"] == 1], pdf[pdf["what"] == 0]
        d_at, h_at = docs["at"].to_numpy(), holes["at"].to_numpy()
        low = np.unique(np.concatenate((d_at, h_at)))
        low = low[(low >= cell * CELL * room) & (low < (cell + 1) * CELL * room)]
        d, h = np.searchsorted(d_at, low, "right") - 1, np.searchsorted(h_at, low, "right") - 1
        high = np.minimum(d_at[d] + docs["length"].to_numpy()[d], h_at[h] + holes["length"].to_numpy()[h])
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4").tobytes() for x, n in zip(docs["ids"], docs["length"], strict=True)]
        crc = [zlib.crc32(ids[i][4 * a : 4 * b]) for i, a, b in zip(d.tolist(), (low - d_at[d]).tolist(), (high - d_at[d]).tolist(), strict=True)]
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].astype("Int64").mask(docs["nameless"]).array[d],
                "start": docs["start"].to_numpy()[d] + low - d_at[d],
                "length": high - low,
                "ids_crc32": np.array(crc, np.int64),
                "doc_tokens": docs["doc_tokens"].to_numpy()[d],
                "sequence_id": holes["sequence_id"].to_numpy()[h],
                "offset": holes["start"].to_numpy()[h] + low - h_at[h],
            }
        )

    return cut


def _short(ids: bytes) -> bytes:
    """The ids in 16 bits each, if they fit."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if numbers.max() < 1 << 16 else ids


def _pieces(tokenizer: str, room: int, separator: int):
    """A document's pieces: of a longer one, all but the first hold ``room`` ids, and their ids aren't kept."""

    def pieces(batches):
        import pyarrow as pa

        coder, uid = word_coder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([separator], "<u4").tobytes()
        names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = coder.encode(text.as_py() or "") + end
                n = len(raw) // 4
                at, stop = 0, n % room or room
                while at < n:
                    ids = raw[4 * at : 4 * stop]
                    rows.append((uid, key, at, stop - at, zlib.crc32(ids), n, _short(ids) if stop - at < room else None))
                    held += len(ids)
                    uid, at, stop = uid + 1, stop, stop + room
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pieces


def pack_by_patterns(docs: DataFrame, tokenizer: str, room: int = 4096, separator: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``separator``. Sequences hold at most ``room`` ids without gaps, and all but those of full
    rooms are as long as a power of two, so nothing is padded. Each piece of ``room`` ids of a longer document is a
    sequence. What is shorter counts in a histogram of lengths, cut into at most ``CLASSES`` classes; from it, column
    generation on the driver (no more than ``room`` numbers, whatever the input) finds patterns of few classes that fill
    sequences of ``room`` or of a power of two. The linear program's numbers of patterns are rounded down. Documents of
    each class are ranked in a mixed order, over all tasks, and a document's rank tells its pattern, sequence and slot.
    Those that no pattern has room for are cut, in order, into what the sequences have left, then into sequences of
    their own; the last ids of all make one sequence for each power of two in their number.

    Only documents longer than ``room`` and those few left over are cut. Texts never shuffle; ids do for what is cut.

    Null text counts as empty: one separator. Null and repeated ids are packed like others. No documents, no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_pieces(tokenizer, room, separator), PIECE), "pieces")
    full = pieces.where(F.col("length") == room).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    short = pieces.where(F.col("length") < room)
    # No more rows than ``room``.
    histogram = sorted((r["length"], r["count"]) for r in short.groupBy("length").count().collect())
    if not histogram:
        return full.select(columns)
    lengths, counts = (np.array(c, np.int64) for c in zip(*histogram, strict=True))
    tops, found = patterns(lengths, counts, room)
    rows, taken, sequences = _slots(found)
    of_length = np.searchsorted(tops, np.arange(tops[-1] + 1)).tolist()
    keyed = short.withColumn("cls", F.get(F.array(*map(F.lit, of_length)), F.col("length").cast("int"))).withColumn("salt", F.xxhash64("uid"))
    ranked = scan(keyed.drop("ids"), ["cls", "salt", "uid"], runs=("cls",), name="ranked")

    # Bounded by the classes and patterns of the basis.
    slots = spark.createDataFrame(rows, "cls int, low long, high long, each long, sequence long, slot long, slots long, size long")
    own = ranked.join(F.broadcast(slots), "cls").where("run >= low and run < high")
    own = own.withColumn("sequence_id", F.expr("sequence + (run - low) div each")).withColumn("slot", F.col("slot") + (F.col("run") - F.col("low")) % F.col("each"))
    own = own.select(*columns[:5], "sequence_id", "slot", "slots", "size")
    own = scan(own, ["sequence_id", "slot"], runs=("sequence_id",), sums=("length",), name="slots")
    own = own.withColumn("offset", F.col("length_sum") - F.col("length"))
    holes = own.where("slot = slots - 1 and length_sum < size").select("sequence_id", F.col("length_sum").alias("start"), (F.col("size") - F.col("length_sum")).alias("length"))

    # The first document of each class that is cut, and all behind it: their ids are read, and no others.
    bounds = spark.createDataFrame([(k, taken.get(k, 0)) for k in range(len(tops))], "cls int, run long")
    bounds = ranked.join(F.broadcast(bounds), ["cls", "run"]).select("cls", F.col("salt").alias("first_salt"), F.col("uid").alias("first_uid"))
    behind = (F.col("salt") > F.col("first_salt")) | ((F.col("salt") == F.col("first_salt")) & (F.col("uid") >= F.col("first_uid")))
    cut = keyed.join(F.broadcast(bounds), "cls").where(behind).drop("first_salt", "first_uid")
    cut = scan(cut, ["salt", "uid"], sums=("length",), name="cut")
    holes = written(holes, "holes")
    free = (cut.agg(F.sum("length")).first()[0] or 0) - (holes.agg(F.sum("length")).first()[0] or 0)
    more = spark.range(free // room).select((F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("start"), F.lit(room).cast("long").alias("length"))
    last = [1 << k for k in range(room.bit_length()) if free % room >> k & 1]
    ends = [(sequences + free // room + k, 0, n) for k, n in enumerate(reversed(last))]
    holes = holes.unionByName(more).unionByName(spark.createDataFrame(ends, holes.schema))
    holes = scan(holes, ["sequence_id"], sums=("length",), name="holes")

    at = (F.col("length_sum") - F.col("length")).alias("at")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("binary").alias("ids")
    # Nulls among whole numbers would make them floats in pandas.
    meet = holes.select(F.lit(0).alias("what"), at, "length", "start", "sequence_id", zero.alias("doc_id"), F.lit(False).alias("nameless"), zero.alias("doc_tokens"), none)
    own_id = [F.coalesce("doc_id", zero).alias("doc_id"), F.col("doc_id").isNull().alias("nameless")]
    meet = meet.unionByName(cut.select(F.lit(1).alias("what"), at, "length", "start", zero.alias("sequence_id"), *own_id, "doc_tokens", "ids"))
    meet = meet.withColumn("cell", F.explode(F.expr(f"sequence(at div {CELL * room}, (at + length - 1) div {CELL * room})")))
    done = meet.groupBy("cell").applyInPandas(_cut(room), CUT)
    return full.select(columns).unionByName(own.select(columns)).unionByName(done)
