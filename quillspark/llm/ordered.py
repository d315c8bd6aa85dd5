"""Row numbers and running sums over all rows of a table: sorted by range, summed in each part, and shifted by the parts before."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .runtime import shuffle_parts, written


def _changes(batch, columns: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row differs from the one before it in some of ``columns``; ``last``: the row before the batch."""
    import pyarrow.compute as pc

    n = batch.num_rows
    out = np.zeros(n, bool)
    out[0] = last is None or last != tuple(batch.column(c)[0].as_py() for c in columns)
    for c in columns:
        values = batch.column(c)
        a, b = values.slice(1), values.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _numbered(keys: list[str], runs: list[str], sums: list[str], fill: list[str], schema: StructType):
    """What a task does with its sorted rows: places, runs and sums as they are within the part."""

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        part, at, begin, last = TaskContext.get().partitionId(), 0, 0, None
        total, base, known = dict.fromkeys(sums, 0), dict.fromkeys(sums, 0), dict.fromkeys(fill)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = np.arange(at, at + n)
            new = _changes(batch, runs, last) if runs else place == 0
            # Where in the batch each row's run begins, or -1 if before it.
            inside = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            cols = [np.full(n, part, np.int32), place, place - np.where(inside >= 0, at + inside, begin)]
            for c in sums:
                v = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                so_far = total[c] + np.cumsum(v)
                before = np.where(inside >= 0, (so_far - v)[np.maximum(inside, 0)], base[c])
                cols.append(so_far - before)
                total[c], base[c] = int(so_far[-1]), int(before[-1])
            filled = []
            for c in fill:
                there = ~batch.column(c).is_null().to_numpy(zero_copy_only=False)
                at_last = np.maximum.accumulate(np.where(there, np.arange(n), -1))
                v = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False)
                none = (at_last < 0) & (known[c] is None)
                v = np.where(at_last >= 0, v[np.maximum(at_last, 0)], known[c] or 0)
                filled.append(pa.array(v, pa.int64(), mask=none))
                known[c] = None if none[-1] else int(v[-1])
            begin, at = int(place[-1] - cols[2][-1]), at + n
            last = tuple(batch.column(c)[n - 1].as_py() for c in runs)
            arrays = [*batch.columns, *map(pa.array, cols), *filled]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return number


def scan(df: DataFrame, keys: list[str], runs: tuple[str, ...] = (), sums: tuple[str, ...] = (), fill: tuple[str, ...] = (), name: str = "scan") -> DataFrame:
    """The rows of ``df`` in the order of ``keys``, with numbers that tell where each stands in it.

    Added are ``place``, the row's number among all (from 0); ``run``, its number among the rows that share the columns
    ``runs``, which are the first of ``keys`` (all rows, without any); for each of ``sums``, ``<c>_sum``, the sum from its
    run's first row up to it; for each of ``fill``, ``<c>_last``, the last value up to it, of all rows, that isn't null.

    ``keys`` must tell all rows apart, so that no run of them, however long, has to lie in one task, and so that a task
    that is run again finds the same order. Sums are of 64-bit whole numbers, null counting as 0. Null keys come first.
    The driver sees one row a part, of bounded size if the columns ``runs`` are.
    """
    spark = df.sparkSession
    own = ["_part", "_at", "run", *[f"{c}_sum" for c in sums]]
    schema = StructType(list(df.schema.fields))
    for c in own:
        schema = schema.add(c, IntegerType() if c == "_part" else LongType())
    for c in fill:
        schema = schema.add(f"{c}_last", LongType())
    ranged = df.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    rows = written(ranged.mapInArrow(_numbered(keys, list(runs), list(sums), list(fill), schema), schema), name)
    key = F.struct(*runs) if runs else F.lit(0)
    tails = [F.max_by(c, "_at").alias(f"_{k}") for k, c in enumerate(["run", *[f"{c}_sum" for c in sums], *[f"{c}_last" for c in fill]])]
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"), *tails).collect()
    before, goes_on, known, shifts, last = 0, [0] * (1 + len(sums)), [None] * len(fill), [], None
    for p in sorted(parts, key=lambda p: p["_part"]):
        carry = goes_on if last is not None and p["first"] == last["last"] else [0] * (1 + len(sums))
        shifts.append((p["_part"], before, *carry, *known))
        one_run = p["first"] == p["last"]
        goes_on = [p[f"_{k}"] + (x if one_run else 0) + (k == 0) for k, x in enumerate(carry)]
        known = [x if (v := p[f"_{len(goes_on) + k}"]) is None else v for k, x in enumerate(known)]
        before, last = before + p["rows"], p
    names = ["_part", "_before", *[f"_carry{k}" for k in range(1 + len(sums))], *[f"_known{k}" for k in range(len(fill))]]
    kinds = ["int"] + ["long"] * (len(names) - 1)
    moves = spark.createDataFrame(shifts, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    number = count()
    first_run = F.col("_at") == F.col("run")  # of its part
    shifted = [(F.col(c) + F.when(first_run, F.col(f"_carry{next(number)}")).otherwise(0)).alias(c) for c in own[2:]]
    filled = [F.coalesce(f"{c}_last", f"_known{k}").alias(f"{c}_last") for k, c in enumerate(fill)]
    return rows.join(F.broadcast(moves), "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias("place"), *shifted, *filled)
