"""Exact top-k search with an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import shuffle_parts, written

#: Vectors of one index shard, and bytes of queries that travel with one pass over the index.
SHARD, QUERY_BYTES = 4096, 16_000_000
#: A query's scoring stops when it is proved that at most this many vectors of the shard can be among its best.
FEW = 64
#: Queries times vectors of a shard that are scored at once, so a task's memory doesn't hang on how many queries a block has.
CELLS = 1 << 18
#: Components of this size and more are not cut into segments: their vectors have shards of their own, scored exactly.
LARGE = float(1 << 40)
LONG = np.iinfo(np.int64)

INDEX = "dim int, ids binary, kind string, vectors binary, segments array<struct<p:int,starts:binary,postings:binary,rest:binary>>"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as a double that holds it exactly, or null if the vector or a component is null
    or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: whole(v * float(scale))))


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, however large; beyond 64 bits they count as the nearest 64-bit number."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    if (np.abs(vectors).astype(np.float64) @ np.abs(query).astype(np.float64)).max() < 2.0**52:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    whole = [int(x) for x in query]
    sums = (sum(int(a) * b for a, b in zip(v, whole)) for v in vectors)
    return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)


def shard_row(dim: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
    """One shard as it is stored: whole vectors, and posting segments by falling impact.

    Segment p holds, for each dimension, the list of vectors whose component has bit p, with its sign: each adds 2 ** p
    times the query's component. ``rest`` is the length of what each vector has below p, which bounds what is to come.
    """
    sizes, segments = np.abs(vectors), []
    if sizes.max(initial=0) < LARGE:
        kind = next(k for k in ("<i2", "<i4", "<i8") if sizes.max(initial=0) < np.iinfo(k).max)
        sizes = sizes.astype(np.int64)
        for p in range(int(sizes.max(initial=0)).bit_length() - 1, -1, -1):
            at, vec = np.nonzero(((sizes >> p) & 1).T)
            starts = np.searchsorted(at, np.arange(dim + 1)).astype("<i4")
            postings = (vec.astype("<i4") << 1) | (vectors[vec, at] < 0)
            rest = np.sqrt(np.square((sizes & ((1 << p) - 1)).astype(np.float64)).sum(axis=1))
            segments.append({"p": p, "starts": starts.tobytes(), "postings": postings.astype("<i4").tobytes(), "rest": rest.astype("<f8").tobytes()})
    else:
        kind = "<f8"
    return {"dim": dim, "ids": ids.astype("<i8").tobytes(), "kind": kind, "vectors": vectors.astype(kind).tobytes(), "segments": segments}


@dataclass
class Best:
    """The best (score, id) so far of a block of queries of one length."""

    own: np.ndarray
    queries: np.ndarray
    k: int

    def __post_init__(self):
        self.score = np.full((len(self.own), self.k), LONG.min)
        self.id = np.full((len(self.own), self.k), -1)
        self.n = np.zeros(len(self.own), np.int64)
        self.length = np.sqrt(np.square(self.queries).sum(axis=1)) * (1 + 1e-9)
        #: Single precision adds up components and their negatives exactly while the sums stay below 2 ** 24.
        self.factors = self.queries.astype(np.float32 if np.abs(self.queries).sum(axis=1).max(initial=0) < 2.0**24 else np.float64)

    def floor(self, i: np.ndarray) -> np.ndarray:
        """What a vector must reach: the k-th best score, if there are k."""
        return np.where(self.n[i] >= self.k, self.score[i, -1].astype(np.float64), -np.inf)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        n = self.n[i]
        ids, scores = np.concatenate((self.id[i, :n], ids)), np.concatenate((self.score[i, :n], scores))
        order = np.lexsort((ids, -scores.astype(object) if (scores == LONG.min).any() else -scores))[: self.k]
        self.n[i] = len(order)
        self.id[i, : len(order)], self.score[i, : len(order)] = ids[order], scores[order]


def plane(segment, dim: int, n: int) -> np.ndarray:
    """The lists of all dimensions of a segment, spread out so that queries add them up at once."""
    starts, postings = np.frombuffer(segment["starts"], "<i4"), np.frombuffer(segment["postings"], "<i4")
    out = np.zeros((dim, n), np.int8)
    out[np.repeat(np.arange(dim), np.diff(starts)), postings >> 1] = 1 - 2 * (postings & 1)
    return out


def search_shard(row, best: Best) -> None:
    """Scores a shard for all queries, ``CELLS`` scores at a time. A shard that can't reach a query's k-th best score is passed
    over at once."""
    ids = np.frombuffer(row.ids, "<i8")
    vectors = np.frombuffer(row.vectors, row.kind).reshape(len(ids), row.dim)
    live, norms, planes = np.arange(len(best.own)), None, []
    if len(row.segments) and len(ids) > FEW:
        norms = np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1))
        live = live[best.length * norms.max() >= best.floor(live)]
    # So few that the vectors which are left for all of them, FEW each, are no more than 16 * CELLS components either.
    step = max(CELLS // max(len(ids), FEW * row.dim // 16), 1)
    for at in range(0, len(live), step):
        search_some(row, ids, vectors, norms, planes, live[at : at + step], best)


def add_few(ids: np.ndarray, vectors: np.ndarray, live: np.ndarray, may: np.ndarray, ended: np.ndarray, largest: float, best: Best) -> None:
    """Scores what ``may`` be among the best of the queries ``live[ended]`` exactly: all at once, if no sum of products is
    beyond what doubles hold (``largest`` bounds them)."""
    if largest >= 2.0**52:
        for i in ended:
            at = np.flatnonzero(may[i])
            best.add(live[i], ids[at], exact(vectors[at], best.queries[live[i]]))
        return
    i, at = np.divmod(np.flatnonzero(may[ended]), len(ids))
    own = live[ended]
    reached = np.einsum("nd,nd->n", vectors[at].astype(np.float64), best.queries[own[i]])
    good = reached >= best.floor(own)[i]
    i, at, reached = i[good], at[good], reached[good].astype(np.int64)
    ends = np.searchsorted(i, np.arange(len(own) + 1))
    for q in np.flatnonzero(np.diff(ends)):
        part = slice(ends[q], ends[q + 1])
        best.add(own[q], ids[at[part]], reached[part])


def search_some(row, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray | None, planes: list, live: np.ndarray, best: Best) -> None:
    """Scores a shard for the queries ``live``, a segment at a time, until bounds prove that few vectors can still be among a
    query's best; those are scored exactly. ``planes`` keeps the segments that were spread out for the queries before."""
    other = ids[None, :] != best.own[live][:, None]
    scores = np.zeros(other.shape)
    largest = 0.0 if norms is None else best.length[live].max() * norms.max()
    for n, segment in enumerate(row.segments if norms is not None else ()):
        if not len(live):
            break
        if n == len(planes):
            planes.append(plane(segment, row.dim, len(ids)))
        scores += float(1 << segment["p"]) * (best.factors[live] @ planes[n].astype(best.factors.dtype))
        rest = np.frombuffer(segment["rest"], "<f8")
        # Besides what is to come, what rounding may have cost.
        slack = best.length[live, None] * (rest + 1e-9 * norms)[None, :]
        floor, k = best.floor(live), min(best.k, len(ids) - 1)
        most = scores + slack
        if k == best.k and (floor == -np.inf).any():
            # k vectors surely reach this; who can't, isn't among the best. Equal scores stay, for ties.
            sure = np.where(other, np.clip(scores - slack, LONG.min, LONG.max), -np.inf)
            floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k])
        may = other & ((most if largest < 2.0**62 else np.clip(most, LONG.min, LONG.max)) >= floor[:, None])
        left = np.count_nonzero(may, axis=1)
        ended = left <= FEW
        alone = np.zeros(0, np.int64)
        if segment["p"] == 0:
            alone, ended = np.flatnonzero(~ended), np.ones(len(live), bool)
        add_few(ids, vectors, live, may, np.flatnonzero(left <= FEW), largest, best)
        for i in alone:
            at = np.flatnonzero(may[i])
            best.add(live[i], ids[at], exact(vectors[at], best.queries[live[i]]))
        live, scores, other = live[~ended], scores[~ended], other[~ended]
    for i, o in zip(live, other, strict=True):
        best.add(i, ids[o], exact(vectors[o], best.queries[i]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k vectors of the highest integer inner product, all exact: ``query_id, rank, vec_id, score``.

    Components count as floor(scale * x), however large. Ties go to smaller ids; scores beyond 64 bits count as the nearest
    64-bit number. A query never finds its own id. Vectors that are null, or have null or non-finite components, take no
    part, nor do null ids; only vectors of one length meet. Each row is a candidate, so repeated rows may all be among a
    query's best; a query id that comes several times is asked once, by its largest vector. Fewer than k candidates: all of
    them. No vectors or no queries: no rows. Other columns are not read.

    The index is written once, as shards of ``SHARD`` vectors made where an even deal of the rows puts them, so repeated
    ids make no shard larger. Queries come in blocks of ``QUERY_BYTES``, each of which travels to the shards in one pass over
    the index: no vector is copied or shuffled for a block. A task scores a shard for some of the block's queries at a time, so
    its memory is that of a few shards and of a block, however many queries there are, and keeps its k best of each query from
    shard to shard, so later shards stop earlier. As every query meets every shard, work grows with queries times vectors.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
        return df.where("id is not null and v is not null").withColumn("dim", F.size("v"))

    def build(batches):
        held: dict[tuple, list] = {}
        for pdf in batches:
            for (dim, large), own in pdf.groupby(["dim", "large"]):
                rows = held.setdefault((dim, large), [])
                rows.append((own["id"].to_numpy(), np.array(own["v"].tolist(), np.float64).reshape(len(own), dim)))
                if sum(len(i) for i, _ in rows) >= SHARD:
                    yield pd.DataFrame([shard_row(int(dim), *map(np.concatenate, zip(*rows, strict=True)))])
                    held[dim, large] = []
        for (dim, _), rows in held.items():
            if rows:
                yield pd.DataFrame([shard_row(int(dim), *map(np.concatenate, zip(*rows, strict=True)))])

    base = clean(vectors).withColumn("large", F.exists("v", lambda x: F.abs(x) >= LARGE))
    n = base.count()
    dealt = base.repartition(max(min(shuffle_parts(spark), n // 256 + 1), n // SHARD + 1))
    index = written(dealt.mapInPandas(build, INDEX), "topk-index")

    asked = clean(queries).groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))
    asked = written(asked, "topk-queries")
    n_bytes = asked.agg(F.sum(8 * F.col("dim") + 100)).first()[0] or 0
    blocks = n_bytes // QUERY_BYTES + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("id", "v").toPandas()  # bounded by QUERY_BYTES, about
        by_dim = {d: own for d, own in rows.groupby(rows["v"].map(len))} if len(rows) else {}
        own = {int(d): (x["id"].to_numpy(np.int64), np.array(x["v"].tolist(), np.float64).reshape(len(x), d)) for d, x in by_dim.items()}
        sent = spark.sparkContext.broadcast(own)

        def search(batches, sent=sent):
            best: dict[int, Best] = {}
            for pdf in batches:
                for row in pdf.itertuples():
                    if row.dim in sent.value:
                        if row.dim not in best:
                            best[row.dim] = Best(*sent.value[row.dim], k)
                        search_shard(row, best[row.dim])
            for b in best.values():
                at, rank = np.nonzero(np.arange(k)[None, :] < b.n[:, None])
                yield pd.DataFrame({"query_id": b.own[at], "vec_id": b.id[at, rank], "score": b.score[at, rank]})

        found = index.mapInPandas(search, "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(found if blocks == 1 else written(found, "topk"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
