"""Conversation prefix trie: nodes as intervals of a preorder; leaves and savings as differences of running sums."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import scan
from .runtime import shuffle_parts, written

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of one block: sort keys and node names hold at most so many turns' digests.
BLOCK = 32
#: Base64 characters of a turn's digest: 96 bits of SHA-256, so even 10 ** 12 turns under one node share one with a chance under 10 ** -4.
DIGEST = 16
#: Blocks of a conversation that one row of its rank serves.
SPAN = 64
#: Ids that travel in one row to the task that hashes a node's members.
IDS = 50_000


def turn_marks(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, sym, words, uid``, written: each turn's digest of role and text, and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return written(
        turns.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("conv_id"),
            F.col(turn_col).cast("long").alias("turn"),
            F.substring(F.base64(F.unhex(sha)), 1, DIGEST).alias("sym"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "turns",
    )


def _sequences(marks: DataFrame, heads: DataFrame | None, skipped: Column) -> DataFrame:
    """``conv_id, depth, sym, words`` of each conversation's turns, depth from 1, and one row without ``sym`` that tells its
    length as ``depth``. ``heads`` (``conv_id, k, sym, words``) stand before a conversation's own turns, of which the
    first ``skipped`` go."""
    own = marks.select("conv_id", F.lit(0).alias("kind"), "turn", "sym", "words", "uid", F.lit(0).cast("long").alias("head"))
    ends = marks.select("conv_id").distinct().selectExpr("conv_id", "1 kind", "0L turn", "cast(null as string) sym", "0L words", "0L uid", "0L head")
    rows = own.unionByName(ends)
    if heads is not None:
        rows = rows.unionByName(heads.selectExpr("conv_id", "-1 kind", "k turn", "sym", "words", "0L uid", "1L head"))
    placed = scan(rows, ["conv_id", "kind", "turn", "sym", "uid"], runs=("conv_id",), sums=("head",), name="turns")
    index = F.col("run") - F.col("head_sum")  # of an own turn; at the end, their number
    kept = F.col("head_sum") + F.greatest(index - skipped, F.lit(0))
    depth = F.when(F.col("kind") == -1, F.col("run") + 1).when(F.col("kind") == 1, kept).when(index >= skipped, kept + 1)
    return placed.select("conv_id", depth.alias("depth"), "sym", "words").where("depth is not null")


def sequences(marks: DataFrame) -> DataFrame:
    """The turns of ``turn_marks``, each conversation as it is."""
    return _sequences(marks, None, F.lit(0).cast("long"))


def shared_heads(marks: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """As ``sequences``, where conversation c begins with the first h turns of conversation c - c % every (remainders
    take the sign of c) in place of its own first h, h being crc32 of c's decimal digits modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    first = Window.partitionBy("conv_id").orderBy("turn", "sym", "uid")
    top = marks.where(F.col("conv_id") % every == 0).withColumn("k", F.row_number().over(first)).where(F.col("k") < most)
    heads = top.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "sym", "words"))).alias("heads"))
    ids = marks.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    taken = ids.join(heads, "base").select("conv_id", F.inline(F.slice("heads", F.lit(1), h.cast("int"))))
    return _sequences(marks, taken.withColumn("k", F.col("k").cast("long")), h)


def _ranked(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, length, place, run``: conversations in lexicographic order of their turns, ties by id.

    Blocks behind the first are ranked among themselves, so that a block is a short code, and codes of ``BLOCK`` blocks
    are a block of the next round, until one is left a conversation.
    """
    tails = blocks.where("block > 0").select("conv_id", (F.col("block") - 1).alias("q"), F.array_join("syms", "").alias("path"))
    joined = lambda by: by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "path"))), lambda x: x["path"]), "").alias("path"))
    most = tails.agg(F.max("q")).first()[0]
    keys = lengths.join(blocks.where("block = 0").select("conv_id", F.array_join("syms", "").alias("key")), "conv_id", "left")
    keys = keys.select("conv_id", "length", F.coalesce("key", F.lit("")).alias("key"))
    if most is not None:
        while True:
            coded = scan(tails, ["path", "conv_id", "q"], runs=("path",), name="blocks")
            tails = coded.select("conv_id", "q", F.lpad(F.hex(F.col("place") - F.col("run")), 12, "0").alias("path"))
            tails = joined(tails.groupBy("conv_id", F.expr(f"q div {BLOCK} as up")) if most >= BLOCK else tails.groupBy("conv_id"))
            if most < BLOCK:
                break
            tails, most = tails.select("conv_id", F.col("up").alias("q"), "path"), most // BLOCK
        keys = keys.join(tails, "conv_id", "left").select("conv_id", "length", F.concat("key", F.coalesce("path", F.lit(""))).alias("key"))
    return scan(keys, ["key", "conv_id"], runs=("key",), name="ranks").drop("key")


def _named(blocks: DataFrame) -> DataFrame:
    """The blocks with ``before``, a name of all turns of the conversation before each: sums of hashes of its blocks."""
    alone = blocks.where((F.col("block") == 0) & (F.size("syms") < BLOCK)).withColumn("before", F.lit(""))
    sha = F.sha2(F.concat_ws(",", F.col("block").cast("string"), F.array_join("syms", "")), 256)
    hashes = [F.conv(F.substring(sha, k * 9 + 1, 9), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    long = blocks.where((F.col("block") > 0) | (F.size("syms") >= BLOCK)).select("*", *hashes)
    sums = [f"h{k}" for k in range(4)]
    long = scan(long, ["conv_id", "block"], runs=("conv_id",), sums=tuple(sums), name="blocks")
    before = F.concat_ws(",", *[F.hex(F.col(f"{c}_sum") - F.col(c)) for c in sums])
    return alone.unionByName(long.select(*blocks.columns, F.when(F.col("block") == 0, "").otherwise(before).alias("before")))


def _digests(ranks: DataFrame) -> DataFrame:
    """``first, depth, sha``: of the conversations that are one sequence, the SHA-256 of their ids, ascending, with commas."""

    def joined(batches):
        import pyarrow as pa

        for batch in batches:
            first, depth, place, ids = (batch.column(k).to_pylist() for k in range(4))
            edges = [i for i in range(len(ids)) if not i or first[i] != first[i - 1] or i % IDS == 0]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(edges, [*edges[1:], len(ids)], strict=True)]
            cols = [[c[i] for i in edges] for c in (first, depth, place)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(texts, pa.string())], names=["first", "depth", "place", "ids"])

    def hashed(batches):
        import pyarrow as pa

        open_key, sha = None, None
        for batch in batches:
            out = []
            for first, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first == open_key[0] if open_key else False:
                    sha.update(b",")
                else:
                    if open_key:
                        out.append((*open_key, sha.hexdigest()))
                    open_key, sha = (first, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["first", "depth", "sha"])
        if open_key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*open_key, sha.hexdigest())], names=["first", "depth", "sha"])

    parts = shuffle_parts(ranks.sparkSession)
    rows = ranks.select((F.col("place") - F.col("run")).alias("first"), F.col("length").alias("depth"), "place", "conv_id")
    pieces = rows.repartitionByRange(parts, "place").sortWithinPartitions("place").mapInArrow(joined, "first long, depth long, place long, ids string")
    return pieces.repartition(parts, "first").sortWithinPartitions("first", "place").mapInArrow(hashed, "first long, depth long, sha string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` or ``shared_heads``: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, n_ends, preorder, subtree_end``.

    A node is a distinct sequence of first turns; its members are the conversations that begin with it, ``conv_id`` the
    smallest, ``n_ends`` those that are it whole, ``ends_sha256`` the SHA-256 of these ids, ascending and joined by
    commas. A node's subtree is the nodes ``preorder`` to ``subtree_end``, both in it; it has ``n_leaves`` nodes without
    children, and would save ``saved_tokens`` words if the turns that members share were kept once.

    Conversations are put into lexicographic order once; a node's members are then an interval of ranks, and a node is
    told by its first member's rank and its depth. Each node opens at its first rank and closes behind its last; running
    sums over these ends, sorted by range, give preorder places, and a subtree's leaves and savings are the difference of
    the sums at its two ends. A node's parent is the last node of the depth before that opened no later. Turns travel as
    digests, never as texts. A conversation of any length and a node with any number of members or children spread over
    as many tasks as they need; but the SHA-256 of one node's members is worked out by one task, as a stream.
    """
    turns = turns.withColumn("block", F.expr(f"(greatest(depth, 1L) - 1) div {BLOCK}"))
    lengths = turns.where("sym is null").select("conv_id", F.col("depth").alias("length"))
    of_block = F.array_sort(F.collect_list(F.struct("depth", "sym", "words")))
    blocks = turns.where("sym is not null").groupBy("conv_id", "block").agg(of_block.alias("rows"))
    blocks = written(blocks.select("conv_id", "block", F.col("rows.sym").alias("syms"), F.col("rows.words").alias("words")), "blocks")
    ranks = _ranked(blocks, lengths)
    spans = ranks.select("conv_id", "length", "place", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {BLOCK * SPAN})")).alias("span"))
    rows = _named(blocks).withColumn("span", F.expr(f"block div {SPAN}")).join(spans, ["conv_id", "span"])
    path = lambda i: F.array_join(F.slice(F.col("syms"), F.lit(1), i + 1), "")
    rows = rows.select("conv_id", "length", "place", "before", "syms", "words", (F.col("block") * BLOCK).alias("above"))
    rows = rows.select("conv_id", "length", "place", "before", "above", F.inline(F.transform("words", lambda w, i: F.struct(w.alias("n_words"), (i + 1).alias("i"), path(i).alias("path")))))
    rows = rows.withColumn("depth", F.col("above") + F.col("i"))
    counted = [
        F.min("place").alias("first"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.count_if(F.col("depth") == F.col("length")).alias("n_ends"),
    ]
    nodes = rows.groupBy("depth", "before", "path").agg(*counted, F.max("n_words").alias("n_words"))
    root = ranks.agg(F.lit(0).cast("long").alias("depth"), F.min("place").alias("first"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if(F.col("length") == 0).alias("n_ends"))
    nodes = nodes.drop("before", "path").unionByName(root.where("n_convs > 0").withColumn("n_words", F.lit(0).cast("long")))
    nodes = written(nodes, "nodes")

    own = ["first", "depth", "conv_id", "n_convs", "n_ends"]
    leaf, gain = F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0), (F.col("n_convs") - 1) * F.col("n_words")
    opens = nodes.select(*own, F.col("first").alias("rank"), F.lit(0).alias("closes"), F.col("depth").alias("tie"), F.lit(1).cast("long").alias("node"), leaf.cast("long").alias("leaf"), gain.alias("gain"))
    zero = F.lit(0).cast("long")
    shut = nodes.select(*own, (F.col("first") + F.col("n_convs") - 1).alias("rank"), F.lit(1).alias("closes"), (-F.col("depth")).alias("tie"), zero.alias("node"), zero.alias("leaf"), zero.alias("gain"))
    events = scan(opens.unionByName(shut), ["rank", "closes", "tie"], sums=("node", "leaf", "gain"), name="events")

    as_parent = nodes.selectExpr("depth level", "first at", "0 child", "first up", "conv_id up_conv", "first", "depth")
    as_child = nodes.where("depth > 0").selectExpr("depth - 1 level", "first at", "1 child", "cast(null as long) up", "cast(null as long) up_conv", "first", "depth")
    lines = scan(as_parent.unionByName(as_child), ["level", "at", "child"], fill=("up", "up_conv"), name="parents").where("child = 1")

    # Everything known of a node, by its first rank and depth.
    empty = {c: F.lit(None).cast("long").alias(c) for c in ("conv_id", "n_convs", "n_ends", "parent", "child", *[f"{e}_{c}" for e in ("open", "shut") for c in ("node", "leaf", "gain")])}
    empty["sha"] = F.lit(None).cast("string").alias("sha")

    def facts(df, **known):
        return df.select(known.pop("first").alias("first"), known.pop("depth").alias("depth"), *[known[c].alias(c) if c in known else empty[c] for c in empty])

    ids = {"first": F.col("first"), "depth": F.col("depth")}
    opened = {f"open_{c}": F.when(F.col("closes") == 0, F.col(f"{c}_sum") - F.col(c)) for c in ("node", "leaf", "gain")}
    closed = {f"shut_{c}": F.when(F.col("closes") == 1, F.col(f"{c}_sum")) for c in ("node", "leaf", "gain")}
    known = facts(events, **ids, **{c: F.col(c) for c in own[2:]}, **opened, **closed)
    known = known.unionByName(facts(lines, **ids, parent=F.col("up_conv_last")))
    known = known.unionByName(facts(lines, first=F.col("up_last"), depth=F.col("level"), child=F.lit(1).cast("long")))
    known = known.unionByName(facts(_digests(ranks), **ids, sha=F.col("sha")))
    each = known.groupBy("first", "depth").agg(*[(F.sum if c == "child" else F.max)(c).alias(c) for c in empty])
    return each.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("child", F.lit(0)).cast("long").alias("n_children"),
        (F.col("shut_leaf") - F.col("open_leaf")).alias("n_leaves"),
        (F.col("shut_gain") - F.col("open_gain")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "n_ends",
        F.col("open_node").alias("preorder"),
        (F.col("shut_node") - 1).alias("subtree_end"),
    )


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The ``trie`` of a table of turns.

    Turns go by number, nulls first, ties by a digest of role and text; null roles and texts are empty; repeated rows are
    turns of their own. Rows without a conversation id are no conversation's and are left out. No conversations, no rows:
    not even the root. Other columns are not read.
    """
    return trie(sequences(turn_marks(turns, id_col, turn_col, role_col, text_col)))
