"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shuffle_parts, text_batches
from .tokens import Bpe, bpe

#: A cut where the rolling hash of 8 bytes has these bits zero: chunks of 512 bytes on average, and no shorter than LEAST.
CUT_BITS, LEAST = 9, 64
#: Bytes of text that one task encodes.
BLOCK_BYTES = 8_000_000
#: Settled places that a join's window holds on either side to begin with; it doubles until encodings agree.
AROUND = 2

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
#: Places that part two pre-tokens whatever stands further away: what is no white space and white space; letters or
#: numbers and other signs; signs but the apostrophe (of 's, 't, ...) and letters or numbers.
#: The commonest of them is looked for first.
_PLAIN = re.compile(rb"(?<=[!-~])(?=[ \n])")
_SETTLED = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{White_Space}\p{L}])|(?<=\p{N})(?=[^\p{White_Space}\p{N}])|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


def chunks(data: bytes) -> list[bytes]:
    """Cuts where the rolling hash of the 8 bytes before says so, moved to the next whole character."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < 2 * LEAST:
        return [data] if data else []
    gear, n = _GEAR[raw], len(raw) - 7
    rolled = gear[7:].copy()
    for back in range(1, 8):
        rolled += gear[7 - back : 7 - back + n] << np.uint32(back)
    hit = (rolled >> np.uint32(32 - CUT_BITS)) == 0
    hit[1:] &= ~hit[:-1]  # a run of one sign isn't cut at each place
    out, done = [], 0
    for at in (np.flatnonzero(hit) + 8).tolist():
        if at - done >= LEAST:
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            out.append(data[done:at])
            done = at
    return out + [data[done:]] * (done < len(data))


def units(data: bytes) -> list[bytes]:
    """Chunks, of which those without a settled place inside are put together with the next, and a last one with the one before it."""
    out: list[list[bytes]] = []
    full = True
    for c in chunks(data):
        if full:
            out.append([])
        out[-1].append(c)
        full = _PLAIN.search(c) is not None or _SETTLED.search(c.decode("utf-8", "surrogatepass")) is not None or (len(out[-1]) > 1 and _seam(out[-1][-2], c))
    if not full and len(out) > 1:
        last = out.pop()
        out[-1] += last
    return [b"".join(x) for x in out]


def _seam(a: bytes, b: bytes) -> bool:
    """Whether a place between two chunks is settled."""
    ends = a[-8:].decode("utf-8", "ignore")[-1:] + b[:8].decode("utf-8", "ignore")[:1]
    return _SETTLED.search(ends) is not None


@dataclass
class Encoded:
    """A unit encoded by itself: its bytes, ids, and where each id's text ends."""

    data: bytes
    ids: np.ndarray
    ends: np.ndarray

    def before(self, at: int) -> int:
        """How many ids stand before a place, or -1 if the place is inside one."""
        k = int(np.searchsorted(self.ends, at, "left")) + 1 if at else 0
        return k if not at or (k <= len(self.ends) and self.ends[k - 1] == at) else -1


def _places(data: bytes, from_end: bool, n: int) -> list[int]:
    """The ``n`` settled places nearest to one end of a unit, nearest first; others may be passed over while plain ones do."""
    reach = 24 * n
    at = max(0, len(data) - reach) if from_end else 0
    found = [m.start() for m in _PLAIN.finditer(data, at, len(data) if from_end else reach)]
    if len(found) >= n:
        return found[-n:][::-1] if from_end else found[:n]
    while True:
        at = max(0, len(data) - reach) if from_end else min(len(data), reach)
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at += -1 if from_end else 1
        text = (data[at:] if from_end else data[:at]).decode("utf-8", "surrogatepass")
        found = [m.start() for m in _SETTLED.finditer(text)]
        if len(found) >= n or reach >= len(data):
            break
        reach *= 4
    found = found[-n:][::-1] if from_end else found[:n]
    if not text.isascii():
        found = [len(text[:p].encode("utf-8", "surrogatepass")) for p in found]
    return [p + at if from_end else p for p in found]


def joined(left: Encoded, right: Encoded, coder: Bpe, around: int = AROUND) -> tuple[int, np.ndarray, int] | None:
    """(ids of ``left`` that stay, ids between, ids of ``right`` that go): a window around the join, encoded again.

    The window goes from some settled place before the join to some behind it, and counts if its ids agree with those of
    both units from its ends to the settled places next to the join. Until they do, it is doubled, up to both units; null
    if even those don't agree.
    """
    while True:
        a, b = _places(left.data, True, around), _places(right.data, False, around)
        text = left.data[a[-1] :] + right.data[: b[-1]]
        ids = coder.encode_part(text.decode("utf-8", "surrogatepass"))
        ends = np.cumsum(coder.lengths[ids])
        got = Encoded(text, ids, ends)
        i, j, k, m = left.before(a[-1]), left.before(a[0]), right.before(b[0]), right.before(b[-1])
        p, q = got.before(a[0] - a[-1]), got.before(len(left.data) - a[-1] + b[0])
        if min(i, j, k, m, p, q) >= 0 and np.array_equal(ids[:p], left.ids[i:j]) and np.array_equal(ids[q:], right.ids[k:m]):
            return j, ids[p:q], k
        if len(a) < around and len(b) < around:
            return None
        around *= 2


class Encoder:
    """Whole texts from the ids of their units; ``known`` holds those that were encoded before, by digest."""

    def __init__(self, coder: Bpe, known: dict[bytes, np.ndarray] | None = None):
        self.coder, self.known, self.reused = coder, known or {}, 0

    def unit(self, data: bytes) -> Encoded:
        ids = self.known.get(digest(data)) if self.known else None
        if ids is None:
            ids = self.coder.encode_part(data.decode("utf-8", "surrogatepass"))
        else:
            self.reused += len(data)
        return Encoded(data, ids, np.cumsum(self.coder.lengths[ids]))

    def part(self, text: str) -> np.ndarray:
        found = [self.unit(x) for x in units(text.encode("utf-8", "surrogatepass"))]
        out, start = [], 0
        for left, right in zip(found, found[1:]):
            if (repaired := joined(left, right, self.coder)) is None:
                return self.coder.encode_part(text)
            stay, between, gone = repaired
            out += [left.ids[start:stay], between]
            start = gone
        return np.concatenate([*out, found[-1].ids[start:]]) if out else found[0].ids

    def encode(self, text: str) -> np.ndarray:
        if not text or not self.coder.plain:
            return self.coder.encode(text)
        ids = [self.part(x) if isinstance(x, str) else np.array([x], np.uint32) for x in self.coder.parts(text)]
        return ids[0] if len(ids) == 1 else np.concatenate(ids)


def _narrow(coder: Bpe) -> str:
    """The smallest numbers that hold the tokenizer's ids, for their way between tasks."""
    return "<u2" if coder.size <= 1 << 16 else "<u4"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _units_of(coder: Bpe, texts: list[bytes]):
    for text in texts:
        for x in coder.parts(text.decode("utf-8", "surrogatepass")) if coder.plain else ():
            if isinstance(x, str):
                yield from units(x.encode("utf-8", "surrogatepass"))


def _joined(rows: pd.DataFrame, column: str) -> bytes:
    return b"".join(x for x in rows[column] if x is not None)


def _digests(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "V16")


def _dealt(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places in ``keys``) by the first bytes of the digests."""
    part = keys.view(np.uint8).reshape(-1, 16)[:, :4].copy().view("<u4").ravel() % np.uint32(parts)
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, at[1:]), strict=True)) if len(order) else []


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, the digests of its units that stand in other places too, and those of them it is to encode."""
    every = _digests(_joined(pdf, "digests"))
    block = np.repeat(pdf["block"].to_numpy(), [len(x) // 16 for x in pdf["digests"]])
    twice = np.frombuffer(_joined(pdf, "twice"), bool)
    names, at, n = np.unique(every, return_inverse=True, return_counts=True)
    many = (n + np.bincount(at, weights=twice, minlength=len(names))) > 1
    # One of the blocks that hold a unit encodes it: which one, the digest says.
    order = np.lexsort((block, at))
    first = np.searchsorted(at[order], np.arange(len(names)))
    turn = names.view(np.uint8).reshape(-1, 16)[:, 4:8].copy().view("<u4").ravel() % n
    own = np.zeros(len(every), bool)
    own[order[first + turn]] = True
    keep = np.flatnonzero(many[at])
    keep = keep[np.argsort(block[keep], kind="stable")]
    found, cut = np.unique(block[keep], return_index=True)
    parts = np.split(keep, cut[1:]) if len(keep) else []
    return pd.DataFrame({"block": found, "digests": [every[x].tobytes() for x in parts], "own": [own[x].tobytes() for x in parts]})


def _handed(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each block, the ids of the shared units that it asked for; rows of made ids have no block."""
    made, asked = pdf[pdf["ids"].notna()], pdf[pdf["ids"].isna()]
    table: dict[bytes, bytes] = {}
    for digests, sizes, ids in zip(made["digests"], made["sizes"], made["ids"], strict=True):
        sizes = np.frombuffer(sizes, np.int32)
        ends = len(ids) // max(1, int(sizes.sum())) * np.cumsum(sizes)
        for k, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            table[digests[16 * k : 16 * k + 16]] = ids[start:end]
    out = []
    for block, digests in zip(asked["block"], asked["digests"], strict=True):
        got = [table[digests[k : k + 16]] for k in range(0, len(digests), 16)]
        out.append((block, digests, np.array([len(x) for x in got], np.int32).tobytes(), b"".join(got)))
    return pd.DataFrame(out, columns=["block", "digests", "sizes", "ids"])


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, schema: str, give) -> DataFrame:
    """``give(encoder, ids, texts)`` for the texts of each block, where shared units are known."""
    # Ids travel as strings: pandas would turn whole numbers among nulls into floats.
    text = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = text.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(shuffle_parts(docs.sparkSession), n_bytes // BLOCK_BYTES + 1)
    # Repeats of one row in several splits go to several blocks.
    by_block = text.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")).groupBy("block")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        coder, block = bpe(tokenizer), pdf["block"].iloc[0]
        keys = [digest(x) for _, texts in text_batches((pdf["doc_id"], pdf["text"])) for x in _units_of(coder, texts)]
        names, n = np.unique(_digests(b"".join(keys)), return_counts=True)
        rows = [(p, block, names[at].tobytes(), (n[at] > 1).tobytes()) for p, at in _dealt(names, blocks)]
        return pd.DataFrame(rows, columns=["part", "block", "digests", "twice"])

    def once(pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        coder, rows = bpe(tokenizer), []
        every = _digests(_joined(shared, "digests"))
        own = set(every[np.frombuffer(_joined(shared, "own"), bool)].tolist())
        ids: dict[bytes, np.ndarray] = {}
        for _, texts in text_batches((pdf["doc_id"], pdf["text"])) if own else ():
            for x in _units_of(coder, texts):
                if (key := digest(x)) in own and key not in ids:
                    ids[key] = coder.encode_part(x.decode("utf-8", "surrogatepass")).astype(_narrow(coder))
        for part, at in _dealt(every, blocks):
            rows.append((part, shared["block"].iloc[0], every[at].tobytes(), None, None))
            if mine := [x for x in every[at].tolist() if x in ids]:
                rows.append((part, None, b"".join(mine), np.array([len(ids[x]) for x in mine], np.int32).tobytes(), b"".join(ids[x].tobytes() for x in mine)))
        return pd.DataFrame(rows, columns=["part", "block", "digests", "sizes", "ids"]).astype({"block": "Int32"})

    def finish(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        coder, known = bpe(tokenizer), {}
        for digests, sizes, ids in zip(table["digests"], table["sizes"], table["ids"], strict=True):
            cut = np.split(np.frombuffer(ids, np.uint8), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])
            known |= {digests[16 * k : 16 * k + 16]: x.view(_narrow(coder)) for k, x in enumerate(cut)}
        encoder = Encoder(coder, known)
        return give(encoder, pdf["doc_id"], pdf["text"])

    seen = by_block.applyInPandas(find, "part int, block int, digests binary, twice binary")
    shared = seen.groupBy("part").applyInPandas(_shared, "block int, digests binary, own binary")
    made = by_block.cogroup(shared.groupBy("block")).applyInPandas(once, "part int, block int, digests binary, sizes binary, ids binary")
    table = made.groupBy("part").applyInPandas(_handed, "block int, digests binary, sizes binary, ids binary")
    done = by_block.cogroup(table.groupBy("block")).applyInPandas(finish, f"doc_id string, {schema}")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: what the tokenizers library gives for each whole text, special tokens not added.

    Texts are dealt into blocks once. Each block cuts its texts into chunks by a rolling hash and sends the chunks' digests
    to the task that has a range of digests, which finds those that stand in several places, in one block or many, and
    picks the one block that encodes each. The ids of shared chunks go back to the blocks that hold them; chunks that stand
    once are encoded where they are. Joins are repaired as ``joined`` says, so results never depend on where chunks were
    cut. A passage that all documents share is one digest a block.

    Null text: empty, with no ids. Null and repeated ids stay as they are; no documents give no rows; other columns are
    not read. Texts are cut at special tokens first. White space of any length is dealt with (``Bpe.encode_part``).
    """

    def give(encoder: Encoder, ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": ids, "ids": [encoder.encode(t).astype(np.int32) for t in texts]})

    return _encoded(docs, tokenizer, id_col, text_col, "ids array<int>", give)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` for ``doc_id, ids``; null ids give an empty text."""

    def run(batches):
        coder = bpe(tokenizer)
        for pdf in batches:
            yield pdf.assign(text=[coder.decode([] if ids is None else ids.tolist()) for ids in pdf.pop("ids")])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes as ``encode_documents`` does, decodes, and returns digests.

    Nulls, repeats and empty tables as in ``encode_documents``.
    """

    def give(encoder: Encoder, keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        coder = encoder.coder
        names = np.array([str(i) for i in range(coder.size)], object)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        rows = []
        for text in texts:
            ids = encoder.encode(text)
            rows.append((len(ids), sha(",".join(names[ids].tolist()).encode()), sha(coder.decode(ids.tolist()).encode("utf-8"))))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=keys.to_numpy())

    return _encoded(docs, tokenizer, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", give)
