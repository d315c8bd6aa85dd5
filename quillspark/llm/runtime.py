"""What the operators share: the shared folder, written intermediate tables, and word arrays over Arrow text."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASK64 = (1 << 64) - 1
#: Bytes 0x20 and 0x09-0x0D part words; every other byte, so every non-ASCII character, belongs to one.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so a lost executor costs no more than rereading it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that a worker has freed to the system: Spark keeps workers for later stages, and what an idle one
    holds is missing to the tasks of those."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby inputs give unrelated names."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


class Spans:
    """64-bit names of spans of a uint64 sequence: equal spans get equal names wherever they stand.

    Polynomials modulo 2 ** 64 are quick, but spans can be made that share a name, so names only choose what is compared.
    """

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * powers(base, n)[:-1], out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


_SEEDS = np.random.default_rng(20240229)
BYTE_NAMES = _SEEDS.integers(1, 1 << 63, (2, 256), np.uint64, endpoint=False) * np.uint64(2) + np.uint64(1)
BYTE_BASE, WORD_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class Words:
    """The words of some texts (UTF-8 bytes): where each starts and ends, its text, and 64-bit names of words."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(sizes)
        space = IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_end, self.start, "right")
        #: First word of each text, and the number of all words.
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def joined(self) -> bytes:
        """All words, each with one space behind it."""
        space = IS_SPACE[self.data]
        keep = ~space
        keep[self.end] = True
        return np.where(space, np.uint8(0x20), self.data)[keep].tobytes()

    def spans(self, which: int = 0, lower: bool = False) -> Spans:
        table = BYTE_NAMES[which]
        if lower:
            table = table.copy()
            table[65:91] = table[97:123]
        return Spans(table[self.data], BYTE_BASE[which])

    def names(self, which: int = 0) -> np.ndarray:
        return self.spans(which).names(self.start, self.end)


_SPACE = re.compile(rb"[ \t-\r]")


def slices(text: bytes, size: int = 1_000_000):
    """The text in parts of about ``size`` bytes, cut at white space (a longer word lies in one part)."""
    at = 0
    while len(text) - at > size and (cut := _SPACE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def word_pieces(text: bytes, overlap: int, size: int = 1_000_000):
    """(number of its first word, piece) of the parts of a text, cut at white space: each goes on for ``overlap`` words of
    the next, so that every stretch of ``overlap`` + 1 words begins in one part only and lies whole in it."""
    more = re.compile(rb"(?:[ \t-\r]*+[^ \t-\r]++){0,%d}+" % overlap)
    at = first = 0
    while True:
        cut = _SPACE.search(text, at + size) if len(text) - at > size else None
        if cut is None:
            yield first, text[at:] if at else text
            return
        yield first, text[at : more.match(text, cut.start()).end()]
        first += len(text[at : cut.start()].split())
        at = cut.end()


def text_batches(columns, most: int = 2_000_000):
    """Lists (ids, texts as bytes) of about ``most`` bytes from pandas or Arrow columns; a null text counts as empty."""
    ids, texts, n = [], [], 0
    for key, text in zip(*columns, strict=True):
        ids.append(key)
        texts.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
        n += len(texts[-1])
        if n >= most:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts
