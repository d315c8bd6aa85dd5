"""Toxicity: a chain of linear models over word counts, each fed the probabilities of the categories before it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .runtime import Words, give_back, mix, slices, text_batches

#: Labelled documents that training takes at most, and bytes of text: those of the smallest hashed ids.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 8_000_000
#: Features that a category's model may weigh: words, and word beginnings of so many bytes, which catch other endings.
FEATURES, BEGINNINGS = 160, (4, 6)
#: Documents that a feature must be in.
LEAST_DOCS = 8
FOLDS, THRESHOLD = 5, 0.3
#: Bytes of text that are scored at a time, of one text or several: a worker holds some sixty times as many in arrays.
BATCH_BYTES = 400_000


@dataclass
class Link:
    """One category's model: sorted word names with their weights, weights of earlier probabilities, and the bias."""

    category: str
    names: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    #: Whether labels of both kinds made it; a constant tells no documents apart, so its verdict keeps them.
    fitted: bool = True


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _choose(word: np.ndarray, doc: np.ndarray, y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Of distinct (word number, document) pairs, the words whose presence tells most about ``y``, by chi-squared."""
    own = fit[doc]
    there = np.bincount(word[own], minlength=word.max(initial=-1) + 1)
    of_yes = np.bincount(word[own], weights=y[doc[own]], minlength=len(there))
    n, yes = fit.sum(), y[fit].sum()
    expected = there * yes / n
    score = (of_yes - expected) ** 2 / np.maximum(expected, 1e-9) + (of_yes - expected) ** 2 / np.maximum(there - expected, 1e-9)
    score[there < min(LEAST_DOCS, max(1, n // 50))] = 0
    best = np.argsort(-score, kind="stable")[:FEATURES]
    # Chance gives one word in 10,000 this much; the rest is noise that long documents would add up.
    return np.sort(best[score[best] > 15.1])


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents of lower-cased words, without the ASCII punctuation around them, and of their beginnings."""
    words = Words([t.translate(_STRIP) for t in texts])
    spans = words.spans(lower=True)
    names, docs = [mix(spans.names(words.start, words.end))], [words.doc]
    for k in BEGINNINGS:
        long = words.end - words.start >= k
        names.append(mix(spans.names(words.start[long], words.start[long] + k) + np.uint64(k)))
        docs.append(words.doc[long])
    return np.concatenate(names), np.concatenate(docs)


#: Besides white space, ASCII that is no letter or digit parts words.
_STRIP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """The chain for ``categories`` (0/1 columns of ``labels``), in that order.

    Trains on the driver on at most ``TRAIN_ROWS`` labelled documents and ``TRAIN_BYTES`` of text: those whose ids hash
    lowest, so the choice doesn't depend on the order of rows; a text that doesn't fit any more is passed over, by its
    length, before it is fetched. Labels with a null, and ids with contradicting labels, are left out. A later model sees out-of-fold probabilities of the earlier ones, so it learns how far to trust them. A
    category with one value only, or with no labels at all, gets the (smoothed) share of ones as a constant.
    """
    known = labels.groupBy(id_col).agg(*[F.max(c).alias(c) for c in categories], *[F.min(c).alias(f"_{c}") for c in categories])
    known = known.where(" and ".join(f"{c} = _{c}" for c in categories)).select(id_col, *categories)
    some = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"))
    sizes = some.select(id_col, F.length("_text").alias("_size")).join(known, id_col).groupBy(id_col).agg(F.max("_size").alias("_size"))
    sizes = sizes.where(F.col("_size") <= TRAIN_BYTES).orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS)
    fit, held = [], 0
    for r in sizes.orderBy(F.xxhash64(id_col), id_col).collect():
        if held + r["_size"] <= TRAIN_BYTES:
            held += r["_size"]
            fit.append((len(fit), r[id_col]))
    chosen = docs.sparkSession.createDataFrame(fit, StructType([StructField("_order", LongType()), StructField(id_col, docs.schema[id_col].dataType)]))
    rows = some.join(F.broadcast(chosen), id_col).groupBy(id_col, "_order").agg(F.max("_text").alias("_text"))
    picked = sorted(rows.join(known, id_col).collect(), key=lambda r: r["_order"]) if fit else []
    texts = [r["_text"].encode("utf-8", "surrogatepass") for r in picked]
    chain: list[Link] = []
    earlier = np.zeros((len(texts), 0))
    parts = [_words(texts[k : k + 200]) for k in range(0, len(texts), 200)]
    names = np.concatenate([n for n, _ in parts]) if parts else np.zeros(0, np.uint64)
    doc = np.concatenate([d + 200 * k for k, (_, d) in enumerate(parts)]) if parts else np.zeros(0, np.int64)
    del parts
    # One row a (word, document) pair, by sorting in place: the driver's memory is small.
    order = np.lexsort((doc, names))
    names, doc = names[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]))))[: len(names)]
    counts = np.diff(np.append(new, len(names)))
    names, doc = names[new], doc[new]
    vocabulary, word = np.unique(names, return_inverse=True)
    del names, order, new
    everyone = np.ones(len(texts), bool)

    def features(chosen):
        hit = np.isin(word, chosen)
        x = np.zeros((len(texts), len(chosen)))
        x[doc[hit], np.searchsorted(chosen, word[hit])] = np.log1p(counts[hit])
        return np.column_stack((x, earlier))

    fold = np.arange(len(texts)) % FOLDS
    for c in categories:
        y = np.array([r[c] for r in picked], float)
        if len(set(y.tolist())) < 2 or min(y.sum(), (1 - y).sum()) < FOLDS:
            share = (y.sum() + 0.5) / (len(y) + 1)
            chain.append(Link(c, np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))), False))
            earlier = np.column_stack((earlier, np.full(len(y), share)))
            continue
        out = np.zeros(len(y))
        for k in range(FOLDS):
            fit = fold != k
            x = features(_choose(word, doc, y, fit))
            w, b = _fit(x[fit], y[fit])
            out[~fit] = 1 / (1 + np.exp(-np.clip(x[~fit] @ w + b, -30, 30)))
        chosen = _choose(word, doc, y, everyone)
        w, b = _fit(features(chosen), y)
        order = np.argsort(vocabulary[chosen])
        chain.append(Link(c, vocabulary[chosen][order], w[: len(chosen)][order], w[len(chosen) :], b))
        earlier = np.column_stack((earlier, out))
    return chain


def _cut(texts: list[bytes]):
    """Lists of (text's number, part of it) of about ``BATCH_BYTES``: a long text is cut where words part."""
    out, n = [], 0
    for k, text in enumerate(texts):
        for part in slices(text.translate(_STRIP), BATCH_BYTES):
            out.append((k, part))
            n += len(part)
            if n >= BATCH_BYTES:
                yield out
                out, n = [], 0
    if out:
        yield out


def probabilities(chain: list[Link], texts: list[bytes]) -> np.ndarray:
    """(documents, categories): each model sees the probabilities of those before it."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x.names for x in chain]]))
    counts = np.zeros((len(texts), len(known)), np.int64)
    for some in _cut(texts) if len(known) else ():
        names, part = _words([x for _, x in some])
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        hit = known[at] == names
        np.add.at(counts, (np.array([k for k, _ in some])[part[hit]], at[hit]), 1)
    seen, out = np.log1p(counts), np.zeros((len(texts), len(chain)))
    for k, link in enumerate(chain):
        score = link.bias + out[:, :k] @ link.earlier + seen[:, np.searchsorted(known, link.names)] @ link.weights
        out[:, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return out


def _judged(text: Column, chain: list[Link]) -> Column:
    """The chain's probabilities for each text, or null for a null or empty one."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for _, some in text_batches((texts, texts), BATCH_BYTES):
            p = probabilities(chain, some)
            out += [p[k] if text else None for k, text in enumerate(some)]
        give_back()
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


def score(docs: DataFrame, chain: list[Link], category: str, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, p_<category>`` for each category, and ``toxic``, the verdict on ``category``.

    Whole texts, a long one in parts whose counts add up; no shuffle; the chain (``FEATURES`` words a category) travels with the task. Null and empty texts have
    null probabilities and aren't toxic; nor is any text if there were no labels to fit ``category`` by. Null and repeated
    ids stay; no documents give no rows; other columns are not read.
    """
    verdict = [x.category for x in chain].index(category)
    if not chain[verdict].fitted:
        threshold = float("inf")
    p = docs.select(F.col(id_col).alias("doc_id"), _judged(F.col(text_col), chain).alias("p"))
    each = [F.col("p")[k].alias(f"p_{x.category}") for k, x in enumerate(chain)]
    return p.select("doc_id", *each, F.coalesce(F.col("p")[verdict] >= threshold, F.lit(False)).alias("toxic"))


def keep_clean(docs: DataFrame, chain: list[Link], category: str, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, that ``score`` doesn't call toxic."""
    verdict = [x.category for x in chain].index(category)
    if not chain[verdict].fitted:
        return docs
    return docs.where(F.coalesce(_judged(F.col(text_col), chain)[verdict] < threshold, F.lit(True)))
