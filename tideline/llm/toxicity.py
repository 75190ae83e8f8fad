"""Toxicity by non-negative positive-unlabelled learning (numpy).

A linear model over hashed words learns from confirmed toxic examples and unlabelled text. With the
class prior p, the risk is p*E+[l(g)] + max(0, E_u[l(-g)] - p*E+[l(-g)]): the unlabelled part, less
what its own positives add, estimates the negatives' risk without any labelled negative; where that
estimate falls below zero its gradient is turned round, so the model can't overfit by it. The prior
is the toxic share of the labelled training rows.

The model is fitted on a bounded sample (``Sample``) whose rows are chosen by a hash of doc_id and whose
features, not texts, come to the driver. The bound on unlabelled rows costs precision only: the risk's unlabelled part is a mean
over 8,000 texts instead of all, so its standard error is about 1 % of the spread of the loss, and features that fewer texts have are left out. Scoring maps every whole text with the model's weights
(``BUCKETS`` floats), without a shuffle.

Cases: a null text counts as empty and is scored by the bias alone. A null doc_id is not held out, and is
not in the sample. Labels that are null, repeat or have no document don't count. Without a toxic
example every score is 0. An empty table gives an empty result; extra columns aren't carried by
``score``; ``drop_toxic`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import by_size, fresh, quoted, trim, word_prefix_hashes

BUCKETS = 1 << 18
#: Beginnings of words that are features besides whole words, in bytes; compounds share them.
PREFIXES = (5, 6, 7, 8, 9)
#: Standard errors by which toxic examples must have a feature more, or less, often than unlabelled text.
SIGNIFICANT = 6.0
THRESHOLD = 0.3
#: ASCII letters in lower case; other ASCII characters but letters and "'" part words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class Sample:
    positive: int = 4000
    unlabelled: int = 8000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct words and word beginnings of each text."""
    plain = [t.lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts]
    both = []
    for hashes, text in word_prefix_hashes(plain, PREFIXES):
        both.append(text.astype(np.int64) * BUCKETS + (hashes >> np.uint64(64 - 18)).astype(np.int64))
    both = np.unique(np.concatenate(both))
    return both // BUCKETS, both % BUCKETS


def _least(rows: DataFrame, k: int) -> DataFrame:
    """The k ids with the smallest hashes. Only ids below a bound that leaves about k of them are sorted, so what meets in one task doesn't grow with the rows."""
    order, n = F.xxhash64("doc_id"), rows.count()
    share = (k + 10 * k**0.5 + 10) / max(n, 1)
    while True:
        bound = int(min(share, 1) * 2**64) - 2**63
        picked = (rows.where(order < bound) if share < 1 else rows).select("doc_id").distinct()
        if share >= 1 or picked.count() >= k:
            return picked.orderBy(order, "doc_id").limit(k)
        share *= 4  # repeated ids


def sampled(documents: DataFrame, labels: DataFrame, sample: Sample) -> tuple[list, list, float]:
    """Buckets of the toxic and the unlabelled sample texts, and the class prior; training rows only."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = _least(known.where("toxic = 1"), sample.positive).select("doc_id", F.lit(1).alias("p"))
    rest = _least(documents.where("doc_id is not null").where(~held_out(F.col("doc_id"))), sample.unlabelled).select("doc_id", F.lit(0).alias("p"))
    # the sample's size is a parameter, so it may be broadcast
    chosen = documents.select("doc_id", "text").join(F.broadcast(toxic.unionByName(rest)), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for first, last in by_size(texts):
                text, bucket = features(texts[first:last])
                ends = np.cumsum(np.bincount(text, minlength=last - first))
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[first:last], "p": batch["p"].to_numpy()[first:last], "x": np.split(bucket.astype(np.int32), ends[:-1])})

    # by Arrow: as Python lists the features would take ten times the memory
    rows = chosen.mapInPandas(run, "doc_id long, p int, x array<int>").toArrow().sort_by([("p", "ascending"), ("doc_id", "ascending")])
    p, ids, found = rows["p"].to_numpy(), rows["doc_id"].to_numpy(), rows["x"].combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    flat, ends = found.values.to_numpy(), found.offsets.to_numpy()
    # rows come in any order, and copies of an id could be more than the bound
    first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(ids) != 0)])) if len(p) else []
    both: tuple[list, list] = [], []
    for i in first:
        both[p[i]].append(flat[ends[i] : ends[i + 1]])
    return both[1], both[0], float(prior)


def _counted(buckets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for first in range(0, len(buckets), step):
        out += np.bincount(buckets[first : first + step], minlength=BUCKETS)
    return out


def risk(g: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """What a step goes down on, and its derivative by the outputs: the risk, or where its part of negatives is below zero that part turned round.

    The first ``n_p`` outputs are of positive examples, the others of unlabelled text; the loss is logistic.
    """
    p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    negative = np.mean(np.logaddexp(0, g[n_p:])) - prior * np.mean(np.logaddexp(0, g[:n_p]))
    d = np.empty(len(g))
    if negative < 0:
        d[:n_p] = prior * p[:n_p] / n_p
        d[n_p:] = -p[n_p:] / (len(g) - n_p)
        return float(-negative), d
    d[:n_p] = prior * (p[:n_p] - 1 - p[:n_p]) / n_p
    d[n_p:] = p[n_p:] / (len(g) - n_p)
    return float(prior * np.mean(np.logaddexp(0, -g[:n_p])) + negative), d


def fit(positive: list, unlabelled: list, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Minimise the non-negative risk by Adam over all examples at once."""
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not len(positive) or not len(unlabelled) or not prior:
        return Model(weights, -np.inf)
    sizes = np.array([len(x) for x in [*positive, *unlabelled]])
    flat = np.concatenate([*positive, *unlabelled])
    n_p, n = len(positive), len(sizes)
    n_u, cut = len(unlabelled), sizes[: len(positive)].sum()
    in_p, in_u = _counted(flat[:cut]), _counted(flat[cut:])
    share = (in_p + in_u) / n
    apart = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    chosen = apart >= SIGNIFICANT
    keep = chosen[flat]
    names, column = np.flatnonzero(chosen), (np.cumsum(chosen) - 1)[flat[keep]]
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[keep]
    del flat, keep
    w, b = np.zeros(len(names)), np.log(prior / (1 - prior))
    state = [np.zeros(len(names) + 1), np.zeros(len(names) + 1)]
    for step in range(1, steps + 1):
        g = np.bincount(row, weights=w[column], minlength=n) + b
        _, d = risk(g, n_p, prior)
        gradient = np.append(np.bincount(column, weights=d[row], minlength=len(names)) + decay * w, d.sum())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights[names] = w
    return Model(weights, float(b))


def trained(documents: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    model = fit(*sampled(documents, labels, sample))
    trim()
    return model


def scores(texts: list[str], model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, last in by_size(texts):
        text, bucket = features(texts[first:last])
        out[first:last] = np.bincount(text, weights=model.weights[bucket], minlength=last - first)
    with np.errstate(over="ignore"):  # an infinite exponential is a score of 0
        return 1 / (1 + np.exp(-(out + model.bias)))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = scores([t if isinstance(t, str) else "" for t in batch["text"]], model)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": found, "predicted": (found >= threshold).astype(np.int32)})

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, all columns as they were."""

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(scores([t if isinstance(t, str) else "" for t in text], model))

    (name,) = fresh(documents, "score")
    return documents.withColumn(name, scored("text")).where(F.col(name) < threshold).select(*map(quoted, documents.columns))
