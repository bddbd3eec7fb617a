"""Quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its words and of the character
n-grams of its bytes, hashed into a fixed number of buckets; a softmax layer on
this average gives the class. Vectors and layer are fitted with plain numpy
stochastic gradient descent on a bounded sample of labelled rows.

For scoring, the layer is applied to every bucket's vector beforehand: the
average of the products is the product of the average, so a document costs one
number per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrill.llm.byte_bpe import groups
from logrill.llm.common import BYTE_VALUES, mixed, stretches

BUCKET_BITS = 17
SIZES = (3, 5)  # character n-grams, in bytes
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, and where each text's features start (one more at the end).

    Words are stretches between white space, in lower case like the n-grams. A
    word that repeats the one before it is a feature of its own, whatever the
    word. Every text has one feature that all have.
    """
    parts = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    shift = np.uint64(64 - BUCKET_BITS)
    found, of = [], []
    text_of = np.repeat(np.arange(len(parts)), sizes)
    with np.errstate(over="ignore"):
        values = BYTE_VALUES[data]
        for n in SIZES:
            h = np.full(max(len(data) - n + 1, 0), n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x5851F42D4C957F2D) + values[i:i + len(h)]
            inside = text_of[:len(h)] == text_of[n - 1:] if len(h) else np.zeros(0, bool)
            found.append((mixed(h[inside]) >> shift).astype(np.int32))
            of.append(text_of[:len(h)][inside])
        gap = SPACE[data]
        edge = np.flatnonzero(np.diff(gap.astype(np.int8)))  # each text begins and ends with a space
        begin, end = edge[::2] + 1, edge[1::2] + 1
        found.append((stretches(data, begin, end) >> shift).astype(np.int32))
        of.append(text_of[begin])
        again = np.flatnonzero((found[-1][1:] == found[-1][:-1]) & (of[-1][1:] == of[-1][:-1]))
        for kind, at in ((1, np.arange(len(parts))), (2, of[-1][again])):  # one for each text, one for each word said again
            found.append((mixed(np.full(len(at), kind, np.uint64)) >> shift).astype(np.int32))
            of.append(at)
    bucket, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(parts))
    return bucket[order], np.concatenate([[0], np.cumsum(counts)])


def bags(docs: DataFrame) -> DataFrame:
    """(label, buckets, shares) per row of (label, text): distinct buckets and their share of the features."""

    def run(batches):
        for batch in batches:
            buckets, shares = [], []
            for some in groups([t or "" for t in batch.column(1).to_pylist()], 1 << 20):
                bucket, bounds = features(some)
                for a, b in zip(bounds, bounds[1:]):
                    keys, n = np.unique(bucket[a:b], return_counts=True)
                    buckets.append(keys.astype(np.int32).tobytes())
                    shares.append((n / (b - a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                names=["label", "buckets", "shares"])

    return docs.select("label", "text").mapInArrow(run, "label int, buckets binary, shares binary")


def fit(rows: list[tuple[int, bytes, bytes]], width: int = 6, epochs: int = 10, rate: float = 2.0,
        batch: int = 32, seed: int = 7) -> np.ndarray:
    """Logit of class 1 per bucket, from (label, buckets, shares) rows; the softmax bias is spread over all.

    Training stops early in no case; without both labels the result is the
    constant logit of the smoothed share of label 1.
    """
    labels = np.array([r[0] for r in rows], np.int64)
    ones = int(labels.sum())
    prior = np.log((ones + 1) / (len(rows) - ones + 1))
    if ones in (0, len(rows)):
        return np.full(1 << BUCKET_BITS, prior, np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << BUCKET_BITS, width))
    layer, bias = rng.normal(0, 0.5, (width, 2)), np.array([0.0, prior])
    buckets = [np.frombuffer(r[1], np.int32) for r in rows]
    shares = [np.frombuffer(r[2], np.float32) for r in rows]
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            some = order[k:k + batch].tolist()
            at, weight = np.concatenate([buckets[i] for i in some]), np.concatenate([shares[i] for i in some])[:, None]
            starts = np.cumsum([0] + [len(buckets[i]) for i in some[:-1]])
            hidden = np.add.reduceat(vectors[at] * weight, starts, axis=0)
            logits = hidden @ layer + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(some)), labels[some]] -= 1  # gradient of the loss by the logits
            step = rate * (1 - done / steps)
            done += 1
            back = np.repeat(chance @ layer.T, np.diff(np.append(starts, len(at))), axis=0) * weight
            layer -= step / len(some) * hidden.T @ chance
            bias -= step / len(some) * chance.sum(axis=0)
            touched, place = np.unique(at, return_inverse=True)
            change = np.stack([np.bincount(place, weights=back[:, j]) for j in range(width)], axis=1)
            vectors[touched] -= step * change  # the sum over the rows, as single-row steps would add up to
    return ((vectors @ layer + bias) @ np.array([-1.0, 1.0])).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, sample: int, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(label, text) of at most `sample` labelled rows that are not held out: those whose key's hash is smallest.

    A key that is labelled twice takes the larger label; rows with a repeated
    key are all taken.
    """
    marked = labels.where(F.col(label).isin(0, 1) & ~held_out).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    picked = marked.join(docs.select(key).distinct(), key, "left_semi").orderBy(F.xxhash64(key), key).limit(sample)
    return docs.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key).select("label", "text")  # `sample` rows


def score(docs: DataFrame, logit: np.ndarray, keep: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns `keep` of each row, score (chance of class 1) and predicted (1 if score >= threshold).

    A null text counts as empty; an empty text has the one feature that every
    text has. Repeated rows are scored each alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logit)  # one number per bucket
    given = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")

    def run(batches):
        logit = shared.value.astype(np.float64)
        for batch in batches:
            sums = []
            for some in groups([t or "" for t in batch.column("_text").to_pylist()], 1 << 19):
                bucket, bounds = features(some)
                total = np.add.reduceat(logit[bucket], bounds[:-1])
                sums.append(total / np.diff(bounds))
            chance = 1 / (1 + np.exp(-np.concatenate(sums))) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return given.mapInArrow(run, f"{schema}, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, label: str, held_out, sample: int = 6000, **kw) -> np.ndarray:
    """The fitted logits. `sample` bounds the labelled rows used; at most its features come to the driver."""
    rows = bags(labelled_sample(docs, labels, label, held_out, sample)).toArrow()
    return fit(list(zip(*(rows.column(i).to_pylist() for i in range(3)))), **kw)
