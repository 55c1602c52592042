"""Quality classifier (operator 8): supervised subword embeddings.

Features of a text are its words and their character n-grams (with the white
space beside a word as its edge), hashed to buckets. Each bucket has a learned
vector; a text's vector is the average over its features; a softmax over two
classes is trained with it by stochastic gradient descent in numpy. Training
takes a bounded sample of labelled rows. After training a bucket matters only
by its vector's product with the difference of the two classes' weights, so
scoring looks up one number for each feature of each whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.textblocks import SPACE, Block, blocks, mix

BUCKETS = 1 << 17
GRAMS = (3, 4)
#: Labelled rows that training takes at most, half of each class.
SAMPLE_ROWS = 3000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_up: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_up.get("up", ())) <= n:
        for name, b in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            p = np.full(max(n + 1, 1 << 21), b, np.uint64)
            p[0] = 1
            _up[name] = np.cumprod(p)
    return _up["up"], _up["down"]


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Owner (text of the block) and bucket of every feature."""
    if not len(b.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    to = np.append(0, np.cumsum((b.data & 0xC0) != 0x80))
    end = to[b.end]
    n = len(points)
    white = (points < 256) & SPACE[np.minimum(points, 255)]
    points = np.where(white, 32, points).astype(np.uint64)
    up, down = _powers(n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * up[:n], out=s[1:])
    owner = np.searchsorted(end, np.arange(n), side="right")
    edge = np.append(True, owner[1:] != owner[:-1])
    first = ~white & (edge | np.append(True, white[:-1]))
    last = ~white & np.append(edge[1:] | white[1:], True)
    a, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    owners, hashes = [owner[a]], [(s[e] - s[a]) * down[a]]
    whites = np.append(0, np.cumsum(white))
    for k in GRAMS:
        i = np.arange(n - k + 1)
        if len(i):
            i = i[(owner[: n - k + 1] == owner[k - 1 :]) & (whites[k - 1 : n] == whites[1 : n - k + 2])]
            owners.append(owner[i])
            hashes.append((s[i + k] - s[i]) * down[i] + np.uint64(k))
    return np.concatenate(owners), (mix(np.concatenate(hashes)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label")
        for b in blocks(batch.column("text")):
            owner, bucket = features(b)
            key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
            cuts = np.searchsorted(key // BUCKETS, np.arange(len(b) + 1))
            rows = range(len(b))
            yield pa.RecordBatch.from_arrays(
                [label[b.rows], pa.array([(key[cuts[i] : cuts[i + 1]] % BUCKETS).astype(np.int32) for i in rows], pa.list_(pa.int32())), pa.array([count[cuts[i] : cuts[i + 1]].astype(np.int32) for i in rows], pa.list_(pa.int32()))],
                ["label", "bucket", "count"],
            )


@dataclass
class Model:
    """``weight`` of each bucket and ``bias``: their mean over a text's features and sum give the log odds of class 1."""

    weight: np.ndarray
    bias: float


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over (label, buckets, counts)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    bags = [(y, i, (c / c.sum()).astype(np.float32)) for y, i, c in bags if len(i)]
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for j in rng.permutation(len(bags)):
            y, index, share = bags[j]
            lr = rate * (1 - step / steps)
            hidden = share @ vectors[index]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            # a bucket's part of the text is its share; scaled by the square root of the number of buckets, which
            # keeps long texts from standing still
            vectors[index] -= lr * np.sqrt(len(index)) * share[:, None] * back
            step += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``sample_rows`` labelled rows outside the held-out part, half of each class, by hash order.

    A sampled id is one row to learn from, however often it is repeated. Features are counted on the executors;
    the driver gets the bags of the sample, which have an entry for each different bucket, BUCKETS at most, however
    long the text. Without labels of both
    classes the model scores every text 0.5 (or the one class there is, by its bias of zero).
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id")) != 1).select("doc_id", F.col("quality").alias("label")).distinct()
    order = F.xxhash64("doc_id", F.lit(5))
    sample = known.where("label = 0").orderBy(order, "doc_id").limit(sample_rows // 2).unionByName(known.where("label = 1").orderBy(order, "doc_id").limit(sample_rows // 2))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows ids
    # an id may be repeated in any number of rows: the text with the least md5 stands for it
    texts = found.groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text")).select(F.col("label").cast("int").alias("label"), "text")
    rows = texts.mapInArrow(_bags, "label int, bucket array<int>, count array<int>").toArrow()
    labels_, bucket, count = rows["label"].to_pylist(), rows["bucket"].combine_chunks(), rows["count"].combine_chunks()
    bags = [(y, bucket[i].values.to_numpy(), count[i].values.to_numpy()) for i, y in enumerate(labels_)]
    bags.sort(key=lambda b: (b[0], len(b[1]), b[1][:50].tobytes(), b[2][:50].tobytes()))  # the order in which tasks end plays no part
    if len({b[0] for b in bags}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return train(bags)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rest = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != at]
            for b in blocks(batch.column(at), 1 << 20):
                owner, bucket = features(b)
                n = np.bincount(owner, minlength=len(b))
                z = np.bincount(owner, model.weight[bucket], minlength=len(b)) / np.maximum(n, 1) + model.bias
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([c[b.rows] for _, c in rest] + [pa.array(score, pa.float64())], [n for n, _ in rest] + ["score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score and prediction of every document.

    A null or empty text has no features and gets the score of the bias. Repeated rows are scored alike;
    a null doc_id is never held out, and never learned from. An empty table gives an empty result. Columns other than
    doc_id and text play no part.
    """
    model = fit(docs, labels, sample_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_scores(model), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
