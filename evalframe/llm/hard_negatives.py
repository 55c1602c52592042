"""Hard-negative mining (operator 13) by Kronecker-packed products.

The components of all candidates of a block, made non-negative by a bias, stand
side by side in fields of one wide integer for each dimension. An anchor is
multiplied into it once for each of its components, and the fields of the sum are
its exact scores with all candidates, however large the components are: a field
is as wide as the largest sum needs, so that none runs into the next.

Anchors in chunks meet candidates in blocks, first those of their label, which
gives the positives, then all, which gives the negatives between the bounds of
each positive's score. A task answers with its own best few for each anchor, and
the best of these are the result. Blocks and chunks are dealt by hash and bounded
in components, so that a label or a vector that a third of all rows share is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import cut, with_few

SCALE = 256
#: Components (rows times dimensions) of a block of candidates and of a chunk of anchors, about.
BLOCK_COMPONENTS, CHUNK_COMPONENTS = 1 << 19, 1 << 17
_WORD = 1 << 64


def labelled_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v, dim): components times ``scale``, rounded down, of the rows that take part, with the labels that hold."""
    as_double = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(as_double, lambda c: F.floor(c * scale).cast("long")).alias("v"),
        F.size("embedding").alias("dim"),
    )


class Packed:
    """A block of candidates, packed for anchors whose components' sizes sum to ``reach`` at most."""

    def __init__(self, v: np.ndarray, reach: int):
        self.rows, dim = v.shape
        low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
        self.bias = max(0, -low)
        top = high + self.bias
        self.width = (reach * top).bit_length() // 8 + 1  # bytes of a field: the largest sum and a sign
        self.half = 1 << (8 * self.width - 1)
        self.small = reach * max(top, self.bias) < 1 << 62
        raw = np.zeros((dim, self.rows, self.width), np.uint8)
        biased = np.ascontiguousarray(v.T).view(np.uint64) + np.uint64(self.bias)
        used = min(8, self.width)
        raw[:, :, :used] = biased.astype("<u8").view(np.uint8).reshape(dim, self.rows, 8)[:, :, :used]
        self.planes = [int.from_bytes(plane.tobytes(), "little") for plane in raw]
        self.start = int.from_bytes(self.half.to_bytes(self.width, "little") * self.rows, "little")  # keeps fields from borrowing

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner products with all candidates; those beyond 64 bits become the largest or least number."""
        total = self.start
        for a, plane in zip(anchor, self.planes):
            total += a * plane
        raw, w = total.to_bytes(self.rows * self.width, "little"), self.width
        shift = self.half + self.bias * sum(anchor)
        if self.small:
            fields = np.zeros((self.rows, 8), np.uint8)
            fields[:, :w] = np.frombuffer(raw, np.uint8).reshape(self.rows, w)
            return (fields.view("<u8")[:, 0] - np.uint64(shift % _WORD)).view(np.int64)
        exact = (int.from_bytes(raw[i * w : (i + 1) * w], "little") - shift for i in range(self.rows))
        return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k best of the candidates ``at``: higher scores first, ties by id."""
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((uids[at], ids[at], -scores[at]))][:k]


def _vectors(column: pa.ChunkedArray, rows: int, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int64)]).astype(np.int64).reshape(rows, dim)


_POSITIVES = "a_uid long, uid long, vec_id long, score long"
_NEGATIVES = "a_uid long, p int, anchor_id long, positive_id long, positive_score long, vec_id long, uid long, score long"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({n: pa.array(c, {"long": pa.int64(), "int": pa.int32()}[t]) for (n, t), c in zip(fields, columns)})


def _packed(anchors: pa.Table, block: pa.Table, dim: int) -> tuple[np.ndarray, Packed]:
    a = _vectors(anchors["a"], len(anchors), dim)
    reach = max((sum(map(abs, row)) for row in a.tolist()), default=0)
    return a, Packed(_vectors(block["v"], len(block), dim), reach)


def _find_positives(k: int) -> Callable:
    def run(key: tuple, anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(block):
            a, packed = _packed(anchors, block, key[0].as_py())
            ids, uids = block["vec_id"].to_numpy(), block["uid"].to_numpy()
            for own, row in zip(anchors["a_uid"].to_pylist(), a.tolist()):
                s = packed.scores(row)
                best = _first(s, ids, uids, np.flatnonzero(uids != own), k)
                out += [(own, int(uids[j]), int(ids[j]), int(s[j])) for j in best]
        return _table(_POSITIVES, out)

    return run


def _find_negatives(k: int, low: int, high: int) -> Callable:
    def run(key: tuple, anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(block):
            a, packed = _packed(anchors, block, key[0].as_py())
            ids, uids, labels = block["vec_id"].to_numpy(), block["uid"].to_numpy(), block["label"].to_numpy()
            for head, row in zip(anchors.select(["a_uid", "anchor_id", "a_label", "positives"]).to_pylist(), a.tolist()):
                s = packed.scores(row)
                other = np.flatnonzero(labels != head["a_label"])
                for p in head["positives"]:
                    # low * positive <= 100 * negative <= high * positive, in whole numbers
                    least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                    if least > most:
                        continue
                    for j in _first(s, ids, uids, other[(s[other] >= least) & (s[other] <= most)], k):
                        out.append((head["a_uid"], p["p"], head["anchor_id"], p["vec_id"], p["score"], int(ids[j]), int(uids[j]), int(s[j])))
        return _table(_NEGATIVES, out)

    return run


def _meet(anchors: DataFrame, data: DataFrame, group: list[str], answer: Callable, schema: str, block: int, chunk: int) -> DataFrame:
    """Every chunk of anchors with every block of its group; a block goes once to each chunk."""
    parts = lambda dim, limit: F.ceil(F.count("*") * F.greatest(F.max(dim), F.lit(1)) / limit).cast("long")
    own = [f"a_{g}" for g in group]
    few = anchors.groupBy(*own).agg(parts("a_dim", chunk).alias("chunks")).withColumnsRenamed(dict(zip(own, group)))
    sizes = cut(data.groupBy(*group).agg(parts("dim", block).alias("blocks")).join(few, group))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = with_few(anchors, sizes.withColumnsRenamed(dict(zip(group, own))), own).withColumn("a_chunk", F.pmod(F.xxhash64("a_uid"), F.col("chunks"))).withColumn("a_block", upto("blocks"))
    right = with_few(data, sizes, group).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks"))).withColumn("chunk", upto("chunks"))
    return left.drop("blocks", "chunks").groupBy(*own, "a_block", "a_chunk").cogroup(right.drop("blocks", "chunks").groupBy(*group, "block", "chunk")).applyInArrow(answer, schema)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(table: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: int = SCALE, block: int = BLOCK_COMPONENTS, chunk: int = CHUNK_COMPONENTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; their positives the best rows of their label; the
    negatives of each the best rows of other labels that score between ``low`` and ``high`` per cent of it. Ties go to
    the smaller vec_id. Rows whose vec_id or label is null, or whose vector is null or holds a null or non-finite
    component, take no part. A vector without components scores 0 with others like it; vectors with different numbers
    of components are not compared. A repeated row is a row of its own, as an anchor, as a positive and as a negative.
    An anchor without another row of its label, or without a negative in bounds, has no rows; an empty table gives none.
    Components beyond 64 bits become the largest or least such number, scores likewise. Other columns play no part.
    """
    data = cut(labelled_vectors(table, scale).withColumn("uid", F.monotonically_increasing_id()))
    anchors = data.where(F.col("vec_id") % every == 0).select(F.col("uid").alias("a_uid"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("dim").alias("a_dim"), F.col("v").alias("a"))
    found = _ranked(_meet(anchors, data, ["dim", "label"], _find_positives(positives), _POSITIVES, block, chunk), ["a_uid"], positives)
    own = found.groupBy("a_uid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("p"), "vec_id", "score"))).alias("positives"))
    armed = cut(anchors.join(own, "a_uid"))
    best = _ranked(_meet(armed, data, ["dim"], _find_negatives(negatives, low, high), _NEGATIVES, block, chunk), ["a_uid", "p"], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql(positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: int = SCALE) -> str:
    """All pairs of anchors and rows in DuckDB SQL, for vectors of one dimension whose scores stay below 2**53."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS ar, d.r, d.vec_id, a.label = d.label AS same, CAST(list_inner_product(a.v, d.v) AS BIGINT) AS score FROM v a JOIN v d ON a.r <> d.r WHERE a.vec_id % {every} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS p FROM s WHERE same) WHERE p <= {positives}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND {low} * p.score <= 100 * s.score AND 100 * s.score <= {high} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
