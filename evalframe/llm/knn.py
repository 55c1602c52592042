"""Exact top-k search (operator 6): a Voronoi kNN join for integer inner products.

Data and queries are grouped by the nearest of a bounded set of pivots. A
summary of each group (its radius about the pivot, its count) bounds what any
of its vectors can score with a query q: q.p + |q| * radius. Queries are first
answered in their own group, which gives each a threshold, its k-th score so
far. Only then a query is sent to other groups, to those whose bound reaches
its threshold, and there only vectors far enough from the pivot are scored:
q.p + |q| * |x - p| must reach it too. Groups are cut into blocks by hash, and the
queries of a group into chunks, so that one that a third of all vectors share is
spread over many tasks. Chunks are of all queries that search a group, whatever their own: a vector is
shuffled once for each 2,048 of these. Each block answers with its own best k for each query, and
the best k of these are the result: a limit in groups, which Spark applies before
it shuffles answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import cut, with_few

#: Pivots at most; the sample they come from is this many distinct vectors, by hash order.
PIVOTS = 64
#: Vectors of a block, and queries of a chunk, about.
BLOCK_ROWS, CHUNK_ROWS = 4096, 2048
SCALE = 1024


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v, copy): components times 1024, rounded down, of vectors without null or non-finite components.

    Rows equal in id and vector are told apart by ``copy``.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = table.where(valid).select("vec_id", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))


def _pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivots for each number of dimensions: far-apart vectors of a bounded sample."""
    sample = vectors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(8 * count).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    out = {}
    for dim, rows in by_dim.items():
        x = np.array(rows, float)
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        # the middle of each chosen vector's share of the sample is a better centre than the vector
        nearest = ((x[:, None, :] - x[chosen][None]) ** 2).sum(2).argmin(1)
        out[dim] = np.array([x[nearest == i].mean(0) for i in range(len(chosen))])
    return out


def _centre(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots for vectors of a dimension; those outside the sample have the origin."""
    return pivots[dim] if dim in pivots else np.zeros((1, dim))


def _grouped(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            dims = df["v"].map(len).to_numpy()
            cell, far = np.zeros(len(df), np.int64), np.zeros(len(df))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, p = np.stack(df["v"].to_numpy()[at]).astype(float), _centre(pivots, dim)
                d = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
                cell[at] = d.argmin(1)
                far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
            yield df.assign(dim=dims.astype(np.int64), cell=cell, far=far)

    return run


def _search(k: int, pivots: dict[int, np.ndarray]):
    """Best k of one block for each query that was sent to it."""

    def run(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in (("q_id", pa.int64()), ("q_key", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        if not len(queries) or not len(data):
            return empty
        dim, cell = key[0].as_py(), key[1].as_py()
        x = data["v"].combine_chunks().values.to_numpy().reshape(-1, dim)
        far = data["far"].to_numpy()
        order = np.argsort(-far, kind="stable")
        x, far = x[order], far[order]
        ids, copies = data["vec_id"].to_numpy()[order], data["copy"].to_numpy()[order]
        qv = queries["q"].combine_chunks().values.to_numpy().reshape(-1, dim)
        q_ids, q_copies, keys, least = queries["q_id"].to_numpy(), queries["q_copy"].to_numpy(), queries["q_key"].to_pylist(), queries["least"].to_numpy(zero_copy_only=False)
        p = _centre(pivots, dim)[cell]
        # sums below 2**53 are exact in floating point, and much faster
        exact = float(np.abs(x.astype(float)).max()) * float(np.abs(qv.astype(float)).max()) * dim < 2.0**53
        xs = x.astype(float) if exact else x
        out: list[tuple] = []
        size = max(1, (1 << 21) // max(1, len(x)))
        for lo in range(0, len(qv), size):
            part = slice(lo, lo + size)
            q = qv[part]
            norm = np.sqrt((q.astype(float) ** 2).sum(1))
            need = (least[part] - q @ p - 1e-6 * np.abs(least[part]) - 1) / np.maximum(norm, 1e-12)
            need = np.where(np.isnan(need), -np.inf, need)
            n = int(np.searchsorted(-far, -need.min(), side="right"))  # vectors nearer to the pivot cannot reach any threshold
            if not n:
                continue
            scores = ((q.astype(float) @ xs[:n].T).astype(np.int64)) if exact else q @ x[:n].T
            for i in range(len(q)):
                j, s = lo + i, scores[i]
                keep = np.arange(n)
                if n > k + 1:
                    # all that score as the (k+1)-th or more: ties are settled by id, and the query itself may be one
                    keep = np.flatnonzero(s >= np.partition(s, n - k - 1)[n - k - 1])
                own = keep[(ids[keep] == q_ids[j]) & (copies[keep] == q_copies[j])]
                own = [m for m in own if np.array_equal(x[m], q[i])]
                keep = keep[~np.isin(keep, own)]
                best = keep[np.lexsort([ids[keep], -s[keep]])][:k]
                out += [(int(q_ids[j]), keys[j], int(ids[m]), int(s[m])) for m in best]
        if not out:
            return empty
        cols = list(zip(*out))
        return pa.table({"q_id": pa.array(cols[0], pa.int64()), "q_key": pa.array(cols[1], pa.string()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return run


def _sizes(sent: DataFrame, summary: DataFrame, chunk_rows: int) -> DataFrame:
    """(dim, cell, blocks, chunks) of the cells that queries are sent to: each of a cell's vectors is shuffled ``chunks`` times."""
    chunks = sent.groupBy("dim", "cell").agg(F.ceil(F.count("*") / chunk_rows).cast("long").alias("chunks"))
    return summary.select("dim", "cell", "blocks").join(chunks, ["dim", "cell"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k answers of each query with their ranks."""
    w = Window.partitionBy("q_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by ``every``. Ties go to the smaller vec_id. Vectors with
    different numbers of components are not compared. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows with a null id. A repeated row is a row of its own: it is a candidate for
    its copies and, as a query, is answered as often as it occurs. An empty table gives an empty result; other
    columns play no part.
    """
    vectors = cut(integer_vectors(table.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")))
    centres = _pivots(vectors, pivots)
    data = cut(vectors.mapInPandas(_grouped(centres), "vec_id long, v array<long>, copy long, dim long, cell long, far double"))
    # at most ``pivots`` groups for each number of dimensions in the sample, and one for each other
    summary = data.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    summary = cut(summary.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long")))
    queries = data.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.col("copy").alias("q_copy"), "dim", F.col("cell").alias("home"))
    queries = cut(queries.withColumn("q_key", F.concat_ws("/", "q_id", "q_copy", F.sha2(F.to_json("q"), 256))))
    answer = _search(k, centres)
    schema = "q_id long, q_key string, vec_id long, score long"

    def search(sent: DataFrame) -> DataFrame:
        """Queries with their cell go to all blocks of it. Those of one cell go together, in chunks, and a block once to each chunk."""
        sizes = cut(_sizes(sent, summary, chunk_rows))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        to = with_few(sent, sizes, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("q_key"), F.col("chunks"))).withColumn("block", upto("blocks"))
        keys = ["dim", "cell", "block", "chunk"]
        left = to.select(*[F.col(c).alias(f"to_{c}") for c in keys], "q_id", "q_copy", "q_key", "q", "least")
        own = with_few(data, sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v", "copy"), F.col("blocks")))
        right = own.withColumn("chunk", upto("chunks")).select(*keys, "vec_id", "copy", "v", "far")
        return left.groupBy(*[f"to_{c}" for c in keys]).cogroup(right.groupBy(*keys)).applyInArrow(answer, schema)

    home = cut(_best(search(queries.withColumn("cell", F.col("home")).withColumn("least", F.lit(float("-inf")))), k))
    known = queries.join(home.where(F.col("rank") == k).select("q_key", F.col("score").cast("double").alias("least")), "q_key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    # the query's product with each centre and its length, against the groups' radii; dimensions outside the sample have one group
    radii = summary.where(F.col("dim").isin(list(centres))).select("dim", "cell", "radius").collect()
    away = cut(known.where(F.col("dim").isin(list(centres))).mapInPandas(_sent(centres, radii), "dim long, cell long, q_key string"))
    others = search(away.join(known.drop("dim"), "q_key"))
    final = _best(home.select("q_id", "q_key", "vec_id", "score").unionByName(others), k)
    return final.select(F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _sent(pivots: dict[int, np.ndarray], summary: list):
    """Each query with the groups, other than its own, whose bound reaches its threshold."""
    radius: dict[int, dict[int, float]] = {}
    for r in summary:
        radius.setdefault(r.dim, {})[r.cell] = r.radius

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            dims, v = df["dim"].to_numpy(), df["q"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                q = np.stack(v[at]).astype(float)
                cells = np.array(sorted(radius[dim]))
                p, r = _centre(pivots, dim)[cells], np.array([radius[dim][c] for c in cells])
                bound = q @ p.T + np.sqrt((q * q).sum(1))[:, None] * r
                least, home = df["least"].to_numpy()[at], df["home"].to_numpy()[at]
                reach = (bound * (1 + 1e-9) + 1 >= least[:, None]) & (cells[None] != home[:, None])
                i, c = np.nonzero(reach)
                yield pd.DataFrame({"dim": int(dim), "cell": cells[c], "q_key": df["q_key"].to_numpy()[at][i]})

    return run


def oracle_sql(k: int = 10, every: int = 100) -> str:
    """All pairs of queries and rows in DuckDB SQL, for vectors of one dimension whose scores stay below 2**53."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.r, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {k}"""
