"""Conversation prefix trie (operator 11) by padded matrices of turn ids.

A turn's id is 128 bits of the SHA-256 of its role and text; texts themselves are
never shuffled. Conversations are dealt to shards by ranges of their id sequences
(and, where these are equal, of conv_id), so that every node is a run of rows,
whatever a third of all conversations have in common. In a shard the sequences
are rows of a matrix, padded with zeros and cut into bands of columns; lexsort
puts them in order, change masks between neighbours, OR-accumulated along the
columns, mark where nodes start at each depth, and reduceat aggregates each depth.

Only the nodes on the paths of a shard's first and last row can reach beyond it.
These boundary nodes are few (two a depth and shard); they are recombined by keys,
and what lies below them in each shard is added up along its two paths. All others
are whole where they are found. The ids of the conversations that end at a
boundary node come in runs, one from each shard, which one task reads in order
while it computes their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.llm.common import cut, scratch_path

#: Turns of a shard, about, and columns of a matrix; ids of one run's piece.
SHARD_TURNS, BAND, PIECE_IDS = 1 << 18, 16, 512
NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FOUND = f"{_NODE}, shard int, branch int, key binary, parent_key binary, length long, piece string, kind string"
_COLUMNS = [f.split() for f in _FOUND.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def rebuilt(table: DataFrame, every: int = 100, cycle: int = 6) -> DataFrame:
    """(conv_id, ids, lengths): each conversation's turns behind the first ones of its group's first conversation.

    Conversations of a group of ``every`` ids are dealt together, which serves both the order of turns and the join.
    """
    c, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.substring(digest, 1, 16).alias("id"), F.length(text).cast("long").alias("length"))
    turns = table.where("conv_id is not null").select((c - c % every).alias("base"), c.alias("conv_id"), turn.alias("t")).repartition("base")
    own = turns.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    heads = own.where("conv_id = base").select("base", F.slice("t", 1, cycle - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % cycle).cast("int")
    first = F.coalesce(F.slice("head", F.lit(1), h), F.slice("t", 1, 0))
    whole = own.join(heads, "base", "left").select("conv_id", F.concat(first, F.slice("t", h + 1, F.size("t"))).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: t["id"]).alias("ids"), F.transform("t", lambda t: t["length"]).alias("lengths"))


class _Shard:
    """Sequences of ids in one array: row i has ``size[i]`` of them from ``begin[i]``."""

    def __init__(self, batches: list[pa.RecordBatch]):
        ids, lengths, size = [], [], []
        for b in batches:
            values = b["ids"].flatten()
            offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
            raw = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.zeros(0, np.uint8)
            ids.append(raw.reshape(-1, 16))
            lengths.append(b["lengths"].flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            size.append(b["ids"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids = np.concatenate(ids)
        self.key = self.ids.view(">u8").astype(np.uint64)
        self.length, self.size = np.concatenate(lengths), np.concatenate(size)
        self.begin = np.cumsum(self.size) - self.size
        self.conv = np.concatenate([b["conv_id"].to_numpy() for b in batches])

    def levels(self) -> tuple[np.ndarray, list[dict]]:
        """The rows in order, and for each depth its nodes: their first places in the order, numbers of rows, least conv_id, length of the last text."""
        n, size, conv = len(self.size), self.size, self.conv
        order = np.lexsort((conv, size > 0))
        levels = [{"at": np.zeros(1, np.int64), "n": np.array([n]), "conv": conv.min(keepdims=True), "length": np.zeros(1, np.int64)}]
        group, depth = np.zeros(n, np.int64), 0  # group: for each place, the node of this depth that it is in
        while len(place := np.flatnonzero(size[order] > depth)):
            rows = order[place]
            width = int(min(BAND, size[rows].max() - depth))
            have = np.minimum(size[rows] - depth, width)
            i = np.repeat(np.arange(len(rows)), have)
            j = np.arange(len(i)) - np.repeat(np.cumsum(have) - have, have)
            matrix = np.zeros((len(rows), width, 2), np.uint64)
            matrix[i, j] = self.key[self.begin[rows][i] + depth + j]
            columns = [matrix[:, d, half] for d in reversed(range(width)) for half in (1, 0)]
            by = np.lexsort((conv[rows], size[rows] > depth + width, *columns, group[place]))
            order[place] = rows = rows[by]
            matrix = matrix[by]
            changed = np.ones((len(rows), width + 1), bool)
            changed[1:, 0] = group[place][1:] != group[place][:-1]
            changed[1:, 1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
            changed = np.logical_or.accumulate(changed, axis=1)
            for d in range(width):
                inside = np.flatnonzero(size[rows] > depth + d)
                starts = np.flatnonzero(changed[inside, d + 1])
                top = rows[inside[starts]]
                levels.append({
                    "at": place[inside[starts]], "n": np.add.reduceat(np.ones(len(inside), np.int64), starts),
                    "conv": np.minimum.reduceat(conv[rows[inside]], starts), "length": self.length[self.begin[top] + depth + d],
                })
            group[place] = np.cumsum(changed[:, width])
            depth += width
        return order, levels

    def path(self, row: int) -> list[bytes]:
        """The keys of the nodes on a row's path, from the root."""
        h, raw = hashlib.sha256(), self.ids[self.begin[row] : self.begin[row] + self.size[row]].tobytes()
        keys = [h.digest()]
        for i in range(0, len(raw), 16):
            h.update(raw[i : i + 16])
            keys.append(h.digest())
        return keys


def _batch(n: int, **columns) -> pa.RecordBatch:
    """Rows of the shard's result; columns that are not given are null."""
    arrays = [pa.array(columns[c], _ARROW[k]) if c in columns else pa.nulls(n, _ARROW[k]) for c, k in _COLUMNS]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in _COLUMNS])


def _boundary(depth: int, count: int, first: list[bytes], last: list[bytes]) -> dict[int, tuple[int, bytes]]:
    """The nodes of a depth that can reach beyond the shard, with their keys and paths: 0 both, 1 the first row's, 2 the last row's."""
    out = {}
    if depth < len(last):
        out[count - 1] = (2, last[depth])
    if depth < len(first):
        out[0] = (0 if depth < len(last) and last[depth] == first[depth] else 1, first[depth])
    return out


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole nodes ("node"), parts of boundary nodes ("edge"), and runs of the ids that end at these ("piece")."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    shard, number = _Shard(got), got[0]["shard"][0].as_py()
    order, levels = shard.levels()
    first, last = shard.path(order[0]), shard.path(order[-1])
    size = shard.size[order]
    by_size = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[by_size], np.arange(len(levels) + 1))
    below = None  # of the next depth's nodes: their parents, and what they add to these
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        count = len(level["at"])
        edge = _boundary(depth, count, first, last)
        inner = np.ones(count, bool)
        inner[list(edge)] = False
        if below is None:
            n_children, leaves, saved = (np.zeros(count, np.int64) for _ in range(3))
        else:
            bounds = np.searchsorted(below[0], np.arange(count + 1))  # children are in the order of their parents
            n_children, leaves, saved = (np.diff(np.append(0, np.cumsum(x))[bounds]) for x in below[1:])
        # of boundary nodes only what lies below them is known here, and not which of their children are boundary nodes
        leaves = leaves + (inner & (n_children == 0))
        saved = saved + np.where(inner, (level["n"] - 1) * level["length"], 0)
        # conversations that end here are the first of their node's rows, in order of conv_id
        done = by_size[cuts[depth] : cuts[depth + 1]]
        of = np.searchsorted(level["at"], done, side="right") - 1
        runs = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
        digests: dict[int, str] = {}
        for lo, hi in zip(runs, [*runs[1:], len(of)]):
            node, convs = int(of[lo]), shard.conv[order[done[lo:hi]]].tolist()
            if node in edge:
                parts = [convs[i : i + PIECE_IDS] for i in range(0, len(convs), PIECE_IDS)]
                yield _batch(len(parts), kind=["piece"] * len(parts), shard=[number] * len(parts), key=[edge[node][1]] * len(parts), conv_id=[p[0] for p in parts], piece=[",".join(map(str, p)) for p in parts])
            else:
                digests[node] = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
        at = np.flatnonzero(inner)
        parent = np.searchsorted(levels[depth - 1]["at"], level["at"], side="right") - 1 if depth else np.zeros(1, np.int64)
        if len(at):
            above = {i: key for i, (_, key) in _boundary(depth - 1, len(levels[depth - 1]["at"]), first, last).items()}
            far = np.isin(parent[at], list(above))
            yield _batch(
                len(at), kind=["node"] * len(at), shard=np.full(len(at), number, np.int32), conv_id=level["conv"][at], depth=np.full(len(at), depth), n_convs=level["n"][at],
                parent_conv_id=pa.array(levels[depth - 1]["conv"][parent[at]], pa.int64(), mask=far), parent_key=[above[p] if f else None for p, f in zip(parent[at].tolist(), far.tolist())],
                n_children=n_children[at], n_leaves=leaves[at], saved_tokens=saved[at], ends_sha256=[digests.get(i, NONE) for i in at.tolist()],
            )
        for i, (branch, key) in edge.items():
            up = (first if branch < 2 else last)[depth - 1] if depth else None
            sums = {n: [int(x[i])] for n, x in (("conv_id", level["conv"]), ("n_convs", level["n"]), ("n_children", n_children), ("n_leaves", leaves), ("saved_tokens", saved), ("length", level["length"]))}
            yield _batch(1, kind=["edge"], shard=[number], branch=[branch], key=[key], parent_key=[up], depth=[depth], **sums)
        below = (parent, inner.astype(np.int64), leaves, saved)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, which come in order, joined by commas."""
    key, h = None, None
    done = lambda: pa.RecordBatch.from_pydict({"key": [key], "digest": [h.hexdigest()]}, pa.schema([("key", pa.binary()), ("digest", pa.string())]))
    for b in batches:
        for k, piece in zip(b["key"].to_pylist(), b["piece"].to_pylist()):
            if k == key:
                h.update(b",")
            else:
                if key is not None:
                    yield done()
                key, h = k, hashlib.sha256()
            h.update(piece.encode())
    if key is not None:
        yield done()


def _recombined(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """The boundary nodes with their parts in all shards added up, by key."""
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    total = edges.groupBy("key").agg(*[F.sum(c).alias(c) for c in names], F.min("conv_id").alias("conv_id"), F.min("shard").alias("owner"), *[F.max(c).alias(c) for c in ("depth", "parent_key", "length")])
    kids = edges.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count_distinct("key").alias("more"))
    total = cut(total.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # what the boundary nodes themselves add: each once, in its first shard, where it counts for all above it on the shard's two paths
    own = total.select("key", "owner", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("length")).alias("save"))
    mine = F.col("shard") == F.col("owner")
    path = edges.select("shard", "branch", "depth", "key").join(own, "key").select("shard", "branch", "depth", "key", *[F.when(mine, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "save")])
    # up to a depth of what both rows share, all of what they do not share lies below it
    branch = Window.partitionBy("shard", "branch").orderBy(F.col("depth").desc())
    both = Window.partitionBy("shard").orderBy(F.when(F.col("branch") == 0, -F.col("depth")))
    shared = F.col("branch") == 0
    sums = path.select("key", *[F.when(shared, F.sum(c).over(both)).otherwise(F.sum(c).over(branch)).alias(c) for c in ("leaf", "save")])
    added = sums.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
    digest = pieces.select("key", "conv_id", "piece").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, digest string")
    up = total.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = total.join(added, "key").join(digest, "key", "left").join(up, "parent_key", "left")
    return out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("save")).alias("saved_tokens"), F.coalesce("digest", F.lit(NONE)).alias("ends_sha256"))


def trie(spark: SparkSession, table: DataFrame, shard_turns: int = SHARD_TURNS, every: int = 100, cycle: int = 6) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    Rows with a null conv_id belong to no conversation. Turns go by ``turn``, null first; those alike in it by their
    ids, so that repeated rows are turns of their own. A null role or text is an empty one. Conversations without turns
    are members of the root alone. A table without conversations has no node, not even a root. Texts of any length are
    read once, as ids. A conversation's ids are held in one task, about 100 bytes a turn. Other columns play no part.
    """
    rows = cut(rebuilt(table.select("conv_id", "turn", "role", "text"), every, cycle))
    turns = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(-(-turns // shard_turns), int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "trie")
    dealt = rows.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    dealt.mapInArrow(_shard_nodes, _FOUND).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(_FOUND).parquet(path)
    edges = found.where("kind = 'edge'").select("shard", "branch", "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "length")
    whole = cut(_recombined(edges, found.where("kind = 'piece'")))
    columns = [f.split()[0] for f in _NODE.split(", ")]
    nodes = found.where("kind = 'node'")
    # a shard's nodes below its boundary nodes get these nodes' final least member
    known = edges.select("shard", "key").join(whole.select("key", F.col("conv_id").alias("up")), "key").withColumnRenamed("key", "parent_key")
    tops = nodes.where("parent_key is not null").drop("parent_conv_id").join(known, ["shard", "parent_key"]).withColumnRenamed("up", "parent_conv_id")
    return nodes.where("parent_key is null").select(*columns).unionByName(tops.select(*columns)).unionByName(whole.select(*columns))


def oracle_sql(every: int = 100, cycle: int = 6) -> str:
    """The same nodes in DuckDB SQL, from the prefixes of all conversations; turns alike in ``turn`` are not told apart there."""
    bits = "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda k: CAST(ord(k) AS BIGINT))), lambda a, b: {bits}), 4294967295)"
    return f"""
WITH turns AS (SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'id': id, 'n': n}} ORDER BY turn NULLS FIRST) AS t, {crc} % {cycle} AS h FROM turns GROUP BY conv_id),
whole AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, o.h), list_slice(o.t, o.h + 1, len(o.t))) AS t FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {every}),
seq AS (SELECT conv_id, list_transform(t, lambda x: x.id) AS ids, list_transform(t, lambda x: x.n) AS ns FROM whole),
steps AS (SELECT conv_id, ids, ns, unnest(range(len(ids) + 1)) AS d FROM seq),
nodes AS (SELECT list_slice(ids, 1, d) AS key, CAST(d AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN any_value(ns[d]) ELSE 0 END AS n,
  sha256(coalesce(string_agg(CASE WHEN len(ids) = d THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM steps GROUP BY list_slice(ids, 1, d), d),
kids AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
each AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.key = nodes.key),
up AS (SELECT unnest(range(depth + 1)) AS d, key, n_children, (n_convs - 1) * n AS saved FROM each),
sums AS (SELECT list_slice(key, 1, d) AS key, count(CASE WHEN n_children = 0 THEN 1 END) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY list_slice(key, 1, d))
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM each e JOIN sums s ON s.key = e.key LEFT JOIN nodes p ON p.key = list_slice(e.key, 1, e.depth - 1) AND e.depth > 0"""
