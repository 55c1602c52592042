"""Near-duplicates (operator 5) by ProbMinHash, banding and verification.

A text is a weighted set of shingles, five words each, weighted by how often
they occur (a text of one to four words is one shingle). Each shingle has a
Poisson process of arrivals whose rate is its weight; every arrival falls in a
register, and a register keeps the shingle that arrived first. Two texts agree
in a register with the probability of their probability Jaccard similarity.
A shingle's process ends as soon as it cannot be first anywhere.

Texts that are equal are one node. Bands of registers put nodes into buckets;
in a bucket every node is held against the least one, so a large group of
copies costs as many comparisons as it has members. Pairs whose registers agree
enough are verified exactly, from whole texts. What is left are pairs of a bucket
in different components: those of its outsiders, the members outside the component
that most of its members are in. Outsiders meet all members in blocks, in which
only outsiders are repeated, so no link of a bucket is lost; a block gives the
links that connect its parts, not every similar pair. Classes are connected
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import cut, unused
from evalframe.llm.components import components
from evalframe.llm.textblocks import Block, blocks, mix, span_hash, windows

WORDS, THRESHOLD = 5, 0.8
#: 24 bands of 5 registers: two texts with similarity 0.8 share a bucket with probability 0.99993.
BANDS, ROWS = 24, 5
#: Registers in all; those beyond the bands sharpen the estimate.
REGISTERS = 2 * BANDS * ROWS
#: Share of equal registers from which a pair is verified: 4.6 standard deviations below 0.8.
AGREE = 0.68
#: Members of a bucket, or bytes of their texts, that one task holds against as many outsiders at a time, about.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_STEP = np.uint64(0xD1B54A32D192ED03)


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each distinct shingle of the texts of a block, by owner and hash."""
    a, e, owner = b.words()
    h = span_hash(b.prefix_hash(), a, e)
    at, g = windows(owner, h, WORDS)
    owners = owner[at]
    n = np.bincount(owner, minlength=len(b))
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        first = np.searchsorted(owner, short)
        s = np.full(len(short), 77, np.uint64)
        for j in range(WORDS - 1):
            s = np.where(n[short] > j, mix(s * np.uint64(31) + h[np.minimum(first + j, len(h) - 1)]), s)
        owners, g = np.concatenate([owners, short]), np.concatenate([g, s])
    order = np.lexsort((g, owners))
    owners, g = owners[order], g[order]
    new = np.append(True, (owners[1:] != owners[:-1]) | (g[1:] != g[:-1]))[: len(g)]
    start = np.flatnonzero(new)
    return owners[start], g[start], np.diff(np.append(start, len(g)))


def signatures(n: int, owner: np.ndarray, item: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of n weighted sets, as 16 bits of the item that is first in each register."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint16)
    time = np.zeros(len(owner))
    weight = weight.astype(float)
    bits = (mix(item + np.uint64(99)) >> np.uint64(48)).astype(np.uint16)
    j = np.uint64(0)
    while len(owner):
        j += np.uint64(1)
        u = mix(item + np.full(1, j) * _STEP)
        time = time - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        last = first.reshape(n, registers).max(1)
        going = np.flatnonzero(time < last[owner])
        owner, item, weight, time, bits, u = owner[going], item[going], weight[going], time[going], bits[going], u[going]
        slot = owner * registers + (mix(u + np.uint64(7)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        kept[slot[won]] = bits[won]
    return kept.reshape(n, registers)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key")
        for b in blocks(batch.column("text")):
            owner, item, weight = shingles(b)
            kept = signatures(len(b), owner, item, weight)
            some = np.isin(np.arange(len(b)), owner)
            size = pa.array(b.end - b.start, pa.int64())
            yield pa.RecordBatch.from_arrays([ids[b.rows], keys[b.rows], pa.array([kept[i].tobytes() if some[i] else None for i in range(len(b))], pa.binary()), size], ["doc_id", "key", "sig", "bytes"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted items, weights): sum over the common items x of
    1 / sum over all y of max(a[y] / a[x], b[y] / b[x])."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    u, v = a[1].astype(float), b[1].astype(float)
    x, y = u[i], v[j]
    # for the ratio r = a[x] / b[x] the sum is (1 / a[x]) * sum of max(a[y], r * b[y]): a[y] where a[y] / b[y] >= r
    r = x / y
    order = np.argsort(r, kind="stable")
    x, y, r = x[order], y[order], r[order]
    above = np.append(np.cumsum(x[::-1])[::-1], 0)
    below = np.append(0, np.cumsum(y))
    at = np.searchsorted(r, r, side="left")
    alone_a, alone_b = u.sum() - x.sum(), v.sum() - y.sum()
    total = alone_a + above[at] + r * (alone_b + below[at])
    return float((x / total).sum())


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items and weights of each text."""
    for b in blocks(column):
        owner, item, weight = shingles(b)
        cuts = np.searchsorted(owner, np.arange(len(b) + 1))
        yield from ((item[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]) for i in range(len(b)))


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                keep = pa.array([similarity(x, y) >= threshold - 1e-12 for x, y in zip(_sets(part.column("text_a")), _sets(part.column("text_b")))], pa.bool_())
                yield part.select(["a", "b"]).filter(keep)

    return run


def _agreeing(agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= agree))

    return run


def _near(m: list, centre: int, band: int, agree: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a group that may be linked: a repeated outsider (``probe``) and a member, as places in ``m``, and their agreement.

    They are in different components, neither is the centre, and their registers agree enough; a pair that shares an
    earlier band's bucket was or is compared there. Two outsiders meet twice and are compared once.
    """
    node, label, probe, out = (np.array([x[k] for x in m]) for k in ("node", "label", "probe", "outsider"))
    sig = np.frombuffer(b"".join(bytes(x["sig"]) for x in m), np.uint16).reshape(len(m), -1)
    for i in np.flatnonzero(probe & (node != centre)).tolist():
        at = np.flatnonzero(~probe & (label != label[i]) & (node != centre) & (~out | (node > node[i])))
        same = sig[at] == sig[i]
        share = same.mean(1)
        at, same, share = (x[share >= agree] for x in (at, same, share))
        first = same[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2).argmax(1)
        at, share = at[first == band], share[first == band]
        if len(at):
            yield np.full(len(at), i), at, share


_GROUP = ["band", "i", "centre", "block", "against"]
_MEMBER = ["node", "label", "probe", "outsider"]


def _involved(agree: float):
    """Members with a pair to verify, once for each group; not the pairs, of which there may be very many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                at = {int(k) for a, b, _ in _near(r.members, r.centre, r.i, agree) for k in (*a[:1], *b)}
                out += [(*(getattr(r, c) for c in _GROUP), *(r.members[k][c] for c in _MEMBER)) for k in sorted(at)]
            yield pd.DataFrame(out, columns=[*_GROUP, *_MEMBER])

    return run


def _forest(threshold: float, agree: float):
    """Links of a group that connect what its similar pairs connect: at most one less than it has members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                m = list(r.members)
                pairs = [np.concatenate(x) for x in zip(*_near(m, r.centre, r.i, agree))]
                if not pairs:
                    continue
                sets = list(_sets(pa.array([x["text"] for x in m], pa.string())))
                part = {x["label"]: x["label"] for x in m}

                def root(k: int) -> int:
                    while part[k] != k:
                        part[k] = part[part[k]]
                        k = part[k]
                    return k

                for k in np.argsort(-pairs[2], kind="stable"):
                    a, b = pairs[0][k], pairs[1][k]
                    x, y = root(m[a]["label"]), root(m[b]["label"])
                    if x != y and similarity(sets[a], sets[b]) >= threshold - 1e-12:
                        part[max(x, y)] = min(x, y)
                        out.append((m[a]["node"], m[b]["node"]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _groups(labelled: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members of buckets that span components, dealt to groups: (band, block of members, block of outsiders).

    ``labelled``: node, band, i, centre, label. A member is repeated for each block of its bucket's outsiders, mostly
    one; an outsider besides for each block of members.
    """
    own = labelled.groupBy("band", "label").agg(F.count("*").alias("k"))
    main = own.groupBy("band").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("band", "main")
    # registers come last, so that only what is dealt carries them
    rows = labelled.join(main, "band").withColumn("outsider", F.col("label") != F.col("main")).drop("main", "size")
    rows = cut(rows.join(sigs.select("node", "bytes"), "node"))
    out = F.col("outsider")
    sizes = rows.groupBy("band").agg(F.count("*").alias("m"), F.sum("bytes").alias("mb"), F.count_if(out).alias("o"), F.sum(F.when(out, F.col("bytes"))).alias("ob"))

    def parts(n: str, b: str):
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(b) / BLOCK_BYTES), F.lit(1)).cast("int")

    rows = rows.join(sizes.select("band", parts("m", "mb").alias("blocks"), parts("o", "ob").alias("others")), "band")
    place = F.xxhash64("node")
    columns = ["band", "i", "centre", "node", "label", "outsider"]
    member = rows.withColumns({"block": F.pmod(place, F.col("blocks")).cast("int"), "against": F.explode(F.sequence(F.lit(0), F.col("others") - 1)), "probe": F.lit(False)})
    probe = rows.where(out).withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "against": F.pmod(place, F.col("others")).cast("int"), "probe": F.lit(True)})
    return member.unionByName(probe).select(*columns, "block", "against", "probe").join(sigs.select("node", "sig"), "node")


def _nodes(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_signed, f"doc_id {kind}, key string, sig binary, bytes long")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max("sig").alias("sig"), F.max("bytes").alias("bytes"))
    # ids over written rows, so they are the same whenever they are read
    return cut(nodes).withColumn("node", F.monotonically_increasing_id())


#: Nodes at most that are broadcast to find their texts.
FEW = 20_000


def _texts(needed: DataFrame, nodes: DataFrame, docs: DataFrame, few: bool = False) -> DataFrame:
    """(node, text) of the needed nodes. A node's text is that of its least document.

    If they are expected to be ``few``, they are counted, and go to the documents instead of these to them.
    """
    own = needed.select("node").distinct().join(nodes, "node").select("node", F.col("key").alias("k"), F.col("doc_id").alias("d"))
    if few:
        own = cut(own)
        own = F.broadcast(own) if own.limit(FEW + 1).count() <= FEW else own
    texts = docs.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("node", "text")
    return cut(texts.dropDuplicates(["node"]))


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose texts are similar enough."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), "a long, b long"))


def _classes(docs: DataFrame, threshold: float, agree: float) -> DataFrame:
    """(key, doc_id, n, class): each distinct text, its least document, its number, and its class's node."""
    nodes = _nodes(docs)
    sigs = nodes.select("node", "sig", "bytes")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    bands = nodes.where("sig is not null").select("node", band.alias("i", "band"))
    centres = bands.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1")
    shared = cut(bands.join(centres, "band"))
    star = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    with_sigs = star.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = cut(with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(agree), "a long, b long"))
    links = _verify(pairs, nodes, docs, threshold)
    found = components(links)
    # what is left in buckets that span components
    labelled = shared.where("size > 2").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    groups = _groups(labelled, sigs)
    grouped = groups.groupBy(*_GROUP).agg(F.collect_list(F.struct(*_MEMBER, "sig")).alias("members")).where(F.exists("members", lambda x: x["probe"]))
    near = cut(grouped.mapInPandas(_involved(agree), "band long, i int, centre long, block int, against int, node long, label long, probe boolean, outsider boolean"))
    if not near.isEmpty():
        full = near.join(sigs.select("node", "sig"), "node").join(_texts(near, nodes, docs, few=True), "node")
        grouped = full.groupBy(*_GROUP).agg(F.collect_list(F.struct(*_MEMBER, "sig", "text")).alias("members"))
        more = grouped.mapInPandas(_forest(threshold, agree), "a long, b long")
        found = components(links.unionByName(cut(more)))
    return nodes.join(found, "node", "left").select("key", "doc_id", "n", F.coalesce("component", "node").alias("class"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, agree: float = AGREE) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every document.

    A class holds the documents linked by probability Jaccard similarity of ``threshold`` or more, directly or
    through others, and equal texts; ``class_id`` is its least doc_id, and the document with it is ``kept``. Pairs
    of a bucket whose share of equal registers is under ``agree`` are not verified; 0 verifies all of them.
    A null text is an empty one; texts without words are alike only if equal. Repeated rows are copies, and
    all carry ``kept`` (``deduplicated`` keeps one). A null doc_id never stands for a class unless all are
    null. An empty table gives an empty result; columns other than doc_id and text play no part.
    """
    keyed = _keyed(docs)
    texts = cut(_classes(keyed, threshold, agree))
    size = texts.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = texts.select("key", "class").join(size, "class").select("key", "class_id", "class_size")
    out = keyed.select("doc_id", "key").join(by_key, "key")
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, agree: float = AGREE) -> DataFrame:
    """One document of each class, that with the least doc_id, with all columns, whatever their names.

    A null text is an empty one, so one of all empty documents stays; of repeated rows one stays; an empty table
    stays empty.
    """
    key, d, k = unused(docs, "key", "doc_id", "text")
    texts = cut(_classes(_keyed(docs), threshold, agree))
    stay = texts.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s")).select(F.col("s.doc_id").alias(d), F.col("s.key").alias(k))
    own = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    # by document and text, so the copies of a text do not meet in one task
    rows = own.join(stay, own["doc_id"].eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)))
    return rows.dropDuplicates([d, k]).select(*docs.columns)
