"""Best-fit packing (operator 1) with swap-based local search.

Documents become token ids plus an end id; only longer ones are cut into
pieces of ``capacity``. What matters for packing is how many pieces there are
of each length, at most ``capacity`` numbers. From that histogram the driver
makes a plan by best fit, longest first, over groups of equal bins, then improves
it by local search: a document of an underfull bin moves to a fuller one, or is
exchanged for a shorter one, or two for a shorter one, or one for two that are
shorter; each step takes tokens from a less full bin to a fuller one, which
increases the sum of squared fills, until a bin is empty. Steps apply to whole
groups of equal bins, so the plan's size depends on the number of lengths, not on
that of documents.

Spark then gives the pieces of each length their places: it ranks them within
(length, bucket), buckets being as many as the length's pieces need, and offsets
buckets by counts, so that a length that a third of all pieces share is spread
over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import cut
from evalframe.llm.tokens import default_path, tokenizer

CAPACITY = 4096
END_ID = 1
#: Rows of one rank window at most, about, and buckets whose counts are summed in one task.
BUCKET_ROWS, BUCKETS = 4000, 1000


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, len(batch), 500):
                texts = [t or "" for t in batch.column(1).slice(lo, 500).to_pylist()]
                rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for i, raw in enumerate(encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    for p, at in enumerate(range(0, n, capacity)):
                        part = raw[4 * at : 4 * min(n, at + capacity)]
                        rows["row"].append(lo + i)
                        rows["piece"].append(p)
                        rows["start"].append(at)
                        rows["length"].append(len(part) // 4)
                        rows["crc"].append(zlib.crc32(part))
                        if with_ids:
                            rows["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                out = [ids.take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text; ``with_ids`` adds the ids themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path or default_path(), capacity, with_ids), schema)


@dataclass
class Bins:
    """``count`` equal bins with ``room`` left; ``items`` has the documents of each as length -> number."""

    count: int
    room: int
    items: dict[int, int]


def best_fit(histogram: dict[int, int], capacity: int, seed: int | None = None) -> list[Bins]:
    """Best fit on counts of lengths, longest first or in a seeded order: each document goes to the fullest bin that can take it."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(b: Bins) -> None:
        if b.room not in by_room:
            by_room[b.room] = []
            insort(rooms, b.room)
        by_room[b.room].append(b)

    for length in sorted(histogram, key=(lambda x: -x) if seed is None else (lambda x: x * seed % (1 << 32))):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                bins = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    del by_room[rooms.pop(at)]
            else:
                bins = Bins(-(-left // (capacity // length)), capacity, {})
            each = bins.room // length  # the bin just served is the fullest that can take the next one
            full = min(bins.count, left // each)
            if full:
                put(Bins(full, bins.room - each * length, bins.items | {length: bins.items.get(length, 0) + each}))
                left -= full * each
            rest = bins.count - full
            if rest and left and left < each:
                put(Bins(1, bins.room - left * length, bins.items | {length: bins.items.get(length, 0) + left}))
                left, rest = 0, rest - 1
            if rest:
                put(Bins(rest, bins.room, bins.items))
    return [b for group in by_room.values() for b in group]


def _exchanged(items: dict[int, int], out: tuple[int, ...], into: tuple[int, ...]) -> dict[int, int]:
    new = dict(items)
    for x in out:
        new[x] -= 1
        if not new[x]:
            del new[x]
    for x in into:
        new[x] = new.get(x, 0) + 1
    return new


def _improvement(donor: Bins, other: Bins) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What the donor gives and gets back so that the other bin, which is no less full, gains most; None if nothing fits."""
    room, best, gain = other.room, None, 0
    mine, theirs = sorted(donor.items, reverse=True), sorted(other.items)
    for x in mine:  # a move
        if gain < x <= room:
            best, gain = ((x,), ()), x
    for x in mine:  # one for one: the longest gain within the room
        at = bisect_left(theirs, x - room)
        if at < len(theirs) and 0 < x - theirs[at] <= room and x - theirs[at] > gain:
            best, gain = ((x,), (theirs[at],)), x - theirs[at]
    for i, x in enumerate(mine):  # two for one
        for y in mine[i:]:
            if x == y and donor.items[x] < 2:
                continue
            at = bisect_left(theirs, x + y - room)
            if at < len(theirs) and 0 < x + y - theirs[at] <= room and x + y - theirs[at] > gain:
                best, gain = ((x, y), (theirs[at],)), x + y - theirs[at]
    for x in mine:  # one for two
        for y in theirs:
            if 2 * y >= x or gain >= room:
                break
            at = bisect_left(theirs, max(x - room - y, y))
            if at < len(theirs) and theirs[at] == y and other.items[y] < 2:
                at += 1
            if at < len(theirs) and 0 < x - y - theirs[at] <= room and x - y - theirs[at] > gain:
                best, gain = ((x,), (y, theirs[at])), x - y - theirs[at]
    return best


def least_bins(bins: list[Bins], capacity: int) -> int:
    """Bins that any packing needs: for each limit up to half the capacity, documents over half of it are one to a
    bin, and those from the limit to the half fill only what these leave."""
    n = np.zeros(capacity + 1, np.int64)
    for b in bins:
        for x, k in b.items.items():
            n[x] += k * b.count
    number, tokens = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1)))
    half = capacity // 2
    limit = np.arange(half + 1)
    middle = number[capacity - limit + 1] - number[half + 1]  # over the half, and a document of the limit fits beside
    free = middle * capacity - (tokens[capacity - limit + 1] - tokens[half + 1])
    small = tokens[half + 1] - tokens[limit]
    return int(number[-1] - number[half + 1] + np.maximum(0, -((free - small) // capacity)).max())


def local_search(bins: list[Bins], capacity: int) -> list[Bins]:
    """Moves and exchanges between underfull bins until no bin more can be emptied.

    The emptiest group of bins gives, those no emptier take; each step increases the sum of squared fills. It ends
    at the least possible number of bins, or when no two groups, whether or not tried before, allow a step. A group
    is tried only with those that are new since it was tried last, since a pair without a step never gets one.
    """
    least, total = least_bins(bins, capacity), sum(b.count for b in bins)
    done = [b for b in bins if not b.room]
    under: list[Bins] = []
    known: dict[tuple, Bins] = {}
    log: list[Bins] = []  # groups in the order in which they came
    tried: dict[int, int] = {}  # how much of the log each group has been tried with

    def put(b: Bins) -> None:
        if not b.room:
            done.append(b)
            return
        key = tuple(sorted(b.items.items()))
        same = known.get(key)
        if same is None:
            known[key] = b
            insort(under, b, key=lambda x: x.room)
            tried[id(b)] = 0
            log.append(b)
        else:
            if same.count == 1:
                log.append(same)  # now it may exchange with its like
            same.count += b.count

    def take(b: Bins, n: int) -> None:
        b.count -= n
        if not b.count:
            del known[tuple(sorted(b.items.items()))], tried[id(b)]
            at = bisect_left(under, b.room, key=lambda x: x.room)
            while under[at] is not b:
                at += 1
            del under[at]

    for b in bins:
        if b.room:
            put(Bins(b.count, b.room, b.items))
    while total > least:
        for donor in reversed(under):
            since = tried[id(donor)]
            if since == len(log):
                continue
            others = [b for b in log[since:] if b.count and b.room <= donor.room] if since else under[: bisect_right(under, donor.room, key=lambda x: x.room)]
            for other in others:
                if other is donor and donor.count < 2:
                    continue
                found = _improvement(donor, other)
                if found is not None:
                    break
            else:
                tried[id(donor)] = len(log)
                continue
            break
        else:
            break  # a whole pass improves nothing
        out, into = found
        n = donor.count // 2 if other is donor else min(donor.count, other.count)
        gain = sum(out) - sum(into)
        given, taken = _exchanged(donor.items, out, into), _exchanged(other.items, into, out)
        rooms = donor.room + gain, other.room - gain
        take(donor, n)
        take(other, n)
        put(Bins(n, rooms[1], taken))
        if given:
            put(Bins(n, rooms[0], given))
        else:
            total -= n
    return done + under


def packed(histogram: dict[int, int], capacity: int, seed: int | None = None) -> list[Bins]:
    """The bins at which the search ends, from best fit with the longest first, or in a seeded order.

    A seeded start leaves the search more to repair: it ends as low, or nearly, but takes many times as long.
    """
    return local_search(best_fit(histogram, capacity, seed), capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places for the pieces of each length: rank ``first`` and on go to bins from ``bin`` on, ``each`` to a bin, from ``offset`` on."""
    rows, taken, base = [], dict.fromkeys(histogram, 0), 0
    for b in packed(histogram, capacity):
        at = 0
        for length, each in sorted(b.items.items(), reverse=True):
            rows.append((length, taken[length], each, base, at))
            taken[length] += each * b.count
            at += each * length
        base += b.count
    return pd.DataFrame(rows, columns=["length", "first", "each", "bin", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives every row of ``items`` (its ``length`` from 1 to capacity) a ``sequence_id`` and ``offset``.

    ``items`` must be cheap to read again (written or checkpointed) and have ``doc_id``, ``piece`` and
    ``ids_crc32``, which decide ranks; rows equal in these are alike and interchangeable.
    """
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = plan(histogram, capacity)
    first = table["length"].to_numpy() << 44 | table["first"].to_numpy()
    few = items.sparkSession.createDataFrame([(n, -(-k // BUCKET_ROWS)) for n, k in histogram.items()], "length bigint, parts bigint")  # at most ``capacity`` rows
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))
    rows = items.join(F.broadcast(few), "length").withColumn("bucket", bucket).drop("parts")
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("many", F.floor(F.col("bucket") / BUCKETS))
    earlier = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("length", "many").orderBy("bucket").rowsBetween(*earlier)
    outer = Window.partitionBy("length").orderBy("many").rowsBetween(*earlier)
    bases = counts.groupBy("length", "many").agg(F.sum("n").alias("n")).select("length", "many", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    before = counts.withColumn("own", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(bases, ["length", "many"]).select("length", "bucket", (F.col("base") + F.col("own")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")
    names = [c for c in items.columns]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each, bins, offset, base = (table[c].to_numpy() for c in ("each", "bin", "offset", "first"))
        for df in batches:
            length, rank = df["length"].to_numpy(), df["rank"].to_numpy()
            at = np.searchsorted(first, length << 44 | rank, side="right") - 1
            place = rank - base[at]
            out = df[names].copy()
            out["sequence_id"] = bins[at] + place // each[at]
            out["offset"] = offset[at] + place % each[at] * length
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields] + ["sequence_id bigint", "offset bigint"])
    return ranked.select(*names, "rank").mapInPandas(assign, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; a row per piece, its place in ``sequence_id`` and ``offset``.

    A null or empty text is its end id alone. Repeated rows are packed as often as they occur. An empty table
    gives an empty result. Columns other than ``doc_id`` and ``text`` play no part.
    """
    return place(cut(pieces(docs, tokenizer_path, capacity, with_ids)), capacity)
