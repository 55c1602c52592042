"""Suffix-array dedup (operator 10): removes every byte of repeated long strings.

A string of ``LENGTH`` bytes that starts at two places holds, at the same
offset in both, the least hash of its grams (winnowing), so repeated strings
meet at anchors that occur more than once. Around each anchor lies a fragment,
the strings whose least gram it is. Fragments that are equal are one. If an
anchor has one fragment only, found more than once, all of it repeats; if it
has several, these are cut to the parts whose cores another one has too, and go
into a shard, whose suffix array is induced: suffixes that share ``LENGTH`` bytes
or more with their neighbours in order are one string, and it repeats if two
fragments of one anchor have it at the same offset. What a fragment learns counts
at all its places.

Equal texts are one before any of this. Every anchor's fragments are in one
shard, as many as fit a shard's size; an anchor with more fragments than that (a
passage that very many texts share, with different surroundings) has its strings
grouped by a hash instead, one row for each string, so that no task gets all of
them. The result is the same either way.

Hashes are 64 bits; fragments count as equal if those of anchor and fragment both
agree, strings of a hot anchor if two more do. They are fixed polynomials, good for
any data that is not made to defeat them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import discard, scratch_path
from evalframe.llm.suffix_array import permuted_prefixes, suffix_array
from evalframe.llm.textblocks import Block, blocks, mix, powers

LENGTH, GRAM = 400, 64
SPAN = LENGTH - GRAM + 1
#: Fragments of an anchor that may go into one shard; bytes of a shard, about.
SHARD_FRAGMENTS = 1000
SHARD_BYTES = 1 << 20
#: Strings whose starts lie in one class, by their distance from the anchor, have all but CLASS - 1 bytes in common places.
CLASS = 42
#: Bytes of one text that are worked on at a time: a longer one is cut, with an overlap, so that each string is in one part.
PART_BYTES = 2 << 20


def parts(b: Block, limit: int | None = None) -> Iterator[tuple[Block, int]]:
    """The block itself, or, of one very long text, overlapping parts with their offsets.

    Each string of LENGTH bytes starts in one part. A fragment that a border cuts becomes two with no string in common.
    """
    limit = PART_BYTES if limit is None else limit
    if len(b) > 1 or len(b.data) <= limit + LENGTH:
        yield b, 0
        return
    for lo in range(0, len(b.data) - LENGTH + 1, limit):
        data = b.data[lo : lo + limit + LENGTH - 1]
        yield Block(data, np.zeros(1, np.int64), np.array([len(data)]), b.rows), lo


def anchors(b: Block) -> tuple[np.ndarray, ...]:
    """Text, position, gram hash and fragment hash of every anchor of a block, and its fragment's bounds."""
    none = np.zeros(0, np.int64)
    n = len(b.data) - GRAM + 1
    if n < SPAN or not (b.end - b.start >= LENGTH).any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = b.prefix_hash()
    _, down = powers(len(b.data))
    gram = mix((prefix[GRAM:] - prefix[:n]) * down[:n])
    value = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # ties: the leftmost
    rows = -(-n // SPAN)
    padded = np.full(rows * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    grid = padded.reshape(rows, SPAN)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    least = np.minimum(ahead[: n - SPAN + 1], behind[SPAN - 1 : n])
    # windows that lie in one text
    inside = np.zeros(len(b.data) + 1, np.int64)
    long = b.end - b.start >= LENGTH
    np.add.at(inside, b.start[long], 1)
    np.add.at(inside, b.end[long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    chosen = least[window]
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    at = (chosen[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(b.end, at, side="right")
    # the strings whose least gram this is: they start side by side
    lo, hi = window[new], window[np.append(new[1:], len(window)) - 1] + LENGTH
    fragment = mix((prefix[hi] - prefix[lo]) * down[lo] + mix(((at - lo) * 1024 + (hi - lo)).astype(np.uint64)))
    return owner, at - b.start[owner], gram[at], fragment, at - lo, hi - at


_OCCURRENCE = "key binary, pos int, run int, anchor long, fragment long, back smallint, ahead smallint"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key")
        for b, offset in (x for whole in blocks(batch.column("text")) for x in parts(whole)):
            owner, pos, anchor, fragment, back, ahead = anchors(b)
            if not len(owner):
                continue
            pos = pos + offset
            # a long run of one character has the same anchor and fragment at every place: one row
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (fragment[1:] != fragment[:-1]) | (pos[1:] != pos[:-1] + 1) | (owner[1:] != owner[:-1]))
            at = np.flatnonzero(new)
            run = np.diff(np.append(at, len(owner)))
            yield pa.RecordBatch.from_arrays(
                [keys[b.rows].take(pa.array(owner[at])), pa.array(pos[at], pa.int32()), pa.array(run, pa.int32()), pa.array(anchor[at].view(np.int64)), pa.array(fragment[at].view(np.int64)), pa.array(back[at], pa.int16()), pa.array(ahead[at], pa.int16())],
                ["key", "pos", "run", "anchor", "fragment", "back", "ahead"],
            )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the fragments that are asked for of each text, and the hash of the core of each class of its strings.

    The core is what all strings of a class share, whichever of them a fragment has.
    """
    schema = pa.schema([("anchor", pa.int64()), ("fragment", pa.int64()), ("back", pa.int16()), ("bytes", pa.binary()), ("cores", pa.list_(pa.struct([("c", pa.int16()), ("core", pa.int64())])))])
    for batch in batches:
        texts, asked = batch.column("text"), batch.column("asked").to_pylist()
        for b in blocks(texts):
            wanted = [(int(b.start[i]) + w["pos"], w) for i in range(len(b)) for w in asked[b.rows.start + i]]
            for part in range(0, len(wanted), PART_FRAGMENTS):
                yield pa.RecordBatch.from_pydict(_cut(b.data, wanted[part : part + PART_FRAGMENTS]), schema)


#: Fragments, of at most 2 * LENGTH - GRAM bytes each, that are cut out at a time.
PART_FRAGMENTS = 4000


def _cut(data: np.ndarray, wanted: list[tuple[int, dict]]) -> dict[str, list]:
    """Rows of ``_pieces``; hashes are taken over the fragments alone, since equal bytes have equal ones wherever they stand."""
    raws = [data[at - w["back"] : at + w["ahead"]].tobytes() for at, w in wanted]
    start = np.append(0, np.cumsum([len(r) for r in raws]))
    joined = np.frombuffer(b"".join(raws), np.uint8)
    prefix = Block(joined, start[:-1], start[1:], slice(0, 0)).prefix_hash()
    _, down = powers(len(joined))
    cores = []
    for (_, w), first in zip(wanted, start.tolist()):
        c = np.arange(-w["back"] // CLASS, (w["ahead"] - LENGTH) // CLASS + 1)
        # what all strings of a class share lies in the fragment if one of them does
        lo, hi = first + w["back"] + c * CLASS + CLASS - 1, first + w["back"] + c * CLASS + LENGTH
        core = mix((prefix[hi] - prefix[lo]) * down[lo]).view(np.int64)
        cores.append([{"c": x, "core": y} for x, y in zip(c.tolist(), core.tolist())])
    names = ("anchor", "fragment", "back")
    return {n: [w[n] for _, w in wanted] for n in names} | {"bytes": raws, "cores": cores}


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments cut to the strings of the classes from ``first`` to ``last``."""
    for batch in batches:
        back, raw, first, last = (batch.column(c).to_pylist() for c in ("back", "bytes", "first", "last"))
        new_back, new_raw = [], []
        for k, r, f, e in zip(back, raw, first, last):
            lo = max(0, k + f * CLASS)
            new_back.append(k - lo)
            new_raw.append(r[lo : min(len(r), k + e * CLASS + CLASS - 1 + LENGTH)])
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("fragment"), pa.array(new_back, pa.int16()), pa.array(new_raw, pa.binary())], ["anchor", "fragment", "back", "bytes"])


def repeats(fragments: list[bytes], anchor: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
    """For distinct fragments of anchors (numbered; ``back`` bytes before the anchor): where, in each, a string of
    LENGTH bytes starts that another fragment of the anchor has at the same offset from it.

    Fragments of different anchors may overlap in one text, so only equal offsets from one anchor tell two places.
    """
    size = np.array([len(f) for f in fragments])
    start = np.append(0, np.cumsum(size + 1))[:-1]
    s = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8).astype(np.int64) + 2
    s[start + size] = 1  # fragments end with a character that texts do not have
    sa = suffix_array(s, 258)
    _, shared = permuted_prefixes(s, sa)
    string = np.cumsum(shared[sa] < LENGTH)  # neighbours in order with enough in common begin with one string
    owner = np.repeat(np.arange(len(size)), size + 1)
    long = start[owner] + size[owner] - np.arange(len(s)) >= LENGTH
    keep = long[sa]
    at, string = sa[keep], string[keep]
    off = at - start[owner[at]] - back[owner[at]]
    order = np.lexsort((off, anchor[owner[at]], string))
    at, string, off, own = at[order], string[order], off[order], anchor[owner[at[order]]]
    same = np.append(False, (string[1:] == string[:-1]) & (off[1:] == off[:-1]) & (own[1:] == own[:-1]))
    marked = np.zeros(len(s), bool)
    marked[at[same]] = True
    marked[at[:-1][same[1:]]] = True
    return [np.flatnonzero(marked[a : a + n]) for a, n in zip(start, size)]


def _spans(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes that strings starting at these offsets cover."""
    if not len(starts):
        return [], []
    new = np.flatnonzero(np.append(True, np.diff(starts) > LENGTH))
    last = np.append(new[1:] - 1, len(starts) - 1)
    return starts[new].tolist(), (starts[last] + LENGTH).tolist()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive with each anchor's fragments together; whole anchors fill a shard."""
    held: list[tuple[int, int, int, bytes]] = []
    size, last = 0, None

    def solved() -> pa.RecordBatch:
        out: dict[str, list] = {"anchor": [], "fragment": [], "from": [], "to": []}
        number = np.unique([h[0] for h in held], return_inverse=True)[1]
        for (anchor, fragment, back, _), starts in zip(held, repeats([h[3] for h in held], number, np.array([h[2] for h in held]))):
            for lo, hi in zip(*_spans(starts)):
                out["anchor"].append(anchor)
                out["fragment"].append(fragment)
                out["from"].append(lo - back)
                out["to"].append(hi - back)
        return pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["fragment"], pa.int64()), pa.array(out["from"], pa.int32()), pa.array(out["to"], pa.int32())], ["anchor", "fragment", "from", "to"])

    for batch in batches:
        for anchor, fragment, back, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "fragment", "back", "bytes"))):
            if held and size >= SHARD_BYTES and anchor != last:
                yield solved()
                held, size = [], 0
            held.append((anchor, fragment, back, raw))
            size, last = size + len(raw) + 1, anchor
    if held:
        yield solved()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of LENGTH bytes of a fragment with its hash and its offset from the anchor."""
    for batch in batches:
        if not len(batch):
            continue
        for b in blocks(_as_text(batch.column("bytes"))):
            prefix = b.prefix_hash()
            _, down = powers(len(b.data))
            count = b.end - b.start - LENGTH + 1
            owner = np.repeat(np.arange(len(b)), count)
            off = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = b.start[owner] + off
            h = mix((prefix[at + LENGTH] - prefix[at]) * down[at])
            rows = pa.array(owner + b.rows.start)
            back = batch.column("back").to_numpy()[owner + b.rows.start]
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(rows), batch.column("fragment").take(rows), pa.array((off - back).astype(np.int32)), pa.array(h.view(np.int64))], ["anchor", "fragment", "from", "string"])


def _as_text(column: pa.Array) -> pa.Array:
    """Binary as a string column with the same buffers (fragments may begin inside a character)."""
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset)


_REMOVED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _merged(spans: list | None, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted((max(0, x["from"]), min(n, x["to"])) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif e > a:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _removed(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, copies = batch.column("doc_id"), batch.column("spans"), batch.column("copies").to_pylist()
            for b in blocks(batch.column("text")):
                out: dict[str, list] = {k: [] for k in ("n", "gone", "spans", "sha", "text")}
                own = spans[b.rows].to_pylist()
                for i in range(len(b)):
                    raw = b.data[b.start[i] : b.end[i]].tobytes()
                    n = len(raw)
                    gone = [(0, n)] if copies[b.rows.start + i] > 1 and n >= LENGTH else _merged(own[i], n)
                    parts, at = [], 0
                    for a, e in gone:
                        parts.append(raw[at:a])
                        at = e
                    kept = b"".join([*parts, raw[at:]])
                    out["n"].append(n)
                    out["gone"].append(n - len(kept))
                    out["spans"].append(len(gone))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        out["text"].append(kept)
                columns = [ids[b.rows], *(pa.array(out[k], pa.int64()) for k in ("n", "gone", "spans")), pa.array(out["sha"], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out["text"], pa.binary())] * with_text, names + ["kept"] * with_text)

    return run


def _stored(df: DataFrame, name: str, spent: list[str] | None = None) -> DataFrame:
    """Written as Parquet to the shared folder and read again: smaller than a checkpoint for wide tables.

    With ``spent``, the path is noted there, to be removed when what was made from it is written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if spent is not None:
        spent.append(path)
    return df.sparkSession.read.parquet(path)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, from, to): byte spans of repeated strings in each of different texts with a ``key``. Spans of a text may overlap."""
    spark, spent = texts.sparkSession, []
    seen = _stored(texts.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInArrow(_occurrences, _OCCURRENCE), "anchors", spent)
    often = seen.groupBy("anchor").agg(F.sum("run").alias("n"), F.min("fragment").alias("lo"), F.max("fragment").alias("hi")).where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    often = _stored(often, "often", spent)  # so that the join's shuffles can be split where an anchor is very common
    again = _stored(seen.join(often, "anchor"), "repeated-anchors")
    discard(spark, spent)
    several = again.where("mixed").groupBy("anchor", "fragment").agg(F.sum("run").alias("n"), F.min(F.struct("key", "pos", "back", "ahead")).alias("at"))
    several = _stored(several, "distinct-fragments")
    asked = several.groupBy("at.key").agg(F.collect_list(F.struct("anchor", "fragment", F.col("at.pos").alias("pos"), F.col("at.back").alias("back"), F.col("at.ahead").alias("ahead"))).alias("asked"))
    plain = "anchor long, fragment long, back smallint, bytes binary"
    got = texts.join(asked, "key").select("text", "asked").mapInArrow(_pieces, plain + ", cores array<struct<c:smallint,core:bigint>>")
    got = _stored(got, "fragments", spent)
    # strings of a class can only repeat where another fragment of the anchor has the same core
    cores = got.select("anchor", "fragment", F.inline("cores"))
    twice = cores.groupBy("anchor", "c", "core").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "c", "core")
    kept = cores.join(twice, ["anchor", "c", "core"]).groupBy("anchor", "fragment").agg(F.min("c").alias("first"), F.max("c").alias("last"))
    pieces = _stored(got.drop("cores").join(kept, ["anchor", "fragment"]).mapInArrow(_trimmed, plain), "trimmed")
    discard(spark, spent)
    size = pieces.groupBy("anchor").agg(F.count("*").alias("fragments"))
    pieces = pieces.join(size, "anchor")
    # twice as many tasks as the session shuffles to: the rows are few bytes, for which Spark would merge the partitions
    # of the join (and those of a repartition to the same number, which it drops), but sorting suffixes is long work
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = pieces.where(F.col("fragments") <= SHARD_FRAGMENTS).repartition(tasks, "anchor").sortWithinPartitions("anchor")
    schema = "anchor long, fragment long, from int, to int"
    found = small.select("anchor", "fragment", "back", "bytes").mapInArrow(_shards, schema)
    strings = pieces.where(F.col("fragments") > SHARD_FRAGMENTS).select("anchor", "fragment", "back", "bytes").mapInArrow(_strings, "anchor long, fragment long, from int, string long")
    common = strings.groupBy("anchor", "from", "string").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "from", "string")
    many = strings.join(common, ["anchor", "from", "string"]).select("anchor", "fragment", "from", (F.col("from") + LENGTH).alias("to"))
    learned = _stored(found.unionByName(many), "learned")
    # a fragment found more than once repeats as a whole
    whole = several.where("n > 1").select("anchor", "fragment", F.lit(True).alias("whole"))
    once = again.where("not mixed").select("key", (F.col("pos") - F.col("back")).alias("from"), (F.col("pos") + F.col("run") - 1 + F.col("ahead")).alias("to"))
    part = again.where("mixed").join(learned.withColumnsRenamed({"from": "f", "to": "t"}), ["anchor", "fragment"]).select("key", (F.col("pos") + F.col("f")).alias("from"), (F.col("pos") + F.col("run") - 1 + F.col("t")).alias("to"))
    full = again.where("mixed").join(whole, ["anchor", "fragment"]).select("key", (F.col("pos") - F.col("back")).alias("from"), (F.col("pos") + F.col("run") - 1 + F.col("ahead")).alias("to"))
    return once.unionByName(part).unionByName(full)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document without its repeated strings of 400 bytes.

    ``with_text`` adds the bytes that are left (``kept``). Strings are judged on the input. A null text is an empty
    one; texts under 400 bytes lose nothing; a text of 400 bytes or more with a copy, or a repeated row, loses all.
    An empty table gives an empty result. Columns other than doc_id and text play no part.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    # copies are whole repeats, and add nothing to what other texts repeat: each text is looked at once
    texts = _stored(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts")
    each = repeated_spans(texts).groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    known = texts.select("key", "copies").join(each, "key", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed.join(known, "key").select("doc_id", "text", "copies", "spans")
    return rows.mapInArrow(_removed(with_text), f"doc_id {kind}, {_REMOVED}" + ", kept binary" * with_text)
