"""Quality rules (operator 9): base counts and robust multivariate outliers.

Each text gets a few exact counts in one vectorised pass. Their transformed
vector is held against a minimum-covariance-determinant (MCD) estimate of its
(language, source) group; documents far from the bulk are rejected.

The MCD is fitted over all documents of a group by concentration steps that
are Spark aggregations: distances, the distance under which a share ``h`` of
the group lies (an exact histogram of log-distances), then mean and covariance
of that part. Several starts, one from quartiles and others from small parts of
the group by hash, take two steps each; that with the least determinant goes on
until its determinant falls no more. A hot group costs no more than its rows,
since every aggregation combines on the map side. Groups too small for five
dimensions take their language's estimate, then that of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import cut, unused, with_few
from evalframe.llm.textblocks import Block, blocks, repeated, span_hash, windows

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Transformed statistics and the least standard deviation that counts for each (a statistic that is zero
#: in most texts would otherwise make any other value an outlier).
FEATURES = {"z_length": 1.5, "z_word": 0.08, "z_symbols": 0.06, "z_lines": 0.12, "z_repeats": 0.08}
DIM = len(FEATURES)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def count_block(b: Block) -> dict[str, np.ndarray]:
    """The base counts of each text of a block."""
    a, e, owner = b.words()
    n = len(b)
    prefix = b.prefix_hash()
    solid = np.zeros(len(b.data) + 1, np.int64)
    np.add.at(solid, a, 1)
    np.add.at(solid, e, -1)
    inside = np.cumsum(solid[:-1]).astype(bool)
    out = {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": b.total(inside & ((b.data & 0xC0) != 0x80)),
        "n_symbols": b.total(_IS_SYMBOL[b.data]),
    }
    newline = np.flatnonzero(b.data == 10)
    line_start = np.sort(np.concatenate([b.start, newline + 1]))
    line_of = np.searchsorted(b.start, line_start, side="right") - 1
    # a line that begins where a text ends belongs to the text that ended there: it is empty and has no word
    stops = np.append(line_start[1:], len(b.data))
    line_end = np.where((stops > line_start) & (np.append(b.data, 0)[stops - 1] == 10), stops - 1, stops)
    words_to = np.zeros(len(b.data) + 1, np.int64)
    first = np.zeros(len(b.data), np.int64)
    first[a] = 1
    np.cumsum(first, out=words_to[1:])
    has = words_to[line_end] > words_to[line_start]
    line_start, line_end, line_of = line_start[has], line_end[has], line_of[has]
    _, later = repeated(line_of, span_hash(prefix, line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_of[later], minlength=n)
    at, h = windows(owner, span_hash(prefix, a, e), WINDOW)
    again, _ = repeated(owner[at], h)
    covered = np.zeros(len(a) + 1, np.int64)
    np.add.at(covered, at[again], 1)
    np.add.at(covered, at[again] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
        names = [f.name for f in batch.schema if f.name != "text"]
        for b in blocks(batch.column(batch.schema.get_field_index("text"))):
            c = count_block(b)
            yield pa.RecordBatch.from_arrays([x[b.rows] for x in keep] + [pa.array(c[k], pa.int64()) for k in COUNTS], names + COUNTS)


def text_counts(docs: DataFrame) -> DataFrame:
    """The base counts of every whole text; all other columns are carried along. A null text has none (all zero)."""
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} bigint" for c in COUNTS])
    return docs.mapInArrow(_counted, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> list[Column]:
    """Length and word size on log scales; shares as square roots, which spreads the small ones."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias("z_length"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("z_word"),
        F.sqrt(F.col("n_symbols") / n).alias("z_symbols"),
        F.sqrt(F.col("n_dup_lines") / n).alias("z_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("z_repeats"),
    ]


_C, _V = [f"c{i}" for i in range(DIM)], [f"v{i}_{j}" for i in range(DIM) for j in range(DIM)]
_FIT = "g string, start int, " + ", ".join(f"{c} double" for c in [*_C, *_V]) + ", logdet double"


def _estimates(scale: float):
    """Moments of each group's part to its centre, the inverse of its covariance and the logarithm of its determinant.

    The covariance has the floors of FEATURES, so a statistic that hardly varies neither makes it singular nor decides.
    """
    floor = np.array(list(FEATURES.values())) ** 2
    up = [(i, j) for i in range(DIM) for j in range(i, DIM)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                mean = np.array([getattr(r, f"m{i}") for i in range(DIM)], float)
                cov = np.zeros((DIM, DIM))
                for i, j in up:
                    cov[i, j] = cov[j, i] = getattr(r, f"s{i}_{j}") - mean[i] * mean[j]
                cov = np.nan_to_num(cov) * scale
                cov += np.diag(np.maximum(floor - np.diag(cov), 0) + 1e-9)
                out.append([r.g, r.start, *mean, *np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]])
            yield pd.DataFrame(out, columns=["g", "start", *_C, *_V, "logdet"])

    return run


def _distance() -> Column:
    z = [F.col(f) - F.col(f"c{i}") for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + (1 if i == j else 2) * z[i] * z[j] * F.col(f"v{i}_{j}")
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    """The fit of the rows of each group and start."""
    names = list(FEATURES)
    aggs = [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)]
    aggs += [F.avg(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
    return rows.groupBy("g", "start").agg(*aggs).mapInPandas(_estimates(CONSISTENCY), _FIT)


def _concentrated(vectors: DataFrame, fit: DataFrame, h: float) -> DataFrame:
    """One concentration step from each fit of each group.

    The rows kept are those under the distance that a share ``h`` of the group does not exceed, by cells of 64 for
    each doubling of squared distances; of a cell all rows or none.
    """
    cell = F.floor(64 * F.log2(_distance() + 1e-9)).cast("long")
    placed = with_few(vectors, fit, "g").select("g", "start", *FEATURES, cell.alias("cell"))
    cells = placed.groupBy("g", "start", "cell").agg(F.count("*").alias("n"))
    # a group has at most a few thousand cells, whatever its rows
    totals = cells.groupBy("g", "start").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("cell"))
    reached = F.aggregate("cells", first, lambda s, x: F.when(s.n >= F.ceil(F.col("all") * h), s).otherwise(F.struct((s.n + x.n).alias("n"), x.cell.alias("cell"))))
    limit = cut(totals.select(F.concat_ws("\u0002", "start", "g").alias("at"), reached.cell.alias("top")))
    kept = with_few(placed.withColumn("at", F.concat_ws("\u0002", "start", "g")), limit, "at").where("cell <= top")
    return cut(_moments(kept))


#: Starts of each group from a part of its rows, besides that from quartiles, and rows of such a part, about.
STARTS, START_ROWS = 3, 12
#: A determinant that falls by no more than this, as a share, has stopped falling.
SETTLED = 1e-4


def _starts(vectors: DataFrame) -> DataFrame:
    """First fits: median and interquartile ranges (start 0), and moments of small parts by hash (the others)."""
    q = [F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)]
    whole = cut(vectors.groupBy("g").agg(F.count("*").alias("n"), *q))
    cols = ["g", F.lit(0).alias("start"), *[F.element_at(f"q{i}", 2).alias(f"c{i}") for i in range(DIM)]]
    for i in range(DIM):
        for j in range(DIM):
            sd = F.greatest((F.element_at(f"q{i}", 3) - F.element_at(f"q{i}", 1)) / 1.349, F.lit(list(FEATURES.values())[i]))
            cols.append((1 / (sd * sd) if i == j else F.lit(0.0)).alias(f"v{i}_{j}"))
    plain = whole.select(*cols, F.lit(None).cast("double").alias("logdet"))
    rows = with_few(vectors, whole.select("g", "n"), "g").withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    part = rows.where(F.pmod(F.xxhash64("start", *FEATURES), F.lit(1 << 40)) / float(1 << 40) < START_ROWS / F.col("n"))
    return cut(plain.unionByName(_moments(part)))


def fit_mcd(vectors: DataFrame, h: float = 0.75) -> DataFrame:
    """MCD centre (``c``), inverse covariance (``v``) and log-determinant of each group ``g`` over all its rows.

    The covariance of the kept part is scaled to be consistent for normal data (a factor for h = 0.75 in five
    dimensions). Every step after the first two lowers a group's determinant or is that group's last.
    """
    fit = _starts(vectors)
    for _ in range(2):
        fit = _concentrated(vectors, fit, h)
    names = [c for c in fit.columns if c != "g"]
    best = cut(fit.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("f")).select("g", "f.*"))
    done = None
    going = best
    while True:
        own = vectors if done is None else with_few(vectors, going.select("g"), "g", "left_semi")
        new = _concentrated(own, going, h).withColumnRenamed("logdet", "new")
        both = going.select("g", F.col("logdet").alias("old")).join(new, "g")
        both = cut(both.withColumn("fell", F.col("new") < F.col("old") - SETTLED))
        ended = both.where("not fell").select("g")
        settled = going.join(ended, "g", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        going = both.where("fell").withColumnRenamed("new", "logdet").select(*best.columns)
        if going.isEmpty():
            return cut(done).drop("start")


#: Covariance of the central 75 % of a normal distribution in five dimensions, as a factor to undo it.
CONSISTENCY = 1.412
#: Squared distance beyond which a document is an outlier: eight deviations from the centre in any direction, far
#: outside the tails of a clean bulk (a chi-square tail of 2e-12 with 5 degrees of freedom).
CUTOFF = 64.0
MIN_GROUP = 60


def judge(docs: DataFrame, cutoff: float = CUTOFF, h: float = 0.75, carry: list[str] | None = None) -> DataFrame:
    """Counts, ``base_failed``, ``kept``, ``distance`` and ``estimate`` of every document.

    ``estimate`` tells whose estimate the distance is to: that of the document's ``language and source``, its
    ``language`` or ``all`` (groups under MIN_GROUP documents take the next one). ``carry`` names columns to return
    besides (``doc_id`` unless told otherwise). A null ``lang`` or ``source`` is a group of its own; a null or empty
    text has zero words and fails the base rules; repeated rows are judged alike and each returned; an empty table
    gives an empty result; other columns, whatever their names, play no part.
    """
    carry = ["doc_id"] if carry is None else carry
    table = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(carry)], F.col("lang").alias("_lang"), F.col("source").alias("_source"), "text")
    base = cut(text_counts(table).withColumn("base_failed", base_failed()).select("*", *features()))
    lang = F.coalesce(F.concat(F.lit("l:"), "_lang"), F.lit("n"))
    both = F.concat(lang, F.lit("\u0001"), F.coalesce(F.concat(F.lit("s:"), "_source"), F.lit("n")))
    # texts that fail the base rules take no part in the estimates
    sizes = base.where("not base_failed").groupBy(lang.alias("_l"), both.alias("_g")).agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("_l").agg(F.sum("n").alias("n_lang"))
    own, wider = F.col("n") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    group = cut(sizes.join(by_lang, "_l").select("_g", "_l", F.when(own, F.col("_g")).when(wider, F.col("_l")).otherwise("*").alias("g"), F.when(own, "language and source").when(wider, "language").otherwise("all").alias("estimate")))
    member = base.where("not base_failed").select(both.alias("_g"), lang.alias("_l"), *FEATURES)
    used = cut(group.select("g").distinct())
    levels = [member.select(g.alias("g"), *FEATURES) for g in (F.col("_g"), F.col("_l"), F.lit("*"))]
    vectors = cut(with_few(levels[0].unionByName(levels[1]).unionByName(levels[2]), used, "g", "left_semi"))
    fit = cut(group.join(fit_mcd(vectors, h), "g").drop("g", "_l"))
    judged = with_few(base.withColumn("_g", both), fit, "_g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return judged.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], *COUNTS, "base_failed", kept.alias("kept"), "distance", F.when(~F.col("base_failed"), F.col("estimate")).alias("estimate"))


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names.

    Null and empty texts go (they have no words); of repeated rows all stay or all go; an empty table stays empty.
    """
    md5, d, m, g, s = unused(docs, "md5", "doc_id", "text", "lang", "source")
    keyed = docs.withColumn(md5, F.md5(F.coalesce("text", F.lit(""))))
    kept = judge(keyed, carry=["doc_id", md5, "lang", "source"], **options).where("kept")
    kept = kept.select(F.col("doc_id").alias(d), F.col(md5).alias(m), F.col("lang").alias(g), F.col("source").alias(s))
    same = keyed["doc_id"].eqNullSafe(F.col(d)) & (keyed[md5] == F.col(m)) & keyed["lang"].eqNullSafe(F.col(g)) & keyed["source"].eqNullSafe(F.col(s))
    return keyed.join(kept, same, "left_semi").select(*docs.columns)
