"""Token counts (operator 7): delta-maintained rollups.

Events are signed: an insert adds a document and its tokens, a delete takes
them away, a revision adds the difference of two counts. A batch of events is
pre-aggregated and committed under its id as one small delta of the additive
totals by source, language and tokenizer version. A batch that was committed
before changes nothing, so a job that is run again after a failure counts
nothing twice. A delta is written to a folder of its attempt and renamed when it
is whole, which only one of several writers of an id can do; totals read marked
folders only, so what a lost writer left counts nowhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.common import cut, scratch_path
from evalframe.llm.tokens import default_path, tokenizer

KEYS = ("source", "lang", "version")


_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long, n_events long"
_COUNTS = ("n_docs", "n_tokens", "n_events")


class TokenRollup:
    """A rollup table at a path that driver and executors share.

    ``batch=<id>`` has the delta of a batch; ``base=<n>`` the totals of all batches whose ids it lists, which
    ``compact`` makes so that totals need not read every delta there ever was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[str]:
        """Ids of the whole folders of a kind."""
        fs, top = self._files(), self._at("x").getParent()
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return [n.removeprefix(kind + "=") for n in names if n.startswith(kind + "=") and fs.exists(self._at(f"{n}/_SUCCESS"))]

    def _base(self) -> int | None:
        return max(map(int, self._marked("base")), default=None)

    def _put(self, attempt: str, name: str) -> bool:
        """Renames an attempt's folder; False if another writer's whole folder is there."""
        fs, target = self._files(), self._at(name)
        if fs.exists(target) and not fs.exists(self._at(f"{name}/_SUCCESS")):
            fs.delete(target, True)  # renamed folders are whole: this one lost its mark or was put here by other means
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._at(attempt), target, how)  # fails if the target exists
        except Exception:
            fs.delete(self._at(attempt), True)
            if not fs.exists(self._at(f"{name}/_SUCCESS")):
                raise
            return False
        return True

    def _ids(self) -> DataFrame | None:
        base = self._base()
        return None if base is None else self.spark.read.schema("batch string").json(f"{self.path}/base={base}/ids")

    def committed(self, batch: str) -> bool:
        if self._files().exists(self._at(f"batch={batch}/_SUCCESS")):
            return True
        ids = self._ids()
        return ids is not None and not ids.where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Adds a batch of events once: False, and no change, if its id was committed before.

        ``events``: source, lang, version, n_docs (signed), n_tokens (signed). Null keys are keys of their own;
        null numbers count as 0.
        """
        if self.committed(batch):
            return False
        delta = events.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_tokens")], F.count("*").alias("n_events"))
        attempt = f"_attempt-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/{attempt}")
        return self._put(attempt, f"batch={batch}")

    def _open(self) -> list[str]:
        """Ids of marked deltas that the base does not have."""
        marked, ids = self._marked("batch"), self._ids()
        held = set() if ids is None or not marked else {r.batch for r in ids.where(F.col("batch").isin(marked)).collect()}  # of the folders there are
        return sorted(set(marked) - held)

    def totals(self) -> DataFrame:
        """Totals over all committed batches. Keys whose documents are all gone stay, with zeros; no batch gives no rows."""
        base, read = self._base(), self.spark.read.schema(_SCHEMA)
        paths = [f"{self.path}/batch={b}" for b in self._open()] + ([] if base is None else [f"{self.path}/base={base}/totals"])
        rows = read.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in _COUNTS])

    def compact(self) -> int:
        """Folds all committed batches into a new base and gives the number of those folded.

        Folders that the base before this one held are removed; those folded now stay until the next time, for
        readers that have their paths. A batch stays committed, whether or not its folder does.
        """
        fresh, old, ids = self._open(), self._base(), self._ids()
        if not fresh:
            return 0
        gone = [b for b in self._marked("batch") if b not in fresh]
        attempt = f"_attempt-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{attempt}/totals")
        listed = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        (listed if ids is None else ids.unionByName(listed)).write.json(f"{self.path}/{attempt}/ids")
        self._files().create(self._at(f"{attempt}/_SUCCESS")).close()
        if not self._put(attempt, f"base={0 if old is None else old + 1}"):
            return 0  # another compaction was first
        for folder in [f"batch={b}" for b in gone] + ([] if old is None or old < 1 else [f"base={old - 1}"]):
            self._files().delete(self._at(folder), True)
        return len(fresh)


def inserts(rows: DataFrame, tokens: Column, docs: Column | None = None) -> DataFrame:
    """``docs``: documents that a row stands for (1 unless told otherwise), each with ``tokens``."""
    n = F.lit(1) if docs is None else docs
    return rows.select(*KEYS, n.cast("long").alias("n_docs"), (n * tokens).cast("long").alias("n_tokens"))


def deletes(rows: DataFrame, tokens: Column, docs: Column | None = None) -> DataFrame:
    n = F.lit(1) if docs is None else docs
    return rows.select(*KEYS, (-n).cast("long").alias("n_docs"), (-n * tokens).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (new - old).cast("long").alias("n_tokens"))


def without_repeated_lines(text: str) -> str:
    """The text without lines that are equal to an earlier line."""
    return "\n".join(dict.fromkeys(text.split("\n")))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rest = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != at]
            for lo in range(0, len(batch), 500):
                texts = [t or "" for t in batch.column(at).slice(lo, 500).to_pylist()]
                counts = [len(x) // 4 for x in encode(texts)]
                clean = list(counts)
                lines = [(i, c) for i, t in enumerate(texts) if (c := without_repeated_lines(t)) != t]
                for (i, _), x in zip(lines, encode([c for _, c in lines])):
                    clean[i] = len(x) // 4
                yield pa.RecordBatch.from_arrays([c.slice(lo, 500) for _, c in rest] + [pa.array(counts, pa.int64()), pa.array(clean, pa.int64())], [n for n, _ in rest] + ["n_tokens", "n_clean"])

    return run


def counted(docs: DataFrame, tokenizer_path: str | None = None, version: str = "word_bpe_49k") -> DataFrame:
    """Token counts of every whole text, as it is and without repeated lines. A null text has no tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    schema = f"doc_id {kind}, source string, lang string, text_md5 string, n_tokens bigint, n_clean bigint"
    return rows.mapInArrow(_counted(tokenizer_path or default_path()), schema).withColumn("version", F.lit(version))


def maintain(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None, version: str = "word_bpe_49k") -> DataFrame:
    """Runs a corpus through the rollup: documents arrive, are cleaned of repeated lines, and lose their copies.

    Three batches, the second of which is sent twice: inserts of all documents, revisions of the counts of
    those that cleaning changes, deletes of all copies of a text but that with the least doc_id. The totals
    equal a count of the corpus as it then is. An empty table gives an empty result; extra columns are not
    returned; repeated rows are copies.
    """
    spark = docs.sparkSession
    rows = cut(counted(docs, tokenizer_path, version))
    rollup = TokenRollup(spark, path or scratch_path(spark, "token-rollup"))
    rollup.commit("inserts", inserts(rows, F.col("n_tokens")))
    cleaned = revisions(rows.where("n_clean <> n_tokens"), F.col("n_tokens"), F.col("n_clean"))
    rollup.commit("revisions", cleaned)
    rollup.commit("revisions", cleaned)
    # copies are counted before they are held against the one that stays, so a text with very many costs no more
    alike = rows.groupBy("text_md5", *KEYS).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("n_clean").alias("n_clean"))
    stays = alike.groupBy("text_md5").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l"), F.col("source").alias("source"), F.col("lang").alias("lang"))).alias("stay"))
    own = F.col("source").eqNullSafe(F.col("stay.source")) & F.col("lang").eqNullSafe(F.col("stay.lang"))
    gone = alike.join(stays, "text_md5").withColumn("gone", F.col("n") - F.when(own, 1).otherwise(0)).where("gone > 0")
    rollup.commit("deletes", deletes(gone, F.col("n_clean"), F.col("gone")))
    rollup.compact()
    return rollup.totals()
