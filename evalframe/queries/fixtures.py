"""Views over the given tables in the shapes that the operators take.

Each view is one SQL text for Spark and DuckDB, except where ``DUCK`` has its
own. ``Views`` builds them lazily as DataFrames; ``with_views`` puts those that
a query names before it as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evalframe.sources.shared import scratch

_TRUE = "CASE WHEN l_partkey % 20 < 11 THEN 0 WHEN l_partkey % 20 < 16 THEN 1 WHEN l_partkey % 20 = 16 THEN 2 ELSE 3 END"


def _pred(limit: int) -> str:
    return f"CASE WHEN (l_orderkey*7 + l_linenumber*13 + l_suppkey*3) % 10 < {limit} THEN (l_suppkey + l_linenumber) % 4 ELSE {_TRUE} END"


def _acquisitions(day: str) -> str:
    """One acquisition for each tile and day."""
    return f"""SELECT tile_id, day, CAST(t AS INT) AS true_class, CAST(CASE WHEN m2 % 10 < 3 THEN m2 % 4 ELSE t END AS INT) AS pred_class FROM
       (SELECT tile_id, day, m2, CASE WHEN m1 % 20 < 11 THEN 0 WHEN m1 % 20 < 16 THEN 1 WHEN m1 % 20 = 16 THEN 2 ELSE 3 END AS t FROM
       (SELECT l_partkey % 100 AS tile_id, {day} AS day, max(l_partkey * 3 + l_orderkey) AS m1, max(l_orderkey * 7 + l_linenumber * 13 + l_suppkey * 3) AS m2 FROM lineitem GROUP BY l_partkey % 100, {day}))"""


SQL = {
    "predictions": f"""SELECT l_orderkey AS sample_id, o_orderpriority AS group_id, {_TRUE} AS true_class,
       {_pred(3)} AS pred_baseline, {_pred(2)} AS pred_improved FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "preds": """SELECT 'baseline' AS model_id, sample_id, group_id, CAST(true_class AS INT) AS true_class, CAST(pred_baseline AS INT) AS pred_class FROM predictions
       UNION ALL SELECT 'improved', sample_id, group_id, CAST(true_class AS INT), CAST(pred_improved AS INT) FROM predictions""",
    "pixels": """SELECT l_orderkey AS sample_id, l_partkey % 97 AS row_px, l_suppkey % 31 AS col_px, CAST(l_quantity AS DOUBLE) AS b0,
       CAST(l_extendedprice AS DOUBLE) AS b1, CAST(l_discount AS DOUBLE) AS b2, CAST(l_tax AS DOUBLE) AS b3, l_returnflag AS scene,
       CAST(CASE WHEN l_partkey % 20 < 11 THEN 0 WHEN l_partkey % 20 < 16 THEN 1 WHEN l_partkey % 20 = 16 THEN 2 ELSE 3 END AS INT) AS label FROM lineitem""",
    "logits": "SELECT vec_id, label, slice(embedding, 1, 10) AS logits FROM embeddings",
    "samples": """SELECT CAST(d.doc_id AS VARCHAR(20)) AS sample_id, d.lang AS dataset, d.source AS group_id, d.n_chars AS n_bytes, l.quality AS label
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "image_sizes": "SELECT CAST(doc_id AS VARCHAR(20)) AS sample_id, CAST(100 + n_chars % 900 AS INT) AS height, CAST(100 + doc_id % 900 AS INT) AS width FROM documents",
    "file_inventory": "SELECT page_id, url AS path, length(html) AS n_chars, html AS content FROM pages",
    "docs_labelled": "SELECT d.doc_id, d.lang AS dataset, d.source AS group_id, d.n_chars, CAST(d.doc_id - CASE WHEN d.doc_id % 31 = 1 AND d.lang IN ('es', 'fr') THEN 1 ELSE 0 END AS VARCHAR(20)) AS sample_id, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "sample_files": """SELECT sample_id, dataset, 'image' AS kind, concat('images/', CAST(doc_id AS VARCHAR(20)), '_b0.tif') AS path, doc_id, n_chars FROM docs_labelled
       UNION ALL SELECT sample_id, dataset, 'image', concat('images/', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 13 = 0 THEN '_b1.png' ELSE '_b1.TIFF' END), doc_id, n_chars FROM docs_labelled WHERE n_chars % 11 <> 0
       UNION ALL SELECT sample_id, dataset, 'label', concat('labels/', CAST(doc_id AS VARCHAR(20)), '.tif'), doc_id, n_chars FROM docs_labelled WHERE label IS NOT NULL""",
    "files_here": "SELECT dataset, path, doc_id, n_chars AS length, md5(path) AS checksum FROM sample_files WHERE NOT (dataset = 'de' AND (kind = 'image' AND doc_id % 17 = 0 AND path LIKE '%b0%' OR kind = 'label' AND doc_id % 19 = 0))",
    "files_meta": """SELECT path, CAST(100 + n_chars % 900 + CASE WHEN doc_id % 23 = 0 AND path LIKE '%b1%' THEN 1 WHEN doc_id % 31 = 0 AND kind = 'label' THEN 2 ELSE 0 END AS INT) AS height, CAST(100 + doc_id % 900 AS INT) AS width
       FROM sample_files WHERE NOT (doc_id % 29 = 0 AND path LIKE '%b0%')""",
    "files_expected": "SELECT dataset, path, doc_id AS position, CASE WHEN doc_id % 11 = 0 AND dataset = 'fr' THEN upper(md5(concat(path, 'x'))) WHEN doc_id % 3 = 0 THEN '' ELSE upper(md5(path)) END AS expected FROM sample_files",
    "mask": """SELECT image_id, row_px, col_px, CAST(t AS INT) AS true_class, CAST(CASE WHEN m2 % 10 < 3 THEN m2 % 4 ELSE t END AS INT) AS pred_class FROM
       (SELECT image_id, row_px, col_px, m2, CASE WHEN m1 % 20 < 11 THEN 0 WHEN m1 % 20 < 16 THEN 1 WHEN m1 % 20 = 16 THEN 2 ELSE 3 END AS t FROM
       (SELECT l_suppkey % 8 AS image_id, l_orderkey % 128 AS row_px, l_partkey % 128 AS col_px, max(l_partkey * 3 + l_orderkey) AS m1, max(l_orderkey * 7 + l_linenumber * 13 + l_suppkey * 3) AS m2
       FROM lineitem GROUP BY l_suppkey % 8, l_orderkey % 128, l_partkey % 128))""",
    "acquisitions": _acquisitions("CAST(datediff(CAST(l_shipdate AS DATE), DATE '1970-01-01') AS BIGINT)"),
    "metric_log": "SELECT user_id AS run_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS epoch, ts, value FROM events",
    "run_log": """SELECT run_id, CAST(ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS INT) AS epoch, ts, value FROM
       (SELECT user_id * 10 + CAST(floor((day(ts) - 1) / 5) AS BIGINT) AS run_id, event_id, ts, value FROM events)""",
}
DUCK = {"logits": "SELECT vec_id, label, embedding[1:10] AS logits FROM embeddings", "acquisitions": _acquisitions("date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))")}
#: The keys by which tables of a view meet. They are dealt by them before the join, over tasks of a bounded number of rows, and what is
#: then grouped by sample stays in its task: partitions that are joined by the bytes shuffled hold many times these in their hash maps.
DEALT = {"predictions": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
TASK_ROWS = 250_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Views:
    """DataFrames of the given tables and of the views above, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in SQL:
                used = [t for t in (*TABLES, *SQL) if t != name and re.search(rf"\b(FROM|JOIN) {t}\b", SQL[name])]
                text = re.sub(r"\b(FROM|JOIN) (\w+)\b", r"\1 {\2}", SQL[name])
                self._made[name] = self.spark.sql(text, **self._dealt(name, {t: getattr(self, t) for t in used}))
            else:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._made[name]

    def _dealt(self, name: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables of a view, those in ``DEALT`` by their keys; Parquet tells their numbers of rows without reading them."""
        keys = DEALT.get(name, {})
        if not keys:
            return tables
        rows = max(tables[t].count() for t in keys)
        least = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        n = max(least, -(-rows // TASK_ROWS))
        return {t: df.repartition(n, keys[t]) if t in keys else df for t, df in tables.items()}

    def stored(self, name: str, build) -> DataFrame:
        """What ``build`` gives, written to the shared folder once and read from there by all parts of a job."""
        if f"stored {name}" not in self._made:
            path = scratch(self.spark, name)
            build().write.parquet(path)
            self._made[f"stored {name}"] = self.spark.read.parquet(path)
        return self._made[f"stored {name}"]


def with_views(sql: str) -> str:
    """The DuckDB query with the views that it needs, in order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for v in SQL:
            if v not in needed and re.search(rf"\b{v}\b", text):
                need(DUCK.get(v, SQL[v]).replace(f"AS {v}", ""))
                if v not in needed:
                    needed.append(v)

    need(sql)
    ctes = ", ".join(f"{v} AS ({DUCK.get(v, SQL[v])})" for v in needed)
    if not ctes:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views under a name, with the SQL of its result."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return register
