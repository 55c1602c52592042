"""Queries on samples and files: discovery, integrity, validation, readiness, sinks, composite jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.operators import compare as M
from evalframe.operators import quality as Q
from evalframe.operators import ranking as R
from evalframe.operators import stats as S
from evalframe.operators import tiling as T
from evalframe.queries import rasters as P
from evalframe.queries.failures import flat_sql
from evalframe.queries.fixtures import query
from evalframe.sources import inventory as I
from evalframe.sources import sinks as K
from evalframe.sources.files import scan_tree
from evalframe.sources.shared import scratch
from evalframe.sources.versions import VersionedTables

# --- sources --------------------------------------------------------------------------------------

IMAGE_FILES = "SELECT concat('data/images/', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' ELSE '.png' END) AS path, n_chars AS length FROM docs_labelled UNION ALL SELECT concat('data/labels/', CAST(doc_id AS VARCHAR), '.tif'), n_chars FROM docs_labelled WHERE label IS NOT NULL"


def paired_files(t):
    d = t.docs_labelled
    ext = F.when(F.col("doc_id") % 3 == 0, ".tif").when(F.col("doc_id") % 3 == 1, ".TIFF").otherwise(".png")
    images = d.select(F.concat(F.lit("data/images/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("n_chars").alias("length"))
    return images.unionByName(d.where("label is not null").select(F.concat(F.lit("data/labels/"), F.col("doc_id").cast("string"), F.lit(".tif")).alias("path"), F.col("n_chars").alias("length")))


PAIRS = "SELECT CAST(doc_id AS VARCHAR) AS sample_id, concat('data/images/', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.tif' ELSE '.TIFF' END) AS image_path, CASE WHEN label IS NOT NULL THEN concat('data/labels/', CAST(doc_id AS VARCHAR), '.tif') END AS label_path FROM docs_labelled WHERE doc_id % 3 < 2"


def written(t, name):
    """The files of ``paired_files``, written to the shared folder: a file for each row in two folders."""
    root = scratch(t.spark, name)
    kind, file = F.split_part(F.col("path"), F.lit("/"), F.lit(2)), F.split_part(F.col("path"), F.lit("/"), F.lit(3))
    K.write_files(paired_files(t).select(kind.alias("folder"), file.alias("name"), F.col("length").cast("string").alias("value")), f"{root}/data")
    return root


@query("s01_discover_paired_files", PAIRS)
def _(t):
    return I.discover_root(t.spark, f"{written(t, 's01')}/data", "data")[0]


@query("j01_image_label_pair", f"SELECT label_path IS NOT NULL AS has_label, count(*) AS samples FROM ({PAIRS}) GROUP BY ALL")
def _(t):
    return I.discover_pairs(paired_files(t)).groupBy(F.col("label_path").isNotNull().alias("has_label")).agg(F.count("*").alias("samples"))


@query("s02_discover_band_dirs", "SELECT CAST(doc_id AS VARCHAR) AS sample_id, array_to_string(list_transform(['B02', 'B03', 'B04', 'B08'], lambda b: 'data/' || doc_id || '/' || b || '.tif'), ',') AS image_paths, CASE WHEN label IS NOT NULL THEN 'labels/' || doc_id || '.tif' END AS label_path FROM docs_labelled")
def _(t):
    key = F.col("doc_id").cast("string")
    dirs = t.docs_labelled.select(F.concat(F.lit("data/"), key).alias("dir"))
    labels = t.docs_labelled.where("label is not null").select(key.alias("sample_id"), F.concat(F.lit("labels/"), key, F.lit(".tif")).alias("label_path"))
    return I.discover_band_dirs(dirs, ["B02", "B03", "B04", "B08"], labels).withColumn("image_paths", F.array_join("image_paths", ","))


@query("s03_discover_missing_root", f"SELECT 'data/' AS root, count(*) AS files, 'ok' AS message FROM ({IMAGE_FILES}) UNION ALL SELECT 'other', count(*), 'dataset root has no files' FROM ({IMAGE_FILES}) WHERE path LIKE 'other/%'")
def _(t):
    root = written(t, "s03")
    return I.discover_root(t.spark, f"{root}/data", "data/")[1].unionByName(I.discover_root(t.spark, f"{root}/other", "other")[1])


HOST = "regexp_extract(path, '://([^/]+)', 1)"


def scanned_pages(t, name, read="list"):
    """The pages as files, by host, that are written to the shared folder and scanned there; a file ends with a line's end."""
    root = scratch(t.spark, name)
    page = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    K.write_files(t.file_inventory.select(F.regexp_extract("path", "://([^/]+)", 1).alias("folder"), page.alias("name"), F.col("content").alias("value")), root)
    return scan_tree(t.spark, root, read)


@query("s04_file_inventory", f"SELECT {HOST} AS dataset, count(*) AS file_count, CAST(sum(strlen(content) + 1) AS BIGINT) AS total_bytes FROM file_inventory GROUP BY ALL")
def _(t):
    files = scanned_pages(t, "s04")
    return I.directory_summary(files.withColumn("dataset", F.split_part(F.col("path"), F.lit("/"), F.lit(1))), ["dataset"])


@query("s05_checksum_scan", "SELECT page_id, sha256(content || chr(10)) AS checksum FROM file_inventory")
def _(t):
    files = scanned_pages(t, "s05", "checksum")
    return files.select(F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast(t.pages.schema["page_id"].dataType).alias("page_id"), "checksum")


MANIFEST_FIELDS = ("p_partkey", "p_name", "p_brand", "source", "license")
ENTRIES = "SELECT p_partkey, p_name, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_size % 5 = 0 THEN 'UNKNOWN' ELSE p_type END AS source, CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'Redistribution prohibited' ELSE 'CC-BY' END AS license, CASE WHEN p_size % 3 = 0 THEN ' tbd ' WHEN p_size % 3 = 1 THEN md5(p_name) END AS checksum, p_size FROM part"


def entries(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey", "p_name", F.when(size % 7 != 0, F.col("p_brand")).alias("p_brand"), F.when(size % 5 == 0, "UNKNOWN").otherwise(F.col("p_type")).alias("source"),
        F.when(size % 11 == 0, None).when(size % 4 == 0, "Redistribution prohibited").otherwise("CC-BY").alias("license"), F.when(size % 3 == 0, " tbd ").when(size % 3 == 1, F.md5("p_name")).alias("checksum"), "p_size",
    )


@query("s06_load_manifest", f"SELECT p_partkey, field FROM (SELECT p_partkey, 'p_brand' AS field FROM ({ENTRIES}) WHERE p_brand IS NULL UNION ALL SELECT p_partkey, 'license' FROM ({ENTRIES}) WHERE license IS NULL) UNION ALL SELECT p_partkey, 'ok' FROM ({ENTRIES}) WHERE p_brand IS NOT NULL AND license IS NOT NULL")
def _(t):
    good = I.load_manifest(entries(t), "p_partkey", MANIFEST_FIELDS).select("p_partkey", F.lit("ok").alias("field"))
    return I.manifest_violations(entries(t), "p_partkey", MANIFEST_FIELDS).unionByName(good)


@query("s07_raster_meta_source", "SELECT path, height, width, CAST(NULL AS INT) AS count, 'uint16' AS dtype FROM files_meta")
def _(t):
    return I.raster_meta(t.files_meta.withColumn("dtype", F.lit("uint16"))).select("path", "height", "width", "count", "dtype")


@query("p12_supported_type", "SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.tif', '.tiff') AS supported FROM sample_files")
def _(t):
    return t.sample_files.select("path", X.supported_type(F.col("path")).alias("supported"))


@query("p13_checksum_available", f"SELECT p_partkey, upper(trim(coalesce(checksum, ''))) NOT IN ('', 'TBD', 'PLACEHOLDER', 'NONE', 'REQUIRES VERIFICATION') AS available FROM ({ENTRIES})")
def _(t):
    return entries(t).select("p_partkey", X.checksum_available(F.col("checksum")).alias("available"))


@query("p14_verify_checksum", "SELECT f.path, expected <> '' AND f.checksum = lower(expected) AS verified FROM files_here f JOIN files_expected e ON e.path = f.path")
def _(t):
    return t.files_here.join(t.files_expected.select("path", "expected"), "path").select("path", X.checksum_matches(F.col("checksum"), F.col("expected")).alias("verified"))


@query("p15_manual_access", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 6 <> 0 AS manual FROM part")
def _(t):
    urls = F.when(F.col("p_size") % 6 == 0, F.array(F.concat(F.lit("http://x/"), "p_name"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", X.manual_access(F.col("p_size") % 2 == 0, urls).alias("manual"))


@query("p18_group_default", "SELECT sample_id, coalesce(nullif(CASE WHEN n_bytes % 5 = 0 THEN '' ELSE group_id END, ''), sample_id) AS group_id FROM samples")
def _(t):
    g = F.when(F.col("n_bytes") % 5 == 0, "").otherwise(F.col("group_id"))
    return t.samples.select("sample_id", X.group_or(g, F.col("sample_id")).alias("group_id"))


@query("p21_license_predicates", f"SELECT p_partkey, NOT contains(lower(coalesce(license, '')), 'prohibit') AS license_ok, source <> 'UNKNOWN' AND coalesce(license, 'UNKNOWN') <> 'UNKNOWN' AS provenance_known FROM ({ENTRIES})")
def _(t):
    return entries(t).select("p_partkey", X.license_ok(F.col("license")).alias("license_ok"), X.provenance_known(F.col("source"), F.col("license")).alias("provenance_known"))


@query("p29_slug_id", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha256(p_name), 1, 8) AS figure_id FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug_id(F.col("p_type"), F.col("p_name")).alias("figure_id"))


@query("p31_acquisition_plan", "SELECT CAST(page_id AS VARCHAR) AS dataset_id, CASE WHEN page_id % 4 = 0 THEN 'manual_access_required' ELSE 'planned' END AS status, CASE WHEN page_id % 4 <> 0 THEN 'http://h/' || page_id || '/f.tif?x=1' END AS url, CASE WHEN page_id % 4 <> 0 THEN 'f.tif' END AS filename FROM pages")
def _(t):
    key = F.col("page_id").cast("string")
    urls = F.when(F.col("page_id") % 4 != 0, F.array(F.concat(F.lit("http://h/"), key, F.lit("/f.tif?x=1")))).otherwise(F.array().cast("array<string>"))
    rows = t.pages.select(key.alias("dataset_id"), F.lit("ask").alias("steps"), urls.alias("urls"))
    return I.acquisition_plan(rows).drop("steps")


# --- validation -----------------------------------------------------------------------------------

MISSING = "SELECT s.path FROM sample_files s ANTI JOIN files_here f ON f.path = s.path"


@query("j05_missing_files", MISSING)
def _(t):
    return I.missing_files(t.sample_files.select("path"), t.files_here)


@query("j06_checksum_compare", "SELECT f.path, f.checksum, e.expected FROM files_here f JOIN files_expected e ON e.path = f.path WHERE e.expected <> '' AND f.checksum <> lower(e.expected)")
def _(t):
    return I.checksum_mismatches(t.files_here.select("path", "checksum"), t.files_expected)


@query("g21_duplicate_ids", "SELECT sample_id, count(*) AS n FROM docs_labelled GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return Q.duplicate_ids(t.docs_labelled)


SIZED = "SELECT s.sample_id, s.kind, s.path, m.height, m.width FROM sample_files s LEFT JOIN files_meta m ON m.path = s.path"
SIZE_ISSUES = f"""SELECT sample_id, 'corrupted_metadata' AS category, path AS detail, 'ERROR' AS severity FROM ({SIZED}) WHERE height IS NULL
 UNION ALL SELECT sample_id, 'inconsistent_dimensions', 'bands', 'ERROR' FROM ({SIZED}) WHERE kind = 'image' AND height IS NOT NULL GROUP BY sample_id HAVING count(DISTINCT (height, width)) > 1
 UNION ALL SELECT DISTINCT l.sample_id, 'inconsistent_dimensions', 'label', 'ERROR' FROM ({SIZED}) l WHERE kind = 'label' AND height IS NOT NULL AND EXISTS (SELECT 1 FROM ({SIZED}) i WHERE i.sample_id = l.sample_id AND i.kind = 'image' AND i.height IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM ({SIZED}) i WHERE i.sample_id = l.sample_id AND i.kind = 'image' AND i.height = l.height AND i.width = l.width)"""
ISSUES = f"""SELECT sample_id, 'duplicate_id' AS category, CAST(count(*) AS VARCHAR) AS detail, 'ERROR' AS severity FROM docs_labelled GROUP BY sample_id HAVING count(*) > 1
 UNION ALL SELECT sample_id, 'missing_file', path, 'ERROR' FROM sample_files WHERE path IN ({MISSING})
 UNION ALL SELECT sample_id, 'unsupported_type', path, 'ERROR' FROM sample_files WHERE path NOT IN ({MISSING}) AND lower(path) NOT LIKE '%.tif' AND lower(path) NOT LIKE '%.tiff'
 UNION ALL SELECT sample_id, 'missing_label', '', 'WARNING' FROM docs_labelled GROUP BY sample_id HAVING count(label) = 0
 UNION ALL SELECT sample_id, 'inconsistent_dimensions', 'bands expected', 'ERROR' FROM sample_files GROUP BY sample_id HAVING count(CASE WHEN kind = 'image' THEN 1 END) <> 2 UNION ALL {SIZE_ISSUES}"""


def issues(t):
    return Q.validate_samples(t.docs_labelled, t.sample_files, t.files_here, t.files_meta, 2)


@query("g24_size_consistency", SIZE_ISSUES)
def _(t):
    return Q.size_issues(t.sample_files, t.files_meta)


@query("c01_validate_samples", ISSUES)
def _(t):
    return issues(t)


@query("g22_issue_counts", f"SELECT category, count(*) AS n FROM ({ISSUES}) GROUP BY ALL")
def _(t):
    return Q.issue_counts(issues(t))


SUMMARY = f"""SELECT (SELECT count(*) FROM docs_labelled) AS total, count(DISTINCT CASE WHEN severity = 'ERROR' THEN sample_id END) AS invalid, (SELECT count(*) FROM docs_labelled) - count(DISTINCT CASE WHEN severity = 'ERROR' THEN sample_id END) AS valid,
 {', '.join(f"count(CASE WHEN category = '{c}' THEN 1 END) AS {c}" for c in Q.CATEGORIES)} FROM ({ISSUES})"""


@query("g23_validation_summary", SUMMARY)
def _(t):
    return Q.validation_summary(t.docs_labelled, issues(t))


@query("g40_qc_report", f"SELECT s.*, w.* FROM ({SUMMARY}) s, (SELECT count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warnings, count(CASE WHEN severity = 'ERROR' THEN 1 END) = 0 AS passed FROM ({ISSUES})) w")
def _(t):
    return Q.qc_report(t.docs_labelled, issues(t))


@query("g25_present_classes", "SELECT sample_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS present, CASE WHEN count(CASE WHEN label = 2 THEN 1 END) > 0 THEN '' ELSE '2' END AS absent FROM pixels GROUP BY sample_id")
def _(t):
    p = Q.present_classes(t.pixels.select("sample_id", "label"), [2])
    return p.select("sample_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("present", "absent")])


STATUS = f"""SELECT s.dataset, CASE WHEN missing > 0 THEN 'FAIL' ELSE 'PASS' END AS file_status, CASE WHEN mismatches > 0 THEN 'FAIL' ELSE 'PASS' END AS checksum_status, CASE WHEN missing > 0 THEN 'NOT_VERIFIED' WHEN absent THEN 'FAIL' ELSE 'PASS' END AS label_status,
 CASE WHEN odd > 0 THEN 'FAIL' WHEN missing > 0 THEN 'NOT_VERIFIED' ELSE 'PASS' END AS dimension_status FROM (SELECT s.dataset, count(CASE WHEN f.path IS NULL THEN 1 END) AS missing, count(CASE WHEN f.path IS NOT NULL AND e.expected <> '' AND lower(e.expected) <> f.checksum THEN 1 END) AS mismatches
 FROM sample_files s LEFT JOIN files_here f ON f.path = s.path LEFT JOIN files_expected e ON e.path = s.path GROUP BY ALL) s
 JOIN (SELECT dataset, count(CASE WHEN n NOT IN (1, 2) THEN 1 END) AS odd FROM (SELECT dataset, sample_id, count(*) AS n FROM sample_files WHERE kind = 'image' GROUP BY ALL) GROUP BY ALL) o ON o.dataset = s.dataset
 JOIN (SELECT dataset, count(CASE WHEN label = 1 THEN 1 END) = 0 AS absent FROM docs_labelled WHERE label IS NOT NULL GROUP BY ALL) l ON l.dataset = s.dataset"""
STATUS_SQL = f"SELECT *, CASE WHEN 'FAIL' IN (checksum_status, label_status, dimension_status) THEN 'INVALID' WHEN file_status = 'FAIL' THEN 'INCOMPLETE' WHEN label_status = 'NOT_VERIFIED' THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS overall FROM ({STATUS})"


def status(t):
    labels = t.docs_labelled.where("label is not null").select("dataset", "label")
    return Q.dataset_status(t.sample_files, t.files_here, t.files_expected, labels, 2, [1], 2)


@query("c02_validate_dataset", STATUS_SQL)
def _(t):
    return status(t)


MANIFEST_ROWS = "SELECT dataset, CASE WHEN dataset = 'en' THEN md5('images/0_b0.tif') WHEN dataset = 'de' THEN 'TBD' ELSE md5(dataset) END AS checksum, 'CC-BY' AS license, CASE WHEN dataset = 'es' THEN 'UNKNOWN' ELSE dataset END AS source FROM (SELECT DISTINCT dataset FROM docs_labelled UNION ALL SELECT 'none')"


def manifest(t):
    names = t.docs_labelled.select("dataset").distinct().unionByName(t.spark.createDataFrame([("none",)], "dataset string"))
    check = F.when(F.col("dataset") == "en", F.md5(F.lit("images/0_b0.tif"))).when(F.col("dataset") == "de", "TBD").otherwise(F.md5("dataset"))
    return names.select("dataset", check.alias("checksum"), F.lit("CC-BY").alias("license"), F.when(F.col("dataset") == "es", "UNKNOWN").otherwise(F.col("dataset")).alias("source"))


def observed(t):
    summary = I.directory_summary(t.files_here, ["dataset"])
    expected = t.files_expected.select("dataset", "path", F.col("path").alias("position"))
    return manifest(t), summary, expected, t.files_here


OBSERVED = f"""SELECT m.*, coalesce(file_count, 0) AS file_count, coalesce(total_bytes, 0) AS total_bytes, coalesce(expected, 0) AS expected, coalesce(missing, 0) AS missing, first_path FROM ({MANIFEST_ROWS}) m
 LEFT JOIN (SELECT dataset, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_bytes FROM files_here GROUP BY ALL) s ON s.dataset = m.dataset
 LEFT JOIN (SELECT e.dataset, count(*) AS expected, count(CASE WHEN f.path IS NULL THEN 1 END) AS missing, min(e.path) AS first_path FROM files_expected e LEFT JOIN files_here f ON f.path = e.path GROUP BY ALL) x ON x.dataset = m.dataset"""
RECORDED = "coalesce(checksum, '') NOT IN ('', 'TBD')"


@query("j12_manifest_inventory", f"SELECT dataset, file_count, total_bytes, expected, missing FROM ({OBSERVED})")
def _(t):
    return Q._observed(*observed(t)).select("dataset", "file_count", "total_bytes", "expected", "missing")


@query("c03_availability", f"""SELECT dataset, CASE WHEN file_count = 0 THEN 'NOT_PRESENT' WHEN complete AND {RECORDED} THEN 'PRESENT' ELSE 'PARTIAL' END AS status, file_count, total_bytes, {RECORDED} AS recorded, complete,
 CASE WHEN file_count = 0 THEN 'not downloaded' WHEN NOT complete THEN 'expected files are missing' WHEN NOT ({RECORDED}) OR complete IS NULL THEN 'not fully verifiable' ELSE 'complete' END AS note
 FROM (SELECT *, CASE WHEN file_count > 0 AND expected > 0 THEN missing = 0 END AS complete FROM ({OBSERVED}))""")
def _(t):
    return Q.availability(*observed(t))


@query("c04_verification", f"""SELECT dataset, download, completeness, checksum_status, overall, overall IN ('PASS', 'PENDING') AS passed FROM (SELECT *, CASE WHEN file_count = 0 THEN 'PENDING' WHEN completeness = 'INCOMPLETE' OR checksum_status = 'MISMATCH' THEN 'FAIL' ELSE 'PASS' END AS overall FROM
 (SELECT o.*, CASE WHEN file_count = 0 THEN 'NOT_DOWNLOADED' ELSE 'DOWNLOADED' END AS download, CASE WHEN file_count = 0 THEN 'N/A' WHEN expected = 0 THEN 'UNKNOWN' WHEN missing > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS completeness,
 CASE WHEN file_count = 0 THEN 'N/A' WHEN NOT ({RECORDED.replace('checksum', 'o.checksum')}) OR f.checksum IS NULL THEN 'UNAVAILABLE' WHEN f.checksum = o.checksum THEN 'VERIFIED' ELSE 'MISMATCH' END AS checksum_status FROM ({OBSERVED}) o LEFT JOIN files_here f ON f.path = first_path))""")
def _(t):
    return Q.verification(*observed(t))


# --- splits and composite jobs --------------------------------------------------------------------

GROUP_SPLIT = f"SELECT doc_id, dataset, group_id, split FROM docs_labelled JOIN ({flat_sql('SELECT DISTINCT group_id AS g FROM docs_labelled', 'g')}) s ON s.g = group_id"


def grouped(t):
    return R.split_groups(t.docs_labelled.select("doc_id", "sample_id", "dataset", "group_id"), "group_id")


@query("c05_preprocessing_plan", f"SELECT 'samples' AS item, count(*) AS n FROM ({PAIRS}) UNION ALL SELECT 'issues', count(*) FROM ({ISSUES}) UNION ALL SELECT 'split_' || split, count(*) FROM ({GROUP_SPLIT}) GROUP BY ALL UNION ALL SELECT 'patches', count(*) FROM ({P.GRID})")
def _(t):
    def n(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")

    splits = grouped(t).groupBy("split").agg(F.count("*").alias("n")).select(F.concat(F.lit("split_"), "split").alias("item"), "n")
    return n("samples", I.discover_pairs(paired_files(t))).unionByName(n("issues", issues(t))).unionByName(splits).unionByName(n("patches", P.manifest(t)))


@query("c06_split_manifest", f"SELECT doc_id, group_id, split, true AS leakage_ok FROM ({GROUP_SPLIT})")
def _(t):
    m = grouped(t)
    leaks = R.leakage(m, "group_id").agg((F.count("*") == 0).alias("leakage_ok"))  # one row
    return m.select("doc_id", "group_id", "split").crossJoin(F.broadcast(leaks))


GATE_SQL = f"""SELECT s.*, '1.0' AS version, 'p1' AS preprocessing_version, m.license, m.source, pixels FROM ({STATUS_SQL}) s JOIN ({MANIFEST_ROWS}) m ON m.dataset = s.dataset JOIN (SELECT dataset, count(CASE WHEN label = 1 THEN 1 END) AS pixels FROM docs_labelled GROUP BY ALL) f ON f.dataset = s.dataset"""
READY_SQL = f"""SELECT dataset, overall IN ('READY', 'READY_WITH_WARNINGS') AND file_status = 'PASS' AND checksum_status <> 'FAIL' AND label_status = 'PASS' AND dimension_status <> 'FAIL' AND pixels > 0 AS ready, source <> 'UNKNOWN' AS provenance_complete, version, preprocessing_version FROM ({GATE_SQL})"""


def gates(t):
    own = t.docs_labelled.groupBy("dataset").agg(F.count_if(F.col("label") == 1).alias("focus_pixels"), F.count_if(F.col("label").isNotNull()).alias("stats"), F.count("*").alias("patches"))
    rows = status(t).join(manifest(t), "dataset").join(own, "dataset")
    leaks = R.leakage(grouped(t), "group_id").agg(F.count("*").alias("leaks"))  # one row
    rows = rows.crossJoin(F.broadcast(leaks)).withColumn("absent_classes", F.when(F.col("focus_pixels") > 0, 0).otherwise(1))
    return Q.readiness(rows.withColumns({"version": F.lit("1.0"), "preprocessing_version": F.lit("p1")}))


@query("g38_readiness_gates", f"SELECT dataset, ready, provenance_complete FROM ({READY_SQL})")
def _(t):
    return gates(t).select("dataset", "ready", "provenance_complete")


@query("c08_readiness_handoff", f"SELECT dataset, version, preprocessing_version, ready FROM ({READY_SQL})")
def _(t):
    return Q.handoff(gates(t))


@query("c07_prepare_dataset", f"""SELECT r.dataset, ready, overall, samples, train_samples FROM ({READY_SQL}) r JOIN ({STATUS_SQL}) s ON s.dataset = r.dataset
 JOIN (SELECT dataset, count(*) AS samples, count(CASE WHEN split = 'train' THEN 1 END) AS train_samples FROM ({GROUP_SPLIT}) GROUP BY ALL) g ON g.dataset = r.dataset""")
def _(t):
    counts = grouped(t).groupBy("dataset").agg(F.count("*").alias("samples"), F.count_if(F.col("split") == "train").alias("train_samples"))
    return gates(t).select("dataset", "ready", "overall").join(counts, "dataset")


@query("c15_inspect_dataset", f"SELECT d.dataset, count(*) AS samples, count(*) - count(label) AS missing_labels, count(CASE WHEN sample_id IN (SELECT sample_id FROM ({ISSUES}) WHERE severity = 'ERROR') THEN 1 END) AS with_issues FROM docs_labelled d GROUP BY ALL")
def _(t):
    rows = t.docs_labelled
    return S.dataset_statistics(rows, t.image_sizes, issues(t).where("severity = 'ERROR'")).drop("sizes")


@query("c19_dataset_reports", f"SELECT 'dataset' AS section, dataset AS item, count(*) AS n FROM docs_labelled GROUP BY ALL UNION ALL SELECT 'split', split, count(*) FROM ({GROUP_SPLIT}) GROUP BY ALL UNION ALL SELECT 'class', class_name, pixels FROM ({P.DIST}) UNION ALL SELECT 'patch', split, count(*) FROM ({P.MANIFEST}) GROUP BY ALL")
def _(t):
    return M.sections(
        dataset=t.docs_labelled.groupBy(F.col("dataset").alias("item")).agg(F.count("*").alias("n")),
        split=grouped(t).groupBy(F.col("split").alias("item")).agg(F.count("*").alias("n")),
        **{"class": P.distribution(t).select(F.col("class_name").alias("item"), F.col("pixels").alias("n"))},
        patch=S.patch_statistics(P.manifest(t)).where("level = 'split'").select("item", F.col("patches").alias("n")),
    )


# --- sinks, each written to the shared folder and read back --------------------------------------


@query("s08_write_jsonl", P.MANIFEST)
def _(t):
    m, path = P.manifest(t), scratch(t.spark, "s08")
    K.write_jsonl(m, path)
    return K.read_records(t.spark, path, m.schema).select(*T.MANIFEST)


@query("s09_write_csv", P.MANIFEST)
def _(t):
    m, path = P.manifest(t), scratch(t.spark, "s09")
    K.write_csv(m, path, T.MANIFEST)
    return K.read_records(t.spark, path, m.schema, "csv")


@query("s10_write_splits", f"SELECT doc_id, group_id, split FROM ({GROUP_SPLIT})")
def _(t):
    path = scratch(t.spark, "s10")
    K.write_splits(grouped(t).select("doc_id", "group_id", "split"), path)
    return t.spark.read.parquet(f"{path}/parquet").select("doc_id", "group_id", "split")


@query("s11_write_report", "SELECT 'labels' AS section, CAST(label AS VARCHAR) AS item, count(*) AS n FROM pixels GROUP BY ALL UNION ALL SELECT 'scenes', scene, count(*) FROM pixels GROUP BY ALL")
def _(t):
    path = scratch(t.spark, "s11")
    tables = {name: t.pixels.groupBy(F.col(c).cast("string").alias("item")).agg(F.count("*").alias("n")) for name, c in (("labels", "label"), ("scenes", "scene"))}
    K.write_report(tables, path)
    parts = [K.read_records(t.spark, f"{path}/{name}", df.schema).select(F.lit(name).alias("section"), "item", "n") for name, df in tables.items()]
    return parts[0].unionByName(parts[1])


@query("s12_append_metric_log", "SELECT run_id, epoch, value, CAST(NULL AS VARCHAR) AS note FROM metric_log")
def _(t):
    path, columns = scratch(t.spark, "s12"), ["run_id", "epoch", "value", "note"]
    first = t.metric_log.where("epoch = 0").drop("ts")
    K.append_log(first, path, columns)
    K.append_log(t.metric_log.where("epoch > 0").drop("ts").withColumn("extra", F.lit(1)), path, columns)
    kinds = dict(t.metric_log.dtypes)
    return K.read_records(t.spark, f"{path}/jsonl", ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


@query("s13_checksum_sidecar", "SELECT sha256(content) || '  ' || path AS value FROM file_inventory")
def _(t):
    path = scratch(t.spark, "s13")
    K.write_checksums(I.checksums(t.file_inventory).select("path", "checksum"), path)
    return t.spark.read.text(path)


@query("s14_read_records_back", f"SELECT scene, band, {P.STATS_ROUNDED} FROM ({P.stats_sql()})")
def _(t):
    path, stats = scratch(t.spark, "s14"), P.r(P.band_stats(t))
    K.write_jsonl(stats, path)
    return K.read_records(t.spark, path, stats.schema)


@query("s15_write_prepared_dataset", f"SELECT 'splits' AS output, count(*) AS n FROM ({GROUP_SPLIT}) UNION ALL SELECT 'patches', count(*) FROM ({P.MANIFEST}) UNION ALL SELECT 'issues', count(*) FROM ({ISSUES})")
def _(t):
    path = scratch(t.spark, "s15")
    K.write_tables({"splits": grouped(t), "patches": P.manifest(t), "issues": issues(t)}, path, "v1")
    parts = [t.spark.read.parquet(f"{path}/v1/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("output"), "n") for n in ("splits", "patches", "issues")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s16_versioned_dataset", f"SELECT CAST(1 AS INT) AS version, 'splits' AS output, count(*) AS n FROM ({GROUP_SPLIT}) UNION ALL SELECT 1, 'issues', count(*) FROM ({ISSUES}) UNION ALL SELECT 2, 'splits', count(*) FROM ({GROUP_SPLIT}) WHERE split = 'train' UNION ALL SELECT 2, 'issues', count(*) FROM ({ISSUES})")
def _(t):
    """Two versions of a prepared dataset; the second replaces one of its tables."""
    v = VersionedTables(t.spark, scratch(t.spark, "s16"))
    v.commit({"splits": grouped(t), "issues": issues(t)}, expected=0)
    v.commit({"splits": v.snapshot(1).table("splits").where("split = 'train'")}, expected=1)
    parts = [v.snapshot(n).table(name).agg(F.count("*").alias("n")).select(F.lit(n).alias("version"), F.lit(name).alias("output"), "n") for n in (1, 2) for name in ("splits", "issues")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s17_versioned_log", "SELECT run_id, epoch, value FROM metric_log")
def _(t):
    """The metric log, added to in three commits and compacted."""
    v, log = VersionedTables(t.spark, scratch(t.spark, "s17")), t.metric_log.select("run_id", "epoch", "value")
    for low, high in ((0, 5), (5, 20), (20, 1 << 30)):
        v.append({"log": log.where((F.col("epoch") >= low) & (F.col("epoch") < high))})
    v.compact("log")
    v.remove_old(keep=1, older_than=0)
    return v.snapshot().table("log")


def page_meta(path: str, raw: bytes) -> dict:
    """A reader of pages as a user would write one for rasters; it fails on pages without an article."""
    if b"<article" not in raw:
        raise ValueError(f"{path} has no article")
    return {"height": raw.count(b"\n"), "width": max(map(len, raw.split(b"\n"))), "count": 1, "dtype": "uint8"}


def page_labels(path: str, raw: bytes):
    """A reader of class arrays: 1 where a tag begins, 2 where one ends, else 0."""
    import numpy as np

    x = np.frombuffer(raw, np.uint8)
    return (x == ord("<")) + 2 * (x == ord(">"))


_PAGE_ID = r"([0-9]+)\.html$"


@query("s18_reader_meta", """SELECT page_id, CASE WHEN contains(content, '<article') THEN CAST(strlen(content) - strlen(replace(content, chr(10), '')) + 1 AS INT) END AS height,
 CASE WHEN contains(content, '<article') THEN CAST(list_max(list_transform(string_split(content, chr(10)), lambda x: strlen(x))) AS INT) END AS width, CASE WHEN contains(content, '<article') THEN 'uint8' END AS dtype FROM file_inventory""")
def _(t):
    meta = I.read_meta(scanned_pages(t, "s18", "content"), page_meta)
    return meta.select(F.regexp_extract("path", _PAGE_ID, 1).cast("long").alias("page_id"), "height", "width", "dtype")


@query("s19_reader_labels", """SELECT label, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS files FROM (SELECT page_id, unnest([0, 1, 2]) AS label, unnest([strlen(replace(replace(content, '<', ''), '>', '')) + 1, strlen(content) - strlen(replace(content, '<', '')),
 strlen(content) - strlen(replace(content, '>', ''))]) AS n FROM file_inventory) WHERE n > 0 GROUP BY ALL""")
def _(t):
    found = I.read_labels(scanned_pages(t, "s19", "content"), page_labels)
    return found.groupBy("label").agg(F.sum("pixels").alias("pixels"), F.count("*").alias("files"))
