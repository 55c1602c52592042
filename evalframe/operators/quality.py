"""Validation of samples and datasets, availability, verification and readiness.

Samples are long: a row for each file (``sample_id``, ``dataset``, ``kind``
image or label, ``path``), and ``files`` has the paths that exist.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.sources.inventory import read_labels, read_meta

#: The names of issues.
CATEGORIES = ("duplicate_id", "missing_file", "unsupported_type", "missing_label", "inconsistent_dimensions", "corrupted_metadata")


def _issue(df: DataFrame, category: str, detail, severity: str = "ERROR") -> DataFrame:
    return df.select("sample_id", F.lit(category).alias("category"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))


def duplicate_ids(samples: DataFrame) -> DataFrame:
    """One row for each id that occurs more than once."""
    return samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")


def size_issues(sample_files: DataFrame, meta: DataFrame) -> DataFrame:
    """Unreadable metadata, bands of different sizes, labels of a size that no image has."""
    rows = sample_files.join(meta.select("path", "height", "width"), "path", "left")
    broken = _issue(rows.where("height is null"), "corrupted_metadata", F.col("path"))
    size = F.struct("height", "width")
    ok = F.col("height").isNotNull()
    per = rows.groupBy("sample_id").agg(F.collect_set(F.when((F.col("kind") == "image") & ok, size)).alias("images"), F.collect_set(F.when((F.col("kind") == "label") & ok, size)).alias("labels"))
    differing = _issue(per.where(F.size("images") > 1), "inconsistent_dimensions", F.lit("bands"))
    odd = F.size(F.array_except("labels", "images")) > 0
    label = _issue(per.where((F.size("images") > 0) & odd), "inconsistent_dimensions", F.lit("label"))
    return broken.unionByName(differing).unionByName(label)


def validate_samples(samples: DataFrame, sample_files: DataFrame, files: DataFrame, meta: DataFrame | None = None, bands: int | None = None, meta_reader: Callable | None = None) -> DataFrame:
    """All issues of samples and their files. A sample without a label is a warning.

    Sizes are checked by a table ``meta``, or by ``meta_reader`` over the ``content`` of the samples' files.
    """
    if meta is None and meta_reader is not None:
        meta = read_meta(files.join(sample_files.select("path").distinct(), "path", "left_semi"), meta_reader)
    present = sample_files.join(files.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left")
    parts = [
        _issue(duplicate_ids(samples), "duplicate_id", F.col("n")),
        _issue(present.where("_here is null"), "missing_file", F.col("path")),
        _issue(present.where(F.col("_here") & ~X.supported_type(F.col("path"))), "unsupported_type", F.col("path")),
    ]
    per = samples.select("sample_id").distinct().join(sample_files.groupBy("sample_id").agg(F.count_if(F.col("kind") == "label").alias("labels"), F.count_if(F.col("kind") == "image").alias("images")), "sample_id", "left")
    parts.append(_issue(per.where("coalesce(labels, 0) = 0"), "missing_label", F.lit(""), "WARNING"))
    if bands is not None:
        parts.append(_issue(per.where(F.coalesce("images", F.lit(0)) != bands), "inconsistent_dimensions", F.lit("bands expected")))
    if meta is not None:
        parts.append(size_issues(sample_files, meta))
    return reduce(lambda a, b: a.unionByName(b), parts)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(F.count("*").alias("n"))


def validation_summary(samples: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: samples, those with an error, the rest, and issues of each category."""
    total = samples.agg(F.count("*").alias("total"))
    bad = issues.agg(F.count_distinct(F.when(F.col("severity") == "ERROR", F.col("sample_id"))).alias("invalid"), *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    out = total.crossJoin(F.broadcast(bad))  # one row each
    return out.withColumn("valid", F.greatest(F.col("total") - F.col("invalid"), F.lit(0)))


def qc_report(samples: DataFrame, issues: DataFrame) -> DataFrame:
    """The summary with its warnings and whether there are no errors."""
    w = issues.agg(F.count_if(F.col("severity") == "WARNING").alias("warnings"), (F.count_if(F.col("severity") == "ERROR") == 0).alias("passed"))
    return validation_summary(samples, issues).crossJoin(F.broadcast(w))


def present_classes(pixels: DataFrame, required: list[int]) -> DataFrame:
    """Classes of each sample and required ones that it lacks, from distinct labels."""
    per = pixels.groupBy("sample_id").agg(F.array_sort(F.collect_set("label")).alias("present"))
    return per.withColumn("absent", F.array_except(F.array(*map(F.lit, required)), "present"))


def dataset_status(sample_files: DataFrame, files: DataFrame, expected: DataFrame | None, labels: DataFrame | None, num_classes: int, required: list[int], bands: int | None = None, strict: bool = False, label_reader: Callable | None = None) -> DataFrame:
    """Check states of each dataset and its overall state.

    ``files``: path, checksum. ``expected``: path, expected. ``labels``: dataset, label; without it ``label_reader``
    reads the ``content`` of the label files. As the rules have it, one file is as good as the expected number of bands
    unless ``strict``; labels count only if all files exist.
    """
    if labels is None and label_reader is not None:
        own = sample_files.where("kind = 'label'").select("path", "dataset").distinct()
        labels = read_labels(files.join(own.select("path").distinct(), "path", "left_semi"), label_reader).join(own, "path").select("dataset", "label")
    here = sample_files.join(files.select("path", "checksum").dropDuplicates(["path"]).withColumn("_here", F.lit(True)), "path", "left")
    wrong = F.lit(None).cast("boolean")
    if expected is not None:
        here = here.join(expected.select("path", "expected").dropDuplicates(["path"]), "path", "left")
        wrong = F.col("_here") & (F.coalesce("expected", F.lit("")) != "") & ~X.checksum_matches(F.col("checksum"), F.col("expected"))
    per = here.groupBy("dataset").agg(F.count_if(F.col("_here").isNull()).alias("missing"), F.count_if(wrong).alias("mismatches"))
    allowed = [bands] if strict else [bands, 1]
    if bands is not None:
        counts = sample_files.where("kind = 'image'").groupBy("dataset", "sample_id").agg(F.count("*").alias("n"))
        per = per.join(counts.groupBy("dataset").agg(F.count_if(~F.col("n").isin(*allowed)).alias("odd_bands")), "dataset", "left")
    else:
        per = per.withColumn("odd_bands", F.lit(0))
    if labels is not None:
        seen = labels.groupBy("dataset").agg(F.count_if((F.col("label") < 0) | (F.col("label") >= num_classes)).alias("bad_labels"), F.collect_set("label").alias("present"))
        per = per.join(seen, "dataset", "left")
    else:
        per = per.withColumns({"bad_labels": F.lit(None).cast("long"), "present": F.lit(None).cast("array<int>")})
    absent = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce("present", F.array().cast("array<int>")))) > 0
    read = (F.col("missing") == 0) & F.lit(labels is not None)
    out = per.withColumns({
        "file_status": F.when(F.col("missing") > 0, "FAIL").otherwise("PASS"),
        "checksum_status": F.lit("NOT_VERIFIED") if expected is None else F.when(F.col("mismatches") > 0, "FAIL").otherwise("PASS"),
        "label_status": F.when(~read, "NOT_VERIFIED").when((F.coalesce("bad_labels", F.lit(0)) > 0) | absent, "FAIL").otherwise("PASS"),
        "dimension_status": F.when(F.coalesce("odd_bands", F.lit(0)) > 0, "FAIL").when(read & F.col("present").isNotNull(), "PASS").otherwise("NOT_VERIFIED"),
    })
    states = F.array("checksum_status", "label_status", "dimension_status")
    warned = (F.col("checksum_status") == "NOT_VERIFIED") | (F.col("label_status") == "NOT_VERIFIED")
    overall = F.when(F.array_contains(states, "FAIL"), "INVALID").when(F.col("file_status") == "FAIL", "INCOMPLETE").when(warned, "READY_WITH_WARNINGS").otherwise("READY")
    return out.select("dataset", "file_status", "checksum_status", "label_status", "dimension_status", overall.alias("overall"))


def _observed(manifest: DataFrame, summary: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """Each dataset of the manifest with its files, and its expected files that are there or not."""
    found = expected.join(files.select("dataset", "path", F.lit(True).alias("_here")).distinct(), ["dataset", "path"], "left")
    per = found.groupBy("dataset").agg(F.count("*").alias("expected"), F.count_if(F.col("_here").isNull()).alias("missing"))
    return manifest.join(summary, "dataset", "left").join(per, "dataset", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("file_count", "total_bytes", "expected", "missing")})


def availability(manifest: DataFrame, summary: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """PRESENT, PARTIAL or NOT_PRESENT for each dataset of the manifest, with a note."""
    o = _observed(manifest, summary, expected, files).withColumn("recorded", X.checksum_available(F.col("checksum")))
    complete = F.when((F.col("file_count") > 0) & (F.col("expected") > 0), F.col("missing") == 0)
    o = o.withColumn("complete", complete)
    status = F.when(F.col("file_count") == 0, "NOT_PRESENT").when(F.col("complete") & F.col("recorded"), "PRESENT").otherwise("PARTIAL")
    note = F.when(F.col("file_count") == 0, "not downloaded").when(~F.col("complete"), "expected files are missing").when(~F.col("recorded") | F.col("complete").isNull(), "not fully verifiable").otherwise("complete")
    return o.select("dataset", status.alias("status"), "file_count", "total_bytes", "recorded", "complete", note.alias("note"))


def verification(manifest: DataFrame, summary: DataFrame, expected: DataFrame, files: DataFrame, require_present: bool = False) -> DataFrame:
    """Download, completeness, checksum and overall state of each dataset; only its first expected file is hashed."""
    o = _observed(manifest, summary, expected, files)
    first = expected.groupBy("dataset").agg(F.min_by("path", "position").alias("path"))
    target = first.join(files.select("dataset", "path", F.col("checksum").alias("actual")).dropDuplicates(["dataset", "path"]), ["dataset", "path"])
    o = o.join(target.select("dataset", "actual"), "dataset", "left")
    none = F.col("file_count") == 0
    complete = F.when(none, "N/A").when(F.col("expected") == 0, "UNKNOWN").when(F.col("missing") > 0, "INCOMPLETE").otherwise("COMPLETE")
    check = F.when(none, "N/A").when(~X.checksum_available(F.col("checksum")) | F.col("actual").isNull(), "UNAVAILABLE").when(X.checksum_matches(F.col("actual"), F.col("checksum")), "VERIFIED").otherwise("MISMATCH")
    o = o.withColumns({"download": F.when(none, "NOT_DOWNLOADED").otherwise("DOWNLOADED"), "completeness": complete, "checksum_status": check})
    failed = (F.col("completeness") == "INCOMPLETE") | (F.col("checksum_status") == "MISMATCH")
    overall = F.when(none, "PENDING").when(failed, "FAIL").otherwise("PASS")
    o = o.withColumn("overall", overall)
    passed = (F.col("overall") == "PASS") | ((F.col("overall") == "PENDING") & F.lit(not require_present))
    return o.select("dataset", "download", "completeness", "checksum_status", "overall", passed.alias("passed"))


#: The names of the gates, in order.
GATES = (
    "validation_ok", "required_files_exist", "checksums_not_failed", "labels_valid", "dimensions_valid", "splits_disjoint", "required_classes_exist", "focus_exists",
    "normalization_stats_exist", "patch_manifest_exists", "preprocessing_version_recorded", "dataset_version_recorded", "licensing_acceptable", "provenance_complete",
)
CRITICAL = GATES[:-1]


def readiness(inputs: DataFrame) -> DataFrame:
    """Gates of each dataset, those critical ones that fail, warnings, and whether it is ready.

    ``inputs``: the columns of ``dataset_status`` and leaks, absent_classes, focus_pixels, stats, patches,
    preprocessing_version, version, license, source.
    """
    recorded = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("preprocessing_version", "version")]
    values = [
        F.col("overall").isin("READY", "READY_WITH_WARNINGS"), F.col("file_status") == "PASS", F.col("checksum_status") != "FAIL", F.col("label_status") == "PASS",
        F.col("dimension_status") != "FAIL", F.col("leaks") == 0, F.col("absent_classes") == 0, F.col("focus_pixels") > 0, F.col("stats") > 0, F.col("patches") > 0,
        *recorded, X.license_ok(F.col("license")), X.provenance_known(F.col("source"), F.col("license")),
    ]
    gates = {g: F.coalesce(v, F.lit(False)) for g, v in zip(GATES, values)}
    out = inputs.withColumns(gates)
    failed = F.array_compact(F.array(*[F.when(~F.col(g), F.lit(g)) for g in CRITICAL]))
    warnings = F.array_compact(F.array(F.when(F.col("checksum_status") != "PASS", "checksums not verified"), F.when(~F.col("provenance_complete"), "provenance incomplete"), F.when(F.col("overall") == "INVALID", "validation reported INVALID")))
    return out.withColumns({"critical_failures": failed, "warnings": warnings, "ready": F.size(failed) == 0})


def handoff(ready: DataFrame, columns: tuple[str, ...] = ("dataset", "version", "preprocessing_version", "ready")) -> DataFrame:
    """The bundle that an experiment takes over: versions and the verdict."""
    return ready.select(*columns)
