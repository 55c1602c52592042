"""Fixed vocabularies as small dimension DataFrames.

The values are fixed ones of the domain, not data: class names, failure
categories, statuses, colours, defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class indices and names, the class and classes of interest.
CLASSES = ((0, "clear"), (1, "thick_cloud"), (2, "thin_cloud"), (3, "cloud_shadow"))
FOCUS_CLASS = "thin_cloud"
CLOUD_CLASSES = (1, 2)
#: Splits with their shares, seed, patch size and overlap, percentiles of stretches, file types.
SPLITS = ("train", "val", "test")
RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}
SEED = 42
PATCH, OVERLAP = 512, 0
PERCENTILES = (2.0, 98.0)
EXTENSIONS = (".tif", ".tiff")
EPSILON = 1e-8
#: What stands for a checksum that is not known yet; severities and the rates from which they hold.
PLACEHOLDERS = ("", "TBD", "PLACEHOLDER", "NONE", "REQUIRES VERIFICATION")
SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_THRESHOLDS = {"CRITICAL": 0.75, "HIGH": 0.5, "MEDIUM": 0.25}
#: Class and the category of its false negatives.
CLASS_CATEGORIES = (("thin_cloud", "thin_cloud_failure"), ("thick_cloud", "thick_cloud_failure"), ("cloud_shadow", "cloud_shadow_failure"), ("clear", "clear_surface_failure"))
#: Category and measurability.
TAXONOMY = (
    ("false_positive", "measurable"),
    ("false_negative", "measurable"),
    ("class_confusion", "measurable"),
    ("thin_cloud_failure", "measurable"),
    ("thick_cloud_failure", "measurable"),
    ("cloud_shadow_failure", "measurable"),
    ("clear_surface_failure", "measurable"),
    ("edge_error", "deferred"),
    ("small_object_failure", "deferred"),
    ("high_confidence_error", "not_measurable"),
    ("low_confidence_error", "not_measurable"),
)
#: Class and colour.
COLORS = ((0, "clear", "#1a9850"), (1, "thick_cloud", "#f7f7f7"), (2, "thin_cloud", "#fdae61"), (3, "cloud_shadow", "#4d4d4d"))
#: Band indices of true-colour and false-colour composites by number of bands.
RGB_BANDS = {13: (3, 2, 1), 4: (2, 1, 0)}
FALSE_COLOR_BANDS = {13: (7, 3, 2), 4: (3, 2, 1)}
#: The required fields of a provenance record.
REQUIRED_FIELDS = (
    "dataset_id", "name", "version", "homepage", "source", "official_paper", "citation", "license", "redistribution",
    "download_required", "manual_steps", "expected_directory", "expected_size", "checksum_algorithm", "checksum",
    "download_date", "bands", "label_schema", "intended_use", "notes",
)
#: Control paths that two arms of an experiment must share.
FAIRNESS_PATHS = (
    "seed",
    "training.epochs", "training.batch_size", "training.grad_accum_steps", "training.device",
    "training.seed", "training.deterministic", "training.mixed_precision", "training.init_strategy",
    "training.max_grad_norm", "training.optimizer", "training.scheduler", "training.loss",
    "training.early_stopping", "training.checkpoint", "training.logging",
    "evaluation.mode", "evaluation.num_classes", "evaluation.class_names", "evaluation.ignore_index",
    "evaluation.dataset", "evaluation.split",
    "failure.dataset", "failure.split", "failure.mode", "failure.class_names", "failure.top_k",
    "failure.ignore_index", "failure.severity_thresholds",
)
#: Control paths that tell two arms apart and are left out of the comparison.
IDENTITY_PATHS = ("training.experiment_name", "training.checkpoint.dir", "training.logging.dir", "evaluation.model_id", "failure.model_id")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES), "class_index int, class_name string")


def values_sql(rows: tuple, names: str) -> str:
    """The same rows as a SQL table expression."""
    quoted = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {quoted}) AS v({names})"
