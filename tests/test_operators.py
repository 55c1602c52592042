"""Hand-computed and metamorphic cases of the library's operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalframe.functions import exprs as X
from evalframe.functions.vocab import classes
from evalframe.operators import augment as A
from evalframe.operators import compare as M
from evalframe.operators import confusion as C
from evalframe.operators import failures as E
from evalframe.operators import quality as Q
from evalframe.operators import ranking as R
from evalframe.operators import stats as S
from evalframe.operators import training_log as L
from evalframe.sources import inventory as I
from evalframe.sources import sinks as K
from evalframe.sources.shared import scratch
from evalframe.streaming import metrics as ST


def matrix(spark, rows):
    cells = [("m", t, p, n) for t, r in enumerate(rows) for p, n in enumerate(r) if n]
    return spark.createDataFrame(cells, "k string, true_class int, pred_class int, n long")


def metrics(spark, rows):
    names = spark.createDataFrame([(i, f"c{i}") for i in range(len(rows))], "class_index int, class_name string")
    return {r.class_index: r for r in C.class_metrics(C.class_counts(matrix(spark, rows), ["k"], names)).collect()}


def test_perfect_and_all_wrong(spark):
    assert all(r.iou == r.f1 == 1.0 for r in metrics(spark, [[5, 0], [0, 3]]).values())
    wrong = metrics(spark, [[0, 4], [3, 0]])
    assert all(r.iou == 0.0 and r.dice == 0.0 and r.f1 is None for r in wrong.values())


def test_absent_class_is_undefined_not_zero(spark):
    r = metrics(spark, [[7, 0], [0, 0]])[1]
    assert (r.iou, r.dice, r.precision, r.recall, r.f1) == (None,) * 5
    assert r.tn == 7


def test_batches_equal_all_and_ignore(spark):
    rows = [(t, p) for t, p in zip([0, 0, 1, 1, 2, 2, 3, 3, 255], [0, 1, 1, 1, 2, 2, 3, 0, 0])]
    df = spark.createDataFrame(rows, "true_class int, pred_class int")
    parts = [C.confusion(spark.createDataFrame(rows[i : i + 4], df.schema), [], 4, ignore=255) for i in range(0, 9, 4)]
    assert sorted(C.merge(*parts).collect()) == sorted(C.confusion(df, [], 4, ignore=255).collect())
    assert C.confusion(df, [], ignore=255).agg(F.sum("n")).first()[0] == 8


def test_out_of_range_class_fails(spark):
    df = spark.createDataFrame([(0, 9)], "true_class int, pred_class int")
    assert C.label_violations(df, 4).count() == 1
    with pytest.raises(Exception, match="class out of range"):
        C.confusion(df, [], 4).collect()


@pytest.mark.parametrize("length,want", [(500, [0, 244]), (512, [0, 256]), (509, [0, 253]), (100, [0])])
def test_axis_offsets(spark, length, want):
    assert spark.range(1).select(X.axis_offsets(F.lit(length), 256, 256)).first()[0] == want


def test_window_origin(spark):
    tr = F.array(*[F.lit(float(x)) for x in (10, 0, 500000, 0, -10, 4000000)])
    out = spark.range(1).select(X.window_origin(tr, F.lit(5), F.lit(3))).first()[0]
    assert out == [10.0, 0.0, 500030.0, 0.0, -10.0, 3999950.0]


def test_splits_are_exact_and_independent_of_order(spark):
    ids = [f"s{i:03d}" for i in range(100)]
    first = {r.sample_id: r.split for r in R.split_flat(spark.createDataFrame([(i,) for i in ids], "sample_id string")).collect()}
    random.Random(1).shuffle(ids)
    again = {r.sample_id: r.split for r in R.split_flat(spark.createDataFrame([(i,) for i in ids], "sample_id string").repartition(7)).collect()}
    assert first == again
    assert [list(first.values()).count(s) for s in ("train", "val", "test")] == [70, 15, 15]
    other = {r.sample_id: r.split for r in R.split_flat(spark.createDataFrame([(i,) for i in ids], "sample_id string"), seed=1).collect()}
    assert other != first
    with pytest.raises(Exception, match="duplicate ids"):
        R.split_flat(spark.createDataFrame([("a",), ("a",), ("b",)], "sample_id string")).collect()


def test_groups_stay_together(spark):
    rows = [(f"s{i}", f"g{i // 5}") for i in range(50)]
    out = R.split_groups(spark.createDataFrame(rows, "sample_id string, g string"), "g")
    assert R.leakage(out, "g").count() == 0 and out.count() == 50


def test_curated_subset_covers_rare_classes(spark):
    labels = [(f"s{i:02d}", 0) for i in range(20)] + [("s03", 2), ("s07", 3), ("s03", 3)]
    samples = spark.createDataFrame([(f"s{i:02d}",) for i in range(20)], "sample_id string")
    out = R.curated_subset(samples, spark.createDataFrame(labels, "sample_id string, label int"), [2, 3, 0], 6).collect()
    assert {r.sample_id for r in out if r.forced} == {"s03"} and len(out) == 6


def test_rank_equals_global_order(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", rng.choice([0.0, 0.1, 0.3, 0.5, 0.9, 0.1001]), rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, error_rate double, error_count long").withColumn("severity", X.severity(F.col("error_rate")))
    got = [r.sample_id for r in R.rank_samples(df).orderBy("rank").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))]


@pytest.mark.parametrize(
    "focus,macro,cost,want",
    [(0.05, 0.02, 1.0, "IMPROVED"), (0.02, 0.02, 2.0, "COMPUTE_UNJUSTIFIED"), (-0.02, 0.05, 1.0, "REGRESSION"), (0.0, 0.0, 1.0, "NO_SIGNIFICANT_IMPROVEMENT"), (None, 0.0, 1.0, "INCONCLUSIVE")],
)
def test_verdicts(spark, focus, macro, cost, want):
    row = [("REAL", "MEASURED", focus, macro, 0.0, False, cost, cost, 3)]
    schema = "data_regime string, status string, focus_delta double, macro_delta double, worst_delta double, regressed boolean, parameter_ratio double, train_ratio double, seeds int"
    assert M.decide(spark.createDataFrame(row, schema)).first().outcome == want


def test_fairness_of_controls(spark):
    a = spark.createDataFrame([("seed", "1"), ("training.epochs", "5"), ("x", None)], "path string, value string")
    b = spark.createDataFrame([("seed", "2"), ("x", None), ("y", "1")], "path string, value string")
    assert {r.path: r.matches for r in M.fairness(a, b).collect()} == {"seed": False, "training.epochs": False, "x": True, "y": False}
    assert M.is_fair(M.fairness(a, a), F.lit("h1"), F.lit("h2")).first().fair
    assert not M.is_fair(M.fairness(a, a), F.lit("h1"), F.lit("h1")).first().fair


def test_fingerprint_ignores_order_but_not_repeats(spark):
    rows = [(i, str(i % 3)) for i in range(50)]
    one = M.fingerprint(spark.createDataFrame(rows, "a int, b string")).first()
    two = M.fingerprint(spark.createDataFrame(rows[::-1], "a int, b string").repartition(5)).first()
    assert one == two
    assert M.fingerprint(spark.createDataFrame(rows + rows[:1] * 2, "a int, b string")).first().fingerprint != one.fingerprint


def test_fingerprint_tells_alike_rows_apart(spark):
    def of(*rows):
        return M.fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first().fingerprint

    seen = [of(("1|b=2", "3")), of(("1", "2|b=3")), of(("1", None)), of(("1", "\\N")), of(("1", "null")), of(("1", "")), of(("1|b=1:2", None)), of((None, None))]
    assert len(set(seen)) == len(seen)


def test_ranks_of_alike_samples_go_by_id(spark):
    ids = [f"{i:05d}" for i in range(0, 4000, 7)] + ["a", "", "é1", "00000x"]
    df = spark.createDataFrame([(i, 1.0, 1) for i in ids], "sample_id string, error_rate double, error_count long").withColumn("severity", X.severity(F.col("error_rate")))
    got = R.rank_samples(df).orderBy("rank").collect()
    assert [r.sample_id for r in got] == sorted(ids) and [r["rank"] for r in got] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("direct", [1 << 16, 3])
def test_exact_percentiles(spark, direct):
    import numpy as np

    rng = random.Random(7)
    groups = {"a": [rng.gauss(0, 1e3) for _ in range(501)], "b": [2.0] * 40, None: [float(rng.randint(0, 4)) for _ in range(77)], "c": [-1e308, 1e308, 3.0], "d": [5.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    points = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r.g: r.q for r in S.exact_percentiles(df, ["g"], "x", points, direct).collect()}
    assert set(got) == set(groups)
    for g in ("a", "b", None, "d"):
        assert got[g] == pytest.approx(np.quantile(groups[g], points).tolist(), rel=1e-12)
    assert got["c"][0] == -1e308 and got["c"][2] == 3.0 and got["c"][4] == 1e308
    assert S.exact_percentiles(df.drop("g"), [], "x", [0.5]).count() == 1
    assert S.exact_percentiles(df.limit(0), ["g"], "x", [0.5]).count() == 0


def test_band_stats_of_ramps_and_nothing(spark):
    df = spark.createDataFrame([(float(i), -9999.0 if i % 2 else 1.0) for i in range(25)], "b0 double, b1 double")
    low, high = sorted(S.band_stats(df, ["b0", "b1"], nodata={"b1": -9999.0}).collect(), key=lambda r: r.band)
    assert (low.min, low.max, low.mean, round(low.p_low, 6), round(low.p_high, 6)) == (0.0, 24.0, 12.0, 0.48, 23.52)
    assert (high.min, high.max, high.p_low, high.p_high) == (1.0, 1.0, 1.0, 1.0)
    assert "p_low" not in S.band_stats(df, ["b0"], percentiles=None).columns
    assert S.band_stats(df.limit(0), ["b0"]).first()[1:] == (0.0,) * 6
    splits = spark.createDataFrame([(1, "val")], "sample_id int, split string")
    with pytest.raises(Exception, match="the split has no pixels"):
        S.fit_on_split(df.withColumn("sample_id", F.lit(1)), splits, ["b0"]).collect()


def test_readers_of_files(spark, tmp_path):
    """Reader hooks: metadata with a file that cannot be read, labels out of range, bands of an image."""
    import numpy as np

    for name, shape in (("images/a", (1, 2, 3)), ("images/b", (1, 4, 4)), ("labels/a", (2, 3)), ("labels/b", (4, 4))):
        p = tmp_path / f"{name}.tif"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(repr(shape).encode())
    (tmp_path / "images/b.tif").write_bytes(b"broken")
    files = I.checksums(I.scan_files(spark, str(tmp_path), content=True))
    path = F.col("path")
    own = files.select(I.file_stem(path).alias("sample_id"), F.lit("d").alias("dataset"), F.when(path.contains("/images/"), "image").otherwise("label").alias("kind"), "path")

    def meta(path, raw):
        return dict(zip(("height", "width"), eval(raw)[-2:]))

    def labels(path, raw):
        return np.arange(np.prod(eval(raw))).reshape(eval(raw)) % 10

    samples = own.select("sample_id").distinct()
    found = {(r.sample_id, r.category) for r in Q.validate_samples(samples, own, files, meta_reader=meta).collect()}
    assert found == {("b", "corrupted_metadata")}
    counts = {(I_.path[-5:], I_.label): I_.pixels for I_ in I.read_labels(files.where(path.contains("/labels/")), labels).collect()}
    assert counts["a.tif", 5] == 1 and counts["b.tif", 3] == 2
    assert Q.dataset_status(own, files, None, None, 10, [9], label_reader=labels).first().label_status == "PASS"
    assert Q.dataset_status(own, files, None, None, 9, [1], label_reader=labels).first().label_status == "FAIL"
    bands = I.read_bands(files.where(path.endswith("images/a.tif")), lambda p, raw: np.arange(6).reshape(eval(raw))).collect()
    assert [(r.row_px, r.col_px, r.bands) for r in bands] == [(i // 3, i % 3, [float(i)]) for i in range(6)]


def test_files_of_parts_are_scanned_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("images", "a.tif", "é"), ("images", "b=1.tif", "xy"), ("labels", "a.tif", "z")], "folder string, name string, value string")
    K.write_files(rows, str(tmp_path / "root/data"))
    got = {r.path: (r.length, bytes(r.content)) for r in I.scan_folders(spark, str(tmp_path / "root"), content=True).collect()}
    assert got["data/images/a.tif"] == (3, "é\n".encode()) and got["data/labels/a.tif"] == (2, b"z\n") and len(got) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_late_epochs_count_as_if_in_time(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(r, e, float(rng.randint(0, 50))) for r in range(6) for e in range(15)]
    log = spark.createDataFrame(rows, "run_id long, epoch int, value double")
    rng.shuffle(rows)
    for i in range(3):  # three micro-batches, in no order of epochs
        spark.createDataFrame(rows[i::3], log.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    stops = ST.latest_stops(ST.drain(ST.stream_early_stopping(stream, 3, 1.0), str(tmp_path / "s")))
    assert {(r.run_id, r.best, r.stop_epoch) for r in stops.collect()} == {(r.run_id, r.best, -1 if r.stop_epoch is None else r.stop_epoch) for r in L.early_stopping(log, 3, 1.0).collect()}
    best = ST.standing_checkpoints(ST.drain(ST.stream_best_checkpoints(stream), str(tmp_path / "b")))
    assert {tuple(r) for r in best.collect()} == {(r.run_id, r.epoch, r.value) for r in L.best_so_far(log).where("improved").collect()}


def test_writing_needs_a_shared_folder():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("X", (), {"getConf": staticmethod(lambda: Unset.conf)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Unset, "x")


def test_augmentation_registry(spark):
    df = spark.createDataFrame([(1, 0, 0, 2, 3, 5.0)], "sample_id int, row_px int, col_px int, height int, width int, b0 double")
    turned = A.pipeline(df, [("rotate", {"quarters": 4, "p": 1.1})]).first()
    assert (turned.row_px, turned.col_px, turned.height, turned.width) == (0, 0, 2, 3)
    with pytest.raises(KeyError, match="unknown operation"):
        A.pipeline(df, [("blur", {})])
    with pytest.raises(ValueError, match="exists"):
        A.register("flip", A.flip)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(r, e, float(rng.randint(0, 50))) for r in range(12) for e in range(20)]
    log = spark.createDataFrame(rows, "run_id long, epoch int, value double")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    out = ST.drain(ST.stream_early_stopping(stream, 3, 1.0), str(tmp_path / "s"))
    got = {r.run_id: (r.best, r.stop_epoch) for r in ST.latest_stops(out).collect()}
    want = {r.run_id: (r.best, -1 if r.stop_epoch is None else r.stop_epoch) for r in L.early_stopping(log, 3, 1.0).collect()}
    assert got == want


def test_scan_of_real_files(spark, tmp_path):
    for name in ("data/images/a.tif", "data/images/b.TIFF", "data/images/c.txt", "data/labels/a.tif", "data/README.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    files = I.scan_files(spark, str(tmp_path), content=True)
    pairs = {r.sample_id: r.label_path is not None for r in I.discover_pairs(files).collect()}
    assert pairs == {"a": True, "b": False}
    assert I.directory_summary(files, []).first().file_count == 4
    assert {len(r.checksum) for r in I.checksums(files, "md5").collect()} == {32}
    assert I.discover(files, str(tmp_path / "none"))[1].first().message == "dataset root has no files"


def test_required_present_turns_pending_into_failure(spark):
    m = spark.createDataFrame([("a", "TBD")], "dataset string, checksum string")
    s = spark.createDataFrame([], "dataset string, file_count long, total_bytes long")
    e = spark.createDataFrame([], "dataset string, path string, position string")
    f = spark.createDataFrame([], "dataset string, path string, checksum string")
    assert Q.verification(m, s, e, f).first().passed
    assert not Q.verification(m, s, e, f, require_present=True).first().passed


def test_class_dimension(spark):
    assert classes(spark).count() == 4


def test_spectral_indices(spark):
    nan = float("nan")
    df = spark.createDataFrame([(3.0, 1.0, 0.02), (0.0, 0.0, 0.0), (1.0, None, None), (nan, 1.0, nan), (-2.0, 2.0, 0.01)], "g double, s double, c double")
    got = [tuple(r) for r in df.select(X.ndsi(F.col("g"), F.col("s")), X.cirrus(F.col("c"))).collect()]
    assert got == [(0.5, True), (None, False), (None, None), (None, None), (None, True)]


def test_all_categories_can_be_measured(spark):
    kinds = {r.category: r.measurability for r in E.measurability(spark).collect()}
    assert kinds["edge_error"] == "deferred" and kinds["low_confidence_error"] == "not_measurable"
    assert E.measurability(spark, "measurable", masks=True).count() == 9 and E.measurability(spark, "measurable", probabilities=True).count() == 9
    a = spark.createDataFrame([(["false_positive", "thin_cloud_failure"],), (["false_positive"],), ([],)], "categories array<string>")
    b = spark.createDataFrame([(["edge_error"],)], "categories array<string>")
    c = spark.createDataFrame([(3, 0), (1, 0)], "high_confidence_error long, low_confidence_error long")
    got = {r.category: r.cases for r in E.measured_counts(a, b, c).collect()}
    assert len(got) == 11 and {k: v for k, v in got.items() if v} == {"false_positive": 2, "thin_cloud_failure": 1, "edge_error": 1, "high_confidence_error": 4}
