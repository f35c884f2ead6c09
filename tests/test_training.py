import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import manifests, training
from rasterlake.sources import rasters, sinks


def test_running_best_of_any_order(spark):
    values = [5.0, 7.0, 3.0, None, 3.0, 2.5, 9.0, float(1e9)]
    day = datetime.date(2020, 1, 1)
    rows = [(None, 4.0), *((day + datetime.timedelta(days=k * k), v) for k, v in enumerate(values))]
    df = spark.createDataFrame(rows, "at date, value double").withColumn("best", F.lit("x")).repartition(4)
    got = [(r.value, r.best_before, r.improves) for r in training.running_best(df, "at", "value", 6.0).orderBy("at").collect()]
    assert got == [(4.0, 6.0, True), (5.0, 4.0, False), (7.0, 4.0, False), (3.0, 4.0, True), (None, 3.0, False), (3.0, 3.0, False), (2.5, 3.0, True), (9.0, 2.5, False), (1e9, 2.5, False)]
    assert training.running_best(df.limit(0), "at", "value").count() == 0


def test_running_best_of_sparse_keys(spark):
    df = spark.range(3000).select((F.col("id") * 10**12).alias("k"), (F.abs(F.hash("id")) % 1000).cast("double").alias("v")).repartition(6)
    got = training.running_best(df, "k", "v", 1e9).orderBy("k").collect()
    best = 1e9
    for r in got:
        assert (r.best_before, r.improves) == (best, r.v < best)
        best = min(best, r.v)


def test_moving_average_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [(0 if k % 3 else k % 5, k, float(v)) for k, v in enumerate(rng.normal(size=4000))] + [(9, 5, None), (9, 6, 2.0), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "u long, t long, v double").repartition(7)
    got = {r.u: r.ema for r in training.series_ema(df, "u", "t", "v", 0.9, 1.0).collect()}
    want = {}
    for u, _, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            want[u] = 0.9 * want.get(u, 1.0) + 0.1 * v
    assert got == pytest.approx(want)
    assert training.series_ema(df.limit(0), "u", "t", "v", 0.9).count() == 0


def test_settings():
    assert training.settings()["u"] == 0.8 and training.settings("C2C")["u"] == 1.0
    assert training.settings("S2C", u=0.3)["u"] == 0.3 and training.settings("S2C", "SINet-v2", epoch=3)["epoch"] == 100
    for wrong in ({"task": "x"}, {"network": "x"}, {"unknown": 1}):
        with pytest.raises(ValueError, match="unknown"):
            training.settings(**wrong)


def test_output_of_an_unknown_network(spark):
    df = spark.createDataFrame([("other", [[1.0], [2.0]])], "n string, maps array<array<double>>")
    with pytest.raises(Exception, match="not supported"):
        df.select(training.pick_output(F.col("maps"), F.col("n"))).collect()


def test_cycle_reads_its_own_snapshots(spark, tmp_path):
    source = spark.createDataFrame([("a", "source"), ("b", "source")], "name string, origin string")
    seen = []

    def predict(k, snapshot):
        seen.append(sorted((r.name, r.origin) for r in snapshot.collect()))
        rows = [("b", 0.1, [0.9, 0.2]), ("c", 0.2, [0.3, 0.1]), ("d", 9.0, [0.9, 0.9]), (f"e{k}", 0.0, [0.6, 0.0]), ("n", None, None)]
        return spark.createDataFrame(rows, "name string, loss double, t array<double>")

    out = training.self_training(source, predict, str(tmp_path), 2, 1.0, 0.5)
    assert sorted((r.name, r.origin) for r in out.collect()) == [("a", "source"), ("b", "round 2"), ("e1", "round 1"), ("e2", "round 2")]
    assert seen == [[("a", "source"), ("b", "source")], [("a", "source"), ("b", "round 1"), ("e1", "round 1")]]
    none = training.self_training(source, lambda k, s: predict(k, s).limit(0), str(tmp_path / "none"), 1, 1.0, 0.5)
    assert none.count() == 2


def test_snapshots_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    manifests.write_snapshot(df.union(df), str(tmp_path), 2)
    path = manifests.write_snapshot(df, str(tmp_path) + "/", 2)
    assert path.endswith("/iteration=2") and spark.read.parquet(path).count() == 1
    manifests.append_log(df, str(tmp_path / "log"))
    manifests.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_report_texts(spark, tmp_path):
    report = spark.createDataFrame([("B", "m2", 0.5), ("B", "m1", 0.25), ("A", "m1", 1.0), (None, "m1", None)], "dataset string, method string, mae double")
    sinks.write_report_texts(report, f"file://{tmp_path}")
    assert (tmp_path / "B_eval.txt").read_text().splitlines() == ["| dataset | method | mae    |", "| B       | m1     | 0.2500 |", "| B       | m2     | 0.5000 |"]
    assert {p.name for p in tmp_path.glob("*.txt")} == {"A_eval.txt", "B_eval.txt", "null_eval.txt"}


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Elsewhere:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="share"):
        manifests.checkpoint_dir(Elsewhere())


def test_file_folders(spark, tmp_path):
    from test_metrics import png

    grey = np.arange(12).reshape(3, 4) * 20
    colour = np.zeros((2, 2, 3), int)
    colour[0, 0], colour[0, 1], colour[1, 0] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    for folder in ("pred", "gt"):
        (tmp_path / folder).mkdir()
    (tmp_path / "gt" / "cat_1.png").write_bytes(png(grey))
    (tmp_path / "pred" / "cat_1.png").write_bytes(png(grey))
    (tmp_path / "gt" / "dog_2.png").write_bytes(png(np.kron(grey, np.ones((2, 2), int))))
    (tmp_path / "pred" / "dog_2.png").write_bytes(png(grey))
    (tmp_path / "gt" / "alone.png").write_bytes(png(grey))
    (tmp_path / "pred" / "extra.png").write_bytes(png(colour))
    (tmp_path / "gt" / "broken.png").write_bytes(png(grey))
    (tmp_path / "pred" / "broken.png").write_bytes(b"not an image")
    roots = str(tmp_path / "pred"), str(tmp_path / "gt")
    told = {r.name: r.outcome for r in rasters.file_outcomes(spark, *roots).collect()}
    assert told == {"cat_1.png": "paired", "dog_2.png": "resized", "alone.png": "no_prediction", "extra.png": "no_mask", "broken.png": "no_prediction"}
    for nearest in (False, True):
        got = {r["class"]: r for r in rasters.file_pairs(spark, *roots, "m", "d", classes=["cat", "dog"], nearest=nearest).collect()}
        assert set(got) == {"cat", "dog"} and got["cat"].pred == grey.ravel().tolist()
        assert (got["dog"].h, got["dog"].w, len(got["dog"].pred)) == (6, 8, 48)
    assert got["dog"].pred == got["dog"].gt
    channels = {r.name: r.channels for r in rasters.rgb_files(spark, roots[0]).collect()}
    assert channels["extra.png"] == [[255, 0, 0, 0], [0, 255, 0, 0], [0, 0, 255, 0]] and channels["cat_1.png"] == [grey.ravel().tolist()] * 3
