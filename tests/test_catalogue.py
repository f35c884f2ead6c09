import pytest
from pyspark.sql import functions as F

from rasterlake.operators import manifests, metrics, training
from rasterlake.sources import catalogue, rasters
from rasterlake.streaming import evaluate

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(r[0] for r in df.collect())


def test_best_fallback_and_error(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    with pytest.raises(FileNotFoundError, match="best, epoch_40"):
        catalogue.load(spark, root, "best", "epoch_40")
    catalogue.publish(spark.range(3), root, "epoch_40", mae=0.25)
    assert values(catalogue.load(spark, root, "best", "epoch_40")) == [0, 1, 2]
    catalogue.publish(spark.range(5, 7), root, "best", mae=0.5)
    assert values(catalogue.load(spark, root, "best", "epoch_40")) == [5, 6]
    assert values(catalogue.load(spark, root, "best", "epoch_40", as_of=1)) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        catalogue.load(spark, root, "other")
    notes = {r.name: r.notes["mae"] for r in catalogue.current(catalogue.listing(spark, root)).collect()}
    assert notes == {"epoch_40": "0.25", "best": "0.5"}


def test_crash_before_publishing_keeps_the_former_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    manifests.write_snapshot(spark.range(4), root, 2)
    reader = manifests.read_snapshot(spark, root, 2)
    monkeypatch.setattr(catalogue, "record", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        manifests.write_snapshot(spark.range(9), root, 2)
    monkeypatch.undo()
    assert values(manifests.read_snapshot(spark, root, 2)) == values(reader) == [0, 1, 2, 3]
    bad = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id")).repartition(3)
    with pytest.raises(Exception, match="lost"):
        manifests.write_snapshot(bad, root, 2)
    assert values(manifests.read_snapshot(spark, root, 2)) == [0, 1, 2, 3]
    manifests.write_snapshot(spark.range(2), root, 2)
    assert values(manifests.read_snapshot(spark, root, 2)) == [0, 1] and values(reader) == [0, 1, 2, 3]
    assert catalogue.retain(spark, root, 1) == []
    assert len(list((tmp_path / "c" / "data").iterdir())) == 1 and values(manifests.read_snapshot(spark, root, 2)) == [0, 1]


def test_two_writers_get_versions_of_their_own(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    assert catalogue.record(spark, root, "a", "data/x/a") == 1
    seen, real = [], catalogue._versions
    monkeypatch.setattr(catalogue, "_versions", lambda *a: real(*a) if seen else seen.append(1) or [])  # the first look is stale
    assert catalogue.record(spark, root, "b", "data/y/b") == 2
    assert {r.name: r.version for r in catalogue.current(catalogue.listing(spark, root)).collect()} == {"a": 1, "b": 2}
    assert not [p for p in (tmp_path / "c" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_retention(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    for k in range(1, 6):
        catalogue.publish(spark.range(k), root, f"epoch_{k}")
        if k == 2:
            catalogue.publish(spark.range(100, 101), root, "best")
    assert sorted(catalogue.retain(spark, root, 2, ["best"])) == ["epoch_1", "epoch_2", "epoch_3"]
    assert sorted(r.name for r in catalogue.current(catalogue.listing(spark, root)).collect()) == ["best", "epoch_4", "epoch_5"]
    assert values(catalogue.load(spark, root, "best")) == [100] and len(list((tmp_path / "c" / "data").iterdir())) == 3
    catalogue.publish(spark.range(1), root, "epoch_1")
    assert values(catalogue.load(spark, root, "epoch_1")) == [0]


def test_what_training_saves(spark):
    error = {0: 0.5, 1: 0.4, 2: 0.6, 3: 0.4, 4: 0.3, 5: None, 6: 0.3}
    df = spark.createDataFrame([("a", k, v) for k, v in error.items()] + [("b", 0, 0.1), ("b", 1, 0.2)], "run string, epoch int, mae double")
    got = sorted(map(tuple, catalogue.due(df, "run", "epoch", "mae", every=3, all_after=5).collect()))
    assert got == [("a", "best", 4), ("a", "epoch_3", 2), ("a", "epoch_6", 5), ("a", "epoch_7", 6)]
    have = spark.createDataFrame([("a", "best"), ("a", "epoch_3"), ("b", "epoch_3")], "run string, name string")
    names = ["best", "epoch_3"]
    assert sorted(map(tuple, catalogue.first_available(df, have, "run", names).collect())) == [("a", "best"), ("b", "epoch_3")]
    with pytest.raises(Exception, match="none of best, epoch_3 is saved for b"):
        catalogue.first_available(df, have.where("run = 'a'"), "run", names).collect()


def test_cycle_killed_midway_starts_from_its_last_round(spark, tmp_path):
    source = spark.createDataFrame([("a", "source")], "name string, origin string")

    def predict(k, snapshot):
        return spark.createDataFrame([(f"e{k}", 0.0 if k == 1 else None, [0.6, 0.0])], "name string, loss double, t array<double>").withColumn("loss", F.when(F.lit(k == 2), F.raise_error(F.lit("killed"))).otherwise(F.col("loss")))

    with pytest.raises(Exception, match="killed"):
        training.self_training(source, predict, str(tmp_path), 2, 2.0, 0.5).count()
    source.unionByName(spark.createDataFrame([("e1", "round 1")], "name string, origin string"))
    assert sorted(map(tuple, manifests.read_snapshot(spark, str(tmp_path), 1).collect())) in ([("a", "source")], [("a", "source"), ("e1", "round 1")])
    with pytest.raises(FileNotFoundError):
        manifests.read_snapshot(spark, str(tmp_path), 2)


def stream(spark, folder, pairs, **files):
    return spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    pairs = rasters.rasters(spark, SF).where("img_id % 5 = 0")
    for k in range(3):  # every image comes twice, in files of its own
        pairs.where(f"img_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pairs.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    root, calls, real = f"{tmp_path}/scores", [], catalogue.record

    def dies(*a, **k):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*a, **k)

    monkeypatch.setattr(catalogue, "record", dies)
    with pytest.raises(Exception, match="killed"):
        evaluate.accumulate(stream(spark, f"{tmp_path}/in", pairs), root, "dataset", "method", availableNow=True).awaitTermination()
    monkeypatch.undo()
    half = evaluate.results(spark, root, "dataset", "method").collect()
    want = sorted(map(tuple, metrics.report(metrics.prepare(pairs), "dataset", "method").collect()))
    assert half and sorted(map(tuple, half)) != want
    evaluate.accumulate(stream(spark, f"{tmp_path}/in", pairs), root, "dataset", "method", availableNow=True).awaitTermination()
    assert sorted(map(tuple, evaluate.results(spark, root, "dataset", "method").collect())) == want
    names = catalogue.current(catalogue.listing(spark, root)).count()
    evaluate.compact(spark, root, "dataset", "method")
    assert names > 2 == catalogue.current(catalogue.listing(spark, root)).count()
    assert sorted(map(tuple, evaluate.results(spark, root, "dataset", "method").collect())) == want
    # Nothing new: nothing changes.
    evaluate.accumulate(stream(spark, f"{tmp_path}/in", pairs), root, "dataset", "method", availableNow=True).awaitTermination()
    assert sorted(map(tuple, evaluate.results(spark, root, "dataset", "method").collect())) == want


def test_stream_of_null_images_and_event_time(spark, tmp_path):
    rows = [(k, "m", "d", "c", 1, 2, p, g, f"2024-01-0{1 + k} 00:00:00") for k, (p, g) in enumerate([([0, 255], [0, 255]), (None, None), ([9, 9], [255, 255])])]
    df = spark.createDataFrame(rows + rows[:1], "img_id long, method string, dataset string, class string, h int, w int, pred array<int>, gt array<int>, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(f"{tmp_path}/in")
    stream_of = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    evaluate.accumulate(stream_of, f"{tmp_path}/scores", "method", event_time="at", delay="10 days", availableNow=True).awaitTermination()
    want = metrics.report(metrics.prepare(df.dropDuplicates(["img_id"])), "method").collect()
    assert evaluate.results(spark, f"{tmp_path}/scores", "method").collect() == want
    with pytest.raises(FileNotFoundError):
        evaluate.results(spark, f"{tmp_path}/none", "method")


def test_stream_scores_before_it_shuffles(spark, tmp_path):
    pairs = rasters.rasters(spark, SF)
    pairs.limit(3).write.parquet(f"{tmp_path}/in")
    q = evaluate.accumulate(stream(spark, f"{tmp_path}/in", pairs), f"{tmp_path}/s", "method", availableNow=True)
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    exchange = plan.index("Exchange")
    assert "MapInArrow" in plan[exchange:] and "pred" not in plan[:exchange]


def test_sums_of_any_split_add_up(spark):
    pairs = metrics.prepare(rasters.rasters(spark, SF, "img_id < 90"))
    want = {(r["class"], r.method): tuple(r) for r in metrics.report(pairs, "class", "method").collect()}
    parts = [metrics.partial_sums(metrics.scored(pairs.where(f"img_id % 7 IN ({k}, {k + 1})")), "class", "method") for k in (0, 2, 4)]
    parts.append(metrics.partial_sums(metrics.scored(pairs.where("img_id % 7 = 6")), "class", "method"))
    whole = parts[0].union(parts[1]).union(metrics.added(parts[2].union(parts[3]), "class", "method"))
    got = {(r["class"], r.method): tuple(r) for r in metrics.merged_report(whole, "class", "method").collect()}
    assert got == want and len(got) > 10
    assert metrics.merged_report(whole.limit(0), "class").count() == 0


def test_merge_replaces_names_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    for k in range(4):
        catalogue.publish(spark.range(k, k + 1), root, f"batch={k}")
    before = catalogue.load_all(spark, root, "batch=")
    catalogue.merge(spark, root, "batch=", lambda df: df.coalesce(1))
    assert values(before) == values(catalogue.load_all(spark, root, "batch=")) == [0, 1, 2, 3]
    assert sorted(r.name for r in catalogue.current(catalogue.listing(spark, root)).collect()) == ["batch=2", "batch=3"]
    catalogue.publish(spark.range(30, 31), root, "batch=3")  # the newest is repeated
    assert values(catalogue.load_all(spark, root, "batch=")) == [0, 1, 2, 30]
    catalogue.merge(spark, root, "other", lambda df: df)
    catalogue.publish(spark.range(9, 10), root, "batch=0")  # a replaced name may come again
    assert values(catalogue.load_all(spark, root, "batch=")) == [0, 1, 2, 9, 30]
