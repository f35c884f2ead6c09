"""Every query by name, on the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.functions.once import settled
from rasterlake.operators import manifests, metrics, stencil, training
from rasterlake.sources import catalogue, sinks
from rasterlake.sources import rasters as src
from rasterlake.streaming import evaluate

#: Mean and deviation of three channels.
IMAGENET = ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prepare(src.rasters(spark, sf))


def _r(*names: str, places: int = 6) -> list:
    return [F.round(n, places).alias(n) for n in names]


def _long(df: DataFrame, values: str, name: str = "v") -> DataFrame:
    return df.select("img_id", F.posexplode_outer(values).alias("pos", name)).select("img_id", F.col("pos").cast("long").alias("pos"), F.round(name, 6).alias(name))


@query
def prepare_pixels(spark, sf):
    return metrics.pixels(_pairs(spark, sf), "img_id").select("img_id", F.col("pos").cast("long").alias("pos"), F.round("p", 6).alias("p"), F.col("g").cast("int").alias("g"))


@query
def mae_image(spark, sf):
    return metrics.mae(_pairs(spark, sf)).select("img_id", *_r("mae"))


@query
def mae_report(spark, sf):
    return metrics.mae(_pairs(spark, sf)).groupBy("method").agg(F.round(F.avg("mae"), 6).alias("mae"), F.count("*").alias("images"))


@query
def fm_adaptive(spark, sf):
    return metrics.adaptive(_pairs(spark, sf)).select("img_id", F.col("tp").cast("long").alias("tp"), F.col("ps").cast("long").alias("ps"), *_r("adp_fm"))


@query
def em_adaptive(spark, sf):
    return metrics.adaptive(_pairs(spark, sf)).select("img_id", *_r("adp_em"))


@query
def pr_curve(spark, sf):
    return metrics.curves(_pairs(spark, sf)).select("img_id", F.col("k").cast("long").alias("k"), F.col("tp").cast("long").alias("tp"), F.col("ps").cast("long").alias("ps"), *_r("precision", "recall", "fm"))


@query
def fm_curve_mean(spark, sf):
    return metrics.curves(_pairs(spark, sf)).groupBy("method", F.col("k").cast("long").alias("k")).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "fm")])


@query
def em_curve(spark, sf):
    return metrics.curves(_pairs(spark, sf)).select("img_id", F.col("k").cast("long").alias("k"), *_r("em"))


@query
def em_curve_mean(spark, sf):
    return metrics.curves(_pairs(spark, sf)).groupBy("method", F.col("k").cast("long").alias("k")).agg(F.round(F.avg("em"), 6).alias("em"))


@query
def sm_object(spark, sf):
    return metrics.structure(_pairs(spark, sf)).where("f > 0 AND f < n").select("img_id", *_r("sm_object"))


@query
def sm_region(spark, sf):
    return metrics.structure(_pairs(spark, sf)).where("f > 0 AND f < n").select("img_id", *_r("sm_region"))


@query
def sm_image(spark, sf):
    return metrics.structure(_pairs(spark, sf)).select("img_id", *_r("sm"))


@query
def edt_nearest(spark, sf):
    return metrics.distance(_pairs(spark, sf))


@query
def wfm_image(spark, sf):
    return metrics.weighted(_pairs(spark, sf)).select("img_id", *_r("wfm"))


@query
def dice_loss(spark, sf):
    return metrics.overlaps(src.rasters(spark, sf)).select("img_id", *_r("dice_loss"))


@query
def iou_soft(spark, sf):
    return metrics.overlaps(src.rasters(spark, sf)).select("img_id", *_r("iou"))


@query
def iou_confusion(spark, sf):
    return metrics.confusion_iou(_pairs(spark, sf)).select("method", *_r("iou_0", "iou_1"))


@query
def eval_report(spark, sf):
    return metrics.report(_pairs(spark, sf), "dataset", "method")


@query
def eval_superclass(spark, sf):
    return metrics.report(_pairs(spark, sf), "class", "method")


@query
def eval_subclass(spark, sf):
    """Classes are substrings of file names."""
    named = _pairs(spark, sf).withColumn("name", F.format_string("cls%s_%s.png", "class", "img_id"))
    return metrics.report(named.withColumn("class", F.explode(manifests.classes_in(F.col("name"), ["cls1_", "cls2_", "cls3_"]))), "class", "method")


@query
def eval_sets(spark, sf):
    """The reports by dataset and by class in one job."""
    return metrics.report_sets(_pairs(spark, sf), ["dataset", "method"], ["class", "method"])


@query
def raw_mae(spark, sf):
    return metrics.raw_mae(src.rasters(spark, sf)).groupBy("method").agg(F.round(F.avg("mae"), 6).alias("mae"), F.count("*").alias("images"))


@query
def grey_levels(spark, sf):
    """Luminance of three channels: prediction, mask, inverted prediction."""
    df = src.rasters(spark, sf).withColumn("v", F.zip_with("pred", "gt", lambda p, g: src.luminance(p, g, 255 - p)))
    return df.select("img_id", F.posexplode_outer("v").alias("pos", "v")).select("img_id", F.col("pos").cast("long").alias("pos"), "v")


@query
def class_predicate(spark, sf):
    pages = src.table(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", F.explode(manifests.classes_in(F.col("url"), ["/en/", "/fr/", "casino", "example.org"])).alias("class"))


@query
def manifest_scan(spark, sf):
    pages = src.table(spark, sf, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".jpg").when(F.col("page_id") % 3 == 1, ".png").otherwise(".tif")).alias("path"))
    return pages.where(manifests.has_suffix(F.col("path"), ".jpg", ".png"))


@query
def name_normalise(spark, sf):
    pages = src.table(spark, sf, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".jpg").when(F.col("page_id") % 3 == 1, ".png").otherwise(".tif")).alias("path"))
    return pages.select("page_id", manifests.output_name(F.col("path")).alias("name"))


@query
def manifest_positional(spark, sf):
    z = manifests.zip_by_rank(src.images(spark, sf).select("img_id"), src.masks(spark, sf).select("img_id"), "img_id")
    return z.select("rank", "img_id", F.col("img_id_r").alias("mask_id"))


@query
def manifest_pair(spark, sf):
    return src.masks(spark, sf).select("img_id", "quality").join(src.images(spark, sf).select("img_id", "source", "n_chars"), "img_id")


@query
def integrity_check(spark, sf):
    return manifests.integrity(src.images(spark, sf), src.masks(spark, sf), "img_id")


@query
def list_difference(spark, sf):
    return manifests.same_list(src.images(spark, sf).select("img_id"), src.masks(spark, sf).select("img_id"))


@query
def size_filter(spark, sf):
    both = src.images(spark, sf).select("img_id", (F.col("n_chars") % 7).alias("img_w")).join(src.masks(spark, sf).select("img_id", (F.col("img_id") % 7).alias("gt_w")), "img_id")
    return both.where("img_w = gt_w")


def _student(spark, sf):
    """Student and teacher probabilities from the two vectors of each image, stretched to 0..1."""
    df = src.teacher_student(spark, sf).withColumn("s", stencil.stretch(F.col("e"))).withColumn("t", stencil.stretch(F.col("proto")))
    return settled(df).withColumn("h", F.lit(src.SIDE)).withColumn("w", F.lit(src.SIDE))


def _losses(spark, sf):
    """Losses with the teacher's probabilities, written: the mean and the selection both read them."""
    return manifests.written(stencil.edge_loss(_student(spark, sf)).select("img_id", "class", F.round("loss", 9).alias("loss"), "t"))


@query
def es_loss(spark, sf):
    return stencil.edge_loss(_student(spark, sf)).select("img_id", *_r("loss"))


@query
def es_loss_weighted(spark, sf):
    return stencil.edge_loss(_student(spark, sf), weighted=True).select("img_id", *_r("loss"))


@query
def sobel_edges(spark, sf):
    return _long(stencil.edges(_pairs(spark, sf), "p", "edge"), "edge")


@query
def structure_loss(spark, sf):
    df = _pairs(spark, sf).join(src.teacher_student(spark, sf).select("img_id", F.col("e").alias("x")), "img_id")
    return stencil.structure_loss(df).select("img_id", *_r("loss"))


@query
def bce_logits(spark, sf):
    df = _pairs(spark, sf).select("img_id", "g").join(src.teacher_student(spark, sf).select("img_id", "e"), "img_id")
    return df.select("img_id", F.round(stencil.mean(F.zip_with("e", "g", stencil.bce_logits)), 6).alias("loss"))


@query
def cls_mean_loss(spark, sf):
    return stencil.edge_loss(_student(spark, sf)).select(F.round("loss", 9).alias("loss")).agg(F.round(F.avg("loss"), 6).alias("mean_loss"), F.count("*").alias("images"))


@query
def cls_select(spark, sf):
    return training.below_mean(_losses(spark, sf), "loss", 0.8).select("img_id", *_r("loss"))


@query
def cls_pseudo(spark, sf):
    kept = training.pseudo_labels(training.below_mean(_losses(spark, sf), "loss", 0.8), "t", 0.4)
    return _long(kept, "label")


@query
def cls_union(spark, sf):
    kept = training.pseudo_labels(training.below_mean(_losses(spark, sf), "loss", 0.8), "t", 0.4)
    new = kept.select(F.concat(F.col("img_id").cast("string"), F.lit(".png")).alias("name"), F.lit("pseudo").alias("origin"))
    old = src.masks(spark, sf).select(F.concat(F.col("img_id").cast("string"), F.lit(".png")).alias("name"), F.lit("source").alias("origin"))
    return manifests.upsert(old, new, "name")


@query
def checkpoint_fallback(spark, sf):
    kinds = src.table(spark, sf, "events").groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("event_id"))).alias(k) for k in ("purchase", "click")])
    return kinds.select("user_id", F.coalesce("purchase", "click", F.lit(-1)).alias("chosen"))


@query
def resize_bilinear(spark, sf):
    df = _pairs(spark, sf)
    sized = lambda mode: _long(df.withColumn("v", stencil.resize(F.col("p"), F.col("h"), F.col("w"), 11, 11, mode)), "v").withColumn("corners", F.lit(mode))
    return sized(True).union(sized(False))


@query
def attn_norm(spark, sf):
    return _long(src.teacher_student(spark, sf).withColumn("v", stencil.stretch(F.col("e"))), "v")


@query
def attn_blur(spark, sf):
    return _long(stencil.separable_blur(_pairs(spark, sf), "p", "v", metrics.gauss_axis(7, 5.0).tolist()), "v")


@query
def search_attention(spark, sf):
    df = _pairs(spark, sf).join(src.teacher_student(spark, sf).select("img_id", "e"), "img_id")
    return _long(stencil.search_attention(df, "p", "e", "v"), "v")


@query
def mask_sink(spark, sf):
    return sinks.mask_bytes(_pairs(spark, sf)).select("img_id", F.posexplode_outer("px").alias("pos", "px")).select("img_id", F.col("pos").cast("long").alias("pos"), "px")


@query
def gt_scale(spark, sf):
    return _long(src.rasters(spark, sf).withColumn("v", stencil.by_maximum(F.col("gt"))), "v")


@query
def normalise_channels(spark, sf):
    df = _pairs(spark, sf)
    return df.select("img_id", F.posexplode_outer("p").alias("pos", "p")).select("img_id", F.col("pos").cast("long").alias("pos"), *[F.round((F.col("p") - m) / s, 6).alias(f"c{k}") for k, (m, s) in enumerate(zip(*IMAGENET, strict=True))])


@query
def flip_h(spark, sf):
    df = _pairs(spark, sf)
    return _long(df.withColumn("v", F.when(F.col("img_id") % 2 == 0, stencil.flip_rows(F.col("p"), F.col("h"), F.col("w"))).otherwise(F.col("p"))), "v")


@query
def straight_through(spark, sf):
    return _long(_pairs(spark, sf).withColumn("v", F.transform("p", lambda v: training.binarize(v))), "v")


@query
def batch_assign(spark, sf):
    return manifests.batches(src.images(spark, sf).select("img_id"), "img_id", 16).select("img_id", "batch")


@query
def batch_shuffled(spark, sf):
    placed = manifests.shuffled(src.images(spark, sf).select("img_id"), "img_id", 7)
    return manifests.batches(placed, "place", 16).select("img_id", "batch")


@query
def batch_zip(spark, sf):
    count = lambda df: manifests.batches(df.select("img_id"), "img_id", 16).groupBy("batch").agg(F.min("img_id").alias("first"), F.count("*").alias("rows"))
    a, b = count(src.images(spark, sf)), count(src.masks(spark, sf))
    return a.join(b.select("batch", F.col("first").alias("target_first"), F.col("rows").alias("target_rows")), "batch")


@query
def running_best(spark, sf):
    return training.running_best(src.table(spark, sf, "events").select("event_id", "value"), "event_id", "value", 1000.0).select("event_id", "value", "best_before", "improves")


@query
def ema_params(spark, sf):
    """One step of each student element into its teacher's, by position."""
    df = src.teacher_student(spark, sf)
    return _long(df.withColumn("v", F.zip_with("proto", "e", lambda t, s: 0.9996 * t + (1 - 0.9996) * s)), "v")


@query
def ema_series(spark, sf):
    """The average over each user's values in order of events."""
    return training.series_ema(src.table(spark, sf, "events"), "user_id", "event_id", "value", 0.9).select("user_id", *_r("ema"))


@query
def grad_clip(spark, sf):
    return _long(src.teacher_student(spark, sf).withColumn("v", F.transform("e", lambda v: training.clip(v, 0.1))), "v")


@query
def log_cadence(spark, sf):
    return src.table(spark, sf, "events").where(F.pmod("event_id", F.lit(10)) == 0).groupBy("event_type").agg(F.count("*").alias("steps"))


def _channels(spark, sf):
    """Three channels: prediction, mask, inverted prediction."""
    return src.rasters(spark, sf).withColumn("channels", F.array("pred", "gt", F.transform("pred", lambda v: 255 - v)))


def _by_channel(df, values):
    flat = df.select("img_id", F.posexplode(values).alias("channel", "c")).select("img_id", "channel", F.posexplode("c").alias("pos", "v"))
    return flat.select("img_id", "channel", F.col("pos").cast("long").alias("pos"), *_r("v"))


@query
def channel_stretch(spark, sf):
    return _by_channel(_channels(spark, sf), stencil.stretch_channels(F.col("channels")))


@query
def channel_normalise(spark, sf):
    return _by_channel(_channels(spark, sf), stencil.normalise_channels(F.col("channels"), *IMAGENET))


@query
def pairing_outcomes(spark, sf):
    """Masks without prediction, predictions without mask, and pairs of different sizes are told, not dropped."""
    masks = src.masks(spark, sf).select("img_id", F.when(F.col("img_id") % 5 > 0, F.col("img_id") % 3).alias("h"))
    predictions = src.images(spark, sf).select("img_id", F.when(F.col("img_id") % 7 > 0, F.col("n_chars") % 3).alias("h"))
    return manifests.pairing(masks, predictions, "img_id", ["h"])


@query
def output_selection(spark, sf):
    """Of two maps the second, of four the fourth."""
    df = src.teacher_student(spark, sf).withColumn("network", F.when(F.col("img_id") % 2 == 0, "SINet").otherwise("SINet-v2"))
    zero = F.transform("e", lambda v: v * 0)
    maps = F.when(F.col("network") == "SINet", F.array(zero, "e")).otherwise(F.array(zero, zero, "e", "proto"))
    return _long(df.withColumn("v", training.pick_output(maps, F.col("network"))), "v")


@query
def snapshot_copy(spark, sf):
    """A snapshot of the source that replaces an older one of the same iteration."""
    root = f"{manifests.checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    masks = src.masks(spark, sf)
    manifests.write_snapshot(masks.where("quality = 1"), root, 2)
    return spark.read.parquet(manifests.write_snapshot(masks, root, 2))


@query
def snapshot_versions(spark, sf):
    """The same iteration before and after it was replaced: readers of the older version keep its files."""
    root = f"{manifests.checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    masks = src.masks(spark, sf)
    manifests.write_snapshot(masks.where("quality = 1"), root, 2)
    old = manifests.read_snapshot(spark, root, 2)
    manifests.write_snapshot(masks.where("quality = 0"), root, 2)
    new, again = manifests.read_snapshot(spark, root, 2), manifests.read_snapshot(spark, root, 2, as_of=1)
    return old.withColumn("seen", F.lit("before")).union(new.withColumn("seen", F.lit("after"))).union(again.withColumn("seen", F.lit("as of 1")))


@query
def checkpoint_catalogue(spark, sf):
    """What training saves of each run (a run is a class, its epochs the vectors, its error the size of their first element), published, and loaded again: the best, else the fiftieth epoch, else the tenth."""
    order = Window.partitionBy("run").orderBy("vec_id")
    v = src.table(spark, sf, "embeddings").select(F.col("label").alias("run"), "vec_id", F.col("embedding").cast("array<double>").alias("weights"))
    epochs = v.withColumn("epoch", F.row_number().over(order) - 1).withColumn("error", F.abs(F.get("weights", F.lit(0))))
    # Runs with an even number get no best, so that the others of the candidates are needed.
    saved = catalogue.due(epochs, "run", "epoch", "error", every=10, all_after=45).where("run % 2 = 1 OR name <> 'best'")
    root = f"{manifests.checkpoint_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
    catalogue.publish(saved.join(epochs.select("run", "epoch", "weights"), ["run", "epoch"]), root, "checkpoints")
    have = catalogue.load(spark, root, "checkpoints")
    chosen = catalogue.first_available(epochs, have, "run", ["best", "epoch_50", "epoch_10"])
    rows = have.join(chosen, ["run", "name"]).select("run", "name", F.col("epoch").cast("long").alias("epoch"), F.posexplode("weights").alias("pos", "w"))
    return rows.select("run", "name", "epoch", F.col("pos").cast("long").alias("pos"), *_r("w"))


@query
def report_sink(spark, sf):
    """The lines of the text report of each dataset, as the file has them."""
    root = f"{manifests.checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report_texts(manifests.written(metrics.report(_pairs(spark, sf), "dataset", "method")), root)
    lines = spark.read.text(f"{root}/*_eval.txt").select(F.split(F.regexp_replace("value", r"[| ]+", " "), " ").alias("c"))
    return lines.where("c[1] <> 'dataset'").select(F.col("c")[1].alias("dataset"), F.col("c")[2].alias("method"), *[F.col("c")[k + 3].alias(n) for k, n in enumerate(metrics.SCORES)])


@query
def log_sink(spark, sf):
    """Every tenth step of two epochs, appended to one log."""
    path = f"{manifests.checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    for epoch in (1, 2):
        steps = src.table(spark, sf, "events").where(F.pmod("event_id", F.lit(10)) == 0)
        manifests.append_log(steps.select(F.lit(epoch).alias("epoch"), F.col("event_id").alias("step"), (F.col("value") * epoch).alias("loss")), path)
    return spark.read.schema("epoch int, step long, loss double").json(path).select("epoch", "step", *_r("loss"))


@query
def self_training(spark, sf):
    """Two rounds. In the second, the teacher of a class is its first image that the first round has labelled."""
    base = src.teacher_student(spark, sf)

    def predict(k, snapshot):
        done = snapshot.where("origin <> 'source'").select("name")
        named = base.withColumn("name", F.concat(F.col("img_id").cast("string"), F.lit(".png")))
        again = named.join(done, "name").groupBy("class").agg(F.min_by("e", "img_id").alias("first"))
        df = named.join(F.broadcast(again), "class", "left").withColumn("proto", F.coalesce("first", "proto"))  # a row for each class
        df = df.withColumn("s", stencil.stretch(F.col("e"))).withColumn("t", stencil.stretch(F.col("proto")))
        df = settled(df).withColumn("h", F.lit(src.SIDE)).withColumn("w", F.lit(src.SIDE))
        return manifests.written(stencil.edge_loss(df).select("name", F.round("loss", 9).alias("loss"), "t"))

    source = src.masks(spark, sf).select(F.concat(F.col("img_id").cast("string"), F.lit(".png")).alias("name"), F.lit("source").alias("origin"))
    return training.self_training(source, predict, f"{manifests.checkpoint_dir(spark)}/cycle-{uuid.uuid4().hex}", 2, 0.8, 0.4)


@query
def mae_stream(spark, sf):
    """The means by method of a stream of raster pairs, all of it taken in; the stream is an extension."""
    root = f"{manifests.checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    pairs = src.rasters(spark, sf)
    pairs.repartition(4).write.parquet(f"{root}/in")
    name = f"scores_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run = evaluate.mae_stream(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("method", *_r("mae"), "images")


@query
def eval_stream(spark, sf):
    """The report by dataset and method from a stream that stops midway, starts again and brings a third of its images twice."""
    root = f"{manifests.checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    pairs = src.rasters(spark, sf)
    take = lambda: evaluate.accumulate(spark.readStream.schema(pairs.schema).parquet(f"{root}/in"), f"{root}/scores", "dataset", "method", availableNow=True)
    pairs.where("img_id % 3 < 2").write.parquet(f"{root}/in")
    take().awaitTermination()
    pairs.where("img_id % 3 > 0").write.mode("append").parquet(f"{root}/in")
    take().awaitTermination()
    evaluate.compact(spark, f"{root}/scores", "dataset", "method")
    return evaluate.results(spark, f"{root}/scores", "dataset", "method")
