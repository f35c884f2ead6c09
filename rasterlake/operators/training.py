"""Data semantics of training: schedules, averages, selection of confident labels, the inference slot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.once import settled
from rasterlake.operators import manifests, stencil


def running_best(df: DataFrame, order: str, value: str, initial: float = 1.0) -> DataFrame:
    """Adds ``best_before`` and ``improves`` (strictly below it), in ``order`` (of any type that has one), null orders first.

    A series is one history by nature; the partitions of a distributed sort are reduced side by side, and a row for each gives the
    best before it. Null values improve nothing and are no best; equal orders come in any order.
    """
    rows = manifests.placed(df, order)
    least = rows.groupBy("__part").agg(F.min(value).alias("__m"))
    before = least.select("__part", F.min("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__m"))
    inside = F.min(value).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(before), "__part").withColumn("best_before", F.least(F.lit(initial), inside, "__m"))
    return rows.withColumn("improves", F.coalesce(F.col(value) < F.col("best_before"), F.lit(False))).drop("__part", "__place", "__m")


def series_ema(df: DataFrame, key: str, order: str, value: str, alpha: float, start: float = 0.0) -> DataFrame:
    """``(key, ema)``: the exponential moving average over the values of each key in ``order``, from ``start``; null values are left out.

    A step maps ``e`` to ``alpha * e + (1 - alpha) * v``, and steps put together map it to ``a * e + b``. Rows are sorted by key and order over all
    partitions; each partition puts the steps of a key together, and a key has one row for each partition that holds some of it, whatever its history.
    """
    rows = manifests.placed(df.where(F.col(value).isNotNull()).select(key, order, value), key, order)
    ago = F.count("*").over(Window.partitionBy("__part", key)) - F.row_number().over(Window.partitionBy("__part", key).orderBy("__place"))
    parts = rows.withColumn("__ago", ago).groupBy("__part", key).agg(F.pow(F.lit(alpha), F.count("*")).alias("a"), F.sum((1 - alpha) * F.col(value) * F.pow(F.lit(alpha), "__ago")).alias("b"))
    steps = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__part", "a", "b"))).alias("steps"))
    return steps.select(key, F.aggregate("steps", F.lit(start), lambda e, s: e * s["a"] + s["b"]).alias("ema"))


def ema(values: Column, alpha: float, start: Column) -> Column:
    """Exponential moving average over an ordered array: ``e = alpha * e + (1 - alpha) * v``."""
    return F.aggregate(values, start, lambda e, v: alpha * e + (1 - alpha) * v)


def learning_rate(epoch: Column, base: float, rate: float = 0.1, every: int = 30) -> Column:
    """Rate after the updates of epochs 1 to ``epoch``; they multiply one another, so the exponents add up."""
    exponents = F.aggregate(F.sequence(F.lit(1), epoch), F.lit(0).cast("long"), lambda a, e: a + F.floor(e / every))
    return F.lit(base) * F.pow(F.lit(rate), exponents.cast("double"))


def clip(v: Column, limit: float) -> Column:
    return F.least(F.greatest(v, F.lit(-limit)), F.lit(limit))


def below_mean(df: DataFrame, loss: str, u: float) -> DataFrame:
    """Rows whose loss is below ``u`` times the mean loss; the mean is a scalar subquery. Null losses are not kept and not in the mean; an empty table keeps none."""
    mean = df.agg(F.avg(loss).alias("m"))
    return df.where(F.col(loss) < u * mean.scalar())


def pseudo_labels(df: DataFrame, p: str, tau: float) -> DataFrame:
    """Rows whose peak reaches ``tau``; values below it become 0, and the rest is stretched to 0..1 as ``label``. Null and empty rasters have no peak and go."""
    kept = settled(df.where(F.array_max(p) >= tau)).withColumn("__z", F.transform(p, lambda v: F.when(v < tau, 0.0).otherwise(v)))
    return settled(kept).withColumn("label", stencil.stretch(F.col("__z"))).drop("__z")


def binarize(v: Column, at: float = 0.5) -> Column:
    """Forward part of a straight-through binarisation."""
    return (v >= at).cast("double")


def predict(df: DataFrame, make_model: Callable[[], Callable], inputs: str, output: str, shape: list[int], batch: int = 64) -> DataFrame:
    """Slot for batch inference: ``make_model`` runs once in a worker and gives a function from a batch of flat inputs, each of ``shape``, to a batch of flat logits."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    run = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[shape])
    return df.withColumn(output, run(F.col(inputs)))


def pick_output(maps: Column, network: Column) -> Column:
    """The map that counts among a network's outputs: the second of two, or the fourth of four; other networks are an error."""
    return F.when(network == "SINet", F.get(maps, F.lit(1))).when(network == "SINet-v2", F.get(maps, F.lit(3))).otherwise(F.raise_error(F.concat(F.lit("network not supported: "), F.coalesce(network, F.lit("null")))))


#: Settings of a run, and those that a task and a network put in their place.
SETTINGS = {"epoch": 40, "batchsize": 16, "decay_epoch": 30, "alpha": 0.9996, "u": 1.0, "tau": 0.5, "a": 0.7, "b": 0.3, "c": 0.5}
OF_TASK = {"C2C": {}, "S2C": {"alpha": 0.996, "u": 0.8, "tau": 0.4, "a": 0.9, "b": 0.3, "c": 0.5}}
OF_NETWORK = {"SINet": {}, "SINet-v2": {"epoch": 100, "batchsize": 32, "decay_epoch": 50}}


def settings(task: str = "S2C", network: str = "SINet", **explicit: float) -> dict[str, float]:
    """The settings of a run. What is given explicitly wins over the task; the network's own numbers hold in any case."""
    if task not in OF_TASK or network not in OF_NETWORK or not set(explicit) <= set(SETTINGS):
        raise ValueError(f"unknown task, network or setting: {task}, {network}, {sorted(explicit)}")
    return {**SETTINGS, **OF_TASK[task], **explicit, **OF_NETWORK[network]}


def with_settings(runs: DataFrame, task: str, network: str, explicit: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``settings``, a map from name to value, to a table of runs by the rule of ``settings``. A null in ``explicit`` gives nothing; reading a run of an unknown or null task or network is an error."""
    explicit = explicit or {}
    if not set(explicit) <= set(SETTINGS):
        raise ValueError(f"unknown setting: {sorted(explicit)}")
    known = F.col(task).isin(*OF_TASK) & F.col(network).isin(*OF_NETWORK)
    error = F.raise_error(F.concat_ws(" ", F.lit("unknown task or network:"), F.coalesce(F.col(task), F.lit("null")), F.coalesce(F.col(network), F.lit("null"))))

    def value(name: str) -> Column:
        of_task = F.coalesce(*[F.when(F.col(task) == t, float(own[name])) for t, own in OF_TASK.items() if name in own], F.lit(float(SETTINGS[name])))
        of_network = [F.when(F.col(network) == n, float(own[name])) for n, own in OF_NETWORK.items() if name in own]
        return F.coalesce(*of_network, *([explicit[name].cast("double")] if name in explicit else []), of_task)

    made = F.map_from_arrays(F.array(*map(F.lit, SETTINGS)), F.array(*map(value, SETTINGS)))
    return runs.withColumn("settings", F.when(F.coalesce(known, F.lit(False)), made).otherwise(error.cast("map<string,double>")))


def self_training(source: DataFrame, predict: Callable[[int, DataFrame], DataFrame], root: str, rounds: int, u: float, tau: float, key: str = "name") -> DataFrame:
    """The snapshot after ``rounds`` selections: each round's snapshot is the next one's source.

    ``predict(round, snapshot)`` gives the targets with ``key``, ``loss`` and the teacher's probabilities ``t``. Those below ``u`` times the mean loss whose peak reaches
    ``tau`` replace the source's rows of the same key, marked with their round in ``origin``. Each snapshot is written under ``root``; a round is a
    few distributed jobs, and the rounds are a loop by nature. An empty target table leaves the source as it is.
    """
    now = source.select(key, "origin")
    for k in range(1, rounds + 1):
        kept = pseudo_labels(below_mean(predict(k, now), "loss", u), "t", tau)
        after = manifests.upsert(now, kept.select(key, F.lit(f"round {k}").alias("origin")), key)
        path = manifests.write_snapshot(after, root, k)
        now = after.sparkSession.read.schema(after.schema).parquet(path)
    return now
