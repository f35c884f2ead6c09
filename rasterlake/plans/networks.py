"""Queries of the networks' building blocks, on rasters and weights from ``embeddings``, and SQL that gives the same rows from long tables and joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators import layers, metrics, stencil, training
from rasterlake.operators.layers import Conv
from rasterlake.plans.oracle import _BASE
from rasterlake.plans.queries import IMAGENET
from rasterlake.sources import rasters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A vector has 64 elements, and a layer's weights start at the vector of 16 times its number.
WIDTH, STEP = 64, 16


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _layers(spark, sf, numbered: dict[str, tuple[int, Conv]]) -> dict[str, layers.Layer]:
    """Layers by name from their numbers and shapes; their weights are read in one job."""
    shapes = [F.struct(F.lit(name).alias("layer"), F.lit(STEP * k).alias("first"), *[F.lit(v).alias(n) for n, v in (("n", s.weights), ("inp", s.inp), ("kh", s.size[0]), ("kw", s.size[1]))]) for name, (k, s) in numbered.items()]
    last = max(STEP * k + s.weights // WIDTH for k, s in numbered.values())
    v = src.table(spark, sf, "embeddings").where(F.col("vec_id").between(0, last)).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "w"))
    at = v.select("w", "vec_id", "pos", F.explode(F.array(*shapes)).alias("s")).withColumn("at", (F.col("vec_id") - F.col("s.first")) * WIDTH + F.col("pos")).where("at >= 0 AND at < s.n")
    return layers.read_weights(at.selectExpr("s.layer", "at div (s.inp * s.kh * s.kw) AS o", "at div (s.kh * s.kw) % s.inp AS i", "at div s.kw % s.kh AS y", "at % s.kw AS x", "w"), {name: s for name, (_, s) in numbered.items()})


def _tensors(spark, sf) -> DataFrame:
    """``img_id`` and a tensor ``x`` of prediction and mask."""
    df = metrics.prepare(src.rasters(spark, sf))
    return df.select("img_id", layers.tensor(F.array("p", F.transform("g", lambda g: g.cast("double"))), F.col("h"), F.col("w")).alias("x"))


def _pyramid(spark, sf) -> DataFrame:
    """``_tensors`` with maxima over 2 by 2 (``half``) and 4 by 4 (``quarter``)."""
    return layers.pyramid(_tensors(spark, sf), "x", ["half", "quarter"])


def _long(df: DataFrame, column: str, *keep: str, places: int = 4) -> DataFrame:
    flat = df.select("img_id", *keep, F.col(f"{column}.h").alias("h"), F.col(f"{column}.w").alias("w"), F.posexplode_outer(f"{column}.v").alias("n", "v"))
    return flat.selectExpr("img_id", *keep, "CAST(n div (h * w) AS INT) AS c", "CAST(n % (h * w) AS BIGINT) AS pos", f"round(v, {places}) AS v")


@query
def conv_norm(spark, sf):
    """Three channels from two by kernels of 3 by 3, normalised over all images."""
    df = _tensors(spark, sf)
    return _long(layers.conv_norm(df, {"y": (["x"], layers.same, _layers(spark, sf, {"y": (0, layers.square(3, 2))})["y"])}), "y")


@query
def conv_strided(spark, sf):
    """The head of a backbone: kernels of 7 by 7 at stride 2, normalised, rectified, maxima over 3 by 3 at stride 2."""
    df = _tensors(spark, sf)
    df = layers.conv_norm(df, {"y": (["x"], layers.same, _layers(spark, sf, {"y": (0, layers.square(2, 2, 7, 1, 2))})["y"])})
    return _long(layers.apply(df, {"z": (["y"], lambda y: layers.pooled(np.maximum(y, 0), 3, 2, 1))}), "z")


@query
def receptive_field(spark, sf):
    made = _layers(spark, sf, {name: (k, spec) for k, (name, spec) in enumerate(layers.receptive_specs(2, 2).items())})
    return _long(layers.receptive_field(_tensors(spark, sf), "x", "y", made), "y")


@query
def group_reversal(spark, sf):
    """Guidance of one channel refined by attention in one, two and four groups of four channels."""
    df = metrics.prepare(src.rasters(spark, sf)).join(src.teacher_student(spark, sf).select("img_id", "e", "proto"), "img_id")
    four = F.array("p", F.transform("g", lambda g: g.cast("double")), "e", "proto")
    df = df.select("img_id", layers.tensor(four, F.col("h"), F.col("w")).alias("x"), layers.tensor(F.array("e"), F.col("h"), F.col("w")).alias("y"))
    specs = {groups: layers.attention_specs(4, groups) for groups in (1, 2, 4)}
    numbered = {}
    for k, (groups, (mix, score)) in enumerate(specs.items()):
        numbered |= {f"mix{groups}": (4 * k, mix), f"mix_bias{groups}": (4 * k + 1, Conv(4, 1)), f"score{groups}": (4 * k + 2, score), f"score_bias{groups}": (4 * k + 3, Conv(1, 1))}
    made = _layers(spark, sf, numbered)
    blocks = [(g, made[f"mix{g}"], made[f"mix_bias{g}"][1].ravel(), made[f"score{g}"], made[f"score_bias{g}"][1].ravel()) for g in specs]
    return _long(layers.reverse_stage(df, "x", "y", "out", blocks), "out")


def _cascade_layers() -> dict[str, tuple[int, Conv]]:
    """Layers of three stages over two channels, in one group and in two."""
    out, k = {}, 0
    for stage in range(3):
        for groups in (1, 2):
            mix, score = layers.attention_specs(2, groups)
            for name, spec in (("mix", mix), ("mix_bias", Conv(2, 1)), ("score", score), ("score_bias", Conv(1, 1))):
                out[f"{name}{stage}{groups}"] = (k, spec)
                k += 1
    return out


@query
def guided_cascade(spark, sf):
    """A map of the finest size, shrunk and refined on its way up through features of three sizes."""
    made = _layers(spark, sf, _cascade_layers())
    stages = [[(g, made[f"mix{k}{g}"], made[f"mix_bias{k}{g}"][1].ravel(), made[f"score{k}{g}"], made[f"score_bias{k}{g}"][1].ravel()) for g in (1, 2)] for k in range(3)]
    guide = src.teacher_student(spark, sf).select("img_id", layers.tensor(F.array("e"), F.lit(src.SIDE), F.lit(src.SIDE)).alias("y"))
    names = ["a", "b", "c"]
    df = layers.guided_cascade(_pyramid(spark, sf).join(guide, "img_id"), ["quarter", "half", "x"], "y", names, stages)
    both = df.select("img_id", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("t")) for n in names])).alias("s"))
    return _long(both.select("img_id", "s.level", "s.t"), "t", "level")


@query
def bottleneck(spark, sf):
    """A bottleneck at stride 2."""
    made = _layers(spark, sf, {name: (k, spec) for k, (name, spec) in enumerate(layers.bottleneck_specs(2, 2, 4, 2).items())})
    return _long(layers.bottleneck(_tensors(spark, sf), "x", "y", made), "y")


@query
def split_stage(spark, sf):
    """A split block at stride 2 that begins a stage, and one after it."""
    first = {name: (k, spec) for k, (name, spec) in enumerate(layers.split_specs(2, 2, 2, 2).items())}
    after = {name: (k + 8, spec) for k, (name, spec) in enumerate(layers.split_specs(2, 2, 2).items())}
    df = layers.split_block(_tensors(spark, sf), "x", "y", _layers(spark, sf, first))
    second = _layers(spark, sf, after)
    return _long(layers.split_block(df, "y", "z", {n: w for n, w in second.items() if n != "skip"}), "z")


def _decoder(spark, sf, neighbours: bool, search: bool) -> DataFrame:
    numbered = {name: (k, spec) for k, (name, spec) in enumerate(layers.decoder_specs(2, search).items())}
    made = _layers(spark, sf, {**numbered, "bias": (10, Conv(1, 1))})
    return _long(layers.decode(_pyramid(spark, sf), "quarter", "half", "x", "out", made, made["bias"][1].ravel(), neighbours, "x" if search else None), "out")


@query
def decoder_search(spark, sf):
    return _decoder(spark, sf, False, True)


@query
def decoder_identify(spark, sf):
    return _decoder(spark, sf, False, False)


@query
def decoder_neighbours(spark, sf):
    return _decoder(spark, sf, True, False)


@query
def pooling_stages(spark, sf):
    """Maxima and means over 3 by 3 at stride 2, and means at stride 3 whose last window goes beyond the edge."""
    ways = {"a": (3, 2, 1), "b": (3, 2, 1, "mean"), "m": (3, 3, 0, "mean", True, False)}
    df = layers.apply(_tensors(spark, sf), {tuple(ways): (["x"], lambda x: tuple(layers.pooled(x, *how) for how in ways.values()))})
    both = df.select("img_id", F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(c).alias("t")) for n, c in (("max", "a"), ("mean", "b"), ("beyond", "m"))])).alias("s"))
    return _long(both.select("img_id", "s.stage", "s.t"), "t", "stage", places=6)


@query
def augment_views(spark, sf):
    """Weak and strong views of three normalised channels: prediction, mask, inverted prediction."""
    df = src.rasters(spark, sf).withColumn("channels", F.array("pred", "gt", F.transform("pred", lambda v: 255 - v)))
    df = df.select("img_id", layers.tensor(stencil.normalise_channels(F.col("channels"), *IMAGENET), F.col("h"), F.col("w")).alias("x"))
    df = layers.augment(df, "x", "weak", "strong", "img_id", 11)
    both = df.select("img_id", F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.col(n).alias("t")) for n in ("weak", "strong")])).alias("s"))
    return _long(both.select("img_id", "s.view", "s.t"), "t", "view", places=6)


@query
def weights_remap(spark, sf):
    """Weights named by class and vector, for a network with two branches of each class; classes below 5 also keep their own name."""
    v = src.table(spark, sf, "embeddings").where("vec_id % 2 = 0").select("vec_id", F.col("label").cast("string").alias("l"), F.get(F.col("embedding").cast("array<double>"), F.lit(0)).alias("w"))
    name = lambda tag: F.concat(F.lit("layer"), "l", F.lit(tag + "."), F.col("vec_id").cast("string"), F.lit(".weight"))
    want = v.select(name("_1").alias("key")).union(v.select(name("_2"))).union(v.where("CAST(l AS INT) < 5").select(name("")))
    return layers.remap(v.select(name("").alias("key"), "w"), want, "key").select("key", "source", F.round("w", 6).alias("w"))


@query
def lr_schedule(spark, sf):
    """The rate of each step of a run whose epochs are the days of ``events``."""
    days = src.table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    first = days.agg(F.min("day").alias("first"))
    numbered = days.select("event_id", (F.datediff("day", first.scalar()) + 1).alias("epoch"))
    return numbered.select("event_id", F.col("epoch").cast("int").alias("epoch"), F.round(training.learning_rate(F.col("epoch"), 1.0, 0.1, 50) * 1e6, 6).alias("lr"))


@query
def task_settings(spark, sf):
    """Settings of the runs that ``orders`` describe: task by status, network by priority, and the threshold of urgent ones given."""
    orders = src.table(spark, sf, "orders").where("o_orderkey IS NOT NULL")
    task = F.when(F.col("o_orderstatus") == "O", "S2C").otherwise("C2C")
    runs = orders.select(F.col("o_orderkey").alias("run"), task.alias("task"), F.when(F.col("o_orderpriority").startswith("1"), "SINet-v2").otherwise("SINet").alias("network"), F.when(F.col("o_orderpriority").startswith("2"), F.lit(0.9)).alias("u"))
    return training.with_settings(runs, "task", "network", {"u": F.col("u")}).select("run", "task", "network", F.explode("settings").alias("name", "value"))


# SQL: a tensor is a long table (img_id, c, y, x, v); each step is a subquery of the one before.


def _w(number: int, spec: Conv) -> str:
    kh, kw = spec.size
    return f"""(SELECT n // {spec.inp * kh * kw} AS o, n // {kh * kw} % {spec.inp} AS i, n // {kw} % {kh} AS ky, n % {kw} AS kx, w FROM (
      SELECT (vec_id - {STEP * number}) * {WIDTH} + unnest(range(0, {WIDTH})) AS n, unnest(CAST(embedding AS DOUBLE[])) AS w FROM embeddings WHERE vec_id BETWEEN {STEP * number} AND {STEP * number + (spec.weights - 1) // WIDTH}) WHERE n < {spec.weights})"""


def _conv(t: str, number: int, spec: Conv, side: int = 8, bias: int | None = None) -> str:
    (ph, pw), (kh, kw), d, s = spec.padding, spec.size, spec.dilation, spec.stride
    h, w = ((side + 2 * p - d * (k - 1) - 1) // s for p, k in zip(spec.padding, spec.size, strict=True))
    more = "" if bias is None else f" + any_value((SELECT w FROM {_w(bias, Conv(spec.out, 1))} b WHERE b.o = q.o))"
    return f"""(SELECT img_id, o AS c, oy // {s} AS y, ox // {s} AS x, sum(v * w){more} AS v FROM (SELECT img_id, o, y + {ph} - ky * {d} AS oy, x + {pw} - kx * {d} AS ox, v, w FROM {t} t JOIN {_w(number, spec)} k ON k.i = t.c) q
      WHERE oy % {s} = 0 AND ox % {s} = 0 AND oy BETWEEN 0 AND {h * s} AND ox BETWEEN 0 AND {w * s} GROUP BY ALL)"""


def _norm(t: str) -> str:
    return f"(SELECT img_id, c, y, x, (v - avg(v) OVER (PARTITION BY c)) / sqrt(var_pop(v) OVER (PARTITION BY c) + 1e-5) AS v FROM {t})"


def _cat(*parts: tuple[str, int]) -> str:
    at, out = 0, []
    for t, n in parts:
        out.append(f"SELECT img_id, c + {at} AS c, y, x, v FROM {t}")
        at += n
    return "(" + " UNION ALL ".join(out) + ")"


def _product(*tables: str) -> str:
    names = [f"m{k}" for k in range(len(tables))]
    return f"(SELECT img_id, c, y, x, {' * '.join(f'{n}.v' for n in names)} AS v FROM {' JOIN '.join(f'{t} {n}' + (' USING (img_id, c, y, x)' if k else '') for k, (t, n) in enumerate(zip(tables, names, strict=True)))})"


def _grown(t: str, side: int) -> str:
    axis = f"(SELECT i, k, sum(f) AS f FROM (SELECT i, unnest([floor(p), least(floor(p) + 1, {side - 1})]) AS k, unnest([1 - p + floor(p), p - floor(p)]) AS f FROM (SELECT i, i * {side - 1} / {2 * side - 1}::DOUBLE AS p FROM range({2 * side}) r(i))) GROUP BY i, k)"
    return f"(SELECT img_id, c, a.i AS y, b.i AS x, sum(v * a.f * b.f) AS v FROM {t} t JOIN {axis} a ON a.k = t.y JOIN {axis} b ON b.k = t.x GROUP BY ALL)"


def _pooled(t: str, side: int, size: int, stride: int, padding: int, how: str, count: int, divide: str = "") -> str:
    return f"(SELECT img_id, c, a.o AS y, b.o AS x, {how}(v){divide} AS v FROM {t} t JOIN range({count}) a(o) ON t.y + {padding} BETWEEN a.o * {stride} AND a.o * {stride} + {size - 1} JOIN range({count}) b(o) ON t.x + {padding} BETWEEN b.o * {stride} AND b.o * {stride} + {size - 1} GROUP BY ALL)"


_X = ", xt AS MATERIALIZED (SELECT img_id, c, y, x, CASE c WHEN 0 THEN p ELSE g::DOUBLE END AS v FROM px, range(2) r(c)), hf AS MATERIALIZED (SELECT img_id, c, y // 2 AS y, x // 2 AS x, max(v) AS v FROM xt GROUP BY ALL), qt AS MATERIALIZED (SELECT img_id, c, y // 2 AS y, x // 2 AS x, max(v) AS v FROM hf GROUP BY ALL)"


def _steps(steps: dict[str, str], last: str, side: int = 8, places: int = 4, base: str = _X) -> str:
    """Named steps, each worked out once, and the long rows of ``last``."""
    return f"{_BASE}{base}" + "".join(f", {name} AS MATERIALIZED (SELECT * FROM {sql} s)" for name, sql in steps.items()) + f" SELECT img_id, CAST(c AS INT) AS c, CAST(y * {side} + x AS BIGINT) AS pos, round(v, {places}) AS v FROM {last}"


def _receptive_sql() -> str:
    numbered = {name: (k, spec) for k, (name, spec) in enumerate(layers.receptive_specs(2, 2).items())}
    one = lambda name, t: _norm(_conv(t, *numbered[name]))
    steps = {"s_b0_0": one("b0_0", "xt"), "s_res": one("res", "xt")}
    for b in (1, 2, 3):
        before = "xt"
        for k in range(4):
            steps[f"s_b{b}_{k}"] = one(f"b{b}_{k}", before)
            before = f"s_b{b}_{k}"
    steps["s_cat"] = one("cat", _cat(("s_b0_0", 2), ("s_b1_3", 2), ("s_b2_3", 2), ("s_b3_3", 2)))
    return _steps(steps, "(SELECT img_id, c, y, x, greatest(a.v + b.v, 0) AS v FROM s_cat a JOIN s_res b USING (img_id, c, y, x))")


def _reversal_sql() -> str:
    steps = {"f0": "(SELECT img_id, c, y, x, [p, g::DOUBLE, val, pval][c + 1] AS v FROM px, range(4) r(c))", "y0": "(SELECT img_id, 0 AS c, y, x, 1 - 1 / (1 + exp(-val)) AS v FROM px)"}
    for k, groups in enumerate((1, 2, 4)):
        mix, score = layers.attention_specs(4, groups)
        n = 4 // groups
        joined = f"(SELECT img_id, c + c // {n} AS c, y, x, v FROM f{k} UNION ALL SELECT img_id, (r.j + 1) * {n + 1} - 1 AS c, y, x, v FROM y{k}, range({groups}) r(j))"
        steps[f"f{k + 1}"] = f"(SELECT img_id, c, y, x, a.v + greatest(b.v, 0) AS v FROM f{k} a JOIN {_conv(joined, 4 * k, mix, bias=4 * k + 1)} b USING (img_id, c, y, x))"
        steps[f"y{k + 1}"] = f"(SELECT img_id, c, y, x, a.v + b.v AS v FROM y{k} a JOIN {_conv(f'f{k + 1}', 4 * k + 2, score, bias=4 * k + 3)} b USING (img_id, c, y, x))"
    return _steps(steps, "y3", base="")


def _shrunk(t: str, side: int, to: int) -> str:
    """Corners not on corners; also grows."""
    axis = f"(SELECT i, k, sum(f) AS f FROM (SELECT i, unnest([floor(p), least(floor(p) + 1, {side - 1})]) AS k, unnest([1 - p + floor(p), p - floor(p)]) AS f FROM (SELECT i, least(greatest((i + 0.5) * {side} / {to}::DOUBLE - 0.5, 0), {side - 1}) AS p FROM range({to}) r(i))) GROUP BY i, k)"
    return f"(SELECT img_id, c, a.i AS y, b.i AS x, sum(v * a.f * b.f) AS v FROM {t} t JOIN {axis} a ON a.k = t.y JOIN {axis} b ON b.k = t.x GROUP BY ALL)"


def _cascade_sql() -> str:
    numbered = _cascade_layers()
    conv = lambda t, name, key, side: _conv(t, *numbered[f"{name}{key}"], side, bias=numbered[f"{name}_bias{key}"][0])
    steps = {"e0": "(SELECT img_id, 0 AS c, y, x, val AS v FROM px)", "g0": _shrunk("e0", 8, 2)}
    for stage, (side, features) in enumerate(((2, "qt"), (4, "hf"), (8, "xt"))):
        if stage:
            steps[f"g{stage}"] = _shrunk(f"o{stage - 1}", side // 2, side)
        f, y = features, f"y{stage}0"
        steps[y] = f"(SELECT img_id, c, y, x, 1 - 1 / (1 + exp(-v)) AS v FROM g{stage})"
        for groups in (1, 2):
            n, key = 2 // groups, f"{stage}{groups}"
            joined = f"(SELECT img_id, c + c // {n} AS c, y, x, v FROM {f} UNION ALL SELECT img_id, (r.j + 1) * {n + 1} - 1 AS c, y, x, v FROM {y}, range({groups}) r(j))"
            steps[f"f{key}"] = f"(SELECT img_id, c, y, x, a.v + greatest(b.v, 0) AS v FROM {f} a JOIN {conv(joined, 'mix', key, side)} b USING (img_id, c, y, x))"
            steps[f"y{key}"] = f"(SELECT img_id, c, y, x, a.v + b.v AS v FROM {y} a JOIN {conv(f'f{key}', 'score', key, side)} b USING (img_id, c, y, x))"
            f, y = f"f{key}", f"y{key}"
        steps[f"o{stage}"] = f"(SELECT img_id, c, y, x, a.v + b.v AS v FROM {y} a JOIN g{stage} b USING (img_id, c, y, x))"
    head = _steps(steps, "o0").rpartition(" SELECT img_id, CAST(c AS INT)")[0]
    return head + " UNION ALL ".join(f" SELECT img_id, '{n}' AS level, CAST(c AS INT) AS c, CAST(y * {side} + x AS BIGINT) AS pos, round(v, 4) AS v FROM o{k}" for k, (n, side) in enumerate((("a", 2), ("b", 4), ("c", 8))))


_RELU = lambda t: f"(SELECT img_id, c, y, x, greatest(v, 0) AS v FROM {t})"
_SUM = lambda a, b: f"(SELECT img_id, c, y, x, greatest(a.v + b.v, 0) AS v FROM {a} a JOIN {b} b USING (img_id, c, y, x))"
_PART = lambda t, k: f"(SELECT img_id, c - {2 * k} AS c, y, x, v FROM {t} WHERE c BETWEEN {2 * k} AND {2 * k + 1})"


def _bottleneck_sql() -> str:
    n = {name: (k, spec) for k, (name, spec) in enumerate(layers.bottleneck_specs(2, 2, 4, 2).items())}
    steps = {"a": _RELU(_norm(_conv("xt", *n["in"]))), "b": _RELU(_norm(_conv("a", *n["mid"]))), "d": _norm(_conv("b", *n["out"], 4)), "e": _norm(_conv("xt", *n["skip"]))}
    return _steps(steps, _SUM("d", "e"), 4)


def _split_sql() -> str:
    one = {name: (k, spec) for k, (name, spec) in enumerate(layers.split_specs(2, 2, 2, 2).items())}
    two = {name: (k + 8, spec) for k, (name, spec) in enumerate(layers.split_specs(2, 2, 2).items())}
    conv = lambda t, at, side: _norm(_conv(t, *at, side))
    steps = {"a": _RELU(conv("xt", one["in"], 8)), **{f"s{k}": _RELU(conv(_PART("a", k), one[f"s{k}"], 8)) for k in range(3)}}
    steps["l"] = _pooled(_PART("a", 3), 8, 3, 2, 1, "sum", 4, " / 9")
    steps["o"] = conv(_cat(("s0", 2), ("s1", 2), ("s2", 2), ("l", 2)), one["out"], 4)
    steps["k"] = conv(_pooled("xt", 8, 2, 2, 0, "avg", 4), one["skip"], 4)
    steps["z"] = _SUM("o", "k")
    steps["b"] = _RELU(conv("z", two["in"], 4))
    steps["t0"] = _RELU(conv(_PART("b", 0), two["s0"], 4))
    for k in (1, 2):
        steps[f"t{k}"] = _RELU(conv(f"(SELECT img_id, c, y, x, a.v + b.v AS v FROM t{k - 1} a JOIN {_PART('b', k)} b USING (img_id, c, y, x))", two[f"s{k}"], 4))
    steps["p"] = conv(_cat(("t0", 2), ("t1", 2), ("t2", 2), (_PART("b", 3), 2)), two["out"], 4)
    return _steps(steps, _SUM("p", "z"), 4)


def _decoder_sql(neighbours: bool, search: bool) -> str:
    numbered = {name: (k, spec) for k, (name, spec) in enumerate(layers.decoder_specs(2, search).items())}
    one = lambda name, t, side: _norm(_conv(t, *numbered[name], side))
    steps = {"m": _product(one("up1", _grown("qt", 2), 4), "hf"), "u4": one("up4", _grown("qt", 2), 4)}
    below = _grown("m", 4) if neighbours else _grown(_grown("qt", 2), 4)
    steps["f"] = _product(one("up2", below, 8), one("up3", _grown("hf", 4), 8), "xt")
    steps["c2"] = one("cat2", _cat(("m", 2), ("u4", 2)), 4)
    steps["u5"] = one("up5", _grown("c2", 4), 8)
    steps["c3"] = one("cat3", _cat(("f", 2), ("u5", 4), *([("xt", 2)] if search else [])), 8)
    steps["c4"] = one("last", "c3", 8)
    return _steps(steps, _conv("c4", *numbered["out"], bias=10))


_U = lambda what: f"(('0x' || md5(img_id || ':11:{what}')[1:8])::BIGINT / 4294967296::DOUBLE)"
_AUGMENT = f"""{_BASE}, ch AS (SELECT img_id, y, x, c, ([pred, gt, 255 - pred][c + 1] / 255.0::DOUBLE - [0.485::DOUBLE, 0.456, 0.406][c + 1]) / [0.229::DOUBLE, 0.224, 0.225][c + 1] AS v,
      {_U('flip')} > 0.5 AS f, {_U('contrast')} < 0.5 AS k, 0.1::DOUBLE + 1.4::DOUBLE * {_U('sigma')} AS s FROM raw, range(3) r(c)),
    wk AS (SELECT img_id, c, y, CASE WHEN f THEN 7 - x ELSE x END AS x, v, k, exp(-0.5 / (s * s)) / (1 + 2 * exp(-0.5 / (s * s))) AS e FROM ch),
    ac AS (SELECT img_id, c, y, x, e, CASE WHEN NOT k THEN v WHEN max(v) OVER i = min(v) OVER i THEN least(greatest(v, 0), 1) ELSE (v - min(v) OVER i) / (max(v) OVER i - min(v) OVER i) END AS v FROM wk WINDOW i AS (PARTITION BY img_id, c)),
    tp AS (SELECT i, d, CASE WHEN i + d < 0 THEN 1 WHEN i + d > 7 THEN 6 ELSE i + d END AS j FROM range(8) r(i), range(-1, 2) q(d)),
    bl AS (SELECT img_id, c, a.i AS y, b.i AS x, sum(v * CASE WHEN a.d = 0 THEN 1 - 2 * e ELSE e END * CASE WHEN b.d = 0 THEN 1 - 2 * e ELSE e END) AS v FROM ac JOIN tp a ON a.j = ac.y JOIN tp b ON b.j = ac.x GROUP BY ALL)
    SELECT img_id, 'weak' AS view, CAST(c AS INT) AS c, CAST(y * 8 + x AS BIGINT) AS pos, round(v, 6) AS v FROM wk UNION ALL SELECT img_id, 'strong', CAST(c AS INT), CAST(y * 8 + x AS BIGINT), round(v, 6) FROM bl"""

_STAGES = " UNION ALL ".join(
    f"SELECT img_id, '{n}' AS stage, CAST(c AS INT) AS c, CAST(y * {k} + x AS BIGINT) AS pos, round(v, 6) AS v FROM {t}"
    for n, k, t in (("max", 4, _pooled("xt", 8, 3, 2, 1, "max", 4)), ("mean", 4, _pooled("xt", 8, 3, 2, 1, "sum", 4, " / 9")), ("beyond", 3, _pooled("xt", 8, 3, 3, 0, "avg", 3)))
)

ORACLE_SQL: dict[str, str] = {
    "conv_norm": _steps({}, _norm(_conv("xt", 0, layers.square(3, 2)))),
    "conv_strided": _steps({"a": f"(SELECT img_id, c, y, x, greatest(v, 0) AS v FROM {_norm(_conv('xt', 0, layers.square(2, 2, 7, 1, 2)))})"}, _pooled("a", 4, 3, 2, 1, "max", 2), 2),
    "receptive_field": _receptive_sql(),
    "group_reversal": _reversal_sql(),
    "guided_cascade": _cascade_sql(),
    "bottleneck": _bottleneck_sql(),
    "split_stage": _split_sql(),
    "decoder_search": _decoder_sql(False, True),
    "decoder_identify": _decoder_sql(False, False),
    "decoder_neighbours": _decoder_sql(True, False),
    "pooling_stages": f"{_BASE}{_X} {_STAGES}",
    "augment_views": _AUGMENT,
    "weights_remap": """WITH v AS (SELECT 'layer' || label || '.' || vec_id || '.weight' AS source, label, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS w FROM embeddings WHERE vec_id % 2 = 0)
        SELECT 'layer' || label || '_' || t || '.' || vec_id || '.weight' AS key, source, w FROM v, range(1, 3) r(t) UNION ALL SELECT source, source, w FROM v WHERE label < 5""",
    "lr_schedule": """WITH e AS (SELECT event_id, CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS INTEGER) + 1 AS epoch FROM events)
        SELECT event_id, epoch, round(power(0.1::DOUBLE, 50 * ((epoch // 50) * (epoch // 50 - 1) // 2) + (epoch // 50) * (epoch % 50 + 1)) * 1e6, 6) AS lr FROM e""",
    "task_settings": """WITH r AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'O' THEN 'S2C' ELSE 'C2C' END AS task, CASE WHEN o_orderpriority LIKE '1%' THEN 'SINet-v2' ELSE 'SINet' END AS network, o_orderpriority LIKE '2%' AS urgent FROM orders)
        SELECT run, task, network, unnest(['epoch', 'batchsize', 'decay_epoch', 'alpha', 'u', 'tau', 'a', 'b', 'c']) AS name, unnest([CASE network WHEN 'SINet' THEN 40 ELSE 100 END, CASE network WHEN 'SINet' THEN 16 ELSE 32 END,
          CASE network WHEN 'SINet' THEN 30 ELSE 50 END, CASE task WHEN 'S2C' THEN 0.996 ELSE 0.9996 END, CASE WHEN urgent THEN 0.9 WHEN task = 'S2C' THEN 0.8 ELSE 1 END, CASE task WHEN 'S2C' THEN 0.4 ELSE 0.5 END, CASE task WHEN 'S2C' THEN 0.9 ELSE 0.7 END, 0.3, 0.5]::DOUBLE[]) AS value FROM r""",
}
