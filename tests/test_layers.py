import time
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import layers, manifests, training
from rasterlake.operators.layers import Conv
from rasterlake.plans import networks

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(4)


@pytest.mark.parametrize("name", list(networks.QUERIES))
def test_matches_sql(spark, same_rows, name):
    same_rows(networks.QUERIES[name](spark, SF), networks.ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(networks.QUERIES) == set(networks.ORACLE_SQL)


def test_a_worker_keeps_the_results_of_one_slice(spark):
    """However many images a batch of Arrow has (here all of them), nothing that was made of earlier slices is held when the next is worked on."""
    images, before = 9000, []

    def make(x):
        alive = sum(made() is not None for made in before)
        y = x[:, :1] * 0 + alive
        before.append(weakref.ref(y))
        return y

    df = spark.range(0, images, 1, 1).select(F.col("id").alias("k"), layers.tensor(F.array(*[F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i * 1.0)] * 2), F.lit(8), F.lit(8)).alias("x"))
    rows = layers.apply(df, {"y": (["x"], make)}).agg(F.count("y.v").alias("n"), F.max(F.array_max("y.v")).alias("alive")).first()
    assert rows.n == images and rows.alive == 0


def test_a_batch_is_sent_once_and_not_held_by_its_results(spark, monkeypatch):
    """An input that stays is one column of a batch, not two; what is given back shares no memory with the batch, which could not be freed while the next is read."""
    df, caught = frame(spark, [RNG.normal(size=(2, 4, 4)), None]), {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: caught.update(run=run, sent=self.columns))
    layers.apply(df, {"y": (["x"], layers.same)})
    assert caught["sent"] == ["k", "x"]
    layers.apply(df.withColumn("z", F.col("x")), {"y": (["x", "z"], np.add), "w": (["z"], layers.same)}, ["x"])
    assert caught["sent"] == ["k", "z", "x"]
    n = 1500  # three slices
    x, z = ([None if k % 7 == r else np.full((2, 8, 8), k + r * 0.5) for k in range(n)] for r in (0, 1))
    given = {"k": pa.array(range(n)), "x": layers._packed(x), "z": layers._packed(z)}
    batch = pa.RecordBatch.from_arrays([given[c] for c in caught["sent"]], caught["sent"])
    taken = [(b.address, b.address + b.size) for c in batch.columns for b in buffers(c)]
    done = list(caught["run"](iter([batch])))
    assert len(done) > 2 and not any(low < b.address + b.size and b.address < high for d in done for c in d.columns for b in buffers(c) for low, high in taken)
    got = pa.Table.from_batches(done).to_pydict()
    assert list(got) == ["k", "z", "y", "w"] and got["k"] == list(range(n)) and got["z"] == got["w"] == given["z"].to_pylist()
    assert [None if y is None else y["v"][0] for y in got["y"]] == [None if k % 7 < 2 else 2 * k + 0.5 for k in range(n)]


def buffers(column):
    return [b for b in column.buffers() if b is not None and b.size]


def test_slices_cover_all_rows():
    sizes = [0, 3, 9, 2, 2, 2, 0, 0, 50, 4, 6]
    column = layers._packed([None if n == 0 else np.ones((1, 1, n)) for n in sizes])
    assert list(layers._slices([column], 6)) == [(0, 2), (2, 1), (3, 5), (8, 1), (9, 1), (10, 1)]
    assert list(layers._slices([column, column], 6)) == [(0, 2), (2, 1), (3, 1), (4, 1), (5, 3), (8, 1), (9, 1), (10, 1)]
    assert list(layers._slices([column.slice(3, 4)], 6)) == [(0, 4)] and list(layers._slices([column.slice(0, 0)], 6)) == [(0, 1)]
    for at, n in layers._slices([column], 6):
        part = column.slice(at, n)
        assert [None if x is None else x["v"] for x in part.to_pylist()] == [None if s == 0 else [1.0] * s for s in sizes[at : at + n]]


@pytest.mark.parametrize(("name", "passes"), [("decoder_identify", 1), ("decoder_search", 1), ("decoder_neighbours", 1), ("receptive_field", 0), ("bottleneck", 0)])
def test_python_passes_of_a_stage(spark, monkeypatch, name, passes):
    """Each pass of a stage has a worker of its own for each task: the pyramid is one, and a block without it is written without any."""
    seen, written = [], manifests.written

    def count(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return written(df)

    monkeypatch.setattr(manifests, "written", count)
    df = networks.QUERIES[name](spark, SF)
    assert seen[0] == passes and set(seen[1:]) == {1}
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_pyramid(spark):
    images = [RNG.normal(size=(2, 8, 12)), None, RNG.normal(size=(1, 4, 5))]
    df = layers.pyramid(frame(spark, images), "x", ["a", "b"])
    want = layers.pool(layers.pool(frame(spark, images), "x", "a", 2, 2), "a", "b", 2, 2)
    for name in ("a", "b"):
        assert all((a is None and b is None) or (a == b).all() for a, b in zip(back(df, name), back(want, name), strict=True))


def frame(spark, arrays, **more):
    rows = [(k, None if a is None else [c.ravel().tolist() for c in a], 1 if a is None else a.shape[1], 1 if a is None else a.shape[2]) for k, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "k long, c array<array<double>>, h int, w int").repartition(3)
    return df.select("k", layers.tensor(F.col("c"), F.col("h"), F.col("w")).alias("x"))


def back(df, column):
    return [None if r[0] is None else np.array(r[0].v).reshape(r[0].c, r[0].h, r[0].w) for r in df.orderBy("k").select(column).collect()]


def naive_conv(x, w, spec, bias=None):
    (ph, pw), d, s = spec.padding, spec.dilation, spec.stride
    h = (x.shape[1] + 2 * ph - d * (spec.size[0] - 1) - 1) // s + 1
    wd = (x.shape[2] + 2 * pw - d * (spec.size[1] - 1) - 1) // s + 1
    out = np.zeros((spec.out, h, wd))
    for o, y, q in np.ndindex(out.shape):
        for i, a, b in np.ndindex(w.shape[1:]):
            yy, xx = y * s + a * d - ph, q * s + b * d - pw
            if 0 <= yy < x.shape[1] and 0 <= xx < x.shape[2]:
                out[o, y, q] += w[o, i, a, b] * x[i, yy, xx]
        out[o, y, q] += 0 if bias is None else bias[o]
    return out


@pytest.mark.parametrize("spec", [Conv(2, 3), layers.square(3, 2), layers.square(1, 2, 3, 5), Conv(2, 1, (1, 5), (0, 2)), Conv(2, 2, (7, 1), (3, 0)), layers.square(2, 3, 7, 1, 2), Conv(1, 1, (2, 3), (1, 0), 2, 3)])
def test_convolution(spec):
    x, w, b = RNG.normal(size=(spec.inp, 9, 8)), RNG.normal(size=(spec.out, spec.inp, *spec.size)), RNG.normal(size=spec.out)
    assert np.allclose(layers.correlate(x, w, spec, b), naive_conv(x, w, spec, b))
    with pytest.raises(ValueError, match="channels"):
        layers.correlate(x[:, :, :][[0] * (spec.inp + 1)], w, spec)


def test_normalisation_over_images_of_all_sizes(spark):
    images = [RNG.normal(1e6, 2, size=(2, h, w)) for h, w in ((3, 4), (1, 1), (5, 2), (8, 8))] + [None]
    spec = layers.square(2, 2)
    w = np.zeros((2, 2, 3, 3))
    w[0, 0, 1, 1] = w[1, 1, 1, 1] = w[1, 0, 0, 2] = 1
    got = back(layers.conv_norm(frame(spark, images), {"y": (["x"], layers.same, (spec, w))}), "y")
    conv = [None if x is None else naive_conv(x, w, spec) for x in images]
    flat = np.concatenate([c.reshape(2, -1) for c in conv if c is not None], axis=1)
    want = [None if c is None else (c - flat.mean(1)[:, None, None]) / np.sqrt(flat.var(1) + 1e-5)[:, None, None] for c in conv]
    assert got[-1] is None and all(np.allclose(a, b, atol=1e-6) for a, b in zip(got[:-1], want[:-1], strict=True))
    stats = {"y": np.stack([flat.mean(1), flat.var(1)], axis=1)}
    trained = layers.conv_norm(frame(spark, images), {"y": (["x"], layers.same, (spec, w))}, stats)
    assert "Exchange" not in trained.drop("k")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(back(trained, "y")[:-1], want[:-1], strict=True))
    assert back(layers.conv_norm(frame(spark, images).limit(0), {"y": (["x"], layers.same, (spec, w))}), "y") == []
    scaled = layers.normaliser(stats["y"], np.array([2.0, 3.0]), np.array([1.0, -1.0]))(conv[0])
    assert np.allclose(scaled, want[0] * np.array([2, 3])[:, None, None] + np.array([1, -1])[:, None, None])


def naive_pool(x, size, stride, padding, how, ceil, outside):
    out = []
    for n in x.shape[1:]:
        k = (n + 2 * padding - size + (stride - 1 if ceil else 0)) // stride + 1
        out.append(k - 1 if ceil and (k - 1) * stride >= n + padding else k)
    got = np.zeros((len(x), *out))
    for c, y, q in np.ndindex(got.shape):
        y0, x0 = y * stride - padding, q * stride - padding
        y1, x1 = min(y0 + size, x.shape[1] + padding), min(x0 + size, x.shape[2] + padding)
        inner = x[c, max(y0, 0) : min(y1, x.shape[1]), max(x0, 0) : min(x1, x.shape[2])]
        got[c, y, q] = inner.max() if how == "max" else inner.sum() / ((y1 - y0) * (x1 - x0) if outside else inner.size)
    return got


@pytest.mark.parametrize("args", [(3, 2, 1, "max", False, True), (3, 2, 1, "mean", False, True), (2, 2, 0, "mean", True, False), (3, 3, 0, "mean", True, False), (3, 2, 1, "mean", True, True), (3, 2, 1, "max", True, True), (2, 2, 0, "max", False, True)])
def test_pooling(args):
    for shape in ((2, 8, 8), (1, 7, 10), (1, 5, 4)):
        x = RNG.normal(size=shape) - 3
        assert np.allclose(layers.pooled(x, *args), naive_pool(x, *args))


def test_growth():
    x = np.array([[[0.0, 1.0], [2.0, 3.0]]])
    assert np.allclose(layers.upsampled(x)[0, 0], [0, 1 / 3, 2 / 3, 1]) and np.allclose(layers.upsampled(x)[0, :, 3], [1, 5 / 3, 7 / 3, 3])
    assert np.allclose(layers.upsampled(x, corners=False)[0, 0], [0, 0.25, 0.75, 1])
    assert layers.upsampled(np.ones((1, 1, 1)), 8).shape == (1, 8, 8)


def test_receptive_field_by_layers(spark):
    images = [RNG.normal(size=(2, 9, 7)), RNG.normal(size=(2, 4, 6))]
    specs = layers.receptive_specs(2, 3)
    made = {n: (s, RNG.normal(size=(s.out, s.inp, *s.size))) for n, s in specs.items()}

    def norm(xs):
        flat = np.concatenate([x.reshape(len(x), -1) for x in xs], axis=1)
        return [(x - flat.mean(1)[:, None, None]) / np.sqrt(flat.var(1) + 1e-5)[:, None, None] for x in xs]

    step = lambda n, xs: norm([naive_conv(x, made[n][1], made[n][0]) for x in xs])
    branches = []
    for b in range(4):
        xs = images
        for k in range(1 if b == 0 else 4):
            xs = step(f"b{b}_{k}", xs)
        branches.append(xs)
    joined = step("cat", [np.concatenate(x) for x in zip(*branches, strict=True)])
    want = [np.maximum(a + b, 0) for a, b in zip(joined, step("res", images), strict=True)]
    got = back(layers.receptive_field(frame(spark, images), "x", "y", made), "y")
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(got, want, strict=True))


def test_attention_groups(spark):
    x, y = np.arange(8.0).reshape(8, 1, 1), np.full((1, 1, 1), -1.0)
    assert layers.interleaved(x, y, 4).ravel().tolist() == [0, 1, -1, 2, 3, -1, 4, 5, -1, 6, 7, -1]
    assert layers.interleaved(x, y, 1).ravel().tolist() == [*range(8), -1]
    df = frame(spark, [x]).withColumn("y", F.col("x"))
    for groups in (3, 64, 0):
        with pytest.raises(ValueError, match="not supported"):
            layers.interleaved(x, y, groups)
        with pytest.raises(ValueError, match="not supported"):
            layers.reverse_stage(df, "x", "y", "z", [(groups, None, None, None, None)])
    mix, score = layers.attention_specs(8, 2)
    guided = layers.attend(x, y, 2, (mix, np.zeros((8, 10, 3, 3))), np.full(8, -5.0), (score, np.ones((1, 8, 3, 3))), np.array([0.5]))
    assert np.allclose(guided[0], x) and guided[1].item() == -1 + x.sum() + 0.5
    out = back(layers.reverse_stage(df.withColumn("y", layers.tensor(F.array(F.array(F.lit(0.0))), F.lit(1), F.lit(1))), "x", "y", "z", [(2, (mix, np.zeros((8, 10, 3, 3))), np.zeros(8), (score, np.zeros((1, 8, 3, 3))), np.zeros(1))]), "z")
    assert out[0].ravel().tolist() == [0.5]


@pytest.mark.parametrize("neighbours", [False, True])
def test_decoder_by_layers(spark, neighbours):
    sizes = ((2, 3), (4, 6), (8, 12))
    images = [[RNG.normal(size=(2, *s)) for s in sizes] for _ in range(3)]
    specs = layers.decoder_specs(2, search=True)
    made = {n: (s, RNG.normal(size=(s.out, s.inp, *s.size))) for n, s in specs.items()}

    def step(n, xs):
        conv = [naive_conv(x, made[n][1], made[n][0]) for x in xs]
        flat = np.concatenate([x.reshape(len(x), -1) for x in conv], axis=1)
        return [(x - flat.mean(1)[:, None, None]) / np.sqrt(flat.var(1) + 1e-5)[:, None, None] for x in conv]

    coarse, middle, fine = zip(*images, strict=True)
    up = lambda xs: [layers.upsampled(x) for x in xs]
    m = [a * b for a, b in zip(step("up1", up(coarse)), middle, strict=True)]
    f = [a * b * c for a, b, c in zip(step("up2", up(m) if neighbours else up(up(coarse))), step("up3", up(middle)), fine, strict=True)]
    c2 = step("cat2", [np.concatenate(x) for x in zip(m, step("up4", up(coarse)), strict=True)])
    c3 = step("cat3", [np.concatenate(x) for x in zip(f, step("up5", up(c2)), fine, strict=True)])
    want = [naive_conv(x, made["out"][1], made["out"][0], [0.25]) for x in step("last", c3)]
    df = frame(spark, fine).withColumnRenamed("x", "fine")
    for name, xs in (("middle", middle), ("coarse", coarse)):
        df = df.join(frame(spark, xs).withColumnRenamed("x", name), "k")
    got = back(layers.decode(df, "coarse", "middle", "fine", "out", made, np.array([0.25]), neighbours, "fine"), "out")
    assert all(np.allclose(a, b, atol=1e-7) for a, b in zip(got, want, strict=True))


def norm_all(conv):
    flat = np.concatenate([x.reshape(len(x), -1) for x in conv], axis=1)
    return [(x - flat.mean(1)[:, None, None]) / np.sqrt(flat.var(1) + 1e-5)[:, None, None] for x in conv]


def relu(xs):
    return [np.maximum(x, 0) for x in xs]


@pytest.mark.parametrize("stride", [1, 2])
def test_bottleneck_by_layers(spark, stride):
    images = [RNG.normal(size=(4, 6, 8)), RNG.normal(size=(4, 4, 2)), RNG.normal(size=(4, 7, 5))]
    made = {n: (s, RNG.normal(size=(s.out, s.inp, *s.size))) for n, s in layers.bottleneck_specs(4, 2, 4, stride).items()}
    if stride == 1:
        del made["skip"]
    step = lambda n, xs: norm_all([naive_conv(x, made[n][1], made[n][0]) for x in xs])
    deep = step("out", relu(step("mid", relu(step("in", images)))))
    want = relu([a + b for a, b in zip(deep, step("skip", images) if stride > 1 else images, strict=True)])
    got = back(layers.bottleneck(frame(spark, images), "x", "y", made), "y")
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("first", [True, False])
def test_split_block_by_layers(spark, first):
    images = [RNG.normal(size=(5, 6, 7)), RNG.normal(size=(5, 4, 4))]
    stride = 2 if first else 1
    made = {n: (s, RNG.normal(size=(s.out, s.inp, *s.size))) for n, s in layers.split_specs(5, 3, 5, stride).items() if first or n != "skip"}
    step = lambda n, xs: norm_all([naive_conv(x, made[n][1], made[n][0]) for x in xs])
    parts = [np.split(x, 4) for x in relu(step("in", images))]
    done, before = [], None
    for k in range(3):
        own = [p[k] for p in parts]
        before = relu(step(f"s{k}", own if first or before is None else [a + b for a, b in zip(before, own, strict=True)]))
        done.append(before)
    last = [naive_pool(p[3], 3, stride, 1, "mean", False, True) if first else p[3] for p in parts]
    deep = step("out", [np.concatenate(x) for x in zip(*done, last, strict=True)])
    skip = step("skip", [naive_pool(x, stride, stride, 0, "mean", True, False) for x in images]) if first else images
    want = relu([a + b for a, b in zip(deep, skip, strict=True)])
    got = back(layers.split_block(frame(spark, images), "x", "y", made), "y")
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(got, want, strict=True))


def test_guided_cascade_by_stages(spark):
    sizes, images, maps = ((2, 3), (4, 6), (8, 12)), [], []
    for _ in range(2):
        images.append([RNG.normal(size=(4, *s)) for s in sizes])
        maps.append(RNG.normal(size=(1, 8, 12)))

    def attention(groups):
        mix, score = layers.attention_specs(4, groups)
        return groups, (mix, RNG.normal(size=(4, 4 + groups, 3, 3)) / 6), RNG.normal(size=4), (score, RNG.normal(size=(1, 4, 3, 3)) / 6), RNG.normal(size=1)

    stages = [[attention(g) for g in (1, 2, 4)] for _ in sizes]
    df = frame(spark, maps).withColumnRenamed("x", "map")
    for k in range(3):
        df = df.join(frame(spark, [i[k] for i in images]).withColumnRenamed("x", f"l{k}"), "k")
    out = layers.guided_cascade(df, ["l0", "l1", "l2"], "map", ["a", "b", "c"], stages)
    got = {n: back(out, n) for n in "abc"}
    for i, (levels, m) in enumerate(zip(images, maps, strict=True)):
        y = layers.resized(m, 2, 3, False)
        for k, n in enumerate("abc"):
            y = layers.upsampled(y, 2, False) if k else y
            x, z = levels[k], 1 - 1 / (1 + np.exp(-y))
            for groups, (ms, mw), mb, (ss, sw), sb in stages[k]:
                joined = np.concatenate([p for c in np.split(x, groups) for p in (c, z)])
                x = x + np.maximum(naive_conv(joined, mw, ms, mb), 0)
                z = z + naive_conv(x, sw, ss, sb)
            y = y + z
            assert np.allclose(got[n][i], y)
    assert np.allclose(layers.resized(np.arange(8.0).reshape(1, 1, 8), 1, 2, False), [1.5, 5.5])
    with pytest.raises(ValueError, match="not supported"):
        layers.guided_cascade(df, ["l0"], "map", ["a"], [[(5, *attention(1)[1:])]])


def test_augmentation_is_the_same_on_every_run_and_partitioning(spark):
    images = [RNG.normal(size=(3, 6, 5)) for _ in range(40)] + [None, np.full((3, 2, 2), 7.0), np.full((3, 1, 1), -2.0)]
    df = frame(spark, images)
    one, two = (layers.augment(d, "x", "weak", "strong", "k", 5) for d in (df, df.repartition(9).coalesce(2)))
    for name in ("weak", "strong"):
        a, b = back(one, name), back(two, name)
        assert all((x is None and y is None) or (x == y).all() for x, y in zip(a, b, strict=True))
    weak, strong = back(one, "weak"), back(one, "strong")
    flipped = [not np.allclose(w, x) for w, x in zip(weak[:40], images[:40], strict=True)]
    assert all(np.allclose(w, x[:, :, ::-1] if f else x) for w, x, f in zip(weak[:40], images[:40], flipped, strict=True)) and 8 < sum(flipped) < 32
    stretched = [s.min() >= 0 and s.max() <= 1 for s in strong[:40]]
    assert 8 < sum(stretched) < 32 and strong[40] is None and set(strong[41].ravel().round(9)) <= {1.0, 7.0} and set(strong[42].ravel().round(9)) <= {0.0, -2.0}
    other = back(layers.augment(df, "x", "weak", "strong", "k", 6), "strong")
    assert sum(np.allclose(a, b) for a, b in zip(strong[:40], other[:40], strict=True)) < 10
    kernel = np.exp(-0.5 * np.arange(-1, 2) ** 2 / 0.7**2)
    x = RNG.normal(size=(1, 5, 5))
    wide = np.pad(x[0], 1, mode="reflect")
    want = [[(wide[i : i + 3, j : j + 3] * np.outer(kernel, kernel) / kernel.sum() ** 2).sum() for j in range(5)] for i in range(5)]
    assert np.allclose(layers.blur3(x, 0.7)[0], want)


def test_remap_of_keys(spark):
    have = spark.createDataFrame([("a.w", 1.0), ("b_1.w", 2.0), ("layer3.0.w", 3.0), ("x_10.w", 9.0), ("c", 5.0)], "key string, w double")
    want = spark.createDataFrame([("a.w",), ("b_1.w",), ("layer3_1.0.w",), ("layer3_2.0.w",), ("c_2_1",), ("c_2_1",)], "key string")
    have = have.union(spark.createDataFrame([("c_2", 6.0)], have.schema))
    got = {r.key: (r.source, r.w) for r in layers.remap(have, want, "key").collect()}
    assert got == {"a.w": ("a.w", 1.0), "b_1.w": ("b_1.w", 2.0), "layer3_1.0.w": ("layer3.0.w", 3.0), "layer3_2.0.w": ("layer3.0.w", 3.0), "c_2_1": ("c_2", 6.0)}
    with pytest.raises(Exception, match="no weights for d_1"):
        layers.remap(have, spark.createDataFrame([("d_1",)], "key string"), "key").collect()
    with pytest.raises(Exception, match="no weights for c_2_1"):  # only the first tag that is known goes
        layers.remap(have.where("key = 'c'"), want.where("key = 'c_2_1'"), "key").collect()
    with pytest.raises(Exception, match="given twice"):
        layers.remap(have.union(have), want, "key").collect()


def test_weights(spark):
    rows = [("a", 0, 0, 0, 0, 2.0), ("a", 1, 0, 0, 0, 3.0), ("z", 5, 5, 5, 5, 1.0)]
    table = spark.createDataFrame(rows, "layer string, o int, i int, y int, x int, w double")
    (spec, w) = layers.read_weights(table, {"a": Conv(2, 2)})["a"]
    assert w.tolist() == [[[[2.0]], [[0.0]]], [[[3.0]], [[0.0]]]]
    for bad in ([("a", 2, 0, 0, 0, 1.0)], rows[:1]):
        with pytest.raises(ValueError, match="twice or outside"):
            layers.read_weights(table.union(spark.createDataFrame(bad, table.schema)), {"a": Conv(2, 2)})


def test_settings_of_a_table_of_runs(spark):
    df = spark.createDataFrame([(1, "C2C", "SINet", None), (2, "S2C", "SINet-v2", 0.3), (3, "S2C", "SINet", 0.7)], "run int, t string, n string, u double")
    got = {r.run: r.settings for r in training.with_settings(df, "t", "n", {"u": F.col("u"), "epoch": F.lit(3)}).collect()}
    assert got == {1: training.settings("C2C", "SINet", epoch=3.0), 2: training.settings("S2C", "SINet-v2", u=0.3, epoch=3), 3: training.settings("S2C", "SINet", u=0.7, epoch=3.0)}
    for row in ((1, "x", "SINet", None), (1, None, "SINet", None), (1, "C2C", "y", None)):
        with pytest.raises(Exception, match="unknown task or network"):
            training.with_settings(spark.createDataFrame([row], df.schema), "t", "n").collect()
    with pytest.raises(ValueError, match="unknown setting"):
        training.with_settings(df, "t", "n", {"nope": F.lit(1)})


SIDE, IMAGES = 352, 4


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    df = spark.range(IMAGES).select("id", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.sin(i * (F.col("id") + 3) / 50)).alias("v")).repartition(IMAGES)
    path = str(tmp_path_factory.mktemp("full") / "t")
    df.select("id", layers.tensor(F.array("v", F.transform("v", lambda v: v * v), F.transform("v", lambda v: -v)), F.lit(SIDE), F.lit(SIDE)).alias("x")).write.parquet(path)
    return spark.read.parquet(path)


def made(specs):
    return {n: (s, RNG.normal(size=(s.out, s.inp, *s.size))) for n, s in specs.items()}


def pyramid(df):
    return layers.pool(layers.pool(df, "x", "half", 2, 2), "half", "quarter", 2, 2)


FULL = {
    "conv_norm": lambda df: layers.conv_norm(df, {"y": (["x"], layers.same, made({"y": layers.square(8, 3)})["y"])}),
    "receptive_field": lambda df: layers.receptive_field(df, "x", "y", made(layers.receptive_specs(3, 2))),
    "reverse_stage": lambda df: layers.reverse_stage(df.withColumn("g", layers.tensor(F.array(F.slice("x.v", 1, SIDE * SIDE)), F.lit(SIDE), F.lit(SIDE))), "x", "g", "y", [(1, made({"m": layers.attention_specs(3, 1)[0]})["m"], np.zeros(3), made({"m": layers.attention_specs(3, 1)[1]})["m"], np.zeros(1))]),
    "decode": lambda df: layers.decode(pyramid(df), "quarter", "half", "x", "y", made(layers.decoder_specs(3)), np.zeros(1), True),
    "bottleneck": lambda df: layers.bottleneck(df, "x", "y", made(layers.bottleneck_specs(3, 4, 8, 2))),
    "split_block": lambda df: layers.split_block(df, "x", "y", made(layers.split_specs(3, 2, 8, 2))),
    "pool": lambda df: layers.pool(df, "x", "y", 3, 2, 1),
    "augment": lambda df: layers.augment(df, "x", "weak", "y", "id", 3),
}


@pytest.mark.parametrize("name", list(FULL))
def test_seconds_an_image(full, name):
    began = time.time()
    assert FULL[name](full).select(F.sum(F.get("y.v", F.lit(7)))).first()[0] is not None
    assert (time.time() - began) / IMAGES < 3
