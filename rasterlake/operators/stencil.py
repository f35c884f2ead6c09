"""Stencils, resizing and losses on rasters held as flat arrays; all narrow, one row an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.once import bound, settled

#: Sobel kernels.
SOBEL_X = [[1, 0, -1], [2, 0, -2], [1, 0, -1]]
SOBEL_Y = [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]


def convolve(values: Column, h: Column, w: Column, kernel: list[list[float]]) -> Column:
    """Correlation with a small kernel, zeros outside."""
    r, c = len(kernel) // 2, len(kernel[0]) // 2
    taps = [(i - r, j - c, k) for i, row in enumerate(kernel) for j, k in enumerate(row) if k]

    def at(v: Column, i: Column) -> Column:
        y, x, out = F.floor(i / w), i % w, F.lit(0.0)
        for dy, dx, k in taps:
            inside = (y + dy).between(0, h - 1) & (x + dx).between(0, w - 1)
            out = out + F.when(inside, F.get(values, (i + dy * w + dx).cast("int")) * F.lit(float(k))).otherwise(0.0)
        return out

    return F.transform(values, at)


def box_mean(values: Column, h: Column, w: Column, size: int = 31) -> tuple:
    """Mean over a centred square, counting zeros outside: sums along rows, then along columns."""
    half = size // 2
    zero = F.lit(0.0)
    row = F.transform(values, lambda v, i: F.aggregate(F.slice(values, (i - F.least(i % w, F.lit(half)) + 1).cast("int"), (F.least(i % w, F.lit(half)) + F.least(w - 1 - i % w, F.lit(half)) + 1).cast("int")), zero, lambda a, x: a + x))

    def down(v: Column, i: Column) -> Column:
        y = F.floor(i / w)
        ys = F.sequence(F.greatest(y - half, F.lit(0)), F.least(y + half, h - 1))
        return F.aggregate(ys, zero, lambda a, t: a + F.get(F.col("__rows"), (t * w + i % w).cast("int"))) / float(size * size)

    return row, down


def with_box_mean(df: DataFrame, column: str, out: str, size: int = 31) -> DataFrame:
    row, down = box_mean(F.col(column), F.col("h"), F.col("w"), size)
    df = df.withColumn("__rows", row)
    return df.withColumn(out, F.transform("__rows", down)).drop("__rows")


def edges(df: DataFrame, column: str, out: str) -> DataFrame:
    """Edge strength ``sqrt(gx^2 + gy^2 + 1e-8)``."""
    gx, gy = (convolve(F.col(column), F.col("h"), F.col("w"), k) for k in (SOBEL_X, SOBEL_Y))
    df = settled(df.withColumn("__gx", gx).withColumn("__gy", gy))
    return df.withColumn(out, F.zip_with("__gx", "__gy", lambda a, b: F.sqrt(a * a + b * b + F.lit(1e-8)))).drop("__gx", "__gy")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def bce(p: Column, t: Column) -> Column:
    """Binary cross-entropy of probabilities, logarithms held at -100 or above."""
    log = lambda v: F.greatest(F.coalesce(F.ln(v), F.lit(-100.0)), F.lit(-100.0))
    return -(t * log(p) + (1 - t) * log(1 - p))


def edge_loss(df: DataFrame, a: float = 0.7, b: float = 0.3, c: float = 0.5, weighted: bool = False) -> DataFrame:
    """Adds ``loss``: ``a`` times the mean edge difference plus ``b`` times the cross-entropy of ``s`` against ``t``."""
    df = edges(edges(df, "s", "__es"), "t", "__et")
    edge = mean(F.zip_with("__es", "__et", lambda x, y: F.abs(x - y)))
    cross = mean(F.zip_with("s", "t", lambda p, t: bce(p, t) * ((t + c) if weighted else 1)))
    return settled(settled(df).withColumn("loss", a * edge + b * cross).drop("__es", "__et"))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def bce_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def structure_loss(df: DataFrame) -> DataFrame:
    """Adds ``loss`` of logits ``x`` against ``g``: mean cross-entropy plus an IoU part weighted by distance from the local mean."""
    df = df.withColumn("m", F.transform("g", lambda v: v.cast("double")))
    df = with_box_mean(df, "m", "box")
    w = F.zip_with("box", "m", lambda b, m: 1 + 5 * F.abs(b - m))
    df = df.withColumn("wt", w).withColumn("sx", F.transform("x", sigmoid))
    zero = F.lit(0.0)
    inter = F.aggregate(F.zip_with(F.zip_with("sx", "m", lambda s, m: s * m), "wt", lambda v, k: v * k), zero, lambda a, v: a + v)
    union = F.aggregate(F.zip_with(F.zip_with("sx", "m", lambda s, m: s + m), "wt", lambda v, k: v * k), zero, lambda a, v: a + v)
    cross = mean(F.zip_with("x", "m", bce_logits))
    df = df.withColumn("i", inter).withColumn("un", union)
    return df.withColumn("loss", cross + 1 - (F.col("i") + 1) / (F.col("un") - F.col("i") + 1)).drop("m", "box", "wt", "sx", "i", "un")


def resize(values: Column, h: Column, w: Column, height: int | Column, width: int | Column, align_corners: bool) -> Column:
    """Bilinear resize of a flat raster to ``height`` by ``width``."""
    height, width = (F.lit(x) if isinstance(x, int) else x for x in (height, width))

    def source(i: Column, old: Column, new: Column) -> Column:
        if align_corners:
            return i * (old - 1) / F.greatest(new - 1, F.lit(1)).cast("double")
        return F.least(F.greatest((i + 0.5) * old / new.cast("double") - 0.5, F.lit(0.0)), (old - 1).cast("double"))

    def tap(i: Column) -> Column:
        sy, sx = source(F.floor(i / width), h, height), source(i % width, w, width)
        y, x = F.floor(sy), F.floor(sx)
        fy, fx = sy - y, sx - x
        y1, x1 = F.least(y + 1, h - 1), F.least(x + 1, w - 1)
        get = lambda a, b: F.get(values, (a * w + b).cast("int"))
        top = get(y, x) * (1 - fx) + get(y, x1) * fx
        return top * (1 - fy) + (get(y1, x) * (1 - fx) + get(y1, x1) * fx) * fy

    return F.transform(F.sequence(F.lit(0), height * width - 1), tap)


def resize_nearest(values: Column, h: Column, w: Column, height: int | Column, width: int | Column) -> Column:
    """Resize that takes, for each pixel, the one whose place its corner falls on."""
    height, width = (F.lit(x) if isinstance(x, int) else x for x in (height, width))
    at = lambda i: F.floor(F.floor(i / width) * h / height) * w + F.floor((i % width) * w / width)
    return F.transform(F.sequence(F.lit(0), height * width - 1), lambda i: F.get(values, at(i).cast("int")))


def stretch(values: Column, eps: float = 1e-8) -> Column:
    """Min-max with a small constant in the denominator; in linear time."""
    ends = F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    return bound(ends, lambda e: F.transform(values, lambda v: (v - e["low"]) / (e["high"] - e["low"] + eps)))


def by_maximum(values: Column, eps: float = 1e-8) -> Column:
    """Values over their maximum, with a small constant in the denominator; in linear time."""
    return bound(F.array_max(values), lambda m: F.transform(values, lambda v: v / (m + F.lit(eps))))


def stretch_channels(channels: Column, eps: float = 1e-8) -> Column:
    """``stretch`` of each channel (an array of flat arrays) on its own."""
    return F.transform(channels, lambda c: stretch(c, eps))


def normalise_channels(channels: Column, mean: list[float], std: list[float], top: float = 255.0) -> Column:
    """Channel ``k`` over ``top``, less ``mean[k]``, over ``std[k]``."""
    m, s = (F.array(*map(F.lit, x)) for x in (mean, std))
    return F.transform(channels, lambda c, k: F.transform(c, lambda v: (v / F.lit(top) - F.get(m, k)) / F.get(s, k)))


def flip_rows(values: Column, h: Column, w: Column) -> Column:
    """Horizontal mirror."""
    return F.transform(values, lambda v, i: F.get(values, (i - 2 * (i % w) + w - 1).cast("int")))


def attention_taps(size: int = 31, reach: float = 4.0) -> list[float]:
    """One axis of the attention kernel: roots of the normal probabilities of ``size`` cells over ``reach`` deviations either way, summing to 1.

    The two-dimensional kernel is the outer product of this axis with itself.
    """
    from math import erf, sqrt

    cell = (2 * reach + 1) / size
    step = (2 * reach + cell) / size
    edge = [0.5 * (1 + erf((-reach - cell / 2 + step * k) / sqrt(2))) for k in range(size + 1)]
    roots = [sqrt(b - a) for a, b in zip(edge, edge[1:], strict=False)]
    return [r / sum(roots) for r in roots]


def separable_blur(df: DataFrame, column: str, out: str, taps: list[float]) -> DataFrame:
    """Correlation with the outer product of ``taps`` with itself, zeros outside: along rows, then along columns."""
    half, weights = len(taps) // 2, F.array(*map(F.lit, taps))
    h, w = F.col("h"), F.col("w")

    def along(values: Column, place: Column, size: Column, stride: Column, i: Column) -> Column:
        reach = F.sequence(F.greatest(F.lit(0), half - place).cast("int"), F.least(F.lit(2 * half), half + size - 1 - place).cast("int"))
        return F.aggregate(reach, F.lit(0.0), lambda a, t: a + F.get(weights, t) * F.get(values, (i + (t - half) * stride).cast("int")))

    df = settled(df.withColumn("__rows", F.transform(column, lambda v, i: along(F.col(column), i % w, w, F.lit(1), i))))
    return settled(df.withColumn(out, F.transform("__rows", lambda v, i: along(F.col("__rows"), F.floor(i / w), h, w, i))).drop("__rows"))


def search_attention(df: DataFrame, attention: str, features: str, out: str) -> DataFrame:
    """``features`` times the larger of ``attention`` and its blurred, stretched form."""
    df = separable_blur(df, attention, "__soft", attention_taps())
    df = settled(df.withColumn("__soft", stretch(F.col("__soft"))))
    both = F.zip_with("__soft", attention, lambda a, b: F.greatest(a, b))
    return df.withColumn(out, F.zip_with(both, features, lambda m, x: m * x)).drop("__soft")
