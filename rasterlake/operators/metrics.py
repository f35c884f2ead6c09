"""Mask evaluation: one row an image in, scores out.

Whatever one image decides alone is computed on its arrays, so nothing moves: sums and counts in higher-order functions,
histograms, structure and distances in NumPy on Arrow batches, as no built-in function makes a histogram of an array or
its neighbourhoods. Only means over images are shuffled, and those are summed on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import formulas as fm
from rasterlake.functions.once import settled
from rasterlake.operators import stencil

KEYS = ["img_id", "method", "dataset", "class"]
EPS = 2.0**-52


def total(values: Column, start: float = 0.0) -> Column:
    return F.aggregate(values, F.lit(start), lambda a, v: a + v)


def prepare(df: DataFrame) -> DataFrame:
    """Adds ``p`` (prediction over 255, stretched to 0..1 unless constant), ``g`` (mask above 128), ``n``, ``f`` and ``mean_p``."""
    u = F.transform("pred", lambda v: v / F.lit(255.0))
    df = df.withColumn("u", u).withColumn("low", F.array_min("u")).withColumn("high", F.array_max("u"))
    p = F.transform("u", lambda v: F.when(F.col("high") != F.col("low"), (v - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(v))
    g = F.transform("gt", lambda v: (v > 128).cast("int"))
    df = settled(df.withColumn("p", p).withColumn("g", g).drop("u", "low", "high"))
    return df.withColumn("n", F.size("p")).withColumn("f", F.aggregate("g", F.lit(0), lambda a, v: a + v)).withColumn("mean_p", total(F.col("p")) / F.size("p")).transform(settled)


def pixels(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each pixel: ``pos``, ``p`` and ``g`` beside ``columns`` of the image."""
    return df.select(*columns, F.posexplode_outer(F.arrays_zip("p", "g")).alias("pos", "z")).select(*columns, "pos", "z.p", "z.g").where("pos IS NOT NULL")


def threshold() -> Column:
    return F.least(2 * F.col("mean_p"), F.lit(1.0))


def with_mae(df: DataFrame) -> DataFrame:
    return df.withColumn("mae", total(F.zip_with("p", "g", lambda p, g: F.abs(p - g))) / F.col("n"))


def mae(df: DataFrame) -> DataFrame:
    """Mean absolute error of each prepared image; narrow."""
    return with_mae(df).select(*KEYS, "mae")


def adaptive(df: DataFrame) -> DataFrame:
    """F and E at the threshold of twice the mean; narrow."""
    return with_adaptive(df).select(*KEYS, "tp", "ps", "adp_fm", "adp_em")


def with_adaptive(df: DataFrame) -> DataFrame:
    cut = df.withColumn("t", threshold())
    both = F.zip_with("p", "g", lambda p, g: F.struct((p >= F.col("t")).cast("int").alias("b"), ((p >= F.col("t")).cast("int") * g).alias("tp")))
    cut = cut.withColumn("z", both)
    cut = cut.withColumn("ps", F.aggregate("z", F.lit(0), lambda a, v: a + v["b"])).withColumn("tp", F.aggregate("z", F.lit(0), lambda a, v: a + v["tp"]))
    f = F.expr(f"CASE WHEN tp = 0 THEN 0E0 ELSE {fm.f_score('tp / CAST(ps AS DOUBLE)', 'tp / CAST(f AS DOUBLE)')} END")
    return cut.withColumn("adp_fm", f).withColumn("adp_em", F.expr(fm.enhanced_alignment("tp", "ps", "f", "n"))).drop("t", "z")


def per_image(df: DataFrame, columns: list[str], out: dict[str, str], score: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """``columns`` of each prepared image and what ``score`` makes of its ``p`` and ``g`` (boolean), both ``h`` by ``w``; Arrow batches, no shuffle.

    ``out`` names the columns of the result with their types. An image without pixels has nulls.
    """
    kinds = {"double": pa.float64(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 4
            h, w, p, g = (batch.column(k) for k in range(n, n + 4))
            pv, gv = p.values.to_numpy(zero_copy_only=False), g.values.to_numpy(zero_copy_only=False) > 0
            po, go = p.offsets.to_numpy(), g.offsets.to_numpy()
            rows = []
            for i, (hi, wi, ok) in enumerate(zip(h.to_pylist(), w.to_pylist(), p.is_valid().to_pylist(), strict=True)):
                rows.append(score(pv[po[i] : po[i + 1]].reshape(hi, wi), gv[go[i] : go[i + 1]].reshape(hi, wi)) if ok and po[i + 1] > po[i] else (None,) * len(out))
            made = [pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*columns, *out])

    types = dict(df.dtypes)
    return df.select(*columns, "h", "w", "p", "g").mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in columns] + [f"{c} {t}" for c, t in out.items()]))


def thresholds(p: np.ndarray, g: np.ndarray) -> tuple[list[int], list[int]]:
    """Pixels, and those of them in the mask, at or above each of 256 descending thresholds: one histogram and its running sum."""
    b = np.floor(p * 255).astype(np.int64).ravel()
    ps, tp = np.bincount(b, minlength=256), np.bincount(b[g.ravel()], minlength=256)
    return ps[::-1].cumsum().tolist(), tp[::-1].cumsum().tolist()


def curve_rows(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each threshold ``k`` of images that hold the arrays ``ps`` and ``tp``, beside ``columns``, ``n`` and ``f``: precision, recall, F and E."""
    rows = df.select(*columns, "n", "f", F.posexplode(F.arrays_zip("tp", "ps")).alias("k", "z")).select(*columns, "n", "f", "k", "z.tp", "z.ps")
    precision, recall = F.expr("tp / CAST(greatest(ps, 1) AS DOUBLE)"), F.expr("tp / CAST(greatest(f, 1) AS DOUBLE)")
    rows = rows.withColumn("precision", precision).withColumn("recall", recall)
    return rows.withColumn("fm", F.expr(fm.f_score("precision", "recall"))).withColumn("em", F.expr(fm.enhanced_alignment("tp", "ps", "f", "n")))


def curves(df: DataFrame) -> DataFrame:
    """Precision, recall, F and E of each image at 256 descending thresholds, empty bins included; narrow."""
    return curve_rows(per_image(df, [*KEYS, "n", "f"], {"ps": "array<long>", "tp": "array<long>"}, thresholds), *KEYS)


def _object(x: np.ndarray) -> float:
    """Likeness of values to a plain object: NaN for fewer than two."""
    if len(x) < 2:
        return np.nan
    m = x.mean()
    return 2 * m / (m * m + 1 + x.std(ddof=1) + EPS)


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Structural similarity of two rasters without constants; NaN for fewer than two pixels."""
    if x.size < 2:
        return np.nan
    mx, my = x.mean(), y.mean()
    dx, dy = x - mx, y - my
    top = 4 * mx * my * (dx * dy).sum() / (x.size - 1)
    low = (mx * mx + my * my) * ((dx * dx).sum() + (dy * dy).sum()) / (x.size - 1)
    return top / (low + EPS) if top else 1.0 if low == 0 else 0.0


def structure_parts(p: np.ndarray, g: np.ndarray) -> tuple[float | None, float | None, float]:
    """Object and region part (None where not defined) and S-measure of one image."""
    n, f = g.size, int(g.sum())
    if f in (0, n):
        return None, None, float(p.mean() if f else 1 - p.mean())
    share = f / n
    obj = share * _object(p[g]) + (1 - share) * _object(1 - p[~g])
    h, w = g.shape
    y, x = (int(np.rint((g.sum(axis=1 - k) * np.arange(g.shape[k])).sum() / f)) + 1 for k in (0, 1))
    mask = g.astype(np.float64)
    parts = [_likeness(p[rows, columns], mask[rows, columns]) for rows in (slice(0, y), slice(y, h)) for columns in (slice(0, x), slice(x, w))]
    weights = [x * y / n, y * (w - x) / n, (h - y) * x / n]
    reg = sum(a * b for a, b in zip([*weights, 1 - weights[0] - weights[1] - weights[2]], parts, strict=True))
    both = 0.5 * obj + 0.5 * reg
    return *(None if np.isnan(v) else float(v) for v in (obj, reg)), float(both) if both > 0 else 0.0


def structure(df: DataFrame) -> DataFrame:
    """S-measure with its object and region parts (NULL where not defined, and for empty and full masks); narrow."""
    got = per_image(df, [*KEYS, "f", "n"], {"sm_object": "double", "sm_region": "double", "sm": "double"}, structure_parts)
    return got.select(*KEYS, "f", "n", "sm_object", "sm_region", "sm")


def nearest_foreground(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance to, and row and column of, each pixel's nearest foreground pixel; ties go to the smaller row, then column.

    Two separable passes: the nearest in each column, then the best column. ``g`` must have foreground.
    """
    h, w = g.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(g, rows, -(4 * h)), axis=0)
    below = np.minimum.accumulate(np.where(g, rows, 5 * h)[::-1], axis=0)[::-1]
    near = np.where(rows - above <= below - rows, above, below)
    has = g.any(axis=0)
    columns = np.flatnonzero(has)
    dy = (near - rows)[:, columns].astype(np.int64)
    d2, ny, nx = (np.empty((h, w), dtype=np.int64) for _ in range(3))
    for x in range(w):
        key = (dy**2 + (columns - x) ** 2) * (h * w) + near[:, columns] * w + columns
        best = key.min(axis=1)
        d2[:, x], rest = np.divmod(best, h * w)
        ny[:, x], nx[:, x] = np.divmod(rest, w)
    return d2, ny, nx


def gauss_kernel(size: int = 7, sigma: float = 5.0) -> np.ndarray:
    """A normalised Gaussian over a square."""
    return np.outer(*[gauss_axis(size, sigma)] * 2)


def gauss_axis(size: int, sigma: float) -> np.ndarray:
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def weighted_f(p: np.ndarray, g: np.ndarray) -> float:
    """Weighted F of one image (Margolin, Zelnik-Manor, Tal 2014); 0 for an empty mask.

    Misses are softened by a Gaussian average of the misses around them, where false alarms take the miss of the nearest pixel of the mask;
    false alarms weigh up to twice, the more the farther they are from the mask.
    """
    f = int(g.sum())
    if not f:
        return 0.0
    d2, ny, nx = nearest_foreground(g)
    soft = np.pad((1 - p)[ny, nx], 3)
    for axis in (0, 1):  # the kernel is the product of one row and one column
        soft = sum(k * np.take(soft, np.arange(t, t + p.shape[axis]), axis=axis) for t, k in enumerate(gauss_axis(7, 5.0)))
    misses = np.minimum(1 - p[g], soft[g]).sum()
    alarms = (p[~g] * (2 - 0.5 ** (np.sqrt(d2[~g]) / 5))).sum()
    recall, precision = 1 - misses / f, (f - misses) / (f - misses + alarms + EPS)
    return float(2 * recall * precision / (recall + precision + EPS))


def weighted(df: DataFrame) -> DataFrame:
    """Weighted F of each prepared image, of any size; narrow."""
    return per_image(df, KEYS, {"wfm": "double"}, lambda p, g: (weighted_f(p, g),))


def distance(df: DataFrame) -> DataFrame:
    """``(img_id, pos, d2, ny, nx)`` for the background pixels of each image that has foreground."""

    def score(p: np.ndarray, g: np.ndarray) -> tuple:
        if not g.any():
            return (None,) * 4
        pos = np.flatnonzero(~g)
        return pos, *(a.ravel()[pos] for a in nearest_foreground(g))

    names = ["pos", "d2", "ny", "nx"]
    got = per_image(df, ["img_id"], dict.fromkeys(names, "array<long>"), score)
    return got.select("img_id", F.explode_outer(F.arrays_zip(*names)).alias("z")).where("z IS NOT NULL").select("img_id", *[f"z.{n}" for n in names])


def overlaps(df: DataFrame, top: float = 255.0) -> DataFrame:
    """Dice loss and soft IoU on values over ``top`` and not prepared; an IoU of nothing over nothing is NULL. Narrow.

    Both are meant for values from 0 to 1: rasters of bytes are divided by 255 here, which is a choice; ``top=1`` takes values as they come.
    """
    p, g = F.transform("pred", lambda v: v / F.lit(top)), F.transform("gt", lambda v: v / F.lit(top))
    df = df.withColumn("i", total(F.zip_with(p, g, lambda a, b: a * b))).withColumn("sp", total(p)).withColumn("sg", total(g))
    return df.select(*KEYS, F.expr("1 - 2 * (i + 1) / (sp + sg + 1)").alias("dice_loss"), F.expr("i / nullif(sg + sp - i, 0)").alias("iou"))


def confusion_iou(df: DataFrame) -> DataFrame:
    """IoU of background and foreground of each method from one confusion matrix, predictions cut at a half. An image is four counts before anything moves; a method without pixels has nulls."""
    cell = F.zip_with("p", "g", lambda p, g: 2 * g + (p >= 0.5).cast("int"))
    counted = df.withColumn("__cell", cell)
    counts = [F.size(F.filter("__cell", lambda v: v == F.lit(2 * y + z))).alias(f"c{y}{z}") for y, z in ((0, 0), (0, 1), (1, 0), (1, 1))]
    sums = settled(counted.where("p IS NOT NULL")).select("method", *counts).groupBy("method").agg(*[F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")])
    return sums.select("method", F.expr("c00 / CAST(nullif(c00 + c01 + c10, 0) AS DOUBLE)").alias("iou_0"), F.expr("c11 / CAST(nullif(c11 + c01 + c10, 0) AS DOUBLE)").alias("iou_1"))


SCORES = ["sm", "wfm", "mae", "adp_em", "mean_em", "max_em", "adp_fm", "mean_fm", "max_fm"]


def raw_mae(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Adds ``mae`` of images as validation sees them: predictions stretched and masks divided by their maximum, both with ``eps``; narrow."""
    p, g = stencil.stretch(F.col("pred"), eps), stencil.by_maximum(F.col("gt"), eps)
    return df.withColumn("mae", total(F.zip_with(p, g, lambda a, b: F.abs(a - b))) / F.size("pred"))


def scored(df: DataFrame, *more: str) -> DataFrame:
    """Every score that one prepared image has on its own, and its threshold counts ``ps`` and ``tp``, beside its keys and ``more`` columns: one pass, no shuffle."""

    def score(p: np.ndarray, g: np.ndarray) -> tuple:
        return weighted_f(p, g), structure_parts(p, g)[2], *thresholds(p, g)

    return per_image(with_adaptive(with_mae(df)), [*dict.fromkeys([*KEYS, *more]), "n", "f", "mae", "adp_fm", "adp_em"], {"wfm": "double", "sm": "double", "ps": "array<long>", "tp": "array<long>"}, score)


IMAGE_SCORES = ["sm", "wfm", "mae", "adp_em", "adp_fm"]


def _means() -> list[Column]:
    """At the first threshold, means of the scores of images; at each threshold, means of the curves."""
    return [*(F.avg(F.when(F.col("k") == 0, F.col(c))).alias(c) for c in IMAGE_SCORES), F.avg("fm").alias("fm"), F.avg("em").alias("em")]


def _nine() -> list[Column]:
    return [*(F.max(c).alias(c) for c in IMAGE_SCORES), F.avg("em").alias("mean_em"), F.max("em").alias("max_em"), F.avg("fm").alias("mean_fm"), F.max("fm").alias("max_fm")]


def partial_sums(rows: DataFrame, *by: str) -> DataFrame:
    """What a report needs of ``scored`` images, in a form that adds up: for each group, 256 rows of counts and sums of both curves, and at the first threshold those of the five scores."""
    curve = curve_rows(rows, *dict.fromkeys([*KEYS, *by]), *IMAGE_SCORES)
    first = [F.sum(F.when(F.col("k") == 0, F.col(c))).alias(c) for c in IMAGE_SCORES] + [F.count(F.when(F.col("k") == 0, F.col(c))).alias(f"n_{c}") for c in IMAGE_SCORES]
    return curve.groupBy(*by, "k").agg(*first, *[F.sum(c).alias(c) for c in ("fm", "em")], F.count("*").alias("images"))


def added(parts: DataFrame, *by: str) -> DataFrame:
    """Any number of ``partial_sums`` as one."""
    names = [*IMAGE_SCORES, *[f"n_{c}" for c in IMAGE_SCORES], "fm", "em", "images"]
    return parts.groupBy(*by, "k").agg(*[F.sum(c).alias(c) for c in names])


def merged_report(parts: DataFrame, *by: str) -> DataFrame:
    """The report from any number of ``partial_sums``, in any order."""
    whole = added(parts, *by)
    means = [F.try_divide(c, f"n_{c}").alias(c) for c in IMAGE_SCORES] + [F.try_divide(c, "images").alias(c) for c in ("fm", "em")]
    return whole.select(*by, "k", *means).groupBy(*by).agg(*_nine()).select(*by, *[F.bround(c, 4).alias(c) for c in SCORES])


def report_sets(df: DataFrame, *sets: list[str]) -> DataFrame:
    """The reports of several groupings from one pass over pixels; columns that a grouping leaves out are NULL."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    rows = curve_rows(scored(df, *keys), *dict.fromkeys([*KEYS, *keys]), *IMAGE_SCORES)
    curve = rows.groupingSets([[F.col(c) for c in (*s, "k")] for s in sets], *keys, "k").agg(F.grouping_id().alias("__set"), *_means())
    return curve.groupBy("__set", *keys).agg(*_nine()).select(*keys, *[F.bround(c, 4).alias(c) for c in SCORES])


def report(df: DataFrame, *by: str) -> DataFrame:
    """The nine scores of each group of prepared images, to four places half to even.

    Maxima and means of curves are taken over the mean curve of the group, and every image counts the same. Pixels are read in
    one narrow pass; the shuffle carries 256 rows for each group and task. A null group is a group.
    """
    rows = curve_rows(scored(df, *by), *dict.fromkeys([*KEYS, *by]), *IMAGE_SCORES)
    return rows.groupBy(*by, "k").agg(*_means()).groupBy(*by).agg(*_nine()).select(*by, *[F.bround(c, 4).alias(c) for c in SCORES])
