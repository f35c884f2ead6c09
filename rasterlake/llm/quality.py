"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are labelled rows; everything unlabelled is web text of unknown quality. The class prior is
estimated from the two samples, and a small network minimises
``prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])``.
Inputs are statistics of the whole text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import begin_task, materialize, table

#: The classes of bytes whose shares are inputs.
BYTE_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"?", b"|", b"#$%&*@~^", b"<>{}[]()=/\\_", b"\"'`;:-+"]
N_FEATURES = len(BYTE_CLASSES) + 1 + 12
_CLASS = np.full(256, len(BYTE_CLASSES), dtype=np.intp)
for _k, _bytes in enumerate(BYTE_CLASSES):
    _CLASS[list(_bytes)] = _k


def text_features(text: str | None) -> np.ndarray:
    """Fixed-length statistics of a whole text; a null or empty text gives zeros."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=len(BYTE_CLASSES) + 1) / len(raw)
    k = len(BYTE_CLASSES) + 1
    out[:k] = np.sqrt(shares)
    ws = raw.split()
    n = len(ws)
    lines = raw.split(b"\n")
    out[k] = np.log1p(n) / 10
    if n:
        distinct = len(set(ws))
        out[k + 1] = sum(map(eq, ws, ws[1:])) / n
        out[k + 2] = sum(map(eq, ws, ws[2:])) / n
        out[k + 3] = distinct / n
        out[k + 4] = distinct / n**0.8
        out[k + 5] = (len(raw) / n) / 20
        out[k + 6] = min(max(map(len, ws)), 200) / 50
        out[k + 7] = sum(map(bytes.isupper, ws)) / n
        out[k + 8] = sum(map(bytes.isalpha, ws)) / n
    out[k + 9] = 1 - len(set(lines)) / len(lines)
    out[k + 10] = np.log1p(len(raw) / len(lines)) / 10
    p = counts[counts > 0] / len(raw)
    out[k + 11] = -(p * np.log2(p)).sum() / 8
    return out


class Network:
    """One hidden layer on standardised inputs; ``score`` is the probability of the positive class."""

    def __init__(self, mean, scale, weights):  # noqa: ANN001
        self.mean, self.scale, self.weights = mean, scale, weights

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, hidden: int, seed: int) -> Network:
    """Minimise the non-negative risk (or, without a prior, separate the two samples) by Adam on logistic loss."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    net = Network(both.mean(0), both.std(0) + 1e-3, [rng.normal(0, 0.3, (pos.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0])
    xp, xu = (np.clip((x - net.mean) / net.scale, -8, 8) for x in (pos, unl))
    m, v = [0.0] * 4, [0.0] * 4
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        bp, bu = (x[rng.integers(0, len(x), min(2048, len(x)))] for x in (xp, xu))
        w1, b1, w2, b2 = net.weights
        hp, hu = np.tanh(bp @ w1 + b1), np.tanh(bu @ w1 + b1)
        sp, su = sig(hp @ w2 + b2), sig(hu @ w2 + b2)
        up = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-9)))
        if prior is None:
            gp, gu = 0.5 * (sp - 1) / len(sp), 0.5 * su / len(su)
        else:
            negative = up - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-9)))
            if negative >= 0:
                gp, gu = prior * ((sp - 1) - sp) / len(sp), su / len(su)
            else:  # the estimate of a risk fell below zero: step back along that part alone
                gp, gu = prior * sp / len(sp), -su / len(su)
        grads = [0.0] * 4
        for x, h, g in ((bp, hp, gp), (bu, hu, gu)):
            back = np.outer(g, w2) * (1 - h * h)
            for k, d in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum())):
                grads[k] = grads[k] + d
        for k, g in enumerate(grads):
            g = g + (1e-4 * net.weights[k] if k in (0, 2) else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.weights[k] = net.weights[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled, from 0.05 to 0.95: the least ratio of tail shares on held-back halves, with its sampling error.

    The same at every size: few rows have a large error, which makes the estimate a high one. A single row is its own half.
    """
    net = _train(pos[::2], unl[::2], None, 300, 8, seed)
    zp, zu = (np.sort(net.logit(x[1::2] if len(x) > 1 else x)) for x in (pos, unl))
    cuts = zp[: max(1, int(len(zp) * 0.7))]
    qp = 1 - np.searchsorted(zp, cuts) / len(zp)
    qu = 1 - np.searchsorted(zu, cuts) / len(zu)
    slack = np.sqrt(np.log(20) / (2 * len(zu))) + np.sqrt(np.log(20) / (2 * len(zp)))
    best = int(np.argmin((qu + slack) / qp))
    error = np.sqrt(qu[best] * (1 - qu[best]) / len(zu))  # the least of many ratios is still too high: take off its error
    return float(np.clip(qu[best] / qp[best] - error, 0.05, 0.95))


def fit(pos: np.ndarray, unl: np.ndarray, steps: int = 1200, hidden: int = 12, seed: int = 7) -> Network | None:
    """None where either sample is empty: nothing can be learnt then."""
    if not len(pos) or not len(unl):
        return None
    return _train(pos, unl, estimate_prior(pos, unl, seed), steps, hidden, seed)


def classify_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 20_000, unlabelled: int = 20_000, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text; adds ``held_out``, ``score`` and ``predicted``.

    Fits on at most ``sample`` trusted positives and ``unlabelled`` rows without a label, the first by a hash of the
    key, from rows that are not held out (``crc32(key as text) % 5 <> 0``; a null key is not held out). These two
    numbers bound what the driver fits on, the estimate of the prior included, at every size of the tables. A key
    whose labels disagree, or are null or negative, is neither trusted nor unlabelled. Null and empty texts get
    the score of all-zero statistics. Without positives or unlabelled rows every score is 0.5. Repeated rows
    each give a row; input columns named like an output are dropped. Every other step covers all rows.

    The sample is chosen from keys and labels alone: their count gives the hash below which it lies, so no task sorts
    more than twice the sample. Its texts come by a join with at most ``sample + unlabelled`` keys. Scoring is one narrow pass
    over the texts without a shuffle.
    """
    new = ["held_out", "score", "predicted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    held = F.coalesce(F.crc32(docs[key].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    marks = labels.select(labels[key].alias("__key"), labels[label].alias("q")).where("__key is not null").groupBy("__key").agg(F.min(F.coalesce("q", F.lit(0))).alias("q"))
    keys = docs.where(~held & docs[key].isNotNull()).select(docs[key].alias("__key")).distinct()
    tagged = keys.join(marks, "__key", "left").select("__key", F.when(F.col("q").isNull(), 0).when(F.col("q") == 1, 1).alias("y"), F.xxhash64("__key", F.lit("fit")).alias("h"))
    tagged = materialize(tagged.where("y is not null"))
    many = {r.y: r["count"] for r in tagged.groupBy("y").count().collect()}

    def first(y: int, most: int) -> DataFrame:
        below = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * most // max(many.get(y, 0), 1))
        return tagged.where((F.col("y") == y) & (F.col("h") <= below)).orderBy("h", "__key").limit(most).select("__key", "y")

    chosen = first(1, sample).union(first(0, unlabelled))
    texts = docs.select(docs[key].alias("__key"), docs[text].alias("__text")).join(F.broadcast(chosen), "__key").select("y", "__key", "__text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("quality")
        for batch in batches:
            x = [text_features(v.as_py()).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["y", "__key", "x"])

    seen = texts.mapInArrow(measure, f"y int, __key {dict(texts.dtypes)['__key']}, x binary").groupBy("y", "__key").agg(F.min("x").alias("x")).orderBy("y", "__key").select("y", "x").collect()
    pos, unl = (np.frombuffer(b"".join(bytes(r.x) for r in seen if r.y == y), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64) for y in (1, 0))
    model = fit(pos, unl)
    source = docs.select(*kept, held.alias("held_out"), docs[text].alias("__text"))
    fields = source.schema.fields[:-1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("quality")
        for batch in batches:
            x = np.array([text_features(v.as_py()) for v in batch.column(batch.num_columns - 1)], dtype=np.float64).reshape(-1, N_FEATURES)
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], [*(f.name for f in fields), "score"])

    scored = source.mapInArrow(judge, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; see ``classify_quality`` for nulls, empty and repeated texts and empty tables."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
