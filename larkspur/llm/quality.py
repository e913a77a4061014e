"""Quality: positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are labelled texts of quality 1; every other text, labelled or not, is
unlabelled web text. A small network over ``FEATURES`` numbers of the whole text's form is
fitted in three steps: positives against unlabelled; an estimate of the class prior from it
(the least ratio of the two tails, with a margin for small tails); then the non-negative risk
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``.

At most ``TRAIN_DOCS`` positives and as many unlabelled texts, all outside fold 0, are used;
only their features come to the driver.

Defined results. Null texts count as empty; an empty text has zero features and gets their
score. Without positives every score is 0.5. Null ids, repeated rows and extra columns pass;
a null id is not held out.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold, small_batches, steps, table
from larkspur.llm.labelled import labelled_sample, unlabelled_sample

TRAIN_DOCS = 12_000
HIDDEN = 16
EPOCHS = 40
RATE = 0.01
THRESHOLD = 0.3
#: Kinds of bytes: 0 small letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 stop or comma, 6 '!' and '?', 7 bar, 8 sign, 9 the rest.
KINDS = np.full(256, 9, np.int64)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|", b"#$%&*@^~<>=+_\\/{}[]")):
    KINDS[np.frombuffer(_bytes, np.uint8)] = _kind
FEATURES = 10 + 6


def features(texts: list[str]) -> np.ndarray:
    """Shares of the kinds of bytes, and how words repeat; a row per text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    kinds = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(texts)), sizes) * 10 + kinds, minlength=10 * len(texts)).reshape(-1, 10)
    out = np.zeros((len(texts), FEATURES))
    out[:, :10] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    for k, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if n:
            distinct = len(set(words))
            out[k, 10] = sum(map(operator.eq, words, words[1:])) / n
            out[k, 11] = distinct / n
            out[k, 12] = np.log1p(n) / 10
            out[k, 13] = np.log1p(distinct) / max(np.log1p(n), 1e-9)
            out[k, 14] = min(20.0, sizes[k] / n) / 10
            out[k, 15] = sum(map(str.isupper, words)) / n
    return out


def forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(((x - net["mean"]) / net["std"]) @ net["a"] + net["b"])
    return h @ net["c"] + net["d"], h


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x_p: np.ndarray, x_u: np.ndarray, prior: float | None, seed: int) -> dict:
    """By Adam. prior None: positives against unlabelled; else the non-negative risk."""
    rng, both = np.random.default_rng(seed), np.concatenate((x_p, x_u))
    net = {"mean": both.mean(axis=0), "std": both.std(axis=0) + 1e-3, "a": rng.normal(0, 0.3, (both.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    names, step = ("a", "b", "c", "d"), 0
    m, s = {k: np.zeros_like(net[k]) for k in names}, {k: np.zeros_like(net[k]) for k in names}
    parts = max(1, len(x_u) // 512)
    for _ in range(EPOCHS):
        for p, u in zip(np.array_split(rng.permutation(len(x_p)), parts), np.array_split(rng.permutation(len(x_u)), parts), strict=True):
            if not len(p) or not len(u):
                continue
            x = np.concatenate((x_p[p], x_u[u]))
            z, h = forward(net, x)
            g, n_p = sigmoid(z), len(p)
            # Sigmoid losses: l(z, +1) = 1 - g and l(z, -1) = g, with slope g (1 - g).
            slope, d = g * (1 - g), np.zeros(len(x))
            if prior is None:
                d[:n_p], d[n_p:] = (g[:n_p] - 1) / n_p, g[n_p:] / len(u)
            else:
                negative = g[n_p:].mean() - prior * g[:n_p].mean()
                d[n_p:], d[:n_p] = slope[n_p:] / len(u), -prior * slope[:n_p] / n_p
                if negative < 0:  # step back where the negative part's estimate is below zero
                    d = -d
                else:
                    d[:n_p] -= prior * slope[:n_p] / n_p
            back = (d[:, None] * net["c"]) * (1 - h * h)
            grad = {"a": ((x - net["mean"]) / net["std"]).T @ back + 1e-4 * net["a"], "b": back.sum(axis=0), "c": h.T @ d + 1e-4 * net["c"], "d": np.array([d.sum()])}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                net[k] = net[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(z_p: np.ndarray, z_u: np.ndarray) -> float:
    """The least ratio of unlabelled to positive tails over all thresholds, with a margin that small tails widen."""
    cuts = np.unique(np.quantile(z_p, np.linspace(0.02, 0.98, 97)))
    t_p = 1 - np.searchsorted(np.sort(z_p), cuts, "left") / len(z_p)
    t_u = 1 - np.searchsorted(np.sort(z_u), cuts, "left") / len(z_u)
    margin = np.sqrt(np.log(40) / (2 * len(z_u))) + np.sqrt(np.log(40) / (2 * len(z_p)))
    k = np.argmin((t_u + margin) / np.maximum(t_p, 1e-9))
    return float(np.clip(t_u[k] / max(t_p[k], 1e-9), 0.05, 0.98))


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float | None = None, seed: int = 1) -> dict | None:
    """The fitted network with its prior; None without positives or unlabelled texts."""
    if not len(x_p) or not len(x_u):
        return None
    if prior is None:
        # The prior is read off texts that the first network did not see.
        half = _fit(x_p[::2], x_u[::2], None, seed)
        held = (x_p[1::2], x_u[1::2]) if len(x_p) > 1 and len(x_u) > 1 else (x_p, x_u)
        prior = estimate_prior(forward(half, held[0])[0], forward(half, held[1])[0])
    return _fit(x_p, x_u, prior, seed) | {"prior": prior}


def _features_of(found: DataFrame) -> np.ndarray:
    def rows(batches):
        for batch in steps(batches):
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    got = found.select("doc_id", "text").mapInArrow(rows, "doc_id long, x array<double>").toArrow().sort_by("doc_id").column("x").combine_chunks()
    return np.asarray(got.flatten()).reshape(-1, FEATURES) if len(got) else np.zeros((0, FEATURES))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> dict | None:
    small_batches(docs.sparkSession)
    positives = _features_of(labelled_sample(docs, labels.where("quality = 1"), "quality", bound))
    return fit(positives, _features_of(unlabelled_sample(docs, bound)))


def scores(net: dict | None, texts: list[str]) -> np.ndarray:
    if net is None or not texts:
        return np.full(len(texts), 0.5)
    return sigmoid(forward(net, features(texts))[0])


def score(docs: DataFrame, net: dict | None) -> DataFrame:
    """A row per document: doc_id, score."""
    small_batches(docs.sparkSession)

    def rows(batches):
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def keep_good(docs: DataFrame, net: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, in their own columns and places: nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            texts, keep = batch.column(at).fill_null("").to_pylist(), []
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= 4 << 20):
                    held += len(texts[hi])
                    hi += 1
                keep.append(scores(net, texts[lo:hi]) >= threshold)
                lo = hi
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(rows, docs.schema)


QUERY = "op10_quality"


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, net).select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
