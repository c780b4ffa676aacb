"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles

CLASSES = tuple(np.isin(np.arange(256), np.frombuffer(s.encode("latin-1"), np.uint8)) for s in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "#*$%&<>", "|", ".,", ";:?'\"()-", "{}=[]_\\/@~^`+", "\n", " \t\r\x0b\x0c", "".join(map(chr, range(128, 256))),
))
#: Buckets of hashed words, and as many of hashed runs of three bytes.
BUCKETS = 32
N_SURFACE = len(CLASSES) + 13
N_FEATURES = N_SURFACE + 2 * BUCKETS


def buckets(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(59)).astype(np.int64), minlength=BUCKETS)


def features(texts: pa.Array) -> np.ndarray:
    """A row of surface measures and hashed n-grams for each whole text; a null text is an empty one.

    N-grams are words and runs of three bytes, as square roots of their buckets' shares.
    """
    data, offsets = shingles.raw_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    sizes = np.diff(offsets)
    lines = np.zeros(n)
    for i in range(n):  # in pieces, so that a long text needs no more memory than a short one
        a, b = int(offsets[i]), int(offsets[i + 1])
        counts, threes = np.zeros(256, np.int64), np.zeros(BUCKETS, np.int64)
        for lo in range(a, b, shingles.CHUNK):
            x = data[lo : min(b, lo + shingles.CHUNK + 2)].astype(np.uint64)
            counts += np.bincount(data[lo : min(b, lo + shingles.CHUNK)], minlength=256)
            threes += buckets(shingles.mix(x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)))
        out[i, : len(CLASSES)] = [counts[c].sum() / max(1, b - a) for c in CLASSES]
        out[i, N_SURFACE + BUCKETS :] = np.sqrt(threes / max(1, b - a - 2))
        lines[i] = counts[10] + 1
    words, per = shingles.word_hashes(data, offsets, shingles.AS_IS)
    grams, per_gram = shingles.shingle_hashes(words, per)
    start = start_gram = 0
    for i in range(n):
        w, g = words[start : start + per[i]], grams[start_gram : start_gram + per_gram[i]]
        start, start_gram = start + per[i], start_gram + per_gram[i]
        m = max(1, len(w))
        x = np.sort(w)
        runs = np.diff(np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))) if len(w) else np.zeros(1)
        y = np.sort(g)
        out[i, len(CLASSES) : N_SURFACE] = [
            np.log1p(len(w)), sizes[i] / m, len(runs) / m, len(runs) / m**0.7, runs.max() / m, (w[1:] == w[:-1]).sum() / m, (w[2:] == w[:-2]).sum() / m,
            (np.count_nonzero(y[1:] != y[:-1]) + 1) / max(1, len(y)), m / lines[i], len(w) < 5, len(w) < 20, len(w) < 50, np.log1p(lines[i]),
        ]
        out[i, N_SURFACE : N_SURFACE + BUCKETS] = np.sqrt(buckets(w) / m)
    return out


def standardise(x: np.ndarray, model: dict) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8).astype(np.float64)


def forward(z: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(z @ a + b)
    return (hidden @ c + d)[:, 0], hidden


def margins(x: np.ndarray, model: dict) -> np.ndarray:
    """Mean margin of a model's networks."""
    z = standardise(x, model)
    return sum(forward(z, layers)[0] for layers in model["layers"]) / len(model["layers"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def nnpu_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """``(risk, gp, gu)`` with logistic loss: ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``, and the step's gradient in the margins.

    Where the second term is negative, the step goes up that term's gradient alone, as the
    non-negative estimator has it.
    """
    # the losses log(1 + e^-f) and log(1 + e^f) have gradients -sigmoid(-f) and sigmoid(f)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    risk = prior * np.logaddexp(0, -fp).mean() + max(0.0, negative)
    if negative >= 0:
        return risk, (-prior * sigmoid(-fp) - prior * sigmoid(fp)) / len(fp), sigmoid(fu) / len(fu)
    return risk, prior * sigmoid(fp) / len(fp), -sigmoid(fu) / len(fu)


def apart_risk(fp: np.ndarray, fu: np.ndarray, share: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The same for telling positives from unlabelled rows, which weigh ``share`` and ``1 - share``."""
    risk = share * np.logaddexp(0, -fp).mean() + (1 - share) * np.logaddexp(0, fu).mean()
    return risk, -share * sigmoid(-fp) / len(fp), (1 - share) * sigmoid(fu) / len(fu)


def fit(positive: np.ndarray, unlabelled: np.ndarray, weight: float, loss=nnpu_risk, hidden: int = 24, epochs: int = 40, batch: int = 1024, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> dict:
    """A small network that minimises ``loss``.  Equal inputs give equal models."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    model = {"mean": both.mean(0), "scale": both.std(0) + 1e-6}
    p, u = standardise(positive, model), standardise(unlabelled, model)
    k = p.shape[1]
    layers = [rng.normal(0, 1 / k**0.5, (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / hidden**0.5, (hidden, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    steps = max(1, max(len(p), len(u)) // batch)
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(steps):
            xp, xu = (x[o[np.arange(s * batch, s * batch + min(batch, len(x))) % len(x)]] for x, o in ((p, p_order), (u, u_order)))
            (fp, hp), (fu, hu) = forward(xp, layers), forward(xu, layers)
            _, gp, gu = loss(fp, fu, weight)
            grads = [np.zeros_like(w) for w in layers]
            for x, h, g in ((xp, hp, gp), (xu, hu, gu)):
                back = (g[:, None] @ layers[2].T) * (1 - h * h)
                for i, d in enumerate((x.T @ back, back.sum(0), h.T @ g[:, None], g.sum(keepdims=True))):
                    grads[i] += d
            t += 1
            step = rate * (1 - epoch / epochs)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                layers[i] = layers[i] * (1 - step * decay * (i % 2 == 0)) - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model | {"layers": [layers]}


def top_bin_share(fp: np.ndarray, fu: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from margins of both that the model hasn't seen.

    Above a margin with no negatives, unlabelled rows are as frequent as positives times that share;
    the margin is the one whose ratio has the least upper confidence bound (best-bin estimation).
    """
    cuts = np.unique(fp)
    qp = 1 - np.searchsorted(np.sort(fp), cuts) / len(fp)
    qu = 1 - np.searchsorted(np.sort(fu), cuts) / len(fu)
    slack = (1 + gamma) * sum((np.log(4 / delta) / (2 * n)) ** 0.5 for n in (len(fp), len(fu)))
    best = int(np.argmin((qu + slack) / qp))
    return float(min(1.0, qu[best] / qp[best]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 3) -> float:
    """The class prior of the unlabelled rows, from positives and unlabelled rows only.

    Each half is judged by a model of the other: at first one that tells positives from
    unlabelled rows, then one that minimises the risk with the prior found before.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    prior = None
    for _ in range(rounds):
        found = []
        for half in (0, 1):
            p, u = positive[1 - half :: 2], unlabelled[1 - half :: 2]
            model = fit(p, u, len(p) / (len(p) + len(u)), apart_risk, epochs=20) if prior is None else fit(p, u, prior, epochs=30)
            found.append(top_bin_share(margins(positive[half::2], model), margins(unlabelled[half::2], model)))
        prior = min(0.98, max(0.02, sum(found) / 2))
    return prior


def fit_several(positive: np.ndarray, unlabelled: np.ndarray, prior: float, networks: int = 5) -> dict:
    """A model of several networks from different starts, whose margins are averaged."""
    each = [fit(positive, unlabelled, prior, seed=7 + i) for i in range(networks)]
    return each[0] | {"layers": [m["layers"][0] for m in each], "prior": prior}


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    if not model:
        return np.full(len(texts), 0.5)
    return sigmoid(margins(features(texts), model))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id has no text and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def _featured(df: DataFrame) -> np.ndarray:
    """A row of features for each row ``(t)``."""

    def run(batches):
        shingles.let_go()
        for whole in batches:
            for b in shingles.pieces(whole, 0):
                yield pa.RecordBatch.from_arrays([shingles.lists(features(b.column(0)))], ["x"])

    got = df.select("t").mapInArrow(run, "x array<float>").toArrow().column("x")
    x = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in got.chunks)]).reshape(-1, N_FEATURES)
    # the order in which tasks end must not matter
    return x[np.lexsort(x.T)]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_unlabelled: int = 12_000, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> dict:
    """A model from documents outside the held-out fold: trusted positives against unlabelled text.

    Positives are rows labelled 1; rows labelled 0 are never read as negatives.  At most
    ``max_labelled`` labelled rows and ``max_unlabelled`` documents are used, those with the
    lowest hashes of their ids; a document with several labels counts by its lowest.  The class
    prior, unless given, is estimated from the positives and the unlabelled rows.  The score is
    the logistic of the margin and is fitted to no labels besides.  Without positives the
    result is an empty model, which scores 0.5.
    """
    mark = F.xxhash64(F.lit(3), "k")
    own = labels.select(labels[id_col].cast("long").alias("k"), labels[quality_col].cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull())
    own = own.where(fold(F.col("k")) != 0).groupBy("k").agg(F.min("y").alias("y")).orderBy(mark, "k").limit(max_labelled)
    src = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t")).where(fold(F.col("k")) != 0)
    # both sides of these joins hold at most max_labelled and max_unlabelled rows of two numbers
    p = _featured(src.join(F.broadcast(own.where("y = 1")), "k"))
    some = src.select("k").distinct().orderBy(F.xxhash64(F.lit(5), "k"), "k").limit(max_unlabelled)
    u = _featured(src.join(F.broadcast(some), "k"))
    if not len(u) or not len(p):
        return {}
    share = estimate_prior(p, u) if prior is None else prior
    return fit_several(p, u, share)


def score_quality(docs: DataFrame, model: dict, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; a null text is scored as an empty one.

    Repeated rows stay, null ids count as held out, other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        shingles.let_go()
        for whole in batches:
            for b in shingles.pieces(whole, 2):
                s = score_texts(b.column(2), shipped.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["k", "held_out", "score", "predicted"])

    src = docs.select(docs[id_col].cast("long").alias("k"), (fold(docs[id_col].cast("long")) == 0).alias("held_out"), docs[text_col].alias("t"))
    return src.mapInArrow(run, "k long, held_out boolean, score double, predicted int").withColumnRenamed("k", id_col)


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        shingles.let_go()
        for whole in batches:
            for b in shingles.pieces(whole, at):
                yield b.filter(pa.array(score_texts(b.column(at), shipped.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
