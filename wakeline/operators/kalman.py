"""A two-dimensional local-level model of each track: expectation-maximisation of its covariances, then smoothing.

State and observation are (lon, lat), both matrices the identity; the transition A can be estimated, too. The noise
covariances Q and R start at 0.1 I; the first state is the first observation, known exactly. A track's sample is one row, and the recursions run over all
tracks of an Arrow batch side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.tracks import stride

#: Positions, filling included, that the recursions run over at a time.
BLOCK = 200_000


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of (..., 2, 2) matrices, pseudo-inverses where they are singular."""
    a, b, c, d = m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1]
    det = a * d - b * c
    singular = np.abs(det) <= 1e-15 * (m * m).sum((-2, -1))
    out = np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2) / np.where(singular, 1, det)[..., None, None]
    if singular.any():
        out[singular] = np.linalg.pinv(m[singular])
    return out


def _smooth(y: np.ndarray, n: np.ndarray, q: np.ndarray, r: np.ndarray, x0: np.ndarray, p0: np.ndarray, a: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed means, covariances, and the covariance of each state with the one before, for y (steps, tracks, 2) of
    which each track has n; what is beyond is filling. The transition is ``a`` (tracks, 2, 2), by default the identity."""
    steps, tracks = y.shape[:2]
    mean, cov, ahead = np.empty((steps, tracks, 2)), np.empty((steps, tracks, 2, 2)), np.empty((steps, tracks, 2, 2))
    for t in range(steps):
        if t == 0:
            x, p = x0, p0
        elif a is None:
            x, p = mean[t - 1], cov[t - 1] + q
        else:
            x, p = (a @ mean[t - 1][..., None])[..., 0], a @ cov[t - 1] @ a.swapaxes(-1, -2) + q
        ahead[t] = p
        gain = p @ _inverse(p + r)
        mean[t] = x + (gain @ (y[t] - x)[..., None])[..., 0]
        cov[t] = p - gain @ p
    lag = np.zeros((steps, tracks, 2, 2))
    for t in range(steps - 2, -1, -1):
        on = np.flatnonzero(t < n - 1)
        j = (cov[t, on] if a is None else cov[t, on] @ a[on].swapaxes(-1, -2)) @ _inverse(ahead[t + 1, on])
        turned = j.swapaxes(-1, -2)
        told = mean[t, on] if a is None else (a[on] @ mean[t, on][..., None])[..., 0]
        mean[t, on] += (j @ (mean[t + 1, on] - told)[..., None])[..., 0]
        cov[t, on] += j @ (cov[t + 1, on] - ahead[t + 1, on]) @ turned
        lag[t + 1, on] = cov[t + 1, on] @ turned
    return mean, cov, lag


def estimate(samples: list[np.ndarray], rounds: int = 100, estimate_a: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Q, R (tracks, 2, 2), the smoothed states and A after ``rounds`` rounds of expectation-maximisation, for samples (n, 2)
    of two positions at least. A is the identity unless it is estimated."""
    n = np.array([len(s) for s in samples])
    y = np.zeros((n.max(), len(n), 2))
    for k, s in enumerate(samples):
        y[: len(s), k] = s
        y[len(s) :, k] = s[-1]
    own = (np.arange(n.max())[:, None] < n)[..., None]
    q = r = np.broadcast_to(np.eye(2) * 0.1, (len(n), 2, 2))
    x0, p0, a = y[0], np.zeros((len(n), 2, 2)), None
    for _ in range(rounds):
        mean, cov, lag = _smooth(y, n, q, r, x0, p0, a)
        miss, cov = (y - mean) * own, cov * own[..., None]
        lag, before = lag.sum(0), (cov[:-1] * own[1:, ..., None]).sum(0)
        if estimate_a:
            last = mean[:-1] * own[1:]
            a = (lag + np.einsum("tki,tkj->kij", mean[1:], last)) @ _inverse(before + np.einsum("tki,tkj->kij", last, last))
            step = (mean[1:] - (a @ mean[:-1, ..., None])[..., 0]) * own[1:]
            lag, before = lag @ a.swapaxes(-1, -2), a @ before @ a.swapaxes(-1, -2)
        else:
            step = np.diff(mean, axis=0) * own[1:]
        q = (np.einsum("tki,tkj->kij", step, step) + cov[1:].sum(0) + before - lag - lag.swapaxes(-1, -2)) / (n - 1)[:, None, None]
        r = (np.einsum("tki,tkj->kij", miss, miss) + cov.sum(0)) / n[:, None, None]
        x0, p0 = mean[0], cov[0]
    mean = _smooth(y, n, q, r, x0, p0, a)[0]
    return q, r, [mean[: len(s), k] for k, s in enumerate(samples)], np.broadcast_to(np.eye(2), q.shape) if a is None else a


def kalman_em(tracks: DataFrame, step: int = 100, rounds: int = 100, estimate_a: bool = False) -> DataFrame:
    """One row for each track and direction (forward, reverse): Q, R and the smoothed sample of every step-th row, and A where
    it is to be estimated.

    status is ok, or too_short for a sample of one, whose Q is not defined.
    """
    id_type = dict(tracks.dtypes)["track_id"]
    sampled = stride(tracks, step).withColumn("direction", F.lit("forward")).unionByName(stride(tracks, step, backwards=True).withColumn("direction", F.lit("reverse")))
    one = F.array_sort(F.collect_list(F.struct("pos", "lon", "lat")))
    rows = sampled.groupBy("track_id", "direction").agg(one.alias("y")).select("track_id", "direction", F.transform("y", lambda p: p["lon"]).alias("lon"), F.transform("y", lambda p: p["lat"]).alias("lat"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples = [np.stack([np.asarray(x.values), np.asarray(y.values)], 1) for x, y in zip(b.column(2), b.column(3), strict=True)]
            n = np.array([len(s) for s in samples])
            out: list[tuple] = [("too_short", None, None, None, None, None)] * len(b)
            order = [k for k in np.argsort(n, kind="stable") if n[k] > 1]
            while order:  # the longest first, as many together as a block holds
                some = order[-max(1, BLOCK // n[order[-1]]) :]
                del order[-len(some) :]
                q, r, means, a = estimate([samples[k] for k in some], rounds, estimate_a)
                for i, k in enumerate(some):
                    out[k] = ("ok", q[i].tolist(), r[i].tolist(), means[i][:, 0].tolist(), means[i][:, 1].tolist(), a[i].tolist())
            matrix, line = pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64())
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), matrix, matrix, line, line, *[matrix] * estimate_a))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *columns], ["track_id", "direction", "n", "status", "q", "r", "lon", "lat", *["a"] * estimate_a])

    return rows.mapInArrow(
        fitted, f"track_id {id_type}, direction string, n long, status string, q array<array<double>>, r array<array<double>>, lon array<double>, lat array<double>" + ", a array<array<double>>" * estimate_a
    )
