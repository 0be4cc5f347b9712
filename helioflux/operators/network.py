"""A small network of rectified units with a penalty, fitted by gradient sums of the partitions.

Rows are packed into blocks once, as a table. A step sends the weights out, every partition adds up the gradient of its
blocks, and Spark adds the partitions' sums by weight, so the driver holds vectors of the weights' length alone. Steps
are those of limited-memory BFGS with backtracking; they end when the held-out rows' loss hasn't improved for some
steps, and the weights that were best there are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Rows of a block; pairs of steps that the curvature is taken from; halvings of a step before the descent ends
BLOCK, PAIRS, HALVINGS = 4096, 8, 12


def shapes(layers: list[int]) -> list[tuple[int, ...]]:
    """Weights and offsets in order."""
    return [s for a, b in zip(layers, layers[1:], strict=False) for s in ((a, b), (b,))]


def unpacked(w: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(layers):
        n = int(np.prod(s))
        out.append(w[at : at + n].reshape(s))
        at += n
    return out


def start(layers: list[int], seed: int) -> np.ndarray:
    """Uniform weights and offsets within sqrt(6 / (inputs + outputs)), sqrt(2 / ..) before the last unit."""
    rng, parts = np.random.default_rng(seed), []
    for i, (a, b) in enumerate(zip(layers, layers[1:], strict=False)):
        reach = np.sqrt((6 if i < len(layers) - 2 else 2) / (a + b))
        parts += [rng.uniform(-reach, reach, a * b), rng.uniform(-reach, reach, b)]
    return np.concatenate(parts)


def outputs(x: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Every layer's values, the last one before the logistic."""
    out = [x]
    for i in range(0, len(parts), 2):
        z = out[-1] @ parts[i] + parts[i + 1]
        out.append(np.maximum(z, 0.0) if i + 2 < len(parts) else z)
    return out


def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Weighted sum of the log losses, and its gradient."""
    parts = unpacked(w, layers)
    values = outputs(x, parts)
    z = values[-1][:, 0]
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    back, gradient = (weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None], [None] * len(parts)
    for i in range(len(parts) - 2, -1, -2):
        gradient[i], gradient[i + 1] = values[i // 2].T @ back, back.sum(0)
        back = (back @ parts[i].T) * (values[i // 2] > 0)
    return loss, np.concatenate([g.ravel() for g in gradient])


def packed(rows: DataFrame, held: float, seed: int) -> DataFrame:
    """(n, x, y, weight, out): blocks of up to BLOCK rows as bytes of doubles; out tells the held-out rows, drawn by a hash of the row."""
    out = F.pmod(F.xxhash64(vector_to_array("x"), "y", F.lit(seed)), F.lit(1_000_000)) < int(held * 1_000_000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BLOCK):
                part = frame[i : i + BLOCK]
                x = np.stack(part["x"].to_numpy())
                yield pd.DataFrame([{"n": len(part), "x": x.tobytes(), **{c: part[c].to_numpy(float).tobytes() for c in ("y", "weight", "out")}}])

    narrow = rows.select(vector_to_array("x").alias("x"), F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), out.cast("double").alias("out"))
    return narrow.mapInPandas(run, "n int, x binary, y binary, weight binary, out binary")


def total(blocks: DataFrame, w: np.ndarray, layers: list[int]) -> np.ndarray:
    """Loss, weight, held-out loss, held-out weight and gradient, added up over all blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(4 + len(w))
        for frame in frames:
            for n, *raw in frame[["n", "x", "y", "weight", "out"]].itertuples(index=False, name=None):
                x, y, weight, out = (np.frombuffer(bytes(b)) for b in raw)
                x = x.reshape(n, -1)
                loss, gradient = sums(x, y, weight * (1 - out), w, layers)
                held = sums(x, y, weight * out, w, layers)[0] if out.any() else 0.0
                own += np.concatenate([[loss, (weight * (1 - out)).sum(), held, (weight * out).sum()], gradient])
        yield pd.DataFrame([{"v": own}])

    added = blocks.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(4 + len(w))
    for r in added.collect():  # one number a weight
        out[r["i"]] = r["v"]
    return out


def direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Descent by the curvature of the last pairs of (step, change of gradient)."""
    q, kept = gradient.copy(), []
    for s, g in reversed(pairs):
        a = s @ q / (s @ g)
        q -= a * g
        kept.append(a)
    if pairs:
        s, g = pairs[-1]
        q *= (s @ g) / (g @ g)
    for (s, g), a in zip(pairs, reversed(kept), strict=True):
        q += s * (a - g @ q / (s @ g))
    return -q


class _Settings(Params):
    layers = Param(Params._dummy(), "layers", "units of each layer, inputs first, one output last", TypeConverters.toListInt)
    penalty = Param(Params._dummy(), "penalty", "weight of half the squared weights over the sum of the rows' weights", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most steps", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "steps without a better held-out loss after which fitting ends", TypeConverters.toInt)
    held = Param(Params._dummy(), "held", "share of rows held out", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the first weights and of the held-out rows", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "fitted weights and offsets", TypeConverters.toListFloat)

    def setParams(self, **params):  # noqa: N802 - as Spark's estimators have it
        return self._set(**params)


class Network(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on x (a vector), y (0 or 1) and weight. Equal rows are held out together or not at all; without any held-out
    rows, all steps run. Raises on a table without rows."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._setDefault(penalty=0.01, maxIter=100, patience=10, held=0.15, seed=42)
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        get = self.getOrDefault
        layers = list(get(self.layers))
        blocks = written(packed(dataset, get(self.held), get(self.seed)), "blocks")
        flat = np.concatenate([np.full(int(np.prod(s)), len(s) == 2) for s in shapes(layers)])

        def at(w: np.ndarray) -> tuple[float, float, np.ndarray]:
            loss, n, out, n_out, *gradient = total(blocks, w, layers)
            if n + n_out <= 0:
                raise ValueError("no rows to fit on")
            n = n or 1.0
            value = (loss + get(self.penalty) / 2 * float((w[flat] ** 2).sum())) / n
            return value, out / n_out if n_out > 0 else value, (np.array(gradient) + get(self.penalty) * np.where(flat, w, 0.0)) / n

        w = start(layers, get(self.seed))
        value, out, gradient = at(w)
        best, best_out, since, pairs = w, out, 0, []
        for _ in range(get(self.maxIter)):
            d = direction(gradient, pairs)
            if not d @ gradient < 0:
                d, pairs = -gradient, []
            step = 1.0 if pairs else min(1.0, 1 / (np.linalg.norm(gradient) + 1e-12))
            for _half in range(HALVINGS):
                new = w + step * d
                new_value, new_out, new_gradient = at(new)
                if new_value <= value + 1e-4 * step * (d @ gradient):
                    break
                step /= 2
            else:
                break
            s, g = new - w, new_gradient - gradient
            if s @ g > 1e-10 * np.linalg.norm(s) * np.linalg.norm(g):
                pairs = [*pairs, (s, g)][-PAIRS:]
            done = value - new_value < 1e-9 * max(abs(value), 1.0)
            w, value, gradient = new, new_value, new_gradient
            since = 0 if new_out < best_out - 1e-4 else since + 1
            if new_out < best_out:
                best, best_out = w, new_out
            if done or since >= get(self.patience):
                break
        return NetworkModel()._set(layers=layers, weights=[float(v) for v in best])


class NetworkModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Adds probability, a vector of the chances of 0 and 1."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers, w = list(self.getOrDefault(self.layers)), np.array(self.getOrDefault(self.weights))

        @F.pandas_udf("double")
        def chance(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            z = outputs(np.stack(x.to_numpy()), unpacked(w, layers))[-1][:, 0]
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        p = dataset.withColumn("_p", chance(vector_to_array("x")))
        return p.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), "_p"))).drop("_p")
