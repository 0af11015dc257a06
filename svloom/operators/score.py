"""Scoring of windows with a model that the caller brings.

A scorer is a function that makes, once for each task, a function from an array (rows, features) to
probabilities. linear_scorer is a stand-in for a trained model and is named so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[], Callable[[np.ndarray], np.ndarray]]


def linear_scorer(weights: list[float], bias: float) -> Scorer:
    """A logistic regression with given weights."""

    def load():
        w = np.asarray(weights, np.float64)
        return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias)))

    return load


def score_windows(windows: DataFrame, scorer: Scorer, features: str = "features", batch: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """windows without the features, with prob; the model is loaded once for each task and fed in batches.

    profile: the resources of the tasks that score (a GPU each, say); the stages before and after keep the session's own.
    """
    kept = [c for c in windows.columns if c != features]

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = scorer()
        for part in parts:
            out = part[kept].copy()
            rows = [np.asarray(x, np.float64) for x in part[features]]
            found = [predict(np.stack(rows[k : k + batch])) for k in range(0, len(rows), batch)]
            out["prob"] = np.concatenate(found) if found else np.zeros(0)
            if ((out["prob"] < 0) | (out["prob"] > 1)).any():
                raise ValueError("a scorer gives probabilities")
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema if f.name != features)
    return windows.mapInPandas(score, f"{schema}, prob double", profile=profile)


# ---------------------------------------------------------------- loss, fit, threshold
def bce_loss(prob: Column, target: Column, pos_weight: float | None = None) -> Column:
    """The mean weighted cross entropy, an aggregate: a probability that is no number is 0.5, all are kept off 0 and 1."""
    p = F.least(F.greatest(F.nanvl(prob.cast("double"), F.lit(0.5)), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    t = target.cast("double")
    loss = -(t * F.log(p) + (1 - t) * F.log(1 - p))
    return F.avg(loss * F.when(t == 1, float(pos_weight)).otherwise(1.0) if pos_weight else loss)


def fit_linear(windows: DataFrame, features: str = "features", label: str = "label", rounds: int = 40, pos_weight: float = 1.0, rate: float = 1.0) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression over windows, by rounds of gradients that tasks sum.

    Features are brought to mean 0 and deviation 1 within. A round sends one number a feature and task to a sum, and one a feature
    to the driver; windows is read once a round, so it should be a written table. No rows give weights of 0.
    """
    size = windows.agg(F.max(F.size(features))).first()[0] or 0
    kept = windows.select(features, F.col(label).cast("double").alias("label"))

    def summed(make: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
        def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(n)
            for part in parts:
                if len(part):
                    total += make(np.stack([np.asarray(x, np.float64) for x in part[features]]), part["label"].to_numpy())
            yield pd.DataFrame({"k": np.arange(n), "x": total})

        out = np.zeros(n)
        for row in kept.mapInPandas(task, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[row.k] = row.x
        return out

    moments = summed(lambda x, t: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * size + 1)
    rows = max(moments[0], 1.0)
    mean = moments[1 : size + 1] / rows
    scale = np.sqrt(np.maximum(moments[size + 1 :] / rows - mean * mean, 0.0))
    scale[scale == 0] = 1.0
    w = np.zeros(size + 1)

    def gradient(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        each = np.where(t == 1, pos_weight, 1.0)
        return np.concatenate([(each * (p - t)) @ x, (each * p * (1 - p)) @ (x * x)])

    for _ in range(rounds):
        g = summed(gradient, 2 * size + 2)
        w = w - rate * g[: size + 1] / (g[size + 1 :] + 1e-3 * rows + 1e-12) / (1 + 0.1 * size)
    own = w[:size] / scale
    return own.tolist(), float(w[size] - own @ mean)


def threshold_curve(scored: DataFrame, prob: str = "prob", label: str = "label", start: float = 0.05, step: float = 0.01, count: int = 92) -> DataFrame:
    """nth, threshold, tp, fp, fn, f1 for count thresholds: rows at or above one are positive.

    One histogram by the largest threshold that a row reaches, and running sums over its at most count + 1 rows.
    """
    p, at = F.col(prob), lambda k: F.lit(start) + F.lit(step) * k
    guess = F.floor((p - start) / step)
    reached = F.when(p >= at(guess + 1), guess + 1).when(p < at(guess), guess - 1).otherwise(guess)
    bins = scored.groupBy(F.least(F.greatest(reached, F.lit(-1)), F.lit(count - 1)).alias("nth")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    grid = scored.sparkSession.range(-1, count).select(F.col("id").alias("nth")).join(bins, "nth", "left").select("nth", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    down, every = Window.orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = grid.select("nth", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("all")).filter("nth >= 0")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("all") - F.col("tp")), F.lit(0.0))
    return sums.select("nth", at(F.col("nth")).alias("threshold"), "tp", "fp", (F.col("all") - F.col("tp")).alias("fn"), f1.alias("f1"))


def best_threshold(curve: DataFrame) -> float:
    """The threshold with the largest F1, the smallest one on ties."""
    return curve.orderBy(F.desc("f1"), "nth").first()["threshold"]
