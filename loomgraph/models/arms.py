"""A grid of small maps trained on one sample of nodes, the best of them by stress that none was trained on.

Every configuration is a row of a table and trained by a task of its own, on a sample that is bounded by a parameter and broadcast; all nodes are placed by
the map that was chosen."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.models.kernel import optimised, stress_gradient
from loomgraph.operators.ranking import selected

#: Fixed: the grid, as the surveyed experiments have it.
RUNGS, RATES, WIDTHS = (10, 50, 100, 200, 400, 800, 1200, 1800, 2400), (0.005, 0.05, 0.5), (1e-3, 1e-2, 1e-1, 1.0)
#: Nodes of the sample at most, others that only judge, share of the pivots that teach, and pivots of one step.
SAMPLE, JUDGES, TEACHING, STEP = 500, 1000, 0.8, 32
ARMS = ("linear", "kernel", "table")


@dataclass
class Sample:
    """Features and hops to all pivots of nodes that teach (first n) and judge, and rows of pivots among the columns that teach and judge.

    Pivots stand behind the nodes, so that they have places too."""

    x: np.ndarray
    hops: np.ndarray
    n_teach: int
    pivots: np.ndarray
    teach: np.ndarray
    judge: np.ndarray


@dataclass
class Arm:
    """A map from features to places: linear, or a sum of bells about anchors. A table has places of its sample only."""

    kind: str
    width: float = 1.0
    weights: list[np.ndarray] = field(default_factory=list)
    anchors: np.ndarray | None = None

    def basis(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "linear":
            return np.concatenate([x, np.ones((len(x), 1))], 1)
        if self.kind == "kernel":
            far = (x * x).sum(1)[:, None] + (self.anchors * self.anchors).sum(1)[None] - 2 * x @ self.anchors.T
            return np.exp(-self.width * np.maximum(far, 0) / x.shape[1])
        return np.eye(len(x))

    def places(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights[0]


def _targets(s: Sample, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(s.hops[np.ix_(rows, columns)] > 0)
    return s.pivots[columns[j]], rows[i], s.hops[rows[i], columns[j]]


def trained_arm(s: Sample, kind: str, steps: int, rate: float, width: float = 1.0, seed: int = 0) -> tuple[Arm, float]:
    """A map taught the hops of the sample to the teaching pivots, and its stress for the judging nodes and the judging pivots."""
    if kind not in ARMS:
        raise ValueError(f"no arm {kind}")
    rng, teachers = np.random.default_rng(seed), np.arange(s.n_teach)
    arm = Arm(kind, width, anchors=s.x[teachers] if kind == "kernel" else None)
    basis = arm.basis(s.x)
    w = rng.normal(size=(basis.shape[1], 2)) * (0.1 if kind == "table" else 1.0)
    w /= 1.0 if kind == "table" else (basis[teachers] @ w).std() + 1e-9  # a layout that isn't a point
    p, m, v = [w], [np.zeros_like(w)], [np.zeros_like(w)]
    for step in range(1, steps + 1):
        columns = rng.choice(s.teach, min(STEP, len(s.teach)), replace=False)
        a, b, d = _targets(s, teachers, columns)
        if not len(d):
            break
        _, grad = stress_gradient(basis @ p[0], a, b, d)
        optimised(p, [basis.T @ grad], m, v, step, rate * (0.05 + 0.475 * (1 + np.cos(np.pi * step / steps))), False, range(0))
    arm.weights = p
    judges = np.arange(s.n_teach, len(s.x) - len(s.pivots)) if kind != "table" else teachers
    a, b, d = _targets(s, judges, s.judge)
    return arm, float(stress_gradient(basis @ p[0], a, b, d)[0]) if len(d) else float("nan")


def grid(steps=RUNGS, rates=RATES, widths=WIDTHS) -> list[tuple]:
    """(config, arm, steps, rate, width) of all configurations; widths belong to the kernel alone."""
    rows = [(a, n, r, 1.0) for a, n, r in product(("linear", "table"), steps, rates)] + [("kernel", n, r, w) for n, r, w in product(steps, rates, widths)]
    return [(i, *r) for i, r in enumerate(rows)]


def sample_of(features: DataFrame, columns: DataFrame, ordinals: DataFrame, most: int = SAMPLE, seed: int = 0) -> Sample:
    """At most `most` nodes that teach (half of the nodes, if they are fewer) and JUDGES others, by hash, with the pivots (source, ordinal) behind them."""
    rows = features.join(columns, "node")
    n = rows.count()
    taken = min(most, n // 2)
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(taken + JUDGES).collect()
    marks = rows.join(F.broadcast(ordinals), F.col("node") == F.col("source")).orderBy("ordinal").collect()
    every = drawn + marks
    hops = np.array([[np.nan if h is None else h for h in r.hops] for r in every], np.float64)
    order = np.random.default_rng(seed).permutation(len(marks))
    cut = max(1, round(TEACHING * len(marks)))
    return Sample(np.array([r.features for r in every], np.float64), hops, taken, np.arange(len(drawn), len(every)), np.sort(order[:cut]), np.sort(order[cut:]))


def trained_grid(sample: Sample, spark, configs: list[tuple], seed: int = 0) -> DataFrame:
    """config, arm, steps, rate, width, loss: every configuration trained, each in a group of its own."""
    shared = spark.sparkContext.broadcast(sample)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.iloc[0]
        _, loss = trained_arm(shared.value, c["arm"], int(c["steps"]), float(c["rate"]), float(c["width"]), seed)
        return rows.assign(loss=loss)

    schema = "config int, arm string, steps int, rate double, width double"
    table = spark.createDataFrame(configs, schema)
    return table.repartition(max(1, len(configs)), "config").groupBy("config").applyInPandas(run, schema + ", loss double")


def chosen_arms(results: DataFrame) -> DataFrame:
    """The configuration of least loss of each arm, the first of equals; arms whose losses are all unknown have none."""
    best = selected(results.where(~F.isnan("loss")).select("arm", "loss", "config"), "loss", "arm")
    return best.join(results.drop("loss", "arm"), "config")


def placed_by_arm(features: DataFrame, arm: Arm) -> DataFrame:
    """node, x, y of all nodes, also of those that no sample held."""
    if arm.kind == "table":
        raise ValueError("a table has places of its sample alone")
    shared = features.sparkSession.sparkContext.broadcast(arm)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                at = shared.value.places(x)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(at[:, 0]), pa.array(at[:, 1])], ["node", "x", "y"])

    return features.select("node", F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "node long, x double, y double")
