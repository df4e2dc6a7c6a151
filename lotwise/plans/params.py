"""Hyperparameters of a run and the grid of runs."""

import hashlib
import math
from dataclasses import dataclass, fields

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators.split import lot_size_of


PUBLIC_SEED = "1"


@dataclass(frozen=True)
class RunParams:
    """One run.  Values never change during training.

    ``clip`` 0 switches clipping off and -1 means no bound.  ``sigma_p`` and ``gamma`` default per
    solver: lot size and 1 for the parallel dual, K and 1 for CoCoA, 1 as the SGD step size.  A
    ``gamma`` of -1 asks the parallel ridge dual and the primal coordinates for a line search.
    ``eps`` > 0 asks for the noise that meets it.  ``sample_ratio`` is the share of rows that a sweep of
    primal coordinates looks at; other solvers do not use it.
    """

    run_id: int = 0
    lambda_: float = 1.0
    sigma: float = 0.0
    eps: float = 0.0
    clip: float = 0.0
    sample_ratio: float = 1.0
    lot_ratio: float = 1.0
    max_iter: int = 10
    out_iter: int = 1
    k: int = 1
    gamma: float | None = None
    sigma_p: float | None = None
    seed: str = PUBLIC_SEED

    @property
    def private(self):
        return self.sigma > 0 or self.eps > 0

    @property
    def searches(self):
        """Whether step sizes are found by line search."""
        return self.gamma == -1

    @property
    def bounded_clip(self):
        """Clipping bound as a number: no clipping is an infinite bound."""
        return math.inf if self.clip in (0, -1) else float(self.clip)

    def lot_size(self, n):
        size = lot_size_of(self.lot_ratio, n, self.max_iter)
        if size > n:
            raise ValueError(f"a lot of {size} rows is larger than the table ({n} rows)")
        return size

    def check(self):
        if self.lambda_ <= 0:
            raise ValueError("lambda must be positive")
        if self.private and (self.clip <= 0 or math.isinf(self.clip)):
            raise ValueError("a private run needs a positive, finite clipping bound")
        if self.private and str(self.seed) == PUBLIC_SEED:
            raise ValueError("a private run needs a secret seed, not the default one")
        return self

    def noise_key(self, solver, task):
        """Names this run's noise.  Runs that differ in anything draw different noise, and a run
        draws the same alone and in a grid."""
        values = [f"{f.name}={getattr(self, f.name)!r}" for f in fields(self)]
        return hashlib.md5("|".join([solver, task, *values]).encode()).hexdigest()


# Names, defaults and types of the grid's parameters, in grid order.
GRID_PARAMETERS = [
    ("lambda", 1.0, "double"),
    ("sigma", 0.0, "double"),
    ("eps", 0.0, "double"),
    ("C", 0.0, "double"),
    ("sample_ratio", 1.0, "double"),
    ("lot_ratio", 1.0, "double"),
    ("max_iter", 10, "int"),
    ("out_iter", 1, "int"),
    ("K", 1, "int"),
    ("gamma", 1.0, "double"),
    ("seed", PUBLIC_SEED, "string"),
]


def param_grid(spark, **lists):
    """Every combination of the given value lists as a ``runs`` frame with a ``run_id``.

    The product is a chain of explodes over literal lists; the last parameter varies fastest.
    """
    unknown = set(lists) - {name for name, _, _ in GRID_PARAMETERS}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    runs = spark.range(1).select(F.lit(0).cast("bigint").alias("run_id"))
    for name, default, kind in GRID_PARAMETERS:
        values = list(lists.get(name, [default]))
        literal = F.array(*[F.lit(v).cast(kind) for v in values])
        runs = runs.select("*", F.posexplode(literal).alias("_p", name))
        runs = runs.withColumn("run_id", F.col("run_id") * len(values) + F.col("_p")).drop("_p")
    return runs


def runs_of(frame):
    """``RunParams`` of a ``runs`` frame: hyperparameters, one small row per run."""
    out = []
    for row in frame.orderBy("run_id").toLocalIterator():
        r = row.asDict()
        out.append(RunParams(
            run_id=r["run_id"], lambda_=r["lambda"], sigma=r["sigma"], eps=r["eps"], clip=r["C"],
            sample_ratio=r["sample_ratio"], lot_ratio=r["lot_ratio"], max_iter=r["max_iter"],
            out_iter=r["out_iter"], k=r["K"], gamma=r["gamma"], seed=str(r["seed"]),
        ))
    return out


PARAM_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("eps", T.DoubleType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("q", T.DoubleType()),
    T.StructField("iters", T.LongType()),
])

