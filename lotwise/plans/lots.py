"""Training over lots: the loop shared by the parallel dual and by SGD, for one run or a grid.

A group of runs that share their lots is trained in the same passes.  The rows are laid out once
per segment (an epoch, or part of one) as a table partitioned by lot in the shared folder; a lot
then reads its own partition only.  The same rewrite brings the dual values up to date, so a
segment costs one read and one write of the table plus one read spread over its lots.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from lotwise.functions.keyed import keyed_normal
from lotwise.operators.split import poisson_lots, slice_lots, spanning_lot
from lotwise.operators.update import noise_scale
from lotwise.plans import kernels
from lotwise.sources.scratch import commit, scratch_path

# Numbers (8 bytes each) of models that may travel with a task: 64 MB.
MODEL_CELLS = 1 << 23


@dataclass
class TrainingTable:
    """A training frame with its fixed facts."""

    df: object
    n: int
    width: int

    @property
    def vector_columns(self):
        return ["features"] if "features" in self.df.columns else ["indices", "values"]


def narrow(df):
    """The columns that training reads."""
    columns = ["features"] if "features" in df.columns else ["indices", "values", "width"]
    return df.select("row_id", F.col("y").cast("double").alias("y"), *columns)


def training_table(df):
    """Row count and width, in one pass; the kernels check every row's width."""
    dense = "features" in df.columns
    width = F.max(F.size("features") if dense else F.col("width"))
    n, width = df.agg(F.count(F.lit(1)), width).first()
    if not n:
        raise ValueError("the training table is empty")
    columns = ["features"] if dense else ["indices", "values"]
    return TrainingTable(df.select("row_id", F.col("y").cast("double").alias("y"), *columns), int(n), int(width))


@dataclass
class GroupResult:
    runs: list
    models: np.ndarray  # runs x features: shared vectors (dual) or coefficients (SGD)
    steps: int
    alpha: object = None  # frame (row_id, alpha ARRAY) or None


def add_sums(spark, sums, noise, width, keys, lot, more=0):
    """Sum the tasks' partials per run and feature, add the noise, bring the small result back.

    ``more`` sums without noise may follow the features.

    Noise is its own frame of runs x features rows, so features that no row of the lot has get
    theirs too; it is added before anything leaves the executors.
    """
    if any(s > 0 for s in noise):
        scales = F.array(*[F.lit(float(s)) for s in noise])
        tasks = 1 + len(noise) * width // (1 << 16)
        drawn = spark.range(0, width, 1, tasks).select(
            F.explode(F.sequence(F.lit(0), F.lit(len(noise) - 1))).alias("run"),
            F.col("id").cast("int").alias("idx"),
        )
        key = F.get(F.array(*[F.lit(k) for k in keys]), F.col("run"))
        value = F.get(scales, F.col("run")) * keyed_normal(key, "w", lot, F.col("idx"))
        sums = sums.unionByName(drawn.withColumn("value", value))
    total = sums.groupBy("run", "idx").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((len(noise), width + more))
    out[total["run"].to_numpy(), total["idx"].to_numpy()] = total["value"].to_numpy()
    return out


@dataclass(frozen=True)
class Segment:
    """Consecutive lots between two rewrites; a lot that spans two epochs is a segment of its own."""

    lots: range
    spans: bool = False


@dataclass(frozen=True)
class LotPlan:
    """Which lots there are and who is in them.

    ``exact`` lots are slices of a new random order per epoch; they run on over the epochs, so a lot
    may hold the end of one and the start of the next.  With ``apart`` lots end with their epoch and
    the rows after an epoch's last whole lot sit that epoch out: no row is in a lot twice, which
    private runs need, because a noisy sum bounds one step of a row.  ``poisson`` lots are drawn
    independently.
    """

    n: int
    size: int
    epochs: int
    mode: str
    apart: bool = False

    def __post_init__(self):
        if self.mode not in ("exact", "poisson"):
            raise ValueError(f"unknown lot mode {self.mode!r}")

    @property
    def per_epoch(self):
        return self.n // self.size

    @property
    def total(self):
        return self.epochs * self.per_epoch if self.apart else self.n * self.epochs // self.size

    def segments(self, runs, width):
        """Segments of all lots, models in flight within the bound."""
        most = max(1, min(self.per_epoch, MODEL_CELLS // max(1, runs * width)))
        lot = 0
        while lot < self.total:
            within = self._end(lot)
            if within == lot:
                yield Segment(range(lot, lot + 1), spans=True)
                lot += 1
            else:
                stop = min(lot + most, within, self.total)
                yield Segment(range(lot, stop))
                lot = stop

    def _end(self, lot):
        """First lot after ``lot`` that is not wholly in the same epoch."""
        if self.mode == "poisson":
            return self.total
        if self.apart:
            return (lot // self.per_epoch + 1) * self.per_epoch
        return ((lot * self.size // self.n + 1) * self.n) // self.size

    def ended(self, lot):
        """Epochs that are over after ``lot``."""
        if lot + 1 == self.total:
            return self.epochs
        return (lot + 1) // self.per_epoch if self.apart else (lot + 1) * self.size // self.n

    def assign(self, df, segment, seed):
        """Column ``lots``: the ordered lots of a segment that a row belongs to."""
        if self.mode == "poisson":
            return poisson_lots(df, self.size, self.n, segment.lots, seed)
        if segment.spans:
            return spanning_lot(df, segment.lots.start, self.size, self.n, seed)
        if self.apart:
            epoch = segment.lots.start // self.per_epoch
            before, skip = epoch * self.per_epoch, 0
        else:
            epoch = segment.lots.start * self.size // self.n
            before = -(-epoch * self.n // self.size)
            skip = before * self.size - epoch * self.n
        cut = slice_lots(df, self.size, self.n, seed, epoch, skip=skip)
        own = F.col("lot") + F.lit(before)
        inside = (F.col("lot") >= 0) & own.between(segment.lots.start, segment.lots.stop - 1)
        empty = F.array().cast("array<int>")
        return cut.withColumn("lots", F.when(inside, F.array(own.cast("int"))).otherwise(empty)).drop("lot")


def _layout(df):
    """One copy per entry of ``lots``; rows of no lot are kept in partition -1."""
    copies = df.select("*", F.posexplode_outer("lots").alias("_copy", "lot"))
    return copies.withColumns({"lot": F.coalesce("lot", F.lit(-1)), "_copy": F.coalesce("_copy", F.lit(0))})


def searched_gamma(total, models, lam_n, width):
    """Step sizes that minimise the ridge dual along a lot's summed step, one for each run.

    ``total`` holds the step of the shared vector and the SEARCH_SUMS behind it.
    """
    move = total[:, :width]
    gain = total[:, width] - (models * move).sum(axis=1) / lam_n
    curvature = total[:, width + 1] + (move * move).sum(axis=1) / lam_n
    return np.divide(gain, curvature, out=np.zeros(len(gain)), where=curvature > 0)


def train_group(table, task, solver, runs, lot_size, mode, on_epoch=None, start=None):
    """Train runs that share lot size, epochs, seed, lot mode and privacy, over all whole lots.

    ``on_epoch(epoch, models) -> active`` may watch the models and stop runs; a stopped run keeps
    its last models.  ``start`` gives models to begin with, runs x features, and for the dual a frame
    ``(row_id, alpha)`` with an array of the runs' values; rows that it lacks begin at zero.

    Runs whose ``gamma`` is -1 choose each lot's step size by line search: the lot's own job brings the
    two more sums that it takes.
    """
    spark = table.df.sparkSession
    dual = solver == "dual_parallel"
    first = runs[0]
    epochs = int(first.max_iter)
    keys = [r.noise_key(solver, task.name) for r in runs]
    count, width = len(runs), table.width
    noise = [noise_scale(solver, r.sigma, r.clip, lot_size) for r in runs]
    models = np.zeros((count, width)) if start is None else np.array(start[0], dtype=float)
    gamma = np.array([1.0 if r.gamma is None else r.gamma for r in runs])
    search = dual and any(r.searches for r in runs)
    lam = np.array([r.lambda_ for r in runs])
    step = kernels.DualStep(
        task,
        lam * table.n,
        [lot_size if r.sigma_p is None else r.sigma_p for r in runs],
        [r.bounded_clip for r in runs],
        gamma,
        noise,
    )
    vectors = table.vector_columns
    paths = [scratch_path(spark, "lots-a"), scratch_path(spark, "lots-b")]
    state = table.df
    if dual:
        zeros = F.array(*[F.lit(0.0)] * count)
        if start is None or start[1] is None:
            state = state.withColumn("alpha", zeros)
        else:
            state = state.join(start[1], "row_id", "left").withColumn("alpha", F.coalesce("alpha", zeros))
    state_columns = list(state.columns)
    poisson = mode == "poisson"
    plan = LotPlan(table.n, lot_size, epochs, mode, apart=not poisson and any(r.private or r.searches for r in runs))
    active = np.ones(count, dtype=bool)
    history = {}
    seen = 0
    if on_epoch:
        active &= on_epoch(0, models)
    laid_out = None
    for number, segment in enumerate(plan.segments(count, width)):
        if not active.any():
            break
        # Lots are drawn on the stored keys, before the Python map, so only keys are read for it.
        source = state if laid_out is None else _one_copy(laid_out)
        source = source.withColumnRenamed("lots", "_done").withColumnRenamed("noise", "_old")
        drawn = plan.assign(source, segment, first.seed)
        if dual and laid_out is not None:
            drawn = _advance(drawn, step, history, width, state_columns, extra=["lots"])
        drawn = drawn.select(*state_columns, "lots")
        if dual and any(s > 0 for s in noise):
            drawn = drawn.withColumn("noise", F.flatten(F.transform("lots", lambda t: F.array(*[
                keyed_normal(key, "a", t, F.col("row_id")) for key in keys
            ]))))
        laid_out = commit(_layout(drawn), paths[number % 2], ["lot"])
        history = {}
        for lot in segment.lots:
            rows = laid_out.where(F.col("lot") == lot)
            if dual:
                work = kernels.dual_lot(step, models, dict(history) if poisson else {}, lot, width, search)
                names = ["y", "alpha", "lots", *vectors] + (["noise"] if "noise" in rows.columns else [])
                if not poisson:
                    # A row has one lot per segment: nothing precedes it.
                    rows = rows.withColumn("lots", F.array().cast("array<int>"))
                    names = [c for c in names if c != "noise"]
                sums = rows.select(*names).mapInArrow(work, kernels.SUM_SCHEMA)
                total = add_sums(spark, sums, noise, width, keys, lot, kernels.SEARCH_SUMS * search)
                steps = gamma
                if search:
                    steps = np.where(gamma == -1.0, searched_gamma(total, models, step.lam_n, width), gamma)
                history[lot] = (models.copy(), active.copy(), steps)
                moved = models + steps[:, None] * total[:, :width]
            else:
                work = kernels.gradient_lot(task, models, [r.bounded_clip for r in runs], width)
                sums = rows.select("y", *vectors).mapInArrow(work, kernels.SUM_SCHEMA)
                total = add_sums(spark, sums, noise, width, keys, lot)
                total += lam[:, None] * models
                moved = models - gamma[:, None] * total / lot_size
            models = np.where(active[:, None], moved, models)
            ended = plan.ended(lot)
            if on_epoch and ended > seen:
                active &= on_epoch(ended, models)
                seen = ended
    alpha = None
    if dual and laid_out is not None:
        final = _one_copy(laid_out).withColumnRenamed("lots", "_done")
        final = final.withColumnRenamed("noise", "_old")
        alpha = _advance(final, step, history, width, state_columns).select("row_id", "alpha")
    return GroupResult(list(runs), models, plan.total, alpha)


def _one_copy(laid_out):
    """Each row once: its first copy."""
    return laid_out.where(F.col("_copy") == 0).drop("lot", "_copy")


def _advance(df, step, history, width, columns, extra=()):
    """Dual values after the lots in ``_done``, with noise ``_old``; ``extra`` columns ride along."""
    ready = df.withColumnRenamed("lots", "_next").withColumnRenamed("_done", "lots")
    ready = ready.withColumnRenamed("_old", "noise")
    keep = [*columns, *["_next" for _ in extra]]
    kinds = dict(ready.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    out = ready.mapInArrow(kernels.dual_commit(step, history, width, keep), schema)
    return out.withColumnRenamed("_next", "lots")
