"""Training jobs: one run, or a grid of runs that share their passes over the data."""

import math
import time
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.tasks import task_of
from lotwise.operators import privacy
from lotwise.operators.encode import add_intercept
from lotwise.operators.metrics import STOP_FACTOR, pending_runs
from lotwise.operators.objective import max_row_norm, score
from lotwise.operators.split import sample_rows
from lotwise.operators.update import (
    delta_theta_logistic,
    delta_theta_ridge,
    optimal_dampening_primal,
)
from lotwise.plans import kernels
from lotwise.plans.cocoa import train_cocoa
from lotwise.plans.lots import MODEL_CELLS, TrainingTable, narrow, train_group, training_table
from lotwise.plans.params import PARAM_SCHEMA, RunParams, runs_of
from lotwise.sources.scratch import commit, scratch_path
from lotwise.sources.writers import write_trace

# The short solver names.
SOLVER_ALIASES = {
    "PSCD": "dual_parallel",
    "SSCD": "dual_sequential",
    "SGD": "sgd",
    "COCOA": "cocoa",
}
SOLVERS = [*SOLVER_ALIASES.values(), "primal_cd"]
# Rows normalised in single precision exceed length 1 by about 1e-7.
NORM_SLACK = 1e-6

TRACE_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("mse", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("ms", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
])
COEF_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])


@dataclass
class FitResult:
    """Trained models.  ``coef`` and ``shared`` map a run to a NumPy vector.

    ``coef`` is for rows as they are given (with the constant 1 in front); ``shared`` is for the
    rows that were trained on, which a private run with an intercept shortens by sqrt(2).
    """

    spark: object
    runs: list
    task: object
    solver: str
    coef: dict
    shared: dict
    alpha: dict
    trace: list
    ledger: object
    fit_intercept: bool
    n: int

    def coef_frame(self):
        """Frame ``(run_id, idx, value)``."""
        return coef_rows(self.spark, self.coef)

    def trace_frame(self):
        return self.spark.createDataFrame(self.trace, TRACE_SCHEMA)

    def scores(self, df, run_id=None):
        """Column ``z`` for one run."""
        run_id = self.runs[0].run_id if run_id is None else run_id
        rows = add_intercept(df) if self.fit_intercept else df
        return score(rows, self.coef_frame().where(F.col("run_id") == run_id))

    def evaluate(self, df):
        """Test metrics of every run, from one pass over ``df``."""
        rows = add_intercept(df) if self.fit_intercept else df
        order = [r.run_id for r in self.runs]
        models = np.stack([self.coef[r] for r in order])
        return evaluation_frame(rows, self.task, models, order)


def coef_rows(spark, models):
    """Frame ``(run_id, idx, value)`` of NumPy vectors by run."""
    runs = sorted(models)
    if not runs:
        return spark.createDataFrame([], COEF_SCHEMA)
    return spark.createDataFrame(pa.table({
        "run_id": np.repeat(np.array(runs, dtype=np.int64), [len(models[r]) for r in runs]),
        "idx": np.concatenate([np.arange(len(models[r]), dtype=np.int32) for r in runs]),
        "value": np.concatenate([np.asarray(models[r], dtype=float) for r in runs]),
    }), COEF_SCHEMA)


def _evaluation_sums(frames, task, models):
    """Sums of loss, error and confusion per run and side, from one pass over all frames."""
    rows = None
    for side, df in enumerate(frames):
        vectors = ["features"] if "features" in df.columns else ["indices", "values"]
        one = df.select(F.lit(side).alias("side"), F.col("y").cast("double").alias("y"), *vectors)
        rows = one if rows is None else rows.unionByName(one)
    work = kernels.evaluate_rows(task, models, models.shape[1], len(frames))
    names = ["n", "loss", "sq_error", "tp", "fp", "fn", "tn"]
    return rows.mapInArrow(work, kernels.EVAL_SCHEMA).groupBy("side", "run").agg(*[F.sum(c).alias(c) for c in names])


def evaluation_frame(df, task, models, run_ids):
    """Loss, error and confusion-based metrics per run: one pass serves all models."""
    sums = _evaluation_sums([df], task, models)
    spread = df.agg((F.var_pop(F.col("y").cast("double")) * F.count(F.lit(1))).alias("t")).scalar()
    ids = F.array(*[F.lit(int(r)).cast("bigint") for r in run_ids])

    def share(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return sums.withColumn("_t", spread).select(
        F.get(ids, F.col("run")).alias("run_id"),
        (F.col("loss") / F.col("n")).alias("loss"),
        (F.col("sq_error") / F.col("n")).alias("mse"),
        F.coalesce(
            F.lit(1.0) - F.try_divide(F.col("sq_error"), F.col("_t")),
            F.when(F.col("sq_error") == 0.0, F.lit(1.0)).otherwise(F.lit(0.0)),
        ).alias("r2"),
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        "tp", "fp", "fn", "tn",
    )


def releases(run, n, solver, mode):
    """(mech_id, sampling rate, number of releases) of one run, as it is trained.

    Lots drawn independently are releases at rate lot / n.  Lots cut from a permutation hold a row
    at most once an epoch: an epoch is one release at rate 1.  The same holds for each pass over
    the parts of CoCoA, which are disjoint.
    """
    if solver in ("cocoa", "dual_sequential"):
        rounds = run.out_iter if solver == "cocoa" else 1
        return 0, 1.0, rounds * int(run.max_iter)
    if mode == "exact":
        return 0, 1.0, int(run.max_iter)
    lot = run.lot_size(n)
    return 0, lot / n, n * int(run.max_iter) // lot


def _with_noise(spark, runs, n, solver, mode_of):
    """Noise scale of every run that names a target epsilon; None where no noise meets it."""
    wanted = [r for r in runs if r.eps > 0]
    found = {}
    if wanted:
        rows = []
        for r in wanted:
            _, q, iters = releases(r, n, solver, mode_of(r))
            rows.append((int(r.run_id), float(r.eps), privacy.TRAINING_DELTA, float(q), int(iters)))
        targets = spark.createDataFrame(rows, PARAM_SCHEMA)
        calibrated = privacy.calibrate_sigma(targets, privacy.TRAINING_ORDERS)
        found = {r["run_id"]: r["sigma"] for r in calibrated.select("run_id", "sigma").collect()}
    return [replace(r, sigma=found.get(r.run_id, r.sigma)) for r in runs]


def ledger_of(spark, runs, n, solver, mode_of):
    rows = []
    for r in runs:
        if r.sigma > 0:
            mech, q, iters = releases(r, n, solver, mode_of(r))
            rows.append((int(r.run_id), int(mech), float(r.sigma), float(q), int(iters)))
    schema = "run_id bigint, mech_id int, sigma double, q double, iters bigint"
    return spark.createDataFrame(rows, schema)


def _refusals(table, task, runs, solver):
    """Why a run cannot be trained, by run."""
    found = {}
    for r in runs:
        try:
            r.check()
            if solver in ("dual_parallel", "sgd"):
                r.lot_size(table.n)
            if solver in ("dual_parallel", "sgd", "primal_cd") and r.k != 1:
                raise ValueError("K is the number of parts of CoCoA and of sequential training only")
            if r.searches and solver != "primal_cd" and (solver != "dual_parallel" or task.name != "ridge" or r.private):
                raise ValueError("a line search is for the ridge task, by lots of the dual, without noise")
            if solver == "primal_cd" and r.private:
                raise ValueError("primal coordinates have no private form: steps are not clipped")
        except ValueError as refused:
            found[r.run_id] = refused
    private = [r for r in runs if r.private and r.run_id not in found]
    if private and solver != "sgd":
        longest = max_row_norm(table.df).first()[0]
        if longest > 1.0 + NORM_SLACK:
            refused = ValueError(
                f"private dual training needs rows of length at most 1 (longest: {longest:.6g}); "
                "apply row_l2_normalize first"
            )
            found.update({r.run_id: refused for r in private})
    return found


class _Watch:
    """Per-epoch cost and validation metric of a group, with the two stopping rules.

    One pass over both tables gives a line per run.  A line that closes a run says so; ``sink``, if
    given, gets the epoch's lines and the models of the runs that they close.
    """

    def __init__(self, table, task, solver, runs, last, validation, trace, factor=1.0, sink=None):
        self.table, self.task, self.solver, self.runs = table, task, solver, runs
        self.last, self.validation, self.trace = last, validation, trace
        self.factor, self.sink = factor, sink
        self.first, self.closed = {}, set()
        self.start = time.time()

    def coef(self, models):
        if self.solver == "sgd" or self.solver == "primal_cd":
            return models
        return models / (np.array([r.lambda_ for r in self.runs])[:, None] * self.table.n)

    def __call__(self, epoch, models):
        coef = self.coef(models)
        frames = [self.table.df] + ([] if self.validation is None else [self.validation])
        sums = {(r["side"], r["run"]): r for r in _evaluation_sums(frames, self.task, coef).collect()}
        ms = (time.time() - self.start) * 1000.0
        lines, closing, active = [], {}, []
        for i, run in enumerate(self.runs):
            train, held = sums[0, i], sums.get((1, i))
            held = held if held and held["n"] else None
            cost = train["loss"] / train["n"] + run.lambda_ / 2.0 * float(coef[i] @ coef[i])
            mse = None if held is None or self.task.classifier else held["sq_error"] / held["n"]
            hit = (held["tp"] + held["tn"]) / held["n"] if held is not None and self.task.classifier else None
            first = self.first.setdefault(run.run_id, mse)
            reason = None
            if not math.isfinite(cost):
                reason = "the cost is not finite"
            elif mse is not None and mse > STOP_FACTOR * first:
                reason = f"the error exceeds {STOP_FACTOR:g} times the first"
            status = "stopped" if reason else "complete" if epoch >= self.last else "running"
            if run.run_id not in self.closed:
                lines.append((int(run.run_id), int(epoch), float(cost), mse, hit, ms, status, reason))
                if status != "running":
                    closing[run.run_id] = self.factor * coef[i]
                    self.closed.add(run.run_id)
            active.append(reason is None)
        self.trace += lines
        if self.sink:
            self.sink(lines, closing)
        return np.array(active)


def fit_runs(
    df, task, solver, runs, fit_intercept=True, mode=None, validation=None, trace=False, keep_going=False, sink=None,
    start=None,
):
    """Train every run.  Runs with the same lots share their passes; wide groups are chunked so
    that the models in flight stay within a fixed size.

    ``start`` is an earlier result of the same runs and rows, whose models and dual values the parallel
    dual and SGD begin with.

    A run that cannot be trained raises its error; with ``keep_going`` it gets a line ``stopped`` in
    the trace, with the reason, and the others are trained.
    """
    task = task_of(task)
    solver = SOLVER_ALIASES.get(solver, solver)
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; known: {SOLVERS}")
    shorten = fit_intercept and solver != "sgd"
    if shorten and len({r.private for r in runs}) == 2:
        # Rows are shortened for private runs only, so these have their own passes.
        sides = [[r for r in runs if r.private is private] for private in (False, True)]
        rest = (fit_intercept, mode, validation, trace, keep_going, sink, start)
        return _joined(runs, *[fit_runs(df, task, solver, side, *rest) for side in sides])
    # With its constant 1 a unit row is sqrt(2) long; private dual steps need length 1.
    factor = math.sqrt(0.5) if shorten and any(r.private for r in runs) else 1.0
    rows = _shortened(add_intercept(df), factor) if fit_intercept else df
    spark = df.sparkSession
    if start is not None and solver not in ("dual_parallel", "sgd"):
        raise ValueError("only the parallel dual and SGD begin with an earlier result")
    held = None
    if validation is not None:
        held = _shortened(add_intercept(validation), factor) if fit_intercept else validation
    if trace or solver in ("primal_cd", "cocoa", "dual_sequential") or len(runs) > 1:
        # Read many times: written once, so that preparation is not repeated and lineage ends here.
        rows = commit(narrow(rows), scratch_path(spark, "train"))
        if trace and held is not None:
            held = rows if validation is df else commit(narrow(held), scratch_path(spark, "held"))
    table = training_table(rows)
    mode_of = lambda r: mode or ("poisson" if r.private else "exact")
    refused = _refusals(table, task, runs, solver)
    noisy = _with_noise(spark, [r for r in runs if r.run_id not in refused], table.n, solver, mode_of)
    missed = [r.run_id for r in noisy if r.sigma is None]
    refused.update({m: ArithmeticError(f"no noise meets the target epsilon of run {m}") for m in missed})
    if refused and not keep_going:
        raise next(iter(refused.values()))
    log = [(int(r), 0, None, None, None, 0.0, "stopped", str(why)) for r, why in sorted(refused.items())]
    if sink and log:
        sink(list(log), {})
    runs = [r for r in noisy if r.sigma is not None]
    coef, shared, alpha = {}, {}, {}
    watch_of = lambda some, last: (
        _Watch(table, task, solver, some, last, held, log, factor, sink) if trace else None
    )
    if solver in ("dual_parallel", "sgd"):
        groups = {}
        for r in runs:
            key = (r.lot_size(table.n), r.max_iter, r.seed, mode_of(r), r.private, r.searches)
            groups.setdefault(key, []).append(r)
        size = max(1, MODEL_CELLS // table.width)
        for (lot, last, _, chosen, *_), members in groups.items():
            for low in range(0, len(members), size):
                chunk = members[low : low + size]
                begin = _begin(start, chunk, table.width) if start else None
                done = train_group(table, task, solver, chunk, lot, chosen, watch_of(chunk, last), begin)
                for i, r in enumerate(chunk):
                    shared[r.run_id] = done.models[i]
                    scale = 1.0 if solver == "sgd" else r.lambda_ * table.n
                    coef[r.run_id] = done.models[i] / scale
                    if done.alpha is not None:
                        alpha[r.run_id] = done.alpha.select(
                            "row_id", F.get("alpha", F.lit(i)).alias("alpha")
                        )
    elif solver in ("cocoa", "dual_sequential"):
        for r in runs:
            k, rounds = min(r.k, table.n), r.out_iter if solver == "cocoa" else 1
            watch = watch_of([r], rounds)
            one = (lambda e, m, watch=watch: watch(e, m[None, :])) if watch else None
            gamma = 1.0 if r.gamma is None else r.gamma
            w, values = train_cocoa(table, task, r, k, rounds, gamma, r.sigma_p, one, solver)
            shared[r.run_id], coef[r.run_id] = w, w / (r.lambda_ * table.n)
            alpha[r.run_id] = values
    else:
        for r in runs:
            coef[r.run_id] = primal_cd(table, task, r, watch_of([r], int(r.max_iter)))
    coef = {run_id: factor * values for run_id, values in coef.items()}
    ledger = ledger_of(spark, runs, table.n, solver, mode_of)
    return FitResult(
        spark, runs, task, solver, coef, shared, alpha, log, ledger, fit_intercept, table.n
    )


def _begin(start, runs, width):
    """Models and dual values of an earlier result for some of its runs."""
    missing = [r.run_id for r in runs if r.run_id not in start.shared]
    if missing or any(len(start.shared[r.run_id]) != width for r in runs if r.run_id in start.shared):
        raise ValueError(f"the earlier result has no models of this width for runs {missing or [r.run_id for r in runs]}")
    models = np.stack([start.shared[r.run_id] for r in runs])
    if runs[0].run_id not in start.alpha:
        return models, None
    values = None
    for i, r in enumerate(runs):
        one = start.alpha[r.run_id].select("row_id", F.col("alpha").alias(f"_{i}"))
        values = one if values is None else values.join(one, "row_id")
    return models, values.select("row_id", F.array(*[f"_{i}" for i in range(len(runs))]).alias("alpha"))


def _shortened(df, factor):
    if factor == 1.0:
        return df
    column = "features" if "features" in df.columns else "values"
    return df.withColumn(column, F.transform(column, lambda v: v * F.lit(factor)))


def _joined(runs, one, other):
    """Results of two sets of runs as one."""
    both = {name: {**getattr(one, name), **getattr(other, name)} for name in ("coef", "shared", "alpha")}
    trained = {r.run_id: r for r in [*one.runs, *other.runs]}
    return replace(
        one, runs=[trained[r.run_id] for r in runs if r.run_id in trained], trace=one.trace + other.trace, ledger=one.ledger.unionByName(other.ledger), **both
    )


def fit(df, task, solver="dual_parallel", params=None, **options):
    """Train one run."""
    return fit_runs(df, task, solver, [params or RunParams()], **options)


def fit_dual_parallel(df, task, params, **options):
    return fit(df, task, "dual_parallel", params, **options)


def fit_dual_sequential(df, task, params, **options):
    return fit(df, task, "dual_sequential", params, **options)


def fit_sgd(df, task, params, **options):
    return fit(df, task, "sgd", params, **options)


def fit_cocoa(df, task, params, **options):
    return fit(df, task, "cocoa", params, **options)


def fit_primal_cd(df, task, params, **options):
    return fit(df, task, "primal_cd", params, **options)


class GridLog:
    """What a grid has done so far, in two tables below one path.

    ``trace`` holds a line per run and epoch, written when the epoch ends; ``models`` the coefficients
    of every run, written before the line that closes it.  A grid that was interrupted begins its open
    runs anew; ``attempt`` tells their lines apart.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")
        self.attempt = int(time.time() * 1000)
        self.coef_schema = T.StructType([*COEF_SCHEMA.fields[1:], T.StructField("attempt", T.LongType()), COEF_SCHEMA[0]])

    def _read(self, name, schema):
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def trace(self):
        """Lines of each run's last attempt."""
        schema = T.StructType([*TRACE_SCHEMA.fields, T.StructField("attempt", T.LongType())])
        newest = F.max("attempt").over(Window.partitionBy("run_id"))
        lines = self._read("trace", schema).withColumn("_newest", newest)
        return lines.where(F.col("attempt") == F.col("_newest")).drop("_newest")

    def models(self, runs):
        """Coefficients of the given runs, from the attempt that closed them."""
        closed = self.trace().where("status in ('complete', 'stopped')").select("run_id", "attempt").distinct()
        wanted = closed.where(F.col("run_id").isin([int(r) for r in runs]))
        return self._read("models", self.coef_schema).join(F.broadcast(wanted), ["run_id", "attempt"])

    def __call__(self, lines, closing):
        if closing:
            frame = coef_rows(self.spark, closing).withColumn("attempt", F.lit(self.attempt))
            write_trace(frame, f"{self.path}/models")
        frame = self.spark.createDataFrame(lines, TRACE_SCHEMA).withColumn("attempt", F.lit(self.attempt))
        write_trace(frame.coalesce(1), f"{self.path}/trace")


def fit_grid(df, runs, task, solver="dual_parallel", log=None, keep_going=None, **options):
    """Train every row of a ``runs`` frame.

    ``log`` names a folder for the trace and the models.  Runs that it already closes are not trained
    again, and a run that cannot be trained is logged as stopped while the others go on (without a log,
    ask for that by ``keep_going``).  The result holds the models of all runs that have one, and the
    trace of all.
    """
    if log is None:
        return fit_runs(df, task, solver, runs_of(runs), keep_going=bool(keep_going), **options)
    spark = df.sparkSession
    book = GridLog(spark, log)
    open_runs = runs_of(pending_runs(runs, book.trace()))
    every = runs_of(runs)
    earlier = sorted({r.run_id for r in every} - {r.run_id for r in open_runs})
    going = True if keep_going is None else keep_going
    result = fit_runs(df, task, solver, open_runs, **{**options, "trace": True}, keep_going=going, sink=book) if open_runs else None
    models = {}
    for row in book.models(earlier).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("v")).toLocalIterator():
        models[row["run_id"]] = np.array([e["value"] for e in row["v"]])
    ids = [r.run_id for r in every]
    lines = [
        tuple(row[f.name] for f in TRACE_SCHEMA)
        for row in book.trace().where(F.col("run_id").isin(ids)).orderBy("run_id", "epoch").toLocalIterator()
    ]
    if result is None:
        chosen = SOLVER_ALIASES.get(solver, solver)
        empty = ledger_of(spark, [], 0, chosen, None)
        result = FitResult(spark, [], task_of(task), chosen, {}, {}, {}, [], empty, options.get("fit_intercept", True), 0)
    known = {**models, **result.coef}
    trained = {r.run_id: r for r in result.runs}
    return replace(result, runs=[trained.get(r.run_id, r) for r in every if r.run_id in known], coef=known, trace=lines)


def primal_cd(table, task, params, on_sweep=None):
    """Primal coordinates, all at once: one aggregate per sweep gives every coordinate's step.

    The summed step is damped by ``gamma`` (default: one over the number of coordinates; -1 asks
    for the step size that minimises the ridge objective along the summed step).  ``sample_ratio``
    below 1 takes each sweep's steps from that share of the rows, drawn anew per sweep.
    """
    if task.name == "hinge":
        raise ValueError("primal coordinates need a smooth loss: ridge or logistic")
    spark = table.df.sparkSession
    theta = np.zeros(table.width)
    damping = 1.0 / table.width if params.gamma is None else params.gamma
    going = on_sweep is None or on_sweep(0, theta[None, :]).all()
    for sweep in range(int(params.max_iter)):
        if not going:
            break
        coef, rows, n = _vector_frame(spark, theta), table.df, table.n
        if params.sample_ratio < 1.0:
            n = max(1, math.ceil(params.sample_ratio * table.n))
            rows = sample_rows(rows, n, f"{params.seed}|sample|{sweep}")
        if task.name == "ridge":
            steps = delta_theta_ridge(rows, coef, params.lambda_, n)
        else:
            steps = delta_theta_logistic(rows, coef, params.lambda_)
        got = steps.toArrow()
        move = np.zeros(table.width)
        move[got["idx"].to_numpy()] = got["delta"].to_numpy()
        if params.gamma == -1:
            damping = _best_damping(spark, table, theta, move, params)
        theta = theta + damping * move
        going = on_sweep is None or on_sweep(sweep + 1, theta[None, :]).all()
    return theta


def _vector_frame(spark, values):
    columns = {"idx": np.arange(len(values), dtype=np.int32), "value": values}
    return spark.createDataFrame(pa.table(columns), "idx int, value double")


def _best_damping(spark, table, theta, move, params):
    coef, step = _vector_frame(spark, theta), _vector_frame(spark, move)
    rows = score(score(table.df, coef).withColumnRenamed("z", "z0"), step)
    rows = rows.select("y", F.col("z0").alias("z"), F.col("z").alias("dz"))
    delta = step.withColumnRenamed("value", "delta")
    lam = params.lambda_ * table.n
    return float(optimal_dampening_primal(rows, coef, delta, params.sigma, lam).first()[0])


__all__ = [
    "FitResult", "GridLog", "TrainingTable", "fit", "fit_cocoa", "fit_dual_parallel", "fit_dual_sequential",
    "fit_grid", "fit_primal_cd", "fit_runs", "fit_sgd", "primal_cd",
]
