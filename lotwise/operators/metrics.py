"""Quality metrics and run control, all grouped by run where a run is given."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def _by(df, by, *columns):
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def _share(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def mse(df, by=()):
    error = F.col("y") - F.col("prediction")
    return _by(df, by, F.avg(error * error).alias("mse"))


def r2(df, by=()):
    """1 - residual / total sum of squares; 0/0 counts as 1 and x/0 as 0."""
    error = F.col("y") - F.col("prediction")
    residual = F.sum(error * error)
    total = F.var_pop("y") * F.count(F.lit(1))
    flat = F.when(residual == 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return _by(df, by, F.coalesce(F.lit(1.0) - F.try_divide(residual, total), flat).alias("r2"))


def accuracy(df, by=()):
    hit = F.when(F.col("y") == F.col("prediction"), F.lit(1.0)).otherwise(F.lit(0.0))
    return _by(df, by, F.avg(hit).alias("accuracy"))


def _cell(label, predicted):
    inside = (F.col("y") > 0 if label else F.col("y") <= 0) & (
        F.col("prediction") > 0 if predicted else F.col("prediction") <= 0
    )
    return F.sum(F.when(inside, 1).otherwise(0))


def confusion(df, by=()):
    return _by(
        df,
        by,
        _cell(False, False).alias("tn"),
        _cell(False, True).alias("fp"),
        _cell(True, False).alias("fn"),
        _cell(True, True).alias("tp"),
    )


def precision_recall_f1(df, by=()):
    """For the positive class; a ratio without cases is 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return confusion(df, by).select(
        *by,
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
    )


def final_eval(df, task, by=()):
    """Test-set metrics of scored rows ``(y, z)``, or one set per run."""
    if not task.classifier:
        scored = df.withColumn("prediction", F.col("z"))
        error = F.col("y") - F.col("prediction")
        residual = F.sum(error * error)
        total = F.var_pop("y") * F.count(F.lit(1))
        flat = F.when(residual == 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
        quality = F.coalesce(F.lit(1.0) - F.try_divide(residual, total), flat)
        return _by(scored, by, F.avg(error * error).alias("mse"), quality.alias("r2"))
    labelled = df.withColumn(
        "prediction", F.when(F.col("z") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return confusion(labelled, by).select(
        *by,
        _share((F.col("tp") + F.col("tn")).cast("double"), total.cast("double")).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        "tn", "fp", "fn", "tp",
    )


# Fixed value: how many times the first error a run may reach before it is stopped.
STOP_FACTOR = 3.0


def early_stop(trace, factor=STOP_FACTOR):
    """Column ``stop``: validation error above ``factor`` times the run's first."""
    first = F.first_value("mse").over(Window.partitionBy("run_id").orderBy("epoch"))
    return trace.withColumn("stop", F.col("mse") > F.lit(float(factor)) * first)


def finite_check(trace, column="cost"):
    """Column ``finite``: the cost is neither NaN nor infinite."""
    value = F.col(column)
    broken = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return trace.withColumn("finite", ~broken)


def pending_runs(runs, trace):
    """Runs without a closing status in the trace."""
    done = trace.where(F.col("status").isin("complete", "stopped")).select("run_id").distinct()
    return runs.join(done, "run_id", "left_anti")
