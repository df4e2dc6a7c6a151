"""Scores, losses, objectives and the diagnostics around them: projections and aggregates.

Model and shared vectors are frames ``(idx, value)``.  Applied to wide rows they travel as one
vector of a row's width; applied to long rows they are joined on ``idx`` and Spark picks the join
by size.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.tasks import task_of
from lotwise.functions.vectors import dot, sq_norm
from lotwise.operators.encode import add_intercept, entries


def as_vector(model):
    """Frame ``(idx, value)``, a vector column or a plain sequence as one vector column."""
    if isinstance(model, Column):
        return model
    if hasattr(model, "agg"):
        pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
        return model.agg(F.transform(pairs, lambda p: p["value"]).alias("v")).scalar()
    return F.array(*[F.lit(float(v)) for v in model])


def score(df, model):
    """Column ``z = x . w`` on wide or sparse rows."""
    # A subquery may not appear inside a lambda: the vector comes in as a column first.
    df = df.withColumn("_w", as_vector(model))
    if "features" in df.columns:
        return df.withColumn("z", dot(F.col("features"), F.col("_w"))).drop("_w")
    terms = F.zip_with("indices", "values", lambda i, v: v * F.coalesce(F.get("_w", i), F.lit(0.0)))
    return df.withColumn("z", F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)).drop("_w")


def score_long(long, model):
    """Scores of long rows, for models too wide to travel: join on ``idx``, sum per row."""
    joined = long.join(model.select("idx", F.col("value").alias("w")), "idx")
    return joined.groupBy("row_id").agg(F.sum(F.col("value") * F.col("w")).alias("z"))


def predict_regression(df, model, fit_intercept=True):
    scored = score(add_intercept(df) if fit_intercept else df, model)
    return df_without_vector(scored).withColumnRenamed("z", "prediction")


def predict_class(df, model, fit_intercept=True):
    """Score above 0 is +1, anything else -1."""
    scored = score(add_intercept(df) if fit_intercept else df, model)
    label = F.when(F.col("z") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return df_without_vector(scored).withColumn("prediction", label).drop("z")


def df_without_vector(df):
    return df.drop("features", "indices", "values", "width")


def primal_loss(scored, task):
    """Mean loss of a scored frame ``(y, z)``."""
    return scored.agg(F.avg(task_of(task).primal_loss(F.col("z"), F.col("y"))).alias("loss"))


def dual_loss(df, task):
    """Mean dual loss of a frame ``(y, alpha)``; reading never changes ``alpha``."""
    return df.agg(F.avg(task_of(task).dual_loss(F.col("alpha"), F.col("y"))).alias("loss"))


def model_sq_norm(model):
    return model.agg(F.sum(F.col("value") * F.col("value")).alias("sq")).scalar()


def objective_logloss01(scored, model, lambda_):
    """Log-loss for 0/1 labels plus lambda |w|^2, the whole sum divided by the row count."""
    target = F.when(F.col("y") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    z = F.col("z")
    # -t ln h - (1 - t) ln(1 - h) with h the sigmoid of z, in its overflow-free form.
    term = F.greatest(F.lit(0.0), z) - target * z + F.log1p(F.exp(-F.abs(z)))
    loss = F.avg(term) + F.lit(float(lambda_)) * model_sq_norm(model) / F.count(F.lit(1))
    return scored.agg(loss.alias("objective"))


def primal_objective(df, coef, lambda_, task):
    loss = F.avg(task_of(task).primal_loss(F.col("z"), F.col("y")))
    penalty = F.lit(lambda_ / 2.0) * model_sq_norm(coef)
    return score(df, coef).agg((loss + penalty).alias("objective"))


def shared_vector(df, weight="alpha"):
    """w = X^T alpha: one weighted sum per feature, combined on the map side."""
    long = entries(df, keep=(weight,))
    return long.groupBy("idx").agg(F.sum(F.col("value") * F.col(weight)).alias("value"))


def model_from_shared(w, lambda_, n):
    return w.withColumn("value", F.col("value") / F.lit(float(lambda_)) / n)


def dual_objective(df, lambda_, task, w=None):
    w = shared_vector(df) if w is None else w
    n = F.count(F.lit(1))
    loss = F.avg(task_of(task).dual_loss(F.col("alpha"), F.col("y")))
    return df.agg((loss + model_sq_norm(w) / (F.lit(2.0 * lambda_) * n * n)).alias("objective"))


def duality_gap(df, lambda_, task, w=None):
    """Losses and objectives of ``(y, alpha, features)`` and the gap between primal and dual."""
    task = task_of(task)
    w = shared_vector(df) if w is None else w
    n = F.count(F.lit(1))
    lam_n = F.lit(float(lambda_)) * n
    counted = df.agg(n.cast("double").alias("n")).scalar()
    scored = score(df, w).withColumn("theta_z", F.col("z") / (F.lit(float(lambda_)) * counted))
    primal = F.avg(task.primal_loss(F.col("theta_z"), F.col("y")))
    dual = F.avg(task.dual_loss(F.col("alpha"), F.col("y")))
    half = model_sq_norm(w) / (F.lit(2.0) * lam_n * n)
    return (
        scored.agg(
            primal.alias("primal_loss"),
            dual.alias("dual_loss"),
            (primal + half).alias("primal_objective"),
            (dual + half).alias("dual_objective"),
        )
        .withColumn("gap", F.abs(F.col("primal_objective") + F.col("dual_objective")))
    )


def vector_compare(a, b):
    """Cosine, lengths and distance of two vectors ``(idx, value)``; absent entries are zero."""
    left = a.select("idx", F.col("value").alias("p"))
    right = b.select("idx", F.col("value").alias("q"))
    both = left.join(right, "idx", "full").na.fill(0.0, ["p", "q"])
    p, q = F.col("p"), F.col("q")
    lengths = F.sqrt(F.sum(p * p)) * F.sqrt(F.sum(q * q))
    return both.agg(
        F.coalesce(F.try_divide(F.sum(p * q), lengths), F.lit(0.0)).alias("cosine"),
        F.sqrt(F.sum(p * p)).alias("norm1"),
        F.sqrt(F.sum(q * q)).alias("norm2"),
        F.sqrt(F.sum((p - q) * (p - q))).alias("distance"),
    )


def lot_diagnostics(deltas):
    """Per epoch: median lengths of the lots' updates, mean and population deviation of the step.

    ``deltas`` has one row per lot: ``epoch, delta_alpha_norm, delta_w_norm, gamma``.
    """
    return deltas.groupBy("epoch").agg(
        F.median("delta_alpha_norm").alias("median_delta_alpha"),
        F.median("delta_w_norm").alias("median_delta_w"),
        F.avg("gamma").alias("mean_gamma"),
        F.stddev_pop("gamma").alias("std_gamma"),
    )


def row_sq_norm(df):
    """``sq = |x|^2`` of every row, in either layout."""
    return df.withColumn("sq", sq_norm(F.col("features" if "features" in df.columns else "values")))


def max_row_norm(df):
    return row_sq_norm(df).agg(F.sqrt(F.max("sq")).alias("max_norm"))
