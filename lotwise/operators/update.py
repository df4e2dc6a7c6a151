"""The private update of one lot: per-row step, clip, sum over the lot, noise, apply."""

from pyspark.sql import functions as F

from lotwise.functions.keyed import keyed_normal
from lotwise.functions.tasks import project_box, task_of
from lotwise.functions.vectors import clip_l2, clip_scalar, scaled
from lotwise.operators.encode import entries
from lotwise.operators.objective import row_sq_norm, score

__all__ = [
    "apply_alpha_update",
    "apply_dual_update",
    "apply_sgd_update",
    "clip_l2",
    "clip_scalar",
    "delta_alpha",
    "delta_theta_logistic",
    "delta_theta_ridge",
    "gaussian_noise_lot",
    "gradient",
    "lot_vector_sum",
    "noise_scale",
    "optimal_dampening_dual",
    "optimal_dampening_primal",
    "project_box",
]


def delta_alpha(df, w, task, lambda_, sigma_p, n, clip=0):
    """Column ``delta``: the dual step of every row against a fixed shared vector ``w``."""
    task = task_of(task)
    step = task.delta_alpha(
        F.col("z"), F.col("y"), F.col("alpha"), F.col("sq"), float(lambda_) * n, sigma_p
    )
    return row_sq_norm(score(df, w)).withColumn("delta", clip_scalar(step, clip))


def gradient(df, w, task, clip=0):
    """Column ``gradient``: the loss gradient of every row at ``w``, clipped by length."""
    factor = task_of(task).gradient_factor(F.col("z"), F.col("y"))
    return score(df, w).withColumn("gradient", clip_l2(scaled(F.col("features"), factor), clip))


def lot_vector_sum(df, weight="delta", by=("lot",)):
    """Sum of weight * x per lot and feature; partial sums are formed before the shuffle."""
    long = entries(df, keep=(*by, weight))
    return long.groupBy(*by, "idx").agg(F.sum(F.col("value") * F.col(weight)).alias("value"))


def noise_scale(solver, sigma, clip, lot_size=1):
    """Deviation of the noise added at the end of a lot.

    ``dual_parallel`` adds it to the dual step and to the vector sum, ``dual_sequential`` to the
    dual values and the shared vector, ``sgd`` to the gradient sum.
    """
    if sigma == 0:
        return 0.0
    if clip <= 0 or clip == float("inf"):
        raise ValueError("noise needs a positive, finite clipping bound")
    if solver == "dual_parallel":
        return sigma * (2.0 * clip**2) ** 0.5
    if solver == "dual_sequential":
        return sigma * ((4.0 * lot_size**2 - 2.0) * clip**2) ** 0.5
    if solver == "sgd":
        return sigma * clip
    raise ValueError(f"unknown solver {solver!r}")


def gaussian_noise_lot(df, scale, *key, column="value"):
    """Add keyed normal noise of deviation ``scale`` to a column."""
    return df.withColumn(column, F.col(column) + F.lit(float(scale)) * keyed_normal(*key))


def apply_dual_update(w, delta_w, gamma=1.0):
    """w + gamma * delta_w on ``(idx, value)`` frames."""
    step = delta_w.select("idx", (F.col("value") * F.lit(float(gamma))).alias("value"))
    both = w.select("idx", "value").unionByName(step)
    return both.groupBy("idx").agg(F.sum("value").alias("value"))


def apply_alpha_update(df, deltas, gamma=1.0):
    """alpha + gamma * delta for the rows of a lot; the other rows keep theirs."""
    step = deltas.select("row_id", F.col("delta").alias("_d"))
    moved = F.col("alpha") + F.lit(float(gamma)) * F.coalesce(F.col("_d"), F.lit(0.0))
    return df.join(step, "row_id", "left").withColumn("alpha", moved).drop("_d")


def apply_sgd_update(w, total, eta, lambda_, lot_size):
    """w - eta * (sum + lambda w) / lot size.

    The penalty enters once per lot before the division, so its weight is lambda / lot size.
    """
    joined = w.join(total.select("idx", F.col("value").alias("_g")), "idx", "left")
    step = F.coalesce(F.col("_g"), F.lit(0.0)) + F.lit(float(lambda_)) * F.col("value")
    moved = F.col("value") - F.lit(float(eta)) * step / F.lit(float(lot_size))
    return joined.select("idx", moved.alias("value"))


def delta_theta_ridge(df, coef, lambda_, n):
    """Step of every coefficient on its own, others fixed: one aggregate gives all of them."""
    residual = score(df, coef).withColumn("_r", F.col("y") - F.col("z"))
    sums = entries(residual, keep=("_r",)).groupBy("idx").agg(
        F.sum(F.col("_r") * F.col("value")).alias("g"),
        F.sum(F.col("value") * F.col("value")).alias("h"),
    )
    lam_n = F.lit(float(lambda_)) * n
    joined = coef.join(sums, "idx", "left").na.fill(0.0, ["g", "h"])
    step = (F.col("g") - lam_n * F.col("value")) / (F.col("h") + lam_n)
    return joined.select("idx", step.alias("delta"))


def delta_theta_logistic(df, coef, lambda_):
    """Newton step of every coefficient on its own, others fixed.

    With p the probability of the wrong label, exp(-yz) / (1 + exp(-yz)), the first derivative of
    a row is -y x p and the second x^2 p (1 - p).
    """
    wrong = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("y") * F.col("z")))
    scored = score(df, coef).withColumn("_p", wrong)
    scored = scored.withColumns({
        "_g": -F.col("y") * F.col("_p"),
        "_h": F.col("_p") * (F.lit(1.0) - F.col("_p")),
    })
    sums = entries(scored, keep=("_g", "_h")).groupBy("idx").agg(
        F.sum(F.col("_g") * F.col("value")).alias("g"),
        F.sum(F.col("_h") * F.col("value") * F.col("value")).alias("h"),
    )
    lam = F.lit(float(lambda_))
    joined = coef.join(sums, "idx", "left").na.fill(0.0, ["g", "h"])
    step = -(F.col("g") + lam * F.col("value")) / (F.col("h") + lam)
    return joined.select("idx", step.alias("delta"))


def optimal_dampening_dual(lot, w, delta_w, sigma, lambda_):
    """Step size that minimises the expected ridge dual under relative noise.

    ``lot`` has ``y, alpha, delta``; all products come from two aggregates.
    """
    rows = lot.agg(
        F.sum(F.col("delta") * (F.col("y") - F.col("alpha"))).alias("gain"),
        F.sum(F.col("delta") * F.col("delta")).alias("dd"),
        F.count(F.lit(1)).alias("n"),
    )
    pair = w.select("idx", F.col("value").alias("w")).join(
        delta_w.select("idx", F.col("value").alias("d")), "idx", "full"
    ).na.fill(0.0, ["w", "d"])
    features = pair.agg(
        F.sum(F.col("w") * F.col("d")).alias("wd"),
        F.sum(F.col("d") * F.col("d")).alias("dw"),
        F.count(F.lit(1)).alias("m"),
    )
    inv, var = F.lit(1.0 / lambda_), F.lit(float(sigma) ** 2)
    both = features.select(F.struct("wd", "dw", "m").alias("f")).scalar()
    f = F.col("f")
    gamma = (F.col("gain") - inv * f["wd"]) / (
        inv * f["dw"] * (F.lit(1.0) + var * f["m"]) + F.col("dd") * (F.lit(1.0) + var * F.col("n"))
    )
    return rows.withColumn("f", both).select(gamma.alias("gamma"))


def optimal_dampening_primal(rows, coef, delta, sigma, lambda_):
    """The same for the ridge primal; ``rows`` has ``y, z`` and ``dz = x . delta``."""
    sums = rows.agg(
        F.sum((F.col("z") - F.col("y")) * F.col("dz")).alias("slope"),
        F.sum(F.col("dz") * F.col("dz")).alias("zz"),
        F.count(F.lit(1)).alias("n"),
    )
    pair = coef.join(delta.select("idx", F.col("delta").alias("d")), "idx")
    features = pair.agg(
        F.sum(F.col("value") * F.col("d")).alias("td"),
        F.sum(F.col("d") * F.col("d")).alias("dd"),
        F.count(F.lit(1)).alias("m"),
    )
    lam, var = F.lit(float(lambda_)), F.lit(float(sigma) ** 2)
    both = features.select(F.struct("td", "dd", "m").alias("f")).scalar()
    f = F.col("f")
    gamma = -(F.col("slope") + lam * f["td"]) / (
        F.col("zz") * (F.lit(1.0) + var * F.col("n")) + lam * f["dd"] * (F.lit(1.0) + var * f["m"])
    )
    return sums.withColumn("f", both).select(gamma.alias("gamma"))
