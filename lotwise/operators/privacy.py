"""Privacy ledger: noisy releases in, (epsilon, delta) out.

A ledger row is one mechanism ``(run_id, mech_id, sigma, q, iters)``.  Its log moments depend on
(sigma, q) alone, so they are evaluated once per distinct pair, as one vector over the orders.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.functions.vectors import let

# Fixed values of the training jobs: moment orders and delta.
TRAINING_ORDERS = 128
TRAINING_DELTA = 1e-3
DEFAULT_ORDERS = 32
TINY = 1e-300


def _log_factorials(top):
    return F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(top + 1)])


def _ln(column):
    return F.log(F.greatest(column, F.lit(TINY)))


def log_moment(sigma, q, order, table):
    """ln of the order-th moment of the privacy loss of the sampled Gaussian mechanism.

    The binomial sum is taken in logs around its largest term, so no order overflows.
    """
    given = F.struct(
        _ln(q).alias("in"), _ln(F.lit(1.0) - q).alias("out"),
        (F.lit(0.5) / (sigma * sigma)).alias("c"), F.get(table, order).alias("f"),
    )

    def term(k, g):
        ways = g["f"] - F.get(table, k) - F.get(table, order - k)
        mix = ways + k * g["in"] + (order - k) * g["out"] + k * (k - 1) * g["c"]
        # (1 - q) e^{k(k-1)c} + q e^{k(k+1)c}, with the first exponent taken out.
        gap = g["in"] - g["out"] + F.lit(2.0) * k * g["c"]
        lift = F.greatest(F.lit(0.0), gap) + F.log1p(F.exp(-F.abs(gap)))
        return mix + g["out"] + lift

    def log_sum(terms):
        return let(F.array_max(terms), lambda peak: peak + F.log(
            F.aggregate(terms, F.lit(0.0), lambda s, v: s + F.exp(v - peak))
        ))

    terms = let(given, lambda g: F.transform(F.sequence(F.lit(0), order), lambda k: term(k, g)))
    return let(terms, log_sum)


# A pair table of up to so many (sigma, q) is small enough to travel: 64 MB at 128 orders.
MOST_PAIRS = 1 << 16
PAIRS_OF_TASK = 1 << 8


def _pairs(ledger, orders):
    """Distinct (sigma, q) with their moment vectors, and whether they are few enough to travel."""
    pairs = ledger.select(F.col("sigma").cast("double").alias("sigma"), F.col("q").cast("double").alias("q")).distinct()
    find = F.pandas_udf(
        lambda sigma, q: pd.Series(list(block_moments(sigma.to_numpy(), q.to_numpy(), orders)), dtype=object), "array<double>"
    )
    found = pairs.limit(MOST_PAIRS + 1).toArrow()
    few = len(found) <= MOST_PAIRS
    if few:  # the ledger is not read again for them
        spark = ledger.sparkSession
        pairs = spark.createDataFrame(found, pairs.schema).repartition(1 + len(found) // PAIRS_OF_TASK)
    return pairs.withColumn("_moments", find("sigma", "q")), few


def log_moments(ledger, orders=DEFAULT_ORDERS):
    """Ledger rows times orders 1..orders with column ``log_moment``.

    The moments are evaluated once per distinct (sigma, q), as vectors.  Where these are few, they are
    sent to the ledger's rows, which stay where they are, however often a pair occurs.
    """
    pairs, few = _pairs(ledger, orders)
    joined = ledger.join(F.broadcast(pairs) if few else pairs, ["sigma", "q"])
    kept = [c for c in joined.columns if c != "_moments"]
    # The outer form: a plain explode adds a size check that would evaluate the moments per row.
    spread = joined.select(*kept, F.posexplode_outer("_moments").alias("_place", "log_moment"))
    return spread.withColumn("order", F.col("_place") + 1).drop("_place")


def composed_vectors(ledger, orders=DEFAULT_ORDERS):
    """One row per run: ``moments``, the composed log moments of orders 1..orders, and ``fallback``.

    What is shuffled are a run's distinct (sigma, q) with their summed ``iters``; the vectors of the
    pairs come to them, and their weighted sum is formed in one task's batch.  A run's list is no
    longer than the table of pairs.
    """
    single = F.log(F.col("q")) + F.lit(1.0) / (F.col("sigma") * F.col("sigma"))
    summed = ledger.groupBy("run_id", "sigma", "q").agg(F.sum("iters").cast("double").alias("iters"))
    pairs, few = _pairs(ledger, orders)
    if not few:
        spread = compose(log_moments(summed, orders))
        listed = F.sort_array(F.collect_list(F.struct("order", "log_moment")))
        return spread.groupBy("run_id").agg(listed.alias("l"), F.first("fallback").alias("fallback")).select(
            "run_id", F.col("l.log_moment").alias("moments"), "fallback"
        )
    table = pairs.toArrow()
    sigma, q = (np.asarray(table[c]) for c in ("sigma", "q"))
    matrix = np.asarray(table["_moments"].combine_chunks().flatten()).reshape(len(sigma), orders)
    place = {pair: i for i, pair in enumerate(zip(sigma.tolist(), q.tolist()))}
    lists = summed.groupBy("run_id").agg(
        F.collect_list("sigma").alias("sigmas"), F.collect_list("q").alias("qs"),
        F.collect_list("iters").alias("iters"), F.sum(F.col("iters") * single).alias("fallback"),
    )

    def add(batches):
        for batch in batches:
            lengths = np.asarray(batch.column("iters").value_lengths())
            flat = {c: np.asarray(batch.column(c).flatten()) for c in ("sigmas", "qs", "iters")}
            at = np.fromiter(map(place.__getitem__, zip(flat["sigmas"].tolist(), flat["qs"].tolist())), np.int64, len(flat["qs"]))
            ends = np.cumsum(lengths)
            total = np.zeros((len(lengths), orders))
            for low in range(0, len(lengths), COMPOSED_ROWS):
                high = min(low + COMPOSED_ROWS, len(lengths))
                a, b = ends[low] - lengths[low], ends[high - 1]
                row = np.repeat(np.arange(high - low), lengths[low:high])
                np.add.at(total[low:high], row, flat["iters"][a:b, None] * matrix[at[a:b]])
            offsets = np.arange(0, total.size + 1, orders, dtype=np.int32)
            moments = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))
            columns = [batch.column("run_id"), moments, batch.column("fallback")]
            yield pa.RecordBatch.from_arrays(columns, ["run_id", "moments", "fallback"])

    kind = summed.schema["run_id"].dataType.simpleString()
    return lists.mapInArrow(add, f"run_id {kind}, moments array<double>, fallback double")


def compose(moments):
    """Sum over the mechanisms of a run, each counted ``iters`` times.

    ``fallback`` is the release-wise bound that stands in when no order is finite.
    """
    single = F.log(F.col("q")) + F.lit(1.0) / (F.col("sigma") * F.col("sigma"))
    return moments.groupBy("run_id", "order").agg(
        F.sum(F.col("iters") * F.col("log_moment")).alias("log_moment"),
        F.sum(F.col("iters") * single).alias("fallback"),
    )


def _finite(column):
    return ~(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))))


def eps_for_delta(composed, delta):
    """Smallest epsilon over the orders for a target delta (a number or a column)."""
    delta = delta if hasattr(delta, "isNull") else F.lit(float(delta))
    bound = F.when(
        _finite(F.col("log_moment")), (F.col("log_moment") - F.log(delta)) / F.col("order")
    )
    best = F.min(F.when(bound.isNotNull(), F.struct(bound.alias("eps"), F.col("order").alias("o"))))
    return composed.groupBy("run_id").agg(
        F.coalesce(best["eps"], F.first("fallback") - F.log(F.first(delta))).alias("eps"),
        F.first(delta).alias("delta"),
        best["o"].alias("min_lambda"),
    )


def delta_for_eps(composed, eps):
    """Smallest delta over the orders for a target epsilon, at most 1."""
    eps = eps if hasattr(eps, "isNull") else F.lit(float(eps))
    moment = F.col("log_moment")
    usable = _finite(moment) & (moment < F.col("order") * eps)
    bound = F.when(usable, F.exp(moment - F.col("order") * eps))
    best = F.min(F.when(bound < 1.0, F.struct(bound.alias("delta"), F.col("order").alias("o"))))
    any_finite = F.max(F.when(_finite(moment), 1).otherwise(0)) == 1
    fallback = F.exp(F.first("fallback") - F.first(eps))
    return composed.groupBy("run_id").agg(
        F.first(eps).alias("eps"),
        F.when(any_finite, F.coalesce(best["delta"], F.lit(1.0))).otherwise(fallback).alias("delta"),
        best["o"].alias("min_lambda"),
    )


def spent(ledger, delta=TRAINING_DELTA, orders=DEFAULT_ORDERS):
    """Epsilon of every run of a ledger: each row's own moments, so nothing is shuffled by order."""
    delta = delta if hasattr(delta, "isNull") else F.lit(float(delta))
    bound = lambda m, i: F.when(_finite(m), F.struct(
        ((m - F.log(delta)) / (i + 1)).alias("eps"), (i + 1).alias("o"),
    ))
    best = F.array_min(F.array_compact(F.transform("moments", bound)))
    return composed_vectors(ledger, orders).withColumn("_best", best).select(
        "run_id", F.coalesce(F.col("_best.eps"), F.col("fallback") - F.log(delta)).alias("eps"),
        delta.alias("delta"), F.col("_best.o").alias("min_lambda"),
    )


# Rows of a batch, and numbers of a block of terms, that are evaluated together.
COMPOSED_ROWS = 1 << 10
TERM_CELLS = 1 << 20


def block_moments(sigma, q, orders):
    """The same log moments for many mechanisms and all orders: a NumPy matrix, a row per mechanism."""
    sigma, q = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (sigma, q))
    k = np.arange(orders + 1.0)
    o = np.arange(1.0, orders + 1.0)[:, None]
    table = np.array([math.lgamma(i + 1.0) for i in range(orders + 1)])
    inside = k[None, :] <= o
    rest = np.where(inside, o - k[None, :], 0.0)
    ways = np.where(inside, table[1:, None] - table[None, :] - table[rest.astype(int)], -np.inf)
    out, step = np.empty((len(q), orders)), max(1, TERM_CELLS // ways.size)
    for low in range(0, len(q), step):
        part = slice(low, low + step)
        log_in, log_out = np.log(np.maximum(q[part], TINY)), np.log(np.maximum(1.0 - q[part], TINY))
        with np.errstate(over="ignore"):
            c = 0.5 / (sigma[part] * sigma[part])
            lift = log_out[:, None] + np.logaddexp(0.0, (log_in - log_out)[:, None] + 2.0 * k * c[:, None])
            of_k = k * log_in[:, None] + k * (k - 1.0) * c[:, None] + lift
            terms = ways + of_k[:, None, :] + rest * log_out[:, None, None]
            peak = terms.max(axis=2, keepdims=True)
            out[part] = peak[..., 0] + np.log(np.exp(terms - peak).sum(axis=2))
    return out


# The interval in which a noise scale is searched.
SIGMA_LOW, SIGMA_HIGH = 1e-10, 1e10
# Start and growth of the step-wise search.
SIGMA_START, SIGMA_GROWTH = 1e-4, 1.1
SIGMA_STEPS = math.ceil(math.log(SIGMA_HIGH / SIGMA_START, SIGMA_GROWTH))
TARGET = ["eps", "delta", "q", "iters"]


def _searched(targets, search):
    """Run a noise search once per distinct target, whole batches at a time, and join it back."""
    find = F.pandas_udf(
        lambda eps, delta, q, iters: pd.Series(search(*(c.to_numpy() for c in (eps, delta, q, iters)))), "double"
    )
    distinct = targets.select(*TARGET).distinct().repartition(*TARGET)
    columns = [F.col(c).cast("double") for c in TARGET]
    return targets.join(distinct.withColumn("sigma", F.nanvl(find(*columns), F.lit(None))), TARGET)


def calibrate_sigma(targets, orders=DEFAULT_ORDERS, rounds=40):
    """Column ``sigma``: least noise that keeps ``(q, iters, delta)`` within ``eps``.

    Bisection on a log scale, of all targets of a batch at once; the upper end is returned, so the
    target is met.  After 40 rounds the interval is narrower than 1e-10 of sigma.  A search evaluates
    thousands of terms in sequence, so it runs on NumPy matrices inside the tasks.  A target that no
    noise can meet (below -ln(delta) / orders) gets a null.
    """
    o = np.arange(1.0, orders + 1.0)

    def search(eps, delta, q, iters):
        def enough(sigma):
            moments = iters[:, None] * block_moments(sigma, q, orders) - np.log(delta)[:, None]
            return (moments / o).min(axis=1) <= eps

        low, high = np.full(len(q), SIGMA_LOW), np.full(len(q), SIGMA_HIGH)
        met = enough(high)
        for _ in range(rounds):
            mid = np.sqrt(low * high)
            fine = enough(mid)
            low, high = np.where(fine, low, mid), np.where(fine, mid, high)
        return np.where(met, high, np.nan)

    return _searched(targets, search)


def calibrate_sigma_geometric(targets, orders=DEFAULT_ORDERS):
    """Column ``sigma``: first of 1e-4 * 1.1^k whose delta at the target ``eps`` is small enough.

    Delta falls as sigma grows, so the first k is found by halving the range of k, for all targets of
    a batch at once.
    """
    o = np.arange(1.0, orders + 1.0)

    def search(eps, delta, q, iters):
        def enough(k):
            moments = iters[:, None] * block_moments(SIGMA_START * SIGMA_GROWTH**k, q, orders)
            return np.exp(np.minimum(0.0, (moments - o * eps[:, None]).min(axis=1))) <= delta

        low, high = np.zeros(len(q)), np.full(len(q), float(SIGMA_STEPS))
        met = enough(high)
        while (low < high).any():
            k = np.floor((low + high) / 2.0)
            fine = enough(k) | (low == high)
            low, high = np.where(fine, low, k + 1.0), np.where(fine, k, high)
        return np.where(met, SIGMA_START * SIGMA_GROWTH**low, np.nan)

    return _searched(targets, search)


def check_budget(ledger, targets, delta=TRAINING_DELTA, orders=TRAINING_ORDERS):
    """Measured epsilon beside the target; without a target a run is only reported."""
    measured = spent(ledger, delta, orders)
    joined = measured.join(targets.select("run_id", F.col("eps").alias("target_eps")), "run_id", "left")
    return joined.withColumn(
        "accepted", F.coalesce(F.col("eps") <= F.col("target_eps"), F.lit(True))
    )


def eps_curve(sigmas, q, iters, delta=1e-5, orders=DEFAULT_ORDERS):
    """Epsilon as a function of sigma; ``sigmas`` has one row per value."""
    ledger = sigmas.select(
        F.col("sigma").cast("string").alias("run_id"),
        F.col("sigma"),
        F.lit(float(q)).alias("q"),
        F.lit(int(iters)).alias("iters"),
    )
    eps = spent(ledger, delta, orders)
    return eps.select(F.col("run_id").cast("double").alias("sigma"), "eps")


def audit_moments(ledger, orders, nodes=1_000_000, reach=30.0):
    """Both moments of every ledger row by quadrature, beside the closed form.

    The nodes are cut into blocks, so every (row, order, block) is its own unit of work.
    ``e1`` and ``e2`` are the two expectations; the closed form assumes e1 < e2.
    """
    block = 1000
    blocks = -(-nodes // block)
    sigma, q = F.col("sigma"), F.col("q")
    step = (F.lit(1.0) + F.lit(2.0 * reach) * sigma) / F.lit(float(nodes - 1))
    pairs = (
        ledger.select("sigma", "q").distinct()
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .repartition("sigma", "q", "b")
        .withColumn("k", F.explode(F.sequence(
            F.col("b") * block, F.least(F.col("b") * block + block, F.lit(nodes)) - 1
        )))
        .withColumn("z", -F.lit(reach) * sigma + F.col("k") * step)
    )
    log_norm = F.log(sigma) + F.lit(0.5 * math.log(2.0 * math.pi))
    l0 = -F.col("z") * F.col("z") / (2.0 * sigma * sigma) - log_norm
    # ln of mixture over base density: ln(1 - q + q exp((2z - 1) / 2 sigma^2)), without overflow.
    tilt = _ln(q) + (2.0 * F.col("z") - 1.0) / (2.0 * sigma * sigma)
    rest = _ln(F.lit(1.0) - q)
    top = F.greatest(tilt, rest)
    ratio = top + F.log(F.exp(tilt - top) + F.exp(rest - top))
    valued = pairs.select("sigma", "q", l0.alias("l0"), ratio.alias("r"), step.alias("h"))
    at = F.explode(F.array(*[F.lit(int(o)) for o in orders]))
    sums = (
        valued.withColumn("order", at)
        .groupBy("sigma", "q", "order")
        .agg(
            (F.sum(F.exp(F.col("l0") - F.col("order") * F.col("r"))) * F.first("h")).alias("e1"),
            (F.sum(F.exp(F.col("l0") + (F.col("order") + 1) * F.col("r"))) * F.first("h")).alias("e2"),
        )
    )
    table = _log_factorials(max(orders))
    closed = log_moment(sigma, q, F.col("order"), table)
    audited = sums.select(
        "sigma", "q", "order", "e1", "e2",
        F.log(F.greatest("e1", "e2")).alias("log_moment_quadrature"),
        closed.alias("log_moment"),
        (F.col("e1") < F.col("e2")).alias("ordered"),
    )
    return ledger.join(audited, ["sigma", "q"])


def solver_ledger(runs, n, solver):
    """Ledger rows of training runs: sampling rate and number of releases per solver.

    ``runs`` has ``run_id, sigma, lot_ratio, max_iter, K, out_iter``.
    """
    size = F.when(
        F.col("lot_ratio") <= 1, F.greatest(F.lit(1.0), F.ceil(F.col("lot_ratio") * F.lit(n)))
    ).otherwise(F.floor("lot_ratio").cast("double"))
    updates = F.lit(n) * F.col("max_iter")
    base = runs.withColumn("lot_size", F.least(size, updates.cast("double")))
    lots = F.floor(updates / F.col("lot_size"))
    share = F.least(F.lit(1.0), F.col("lot_size") / (F.lit(float(n)) * F.col("K")))
    if solver == "sgd":
        return base.select(
            "run_id", F.lit(0).alias("mech_id"), "sigma",
            (F.col("lot_size") / F.lit(float(n))).alias("q"), lots.alias("iters"),
        )
    if solver == "dual_parallel":
        return base.select(
            "run_id", F.lit(0).alias("mech_id"), "sigma", share.alias("q"), lots.alias("iters")
        )
    if solver == "dual_sequential":
        return base.select(
            "run_id", F.lit(0).alias("mech_id"), "sigma", share.alias("q"),
            (F.col("K") * F.col("out_iter") * lots).alias("iters"),
        )
    if solver == "cocoa":
        # One entry per outer round and part; a part's own size sets its lot and its rate.
        part = F.sequence(F.lit(0), F.col("K") - 1)
        rounds = F.explode(F.sequence(F.lit(0), F.col("out_iter") - 1))
        small = F.floor(F.lit(n) / F.col("K"))
        own = small + F.when(F.col("_part") < F.lit(n) % F.col("K"), 1).otherwise(0)
        ratio = F.col("lot_ratio")
        own_lot = F.when(ratio <= 1, F.greatest(F.lit(1.0), F.ceil(ratio * F.col("own")))).otherwise(
            F.floor(ratio).cast("double")
        )
        own_updates = (F.col("own") * F.col("max_iter")).cast("double")
        return (
            runs.withColumn("round", rounds)
            .withColumn("_part", F.explode(part))
            .withColumn("own", own)
            .withColumn("lot_size", F.least(own_lot, own_updates))
            .select(
                "run_id",
                (F.col("round") * F.col("K") + F.col("_part")).alias("mech_id"),
                "sigma",
                (
                    F.least(F.lit(1.0), F.col("lot_size") / (F.col("own") * F.col("K")))
                    * F.col("own") / F.lit(float(n))
                ).alias("q"),
                (F.col("K") * F.col("out_iter") * F.floor(own_updates / F.col("lot_size"))).alias("iters"),
            )
        )
    raise ValueError(f"unknown solver {solver!r}")
