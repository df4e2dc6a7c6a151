"""Training against plain NumPy re-computations on a small table, and the laws that must hold."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions.tasks import task_of
from lotwise.operators import objective
from lotwise.operators.encode import to_sparse
from lotwise.plans.cocoa import part_sizes
from lotwise.plans.fit import fit, fit_grid
from lotwise.plans.params import RunParams, param_grid

LAM = 0.05


def digest(key):
    return hashlib.md5(key.encode()).hexdigest()


def order(n, key):
    return sorted(range(n), key=lambda i: (digest(f"{key}|{i}"), i))


def uniform(key):
    return (int(digest(key)[:12], 16) + 0.5) / 2.0**48


def normal(key):
    radius = math.sqrt(-2 * math.log(uniform(key + "|r")))
    return radius * math.cos(2 * math.pi * uniform(key + "|t"))


def joined(n, size, total, seed, i):
    """Lots that a row joins: keyed geometric skips, anew in every block of an epoch's lots."""
    block, rate, found = -(-n // size), min(1.0, size / n), set()

    def skip(b, j):
        return math.floor(math.log(uniform(f"{seed}|skip|{b}|{i}|{j}")) / math.log(1 - rate)) if rate < 1 else 0

    for b in range(-(-total // block)):
        j, at = 0, skip(b, 0)
        while at < block:
            found.add(b * block + at)
            j += 1
            at += 1 + skip(b, j)
    return {t for t in found if t < total}


def lots(n, size, epochs, seed, mode, apart=False):
    """``apart``: lots end with their epoch, as in private runs."""
    stream = [i for e in range(epochs) for i in order(n, f"{seed}|{e}")[: n - n % size if apart else n]]
    total = n * epochs // size if mode == "poisson" else len(stream) // size
    joins = {i: joined(n, size, total, seed, i) for i in range(n)} if mode == "poisson" else {}
    for t in range(total):
        if mode == "poisson":
            yield t, [i for i in range(n) if t in joins[i]]
        else:
            yield t, stream[t * size : (t + 1) * size]


def dual(task, x, y, size, epochs, seed, mode="exact", clip=0.0, noise=0.0, lam=LAM, key=""):
    n, m = x.shape
    alpha, w = np.zeros(n), np.zeros(m)
    for t, rows in lots(n, size, epochs, seed, mode, apart=noise > 0):
        z, sq = x[rows] @ w, (x[rows] ** 2).sum(axis=1)
        d = task.block_delta(z, y[rows], alpha[rows], sq, lam * n, float(size))
        if clip:
            d = d / np.maximum(1, np.abs(d) / clip)
        move = d @ x[rows]
        if noise:
            move += noise * np.array([normal(f"{key}|w|{t}|{i}") for i in range(m)])
            for i in set(rows):
                alpha[i] += noise * normal(f"{key}|a|{t}|{i}")
        w = w + move
        np.add.at(alpha, rows, d)
    return w, alpha


def alphas(result, n, run=0):
    got = {r["row_id"]: r["alpha"] for r in result.alpha[run].collect()}
    return np.array([got[i] for i in range(n)])


@pytest.mark.parametrize("task", ["ridge", "logistic", "hinge"])
@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_dual_parallel(small, task, mode):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=0.3, max_iter=3, seed="s")
    got = fit(df, task, "PSCD", run, fit_intercept=False, mode=mode)
    w, alpha = dual(task_of(task), x, y, 18, 3, "s", mode)
    np.testing.assert_allclose(got.shared[0], w, atol=1e-10)
    np.testing.assert_allclose(alphas(got, 60), alpha, atol=1e-10)
    np.testing.assert_allclose(x.T @ alpha, w, atol=1e-10)
    np.testing.assert_allclose(got.coef[0], w / (LAM * 60), atol=1e-10)


def test_private_dual_adds_the_stated_noise(small):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=0.3, max_iter=2, seed="s", sigma=1.3, clip=0.2)
    got = fit(df, "ridge", "PSCD", run, fit_intercept=False)
    scale = 1.3 * math.sqrt(2 * 0.2**2)
    key = run.noise_key("dual_parallel", "ridge")
    w, alpha = dual(task_of("ridge"), x, y, 18, 2, "s", "poisson", 0.2, scale, key=key)
    np.testing.assert_allclose(got.shared[0], w, atol=1e-9)
    np.testing.assert_allclose(alphas(got, 60), alpha, atol=1e-9)
    ledger = got.ledger.first()
    assert (ledger["q"], ledger["iters"], ledger["sigma"]) == (18 / 60, 6, 1.3)


def test_sgd(small):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=0.3, max_iter=2, seed="s", clip=0.4, gamma=0.7)
    for name in ("ridge", "logistic", "hinge"):
        got = fit(df, name, "SGD", run, fit_intercept=False)
        task, w = task_of(name), np.zeros(5)
        for _, rows in lots(60, 18, 2, "s", "exact"):
            g = task.block_factor(x[rows] @ w, y[rows])[:, None] * x[rows]
            g /= np.maximum(1, np.linalg.norm(g, axis=1, keepdims=True) / 0.4)
            w = w - 0.7 * (g.sum(axis=0) + LAM * w) / 18
        np.testing.assert_allclose(got.coef[0], w, atol=1e-10)


def cocoa(task, x, y, k, rounds, passes, ratio, seed, gamma=1.0, clip=0.0):
    n, m = x.shape
    edges = np.concatenate(([0], np.cumsum(part_sizes(n, k))))
    ranked = order(n, seed)
    parts = [ranked[a:b] for a, b in zip(edges, edges[1:])]
    alpha, w = np.zeros(n), np.zeros(m)
    for t in range(rounds):
        total, start = np.zeros(m), alpha.copy()
        for rows in parts:
            if not rows:
                continue
            view, local = w.copy(), start.copy()
            size = max(1, math.ceil(ratio * len(rows)))
            updates = len(rows) * passes
            updates -= updates % size
            stream = [
                i for p in range(passes)
                for i in sorted(rows, key=lambda i: digest(f"{seed}|order|{t}|{p}|{i}"))
            ]
            for i in stream[:updates]:
                d = float(task.block_delta(view @ x[i], y[i], local[i], x[i] @ x[i], LAM * n, float(k)))
                if clip:
                    d /= max(1, abs(d) / clip)
                view += k * d * x[i]
                local[i] += d
            alpha[rows] = start[rows] + gamma * (local[rows] - start[rows])
            total += (view - w) / k
        w = w + gamma * total
    return w, alpha


@pytest.mark.parametrize("task,k,passes,ratio,gamma", [
    ("ridge", 1, 1, 1.0, 1.0), ("hinge", 4, 1, 0.5, 1.0), ("logistic", 7, 2, 0.4, 0.5),
])
def test_cocoa(small, task, k, passes, ratio, gamma):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=ratio, max_iter=passes, out_iter=3, k=k, seed="s",
                    gamma=gamma)
    got = fit(df, task, "COCOA", run, fit_intercept=False)
    w, alpha = cocoa(task_of(task), x, y, k, 3, passes, ratio, "s", gamma)
    np.testing.assert_allclose(got.shared[0], w, atol=1e-9)
    np.testing.assert_allclose(alphas(got, 60), alpha, atol=1e-9)
    np.testing.assert_allclose(x.T @ alpha, w, atol=1e-9)


def test_more_parts_than_rows(spark):
    rows = [(i, 1.0 if i % 2 else -1.0, [1.0, float(i)]) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id bigint, y double, features array<double>")
    run = RunParams(lambda_=LAM, max_iter=1, out_iter=2, k=8, seed="s")
    assert np.isfinite(fit(df, "ridge", "COCOA", run, fit_intercept=False).coef[0]).all()


def test_sequential_equals_one_part(small):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=2, seed="s")
    got = fit(df, "ridge", "SSCD", run, fit_intercept=False)
    w, alpha = cocoa(task_of("ridge"), x, y, 1, 1, 2, 0.5, "s")
    np.testing.assert_allclose(got.shared[0], w, atol=1e-9)
    np.testing.assert_allclose(alphas(got, 60), alpha, atol=1e-9)


def test_private_cocoa_repeats_itself(small):
    df, _, _ = small
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=1, out_iter=2, k=3, seed="s", sigma=0.5, clip=0.1)
    one = fit(df, "ridge", "COCOA", run, fit_intercept=False)
    two = fit(df.repartition(7), "ridge", "COCOA", run, fit_intercept=False)
    np.testing.assert_allclose(one.coef[0], two.coef[0], atol=1e-12)


@pytest.mark.parametrize("solver", ["PSCD", "SGD", "COCOA"])
def test_sparse_layout_equals_dense(small, solver):
    df, _, _ = small
    k = 3 if solver == "COCOA" else 1
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=1, out_iter=2, k=k, seed="s")
    dense = fit(df, "logistic", solver, run)
    sparse = fit(to_sparse(df), "logistic", solver, run)
    np.testing.assert_allclose(sparse.coef[0], dense.coef[0], atol=1e-10)
    a, b = dense.evaluate(df).first(), sparse.evaluate(to_sparse(df)).first()
    assert a["loss"] == pytest.approx(b["loss"]) and a["tp"] == b["tp"]


def test_partitioning_does_not_matter(small):
    df, _, _ = small
    run = RunParams(lambda_=LAM, lot_ratio=0.3, max_iter=1, seed="s", sigma=1.0, clip=0.2)
    models = [
        fit(df.repartition(p), "hinge", "PSCD", run, fit_intercept=False).coef[0] for p in (1, 16)
    ]
    np.testing.assert_allclose(models[0], models[1], atol=1e-10)


def test_grid_equals_single_runs(spark, small):
    df, _, _ = small
    runs = param_grid(spark, **{"lambda": [0.05, 0.5], "lot_ratio": [0.5, 0.25], "max_iter": [2], "C": [0.3]})
    assert runs.count() == 4
    got = fit_grid(df, runs, "logistic", "PSCD", fit_intercept=False)
    for run in got.runs:
        alone = fit(df, "logistic", "PSCD", run, fit_intercept=False)
        np.testing.assert_allclose(got.coef[run.run_id], alone.coef[run.run_id], atol=1e-12)
        np.testing.assert_allclose(alphas(got, 60, run.run_id), alphas(alone, 60, run.run_id), atol=1e-12)


@pytest.mark.parametrize("task", ["ridge", "logistic", "hinge"])
def test_gap_is_positive_and_falls(small, task):
    df, _, _ = small
    gaps = []
    for epochs in (1, 6):
        run = RunParams(lambda_=LAM, lot_ratio=0.2, max_iter=epochs, seed="s")
        got = fit(df, task, "PSCD", run, fit_intercept=False)
        rows = df.join(got.alpha[0], "row_id")
        row = objective.duality_gap(rows, LAM, task).first()
        assert row["primal_objective"] + row["dual_objective"] >= -1e-12
        gaps.append(row["gap"])
    assert gaps[1] < gaps[0]


def test_intercept_is_the_first_coefficient(small):
    df, _, _ = small
    got = fit(df, "ridge", "PSCD", RunParams(lambda_=LAM, max_iter=1, lot_ratio=1.0))
    assert got.coef[0].shape == (6,)
    z = {r["row_id"]: r["z"] for r in got.scores(df).collect()}
    first = df.orderBy("row_id").first()
    assert z[first["row_id"]] == pytest.approx(got.coef[0][0] + np.dot(first["features"], got.coef[0][1:]))


def test_trace_and_stopping(small):
    df, _, _ = small
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=3, gamma=60.0)
    got = fit(df, "ridge", "SGD", run, fit_intercept=False, validation=df, trace=True)
    trace = got.trace_frame().orderBy("epoch").collect()
    assert trace[-1]["status"] == "stopped" and trace[-1]["mse"] > 3 * trace[0]["mse"]
    calm = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=2)
    trace = fit(df, "ridge", "PSCD", calm, fit_intercept=False, validation=df, trace=True).trace
    assert [t[1] for t in trace] == [0, 1, 2] and trace[-1][-2] == "complete"
    assert trace[2][2] < trace[0][2]


def test_primal_coordinates(small):
    df, x, y = small
    run = RunParams(lambda_=LAM, max_iter=4, gamma=-1)
    theta = fit(df, "ridge", "primal_cd", run, fit_intercept=False).coef[0]
    best = np.linalg.solve(x.T @ x + LAM * 60 * np.eye(5), x.T @ y)
    cost = lambda t: ((x @ t - y) ** 2).sum() + LAM * 60 * (t @ t)
    assert cost(best) <= cost(theta) < 0.5 * (cost(np.zeros(5)) + cost(best))
    with pytest.raises(ValueError):
        fit(df, "hinge", "primal_cd", run, fit_intercept=False)


def test_target_epsilon_sets_the_noise(small):
    df, _, _ = small
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=1, eps=2.0, clip=0.2, seed="s")
    got = fit(df, "ridge", "PSCD", run, fit_intercept=False)
    from lotwise.operators.privacy import spent

    assert spent(got.ledger, 1e-3, 128).first()["eps"] == pytest.approx(2.0, abs=1e-6)


@pytest.mark.parametrize("changes", [
    {"sigma": 1.0, "clip": 0.0}, {"sigma": 1.0, "clip": -1}, {"lambda_": 0.0}, {"lot_ratio": 61},
    {"sigma": 1.0, "clip": 0.2, "seed": "1"}, {"k": 4},
])
def test_bad_parameters_are_refused(small, changes):
    df, _, _ = small
    run = RunParams(**{"lambda_": LAM, "max_iter": 2, "seed": "s", **changes})
    with pytest.raises(ValueError):
        fit(df, "ridge", "PSCD", run, fit_intercept=False)


def test_private_rows_must_be_short(small):
    df, _, _ = small
    long = df.withColumn("features", F.transform("features", lambda v: v * 2.0))
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=1, sigma=1.0, clip=0.2, seed="s")
    with pytest.raises(ValueError):
        fit(long, "ridge", "PSCD", run, fit_intercept=False)
    with pytest.raises(ValueError):
        fit(df, "ridge", "SIMPLEX", run)


@pytest.mark.parametrize("mode", ["exact", "poisson"])
@pytest.mark.parametrize("cells", [1, 10])
def test_segments_within_an_epoch_give_the_same_result(small, monkeypatch, mode, cells):
    """Models in flight beyond the bound: more rewrites per epoch, equal numbers."""
    from lotwise.plans import lots as lots_module

    monkeypatch.setattr(lots_module, "MODEL_CELLS", cells)
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=0.3, max_iter=2, seed="s", sigma=0.4, clip=0.3)
    got = fit(df, "hinge", "PSCD", run, fit_intercept=False, mode=mode)
    scale = 0.4 * math.sqrt(2 * 0.3**2)
    key = run.noise_key("dual_parallel", "hinge")
    w, alpha = dual(task_of("hinge"), x, y, 18, 2, "s", mode, 0.3, scale, key=key)
    np.testing.assert_allclose(got.shared[0], w, atol=1e-9)
    np.testing.assert_allclose(alphas(got, 60), alpha, atol=1e-9)


def test_wide_grids_are_trained_in_chunks(spark, small, monkeypatch):
    from lotwise.plans import fit as fit_module

    df, _, _ = small
    runs = param_grid(spark, **{"lambda": [0.05, 0.1, 0.5], "lot_ratio": [0.5], "max_iter": [1]})
    whole = fit_grid(df, runs, "ridge", "SGD", fit_intercept=False)
    monkeypatch.setattr(fit_module, "MODEL_CELLS", 10)
    chunked = fit_grid(df, runs, "ridge", "SGD", fit_intercept=False)
    for run_id, coef in whole.coef.items():
        np.testing.assert_allclose(chunked.coef[run_id], coef, atol=1e-12)


def test_sequential_training_takes_the_parts_it_is_given(small):
    df, x, y = small
    run = RunParams(lambda_=LAM, max_iter=1, seed="s", k=3)
    got = fit(df, "ridge", "SSCD", run, fit_intercept=False)
    w, _ = cocoa(task_of("ridge"), x, y, 3, 1, 1, 1.0, "s")
    np.testing.assert_allclose(got.shared[0], w, atol=1e-9)


@pytest.mark.parametrize("ratio", [7, 25, 45, 60])
def test_lots_span_epochs_and_leave_no_row_out(small, ratio):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=ratio, max_iter=3, seed="s")
    got = fit(df, "ridge", "PSCD", run, fit_intercept=False)
    w, alpha = dual(task_of("ridge"), x, y, ratio, 3, "s")
    np.testing.assert_allclose(got.shared[0], w, atol=1e-10)
    np.testing.assert_allclose(alphas(got, 60), alpha, atol=1e-10)
    np.testing.assert_allclose(x.T @ alpha, w, atol=1e-10)


@pytest.mark.parametrize("skip", [0, 3, 6])
@pytest.mark.parametrize("few", [0, 64])
def test_slices_after_skipped_rows(spark, monkeypatch, skip, few):
    from lotwise.operators import split

    monkeypatch.setattr(split, "FEW_LOTS", few)
    df = spark.range(200).withColumnRenamed("id", "row_id")
    got = {r["row_id"]: r["lot"] for r in split.slice_lots(df, 7, 200, "s", 1, skip=skip).collect()}
    whole = (200 - skip) // 7
    for place, i in enumerate(order(200, "s|1")):
        lot = (place - skip) // 7
        assert got[i] == (lot if 0 <= lot < whole else -1)


@pytest.mark.parametrize("k", [1, 4, 16])
def test_cocoa_noise_has_its_stated_size(small, k):
    """The shared vector's noise is the sum of the parts' draws, at any number of parts."""
    df, _, _ = small
    wide = df.withColumn("features", F.concat("features", F.array(*[F.lit(0.0)] * 395)))
    common = dict(lambda_=LAM, lot_ratio=1.0, max_iter=1, k=k, clip=0.1, seed="s")
    noisy = fit(wide, "ridge", "COCOA", RunParams(sigma=1.0, **common), fit_intercept=False)
    plain = fit(wide, "ridge", "COCOA", RunParams(**common), fit_intercept=False)
    drawn = (noisy.shared[0] - plain.shared[0])[5:]
    stated = math.sqrt(sum((4 * size**2 - 2) * 0.1**2 for size in part_sizes(60, k)))
    assert drawn.std() == pytest.approx(stated, rel=0.15)


def test_runs_do_not_share_noise(small):
    df, _, _ = small
    wide = df.withColumn("features", F.concat("features", F.array(*[F.lit(0.0)] * 395)))
    draws = []
    for changes in ({"lot_ratio": 1.0}, {"lot_ratio": 0.5}, {"lot_ratio": 1.0, "run_id": 1}, {"lot_ratio": 1.0, "lambda_": 0.1}):
        run = RunParams(**{"lambda_": LAM, "max_iter": 1, "sigma": 1.0, "clip": 0.1, "seed": "s", **changes})
        draws.append(fit(wide, "ridge", "SGD", run, fit_intercept=False).coef[run.run_id][5:])
    assert np.abs(np.corrcoef(draws) - np.eye(4)).max() < 0.2


def test_primal_coordinates_refuse_noise(small):
    df, _, _ = small
    with pytest.raises(ValueError):
        fit(df, "ridge", "primal_cd", RunParams(sigma=1.0, clip=0.1, seed="s"), fit_intercept=False)


def test_stopped_runs_keep_their_shared_vector(small):
    df, x, _ = small
    run = RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=4, seed="s", gamma=40.0, sigma_p=1.0)
    got = fit(df, "ridge", "PSCD", run, fit_intercept=False, validation=df, trace=True)
    assert got.trace[-1][-2] == "stopped"
    np.testing.assert_allclose(x.T @ alphas(got, 60), got.shared[0], rtol=1e-9)


def test_private_training_with_an_intercept(small):
    df, x, y = small
    run = RunParams(lambda_=LAM, lot_ratio=1.0, max_iter=1, seed="s", sigma=1e-9, clip=5.0)
    got = fit(df, "ridge", "PSCD", run, mode="exact")
    rows = np.hstack((np.ones((60, 1)), x)) * math.sqrt(0.5)
    w, _ = dual(task_of("ridge"), rows, y, 60, 1, "s", clip=5.0)
    np.testing.assert_allclose(got.coef[0], math.sqrt(0.5) * w / (LAM * 60), atol=1e-6)
    mixed = [run, RunParams(run_id=1, lambda_=LAM, lot_ratio=1.0, max_iter=1, seed="s")]
    from lotwise.plans.fit import fit_runs

    both = fit_runs(df, "ridge", "PSCD", mixed, mode="exact")
    alone = fit(df, "ridge", "PSCD", mixed[1], mode="exact")
    np.testing.assert_allclose(both.coef[1], alone.coef[1], atol=1e-12)


def test_many_lots_per_epoch(small):
    """More lots than can be told apart by their last keys alone."""
    from lotwise.operators import split

    df, x, y = small
    many = df.unionByName(df.withColumn("row_id", F.col("row_id") + 60))
    assert 120 // 1 > split.FEW_LOTS
    sizes = split.slice_lots(many, 1, 120, "s", 0).groupBy("lot").count().collect()
    assert sorted(r["lot"] for r in sizes) == list(range(120)) and {r["count"] for r in sizes} == {1}


@pytest.mark.parametrize("size, steps", [(1, range(0, 130)), (13, range(3, 21)), (60, range(0, 3)), (200, range(7, 8))])
def test_skips_over_lots(spark, monkeypatch, size, steps):
    """Rows that join more lots than the first stretch holds go on; ranges of lots do not change them."""
    from lotwise.operators import split

    df = spark.range(200).select(F.col("id").alias("row_id"))
    want = {i: sorted(t for t in joined(200, size, steps.stop, "s", i) if t >= steps.start) for i in range(200)}
    for first in (24, 1):
        monkeypatch.setattr(split, "FIRST_SKIPS", first)
        got = {r.row_id: r.lots for r in split.poisson_lots(df, size, 200, steps, "s").collect()}
        assert got == want
    share = sum(map(len, want.values())) / (200 * len(steps))
    assert share == pytest.approx(size / 200, abs=4 * math.sqrt(size / 200 / (200 * len(steps))) + 1e-9)


@pytest.mark.parametrize("solver", ["PSCD", "SGD"])
def test_training_goes_on_from_an_earlier_result(small, solver):
    from lotwise.plans.fit import fit_runs

    df, x, _ = small
    runs = [RunParams(run_id=i, lambda_=LAM, lot_ratio=ratio, max_iter=1, seed="s") for i, ratio in enumerate((0.5, 0.5, 0.3))]
    first = fit_runs(df, "ridge", solver, runs, fit_intercept=False)
    again = fit_runs(df, "ridge", solver, runs, fit_intercept=False, start=first)
    for run in runs:
        alone = fit(df, "ridge", solver, run, fit_intercept=False)
        np.testing.assert_allclose(
            fit(df, "ridge", solver, run, fit_intercept=False, start=alone).shared[run.run_id], again.shared[run.run_id], atol=1e-12
        )
        assert not np.allclose(again.shared[run.run_id], first.shared[run.run_id])
    if solver == "PSCD":
        np.testing.assert_allclose(x.T @ alphas(again, 60, 2), again.shared[2], atol=1e-9)
    with pytest.raises(ValueError):
        fit(df, "ridge", solver, RunParams(run_id=7, lambda_=LAM, lot_ratio=0.5, max_iter=1), fit_intercept=False, start=first)


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_searched_steps_never_raise_the_dual(small, mode):
    df, x, y = small
    costs = []
    for epochs in (1, 2, 3):
        run = RunParams(lambda_=LAM, lot_ratio=0.4, max_iter=epochs, seed="s", gamma=-1)
        got = fit(df, "ridge", "PSCD", run, fit_intercept=False, mode=mode)
        a = alphas(got, 60)
        np.testing.assert_allclose(x.T @ a, got.shared[0], atol=1e-9)
        costs.append(0.5 * a @ a - a @ y + got.shared[0] @ got.shared[0] / (2 * LAM * 60))
    assert costs[0] > costs[1] > costs[2] and costs[0] < 0
    for refused in (("hinge", "PSCD", {}), ("ridge", "SGD", {}), ("ridge", "PSCD", {"sigma": 1.0, "clip": 0.1, "seed": "q"})):
        with pytest.raises(ValueError):
            run = RunParams(**{"lambda_": LAM, "lot_ratio": 0.4, "max_iter": 1, "seed": "s", "gamma": -1, **refused[2]})
            fit(df, refused[0], refused[1], run, fit_intercept=False)
