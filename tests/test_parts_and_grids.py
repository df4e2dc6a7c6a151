"""CoCoA's bucketed parts, resumable grids, and lots of private runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions.tasks import TASKS, task_of
from lotwise.operators.encode import to_sparse
from lotwise.operators.split import assign_partitions
from lotwise.plans import cocoa as cocoa_plan
from lotwise.plans.cocoa import LocalSolver, PartTable, part_sizes, round_frame, train_cocoa
from lotwise.plans.fit import GridLog, fit, fit_grid, fit_runs
from lotwise.plans.lots import LotPlan, training_table
from lotwise.plans.params import RunParams, param_grid
from lotwise.sources.scratch import scratch_path

LAM = 0.05


@pytest.mark.parametrize("name", sorted(TASKS))
def test_steps_of_one_row_and_of_a_block_agree(name):
    task, rng = task_of(name), np.random.default_rng(2)
    for _ in range(300):
        z, alpha, sq = rng.normal(0, 5), rng.uniform(-1, 1), rng.choice([0.0, 1e-9, 0.5, 1.0, 4.0])
        y, z = rng.choice([-1.0, 1.0]), z * (sq > 0)  # a row without features scores 0
        one = task.step(z, y, alpha, sq, 3.0, 2.0)
        assert one == pytest.approx(float(task.block_delta(z, y, alpha, sq, 3.0, 2.0)), abs=1e-12)


def test_a_round_exchanges_nothing(small):
    df, _, _ = small
    table = training_table(df)
    parts = PartTable(table, 5, "s")
    work = LocalSolver(task_of("ridge"), np.zeros(5), LAM * 60, 5.0, np.inf, 1.0, [12] * 5, 2, [], (), 5)
    state, _ = parts.written(round_frame(parts, None, work, "s", None, 0, 2), "round")
    again = round_frame(parts, state, work, "s", None, 1, 2)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    parts_of = parts.rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("part").alias("n"), F.count("*").alias("rows"))
    assert sorted((r.n, r.rows) for r in parts_of.collect()) == [(1, 12)] * 5
    parts.forget()


@pytest.mark.parametrize("rows, cells", [(64, 1 << 20), (7, 1 << 20), (64, 10)])
@pytest.mark.parametrize("layout", ["dense", "sparse"])
def test_blocks_do_not_change_the_steps(small, monkeypatch, rows, cells, layout):
    df, x, _ = small
    frame = to_sparse(df) if layout == "sparse" else df
    table = training_table(frame)
    run = RunParams(lambda_=LAM, lot_ratio=0.3, max_iter=3, seed="s", clip=0.4)
    want, _ = train_cocoa(training_table(df), task_of("logistic"), run, 4, 2)
    monkeypatch.setattr(cocoa_plan, "BLOCK_ROWS", rows)
    monkeypatch.setattr(cocoa_plan, "BLOCK_CELLS", cells)
    got, alpha = train_cocoa(table, task_of("logistic"), run, 4, 2)
    np.testing.assert_allclose(got, want, atol=1e-11)
    values = np.array([r.alpha for r in alpha.orderBy("row_id").collect()])
    np.testing.assert_allclose(x.T @ values, got, atol=1e-9)


def test_noisy_lots_end_with_their_pass(small):
    solver = LocalSolver(task_of("ridge"), np.zeros(5), 1.0, 2.0, 1.0, 1.0, [7, 7], 3, [0.5, 0.5], (), 5)
    plain = LocalSolver(task_of("ridge"), np.zeros(5), 1.0, 2.0, 1.0, 1.0, [7, 7], 3, [], (), 5)
    assert solver._updates(0, 18) == [14, 14, 14] and plain._updates(0, 18) == [18, 18, 13]
    block = type("B", (), {"cells_of_row": lambda self: 5})()
    ends = [(len(rows), last) for rows, last in solver._blocks(block, np.arange(14), 0)]
    assert ends == [(7, True), (7, True)]


def test_parts_too_large_for_a_task_are_refused(small, monkeypatch):
    df, _, _ = small
    monkeypatch.setattr(cocoa_plan, "PART_CELLS", 100)
    run = RunParams(lambda_=LAM, max_iter=1, seed="s", k=2)
    for frame in (df, to_sparse(df)):
        with pytest.raises(ValueError, match="K must be at least"):
            fit(frame, "ridge", "COCOA", run, fit_intercept=False)
    assert fit(df, "ridge", "COCOA", RunParams(lambda_=LAM, max_iter=1, seed="s", k=3), fit_intercept=False).coef


@pytest.mark.parametrize("n, k", [(200, 1), (200, 7), (203, 200), (5, 9)])
def test_parts_follow_the_order_of_keys(spark, n, k):
    from test_training import order

    df = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("features"))
    got = {r.row_id: r.part for r in assign_partitions(df, k, "s").collect()}
    want = np.repeat(np.arange(k), part_sizes(n, k))
    assert [got[i] for i in order(n, "s")] == want.tolist()


@pytest.mark.parametrize("n, size, epochs", [(100, 60, 3), (60, 18, 2), (60, 60, 2), (60, 7, 3)])
def test_no_row_is_twice_in_a_lot_of_a_private_run(spark, n, size, epochs):
    """Adding or removing a row then moves a lot's sum by one clipped step: over all rows and lots."""
    df = spark.range(n).select(F.col("id").alias("row_id"))
    plan, seen = LotPlan(n, size, epochs, "exact", apart=True), {}
    for segment in plan.segments(1, 1):
        for row in plan.assign(df, segment, "s").collect():
            for lot in row.lots:
                seen.setdefault(lot, []).append(row.row_id)
    assert sorted(seen) == list(range(epochs * (n // size)))
    assert all(len(rows) == size == len(set(rows)) for rows in seen.values())
    for epoch in range(epochs):
        rows = [i for lot in range(epoch * plan.per_epoch, (epoch + 1) * plan.per_epoch) for i in seen[lot]]
        assert len(rows) == len(set(rows))
    assert [plan.ended(lot) for lot in range(plan.total)][plan.per_epoch - 1 :: plan.per_epoch] == list(range(1, epochs + 1))


def _runs(spark):
    grid = param_grid(spark, **{"lambda": [0.1, 0.2], "lot_ratio": [0.5], "max_iter": [2], "seed": [5]})
    alone = param_grid(spark, **{"lambda": [0.3], "lot_ratio": [0.25], "max_iter": [1], "seed": [5]})
    bad = param_grid(spark, sigma=[1.0], seed=[6])  # noise without a clipping bound
    return grid.unionByName(alone.withColumn("run_id", F.lit(2).cast("bigint"))).unionByName(
        bad.withColumn("run_id", F.lit(3).cast("bigint"))
    )


def test_one_infeasible_run_among_four(small, spark):
    df, _, _ = small
    runs = _runs(spark)
    with pytest.raises(ValueError):
        fit_grid(df, runs, "ridge", "PSCD", fit_intercept=False)
    got = fit_grid(df, runs, "ridge", "PSCD", fit_intercept=False, keep_going=True)
    assert sorted(got.coef) == [0, 1, 2] and [t[0] for t in got.trace] == [3]
    assert got.trace[0][-2] == "stopped" and "clipping" in got.trace[0][-1]
    assert got.evaluate(df).count() == 3
    unreachable = RunParams(run_id=9, lambda_=LAM, lot_ratio=0.5, max_iter=1, clip=0.1, eps=1e-9, seed="s")
    mixed = fit_runs(df, "ridge", "PSCD", [unreachable, RunParams(lambda_=LAM, lot_ratio=0.5, max_iter=1)], keep_going=True)
    assert sorted(mixed.coef) == [0] and mixed.trace[0][0] == 9 and "epsilon" in mixed.trace[0][-1]


@pytest.mark.parametrize("solver", ["PSCD", "SGD", "primal_cd"])
def test_a_grid_goes_on_from_its_log(small, spark, solver):
    df, _, _ = small
    runs, log = _runs(spark), scratch_path(spark, "grid")
    options = dict(fit_intercept=False, log=log)
    first = fit_grid(df, runs.where("run_id in (0, 3)"), "ridge", solver, **options)
    assert sorted(first.coef) == [0]
    # A run that was interrupted: its lines are open, so it is trained again.
    book = GridLog(spark, log)
    book.attempt = 1
    book([(1, 0, 9.0, None, None, 0.0, "running", None), (1, 1, 9.0, None, None, 0.0, "running", None)], {})
    got = fit_grid(df, runs, "ridge", solver, **options)
    whole = fit_grid(df, runs, "ridge", solver, fit_intercept=False, keep_going=True)
    assert sorted(got.coef) == sorted(whole.coef) == [0, 1, 2] and [r.run_id for r in got.runs] == [0, 1, 2]
    for run in (0, 1, 2):
        np.testing.assert_allclose(got.coef[run], whole.coef[run], atol=1e-12)
    lines = {(t[0], t[1]): t for t in got.trace}
    assert sorted(lines) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]
    assert all(t[-2] == ("running" if (t[0], t[1]) in ((0, 0), (0, 1), (1, 0), (1, 1), (2, 0)) else "stopped" if t[0] == 3 else "complete") for t in lines.values())
    again = fit_grid(df, runs, "ridge", solver, **options)
    assert again.trace == got.trace and sorted(again.coef) == [0, 1, 2] and not again.alpha
    assert got.evaluate(df).orderBy("run_id").collect() == again.evaluate(df).orderBy("run_id").collect()
