"""The ledger against known values and its own laws."""

import pytest

from lotwise.operators import privacy

SCHEMA = "run_id int, mech_id int, sigma double, q double, iters int"
# Sigma, q, releases, delta, orders, epsilon, best order.
GOLDEN = [
    (1.0, 0.01, 1000, 1e-5, 32, 2.538347545459, 7),
    (4.0, 0.01, 10000, 1e-5, 32, 1.258574741253, 19),
    (2.0, 0.001, 1000, 1e-3, 128, 0.138135333144, 53),
    (0.5, 0.01, 100, 1e-3, 128, 7.442305510417, 1),
    (10.0, 1.0, 10, 1e-3, 128, 1.225646273248, 12),
    (8.0, 0.0028753, 17389, 1e-3, 128, 0.178299197987, 78),
]


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize("orders", [32, 128])
def test_golden_values(spark, orders):
    cases = [c for c in GOLDEN if c[4] == orders]
    rows = ledger(spark, *[(i, 0, s, q, t) for i, (s, q, t, *_) in enumerate(cases)])
    got = {r["run_id"]: r for r in privacy.spent(rows, cases[0][3], orders).collect()}
    for i, (*_, eps, order) in enumerate(cases):
        assert got[i]["eps"] == pytest.approx(eps, abs=1e-10)
        assert got[i]["min_lambda"] == order


def test_block_moments_equal_the_column_form(spark):
    rows = ledger(spark, (0, 0, 0.7, 0.05, 1), (1, 0, 3.0, 1.0, 1), (2, 0, 1e-4, 0.3, 1))
    for r in privacy.log_moments(rows, 16).collect():
        block = privacy.block_moments(r["sigma"], r["q"], 16)[0]
        assert r["log_moment"] == pytest.approx(block[r["order"] - 1], rel=1e-12)


def test_composition_and_monotony(spark):
    rows = ledger(
        spark,
        (0, 0, 2.0, 0.1, 30), (0, 1, 2.0, 0.1, 70), (1, 0, 2.0, 0.1, 100),
        (2, 0, 4.0, 0.1, 100), (3, 0, 2.0, 0.1, 200),
    )
    eps = {r["run_id"]: r["eps"] for r in privacy.spent(rows, 1e-5).collect()}
    assert eps[0] == pytest.approx(eps[1], abs=1e-12)
    assert eps[2] < eps[1] < eps[3]


def test_empty_ledger(spark):
    assert privacy.spent(ledger(spark), 1e-5).count() == 0


def test_delta_is_capped_and_inverts_epsilon(spark):
    composed = privacy.compose(privacy.log_moments(ledger(spark, (0, 0, 2.0, 0.1, 100)))).cache()
    eps = privacy.eps_for_delta(composed, 1e-5).first()["eps"]
    assert privacy.delta_for_eps(composed, eps).first()["delta"] == pytest.approx(1e-5, rel=1e-9)
    tiny = privacy.delta_for_eps(composed, 1e-6).first()
    assert tiny["delta"] == 1.0 and tiny["min_lambda"] is None


def test_release_wise_bound_when_no_order_is_finite(spark):
    import math

    composed = spark.createDataFrame(
        [(0, o, float("inf"), 3.0) for o in (1, 2)],
        "run_id int, order int, log_moment double, fallback double",
    )
    row = privacy.eps_for_delta(composed, 1e-3).first()
    assert row["eps"] == pytest.approx(3.0 - math.log(1e-3)) and row["min_lambda"] is None
    assert privacy.delta_for_eps(composed, 5.0).first()["delta"] == pytest.approx(math.exp(-2.0))


def test_every_target_is_met_and_tight(spark):
    targets = spark.createDataFrame(
        [(0, 1.0, 1e-3, 0.25, 8), (1, 0.1, 1e-3, 0.01, 100), (2, 5.0, 1e-5, 1.0, 3)],
        "run_id int, eps double, delta double, q double, iters int",
    )
    found = privacy.calibrate_sigma(targets, 128).collect()
    stepped = {r["run_id"]: r["sigma"] for r in privacy.calibrate_sigma_geometric(targets, 128).collect()}
    for r in found:
        def spend(sigma):
            rows = ledger(spark, (0, 0, sigma, r["q"], r["iters"]))
            return privacy.spent(rows, r["delta"], 128).first()["eps"]

        assert spend(r["sigma"]) <= r["eps"] + 1e-12
        assert spend(r["sigma"] * (1 - 1e-6)) > r["eps"]
        assert r["sigma"] <= stepped[r["run_id"]] <= 1.1 * r["sigma"] * (1 + 1e-9)


def test_unreachable_target_gets_no_noise(spark):
    targets = spark.createDataFrame(
        [(0, 0.1, 1e-3, 0.01, 100)], "run_id int, eps double, delta double, q double, iters int"
    )
    assert privacy.calibrate_sigma(targets, 64).first()["sigma"] is None
    assert privacy.calibrate_sigma_geometric(targets, 64).first()["sigma"] is None


def test_budget_rejects_only_overspending(spark):
    rows = ledger(spark, (0, 0, 2.0, 0.1, 100), (1, 0, 2.0, 0.1, 100), (2, 0, 2.0, 0.1, 100))
    eps = privacy.spent(rows, 1e-3, 128).first()["eps"]
    targets = spark.createDataFrame([(0, eps * 1.01), (1, eps * 0.99)], "run_id int, eps double")
    got = {r["run_id"]: r["accepted"] for r in privacy.check_budget(rows, targets).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_quadrature_agrees(spark):
    rows = ledger(spark, (0, 0, 1.5, 0.2, 1), (1, 0, 4.0, 0.01, 1))
    for r in privacy.audit_moments(rows, (1, 8), 20001).collect():
        assert r["ordered"] and r["log_moment_quadrature"] == pytest.approx(r["log_moment"], abs=1e-9)


def test_ledgers_with_many_pairs_take_the_other_way(spark, monkeypatch):
    rows = [(i % 7, 1.0 + i % 5, 0.01 * (1 + i % 3), 10 + i) for i in range(60)]
    ledger = spark.createDataFrame(rows, "run_id int, sigma double, q double, iters int")
    few = {r.run_id: (r.eps, r.min_lambda) for r in privacy.spent(ledger).collect()}
    again = {r.run_id: (r.eps, r.min_lambda) for r in privacy.eps_for_delta(privacy.compose(privacy.log_moments(ledger)), privacy.TRAINING_DELTA).collect()}
    monkeypatch.setattr(privacy, "MOST_PAIRS", 3)
    many = {r.run_id: (r.eps, r.min_lambda) for r in privacy.spent(ledger).collect()}
    assert few.keys() == many.keys() == again.keys() == set(range(7))
    for run in few:
        assert few[run] == pytest.approx(many[run], rel=1e-12) and few[run] == pytest.approx(again[run], rel=1e-12)
    assert privacy.spent(ledger.limit(0)).count() == 0


def test_searches_of_a_batch_equal_single_ones(spark):
    rows = [(i, 0.3 + 0.4 * i, 1e-5, 0.01 * (1 + i % 4), 100) for i in range(12)] + [(99, 1e-9, 1e-5, 0.01, 100)]
    schema = "run_id int, eps double, delta double, q double, iters int"
    for search in (privacy.calibrate_sigma, privacy.calibrate_sigma_geometric):
        together = {r.run_id: r.sigma for r in search(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
        assert together[99] is None or search is privacy.calibrate_sigma_geometric
        for row in rows[1:4]:
            alone = search(spark.createDataFrame([row], schema)).first().sigma
            assert together[row[0]] == pytest.approx(alone, rel=1e-12)
