"""Row formulas: hand-computed values, block forms against column forms, keyed randomness."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotwise.functions.keyed import keyed_normal, keyed_uniform
from lotwise.functions.tasks import TASKS, project_box, task_of
from lotwise.functions.vectors import clip_l2, clip_scalar, padded, unit, vector


def uniform(key):
    return (int(hashlib.md5(key.encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48


def test_keyed_draws_follow_their_key(spark):
    df = spark.range(40).select("id", keyed_uniform(7, "x", F.col("id")).alias("u"),
                                keyed_normal(7, "x", F.col("id")).alias("g"))
    one = {r["id"]: (r["u"], r["g"]) for r in df.collect()}
    again = {r["id"]: (r["u"], r["g"]) for r in df.repartition(5).collect()}
    assert one == again
    for i, (u, g) in one.items():
        assert u == pytest.approx(uniform(f"7|x|{i}"), abs=1e-15)
        r, t = uniform(f"7|x|{i}|r"), uniform(f"7|x|{i}|t")
        assert g == pytest.approx(math.sqrt(-2 * math.log(r)) * math.cos(2 * math.pi * t), abs=1e-12)


def test_clips_and_unit(spark):
    one = spark.range(1)
    a = vector([3.0, 4.0])
    row = one.select(
        clip_l2(a, 1.0).alias("cut"), clip_l2(a, 10.0).alias("kept"), clip_l2(a, 0).alias("off"),
        clip_l2(a, -1).alias("free"), unit(a).alias("unit"), unit(vector([0.0, 0.0])).alias("zero"),
        clip_scalar(F.lit(-3.0), 2.0).alias("s"), clip_scalar(F.lit(2.0), 2.0).alias("edge"),
        clip_scalar(F.lit(-3.0), 0).alias("s_off"), clip_scalar(F.lit(-3.0), -1).alias("s_free"),
        padded(a, 4).alias("padded"), padded(a, 1).alias("long"),
    ).first()
    assert row["cut"] == pytest.approx([0.6, 0.8]) and row["kept"] == [3.0, 4.0]
    assert row["off"] == row["free"] == [3.0, 4.0]
    assert row["unit"] == pytest.approx([0.6, 0.8]) and row["zero"] == [0.0, 0.0]
    assert (row["s"], row["edge"], row["s_off"], row["s_free"]) == (-2.0, 2.0, -3.0, -3.0)
    assert row["padded"] == [3.0, 4.0, 0.0, 0.0] and row["long"] == [3.0, 4.0]


def test_box_keeps_the_side_of_the_label(spark):
    pairs = [(0.0, 1.0), (2.0, 1.0), (-0.5, 1.0), (0.0, -1.0), (-3.0, -1.0), (0.4, 1.0), (1e-4, 1.0)]
    df = spark.createDataFrame(pairs, "alpha double, y double")
    got = [r[0] for r in df.select(project_box(F.col("alpha"), F.col("y"))).collect()]
    assert got == pytest.approx([1e-4, 1 - 1e-4, 1e-4, -1e-4, -(1 - 1e-4), 0.4, 1e-4])


def test_hand_computed_steps(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.2, 1.0), (0.0, -1.0, -0.3, 0.0)],
                               "z double, y double, alpha double, sq double")
    args = [F.col(c) for c in ("z", "y", "alpha", "sq")]
    ridge = [r[0] for r in df.select(task_of("RR").delta_alpha(*args, 2.0, 4.0)).collect()]
    assert ridge == pytest.approx([(1 - 0.25 - 0.2) / 3.0, (-1 - 0 + 0.3) / 1.0])
    hinge = [r[0] for r in df.select(task_of("SVM").delta_alpha(*args, 2.0, 4.0)).collect()]
    # 0.2 + (2 - 0.5) / 4 = 0.575; a row without features moves to the far edge of the box.
    assert hinge == pytest.approx([0.375, -(1 - 1e-4) + 0.3])
    logistic = df.select(task_of("LR").delta_alpha(*args, 2.0, 4.0)).first()[0]
    slope = math.log(0.2) - math.log(0.8) + 0.25
    assert logistic == pytest.approx(-slope / (1 / 0.16 + 2.0))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(
    st.floats(-5, 5), st.sampled_from([-1.0, 1.0]), st.floats(-1.5, 1.5), st.floats(0, 2)
), min_size=1, max_size=30))
def test_block_forms_equal_column_forms(spark, rows):
    df = spark.createDataFrame(rows, "z double, y double, alpha double, sq double")
    z, y, alpha, sq = (np.array(c) for c in zip(*rows))
    for task in TASKS.values():
        task = task()
        got = df.select(
            task.delta_alpha(*[F.col(c) for c in ("z", "y", "alpha", "sq")], 3.0, 7.0),
            task.gradient_factor(F.col("z"), F.col("y")),
            task.primal_loss(F.col("z"), F.col("y")),
        ).toPandas().to_numpy()
        np.testing.assert_allclose(got[:, 0], task.block_delta(z, y, alpha, sq, 3.0, 7.0), atol=1e-9)
        np.testing.assert_allclose(got[:, 1], task.block_factor(z, y), atol=1e-12)
        np.testing.assert_allclose(got[:, 2], task.block_loss(z, y), atol=1e-12)


def test_unknown_task_is_refused():
    with pytest.raises(ValueError):
        task_of("forest")
