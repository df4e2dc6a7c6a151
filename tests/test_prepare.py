"""Cleaning, encoding, scaling and splitting: edge cases on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import clean, encode, scale, split


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, 1.0, list(map(float, r))) for i, r in enumerate(rows)],
        "row_id bigint, y double, features array<double>",
    )


def matrix(df):
    return np.array([r["features"] for r in df.orderBy("row_id").collect()], dtype=float)


def test_zero_rows_and_constant_columns(spark):
    df = frame(spark, [[0, 5, 0], [3, 5, 0], [4, 5, 0]])
    std = matrix(scale.standard_scale(df, df))
    assert std[:, 1].tolist() == [0.0, 0.0, 0.0] and std[:, 2].tolist() == [0.0, 0.0, 0.0]
    x = np.array([0, 3, 4.0])
    np.testing.assert_allclose(std[:, 0], (x - x.mean()) / x.std())
    assert matrix(scale.max_abs_scale(df, df))[:, 2].tolist() == [0.0, 0.0, 0.0]
    zero = frame(spark, [[0, 0, 0], [3, 0, 4]])
    np.testing.assert_allclose(matrix(scale.row_l2_normalize(zero)), [[0, 0, 0], [0.6, 0, 0.8]])
    spread = scale.mean_range_normalize(df).orderBy("row_id").first()["features"]
    assert spread[1] is None and spread[0] == pytest.approx((0 - 7 / 3) / 4)


def test_statistics_come_from_the_fit_frame(spark):
    train, test = frame(spark, [[1, 0], [2, 0]]), frame(spark, [[4, 7]])
    np.testing.assert_allclose(matrix(scale.max_abs_scale(train, test)), [[2, 7]])


def test_sparse_scaling_equals_dense(spark):
    dense = frame(spark, [[0, 2, 0, 1], [4, 0, 0, -3], [0, 0, 0, 0]])
    sparse = encode.to_sparse(dense)
    for operator in (scale.col_l1_normalize, scale.row_l2_normalize,
                     lambda d: scale.max_abs_scale(d, d)):
        np.testing.assert_allclose(
            matrix(encode.to_dense(operator(sparse))), matrix(operator(dense))
        )


def test_layouts_round_trip(spark):
    df = frame(spark, [[1, 0, 2], [3, 4, 5]])
    np.testing.assert_allclose(matrix(encode.to_wide(encode.to_long(df), 3)), matrix(df))
    narrow = encode.pad_features(frame(spark, [[1, 2]]), 4)
    assert matrix(narrow).tolist() == [[1, 2, 0, 0]]


def test_modes_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, None)], "row_id int, c string, d string")
    filled = {r["row_id"]: (r["c"], r["d"]) for r in clean.fill_mode(df, ["c", "d"]).collect()}
    assert filled == {1: ("b", "x"), 2: ("a", "x"), 3: ("a", "x")}


def test_category_order_is_exact_with_many_levels(spark):
    words = sorted({f"{i * 7919 % 3001:04d}" for i in range(3000)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "c string").repartition(7)
    codes = encode.category_codes(df.withColumn("v", F.col("c")), ["c"]).collect()
    want = {w: i for i, w in enumerate(words)} | {None: -1}
    assert {r["v"]: r["c"] for r in codes} == want


def test_frequency_order_takes_both_sides(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "row_id int, c string")
    test = spark.createDataFrame([(4, "b"), (5, "z"), (6, "b")], "row_id int, c string")
    left, right = encode.one_hot_freq(train, test, ["c"])
    # b is commonest and dropped; a before z among equals.
    assert left.columns == ["row_id", "c_a", "c_z"]
    assert {tuple(r) for r in left.collect()} == {(1, 1, 0), (2, 0, 0), (3, 0, 0)}
    assert {tuple(r) for r in right.collect()} == {(4, 0, 0), (5, 0, 1), (6, 0, 0)}


def test_too_many_levels_are_refused(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        encode.one_hot(df, ["c"])
    assert encode.one_hot_long(df, ["c"]).count() == 5000


def ranked(n, *seed):
    import hashlib

    key = "|".join(map(str, seed))
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{key}|{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("ratio", [0.0, 0.2, 0.33, 1.0])
def test_split_is_exact_and_ignores_partitioning(spark, ratio):
    order = ranked(101, 9)
    cut = int(np.ceil(ratio * 101))
    for parts in (1, 4, 16):
        train, test = split.train_test_split(
            spark.range(101).select(F.col("id").alias("row_id")).repartition(parts), ratio, 9
        )
        assert {r[0] for r in test.collect()} == set(order[:cut])
        assert {r[0] for r in train.collect()} == set(order[cut:])


@pytest.mark.parametrize("lot_size", [1, 7, 50, 101])
def test_lots_agree_with_a_full_ranking(spark, lot_size):
    df = spark.range(101).select(F.col("id").alias("row_id")).repartition(3)
    order = ranked(101, 9, 0)
    whole = 101 // lot_size
    want = {r: (p // lot_size if p // lot_size < whole else -1) for p, r in enumerate(order)}
    got = {r["row_id"]: r["lot"] for r in split.slice_lots(df, lot_size, 101, 9, 0).collect()}
    assert got == want
    exact = split.assign_lots(df, lot_size, 1, 9)
    assert {r["row_id"]: r["lot"] for r in exact.collect()} == {r: l for r, l in want.items() if l >= 0}


def test_small_lots_are_cut_from_full_ranks(spark, monkeypatch):
    monkeypatch.setattr(split, "BUCKET_DIGITS", 1)
    monkeypatch.setattr(split, "FEW_LOTS", 0)
    df = spark.range(400).select(F.col("id").alias("row_id"))
    order = ranked(400, 9, 0)
    for lot_size in (7, 60):  # below and above the 25 rows of a bucket
        whole = 400 // lot_size
        want = {r: (p // lot_size if p // lot_size < whole else -1) for p, r in enumerate(order)}
        got = {r["row_id"]: r["lot"] for r in split.slice_lots(df, lot_size, 400, 9, 0).collect()}
        assert got == want


def test_a_lot_may_span_two_epochs(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"))
    lots = split.assign_lots(df, 4, 2, 1).groupBy("lot").count().orderBy("lot").collect()
    assert [tuple(r) for r in lots] == [(i, 4) for i in range(5)]
    both = split.assign_lots(df, 4, 2, 1).where("lot = 2").select("epoch").distinct().count()
    assert both == 2


@pytest.mark.parametrize("k", [1, 3, 10, 17])
def test_parts_are_near_equal(spark, k):
    df = spark.range(10).select(F.col("id").alias("row_id"))
    sizes = {r["part"]: r["count"] for r in split.assign_partitions(df, k, 1).groupBy("part").count().collect()}
    want = [10 // k + (i < 10 % k) for i in range(k)]
    assert sizes == {i: s for i, s in enumerate(want) if s}


def test_sample_larger_than_table(spark):
    df = spark.range(5).select(F.col("id").alias("row_id"))
    assert split.sample_rows(df, 9, 1).count() == 5
    assert split.sample_rows(df, 3, 1).count() == 3


def test_plain_streams_accept_row_local_operators(spark, tmp_path):
    from lotwise.operators.objective import predict_class

    frame(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0]]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id bigint, y double, features array<double>").parquet(
        str(tmp_path / "in")
    )
    out = predict_class(stream, [2.0, 0.0], fit_intercept=False)
    running = out.writeStream.format("memory").queryName("streamed").start()
    running.processAllAvailable()
    running.stop()
    got = {r["row_id"]: r["prediction"] for r in spark.table("streamed").collect()}
    assert got == {0: 1.0, 1: -1.0, 2: -1.0}


def test_indices_outside_the_width_are_an_error(spark):
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([(0, [0, 7], [1.0, 2.0], 4), (1, [1, 0], [1.0, 2.0], 2)], "row_id int, indices array<int>, values array<double>, width int")
    with pytest.raises(PySparkException):
        encode.to_dense(rows).collect()
    assert encode.to_dense(rows.filter("row_id = 1")).first()["features"] == [2.0, 1.0]
    long = spark.createDataFrame([(0, 0, 1.0), (0, 5, 2.0)], "row_id int, idx int, value double")
    with pytest.raises(PySparkException):
        encode.to_wide(long, 2).collect()
