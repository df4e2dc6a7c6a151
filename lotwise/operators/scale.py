"""Scaling: fitting is one aggregate per feature, applying it is a projection.

Per-feature statistics come back as one vector (a scalar subquery as wide as a row), so applying
them needs neither a join nor a shuffle of the table.  Both layouts are supported where scaling
keeps zeros at zero.
"""

from pyspark.sql import functions as F

from lotwise.functions.vectors import unit
from lotwise.operators.encode import entries


def _one_for_zero(column):
    return F.when(column == 0.0, F.lit(1.0)).otherwise(column)


def feature_stats(df):
    """Mean, population deviation, extremes and absolute sums per feature of dense vectors."""
    value = F.col("value")
    return entries(df, keep=(), zeros=True).groupBy("idx").agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.max(F.abs(value)).alias("max_abs"),
        F.sum(F.abs(value)).alias("sum_abs"),
    )


def stat_vector(stats, column):
    """One statistic as a vector ordered by feature: a row's width, whatever the table's size."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("idx"), column.alias("s"))))
    return stats.agg(F.transform(pairs, lambda p: p["s"]).alias("v")).scalar()


def _divide_by(fit_df, df, statistic):
    """Divide each entry by a statistic of its feature in ``fit_df``, in either layout."""
    seen = entries(fit_df, keep=(), zeros=True)
    if "width" in fit_df.columns:
        # Every position of a sparse row needs a place in the vector, also one never filled.
        widths = fit_df.agg(F.max("width").alias("w"))
        every = widths.select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("idx"))
        seen = seen.unionByName(every.withColumn("value", F.lit(0.0)))
    stats = seen.groupBy("idx").agg(statistic(F.abs("value")).alias("stat"))
    # A subquery may not appear inside a lambda: the vector comes in as a column first.
    df = df.withColumn("_by", stat_vector(stats, _one_for_zero(F.col("stat"))))
    if "features" in df.columns:
        divided = F.zip_with("features", "_by", lambda v, s: v / s)
        return df.withColumn("features", divided).drop("_by")
    divided = F.zip_with(
        "indices", "values", lambda i, v: v / F.coalesce(F.get("_by", i), F.lit(1.0))
    )
    return df.withColumn("values", divided).drop("_by")


def standard_scale(fit_df, df):
    """(x - mean) / population deviation; a constant feature is only centred."""
    stats = feature_stats(fit_df)
    mean = stat_vector(stats, F.col("mean"))
    std = stat_vector(stats, _one_for_zero(F.col("std")))
    df = df.withColumns({"_mean": mean, "_std": std})
    centred = F.zip_with("features", "_mean", lambda v, m: v - m)
    scaled = F.zip_with(centred, "_std", lambda v, s: v / s)
    return df.withColumn("features", scaled).drop("_mean", "_std")


def standard_scale_each(train, test):
    """Train and test, each by its own statistics."""
    return standard_scale(train, train), standard_scale(test, test)


def max_abs_scale(fit_df, df):
    """x / max|x| per feature of ``fit_df``."""
    return _divide_by(fit_df, df, F.max)


def row_l2_normalize(df):
    """Each row to length 1, which bounds what one row can contribute."""
    if "features" in df.columns:
        return df.withColumn("features", unit(F.col("features")))
    return df.withColumn("values", unit(F.col("values")))


def col_l1_normalize(df):
    """Each column divided by the sum of its absolute values; call once per split."""
    return _divide_by(df, df, F.sum)


def mean_range_normalize(df):
    """(x - mean) / (max - min); a constant column has no range and becomes null."""
    stats = feature_stats(df)
    mean = stat_vector(stats, F.col("mean"))
    span = stat_vector(stats, F.col("high") - F.col("low"))
    df = df.withColumns({"_mean": mean, "_span": span})
    centred = F.zip_with("features", "_mean", lambda v, m: v - m)
    scaled = F.zip_with(centred, "_span", lambda v, s: F.try_divide(v, s))
    return df.withColumn("features", scaled).drop("_mean", "_span")


def center_target(train, test):
    """Subtract the training mean from both targets."""
    mean = train.agg(F.avg("y").alias("m")).scalar()
    return train.withColumn("y", F.col("y") - mean), test.withColumn("y", F.col("y") - mean)
