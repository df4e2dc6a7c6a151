"""Categories, layouts and the intercept."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.functions.vectors import padded
from lotwise.sources.scratch import commit, scratch_path

SPLITTERS = 256
MAX_NAMED_LEVELS = 4096


def ordered_rank(df, column, splitters=SPLITTERS):
    """1-based rank of distinct, non-null values without sorting them in one task.

    At most ``splitters`` values, picked by hash, cut the value range; each range is ranked on its
    own and shifted by the number of values in the ranges before it.
    """
    picked = df.select(column).orderBy(F.md5(F.col(column).cast("string").cast("binary")))
    cuts = picked.limit(splitters).agg(F.array_sort(F.collect_list(column)).alias("cuts")).scalar()
    value = F.col(column)
    ranged = df.withColumn("_cuts", cuts)
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= value))).drop("_cuts")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # At most splitters + 1 rows.
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn("rank", F.col("_start") + inside)
        .drop("_range", "_start")
    )


def category_codes(df, columns):
    """Text to its 0-based place among the sorted distinct values; null to -1.

    The level table is written first, so Spark knows its true size when it plans the join: small
    ones are broadcast, very large ones are joined by a (skew-aware) shuffle.
    """
    for c in columns:
        levels = df.select(F.col(c).alias("_level")).where(F.col("_level").isNotNull()).distinct()
        codes = ordered_rank(levels, "_level").select("_level", (F.col("rank") - 1).alias("_code"))
        codes = commit(codes, scratch_path(df.sparkSession, "levels"))
        df = (
            df.join(codes, F.col(c) == F.col("_level"), "left")
            .withColumn(c, F.coalesce("_code", F.lit(-1)).cast("int"))
            .drop("_level", "_code")
        )
    return df


def level_counts(df, columns):
    """Rows per (column, value), nulls left out, all columns in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ]))
    return (
        df.select(pairs.alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy(F.col("p.name").alias("name"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _named_levels(counts, columns, order):
    """Levels as plan-time names.  Each becomes a column, so their number is checked first."""
    limit = MAX_NAMED_LEVELS * len(columns) + 1
    rows = counts.orderBy("name", *order).limit(limit).collect()
    levels = {c: [r["value"] for r in rows if r["name"] == c] for c in columns}
    if len(rows) == limit or any(len(v) > MAX_NAMED_LEVELS for v in levels.values()):
        raise ValueError(
            f"more than {MAX_NAMED_LEVELS} levels in one column: use one_hot_long instead"
        )
    return levels


def _indicators(df, levels, keep_others=True):
    others = [c for c in df.columns if c not in levels] if keep_others else []
    made = [
        F.coalesce(F.when(F.col(f"`{c}`") == v, 1), F.lit(0)).alias(f"{c}_{v}")
        for c, values in levels.items()
        for v in values
    ]
    return df.select(*others, *made)


def one_hot(df, columns, drop=()):
    """One indicator per value in sorted value order; then drop chosen indicators by name."""
    levels = _named_levels(level_counts(df, columns), columns, ["value"])
    return _indicators(df, levels).drop(*drop)


def one_hot_freq(train, test, columns, drop_first=True, counts=None):
    """Indicators in order of frequency over train and test together (ties: smaller value first).

    The commonest level is dropped; nulls and dropped levels are all zeros.  ``counts`` may bring
    frequencies taken earlier, for example before imputation.
    """
    if counts is None:
        both = train.select(*columns).unionByName(test.select(*columns))
        counts = level_counts(both, columns)
    levels = _named_levels(counts, columns, [F.desc("n"), "value"])
    if drop_first:
        levels = {c: v[1:] for c, v in levels.items()}
    return _indicators(train, levels), _indicators(test, levels)


def one_hot_long(df, columns):
    """Indicators as sparse rows ``row_id, idx, value`` for columns of any number of levels."""
    counts = level_counts(df, columns)
    levels = counts.select(F.concat_ws("=", "name", "value").alias("_level"))
    index = ordered_rank(levels, "_level").select("_level", (F.col("rank") - 1).alias("idx"))
    index = commit(index, scratch_path(df.sparkSession, "levels"))
    marks = F.explode(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string")))
        for c in columns
    ]))
    return (
        df.select("row_id", marks.alias("_level"))
        .where(F.col("_level").isNotNull())
        .join(index, "_level")
        .select("row_id", "idx", F.lit(1.0).alias("value"))
    )


def assemble(df, numeric, indicators, keep=("row_id", "y")):
    """Numeric columns followed by indicator columns as one feature vector."""
    parts = [F.col(f"`{c}`").cast("double") for c in [*numeric, *indicators]]
    return df.select(*[c for c in keep if c in df.columns], F.array(*parts).alias("features"))


def to_dense(df, width=None):
    """Sparse pair to a dense vector of ``width`` entries; an index outside it is an error."""
    width = F.col("width") if width is None else F.lit(width)
    lookup = F.map_from_arrays("indices", "values")
    filled = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(0.0)),
    )
    dense = _inside(F.col("indices"), width, filled)
    rest = [c for c in df.columns if c not in ("indices", "values", "width")]
    return df.select(*rest, dense.alias("features"))


def _inside(indices, width, vector):
    """``vector``, or an error where an index is negative or not below ``width``."""
    outside = (F.array_min(indices) < 0) | (F.array_max(indices) >= width)
    message = F.concat(F.lit("feature index outside the width "), width.cast("string"))
    return F.when(outside, F.raise_error(message)).otherwise(vector)


def to_sparse(df):
    """Dense vector to the sparse pair; zeros are left out."""
    pairs = F.filter(
        F.transform("features", lambda v, i: F.struct(i.alias("idx"), v.alias("value"))),
        lambda e: e["value"] != 0.0,
    )
    rest = [c for c in df.columns if c != "features"]
    return df.withColumn("_pairs", pairs).select(
        *rest,
        F.transform("_pairs", lambda e: e["idx"]).alias("indices"),
        F.transform("_pairs", lambda e: e["value"]).alias("values"),
        F.size("features").alias("width"),
    )


def entries(df, keep=("row_id",), zeros=False):
    """One row per vector entry, from either layout."""
    if "features" in df.columns:
        # The outer form: a plain explode adds a size check that evaluates the vector twice.
        out = df.select(*keep, F.posexplode_outer("features").alias("idx", "value"))
        return out.where(F.col("idx").isNotNull() if zeros else F.col("value") != 0.0)
    return df.select(*keep, F.explode(F.arrays_zip("indices", "values")).alias("e")).select(
        *keep, F.col("e.indices").alias("idx"), F.col("e.values").alias("value")
    )


def to_long(df):
    return entries(df)


def to_wide(long, width):
    """Long rows back to one vector per row; an index outside ``width`` is an error."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    gathered = long.groupBy("row_id").agg(pairs.alias("_p"))
    lookup = F.map_from_entries("_p")
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(0.0)),
    )
    dense = _inside(F.transform("_p", lambda p: p["idx"]), F.lit(width), filled)
    return gathered.select("row_id", dense.alias("features"))


def pad_features(df, width):
    return df.withColumn("features", padded(F.col("features"), width))


def add_intercept(df):
    """Constant 1 in front of every vector."""
    if "features" in df.columns:
        return df.withColumn("features", F.concat(F.array(F.lit(1.0)), F.col("features")))
    return df.withColumns({
        "indices": F.concat(F.array(F.lit(0)), F.transform("indices", lambda i: i + 1)),
        "values": F.concat(F.array(F.lit(1.0)), F.col("values")),
        "width": F.col("width") + 1,
    })
