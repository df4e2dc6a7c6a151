"""Column selection, null handling and labels."""

from pyspark.sql import functions as F


def drop_columns(df, columns):
    """Drop by name or by position; positions refer to the frame as given."""
    names = [df.columns[c] if isinstance(c, int) else c for c in columns]
    return df.drop(*names)


def keep_features(df, k):
    return df.withColumn("features", F.slice("features", 1, k))


# The type names that make up each family.
TYPE_FAMILIES = {
    "int": ("tinyint", "smallint", "int", "bigint"),
    "number": ("tinyint", "smallint", "int", "bigint", "float", "double"),
    "string": ("string",),
}


def columns_of_type(df, family):
    return [name for name, kind in df.dtypes if kind in TYPE_FAMILIES[family]]


def select_by_dtype(df, family, keep=()):
    chosen = set(columns_of_type(df, family)) | set(keep)
    return df.select(*[c for c in df.columns if c in chosen])


def drop_nulls(df):
    return df.na.drop("any")


def fill_constant(df, value=0):
    """The same constant in every null: as a number in numeric columns, as text in text columns."""
    return df.na.fill(value).na.fill(str(value))


def column_modes(df, columns):
    """Most frequent value of each text column, ties to the smallest, from one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ]))
    counted = (
        df.select(pairs.alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy(F.col("p.name").alias("name"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
    return counted.groupBy("name").agg(best.getField("value").alias("value"))


def fill_mode(df, columns, strategy="most_frequent", fit_df=None):
    """Null to the most frequent value of the named columns; another strategy fills ``'0'``."""
    if strategy != "most_frequent":
        return df.na.fill("0", subset=list(columns))
    modes = column_modes(df if fit_df is None else fit_df, columns)
    # One row, one entry per named column.
    lookup = modes.agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("modes")
    ).scalar()
    return df.withColumns({
        c: F.coalesce(F.col(f"`{c}`"), F.try_element_at(lookup, F.lit(c))) for c in columns
    })


def remap_label(df, positive, column="y", negative_value=-1.0):
    """Label to +1 where ``positive`` holds (a value or a condition), else to ``negative_value``."""
    condition = F.col(column) == F.lit(positive) if not hasattr(positive, "isNull") else positive
    return df.withColumn(column, F.when(condition, F.lit(1.0)).otherwise(F.lit(negative_value)))
