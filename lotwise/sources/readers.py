"""Scans.  Schemas are explicit; Spark reads ``.bz2`` and ``.gz`` files as they are."""

from pyspark.sql import functions as F


def scan_csv(spark, path, schema, header=True, null_value=None, comment=None):
    """Comma-separated text with trimmed fields.

    A file whose first line is not data is read with ``header=True`` as well: the explicit schema
    supplies the names, the line is skipped.
    """
    options = {
        "header": str(header).lower(),
        "enforceSchema": "true",
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
        "mode": "FAILFAST",
    }
    if null_value is not None:
        options["nullValue"] = null_value
    if comment is not None:
        options["comment"] = comment
    return spark.read.schema(schema).options(**options).csv(path)


def scan_tsv(spark, path, schema):
    """Tab-separated text without a header; empty fields are nulls."""
    return spark.read.schema(schema).options(sep="\t", header="false", mode="FAILFAST").csv(path)


def with_row_id(df, column="row_id"):
    """Numbers in file order, for what goes by that order.

    They depend on how files are cut into tasks, so commit the result once before it is used.
    """
    return df.withColumn(column, F.monotonically_increasing_id())


# Copies of one line that a task makes at a time.
COPIES = 1 << 16


def with_content_key(df, content=None, column="row_id"):
    """Key that follows from what the rows say: digest of ``content`` and number of the occurrence.

    ``content`` is a text that determines the row (default: all columns as JSON).  The same files give
    the same keys however they are cut, named or ordered.  Digests alone are counted; a row whose
    digest occurs once keeps its place.  Equal rows are interchangeable, so one of them and their
    number are enough to write them all out, in tasks of bounded size however many there are.
    """
    if content is None:
        content = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    keyed = df.withColumn("_digest", F.md5(content.cast("binary")))
    repeated = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    once = keyed.join(repeated, "_digest", "left_anti").withColumn("_at", F.lit(0).cast("bigint"))
    one = keyed.join(repeated, "_digest").groupBy("_digest").agg(
        F.first("_n").alias("_n"), F.first(F.struct(*df.columns)).alias("_row")
    )
    blocks = one.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {COPIES}"))))
    low = F.col("_block") * COPIES
    places = F.sequence(low, F.least(low + COPIES, F.col("_n")) - 1)
    copies = blocks.repartition("_digest", "_block").select("_row.*", "_digest", F.explode(places).alias("_at"))
    both = once.select(*df.columns, "_digest", "_at").unionByName(copies)
    return both.withColumn(column, F.concat_ws("-", "_digest", "_at")).drop("_digest", "_at")


def scan_libsvm(spark, path, n_features):
    """Sparse ``label index:value`` text as ``row_id, y, indices, values, width``, indices from 0.

    The lines are split where they are read, so a row never takes more room than its own entries; its
    key is made of the line without comment and outer spaces.
    """
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    lines = spark.read.text(path).select(text.alias("line")).where(F.col("line") != "")
    lines = with_content_key(lines, F.col("line"))
    fields = F.split("line", "\\s+")
    texts = F.slice(fields, 2, F.greatest(F.lit(0), F.size(fields) - 1))
    pairs = F.array_sort(F.transform(texts, lambda t: F.struct(
        (F.substring_index(t, ":", 1).cast("int") - 1).alias("i"),
        F.substring_index(t, ":", -1).cast("double").alias("v"),
    )))
    parsed = lines.select("row_id", F.element_at(fields, 1).cast("double").alias("y"), pairs.alias("p"))
    return parsed.select(
        "row_id", "y", F.col("p.i").alias("indices"), F.col("p.v").alias("values"),
        F.lit(int(n_features)).alias("width"),
    )


def write_libsvm(df, path):
    """The inverse of :func:`scan_libsvm`, for either layout."""
    if "features" in df.columns:
        pairs = F.filter(
            F.transform("features", lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"))),
            lambda e: e["v"] != 0.0,
        )
    else:
        pairs = F.zip_with(
            "indices", "values", lambda i, v: F.struct((i + 1).alias("i"), v.alias("v"))
        )
    texts = F.transform(pairs, lambda e: F.concat_ws(":", e["i"], e["v"].cast("string")))
    line = F.concat_ws(" ", F.array_prepend(texts, F.col("y").cast("string")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def paired_scan(scan, train_path, test_path):
    """Ready-made train and test files read by one scan, hence with one schema and one width."""
    return scan(train_path), scan(test_path)


def struct_of(fields):
    """Schema text from ``(name, type name)`` pairs."""
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)
