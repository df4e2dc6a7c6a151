"""Training tables made from the given tables, and the same tables as SQL.

Every pair below is one definition written twice: a Spark frame and a SQL common table expression.
Results are rounded to six places on both sides; adding zero turns a negative zero positive.
"""

from pyspark.sql import functions as F

from lotwise.functions.keyed import keyed_uniform
from lotwise.operators.encode import entries
from lotwise.operators.objective import score, shared_vector

LAMBDA = 0.01


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(column, name):
    column = F.col(column) if isinstance(column, str) else column
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def long_out(df, *keys):
    """Vector entries, zeros included, as rounded rows."""
    out = entries(df, keep=keys, zeros=True)
    return out.select(*keys, F.col("idx").cast("int").alias("idx"), r6("value", "value"))


def model_out(model):
    return model.select(F.col("idx").cast("int").alias("idx"), r6("value", "value"))


def embeddings(spark, sf):
    """Unit vectors with label +1 for class 0 and -1 for the others."""
    raw = table(spark, sf, "embeddings")
    label = F.when(F.col("label") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return raw.select(
        F.col("vec_id").alias("row_id"),
        label.alias("y"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def with_alpha(df):
    """A feasible dual value for every row: y times a keyed uniform."""
    return df.withColumn("alpha", F.col("y") * keyed_uniform("alpha", F.col("row_id")))


def dual_rows(spark, sf):
    return with_alpha(embeddings(spark, sf))


def mean_model(df):
    """Model from the data: difference of the class means."""
    up = F.avg(F.when(F.col("y") > 0, F.col("value")))
    down = F.avg(F.when(F.col("y") < 0, F.col("value")))
    return entries(df, keep=("y",), zeros=True).groupBy("idx").agg((up - down).alias("value"))


def scored(spark, sf):
    rows = embeddings(spark, sf)
    return score(rows, mean_model(rows))


def dual_state(spark, sf):
    """Rows with alpha, and w = X^T alpha."""
    rows = dual_rows(spark, sf)
    return rows, shared_vector(rows)


def lineitems(spark, sf):
    raw = table(spark, sf, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return raw.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").cast("double").alias("y"),
        F.array(*[F.col(c) for c in names]).alias("features"),
    )


def gappy_customers(spark, sf):
    """Customers whose BUILDING segment and balances below zero are missing."""
    raw = table(spark, sf, "customer")
    return raw.select(
        F.col("c_custkey").alias("row_id"),
        "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"),
    )


# ---- the same in SQL -------------------------------------------------------------------------


def u_sql(key):
    """Keyed uniform; ``key`` is a SQL text expression."""
    return f"((('0x' || substr(md5({key}), 1, 12))::bigint + 0.5e0) / 281474976710656e0)"


def normal_sql(key):
    radius = f"sqrt(-2e0 * ln({u_sql(f'({key}) || ' + repr('|r'))}))"
    return f"({radius} * cos(6.283185307179586e0 * {u_sql(f'({key}) || ' + repr('|t'))}))"


EMB = """
emb as (select vec_id as row_id, case when label = 0 then 1e0 else -1e0 end as y,
               cast(embedding as double[]) as x from embeddings),
el as (select row_id, y, unnest(range(len(x))) as i, unnest(x) as v from emb)
"""

COEF = EMB + """,
coef as (select i, avg(v) filter (where y > 0) - avg(v) filter (where y < 0) as w
         from el group by i)
"""

SCORED = COEF + """,
sc as (select row_id, any_value(y) as y, sum(v * w) as z, sum(v * v) as sq
       from el join coef using (i) group by row_id)
"""

DUAL = EMB + f""",
al as (select row_id, y, y * {u_sql("'alpha|' || row_id")} as alpha from emb),
sv as (select i, sum(v * alpha) as w from el join al using (row_id) group by i),
ds as (select el.row_id, any_value(el.y) as y, any_value(alpha) as alpha, sum(v * w) as z,
              sum(v * v) as sq
       from el join al on el.row_id = al.row_id join sv using (i) group by el.row_id),
nn as (select count(*) as n from emb)
"""

LINE = """
li as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1e0 else 0e0 end as y,
              [l_quantity, l_extendedprice, l_discount, l_tax] as x from lineitem),
ll as (select l_orderkey, l_linenumber, y, unnest(range(len(x))) as i, unnest(x) as v from li)
"""

GAPPY = """
gc as (select c_custkey as row_id, c_nationkey,
              case when c_acctbal >= 0 then c_acctbal end as c_acctbal,
              nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer)
"""


def delta_sql(task, z="z", alpha="alpha", lam_n=None, sigma_p="50e0", box="1e-4"):
    """Dual step of a row as SQL text, from y, sq and the given expressions."""
    if task == "ridge":
        return f"((y - {z} / {lam_n} - {alpha}) / (1e0 + {sigma_p} * sq / {lam_n}))"
    a = f"greatest({box}, least(1e0 - {box}, y * {alpha}))"
    if task == "logistic":
        slope = f"(y * (ln({a}) - ln(1e0 - {a})) + {z} / {lam_n})"
        curve = f"(1e0 / ({a} * (1e0 - {a})) + {sigma_p} * sq / {lam_n})"
        moved = f"greatest({box}, least(1e0 - {box}, y * (y * {a} - {slope} / {curve})))"
    else:
        goal = f"greatest(0e0, least(1e0, y * (y * {a} + ({lam_n} * y - {z}) / ({sigma_p} * sq))))"
        moved = f"greatest({box}, least(1e0 - {box}, {goal}))"
    return f"(y * {moved} - y * {a})"


def factor_sql(task, z="z"):
    if task == "ridge":
        return f"({z} - y)"
    if task == "logistic":
        return f"(1e0 / (1e0 + exp(-{z})) - case when y > 0 then 1e0 else 0e0 end)"
    return f"(case when y * {z} < 1e0 then -y else 0e0 end)"


def loss_sql(task, z="z"):
    if task == "ridge":
        return f"(power({z} - y, 2) / 2e0)"
    if task == "logistic":
        return f"(greatest(0e0, -y * {z}) + ln(1e0 + exp(-abs(y * {z}))))"
    return f"greatest(0e0, 1e0 - y * {z})"


def dual_loss_sql(task, box="1e-4"):
    if task == "ridge":
        return "(alpha * alpha / 2e0 - alpha * y)"
    if task == "logistic":
        a = f"greatest({box}, least(1e0 - {box}, y * alpha))"
        return f"((1e0 - {a}) * ln(1e0 - {a}) + {a} * ln({a}))"
    return "(-alpha * y)"


def skips_sql(seed, p=""):
    """Recursive table ``ch`` (row_id, b, j, t): the lots ``b * k + t`` that rows join, t < k.

    Needs ``pz`` with k, the lots of a block, and q, the probability of joining one, and ``bl`` with
    row_id and block b.  Between two joined lots lie floor(ln u / ln(1 - q)) others.  ``p`` begins all names.
    """
    u = lambda j: u_sql(f"'{seed}|skip|' || b || '|' || row_id || '|' || {j}")
    gap = lambda j: f"(case when q < 1e0 then floor(ln({u(j)}) / ln(1e0 - q)) else 0e0 end)::bigint"
    return f"""{p}ch as (
  select row_id, b, 0::bigint as j, {gap("'0'")} as t from {p}bl, {p}pz
  union all
  select row_id, b, j + 1, t + 1 + {gap("(j + 1)")} from {p}ch, {p}pz where t < k)"""
