"""Scans and sinks: each query writes a table out as files and reads it back through a scan."""

from pyspark.sql import functions as F

from lotwise.operators.objective import row_sq_norm
from lotwise.operators.privacy import eps_curve
from lotwise.plans.recipes import load_dataset
from lotwise.queries.evaluation import TRACE, event_trace
from lotwise.queries.inputs import EMB, embeddings, long_out, r6, table
from lotwise.queries.ledger import LEDGER, moments_sql, order_ledger
from lotwise.queries.prep import SPARSE_EMB, thresholded
from lotwise.queries.registry import query
from lotwise.sources import readers, writers
from lotwise.sources.scratch import scratch_path


@query("scan_libsvm", f"""with {EMB}, {SPARSE_EMB}
select y, i::int as idx, round(v, 6) + 0e0 as value from th where v <> 0""")
def scan_libsvm(spark, sf):
    path = readers.write_libsvm(thresholded(spark, sf), scratch_path(spark, "libsvm"))
    return long_out(readers.scan_libsvm(spark, path, 64), "y")


ORDER_FIELDS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderpriority", "string"),
]
ORDER_NAMES = [n for n, _ in ORDER_FIELDS]


@query("scan_csv", "select " + ", ".join(ORDER_NAMES) + " from orders")
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "orders").select(*ORDER_NAMES).write.csv(path, header=True)
    return readers.scan_csv(spark, path, readers.struct_of(ORDER_FIELDS))


CUSTOMER_FIELDS = [("c_custkey", "bigint"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("scan_csv_headerless", """
select c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer""")
def scan_csv_headerless(spark, sf):
    """Fields separated by ' , ', a question mark for a missing value, no header."""
    path = scratch_path(spark, "csv-plain")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.col("c_mktsegment"))
    line = F.concat_ws(" , ", F.col("c_custkey"), F.col("c_acctbal").cast("string"), segment)
    table(spark, sf, "customer").select(line).write.text(path)
    schema = readers.struct_of(CUSTOMER_FIELDS)
    return readers.scan_csv(spark, path, schema, header=False, null_value="?")


@query("scan_tsv", "select event_id, user_id, event_type, value from events")
def scan_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    fields = [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double")]
    table(spark, sf, "events").select(*[n for n, _ in fields]).write.csv(path, sep="\t")
    return readers.scan_tsv(spark, path, readers.struct_of(fields))


@query("scan_compressed", "select " + ", ".join(ORDER_NAMES) + " from orders")
def scan_compressed(spark, sf):
    path = scratch_path(spark, "csv-bz2")
    chosen = table(spark, sf, "orders").select(*ORDER_NAMES)
    chosen.write.csv(path, header=True, compression="bzip2")
    return readers.scan_csv(spark, path, readers.struct_of(ORDER_FIELDS))


@query("paired_scan", """
select case when o_orderstatus = 'O' then 'test' else 'train' end as side, """
       + ", ".join(ORDER_NAMES) + " from orders")
def paired_scan(spark, sf):
    """The test file has a first line that is not data."""
    chosen = table(spark, sf, "orders").select(*ORDER_NAMES)
    paths = [scratch_path(spark, "pair-train"), scratch_path(spark, "pair-test")]
    chosen.where("o_orderstatus <> 'O'").write.csv(paths[0], header=True)
    chosen.where("o_orderstatus = 'O'").write.csv(paths[1], header=True)
    schema = readers.struct_of(ORDER_FIELDS)
    train, test = readers.paired_scan(lambda p: readers.scan_csv(spark, p, schema), *paths)
    sides = [f.withColumn("side", F.lit(s)) for f, s in ((train, "train"), (test, "test"))]
    return sides[0].unionByName(sides[1])


@query("write_trace", f"""with {TRACE.replace("user_id as run_id", "user_id % 10 as run_id")}
select run_id, epoch, round(mse, 6) + 0e0 as mse from tr""")
def write_trace(spark, sf):
    """Two appends, as two epochs' reports would be."""
    path = scratch_path(spark, "trace")
    trace = event_trace(spark, sf).withColumn("run_id", F.col("run_id") % 10).select(
        "run_id", "epoch", "mse"
    )
    writers.write_trace(trace.where("epoch = 0"), path)
    writers.write_trace(trace.where("epoch > 0"), path)
    back = spark.read.schema(trace.schema).parquet(path)
    return back.select("run_id", "epoch", r6("mse", "mse"))


@query("write_eps_curve", f"""with {LEDGER.replace("lg as", "l0 as")},
lg as (select distinct sigma, 0.05e0 as q from l0), {moments_sql()}
select sigma, round(min((200 * lm - ln(1e-5)) / o), 6) + 0e0 as eps from lm group by sigma""")
def write_eps_curve(spark, sf):
    sigmas = order_ledger(spark, sf).select("sigma").distinct()
    path = writers.write_eps_curve(eps_curve(sigmas, 0.05, 200), scratch_path(spark, "curve"))
    schema = readers.struct_of([("sigma", "double"), ("eps", "double")])
    return readers.scan_csv(spark, path, schema, header=False).select("sigma", r6("eps", "eps"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LOADED_SQL = f"""
with x as (
  select round(o_totalprice)::double as y,
         [{", ".join(f"(o_orderpriority = '{p}')::int::double" for p in PRIORITIES)}, o_custkey::double,
          {", ".join(f"(o_orderstatus = '{s}')::int::double" for s in "FO")}] as f from orders),
l as (select y, f, y || ' ' || array_to_string(list_transform(list_filter(range(1, 9), lambda i: f[i] <> 0e0),
             lambda i: i || ':' || f[i]), ' ') as line from x),
k as (select y, f, md5(line) || '-' || (row_number() over (partition by line) - 1) as row_id from l),
r as (select *, row_number() over (order by md5('42|' || row_id), row_id)
             <= (select ceil(count(*) * 0.25e0) from k) as test from k),
m as (select avg(y) filter (not test) as mean from r),
p as (select row_id, test, unnest(f) as v, unnest(range(8)) as i from r),
a as (select i, max(abs(v)) as top from p where not test group by i),
s as (select row_id, i, v / case when top = 0e0 then 1e0 else top end as v from p join a using (i)),
n as (select row_id, sqrt(sum(v * v)) as length from s group by row_id)
select case when test then 'test' else 'train' end as side, row_id, round(y - mean, 6) + 0e0 as y,
       i::int as idx, round(v / length, 6) + 0e0 as value
from s join n using (row_id) join r using (row_id), m where v <> 0e0"""


@query("load_dataset", LOADED_SQL)
def load_dataset_query(spark, sf):
    """Orders written as a sparse label file and loaded through a regression recipe."""
    root = scratch_path(spark, "datasets")
    flags = [("o_orderpriority", p) for p in PRIORITIES], [("o_orderstatus", s) for s in "FO"]
    marks = [[(F.col(c) == v).cast("double") for c, v in some] for some in flags]
    rows = table(spark, sf, "orders").select(
        F.round("o_totalprice").cast("double").alias("y"),
        F.array(*marks[0], F.col("o_custkey").cast("double"), *marks[1]).alias("features"),
    )
    readers.write_libsvm(rows, f"{root}/cadata/cadata")
    train, test = load_dataset(spark, "cadata", root)
    sides = [f.withColumn("side", F.lit(s)) for f, s in ((train, "train"), (test, "test"))]
    both = sides[0].unionByName(sides[1])
    entries = both.select("side", "row_id", r6("y", "y"), F.posexplode("features").alias("idx", "value"))
    return entries.where("value <> 0").withColumn("value", r6("value", "value"))


def customers_by_side(spark, sf, root):
    readers.write_libsvm(
        table(spark, sf, "customer").select(
            (F.col("c_acctbal") / 1e3).alias("y"),
            F.array(*[
                F.col(c).cast("double") for c in ("c_custkey", "c_nationkey", "c_acctbal")
            ], *[F.lit(0.0)] * 5).alias("features"),
        ),
        f"{root}/abalone/abalone",
    )
    return load_dataset(spark, "abalone", root)


@query("load_dataset_sides", """
with n as (select count(*) as n, ceil(count(*) * 0.25e0)::bigint as t from customer)
select 'train' as side, n - t as n, 8::int as width, 1e0 as longest from n
union all select 'test', t, 8, 1e0 from n""")
def load_dataset_sides(spark, sf):
    """Customers through the file recipe: exact shares, full width, unit rows."""
    sides = customers_by_side(spark, sf, scratch_path(spark, "datasets"))
    named = [f.withColumn("side", F.lit(s)) for s, f in zip(("train", "test"), sides)]
    both = row_sq_norm(named[0].unionByName(named[1]))
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width"),
        r6(F.sqrt(F.max("sq")), "longest"),
    )


@query("load_dataset_pair", f"""with {EMB}
select 'train' as side, count(*) as n, 90::int as width from emb where y > 0
union all select 'test', count(*), 90 from emb where y < 0""")
def load_dataset_pair(spark, sf):
    """A ready-made pair of compressed files through the regression recipe for pairs."""
    root = scratch_path(spark, "datasets")
    rows = embeddings(spark, sf)
    base = f"{root}/yearPredictionMSD/YearPredictionMSD"
    readers.write_libsvm(rows.where("y > 0"), f"{base}.bz2")
    readers.write_libsvm(rows.where("y < 0"), f"{base}.t.bz2")
    sides = load_dataset(spark, "msd", root, suffix=".bz2")
    named = [f.withColumn("side", F.lit(s)) for s, f in zip(("train", "test"), sides)]
    both = named[0].unionByName(named[1])
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")
    )
