"""Cleaning, encoding and scaling."""

from pyspark.sql import functions as F

from lotwise.operators import clean, encode, scale
from lotwise.queries.inputs import (
    EMB, GAPPY, LINE, embeddings, gappy_customers, lineitems, long_out, r6, table,
)
from lotwise.queries.registry import query


@query("drop_columns", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def drop_columns(spark, sf):
    raw = table(spark, sf, "lineitem")
    return clean.drop_columns(raw, [1, 2, 5, 6, 7, "l_linestatus", "l_shipdate"])


@query("keep_features", f"""with {EMB}
select row_id, i::int as idx, round(v, 6) + 0e0 as value from el where i < 2""")
def keep_features(spark, sf):
    return long_out(clean.keep_features(embeddings(spark, sf), 2), "row_id")


@query("select_by_dtype", "select c_custkey, c_nationkey from customer")
def select_by_dtype(spark, sf):
    return clean.select_by_dtype(table(spark, sf, "customer"), "int")


@query("select_by_dtype_text", "select c_custkey, c_name, c_mktsegment from customer")
def select_by_dtype_text(spark, sf):
    return clean.select_by_dtype(table(spark, sf, "customer"), "string", keep=["c_custkey"])


@query("drop_nulls", f"""with {GAPPY}
select * from gc where c_acctbal is not null and c_mktsegment is not null""")
def drop_nulls(spark, sf):
    return clean.drop_nulls(gappy_customers(spark, sf))


@query("fill_constant", f"""with {GAPPY}
select row_id, c_nationkey, coalesce(c_acctbal, 0e0) as c_acctbal,
       coalesce(c_mktsegment, '0') as c_mktsegment from gc""")
def fill_constant(spark, sf):
    return clean.fill_constant(gappy_customers(spark, sf), 0)


@query("fill_mode", f"""with {GAPPY},
top as (select c_mktsegment as m from gc where c_mktsegment is not null
        group by 1 order by count(*) desc, 1 limit 1)
select row_id, c_nationkey, c_acctbal, coalesce(c_mktsegment, (select m from top)) as c_mktsegment
from gc""")
def fill_mode(spark, sf):
    return clean.fill_mode(gappy_customers(spark, sf), ["c_mktsegment"])


@query("fill_other_strategy", f"""with {GAPPY}
select row_id, c_nationkey, c_acctbal, coalesce(c_mktsegment, '0') as c_mktsegment from gc""")
def fill_other_strategy(spark, sf):
    return clean.fill_mode(gappy_customers(spark, sf), ["c_mktsegment"], strategy="constant")


@query("remap_label", """
select vec_id, case when label <> 0 then 1e0 else -1e0 end as y_nonzero,
       case when label = 2 then 1e0 else -1e0 end as y_two from embeddings""")
def remap_label(spark, sf):
    raw = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("y_nonzero"), F.col("label").alias("y_two")
    )
    both = clean.remap_label(raw, F.col("y_nonzero") != 0, "y_nonzero")
    return clean.remap_label(both, 2, "y_two")


@query("remap_label_text", """
select o_orderkey, case when o_orderstatus = 'F' then 1e0 else 0e0 end as o_orderstatus
from orders""")
def remap_label_text(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return clean.remap_label(raw, "F", "o_orderstatus", negative_value=0.0)


@query("category_codes", f"""with {GAPPY},
codes as (select c_mktsegment as m, dense_rank() over (order by c_mktsegment) - 1 as code
          from (select distinct c_mktsegment from gc where c_mktsegment is not null))
select row_id, coalesce(code, -1)::int as c_mktsegment from gc left join codes on c_mktsegment = m""")
def category_codes(spark, sf):
    return encode.category_codes(
        gappy_customers(spark, sf).select("row_id", "c_mktsegment"), ["c_mktsegment"]
    )


@query("category_codes_many_levels", """
with codes as (select props as p, dense_rank() over (order by props) - 1 as code
               from (select distinct props from events where props is not null))
select event_id, coalesce(code, -1)::int as props from events left join codes on props = p""")
def category_codes_many_levels(spark, sf):
    return encode.category_codes(table(spark, sf, "events").select("event_id", "props"), ["props"])


@query("one_hot", """
select o_orderkey, """ + ", ".join(
    f"case when o_orderstatus = '{v}' then 1 else 0 end as \"o_orderstatus_{v}\"" for v in "OP"
) + " from orders")
def one_hot(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_hot(raw, ["o_orderstatus"], drop=["o_orderstatus_F"])


ONE_HOT_FREQ_SQL = f"""with {GAPPY},
other as (select s_suppkey as row_id, case s_nationkey % 2 when 0 then 'BUILDING' else 'HOUSEHOLD' end
                 as c_mktsegment from supplier),
lv as (select c_mktsegment as v,
              row_number() over (order by count(*) desc, c_mktsegment) - 2 as idx
       from (select c_mktsegment from gc union all select c_mktsegment from other)
       where c_mktsegment is not null group by 1)
select p.side, row_id, idx::int as idx, case when p.c_mktsegment = v then 1e0 else 0e0 end as value
from (select 'train' as side, row_id, c_mktsegment from gc
      union all select 'test', row_id, c_mktsegment from other) p
     cross join (select * from lv where idx >= 0)"""


@query("one_hot_freq", ONE_HOT_FREQ_SQL)
def one_hot_freq(spark, sf):
    train = gappy_customers(spark, sf).select("row_id", "c_mktsegment")
    test = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("row_id"),
        F.when(F.col("s_nationkey") % 2 == 0, "BUILDING").otherwise("HOUSEHOLD").alias("c_mktsegment"),
    )
    sides = encode.one_hot_freq(train, test, ["c_mktsegment"])
    out = []
    for side, frame in zip(("train", "test"), sides):
        names = [c for c in frame.columns if c != "row_id"]
        wide = encode.assemble(frame, [], names, keep=("row_id",)).withColumn("side", F.lit(side))
        out.append(long_out(wide, "side", "row_id"))
    return out[0].unionByName(out[1])


@query("one_hot_long", """
with marks as (select event_id as row_id, 'event_type=' || event_type as lv from events
               union all select event_id, 'props=' || props from events where props is not null),
ix as (select lv, dense_rank() over (order by lv) - 1 as idx from (select distinct lv from marks))
select row_id, idx::int as idx, 1e0 as value from marks join ix using (lv)""")
def one_hot_long(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type", "props")
    out = encode.one_hot_long(raw, ["event_type", "props"])
    return out.select("row_id", F.col("idx").cast("int").alias("idx"), "value")


@query("assemble", """
with w as (select o_orderkey as row_id,
                  [o_totalprice, (o_orderstatus = 'F')::int::double, (o_orderstatus = 'O')::int::double,
                   (o_orderstatus = 'P')::int::double] as x from orders)
select row_id, unnest(range(4))::int as idx, unnest(x) as value from w""")
def assemble(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderstatus"
    )
    marked = encode.one_hot(raw, ["o_orderstatus"])
    names = [c for c in marked.columns if c.startswith("o_orderstatus_")]
    return long_out(encode.assemble(marked, ["o_totalprice"], names), "row_id")


SPARSE_EMB = """
th as (select row_id, y, i, case when abs(v) >= 0.1e0 then v else 0e0 end as v from el)"""


def thresholded(spark, sf):
    """Embeddings with small entries set to zero: a sparse table."""
    rows = embeddings(spark, sf)
    kept = F.transform("features", lambda v: F.when(F.abs(v) >= 0.1, v).otherwise(F.lit(0.0)))
    return rows.withColumn("features", kept)


@query("to_dense", f"""with {EMB}, {SPARSE_EMB}
select row_id, i::int as idx, round(v, 6) + 0e0 as value from th""")
def to_dense(spark, sf):
    return long_out(encode.to_dense(encode.to_sparse(thresholded(spark, sf))), "row_id")


@query("to_long", f"""with {EMB}, {SPARSE_EMB}
select row_id, i::int as idx, round(v, 6) + 0e0 as value from th where v <> 0""")
def to_long(spark, sf):
    out = encode.to_long(thresholded(spark, sf))
    return out.select("row_id", F.col("idx").cast("int").alias("idx"), r6("value", "value"))


@query("to_wide", f"""with {EMB}, {SPARSE_EMB},
kept as (select distinct row_id from th where v <> 0)
select row_id, i::int as idx, round(v, 6) + 0e0 as value from th join kept using (row_id)""")
def to_wide(spark, sf):
    return long_out(encode.to_wide(encode.to_long(thresholded(spark, sf)), 64), "row_id")


@query("pad_features", f"""with {EMB},
p as (select row_id, y, x || [0e0, 0e0] as x from emb)
select row_id, unnest(range(len(x)))::int as idx, round(unnest(x), 6) + 0e0 as value from p""")
def pad_features(spark, sf):
    return long_out(encode.pad_features(embeddings(spark, sf), 66), "row_id")


@query("add_intercept", f"""with {EMB},
p as (select row_id, y, [1e0] || x as x from emb)
select row_id, unnest(range(len(x)))::int as idx, round(unnest(x), 6) + 0e0 as value from p""")
def add_intercept(spark, sf):
    return long_out(encode.add_intercept(embeddings(spark, sf)), "row_id")


@query("add_intercept_sparse", f"""with {EMB}, {SPARSE_EMB}
select row_id, (i + 1)::int as idx, round(v, 6) + 0e0 as value from th where v <> 0
union all select row_id, 0, 1e0 from emb""")
def add_intercept_sparse(spark, sf):
    out = encode.add_intercept(encode.to_sparse(thresholded(spark, sf)))
    return long_out(out, "row_id")


LINE_KEYS = ("l_orderkey", "l_linenumber")


def line_scaled(value, stats, extra=""):
    """SQL of a per-feature scaling of the line items."""
    return f"""with {LINE}, st as (select i, {stats} from ll {extra} group by i)
select l_orderkey, l_linenumber, i::int as idx, round({value}, 6) + 0e0 as value
from ll join st using (i)"""


@query("standard_scale", line_scaled(
    "(v - m) / case when s = 0 then 1e0 else s end", "avg(v) as m, stddev_pop(v) as s"))
def standard_scale(spark, sf):
    rows = lineitems(spark, sf)
    return long_out(scale.standard_scale(rows, rows), *LINE_KEYS)


@query("standard_scale_each", f"""with {LINE},
st as (select y, i, avg(v) as m, stddev_pop(v) as s from ll group by y, i)
select l_orderkey, l_linenumber, y, i::int as idx,
       round((v - m) / case when s = 0 then 1e0 else s end, 6) + 0e0 as value
from ll join st using (y, i)""")
def standard_scale_each(spark, sf):
    rows = lineitems(spark, sf)
    one, two = scale.standard_scale_each(rows.where("y = 1"), rows.where("y = 0"))
    return long_out(one.unionByName(two), *LINE_KEYS, "y")


@query("max_abs_scale", line_scaled(
    "v / case when s = 0 then 1e0 else s end", "max(abs(v)) as s", "where y = 1"))
def max_abs_scale(spark, sf):
    rows = lineitems(spark, sf)
    return long_out(scale.max_abs_scale(rows.where("y = 1"), rows), *LINE_KEYS)


@query("max_abs_scale_sparse", f"""with {EMB}, {SPARSE_EMB},
st as (select i, max(abs(v)) as s from th group by i)
select row_id, i::int as idx, round(v / case when s = 0 then 1e0 else s end, 6) + 0e0 as value
from th join st using (i) where v <> 0""")
def max_abs_scale_sparse(spark, sf):
    rows = encode.to_sparse(thresholded(spark, sf))
    return long_out(scale.max_abs_scale(rows, rows), "row_id")


@query("row_l2_normalize", f"""with {LINE},
nm as (select l_orderkey, l_linenumber, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) as s from li)
select l_orderkey, l_linenumber, unnest(range(4))::int as idx,
       round(unnest(x) / case when s = 0 then 1e0 else s end, 6) + 0e0 as value from nm""")
def row_l2_normalize(spark, sf):
    return long_out(scale.row_l2_normalize(lineitems(spark, sf)), *LINE_KEYS)


@query("col_l1_normalize", f"""with {LINE},
st as (select y, i, sum(abs(v)) as s from ll group by y, i)
select l_orderkey, l_linenumber, y, i::int as idx, round(1e6 * v / s, 6) + 0e0 as value
from ll join st using (y, i)""")
def col_l1_normalize(spark, sf):
    rows = lineitems(spark, sf)
    parts = [scale.col_l1_normalize(rows.where(F.col("y") == y)) for y in (0.0, 1.0)]
    # Shares of a column's total are tiny: shown in millionths.
    long = encode.entries(parts[0].unionByName(parts[1]), keep=(*LINE_KEYS, "y"), zeros=True)
    idx = F.col("idx").cast("int").alias("idx")
    return long.select(*LINE_KEYS, "y", idx, r6(F.col("value") * 1e6, "value"))


@query("mean_range_normalize", line_scaled(
    "(v - m) / nullif(s, 0)", "avg(v) as m, max(v) - min(v) as s"))
def mean_range_normalize(spark, sf):
    return long_out(scale.mean_range_normalize(lineitems(spark, sf)), *LINE_KEYS)


@query("center_target", """
with m as (select avg(o_totalprice) as m from orders where o_orderstatus <> 'O')
select case when o_orderstatus <> 'O' then 'train' else 'test' end as side, o_orderkey as row_id,
       round(o_totalprice - (select m from m), 4) + 0e0 as y from orders""")
def center_target(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"), "o_orderstatus"
    )
    train, test = raw.where("o_orderstatus <> 'O'"), raw.where("o_orderstatus = 'O'")
    sides = scale.center_target(train, test)
    named = [f.withColumn("side", F.lit(s)) for s, f in zip(("train", "test"), sides)]
    both = named[0].unionByName(named[1])
    return both.select("side", "row_id", (F.round("y", 4) + F.lit(0.0)).alias("y"))
