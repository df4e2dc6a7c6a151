"""Splits, samples, lots and parts."""

from pyspark.sql import functions as F

from lotwise.operators import split
from lotwise.queries.inputs import EMB, embeddings, skips_sql, table, u_sql
from lotwise.queries.registry import query


def keyed_events(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", F.lit(1.0)).otherwise(F.lit(-1.0))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), kind.alias("y"), "value"
    )


EVENTS = """
ev as (select event_id as row_id, case when event_type = 'purchase' then 1e0 else -1e0 end as y,
              value from events),
nn as (select count(*) as n from ev)"""


def ranked_sql(seed, table_name="ev"):
    return (
        f"rk as (select *, row_number() over (order by md5('{seed}|' || row_id), row_id) as rn "
        f"from {table_name})"
    )


@query("train_test_split", f"""with {EVENTS}, {ranked_sql(42)}
select case when rn <= (select ceil(n * 0.25e0) from nn) then 'test' else 'train' end as side,
       row_id, y, value from rk""")
def train_test_split(spark, sf):
    train, test = split.train_test_split(keyed_events(spark, sf), 0.25, 42)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("validation_split", f"""with {EVENTS}, {ranked_sql(42)},
tr as (select row_id, y, value from rk where rn > (select ceil(n * 0.2e0) from nn)),
r2 as (select *, row_number() over (order by md5('7|' || row_id), row_id) as rn from tr)
select row_id, case when rn <= (select ceil(count(*) * 0.25e0) from tr) then 'validation'
                    else 'train' end as side from r2
union all
select row_id, 'validation_is_test' from rk where rn <= (select ceil(n * 0.2e0) from nn)""")
def validation_split(spark, sf):
    train, test = split.train_test_split(keyed_events(spark, sf), 0.2, 42)
    left, held = split.validation_split(train, test, 0.25, seed=7)
    _, same = split.validation_split(train, test, 0)
    parts = [(left, "train"), (held, "validation"), (same, "validation_is_test")]
    frames = [f.select("row_id", F.lit(name).alias("side")) for f, name in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("tail_split", f"""with {EVENTS},
t as (select row_number() over (order by row_id desc) as rn, * from ev)
select case when rn <= 20 then 'test' else 'train' end as side, row_id, y, value from t""")
def tail_split(spark, sf):
    train, test = split.tail_split(keyed_events(spark, sf), 20)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("unbalance_classes", f"""with {EVENTS},
t as (select *, row_number() over (partition by y order by row_id) as rn from ev)
select row_id, y, value from t where y < 0 or rn <= 500""")
def unbalance_classes(spark, sf):
    return split.unbalance_classes(keyed_events(spark, sf), n_pos=500)


@query("lot_plan", f"""with {EVENTS},
p as (select 0.3e0 as r, 2 as e union all select 700e0, 3 union all select 0e0, 1),
s as (select r, e, n, n * e as total,
             case when r <= 1 then greatest(1, ceil(r * n)) else floor(r) end as wanted from p, nn),
t as (select *, least(wanted, total)::bigint as lot_size from s)
select r as lot_ratio, n, lot_size, (total - total % lot_size)::bigint as updates,
       (total // lot_size)::bigint as lots from t""")
def lot_plan(spark, sf):
    rows = keyed_events(spark, sf)
    plans = [
        split.lot_plan(rows, ratio, epochs).withColumn("lot_ratio", F.lit(float(ratio)))
        for ratio, epochs in ((0.3, 2), (700, 3), (0, 1))
    ]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query("assign_lots_exact", f"""with {EVENTS},
r as (select row_id, e, row_number() over (partition by e order by md5('7|' || e || '|' || row_id), row_id)
             as rn from ev, range(2) t(e)),
p as (select row_id, e::int as epoch, ((e * n + rn - 1) // 900)::int as lot, n * 2 // 900 as lots
      from r, nn)
select row_id, epoch, lot from p where lot < lots""")
def assign_lots_exact(spark, sf):
    out = split.assign_lots(keyed_events(spark, sf), 900, 2, 7, "exact")
    return out.select("row_id", "epoch", "lot")


@query("assign_lots_hash", f"""with {EVENTS}, p as (select ceil(n / 900e0) as k from nn)
select row_id, e::int as epoch,
       (e * k + floor({u_sql("'7|' || e || '|' || row_id")} * k))::int as lot
from ev, range(2) t(e), p""")
def assign_lots_hash(spark, sf):
    out = split.assign_lots(keyed_events(spark, sf), 900, 2, 7, "hash")
    return out.select("row_id", "epoch", "lot")


@query("assign_lots_poisson", f"""with recursive {EVENTS},
pz as (select n, n * 2 // 900 as steps, ceil(n / 900e0)::bigint as k, least(1e0, 900e0 / n) as q from nn),
bl as (select row_id, b from ev, pz, range(0, 1000) r(b) where b * k < steps),
{skips_sql(7)}
select row_id, floor((b * k + t) / k)::int as epoch, (b * k + t)::int as lot from ch, pz where t < k and b * k + t < steps""")
def assign_lots_poisson(spark, sf):
    out = split.assign_lots(keyed_events(spark, sf), 900, 2, 7, "poisson")
    return out.select("row_id", "epoch", "lot")


@query("slice_lots", f"""with {EVENTS},
r as (select row_id, row_number() over (order by md5('7|0|' || row_id), row_id) as rn from ev),
p as (select row_id, ((rn - 1) // 900)::int as lot, n // 900 as whole from r, nn)
select row_id, case when lot < whole then lot else -1 end as lot from p""")
def slice_lots(spark, sf):
    rows = keyed_events(spark, sf)
    n = rows.count()
    return split.slice_lots(rows, 900, n, 7, 0).select("row_id", "lot")


@query("assign_partitions", f"""with {EMB},
rk as (select row_id, row_number() over (order by md5('3|' || row_id), row_id) as rn from emb)
select row_id, (ntile(7) over (order by rn) - 1)::int as part from rk""")
def assign_partitions(spark, sf):
    return split.assign_partitions(embeddings(spark, sf), 7, 3).select("row_id", "part")


@query("sample_rows", f"""with {EVENTS}, {ranked_sql(11)}
select row_id, y, value from rk where rn <= 777""")
def sample_rows(spark, sf):
    return split.sample_rows(keyed_events(spark, sf), 777, 11)
