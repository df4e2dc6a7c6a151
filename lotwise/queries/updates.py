"""The private update of one lot, step by step."""

from pyspark.sql import functions as F

from lotwise.operators import objective, split, update
from lotwise.queries.inputs import (
    DUAL, LAMBDA, SCORED, delta_sql, dual_rows, dual_state, embeddings, factor_sql,
    long_out, mean_model, model_out, normal_sql, r6,
)
from lotwise.queries.registry import query

TASKS = ("ridge", "logistic", "hinge")
LAM_N = f"({LAMBDA}e0 * n)"
CLIP = 0.2


def row_count(rows):
    return rows.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()


def stepped(spark, sf, task="ridge", clip=0):
    rows, w = dual_state(spark, sf)
    return update.delta_alpha(rows, w, task, LAMBDA, 50.0, row_count(rows), clip), w


def _register_steps():
    for task in TASKS:
        sql = f"with {DUAL} select row_id, round({delta_sql(task, lam_n=LAM_N)}, 6) + 0e0 as delta from ds, nn"

        @query(f"delta_alpha_{task}", sql)
        def delta(spark, sf, task=task):
            return stepped(spark, sf, task)[0].select("row_id", r6("delta", "delta"))

        sql = f"""with {SCORED}
select el.row_id, i::int as idx, round(v * {factor_sql(task)}, 6) + 0e0 as value
from (select row_id, y, z from sc) join (select row_id, i, v from el) el using (row_id)"""

        @query(f"grad_{task}", sql)
        def grad(spark, sf, task=task):
            rows = embeddings(spark, sf)
            out = update.gradient(rows, mean_model(rows), task)
            return long_out(out.select("row_id", F.col("gradient").alias("features")), "row_id")


_register_steps()


@query("project_box", f"""with {DUAL}
select row_id, round(y * greatest(1e-4, least(1e0 - 1e-4, y * (3e0 * alpha - y))), 6) + 0e0 as alpha
from al""")
def project_box(spark, sf):
    wide = 3.0 * F.col("alpha") - F.col("y")
    boxed = update.project_box(wide, F.col("y"))
    return dual_rows(spark, sf).select("row_id", r6(boxed, "alpha"))


DELTA_CTE = f"""
dl as (select row_id, y, alpha, {delta_sql('ridge', lam_n=LAM_N)} as d0 from ds, nn),
dc as (select row_id, y, alpha, d0, d0 / greatest(1e0, abs(d0) / {CLIP}e0) as d from dl)"""


@query("clip_scalar", f"""with {DUAL}, {DELTA_CTE}
select row_id, round(d, 6) + 0e0 as clipped, round(d0, 6) + 0e0 as off,
       round(d0, 6) + 0e0 as unbounded from dc""")
def clip_scalar(spark, sf):
    rows, _ = stepped(spark, sf)
    delta = F.col("delta")
    return rows.select(
        "row_id",
        r6(update.clip_scalar(delta, CLIP), "clipped"),
        r6(update.clip_scalar(delta, 0), "off"),
        r6(update.clip_scalar(delta, -1), "unbounded"),
    )


@query("clip_l2", f"""with {SCORED},
g as (select row_id, i, v * (z - y) as g from (select row_id, y, z from sc)
      join (select row_id, i, v from el) using (row_id)),
m as (select row_id, sqrt(sum(g * g)) as s from g group by row_id)
select row_id, i::int as idx, round(g / greatest(1e0, s / {CLIP}e0), 6) + 0e0 as value
from g join m using (row_id)""")
def clip_l2(spark, sf):
    rows = embeddings(spark, sf)
    out = update.gradient(rows, mean_model(rows), "ridge", clip=CLIP)
    return long_out(out.select("row_id", F.col("gradient").alias("features")), "row_id")


LOTS = """
rk as (select row_id, row_number() over (order by md5('5|0|' || row_id), row_id) as rn from emb),
lt as (select row_id, ((rn - 1) // 100)::int as lot from rk, nn where (rn - 1) // 100 < n // 100)"""


@query("lot_vector_sum", f"""with {DUAL}, {DELTA_CTE}, {LOTS}
select lot, i::int as idx, round(sum(v * d), 6) + 0e0 as value
from lt join dc using (row_id) join (select row_id, i, v from el) using (row_id) group by lot, i""")
def lot_vector_sum(spark, sf):
    rows, _ = stepped(spark, sf, clip=CLIP)
    lots = split.assign_lots(rows, 100, 1, 5)
    out = update.lot_vector_sum(lots, "delta", by=("lot",))
    return out.select("lot", F.col("idx").cast("int").alias("idx"), r6("value", "value"))


@query("gaussian_noise_lot", f"""with {DUAL},
s as (select 1.5e0 * sqrt(2e0 * {CLIP}e0 * {CLIP}e0) as parallel,
             1.5e0 * sqrt((4e0 * 100 * 100 - 2e0) * {CLIP}e0 * {CLIP}e0) as sequential,
             1.5e0 * {CLIP}e0 as sgd)
select i::int as idx,
       round(w + parallel * {normal_sql("'11|w|' || i")}, 6) + 0e0 as dual_parallel,
       round(w + sequential * {normal_sql("'11|w|' || i")}, 6) + 0e0 as dual_sequential,
       round(w + sgd * {normal_sql("'11|w|' || i")}, 6) + 0e0 as sgd from sv, s""")
def gaussian_noise_lot(spark, sf):
    _, w = dual_state(spark, sf)
    out = w.select(
        F.col("idx").cast("int").alias("idx"),
        *[F.col("value").alias(s) for s in ("dual_parallel", "dual_sequential", "sgd")],
    )
    for solver in ("dual_parallel", "dual_sequential", "sgd"):
        scale = update.noise_scale(solver, 1.5, CLIP, 100)
        out = update.gaussian_noise_lot(out, scale, 11, "w", F.col("idx"), column=solver)
    return out.select("idx", *[r6(c, c) for c in out.columns if c != "idx"])


@query("apply_dual_update", f"""with {DUAL}, {DELTA_CTE}, {LOTS},
dw as (select i, sum(v * d) as s from lt join dc using (row_id)
       join (select row_id, i, v from el) using (row_id) where lot = 0 group by i)
select i::int as idx, round(w + 0.5e0 * coalesce(s, 0e0), 6) + 0e0 as value
from sv left join dw using (i)""")
def apply_dual_update(spark, sf):
    rows, w = stepped(spark, sf, clip=CLIP)
    lot = split.assign_lots(rows, 100, 1, 5).where("lot = 0")
    change = update.lot_vector_sum(lot, "delta", by=())
    return model_out(update.apply_dual_update(w, change, 0.5))


@query("apply_alpha_update", f"""with {DUAL}, {DELTA_CTE}, {LOTS}
select al.row_id, round(al.alpha + 0.5e0 * case when lot = 0 then d else 0e0 end, 6) + 0e0 as alpha
from al left join lt using (row_id) left join (select row_id, d from dc) using (row_id)""")
def apply_alpha_update(spark, sf):
    rows, _ = stepped(spark, sf, clip=CLIP)
    lot = split.assign_lots(rows, 100, 1, 5).where("lot = 0")
    out = update.apply_alpha_update(dual_rows(spark, sf), lot, 0.5)
    return out.select("row_id", r6("alpha", "alpha"))


@query("apply_sgd_update", f"""with {SCORED},
g as (select i, sum(v * (z - y)) as g from (select row_id, y, z from sc)
      join (select row_id, i, v from el) using (row_id) group by i)
select i::int as idx, round(w - 0.1e0 * (g + {LAMBDA}e0 * w) / 100e0, 6) + 0e0 as value
from coef join g using (i)""")
def apply_sgd_update(spark, sf):
    rows = embeddings(spark, sf)
    w = mean_model(rows)
    graded = update.gradient(rows, w, "ridge").select(
        "row_id", F.col("gradient").alias("features"), F.lit(1.0).alias("one")
    )
    total = update.lot_vector_sum(graded, "one", by=())
    return model_out(update.apply_sgd_update(w, total, 0.1, LAMBDA, 100))


@query("optimal_dampening_dual", f"""with {DUAL}, {DELTA_CTE},
dw as (select i, sum(v * d) as d from dc join (select row_id, i, v from el) using (row_id) group by i),
a as (select sum(d * y) - sum(d * alpha) as gain, sum(d * d) as dd, count(*) as n from dc),
b as (select sum(w * d) as wd, sum(d * d) as dw, count(*) as m from sv join dw using (i))
select round((gain - wd / {LAMBDA}e0)
             / (dw / {LAMBDA}e0 + dd + 0.25e0 * dw * m / {LAMBDA}e0 + 0.25e0 * dd * n), 6) + 0e0 as gamma
from a, b""")
def optimal_dampening_dual(spark, sf):
    rows, w = stepped(spark, sf, clip=CLIP)
    change = update.lot_vector_sum(rows, "delta", by=())
    out = update.optimal_dampening_dual(rows, w, change, 0.5, LAMBDA)
    return out.select(r6("gamma", "gamma"))


RIDGE_STEP = f"""
ts as (select i, sum((y - z) * v) as g, sum(v * v) as h from (select row_id, y, z from sc)
       join (select row_id, i, v from el) using (row_id) group by i),
tn as (select count(*) as n from emb),
st as (select i, w, (g - {LAM_N} * w) / (h + {LAM_N}) as delta from coef join ts using (i), tn)"""


@query("delta_theta_ridge", f"""with {SCORED}, {RIDGE_STEP}
select i::int as idx, round(delta, 6) + 0e0 as delta from st""")
def delta_theta_ridge(spark, sf):
    rows = embeddings(spark, sf)
    out = update.delta_theta_ridge(rows, mean_model(rows), LAMBDA, row_count(rows))
    return out.select(F.col("idx").cast("int").alias("idx"), r6("delta", "delta"))


@query("delta_theta_logistic", f"""with {SCORED},
pr as (select row_id, y, exp(-y * z) / (1e0 + exp(-y * z)) as p,
              exp(-y * z) / power(1e0 + exp(-y * z), 2) as pp from sc),
ts as (select i, -sum(y * v * p) as g, sum(v * v * pp) as h from pr
       join (select row_id, i, v from el) using (row_id) group by i)
select i::int as idx, round(-(g + {LAMBDA}e0 * w) / (h + {LAMBDA}e0), 6) + 0e0 as delta
from coef join ts using (i)""")
def delta_theta_logistic(spark, sf):
    rows = embeddings(spark, sf)
    out = update.delta_theta_logistic(rows, mean_model(rows), LAMBDA)
    return out.select(F.col("idx").cast("int").alias("idx"), r6("delta", "delta"))


@query("optimal_dampening_primal", f"""with {SCORED}, {RIDGE_STEP},
dz as (select row_id, sum(v * delta) as dz from el join st using (i) group by row_id),
a as (select sum((z - y) * dz) as slope, sum(dz * dz) as zz, count(*) as n
      from sc join dz using (row_id)),
b as (select sum(w * delta) as td, sum(delta * delta) as dd, count(*) as m from st)
select round(-(slope + {LAMBDA}e0 * td)
             / (zz + {LAMBDA}e0 * dd + {LAMBDA}e0 * 0.25e0 * dd * m + 0.25e0 * zz * n), 6) + 0e0 as gamma
from a, b""")
def optimal_dampening_primal(spark, sf):
    rows = embeddings(spark, sf)
    coef = mean_model(rows)
    delta = update.delta_theta_ridge(rows, coef, LAMBDA, row_count(rows))
    scored = objective.score(rows, coef).withColumnRenamed("z", "z0")
    step = delta.select("idx", F.col("delta").alias("value"))
    both = objective.score(scored, step).select("y", F.col("z0").alias("z"), F.col("z").alias("dz"))
    out = update.optimal_dampening_primal(both, coef, delta, 0.5, LAMBDA)
    return out.select(r6("gamma", "gamma"))

