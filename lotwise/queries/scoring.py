"""Scores, losses, objectives and diagnostics."""

from pyspark.sql import functions as F

from lotwise.operators import encode, objective
from lotwise.queries.inputs import (
    COEF, DUAL, EMB, LAMBDA, SCORED, dual_loss_sql, dual_rows, dual_state, embeddings, loss_sql,
    mean_model, model_out, r6, scored,
)
from lotwise.queries.prep import SPARSE_EMB, thresholded
from lotwise.queries.registry import query

TASKS = ("ridge", "logistic", "hinge")


@query("score", f"with {SCORED} select row_id, round(z, 6) + 0e0 as z from sc")
def score(spark, sf):
    return scored(spark, sf).select("row_id", r6("z", "z"))


SPARSE_SCORE_SQL = f"""with {COEF}, {SPARSE_EMB}
select row_id, round(sum(v * w), 6) + 0e0 as z from th join coef using (i) group by row_id"""


@query("score_sparse", SPARSE_SCORE_SQL)
def score_sparse(spark, sf):
    model = mean_model(embeddings(spark, sf))
    rows = encode.to_sparse(thresholded(spark, sf))
    return objective.score(rows, model).select("row_id", r6("z", "z"))


@query("score_long", f"""with {COEF}, {SPARSE_EMB}
select row_id, round(sum(v * w), 6) + 0e0 as z from th join coef using (i)
where v <> 0 group by row_id""")
def score_long(spark, sf):
    model = mean_model(embeddings(spark, sf))
    long = encode.to_long(thresholded(spark, sf))
    return objective.score_long(long, model).select("row_id", r6("z", "z"))


@query("predict_regression", f"""with {SCORED}
select row_id, y, round(z - 0.25e0, 6) + 0e0 as prediction from sc""")
def predict_regression(spark, sf):
    rows = embeddings(spark, sf)
    shifted = mean_model(rows).select((F.col("idx") + 1).alias("idx"), "value")
    constant = rows.limit(1).select(F.lit(0).alias("idx"), F.lit(-0.25).alias("value"))
    out = objective.predict_regression(rows, constant.unionByName(shifted))
    return out.select("row_id", "y", r6("prediction", "prediction"))


@query("predict_class", f"""with {SCORED}
select row_id, y, case when z > 0 then 1e0 else -1e0 end as prediction from sc""")
def predict_class(spark, sf):
    rows = embeddings(spark, sf)
    return objective.predict_class(rows, mean_model(rows), fit_intercept=False)


def _register_losses():
    for task in TASKS:
        sql = f"with {SCORED} select round(avg({loss_sql(task)}), 6) + 0e0 as loss from sc"

        @query(f"loss_{task}", sql)
        def primal(spark, sf, task=task):
            return objective.primal_loss(scored(spark, sf), task).select(r6("loss", "loss"))

        sql = f"with {DUAL} select round(avg({dual_loss_sql(task)}), 6) + 0e0 as loss from al"

        @query(f"dual_loss_{task}", sql)
        def dual(spark, sf, task=task):
            return objective.dual_loss(dual_rows(spark, sf), task).select(r6("loss", "loss"))

        sql = f"""with {SCORED}, pen as (select sum(w * w) as s from coef)
select round(avg({loss_sql(task)}) + {LAMBDA}e0 / 2 * any_value(s), 6) + 0e0 as objective
from sc, pen"""

        @query(f"primal_objective_{task}", sql)
        def primal_objective(spark, sf, task=task):
            rows = embeddings(spark, sf)
            out = objective.primal_objective(rows, mean_model(rows), LAMBDA, task)
            return out.select(r6("objective", "objective"))

        sql = f"""with {DUAL}, pen as (select sum(w * w) as s from sv)
select round(avg({dual_loss_sql(task)})
             + any_value(s) / (2e0 * {LAMBDA}e0 * count(*) * count(*)), 6) + 0e0 as objective
from al, pen"""

        @query(f"dual_objective_{task}", sql)
        def dual_objective(spark, sf, task=task):
            out = objective.dual_objective(dual_rows(spark, sf), LAMBDA, task)
            return out.select(r6("objective", "objective"))

        theta = f"(z / ({LAMBDA}e0 * n))"
        sql = f"""with {DUAL}, pen as (select sum(w * w) as s from sv),
t as (select avg({loss_sql(task, theta)}) as primal_loss, avg({dual_loss_sql(task)}) as dual_loss,
             any_value(s) / (2e0 * {LAMBDA}e0 * any_value(n) * any_value(n)) as half
      from ds, nn, pen)
select round(primal_loss, 6) + 0e0 as primal_loss, round(dual_loss, 6) + 0e0 as dual_loss,
       round(primal_loss + half, 6) + 0e0 as primal_objective,
       round(dual_loss + half, 6) + 0e0 as dual_objective,
       round(abs(primal_loss + dual_loss + 2 * half), 6) + 0e0 as gap from t"""

        @query(f"duality_gap_{task}", sql)
        def duality_gap(spark, sf, task=task):
            rows, w = dual_state(spark, sf)
            out = objective.duality_gap(rows, LAMBDA, task, w)
            return out.select(*[r6(c, c) for c in out.columns])


_register_losses()


@query("objective_logloss01", f"""with {SCORED}, pen as (select sum(w * w) as s from coef),
h as (select case when y > 0 then 1e0 else 0e0 end as t, 1e0 / (1e0 + exp(-z)) as h from sc)
select round((sum(-t * ln(h) - (1 - t) * ln(1 - h)) + {LAMBDA}e0 * any_value(s)) / count(*), 6) + 0e0
       as objective from h, pen""")
def objective_logloss01(spark, sf):
    rows = embeddings(spark, sf)
    model = mean_model(rows)
    out = objective.objective_logloss01(objective.score(rows, model), model, LAMBDA)
    return out.select(r6("objective", "objective"))


@query("shared_vector", f"with {DUAL} select i::int as idx, round(w, 6) + 0e0 as value from sv")
def shared_vector(spark, sf):
    return model_out(dual_state(spark, sf)[1])


@query("model_from_shared", f"""with {DUAL}
select i::int as idx, round(w / {LAMBDA}e0 / n, 6) + 0e0 as value from sv, nn""")
def model_from_shared(spark, sf):
    rows, w = dual_state(spark, sf)
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return model_out(objective.model_from_shared(w, LAMBDA, n))


@query("vector_compare", f"""with {DUAL}, sg as (select i, sum(v * y) as q from el group by i),
t as (select sum(w * q) as pq, sqrt(sum(w * w)) as p, sqrt(sum(q * q)) as q,
             sqrt(sum((w - q) * (w - q))) as d from sv join sg using (i))
select round(pq / (p * q), 6) + 0e0 as cosine, round(p, 6) + 0e0 as norm1,
       round(q, 6) + 0e0 as norm2, round(d, 6) + 0e0 as distance from t""")
def vector_compare(spark, sf):
    rows, w = dual_state(spark, sf)
    out = objective.vector_compare(w, objective.shared_vector(rows, "y"))
    return out.select(*[r6(c, c) for c in out.columns])


@query("lot_diagnostics", f"""with {DUAL},
r as (select row_id, e, row_number() over (partition by e order by md5('9|' || e || '|' || row_id), row_id)
             as rn from emb, range(2) t(e)),
p as (select r.row_id, e, (e * n + rn - 1) // 50 as lot from r, nn
      where (e * n + rn - 1) // 50 < n * 2 // 50),
da as (select e, lot, sqrt(sum(alpha * alpha)) as na from p join al using (row_id) group by e, lot),
dw as (select e, lot, sqrt(sum(s * s)) as nw
       from (select e, lot, i, sum(v * alpha) as s
             from p join al using (row_id) join el using (row_id) group by e, lot, i) group by e, lot)
select e::int as epoch, round(median(na), 6) + 0e0 as median_delta_alpha,
       round(median(nw), 6) + 0e0 as median_delta_w, round(avg(1e0 / (1 + lot)), 6) + 0e0 as mean_gamma,
       round(stddev_pop(1e0 / (1 + lot)), 6) + 0e0 as std_gamma
from da join dw using (e, lot) group by e""")
def lot_diagnostics(spark, sf):
    from lotwise.operators.split import assign_lots
    from lotwise.operators.update import lot_vector_sum

    lots = assign_lots(dual_rows(spark, sf), 50, 2, 9)
    rows = lots.groupBy("epoch", "lot").agg(
        F.sqrt(F.sum(F.col("alpha") * F.col("alpha"))).alias("delta_alpha_norm")
    )
    sums = lot_vector_sum(lots, "alpha", by=("epoch", "lot"))
    norms = sums.groupBy("epoch", "lot").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("delta_w_norm")
    )
    deltas = rows.join(norms, ["epoch", "lot"]).withColumn("gamma", F.lit(1.0) / (1 + F.col("lot")))
    out = objective.lot_diagnostics(deltas)
    return out.select("epoch", *[r6(c, c) for c in out.columns if c != "epoch"])


@query("max_row_norm", f"""with {EMB},
t as (select row_id, sqrt(sum(v * v)) as s from el group by row_id)
select round(max(s), 6) + 0e0 as max_norm from t""")
def max_row_norm(spark, sf):
    return objective.max_row_norm(embeddings(spark, sf)).select(r6("max_norm", "max_norm"))
