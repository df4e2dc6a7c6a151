"""Quality metrics and run control."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.functions.tasks import task_of
from lotwise.operators import metrics
from lotwise.queries.inputs import SCORED, r6, scored, table
from lotwise.queries.registry import query

LENGTHS = """
dl as (select source as run_id, case when quality = 1 then 1e0 else -1e0 end as y,
              case when n_chars > 1000 then 1e0 else -1e0 end as prediction
       from documents join labels using (doc_id))"""


def lengths(spark, sf):
    """Is a document good, judged by its length alone; one run per source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    sign = lambda condition: F.when(condition, F.lit(1.0)).otherwise(F.lit(-1.0))
    return joined.select(
        F.col("source").alias("run_id"),
        sign(F.col("quality") == 1).alias("y"),
        sign(F.col("n_chars") > 1000).alias("prediction"),
    )


PRICES = """
pr as (select o_orderpriority as run_id, o_totalprice / 1e5 as y,
              case o_orderstatus when 'F' then 1.5e0 when 'O' then 2e0 else 2.5e0 end as prediction
       from orders)"""


def prices(spark, sf):
    status = F.col("o_orderstatus")
    guess = F.when(status == "F", F.lit(1.5)).when(status == "O", F.lit(2.0)).otherwise(F.lit(2.5))
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"),
        (F.col("o_totalprice") / 1e5).alias("y"),
        guess.alias("prediction"),
    )


@query("mse", f"""with {PRICES}
select run_id, round(avg(power(y - prediction, 2)), 6) + 0e0 as mse from pr group by run_id""")
def mse(spark, sf):
    return metrics.mse(prices(spark, sf), ["run_id"]).select("run_id", r6("mse", "mse"))


@query("r2", f"""with {PRICES}, m as (select run_id, avg(y) as m from pr group by run_id)
select run_id, round(1e0 - sum(power(y - prediction, 2)) / sum(power(y - m, 2)), 6) + 0e0 as r2
from pr join m using (run_id) group by run_id""")
def r2(spark, sf):
    return metrics.r2(prices(spark, sf), ["run_id"]).select("run_id", r6("r2", "r2"))


@query("accuracy", f"""with {LENGTHS}
select run_id, round(avg(case when y = prediction then 1e0 else 0e0 end), 6) + 0e0 as accuracy
from dl group by run_id""")
def accuracy(spark, sf):
    out = metrics.accuracy(lengths(spark, sf), ["run_id"])
    return out.select("run_id", r6("accuracy", "accuracy"))


CELLS = """
cc as (select run_id, count(*) filter (where y < 0 and prediction < 0) as tn,
              count(*) filter (where y < 0 and prediction > 0) as fp,
              count(*) filter (where y > 0 and prediction < 0) as fn,
              count(*) filter (where y > 0 and prediction > 0) as tp from dl group by run_id)"""


@query("confusion", f"with {LENGTHS}, {CELLS} select run_id, tn, fp, fn, tp from cc")
def confusion(spark, sf):
    return metrics.confusion(lengths(spark, sf), ["run_id"])


@query("precision_recall_f1", f"""with {LENGTHS}, {CELLS}
select run_id, round(coalesce(tp / nullif(tp + fp, 0)::double, 0e0), 6) + 0e0 as precision,
       round(coalesce(tp / nullif(tp + fn, 0)::double, 0e0), 6) + 0e0 as recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0e0), 6) + 0e0 as f1 from cc""")
def precision_recall_f1(spark, sf):
    out = metrics.precision_recall_f1(lengths(spark, sf), ["run_id"])
    return out.select("run_id", *[r6(c, c) for c in ("precision", "recall", "f1")])


@query("final_eval_scored", f"""with {SCORED}
select round(avg(case when (z > 0) = (y > 0) then 1e0 else 0e0 end), 6) + 0e0 as accuracy,
       count(*) filter (where y > 0 and z > 0) as tp, count(*) filter (where y < 0 and z > 0) as fp,
       count(*) filter (where y > 0 and z <= 0) as fn, count(*) filter (where y < 0 and z <= 0) as tn
from sc""")
def final_eval_scored(spark, sf):
    out = metrics.final_eval(scored(spark, sf), task_of("logistic"))
    return out.select(r6("accuracy", "accuracy"), "tp", "fp", "fn", "tn")


TRACE = """
tr as (select user_id as run_id, value as mse,
              case event_type when 'error' then 'nan'::double when 'purchase' then 'inf'::double
                              else value end as cost,
              row_number() over (partition by user_id order by event_id) - 1 as epoch from events)"""


def event_trace(spark, sf):
    """A trace per user: every event is an epoch, errors and purchases have broken costs."""
    kind = F.col("event_type")
    cost = F.when(kind == "error", F.lit(float("nan"))).when(
        kind == "purchase", F.lit(float("inf"))
    ).otherwise(F.col("value"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("value").alias("mse"), cost.alias("cost"),
        place.cast("bigint").alias("epoch"),
    )


@query("early_stop", f"""with {TRACE}
select run_id, epoch, mse > 3e0 * first_value(mse) over (partition by run_id order by epoch) as stop
from tr""")
def early_stop(spark, sf):
    return metrics.early_stop(event_trace(spark, sf)).select("run_id", "epoch", "stop")


@query("finite_check", f"""with {TRACE}
select run_id, epoch, not (isnan(cost) or isinf(cost)) as finite from tr""")
def finite_check(spark, sf):
    return metrics.finite_check(event_trace(spark, sf)).select("run_id", "epoch", "finite")


@query("pending_runs", """
select c_custkey as run_id, c_nationkey from customer
where c_custkey not in (select o_custkey from orders where o_orderstatus in ('F', 'P'))""")
def pending_runs(spark, sf):
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), "c_nationkey")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(
        F.col("o_orderstatus") == "P", "stopped"
    ).otherwise("running")
    trace = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), status.alias("status")
    )
    return metrics.pending_runs(runs, trace)
